"""What file names and paths tell: start times, stems, deployments, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deployment_key(*parts: Column) -> Column:
    """Path segments joined by "/"."""
    return F.concat_ws("/", *parts)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name up to its last dot."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    """The second segment from the end; null if there is none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def is_audio(path: Column) -> Column:
    return path.endswith(".flac") | path.endswith(".wav")


def is_recording(path: Column) -> Column:
    """An audio file that is no post-deployment check."""
    return is_audio(path) & ~path.contains("Post-Deployment")


def _short_year(text: Column, pattern: str) -> Column:
    """Two-digit years: 69 and later are of the 20th century."""
    century = F.when(F.substring(text, 1, 2) >= "69", "19").otherwise("20")
    return F.try_to_timestamp(F.concat(century, text), F.lit("yy" + pattern))


def start_time(path: Column) -> Column:
    """The recording's start that its name holds; null if no form fits.

    The last two tokens between underscores, before the first dot, are tried as
    yyyyMMdd HHmmss; then with a final 60 as 59; a last token of over six
    characters as yyMMddHHmmss; and the two tokens as yyMMdd HHmmss.
    """
    tokens = F.split(F.split(basename(path), r"\.")[0], "_")
    last = F.element_at(tokens, -1)
    day = F.when(F.size(tokens) >= 2, F.element_at(tokens, -2)).otherwise(F.lit(""))
    joined = F.concat(day, F.lit(" "), last)
    full = lambda t: F.when(t.rlike(r"^\d{8} \d{6}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd HHmmss")))
    return F.coalesce(
        full(joined),
        full(F.regexp_replace(joined, "60$", "59")),
        F.when((F.length(last) > 6) & last.rlike(r"^\d{12}$"), _short_year(last, "yyMMddHHmmss")),
        F.when(joined.rlike(r"^\d{6} \d{6}$"), _short_year(joined, "yyMMdd HHmmss")),
    )


def utc_start_time(path: Column) -> Column:
    """The start in names that end .yyyyMMdd_HHmmssZ.flac; null in others."""
    found = F.regexp_extract(path, r"\.(\d{8}_\d{6})Z\.flac$", 1)
    return F.when(found != "", F.try_to_timestamp(found, F.lit("yyyyMMdd_HHmmss")))


def leading_date(name: Column) -> Column:
    """The date that a name begins with, as yyyyMMdd; null if there is none."""
    first = F.substring(name, 1, 8)
    return F.when(first.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(first, F.lit("yyyyMMdd"))))


def clean_label(label: Column) -> Column:
    """A label that can be a folder's name."""
    return F.translate(label, "/\\ ", "___")


def remote_path(file_path: Column, file_name: Column, root: str = "DCLDE/") -> Column:
    """An object's path in the store: what follows root in file_path, folders in lower case, and the file's own name."""
    path = F.replace(file_path, F.lit("\\"), F.lit("/"))
    at = F.locate(root, path)
    inner = F.when(at > 0, F.substr(path, at + len(root))).otherwise(path)
    folders = F.regexp_replace(inner, "/?[^/]*$", "")
    return F.concat_ws("/", F.when(folders != "", F.lower(folders)), file_name)


def clip_name(stem_: Column, at: Column, suffix: str = ".flac") -> Column:
    return F.concat(stem_, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(suffix))
