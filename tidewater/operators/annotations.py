"""Windows around annotated events, their labels and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.chance import uniform
from tidewater.functions.intervals import overlap_ratio, window_end, window_start
from tidewater.functions.names import clean_label


def usable(ann: DataFrame, ok: str = "FileOk", label: str = "ClassSpecies") -> DataFrame:
    """Annotations of good files with a label that is not blank."""
    return ann.where(F.col(ok) & F.col(label).isNotNull() & (F.trim(label) != ""))


def positive_length(ann: DataFrame, begin: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): annotations that end after they begin, and the others with the reason."""
    good = F.coalesce(F.col(end) > F.col(begin), F.lit(False))
    return ann.where(good), ann.where(~good).withColumn("error", F.lit("annotation ends no later than it begins"))


def checked_length(ann: DataFrame, begin: str, end: str) -> DataFrame:
    """ann; the query fails if an annotation ends no later than it begins."""
    bad = ~F.coalesce(F.col(end) > F.col(begin), F.lit(False))
    return ann.withColumn(end, F.when(bad, F.raise_error(F.lit("annotation ends no later than it begins"))).otherwise(F.col(end)))


def with_windows(ann: DataFrame, key: str, begin: str, end: str, duration: str, seed: int = 42, length: float = 5.0) -> DataFrame:
    """ann with window_start and window_end, the window's place decided by the seed and the key."""
    start = window_start(F.col(begin), F.col(end), F.col(duration), uniform(seed, F.col(key)), length)
    return ann.withColumn("window_start", start).withColumn("window_end", window_end(F.col("window_start"), F.col(duration), length))


def overlapping_labels(windows: DataFrame, key: str, recording: str, begin: str, end: str, label: str, least: float = 0.3, length: float = 5.0, bucket: float = 60.0) -> DataFrame:
    """(key, labels, num_annotations, num_labels, multilabel) of each window.

    Annotations of the same recording count that overlap the window by a ratio above
    `least`. labels are sorted, and hold the window's own label always;
    num_annotations does not count it if it overlaps too little. Long recordings are
    cut into time buckets, so that only annotations near a window are paired with it.
    """
    at = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
    w = windows.select(F.col(key).alias("_k"), F.col(recording).alias("_r"), F.col("window_start").alias("_ws"), F.col("window_end").alias("_we"), at("window_start", "window_end").alias("_b"))
    a = windows.where(F.col(end) > F.col(begin)).select(F.col(key).alias("_a"), F.col(recording).alias("_ar"), F.col(begin).alias("_as"), F.col(end).alias("_ae"), F.col(label).alias("_al"), at(begin, end).alias("_ab"))
    first = F.floor(F.greatest(F.col("_ws"), F.col("_as")) / bucket)  # a pair meets in several buckets; it counts in the first
    near = w.join(a, (F.col("_r") == F.col("_ar")) & (F.col("_b") == F.col("_ab")) & (F.col("_b") == first) & (overlap_ratio(F.col("_ws"), F.col("_we"), F.col("_as"), F.col("_ae"), length) > least))
    found = near.groupBy("_k").agg(F.collect_set("_al").alias("_set"), F.count(F.lit(1)).alias("num_annotations"))
    out = windows.select(key, label).join(found, F.col(key) == F.col("_k"), "left")
    own = F.array(F.col(label))
    out = out.withColumn("labels", F.sort_array(F.array_union(F.coalesce("_set", own), own)))
    return out.select(key, "labels", F.coalesce("num_annotations", F.lit(0)).alias("num_annotations"), F.size("labels").alias("num_labels"), (F.size("labels") > 1).alias("multilabel"))


def metadata(windows: DataFrame, labels: DataFrame, key: str, recording: str, begin: str, end: str, label: str, dataset: str, path: str, source_rate: Column, rate: int = 16_000) -> DataFrame:
    """The metadata row of each window; primary_label is cleaned, labels are not."""
    named = labels.select(F.col(key).alias("_k"), "labels", "num_annotations", "num_labels", "multilabel")
    x = windows.join(named, F.col(key) == F.col("_k"))
    clean = clean_label(F.col(label))
    return x.select(
        F.concat(clean, F.lit("/"), F.col(recording), F.lit("_"), F.col(key).cast("string"), F.lit(".wav")).alias("file"),
        clean.alias("primary_label"),
        F.array_join("labels", "|").alias("labels"),
        "multilabel",
        F.col(recording).alias("recording"),
        F.col(dataset).alias("dataset"),
        F.col(path).alias("original_filepath"),
        "window_start",
        "window_end",
        (F.col("window_end") - F.col("window_start")).alias("window_length"),
        F.col(begin).alias("annotation_start"),
        F.col(end).alias("annotation_end"),
        "num_annotations",
        "num_labels",
        source_rate.cast("int").alias("original_sample_rate"),
        F.lit(rate).alias("sample_rate"),
    )


def only_new(rows: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key is not among the existing ones."""
    return rows.join(existing.select(*on).distinct(), on, "left_anti")


def all_present(rows: DataFrame, existing: DataFrame, group: str, file: str) -> DataFrame:
    """(group, complete): whether every file of a group exists."""
    there = existing.select(F.col(file).alias("_f")).distinct().withColumn("_there", F.lit(True))
    x = rows.join(there, F.col(file) == F.col("_f"), "left")
    return x.groupBy(group).agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("complete"))


def profile(rows: DataFrame, recording: str, label: str) -> DataFrame:
    """One row: annotations, different recordings and classes."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(recording).alias("n_recordings"), F.count_distinct(label).alias("n_classes"))


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
