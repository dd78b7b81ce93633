"""Splits into training and test rows that share no recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.chance import uniform
from tidewater.operators.ordered import running_total


def temporal(rows: DataFrame, recording: str, ts: str, share: float = 0.8) -> DataFrame:
    """(recording, first_ts, n, cum, split): recordings in order of their first time.

    Those up to and with the one at which `share` of all rows is reached are train.
    Rows without a time do not count.
    """
    per = rows.where(F.col(ts).isNotNull()).groupBy(recording).agg(F.min(ts).alias("first_ts"), F.count(F.lit(1)).alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    cum = running_total(per, ["first_ts", recording], "n", "cum")
    out = cum.join(F.broadcast(total))  # one row
    return out.withColumn("split", F.when(F.col("cum") - F.col("n") < F.lit(share) * F.col("total"), "train").otherwise("test")).drop("total")


def by_recordings(rows: DataFrame, chosen: DataFrame, recording: str) -> tuple[DataFrame, DataFrame]:
    """(rows of chosen recordings, the others); a null recording is not chosen."""
    keys = chosen.select(recording).distinct()
    return rows.join(keys, recording, "left_semi"), rows.join(keys, recording, "left_anti")


def by_date(date: Column, cut: str) -> Column:
    """train before the cut, test from it on; null dates have no split."""
    return F.when(date < F.lit(cut).cast("date"), "train").when(date >= F.lit(cut).cast("date"), "test")


def unparsed(rows: DataFrame, ts: str) -> DataFrame:
    """One row: rows with and without a time."""
    return rows.agg(F.count_if(F.col(ts).isNotNull()).alias("parsed"), F.count_if(F.col(ts).isNull()).alias("missing"))


def class_codes(labels: DataFrame, label: str) -> DataFrame:
    """(label, code): codes from 0 in alphabetical order. Fit on the training rows and join to both splits."""
    one = labels.where(F.col(label).isNotNull()).select(label).distinct()
    return one.withColumn("code", F.dense_rank().over(Window.orderBy(label)) - 1)


def shuffled_labels(rows: DataFrame, key: str, labels: list[str], seed: int = 9) -> DataFrame:
    """rows with shuffled_label: a random class, as a negative control."""
    at = F.floor(uniform(seed, F.col(key)) * len(labels)).cast("int") + 1
    return rows.withColumn("shuffled_label", F.element_at(F.array(*[F.lit(x) for x in labels]), at))


def one_hot(rows: DataFrame, label: str, classes: list) -> DataFrame:
    """rows with one 0/1 column for each class."""
    return rows.withColumns({f"is_{c}": F.coalesce((F.col(label) == F.lit(c)).cast("int"), F.lit(0)) for c in classes})


def copy_plan(rows: DataFrame, source: str, split: str, label: str) -> DataFrame:
    """(src, dst) of files that are to be copied to split/label/."""
    name = F.element_at(F.split(F.col(source), "/"), -1)
    return rows.where(F.col(split).isNotNull()).select(F.col(source).alias("src"), F.concat_ws("/", split, label, name).alias("dst"))
