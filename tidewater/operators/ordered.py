"""Running totals and ranks over a whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.work import cut


def running_total(rows: DataFrame, order: list[str], value: str, into: str, exclusive: bool = False) -> DataFrame:
    """rows with the total of `value` up to each row (or before it), by `order`, nulls first."""
    out = running_totals(rows, [], [F.col(c) for c in order], {into: value})
    return out.withColumn(into, F.col(into) - F.coalesce(F.col(value), F.lit(0))) if exclusive else out


def running_totals(rows: DataFrame, by: list[str], order: list[Column], totals: dict[str, str]) -> DataFrame:
    """rows with a column for each of `totals` (name: column): its total up to each row of a group, by `order`.

    Rows are dealt by range of group and order, added up within each part, and the
    totals of a group's parts before are added. Dealt so, parts and groups meet in no
    more pairs than there are parts and groups, however many rows a group has.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {c: f"_of_group{i}" for i, c in enumerate(by)}
    names = {c: f"_before{i}" for i, c in enumerate(totals)}
    # written, so that the parts are the same in both uses
    dealt = cut(rows.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys.values()).orderBy("_of_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*[F.col(c).alias(k) for c, k in keys.items()], F.col("_part").alias("_of_part")).agg(*[F.sum(totals[c]).alias(t) for c, t in names.items()])
    starts = starts.withColumns({t: F.coalesce(F.sum(t).over(before), F.lit(0)) for t in names.values()})
    here = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({c: F.sum(v).over(here) for c, v in totals.items()})
    same = [F.col("_part") == F.col("_of_part"), *[F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]]
    out = out.join(starts if by else F.broadcast(starts), same)  # without groups a row a part
    return out.withColumns({c: F.col(c) + F.col(t) for c, t in names.items()}).drop("_part", "_of_part", *keys.values(), *names.values())


def prefix_index(recordings: DataFrame, order: list[str], windows: str) -> DataFrame:
    """recordings with lo and hi: the global numbers [lo, hi) of their windows."""
    return running_total(recordings, order, windows, "lo", exclusive=True).withColumn("hi", F.col("lo") + F.col(windows))


def window_count(duration: Column, length: float, whole: bool) -> Column:
    """Windows of a recording: whole ones only, or a last one that is padded too."""
    n = duration / F.lit(length)
    return (F.floor(n) if whole else F.ceil(n)).cast("long")


def window_grid(recordings: DataFrame, duration: str, length: float, whole: bool) -> DataFrame:
    """A row for each window: win_idx and its offset in the recording."""
    n = window_count(F.col(duration), length, whole)
    return recordings.withColumn("_n", n).where("_n > 0").withColumn("win_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("offset", F.col("win_idx") * F.lit(length)).drop("_n")


def lookup(indexes: DataFrame, index: str, recordings: DataFrame, recording: str, step: int = 4096) -> DataFrame:
    """indexes with the recording and the window in it, from recordings' lo and hi.

    A recording is put into each bucket of `step` numbers that it touches, for a join
    on an equal key.
    """
    last = F.floor((F.col("hi") - 1) / step)
    r = recordings.where("hi > lo").select(recording, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step), last)).alias("_b"))
    i = F.col(index)
    out = indexes.join(r, (F.floor(i / step) == F.col("_b")) & (F.col("lo") <= i) & (i < F.col("hi")))
    return out.withColumn("win_idx", i - F.col("lo")).drop("_b", "lo", "hi")
