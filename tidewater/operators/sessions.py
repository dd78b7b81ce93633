"""Vessel visits, and the windows that no visit covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.intervals import micros


def visits(pings: DataFrame, vessel: str, ts: str, gap_seconds: int = 600, also: list[str] | None = None) -> DataFrame:
    """(vessel, also, session, start_time, end_time, n): pings with no gap of more than gap_seconds between.

    A gap of exactly gap_seconds does not end a visit.
    """
    by = [*(also or ()), vessel]
    w = Window.partitionBy(*by).orderBy(ts)
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(w))
    marked = pings.where(F.col(ts).isNotNull()).select(*by, ts, F.coalesce((gap > gap_seconds * 1_000_000).cast("int"), F.lit(0)).alias("_new"))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "session").agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count(F.lit(1)).alias("n"))


def uncovered(windows: DataFrame, covers: DataFrame, on: dict[str, str], ts: str, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Windows whose time is in no cover of the same key, both ends included.

    on: columns of windows to those of covers. Each key's covers are merged where
    they overlap, so a time is in one merged cover at most: the last that starts at
    or before it, which one pass over the sorted key finds.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    w = Window.partitionBy(*keys)
    c = covers.where(F.col(start) <= F.col(end)).select(*[F.col(b).alias(k) for k, b in zip(keys, on.values(), strict=True)], F.col(start).cast("timestamp").alias("_t"), F.col(end).cast("timestamp").alias("_e"))
    x = windows.withColumns({k: F.col(a) for k, a in zip(keys, on, strict=True)}).withColumn("_t", F.col(ts).cast("timestamp"))
    both = x.withColumn("_win", F.lit(1)).unionByName(c.withColumn("_win", F.lit(0)), allowMissingColumns=True)
    reach = F.max("_e").over(w.orderBy("_t", "_win").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("_reach", reach).where("_win = 1 and (_t is null or _reach is null or _reach < _t)").drop(*keys, "_t", "_e", "_win", "_reach")


def uncovered_anywhere(windows: DataFrame, covers: DataFrame, ts: str, start: str = "start_time", end: str = "end_time", bucket_seconds: int = 3600) -> DataFrame:
    """Windows whose time is in no cover at all.

    Covers are put into time buckets, which gives the join an equal key. A cover goes to
    the finest of the widths (bucket_seconds, and 8 times the one before) that is no less
    than its length, so it touches two buckets at most; there is an anti-join for each
    width in use.
    """
    size = bucket_seconds * 1_000_000
    length = micros(F.col(end)) - micros(F.col(start))
    level = F.greatest(F.lit(0), F.ceil(F.log(8.0, length / F.lit(float(size))) - 1e-9)).cast("int")
    c = covers.where(F.col(start) <= F.col(end)).select(F.col(start).alias("_a"), F.col(end).alias("_b"), F.coalesce(level, F.lit(0)).alias("_level"))
    t = F.col(ts)
    for r in c.select("_level").distinct().orderBy("_level").collect():  # a time has 64 bits, so there are 22 widths at most
        width = size * 8 ** r["_level"]
        here = c.where(F.col("_level") == r["_level"]).select("_a", "_b", F.explode(F.sequence(F.floor(micros(F.col("_a")) / width), F.floor(micros(F.col("_b")) / width))).alias("_bucket"))
        here = here.groupBy("_bucket", "_a").agg(F.max("_b").alias("_b"))
        windows = windows.join(here, (F.floor(micros(t) / width) == F.col("_bucket")) & (F.col("_a") <= t) & (t <= F.col("_b")), "left_anti")
    return windows
