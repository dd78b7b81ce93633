"""Matching of instants to recordings by start time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.intervals import micros


def nearest2_backward(pings: DataFrame, recordings: DataFrame, on: str, ping_ts: str, start: str, path: str, key: str, strict: bool = True) -> DataFrame:
    """pings with match_path and match_start: of the two starts nearest in time, the nearest that is before.

    A start at the ping's own time counts if strict is False. If both nearest starts
    lie after the ping there is no match, even if an earlier start exists. Ties go to
    the lesser path.

    The nearest two can only be among the two starts on either side, so pings and
    starts are sorted together, once forwards and once backwards, and nothing is
    paired. Every frame begins at the first row of its key, so that it is carried on
    from row to row: the time grows with a key's rows, not with their square.
    """
    back = Window.partitionBy("_k").orderBy(F.col("_t").desc(), F.col("_ping").desc(), F.col("_path").desc())
    rec = recordings.where(F.col(start).isNotNull()).select(F.col(on).alias("_k"), micros(F.col(start)).alias("_t"), F.col(path).alias("_path"), F.col(start).alias("_s"))
    p = pings.withColumns({"_k": F.col(on), "_t": micros(F.col(ping_ts))})
    own = F.struct(F.col("_t").alias("t"), F.col("_path").alias("path"), F.col("_s").alias("s"))
    r = rec.withColumns({"_me": own, "_ping": F.lit(0)})
    both = r.unionByName(p.withColumn("_ping", F.lit(1)), allowMissingColumns=True)
    # starts in order, each with the one before it; equal times: the lesser path is the nearer, so it is kept last on the left
    left = Window.partitionBy("_k").orderBy("_t", "_ping", F.col("_path").desc())
    upto = left.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_prev", F.when(F.col("_ping") == 0, F.last("_me", ignorenulls=True).over(left.rowsBetween(Window.unboundedPreceding, -1))))
    pair = F.struct(F.col("_me").alias("a"), F.col("_prev").alias("b"))
    both = both.withColumn("_l", F.last(F.when(F.col("_ping") == 0, pair), ignorenulls=True).over(upto))
    both = both.withColumn("_next", F.when(F.col("_ping") == 0, F.last("_me", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))))
    pair = F.struct(F.col("_me").alias("a"), F.col("_next").alias("b"))
    both = both.withColumn("_r", F.last(F.when(F.col("_ping") == 0, pair), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = F.filter(F.array("_l.a", "_l.b", "_r.a", "_r.b"), lambda c: c.isNotNull())
    ranked = F.array_sort(F.transform(near, lambda c: F.struct(F.abs(F.col("_t") - c.t).alias("d"), c.path.alias("path"), c.t.alias("t"), c.s.alias("s"))))
    ok = (lambda c: c.t < F.col("_t")) if strict else (lambda c: c.t <= F.col("_t"))
    hit = F.get(F.filter(F.slice(ranked, 1, 2), ok), F.lit(0))
    out = both.where("_ping = 1").withColumn("_hit", hit)
    return out.select(*pings.columns, F.col("_hit.path").alias("match_path"), F.col("_hit.s").alias("match_start"))


def nearest2_by_pairs(pings: DataFrame, recordings: DataFrame, on: str, ping_ts: str, start: str, path: str, key: str, strict: bool = True) -> DataFrame:
    """What nearest2_backward() gives, from all pairs of a key: the definition, for tests."""
    r = recordings.select(F.col(on).alias("_k"), F.col(start).alias("match_start"), F.col(path).alias("match_path"))
    t, s = micros(F.col(ping_ts)), micros(F.col("match_start"))
    w = Window.partitionBy(key).orderBy(F.abs(t - s), "match_path")
    pairs = pings.join(r, F.col(on) == F.col("_k")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2).where(t > s if strict else t >= s)
    hit = pairs.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct("match_path", "match_start"), "_n").alias("_hit"))
    return pings.join(hit, F.col(key) == F.col("_key"), "left").select(*pings.columns, "_hit.match_path", "_hit.match_start")


def asof_backward(pings: DataFrame, recordings: DataFrame, on: str, ping_ts: str, start: str, path: str) -> DataFrame:
    """pings with match_path and match_start: the latest start at or before each; of equal starts the largest path."""
    rec = recordings.where(F.col(start).isNotNull()).select(F.col(on).alias("_k"), micros(F.col(start)).alias("_t"), F.col(path).alias("_path"), F.col(start).alias("_s"), F.lit(0).alias("_ping"))
    both = rec.unionByName(pings.withColumns({"_k": F.col(on), "_t": micros(F.col(ping_ts)), "_ping": F.lit(1)}), allowMissingColumns=True)
    w = Window.partitionBy("_k").orderBy("_t", "_ping", "_path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_m", F.last(F.when(F.col("_ping") == 0, F.struct("_path", "_s")), ignorenulls=True).over(w))
    return both.where("_ping = 1").select(*pings.columns, F.col("_m._path").alias("match_path"), F.col("_m._s").alias("match_start"))


def first_match(rows: DataFrame, dimension: DataFrame, on: str, dim_key: str, value: str, order: str, broadcast_rows: int = 100_000) -> DataFrame:
    """rows with `value` of the first dimension row of their key; rows without one are dropped.

    The dimension has one row a key then; it is broadcast if it has no more than
    broadcast_rows rows.
    """
    one = dimension.groupBy(F.col(dim_key).alias("_dk")).agg(F.min_by(value, order).alias(value))
    small = one.limit(broadcast_rows + 1).count() <= broadcast_rows
    return rows.join(F.broadcast(one) if small else one, F.col(on) == F.col("_dk")).drop("_dk")
