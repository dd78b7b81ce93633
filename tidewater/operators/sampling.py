"""Rarity-weighted sampling of position reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.chance import uniform
from tidewater.functions.intervals import jittered


def ping_counts(pings: DataFrame, vessel: str = "MMSI") -> DataFrame:
    """Pings of each vessel over all files."""
    return pings.groupBy(vessel).agg(F.count(F.lit(1)).alias("n"))


def merged_counts(counts: list[DataFrame], key: str, value: str = "n") -> DataFrame:
    """Counts of several tables, added up by key."""
    all_ = counts[0]
    for c in counts[1:]:
        all_ = all_.unionByName(c)
    return all_.groupBy(key).agg(F.sum(value).alias(value))


def inclusion_probability(counts: DataFrame, t: int, n: str = "n") -> DataFrame:
    """p = t / max(t, n): a vessel of t pings or fewer keeps all of them."""
    if t < 1:
        raise ValueError("t must be 1 or more")
    return counts.withColumn("p", F.lit(float(t)) / F.greatest(F.lit(t), F.col(n)))


def neighbour_jitter(pings: DataFrame, key: str, vessel: str = "MMSI", ts: str = "BaseDateTime", file: str = "ais_file", seed: int = 1, by_vessel: bool = False) -> DataFrame:
    """pings with sel_ts: a time between a ping and its neighbour in the file.

    If the next ping of the file is of the same vessel, in [own, next); else if the
    one before is, in [before, own); else the ping's own time. by_vessel looks at
    the vessel's own next and previous ping instead.
    """
    w = Window.partitionBy(file, vessel) if by_vessel else Window.partitionBy(file)
    w = w.orderBy(ts, key)
    u = uniform(seed, F.col(key))
    out = pings.withColumns({"_nv": F.lead(vessel).over(w), "_nt": F.lead(ts).over(w), "_pv": F.lag(vessel).over(w), "_pt": F.lag(ts).over(w)})
    time = F.when(F.col("_nv") == F.col(vessel), jittered(F.col(ts), F.col("_nt"), u)).when(F.col("_pv") == F.col(vessel), jittered(F.col("_pt"), F.col(ts), u)).otherwise(F.col(ts))
    return out.withColumn("sel_ts", time).drop("_nv", "_nt", "_pv", "_pt")


def rarity_sample(pings: DataFrame, t: int, key: str, vessel: str = "MMSI", ts: str = "BaseDateTime", file: str = "ais_file", seed: int = 42, by_vessel: bool = False) -> DataFrame:
    """Pings kept with p = t / max(t, pings of the vessel), with their jittered time sel_ts.

    Neighbours are taken among all pings of the file, kept or not.
    """
    p = inclusion_probability(ping_counts(pings, vessel), t).select(F.col(vessel).alias("_v"), "p")
    moved = neighbour_jitter(pings, key, vessel, ts, file, seed + 1, by_vessel)
    return moved.join(p, F.col(vessel) == F.col("_v")).where(uniform(seed, F.col(key)) < F.col("p")).drop("_v")


def random_per_cluster(rows: DataFrame, cluster: str, key: str, n: int, seed: int = 3) -> DataFrame:
    """n rows of each cluster by hashed order; all rows of smaller ones."""
    w = Window.partitionBy(cluster).orderBy(uniform(seed, F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def reservoir(rows: DataFrame, key: str, k: int, seed: int = 5) -> DataFrame:
    """A uniform sample of k rows, by hashed order."""
    return rows.orderBy(uniform(seed, F.col(key)), key).limit(k)
