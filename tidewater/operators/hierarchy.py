"""Cluster trees: sizes, quotas by water-filling, draws and path distances.

A tree is an edge table (level, child_id, parent_id); level 1 maps rows to clusters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.chance import uniform
from tidewater.functions.vectors import euclidean


def flat_clusters(edges: list[DataFrame]) -> list[DataFrame]:
    """(row, cid) for each level: edges are (child, parent), level by level from the rows up."""
    out = [edges[0].select(F.col("child").alias("row"), F.col("parent").alias("cid"))]
    for e in edges[1:]:
        up = e.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
        out.append(out[-1].join(up, F.col("cid") == F.col("_c")).select("row", F.col("_p").alias("cid")))
    return out


def flat_sizes(edges: list[DataFrame]) -> DataFrame:
    """(level, cid, n, size_rank): rows below each cluster, and its rank among the level's by size, from 1."""
    per = [f.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(i + 1)) for i, f in enumerate(flat_clusters(edges))]
    all_ = reduce(DataFrame.unionByName, per)
    return all_.select("level", "cid", "n", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("n"), "cid")).alias("size_rank"))


def with_cut(rows: DataFrame, parent: list[str], child: str, size: str, target: str) -> DataFrame:
    """rows with cut: the largest whole x with sum(min(x, size)) <= target among a parent's children; the largest size if all fit.

    With sizes in order, the child at place i bounds x by what is left of the target
    for it and those behind; x is the largest such bound that is no less than the
    size before it, capped by the child's own size.
    """
    w = Window.partitionBy(*parent)
    o = w.orderBy(size, child)
    before = F.coalesce(F.sum(size).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.count(F.lit(1)).over(w) - F.row_number().over(o) + 1
    x = rows.withColumn("_prev", F.coalesce(F.lag(size).over(o), F.lit(0))).withColumn("_x", F.floor((F.col(target) - before) / behind))
    ok = F.col("_x") >= F.col("_prev")
    bad = (F.col(size) < 0) | (F.col(target) < 0)
    x = x.withColumn("cut", F.max(F.when(bad, F.raise_error(F.lit("sizes and targets may not be negative"))).when(ok, F.least(F.col(size), F.col("_x")))).over(w).cast("long"))
    return x.drop("_prev", "_x")


def with_quota(rows: DataFrame, parent: list[str], child: str, size: str, target: str, seed: int = 11) -> DataFrame:
    """rows with cut and quota: min(cut, size), and what remains of the target one each to children above the cut, by hashed order."""
    w = Window.partitionBy(*parent)
    x = with_cut(rows, parent, child, size, target)
    x = x.withColumn("_base", F.least("cut", F.col(size)))
    x = x.withColumn("_left", F.least(F.col(target), F.sum(size).over(w)) - F.sum("_base").over(w))
    u = uniform(seed, *[F.col(p) for p in parent], F.col(child))
    above = F.when(F.col(size) > F.col("cut"), F.row_number().over(Window.partitionBy(*parent, F.col(size) > F.col("cut")).orderBy(u, child)))
    more = F.coalesce((above <= F.col("_left")).cast("int"), F.lit(0))
    return x.withColumn("quota", (F.col("_base") + more).cast("long")).drop("_base", "_left")


def sample(rows: DataFrame, levels: list[str], key: str, target: int, multiplier: int = 1, order: str = "random", by: str | None = None, seed: int = 13) -> DataFrame:
    """rows drawn from a tree to a target size, with copy: 1 for the first draw of a row.

    levels: columns with a row's cluster at each level, from the top down. Each
    level's quota is shared among its children; sizes count multiplier times. A
    lowest cluster gives all of its rows as often as its quota allows, and the rest
    by order: random (hashed), or distance (column `by`, nearest first).
    """
    if order not in ("random", "distance"):
        raise ValueError(f"unknown order {order!r}")
    quota = None
    for i in range(len(levels)):
        path = levels[: i + 1]
        sizes = rows.groupBy(*path).agg((F.count(F.lit(1)) * multiplier).alias("_size"))
        if quota is None:
            sizes = sizes.withColumn("_target", F.lit(target)).withColumn("_root", F.lit(0))
            got = with_quota(sizes, ["_root"], path[-1], "_size", "_target", seed)
        else:
            sizes = sizes.join(quota.withColumnRenamed("quota", "_target"), path[:-1])
            got = with_quota(sizes, path[:-1], path[-1], "_size", "_target", seed + i)
        quota = got.where("quota > 0").select(*path, "quota")
    first = F.col(by) if order == "distance" and by else uniform(seed, F.col(key))
    w = Window.partitionBy(*levels)
    x = rows.join(quota, levels).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(first, key)))
    full = F.floor(F.col("quota") / F.col("_n"))
    copies = full + F.when(F.col("_r") <= F.col("quota") % F.col("_n"), 1).otherwise(0)
    x = x.withColumn("_c", copies.cast("int")).where("_c > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c"))))
    return x.drop("_n", "_r", "_c", "quota")


def path_distance(vectors: list[Column], eps: float = 0.0) -> Column:
    """The sum of distances along a path: row to centroid to its parent and on."""
    steps = [euclidean(a, b, eps) for a, b in zip(vectors[:-1], vectors[1:], strict=True)]
    return reduce(lambda a, b: a + b, steps)


def nearest_n(rows: DataFrame, distance: str, key: str, n: int) -> DataFrame:
    """The n rows of least distance."""
    return rows.orderBy(distance, key).limit(n)


def merged_nearest(state: DataFrame | None, new: DataFrame, distance: str, key: str, n: int) -> DataFrame:
    """The n nearest among those kept so far and new ones."""
    return nearest_n(new if state is None else state.unionByName(new), distance, key, n)


def merged(trees: list[DataFrame]) -> DataFrame:
    """Edge or assignment tables of several trees as one: members are appended."""
    return reduce(DataFrame.unionByName, trees)
