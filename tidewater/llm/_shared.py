"""What the text operators have in common: staged tables, gapless numbering and connected components.

A job that reads a text column more than once writes the narrow part it needs to a
Parquet table in the shared folder and goes on from there. That cuts the lineage, so
a lost executor costs the tasks it ran and not the whole chain.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.work import work_folder

#: Groups (classes, languages) that a bounded sample is drawn from at most.
GROUPS = 128
#: Java regular expression of a word: a run of bytes other than the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"

def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back.

    The table stays until the caller drops it (unstage) or clears the folder, since
    results that are not yet computed may still read it.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def unstage(df: DataFrame) -> None:
    """Delete the table that staged() wrote; nothing may read it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches of text columns by rows; Spark bounds them by bytes too (arrow.maxBytesPerBatch)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_sample(df: DataFrame, group: str, marks: list[str], rows: int) -> DataFrame:
    """At most `rows` rows of each group, by a hash of the mark columns; of the GROUPS most frequent groups, null none.

    Counts first give the share of the hash range that holds about four times as many
    rows, so what is shuffled does not grow with the input.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(group).count().orderBy(F.desc("count"), group).limit(GROUPS).collect()
    if not counts:
        return df.limit(0)
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, 4 * rows / r[1]))])
    share = F.coalesce(F.try_element_at(shares, F.col(group)), F.lit(0.0))
    h = F.xxhash64(F.lit("sample"), *[F.col(c) for c in marks])
    near = df.withColumn("_h", h).where(F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53)) < share)
    order = F.row_number().over(Window.partitionBy(group).orderBy("_h", *marks))
    return near.withColumn("_n", order).where(F.col("_n") <= rows).drop("_h", "_n")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by Newton steps with a slight ridge."""
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def numbered(df: DataFrame, group: list[str], order: list[str], into: str, slices: int = 256, coarse: Column | None = None) -> DataFrame:
    """df with column `into`: a gapless number from 0 within each group.

    Rows are ordered by the coarse class (an integer column, if given), then by a
    hash of the order columns, then by these columns. A group is cut into slices by
    class and hash, the slices are numbered on their own, and the rows before each
    slice are added. So no task holds a whole group, however hot it is: the window
    over slices has at most classes x slices rows a group. Rows equal in all order
    columns are interchangeable. Reruns agree.
    """
    mixed = F.xxhash64(*[F.col(c) for c in order])
    cut = df.withColumn("_c", F.lit(0) if coarse is None else coarse).withColumn("_h", mixed).withColumn("_s", F.pmod("_h", F.lit(slices)).cast("int"))
    by = [*group, "_c", "_s"]
    before = Window.partitionBy(*group).orderBy("_c", "_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = Window.partitionBy(*by).orderBy("_h", *order)
    within = cut.withColumn("_r", F.row_number().over(here) - 1)
    pairs = {c: f"_k{i}" for i, c in enumerate(by)}
    starts = starts.select([F.col(c).alias(k) for c, k in pairs.items()] + ["_b"])
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in pairs.items()]
    out = within.join(starts, same).withColumn(into, (F.col("_r") + F.col("_b")).cast("long"))
    return out.drop("_c", "_h", "_s", "_r", "_b", *pairs.values())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node of an undirected edge list, the least node reachable.

    Alternates large-star and small-star steps; every step aggregates before it
    joins, and each round is written to the shared folder. Nothing is collected but
    a row count and a checksum a round. Null ends and loops are ignored.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = staged(e, "edges")
    seen = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = staged(small, "edges")
        unstage(e)
        e = after
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
