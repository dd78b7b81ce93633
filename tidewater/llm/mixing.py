"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

A source's target is its share of all words by weight, at most `most` times its own
words; what is above that is shared anew by weight. Each document of a source is
expected target / words times. Expected copies are summed from one random offset a
source, and a document is emitted once for each whole number that its part of the
sum crosses. Since this rounds copies and not words, a few long documents could miss
the target by their size; so documents go by levels, those of over 1/4 of the target
first, then those of over 1/16, and so on. The documents of each level are expected
as often as is needed for what the levels before have left of the target. Within a
level they stand in classes of like size, and in hashed order within a class. The
words taken miss the target by about the size of one document of the last level,
if that has enough of them; no document is taken more than `most` times.

Defined results
---------------
* a null or empty text has size 0 and takes no words; texts of any length count whole; a source of such texts only
  has target 0;
* a null source is a source of its own, last in order;
* repeated rows and ids are rows of their own; reruns agree;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm._shared import numbered, staged, word_count

#: Levels of document sizes above the last: over 1/4, 1/16, ... of a source's target.
LEVELS = 4


def weights_in_turn(turn: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights for sources in code point order, null last, from a list that repeats."""
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in turn]), F.pmod(at, F.lit(len(turn))).cast("int") + 1)


def targets(sizes: DataFrame, weight: Column, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Take the sources in order of how soon they reach their cap. If the first k are
    capped, the others share the rest at some level by weight. That level rises with
    k as long as the source capped last would get more than its cap without it, and
    falls after that; so the right k is the one with the highest level.
    """
    w = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    w = w.withColumn("reach", F.col("cap") / F.col("w"))
    everything = Window.orderBy("reach", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("reach", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("all_s", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    w = w.withColumn("b_cap", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("b_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("level", (F.col("all_s") - F.col("b_cap")) / (F.col("all_w") - F.col("b_w")))
    w = w.withColumn("level", F.max("level").over(everything))
    return w.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, most: float = 3.0, seed: int = 7, extra: list[str] | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies long, taken long) of every row.

    extra: columns that tell rows with one id apart where copies are to be made of them.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col), *[F.col(c) for c in extra or ()]).alias("mark"))
    size, weights = F.col("size"), weights_in_turn() if weight is None else weight
    own = staged(own, "sizes")
    aims = targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    same = F.col("source").eqNullSafe(F.col("s"))
    aims = staged(aims.withColumnRenamed("source", "s"), "targets")
    level = F.least(F.floor(F.log2(F.greatest(F.col("target") / size, F.lit(1.0))) / 2), F.lit(LEVELS)).cast("int")
    own = own.join(aims, same).withColumn("level", F.when(size > 0, level).otherwise(F.lit(LEVELS)))
    like = F.floor(F.log2(size + 1) * 12).cast("int")
    at = staged(numbered(own, ["source", "level"], ["id", "mark", "size"], "k", coarse=like), "levels")
    start = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def copies(rate: Column) -> Column:
        return F.least(F.floor(start + rate * (F.col("k") + 1)) - F.floor(start + rate * F.col("k")), F.lit(int(most))).cast("long")

    # what is still to be taken, and from how many words
    left = aims.select("s", "target", F.col("source_size").alias("words"))
    levels = sorted(r.level for r in at.select("level").distinct().collect()) or [LEVELS]
    done = None
    for n in levels:
        rate = F.when(F.col("words") > 0, F.least(F.greatest(F.col("target") / F.col("words"), F.lit(0.0)), F.lit(most))).otherwise(F.lit(0.0))
        rated = left.select(F.col("s").alias("z"), rate.alias("rate"))
        part = at.where(F.col("level") == n).join(rated, F.col("source").eqNullSafe(F.col("z"))).withColumn("copies", copies(F.col("rate"))).drop("z")
        done = part if done is None else done.unionByName(part)
        if n < levels[-1]:
            taken = part.groupBy(F.col("source").alias("z")).agg(F.sum(F.col("copies") * size).alias("got"), F.sum("size").alias("had"))
            left = left.join(taken, F.col("s").eqNullSafe(F.col("z")), "left")
            left = left.select("s", (F.col("target") - F.coalesce("got", F.lit(0))).alias("target"), (F.col("words") - F.coalesce("had", F.lit(0))).alias("words"))
            left = staged(left, "left")
    return done.select("id", "source", "mark", "size", "source_size", "target", "copies", (F.col("copies") * size).alias("taken"))
