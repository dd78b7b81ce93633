"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

Containment of an item in a document is the share of the item's different word
shingles that the document has. Items fall into partitions by their number of
shingles. An item's sketch is its bottom-k MinHash: the k shingles with the least
hash. With k = floor((1 - threshold) * size) + 1, size being the partition's largest,
an item of at most that many shingles cannot be contained without one of its sketch's
shingles in the document, however long the document is. Documents that have a sketch
shingle are candidates; these are verified on the shingles' text.

Defined results
---------------
* words are lower-cased; an item of fewer words than a shingle is one shingle of all
  its words and is looked for as such; items without a word are in no document;
* null and empty documents contain nothing; texts of any length are read whole;
* rows with one id and different texts are judged each on its own, and rows with
  equal id and text as one; rows of a null id are judged as any others;
* items with one id are judged together; repeated items count once;
* empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm._shared import WORD, staged

#: Rows and bytes of text up to which a table of item shingles is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(words: Column, size: int, hashed: bool) -> Column:
    """All runs of `size` words, as hashes or as text."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    if hashed:
        return F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(size)]))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, size), " "))


def item_shingles(items: DataFrame, item_col: str, text_col: str, words: int) -> DataFrame:
    """(item_id, size int, s string, h long): each item's different shingles, of min(words, its words) words."""
    w = items.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    parts = []
    for n in range(1, words + 1):
        own = w.where(F.size("w") == n if n < words else F.size("w") >= n)
        pairs = F.arrays_zip(shingles(F.col("w"), n, False).alias("s"), shingles(F.col("w"), n, True).alias("h"))
        parts.append(own.select("item_id", F.lit(n).alias("size"), F.explode(pairs).alias("x")).select("item_id", "size", "x.s", "x.h"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def sketches(shingled: DataFrame, threshold: float) -> DataFrame:
    """(item_id, size, h): the bottom-k sketch of each item, k by its partition (sizes up to a power of 2)."""
    w = Window.partitionBy("item_id", "size")
    ranked = shingled.withColumn("q", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.xxhash64("h", F.lit(1)), "h")))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2("q")))
    return ranked.where(F.col("r") <= F.floor((1 - threshold) * largest + 1e-9) + 1).select("item_id", "size", "h")


def _small(df: DataFrame, text: str | None = None) -> DataFrame:
    size = df.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.octet_length(text)) if text else F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, mark long, item_id, shared long, item_size long, containment double) of every pair at the threshold or above.

    mark is xxhash64 of the document's text, and tells rows with one id apart.
    """
    shingled = staged(item_shingles(items, item_col, item_text_col, words), "item-shingles")
    sizes = sorted(r["size"] for r in shingled.select("size").distinct().collect())
    sketch = staged(sketches(shingled, threshold).select("size", "h").distinct(), "sketches")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    own = own.select("id", F.xxhash64("t").alias("mark"), words_of(F.col("t")).alias("w"))

    def exploded(rows: DataFrame, hashed: bool) -> DataFrame:
        parts = [rows.select("id", "mark", F.lit(n).alias("size"), F.explode(shingles(F.col("w"), n, hashed)).alias("g")) for n in sizes]
        out = parts[0] if parts else rows.select("id", "mark", F.lit(0).alias("size"), F.lit(0 if hashed else "").alias("g")).limit(0)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    hits = exploded(own, True).join(_small(sketch.select(F.col("size").alias("z"), "h")), (F.col("g") == F.col("h")) & (F.col("size") == F.col("z")), "left_semi")
    candidates = staged(hits.select("id", "mark").distinct(), "candidates").select(F.col("id").alias("i"), F.col("mark").alias("m"))
    some = own.join(candidates, own.id.eqNullSafe(F.col("i")) & (own.mark == F.col("m")), "left_semi")
    parts = shingled.select("item_id", F.col("size").alias("z"), "s")
    found = exploded(some, False).join(_small(parts, "s"), (F.col("g") == F.col("s")) & (F.col("size") == F.col("z")))
    shared = found.select("id", "mark", "item_id", "size", "g").distinct().groupBy("id", "mark", "item_id", "size").agg(F.count(F.lit(1)).alias("shared"))
    whole = shingled.groupBy(F.col("item_id").alias("k"), F.col("size").alias("z")).agg(F.count(F.lit(1)).alias("item_size"))
    out = shared.join(whole, F.col("item_id").eqNullSafe(F.col("k")) & (F.col("size") == F.col("z")))
    out = out.withColumn("containment", F.col("shared") / F.col("item_size"))
    return out.where(F.col("containment") >= threshold).select("id", "mark", "item_id", "shared", "item_size", "containment")
