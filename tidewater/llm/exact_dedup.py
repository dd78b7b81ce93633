"""Exact duplicates by an extendible-hash index that is kept in shared files.

The index maps a text's 64-bit key to its bucket through a directory of key
prefixes. The directory doubles wherever a bucket would hold more than `capacity`
different keys; equal keys never part, so a bucket of one key may be larger. The
directory is a table of its own in the shared folder, and whatever writes to the
index or asks it reads it from there. Each owner task has a range of buckets, gets
their texts in key order, chains texts that share a key and tells them apart by
their bytes. It writes one entry for each different text into its part of the index
table. A row finds its entry by its bucket, its key and its place in the chain, which
the checksum of its text tells.

The directory has some ENTRIES buckets at most, since it is sent to all tasks: for
more keys than these hold, the capacity rises with the number of keys. Buckets are
read in key order and never held whole, so no task's memory grows with them.

Defined results
---------------
* null is an empty text; texts are equal if they are the same after A-Z are lower-cased;
* of equal texts the row with the largest id stays; rows that repeat that id and
  text all count as that row; null ids are smaller than any other, and a group
  with no other id has the null keep_id and keeps all its rows;
* texts of any length are read whole;
* an empty table gives an empty index and result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._shared import small_batches, staged

#: Bits of the key that the directory may use, and buckets that its capacity is chosen for at most.
DEEPEST, ENTRIES = 18, 1 << 15
#: Bytes of different texts that a map task gathers before it hands them on.
HELD = 16 << 20


def normalised(text: bytes | None) -> bytes:
    return (text or b"").lower()


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key long, sha256 binary) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [normalised(t.as_py()) for t in b.column(1)]
            key = [xxhash.xxh64_intdigest(t) - 2**63 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["id", "key", "sha256"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, key long, sha256 binary")


def directory(counts: dict[int, int], capacity: int, deepest: int = DEEPEST) -> list[tuple[int, int]]:
    """The buckets, as (local depth, prefix), in key order.

    counts: different keys by prefix of `deepest` bits. A bucket that is over
    capacity is split in two by one more bit, which doubles the directory if its
    local depth was the global one; at `deepest` bits it is left as it is.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, 0, sorted(counts.items()))]
    while todo:
        depth, prefix, held = todo.pop()
        if sum(n for _, n in held) <= capacity or depth == deepest:
            out.append((depth, prefix))
            continue
        bit = deepest - depth - 1
        for one in (1, 0):
            todo.append((depth + 1, prefix << 1 | one, [x for x in held if x[0] >> bit & 1 == one]))
    return out


def build_directory(entries: DataFrame, capacity: int = 1000) -> DataFrame:
    """The directory table: (bucket int, depth int, prefix long, first long), one row a bucket.

    first is the least key prefix of DEEPEST bits in the bucket. Different keys are
    counted by prefix; only these counts come to the driver, 2**DEEPEST at most.
    """
    prefix = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), 64 - DEEPEST)
    counts = {int(r.p): r.n for r in entries.select("key").distinct().groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = directory(counts, max(capacity, 2 * sum(counts.values()) // ENTRIES))
    rows = [(i, d, p, p << (DEEPEST - d)) for i, (d, p) in enumerate(buckets)]
    return staged(entries.sparkSession.createDataFrame(rows, "bucket int, depth int, prefix long, first long").coalesce(1), "hash-directory")


def bucket_of(key: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The bucket of each key (signed, as stored) by the buckets' first prefixes."""
    prefix = (key.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - DEEPEST)
    return (np.searchsorted(firsts, prefix.astype(np.int64), side="right") - 1).astype(np.int32)


def _firsts(table: DataFrame) -> np.ndarray:
    return np.array([r.first for r in table.orderBy("bucket").select("first").collect()], dtype=np.int64)


def build_index(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index table: (bucket int, key long, chain int, sha256 binary, n long, keep_id), one row for each different text.

    table: the directory. A map task hands on each of its different texts once, with a
    row count and largest id, so a group of copies reaches its owner as a few rows a
    map task at most.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    firsts = _firsts(table)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            key = np.array([xxhash.xxh64_intdigest(t) - 2**63 for t in held], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(bucket_of(key, firsts)), pa.array(key), pa.array(list(held), pa.binary()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], ids)], ["bucket", "key", "t", "n", "keep_id"])

        ids = None
        for b in batches:
            ids = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = normalised(t)
                if (own := held.get(t)) is None:
                    held[t] = [1, i]
                    size += len(t) + 200
                else:
                    own[0] += 1
                    own[1] = own[1] if i is None else i if own[1] is None else max(i, own[1])
            if size > HELD:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in key order; those of one key form a chain of different texts."""
        chain: list[list] = []
        now = None
        ids = None

        def out(done: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in done], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), ids))], ["bucket", "key", "chain", "sha256", "n", "keep_id"])

        def closed() -> list[list]:
            return [[x[0], x[1], c, hashlib.sha256(x[2]).digest(), x[3], x[4]] for c, x in enumerate(chain)]

        for b in batches:
            ids, done = b.column("keep_id").type, []
            for bucket, key, t, n, i in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "t", "n", "keep_id")), strict=True):
                if key != now:
                    done += closed()
                    chain, now = [], key
                for x in chain:
                    if x[2] == t:
                        x[3] += n
                        x[4] = x[4] if i is None else i if x[4] is None else max(i, x[4])
                        break
                else:
                    chain.append([bucket, key, t, n, i])
            if done:
                yield out(done)
        if chain:
            yield out(closed())

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    part = texts.mapInArrow(gathered, f"bucket int, key long, t binary, n long, keep_id {kind}")
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.floor(F.col("bucket") * owners / F.lit(len(firsts))).cast("int")
    dealt = part.repartitionById(owners, share).sortWithinPartitions("bucket", "key")
    return staged(dealt.mapInArrow(chained, f"bucket int, key long, chain int, sha256 binary, n long, keep_id {kind}"), "hash-index")


def look_up(entries: DataFrame, table: DataFrame, index: DataFrame) -> DataFrame:
    """entries' rows with the n and keep_id of the index entry that their bucket has for their key and checksum."""
    firsts, kind = _firsts(table), entries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = bucket_of(b.column(1).to_numpy(zero_copy_only=False), firsts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], ["id", "key", "sha256", "at"])

    asked = entries.select("id", "key", "sha256").mapInArrow(run, f"id {kind}, key long, sha256 binary, at int")
    held = index.select("bucket", F.col("key").alias("k"), F.col("sha256").alias("s"), "n", "keep_id")
    return asked.join(held, (F.col("at") == F.col("bucket")) & (F.col("key") == F.col("k")) & (F.col("sha256") == F.col("s"))).select("id", "sha256", "n", "keep_id")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1000) -> DataFrame:
    """(id, keep_id, group_size long, kept boolean, text_sha256 string) of every row, dropped ones too."""
    entries = staged(keys(docs, id_col, text_col), "keys")
    table = build_directory(entries, capacity)
    out = look_up(entries, table, build_index(docs, table, id_col, text_col))
    return out.select("id", "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))
