"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

At each node every child of weight w draws -ln(u) / w for a document, u being a hash
of the document and the child's place in the tree; a rack's weight is the sum of its
shards' and a region's the sum of its racks'. The document goes down to the child
with the least draw and only that child's own children draw next. If a shard's weight
changes, the weights of its rack and region change with it and no others: a document
moves only into or out of the child on that path, at the level where its way parts
from the one before; none moves between two subtrees whose weights are the same.

A further shard gets a region of its own, so that every document keeps its way unless
the new region draws it: the new shard takes documents only into itself.

Defined results
---------------
* a null text has size 16 and the checksum of the empty text; texts of any length
  count whole, by their bytes;
* a null id is one key like any other; rows with one id are in one shard;
* shards, racks and regions without weight get no document; without any weight
  the shard is -1;
* slots number each shard's rows from 0 without gaps; reruns agree;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._shared import numbered, staged

#: Shards of a rack and racks of a region.
RACK, REGION = 5, 4
_1, _2, _3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _2
    x = (x ^ (x >> np.uint64(27))) * _3
    return x ^ (x >> np.uint64(31))


#: A node: (shard, weight) or a list of nodes.
Node = tuple[int, float] | list


def tree(shards: int, weights: dict[int, float] | None = None) -> list[list[list[tuple[int, float]]]]:
    """Regions of racks of (shard, weight); shards fill racks in order."""
    leaves = [(s, (weights or {}).get(s, 1.0)) for s in range(shards)]
    racks = [leaves[i : i + RACK] for i in range(0, shards, RACK)]
    return [racks[i : i + REGION] for i in range(0, len(racks), REGION)]


def _weight(node: Node) -> float:
    return sum(map(_weight, node)) if isinstance(node, list) else node[1]


def descend(key: np.ndarray, nodes: Node) -> np.ndarray:
    """The shard of each key (unsigned 64 bits)."""
    shard = np.full(len(key), -1, dtype=np.int32)

    def down(rows: np.ndarray, node: Node, place: np.ndarray) -> None:
        if not len(rows):
            return
        if not isinstance(node, list):
            shard[rows] = node[0]
            return
        live = [(i, child, _weight(child)) for i, child in enumerate(node) if _weight(child) > 0]
        if not live:
            return
        places = [_mixed(place + np.array([i + 1], np.uint64) * _1) for i, _, _ in live]
        draws = [-np.log(((_mixed(key[rows] ^ p) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / w for p, (_, _, w) in zip(places, live, strict=True)]
        least = np.stack(draws).argmin(axis=0)
        for k, (_, child, _) in enumerate(live):
            down(rows[least == k], child, places[k])

    down(np.arange(len(key)), nodes, np.zeros(1, np.uint64))
    return shard


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = 40, weights: dict[int, float] | None = None) -> DataFrame:
    """(id, size long, text_crc32 long, shard int, grown_shard int, slot long) of every row.

    grown_shard is the shard with one shard more, of weight 1, in a region of its own.
    """
    text = F.col(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col)).alias("h"),
    )
    now = tree(count, weights)
    grown = [*now, [[(count, 1.0)]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(descend(key, now)), pa.array(descend(key, grown))], ["id", "size", "text_crc32", "shard", "grown_shard"])

    placed = staged(own.mapInArrow(run, f"id {kind}, size long, text_crc32 long, shard int, grown_shard int"), "placed")
    return numbered(placed, ["shard"], ["id", "text_crc32", "size"], "slot")
