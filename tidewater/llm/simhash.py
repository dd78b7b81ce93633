"""SimHash near-duplicates: pigeonhole blocks find pairs of close fingerprints, components group them.

groups() links them further than fingerprints can tell, and then checks the similarity of
the texts' shingles; MinHash bands add the similar texts whose fingerprints differ in more bits.

Defined results
---------------
* null and empty texts, and texts of spaces only, have fingerprint zero and link to it;
* texts with fewer words than a shingle are one shingle of all their words;
* rows with equal fingerprints are in one group, however many there are; repeated
  rows and repeated ids count as any others; a null id is grouped, but is a
  component's id only if no row of the group has an id;
* an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._shared import components, small_batches, staged

SEED = 42
#: Rows of a bucket that are compared directly; larger ones are split by further blocks first.
DIRECT = 2048
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def _hashes(w: list[bytes], words: int) -> np.ndarray:
    """The hash of each shingle; of all words, if they are fewer than a shingle has."""
    joined, xx = b" ".join(w), xxhash.xxh64_intdigest
    ends = [e + i for i, e in enumerate(accumulate(map(len, w)))]
    starts = [0, *(e + 1 for e in ends[: max(0, len(w) - words)])]
    return np.array([xx(joined[s:e], SEED) for s, e in zip(starts, ends[min(words, len(w)) - 1 :], strict=True)], dtype="<u8")


def fingerprint(text: bytes | None, words: int, distinct: bool = False) -> int:
    """The fingerprint of one text (UTF-8), as an unsigned number."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    h = _hashes(w, words)
    return majority(np.unique(h) if distinct else h)


def majority(h: np.ndarray) -> int:
    """The number whose bits are 1 where they are so in over half of the hashes; 0 for none."""
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distinct: bool = False) -> DataFrame:
    """(id, fp long) of every row; fp is the unsigned fingerprint's bits."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fps = np.array([fingerprint(t.as_py(), words, distinct) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Bit masks, one for each choice of `blocks - distance` blocks out of `blocks`.

    At most `distance` blocks hold a differing bit, so two fingerprints that differ
    in at most that many bits agree on all bits of one mask at least.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks, two agreeing ones at least, whose buckets hold 256 of n evenly spread fingerprints at most."""
    blocks = distance + 2
    while blocks < distance + 5 and n / 2 ** (64 * (blocks - distance) / blocks) > 256:
        blocks += 1
    return blocks


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each pair the least label of all that they are linked to."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _link(group: np.ndarray, fp: np.ndarray, label: np.ndarray, distance: int, free: int) -> None:
    """Merge the labels of rows of one group (a sorted number) that are close.

    free: bits on which rows of a group may still differ. A group of more than DIRECT
    rows is split by `distance + 1` blocks of these bits, and again until it is small.
    """
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    row_size = np.repeat(sizes, sizes)
    left = row_size - (np.arange(n) - np.repeat(starts, sizes)) - 1  # rows of the group behind this one
    few = bin(free).count("1") <= distance
    idx = np.flatnonzero((left > 0) & (few | (row_size <= DIRECT)))
    off = 1
    while len(idx):
        near = idx[np.bitwise_count(fp[idx] ^ fp[idx + off]) <= distance]
        if len(near):
            _merge(label, near, near + off)
        off += 1
        idx = idx[left[idx] >= off]
    if few or (row_size <= DIRECT).all():
        return
    big = np.flatnonzero(row_size > DIRECT)
    bits = [b for b in range(64) if free >> b & 1]
    for piece in np.array_split(np.array(bits), distance + 1):
        mask = sum(1 << int(b) for b in piece)
        part = fp[big] & np.uint64(mask)
        order = np.lexsort((part, group[big]))
        g, p = group[big][order], part[order]
        ids = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
        rows = big[order]
        sub = np.arange(len(rows))
        _link(ids, fp[rows], sub, distance, free & ~mask)
        moved = np.flatnonzero(sub != np.arange(len(rows)))
        if len(moved):
            _merge(label, rows[moved], rows[sub[moved]])


def _bucket_links(distance: int, masks: list[int]):
    def solve(c: np.ndarray, k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
        label = np.arange(len(f))
        for which in np.unique(c):
            rows = np.flatnonzero(c == which)
            own = np.arange(len(rows))
            _link(group[rows], f[rows], own, distance, ~masks[which] & (2**64 - 1))
            label[rows] = rows[own]
        moved = np.flatnonzero(label != np.arange(len(f)))
        return pa.RecordBatch.from_arrays([pa.array(f[moved].view(np.int64)), pa.array(f[label[moved]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            now = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            c, k, f = held
            if not len(c):
                held = []
                continue
            last = np.flatnonzero((c != c[-1]) | (k != k[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield solve(c[:cut], k[:cut], f[:cut])
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield solve(*held)

    return run


def links(fps: DataFrame, fp_col: str = "fp", distance: int = 4) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs at `distance` bits or fewer do.

    fps has each fingerprint once. Every fingerprint goes to one bucket for each
    mask; a bucket's close pairs are found by comparison and reduced to a forest, so
    what leaves a bucket is no more than its rows.
    """
    n = fps.count()
    masks = block_masks(distance, blocks_for(n, distance))
    signed = [m - 2**64 if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col(fp_col).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    rows = fps.select(F.col(fp_col).alias("f"), F.explode(keys).alias("x")).select("x.c", "x.k", "f")
    n_parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n_parts, "c", "k").sortWithinPartitions("c", "k", "f")
    return dealt.mapInArrow(_bucket_links(distance, masks), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, distinct: bool = False) -> DataFrame:
    """(id, fp, fingerprint, component_id) of every row.

    component_id is the least id among all rows reachable over fingerprints that
    differ in `distance` bits or fewer.
    """
    own = staged(fingerprints(docs, id_col, text_col, words, distinct), "fingerprints")
    classes = staged(own.groupBy("fp").agg(F.min("id").alias("least_id")), "classes")
    group = components(links(classes, "fp", distance), "a", "b").select(F.col("node").alias("fp"), "root")
    rooted = classes.join(group, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    out = own.join(named, own.fp == named.f)
    return out.select("id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def cluster(texts: list[bytes], words: int, similarity: float) -> list[int]:
    """For each text the number of the text that stands for its group.

    Groups connect texts whose shingles have a Jaccard similarity of `similarity` or
    more. A text is compared with a group's members until one is similar, first with
    those that most others were similar to; the first of these stands for the group.
    """
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({hash(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))})
    hits = [0] * len(texts)
    groups: list[list[int]] = []
    for i, own in enumerate(sets):
        joined, others = [i], []
        for members in groups:
            for at, j in enumerate(members):
                a, b = (own, sets[j]) if len(own) < len(sets[j]) else (sets[j], own)
                if len(a) < similarity * len(b):
                    continue
                both = len(a & b)
                if both >= similarity * (len(a) + len(b) - both):
                    hits[j] += 1
                    hits[i] += 1
                    if at and hits[j] > hits[members[at - 1]]:
                        members[at - 1], members[at] = j, members[at - 1]
                    joined = members + joined if len(members) >= len(joined) else joined + members
                    break
            else:
                others.append(members)
        groups = [joined, *others]
    out = list(range(len(texts)))
    for members in groups:
        for j in members:
            out[j] = members[0]
    return out


#: Bounds of what is compared at once: bytes of text, and texts.
PART_BYTES, PART_TEXTS = 8 << 20, 2000


def _clustered(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def solved() -> pa.RecordBatch:
            hubs = cluster([t for _, t in rows], words, similarity)
            moved = [(f, rows[h][0]) for (f, _), h in zip(rows, hubs, strict=True) if f != rows[h][0]]
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in moved], pa.int64()) for i in (0, 1)], ["fp", "hub"])

        for b in batches:
            for *block, fp, t in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if now != block:
                    if rows:
                        yield solved()
                    now, rows = block, []
                rows.append((fp, t or b""))
        if rows:
            yield solved()

    return run


def similar(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(fp, hub): links that connect the same texts of (root, fp, t) as all similar pairs of one root do.

    The texts of a root of more than PART_BYTES or PART_TEXTS are dealt to parts of
    half that, and every two parts are compared together, so every pair meets.
    """
    n_parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = F.greatest(F.sum(F.length("t") + 64) / PART_BYTES, F.count(F.lit(1)) / PART_TEXTS)
    sizes = texts.groupBy(F.col("root").alias("r")).agg(full.alias("full"))
    parts = F.when(F.col("full") <= 1, 1).otherwise(F.ceil(2 * F.col("full"))).cast("long")
    dealt = texts.join(sizes.select("r", parts.alias("parts")), F.col("root") == F.col("r")).withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).where("parts = 1 or other != part")
    blocks = met.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp", "t")
    return blocks.repartition(n_parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "fp").mapInArrow(_clustered(words, similarity), "fp long, hub long")


#: Chance, for two texts at the least similarity, that they share no band; less for any that are more similar.
MISS = 1e-7


def banding(similarity: float) -> tuple[int, int]:
    """(bands, least hashes in a band) of the signatures for a similarity.

    Two sets have the same least hash with a chance of their Jaccard similarity, so
    they share one of the bands at least with a chance of 1 - (1 - s^rows)^bands.
    """
    if similarity >= 1:
        return 1, 1
    rows = max(1, round(math.log(0.26) / math.log(similarity)))
    return math.ceil(math.log(MISS) / math.log1p(-(similarity**rows))), rows


def shingle_print(text: bytes | None, words: int) -> tuple[int, np.ndarray]:
    """A number that tells the set of a text's shingles from others, equal for equal sets, and the shingles' hashes."""
    w = (text or b"").lower().split()
    if not w:
        return 0, np.zeros(0, np.uint64)
    h = np.unique(_hashes(w, words))
    return xxhash.xxh64_intdigest(h.tobytes(), SEED), h


def _bands(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of a signature: a hash of `rows` least hashes, each under its own mixing."""
    rng = np.random.default_rng(SEED)
    flip = rng.integers(0, 2**32, (bands * rows, 1), dtype=np.uint32)
    odd = rng.integers(0, 2**32, (bands * rows, 1), dtype=np.uint32) | np.uint32(1)
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, ((x[at : at + 512] ^ flip) * odd).min(1))
    mult = rng.integers(0, 2**63, (1, rows), dtype=np.uint64) | np.uint64(1)
    key = (least.reshape(bands, rows) * mult).sum(1, dtype=np.uint64) + rng.integers(0, 2**63, bands, dtype=np.uint64)
    return ((key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(id, fp long, bits long, n int, bands array<long>) of every row: the shingle set's number, SimHash fingerprint, size and bands.

    Bands are empty for sets so small that no other set is similar to them.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    bands, rows = banding(similarity)
    # one shingle more or less is the least that two different sets differ in
    least = math.inf if similarity >= 1 else similarity / (1 - similarity) - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_print(t.as_py(), words) for t in b.column(1)]
            fps = np.array([f for f, _ in found], dtype=np.uint64).view(np.int64)
            bits = np.array([majority(h) for _, h in found], dtype=np.uint64).view(np.int64)
            keys = [_bands(h, bands, rows) if len(h) >= least else [] for _, h in found]
            n = pa.array([len(h) for _, h in found], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(bits, pa.int64()), n, pa.array(keys, pa.list_(pa.int64()))], ["id", "fp", "bits", "n", "bands"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long, bits long, n int, bands array<long>")


def _chained(similarity: float):
    """Links of the rows of one key, sorted by size, each to the first row of a run without a gap in sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, first = None, 0, 0
        for b in batches:
            k, n, f = (b.column(c).to_numpy() for c in range(3))
            if not len(k):
                continue
            on = np.r_[key is not None and k[0] == key and size >= similarity * n[0], (k[1:] == k[:-1]) & (n[:-1] >= similarity * n[1:])]
            start = np.maximum.accumulate(np.where(on, -1, np.arange(len(k))))
            to = np.where(start < 0, first, f[start])
            key, size, first = k[-1], n[-1], to[-1]
            moved = on & (to != f)
            yield pa.RecordBatch.from_arrays([pa.array(f[moved]), pa.array(to[moved])], ["a", "b"])

    return run


def candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all fingerprints of (fp, n, bands) that share a band and may be similar by size."""
    rows = classes.select(F.explode("bands").alias("k"), "n", "fp")
    n_parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n_parts, "k").sortWithinPartitions("k", "n", "fp")
    return dealt.mapInArrow(_chained(similarity), "a long, b long").distinct()


def close(classes: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect all sets of (fp, bits) whose SimHash fingerprints `bits` differ in `distance` bits or fewer."""
    least = staged(classes.groupBy("bits").agg(F.min("fp").alias("least")), "prints")
    same = classes.join(least, "bits").where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    ends = links(least, "bits", distance)
    for end in ("a", "b"):
        ends = ends.join(least.select(F.col("bits").alias(end), F.col("least").alias(f"least_{end}")), end)
    return same.unionByName(ends.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = 8, similarity: float = 0.8) -> DataFrame:
    """(id, fp, keep_id) of every row: near-duplicates checked on the texts themselves.

    fp tells a text's set of shingles. Sets whose SimHash fingerprints differ in
    `distance` bits or fewer, which pigeonhole blocks find, form components. A similar
    pair may differ in more bits, so sets that share a band of their signatures join
    them: a pair at `similarity` shares none with a chance of MISS, whatever the length
    of the texts, and a more similar one with less. Within a component, texts whose
    shingles have a Jaccard similarity of `similarity` or more are linked; rows whose
    texts are connected by links, and rows of one set, are a group, and keep_id is its
    least id (null if no row has one). Sets too small for another to be similar are in
    no component. Components of any size are compared in full.
    """
    signed = staged(signatures(docs, id_col, text_col, words, similarity), "fingerprints")
    own = signed.select("id", "fp")
    sets = staged(signed.groupBy("fp").agg(F.min("id").alias("least_id"), F.first("bits").alias("bits"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    classes = sets.select("fp", "least_id")
    near = close(sets.where(F.size("bands") > 0).select("fp", "bits"), distance).unionByName(candidates(sets, similarity))
    group = components(near, "a", "b").select(F.col("node").alias("f"), "root")
    many = staged(classes.join(group, F.col("fp") == F.col("f")).select("root", "fp", "least_id"), "members")
    # one text of each class that has a neighbour; where ids repeat, the one with the class's fingerprint
    wanted = many.select(F.col("least_id").alias("i"), "root", "fp").hint("shuffle_hash")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("i"))).where(print_of(F.col("t"), words) == F.col("fp"))
    todo = staged(found.groupBy("root", "fp").agg(F.first("t").alias("t")), "texts")
    to = components(similar(todo, words, similarity), "fp", "hub").select(F.col("node").alias("f"), F.col("root").alias("hub"))
    hubs = classes.join(to, F.col("fp") == F.col("f"), "left").select("fp", "least_id", F.coalesce("hub", "fp").alias("hub"))
    least = hubs.groupBy(F.col("hub").alias("h")).agg(F.min("least_id").alias("keep_id"))
    named = hubs.join(least, F.col("hub") == F.col("h")).select(F.col("fp").alias("f"), "keep_id")
    return own.join(staged(named, "named"), F.col("fp") == F.col("f")).select("id", "fp", "keep_id")


def print_of(text: Column, words: int) -> Column:
    """The number of a text's set of shingles, for the few rows of which it is asked for again."""

    @F.pandas_udf("long")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(np.array([shingle_print(x, words)[0] for x in t], dtype=np.uint64).view(np.int64))

    return run(text.cast("binary"))
