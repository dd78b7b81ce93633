"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept only at minimisers: positions whose hash of GRAM words is the least
of some window of `min_words - FIRST + 1` neighbouring positions. The choice depends on
nothing but the words, and every run of min_words words has such a position with FIRST
words of the run behind it, the same one wherever the run occurs. Suffixes whose FIRST
words occur in no other document are dropped. The others are sorted, with the words
after and before them; neighbours tell how far a suffix can match to the right and to
the left. Where the two together
reach min_words, the match is extended: for each way to divide the run between left and
right, suffixes are compared on the whole run. So each run of min_words words
that another document has is found, and runs that touch are joined to spans.

Suffixes of one document that have the same words around them, as a repeated line has,
are compared once, and what is found holds at each of their places. Suffixes whose
FIRST words occur in more than HOT documents are not gathered in one task: each of
their runs is counted by its hash instead, which combines before the shuffle.

Defined results
---------------
* words are runs of bytes other than the six ASCII spaces, A-Z lower-cased;
* rows with one id are one document; so are all rows without an id, which repeat
  only against rows with one;
* null and empty texts, and texts under min_words words, have no spans; texts of any
  length are read whole;
* repeats within one document alone are no spans;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm._shared import small_batches, staged

#: Words that choose minimisers, and first words that kept suffixes are told apart by.
GRAM, FIRST = 8, 29
#: Documents with the same first words from which on these suffixes are counted by hash.
HOT = 200_000
#: Rows from which on a key counts as frequent, if it has over one in COMMON of all rows too.
OFTEN, COMMON = 1000, 100_000
#: Bytes of text hashed at a time, and suffixes compared at a time.
CHUNK, COMPARED = 1 << 20, 20_000

_BASE = 0x5851F42D4C957F2D
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 2**64)))
    return _powers[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): 64 bits of each word, one text after the other, and the words of each text."""
    data = b" ".join(texts).lower() + b" "
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(raw))
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])]
    first = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    at = np.searchsorted(start, first)
    return _mix((sums[end] - sums[start]) * down[start]), np.diff(at)


def _slid(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least (or largest) of each n neighbours, in log n steps."""
    pick, step = np.minimum if least else np.maximum, 1
    while step * 2 <= n:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def minimisers(words: np.ndarray, counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of the first words): the minimisers among all words."""
    window, n, runs = min_words - FIRST + 1, len(words) - GRAM + 1, len(words) - min_words + 1
    if runs < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(n, np.uint64)
    for j in range(GRAM):
        gram = gram * np.uint64(_BASE) + words[j : j + n]
    gram = _mix(gram)
    text = np.repeat(np.arange(len(counts)), counts)
    least = np.where(text[:runs] == text[min_words - 1 :], _slid(gram, window, True)[:runs], np.uint64(0))  # of runs within one text
    best = _slid(np.r_[np.zeros(window - 1, np.uint64), least, np.zeros(n - runs, np.uint64)], window, False)
    at = np.flatnonzero((best == gram) & (gram > 0))
    at = at[at + FIRST <= len(words)]
    at = at[text[at] == text[at + FIRST - 1]]
    up, down = _power(len(words))
    sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]
    return at, _mix((sums[at + FIRST] - sums[at]) * down[at])


def _batched(names: list, texts: list[bytes | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows in chunks of CHUNK bytes or one text: (row numbers, hashes, counts)."""
    rows: list[int] = []
    size = 0
    for i in range(len(names) + 1):
        if rows and (i == len(names) or size + len(texts[i] or b"") > CHUNK):
            yield rows, *word_hashes([texts[r] for r in rows])
            rows, size = [], 0
        if i < len(names) and texts[i]:
            rows.append(i)
            size += len(texts[i])


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, g long, pos array<int>): a row for the first words of each document's minimisers; docs: (id, t binary).

    A line that a document repeats has the same first words at many places: these are one row.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, words, counts in _batched(b.column(0), b.column(1).to_pylist()):
                at, gram = minimisers(words, counts, min_words)
                ends = np.cumsum(counts)
                text = np.searchsorted(ends, at, side="right")
                order, first = _grouped(text, gram)
                at, text, gram = at[order], text[order], gram[order]
                names = b.column(0).take(pa.array(np.array(rows, dtype=np.int64)[text[first]]))
                yield pa.RecordBatch.from_arrays([names, pa.array(gram[first].view(np.int64)), _lists(at - (ends - counts)[text], first)], ["id", "g", "pos"])

    return docs.mapInArrow(run, f"id {kind}, g long, pos array<int>")


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): an order that brings equal keys together, and where in it each different one begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """values cut into lists that begin at `first`."""
    return pa.ListArray.from_arrays(pa.array(np.r_[first, len(values)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _contexts(docs: DataFrame, min_words: int) -> DataFrame:
    """(g long, id, pos array<int>, left int, right int, ctx binary): docs' suffixes at `at`, with the words around them.

    Suffixes of one document with the same words around them are one row. ctx has 32 bits of each word from min_words - FIRST before the suffix to min_words
    after its start; left and right tell how many of these the text has.
    """
    kind = docs.schema["id"].dataType.simpleString()
    before = min_words - FIRST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(2)
            for rows, words, counts in _batched(b.column(0), b.column(1).to_pylist()):
                all_at, all_gram = minimisers(words, counts, min_words)
                first = np.cumsum(counts) - counts
                own = [np.unique(wanted[r].values.to_numpy(zero_copy_only=False)[:]) for r in rows]
                at = np.concatenate([f + o[o < c] for f, o, c in zip(first, own, counts, strict=True)]).astype(np.int64)
                k = np.searchsorted(all_at, at)
                ok = (k < len(all_at)) & (all_at[np.minimum(k, max(len(all_at) - 1, 0))] == at) if len(all_at) else np.zeros(len(at), bool)
                at, gram = at[ok], all_gram[k[ok]]
                if not len(at):
                    continue
                text = np.searchsorted(np.cumsum(counts), at, side="right")
                pos = at - first[text]
                short = np.r_[np.zeros(before, np.uint32), (words >> np.uint64(32)).astype(np.uint32), np.zeros(min_words, np.uint32)]
                ctx = np.lib.stride_tricks.sliding_window_view(short, before + min_words)[at]
                left, right = np.minimum(pos, before), np.minimum(counts[text] - pos, min_words)
                order, first = _grouped(text, gram, left, right, _mix(_run_hashes(ctx, before + min_words)[:, 0]))
                pos, kept = pos[order], order[first]
                text, gram, left, right, ctx = text[kept], gram[kept], left[kept], right[kept], ctx[kept]
                names = b.column(0).take(pa.array(np.array(rows, dtype=np.int64)[text]))
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * (before + min_words)), len(text), [None, pa.py_buffer(np.ascontiguousarray(ctx))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), names, _lists(pos, first), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), data], ["g", "id", "pos", "left", "right", "ctx"])

    return docs.mapInArrow(run, f"g long, id {kind}, pos array<int>, left int, right int, ctx binary")


def _run_hashes(ctx: np.ndarray, min_words: int) -> np.ndarray:
    """[suffix, o]: the hash of the run of min_words words that starts o words before the suffix."""
    n = ctx.shape[1]
    up, down = _power(n)
    sums = np.concatenate([np.zeros((len(ctx), 1), np.uint64), np.cumsum(_mix(ctx.astype(np.uint64) + np.uint64(1)) * up[:n], axis=1)], axis=1)
    before = n - min_words
    o = np.arange(before + 1)
    return _mix((sums[:, n - o] - sums[:, before - o]) * down[before - o])


def _reach(group: np.ndarray, words: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many first words each row shares with a neighbour in the sorted order of its group, at most."""
    keyed = np.concatenate([group[:, None].astype(">u4"), words.astype(">u4")], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1] * 4}").ravel(), kind="stable")
    s, g = words[order], group[order]
    differs = s[1:] != s[:-1]
    shared = np.where(differs.any(1), differs.argmax(1), words.shape[1])
    shared = np.where(g[1:] == g[:-1], shared, -1)
    out = np.empty(len(words), np.int64)
    out[order] = np.maximum(np.r_[shared, -1], np.r_[-1, shared])
    return np.minimum(out, limit)


def compare(group: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, ctx: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, o, other): runs that another document of the group has; ids are ranks, 0 for no id.

    other is the least rank among the documents with that run, or the largest for
    the least itself.
    """
    before = ctx.shape[1] - min_words
    r = _reach(group, ctx[:, before:], right)
    after_left = _reach(group, ctx[:, :before][:, ::-1], left) if before else np.zeros(len(group), np.int64)
    rows = np.flatnonzero((r >= FIRST) & (r + np.maximum(after_left, 0) >= min_words))
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    hashes = _run_hashes(ctx[rows], min_words)
    found = []
    for o in range(before + 1):
        on = np.flatnonzero((after_left[rows] >= o) & (r[rows] >= min_words - o)) if o else np.flatnonzero(r[rows] >= min_words)
        if len(on) < 2:
            continue
        key, who = hashes[on, o] ^ _mix(group[rows[on]].astype(np.uint64)), ids[rows[on]]
        order = np.lexsort((who, key))
        k, w = key[order], who[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[first, len(k)])
        least, most = np.repeat(w[first], size), np.repeat(w[first + size - 1], size)
        hit = np.flatnonzero(least != most)
        found.append((rows[on[order[hit]]], np.full(len(hit), o), np.where(w[hit] == least[hit], most[hit], least[hit])))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spread(pos: pa.ListArray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): each of the rows' places, and which of `row` it is of."""
    ends = pos.offsets.to_numpy().astype(np.int64)
    n = np.diff(ends)[row]
    which = np.repeat(np.arange(len(row)), n)
    at = np.repeat(ends[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return which, pos.values.to_numpy(zero_copy_only=False)[at]


def _ranges(row: np.ndarray, o: np.ndarray, other: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, other): the runs of a row with one partner, joined where they follow each other; start and end from the suffix on."""
    order = np.lexsort((o, other, row))
    row, o, other = row[order], o[order], other[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (o[1:] != o[:-1] + 1)])
    last = np.r_[first[1:], len(row)] - 1
    return row[first], -o[last], min_words - o[first], other[first]


def _compared(contexts: DataFrame, min_words: int) -> DataFrame:
    """(id, start int, end int, other): runs found among suffixes that come sorted by g."""
    kind = contexts.schema["id"].dataType.simpleString()

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        g = t["g"].to_numpy()
        names = t["id"].unique().sort() if t.num_rows else t["id"].unique()
        names = names.drop_null()
        ids = pc.fill_null(pc.index_in(t["id"], value_set=names), -1).to_numpy().astype(np.int64) + 1
        n = len(t["ctx"][0].as_py()) // 4
        ctx = np.frombuffer(b"".join(t["ctx"].to_pylist()), np.uint32).reshape(-1, n)
        group = np.cumsum(np.r_[False, g[1:] != g[:-1]])
        row, o, other = compare(group, ids, t["left"].to_numpy(), t["right"].to_numpy(), ctx, min_words)
        row, start, end, other = _ranges(row, o, other, min_words) if len(row) else (row, row, row, other)
        which, place = _spread(t["pos"].combine_chunks(), row)
        row, start, end, other = row[which], place + start[which], place + end[which], other[which]
        partner = names.take(pa.array(np.where(other > 0, other - 1, 0), mask=other == 0)) if len(names) else pa.nulls(len(other), t["id"].type)
        own = t["id"].combine_chunks()
        return pa.RecordBatch.from_arrays([own.take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), partner], ["id", "start", "end", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= COMPARED:
                t = pa.Table.from_batches(held)
                g = t["g"].to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if cut:
                    yield solve(t.slice(0, cut))
                    held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield solve(pa.Table.from_batches(held))

    return contexts.mapInArrow(run, f"id {kind}, start int, end int, other {kind}")


def _counted(contexts: DataFrame, min_words: int) -> DataFrame:
    """What _compared() gives, for suffixes that are too common for one task: runs are counted by their hash."""
    kind = contexts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = len(b.column(5)[0].as_py()) // 4
            ctx = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint32).reshape(-1, n)
            left, right = (b.column(c).to_numpy() for c in (3, 4))
            o = np.arange(n - min_words + 1)
            row, o = np.nonzero((left[:, None] >= o) & (right[:, None] >= min_words - o))
            h = _run_hashes(ctx, min_words)[row, o]
            names = b.column(1).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), names, b.column(2).take(pa.array(row)), pa.array(o.astype(np.int32))], ["h", "id", "pos", "o"])

    runs = staged(contexts.mapInArrow(run, f"h long, id {kind}, pos array<int>, o int"), "runs")
    # a null id counts as a document of its own
    many = runs.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n"))
    many = many.where("least is not null and (least != most or nameless)").select(F.col("h").alias("k"), "least", "most", "n")
    other = F.when(F.col("id").eqNullSafe(F.col("least")), F.when(F.col("least") != F.col("most"), F.col("most"))).otherwise(F.col("least"))
    found = _by_key(runs, "h", many).withColumn("start", F.explode("pos")).withColumn("start", F.col("start") - F.col("o"))
    return found.select("id", "start", (F.col("start") + min_words).cast("int").alias("end"), other.alias("other"))


def _by_key(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """rows with what facts has for their key (k, n, ...), n being the key's number of rows.

    No more than COMMON keys can have over one in COMMON of the rows. Their facts are
    sent to all tasks, so that no task gets all rows of such a key; the rest is
    joined by shuffle.
    """
    facts = staged(facts, "facts")
    often = F.broadcast(facts.where(F.col("n") > max(OFTEN, rows.count() // COMMON)))
    seldom = facts.join(often.select(F.col("k").alias("o_")), F.col("k") == F.col("o_"), "left_anti")
    rest = rows.join(often.select("k"), F.col(key) == F.col("k"), "left_anti").join(seldom, F.col(key) == F.col("k"))
    return rows.join(often, F.col(key) == F.col("k")).unionByName(rest)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(id, start int, end int, n_words int, other): spans of words that other documents have too.

    start and end number a document's words from 0, end being the first word after
    the span; other is the least id among the documents that a run of the span was
    found in.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).where(F.length("t") >= 2 * min_words - 1)
    sparse = staged(suffixes(own, min_words), "suffixes")
    shared = sparse.groupBy("g").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max(F.col("id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("a is not null and (a != b or nameless)").select(F.col("g").alias("k"), "n", (F.col("n") > HOT).alias("hot"))
    hits = staged(_by_key(sparse, "g", shared).groupBy("id", "hot").agg(F.flatten(F.collect_list("pos")).alias("at")), "hits")

    def contexts(hot: bool) -> DataFrame:
        at = hits.where(F.col("hot") == hot).select(F.col("id").alias("i"), "at")
        return _contexts(own.join(at, own.id.eqNullSafe(F.col("i"))).select("id", "t", "at"), min_words)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = _compared(contexts(False).repartition(n, "g").sortWithinPartitions("g"), min_words)
    if not hits.where("hot").isEmpty():
        runs = runs.unionByName(_counted(contexts(True), min_words))
    w = Window.partitionBy("id").orderBy("start", "end")
    runs = runs.groupBy("id", "start", "end").agg(F.min("other").alias("other"))
    behind = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", (F.col("start") > F.coalesce(behind, F.lit(-1))).cast("int"))
    runs = runs.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
    return out.select("id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "other")
