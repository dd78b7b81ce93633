"""Nearest centroids, k-means in batch and online, and hierarchies of them.

Centroids are small (levels of thousands); they are counted before they come to the
driver and are broadcast up to BROADCAST_CELLS numbers, beyond which assign() refuses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.functions.chance import uniform
from tidewater.functions.vectors import distance, doubles
from tidewater.operators.work import cut

#: Numbers of all centroids up to which they are one literal of the plan, and up to which they are broadcast.
LITERAL_CELLS, BROADCAST_CELLS = 20_000, 50_000_000
#: Centres that k-means++ chooses before the distances to the nearest are written anew.
SEED_STEP = 64


def nearest(x: np.ndarray, centres: np.ndarray, kind: str = "l2") -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of each row's nearest centre; the first of equal ones.

    Distances are expanded into one matrix product, some rows at a time; where
    another centre comes within its rounding error, both are summed term by term.
    """
    place, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    norms = (centres**2).sum(1)
    step = max(1, 2_000_000 // max(1, len(centres)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = norms - 2 * (part @ centres.T) if kind == "l2" else -2 * (part @ centres.T)
        best = d.argmin(1)
        slack = 1e-9 * (1 + norms.max() + (part**2).sum(1))
        close = d <= (d[np.arange(len(part)), best] + slack)[:, None]
        for i in np.flatnonzero(close.sum(1) > 1):
            some = np.flatnonzero(close[i])
            exact = ((part[i] - centres[some]) ** 2).sum(1) if kind == "l2" else -2 * (centres[some] @ part[i])
            best[i] = some[exact.argmin()]
        place[at : at + step] = best
        dist[at : at + step] = ((part - centres[best]) ** 2).sum(1) if kind == "l2" else 2 - 2 * (part * centres[best]).sum(1)
    return place, dist


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow batch, which has a vector in every row, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def table_of(centroids: DataFrame, cid: str = "cid", cvec: str = "cvec") -> tuple[list, np.ndarray]:
    """(ids, vectors) of centroids, by id. They are counted before they come to the driver, as one Arrow table."""
    c = centroids.select(F.col(cid).alias("i"), doubles(F.col(cvec)).alias("v"))
    cells = c.agg(F.sum(F.size("v"))).first()[0]
    if not cells:
        raise ValueError("no centroids")
    if cells > BROADCAST_CELLS:
        raise ValueError(f"{cells} centroid entries are more than BROADCAST_CELLS; assign to fewer centroids at a time")
    t = c.toArrow().sort_by("i").combine_chunks()
    return t["i"].to_pylist(), _matrix(t["v"].combine_chunks())


def assign(rows: DataFrame, centroids: DataFrame, vec: str = "embedding", kind: str = "l2", cid: str = "cid", cvec: str = "cvec") -> DataFrame:
    """rows with cid and dist of the nearest centroid; the lowest id of equal ones. Null vectors have neither.

    Few centroids are a literal of the plan and compared by the JVM; more are
    broadcast as one array, up to BROADCAST_CELLS numbers, and compared in Arrow
    batches.
    """
    ids, m = table_of(centroids, cid, cvec)
    if m.size <= LITERAL_CELLS:
        table = F.array(*[F.struct(F.lit(i).alias("i"), F.split(F.lit(",".join(map(repr, v.tolist()))), ",").cast("array<double>").alias("v")) for i, v in zip(ids, m, strict=True)])
        best = F.array_min(F.transform(table, lambda x: F.struct(distance(F.col(vec), x.v, kind).alias("d"), x.i.alias("i"))))
        best = F.when(F.col(vec).isNotNull(), best)
        return rows.withColumn("_best", best).withColumn(cid, F.col("_best.i")).withColumn("dist", F.col("_best.d")).drop("_best")
    shared = rows.sparkSession.sparkContext.broadcast(m)
    columns, id_type = rows.columns, to_arrow_type(centroids.schema[cid].dataType)
    at = columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = pa.array(ids, id_type)
        for b in batches:
            there = b.column(at).is_valid().to_numpy(zero_copy_only=False)
            near, best = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            if there.any():
                near[there], best[there] = nearest(_matrix(b.column(at).drop_null()), shared.value, kind)
            yield pa.RecordBatch.from_arrays([*b.columns, named.take(pa.array(near, mask=~there)), pa.array(best, mask=~there)], [*columns, cid, "dist"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, `{cid}` {centroids.schema[cid].dataType.simpleString()}, dist double")


def _added(parts: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, v, n): sums of the vectors v and numbers n of each group, from rows that hold sums of some."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, count = None, None, 0
        for b in batches:
            for g, v, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                if total is not None and g == now:
                    total, count = total + v, count + k
                    continue
                if total is not None:
                    yield out(b.column(0).type, now, total, count)
                now, total, count, type_ = g, v, k, b.column(0).type
        if total is not None:
            yield out(type_, now, total, count)

    def out(type_: pa.DataType, g: object, v: np.ndarray, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g], type_), pa.array([v], pa.list_(pa.float64())), pa.array([n], pa.int64())], [group, "v", "n"])

    return parts.repartition(n, group).sortWithinPartitions(group).mapInArrow(run, f"`{group}` {kind}, v array<double>, n long")


#: Numbers of partial sums that a task holds before it hands them on.
HELD_CELLS = 4_000_000


def sums(rows: DataFrame, group: str, vec: str = "embedding", near: tuple[list, np.ndarray] | None = None, distances: str = "l2") -> DataFrame:
    """(group, v, n): the sum of each group's vectors and their number.

    With `near`, (ids, vectors) of centroids, a row's group is the id of the nearest.
    Tasks add up on their own first, so what is shuffled has a row a group and task.
    """
    some = rows.where(F.col(vec).isNotNull())
    kind = "int" if near else rows.schema[group].dataType.simpleString()
    columns = [doubles(F.col(vec)).alias("v")] + ([] if near else [F.col(group).alias("g")])
    shared = rows.sparkSession.sparkContext.broadcast(near) if near else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out(type_: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array(list(held), type_), pa.array([x[0] for x in held.values()], pa.list_(pa.float64())), pa.array([x[1] for x in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, [group, "v", "n"])

        type_ = pa.int32()
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            if shared:
                ids, m = shared.value
                code, names = nearest(x, m, distances)[0], ids
            else:
                coded = b.column(1).dictionary_encode()
                type_, names = b.column(1).type, [*coded.dictionary.to_pylist(), None]
                code = np.nan_to_num(coded.indices.to_numpy(zero_copy_only=False).astype(np.float64), nan=len(names) - 1).astype(np.int64)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
            for c, v, n in zip(code[order][first], np.add.reduceat(x[order], first, axis=0), np.diff(np.r_[first, len(x)]), strict=True):
                own = held.get(names[c])
                held[names[c]] = (v, int(n)) if own is None else (own[0] + v, own[1] + int(n))
            if len(held) * x.shape[1] > HELD_CELLS:
                yield out(type_)
                held = {}
        if held:
            yield out(type_)

    return _added(some.select(*columns).mapInArrow(run, f"`{group}` {kind}, v array<double>, n long"), group, kind)


def means(rows: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """(group, cvec, n): the mean vector of each group; null vectors do not count."""
    return sums(rows, group, vec).select(group, F.transform("v", lambda x: x / F.col("n")).alias("cvec"), "n")


def updated(centroids: DataFrame, assigned: DataFrame, vec: str = "embedding", cid: str = "cid") -> DataFrame:
    """(cid, cvec): the mean of each cluster; an empty one keeps its vector."""
    m = means(assigned, cid, vec).select(F.col(cid).alias("_c"), F.col("cvec").alias("_new"))
    return centroids.join(m, F.col(cid) == F.col("_c"), "left").select(cid, F.coalesce("_new", doubles(F.col("cvec"))).alias("cvec"))


def online_update(state: DataFrame, assigned: DataFrame, vec: str = "embedding", cid: str = "cid") -> DataFrame:
    """(cid, cvec, n) after a batch: (n c + sum of x) / (n + m).

    Equal to adding the batch's points one by one with rate 1 / (n + 1), labels
    being those of before the batch. n starts at 1.
    """
    m = means(assigned, cid, vec).select(F.col(cid).alias("_c"), F.col("cvec").alias("_m"), F.col("n").alias("_k"))
    x = state.join(m, F.col(cid) == F.col("_c"), "left")
    n, k = F.col("n"), F.coalesce("_k", F.lit(0))
    moved = F.zip_with(doubles(F.col("cvec")), F.col("_m"), lambda c, a: (n * c + k * a) / (n + k))
    return x.select(cid, F.when(F.col("_k").isNull(), doubles(F.col("cvec"))).otherwise(moved).alias("cvec"), (n + k).alias("n"))


def members(assigned: DataFrame, key: str, k: int | None = None, cid: str = "cid") -> DataFrame:
    """(cid, members, n): sorted keys of each cluster. With k, clusters 0 to k - 1, empty ones too; else from the least to the largest."""
    got = assigned.groupBy(cid).agg(F.sort_array(F.collect_list(key)).alias("members"))
    if k is not None:
        every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("_c"))
    else:
        every = assigned.agg(F.min(cid).alias("a"), F.max(cid).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("_c"))
    out = every.join(got, F.col("_c") == F.col(cid), "left")
    none = F.array().cast(got.schema["members"].dataType)
    return out.select(F.col("_c").alias(cid), F.coalesce("members", none).alias("members"), F.size(F.coalesce("members", none)).alias("n"))


def potential(assigned: DataFrame, vec: str = "embedding", cid: str = "cid") -> DataFrame:
    """One row: the sum of squared distances to the members' means."""
    m = means(assigned, cid, vec).select(F.col(cid).alias("_c"), "cvec")
    return assigned.join(m, F.col(cid) == F.col("_c")).agg(F.sum(distance(F.col(vec), F.col("cvec"))).alias("potential"), F.count(F.lit(1)).alias("n"))


def closest(assigned: DataFrame, key: str, s: int | None = None, cid: str = "cid") -> DataFrame:
    """assigned with rank: by distance within the cluster, from 1; the first s of each if s is given."""
    w = Window.partitionBy(cid).orderBy("dist", key)
    out = assigned.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= s) if s else out


def _nearest(b: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A batch's vectors (column v), and the squared distance of each to the nearest centre (column near counts too)."""
    x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    near = b.column("near").to_numpy(zero_copy_only=False)
    for c in centres:
        near = np.minimum(near, ((x - c) ** 2).sum(1))
    return x, near


def _draws(table: DataFrame, centres: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n rows' vectors, each drawn from all rows with odds in proportion to near; none if all are at a centre.

    A row's time is exponential with rate near, by a hash of its key; the first one is drawn.
    """
    hashed = table.select("v", "near", *[F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(t), F.col("key")), 11).alias(f"h{t}") for t in range(n)], "key")
    kind = hashed.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [(np.inf, None, None)] * n
        for b in batches:
            x, near = _nearest(b, centres)
            for t in range(n):
                u = (b.column(f"h{t}").to_numpy(zero_copy_only=False) + 0.5) / 2.0**53
                time = np.divide(-np.log(u), near, out=np.full(len(x), np.inf), where=near > 0)
                at = int(time.argmin()) if len(x) else 0
                if len(x) and time[at] < best[t][0]:
                    best[t] = (time[at], b.column("key")[at].as_py(), x[at].tolist())
        got = [(t, *r) for t, r in enumerate(best) if r[2] is not None]
        types = [pa.int32(), pa.float64(), to_arrow_type(kind), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], y) for i, y in enumerate(types)], ["t", "time", "key", "v"])

    firsts = hashed.mapInArrow(run, f"t int, time double, key {kind.simpleString()}, v array<double>")
    got = firsts.groupBy("t").agg(F.min(F.struct("time", "key", "v")).alias("r")).orderBy("t").collect()
    return np.array([g.r.v for g in got], dtype=np.float64)


def _left(table: DataFrame, centres: np.ndarray, draws: np.ndarray) -> list[float]:
    """For each draw the sum over all rows of the squared distance to the nearest of the centres and the draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(draws))
        for b in batches:
            x, near = _nearest(b, centres)
            sums += [np.minimum(near, ((x - d) ** 2).sum(1)).sum() for d in draws]
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = table.select("v", "near").mapInArrow(run, "sums array<double>").collect()
    return [math.fsum(p.sums[t] for p in parts) for t in range(len(draws))]


def _renewed(table: DataFrame, centres: np.ndarray) -> DataFrame:
    """table with near up to these centres too."""
    kind = table.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), pa.array(_nearest(b, centres)[1], pa.float64())], ["key", "v", "near"])

    return cut(table.select("key", "v", "near").mapInArrow(run, f"key {kind}, v array<double>, near double"))


def seeds(rows: DataFrame, key: str, k: int, vec: str = "embedding", method: str = "k-means++", seed: int = 42) -> DataFrame:
    """(cid int, cvec) of k rows to start from; fewer if there are fewer different rows.

    random: by hashed order. k-means++: each next one is drawn from all rows with odds
    in proportion to their squared distance from those before, the best of 2 + ln k
    draws by the potential it leaves over all rows. Each takes two passes over the
    rows; only the chosen and the drawn are on the driver.
    """
    if method not in ("random", "k-means++"):
        raise ValueError(f"unknown seeding {method!r}")
    some = rows.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), doubles(F.col(vec)).alias("v"))
    table = cut(some.withColumn("near", F.lit(float("inf")))) if method == "k-means++" else some
    first = table.orderBy(uniform(seed, F.col("key")), "key").limit(k if method == "random" else 1).select("v").collect()
    chosen, written = [np.array(r.v, dtype=np.float64) for r in first], 0
    while method == "k-means++" and 0 < len(chosen) < k:
        if len(chosen) - written >= SEED_STEP:
            table, written = _renewed(table, np.array(chosen[written:])), len(chosen)
        new = np.array(chosen[written:]).reshape(-1, len(chosen[0]))
        drawn = _draws(table, new, 2 + int(np.log(k)), seed + 1_000_003 * len(chosen))
        if not len(drawn):
            break
        chosen.append(drawn[int(np.argmin(_left(table, new, drawn)))])
    return rows.sparkSession.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(chosen)], "cid int, cvec array<double>")


def _table(spark: SparkSession, ids: list, m: np.ndarray) -> DataFrame:
    """(cid, cvec) of centroids; a literal of the plan if they are few, else a table in the shared folder."""
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1])), pa.int32()), pa.array(m.ravel()))
    made = spark.createDataFrame(pa.table({"cid": pa.array(ids, pa.int32()), "cvec": flat}), "cid int, cvec array<double>")
    return made if m.size <= LITERAL_CELLS else cut(made)


def lloyd(rows: DataFrame, centroids: DataFrame, iterations: int, vec: str = "embedding", kind: str = "l2") -> DataFrame:
    """Centroids after a fixed number of assignments and means; an empty cluster keeps its vector.

    An iteration broadcasts the centroids as one array, adds up within each task, and
    shuffles a row a centroid and task; table_of() bounds what comes to the driver.
    """
    if not iterations or centroids.isEmpty():
        return centroids.select("cid", doubles(F.col("cvec")).alias("cvec"))
    ids, m = table_of(centroids)
    for _ in range(iterations):
        got = sums(rows, "cid", vec, (ids, m), kind).toArrow().combine_chunks()
        if got.num_rows:
            m = m.copy()
            m[np.searchsorted(ids, got["cid"].to_numpy())] = _matrix(got["v"].combine_chunks()) / got["n"].to_numpy()[:, None]
    return _table(rows.sparkSession, ids, m)


def kmeans(rows: DataFrame, key: str, k: int, iterations: int = 50, starts: int = 1, vec: str = "embedding", kind: str = "l2", method: str = "k-means++", seed: int = 42) -> DataFrame:
    """(cid, cvec) of the best of several starts by potential."""
    runs = [lloyd(rows, seeds(rows, key, k, vec, method, seed + 1000 * s), iterations, vec, kind) for s in range(starts)]
    if starts == 1:
        return runs[0]
    left = [potential(assign(rows, c, vec, kind), vec).first().potential for c in runs]
    return runs[int(np.argmin(left))]


@dataclass
class Level:
    """A level of a hierarchy: its centroids, and to which each of the level below belongs."""

    centroids: DataFrame
    assigned: DataFrame
    sizes: dict = field(default_factory=dict)


def hierarchy(rows: DataFrame, key: str, clusters: list[int], samples: list[int], resamples: int = 10, iterations: int = 50, vec: str = "embedding", seed: int = 42) -> list[Level]:
    """Hierarchical k-means with resampling: level l + 1 clusters level l's centroids.

    At each level, `resamples` times, the `samples` rows closest to each centroid are
    clustered anew and all rows assigned to the result; not where samples is 1 or less.
    """
    if len(clusters) != len(samples):
        raise ValueError("as many sample sizes as levels are needed")
    out: list[Level] = []
    data, name, v = rows, key, vec
    for k, s in zip(clusters, samples, strict=True):
        c = kmeans(data, name, k, iterations, vec=v, seed=seed)
        a = cut(assign(data, c, v))
        for r in range(resamples if s > 1 else 0):
            some = closest(a, name, s).select(*data.columns)
            c = kmeans(some, name, k, iterations, vec=v, seed=seed + r + 1)
            a = cut(assign(data, c, v))
        out.append(Level(c, a))
        data, name, v = c.select(F.col("cid").alias("id"), F.col("cvec").alias("vec")), "id", "vec"
    return out


def stream_step(state: list[tuple[DataFrame, DataFrame]] | None, rows: DataFrame, key: str, clusters: list[int], samples: list[int], resamples: int = 10, vec: str = "embedding", seed: int = 42) -> list[tuple[DataFrame, DataFrame]]:
    """A hierarchy's models after a further batch: for each level (initial, final), each (cid, cvec, n).

    A level's initial model moves with all of the batch; its final model moves, time
    and again, with the `samples` rows that are closest to each of its centroids, the
    first time to the initial model's. The next level's batch is this level's final
    centroids. Without a state, initial models are seeded from the batch and final ones
    start as copies of the moved initial ones. A level with samples of 1 or less has a
    final model equal to its initial one.
    """
    if len(clusters) != len(samples):
        raise ValueError("as many sample sizes as levels are needed")
    out: list[tuple[DataFrame, DataFrame]] = []
    data, name, v = rows, key, vec
    for level, (k, s) in enumerate(zip(clusters, samples, strict=True)):
        first, last = state[level] if state else (seeds(data, name, k, v, seed=seed).withColumn("n", F.lit(1).cast("long")), None)
        first = cut(online_update(first, assign(data, first, v), v))
        last, near = first if last is None or s <= 1 else last, first
        for _ in range(resamples if s > 1 else 0):
            some = closest(assign(data, near, v).where(F.col(v).isNotNull()), name, s).select(*data.columns)
            last = cut(online_update(last, assign(some, last, v), v))
            near = last
        out.append((first, last))
        data, name, v = last.select(F.col("cid").alias("id"), F.col("cvec").alias("vec")), "id", "vec"
    return out


def applied(rows: DataFrame, levels: list[DataFrame], vec: str = "embedding") -> list[DataFrame]:
    """Assignments of rows to frozen centroids, and of each level's centroids to the next's."""
    out, data, v = [], rows, vec
    for c in levels:
        out.append(assign(data, c, v))
        data, v = c.select(F.col("cid").alias("id"), F.col("cvec").alias("vec")), "vec"
    return out
