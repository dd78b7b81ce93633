"""Boundaries of the operators on literal rows."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import config
from tidewater.functions import intervals, names, vectors
from tidewater.operators import annotations, evaluate, hierarchy, kmeans, matching, ordered, probe, sampling, sessions, splits, tracks
from tidewater.plans import pipelines

T0 = dt.datetime(2020, 1, 1)


def at(*seconds):
    return [T0 + dt.timedelta(seconds=s) for s in seconds]


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("a/b/SITE_20190203_123456.flac", dt.datetime(2019, 2, 3, 12, 34, 56)),
        ("a/b/SITE_20190203_123460.wav", dt.datetime(2019, 2, 3, 12, 34, 59)),
        ("a/b/SITE_190203123456.flac", dt.datetime(2019, 2, 3, 12, 34, 56)),
        ("a/b/SITE_190203_123456.flac", dt.datetime(2019, 2, 3, 12, 34, 56)),
        ("a/b/SITE_690203_123456.flac", dt.datetime(1969, 2, 3, 12, 34, 56)),
        ("a/b/SITE_20190203_1234xo.flac", None),
        ("plain.wav", None),
    ],
)
def test_start_time(spark, name, expected):
    assert one(spark, names.start_time(F.lit(name)).cast("timestamp_ntz")).c0 == expected


def test_names(spark):
    r = one(
        spark,
        names.is_recording(F.lit("a/SITE_Post-Deployment_20190203_123456.flac")),
        names.is_recording(F.lit("a/notes.txt")),
        names.utc_start_time(F.lit("a/b/X.20131122_133600Z.flac")).cast("timestamp_ntz"),
        names.remote_path(F.lit("C:\\Data\\DCLDE\\North\\Site A\\x.wav"), F.lit("X.WAV")),
        names.clean_label(F.lit("a/b c\\d")),
        names.parent(F.lit("x")),
        names.leading_date(F.lit("notadate")),
    )
    assert tuple(r) == (False, False, dt.datetime(2013, 11, 22, 13, 36), "north/site a/X.WAV", "a_b_c_d", None, None)


def test_gap_of_exactly_600_seconds_is_one_visit(spark):
    df = spark.createDataFrame([(1, t) for t in at(0, 600, 1201)], "v long, ts timestamp_ntz")
    got = sorted((r.start_time, r.end_time, r.n) for r in sessions.visits(df, "v", "ts").collect())
    assert got == [(*at(0, 600), 2), (*at(1201, 1201), 1)]


def test_covers_hold_both_ends(spark):
    win = spark.createDataFrame([(i, "d", t) for i, t in enumerate(at(9, 10, 15, 20, 21))] + [(9, "e", T0), (10, None, T0)], "i int, d string, ts timestamp_ntz")
    cov = spark.createDataFrame([("d", *at(10, 20)), ("d", *at(12, 13)), (None, T0, T0)], "k string, start_time timestamp_ntz, end_time timestamp_ntz")
    assert sorted(r.i for r in sessions.uncovered(win, cov, {"d": "k"}, "ts").collect())[:3] == [0, 4, 9]
    assert sorted(r.i for r in sessions.uncovered_anywhere(win.where("d = 'd'"), cov.where("k = 'd'"), "ts", bucket_seconds=3).collect()) == [0, 4]


@pytest.mark.parametrize("strict", [True, False])
def test_two_nearest(spark, strict):
    rec = spark.createDataFrame([("d", p, T0 + dt.timedelta(seconds=s)) for p, s in (("a", 0), ("b", 100), ("c", 101), ("x", 500), ("y", 500), ("z", 500))], "d string, path string, start timestamp_ntz")
    ping = spark.createDataFrame([(i, "d", T0 + dt.timedelta(seconds=s)) for i, s in enumerate((99, 0, 100, 300, 501, 600))] + [(9, "none", T0)], "id int, d string, ts timestamp_ntz")
    a, b = (f(ping, rec, "d", "ts", "start", "path", "id", strict) for f in (matching.nearest2_backward, matching.nearest2_by_pairs))
    got = {r.id: r.match_path for r in a.collect()}
    assert got == {r.id: r.match_path for r in b.collect()}
    assert got[0] is None and got[1] == (None if strict else "a") and got[4] == "x" and got[9] is None
    asof = {r.id: r.match_path for r in matching.asof_backward(ping, rec, "d", "ts", "start", "path").collect()}
    assert asof[0] == "a" and asof[1] == "a" and asof[4] == "z" and asof[9] is None


def test_inclusion_and_jitter(spark):
    counts = spark.createDataFrame([(1, 5), (2, 10), (3, 20)], "v int, n int")
    assert [r.p for r in sampling.inclusion_probability(counts, 10).orderBy("v").collect()] == [1, 1, 0.5]
    with pytest.raises(ValueError, match="t must be"):
        sampling.inclusion_probability(counts, 0)
    p = spark.createDataFrame([(0, "f", 1, T0), (1, "f", 1, at(100)[0]), (2, "f", 2, at(150)[0]), (3, "f", 3, at(200)[0]), (4, "f", 3, at(200)[0])], "k int, f string, v int, ts timestamp_ntz")
    got = {r.k: r.sel_ts for r in sampling.neighbour_jitter(p, "k", "v", "ts", "f").collect()}
    assert at(0)[0] <= got[0] < at(100)[0] and at(0)[0] <= got[1] < at(100)[0]
    assert (got[2], got[3], got[4]) == tuple(at(150, 200, 200))
    assert sampling.rarity_sample(p, 100, "k", "v", "ts", "f").count() == 5  # p = 1 keeps all


@pytest.mark.parametrize(("b", "e", "dur", "low", "high"), [(10, 15, 99, 10, 10), (10, 22, 99, 10, 17), (1, 2, 3, 0, 0), (0, 1, 99, 0, 0), (98, 99, 99, 94, 94), (50, 51, 99, 46, 50)])
def test_random_window(spark, b, e, dur, low, high):
    for u in (0.0, 0.5, 0.999):
        s = intervals.window_start(F.lit(float(b)), F.lit(float(e)), F.lit(float(dur)), F.lit(u))
        r = one(spark, s, intervals.window_end(s, F.lit(float(dur))))
        assert low <= r.c0 <= high and r.c1 == min(r.c0 + 5, dur)


def test_overlap_of_exactly_the_least_ratio_does_not_count(spark):
    ann = spark.createDataFrame([(0, "r", 0.0, 5.0, "a", 0.0, 5.0), (1, "r", 3.5, 8.5, "b", 3.5, 8.5), (2, "r", 3.4, 8.4, "c", 3.4, 8.4), (3, "q", 0.0, 5.0, "d", 0.0, 5.0)], "i int, r string, b double, e double, l string, window_start double, window_end double")
    got = {r.i: r for r in annotations.overlapping_labels(ann, "i", "r", "b", "e", "l").collect()}
    assert got[0].labels == ["a", "c"] and got[0].num_annotations == 2 and got[3].labels == ["d"] and not got[3].multilabel
    same = {r.i: r.labels for r in annotations.overlapping_labels(ann, "i", "r", "b", "e", "l", bucket=0.7).collect()}
    assert same == {k: v.labels for k, v in got.items()}


def test_bad_annotations(spark):
    ann = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 2.0), (2, None, 2.0)], "i int, b double, e double")
    good, bad = annotations.positive_length(ann, "b", "e")
    assert [r.i for r in good.collect()] == [1] and sorted(r.i for r in bad.collect()) == [0, 2]
    with pytest.raises(Exception, match="ends no later"):
        annotations.checked_length(ann, "b", "e").collect()


@pytest.mark.parametrize(("sizes", "target", "cut", "quotas"), [([1, 5, 9], 9, 4, [1, 4, 4]), ([5, 5], 7, 3, [3, 4]), ([2, 2], 9, 2, [2, 2]), ([3, 0], 0, 0, [0, 0])])
def test_water_fill(spark, sizes, target, cut, quotas):
    df = spark.createDataFrame([(0, i, s, target) for i, s in enumerate(sizes)], "p int, c int, size int, target int")
    got = hierarchy.with_quota(df, ["p"], "c", "size", "target").orderBy("c").collect()
    assert {r.cut for r in got} == {cut} and sorted(r.quota for r in got) == sorted(quotas)


def test_water_fill_of_random_sizes(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for p in range(60):
        a, t = rng.integers(0, 30, rng.integers(1, 9)), int(rng.integers(0, 150))
        rows += [(p, i, int(s), t) for i, s in enumerate(a)]
        want[p] = max(x for x in range(int(a.max()) + 1) if np.minimum(a, x).sum() <= t)
    got = hierarchy.with_quota(spark.createDataFrame(rows, "p int, c int, size int, target int"), ["p"], "c", "size", "target").collect()
    assert {r.p: r.cut for r in got} == want
    for p in want:
        own = [r for r in got if r.p == p]
        assert sum(r.quota for r in own) == min(own[0].target, sum(r["size"] for r in own)) and all(r.quota <= r["size"] for r in own)
    with pytest.raises(Exception, match="negative"):
        hierarchy.with_cut(spark.createDataFrame([(0, 0, -1, 3)], "p int, c int, size int, target int"), ["p"], "c", "size", "target").collect()


def test_sample_of_a_tree(spark):
    df = spark.createDataFrame([(i, i % 3, i % 6, float(i)) for i in range(60)], "k int, a int, b int, d double")
    drawn = hierarchy.sample(df, ["a", "b"], "k", 20, order="distance", by="d").collect()
    assert len(drawn) == 20 and len({r.k for r in drawn}) == 20
    assert hierarchy.sample(df, ["a", "b"], "k", 100, multiplier=2).count() == 100
    with pytest.raises(ValueError, match="order"):
        hierarchy.sample(df, ["a"], "k", 1, order="x")


def test_temporal_split(spark):
    df = spark.createDataFrame([("a", T0)] * 8 + [("b", at(5)[0]), ("c", at(9)[0]), ("n", None)], "r string, ts timestamp_ntz")
    got = {r.r: r.split for r in splits.temporal(df, "r", "ts").collect()}
    assert got == {"a": "train", "b": "test", "c": "test"}
    assert splits.temporal(df.where("false"), "r", "ts").count() == 0


def test_clusters(spark):
    x = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [9.0, 9.0])], "k int, embedding array<double>")
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [50.0, 50.0])], "cid int, cvec array<double>")
    a = kmeans.assign(x, c)
    assert {r.k: r.cid for r in a.collect()} == {0: 0, 1: 0, 2: 0}  # the lowest id of equal ones
    new = {r.cid: r.cvec for r in kmeans.updated(c, a).collect()}
    assert new[1] == [1.0, 0.0] and new[2] == [50.0, 50.0]  # empty ones keep theirs
    state = spark.createDataFrame([(0, [0.0], 1)], "cid int, cvec array<double>, n long")
    got = kmeans.online_update(state, spark.createDataFrame([(0, [1.0]), (0, [2.0])], "cid int, embedding array<double>")).first()
    assert got.cvec == [1.0] and got.n == 3
    with pytest.raises(ValueError, match="distance"):
        vectors.distance(F.lit(1), F.lit(1), "x")
    big = kmeans.LITERAL_CELLS
    try:
        kmeans.LITERAL_CELLS = 0
        assert {r.k: (r.cid, r.dist) for r in kmeans.assign(x, c).collect()} == {r.k: (r.cid, r.dist) for r in a.collect()}
    finally:
        kmeans.LITERAL_CELLS = big
    assert kmeans.kmeans(x, "k", 3, 2).count() == 3 and kmeans.seeds(x, "k", 9, method="random").count() == 3


def test_measures(spark):
    rng = np.random.default_rng(2)
    rows = [(0, int(p), float(s)) for p, s in zip(rng.integers(0, 2, 80), rng.integers(0, 9, 80), strict=True)] + [(1, 1, 0.5)]
    df = spark.createDataFrame(rows, "cls int, positive int, score double")
    pos, neg = ([s for c, p, s in rows if c == 0 and p == v] for v in (1, 0))
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    got = {r.cls: r.auc for r in evaluate.roc_auc(df, "cls", "positive", "score").collect()}
    assert got[0] == pytest.approx(want) and got[1] is None
    ap, hit, seen = 0.0, 0, 0
    for s in sorted({s for _, _, s in rows[:-1]}, reverse=True):
        tie = [p for c, p, x in rows if c == 0 and x == s]
        hit, seen = hit + sum(tie), seen + len(tie)
        ap += sum(tie) * hit / seen
    assert {r.cls: r.ap for r in evaluate.average_precision(df, "cls", "positive", "score").collect()}[0] == pytest.approx(ap / len(pos))


def test_index_and_windows(spark):
    r = spark.createDataFrame([(0, 12.0), (1, 4.0), (2, 10.0)], "r int, d double")
    assert sorted((x.r, x.win_idx) for x in ordered.window_grid(r, "d", 5.0, whole=True).collect()) == [(0, 0), (0, 1), (2, 0), (2, 1)]
    i = ordered.prefix_index(r.withColumn("n", ordered.window_count(F.col("d"), 5.0, False)), ["r"], "n")
    assert {x.r: (x.lo, x.hi) for x in i.collect()} == {0: (0, 3), 1: (3, 4), 2: (4, 6)}
    q = ordered.lookup(spark.range(7), "id", i, "r", step=2)
    assert {x.id: (x.r, x.win_idx) for x in q.collect()} == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 0), 4: (2, 0), 5: (2, 1)}
    v = F.array(*[F.lit(x) for x in (1, 2, 3)])
    assert tuple(one(spark, vectors.reflect_padded(v, 5), vectors.equal_windows(v, 2), vectors.argmax(v))) == ([1, 2, 3, 3, 2], [[1, 2]], 2)


def test_track(spark):
    p = spark.createDataFrame([(0, T0, 36.0, -122.0, 10.0, 90.0)], "k int, BaseDateTime timestamp_ntz, LAT double, LON double, SOG double, COG double")
    g = tracks.grid(p, 3, 5).orderBy("step").collect()
    assert g[0].lon_at == -122.0 and g[2].timestamp == at(10)[0] and g[2].lon_at > g[1].lon_at and abs(g[2].lat_at - 36.0) < 1e-9
    az, el, rng_ = tracks.bearing(F.lit(36.0), F.lit(-121.99), F.lit(100.0), F.lit(36.0), F.lit(-122.0))
    r = one(spark, az, el, rng_)
    assert r.c0 == pytest.approx(90) and 0 < r.c1 < 90 and 850 < r.c2 < 950


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("t: 100\ntarget: 5\n")
    c = config.parse(["--config", str(f), "--t", "7"])
    assert (c.t, c.target) == (7, 5)
    with pytest.raises(ValueError, match="t must"):
        config.Config(t=0)


def test_vessel_clips(spark):
    pings = spark.createDataFrame([(i, 1, "f1", t) for i, t in enumerate(at(0, 60, 120))], "ping_id int, MMSI long, ais_file string, BaseDateTime timestamp_ntz")
    dep = spark.createDataFrame([("f1", "a", "b", "c"), ("f1", "z", "z", "z")], "ais_file string, col0 string, col1 string, col2 string")
    cat = spark.createDataFrame([("a/b/c/S_20191231_235900.flac",), ("a/b/c/S_20210101_000000.flac",), ("a/b/c/notes.txt",)], "path string")
    got = pipelines.vessel_clips(pings, dep, cat).collect()
    assert len(got) == 3 and all(r.match_path == "a/b/c/S_20191231_235900.flac" and 60 <= r.offset_s <= 180 for r in got)


def test_cluster_sample(spark):
    rng = np.random.default_rng(3)
    emb = spark.createDataFrame([("d", T0 + dt.timedelta(seconds=10 * i), "p", [float(x) for x in rng.normal(size=3)], i) for i in range(60)], "deployment string, ts timestamp_ntz, path string, embedding array<double>, key int")
    pings = spark.createDataFrame([(1, "f", t) for t in at(0, 100)], "MMSI long, ais_file string, BaseDateTime timestamp_ntz")
    dep = spark.createDataFrame([("f", "d")], "ais_file string, deployment string")
    c1 = kmeans.seeds(emb, "key", 6)
    c2 = kmeans.seeds(c1, "cid", 2, "cvec")
    got = pipelines.cluster_sample(emb, pings, dep, [c1, c2], target=10, sub_target=20).collect()
    assert len(got) == 10 and min(r.key for r in got) > 10


def test_labelled_windows(spark):
    ann = spark.createDataFrame([(0, True, "A b", "x/r1", "r1.wav", "s", 1.0, 3.0, 60.0, T0), (1, True, "C", "x/r1", "r1.wav", "s", 1.5, 3.5, 60.0, T0), (2, True, " ", "x/r2", "r2.wav", "s", 1.0, 2.0, 60.0, T0), (3, True, "D", "x/r2", "r2.wav", "s", 2.0, 2.0, 60.0, T0), (4, False, "D", "x/r2", "r2.wav", "s", 2.0, 3.0, 60.0, T0)], "idx int, FileOk boolean, ClassSpecies string, FilePath string, Soundfile string, Dataset string, FileBeginSec double, FileEndSec double, duration double, rec_ts timestamp_ntz")
    meta, split, bad = pipelines.labelled_windows(ann)
    rows = {r.primary_label: r for r in meta.collect()}
    assert set(rows) == {"A_b", "C"} and rows["C"].labels == "A b|C" and [r.idx for r in bad.collect()] == [3] and split.count() == 1
    assert pipelines.labelled_windows(ann, existing=meta)[0].count() == 0


def test_running_totals_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [(None if g == 0 else int(g), float(s), int(v)) for g, s, v in zip(rng.zipf(1.5, 500) % 5, rng.permutation(500), rng.integers(0, 9, 500), strict=True)]
    df = spark.createDataFrame(rows, "g int, s double, v long").repartition(3)
    got = {r.s: (r.a, r.b) for r in ordered.running_totals(df, ["g"], [F.desc("s")], {"a": "v", "b": "v"}).collect()}
    for g, s, _ in rows:
        want = sum(v for h, t, v in rows if h == g and t >= s)
        assert got[s] == (want, want)


def test_ranks_of_a_large_class(spark):
    """Continuous scores, nearly all of one class: against counts of pairs and the steps of recall."""
    rng = np.random.default_rng(9)
    x = [("a" if i % 50 else "b", int(rng.random() < 0.3), round(float(rng.normal()), 2)) for i in range(600)] + [("c", 1, 0.5), ("d", 0, 0.5)]
    df = spark.createDataFrame(x, "cls string, positive int, score double")
    auc = {r.cls: r.auc for r in evaluate.roc_auc(df, "cls", "positive", "score").collect()}
    ap = {r.cls: r.ap for r in evaluate.average_precision(df, "cls", "positive", "score").collect()}
    assert auc["c"] is None and auc["d"] is None and ap["d"] is None and ap["c"] == 1
    for c in "ab":
        pos, neg = ([s for k, p, s in x if k == c and p == want] for want in (1, 0))
        assert auc[c] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
        at = lambda t: [p for k, p, s in x if k == c and s >= t]  # noqa: B023, E731
        assert ap[c] == pytest.approx(sum(np.mean(at(t)) for t in pos) / len(pos))


def test_covers_of_any_length(spark):
    rng = np.random.default_rng(6)
    at = lambda s: T0 + dt.timedelta(seconds=float(s))
    covers = [(at(s), at(s + n)) for s, n in zip(rng.uniform(0, 1e7, 60), 10 ** rng.uniform(-3, 5.5, 60), strict=True)] + [(at(5), at(5)), (at(9), at(7)), (at(2e7), at(2e7 + 8)), (at(3e7), at(3e7 + 64))]
    times = [(i, at(s)) for i, s in enumerate([*rng.uniform(0, 1e7, 800), 5, 8, 2e7, 2e7 + 8, 3e7 + 64, 3e7 + 65])] + [(9999, None)]
    got = {r.i for r in sessions.uncovered_anywhere(spark.createDataFrame(times, "i int, ts timestamp_ntz"), spark.createDataFrame(covers, "start_time timestamp_ntz, end_time timestamp_ntz"), "ts", bucket_seconds=1).collect()}
    assert got == {i for i, t in times if t is None or not any(a <= t <= b for a, b in covers)}


def test_linear_probe(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1)], i % 3) for i in range(30)] + [(99, None, 1)], "k int, v array<float>, c int")
    probe.save(probe.fit(df, "v", "c"), str(tmp_path / "m"))
    got = probe.predict(df.where("k < 30"), probe.load(str(tmp_path / "m")), "v").collect()
    assert all(r.pred == r.c for r in got) and len(got) == 30


def test_seeds_are_drawn_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "SEED_CELLS", 40, raising=False)  # the bound of the sample that was drawn from
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (200, 2)), rng.normal(50, 1, (200, 2)), rng.normal(1000, 1, (3, 2))])
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "k long, embedding array<double>").repartition(7)
    for step in (64, 1):
        monkeypatch.setattr(kmeans, "SEED_STEP", step, raising=False)
        for seed in range(3):
            got = sorted(r.cvec[0] for r in kmeans.seeds(df, "k", 3, seed=seed).collect())
            assert got[0] < 10 and 40 < got[1] < 60 and got[2] > 990
    assert kmeans.seeds(df.limit(1).union(df.limit(1)), "k", 3).count() == 1


def test_seed_draws_have_their_odds(spark):
    df = spark.createDataFrame([(i, [float(i % 4)]) for i in range(4000)], "key long, v array<double>").withColumn("near", F.lit(float("inf")))
    got = kmeans._draws(df, np.array([[0.0]]), 400, 5)[:, 0]
    assert np.allclose([(got == i).mean() for i in range(4)], [0, 1 / 14, 4 / 14, 9 / 14], atol=0.08)
    assert kmeans._left(df, np.array([[0.0]]), np.array([[3.0], [1.0]])) == [2000.0, 5000.0]


def test_two_nearest_of_one_key_in_linear_time(spark):
    """Frames that are begun anew for each row would take minutes for these rows."""
    n = 100_000
    pings = spark.range(n).select(F.col("id").alias("ping"), F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 1_000_000 + 500_000).cast("timestamp_ntz").alias("ts"))
    rec = spark.range(n).select(F.lit("k").alias("on"), F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("start"), F.format_string("p%06d", "id").alias("path"))
    out = matching.nearest2_backward(pings, rec.withColumnRenamed("on", "k"), "k", "ts", "start", "path", "ping")
    began = time.time()
    assert out.where(F.col("match_path") == F.format_string("p%06d", "ping")).count() == n
    assert time.time() - began < 60


def by_hand(x, m, iterations):
    m = m.copy()
    for _ in range(iterations):
        near = ((x[:, None, :] - m[None, :, :]) ** 2).sum(2).argmin(1)
        for c in range(len(m)):
            if (near == c).any():
                m[c] = x[near == c].mean(0)
    return m


@pytest.mark.parametrize("cells", [kmeans.LITERAL_CELLS, 0])
def test_lloyd_by_hand(spark, sf_dir, monkeypatch, cells):
    monkeypatch.setattr(kmeans, "LITERAL_CELLS", cells)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").repartition(3)
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], dtype=np.float64)
    first = kmeans.seeds(e, "vec_id", 5, method="random")
    start = np.array([r.cvec for r in first.orderBy("cid").collect()])
    with_null = e.unionByName(spark.createDataFrame([(-1, None)], "vec_id long, embedding array<float>").select("vec_id", "embedding"))
    for n in (0, 1, 4):
        got = np.array([r.cvec for r in kmeans.lloyd(with_null, first, n).orderBy("cid").collect()])
        assert np.allclose(got, by_hand(x, start, n))
    a = {r.vec_id: (r.cid, r.dist) for r in kmeans.assign(with_null, first).collect()}
    d = ((x[:, None, :] - start[None, :, :]) ** 2).sum(2)
    assert a.pop(-1) == (None, None) and [a[i][0] for i in sorted(a)] == d.argmin(1).tolist() and np.allclose([a[i][1] for i in sorted(a)], d.min(1))
    # of several starts, the one that leaves the least
    runs = [kmeans.lloyd(e, kmeans.seeds(e, "vec_id", 5, seed=42 + 1000 * s), 2) for s in range(3)]
    left = [kmeans.potential(kmeans.assign(e, c)).first().potential for c in runs]
    best = kmeans.kmeans(e, "vec_id", 5, iterations=2, starts=3)
    assert np.allclose(sorted(r.cvec for r in best.collect()), sorted(r.cvec for r in runs[int(np.argmin(left))].collect()))


def test_hierarchy_by_hand(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    low, high = kmeans.hierarchy(e, "vec_id", [6, 2], [4, 1], resamples=1, iterations=3)
    data = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in e.collect()}
    c = kmeans.kmeans(e, "vec_id", 6, 3)
    m = np.array([r.cvec for r in c.orderBy("cid").collect()])
    d = {i: ((m - v) ** 2).sum(1) for i, v in data.items()}
    near = {i: int(x.argmin()) for i, x in d.items()}
    kept = [i for k in range(6) for i in sorted((i for i in near if near[i] == k), key=lambda i: (d[i][k], i))[:4]]
    again = kmeans.kmeans(e.where(F.col("vec_id").isin(kept)), "vec_id", 6, 3, seed=43)
    want = np.array([r.cvec for r in again.orderBy("cid").collect()])
    assert np.allclose([r.cvec for r in low.centroids.orderBy("cid").collect()], want)
    assert {r.vec_id: r.cid for r in low.assigned.collect()} == {i: int(((want - v) ** 2).sum(1).argmin()) for i, v in data.items()}
    assert high.centroids.count() == 2 and high.assigned.count() == 6


def test_nearest_of_ties_and_near_ties():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 8)) * 1e3
    m = np.concatenate([m, m[::-1]])  # every centre twice: the first counts
    x = np.concatenate([m[:40] + rng.normal(size=(40, 8)) * 1e-7, (m[:20] + m[20:40]) / 2])
    for kind in ("l2", "cos"):
        place, dist = kmeans.nearest(x, m, kind)
        d = ((x[:, None, :] - m[None, :, :]) ** 2).sum(2) if kind == "l2" else 2 - 2 * (x @ m.T)
        assert (place < 40).all() and np.allclose(dist, d.min(1), rtol=1e-9, atol=1e-6)


def test_groups_with_null_names_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "HELD_CELLS", 2)
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), (None, [5.0, 6.0]), ("b", None), (None, [7.0, 8.0])], "g string, embedding array<double>").repartition(2)
    assert {(r.g, tuple(r.cvec), r.n) for r in kmeans.means(df, "g").collect()} == {("a", (2.0, 3.0), 2), (None, (6.0, 7.0), 2)}
    assert kmeans.means(df.limit(0), "g").count() == 0
