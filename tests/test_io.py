"""Sources, sinks and streams, through files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.operators import hierarchy, kmeans, sessions
from tidewater.sinks import tables as sinks
from tidewater.sources import audio
from tidewater.sources import tables as sources
from tidewater.streaming import streams

T0 = dt.datetime(2020, 1, 1)


def test_pings(spark, tmp_path):
    head = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType,Status,Length,Width,Draft,Cargo,TransceiverClass\n"
    (tmp_path / "a.csv").write_text(head + "1,2021-02-23T05:26:46,1.5,2.5,3,4,511.0,,,,,,,,,,A\n")
    (tmp_path / "b.csv").write_text(head + "2,2021-02-23T05:26:47,1.5,2.5,3,4,511.0,N,IMO1,C,70,0,10,2,,0,B\n")
    got = sources.pings(spark, str(tmp_path)).orderBy("MMSI").collect()
    assert [(r.ais_file, r.BaseDateTime) for r in got] == [("a.csv", dt.datetime(2021, 2, 23, 5, 26, 46)), ("b.csv", dt.datetime(2021, 2, 23, 5, 26, 47))]
    assert [r.ais_file for r in sources.ping_files(spark, str(tmp_path)).collect()] == ["a.csv", "b.csv"]


def test_deployments(spark, tmp_path):
    (tmp_path / "d.csv").write_text('col0,col1,col2,AIS data file,Audio Start,Audio End\na,b,c,"f1.csv, f2.csv",2020-01-01 00:00:00,2020-01-02 00:00:00\nx,y,z,f3.csv,2020-01-01 00:00:00,2020-01-09 00:00:00\n')
    assert [(r.col0, r.ais_file) for r in sources.deployments(spark, str(tmp_path / "d.csv")).collect()] == [("x", "f3.csv"), ("a", "f1.csv"), ("a", "f2.csv")]


def test_embeddings(spark, tmp_path):
    np.save(tmp_path / "S_20200101_000000.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    got = sources.embedding_files(spark, str(tmp_path)).orderBy("win_idx").collect()
    assert [(r.ts, list(r.embedding)) for r in got] == [(T0 + dt.timedelta(seconds=10 * i), [2.0 * i, 2.0 * i + 1]) for i in range(3)]


def test_multiline_cells_and_arrays(spark, tmp_path):
    (tmp_path / "s.csv").write_text('index,Type,Notes\n0,Ferry,"a, b\nc"\n1,Boat,x\n')
    assert sources.labelled_set(spark, str(tmp_path / "s.csv")).count() == 2
    arrays = spark.createDataFrame([([1, 2], ["a", "b"])], "d array<int>, p array<string>")
    assert [tuple(r) for r in sources.selection_rows(arrays, ["d", "p"]).collect()] == [(1, "a"), (2, "b")]


def test_audio(spark, tmp_path):
    folder = tmp_path / "ship"
    folder.mkdir()
    t = np.arange(32000) / 16000
    (folder / "S_20200101_000000.wav").write_bytes(audio.encode_wav(np.sin(2 * np.pi * 440 * t) * 0.5, 16000))
    (folder / "S_20200101_000010.wav").write_bytes(b"broken")
    rec = sources.recordings(spark, str(tmp_path)).collect()
    assert {r.label for r in rec} == {"ship"} and sources.object_count(spark, str(tmp_path)) == 2
    content = sources.contents(spark, str(tmp_path))
    h = {r.path.rsplit("_", 1)[1]: r for r in audio.headers(content).collect()}
    assert h["000000.wav"].duration == 2.0 and h["000010.wav"].error
    wanted = content.select("path", F.concat(F.element_at(F.split("path", "/"), -1), F.lit(".clip")).alias("clip"), F.lit(0.5).alias("start"), F.lit(1.5).alias("stop"))
    made = audio.clips(content, wanted, rate=8000).collect()
    x, rate = audio.decode_wav(next(r.data for r in made if r.data))
    assert rate == 8000 and len(x) == 8000 and abs(np.abs(x).max() - 0.5) < 0.02 and sum(r.error is not None for r in made) == 1
    assert audio.mel_db(x[:, 0], rate).shape[0] == 64 and len(audio.padded(np.arange(3), 7)) == 7
    out = sinks.write_files(audio.clips(content, wanted), str(tmp_path / "out")).collect()
    assert len(out) == 1 and (tmp_path / "out" / out[0].name).stat().st_size == out[0].bytes
    plan = spark.createDataFrame([(str(folder / "S_20200101_000000.wav"), "train/ship/a.wav"), ("/no/such", "train/ship/b.wav")], "src string, dst string")
    assert {r.status for r in sinks.copy_files(plan, str(tmp_path / "c")).collect()} == {"copied", "missing"}
    assert {r.status for r in sinks.copy_files(plan, str(tmp_path / "c")).collect()} == {"present", "missing"}
    frames = spark.createDataFrame([([1.0, 2.0],)], "samples array<float>")
    assert list(audio.embedded(frames, lambda m: m * 2).first().embedding) == [2.0, 4.0]


def test_sinks(spark, tmp_path):
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    at = sinks.selection_path(str(tmp_path), 250)
    for force in (False, False, True):
        assert sinks.cached(spark, at, make, force).count() == 3
    assert len(made) == 2
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "file string, labels array<string>")
    for _ in range(2):
        sinks.append_csv(df, str(tmp_path / "w"), "file")
    assert spark.read.csv(str(tmp_path / "w"), header=True).count() == 2
    bad = spark.createDataFrame([(1, None), (2, "broken")], "i int, error string")
    assert [r.i for r in sinks.dead_letters(bad, str(tmp_path / "dead")).collect()] == [1] and spark.read.parquet(str(tmp_path / "dead")).count() == 1
    sinks.split_csv(spark.createDataFrame([("a", "train"), ("b", "test")], "f string, split string"), str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").exists()
    sinks.save(spark.range(2).withColumn("x", F.lit(1)), str(tmp_path / "t"), ["id"])
    assert sources.state(spark, str(tmp_path / "t")).count() == 2


@pytest.fixture
def parts(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    e.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


def streamed(made, name, at):
    q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    q.awaitTermination()
    return made.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_visits_of_a_stream(spark, tmp_path, parts):
    """All pings come in one batch; the visits that the watermark has passed are those of the batch operator."""
    rows = streams.table_stream(spark, str(tmp_path / "in"), parts.schema.simpleString()[7:-1].replace(":", " "), 9)
    done = {(r.user_id, r.start_time, r.end_time, r.n) for r in streamed(streams.visits(rows, "user_id", "ts", gap="6 hours", late="1 hour"), "visits", tmp_path / "cp")}
    batch = sessions.visits(parts.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 6 * 3600)
    last = parts.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    want = {(r.user_id, r.start_time, r.end_time, r.n) for r in batch.collect() if r.end_time + dt.timedelta(hours=7) < last}
    assert len(want) > 500 and done == want and max(n for *_, n in done) > 1


def test_windows_of_a_stream(spark, tmp_path, parts):
    rows = streams.table_stream(spark, str(tmp_path / "in"), parts.schema.simpleString()[7:-1].replace(":", " "), 9)
    done = {(r.start, r.event_type, r.n) for r in streamed(streams.tumbling(rows, "ts", "event_type", "1 day"), "days", tmp_path / "cp")}
    all_ = parts.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "event_type", "n").collect()
    last = parts.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    want = {(r.start, r.event_type, r.n) for r in all_ if r.end <= last - dt.timedelta(hours=1)}
    assert len(want) > 20 and done == want


def test_streams_of_files(spark, tmp_path):
    folder = tmp_path / "pings"
    folder.mkdir()
    names = [c.split(" ")[0] for c in schemas.PINGS.split(", ")]
    (folder / "a.csv").write_text(",".join(names) + "\n" + "7,2020-01-02T03:04:05" + "," * (len(names) - 2) + "\n")
    got = streamed(streams.ping_stream(spark, str(folder)), "pings", tmp_path / "cp1")
    assert [(r.MMSI, r.BaseDateTime, r.ais_file) for r in got] == [(7, dt.datetime(2020, 1, 2, 3, 4, 5), "a.csv")]
    sounds = tmp_path / "sounds"
    (sounds / "deep").mkdir(parents=True)
    for name in ("S_20190101_000000.wav", "deep/S_20200101_000000.flac", "deep/notes.txt"):
        (sounds / name).write_bytes(b"x")
    for since, n in ((None, 2), ("2019-06-01", 1)):
        assert len(streamed(streams.file_stream(spark, str(sounds), since), f"sounds{n}", tmp_path / f"cp2{n}")) == n


def test_tables_of_annotations_windows_and_tracks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FileOk,ClassSpecies,FilePath,Soundfile,Dataset,FileBeginSec,FileEndSec\ntrue,KW,x/y.flac,y.flac,D,1.5,2.5\n")
    a = sources.annotations(spark, str(tmp_path / "a.csv")).first()
    assert (a.FileOk, a.ClassSpecies, a.FileBeginSec, a.FileEndSec) == (True, "KW", 1.5, 2.5)
    names = [c.split(" ")[0] for c in schemas.WINDOWS.split(", ")]
    cells = {"file": "f", "labels": "KW|HW", "multilabel": "true", "window_start": "0.5", "num_labels": "2"}
    (tmp_path / "w.csv").write_text(",".join(names) + "\n" + ",".join(cells.get(n, "") for n in names) + "\n")
    w = sources.windows(spark, str(tmp_path / "w.csv")).first()
    assert (w.file, w.labels, w.multilabel, w.window_start, w.num_labels, w.sample_rate) == ("f", ["KW", "HW"], True, 0.5, 2, None)
    (tmp_path / "t.csv").write_text("file_name,MMSI,timestamp,lat,lon,az_deg,el_deg,range_m\nf.flac,7,2020-01-01T00:00:10,1.0,2.0,90.0,45.0,1000.0\n")
    t = sources.track(spark, str(tmp_path / "t.csv")).first()
    assert (t.file_name, t.MMSI, t.timestamp, t.range_m) == ("f.flac", 7, dt.datetime(2020, 1, 1, 0, 0, 10), 1000.0)


def test_hierarchy_of_a_stream(spark, tmp_path, sf_dir):
    """Batch by batch the stream's models are those of the steps run one after the other."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    parts = [e.where(F.col("vec_id") % 2 == i) for i in range(2)]
    clusters, samples = [6, 2], [5, 2]
    want = None
    for i, p in enumerate(parts):  # a batch a run, in this order
        p.coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
        rows = streams.table_stream(spark, str(tmp_path / "in" / "b=*"), "vec_id long, embedding array<float>").select("vec_id", "embedding")
        streams.hierarchical_centroids(rows, "vec_id", clusters, samples, str(tmp_path / "st"), str(tmp_path / "cp"), resamples=2).awaitTermination()
        want = kmeans.stream_step(want, p, "vec_id", clusters, samples, resamples=2)
    got = streams.latest(spark, str(tmp_path / "st")).collect()
    assert len(got) == 2 * (6 + 2)
    for level, both in enumerate(want):
        for kind, model in zip(("initial", "final"), both, strict=True):
            own = {r.cid: r for r in got if (r.level, r.kind) == (level, kind)}
            for r in model.collect():
                assert own[r.cid].n == r.n and np.allclose(own[r.cid].cvec, r.cvec)
    first = {r.cid: r.n for r in got if (r.level, r.kind) == (0, "initial")}
    assert sum(first.values()) == e.count() + 6


def test_nearest_rows_of_a_stream(spark, tmp_path, parts):
    schema = parts.schema.simpleString()[7:-1].replace(":", " ")
    q = streams.nearest_rows(streams.table_stream(spark, str(tmp_path / "in"), schema).select("event_id", "value"), str(tmp_path / "st"), str(tmp_path / "cp"), "value", "event_id", 20)
    q.awaitTermination()
    got = sorted(r.event_id for r in streams.latest(spark, str(tmp_path / "st")).collect())
    assert got == sorted(r.event_id for r in hierarchy.nearest_n(parts, "value", "event_id", 20).collect())


def test_online_centroids_of_a_stream(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    first = kmeans.seeds(e, "vec_id", 4).withColumn("n", F.lit(1).cast("long"))
    q = streams.online_centroids(streams.table_stream(spark, str(tmp_path / "in"), "vec_id long, embedding array<float>"), first, str(tmp_path / "st"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r.cid: (r.n, r.cvec) for r in streams.latest(spark, str(tmp_path / "st")).collect()}
    want = {r.cid: (r.n, r.cvec) for r in kmeans.online_update(first, kmeans.assign(e, first)).collect()}
    assert got.keys() == want.keys() and all(got[c][0] == want[c][0] and np.allclose(got[c][1], want[c][1]) for c in got)
