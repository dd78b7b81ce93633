"""Queries that show each operator on the driver's tables; oracle.py has their SQL.

Notions bind to tables so: pings are events (vessel: user_id, file: event_type),
recordings are the events of type view, embeddings and classes are embeddings,
annotations are events (recording: user_id and day), deployments are customers with
nation and region.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import intervals, names, vectors
from tidewater.functions.chance import uniform
from tidewater.operators import annotations, evaluate, hierarchy, kmeans, matching, ordered, probe, sampling, sessions, splits, tracks

#: Pings a vessel keeps whole; the driver's tables have 49 pings and more a user.
T = 60

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _queries[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# counts, rarity and jitter


@query
def ping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.ping_counts(events(spark, sf_dir), "user_id")


@query
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    parts = [sampling.ping_counts(e.where(F.col("event_type") == t), "user_id") for t in ("view", "click", "purchase", "signup", "error")]
    return sampling.merged_counts(parts, "user_id")


@query
def inclusion_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.inclusion_probability(sampling.ping_counts(events(spark, sf_dir), "user_id"), T)


@query
def rarity_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.rarity_sample(events(spark, sf_dir), T, "event_id", "user_id", "ts", "event_type")
    return out.select("event_id", F.col("event_type").alias("ais_file"), F.col("user_id").alias("mmsi"), "ts", "sel_ts", "p")


@query
def neighbour_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.neighbour_jitter(events(spark, sf_dir), "event_id", "user_id", "ts", "event_type", by_vessel=True).select("event_id", "sel_ts")


@query
def neighbour_jitter_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.neighbour_jitter(events(spark, sf_dir), "event_id", "user_id", "ts", "event_type").select("event_id", "sel_ts")


@query
def random_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_per_cluster(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 7)


@query
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir(events(spark, sf_dir).select("event_id", "user_id"), "event_id", 100)


# visits


def _visits(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    return sessions.visits(events(spark, sf_dir), "user_id", "ts", gap).select("user_id", "start_time", "end_time", "n")


@query
def visit_sessions_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(spark, sf_dir, 600)


@query
def visit_sessions_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(spark, sf_dir, 6 * 3600)


@query
def visit_sessions_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.session_window(F.col("ts").cast("timestamp"), "10 minutes")
    out = events(spark, sf_dir).groupBy("user_id", w).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", "start_time", "end_time", "n")


def _stays(e: DataFrame) -> DataFrame:
    """Visits by purchases, as covers of the users' other events."""
    return sessions.visits(e.where("event_type = 'purchase'"), "user_id", "ts", 24 * 3600)


@query
def anti_join_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    free = sessions.uncovered(e.where("event_type = 'view'"), _stays(e), {"user_id": "user_id"}, "ts")
    return free.select("event_id", "user_id", "ts")


@query
def anti_join_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    covers = e.where("event_type = 'error'").select(F.col("ts").alias("start_time"), F.timestamp_add("SECOND", F.floor(F.col("value") * 10).cast("int"), F.col("ts")).alias("end_time"))
    return sessions.uncovered_anywhere(e.where("event_type = 'view'"), covers, "ts").select("event_id", "ts")


# matching


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    rec = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("start"), F.concat(F.lit("rec_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("path"))
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), rec


@query
def match_nearest2_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _sides(spark, sf_dir)
    return matching.nearest2_backward(p, r, "user_id", "ts", "start", "path", "event_id")


@query
def match_nearest2_nonstrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _sides(spark, sf_dir)
    return matching.nearest2_backward(p, r, "user_id", "ts", "start", "path", "event_id", strict=False)


@query
def match_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _sides(spark, sf_dir)
    return matching.asof_backward(p, r, "user_id", "ts", "start", "path")


@query
def clip_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _sides(spark, sf_dir)
    hit = matching.asof_backward(p, r, "user_id", "ts", "start", "path").where("match_path is not null")
    return hit.select("event_id", F.timestamp_diff("SECOND", F.col("match_start"), F.col("ts")).alias("offset_s"), names.clip_name(F.col("match_path"), F.col("ts")).alias("clip"))


@query
def deployment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    d = table(spark, sf_dir, "part").select(F.col("p_name").alias("deployment"), F.element_at(F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")]), (F.col("p_size") % 4 + 1).cast("int")).alias("segment"), "p_partkey")
    return matching.first_match(c, d, "c_mktsegment", "segment", "deployment", "p_partkey").select("c_custkey", "c_mktsegment", "deployment")


# names


@query
def deployment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.select("c_custkey", names.deployment_key(F.col("r_name"), F.col("n_name"), F.col("c_name")).alias("deployment"))


def _named(e: DataFrame) -> DataFrame:
    """A file name in each of the forms, by the event's number."""
    f = lambda p: F.date_format("ts", p)
    forms = [
        F.concat(F.lit("a/b/SITE_"), f("yyyyMMdd_HHmmss"), F.lit(".flac")),
        F.concat(F.lit("a/b/SITE_"), f("yyyyMMdd_HHmm"), F.lit("60.wav")),
        F.concat(F.lit("a/b/SITE_"), f("yyMMddHHmmss"), F.lit(".flac")),
        F.concat(F.lit("a/b/SITE_"), f("yyMMdd_HHmmss"), F.lit(".flac")),
        F.concat(F.lit("a/b/SITE_69"), f("MMdd_HHmmss"), F.lit(".flac")),
        F.concat(F.lit("a/b/SITE_"), f("yyyyMMdd_HHmm"), F.lit("xo.flac")),
        F.concat(F.lit("a/b/SITE_Post-Deployment_"), f("yyyyMMdd_HHmmss"), F.lit(".flac")),
        F.lit("a/b/notes.txt"),
    ]
    return e.select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int")).alias("path"))


@query
def name_time_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _named(events(spark, sf_dir)).where(names.is_recording(F.col("path")))
    return x.select("event_id", "path", names.start_time(F.col("path")).cast("timestamp_ntz").alias("start_ts"))


@query
def name_utc_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = events(spark, sf_dir).select("event_id", F.concat(F.lit("X."), F.date_format("ts", "yyyyMMdd_HHmmss"), F.when(F.col("event_type") == "view", "Z.flac").otherwise("Z.wav")).alias("path"))
    return x.select("event_id", names.utc_start_time(F.col("path")).cast("timestamp_ntz").alias("start_ts"))


@query
def unparsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _named(events(spark, sf_dir)).withColumn("start_ts", names.start_time(F.col("path")))
    return splits.unparsed(x, "start_ts")


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", names.basename(p).alias("base"), names.stem(p).alias("stem"), names.parent(p).alias("parent"))


@query
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.clean_label(F.concat_ws("/", "p_name", "p_type")).alias("label"))


@query
def remote_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("C:\\DCLDE\\"), F.col("p_brand"), F.lit("\\"), F.col("p_type"), F.lit("\\x.wav")))
    return x.select("p_partkey", names.remote_path(F.col("path"), F.concat(F.col("p_name"), F.lit(".WAV"))).alias("remote"))


@query
def leading_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.col("o_orderpriority")).alias("name"))
    d = names.leading_date(F.col("name"))
    return x.select("o_orderkey", d.alias("day"), splits.by_date(d, "1996-01-01").alias("split"))


# annotated events


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    begin = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return e.select(
        F.col("event_id").alias("idx"),
        (F.col("value") > 1.0).alias("FileOk"),
        F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(F.concat(F.col("event_type"), F.lit(" sp"))).alias("ClassSpecies"),
        F.concat(F.lit("day"), F.dayofyear("ts").cast("string"), F.lit("/"), (F.col("user_id") % 10).cast("string")).alias("FilePath"),
        F.concat(F.lit("f"), F.dayofyear("ts").cast("string"), F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("Soundfile"),
        F.lit("set").alias("Dataset"),
        begin.cast("double").alias("FileBeginSec"),
        (begin + F.col("value") - 2.0).alias("FileEndSec"),
        F.lit(86400.0).alias("duration"),
        F.col("ts").alias("rec_ts"),
    )


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = annotations.positive_length(annotations.usable(_annotations(spark, sf_dir)), "FileBeginSec", "FileEndSec")
    return annotations.with_windows(good, "idx", "FileBeginSec", "FileEndSec", "duration")


@query
def usable_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.usable(_annotations(spark, sf_dir)).select("idx", "ClassSpecies")


@query
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.positive_length(annotations.usable(_annotations(spark, sf_dir)), "FileBeginSec", "FileEndSec")[1].select("idx", "error")


@query
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("idx", F.round("window_start", 6).alias("window_start"), F.round("window_end", 6).alias("window_end"))


@query
def overlap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotations.overlapping_labels(_windows(spark, sf_dir), "idx", "FilePath", "FileBeginSec", "FileEndSec", "ClassSpecies")
    return out.withColumn("labels", F.array_join("labels", "|"))


@query
def window_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    labels = annotations.overlapping_labels(w, "idx", "FilePath", "FileBeginSec", "FileEndSec", "ClassSpecies")
    out = annotations.metadata(w, labels, "idx", "Soundfile", "FileBeginSec", "FileEndSec", "ClassSpecies", "Dataset", "FilePath", F.lit(48000))
    return out.withColumns({c: F.round(c, 6) for c in ("window_start", "window_end", "window_length", "annotation_start", "annotation_end")})


@query
def multilabel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotations.overlapping_labels(_windows(spark, sf_dir), "idx", "FilePath", "FileBeginSec", "FileEndSec", "ClassSpecies")
    return out.groupBy(F.array_join("labels", "|").alias("labels"), "multilabel").agg(F.count(F.lit(1)).alias("n"))


@query
def annotation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.profile(annotations.usable(_annotations(spark, sf_dir)), "FilePath", "ClassSpecies")


@query
def new_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return annotations.only_new(e.where("event_type = 'view'").select("event_id", "user_id"), e.where("event_type = 'purchase' and value > 100"), ["user_id"])


@query
def groups_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("file")).distinct()
    there = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("file"))
    return annotations.all_present(files, there, "l_suppkey", "file")


# splits


@query
def temporal_split_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query
def split_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = splits.temporal(o, "o_custkey", "o_orderdate").select("o_custkey", "split")
    return o.join(s, "o_custkey").groupBy("split", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query
def split_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    chosen = splits.temporal(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").where("split = 'train'")
    return splits.by_recordings(o, chosen, "o_custkey")[1].select("o_orderkey", "o_custkey")


@query
def class_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.class_codes(table(spark, sf_dir, "orders"), "o_orderpriority")


@query
def shuffled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shuffled_labels(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", ["a", "b", "c"])


@query
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 5 == 0, "test").otherwise("train").alias("split"), F.lit("ship").alias("label"))
    return splits.copy_plan(x, "url", "split", "label")


# windows of recordings


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.col("value").alias("duration"))


@query
def window_grid_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.window_grid(_recordings(spark, sf_dir), "duration", 10.0, whole=True).select("event_id", "win_idx", "offset")


@query
def window_grid_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.window_grid(_recordings(spark, sf_dir), "duration", 5.0, whole=False).select("event_id", "win_idx", "offset")


@query
def total_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recordings(spark, sf_dir).agg(F.sum(ordered.window_count(F.col("duration"), 5.0, whole=False)).alias("n"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recordings(spark, sf_dir).select("event_id", ordered.window_count(F.col("duration"), 5.0, whole=False).alias("n_windows"))
    return ordered.prefix_index(r, ["event_id"], "n_windows")


@query
def prefix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("event_id", "n_windows", "lo", "hi")


@query
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir).select((F.col("event_id") * 7).alias("idx"))
    return ordered.lookup(at, "idx", _index(spark, sf_dir), "event_id").select("idx", "event_id", "win_idx")


@query
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "10 seconds")
    out = events(spark, sf_dir).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# vectors and clusters


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _centroids(e: DataFrame) -> DataFrame:
    return kmeans.means(e, "label").withColumnRenamed("label", "cid")


@query
def centroids_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kmeans.means(_emb(spark, sf_dir), "label")
    return c.select("label", "n", F.posexplode("cvec").alias("pos", "x")).select("label", "n", "pos", F.round("x", 6).alias("x"))


@query
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    return kmeans.assign(e, _centroids(e)).select("vec_id", "cid", F.round("dist", 6).alias("dist"))


@query
def nearest_centroid_cos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    return kmeans.assign(e, _centroids(e), kind="cos").select("vec_id", "cid", F.round("dist", 6).alias("dist"))


@query
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).select("vec_id", F.col("label").alias("cid"))
    return kmeans.members(e, "vec_id", 12).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query
def cluster_members_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).select("vec_id", F.when(F.col("label") != 3, F.col("label") * 2).alias("cid")).where("cid is not null")
    return kmeans.members(e, "vec_id").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query
def kmeans_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).withColumnRenamed("label", "cid")
    return kmeans.potential(e).select(F.round("potential", 4).alias("potential"), "n")


@query
def mean_nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    return kmeans.assign(e, _centroids(e)).agg(F.round(F.avg("dist"), 6).alias("pot"), F.count_distinct("cid").alias("k"))


@query
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    c = _centroids(e)
    new = kmeans.updated(c, kmeans.assign(e, c))
    return new.select("cid", F.posexplode("cvec").alias("pos", "x")).select("cid", "pos", F.round("x", 6).alias("x"))


@query
def online_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    state = _centroids(e).select("cid", "cvec", F.lit(1).cast("long").alias("n"))
    new = kmeans.online_update(state, kmeans.assign(e, state))
    return new.select("cid", "n", F.posexplode("cvec").alias("pos", "x")).select("cid", "n", "pos", F.round("x", 6).alias("x"))


@query
def closest_s_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    a = kmeans.assign(e, _centroids(e)).withColumn("dist", F.round("dist", 9))
    return kmeans.closest(a, "vec_id", 5).select("cid", "vec_id", "rank")


@query
def cluster_distance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    a = kmeans.assign(e, _centroids(e)).withColumn("dist", F.round("dist", 9))
    return kmeans.closest(a, "vec_id").select("cid", "vec_id", "rank")


@query
def path_distance_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    c1 = _centroids(e)
    c2 = kmeans.means(c1.withColumn("top", F.col("cid") % 3), "top", "cvec").select(F.col("top").alias("cid2"), F.col("cvec").alias("v2"))
    x = e.join(c1.select(F.col("cid").alias("label"), F.col("cvec").alias("v1")), "label").withColumn("cid2", F.col("label") % 3).join(c2, "cid2")
    x = x.withColumn("distance", F.round(hierarchy.path_distance([F.col("embedding"), F.col("v1"), F.col("v2")]), 6))
    return hierarchy.nearest_n(x, "distance", "vec_id", 50).select("vec_id", "distance")


@query
def running_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", F.col("value").alias("distance"))
    state = None
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        state = hierarchy.merged_nearest(state, part, "distance", "event_id", 25)
    return state


# cluster trees


def _edges(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return [c.select(F.col("c_custkey").alias("child"), F.col("c_nationkey").alias("parent")), n.select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent"))]


@query
def flat_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.flat_sizes(_edges(spark, sf_dir))


@query
def merged_hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)[0]
    return hierarchy.merged([e.where("child % 2 = 0"), e.where("child % 2 = 1")]).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    x = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", "n_nationkey").agg(F.sum(F.col("c_custkey") % 7).alias("size"))
    return x.withColumn("target", (F.col("n_regionkey") + 1) * 150)


@query
def waterfill_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.with_cut(_sizes(spark, sf_dir), ["n_regionkey"], "n_nationkey", "size", "target").select("n_regionkey", "n_nationkey", "size", "target", "cut")


@query
def waterfill_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.with_quota(_sizes(spark, sf_dir), ["n_regionkey"], "n_nationkey", "size", "target").select("n_regionkey", "n_nationkey", "size", "target", "cut", "quota")


@query
def hier_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    x = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_regionkey", "n_nationkey")
    drawn = hierarchy.sample(x, ["n_regionkey", "n_nationkey"], "c_custkey", 777)
    return drawn.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("most_copies"))


@query
def hier_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    x = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_regionkey", "n_nationkey", "c_acctbal")
    return hierarchy.sample(x, ["n_regionkey", "n_nationkey"], "c_custkey", 400, order="distance", by="c_acctbal").select("c_custkey", "copy")


# measures


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    return kmeans.assign(e, _centroids(e)).select("vec_id", "label", F.col("cid").alias("pred"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each of ten classes: an embedding's first entries, coarse so that they tie."""
    e = _emb(spark, sf_dir).select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: F.round(x.cast("double"), 2)).alias("scores"))
    return evaluate.one_vs_rest(e, "label", "scores")


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_predicted(spark, sf_dir), "label", "pred").select(F.round("accuracy", 6).alias("accuracy"), "n")


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_predicted(spark, sf_dir), "label", "pred", list(range(10)))


@query
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(_scores(spark, sf_dir), "cls", "positive", "score").select("cls", F.round("ap", 6).alias("ap"), "n_pos")


@query
def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro(evaluate.average_precision(_scores(spark, sf_dir), "cls", "positive", "score"), "ap").select(F.round("macro_ap", 6).alias("macro_ap"))


@query
def roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(_scores(spark, sf_dir), "cls", "positive", "score").select("cls", F.round("auc", 6).alias("auc"), "n_pos")


@query
def roc_auc_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro(evaluate.roc_auc(_scores(spark, sf_dir), "cls", "positive", "score"), "auc").select(F.round("macro_auc", 6).alias("macro_auc"))


@query
def roc_auc_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.weighted(evaluate.roc_auc(_scores(spark, sf_dir), "cls", "positive", "score"), "auc").select(F.round("weighted_auc", 6).alias("weighted_auc"))


@query
def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emb(spark, sf_dir).select("vec_id", vectors.argmax(F.slice("embedding", 1, 10)).alias("pred"))


@query
def mean_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.mean_pooled(_emb(spark, sf_dir).withColumn("rec", F.col("vec_id") % 20), "rec", "embedding")
    return p.select("rec", F.posexplode("pooled").alias("pos", "x")).select("rec", "pos", F.round("x", 6).alias("x"))


@query
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emb(spark, sf_dir).agg(F.count_distinct("label").alias("n_labels"))


# order and sets


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as position reports: a place, a speed and a course made of their numbers."""
    e = events(spark, sf_dir)
    place = {"LAT": F.col("event_id") % 120 - 60.0, "LON": F.col("user_id") % 300 - 150.0, "SOG": F.col("event_id") % 23 + 0.5, "COG": (F.col("event_id") * 7 % 360).cast("double")}
    return e.select("event_id", F.col("ts").alias("BaseDateTime"), *[c.cast("double").alias(k) for k, c in place.items()])


@query
def track_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tracks.grid(_tracked(spark, sf_dir), 3, 10)
    return g.select("event_id", "step", "timestamp", F.round("lat_at", 7).alias("lat_at"), F.round("lon_at", 7).alias("lon_at"))


@query
def track_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tracks.grid(_tracked(spark, sf_dir), 2, 60).where("step = 1")
    az, el, far = tracks.bearing(F.col("lat_at"), F.col("lon_at"), F.lit(100.0), F.col("LAT"), F.col("LON"))
    return g.select("event_id", F.round(az, 4).alias("az_deg"), F.round(el, 5).alias("el_deg"), F.round(far, 3).alias("range_m"))


@query
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic function of each vector's first entry."""
    return _emb(spark, sf_dir).select("vec_id", F.round(vectors.sigmoid(F.col("embedding")[0].cast("double")), 9).alias("p"))


@query
def vector_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's windows of 10 entries, and its first 3 entries padded to 5 backwards: the sums of each."""
    v = vectors.doubles(F.col("embedding"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    w = _emb(spark, sf_dir).select("vec_id", F.posexplode(vectors.equal_windows(v, 10)).alias("window", "x"), vectors.reflect_padded(F.slice(v, 1, 3), 5).alias("y"))
    return w.select("vec_id", "window", total(F.col("x")).alias("total"), F.round(F.element_at("y", 4), 6).alias("y4"), F.round(F.element_at("y", 5), 6).alias("y5"))


@query
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.label_counts(annotations.usable(_annotations(spark, sf_dir)), "ClassSpecies")


@query
def by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _visits(spark, sf_dir, 6 * 3600)
    seconds = intervals.seconds_between(F.col("start_time"), F.col("end_time"))
    return v.select("user_id", "start_time", F.round(seconds, 6).alias("seconds")).orderBy(F.desc("seconds"), "user_id", "start_time")


@query
def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.join(e.select("user_id").distinct().orderBy("user_id").limit(10), "user_id", "left_semi").select("event_id", "user_id")


@query
def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.where("event_type = 'view'").select("user_id").unionByName(e.where("event_type = 'click'").select("user_id")).distinct()


@query
def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("user_id").distinct().exceptAll(e.where("event_type = 'purchase' and value > 100").select("user_id").distinct())


@query
def since_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderdate")


@query
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(uniform(8, F.col("event_id")) < 0.1).select("event_id")


# iterative: rows only


@query
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    c = kmeans.kmeans(e, "vec_id", 10, iterations=5)
    return kmeans.assign(e, c).select("vec_id", "cid", F.round("dist", 6).alias("dist"))


@query
def hierarchical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = kmeans.hierarchy(_emb(spark, sf_dir), "vec_id", [8, 3], [8, 2], resamples=1, iterations=2)
    up = levels[1].assigned.select(F.col("id").alias("c1"), F.col("cid").alias("c2"))
    return levels[0].assigned.select("vec_id", F.col("cid").alias("c1")).join(up, "c1")


@query
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the rows that the probe was not fitted to, a fifth of all by hash."""
    e = _emb(spark, sf_dir)
    held_out = uniform(17, F.col("vec_id")) < 0.2
    return probe.predict(e.where(held_out), probe.fit(e.where(~held_out), "embedding", "label", iterations=10), "embedding").select("vec_id", "label", "pred")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)
