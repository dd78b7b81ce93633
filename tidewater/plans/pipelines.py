"""The three curation plans, each one lazy DataFrame from its inputs to its result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.chance import uniform
from tidewater.functions.names import deployment_key, is_recording, start_time
from tidewater.operators import annotations, hierarchy, kmeans, matching, sampling, sessions, splits
from tidewater.operators.work import cut


def recordings_of(catalog: DataFrame, path: str = "path") -> DataFrame:
    """(deployment, path, start_ts) of a listing's recordings whose names hold a time."""
    x = catalog.where(is_recording(F.col(path))).withColumn("start_ts", start_time(F.col(path)))
    return x.where("start_ts is not null").select(F.regexp_replace(path, "/[^/]*$", "").alias("deployment"), F.col(path).alias("path"), "start_ts")


def vessel_clips(pings: DataFrame, deployments: DataFrame, catalog: DataFrame, t: int = 250, since: str = "2019-01-01", strict: bool = True, by_vessel: bool = False) -> DataFrame:
    """Pings sampled by rarity, each with the recording that holds its jittered time and the clip's offset in it.

    deployments: (ais_file, col0, col1, col2); the first row of a file counts.
    """
    chosen = sampling.rarity_sample(pings, t, "ping_id", by_vessel=by_vessel).where(F.col("sel_ts") >= F.lit(since).cast("timestamp_ntz"))
    named = deployments.select(F.col("ais_file").alias("file"), deployment_key(F.col("col0"), F.col("col1"), F.col("col2")).alias("deployment"))
    placed = matching.first_match(chosen, named, "ais_file", "file", "deployment", "deployment")
    hit = matching.nearest2_backward(placed, recordings_of(catalog), "deployment", "sel_ts", "start_ts", "path", "ping_id", strict)
    offset = F.timestamp_diff("SECOND", F.col("match_start"), F.col("sel_ts"))
    return hit.where("match_path is not null").withColumn("offset_s", offset)


def cluster_sample(embedded: DataFrame, pings: DataFrame, deployments: DataFrame, levels: list[DataFrame], target: int, sub_target: int, gap_seconds: int = 600) -> DataFrame:
    """Windows without a vessel, drawn evenly over a frozen hierarchy and ranked by path distance.

    embedded: (deployment, ts, path, embedding, key); deployments: (ais_file,
    deployment). Of sub_target rows drawn, the `target` nearest ones are kept.
    """
    seen = sessions.visits(pings, "MMSI", "BaseDateTime", gap_seconds, also=["ais_file"])
    there = seen.join(deployments.select(F.col("ais_file").alias("_f"), "deployment").distinct(), F.col("ais_file") == F.col("_f"))
    free = sessions.uncovered(embedded, there, {"deployment": "deployment"}, "ts")
    x = cut(kmeans.assign(free, levels[0]).withColumnRenamed("cid", "c1").drop("dist"))
    edges = kmeans.applied(x.select("embedding"), levels)[1:]
    vectors = [F.col("embedding")]
    x = x.join(levels[0].select(F.col("cid").alias("c1"), F.col("cvec").alias("v1")), "c1")
    vectors.append(F.col("v1"))
    for i, e in enumerate(edges, start=2):
        up = e.select(F.col("id").alias(f"c{i - 1}"), F.col("cid").alias(f"c{i}")).join(levels[i - 1].select(F.col("cid").alias(f"c{i}"), F.col("cvec").alias(f"v{i}")), f"c{i}")
        x = x.join(up, f"c{i - 1}")
        vectors.append(F.col(f"v{i}"))
    x = x.withColumn("distance", hierarchy.path_distance(vectors))
    names = [f"c{i}" for i in range(len(levels), 0, -1)]
    drawn = hierarchy.sample(x, names, "key", sub_target, order="distance", by="distance")
    return hierarchy.nearest_n(drawn, "distance", "key", target).select("deployment", "ts", "path", "key", "distance", *names)


def labelled_windows(ann: DataFrame, existing: DataFrame | None = None, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, splits, rejected) of annotated events.

    ann: (idx, FileOk, ClassSpecies, FilePath, Soundfile, Dataset, FileBeginSec,
    FileEndSec, duration, rec_ts).
    """
    good, bad = annotations.positive_length(annotations.usable(ann), "FileBeginSec", "FileEndSec")
    w = annotations.with_windows(good, "idx", "FileBeginSec", "FileEndSec", "duration", seed)
    labels = annotations.overlapping_labels(w, "idx", "FilePath", "FileBeginSec", "FileEndSec", "ClassSpecies")
    meta = annotations.metadata(w, labels, "idx", "Soundfile", "FileBeginSec", "FileEndSec", "ClassSpecies", "Dataset", "FilePath", F.lit(None))
    if existing is not None:
        meta = annotations.only_new(meta, existing, ["file"])
    return meta, splits.temporal(w, "Soundfile", "rec_ts", share), bad


def negative_control(rows: DataFrame, key: str, label: str, classes: list[str], seed: int = 9) -> DataFrame:
    return splits.shuffled_labels(rows, key, classes, seed).withColumn(label, F.col("shuffled_label")).drop("shuffled_label")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def hashed_split(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 17) -> DataFrame:
    """rows with split, drawn by hash with the given shares."""
    u, out, low = uniform(seed, F.col(key)), F.lit(None).cast("string"), 0.0
    for name, s in shares.items():
        out = F.when((u >= low) & (u < low + s), name).otherwise(out)
        low += s
    return rows.withColumn("split", out)
