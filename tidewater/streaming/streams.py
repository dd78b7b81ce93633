"""Streams: visits, windows, running nearest rows and online centroids.

A stream's checkpoint replaces cursors and lists of what is done. State tables carry
the batch's number, so a batch that is run again gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater import schemas
from tidewater.operators import hierarchy, kmeans
from tidewater.operators.work import cut
from tidewater.sinks.tables import exists, save_version


def table_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """Parquet files as they appear, per_batch at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def ping_stream(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    x = spark.readStream.schema(schemas.PINGS).option("maxFilesPerTrigger", per_batch).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)
    return x.withColumn("ais_file", F.col("_metadata.file_name"))


def file_stream(spark: SparkSession, path: str, since: str | None = None, per_batch: int = 1) -> DataFrame:
    """(path, content) of audio files as they appear; with a date, of recordings that start no earlier."""
    from tidewater.functions.names import start_time

    x = spark.readStream.format("binaryFile").schema(schemas.FILES).option("pathGlobFilter", "*.{flac,wav}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    if since:
        x = x.where(start_time(F.col("path")) >= F.lit(since).cast("timestamp"))
    return x.select("path", "content")


def visits(pings: DataFrame, vessel: str, ts: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(vessel, start_time, end_time, n) of visits, once they can get no further ping.

    As in sessions.visits(), pings that are just `gap` apart are of one visit.
    """
    x = pings.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    out = x.groupBy(vessel, F.session_window("_t", f"{gap} 1 microsecond")).agg(F.min("_t").alias("start_time"), F.max("_t").alias("end_time"), F.count(F.lit(1)).alias("n"))
    return out.select(vessel, "start_time", "end_time", "n")


def tumbling(rows: DataFrame, ts: str, by: str, width: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """(start, by, n) of windows of equal width."""
    x = rows.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return x.groupBy(F.window("_t", width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def _previous(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    at = f"{path.rstrip('/')}/version={batch - 1}"
    return spark.read.parquet(at) if batch > 0 and exists(spark, at) else None


def nearest_rows(rows: DataFrame, state: str, checkpoint: str, distance: str, key: str, n: int) -> StreamingQuery:
    """Keeps the n rows of least distance so far; versions of the table state are by batch."""

    def step(batch: DataFrame, number: int) -> None:
        before = _previous(batch.sparkSession, state, number)
        save_version(hierarchy.merged_nearest(before, batch, distance, key, n), state, number)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_centroids(rows: DataFrame, first: DataFrame, state: str, checkpoint: str, vec: str = "embedding") -> StreamingQuery:
    """Moves centroids (cid, cvec, n) with each batch: labels are those of before the batch."""

    def step(batch: DataFrame, number: int) -> None:
        before = _previous(batch.sparkSession, state, number)
        now = first if before is None else before
        save_version(kmeans.online_update(now, kmeans.assign(batch, now, vec), vec), state, number)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hierarchical_centroids(rows: DataFrame, key: str, clusters: list[int], samples: list[int], state: str, checkpoint: str, resamples: int = 10, vec: str = "embedding", seed: int = 42, first: DataFrame | None = None) -> StreamingQuery:
    """Moves a hierarchy's models with each batch (kmeans.stream_step).

    A version of the table `state` has (level, kind, cid, cvec, n) with kind initial or
    final; `first` is such a table of pretrained models. An empty batch keeps them.
    """

    def models(table: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        part = lambda i, kind: table.where((F.col("level") == i) & (F.col("kind") == kind)).select("cid", "cvec", "n")
        return [(part(i, "initial"), part(i, "final")) for i in range(len(clusters))]

    def step(batch: DataFrame, number: int) -> None:
        before = _previous(batch.sparkSession, state, number)
        before = first if before is None else before
        batch = cut(batch)
        if not batch.isEmpty():
            moved = kmeans.stream_step(None if before is None else models(before), batch, key, clusters, samples, resamples, vec, seed)
            named = [m.select(F.lit(i).alias("level"), F.lit(kind).alias("kind"), "cid", "cvec", "n") for i, both in enumerate(moved) for kind, m in zip(("initial", "final"), both, strict=True)]
            save_version(hierarchy.merged(named), state, number)
        elif before is not None:
            save_version(before, state, number)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, state: str) -> DataFrame:
    """The newest version of a state table."""
    x = spark.read.parquet(state)
    newest = x.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{state.rstrip('/')}/version={newest}")
