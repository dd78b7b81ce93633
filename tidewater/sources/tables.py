"""Tables: each reader declares its schema, so a scan reads no more than a query asks for."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions.names import basename, is_recording, parent, start_time
from tidewater.operators.ordered import running_total


def pings(spark: SparkSession, path: str) -> DataFrame:
    """Ping CSVs of a folder, with ais_file, and ping_id: a hash of the row that tells pings apart."""
    x = spark.read.schema(schemas.PINGS).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path, header=True).withColumn("ais_file", F.col("_metadata.file_name"))
    return x.where("MMSI is not null").withColumn("ping_id", F.xxhash64("ais_file", "MMSI", "BaseDateTime", "LAT", "LON"))


def ping_files(spark: SparkSession, path: str) -> DataFrame:
    """(ais_file, length) of a folder's CSVs, by name; contents are not read."""
    return files(spark, path, "*.csv").select(basename(F.col("path")).alias("ais_file"), "length").orderBy("ais_file")


def deployments(spark: SparkSession, path: str) -> DataFrame:
    """The deployment table from CSV, or from Excel where openpyxl is installed; longest recordings first.

    ais_file: one row for each of a deployment's AIS files, which are comma-separated.
    """
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        book = pd.read_excel(path)
        book = book.rename(columns=dict(zip(book.columns[:3], ("col0", "col1", "col2"), strict=True)))
        x = spark.createDataFrame(book[["col0", "col1", "col2", "AIS data file", "Audio Start", "Audio End"]].astype(object).where(book.notna(), None), schemas.DEPLOYMENTS)
    else:
        x = spark.read.schema(schemas.DEPLOYMENTS).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True)
    x = x.withColumn("ais_file", F.explode_outer(F.transform(F.split("AIS data file", ","), lambda x: F.trim(x))))
    return x.orderBy(F.timestamp_diff("SECOND", F.col("Audio Start"), F.col("Audio End")).desc_nulls_last(), "col0", "col1", "col2", "ais_file")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of all files below a path; contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, label, start_ts) of recordings below a path; the label is the folder's name."""
    x = files(spark, path, "*.{flac,wav}").where(is_recording(F.col("path")))
    return x.select("path", "length", parent(F.col("path")).alias("label"), start_time(F.col("path")).alias("start_ts"))


def within_bytes(listed: DataFrame, cap: int) -> DataFrame:
    """Of files (path, length), the first by path whose lengths together are no more than `cap` bytes."""
    return running_total(listed, ["path"], "length", "total").where(F.col("total") <= cap).drop("total")


def object_count(spark: SparkSession, path: str) -> int:
    return files(spark, path).count()


def contents(spark: SparkSession, path: str, pattern: str = "*.{flac,wav}") -> DataFrame:
    """(path, content): whole files, read by the executors."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def embedding_files(spark: SparkSession, path: str, seconds: int = 10) -> DataFrame:
    """(rec, win_idx, ts, embedding) of .npy matrices; row i is the window i * seconds after the name's time."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    x = x.select("path", start_time(F.regexp_replace("path", r"\.npy$", ".flac")).cast("timestamp_ntz").alias("start"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, data in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                m = np.load(BytesIO(data), allow_pickle=False).astype(np.float32)
                for at in range(0, len(m), 1000):
                    part = m[at : at + 1000]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, m.shape[1]), pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int32()), pa.array([start.as_py()] * len(part), pa.timestamp("us")), vectors], ["rec", "win_idx", "start", "embedding"])

    y = x.mapInArrow(run, "rec string, win_idx int, start timestamp_ntz, embedding array<float>")
    return y.select("rec", "win_idx", F.timestamp_add("SECOND", F.col("win_idx") * seconds, F.col("start")).alias("ts"), "embedding")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ANNOTATIONS).csv(path, header=True)


def windows(spark: SparkSession, path: str) -> DataFrame:
    """Window metadata; labels come as an array."""
    return spark.read.schema(schemas.WINDOWS).csv(path, header=True, multiLine=True).withColumn("labels", F.split("labels", r"\|"))


def labelled_set(spark: SparkSession, path: str) -> DataFrame:
    """A labelled set's table with its own header; cells may hold commas and line ends."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def track(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRACK).csv(path, header=True)


def state(spark: SparkSession, path: str) -> DataFrame:
    """Centroids, edges, selections or resample state, as sinks.save() wrote them."""
    return spark.read.parquet(path)


def selection_rows(arrays: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a table that keeps each column as one array."""
    return arrays.select(F.explode(F.arrays_zip(*columns)).alias("_z")).select(*[F.col(f"_z.{c}").alias(c) for c in columns])
