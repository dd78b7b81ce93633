"""Sinks. Each can be run again: what is there is kept, replaced as a whole, or only added to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import files
from tidewater.operators.annotations import only_new


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; made and written if it is not there, or if forced."""
    if force or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def selection_path(root: str, t: int) -> str:
    """Where the selection of a rarity parameter is kept."""
    return f"{root.rstrip('/')}/t={t}"


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces a table, in folders by the given columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def save_version(df: DataFrame, path: str, version: int) -> str:
    """A state table for a version; writing a version again gives the same."""
    at = f"{path.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(at)
    return at


def append_csv(df: DataFrame, path: str, key: str) -> None:
    """Adds rows whose key is not in the CSV table yet; arrays are joined by |."""
    spark = df.sparkSession
    flat = df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    if exists(spark, path):
        flat = only_new(flat, spark.read.schema(flat.schema).csv(path, header=True), [key])
    flat.write.mode("append").csv(path, header=True)


def split_csv(df: DataFrame, path: str, split: str = "split") -> None:
    """A CSV table with a folder for each split."""
    df.write.mode("overwrite").partitionBy(split).csv(path, header=True)


def dead_letters(df: DataFrame, path: str, error: str = "error") -> DataFrame:
    """Writes rows that have an error, and gives those that have none."""
    df.where(F.col(error).isNotNull()).write.mode("append").parquet(path)
    return df.where(F.col(error).isNull()).drop(error)


def write_files(df: DataFrame, root: str, name: str = "clip", data: str = "data") -> DataFrame:
    """(name, bytes) after writing each row's data to root/name; root is a path or address that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [files.put(f"{root.rstrip('/')}/{n}", d) for n, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return df.where(F.col(data).isNotNull()).select(F.col(name), F.col(data)).mapInArrow(run, "name string, bytes long")


def copy_files(plan: DataFrame, root: str) -> DataFrame:
    """(src, dst, status) of a copy plan: copied, there already, or missing."""

    def copied(src: str, dst: str) -> str:
        to = f"{root.rstrip('/')}/{dst}"
        if files.exists(to):
            return "present"
        if not files.exists(src):
            return "missing"
        with files.opened(src) as f:
            files.put(to, f)
        return "copied"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [copied(s, d) for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["src", "dst", "status"])

    return plan.select("src", "dst").mapInArrow(run, "src string, dst string, status string")


def log_run(spark: SparkSession, path: str, step: str, counts: dict[str, int]) -> None:
    """Adds a line (at, step, name, n) to a run's log for each count."""
    rows = spark.createDataFrame([(step, k, int(v)) for k, v in counts.items()], "step string, name string, n long")
    rows.select(F.current_timestamp().alias("at"), "step", "name", "n").coalesce(1).write.mode("append").json(path)
