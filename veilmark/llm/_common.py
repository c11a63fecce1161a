"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Python files that executors import live beside this package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started from."""
    env = spark.sparkContext.environment
    old = env.get("PYTHONPATH", "")
    if ROOT not in old.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, old) if x)
    return spark


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in full (scheme and host included)."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, store.makeQualified(place)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local session (driver and workers are one machine) gets a temporary folder; a cluster is
    refused, since no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    full = _hadoop(spark, found)[1].toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The folder in the shared one that holds all that this application writes; ``clear`` removes it."""
    return f"{shared_dir(spark)}/veilmark-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that nothing else uses, in full, so that Spark and Arrow mean the same place."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new empty folder in the application's folder."""
    path = fresh_path(spark, name)
    store, place = _hadoop(spark, path)
    store.mkdirs(place)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing will read again."""
    for path in paths:
        store, place = _hadoop(spark, path)
        store.delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete all that the operators have written; results that were not yet read are lost."""
    remove(spark, work_dir(spark))


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``written`` returned, once all that was made of them is written itself."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            remove(df.sparkSession, path)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or that with a number, such that no column has the name (Spark's names don't tell cases apart)."""
    taken, name, i = {c.lower() for c in columns}, wanted, 0
    while name.lower() in taken:
        i += 1
        name = f"{wanted}{i}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the path can be in any store that it knows)."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """Apply a per-batch function; ``make`` runs once in each task and returns it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null is empty."""
    return [x or "" for x in column.to_pylist()]
