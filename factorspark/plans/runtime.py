"""Shared storage and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the plans rely on. Only runtime SQL options, no cluster sizing."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Prices and flow are both laid out by symbol for their windows; this lets the
    # (symbol, trade_date) join between them run on that layout without a shuffle.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, named by spark.checkpoint.dir.

    Only a local[*] session, where driver and executors are one machine, falls
    back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="factorspark-")
    return _LOCAL_FOLDERS[context.applicationId]


#: The paths made inside the open `scratch` of this job. Each thread, and each call of a
#: stream's batch function, has its own, so jobs that run at once do not see each other's.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of the store that holds `path`."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    store, place = filesystem(spark, path)
    store.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Paths made inside, in this thread, are removed at the end; nothing read from them may leave it.

    Callers of research jobs wrap the job and the writing of its result in it."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            remove(spark, path)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    paths = _SCRATCH.get()
    if paths is not None:
        paths.append(path)
    return path


def materialise(frame: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives
    the loss of an executor, and every later reader sees the same rows."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    writer = frame.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)

