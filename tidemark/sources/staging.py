"""Tables that a job writes on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[list[str]] = []
#: Folders of local sessions that name none, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        path = _local[context.applicationId]
    return path.rstrip("/")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder (in a folder for each value of ``by``, large ones split) and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance", by) if by else df).write.parquet(path, partitionBy=by)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are removed at the end: what is made from them has to be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)
