"""Written tables that cut lineage, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Paths made inside of the innermost clearing() block of a thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@cache
def local_scratch() -> str:
    """For tests and single machines: a folder that goes when the process ends."""
    path = tempfile.mkdtemp(prefix="histlake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names. Where it is unset, a temporary one on a local
    master, on which all tasks share a disk; an error on a cluster, where they don't."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = local_scratch()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a written table, which outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Deletes what was made inside at the end, but not after an error. What is to stay must be written after it."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
    for path in made:
        delete(spark, path)
