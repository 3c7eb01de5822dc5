"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from histlake.scratch import scratch, written
from histlake.shipping import ship, small_batches

__all__ = ["ascii_lower", "held_out", "lean", "let", "scratch", "small", "table", "trim", "words", "written"]

#: The characters between words: space and \x09 to \x0D.
GAP = "[\\x20\\x09-\\x0D]+"
#: Most rows of a few numbers each that a side may have and still be broadcast (about 16 MB).
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table. Where the session has Spark's own bound for batches to Python, it is lowered for good: plans
    read it when they run, which is after this returns. Operators that are given a DataFrame change nothing."""
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives freed memory back to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Wraps a task's function on batches: workers are used again, so what one task needed must not stay."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return wrapped


def small(df: DataFrame, most: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """Broadcasts a written table if its counted rows are within a bound, and, where rows can be of any size, if the sum
    of their sizes is within BROADCAST_BYTES; beyond it the planner shuffles."""
    n, total = df.agg(F.count("*"), F.lit(0) if size is None else F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= BROADCAST_BYTES else df


def let(value: Column, body) -> Column:
    """Evaluates value once per row and passes it to body, which inlining into a lambda would not."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The maximal runs of characters outside GAP; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no label is learned from: crc32(doc_id as text) mod 3 is 1. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
