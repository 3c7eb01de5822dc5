"""Dense numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from histlake.scratch import written

#: Low bits of Spark's increasing ids: the place of a row in its partition.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: Sequence[str], name: str, first: int = 0) -> DataFrame:
    """rows and a column of the numbers first, first + 1, ... in an order. Sorted ranges are written once, each row with
    its range and place; counts and rows are both read from there, so they can't tell of different ranges."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged = written(ranged, "ranges")
    part, place = F.shiftright("_place", PLACE_BITS), F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row for each task of the write, so one window over all of them is small.
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n") + first).alias("_before"))
    out = ranged.withColumn("_part", part).join(F.broadcast(before), "_part", "left")
    return out.withColumn(name, F.col("_before") + place).drop("_part", "_before", "_place")


def dense(rows: DataFrame, name: str, first: int) -> bool:
    """Whether the numbers are first, first + 1, ..., each once. Distinct ones are counted in bitmaps of 32,768 numbers,
    of which each task sends those that it has a part of, so the numbers themselves are not shuffled."""
    n = F.col(name)
    some = rows.groupBy(F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"), F.count("*").alias("n"), F.min(n).alias("low"), F.max(n).alias("high"))
    n, distinct, low, high = some.agg(F.sum("n"), F.sum(F.bitmap_count("bits")), F.min("low"), F.max("high")).first()
    return not n or (n == distinct and (low, high) == (first, first + n - 1))
