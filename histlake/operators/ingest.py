"""From entries to stored commands: redact, hash, drop what is known, number, embed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from histlake.operators.numbering import numbered

#: The order in which sources are drained.
SOURCE_RANK = {"zsh": 0, "bash": 1, "atuin": 2}
KEY = ("source", "text_hash", "ts")


def concatenated(entries: Sequence[DataFrame]) -> DataFrame:
    """All sources, with their rank."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv]), F.col("source")), F.lit(len(SOURCE_RANK)))
    return reduce(DataFrame.unionByName, entries).withColumn("source_rank", rank)


def hashed(entries: DataFrame, redact, digest) -> DataFrame:
    """Redacts, then hashes what is left; text goes."""
    return entries.withColumn("text_scrubbed", redact(F.col("text"))).withColumn("text_hash", digest(F.col("text_scrubbed"))).drop("text")


def first_of_each(rows: DataFrame) -> DataFrame:
    """One row for each (source, hash, ts): the first in its source. A minimum by partial aggregation, not a window,
    so that a command that was typed a billion times meets as one row of each task."""
    rest = [c for c in rows.columns if c not in (*KEY, "ordinal")]
    first = F.min_by(F.struct(*rest), "ordinal").alias("r")
    return rows.groupBy(*KEY).agg(first, F.min("ordinal").alias("ordinal")).select(*KEY, "ordinal", "r.*")


def unknown(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose key the store has not."""
    return rows.join(store.select(*KEY), list(KEY), "left_anti")


def numbered_after(rows: DataFrame, last: int, order: Sequence[str] = ("source_rank", "ordinal", "text_hash")) -> DataFrame:
    """Ids from last + 1 on, without gaps, in an order."""
    return numbered(rows, order, "id", last + 1)


def counters(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """source, inserted, skipped."""
    seen = rows.groupBy("source").agg(F.count("*").alias("seen"))
    new = kept.groupBy("source").agg(F.count("*").alias("inserted"))
    n: Column = F.coalesce("inserted", F.lit(0))
    return seen.join(new, "source", "left").select("source", n.alias("inserted"), (F.col("seen") - n).alias("skipped_dedup"))


def cursors(rows: DataFrame) -> DataFrame:
    """source and its latest known time; sources without one don't advance."""
    return rows.groupBy("source").agg(F.max("ts").alias("cursor")).filter("cursor > 0")
