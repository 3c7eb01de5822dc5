"""Incremental ingestion of history entries from a folder of Parquet files into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from histlake.plans.store import Store
from histlake.schema import ENTRY


def stream_into(spark: SparkSession, store: Store, folder: str, checkpoint: str):
    """Starts a query that loads all files that are there and not yet loaded, then ends. Entries at or before their
    source's cursor were seen before and are left out; unknown times always pass. A batch that is run again after a
    failure finds its rows in the store and adds none."""

    def load(batch: DataFrame, _: int) -> None:
        cursors = store.meta()["cursors"]
        seen = F.lit(0)
        for source, ts in cursors.items():
            seen = F.when(F.col("source") == source, ts).otherwise(seen)
        store.load([batch.filter((F.col("ts") == 0) | (F.col("ts") > seen))])

    entries = spark.readStream.schema(ENTRY).parquet(folder)
    return entries.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
