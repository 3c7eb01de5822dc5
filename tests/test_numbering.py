"""Dense numbers at sizes at which adaptive execution coalesces ranges."""

import pytest
from pyspark.sql import functions as F

from histlake.operators import ingest
from histlake.operators.numbering import dense, numbered
from histlake.plans.driver_queries import QUERIES
from histlake.plans.store import Store
from histlake.schema import ENTRY, conform


@pytest.fixture
def many(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_two_million_rows(many):
    rows = many.range(0, 2_000_000, 1, 40).select((F.col("id") % 3).cast("int").alias("source_rank"), (F.hash("id").cast("long") * 7919 + F.col("id")).alias("ordinal"), F.col("id").alias("text_hash"), F.repeat(F.lit("x"), 20).alias("rest"))
    got = ingest.numbered_after(rows, 1000).cache()
    assert got.count() == 2_000_000 and dense(got, "id", 1001)
    # The numbers follow the order.
    by_source = got.groupBy("source_rank").agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("source_rank").collect()
    assert all(a.high < b.low for a, b in zip(by_source, by_source[1:]))
    ties = got.select("id", F.struct("source_rank", "ordinal", "text_hash").alias("k"))
    later = ties.select((F.col("id") + 1).alias("id"), F.col("k").alias("was"))
    assert ties.join(later, "id").filter("was >= k").count() == 0
    got.unpersist()


def test_small(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "x string")
    assert sorted(tuple(r) for r in numbered(df, ["x"], "n").collect()) == [("a", 0), ("b", 1), ("b", 2)]
    assert numbered(df.filter("false"), ["x"], "n").count() == 0 and dense(numbered(df.filter("false"), ["x"], "n"), "n", 0)
    assert not dense(spark.createDataFrame([(1,), (1,), (3,)], "n long"), "n", 1)


def test_load(many, tmp_path):
    n = 300_000
    rows = many.range(0, n, 1, 16).select(F.concat(F.lit("run "), F.col("id") % 280_000).alias("text"), F.lit(0).alias("ts"), F.element_at(F.array(*map(F.lit, ingest.SOURCE_RANK)), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.col("id").alias("ordinal"))
    store = Store(many, f"file://{tmp_path}/s", embed=lambda c: F.array(F.lit(0.5).cast("float")))
    got = store.load([conform(rows, ENTRY)])
    want = rows.select("text", "source").distinct().count()
    assert got.inserted == store.commands().count() == want and got.skipped_dedup == n - want and dense(store.commands(), "id", 1)


@pytest.mark.parametrize(("sf", "n"), [("sf0.01", 5000), ("sf0.1", 50_000)])
def test_incremental_at_scale(many, sf, n):
    got = QUERIES["incremental_ingest"](many, f"/root/testdata/{sf}")
    assert got.count() == n and dense(got, "id", 1001)
