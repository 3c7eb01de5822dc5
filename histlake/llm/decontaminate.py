"""Benchmark decontamination (operator 5), on DataFrame functions alone.

Short test items are searched inside long documents. Items are partitioned by size (powers of two of their distinct
five-word shingles). A partition with at most u shingles keeps, of each item, the floor((1 - t) u) + 1 smallest
shingle hashes as its MinHash sketch. A document that contains a share t of an item lacks at most (1 - t) u of its
shingles, so it holds at least one hash of the sketch: the search loses nothing. Candidates are verified by the exact
shingles themselves.

Words are runs of letters and digits, lower-cased, so that punctuation and case do not hide an item. A text of fewer
than five words is one shingle, its whole sequence. Null or empty items and documents have no shingles and match
nothing. A document without an id can't be named and has no rows. Equal items of several ids, repeated documents and ties all give a row for each pair of rows' ids; rows with
one id are taken together. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from histlake.llm.common import let, small, table, written

WIDTH, THRESHOLD = 5, 0.75


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Distinct shingles, as strings of words with a space after each but the last."""

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), lambda i: F.array_join(F.slice(ws, i + 1, WIDTH), " "))
        )

    return F.array_distinct(let(words_of(text), cut))


def shingle_hashes(text: Column) -> Column:
    """A hash of each shingle, made of the hashes of its words, so that no shingle is written out."""

    def cut(h: Column) -> Column:
        n = F.size(h)
        long = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]))
        return F.when(n >= WIDTH, long).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), cut)


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key (the id in a struct, so that null is one too), item (its shingles), n, and the sketch of its size partition."""
    own = F.array_sort(F.array_distinct(shingle_hashes(F.col("text"))))
    sized = items.select(F.struct("item_id").alias("key"), shingles(F.col("text")).alias("item"), own.alias("hashes")).withColumn("n", F.size("item")).filter("n > 0")
    upper = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")
    keep = F.floor((1 - threshold) * upper + 1e-9).cast("int") + 1
    return sized.withColumn("size_partition", upper).withColumn("sketch", F.slice("hashes", F.lit(1), keep)).drop("hashes")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, key) with a hash of the item's sketch in the document."""
    probes = docs.select("doc_id", F.explode(shingle_hashes(F.col("text"))).alias("h"))
    keys = written(items.select("key", F.explode("sketch").alias("h")), "item-sketches")
    return probes.join(small(keys), "h").select("doc_id", "key").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item of which it contains a share of at least threshold:
    doc_id, item_id, n_shingles (of the item), n_shared, containment."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    items = written(sketches(benchmark, threshold), "items")
    found = written(candidates(docs, items), "leak-candidates")
    # Items are broadcast by their bytes: one may have any number of shingles.
    named = items.select("key", "item", "n")
    size = F.length(F.array_join("item", " ")) + 16 * F.col("n")
    held = docs.join(small(found), "doc_id").withColumn("has", shingles(F.col("text"))).drop("text").join(small(named, size=size), "key")
    out = held.select("doc_id", "key.item_id", F.col("n").cast("long").alias("n_shingles"), F.size(F.array_intersect("item", "has")).cast("long").alias("n_shared"))
    out = out.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return out.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6)).filter(F.col("n_shared") >= threshold * F.col("n_shingles"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_shingles(table_: str, key: str) -> str:
    """Distinct shingles of a table, a row each."""
    words = f"SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM {table_}"
    cut = f"list_transform(range(1, greatest(len(ws) - {WIDTH - 1}, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + {WIDTH - 1}), ' '))"
    return f"SELECT DISTINCT {key}, unnest({cut}) AS s FROM ({words}) WHERE len(ws) > 0"


SQL = f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}), i AS ({_sql_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, round(n_shared / n_shingles, 6) AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= {THRESHOLD} * n_shingles
"""
