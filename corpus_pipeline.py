"""The corpus pipeline: five operators in turn, each over all that its predecessor kept.

Documents that the quality classifier rejects go; one document of each group of near copies stays (that with the
smallest id, one with an id before one without); documents that hold a benchmark item go; personal data become
pseudonyms; what is left is encoded. Each row is judged by itself, so rows without an id, and rows that share one but not
the text, meet the same decisions as all others. Texts without words are copies of nothing. The columns of documents
stay as they are, clashing names included; a table without rows gives one without rows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from histlake.llm import decontaminate, ngram_join, pii, quality_classifier, sentencepiece_codec
from histlake.llm.common import small, table, written
from histlake.scratch import clearing, delete, scratch

#: Names for columns of a stage's own, which no input is likely to have.
KEY, OWN = "_pipeline_key", "_pipeline_own_"


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.join(small(written(keys.select(KEY).distinct(), "dropped")), KEY, "left_anti")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    # The score's columns replace ones of their names, so those are named otherwise meanwhile.
    names = {c: OWN + c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")}
    kept = quality_classifier.score(docs.withColumnsRenamed(names), model).filter("predicted = 1")
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def keyed_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a number for each row that is the same in every pass. Rows of Parquet files have one by file and place
    there; others are written down once."""
    if "_metadata" not in map(str.lower, docs.columns) and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        with contextlib.suppress(AnalysisException):
            placed = docs.select("*", F.col("_metadata.file_path").alias(OWN + "file"), F.col("_metadata.row_index").alias(OWN + "place"))
            names = sorted(r[0] for r in placed.select(OWN + "file").distinct().collect())
            files = spark.createDataFrame(list(enumerate(names)), f"{OWN}number long, {OWN}file string")
            key = F.shiftleft(OWN + "number", 40) + F.col(OWN + "place")
            return placed.join(F.broadcast(files), OWN + "file").select(*docs.columns, key.alias(KEY))
    return written(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = keyed_rows(spark, docs)
    found = ngram_join.classes_of(keyed.select(F.col(KEY).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias(KEY), F.col("component_id").alias("component"))
    copies = written(found.join(found.groupBy("component").count().filter("count > 1").drop("count"), "component"), "copies")
    ids = keyed.select(KEY, "doc_id").join(small(copies), KEY)
    first = F.min_by(KEY, F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("first")
    stays = ids.groupBy("component").agg(first).select(F.col("first").alias(KEY))
    return without(keyed, copies.select(KEY).join(stays, KEY, "left_anti")).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whether a text holds an item is a matter of the text alone, so texts are named by their digest."""
    named = docs.withColumn(KEY, F.md5("text"))
    found = decontaminate.leaks(named.select(F.col(KEY).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(named, found.select(F.col("doc_id").alias(KEY))).select(docs.columns)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, spans="pii_spans").withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs).select("doc_id", "token_ids", "n_tokens", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("PII", pseudonymised),
    ("SentencePiece encoding", encoded),
]

#: Trained models and keyed permutations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes once its result is, and that once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    *stages, (_, last) = STAGES
    for i, (_, stage) in enumerate(stages, 1):
        path = scratch(spark, f"stage-{i}")
        with clearing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            delete(spark, before)
        before, docs = path, spark.read.schema(out.schema).parquet(path)
    return last(spark, docs, sf_dir)
