"""Evaluation sets: corpus(doc_id, text), queries(query_id, nl) and gold(query_id, text)."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from histlake.operators.numbering import numbered


@dataclass
class Dataset:
    name: str
    corpus: DataFrame
    queries: DataFrame
    gold: DataFrame


def line_table(spark: SparkSession, path: str) -> DataFrame:
    """line (its number) and text, stripped."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line", "text")).select("line", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def nl2bash(spark: SparkSession, folder: str) -> Dataset:
    """Two line-aligned files: golds are grouped by their request, the corpus is all distinct commands."""
    nl, cm = (line_table(spark, f"{folder}/all.{x}") for x in ("nl", "cm"))
    if (a := nl.count()) != (b := cm.count()):
        raise ValueError(f"files misaligned: {a} requests and {b} commands")
    pairs = nl.withColumnRenamed("text", "nl").join(cm, "line").filter("nl <> '' and text <> ''").select("nl", "text").distinct()
    queries = numbered(pairs.select("nl").distinct(), ["nl"], "query_id").select("query_id", "nl")
    corpus = numbered(cm.filter("text <> ''").select("text").distinct(), ["text"], "doc_id").select("doc_id", "text")
    return Dataset("nl2bash", corpus, queries, queries.join(pairs, "nl").select("query_id", "text"))


def checked_query(i: int, q: dict, corpus: set[str]) -> tuple[tuple, list[str]]:
    """A declared request: (id, tier, short, nl, star) and golds. Raises for whatever is not as declared."""

    def need(ok, what: str) -> None:
        if not ok:
            raise ValueError(f"query[{i}]: {what}")

    filled = lambda x: isinstance(x, str) and bool(x.strip())
    need(isinstance(q, dict), "a request is a table")
    need(filled(q.get("nl")), "its text 'nl' is absent or blank")
    need(("gold" in q) != ("golds" in q), "give either 'gold' or 'golds'")
    golds = [q["gold"]] if "gold" in q else q["golds"]
    need(isinstance(golds, list) and golds and all(isinstance(g, str) for g in golds), "golds are a list of one string or more")
    need(set(golds) <= corpus, "a gold is no text of the corpus")
    need(isinstance(q.get("id"), int), "its id is no whole number")
    need(q.get("tier") in ("L", "M", "H"), "its tier is none of L, M and H")
    need(filled(q.get("short")), "its short name is absent or blank")
    return (q["id"], q["tier"], q["short"], q["nl"], bool(q.get("star", False))), golds


def declared(spark: SparkSession, path: str, name: str = "dogfood") -> Dataset:
    """A TOML file with a corpus and declared requests, in their order."""
    parsed = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    corpus, asked = parsed.get("corpus"), parsed.get("query")
    if not isinstance(corpus, list) or not all(isinstance(c, str) for c in corpus):
        raise ValueError("the corpus is to be a list of texts")
    if not isinstance(asked, list) or not asked:
        raise ValueError("there are no requests")
    got = [checked_query(i, q, set(corpus)) for i, q in enumerate(asked)]
    return Dataset(
        name,
        spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string"),
        spark.createDataFrame([(i, *head) for i, (head, _) in enumerate(got)], "query_id long, id long, tier string, short string, nl string, star boolean"),
        spark.createDataFrame([(i, g) for i, (_, golds) in enumerate(got) for g in golds], "query_id long, text string"),
    )
