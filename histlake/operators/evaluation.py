"""Ranks, recall and comparison of rankers on an evaluation set."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from histlake.operators.ranking import RANKERS, Ranker
from histlake.sources.datasets import Dataset

K_MAX = 5
SOFT_SECONDS, HARD_SECONDS = 90.0, float(os.environ.get("HISTLAKE_EVAL_HARD_FAIL_S", "120"))


class EvaluationTimeError(RuntimeError):
    pass


def digest(text: str) -> Column:
    """Texts are compared by digests, so that none is shuffled."""
    return F.sha2(text, 256).alias("digest")


def gold_ranks(ranking: DataFrame, corpus: DataFrame, queries: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id and the best rank at which one of its golds stands; null if none does. Golds are texts of the corpus,
    and those with a doc_id are met by it."""
    if "doc_id" in gold.columns:
        hits = ranking.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    else:
        texts = ranking.join(corpus.select("doc_id", digest("text")), "doc_id")
        hits = texts.join(gold.select("query_id", digest("text")).distinct(), ["query_id", "digest"])
    return queries.select("query_id").join(hits.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def metrics(ranks: DataFrame, corpus: DataFrame, gold: DataFrame, k: int = K_MAX) -> DataFrame:
    """One row: n_queries, n_corpus, recall_at_1, recall_at_5, mrr over all queries, and what chance would reach."""
    within = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0))
    one = ranks.agg(F.count("*").alias("n_queries"), within(1).alias("recall_at_1"), within(5).alias("recall_at_5"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    golds = gold.select("query_id", digest("text")).distinct().agg(F.count("*").alias("n_gold"))
    one = one.join(corpus.agg(F.count("*").alias("n_corpus"))).join(golds)
    chance = F.least(F.lit(1.0), F.col("n_gold") / F.col("n_queries") * k / F.col("n_corpus"))
    return one.select("n_queries", "n_corpus", "recall_at_1", "recall_at_5", "mrr", chance.alias("random_baseline_recall_at_5"))


def verdicts(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("semantic", "bm25")) -> DataFrame:
    """query_id, both ranks and who wins: tie, a name with -wins or -only, or both-fail. Ranks beyond 5 fail."""
    a, b = F.when(F.col("a") <= 5, F.col("a")), F.when(F.col("b") <= 5, F.col("b"))
    both = first.select("query_id", F.col("rank").alias("a")).join(second.select("query_id", F.col("rank").alias("b")), "query_id")
    verdict = (
        F.when(a.isNull() & b.isNull(), "both-fail").when(a.isNull(), f"{names[1]}-only").when(b.isNull(), f"{names[0]}-only")
        .when(a == b, "tie").when(a < b, f"{names[0]}-wins").otherwise(f"{names[1]}-wins")
    )
    return both.select("query_id", a.alias(f"{names[0]}_rank"), b.alias(f"{names[1]}_rank"), verdict.alias("verdict"))


def summary(results: DataFrame) -> DataFrame:
    """ranker and recall_at_5 of some runs, best first, with how many times better the semantic one is."""
    base = results.filter("ranker = 'semantic'").select(F.max("recall_at_5").alias("base"))
    return results.join(F.broadcast(base)).select("ranker", "recall_at_5", F.try_divide("base", "recall_at_5").alias("semantic_times")).orderBy(F.desc("recall_at_5"), "ranker")


def evaluate(dataset: Dataset, ranker: str | Ranker, k: int = K_MAX, hard: float = HARD_SECONDS) -> dict:
    """Runs a ranker on a set: metrics, ranks by query, and seconds of each step. Raises beyond the hard budget."""
    t0 = time.perf_counter()
    run = RANKERS[ranker] if isinstance(ranker, str) else ranker
    t1 = time.perf_counter()
    ranking = run(dataset.corpus, dataset.queries, k)
    t2 = time.perf_counter()
    ranks = gold_ranks(ranking, dataset.corpus, dataset.queries, dataset.gold).cache()
    try:
        row = metrics(ranks, dataset.corpus, dataset.gold, k).first().asDict()
        each = [r["rank"] for r in ranks.orderBy("query_id").collect()]
    finally:
        ranks.unpersist()
    t3 = time.perf_counter()
    if not row["n_queries"]:
        raise ValueError(f"dataset {dataset.name!r} has no eval cases")
    if t3 - t0 > hard:
        raise EvaluationTimeError(f"{t3 - t0:.1f} s > {hard} s")
    name = ranker if isinstance(ranker, str) else getattr(ranker, "__name__", "ranker")
    return row | {"dataset": dataset.name, "ranker": name, "per_query_ranks": each, "runtime_seconds": t3 - t0, "runtime_breakdown": {"init": t1 - t0, "index": t2 - t1, "search": t3 - t2}}


def append_history(results: list[dict], path: str) -> None:
    """Appends to a JSON array of results; anything else in the file is an error and stays."""
    file = Path(path)
    old = json.loads(file.read_text()) if file.exists() else []
    if not isinstance(old, list):
        raise ValueError(f"{path} is not a JSON array")
    part = file.with_suffix(".part")
    part.write_text(json.dumps([*old, *results], indent=2))
    part.replace(file)
