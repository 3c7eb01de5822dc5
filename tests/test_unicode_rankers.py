"""Ranker queries over the driver's tables, on texts with accents, against brute force."""

import math
from collections import Counter

import pytest

from histlake.functions.texts import tokens_of
from histlake.operators import ranking
from histlake.plans import driver_queries
from histlake.plans.driver_queries import QUERIES

DOCS = ["Über den Fluß und über die Brücke", "ber den Wald und die Wiese", "El niño comió piñas mañana", "El nino comio pinas", "L'été à la forêt rouénrére", "ouenr re la for t", "ENTFERNT ＦＵＬＬ ﬁn", "plain ascii words only", "über", "mañana mañana y nada más", "straße_und_weg", "nichts von alldem"]
ASKED = ["über die Brücke", "comió piñas", "rouénrére forêt", "full fin", "strasse", "plain words"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("accents"))
    spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ranked(score, k):
    out = {}
    for q, nl in enumerate(ASKED):
        s = sorted((-score(tokens_of(nl), tokens_of(d)), i) for i, d in enumerate(DOCS))
        out |= {(q, i): (round(-x, 6), n) for n, (x, i) in enumerate([(x, i) for x, i in s if x][:k], 1)}
    return out


def overlap(q, d):
    return float(len(set(q) & set(d)))


def bm25(q, d):
    terms, n = [tokens_of(x) for x in DOCS], len(DOCS)
    mean, out = sum(map(len, terms)) / n, 0.0
    for t, times in Counter(q).items():
        if tf := d.count(t):
            df = sum(t in x for x in terms)
            idf = math.log((n - df + 0.5) / (df + 0.5))
            out += times * (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return round(out, 9)


def rows(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize(("name", "score"), [("rank_token_overlap_unicode", overlap), ("rank_bm25_unicode", bm25)])
def test_ranks(spark, folder, name, score):
    assert {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in rows(spark, folder, name)} == ranked(score, 5)


def test_fusion(spark, folder):
    sums = Counter()
    for score in (bm25, overlap):
        for pair, (_, n) in ranked(score, 20).items():
            sums[pair] += 1 / (60 + n)
    want = set()
    for q in range(len(ASKED)):
        best = sorted((-s, i) for (x, i), s in sums.items() if x == q)[:5]
        want |= {(q, i, round(-s, 6), n) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in rows(spark, folder, "rank_fusion")} == want


def test_evaluation(spark, folder):
    gold = {q: {i for i, d in enumerate(DOCS) if nl in d} for q, nl in enumerate(ASKED)}
    ranks = {score: {q: min((n for (x, i), (_, n) in ranked(score, 5).items() if x == q and i in gold[q]), default=None) for q in gold} for score in (bm25, overlap)}
    assert {r.query_id: r["rank"] for r in rows(spark, folder, "eval_per_query_ranks_unicode")} == ranks[bm25]
    assert {r.query_id: (r.overlap_rank, r.bm25_rank) for r in rows(spark, folder, "ranker_verdict_unicode")} == {q: (ranks[overlap][q], ranks[bm25][q]) for q in gold}
    (got,) = rows(spark, folder, "eval_metrics_unicode")
    found = [n for n in ranks[bm25].values() if n]
    assert (got.n_queries, got.n_corpus) == (len(ASKED), len(DOCS))
    assert (got.recall_at_1, got.recall_at_5, got.mrr) == tuple(round(x / len(ASKED), 6) for x in (sum(n == 1 for n in found), len(found), sum(1 / n for n in found)))


@pytest.mark.parametrize(("name", "passes"), [("rank_fusion", 2), ("ranker_verdict_unicode", 2)])
def test_texts_are_cut_once_for_both_rankers(spark, folder, monkeypatch, name, passes):
    """Once for the statistics and once for both rankings."""
    cut = spark.sparkContext.accumulator(0)

    def counted(text):
        cut.add(text in DOCS)
        return tokens_of(text)

    monkeypatch.setattr(driver_queries, "tokens_of", counted)
    monkeypatch.setattr(ranking.bm25_and_overlap, "__defaults__", (counted,))
    if name == "rank_fusion":
        driver_queries.rank_fusion(spark, folder).collect()
    else:
        driver_queries.ranker_verdict(spark, folder, counted).collect()
    assert cut.value == passes * len(DOCS)


def test_long_texts_go_in_small_parts(spark, monkeypatch):
    most = spark.sparkContext.accumulator(0)

    class Checked(ranking.Terms):
        def of(self, some, seen=most):
            if len(some) > 1 and sum(map(len, some)) > 1_000_000:
                seen.add(1)
            return super().of(some)

    monkeypatch.setattr(ranking, "Terms", Checked)
    corpus = spark.createDataFrame([(i, "über " * 60_000 * (i + 1)) for i in range(5)], "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(0, "uber")], "query_id long, nl string")
    assert [r.doc_id for r in ranking.token_overlap(corpus, queries, 3).orderBy("rank").collect()] == [0, 1, 2] and most.value == 0
