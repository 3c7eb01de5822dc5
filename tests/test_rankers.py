import random
import re
import sqlite3
import unicodedata

import numpy as np
import pandas as pd
import pytest

from histlake.functions import texts
from histlake.functions.texts import partial_ratio, partial_ratios, tokens_of
from histlake.functions.vectors import CachedEncoder, hash_encode
from histlake.operators import evaluation, nearest, ranking
from histlake.sources.datasets import Dataset

CORPUS = ["git commit -m fix", "git push origin main", "docker run nginx", "find . -name '*.py'", "grep -r todo .", "Café au lait", "ls", "git log --oneline git", "kubectl get pods", "tar xzf a.tgz"]
QUERIES = ["git commit the git fix", "find python files", "cafe", "nothing matches zzz", "", "docker nginx run run"]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, nl string")


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.doc_id)
    return out


def test_tokens():
    assert tokens_of("Café_AU lait-2") == ["cafe", "au", "lait", "2"]


def test_bm25_is_fts5(tables):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61 remove_diacritics 1')")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(CORPUS, 1)))
    got = {(r.query_id, r.doc_id): r.score for r in ranking.bm25(*tables, 10).collect()}
    want = {}
    for i, q in enumerate(QUERIES):
        if t := tokens_of(q):
            for rowid, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" OR ".join(f'"{x}"' for x in t),)):
                want[i, rowid - 1] = -s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_token_overlap(tables):
    assert lists(ranking.token_overlap(*tables, 3)) == {0: [0, 1, 7], 1: [3], 2: [5], 5: [2]}


def test_naive(tables):
    want = {}
    for i, q in enumerate(QUERIES):
        s = [(-sum(w in c.lower() for w in q.lower().split()), j) for j, c in enumerate(CORPUS)]
        if x := [j for n, j in sorted(s) if n][:4]:
            want[i] = x
    assert lists(ranking.naive(*tables, 4)) == want


def slow_ratio(a, b):
    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = row[:]
            for j, d in enumerate(y, 1):
                row[j] = last[j - 1] + 1 if c == d else max(last[j], row[j - 1])
        return row[-1]

    best = 0.0
    for s, t in ([(a, b), (b, a)] if len(a) == len(b) else [sorted((a, b), key=len)]):
        for i in range(1 - len(s), len(t)):
            w = t[max(0, i) : i + len(s)]
            best = max(best, 200 * common(s, w) / (len(s) + len(w)))
    return best


def test_partial_ratio():
    for a, b in [("abc", "xxabcxx"), ("abd", "abc"), ("kitten", "sitting now"), ("a", "b"), ("git psh", "git push origin")]:
        assert partial_ratio(a, b) == pytest.approx(slow_ratio(a, b))
    r = random.Random(0)
    for _ in range(60):
        a, b = ("".join(r.choice("abcé🎉 ") for _ in range(r.choice((1, 3, 20, 63, 64, 65, 130)))) for _ in range(2))
        assert partial_ratio(a, b) == pytest.approx(slow_ratio(a, b))
    assert partial_ratios("git", ["git push", "", "g", "tig"]).tolist() == [partial_ratio("git", t) for t in ("git push", "", "g", "tig")]
    assert partial_ratio("", "") == 100 and partial_ratio("", "a") == 0


def test_fuzzy(tables):
    got = lists(ranking.fuzzy(*tables, 3))
    for i, q in enumerate(QUERIES):
        s = sorted((-partial_ratio(q, c), j) for j, c in enumerate(CORPUS))
        assert got.get(i, []) == [j for x, j in s if x][:3]


def test_partial_ratios_of_many_lengths():
    r = random.Random(1)
    for n in (5, 40, 130):
        query = "".join(r.choice("abcé🎉 ") for _ in range(n))
        texts = ["".join(r.choice("abcxé7 ") for _ in range(r.randrange(0, n + 3))) for _ in range(30)] + ["x" * n, "7", "\0"]
        assert partial_ratios(query, texts) == pytest.approx([slow_ratio(query, t) if t else 0.0 for t in texts])


def test_fuzzy_compares_alike_texts_once(spark, monkeypatch):
    """Signs that no query has count by their number only; ids decide among texts that score the same."""
    seen = spark.sparkContext.accumulator(0)

    def counted(query, texts, real=ranking.partial_ratios):
        seen.add(len(texts))
        return real(query, texts)

    monkeypatch.setattr(ranking, "partial_ratios", counted)
    queries = [(0, "find the large folder now"), (1, "where is the folder of mine")]
    texts = [f"http://the.folder/{i:04d}" for i in range(300)] + ["http://mine/1", None, "find the large folder now or then 7"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = lists(ranking.fuzzy(corpus, spark.createDataFrame(queries, "query_id long, nl string"), 4))
    for i, q in queries:
        assert got[i] == [j for x, j in sorted((-slow_ratio(q, t), j) for j, t in enumerate(texts) if t) if x][:4]
    assert seen.value == 3 * len(queries)


def test_semantic(spark):
    corpus = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    queries = spark.createDataFrame([(0, CORPUS[3]), (1, CORPUS[8])], "query_id long, nl string")
    got = lists(ranking.semantic(corpus, queries, 4))
    m = np.round(hash_encode([CORPUS[3], CORPUS[8]]).astype(float) @ hash_encode(CORPUS).astype(float).T, 5)
    assert got == {i: np.lexsort((np.arange(10), -m[i]))[:4].tolist() for i in (0, 1)} and got[0][0] == 3


def test_nearest_each_in_tiles(spark, monkeypatch):
    """Ties by id across tiles and tasks; a tile of scores is all that is held of the pairs."""
    seen = spark.sparkContext.accumulator(0)

    def tile(*args, real=nearest.best_of):
        assert len(args[0]) <= 16 * (8 + 3)
        seen.add(1)
        return real(*args)

    monkeypatch.setattr(nearest, "best_of", tile)
    for name, n in (("QUERY_BLOCK", 16), ("VECTOR_BLOCK", 8), ("NUMBERS", 60)):
        monkeypatch.setattr(nearest, name, n)
    r = np.random.default_rng(0)
    v = r.integers(-1, 2, (100, 3)).astype(float)
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in r.permutation(100).tolist()], "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i + 1000, v[i].tolist()) for i in range(45)], "query_id long, embedding array<double>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in nearest.nearest_each(vectors, queries, 3, 5).collect()}
    m = np.round(v[:45] @ v.T, 5)
    assert got == {(i + 1000, n): (j, m[i, j]) for i in range(45) for n, j in enumerate(np.argsort(-m[i], kind="stable")[:3].tolist(), 1)}
    assert seen.value > 10


def test_cache():
    seen = []
    c = CachedEncoder(lambda t: seen.extend(t) or hash_encode(t), 2)
    a = c(["x", "y", "x"])
    assert np.array_equal(a[0], a[2]) and seen == ["x", "y"]
    c(["x", "z"])  # x was touched, so y goes
    c(["x", "y"])
    assert seen == ["x", "y", "z", "y"]
    assert CachedEncoder(hash_encode)(["x"]).shape == (1, 384)


def test_evaluation(spark, tables, tmp_path):
    corpus, queries = tables
    gold = spark.createDataFrame([(0, CORPUS[0]), (2, CORPUS[5]), (2, CORPUS[6]), (3, CORPUS[1])], "query_id long, text string")
    out = evaluation.evaluate(Dataset("toy", corpus, queries, gold), "bm25", hard=600)
    assert out["per_query_ranks"] == [1, None, 1, None, None, None]
    assert out["recall_at_1"] == pytest.approx(2 / 6) and out["mrr"] == pytest.approx(2 / 6)
    assert out["random_baseline_recall_at_5"] == pytest.approx(4 / 6 * 5 / 10)
    p = str(tmp_path / "r.json")
    evaluation.append_history([out], p)
    evaluation.append_history([out], p)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        evaluation.append_history([out], str(tmp_path / "bad.json"))
    ranks = lambda *r: spark.createDataFrame(list(enumerate(r)), "query_id long, rank int")
    got = evaluation.verdicts(ranks(1, 2, None, None, 7, 1), ranks(1, 1, 3, None, None, 6)).orderBy("query_id").collect()
    assert [r.verdict for r in got] == ["tie", "bm25-wins", "bm25-only", "both-fail", "both-fail", "semantic-only"]
    with pytest.raises(evaluation.EvaluationTimeError):
        evaluation.evaluate(Dataset("toy", corpus, queries, gold), "bm25", hard=0)
    with pytest.raises(ValueError):
        ranking.rankers_of("zz")


def test_tokens_in_parts(monkeypatch):
    """Tokens of a batch are handed on in parts, and are those of the plain rule."""
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
    r = random.Random(2)
    odd = ["".join(chr(r.choice((r.randrange(128), r.randrange(0x3000), r.randrange(0xD800)))) for _ in range(12)) for _ in range(500)]
    for t in ["", "a_b__c", "É é ß ﬁ", "x̀_y", *odd]:
        assert tokens_of(t) == re.findall(r"[^\W_]+", bare(t)) and texts.ascii_tokens(t) == [x.lower() for x in re.findall("[A-Za-z0-9]+", t)]
    monkeypatch.setattr(texts, "CHARACTERS", 100)
    column = pd.Series(["ab cd " * 10, None, "x" * 300, "", "y z"] * 3)
    parts = list(texts.tokens.func(iter([column])))
    assert pd.concat(parts).tolist() == [None if t is None else t.split() for t in column] and len(parts) >= 6
    assert [s.stop - s.start for s in texts.slices(column, 1)] == [1] * 15
