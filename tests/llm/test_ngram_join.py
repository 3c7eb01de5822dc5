import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histlake.llm import components as stars, ngram_join
from histlake.llm.components import components
from histlake.llm.ngram_join import Tree, classes_of, needed, prefix_length, set_hashes, shingle_hashes, word_hashes
from tests.llm.conftest import prose


def brute(rows):
    """n_shingles and component_id of each row, from all pairs of sets of word tuples."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for j, (e, _) in enumerate(rows) if root(j) == root(i) and e is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids, default=None)))
    return sorted(out, key=str)


def run(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in classes_of(df).collect()], key=str)


def test_all_sorts(docs, texts):
    assert run(docs) == brute(texts)


def test_empty(none):
    assert run(none) == []


def cluster(seed):
    """A group of near copies at all distances, a passage that many texts share, and singles."""
    r = random.Random(seed)
    base, passage = prose(seed, 100).split(), prose(seed + 1, 60)
    rows = []
    for i in range(120):
        w = [x if r.random() > (i % 7) * 0.01 else f"e{r.randrange(10**6)}" for x in base]
        rows.append((i, " ".join(w[: 100 - i % 9])))
    rows += [(200 + i, f"{prose(1000 + i, 20 + i % 40)} {passage} {prose(2000 + i, 5 + i % 50)}") for i in range(100)]
    rows += [(400 + i, prose(3000 + i, r.randrange(1, 80))) for i in range(40)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [10, 20])
def test_clusters(spark, seed):
    rows = cluster(seed)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("seed", [30, 40])
def test_clusters_in_small_parts(spark, monkeypatch, seed):
    """Hot shingles, hubs and cells go in parts, and sketches are added up over several levels."""
    for name, value in {"PART_ROWS": 20, "CELL_ROWS": 3, "PARTNERS": 4, "FAN_IN": 2, "MANY": 6}.items():
        monkeypatch.setattr(ngram_join, name, value)
    assert ngram_join.parts_by_class(40.0, 3).tolist() == [1, 4, 8, 16]
    rows = cluster(seed)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_rows_without_id_link(spark):
    """One without an id stands between two that have one; others have sets or groups of their own."""
    base = prose(50, 200).split()
    change = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(base))
    first, middle, last = change(), change(20, 40, 60), change(20, 40, 60, 80, 100, 120)
    lone = prose(51, 60)
    rows = [(7, first), (None, middle), (5, last), (None, lone), (None, lone + " more"), (None, prose(52, 30)), (9, None), (None, None)]
    want = brute(rows)
    assert (7, 196, 5) in want and run(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert run(spark.createDataFrame(rows[:1] + rows[2:], "doc_id long, text string")) == brute(rows[:1] + rows[2:])


def test_cells(spark, monkeypatch):
    """Entries of different groups under one shingle meet in one cell, once."""
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 4)
    r = random.Random(5)
    entries = [(t, a, r.choice([1, 1, 1, 2, 3, a]) if t % 3 else r.randrange(4)) for t in range(6) for a in r.sample(range(1000), 5 + 9 * t)]
    df = spark.createDataFrame(entries, "token long, a long, label long")
    stats = df.groupBy("token", "label").count().groupBy("token").agg(F.sum("count").alias("total"), F.max(F.struct(F.col("count").alias("n"), "label")).alias("top"))
    met, sizes = {}, {}
    for x in ngram_join.celled(df, stats).collect():
        sizes.setdefault((x.token, x.kind, x.lo, x.hi), []).append(x)
    for (token, kind, lo, hi), xs in sizes.items():
        free = kind == ngram_join.WHOLE or (kind == ngram_join.BLOCKS and lo == hi)
        for i, x in enumerate(xs):
            for y in xs[:i]:
                if x.label != y.label and (free or x.side != y.side):
                    met[token, min(x.a, y.a), max(x.a, y.a)] = met.get((token, min(x.a, y.a), max(x.a, y.a)), 0) + 1
    want = {(t, min(a, b), max(a, b)) for i, (t, a, g) in enumerate(entries) for s, b, h in entries[:i] if s == t and g != h}
    assert met.keys() == want and set(met.values()) == {1}


def test_a_thousand_long_near_copies():
    r = np.random.default_rng(0)
    base = np.sort(r.choice(1 << 40, 20_000, replace=False).astype(np.uint64))
    sets = [(i, np.delete(base, r.choice(20_000, i % 50, replace=False))) for i in range(1000)]
    tree = Tree(sorted(sets, key=lambda x: x[1].astype(">u8").tobytes()))
    assert sorted(tree.walk(base)) == list(range(1000)) and list(tree.walk(base[:14_000])) == []


def test_long_near_copies_link(spark):
    base = prose(60, 4000).split()
    rows = [(i, " ".join(w if j != 7 * i else f"new{i}" for j, w in enumerate(base))) for i in range(300)]
    assert {c for _, _, c in run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))} == {0}


def test_words():
    morse = "a"
    for _ in range(10):
        morse += morse.translate(str.maketrans("ab", "ba"))
    both = f"{morse} {morse.translate(str.maketrans('ab', 'ba'))}".encode()
    assert len(set(word_hashes(both)[1].tolist())) == 2
    # Texts that are hashed together have the sets that they have alone.
    texts = ["a b c d e f", None, "", "x", prose(1, 300), "a b c d e f", "\n", "w" * 256 + " " + "w" * 255, prose(2, 4), "é" * 9]
    assert all(np.array_equal(a, shingle_hashes(x)) for a, x in zip(set_hashes(texts), texts, strict=True))
    assert len(shingle_hashes("a b c d e f")) == 2 and len(shingle_hashes("É b")) == 1
    assert np.array_equal(shingle_hashes("A  b\x0bc d E"), shingle_hashes("a b c\td e"))
    assert not np.array_equal(shingle_hashes("É b c d e"), shingle_hashes("é b c d e"))
    assert not np.array_equal(shingle_hashes("a b\xa0c d e f"), shingle_hashes("a b c d e f"))  # no gap
    assert not np.array_equal(shingle_hashes("ab c"), shingle_hashes("a bc"))


def test_tree_finds_what_pairs_do():
    r = random.Random(1)
    base = sorted(r.sample(range(10_000), 80))
    sets = []
    for i in range(60):
        s = set(base) - set(r.sample(base, r.randrange(25))) | set(r.sample(range(10_000), r.randrange(15)))
        sets.append((i, np.array(sorted(s), np.uint64)))
    tree = Tree(sorted(sets, key=lambda x: x[1].astype(">u8").tobytes()))
    for _, p in sets:
        want = {j for j, s in sets if 100 * (o := len(np.intersect1d(p, s))) >= 75 * (len(p) + len(s) - o)}
        assert set(tree.walk(p)) == want


def test_bounds():
    for a in range(1, 80):
        for b in range(1, 80):
            o = needed(a, b)
            assert 100 * o >= 75 * (a + b - o) and not 100 * (o - 1) >= 75 * (a + b - o + 1)
        assert prefix_length(a) == a // 4 + 1


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(150)] + [(-5, 5000), (7, 7)]
    got = {x.vertex: x.component for x in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components_in_small_plans(spark, monkeypatch, one_task):
    """In one task and by stars, no plan holds copies of another: the driver's memory goes by how much it plans."""
    tables = []

    def counted(df, name):
        tables.append((name, df._jdf.queryExecution().optimizedPlan().collectLeaves().size()))
        return written(df, name)

    written = stars.written
    monkeypatch.setattr(stars, "written", counted)
    monkeypatch.setattr(stars, "ONE_TASK", one_task, raising=False)
    r = random.Random(6)
    path = list(range(200))
    r.shuffle(path)
    edges = [*zip(path, path[1:]), *((1000 + i, 300) for i in range(50)), (-8, -9), (-9, -7), (-7, -8), (4, 4)]
    r.shuffle(edges)
    got = {x.vertex: x.component for x in components(spark.createDataFrame(edges, "u long, v long").repartition(9)).collect()}
    assert got == {i: 0 for i in path} | {i: 300 for i in (300, *range(1000, 1050))} | {i: -9 for i in (-9, -8, -7)}
    assert max(n for _, n in tables) <= 2
    assert [name for name, _ in tables] == ["forest", "stars"] if one_task else len(tables) > 3


def test_more_rows_than_a_slice(spark):
    rows = [(i, prose(i % 700, 12)) for i in range(1200)]
    got = {d: c for d, _, c in run(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))}
    assert got == {i: i % 700 for i in range(1200)}
