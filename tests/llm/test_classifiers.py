import numpy as np
import pytest
from pyspark.sql import functions as F

from histlake.llm import quality_classifier, toxicity
from histlake.llm.common import held_out, table
from histlake.llm.learners import BoostedTrees, Isotonic, Logistic, folds

SF = "/root/testdata/sf0.01"


def data(n=600, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    return x, ((x[:, 0] * x[:, 1] > 0) ^ (r.random(n) < 0.03)).astype(float)


def test_trees_learn_an_interaction():
    x, y = data()
    p = BoostedTrees().fit(x[:400], y[:400]).predict(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.85
    assert np.array_equal(BoostedTrees().fit(x, y).raw(x), BoostedTrees().fit(x, y).raw(x))
    assert np.isfinite(BoostedTrees().fit(np.zeros((20, 2)), np.r_[np.ones(10), np.zeros(10)]).predict(np.ones((3, 2)))).all()


def test_logistic():
    x = np.random.default_rng(1).normal(size=(500, 3))
    y = (x @ [2, -1, 0] > 0.3).astype(float)
    assert ((Logistic().fit(x, y).predict(x) > 0.5) == y).mean() > 0.95


def test_isotonic_is_the_least_squares_monotone_fit():
    r = np.random.default_rng(2)
    s, y = r.integers(0, 8, 60).astype(float), r.integers(0, 2, 60).astype(float)
    got = Isotonic().fit(s, y).predict(s)
    u = np.unique(s)
    m, w = np.array([y[s == v].mean() for v in u]), np.array([(s == v).sum() for v in u])
    # The minimax form of the same fit.
    want = [max(min(np.average(m[a : b + 1], weights=w[a : b + 1]) for b in range(i, len(u))) for a in range(i + 1)) for i in range(len(u))]
    assert np.allclose(got, np.array(want)[np.searchsorted(u, s)])


def test_folds():
    assert sorted(np.bincount(folds(10, 4))) == [2, 2, 3, 3]


def labelled(df, spark, column):
    return df.join(table(spark, SF, "labels").select("doc_id", column), "doc_id").toPandas()


def test_toxicity_held_out(spark):
    out = toxicity.op1_toxicity(spark, SF)
    assert out.count() == 1000 and out.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").isEmpty()
    got = labelled(out, spark, "toxic")
    far = got[got["held_out"]]
    assert (far["predicted"] == far["toxic"]).mean() > 0.93 and far[far["toxic"] == 0]["predicted"].mean() < 0.02
    assert far[far["toxic"] == 1]["predicted"].mean() > 0.6


def test_calibration_sees_no_term_of_its_own_rows(spark):
    """Terms that stand in one fold alone are in the lexicon of all rows, and in none of those without the fold."""
    own = lambda f: f"fold{chr(97 + f) * 3}bad"
    rows = [("plain words of some number", 0, i % toxicity.FOLDS) for i in range(400)] + [(f"sharedbad {own(i % toxicity.FOLDS)} plain", 1, i % toxicity.FOLDS) for i in range(400)]
    whole, *left = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    assert whole.weight("sharedbad") > 0 and len(left) == toxicity.FOLDS
    for f, lexicon in enumerate(left):
        assert own(f) not in lexicon.words and lexicon.weight("sharedbad") > 0


def test_capitals_of_any_script():
    capitals = dict(zip(toxicity.NAMES, toxicity.Lexicon({}).features("ÄÉabЖ"), strict=True))["capitals"]
    assert capitals == 3 / 5


def test_toxicity_features():
    lex = toxicity.Lexicon({"idiot": 3.0, "lowei*": 2.0})
    f = lambda t: dict(zip(toxicity.NAMES, lex.features(t), strict=True))
    assert f("You IDIOT, loweische")["hits"] == 2 and f("You idiot")["near"] == 1 and f("idiot")["near"] == 0
    assert f("id10t you")["undone"] == 1 and f("i-d-i-o-t")["undone"] == 1 and f("plain words")["undone"] == 0
    assert lex.features(None) == lex.features("") == [0.0] * len(toxicity.NAMES) and all(np.isfinite(lex.features("🎉 \x00 123")))


def tiny(spark):
    rows = [(i, ("you stupid loser " if i % 2 else "kind gentle words ") * 5) for i in range(120)] + [(500, None), (501, ""), (None, "stupid"), (502, "stupid " * 20_000), (3, "stupid")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 9.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(120)] + [(500, None, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_cases(spark):
    docs, labels = tiny(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    by = {r.doc_id: r.score for r in got if r.doc_id != 3}
    assert len(got) == docs.count() and by[1] > 0.7 > 0.3 > by[2] and by[502] > 0.5 and {500, 501, None} <= by.keys()
    for l in (labels.filter("false"), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, l)).collect()} == {0.0}
    assert toxicity.score(docs.filter("false"), toxicity.fit(docs, labels)).count() == 0


def test_held_out_labels_teach_nothing(spark):
    docs, labels = tiny(spark)
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held_out(F.col("doc_id")), 0).otherwise(F.col("quality")))
    for score, fit in ((toxicity.score, toxicity.fit), (quality_classifier.score, quality_classifier.fit)):
        a, b = (sorted((str(r.doc_id), r.score) for r in score(docs, fit(docs, l)).collect()) for l in (labels, flipped))
        assert a == b


def test_quality_held_out(spark):
    out = quality_classifier.op6_quality_classifier(spark, SF)
    assert out.count() == 1000 and out.filter("score is null or score < 0 or score > 1").isEmpty()
    got = labelled(out, spark, "quality")
    far = got[got["held_out"]]
    assert (far["predicted"] == far["quality"]).mean() > 0.95 and far[far["quality"] == 1]["predicted"].mean() > 0.97


def test_quality_cases(spark):
    docs, labels = tiny(spark)
    out = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "text_score", "metadata_score", "score", "predicted"]
    got = {r.doc_id: r.score for r in out.collect() if r.doc_id != 3}
    assert got[2] > 0.5 > got[1] and out.count() == docs.count()
    nulls = docs.select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))])
    assert quality_classifier.score(nulls, quality_classifier.fit(nulls, labels)).filter("score is null").isEmpty()
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels.filter("false"))).collect()} == {1.0}
    assert quality_classifier.score(docs.filter("false"), quality_classifier.fit(docs.filter("false"), labels)).count() == 0


def test_co_training_uses_the_pool():
    r = np.random.default_rng(0)
    n = 3000
    y = (r.random(n) < 0.6).astype(float)
    views = tuple(r.normal(size=(n, 3)) + 1.2 * y[:, None] for _ in range(2))
    few, pool, far = slice(0, 90), slice(90, 2000), slice(2000, n)
    model = quality_classifier.CoTrained(tuple(v[few] for v in views), y[few], quality_classifier.from_arrays(*(v[pool] for v in views)))
    p = model.score(*(v[far] for v in views))[2]
    assert ((p > 0.5) == y[far]).mean() > 0.85


@pytest.mark.parametrize("n", [0, 3])
def test_too_few_labels(n):
    e = (np.zeros((n, 2)), np.zeros((n, 2)))
    assert quality_classifier.CoTrained(e, np.ones(n), quality_classifier.from_arrays(np.zeros((0, 2)), np.zeros((0, 2)))).score(np.zeros((2, 2)), np.zeros((2, 2)))[2].tolist() == [1.0, 1.0]


def test_the_whole_pool_is_searched(spark, monkeypatch):
    """The surest rows by tasks that compare ever fewer are the surest of all, as an array finds them."""
    monkeypatch.setattr(quality_classifier, "FAN_IN", 2)
    r = np.random.default_rng(3)
    text, meta = r.normal(size=(500, quality_classifier.N_TEXT)), r.normal(size=(500, quality_classifier.N_META))
    y = (text[:, 0] + meta[:, 0] > 0).astype(float)
    models = [BoostedTrees().fit(text[:200], y[:200]), Logistic().fit(meta[:200], y[:200])]
    rows = [(i, np.r_[text[i], meta[i]].tobytes()) for i in range(500)]
    pool = spark.createDataFrame(rows + rows[:50], "doc_id long, x binary").repartition(9)
    taken = frozenset(range(0, 500, 7))
    for wanted in ((12, 5), (0, 3)):
        got, want = (pick(models, wanted, taken) for pick in (quality_classifier.from_table(pool), quality_classifier.from_arrays(text, meta)))
        for (a, (ta, ma), la), (b, (tb, mb), lb) in zip(got, want, strict=True):
            assert sorted(zip(a, la)) == sorted(zip(b, lb)) and np.array_equal(ta[np.argsort(a)], tb[np.argsort(b)]) and np.array_equal(ma[np.argsort(a)], mb[np.argsort(b)]) and a
