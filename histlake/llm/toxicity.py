"""Toxicity by gradient-boosted trees over dense features (operator 1).

Features of a whole text: densities of a learned lexicon (whole words, and beginnings of words for languages that
inflect), its hits in all and at their densest, how near second-person words stand to hits, shares of capitals and
punctuation, and how much is obfuscated (signs or digits inside words; words that reach the lexicon only once these
are undone). Lexicon, trees and isotonic calibration are learned from labelled rows outside the held-out fold; the
scores that calibration is learned from are those of lexicons and trees that have not seen their rows.

Defined results: null and empty texts have zero features and get a score like any other; rows are scored one by one,
so repeated rows and ties each keep a row; labels of null, or of ids without a document, teach nothing; without
labels of both kinds every score is the share of toxic labels (0.0 without any). Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from histlake.llm.common import held_out, table, written
from histlake.llm.learners import BoostedTrees, Isotonic

#: Bounds of the fitting sample: rows of each label, in an order of hashes. What is learned is bounded by it.
MOST_TOXIC, MOST_CLEAN = 3000, 5000
#: Parts of the sample, each scored by a lexicon and trees of the others.
FOLDS = 10
STEMS, LEAST_DF, LEAST_RATIO = (4, 5), 4, 20.0
#: Least log-likelihood ratio of a term, against standing in toxic texts by chance as often as it does.
LEAST_EVIDENCE = 10.0
#: Words of a toxic text that may each bring a term into the lexicon.
DEPTH = 2
CUT = 0.7
#: Second-person words.
YOU = frozenset("you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú usted ustedes vosotros tuyo".split())
#: Signs that stand for letters.
LEET = str.maketrans("0134578@$!|€", "oieastbasiie")
WORD = re.compile(r"[^\W_](?:[\w@$!|€*.\-']*[^\W_])?")
PLAIN = re.compile(r"[^\W\d_]+")
NEAR = 8


def forms(word: str) -> list[str]:
    """A word, and its beginnings with a mark."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def terms(text: str) -> set[str]:
    """Distinct lower-case words, and their beginnings."""
    return {t for w in set(PLAIN.findall(text.lower())) for t in forms(w)}


class Lexicon:
    def __init__(self, weights: dict[str, float]):
        self.words = {t: w for t, w in weights.items() if t[-1] != "*"}
        self.stems = {t[:-1]: w for t, w in weights.items() if t[-1] == "*"}

    def weight(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k), default=0.0)

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        if not text:
            return [0.0] * len(NAMES)
        low = text.lower()
        words = PLAIN.findall(low)
        counts, n = Counter(words), max(1, len(words))
        bad = {w: s for w in counts if (s := self.weight(w))}
        hits = sum(counts[w] for w in bad)
        exact = sum(counts[w] for w in bad if w in self.words)
        near, densest = 0, 0
        if bad:
            at = [i for i, w in enumerate(words) if w in bad]
            you = np.array([i for i, w in enumerate(words) if w in YOU])
            if len(you):
                k = np.searchsorted(you, at)
                gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - at), np.abs(you[np.maximum(k - 1, 0)] - at))
                near = int((gap <= NEAR).sum())
            a = np.array(at)
            densest = int((np.searchsorted(a, a + 50) - np.arange(len(a))).max())
        odd = [w for w in WORD.findall(low) if not w.isalpha()] if not low.isalpha() else []
        undone = sum(self.weight(re.sub(r"[^\w]|_", "", w.translate(LEET))) > 0 and not any(self.weight(p) for p in PLAIN.findall(w)) for w in odd)
        upper = sum(n for c, n in Counter(text).items() if c.isupper())
        return [
            hits / n, exact / n, sum(bad[w] * counts[w] for w in bad) / n, float(hits), float(len(bad)), max(bad.values(), default=0.0),
            float(densest), near / n, float(near), upper / len(text), sum(map(text.count, ".,;:?")) / len(text), text.count("!") / len(text),
            len(odd) / n, float(undone), undone / n, float(np.log1p(len(words))),
        ]


NAMES = ["hit_rate", "word_rate", "weight_rate", "hits", "distinct", "strongest", "densest", "near_rate", "near", "capitals", "marks", "shouts", "odd_rate", "undone", "undone_rate", "log_words"]


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and fold of a bounded sample of labelled rows outside the held-out fold."""
    own = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = F.xxhash64("doc_id", F.lit("sample"))
    parts = [own.filter(F.col("toxic") == k).orderBy(by, "doc_id").limit(n) for k, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    picked = parts[0].unionByName(parts[1])
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic", fold.alias("fold"))


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """Terms in far more toxic than clean texts, weighted by the log of the ratio: of all rows, and of all but each
    fold's. Counts are made once, by fold."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text, toxic, fold in zip(pdf["text"], pdf["toxic"], pdf["fold"], strict=True):
                seen.update((t, fold, toxic) for t in [*terms(text or ""), ""])
        yield pd.DataFrame([(t, f, y, n) for (t, f, y), n in seen.items()], columns=["term", "fold", "toxic", "n"])

    of = lambda y, f: F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"{'toxic' if y else 'clean'}{f}")
    counted = rows.mapInPandas(count, "term string, fold int, toxic int, n long").groupBy("term").agg(*[of(y, f) for y in (0, 1) for f in range(FOLDS)])
    found = written(counted, "terms")
    totals = found.filter("term = ''").first()
    ranked = [best_terms(found, totals, left) for left in (None, *range(FOLDS))]
    known = frozenset(t for x in ranked for t, _ in x)

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [set(PLAIN.findall((t or "").lower())) for t in pdf["text"]]
            yield pd.DataFrame({"words": [sorted(w for w in x if any(t in known for t in forms(w))) for x in words], "fold": pdf["fold"]})

    # Of a bounded sample, and only what its lexicons may hold.
    texts = [(r["words"], r["fold"]) for r in rows.filter("toxic = 1").select("text", "fold").mapInPandas(matched, "words array<string>, fold int").collect()]
    return [Lexicon(dict(explaining(x, [w for w, f in texts if f != left]))) for x, left in zip(ranked, (None, *range(FOLDS)), strict=True)]


def best_terms(found: DataFrame, totals, left: int | None) -> list[tuple[str, float]]:
    """Terms with evidence and their weights, best first, without the rows of a fold."""
    folds = [f for f in range(FOLDS) if f != left]
    toxic, clean = (sum(totals[f"{y}{f}"] for f in folds) if totals else 0 for y in ("toxic", "clean"))
    if not toxic or not clean:
        return []
    own = found.select("term", *[reduce(add, (F.col(f"{y}{f}") for f in folds)).alias(y) for y in ("toxic", "clean")])
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    best = own.filter((F.col("term") != "") & (F.col("toxic") >= LEAST_DF)).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    share, n = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
    bits = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    best = best.withColumn("evidence", bits(F.col("toxic"), share) + bits(F.col("clean"), 1 - share)).filter(F.col("evidence") >= LEAST_EVIDENCE)
    # As many as a bounded sample can have.
    return [(r["term"], r["w"]) for r in best.orderBy(F.desc(F.round("evidence", 6)), F.desc(F.length("term")), "term").select("term", F.log("ratio").alias("w")).collect()]


def explaining(ranked: list[tuple[str, float]], texts: list[list[str]]) -> Iterator[tuple[str, float]]:
    """Of terms, best first, those that still explain some texts: ones with fewer than DEPTH words of the terms before.
    Words that copies of a toxic text share by chance explain nothing that its toxic words haven't."""
    where: dict[str, list[tuple[int, str]]] = {}
    for i, words in enumerate(texts):
        for w in words:
            for t in forms(w):
                where.setdefault(t, []).append((i, w))
    depth, used = Counter(), set()
    for term, weight in ranked:
        new = [x for x in where.get(term, ()) if x not in used]
        if len({i for i, _ in new if depth[i] < DEPTH}) >= LEAST_DF:
            used.update(new)
            depth.update(i for i, _ in new)
            yield term, weight


class Scorer:
    """A fitted model; score() takes texts."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, unseen: np.ndarray, fold: np.ndarray):
        """x are features by the lexicon, unseen those by lexicons without the row's fold."""
        self.lexicon, self.trees, self.share = lexicon, None, float(y.mean()) if len(y) else 0.0
        if 0 < y.sum() < len(y):
            self.trees = BoostedTrees().fit(x, y)
            raw = np.zeros(len(y))
            for f in np.unique(fold):
                # Trees of the other folds, whose own features are by the lexicon of those folds.
                out = fold == f
                raw[out] = BoostedTrees().fit(unseen[f][~out], y[~out]).raw(unseen[f][out]) if (~out).any() else self.trees.base
            self.calibration = Isotonic().fit(raw, y)

    def score(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(-1, len(NAMES))
        return self.calibration.predict(self.trees.raw(x))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    rows = written(sample(docs, labels), "toxicity-sample")
    lexicons = learn_lexicons(rows)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [[v for l in lexicons for v in l.features(t)] for t in pdf["text"]], "y": pdf["toxic"].astype("float64"), "fold": pdf["fold"]})

    got = rows.mapInPandas(measure, "x array<double>, y double, fold int").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(lexicons) * len(NAMES))
    order = np.lexsort((*x.T, got["y"], got["fold"]))  # the fit doesn't depend on the order of rows
    each = x[order].reshape(len(x), len(lexicons), len(NAMES)).swapaxes(0, 1)
    return Scorer(lexicons[0], each[0], got["y"].to_numpy()[order], each[1:], got["fold"].to_numpy()[order])


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of each row, in one pass over whole texts."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.value.score(pdf["text"])})

    nobody = F.lit(-(1 << 63))
    out = docs.select(F.coalesce("doc_id", nobody).alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return out.withColumn("doc_id", F.nullif("doc_id", nobody))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
