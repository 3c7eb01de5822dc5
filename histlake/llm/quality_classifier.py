"""Quality by co-training of two views (operator 6).

A text-content classifier (boosted trees over measures of the whole text) and a page-metadata classifier (logistic
regression over language, source and length) learn from labelled rows outside the held-out fold. Over rounds, each
scores all unlabelled documents, where they are, and labels those it is surest of for the other. Both are calibrated
on labelled rows that neither learned from, and a logistic combination of the calibrated views, learned from yet other
rows, scores every document.

Defined results: a null text measures like an empty one; null metadata are values of their own; rows are scored one by
one, so repeated rows and ties each keep a row; null labels teach nothing; without labels of both kinds every score is
the share of good labels (1.0 without any, so nothing is rejected). Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from histlake.llm.common import held_out, lean, small, table, written
from histlake.llm.learners import BoostedTrees, Isotonic, Logistic, folds

#: Bound of the fitting sample: labelled rows, in an order of hashes. The unlabelled pool has none.
MOST_LABELLED = 6000
#: Co-training: rounds, documents that a view labels in each, and how sure it must be.
ROUNDS, PER_ROUND, SURE = 4, 150, 0.9
#: Tasks whose surest documents one task compares.
FAN_IN = 64
#: Dropping a good document costs more than keeping a bad one.
CUT = 0.35
#: Common function words of four languages.
COMMON = frozenset("the of and to in a is that for it der die und den von zu das mit ein de la le et les des en un du une que el y los se del".split())
SYMBOLS, MARKS, DIGITS, UPPER = "#*$%&|<>", ".,;:?", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ODD = re.compile(r"[^\w\s]")
LANGS, SOURCES = 8, 32


def text_view(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda signs: sum(map(text.count, signs)) / chars
    return [
        math.log1p(len(words)), chars / n, len(counts) / n, max(counts.values(), default=0) / n, pairs / n,
        share(UPPER), share(DIGITS), share(SYMBOLS), share(MARKS), text.count("!") / chars, text.count("|") / n,
        sum(c for w, c in counts.items() if w.lower() in COMMON) / n,
        sum(c for w, c in counts.items() if len(ODD.findall(w)) > 1) / n,
        sum(c for w, c in counts.items() if len(w) > 20) / n, len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)),
    ]


def metadata_view(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    slot = lambda x, n: 0 if x is None else 1 + zlib.crc32(x.encode()) % (n - 1)
    out = [0.0] * (LANGS + SOURCES)
    out[slot(lang, LANGS)] = out[LANGS + slot(source, SOURCES)] = 1.0
    known = n_chars is not None and not math.isnan(n_chars)
    size = math.log1p(max(0.0, n_chars)) if known else 0.0
    return [*out, float(known), size, size * size]


def views(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    plain = lambda c: [x if isinstance(x, str) else None for x in pdf[c]]
    meta = [metadata_view(*x) for x in zip(plain("lang"), plain("source"), pdf["n_chars"].astype("float64"), strict=True)]
    return np.array([text_view(x) for x in plain("text")]), np.array(meta)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.005, 0.995)
    return np.log(p / (1 - p))


#: Rows that a view labels: ids, both views, and labels.
Picked = tuple[list[int], tuple[np.ndarray, np.ndarray], np.ndarray]
#: Given both models, how many good and bad rows to pick, and ids that are taken: the surest of each model.
Pick = Callable[[list, tuple[int, int], frozenset], list[Picked]]


def surest(p: np.ndarray, ids: np.ndarray, wanted: tuple[int, int]) -> list[tuple[np.ndarray, float]]:
    """Places of the surest good and bad rows; ids decide ties."""
    out = []
    for sign, n, label in ((-1, wanted[0], 1.0), (1, wanted[1], 0.0)):
        order = np.lexsort((ids, sign * p))[:n]
        out.append((order[np.abs(label - p[order]) <= 1 - SURE + 1e-12], label))
    return out


def from_arrays(text: np.ndarray, meta: np.ndarray) -> Pick:
    """Picks from a pool in memory; ids are places."""

    def pick(models: list, wanted: tuple[int, int], taken: frozenset) -> list[Picked]:
        left, out = np.array([i for i in range(len(text)) if i not in taken], int), []
        for model, view in zip(models, (text, meta), strict=True):
            found = surest(model.predict(view[left]), left, wanted) if len(left) else []
            at = np.concatenate([np.empty(0, int), *(left[i] for i, _ in found)])
            labels = np.concatenate([np.empty(0), *(np.full(len(i), y) for i, y in found)])
            out.append((at.tolist(), (text[at], meta[at]), labels))
        return out

    return pick


class CoTrained:
    def __init__(self, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pick: Pick):
        self.share, self.models = float(y.mean()) if len(y) else 1.0, None
        part = folds(len(y), 6) if len(y) else np.zeros(0, int)
        apart, last, own = part == 0, part == 1, part > 1
        if min((y[x] == k).sum() for x in (apart, last, own) for k in (0, 1)) < 2:
            return
        make = (BoostedTrees, Logistic)
        xs, ys = [v[own] for v in labelled], [y[own], y[own]]
        taken: frozenset = frozenset()
        good = round(PER_ROUND * self.share)
        for _ in range(ROUNDS):
            models = [m().fit(x, t) for m, x, t in zip(make, xs, ys, strict=True)]
            for teacher, (ids, views_, t) in enumerate(pick(models, (good, PER_ROUND - good), taken)):
                # What both are sure of, the first to teach labels.
                new = np.array([i not in taken for i in ids], bool)
                if new.any():
                    other = 1 - teacher
                    xs[other], ys[other] = np.r_[xs[other], views_[other][new]], np.r_[ys[other], t[new]]
                    taken |= frozenset(ids)
        self.models = [m().fit(x, t) for m, x, t in zip(make, xs, ys, strict=True)]
        self.calibrations = [Isotonic().fit(m.raw(v[apart]), y[apart]) for m, v in zip(self.models, labelled, strict=True)]
        own = [c.predict(m.raw(v[last])) for c, m, v in zip(self.calibrations, self.models, labelled, strict=True)]
        self.combined = Logistic().fit(np.stack([logit(p) for p in own], axis=1), y[last])

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the text view, the metadata view, and both."""
        if self.models is None:
            return (np.full(len(text), self.share),) * 3
        own = [c.predict(m.raw(v)) for c, m, v in zip(self.calibrations, self.models, (text, meta), strict=True)]
        return (*own, self.combined.predict(np.stack([logit(p) for p in own], axis=1)))


N_TEXT, N_META = len(text_view("")), len(metadata_view(None, None, None))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, y and x: both views of each row as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.concatenate([v.reshape(len(pdf), n) for v, n in zip(views(pdf), (N_TEXT, N_META), strict=True)], axis=1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [r.tobytes() for r in x], "y": pdf["y"]})

    return docs.select("doc_id", "text", "lang", "source", "n_chars", "y").mapInPandas(lean(run), "doc_id long, x binary, y int")


def unpacked(x) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(bytes, x)), np.float64).reshape(-1, N_TEXT + N_META)
    return both[:, :N_TEXT], both[:, N_TEXT:]


def from_table(pool: DataFrame) -> Pick:
    """Picks from all rows of a written table of doc_id and x. Each task keeps its surest, which are compared by ever
    fewer tasks; the driver gets the surest of all."""
    schema = "teacher int, label double, p double, doc_id long, x binary"

    def pick(models: list, wanted: tuple[int, int], taken: frozenset) -> list[Picked]:
        def rows_of(teacher: int, p: np.ndarray, ids: np.ndarray, x: np.ndarray) -> list[tuple]:
            return [(teacher, y, p[i], ids[i], x[i]) for at, y in surest(p, ids, wanted) for i in at]

        def best(held: dict[int, list[tuple]]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame([r for rows in held.values() for r in rows], columns=["teacher", "label", "p", "doc_id", "x"]).astype({"teacher": "int32", "label": "float64", "p": "float64", "doc_id": "int64"})

        def again(teacher: int, rows: list[tuple]) -> list[tuple]:
            rows = list({r[3]: r for r in rows}.values())  # a repeated id is one document
            p, ids, x = (np.array([r[i] for r in rows], dtype=t) for i, t in ((2, float), (3, np.int64), (4, object)))
            return rows_of(teacher, p, ids, x)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[tuple]] = {0: [], 1: []}
            for pdf in batches:
                pdf = pdf[~pdf["doc_id"].isin(taken)]
                if not len(pdf):
                    continue
                ids, x = pdf["doc_id"].to_numpy(np.int64), pdf["x"].to_numpy()
                for teacher, (model, view) in enumerate(zip(models, unpacked(x), strict=True)):
                    held[teacher] = again(teacher, held[teacher] + rows_of(teacher, model.predict(view), ids, x))
            yield from best(held)

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[tuple]] = {0: [], 1: []}
            for pdf in batches:
                for teacher in held:
                    held[teacher] = again(teacher, held[teacher] + list(pdf[pdf["teacher"] == teacher].itertuples(index=False, name=None)))
            yield from best(held)

        out = pool.select("doc_id", "x").mapInPandas(lean(score), schema)
        parts = pool.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // FAN_IN)
            out = out.repartition(parts).mapInPandas(merge, schema)
        got = out.orderBy("teacher", F.desc("label"), "p", "doc_id").collect()  # PER_ROUND rows of each
        picked = []
        for teacher in (0, 1):
            own = [r for r in got if r["teacher"] == teacher]
            picked.append(([r["doc_id"] for r in own], unpacked([r["x"] for r in own]), np.array([r["label"] for r in own])))
        return picked

    return pick


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    own = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y")).filter(~held_out(F.col("doc_id")))
    known = written(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED), "quality-sample")
    got = measured(docs.join(F.broadcast(known), "doc_id")).toPandas()
    y = got["y"].to_numpy().astype(float)
    text, meta = unpacked(got["x"])
    if len(got):  # the fit doesn't depend on the order of rows
        order = np.lexsort((*meta.T, *text.T, y))
        y, text, meta = y[order], text[order], meta[order]
    others = docs.filter("doc_id is not null").join(small(written(labels.select("doc_id").distinct(), "quality-labels")), "doc_id", "left_anti")
    pool = written(measured(others.withColumn("y", F.lit(-1))), "quality-pool")
    return CoTrained((text, meta), y, from_table(pool))


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """docs with text_score, metadata_score, score and predicted (1: good), in one pass over whole texts. Columns of
    these names in docs are replaced."""
    new = [T.StructField(c, T.DoubleType()) for c in ("text_score", "metadata_score", "score")] + [T.StructField("predicted", T.IntegerType())]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                pdf = pd.DataFrame({c: part[c].to_pandas() for c in ("text", "lang", "source", "n_chars")})
                scores = shared.value.score(*views(pdf))
                cols = {f.name: part[f.name] for f in kept} | {f.name: pa.array(s, pa.float64()) for f, s in zip(new, scores, strict=False)}
                cols["predicted"] = pa.array((scores[2] >= CUT).astype("int32"), pa.int32())
                yield pa.RecordBatch.from_pydict(cols)

    return docs.mapInArrow(lean(run), T.StructType([*kept, *new]))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "metadata_score", "score", "predicted")
