"""Five interchangeable rankers: (corpus(doc_id, text), queries(query_id, nl), k) -> (query_id, doc_id, score, rank).

Queries are a stated set: a block of them at a time goes out with the code and meets all texts in one pass, in which
each task keeps its k best of each query. So no terms and no pairs are shuffled, only k rows of each query and task.
Ranks are by score, then by doc_id; what does not match at all is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from histlake.functions.texts import partial_ratios, slices, tokens_of
from histlake.functions.vectors import embedder
from histlake.operators.nearest import nearest_each
from histlake.scratch import written

Ranker = Callable[[DataFrame, DataFrame, int], DataFrame]
Tokenize = Callable[[str], list[str]]
#: Takes a block of queries to a function that scores texts: a row for each query, NaN where nothing matches.
Prepare = Callable[[list[str]], Callable[[list[str]], np.ndarray]]
#: Fixed values of BM25, as the full-text index has them; scores of terms in over half of all texts are floored.
K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Queries that go out together, and texts that are scored together.
BLOCK, TEXTS = 500, 500
#: Scores that a task of fuzzy remembers.
REMEMBERED = 2_000_000


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, and of each list if there are some. Spark keeps k of each in each task before the shuffle."""
    of = [c for c in ("list",) if c in scores.columns]
    w = W.partitionBy("query_id", *of).orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank", *of)


def spread(corpus: DataFrame) -> DataFrame:
    """Fewer files than cores are dealt out, as one file's row group is one task otherwise."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return corpus.repartition(cores) if 0 < len(corpus.inputFiles()) < cores else corpus


def blocks(queries: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """A stated query set, BLOCK at a time."""
    block = []
    for row in queries.select("query_id", "nl").toLocalIterator():
        block.append((row[0], row[1] or ""))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def in_blocks(corpus: DataFrame, queries: DataFrame, k: int, prepare: Prepare, dealt: bool = False, lists: int = 1) -> DataFrame:
    """Each query's k best texts. dealt: the corpus is in as many tasks as it should be. lists: how many scores of each
    query a text gets, those of all queries after one another; which of them it is comes as a column then."""

    def one(block: list) -> DataFrame:
        ids, asked = np.array([i for i, _ in block] * lists, np.int64), [q for _, q in block]
        which = np.repeat(np.arange(lists), len(asked))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score = prepare(asked)
            best, docs = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
            for pdf in (x.iloc[part].dropna() for x in batches for part in slices(x["text"], TEXTS)):
                new = score(pdf["text"].tolist()).reshape(len(ids), len(pdf))
                docs = np.c_[docs, np.broadcast_to(pdf["doc_id"].to_numpy(np.int64), new.shape)]
                best = np.c_[best, new]
                top = np.lexsort((docs, -best), axis=1)[:, :k]
                best, docs = np.take_along_axis(best, top, 1), np.take_along_axis(docs, top, 1)
            found = pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "doc_id": docs.ravel(), "score": best.ravel()})
            if lists > 1:
                found["list"] = np.repeat(which, best.shape[1])
            yield found.dropna()

        return corpus.select("doc_id", "text").mapInPandas(run, "query_id long, doc_id long, score double" + ", list long" * (lists > 1))

    corpus, out = corpus if dealt else spread(corpus), None
    for block in blocks(queries):
        out = one(block) if out is None else out.union(one(block))
    return ranked(one([]) if out is None else out, k)


def matches(scores: np.ndarray) -> np.ndarray:
    """Scores of 0 are no match."""
    return np.where(scores > 0, scores, np.nan)


class Terms:
    """Distinct terms of a block of queries, and how often each query has each."""

    def __init__(self, asked: list[str], split: Tokenize):
        self.split, counts = split, [Counter(split(q)) for q in asked]
        self.place = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        self.counts = np.zeros((len(asked), len(self.place)))
        for i, c in enumerate(counts):
            for t, n in c.items():
                self.counts[i, self.place[t]] = n

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How often each text has each term, a column for each text, and how many terms of any kind it has."""
        tf, size = np.zeros((len(self.place), len(texts))), np.zeros(len(texts))
        for j, text in enumerate(texts):
            all_ = self.split(text)
            size[j] = len(all_)
            for t, n in Counter(filter(self.place.__contains__, all_)).items():
                tf[self.place[t], j] = n
        return tf, size


def token_overlap(corpus: DataFrame, queries: DataFrame, k: int, tokenize: Tokenize = tokens_of) -> DataFrame:
    """How many distinct terms both have."""

    def prepare(asked: list[str]):
        terms = Terms(asked, tokenize)
        return lambda texts: matches((terms.counts > 0).astype(float) @ (terms.of(texts)[0] > 0))

    return in_blocks(corpus, queries, k, prepare)


def term_statistics(corpus: DataFrame, wanted: frozenset[str], tokenize: Tokenize) -> tuple[int, float, dict[str, int]]:
    """Number of texts, their average length, and how many have each of the wanted terms. Each task counts for itself,
    and the wanted terms are those of a stated query set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, n, size, known = Counter(), 0, 0, 0
        for pdf in batches:
            n += len(pdf)
            for text in pdf["text"].dropna():
                all_ = tokenize(text)
                size, known = size + len(all_), known + 1
                have.update(wanted.intersection(all_))
        # The first three have names that no term has.
        yield pd.DataFrame([(" n", n), (" size", size), (" known", known), *have.items()], columns=["term", "n"])

    got = spread(corpus.select("text")).mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = Counter({r["term"]: r["n"] for r in got})
    n, size, known = (sums.pop(x, 0) for x in (" n", " size", " known"))
    return n, size / known if known else 0.0, dict(sums)


def weighted(corpus: DataFrame, queries: DataFrame, tokenize: Tokenize) -> Callable[[Terms], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """BM25 of the query's terms OR-ed; a term that the query repeats counts each time. Scores are rounded, so that ties
    don't hang on the order of sums."""
    wanted = frozenset(t for block in blocks(queries) for _, q in block for t in tokenize(q))
    n, mean, df = term_statistics(corpus, wanted, tokenize)
    idf = {t: max(np.log((n - m + 0.5) / (m + 0.5)), 0.0) or FLOOR for t, m in df.items()}

    def prepare(terms: Terms):
        weights = terms.counts * np.array([idf.get(t, 0.0) for t in terms.place])

        def score(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
            return np.round(matches(weights @ (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (mean or 1.0))))), 9)

        return score

    return prepare


def bm25(corpus: DataFrame, queries: DataFrame, k: int, tokenize: Tokenize = tokens_of) -> DataFrame:
    """BM25 as in weighted."""
    weigh = weighted(corpus, queries, tokenize)

    def prepare(asked: list[str]):
        score = weigh(terms := Terms(asked, tokenize))
        return lambda texts: score(*terms.of(texts))

    return in_blocks(corpus, queries, k, prepare)


def bm25_and_overlap(corpus: DataFrame, queries: DataFrame, k: int, tokenize: Tokenize = tokens_of) -> list[DataFrame]:
    """Both rankings from one pass that cuts each text once, after that of the statistics. What is left of it, k rows of
    each query, is written, as two plans read it."""
    weigh = weighted(corpus, queries, tokenize)

    def prepare(asked: list[str]):
        score = weigh(terms := Terms(asked, tokenize))

        def both(texts: list[str]) -> np.ndarray:
            tf, size = terms.of(texts)
            return np.concatenate([score(tf, size), matches((terms.counts > 0).astype(float) @ (tf > 0))])

        return both

    out = written(in_blocks(corpus, queries, k, prepare, lists=2), "rankings")
    return [out.filter(F.col("list") == i).select("query_id", "doc_id", "score", "rank") for i in range(2)]


def automaton(words):
    """Finds all of some distinct words in a text in one pass, as places in their list."""
    from ahocorasick import Automaton

    out = Automaton()
    for i, w in enumerate(words):
        out.add_word(w, i)
    out.make_automaton()
    return out


def naive(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """How many of the query's words (repeated ones too) the text contains, in lower case."""

    def prepare(asked: list[str]):
        terms = Terms(asked, lambda q: q.lower().split())
        if not terms.place:
            return lambda texts: np.full((len(asked), len(texts)), np.nan)
        seek = automaton(terms.place)

        def score(texts: list[str]) -> np.ndarray:
            inside = np.zeros((len(terms.place), len(texts)))
            for j, text in enumerate(texts):
                inside[list({i for _, i in seek.iter(text.lower())}), j] = 1
            return matches(terms.counts @ inside)

        return score

    return in_blocks(corpus, queries, k, prepare)


def holding(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, text) of each text that contains a query's text literally, found in one pass for a block of
    queries. An empty query is in every text."""

    def one(block: list) -> DataFrame:
        where: dict[str, list[int]] = {}
        for i, q in block:
            where.setdefault(q, []).append(i)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [q for q in where if q]
            seek = automaton(names) if names else None
            for pdf in batches:
                rows = []
                for doc_id, text in pdf.dropna().itertuples(index=False):
                    held = {names[i] for _, i in seek.iter(text)} if seek else set()
                    rows += [(i, doc_id, text) for q in sorted(held | ({""} & where.keys())) for i in where[q]]
                yield pd.DataFrame(rows, columns=["query_id", "doc_id", "text"])

        return corpus.select("doc_id", "text").mapInPandas(run, "query_id long, doc_id long, text string")

    corpus, out = spread(corpus), None
    for block in blocks(queries):
        out = one(block) if out is None else out.union(one(block))
    return one([]) if out is None else out


def fuzzy(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best partial similarity, 0 to 100, with case. In texts shorter than all queries, signs that no query has count by
    their number only, so texts that are the same without them score the same: k of them stay, and meet in one task,
    which compares them once while it remembers their scores."""
    signs, least = set(), None
    for block in blocks(queries):
        signs.update(*(q for _, q in block))
        least = min(len(q) for _, q in block) if least is None else min(least, *(len(q) for _, q in block))

    def key(text: str) -> str:
        return f"{len(text)} {''.join(filter(signs.__contains__, text)) if len(text) < (least or 0) else text}"

    @F.pandas_udf(T.StringType())
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(key)

    def prepare(asked: list[str]):
        known: dict[str, np.ndarray] = {}

        def score(texts: list[str]) -> np.ndarray:
            have = [key(t) for t in texts]
            new = {x: t for x, t in zip(have, texts, strict=True) if x not in known}
            columns = np.array([partial_ratios(q, list(new.values())) for q in asked]).reshape(len(asked), len(new))
            known.update(zip(new, columns.T.copy(), strict=True))
            out = np.array([known[x] for x in have]).reshape(len(texts), len(asked)).T
            while len(known) * len(asked) > REMEMBERED:
                del known[next(iter(known))]
            return matches(out)

        return score

    w = W.partitionBy("key").orderBy("doc_id")
    few = spread(corpus.select("doc_id", "text").dropna()).withColumn("key", keys("text")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    # A stated number of tasks, as texts of a few bytes each would be taken for work of one task.
    tasks = 2 * corpus.sparkSession.sparkContext.defaultParallelism
    return in_blocks(few.repartition(tasks, "key"), queries, k, prepare, dealt=True)


def semantic(corpus: DataFrame, queries: DataFrame, k: int, embed=None, digits: int = 5) -> DataFrame:
    """Cosine of embeddings, rounded so that equal ones are equal on every machine."""
    embed = embed or embedder()
    vectors = corpus.select(F.col("doc_id").alias("vec_id"), embed(F.col("text")).alias("embedding"))
    asked = queries.select("query_id", embed(F.col("nl")).alias("embedding"))
    out = nearest_each(vectors, asked, k, digits)
    return out.select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


def fused(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings."""
    all_ = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        all_ = all_.unionByName(x.select("query_id", "doc_id", "rank"))
    return ranked(all_.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")), k)


RANKERS: dict[str, Ranker] = {"semantic": semantic, "naive": naive, "token-overlap": token_overlap, "bm25": bm25, "fuzzy": fuzzy}
#: What "all" runs; naive only on request.
DEFAULT_RANKERS = ("semantic", "token-overlap", "bm25", "fuzzy")


def rankers_of(name: str) -> tuple[str, ...]:
    if name == "all":
        return DEFAULT_RANKERS
    if name not in RANKERS:
        raise ValueError(f"unknown ranker: {name!r}; expected one of {', '.join(['all', *sorted(RANKERS)])}")
    return (name,)
