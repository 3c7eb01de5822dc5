"""Nearest neighbours by exact distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from histlake.functions.vectors import distance, distance_score
from histlake.operators.history import scoped

OVER_FETCH = 5
#: Queries and vectors that are scored together, and numbers of queries that go out together for one pass of all vectors.
QUERY_BLOCK, VECTOR_BLOCK, NUMBERS = 1024, 1024, 2_000_000


def nearest(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """command_id and distance of the k nearest; ids decide ties. Each task keeps its own k first."""
    q = F.lit([float(x) for x in query])
    return vectors.select("command_id", distance(F.col("embedding"), q).alias("distance")).orderBy("distance", "command_id").limit(k)


def search(vectors: DataFrame, commands: DataFrame, query: Sequence[float], limit: int, cwd_prefix: str | None = None, host: str | None = None, since: int | None = None, exact: bool = False) -> DataFrame:
    """The limit best commands with their score. Filters apply to the OVER_FETCH * limit nearest of all, so fewer may
    be left; exact filters first instead."""
    if exact:
        inside = scoped(commands, cwd_prefix, host, since).select(F.col("id").alias("command_id"))
        found = nearest(vectors.join(inside, "command_id", "left_semi"), query, limit)
        rows = commands
    else:
        found = nearest(vectors, query, OVER_FETCH * limit)
        rows = scoped(commands, cwd_prefix, host, since)
    # found has OVER_FETCH * 200 rows at most.
    out = rows.join(F.broadcast(found), F.col("id") == F.col("command_id")).drop("command_id")
    return out.orderBy("distance", "id").limit(limit).withColumn("score", distance_score(F.col("distance")))


def best_of(row: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, lower ids first where scores are equal."""
    order = np.lexsort((vec, -score, row))
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], score[order][kept], vec[order][kept]


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """query_id, vec_id, score and rank of each query's k best by dot product, lower ids first where scores (rounded, if
    digits is given) are equal. Queries are a stated set: collected in blocks, each block scored in one pass by matrix
    products of some queries and some vectors at a time, each task keeping k of each query."""

    def scored(block: list) -> DataFrame:
        ids, matrix = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tiles = range(0, len(ids), QUERY_BLOCK)
            none = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
            held, floor = dict.fromkeys(tiles, none), np.full(len(ids), -np.inf)
            for pdf in (x.iloc[i : i + VECTOR_BLOCK] for x in batches for i in range(0, len(x), VECTOR_BLOCK)):
                vec, side = pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist(), np.float64).T
                for at in tiles:
                    s = matrix[at : at + QUERY_BLOCK] @ side
                    s = s if digits is None else np.round(s, digits, out=s)
                    least = floor[at : at + QUERY_BLOCK]
                    rows = np.flatnonzero(s.max(axis=1) >= least)
                    s, least = s[rows], least[rows]
                    if 0 < k < len(vec):
                        least = np.maximum(least, np.partition(s, len(vec) - k, axis=1)[:, len(vec) - k])
                    r, c = np.nonzero(s >= least[:, None])
                    held[at] = best_of(*(np.concatenate(x) for x in zip(held[at], (rows[r], s[r, c], vec[c]), strict=True)), k)
                    row, score, _ = held[at]
                    ends = np.searchsorted(row, np.arange(len(floor[at : at + QUERY_BLOCK])), "right")
                    full = np.diff(ends, prepend=0) == k
                    floor[at : at + QUERY_BLOCK][full] = score[ends[full] - 1] if k else np.inf
            for at in tiles:
                row, score, vec = held[at]
                yield pd.DataFrame({"query_id": ids[at + row], "vec_id": vec, "score": score})

        return vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")

    block, out = [], None
    for row in queries.select("query_id", "embedding").orderBy("query_id").toLocalIterator():
        block.append(row)
        if len(block) * len(row[1]) >= NUMBERS:
            out, block = scored(block) if out is None else out.union(scored(block)), []
    if block or out is None:
        out = scored(block) if out is None else out.union(scored(block))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
