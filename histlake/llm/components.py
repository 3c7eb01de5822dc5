"""Connected components of an edge table: forests of tasks' edges, then one task or alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from histlake.llm.common import lean, written

#: Edges of all tasks' forests up to which one task joins them.
ONE_TASK = 200_000
EDGE = "u long, v long"


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each partition's edges as a forest: (vertex, least vertex of its part)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in list(parent)]
    yield pd.DataFrame([e for e in found if e[0] != e[1]], columns=["u", "v"]).astype("int64")


def turned(links: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each of the given pairs of columns."""
    return links.select(F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs to (vertex, component), the least vertex reachable; vertices without edges are not in it.

    Tasks join their own edges first. Where at most ONE_TASK edges are left, one task joins those. Else large and small
    stars alternate until nothing changes, so rounds grow with the logarithm of the longest path; each vertex's
    neighbours are reduced by partial aggregation and no neighbourhood is gathered. Each star is written, as what reads
    it twice would hold its whole plan twice: the driver plans and compiles each copy."""
    links = written(edges.select("u", "v").filter("u <> v").mapInPandas(lean(forest), EDGE), "forest")
    if links.count() <= ONE_TASK:
        links = written(links.coalesce(1).mapInPandas(lean(forest), EDGE), "stars")
    else:
        links = contracted(links)
    return links.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(links.select(F.col("v"), F.col("v")).distinct())


def contracted(links: DataFrame) -> DataFrame:
    """(u, v) pairs to stars: each vertex but the least of its component, with that."""
    mark = None
    while True:
        both = turned(links, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = written(turned(large.join(least, "u"), ("v", "m"), ("u", "m")).filter("u <> v").distinct(), "stars")
        was, mark = mark, tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v"))).first())
        if was == mark:
            return links
