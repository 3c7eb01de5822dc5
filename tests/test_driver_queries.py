import hashlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from histlake.functions.redact import redact_text
from histlake.functions.vectors import hash_encode
from histlake.plans.driver_queries import DUCK, QUERIES, SALT

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


BY_HAND = ("rank_fuzzy", "rank_semantic", "text_hash_prefix")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in BY_HAND])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in want.columns)) for r in rows)


def test_text_hash_prefix(spark, duck):
    rows = duck.sql(f"SELECT id, text_scrubbed FROM ({DUCK})").fetchall()
    want = {(i, hashlib.blake2b(SALT + redact_text(t).encode(), digest_size=32).hexdigest()[:16]) for i, t in rows}
    assert {tuple(r) for r in QUERIES["text_hash_prefix"](spark, SF).collect()} == want and len(want) == len(rows)


def test_rank_semantic(spark, duck):
    (ids, texts), (asked, nl) = (zip(*duck.sql(f"SELECT * FROM (SELECT {c}, text FROM {t} ORDER BY 1)").fetchall()) for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    scores = np.round(hash_encode(nl).astype(float) @ hash_encode([t or "" for t in texts]).astype(float).T, 5)
    want = {(q, ids[j], round(s[j], 6), n) for q, s in zip(asked, scores, strict=True) for n, j in enumerate(np.argsort(-s, kind="stable")[:5], 1)}
    assert {tuple(r) for r in QUERIES["rank_semantic"](spark, SF).collect()} == want


def test_entry(spark):
    assert entry.entry(spark).count() == 20
