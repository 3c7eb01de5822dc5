import sqlite3

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from histlake.plans.driver_queries import QUERIES
from histlake.sources.atuin import read_atuin, read_databases, write_databases
from histlake.sources.datasets import declared, nl2bash
from histlake.sources.shells import read_bash, read_zsh


def put(tmp_path, data):
    p = tmp_path / "history"
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def got(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("ordinal").collect()]


def test_zsh(spark, tmp_path):
    p = put(tmp_path, ": 1700000000:5;ls -la\nplain\n: bad:bad;x\n: 1700000010:1;cat <<E\\\na\\\nE\n\n: 5:0;tail\\")
    assert got(read_zsh(spark, p), "text", "ts", "duration_ms") == [("ls -la", 1700000000, 5000), ("plain", 0, None), ("cat <<E\na\nE", 1700000010, 1000), ("tail\\", 5, 0)]
    assert got(read_zsh(spark, p, since=1700000000), "text") == [("plain",), ("cat <<E\na\nE",)]


def test_latin1(spark, tmp_path):
    assert got(read_zsh(spark, put(tmp_path, b"a\xff\r\nb\n")), "text") == [("aÿ",), ("b",)]


def test_bash(spark, tmp_path):
    p = put(tmp_path, "plain1\n#1600000000\n#1700000000\n\nstamped\n#5\nplain2\n#1700000001\n")
    assert got(read_bash(spark, p), "text", "ts") == [("plain1", 0), ("stamped", 1700000000), ("#5", 0), ("plain2", 0)]
    assert got(read_bash(spark, p, since=2_000_000_000), "text") == [("plain1",), ("#5",), ("plain2",)]


def test_missing(spark, tmp_path):
    for read in (read_zsh, read_bash, read_atuin):
        assert read(spark, str(tmp_path / "none")).count() == 0


def database(tmp_path, columns, rows):
    with sqlite3.connect(tmp_path / "h.db") as db:
        db.execute(f"CREATE TABLE history ({', '.join(columns)})")
        db.executemany(f"INSERT INTO history VALUES ({', '.join('?' * len(columns))})", rows)
    return str(tmp_path / "h.db")


def test_atuin(spark, tmp_path):
    p = database(tmp_path, ["id", "timestamp", "duration", "exit", "command", "cwd", "session", "hostname"], [("a", 2_500_000_000, 3_999_999, 1, "x", "/p", "s", "h"), ("b", 1_000_000_000, None, None, "y", None, None, None)])
    cols = ("text", "ts", "source_id", "duration_ms", "exit_code", "cwd", "session_id", "hostname")
    assert got(read_atuin(spark, p), *cols) == [("y", 1, "b", None, None, None, None, None), ("x", 2, "a", 3, 1, "/p", "s", "h")]
    assert got(read_atuin(spark, p, since=2), "text") == [("x",)]  # its second began at the cursor
    assert got(read_atuin(spark, p, since=3), "text") == []


def test_atuin_columns(spark, tmp_path):
    assert got(read_atuin(spark, database(tmp_path, ["timestamp", "command"], [(5_000_000_000, "x")])), "text", "ts", "cwd") == [("x", 5, None)]


def test_atuin_broken(spark, tmp_path):
    with pytest.raises(Exception, match="timestamp"):
        read_atuin(spark, database(tmp_path, ["command"], [("x",)])).collect()


def test_databases_of_tasks(spark, tmp_path):
    """No row comes to the driver; each task's rows are a database of their own."""
    rows = spark.range(1000, numPartitions=3).selectExpr("concat('x', id) AS id", "id * 1000000000 AS timestamp", "concat('é ', id) AS command")
    uris = write_databases(rows, f"file://{tmp_path}/ab")
    assert len(uris) == 3 and sorted(f"file://{tmp_path}/ab/{p.name}" for p in (tmp_path / "ab").iterdir()) == uris
    assert got(read_databases(spark, uris, since=989), "text", "ts", "source_id", "cwd") == [(f"é {i}", i, f"x{i}", None) for i in range(990, 1000)]
    assert read_databases(spark, uris).count() == 1000 and read_databases(spark, []).count() == 0


def test_atuin_scan_keeps_rows_from_the_driver(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows are collected")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    assert QUERIES["atuin_scan"](spark, "/root/testdata/sf0.001").count() > 0


def test_nl2bash(spark, tmp_path):
    (tmp_path / "all.nl").write_text("list\n find \nlist\n\n")
    (tmp_path / "all.cm").write_text("ls\nfind .\nls -a\nlone\n")
    d = nl2bash(spark, str(tmp_path))
    assert [tuple(r) for r in d.corpus.orderBy("doc_id").collect()] == [(0, "find ."), (1, "lone"), (2, "ls"), (3, "ls -a")]
    assert {(r.query_id, r.text) for r in d.gold.collect()} == {(0, "find ."), (1, "ls"), (1, "ls -a")}
    (tmp_path / "all.cm").write_text("ls\n")
    with pytest.raises(ValueError, match="misaligned"):
        nl2bash(spark, str(tmp_path))


GOOD = 'corpus = ["a b", "c"]\n[[query]]\nid = 1\ntier = "L"\nshort = "s"\nnl = "q"\n'


def test_declared(spark, tmp_path):
    p = tmp_path / "d.toml"
    p.write_text(GOOD + 'golds = ["c", "a b"]\nstar = true\n')
    d = declared(spark, str(p))
    assert d.queries.first().asDict() == {"query_id": 0, "id": 1, "tier": "L", "short": "s", "nl": "q", "star": True} and d.gold.count() == 2
    for bad in ('gold = "zz"', "", 'gold = "c"\ngolds = ["c"]', "golds = []", 'gold = "c"\nid = "x"'):
        p.write_text(GOOD.replace("id = 1\n", "") + bad if "id" in bad else GOOD + bad)
        with pytest.raises(ValueError):
            declared(spark, str(p))
