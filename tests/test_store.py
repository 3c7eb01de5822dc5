import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from histlake.functions.texts import tokens
from histlake.functions.times import cutoff, window_seconds
from histlake.operators import history
from histlake.plans.requests import INPUTS, Requests, UnknownRequest, validated
from histlake.plans.serving import serve
from histlake.operators.numbering import dense
from histlake.plans.store import Conflict, Store, postings_of
from histlake.schema import ENTRY, conform
from histlake.streaming.ingest import stream_into

NOW = 2_000_000


def entries(spark, rows):
    names = ["text", "ts", "source", "cwd", "hostname", "exit_code", "duration_ms", "session_id", "ordinal"]
    return conform(spark.createDataFrame([dict(zip(names, r, strict=False)) | {"ordinal": i} for i, r in enumerate(rows)], "text string, ts long, source string, cwd string, hostname string, exit_code int, duration_ms long, session_id string, ordinal long"), ENTRY)


ROWS = [
    ("psql -c migration", NOW - 500, "atuin", "/home/u/proj", "h1", 1, 100, "s1"),
    ("git status", NOW - 400, "atuin", "/home/u/proj/sub", "h1", 0, 200, "s1"),
    ("git status", NOW - 400, "atuin", "/home/u/proj/sub", "h1", 0, 200, "s1"),
    ("rollback", NOW - 300, "atuin", "/home/u/projector", "h2", 0, None, "s1"),
    ("psql --password FAKEpw", NOW - 90_000, "atuin", "/etc", "h1", 2, 50, "s2"),
    ("PSQL plain", 0, "zsh", None, None, None, None, None),
    ("PSQL plain", 0, "zsh", None, None, None, None, None),
    ("100%_done", 0, "bash", "/", None, None, None, None),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    r = s.load([entries(spark, ROWS)])
    assert (r.inserted, r.skipped_dedup, r.by_source) == (6, 2, {"atuin": 4, "zsh": 1, "bash": 1})
    return s


@pytest.fixture(scope="module")
def ask(store):
    return Requests(store, now=lambda: NOW)


def texts(payload):
    return [x["text"] for x in payload[0]["results"]]


def test_ids_and_redaction(store):
    rows = store.commands().orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4, 5, 6] and [r.source for r in rows] == ["zsh", "bash", *["atuin"] * 4]
    assert "FAKEpw" not in str(rows) and all(len(r.text_hash) == 32 for r in rows)
    assert store.meta()["cursors"] == {"atuin": NOW - 300} and store.vectors().count() == 6
    assert store.postings().filter("term = 'psql'").agg(F.sum("tf")).first()[0] == 3


def test_recent(ask):
    assert texts(ask("recent", {}))[:2] == ["rollback", "git status"] and texts(ask("recent", {}))[-2:] == ["100%_done", "PSQL plain"]
    for prefix in ("/home/u/proj", "/home/u/proj/", "/HOME/u/proj//"):
        assert len(texts(ask("recent", {"cwd_prefix": prefix}))) == (2 if prefix.startswith("/home") else 1)
    assert texts(ask("recent", {"cwd_prefix": "/"})) == ["100%_done"]
    assert len(texts(ask("recent", {"host": "h1", "limit": 2}))) == 2


def test_failed(ask):
    assert texts(ask("failed_recently", {})) == ["psql -c migration"]
    assert len(texts(ask("failed_recently", {"window": "2d", "pattern": "PSQL"}))) == 2


def test_after(ask):
    got = ask("commands_after", {"pattern": "psql"})[0]["results"]
    assert [(g["pattern_match"]["text"], [f["text"] for f in g["following"]]) for g in got] == [("psql -c migration", ["git status", "rollback"]), ("psql --password <REDACTED:PASSWORD>", []), ("PSQL plain", [])]


def test_stats(ask):
    got = ask("command_stats", {"pattern": "psql"})[0]
    assert got == {"top_cwds": [["/etc", 1], ["/home/u/proj", 1]], "mean_duration_ms": 75.0, "success_rate": 0.0, "by_source": {"atuin": 2, "zsh": 1}, "total": 3}
    assert ask("command_stats", {"pattern": "zz"})[0] == {"top_cwds": [], "mean_duration_ms": None, "success_rate": None, "by_source": {}, "total": 0}
    assert ask("command_stats", {"pattern": "%_D"})[1] == 1 and ask("command_stats", {"pattern": "g_t"})[1] == 0


def test_search(ask, monkeypatch):
    got = ask("search", {"query": "rollback", "limit": 2})[0]["results"]
    assert got[0]["text"] == "rollback" and got[0]["score"] > 0.999 and got[0]["score"] >= got[1]["score"]
    assert texts(ask("search", {"query": "rollback", "cwd_prefix": "/etc"})) == ["psql --password <REDACTED:PASSWORD>"]
    assert texts(ask("search", {"query": "x", "since": "1h"})) and "100%_done" not in texts(ask("search", {"query": "x", "since": "1h"}))
    assert set(texts(ask("find_in_project", {"query": "x", "cwd": "/home/u/proj/"}))) == {"psql -c migration", "git status"}
    monkeypatch.setenv("MCP_CLIENT_CWD", "/etc")
    assert len(texts(ask("find_in_project", {"query": "x"}))) == 1
    monkeypatch.setenv("MCP_CLIENT_CWD", "/")
    assert ask("find_in_project", {"query": "x"})[2]
    assert json.loads(ask.text("recent", {}))["results"]


@pytest.mark.parametrize(("name", "args"), [("recent", {"limit": 0}), ("recent", {"limit": 201}), ("recent", {"x": 1}), ("search", {}), ("search", {"query": ""}), ("search", {"query": "a" * 1001}), ("command_stats", {"pattern": " %% "}), ("failed_recently", {"window": "2026-01-01"}), ("search", {"query": "x", "since": "later"}), ("recent", {"limit": True})])
def test_bad_input(ask, name, args):
    payload, n, bad = ask(name, args)
    assert bad and n == 0 and payload["error"] and payload["results"] == []


def test_serving(ask):
    call = lambda i, name, **args: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": args}})
    lines = ['{"jsonrpc": "2.0", "id": 1, "method": "initialize"}', '{"jsonrpc": "2.0", "method": "notifications/initialized"}', "", '{"id": 2, "method": "tools/list"}', call(3, "recent", limit=1), call(4, "recent", limit=0), call(5, "zz"), '{"id": 6, "method": "zz"}', "{", '{"id": 7, "method": "tools/call"}']
    got = [json.loads(x) for x in serve(ask, lines)]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, 6, None, 7]
    assert [x.get("error", {}).get("code") for x in got] == [None, None, None, None, -32602, -32601, -32700, -32602]
    assert {t["name"] for t in got[1]["result"]["tools"]} == set(INPUTS) and got[1]["result"]["tools"][0]["inputSchema"]["required"] == ["query"]
    one, bad = got[2]["result"], got[3]["result"]
    assert json.loads(one["content"][0]["text"]) == one["structuredContent"] and one["structuredContent"]["results"][0]["text"] == "rollback"
    assert not one["isError"] and bad["isError"]


def test_defaults():
    assert validated("failed_recently", {}) == {"window": "24h", "pattern": None, "limit": 20} and len(INPUTS) == 6


def test_unknown_request(ask):
    with pytest.raises(UnknownRequest):
        ask("zz", {})


def test_times():
    assert window_seconds(" 2 d") == 172800 and cutoff("1h", 7200) == 3600 and cutoff("2026-05-01") == 1777593600 == cutoff("2026-05-01T02:00:00+02:00")
    for bad in ("", "soon"):
        with pytest.raises(ValueError):
            cutoff(bad)


def test_states(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    ask = Requests(s)
    assert "not found" in ask("recent", {})[0]["error"]
    s.load([entries(spark, [("x", 5, "zsh")])])
    assert "atuin" in ask("failed_recently", {})[0]["error"] and "atuin" in ask("commands_after", {"pattern": "x"})[0]["error"]
    stale = Requests(Store(spark, s.path, model=("other", "1")))
    assert "model" in stale("recent", {})[0]["error"]
    with pytest.raises(ValueError):
        s.rotate_salt()
    old = s.salt()
    assert s.rotate_salt(rebuild=True) == 2 and s.salt() != old and s.commands().count() == 0
    s.put_meta(s.meta() | {"schema_version": 99})
    with pytest.raises(ValueError, match="99"):
        Store(spark, s.path)


def test_incremental_and_stream(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    src = f"{tmp_path}/in"
    first = [("a", 10, "zsh"), ("b", 0, "zsh")]
    entries(spark, first).write.parquet(src)
    for _ in range(2):
        stream_into(spark, s, src, f"{tmp_path}/cp").awaitTermination()
        assert s.commands().count() == 2
    entries(spark, [*first, ("late", 5, "zsh"), ("c", 11, "zsh"), ("d", 0, "zsh"), ("a", 10, "bash")]).write.mode("append").parquet(src)
    stream_into(spark, s, src, f"{tmp_path}/cp").awaitTermination()
    got = [(r.id, r.text_scrubbed) for r in s.commands().orderBy("id").collect()]
    assert sorted(x for _, x in got) == ["a", "a", "b", "c", "d"] and [i for i, _ in got] == [1, 2, 3, 4, 5]


def test_two_loads_at_once(spark, tmp_path):
    """Both keep their rows; what both have comes once, and ids have no gaps."""
    path = f"file://{tmp_path}/s"
    Store(spark, path).load([entries(spark, [("old", 1, "zsh")])])
    loads = [[(f"{who} {i}", 10 + i, "zsh") for i in range(5)] + [("both", 50, "zsh")] for who in "ab"]
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda rows: Store(spark, path).load([entries(spark, rows)]), loads))
    rows = Store(spark, path).commands().orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 13)) and len({r.text_scrubbed for r in rows}) == 12
    assert sum(d.inserted for d in done) == 11 and sum(d.skipped_dedup for d in done) == 1
    assert Store(spark, path).meta()["cursors"] == {"zsh": 50} and not list((tmp_path / "s" / "staged").iterdir())


def test_a_stale_manifest_is_refused(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    old = s.meta()
    s.salt()
    with pytest.raises(Conflict):
        s.put_meta(old | {"batches": ["lost"]})
    assert s.meta()["batches"] == [] and s.meta()["salt"]


def test_postings(spark, store):
    want = store.commands().select("id", F.explode(tokens("text_scrubbed")).alias("term")).groupBy("term", "id").count()
    assert sorted(map(tuple, store.postings().collect())) == sorted(map(tuple, want.collect()))


def test_following_all_agrees(spark, store):
    c = store.commands().filter("session_id is not null")
    one = {(r.match_id, r.pos, r.id) for r in history.following(c, c).collect()}
    many = history.following_all(c, "session_id", ("ts", "id")).select("id", F.explode("nexts").alias("x")).collect()
    assert one == {(r.id, r.x.pos, r.x.next.id) for r in many}


def test_postings_and_numbers_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "a b A_a"), (2, ""), (3, None), (4, "é c")], "id long, text_scrubbed string")
    out = postings_of(rows)
    assert sorted(map(tuple, out.collect())) == [("a", 1, 3), ("b", 1, 1), ("c", 4, 1), ("e", 4, 1)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    many = spark.range(5, 70_005, numPartitions=3)
    assert dense(many, "id", 5) and not dense(many, "id", 4) and dense(many.limit(0), "id", 5)
    assert not dense(many.filter("id <> 40000").union(spark.range(50_000, 50_001)), "id", 5)
