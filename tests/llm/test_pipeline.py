import re
from pathlib import Path

import corpus_pipeline as pipeline
from histlake.llm import quality_classifier
from histlake.llm.common import table, written
from histlake.llm.pii import DEMO_KEY, pseudonymised
from histlake.llm.sentencepiece_codec import MODEL, codec
from histlake.scratch import scratch
from tests.llm.conftest import prose
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [s for r in table(spark, SF, "benchmark").collect() if (s := shingles(r.text))]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, SF), "stage-test")
        got = {r[0]: r[1] for r in docs.select("doc_id", docs.columns[1]).collect()}
        if i < 4:
            assert docs.columns == before.columns
        if i == 0:
            model = quality_classifier.fit(before, table(spark, SF, "labels"))
            kept = {r.doc_id for r in quality_classifier.score(before, model).collect() if r.score >= quality_classifier.CUT}
            rows = {k: v for k, v in rows.items() if k in kept}
        elif i == 1:
            rows = {d: rows[d] for d, _, c in brute(list(rows.items())) if d == c}
        elif i == 2:
            rows = {d: t for d, t in rows.items() if not any(len(x & (s := shingles(t))) >= 0.75 * len(x) for x in items)}
        elif i == 3:
            rows = {d: pseudonymised(t, DEMO_KEY)[0] for d, t in rows.items()}
        else:
            rows = dict(zip(rows, codec(MODEL).encode(list(rows.values())), strict=True))
        assert got == rows, name
    assert len(rows) > 50


def test_odd_rows(spark, docs, none):
    part = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (part, part.filter("false")):
        for name, stage in pipeline.STAGES:
            df = written(stage(spark, df, SF), "stage-test")
    again = pipeline.deduplicate(spark, docs, SF)
    assert again.columns == docs.columns and again.filter("doc_id = 13").count() == 1
    assert {r.doc_id for r in again.collect()} == {1, 4, 5, 7, 8, 9, 10, 11, 13}


def test_rows_without_id_or_with_one_id(spark):
    """Each row is judged by itself: copies and leaks without an id go, other texts of one id stay."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 60").first().text
    rows = [(None, prose(1, 80)), (4, prose(1, 80)), (4, prose(2, 80)), (4, prose(2, 80)), (None, prose(3, 80)), (None, prose(3, 80)), (None, f"{prose(4, 30)} {item} {prose(5, 30)}"), (5, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    kept = pipeline.deduplicate(spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, rows[1][1]), (4, rows[2][1]), (None, rows[4][1]), *rows[6:]], key=str)
    clean = pipeline.decontaminated(spark, kept, SF)
    assert clean.count() == kept.count() - 1 and clean.filter("text is null").count() == 1
    assert pipeline.classify(spark, clean, SF).columns == docs.columns


def test_deduplication_copies_no_texts(spark, docs, tmp_path, monkeypatch):
    """Rows of files are numbered by file and place, without a second copy of them; the same rows stay."""
    part, names = docs.select("doc_id", "text", "lang", "source", "n_chars"), []
    part.repartition(3).write.parquet(str(tmp_path / "d"))
    read, kept = spark.read.parquet(str(tmp_path / "d")), pipeline.deduplicate(spark, part, SF)
    keys = [sorted((r[pipeline.KEY], str(r.doc_id), str(r.text)) for r in pipeline.keyed_rows(spark, d).collect()) for d in (read, read.repartition(5).filter("true"))]
    assert [len({k for k, *_ in x}) for x in keys] == [part.count()] * 2
    monkeypatch.setattr(pipeline, "written", lambda df, name: names.append(name) or written(df, name))
    again = pipeline.deduplicate(spark, read, SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect())) and "keyed" not in names
    odd = read.withColumnRenamed("lang", "_metadata")
    assert pipeline.keyed_rows(spark, odd).select(odd.columns).count() == part.count() and "keyed" in names
    assert pipeline.keyed_rows(spark, read.filter("false")).isEmpty()


def test_run_leaves_one_table(spark):
    """Of all that the stages write, what the last one reads stays."""
    folder = Path(scratch(spark, "none").removeprefix("file:")).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"] and out.filter("not round_trip").isEmpty()
    assert [p.name.split("-")[:2] for p in set(folder.iterdir()) - before if not p.name.startswith(".")] == [["stage", "4"]]
