import json

from histlake.cli import main


def test_index_ask_eval(spark, tmp_path, capsys):
    (tmp_path / "h").write_text(": 1700000000:5;ls -la\nplain\n")
    store = f"file://{tmp_path}/s"
    assert main(["index", store, "--source", f"zsh={tmp_path}/h"]) == 0 and main(["index", store, "--source", f"zsh={tmp_path}/h"]) == 0
    assert "inserted=2" in (out := capsys.readouterr().out) and "inserted=0" in out
    assert main(["ask", store, "recent", '{"limit": 1}']) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["text"] == "ls -la"
    assert main(["ask", store, "recent", '{"limit": 0}']) == 1
    (tmp_path / "d.toml").write_text('corpus = ["ls -la", "pwd"]\n[[query]]\nid = 1\ntier = "L"\nshort = "s"\nnl = "pwd now"\ngold = "pwd"\n')
    assert main(["eval", f"{tmp_path}/d.toml", "--ranker", "bm25", "--output", f"{tmp_path}/r.json"]) == 0
    assert json.loads((tmp_path / "r.json").read_text())[0]["recall_at_1"] == 1.0
