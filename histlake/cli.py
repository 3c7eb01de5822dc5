"""Command line: load history, answer a request, evaluate rankers."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from histlake.operators.evaluation import append_history, evaluate
from histlake.operators.ranking import rankers_of
from histlake.plans.requests import INPUTS, Requests
from histlake.plans.serving import serve
from histlake.plans.store import Store
from histlake.sources.atuin import read_atuin
from histlake.sources.datasets import declared, nl2bash
from histlake.sources.shells import read_bash, read_zsh

READERS = {"zsh": read_zsh, "bash": read_bash, "atuin": read_atuin}
#: Seconds that all rankers together may take before a warning, and before an error.
ALL_SOFT, ALL_HARD = 120.0, 180.0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="histlake")
    sub = p.add_subparsers(dest="what", required=True)
    load = sub.add_parser("index")
    load.add_argument("store")
    load.add_argument("--source", action="append", default=[], metavar="KIND=PATH", help="zsh, bash or atuin, and where it is")
    load.add_argument("--rebuild", action="store_true")
    load.add_argument("--new-salt", action="store_true")
    ask = sub.add_parser("ask")
    ask.add_argument("store")
    ask.add_argument("request", choices=sorted(INPUTS))
    ask.add_argument("arguments", nargs="?", default="{}", help="JSON")
    sub.add_parser("serve", help="JSON-RPC, a message a line, on standard input and output").add_argument("store")
    ev = sub.add_parser("eval")
    ev.add_argument("dataset", help="a TOML file, or a folder with all.nl and all.cm")
    ev.add_argument("--ranker", default="all")
    ev.add_argument("--output")
    ev.add_argument("--no-append", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("histlake").getOrCreate()
    if a.what == "serve":
        for line in serve(Requests(Store(spark, a.store)), sys.stdin):
            print(line, flush=True)
        return 0
    if a.what == "ask":
        payload, _, bad = Requests(Store(spark, a.store))(a.request, json.loads(a.arguments))
        print(json.dumps(payload))
        return int(bad)
    if a.what == "index":
        store = Store(spark, a.store)
        if a.new_salt:
            store.rotate_salt(rebuild=a.rebuild)
        elif a.rebuild:
            store.rebuild()
        given = dict(s.split("=", 1) for s in a.source)
        cursors = store.meta()["cursors"]
        print(store.load([READERS[k](spark, given[k], cursors.get(k)) for k in READERS if k in given]))
        return 0
    dataset = declared(spark, a.dataset) if a.dataset.endswith(".toml") else nl2bash(spark, a.dataset)
    began, results = time.perf_counter(), []
    for name in rankers_of(a.ranker):
        results.append(evaluate(dataset, name))
        print(json.dumps(results[-1]))
    took = time.perf_counter() - began
    if a.output and not a.no_append:
        append_history(results, a.output)
    if took > ALL_SOFT:
        print(f"slow: {took:.0f} s")
    return int(took > ALL_HARD)


if __name__ == "__main__":
    raise SystemExit(main())
