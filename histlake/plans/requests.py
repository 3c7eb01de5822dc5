"""The six requests: validated inputs in, plain dictionaries out."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import MISSING, dataclass

from pyspark.sql import DataFrame, Row, functions as F

from histlake.functions.hashing import hash_prefix
from histlake.functions.redact import redact_text
from histlake.functions.times import cutoff, window_seconds
from histlake.functions.vectors import Encode, hash_encode
from histlake.operators import history, nearest
from histlake.plans.store import Store
from histlake.schema import HIT

NO_INDEX = "Nothing is loaded at {path}: not found."
STALE_MODEL = "Vectors are of model {indexed!r}, requests of {configured!r}. Load the history anew."
NO_EXIT_CODES = "How commands ended is known of atuin history alone, and none is loaded."
NO_SESSIONS = "Sessions are known of atuin history alone, and none is loaded."
NO_CWD = "No working directory is known. Pass 'cwd'."
BARE_WILDCARD = "A pattern of nothing but '%' matches everything; give some text."


class UnknownRequest(LookupError):
    pass


@dataclass(frozen=True)
class Bound:
    """What a field may hold."""

    kind: type
    least: int = 0
    most: int = 0
    path: bool = False
    optional: bool = False


TEXT, LIMIT = Bound(str, 1, 1000), Bound(int, 1, 200)
CWD, HOST, TIME = Bound(str, 0, 4096, path=True, optional=True), Bound(str, 0, 255, optional=True), Bound(str, 0, 64, optional=True)
#: Fields of each request, as (default, bound); MISSING must be given.
INPUTS: dict[str, dict[str, tuple[object, Bound]]] = {
    "search": {"query": (MISSING, TEXT), "limit": (10, LIMIT), "cwd_prefix": (None, CWD), "host": (None, HOST), "since": (None, TIME)},
    "find_in_project": {"query": (MISSING, TEXT), "limit": (10, LIMIT), "cwd": (None, CWD)},
    "commands_after": {"pattern": (MISSING, TEXT), "limit": (10, LIMIT)},
    "failed_recently": {"window": ("24h", Bound(str, 0, 64)), "pattern": (None, Bound(str, 0, 1000, optional=True)), "limit": (20, LIMIT)},
    "command_stats": {"pattern": (MISSING, TEXT)},
    "recent": {"limit": (20, LIMIT), "cwd_prefix": (None, CWD), "host": (None, HOST)},
}


def validated(name: str, given: dict) -> dict:
    """The request's fields with defaults. Unknown, absent, mistyped and out-of-bounds ones are errors."""
    known = INPUTS[name]
    if extra := sorted(set(given) - set(known)):
        raise ValueError(f"unknown fields: {', '.join(extra)}")
    out = {}
    for field, (default, bound) in known.items():
        value = given.get(field, default)
        if value is MISSING:
            raise ValueError(f"{field}: required")
        if value is None and bound.optional:
            out[field] = None
            continue
        if not isinstance(value, bound.kind) or isinstance(value, bool):
            raise ValueError(f"{field}: must be {bound.kind.__name__}")
        size = value if bound.kind is int else len(value)
        if not bound.least <= size <= bound.most:
            raise ValueError(f"{field}: must be from {bound.least} to {bound.most}" + " characters" * (bound.kind is str))
        out[field] = (value.rstrip("/") or "/") if bound.path else value
    if out.get("pattern") is not None and re.fullmatch("%+", out["pattern"].strip()):
        raise ValueError(BARE_WILDCARD)
    return out


def hits(commands: DataFrame, *extra: str) -> DataFrame:
    """Columns of results; the text is redacted again on the driver, where there are few."""
    named = commands.withColumn("text_hash", hash_prefix(F.col("text_hash"))).withColumnRenamed("text_scrubbed", "text")
    return named.select(*extra, *HIT)


def hit(row: Row, score: float | None = None) -> dict:
    return {c: row[c] for c in HIT} | {"text": redact_text(row["text"]), "score": score}


class Requests:
    """Answers requests over a store."""

    def __init__(self, store: Store, encode: Encode = hash_encode, now: Callable[[], float] = time.time):
        self.store, self.encode, self.now = store, encode, now

    def __call__(self, name: str, arguments: dict) -> tuple[dict, int, bool]:
        """(payload, number of results, whether it is an error). Unknown names raise."""
        if name not in INPUTS:
            raise UnknownRequest(f"unknown request: {name!r}")
        try:
            payload, n = getattr(self, name)(**validated(name, arguments))
        except ValueError as e:
            payload, n = {"error": str(e), "results": []}, 0
        return payload, n, "error" in payload

    def text(self, name: str, arguments: dict) -> str:
        """The payload as JSON."""
        return json.dumps(self(name, arguments)[0])

    def problem(self) -> tuple[dict, int] | None:
        meta = self.store.meta()
        if not meta["batches"]:
            return {"error": NO_INDEX.format(path=self.store.path), "results": []}, 0
        if (was := meta.get("embedding_model_name")) != self.store.model[0]:
            return {"error": STALE_MODEL.format(indexed=was, configured=self.store.model[0]), "results": []}, 0
        return None

    def listed(self, found: DataFrame) -> tuple[dict, int]:
        rows = [hit(r) for r in hits(found).collect()]  # 200 at most
        return {"results": rows}, len(rows)

    def recent(self, limit, cwd_prefix, host):
        return self.problem() or self.listed(history.recent(self.store.commands(), limit, cwd_prefix, host))

    def failed_recently(self, window, pattern, limit):
        if bad := self.problem():
            return bad
        commands = self.store.commands()
        if not history.has_source(commands, "atuin"):
            return {"error": NO_EXIT_CODES, "results": []}, 0
        return self.listed(history.failed_recently(commands, int(self.now()) - window_seconds(window), limit, pattern))

    def command_stats(self, pattern):
        if bad := self.problem():
            return bad
        r = history.stats(history.matching(self.store.commands(), pattern)).first()
        payload = {"top_cwds": [[x["cwd"], x["n"]] for x in r["top_cwds"]], "mean_duration_ms": r["mean_duration_ms"], "success_rate": r["success_rate"], "by_source": dict(r["by_source"] or {}), "total": r["total"]}
        return payload, r["total"]

    def commands_after(self, pattern, limit):
        if bad := self.problem():
            return bad
        commands = self.store.commands()
        if not history.has_source(commands, "atuin"):
            return {"error": NO_SESSIONS, "results": []}, 0
        matches, after = history.after(commands, pattern, limit)
        nexts: dict[int, list] = {}
        for r in hits(after, "match_id", "pos").orderBy("match_id", "pos").collect():  # 3 for each match
            nexts.setdefault(r["match_id"], []).append(hit(r))
        found = [{"pattern_match": (h := hit(r)), "following": nexts.get(h["id"], [])} for r in hits(matches).collect()]
        return {"results": found}, len(found)

    def search(self, query, limit, cwd_prefix, host, since):
        if bad := self.problem():
            return bad
        at = None if since is None else cutoff(since, int(self.now()))
        vector = [float(x) for x in self.encode([query])[0]]
        found = nearest.search(self.store.vectors(), self.store.commands(), vector, limit, cwd_prefix, host, at)
        rows = [hit(r, r["score"]) for r in hits(found, "score", "distance").orderBy("distance", "id").collect()]
        return {"results": rows}, len(rows)

    def find_in_project(self, query, limit, cwd):
        here = cwd or os.environ.get("MCP_CLIENT_CWD") or os.getcwd()
        if not cwd and here == "/":
            return {"error": NO_CWD, "results": []}, 0
        return self.search(query, limit, here.rstrip("/") or "/", None, None)
