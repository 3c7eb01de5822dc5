"""The requests as tools over JSON-RPC: one message a line in, one a line out."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from histlake.plans.requests import INPUTS, MISSING, Requests, UnknownRequest

#: Error codes of JSON-RPC, and the protocol's version.
PARSE, METHOD, PARAMS, INTERNAL = -32700, -32601, -32602, -32603
PROTOCOL = "2025-06-18"
ABOUT = {
    "search": "Commands nearest in meaning to a text.", "find_in_project": "The same, at or below a folder.", "recent": "The latest commands.",
    "failed_recently": "Commands that ended with an error in a time window.", "commands_after": "What ran next after matching commands.", "command_stats": "Counts, durations and success of matching commands.",
}


def tools() -> list[dict]:
    """Names and input schemas of the requests."""

    def field(default, bound) -> dict:
        text = bound.kind is str
        limits = {"minLength": bound.least, "maxLength": bound.most} if text else {"minimum": bound.least, "maximum": bound.most}
        return {"type": "string" if text else "integer"} | limits | ({} if default is MISSING or default is None else {"default": default})

    return [
        {"name": name, "description": ABOUT[name], "inputSchema": {"type": "object", "additionalProperties": False, "properties": {k: field(*v) for k, v in known.items()}, "required": [k for k, v in known.items() if v[0] is MISSING]}}
        for name, known in INPUTS.items()
    ]


def envelope(payload: dict, bad: bool) -> dict:
    """A tool's result: the payload as it is and as text."""
    return {"content": [{"type": "text", "text": json.dumps(payload, ensure_ascii=False)}], "structuredContent": payload, "isError": bad}


def answer(requests: Requests, method: str, params: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "histlake", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": tools()}
    if method == "tools/call":
        payload, _, bad = requests(params["name"], params.get("arguments") or {})
        return envelope(payload, bad)
    raise NotImplementedError(method)


def serve(requests: Requests, lines: Iterable[str]) -> Iterator[str]:
    """Responses to messages. Notifications (without an id) have none; nothing that a message holds ends the service."""
    for line in filter(str.strip, lines):
        out: dict = {"jsonrpc": "2.0", "id": None}
        try:
            message = json.loads(line)
            if not isinstance(message, dict):
                raise ValueError
        except ValueError:
            yield json.dumps(out | {"error": {"code": PARSE, "message": "no JSON object"}})
            continue
        if "id" not in message:
            continue
        out["id"] = message["id"]
        try:
            out["result"] = answer(requests, message.get("method", ""), message.get("params") or {})
        except NotImplementedError as e:
            out["error"] = {"code": METHOD, "message": f"no method {e}"}
        except (UnknownRequest, KeyError, TypeError, AttributeError) as e:
            out["error"] = {"code": PARAMS, "message": str(e)}
        except Exception as e:  # noqa: BLE001
            out["error"] = {"code": INTERNAL, "message": type(e).__name__}
        yield json.dumps(out, ensure_ascii=False)
