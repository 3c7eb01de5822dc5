"""Times and windows in requests, resolved on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime

#: Seconds of each unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def span(m: re.Match) -> int:
    return int(m["n"]) * UNITS[m["unit"]]


def moment(m: re.Match) -> int:
    at = datetime.fromisoformat(m.group())
    return int(at.replace(tzinfo=at.tzinfo or UTC).timestamp())


#: Notations of a time: a pattern, its value, and whether that counts back from now.
AGO = (re.compile(r"(?P<n>\d+)\s*(?P<unit>[smhdw])"), span, True)
NOTATIONS: tuple[tuple[re.Pattern, Callable[[re.Match], int], bool], ...] = (AGO, (re.compile(r"(?s).+"), moment, False))


def parsed(text: str, field: str, notations=NOTATIONS) -> tuple[int, bool]:
    """The value by the first notation that text is written in, and whether it counts back from now."""
    for pattern, value, back in notations:
        if m := pattern.fullmatch(text.strip()):
            try:
                return value(m), back
            except ValueError:
                break
    known = "a number with a unit, like 90m or 7d" + ", or an ISO 8601 date or time" * (len(notations) > 1)
    raise ValueError(f"{field}: {text!r} is not {known}")


def window_seconds(window: str) -> int:
    return parsed(window, "window", (AGO,))[0]


def cutoff(since: str, now: int | None = None) -> int:
    """Unix seconds of a relative or ISO 8601 time; without a zone it is UTC."""
    value, back = parsed(since, "since")
    return (int(datetime.now(UTC).timestamp()) if now is None else now) - value if back else value
