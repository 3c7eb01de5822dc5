"""Text functions: ASCII folding, literal containment, path prefixes, tokens and partial similarity."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Characters of texts that are cut into tokens together.
CHARACTERS = 1_000_000
#: Stretches that are compared together, so that their states stay in a core's cache.
STRETCHES = 32_768
TOKEN = re.compile(r"\w+")  # underscores are taken out before
#: Letters and digits in lower case, spaces for the rest.
ASCII_PARTS = "".join(chr(i).lower() if chr(i).isalnum() else " " for i in range(128))
#: No combining mark comes before U+0300.
BEYOND = re.compile("[\u0300-\U0010ffff]+")
NO_ASCII = re.compile("[^\x00-\x7f]+")


def ascii_fold(text: Column) -> Column:
    """Lower-cases A-Z only: É stays apart from é, as in SQLite's LIKE."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fold_literal(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def contains_literal(text: Column, pattern: str) -> Column:
    """Whether text contains pattern literally, up to the case of ASCII letters."""
    return F.contains(ascii_fold(text), F.lit(fold_literal(pattern)))


def under_path(path: Column, prefix: str) -> Column:
    """Whether path is prefix or below it: whole components only. The equal branch minds case."""
    prefix = prefix.rstrip("/") or "/"
    return (path == prefix) | F.startswith(ascii_fold(path), F.lit(fold_literal(prefix + "/")))


def without_marks(run: re.Match) -> str:
    return "".join(c for c in run[0] if not unicodedata.combining(c))


def tokens_of(text: str) -> list[str]:
    """Case-folded runs of letters and digits, without combining marks."""
    if text.isascii():
        return text.translate(ASCII_PARTS).split()
    return TOKEN.findall(BEYOND.sub(without_marks, unicodedata.normalize("NFKD", text)).casefold().replace("_", " "))


def slices(texts: pd.Series | list, rows: int | None = None) -> Iterator[slice]:
    """Stretches of at most CHARACTERS together, or of one text, and of at most so many rows."""
    ends = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARACTERS, "right")))
        to = min(to, at + rows) if rows else to
        yield slice(at, to)
        at = to


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A batch may hold 10,000 texts of any length; the lists of all their tokens would take many times their size."""
    for texts in batches:
        for part in slices(texts):
            yield texts.iloc[part].map(lambda t: tokens_of(t) if isinstance(t, str) else None)


def ascii_tokens(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits; other letters part them."""
    return (text if text.isascii() else NO_ASCII.sub(" ", text)).translate(ASCII_PARTS).split()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def common_lengths(pattern: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common subsequence of the pattern with each of many texts of one length, given place by
    place (-1 matches nothing). Bit-parallel: each text's state is one bit for each place of the pattern."""
    signs, at = np.unique(pattern, return_inverse=True)
    words = -(-len(pattern) // 64)
    masks = np.zeros((words, len(signs) + 1), np.uint64)
    for i, c in enumerate(at):
        masks[i // 64, c] |= np.uint64(1) << np.uint64(i % 64)
    state = np.full((words, len(columns[0])), ~np.uint64(0))
    for column in columns:
        c = np.searchsorted(signs, column)
        c = np.where((c < len(signs)) & (signs[np.minimum(c, len(signs) - 1)] == column), c, len(signs))
        carry = np.uint64(0)
        for w in range(words):
            s = state[w]
            u = s & masks[w][c]
            total = s + u
            over = total < s
            total = total + carry
            state[w] = total | (s - u)
            carry = (over | (total < carry)).astype(np.uint64)
    unset = ~state
    if len(pattern) % 64:
        unset[-1] &= (np.uint64(1) << np.uint64(len(pattern) % 64)) - np.uint64(1)
    return np.bitwise_count(unset).sum(axis=0)


def best_windows(short: str, longs: list[str]) -> np.ndarray:
    """0 to 100 for each of longs, none shorter than short: the best normalised indel similarity of short with a stretch
    as long as itself, also one that hangs over an end. All texts' stretches are compared together."""
    m = len(short)
    gap = np.full(m - 1, -1, np.int64)
    line = np.concatenate([gap, *(x for t in longs for x in (points(t), gap))])
    n = len(line) - m + 1
    used = np.convolve(line >= 0, np.ones(m, np.int64), "valid") if m > 1 else (line >= 0).astype(np.int64)
    score = 200.0 * common_lengths(points(short), [line[i : i + n] for i in range(m)]) / (m + used)
    return np.maximum.reduceat(score, np.cumsum([0, *(len(t) + m - 1 for t in longs[:-1])]))


def best_in(long: str, shorts: list[str]) -> np.ndarray:
    """best_windows of each of many shorts in one long text, which is no shorter than any. Signs that long has not match
    nothing, so only the others take a bit; all shorts and stretches go together, place by place."""
    signs, size = np.unique(points(long)), np.array(list(map(len, shorts)))
    longest = size.max()

    def places(text: str) -> np.ndarray:
        c = np.searchsorted(signs, x := points(text))
        return np.where(signs[np.minimum(c, len(signs) - 1)] == x, c, len(signs))

    order = np.argsort(-size, kind="stable")
    gap = np.full(longest - 1, len(signs), np.int64)
    line = np.concatenate([gap, places(long), gap, [len(signs)]])
    n = len(line) - longest
    codes = places("".join(shorts[i].ljust(longest, "\0") for i in order)).reshape(-1, longest)
    codes[np.arange(longest) >= size[order, None]] = len(signs)
    bit = np.cumsum(codes < len(signs), axis=1) - 1
    kind, bits = (np.uint32, 32) if bit.max() < 32 else (np.uint64, 64)
    masks = np.zeros((max(0, bit.max()) // bits + 1, len(shorts), len(signs) + 1), kind)
    for i in range(longest):
        (j,) = np.nonzero(codes[:, i] < len(signs))
        masks[bit[j, i] // bits, j, codes[j, i]] |= kind(1) << (bit[j, i] % bits).astype(kind)
    masks = masks[:, :, line]
    state = np.full((len(masks), len(shorts), n), ~kind(0))
    u, total = np.empty_like(state[0]), np.empty_like(state[0])
    # Those that have a place i come first.
    for i, m in enumerate(np.searchsorted(-size[order], -np.arange(longest))):
        carry = None
        for w in range(len(masks)):
            s = state[w, :m]
            np.bitwise_and(masks[w, :m, i : i + n], s, out=u[:m])
            np.add(s, u[:m], out=total[:m])
            if len(masks) > 1:
                over = total[:m] < s
                if carry is not None:
                    total[:m] += carry
                    over |= total[:m] < carry
                carry = over.astype(kind)
            s -= u[:m]
            s |= total[:m]
    common = np.bitwise_count(~state).sum(axis=0, dtype=np.int64)
    ends = np.cumsum(np.append(0, line < len(signs)))
    used = ends[np.arange(n) + size[order, None]] - ends[:n]
    out = np.empty(len(shorts))
    out[order] = (200.0 * common / (size[order, None] + used)).max(axis=1)
    return out


def partial_ratios(query: str, texts: list[str]) -> np.ndarray:
    """0 to 100 for each text: the shorter of the two against the best stretch of the longer. Two empty texts are alike;
    equal lengths are tried both ways."""
    out = np.array([100.0 if not query and not t else 0.0 for t in texts])
    longer = [i for i, t in enumerate(texts) if query and len(t) >= len(query)]
    # Many stretches at a time, but within some megabytes.
    part: list[int] = []
    for i in longer:
        part.append(i)
        if sum(len(texts[j]) + len(query) for j in part) > 200_000 or i == longer[-1]:
            out[part] = best_windows(query, [texts[j] for j in part])
            part = []
    shorter = sorted((i for i, t in enumerate(texts) if query and 0 < len(t) <= len(query)), key=lambda i: len(texts[i]))
    while shorter:
        m = len(texts[shorter[-1]])
        size = max(1, STRETCHES // ((len(query) + m) * -(-m // 64)))
        part, shorter = shorter[-size:], shorter[:-size]
        out[part] = np.maximum(out[part], best_in(query, [texts[i] for i in part]))
    return out


def partial_ratio(a: str, b: str) -> float:
    return float(partial_ratios(a, [b])[0])
