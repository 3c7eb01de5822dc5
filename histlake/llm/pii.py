"""Format-preserving Feistel pseudonyms for personal data (operator 8).

Validated card numbers, account numbers, phone numbers, social-security numbers, network addresses, dates, e-mail
addresses and secrets are replaced by a keyed permutation of their own format's values. Equal values (whatever their
separators, and whatever stands around them) get equal pseudonyms in every document, so records stay linked; no value
is its own pseudonym. Texts are scanned whole, and values may be of any length.

Defined results: a null text stays null with no spans; an empty text stays empty; only the text column is rewritten,
all other columns (also ones of other names and types) pass through. Rows are independent, so ties, repeated rows and
tables without rows need no rule.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from histlake.llm.common import lean, table

#: For queries and tests only. Deployments pass their own secret.
DEMO_KEY = b"histlake demonstration key"
ROUNDS = 8
#: Characters that are permuted as one number.
PART = 128
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Every value has a digit, an @, or a sign that assigns it to a keyword, or begins with AKIA: a text without any of
#: these has none.
HINT = re.compile(r"[0-9@=:]|AKIA")
WORDS = "(?i:password|passwd|token|secret|api[_-]?key|access[_-]?key)"
HEX = "[0-9A-Fa-f]{1,4}"
#: What a value of each kind looks like, in the order in which kinds are tried at a place. None begins inside a word.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": rf"""\bAKIA[A-Z0-9]{{16}}\b|\b{WORDS}["']?\s*[=:]\s*["']?[A-Za-z0-9_+/.~!@#$%^*=:?-]{{5,}}[A-Za-z0-9_+/~@#$%^*=-]""",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b",
    "date": r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:)|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![\w-]|[./][0-9]))",
    "ip": rf"(?<![\w.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?!\w|\.[0-9])|(?<![\w:.])(?:(?:{HEX}:){{7}}{HEX}|{HEX}(?::{HEX}){{0,6}}::(?:{HEX}(?::{HEX}){{0,6}})?)(?![\w:])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w+-])[0-9](?:[ -]?[0-9]){12,18}(?!\w)",
    "phone": r"(?<![\w+])(?:\+[1-9][0-9]{7,14}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]?){1,3}[0-9]{2,4})(?!\w)",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SHAPES.items()))
KINDS = tuple(SHAPES)
EACH = {k: re.compile(p) for k, p in SHAPES.items()}
#: Country calling codes of one and two digits; all others have three.
CALLING = re.compile("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
ASSIGNED, RUN = re.compile(r"[=:]\s*[\"']?"), re.compile(r"\w+|.", re.S)


def feistel(x: int, size: int, key: bytes, back: bool = False) -> int:
    """A keyed bijection of range(size): Feistel rounds on a domain of an even number of bits, walked into range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            seen = a if back else b
            h = hashlib.blake2b(b"%d|%d|%d" % (i, size, seen), key=key[:64], digest_size=max(8, half // 8 + 1))
            r = int.from_bytes(h.digest(), "big") & mask
            a, b = (b ^ r, a) if back else (b, a ^ r)
        x = a << half | b
        if x < size:
            return x


def permuted(x: int, size: int, key: bytes) -> int:
    """A keyed bijection of range(size) without fixed points: a keyed step between a Feistel walk and its inverse."""
    if size < 2:
        return x
    step = 1 + int.from_bytes(hashlib.blake2b(b"step%d" % size, key=key[:64], digest_size=16).digest(), "big") % (size - 1)
    return feistel((feistel(x, size, key) + step) % size, size, key, back=True)


def remixed(chars: str, sets: list[str], key: bytes) -> str:
    """chars as a number of mixed radix, permuted; sets has each place's alphabet. What is longer than a PART goes part
    by part, each under a key that hangs on all parts before it."""
    if len(chars) > PART:
        out, seen, own = [], hashlib.blake2b(key=key[:64], digest_size=32), key
        for i in range(0, len(chars), PART):
            out.append(remixed(chars[i : i + PART], sets[i : i + PART], own))
            seen.update(chars[i : i + PART].encode())
            own = seen.digest()
        return "".join(out)
    x, size = 0, 1
    for c, s in zip(chars, sets, strict=True):
        x, size = x * len(s) + s.index(c), size * len(s)
    x, out = permuted(x, size, key), []
    for s in reversed(sets):
        x, i = divmod(x, len(s))
        out.append(s[i])
    return "".join(reversed(out))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def alphabet(c: str) -> str:
    return next((s for s in (DIGITS, LOWER, UPPER) if c in s), c)


def refill(value: str, chars: str) -> str:
    """value with its letters and digits replaced in turn; separators stay."""
    it = iter(chars)
    return "".join(next(it) if c in DIGITS or c.isalpha() else c for c in value)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def classes(value: str, key: bytes) -> str:
    """Every letter and digit moves within its class."""
    core = [c for c in value if alphabet(c) != c]
    it = iter(remixed("".join(core), [alphabet(c) for c in core], key))
    return "".join(next(it) if alphabet(c) != c else c for c in value)


def email(v: str, key: bytes) -> str | None:
    local, _, domain = v.rpartition("@")
    if not any(c.isalnum() for c in local):
        return None
    return classes(local, key + domain.lower().encode()[:24]) + "@" + domain


def ip(v: str, key: bytes) -> str | None:
    if ":" in v:
        return ip6(v, key)
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permuted(sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)), 1 << 32, key)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def ip6(v: str, key: bytes) -> str | None:
    """The first group says what sort of address it is, and stays. What could be a time or a scope of names is none."""
    try:
        x = int(ipaddress.IPv6Address(v))
    except ValueError:
        return None
    if x >> 112 < 0x1000:
        return None
    rest = 1 << 112
    return str(ipaddress.IPv6Address(x // rest * rest + permuted(x % rest, rest, key + b"%d" % (x // rest))))


def card(v: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", v)
    if not luhn(d) or len(set(d)) == 1:
        return None
    body = remixed(d[:-1], ["123456789" if d[0] != "0" else "0", *[DIGITS] * (len(d) - 2)], key)
    return refill(v, body + next(c for c in DIGITS if luhn(body + c)))


def iban(v: str, key: bytes) -> str | None:
    d = v.replace(" ", "")
    if not 15 <= len(d) <= 34 or mod97(d) != 1:
        return None
    body = remixed(d[4:], [alphabet(c) for c in d[4:]], key)
    return refill(v, d[:2] + f"{98 - mod97(d[:2] + '00' + body):02d}" + body)


def ssn(v: str, key: bytes) -> str | None:
    a, g, s = map(int, v.split("-"))
    if a in (0, 666) or a >= 900 or not g or not s:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    x, s = divmod(permuted(x, 898 * 99 * 9999, key), 9999)
    a, g = divmod(x, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def phone(v: str, key: bytes) -> str | None:
    """With a + the calling code stays, and the number is the same with and without separators."""
    d = re.sub(r"\D", "", v)
    code = m.group() if v[0] == "+" and (m := CALLING.match(d)) else ""
    d = d[len(code) :]
    if not 7 <= len(d) <= 13 or len(d) + len(code) + bool(code) < 10:
        return None
    if len(d) == 10 and code in ("", "1") and d[0] > "1" and d[3] > "1":
        sets = ["23456789", DIGITS, DIGITS, "23456789", *[DIGITS] * 6]
    else:
        sets = ["0" if d[0] == "0" else "123456789", *[DIGITS] * (len(d) - 1)]
    return refill(v, code + remixed(d, sets, key))


def date(v: str, key: bytes) -> str | None:
    """ISO, or day first, or month first where only that is valid; a date has one pseudonym in every notation."""
    n = [int(x) for x in re.split(r"[-./]", v)]
    iso = v[4:5] == "-"
    for order in ([(0, 1, 2)] if iso else [(2, 1, 0), (2, 0, 1)]):
        try:
            day = datetime.date(*(n[i] for i in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key))
        if iso:
            return new.isoformat()
        sep = re.search(r"[./]", v).group()
        two = [f"{new.day:02d}", f"{new.month:02d}"]
        return sep.join([*(two if order[1] == 1 else two[::-1]), f"{new.year:04d}"])
    return None


def secret(v: str, key: bytes) -> str | None:
    if v.startswith("AKIA"):
        return "AKIA" + remixed(v[4:], [UPPER + DIGITS] * 16, key)
    at = ASSIGNED.search(v).end()
    hexed = all(c in "0123456789abcdef" for c in v[at:])
    new = remixed(v[at:], ["0123456789abcdef"] * (len(v) - at), key) if hexed else classes(v[at:], key)
    return v[:at] + new


MAKERS: dict[str, Callable[[str, bytes], str | None]] = {
    "email": email, "ip": ip, "card": card, "iban": iban, "ssn": ssn, "phone": phone, "date": date, "secret": secret,
}


def pseudonymised(text: str, key: bytes, make: Callable | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """The new text, and (kind, start, end) of each value in the old one."""
    make = make or (lambda kind, v: MAKERS[kind](v, hashlib.blake2b(kind.encode(), key=key[:64]).digest()[:32]))
    out, at, spans = [], 0, []
    pos = 0 if HINT.search(text) else len(text)
    while found := PATTERN.search(text, pos):
        start, kinds = found.start(), KINDS[KINDS.index(found.lastgroup) :]
        valid = ((k, m, new) for k in kinds if (m := EACH[k].match(text, start)) and (new := make(k, m.group())) not in (None, m.group()))
        kind, m, new = next(valid, (None, found, ""))
        if kind is None:
            # What follows in the same word can't begin a value, what follows that can.
            pos = max(start + 1, min(RUN.match(text, start).end(), found.end()))
            continue
        out += [text[at:start], new]
        at = pos = m.end()
        spans.append((kind, start, m.end()))
    return "".join([*out, text[at:]]), spans


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def pseudonymise(df: DataFrame, key: bytes = DEMO_KEY, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """df with the text column pseudonymised and a column of spans in the old text. One pass, no shuffle."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != spans), T.StructField(spans, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {k: hashlib.blake2b(k.encode(), key=key[:64]).digest()[:32] for k in KINDS}
        make = lru_cache(200_000)(lambda kind, v: MAKERS[kind](v, keys[kind]))
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                done = [(None, []) if x is None else pseudonymised(x, key, make) for x in part[text].to_pylist()]
                own = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done], SPANS_ARROW)
                cols = {n: part[n] for n in part.schema.names if n != spans} | {text: pa.array([x for x, _ in done], pa.string()), spans: own}
                yield pa.RecordBatch.from_pydict({f.name: cols[f.name] for f in schema})

    return df.mapInArrow(lean(run), schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, and how many values of each kind it had."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return pseudonymise(docs).select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_values"), *map(of, KINDS))
