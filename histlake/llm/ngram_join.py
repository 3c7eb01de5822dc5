"""N-gram Jaccard self-join by prefix trees (operator 10).

A document's set is its distinct five-word shingles (ASCII letters lower-cased; a shorter text is one shingle, its
whole sequence). Two documents link when 100 * intersection >= 75 * union.

1. Each set gets a hash of its own; equal sets are one set from there on. A fixed-size count sketch over all
   shingles of all documents gives the global order of shingles: rare classes first, then by hash. Tasks' sketches are
   added up in a tree.
2. A set of n shingles that links to any other shares one of its n - ceil(0.75 n) + 1 first with it (prefix filter), so
   only these are dealt out, packed, by shingle; entries of a shingle that the sketch knows as common go in several
   parts. What only one set has is dropped at once.
3. Under each shingle, each set is paired with the set before it and with a few hubs, and hubs of several parts with
   each other. Pairs that come under enough shingles are verified first and joined, so a large group of near copies
   collapses without all its pairs. What is left are shingles whose sets are in several groups. Under those that many
   sets have, each set's nearest of another group by bitmap follows; then all pairs of sets of different groups that
   pass the bounds of their lengths, bitmaps and shared prefix are verified; pairs inside a group add no link between
   groups. Sets under one shingle meet in cells of bounded size: those of the largest group are dealt out once, all
   others go to each of its cells and, in blocks, meet each other.
4. Verification stores the partners' whole ordered sets in a prefix tree, walks it with the probing set, shares the
   overlap of common beginnings, and prunes subtrees that remaining lengths rule out. Partners of a hub come in parts.
5. Verified links give components: in one task if few edges are left of tasks' forests, else by star contraction.

Shingles are compared as 64-bit hashes. Defined results: null, empty and blank texts have empty sets, link with
nothing and are components of their own; repeated rows and copies each keep their row; a row without an id links like
any other and may stand between two that have one, but names no component (where no other row of its component has an
id, component_id is null). Texts and groups may be of any size. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from histlake.llm.common import lean, small, table, trim, written
from histlake.llm.components import components

WIDTH, NUMER, DENOM = 5, 75, 100
#: The count sketch: so many cells in slices, whatever the input (2 MB from each task).
CELL_BITS, SLICES = 20, 16
#: Sets that every other set under a shingle is paired with at first.
HUBS = 3
#: Sets under a shingle from which bitmaps are compared.
MANY = 32
#: Rounds in which sets under common shingles are paired with their nearest only, before all pairs that may link.
NEAREST_ROUNDS = 1
#: Pairs that a task sums up before it hands them on.
PAIR_ROWS = 150_000
#: Bytes of packed prefix entries that one reducing task gets, and entries of one shingle from which it goes in parts.
BUCKET_BYTES, PART_ROWS = 4 << 20, 200_000
#: Sketches that are added up at a time; sets of one group that meet in a cell; partners of one set in a part.
FAN_IN, CELL_ROWS, PARTNERS = 64, 512, 2000
#: Bytes of partners' sets in one prefix tree.
TREE_BYTES = 16 << 20
#: Bytes from which a word is hashed by itself.
LONG_WORD = 256
#: Stands for a null doc_id on the way through Python.
NOBODY = -(1 << 63)
ENTRY = np.dtype([("token", "<u8"), ("sid", "<i8"), ("n", "<u4")])
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GAPS = np.isin(np.arange(256), [32, *range(9, 14)])
#: Which bits of eight bytes are a word's own, by how many bytes of it are left.
OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text's bytes begins, and a 64-bit hash of it: eight bytes at a time of all words together,
    mixed in between. Words of one length up to eight bytes never share one; LONG_WORD bytes and more are hashed one by
    one."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[True, GAPS[raw], True]))
    starts, ends = edges[::2], edges[1::2]
    n = ends - starts
    # The eight bytes from each place on.
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    h = mixed((eight[starts] & OWN[np.minimum(n, 8)]) * MULT[0] + n.astype(np.uint64) * MULT[1])
    left, at = np.flatnonzero((n > 8) & (n < LONG_WORD)), 8
    while len(left):
        own = eight[starts[left] + at] & OWN[np.minimum(n[left] - at, 8)]
        h[left] = mixed((h[left] ^ own) * MULT[2] + np.uint64(at))
        at += 8
        left = left[n[left] > at]
    for i in np.flatnonzero(n >= LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return starts, h


def set_hashes(texts) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles. Words and shingles of all texts are hashed together."""
    data = [x.encode("utf-8", "surrogatepass").lower() if isinstance(x, str) else b"" for x in texts]
    starts, w = word_hashes(b" ".join(data))
    edges = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in data)])).tolist()
    # Hashes of words are as good as random, so a sum with odd factors parts sequences; what runs over texts is not read.
    n = max(0, len(w) - WIDTH + 1)
    h = np.full(n, WIDTH, np.uint64)
    for i in range(WIDTH):
        h += w[i : n + i] * MULT[i]
    h, out = mixed(h), []
    for a, b in zip(edges, edges[1:]):
        if b - a >= WIDTH:
            own = np.sort(h[a : b - WIDTH + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            out.append(mixed((w[a:b] * MULT[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def shingle_hashes(text: str | None) -> np.ndarray:
    return set_hashes([text])[0]


def bitmap(h: np.ndarray) -> bytes:
    """A set as the parity of how many of its shingles fall on each of 1,024 bits."""
    bits = np.bincount((h & np.uint64(1023)).astype(np.int64), minlength=1024).astype(np.uint8) & 1
    return np.packbits(bits).tobytes()


def set_id(h: np.ndarray) -> int:
    """A hash of a whole set, as a signed 64-bit number."""
    both = np.array([h.sum(dtype=np.uint64) + np.uint64(len(h)), np.bitwise_xor.reduce(h)], np.uint64)
    return int(mixed(mixed(both[:1]) + both[1:]).view(np.int64)[0])


def prefix_length(n):
    return n - -(-NUMER * n // DENOM) + 1


def needed(a, b):
    """Least overlap with which sets of these sizes link."""
    return -(-NUMER * (a + b) // (DENOM + NUMER))


def slices(batches: Iterator[pd.DataFrame], rows: int = 200) -> Iterator[pd.DataFrame]:
    """The same rows, few at a time, so that long texts' sets don't pile up."""
    for pdf in batches:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i : i + rows].reset_index(drop=True)


def surveyed(docs: DataFrame) -> DataFrame:
    """Each document's n, sid and bitmap, and each task's slices of the count sketch, in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for pdf in slices(batches):
            sets = set_hashes(pdf["text"])
            places, times = np.unique(np.concatenate(sets) >> np.uint64(64 - CELL_BITS), return_counts=True)
            cells[places.astype(np.int64)] += times
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(s) for s in sets], "sid": pd.Series([set_id(s) if len(s) else None for s in sets], dtype="Int64"), "bits": [bitmap(s) if len(s) else None for s in sets], "slice": pd.Series([None] * len(sets), dtype="Int32"), "cells": pd.Series([None] * len(sets), dtype=object)})
        parts = np.minimum(cells, 65535).astype("<u2").reshape(SLICES, -1)
        if cells.any():
            yield pd.DataFrame({"doc_id": NOBODY, "n": TaskContext.get().partitionId(), "sid": pd.Series([None] * SLICES, dtype="Int64"), "bits": None, "slice": pd.Series(range(SLICES), dtype="Int32"), "cells": [p.tobytes() for p in parts]})

    # A column with nulls would come as floats, which can't hold large ids.
    out = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc_id"), "text").mapInPandas(lean(run), "doc_id long, n long, sid long, bits binary, slice int, cells binary")
    return written(out.withColumn("doc_id", F.nullif("doc_id", F.lit(NOBODY))), "survey")


def rarity(survey: DataFrame) -> tuple[np.ndarray, float]:
    """The class of each cell of the sketch: 0, or by how many doublings its count is beyond what chance explains; and
    the count that chance explains at most."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8" if wide else "<u2").astype(np.int64) for x, wide in zip(pdf["cells"], pdf["wide"], strict=True))
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [pdf["above"].iloc[0]], "cells": [total.tobytes()], "wide": [True]})

    sums = survey.filter("slice is not null").select("slice", F.col("n").alias("part"), "cells", F.lit(False).alias("wide"))
    most = sums.agg(F.max("part")).first()[0] or 0
    while True:
        sums = sums.withColumn("above", F.floor(F.col("part") / FAN_IN)).groupBy("slice", "above").applyInPandas(add, "slice int, part long, cells binary, wide boolean")
        if most < FAN_IN:
            break
        most //= FAN_IN
    cells = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), np.int64)
    for r in sums.collect():  # a row for each slice
        cells[r["slice"]] = np.frombuffer(r["cells"], np.int64)
    mean = cells.mean()
    most = mean + 8 * np.sqrt(mean) + 32
    return np.where(cells > most, 1 + np.log2(np.maximum(cells / most, 1)), 0).astype(np.uint8).ravel(), float(most)


def parts_by_class(most: float, highest: int) -> np.ndarray:
    """In how many parts the entries of a shingle go, by its class; classes end at the highest."""
    known = np.arange(highest + 1)
    return np.where(known > 0, np.maximum(1, most * 2.0**known // PART_ROWS), 1).astype(np.uint64)


def ordered(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set in the global order: class, then hash. The key keeps 58 bits of the hash."""
    c = classes[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort(c << np.uint64(58) | h >> np.uint64(6))


def prefixes(docs: DataFrame, classes, buckets: int, parts: np.ndarray) -> DataFrame:
    """(bucket, packed entries) of all sets' prefixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, held, size = set(), [], 0

        def packed() -> pd.DataFrame:
            e = np.concatenate(held)
            part = mixed(e["sid"].astype(np.uint64)) % parts[(e["token"] >> np.uint64(58)).astype(np.int64)]
            b = ((e["token"] + part) % np.uint64(buckets)).astype(np.int64)
            e = e[np.argsort(b, kind="stable")]
            ends = np.cumsum(np.bincount(b, minlength=buckets))
            return pd.DataFrame([(i, p.tobytes()) for i, p in enumerate(np.split(e, ends[:-1])) if len(p)], columns=["bucket", "entries"]).astype({"bucket": "int32"})

        for pdf in slices(batches):
            for h in set_hashes(pdf["text"]):
                if not len(h) or (sid := set_id(h)) in seen:
                    continue
                seen.add(sid)
                e = np.empty(prefix_length(len(h)), ENTRY)
                e["token"], e["sid"], e["n"] = ordered(h, classes.value)[: len(e)], sid, len(h)
                held.append(e)
                size += e.nbytes
                if size > BUCKET_BYTES:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return docs.select("text").mapInPandas(lean(run), "bucket int, entries binary")


def summed(a, b, na, nb) -> pd.DataFrame:
    """Pairs with how often each came."""
    return pd.DataFrame({"a": a, "b": b, "na": na, "nb": nb}).groupby(["a", "b", "na", "nb"], sort=False).size().reset_index(name="c")


def close_pairs(token, sid, n) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in order of (token, n, sid): pairs that connect them (each set with the one before it and with the
    first few under the shingle that are not too short; for a group of near copies these are the same few under most
    shingles, so their counts add up), which entries are in any, and which are first of their shingle's lengths."""
    at = np.arange(len(token))
    first = np.maximum.accumulate(np.where(np.r_[True, token[1:] != token[:-1]], at, 0)) if len(at) else at
    pairs, on, hub = [np.zeros((2, 0), np.int64)], np.zeros(len(at), bool), np.zeros(len(at), bool)
    hubs = first.copy()
    while (short := n[hubs] * DENOM < NUMER * n).any():
        hubs[short] += 1
    for other in (at - 1, *(hubs + k for k in range(HUBS))):
        i = np.flatnonzero((other >= first) & (other < at))
        i = i[n[other[i]] * DENOM >= NUMER * n[i]]
        pairs.append(np.stack([other[i], i]))
        on[i] = on[other[i]] = True
    hub[np.unique(hubs)] = True
    lo, hi = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return lo, hi, on, hub


RUNS = "a long, b long, na long, nb long, c long, token long"
#: What a row of runs is, by its c: an entry, a hub of a part, or a pair that came c times.
ENTRY_ROW, HUB_ROW = 0, -1


def runs_of(parts: np.ndarray):
    """A bucket's shingles that two sets or more have (or one, where they go in parts): their entries, and pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in pdf["entries"]])
        e = e[np.lexsort((e["sid"], e["n"], e["token"]))]
        e = e[np.r_[True, (e["token"][1:] != e["token"][:-1]) | (e["sid"][1:] != e["sid"][:-1])]]
        n = e["n"].astype(np.int64)
        lo, hi, on, hub = close_pairs(e["token"], e["sid"], n)
        pairs = summed(e["sid"][lo], e["sid"][hi], n[lo], n[hi])
        pairs["token"] = 0
        split = parts[(e["token"] >> np.uint64(58)).astype(np.int64)] > 1
        named = lambda keep, c: pd.DataFrame({"a": e["sid"][keep], "b": 0, "na": n[keep], "nb": 0, "c": c, "token": np.ascontiguousarray(e["token"][keep]).view(np.int64)})
        out = pd.concat([named(on | split, ENTRY_ROW), named(hub & split, HUB_ROW), pairs])[["a", "b", "na", "nb", "c", "token"]]
        trim()
        return out

    return run


def hub_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of hubs of one shingle's parts. They are few, and where one pair links, so do the parts."""
    pdf = pdf.sort_values(["na", "a"])
    sid, n = pdf["a"].to_numpy(), pdf["na"].to_numpy()
    lo, hi, _, _ = close_pairs(pdf["token"].to_numpy(), sid, n)
    return pd.DataFrame({"a": sid[lo], "b": sid[hi]}).astype("int64")


def promising(pairs: DataFrame) -> DataFrame:
    """Sums pairs' counts and keeps what the shared prefix doesn't rule out: c shared shingles there and the rest of
    either set beyond its prefix must make the needed overlap. na <= nb."""
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    ceil = lambda x, y: F.floor((x + (y - 1)) / F.lit(y))
    rest = ceil(NUMER * F.col("nb"), DENOM) - 1
    return pairs.filter(F.col("c") + rest >= ceil(NUMER * (F.col("na") + F.col("nb")), DENOM + NUMER)).select("a", "b")


class Node:
    __slots__ = ("children", "depth", "ends", "keys", "least", "most")


class Tree:
    """A prefix tree of ordered sets; a node holds a stretch of keys that all sets below share. Neither making nor
    walking it recurs, so sets may part at any number of places."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        """sets: (name, keys), sorted by keys."""
        sizes = np.array([len(s) for _, s in sets])
        self.root, todo = Node(), []
        todo.append((self.root, 0, len(sets), 0))
        while todo:
            node, lo, hi, depth = todo.pop()
            first, last = sets[lo][1], sets[hi - 1][1]
            k = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:k] != last[depth:k])
            end = depth + int(differ[0]) if len(differ) else k
            node.keys, node.depth, node.children = first[depth:end], end, []
            node.least, node.most = int(sizes[lo:hi].min()), int(sizes[lo:hi].max())
            # Sets that end here come first in order.
            ended = lo + int((sizes[lo:hi] == end).sum())
            node.ends = [name for name, _ in sets[lo:ended]]
            while ended < hi:
                key, stop = sets[ended][1][end], ended + 1
                while stop < hi and sets[stop][1][end] == key:
                    stop += 1
                node.children.append(child := Node())
                todo.append((child, ended, stop, end))
                ended = stop

    def walk(self, probe: np.ndarray) -> Iterator[int]:
        """Names of sets that link to probe. Of each node on the way: what the path so far has used and shared."""
        todo = [(self.root, 0, 0)]
        while todo:
            node, at, overlap = todo.pop()
            if len(node.keys):
                pos = np.searchsorted(probe[at:], node.keys)
                inside = pos < len(probe) - at
                overlap += int((probe[at:][pos[inside]] == node.keys[inside]).sum())
                at += int(np.searchsorted(probe[at:], node.keys[-1], side="right"))
            left = len(probe) - at
            if overlap + min(left, node.most - node.depth) < needed(len(probe), node.least):
                continue
            if node.ends and overlap >= needed(len(probe), node.depth):
                yield from node.ends
            todo += [(child, at, overlap) for child in node.children]


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (a, part, own): of each part of a's partners its own set, then theirs (own is 1), up to a bound at
    a time."""
    key, probe, partners, size = None, None, [], 0

    def links() -> pd.DataFrame:
        tree = Tree(sorted(partners, key=lambda x: x[1].astype(">u8").tobytes()))
        return pd.DataFrame([(key[0], b) for b in tree.walk(probe)], columns=["u", "v"]).astype("int64")

    for pdf in batches:
        for a, part, b, own, keys in zip(pdf["a"], pdf["part"], pdf["b"], pdf["own"], pdf["keys"], strict=True):
            if partners and ((a, part) != key or size >= TREE_BYTES):
                yield links()
                partners, size = [], 0
            if not own:
                key, probe = (a, part), np.frombuffer(keys, "<u8")
            elif (a, part) != key:
                raise RuntimeError(f"set {a} was not found")
            else:
                partners.append((int(b), np.frombuffer(keys, "<u8")))
                size += len(keys)
    if partners:
        yield links()


def sets_of(docs: DataFrame, survey: DataFrame, wanted: DataFrame, classes) -> DataFrame:
    """sid and ordered keys of wanted sets, made anew from a row that has them."""
    one = written(survey.filter("sid is not null").join(small(wanted), "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "wanted")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for pdf in slices(batches):
            # Rows that repeat an id may hold other texts; the set's hash tells them apart.
            asked = pdf["sid"] if "sid" in pdf else [None] * len(pdf)
            keys = [(s, h) for a, h in zip(asked, set_hashes(pdf["text"]), strict=True) if len(h) and (s := set_id(h)) not in done and a in (None, s) and not done.add(s)]
            yield pd.DataFrame({"sid": [s for s, _ in keys], "keys": [ordered(h, classes.value).tobytes() for _, h in keys]}).astype({"sid": "int64"})

    made = lambda df: df.mapInPandas(lean(sets), "sid long, keys binary")
    held = made(docs.select("doc_id", "text").join(small(one.filter("doc_id is not null")), "doc_id").select("sid", "text"))
    lone = one.filter("doc_id is null").select("sid")
    if lone.isEmpty():
        return held
    # Sets that only rows without an id have are found among those.
    return held.unionByName(made(docs.filter("doc_id is null").select("text")).join(small(lone), "sid", "left_semi").dropDuplicates(["sid"]))


def verify(docs: DataFrame, survey: DataFrame, pairs: DataFrame, classes) -> DataFrame:
    """Of pairs (a, b) of sets those that link, as (u, v)."""
    pairs = written(pairs, "pairs")
    held = sets_of(docs, survey, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), classes)
    # Partners of a hub are dealt out in parts, each with the hub's set.
    hot = written(pairs.groupBy("a").count().filter(F.col("count") > PARTNERS), "hot")
    part = F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("count") / PARTNERS), F.lit(1)))
    pairs = pairs.join(small(hot), "a", "left").select("a", "b", part.alias("part"))
    # A set goes to each pair it is the partner in, and once to each part that it probes; it is made once for all.
    roles = pairs.select(F.col("b").alias("sid"), "a", "part", F.lit(1).alias("own")).union(pairs.select("a", "a", "part", F.lit(0)).distinct())
    dealt = held.join(small(written(roles, "roles")), "sid").select("a", "part", F.col("sid").alias("b"), "own", "keys")
    return dealt.repartition("a", "part").sortWithinPartitions("a", "part", "own", "b").mapInPandas(lean(verified), "u long, v long")


def cross_pairs(e: pd.DataFrame, nearest: bool) -> Iterator[pd.DataFrame]:
    """Pairs of different groups in one cell whose lengths, and bitmaps if there are any, allow a link: all, or for each
    set (one) only that with the least differing bitmap. e is sorted by cell and n."""
    n, sid, group, side = (e[c].to_numpy() for c in ("na", "a", "label", "side"))
    token = cells_of(e)
    free = ((e["kind"] == WHOLE) | ((e["kind"] == BLOCKS) & (e["lo"] == e["hi"]))).to_numpy()
    bits = np.frombuffer(b"".join(e["bits"]), np.uint64).reshape(len(e), -1) if "bits" in e else None
    out, size, k, live = [], 0, 0, np.arange(len(e))
    best, least = np.full(len(e), -1), np.full(len(e), np.inf)

    def packed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        swap = (n[i] == n[j]) & (sid[i] > sid[j])
        return np.stack([np.where(swap, sid[j], sid[i]), np.where(swap, sid[i], sid[j]), n[i], n[j]])

    # Shift by shift: element i with element i + k, while any such pair is in one cell.
    while len(live):
        k += 1
        live = live[live + k < len(e)]
        live = live[(token[live] == token[live + k]) & (n[live] * DENOM >= NUMER * n[live + k])]
        i = live[(group[live] != group[live + k]) & (free[live] | (side[live] != side[live + k]))]
        if bits is not None:
            # Sets whose parities differ on d bits have at most (a + b - d) / 2 in common.
            apart = np.concatenate([np.bitwise_count(bits[j] ^ bits[j + k]).sum(axis=1, dtype=np.int64) for j in np.array_split(i, len(i) // 50_000 + 1)])
            near = 2 * needed(n[i], n[i + k]) <= n[i] + n[i + k] - apart
            i, apart = i[near], apart[near] / (n[i] + n[i + k])[near]
        if nearest:
            for one, other in ((i, i + k), (i + k, i)):
                closer = apart < least[one]
                best[one[closer]], least[one[closer]] = other[closer], apart[closer]
            continue
        out.append(packed(i, i + k))
        size += len(i)
        if size > PAIR_ROWS:
            yield summed(*np.concatenate(out, axis=1))
            out, size = [], 0
    if nearest:
        i = np.flatnonzero(best >= 0)
        a, b, na, nb = packed(np.minimum(i, best[i]), np.maximum(i, best[i]))
        # Here c is how far apart they are, in millionths.
        yield pd.DataFrame({"one": sid[i], "a": a, "b": b, "na": na, "nb": nb, "c": (least[i] * 1e6).astype(np.int64)})
        return
    if size:
        yield summed(*np.concatenate(out, axis=1))


#: Kinds of cells: all sets of a shingle; a part of its largest group, with all others; two blocks of others.
WHOLE, LARGEST, BLOCKS = 2, 0, 1
CELL = ("token", "kind", "lo", "hi")


def cells_of(e: pd.DataFrame) -> np.ndarray:
    """A number of each row's cell, in rows sorted by cell."""
    key = e[list(CELL)].to_numpy()
    return np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])


def celled(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """Entries of shingles in stats (total, and the label and size of the largest group), dealt to cells of at most some
    CELL_ROWS of a side; side tells the two sides of a cell apart. Any two entries of different groups meet in one cell."""
    count = lambda n: F.greatest(F.ceil(n / CELL_ROWS), F.lit(1))
    cell = lambda kind, lo, hi, side: F.struct(F.lit(kind).alias("kind"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), side.cast("int").alias("side"))
    zero, h = F.lit(0), F.xxhash64("a")
    large, blocks = count(F.col("top.n")), count(F.col("total") - F.col("top.n"))
    own = F.pmod(h, blocks)
    others = F.concat(
        F.transform(F.sequence(zero.cast("long"), large - 1), lambda i: cell(LARGEST, i, zero, F.lit(1))),
        F.transform(F.sequence(zero.cast("long"), blocks - 1), lambda i: cell(BLOCKS, F.least(own, i), F.greatest(own, i), own > i)),
    )
    cells = F.when(F.col("total") <= 2 * CELL_ROWS, F.array(cell(WHOLE, zero, zero, zero))).when(F.col("label") == F.col("top.label"), F.array(cell(LARGEST, F.pmod(h, large), zero, zero))).otherwise(others)
    return entries.join(stats, "token").select(*entries.columns, F.explode(cells).alias("cell")).select(*entries.columns, "cell.*")


def crossing(nearest: bool = False):
    """cross_pairs of batches of entries sorted by cell and n; a cell's entries may go over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for pdf in batches:
            held = pd.concat([held, pdf])
            if not len(held):
                continue
            whole = (held[list(CELL)] != held[list(CELL)].iloc[-1]).any(axis=1)
            if whole.any():
                yield from cross_pairs(held[whole], nearest)
                held = held[~whole]
        if len(held):
            yield from cross_pairs(held, nearest)

    return run


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    spark = docs.sparkSession
    survey = surveyed(docs)
    found, most = rarity(survey)
    classes, parts = spark.sparkContext.broadcast(found), parts_by_class(most, int(found.max()))
    people = survey.filter("slice is null").drop("slice", "cells")
    total = people.agg(F.sum(F.floor(F.col("n") * (DENOM - NUMER) / DENOM) + 1)).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total * ENTRY.itemsize // BUCKET_BYTES)
    runs = written(prefixes(docs, classes, buckets, parts).groupBy("bucket").applyInPandas(runs_of(parts), RUNS), "runs")
    pairs = promising(runs.filter("c > 0"))
    if (parts > 1).any():
        pairs = pairs.union(runs.filter(F.col("c") == HUB_ROW).groupBy("token").applyInPandas(hub_pairs, "a long, b long")).distinct()
    links = written(verify(docs, people, pairs, classes), "links")
    bits = people.filter("sid is not null").groupBy("sid").agg(F.first("bits").alias("bits")).withColumnRenamed("sid", "a")
    entries = runs.filter(F.col("c") == ENTRY_ROW).select("token", "na", "a")

    def named(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries with their groups, and the shingles whose sets are in several. Sums by group come first, so a hot
        shingle is some rows there."""
        own = entries.join(small(groups), F.col("a") == F.col("vertex"), "left").select("token", "na", "a", F.coalesce("component", "a").alias("label"))
        sums = own.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token")
        stats = sums.agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("top")).filter("total > top.n")
        return own, written(stats, "mixed")

    def across(own: DataFrame, stats: DataFrame, many: bool, nearest: bool = False) -> DataFrame:
        """Pairs under shingles that few sets have, or many; those by bitmaps."""
        stats = stats.filter(F.col("total") >= MANY if many else F.col("total") < MANY)
        dealt = celled(own, small(stats, 200_000))
        dealt = (dealt.join(bits, "a") if many else dealt).repartition(*CELL).sortWithinPartitions(*CELL, "na", "a")
        return dealt.mapInPandas(lean(crossing(nearest)), "one long, " * nearest + "a long, b long, na long, nb long, c long")

    groups = written(components(links), "groups")
    for _ in range(NEAREST_ROUNDS):
        # Each set's nearest of another group: one pair for each set, so most groups that link are joined here.
        best = across(*named(groups), many=True, nearest=True).groupBy("one").agg(F.min_by(F.struct("a", "b"), F.struct("c", "a", "b")).alias("p"))
        more = written(verify(docs, people, best.select("p.*").distinct(), classes), "links")
        links = links.union(more)
        groups = written(components(links), "groups")
    own, stats = named(groups)
    rest = across(own, stats, many=False).union(across(own, stats, many=True))
    whole = components(links.union(written(verify(docs, people, promising(rest), classes), "links"))).withColumnRenamed("vertex", "sid")
    # The component's name is its smallest doc_id. Sums by set come first, so a hot set is one row there.
    least = people.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = least.join(whole, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(names, "component").select("sid", "component_id")
    out = people.join(by_set, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - {WIDTH - 1}, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + {WIDTH - 1}), ' '))) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DENOM} * o >= {NUMER} * (x.n + y.n - o)),
c AS (SELECT doc_id AS v, doc_id AS r FROM w UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.v WHERE c.r < e.b)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(r) AS m FROM c GROUP BY v) ON v = w.doc_id
"""
