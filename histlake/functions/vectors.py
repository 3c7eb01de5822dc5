"""Vector functions: native dot products, scores, and pluggable embedders."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from histlake.schema import VECTOR_SIZE

Encode = Callable[[Sequence[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; of unit vectors it is the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def distance_score(d: Column) -> Column:
    """Cosine of unit vectors from their distance, kept within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d * d / 2))


def hash_encode(texts: Sequence[str]) -> np.ndarray:
    """A deterministic stand-in for a language model: 16 bytes of SHA-256, repeated to full size, of length one."""
    raw = np.array([np.frombuffer(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16], np.uint8) for t in texts], np.float32).reshape(-1, 16) - 128
    v = np.tile(raw, VECTOR_SIZE // 16)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def embedder(load: Callable[[], Encode] = lambda: hash_encode, batch: int = 64):
    """A column function for a model that each worker loads once; rows are encoded in batches."""
    box: list[Encode] = []

    @F.arrow_udf(T.ArrayType(T.FloatType(), False))
    def embedded(texts: pa.Array) -> pa.Array:
        if not box:
            box.append(load())
        given = [t or "" for t in texts.to_pylist()]
        parts = [np.asarray(box[0](given[i : i + batch]), np.float32) for i in range(0, len(given), batch)]
        # From matrices to a column without an object for each row.
        ends = np.cumsum([0, *(p.shape[1] for p in parts for _ in range(len(p)))], dtype=np.int32)
        flat = np.concatenate([p.ravel() for p in parts]) if parts else np.empty(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return embedded


class CachedEncoder:
    """Remembers the vectors of the last queries, on the driver; 0 remembers none."""

    def __init__(self, encode: Encode, size: int = 0):
        self.encode, self.size, self.held = encode, size, OrderedDict()

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        if not self.size:
            return self.encode(texts)
        known = {}
        for t in dict.fromkeys(texts):
            if t in self.held:
                self.held.move_to_end(t)
                known[t] = self.held[t]
        if new := [t for t in dict.fromkeys(texts) if t not in known]:
            known |= dict(zip(new, self.encode(new), strict=True))
            for t in new:
                self.held[t] = known[t]
                while len(self.held) > self.size:
                    self.held.popitem(last=False)
        return np.array([known[t] for t in texts])
