"""The store of commands: Parquet generations, vectors and postings beside them, and numbered manifests.

Each load writes its rows, vectors and postings as files of a new batch and then publishes the next manifest; readers
take the batches that the latest manifest names, so half a load is never seen and a lost task's files are never read.
A manifest's number is in its name, and a name that exists is never replaced: of two loads at once the later finds its
number taken, and drops what is known, numbers and publishes anew on top of the other's batch.
"""

from __future__ import annotations

import json
import os
import secrets
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from histlake.functions.hashing import salted_hash
from histlake.functions.redact import redact
from histlake.functions.vectors import embedder
from histlake.functions.texts import slices, tokens_of
from histlake.operators import ingest
from histlake.operators.numbering import dense
from histlake.schema import COMMANDS, POSTINGS, SCHEMA_VERSION, VECTORS
from histlake.scratch import clearing, delete
from histlake.shipping import ship

MODEL = ("hash-384", "1")
#: Manifests that stay for readers that have just chosen one, and how often a load starts over behind another.
KEPT_MANIFESTS, ATTEMPTS = 20, 10


class Conflict(RuntimeError):
    """Another writer has published since this one read."""


@dataclass
class LoadResult:
    inserted: int = 0
    skipped_dedup: int = 0
    by_source: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0


def postings_of(rows: DataFrame) -> DataFrame:
    """term, id and tf; a command's terms are counted where it is, so none is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for part in slices(texts):
                counts = [(i, Counter(tokens_of(t))) for i, t in zip(ids[part], texts[part], strict=True) if t]
                rows = [(t, i, n) for i, c in counts for t, n in c.items()]
                columns = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=POSTINGS.names)

    return rows.select("id", "text_scrubbed").mapInArrow(run, POSTINGS)


class Store:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, embed=None, model: tuple[str, str] = MODEL):
        ship(spark)
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.embed = embed or embedder()
        meta = self.meta()
        if (version := meta.get("schema_version", SCHEMA_VERSION)) > SCHEMA_VERSION:
            raise ValueError(f"store has schema version {version}; this code knows {SCHEMA_VERSION}")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/meta-*.json")
        return sorted(int(x.getPath().getName()[5:-5]) for x in fs.globStatus(p) or [])

    def _manifest(self, version: int) -> str:
        return f"{self.path}/meta-{version:012d}.json"

    def meta(self) -> dict:
        """The latest manifest."""
        if not (known := self.versions()):
            return {"version": 0, "schema_version": SCHEMA_VERSION, "salt": None, "salt_version": 0, "batches": [], "last_id": 0, "cursors": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self._manifest(known[-1])).collect()))

    def put_meta(self, meta: dict) -> None:
        """Publishes what was made from a manifest as the next one. Raises Conflict if that is there already."""
        fs, part = self._fs(f"{self.path}/part-{uuid.uuid4().hex}")
        fs.mkdirs(self._fs(self.path)[1])
        version = meta["version"] + 1
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(meta | {"version": version}).encode()))
        out.close()
        to = self._fs(self._manifest(version))[1]
        try:
            if fs.getUri().getScheme() == "file":
                # A local rename replaces; a link does not.
                os.link(part.toUri().getPath(), to.toUri().getPath())
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(fs.makeQualified(part), fs.makeQualified(to), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if fs.exists(to):
                raise Conflict(f"manifest {version} of {self.path} was published by another writer") from e
            raise
        finally:
            fs.delete(part, False)
        for old in self.versions()[:-KEPT_MANIFESTS]:
            fs.delete(self._fs(self._manifest(old))[1], False)

    def update(self, change: Callable[[dict], dict]) -> dict:
        """Publishes change of the latest manifest, of a later one if others come between."""
        for _ in range(ATTEMPTS):
            meta = self.meta()
            try:
                self.put_meta(new := meta | change(meta))
            except Conflict:
                continue
            return new
        raise Conflict(f"{self.path} changes too often")

    def salt(self) -> bytes:
        """32 random bytes, made once."""
        meta = self.meta()
        if not meta["salt"]:
            made = {"salt": secrets.token_hex(32), "salt_version": 1}
            meta = self.update(lambda m: {} if m["salt"] else made)
        return bytes.fromhex(meta["salt"])

    def rotate_salt(self, rebuild: bool = False) -> int:
        """A new salt. Old hashes would no longer meet new ones, so rows go with it, in one step."""
        if not rebuild:
            raise ValueError("a new salt needs a rebuild")
        return self.update(lambda m: {"batches": [], "cursors": {}, "salt": secrets.token_hex(32), "salt_version": m["salt_version"] + 1})["salt_version"]

    def rebuild(self) -> None:
        """Drops rows, vectors and cursors; salt and other meta stay."""
        self.update(lambda m: {"batches": [], "cursors": {}})

    def _read(self, kind: str, schema, meta: dict | None = None) -> DataFrame:
        paths = [f"{self.path}/{kind}/{b}" for b in (meta or self.meta())["batches"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commands(self) -> DataFrame:
        return self._read("commands", COMMANDS)

    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS)

    def postings(self) -> DataFrame:
        """term, id and tf of all commands; each load adds those of its own."""
        return self._read("postings", POSTINGS)

    def load(self, entries: list[DataFrame]) -> LoadResult:
        """Redacts, hashes, drops what is known or repeated, numbers, embeds and publishes, then moves the cursors."""
        began, salt, staged = time.perf_counter(), self.salt(), f"{self.path}/staged/{uuid.uuid4().hex}"
        rows = ingest.hashed(ingest.concatenated(entries), redact, salted_hash(salt))
        rows.write.parquet(staged)
        rows = self.spark.read.schema(rows.schema).parquet(staged)
        try:
            for _ in range(ATTEMPTS):
                meta, batch = self.meta(), uuid.uuid4().hex
                if meta["salt"] != salt.hex():
                    raise Conflict(f"the salt of {self.path} was changed during a load")
                try:
                    return self._add(rows, meta, batch, began)
                except Conflict:
                    for kind in ("commands", "vectors", "postings"):
                        delete(self.spark, f"{self.path}/{kind}/{batch}")
            raise Conflict(f"{self.path} changes too often")
        finally:
            delete(self.spark, staged)

    def _add(self, rows: DataFrame, meta: dict, batch: str, began: float) -> LoadResult:
        """Writes what a manifest's batches don't have as a batch, and publishes it."""
        with clearing(self.spark):
            new = ingest.unknown(ingest.first_of_each(rows), self._read("commands", COMMANDS, meta))
            new = ingest.numbered_after(new, meta["last_id"]).select([f.name for f in COMMANDS])
            new.write.parquet(f"{self.path}/commands/{batch}")
        new = self.spark.read.schema(COMMANDS).parquet(f"{self.path}/commands/{batch}")
        if not dense(new, "id", meta["last_id"] + 1):
            raise RuntimeError("numbers of a load are not dense")
        new.select(F.col("id").alias("command_id"), self.embed(F.col("text_scrubbed")).alias("embedding")).write.parquet(f"{self.path}/vectors/{batch}")
        postings_of(new).write.parquet(f"{self.path}/postings/{batch}")
        counts = {r["source"]: r for r in ingest.counters(rows, new).collect()}
        known = meta["cursors"] | {r["source"]: max(r["cursor"], meta["cursors"].get(r["source"], 0)) for r in ingest.cursors(rows).collect()}
        done = {s: r["inserted"] for s, r in counts.items()}
        last = meta["last_id"] + sum(done.values())
        self.put_meta(meta | {"batches": [*meta["batches"], batch], "last_id": last, "cursors": known, "embedding_model_name": self.model[0], "embedding_model_revision": self.model[1]})
        return LoadResult(sum(done.values()), sum(r["skipped_dedup"] for r in counts.values()), done, time.perf_counter() - began)
