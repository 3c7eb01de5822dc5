"""The SQLite history database as a Spark data source with filter pushdown of the cursor."""

from __future__ import annotations

import contextlib
import json
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from histlake.schema import ENTRY
from histlake.shipping import ship

#: Columns of the history table.
REQUIRED, OPTIONAL = {"timestamp", "command"}, {"id", "duration", "exit", "cwd", "session", "hostname"}
NS_S, NS_MS = 1_000_000_000, 1_000_000
ROWS = 200_000


class AtuinSchemaError(ValueError):
    pass


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def connect(path: str) -> sqlite3.Connection:
    """Opens the file where it is, or an executor's own copy of it."""
    path = path if Path(path).exists() else SparkFiles.get(Path(path).name)
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


@contextlib.contextmanager
def opened(uri: str) -> Iterator[sqlite3.Connection]:
    """A database of a shared folder: where it is, or a copy on this machine's disk while it is read."""
    fs, path = open_fs(uri)
    with tempfile.TemporaryDirectory() as folder:
        if not isinstance(fs, pa.fs.LocalFileSystem):
            pa.fs.copy_files(path, own := f"{folder}/history.db", source_filesystem=fs, destination_filesystem=pa.fs.LocalFileSystem())
            path = own
        with contextlib.closing(sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)) as db:
            yield db


class Slice(InputPartition):
    """Row ids of the one database, or a database of a shared folder."""

    def __init__(self, first: int, last: int, uri: str | None = None):
        self.first, self.last, self.uri = first, last, uri


def columns(db: sqlite3.Connection) -> set[str]:
    found = {r[1] for r in db.execute("PRAGMA table_info(history)")}
    if missing := REQUIRED - found:
        raise AtuinSchemaError(f"history table is missing required columns: {sorted(missing)}; found: {sorted(found)}")
    return found


class AtuinReader(DataSourceReader):
    """One partition for each stretch of row ids, so that large databases are read side by side."""

    def __init__(self, path: str, since: int | None, shared: list[str] | None = None):
        self.path, self.since, self.shared = path, since, shared

    def partitions(self) -> list[Slice]:
        if self.shared is not None:
            return [Slice(-(1 << 63), (1 << 63) - 1, uri) for uri in self.shared] or [Slice(0, -1)]
        if not Path(self.path).exists():
            return [Slice(0, -1)]
        with connect(self.path) as db:
            columns(db)
            low, high = db.execute("SELECT min(rowid), max(rowid) FROM history").fetchone()
        return [Slice(0, -1)] if low is None else [Slice(i, i + ROWS - 1) for i in range(low, high + 1, ROWS)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if partition.last < partition.first:
            return
        with opened(partition.uri) if partition.uri else connect(self.path) as db:
            found = columns(db)
            names = ["timestamp", "command", *sorted(OPTIONAL)]
            picked = ", ".join(f'"{c}"' if c in found else "NULL" for c in names)
            sql = f"SELECT {picked} FROM history WHERE rowid BETWEEN ? AND ?"
            args = [partition.first, partition.last]
            if self.since is not None:
                sql, args = sql + " AND timestamp > ?", [*args, self.since * NS_S]
            for values in db.execute(sql, args):
                r = dict(zip(names, values, strict=True))
                at = int(r["timestamp"])
                ms = None if r["duration"] is None else int(r["duration"]) // NS_MS
                yield (r["command"], at // NS_S, "atuin", None if r["id"] is None else str(r["id"]), r["cwd"], r["hostname"], r["exit"], ms, r["session"], at)


class AtuinDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atuin"

    def schema(self):
        return ENTRY

    def reader(self, schema) -> AtuinReader:
        since = self.options.get("since")
        shared = self.options.get("shared")
        return AtuinReader(self.options.get("path", ""), None if since is None else int(since), None if shared is None else json.loads(shared))


def read_atuin(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """Entries by time; the time in nanoseconds is their ordinal. Unknown times have no exemption here. The driver's file
    goes to executors that don't share its disk."""
    ship(spark)
    if Path(path).exists() and not spark.sparkContext.master.startswith("local["):
        spark.sparkContext.addFile(path)
    spark.dataSource.register(AtuinDataSource)
    reader = spark.read.format("atuin").option("path", path)
    return (reader if since is None else reader.option("since", since)).load()


def write_databases(rows: DataFrame, folder: str) -> list[str]:
    """Writes columns of history tables as databases in a folder that all share, one of each task, and returns their
    URIs. Rows go from tasks to files; the driver sees names only."""
    names = ", ".join(f'"{c}"' for c in rows.columns)
    marks = ", ".join("?" * len(rows.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, to = open_fs(uri := f"{folder}/{uuid.uuid4().hex}.db")
        with tempfile.TemporaryDirectory() as own:
            with contextlib.closing(sqlite3.connect(f"{own}/history.db")) as db, db:
                db.execute("PRAGMA synchronous = OFF")
                db.execute(f"CREATE TABLE history ({names})")
                for batch in batches:
                    db.executemany(f"INSERT INTO history VALUES ({marks})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
            fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
            pa.fs.copy_files(f"{own}/history.db", to, source_filesystem=pa.fs.LocalFileSystem(), destination_filesystem=fs)
        yield pa.RecordBatch.from_pydict({"uri": [uri]})

    return sorted(r[0] for r in rows.mapInArrow(run, "uri string").collect())


def read_databases(spark: SparkSession, uris: list[str], since: int | None = None) -> DataFrame:
    """Entries of databases in a shared folder, a task for each."""
    ship(spark)
    spark.dataSource.register(AtuinDataSource)
    reader = spark.read.format("atuin").option("shared", json.dumps(uris))
    return (reader if since is None else reader.option("since", since)).load()
