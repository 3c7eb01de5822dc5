"""WARC archives with a two-level capture index (operator 2).

Pages are written as WARC/1.1 records, each a gzip member of its own, into archives of bounded size in a shared folder.
Of records with equal payloads of at least 100 bytes the one with the smallest page_id is a response and the others
are revisits that name it and its URL. The index sorts captures by reversed-host URL key and page_id into blocks, which are
compressed and written as a table (first level), and keeps a sparse directory of the blocks' first keys (second
level), whose size is bounded whatever the input. A lookup binary-searches the directory, reads the blocks that can
hold the key, searches them, and reads the record's bytes alone; a revisit's payload is that of its response, found by
the same index.

Archives are named by chance and listed in a manifest table, so what a lost or repeated task wrote is never read.
Defined results: null html is an empty payload; a null url has the key "" ; a null page_id is written without an id and
takes no part in revisits but as one of them (refers_to stays the smallest known id; without any, all are responses);
repeated page_ids each keep their record, with a record id of its own, and of a payload's rows all that have its
smallest page_id are responses; empty tables have an empty manifest and index. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from histlake.llm.common import scratch, small, table, written

LEAST_REVISIT = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Captures in a block, at least; and blocks in the directory, at most.
BLOCK_ROWS, MOST_BLOCKS = 3000, 100_000
LEVEL = 1
#: Records that are in memory together when archives are read.
READ_ROWS = 200
CRLF = b"\r\n"
#: Compressed bytes that a reading task gets, at least, and reading tasks, at most.
READ_BYTES, MOST_READERS = 4 << 20, 50_000
#: Fixed value: the profile of revisits of equal payloads.
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "url_key string, page_id long, archive string, start long, size long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels reversed and parted by commas, then ")", path and query: captures of a site sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    port = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path.rstrip("/") or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, refers_url: str | None = None, place: str = "") -> bytes:
    """A WARC record, uncompressed; its place (archive and offset) makes its id. A revisit has no payload of its own;
    its length and digest stay."""
    body = payload if kind == "response" else b""
    line = lambda u: re.sub(r"[\r\n]", " ", u or "").encode("utf-8", "surrogatepass")
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, place or f"page:{page_id}")).encode() + b">", b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + line(url), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % len(payload), b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To-Target-URI: " + line(refers_url), b"X-Refers-To-Page: %d" % refers_to]
    return CRLF.join(head) + CRLF + CRLF + body + CRLF + CRLF


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record."""
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("a record's length is not what it says")
    return headers, rest[:n]


def packed(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, and its digest, type and the response it refers to. Equal payloads meet as counts by
    digest, so a payload that a third of all pages have is one row there."""
    df = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    own = F.length(F.coalesce("html", F.lit("")).cast("binary"))
    long = pages.select("page_id", "url", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("payload_digest"), own.alias("n")).filter(F.col("n") >= LEAST_REVISIT)
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.min_by(F.coalesce("url", F.lit("")), F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first_url"), F.count("*").alias("copies")).filter("copies > 1 and first is not null").drop("copies")
    # Digests that come twice are few, so payloads mostly stay where they are.
    first = small(written(first, "warc-copies"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return df.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"),
    )


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Writes archives into folder; returns their manifest, written: a row for each record that a finished task wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        out, rows, at, name = None, [], 0, ""

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, SCHEMA)

        for batch in batches:
            for r in (r for i in range(0, batch.num_rows, 500) for r in batch.slice(i, 500).to_pylist()):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = packed(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["record_type"], r["refers_to"], r["refers_url"], f"{name}@{at}"))
                out.write(data)
                rows.append({"url_key": url_key(r["url"]), "page_id": r["page_id"], "archive": f"{folder}/{name}", "start": at, "size": len(data), "payload_bytes": len(r["payload"]), "payload_digest": r["payload_digest"], "record_type": r["record_type"], "refers_to": r["refers_to"]})
                at += len(data)
                if at >= ARCHIVE_BYTES or len(rows) >= 20_000:
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                    yield flushed()
                    rows = []
        if out is not None:
            out.close()
        if rows:
            yield flushed()

    return written(typed.mapInArrow(run, MANIFEST), "warc-manifest")


SCHEMA = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
FIELDS = ("url_key", "page_id", "archive", "start", "size")


def build_index(manifest: DataFrame) -> DataFrame:
    """The written table of blocks: block, its first capture (key, page, archive, start), n, data (compressed lines of
    captures, sorted). No two captures are equal in these four, so blocks have one order, also those of one key."""
    spark = manifest.sparkSession
    rows = max(BLOCK_ROWS, -(-manifest.count() // MOST_BLOCKS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def block(part: list[tuple]) -> dict:
            lines = "\n".join("\t".join("" if v is None else str(v) for v in r) for r in part)
            return {"block": uuid.uuid4().hex, "first_key": part[0][0], "first_page": part[0][1], "first_archive": part[0][2], "first_start": part[0][3], "n": len(part), "data": zlib.compress(lines.encode("utf-8", "surrogatepass"), 6)}

        for pdf in batches:
            held += list(zip(pdf["url_key"], pdf["page"], pdf["archive"], pdf["start"], pdf["size"], strict=True))
            while len(held) >= rows:
                yield pd.DataFrame([block(held[:rows])])
                held = held[rows:]
        if held:
            yield pd.DataFrame([block(held)])

    page = F.coalesce(F.col("page_id"), F.lit(NOBODY)).alias("page")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-manifest.count() // rows)))
    keyed = manifest.select(F.translate("url_key", "\t\n", "  ").alias("url_key"), page, "archive", "start", "size").repartitionByRange(parts, "url_key", "page", "archive", "start").sortWithinPartitions("url_key", "page", "archive", "start")
    return written(keyed.mapInPandas(run, "block string, first_key string, first_page long, first_archive string, first_start long, n long, data binary"), "warc-index")


#: Stands for a null page_id in the index.
NOBODY = -(1 << 63)


def captures(data: bytes) -> list[tuple[str, int, str, int, int]]:
    """A block's captures, in order."""
    lines = zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")
    return [(k, int(p), a, int(s), int(n)) for k, p, a, s, n in (x.split("\t") for x in lines)]


def read_range(archive: str, start: int, size: int) -> tuple[dict[str, str], bytes]:
    fs, path = open_fs(archive)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return parse(zlib.decompress(f.read(size), 31))


class CaptureIndex:
    """The directory in memory (MOST_BLOCKS entries at most, and one for each task's rest), blocks on disk."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        first = ["first_key", "first_page", "first_archive", "first_start"]
        rows = blocks.select(*first, "block").orderBy(*first).collect()
        self.firsts, self.names = [tuple(r)[:4] for r in rows], [r[4] for r in rows]

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Headers and payloads of all captures of a URL; of revisits the payload of their response."""
        out = []
        for head, payload in self.records(url):
            if head["warc-type"] == "revisit":
                first = (b for h, b in self.records(head["warc-refers-to-target-uri"], int(head["x-refers-to-page"])) if h["warc-type"] == "response")
                payload = next(first)
                if hashlib.sha256(payload).hexdigest() != head["warc-payload-digest"].removeprefix("sha256:"):
                    raise ValueError(f"the response of {head['warc-record-id']} is another payload")
            out.append((head, payload))
        return out

    def records(self, url: str, page: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and payloads, as they are, of all captures of a URL, or of those of a page."""
        key = re.sub(r"[\t\n]", " ", url_key(url))
        i = max(0, bisect.bisect_left(self.firsts, (key, NOBODY)) - 1)
        while i < len(self.names) and self.firsts[i][0] <= key:
            data = self.blocks.filter(F.col("block") == self.names[i]).select("data").first()[0]
            found = captures(bytes(data))
            a = bisect.bisect_left(found, (key,))
            while a < len(found) and found[a][0] == key:
                if page is None or found[a][1] == page:
                    yield read_range(*found[a][2:])
                a += 1
            i += 1


def resolve(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """url_key, page: requests by the thousand. Each is binary-searched in the broadcast directory, goes to every block
    that may hold it (captures of one key can run over blocks), meets the block's other requests there, and is
    binary-searched in the block. Gives archive, start, size of each capture that was asked for."""
    index = CaptureIndex(blocks)
    directory = requests.sparkSession.sparkContext.broadcast((index.firsts, index.names))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, names = directory.value
        for pdf in batches:
            asked = list(zip(pdf["url_key"], pdf["page"], strict=True))
            # The block before the first that begins with the key may end with it.
            spans = [(max(0, bisect.bisect_left(firsts, x) - 1), bisect.bisect_left(firsts, (x[0], x[1] + 1))) for x in asked]
            rows = ((*x, names[i]) for x, (a, b) in zip(asked, spans, strict=True) for i in range(a, b))
            while part := list(itertools.islice(rows, 10_000)):
                yield pd.DataFrame(part, columns=["url_key", "page", "block"])

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf["data"].dropna()
        if not len(data):
            return pd.DataFrame({"url_key": [], "page": [], "archive": [], "start": [], "size": []})
        found = captures(bytes(data.iloc[0]))
        out = []
        for x in set(zip(pdf["url_key"][pdf["data"].isna()], pdf["page"][pdf["data"].isna()], strict=True)):
            a = bisect.bisect_left(found, x)
            while a < len(found) and found[a][:2] == x:
                out.append(found[a])
                a += 1
        return pd.DataFrame(out, columns=["url_key", "page", "archive", "start", "size"])

    asked = requests.mapInPandas(find, "url_key string, page long, block string")
    both = asked.withColumn("data", F.lit(None).cast("binary")).unionByName(blocks.select(F.lit("").alias("url_key"), F.lit(NOBODY).alias("page"), "block", "data"))
    return both.groupBy("block").applyInPandas(search, "url_key string, page long, archive string, start long, size long")


def read_records(places: DataFrame) -> DataFrame:
    """Range-reads records (archive, start, size) and checks each payload against its digest; neighbours in one
    stretch of an archive share an open file, and as many tasks read as the records' bytes ask for. Gives page_id, url,
    html, and what the headers say."""
    places = written(places.select("archive", "start", "size"), "warc-places")
    total = places.agg(F.sum("size")).first()[0] or 0
    stretch = max(READ_BYTES, -(-total // MOST_READERS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, f = None, None
        for pdf in (x.iloc[i : i + READ_ROWS] for x in batches for i in range(0, len(x), READ_ROWS)):
            rows = []
            for archive, start, size in zip(pdf["archive"], pdf["start"], pdf["size"], strict=True):
                if archive != name:
                    if f is not None:
                        f.close()
                    fs, path = open_fs(archive)
                    name, f = archive, fs.open_input_file(path)
                f.seek(start)
                head, payload = parse(zlib.decompress(f.read(size), 31))
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and (len(payload) != int(head["x-payload-length"]) or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{archive} is damaged at {start}")
                rows.append((int(head.get("x-page-id", NOBODY)), head["warc-target-uri"], payload.decode("utf-8", "replace"), int(head["x-payload-length"]), digest, head["warc-type"], int(head.get("x-refers-to-page", NOBODY))))
            yield pd.DataFrame(rows, columns=["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f is not None:
            f.close()

    known = lambda c: F.nullif(F.col(c), F.lit(NOBODY)).alias(c)
    dealt = places.withColumn("stretch", F.floor(F.col("start") / stretch)).repartition(max(1, 2 * total // stretch), "archive", "stretch")
    out = dealt.sortWithinPartitions("archive", "start").select("archive", "start", "size")
    out = out.mapInPandas(run, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.select(known("page_id"), "url", "html", "payload_bytes", "payload_digest", "record_type", known("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page, indexes the archives, finds every capture through both levels, and reads it back."""
    folder = scratch(spark, "warc")
    manifest = write_archives(with_types(table(spark, sf_dir, "pages")), folder)
    blocks = build_index(manifest)
    requests = manifest.select(F.translate("url_key", "\t\n", "  ").alias("url_key"), F.coalesce("page_id", F.lit(NOBODY)).alias("page")).distinct()
    return read_records(resolve(requests, blocks)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
