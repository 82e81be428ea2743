"""WARC archives with a two-level capture index.

Records are written uncompressed by Spark's text writer, whose line separator is the blank line that
ends a record, so no record passes through Python and none is held with another. Of records with equal
payloads that with the largest page id is the response; the others are revisits that keep the HTTP
headers only. The decisions come from a pass over (page_id, digest); only groups of copies go into the
table that the pages are joined with, so pages are shuffled only when that table is too big to broadcast.

The index has two levels, in files of their own. The first: one entry per capture, sorted by reversed-host
URL key, in compressed blocks of ``PER_BLOCK`` entries. The second: a sparse directory with the first key, the
last key and the place of each block, in sorted files of about ``PER_FILE`` lines, whose first and last keys
the driver holds. A search bisects these, then the directory file, reads the block by its byte range, bisects the
block, and reads the record by its byte range. A key with many captures is as many tasks as it has blocks.

Archives and index are read through ``pyarrow.fs``, so the shared folder must be one that it reaches (local,
HDFS, S3, GCS, ABFS); the pages themselves are only read by Spark.

Defined results: ids are whole numbers or null; a null html is an empty payload; null URLs have no target header and the
empty key; null page ids are smaller than any; of rows equal in id and payload one is the response; equal rows
each get a record; line breaks and blanks in URLs are percent-encoded; an empty table gives no record; extra columns
aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import scratch

PER_BLOCK, PER_FILE, DATE = 1024, 16_384, "2024-01-01T00:00:00Z"
_GAP = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits at a time are four base32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """Reversed-host key: scheme, www., fragment, default port and trailing slash don't count; the query does. Line breaks and
    blanks count as they stand in a record, percent-encoded."""
    if not url:
        return ""
    url = re.sub("[\\x00-\\x20]", "%20", re.sub("[\r\n]+", "%0D%0A", url))
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    query = "?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{where}){parts.path.rstrip('/').lower() or '/'}{query}"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """A record per row of ``pages`` under ``path``."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    slim = pages.select(F.col(id_col).alias("_id"), base32_sha1(payload).alias("_digest"), F.octet_length(payload).alias("_size"))
    per_id = slim.where(F.col("_size") >= least_bytes).groupBy("_digest", "_id").agg(F.count(F.lit(1)).alias("n"))
    copies = per_id.groupBy("_digest").agg(F.max(F.struct("_id", "n")).alias("best"), F.sum("n").alias("size")).where("size > 1")
    copies = scratch.stage(copies.select(F.col("_digest").alias("_of"), F.col("best._id").alias("_winner"), (F.col("best.n") > 1).alias("_tied")), "copies", codec="snappy")
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "[\r\n]+", "%0D%0A"), "[\\x00-\\x20]", "%20")
    rows = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), payload.alias("_html"))
    rows = rows.withColumn("_digest", base32_sha1(F.col("_html"))).withColumn("_size", F.octet_length("_html"))
    rows = rows.join(copies, (F.col("_digest") == F.col("_of")) & (F.col("_size") >= least_bytes), "left")
    first = F.col("_of").isNull() | F.col("_id").eqNullSafe(F.col("_winner"))
    tied = F.coalesce(F.col("_tied") & first, F.lit(False))
    if copies.where("_tied").isEmpty():
        out = rows.withColumn("_k", F.lit(1).cast("long"))
    else:  # several rows with the winner's id and payload: one of them is the response
        alike = scratch.stage(rows.where(tied).withColumn("_rid", F.monotonically_increasing_id()), "alike")
        one = alike.groupBy("_digest").agg(F.min("_rid").alias("_one"))
        alike = alike.join(one, "_digest").withColumn("_k", F.when(F.col("_rid") == F.col("_one"), 1).otherwise(F.col("_rid") + 2))
        out = rows.where(~tied).withColumn("_k", F.lit(1).cast("long")).unionByName(alike.drop("_rid", "_one"))
    out = out.withColumn("_response", first & (F.col("_k") == 1))
    name = lambda i, d: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), d)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_size"), F.lit(_GAP))
    length = F.octet_length(http) + F.when(F.col("_response"), F.col("_size")).otherwise(0)
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("_response"), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("_id"), F.col("_digest")), F.lit(":"), F.when(F.col("_response"), F.lit("r")).otherwise(F.concat(F.lit("v"), F.col("_k"))), F.lit(">"),
        F.lit(f"\r\nWARC-Date: {DATE}"),
        F.when(F.col("_url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("_url"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.when(~F.col("_response"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("_winner"), F.col("_digest")), F.lit(":r>"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length, F.lit(_GAP),
    )
    out.select(F.concat(header, http, F.when(F.col("_response"), F.col("_html")).otherwise("")).alias("value")).write.option("lineSep", _GAP).text(path)


def _open(path: str):
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem().open_input_file(local)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _page(record_id: str) -> int | str | None:
    found = re.match(r"<urn:page:(.*):[A-Z2-7]{32}:", record_id, re.DOTALL)[1]
    return int(found) if re.fullmatch(r"-?\d+", found) else found or None


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:])


def _scan(path: str, size: int, window: int = 1 << 16):
    """(offset, length, headers) of each record; payloads are skipped, not read."""
    with _open(path) as f:
        at = 0
        while at < size:
            raw, k = b"", -1
            while k < 0:
                more = f.read_at(window, at + len(raw))
                if not more:
                    raise ValueError("a record's headers don't end")
                raw += more
                k = raw.find(b"\r\n\r\n")
            h = _headers(raw[:k])
            length = k + 4 + int(h["Content-Length"]) + 4
            yield at, length, h
            at += length


def _entries(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for p, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = [(url_key(h.get("WARC-Target-URI")), h.get("WARC-Target-URI"), p, at, n) for at, n, h in _scan(p, size)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "url", "file", "start", "length"])

    return _files(spark, path).mapInArrow(run, "key string, url string, file string, start long, length long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").where("length > 0")


def _lines(path: str, size: int, window: int = 1 << 20):
    """(offset, line) of a text file, read in stretches."""
    with _open(path) as f:
        at, rest = 0, b""
        for k in range(0, size, window):
            *whole, rest = (rest + f.read_at(min(window, size - k), k)).split(b"\n")
            for line in whole:
                yield at, line
                at += len(line) + 1


@dataclass
class CaptureIndex:
    """``top``: first key, last key and path of each file of the directory, in order; one for ``PER_FILE * PER_BLOCK`` captures or so."""

    spark: SparkSession
    top: list[tuple[str, str, str]]

    @classmethod
    def build(cls, spark: SparkSession, archives: str, path: str, per_block: int = PER_BLOCK, per_file: int = PER_FILE) -> CaptureIndex:
        entries = _entries(spark, archives).repartitionByRange(F.col("key"), F.col("file"), F.col("start"))
        entries = entries.sortWithinPartitions("key", "file", "start")

        def blocks(batches):
            have: list[tuple] = []
            for b in batches:
                have += zip(*(c.to_pylist() for c in b.columns), strict=True)
                full = len(have) // per_block * per_block
                yield pa.RecordBatch.from_arrays([pa.array([_packed(have[k : k + per_block]) for k in range(0, full, per_block)], pa.string())], ["value"])
                have = have[full:]
            if have:
                yield pa.RecordBatch.from_arrays([pa.array([_packed(have)], pa.string())], ["value"])

        entries.mapInArrow(blocks, "value string").write.text(f"{path}/blocks")

        def places(batches):
            for b in batches:
                for file, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    rows = []
                    for at, line in _lines(file, size):
                        have = _unpacked(line)
                        rows.append((have[0][0], have[-1][0], file, at, len(line)))
                    yield _batch(rows, _PLACE)

        found = scratch.stage(_files(spark, f"{path}/blocks").mapInArrow(places, _schema(_PLACE)), "places")
        lines = found.repartitionByRange(max(1, -(-found.count() // per_file)), "first", "last", "file", "start").sortWithinPartitions("first", "last", "file", "start")
        lines.select(F.to_json(F.array(*[F.col(c).cast("string") for c in _PLACE]))).write.text(f"{path}/directory")

        def ends(batches):
            for b in batches:
                for file, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    own = _directory(file, size)
                    yield _batch([(own[0][0], own[-1][1], file)], _TOP)

        top = _files(spark, f"{path}/directory").mapInArrow(ends, _schema(_TOP)).collect()
        return cls(spark, sorted(map(tuple, top)))

    def locate(self, urls: DataFrame) -> DataFrame:
        """The blocks to read: key, file, start, length; a row for each key and block that may hold it. ``urls`` has one column."""
        wanted = urls.select(F.col(urls.columns[0]).alias("url")).distinct().mapInArrow(_keys, "key string").distinct()
        wanted = wanted.repartitionByRange("key").sortWithinPartitions("key")
        top = self.top

        def run(batches):
            opened: tuple[str, list, list] = ("", [], [])
            for b in batches:
                rows = []
                for key in b.column(0).to_pylist():
                    for _, _, path in _between(top, [t[1] for t in top], key):
                        if opened[0] != path:
                            own = _directory(path)
                            opened = path, own, [r[1] for r in own]
                        rows += [(key, *r[2:]) for r in _between(opened[1], opened[2], key)]
                yield _batch(rows, _WANTED)

        return wanted.mapInArrow(run, _schema(_WANTED))

    def find(self, urls: DataFrame) -> DataFrame:
        """Records of all captures of these URLs (one column; repeats and nulls are looked up once)."""
        dealt = self.locate(urls).repartition("file", "start").sortWithinPartitions("file", "start", "key")

        def run(batches):
            name, have, own = None, [], []
            for b in batches:
                rows = []
                for key, file, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (file, start) != name:
                        with _open(file) as f:
                            have = _unpacked(f.read_at(length, start))
                        name, own = (file, start), [e[0] for e in have]
                    rows += have[bisect_left(own, key) : bisect_right(own, key)]
                yield _batch(rows, _ENTRY)

        return _read(dealt.mapInArrow(run, _schema(_ENTRY)))

    def lookup(self, urls: list[str]) -> DataFrame:
        """Records of all captures of a list of URLs that the caller holds."""
        return self.find(self.spark.createDataFrame([(u,) for u in urls], "url string"))


_ENTRY = {"key": pa.string(), "url": pa.string(), "file": pa.string(), "start": pa.int64(), "length": pa.int64()}
_PLACE = {"first": pa.string(), "last": pa.string(), "file": pa.string(), "start": pa.int64(), "length": pa.int64()}
_WANTED = {"key": pa.string(), "file": pa.string(), "start": pa.int64(), "length": pa.int64()}
_TOP = {"first": pa.string(), "last": pa.string(), "path": pa.string()}
_RECORD = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}


def _schema(kinds: dict) -> str:
    return ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in kinds.items())


def _batch(rows: list, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def _keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], ["key"])


def _between(rows: list, last: list[str], key: str):
    """Of rows (first, last, ...) in order, those with first <= key <= last."""
    at = bisect_left(last, key)
    while at < len(rows) and rows[at][0] <= key:
        yield rows[at]
        at += 1


def _directory(path: str, size: int | None = None) -> list[tuple]:
    """A whole file of the directory, of about ``PER_FILE`` lines."""
    with _open(path) as f:
        raw = f.read_at(size or f.size(), 0)
    return [(a, b, c, int(d), int(e)) for a, b, c, d, e in map(json.loads, raw.decode().split("\n")[:-1])]


def _packed(rows: list[tuple]) -> str:
    return base64.b64encode(zlib.compress("\n".join(map(json.dumps, rows)).encode(), 6)).decode()


def _unpacked(line: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(base64.b64decode(line)).decode().split("\n")]


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """WARC headers, payload, and the payload's full length by the HTTP headers; a payload's digest is verified."""
    k = raw.index(b"\r\n\r\n")
    h = _headers(raw[:k])
    block = raw[k + 4 : -4]
    if len(block) != int(h["Content-Length"]) or raw[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if h["WARC-Type"] == "response" and (len(payload) != size or "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != h["WARC-Payload-Digest"]):
        raise ValueError("a payload doesn't match its digest")
    return h, payload, size


def _read(entries: DataFrame) -> DataFrame:
    """Range reads, a file's in one go: entries are dealt by file and a stretch of it, so a large file is many tasks."""
    dealt = entries.repartition("file", F.floor(F.col("start") / (64 << 20))).sortWithinPartitions("file", "start")

    def run(batches):
        name, f = None, None
        for b in batches:
            out = []
            for path, at, n, url in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 1)), strict=True):
                if path != name:
                    if f is not None:
                        f.close()
                    name, f = path, _open(path)
                h, _, size = parse_record(f.read_at(n, at))
                refers = h.get("WARC-Refers-To")
                out.append((_page(h["WARC-Record-ID"]), url, h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), size, _page(refers) if refers else None))
            yield _batch(out, _RECORD)
        if f is not None:
            f.close()

    return dealt.mapInArrow(run, _schema(_RECORD))
