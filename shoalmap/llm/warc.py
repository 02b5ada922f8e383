"""WARC archives of pages, with a capture index merged from sorted runs.

Writing: every page becomes a record, `response` or, if an earlier page (smaller page_id) has the same
payload of at least 100 bytes, `revisit` with a reference and no payload. Spark's text writer puts the
records into gzipped archive files; the line separator is the two line ends that close a record.

Reading: each archive is parsed record by record. Its captures, sorted by URL key and timestamp, are a
run. The index is cut into ranges of (URL key, timestamp, page_id), so that one busy URL can fill several
ranges; in each range a loser tree merges what the runs hold of it. The result is in global order;
`histories` sums it up by URL.

Defined results: null html is an empty payload; payloads below 100 bytes are never revisits; null URLs
have an empty key; line ends inside a URL are escaped, so no header can be forged; rows with a null page_id come last and do
not become the response of others unless all pages with the payload have none. A record's id is made of page_id and payload
digest, so rows that share a page_id but not the payload have ids of their own; rows that share both are one page written
as often as it is given, each a record with the same id. A task holds an archive whole while it parses it.
"""

from __future__ import annotations

import gzip
import hashlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalmap.session import scratch_path

LEAST = 100
CLOSE = "\r\n\r\n"
RECORDS = "page_id long, url string, url_key string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, place long"


def with_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to.

    The first page of each payload is found by an aggregate with map-side combine over ids and digests;
    no group of equal payloads is held together.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    ids = rows.filter(F.col("payload_bytes") >= least)
    first = ids.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    rows = rows.join(first, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record(captured: Column) -> Column:
    """Text of a WARC record without the line ends that close it."""
    end = F.lit("\r\n")
    # A revisit has the digest of the response it refers to.
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(":"), F.col("payload_digest"), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "%0([AD])", "%250$1"), "\r", "%0D")
    url = F.regexp_replace(url, "\n", "%0A")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(CLOSE), body)
    return F.concat(
        *[F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), end],
        *[F.lit("WARC-Record-ID: "), urn(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), end],
        *[F.lit("WARC-Date: "), captured, end, F.lit("WARC-Target-URI: "), url, end],
        *[F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"), end],
        *[F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"), end],
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")), end)).otherwise(F.lit("")),
        *[F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(CLOSE), block],
    )


def capture_time(page_id: Column) -> Column:
    """A timestamp for pages that have none: a second per page from the start of 2020 on."""
    second = F.lit(1_577_836_800) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**9))
    return F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the records of (page_id, url, html) below `path`, a new folder all executors share."""
    rows = with_types(pages)
    rows.select(record(capture_time(F.col("page_id"))).alias("value")).write.option("lineSep", CLOSE).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Host labels from the right, then path and query, so that a site's pages sort together."""
    parts = urlsplit(url) if "[" not in url else urlsplit("")
    host = (parts.netloc.rpartition("@")[2].partition(":")[0] or "").lower().removeprefix("www.")
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}" if host else url


def parse(data: bytes, archive: str):
    """Captures of an archive, in its order; payloads are read by length and their digests taken anew."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = head_end + 4
        stop = start + int(head["Content-Length"])
        body = data[data.index(b"\r\n\r\n", start, stop) + 4 : stop]
        digest, length = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response":
            if (hashlib.sha256(body).hexdigest(), len(body)) != (digest, length):
                raise ValueError(f"{archive} at {at}: the payload does not have the digest of its header")
        url = head["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%250", "%0")
        page = head["WARC-Record-ID"].removeprefix("<urn:page:").partition(":")[0]
        refers = head.get("WARC-Refers-To", "").removeprefix("<urn:page:").partition(":")[0]
        yield (int(page) if page else None, url, url_key(url), head["WARC-Date"], head["WARC-Type"], int(refers) if refers else None, length, digest, archive, at)
        at = stop + 4


def _order(capture: tuple) -> tuple:
    page = capture[0]
    return capture[2].encode(), capture[3], page is None, page or 0, capture[8], capture[9]


def _types() -> list[pa.DataType]:
    return [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _types(), strict=True)], names=NAMES)


def _runs(batches):
    """A sorted run per archive."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = sorted(parse(gzip.decompress(content.as_py()), path.rpartition("/")[2]), key=_order)
            for k in range(0, len(rows), 10_000):
                yield _batch(rows[k : k + 10_000])


class LoserTree:
    """Merges sorted runs: a match node keeps the loser, so the next smallest costs one path to the top."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.at = [0] * len(runs)
        self.losers = [-1] * self.size
        winners = [-1] * self.size + [k if k < len(runs) else -1 for k in range(self.size)]
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1]

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if 0 <= run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return x is not None and (y is None or _order(x) <= _order(y))

    def __iter__(self):
        while (head := self._head(self.winner)) is not None:
            yield head
            self.at[self.winner] += 1
            node, now = (self.winner + self.size) // 2, self.winner
            while node:
                if self._before(self.losers[node], now):
                    self.losers[node], now = now, self.losers[node]
                node //= 2
            self.winner = now


def _merge(batches):
    """Merge what the runs hold of one range."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[8], []).append(row)
    # A shuffle keeps the pieces of a run whole, not their order in the range.
    sorted_runs = [sorted(run, key=_order) for _, run in sorted(runs.items())]
    held = []
    for row in LoserTree(sorted_runs):
        held.append(row)
        if len(held) == 10_000:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def capture_index(archives: DataFrame) -> DataFrame:
    """Captures of archive files (path, content) in global order of (url_key, captured, page_id)."""
    runs = archives.select("path", "content").mapInArrow(_runs, RECORDS)
    return runs.repartitionByRange("url_key", "captured", F.col("page_id").asc_nulls_last()).mapInArrow(_merge, RECORDS)


def read_archives(spark, path: str) -> DataFrame:
    """The index of all archives below a folder."""
    return capture_index(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path))


def histories(index: DataFrame) -> DataFrame:
    """One row per URL: first and last capture, captures, revisits and distinct payloads."""
    return index.groupBy("url_key").agg(
        F.min("captured").alias("first"), F.max("captured").alias("last"), F.count("*").alias("captures"),
        F.sum((F.col("record_type") == "revisit").cast("long")).alias("revisits"), F.countDistinct("payload_digest").alias("payloads"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read their index back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    index = read_archives(pages.sparkSession, path)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
