"""WARC archives with payload deduplication, and their capture index by external merging.

Writing: one record a page; of equal payloads the page with the smallest key is the `response`, the
others are `revisit` records that name it and carry no payload. Spark's text writer writes the records
(a record ends with CRLF CRLF, which is its line separator), so commits, retries and remote file
systems work as for any table.

Reading: each archive file is parsed, its digests are checked, and its captures form a run sorted by
(URL key, timestamp, page). Each run is cut at the same splitters; the task of a range merges its
slices of all runs by a loser tree. Ranges follow one another, so the captures are globally ordered.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import bounded_batches, parts, scan_bytes, work_dir, written

#: Records and payload bytes of one archive file: bounds what a reader holds.
FILE_RECORDS, FILE_BYTES = 1000, 64 << 20
#: Bytes of input for each range of the index, and the most ranges: the driver samples SAMPLE captures for each.
RANGE_BYTES, MOST_RANGES = 64 << 20, 10_000
#: A table of duplicated digests of at most this many rows (64 bytes each) is broadcast.
BROADCAST_ROWS = 200_000
SAMPLE = 100

# The digits of base 32 in conv() and in RFC 4648.
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 20 bits at a time from the hex form."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, RFC_DIGITS)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; scheme, user and a www label don't count."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return (url or "").strip().lower()
    labels = [x for x in host.split(".") if x]
    if labels[:1] == ["www"] and len(labels) > 2:
        labels = labels[1:]
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def _stamp(when: Column | None) -> Column:
    """Text of a time in UTC, whatever the session's zone."""
    when = when if when is not None else F.timestamp_seconds(F.lit(946684800))
    return F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _records(pages: DataFrame, key: str, url: str, html: str, when: Column | None, min_bytes: int) -> DataFrame:
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    base = pages.select(
        F.col(key).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]+", " ").alias("url"),
        _stamp(when).alias("ts"),
        payload.alias("payload"),
    )
    base = base.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    firsts = base.where((F.col("bytes") >= min_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    firsts = written(firsts.where("first < last").select("digest", "first"), "warc-firsts")
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = base.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    return joined.withColumn("revisit", F.coalesce(F.col("id") > F.col("first"), F.lit(False)) & (F.col("bytes") >= min_bytes))


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", when: Column | None = None, min_bytes: int = 0, path: str | None = None) -> str:
    """Writes the archives of `pages`; returns their folder.

    A null text has an empty payload; an empty payload is one like others. A row whose key is null is a
    response and is nobody's first. Rows that repeat a key and a payload are all responses if the key is
    the smallest. Payloads of fewer than `min_bytes` bytes are responses. No rows: an empty folder.
    """
    spark = pages.sparkSession
    path = path or work_dir(spark, "warc")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit("\r\nWARC-Date: "), F.col("ts"),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))).cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(F.col("http").cast("binary"), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")))
    records = _records(pages, key, url, html, when, min_bytes).withColumn("http", http)
    # Of each size class (a factor of 4) as many records a file as stay within its bytes.
    least = FILE_BYTES // FILE_RECORDS
    size = F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    most = pages.agg(F.max(F.octet_length(F.col(f"`{html}`").cast("string")))).first()[0] or 0
    classes = [least]
    while classes[-1] < most:
        classes.append(4 * classes[-1])
    for n, top in enumerate(classes):
        some = records if len(classes) == 1 else records.where((size > (classes[n - 1] if n else -1)) & (size <= top))
        some = some.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))
        some.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, FILE_BYTES // top)).text(path)
    return path


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers, block) of each record of an archive file."""
    view, at = memoryview(content), 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(content[content.index(b"\r\n", at) + 2 : end + 2])}
        start = end + 4
        stop = start + int(head["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} doesn't end at byte {stop}")
        yield at, stop + 4 - at, head, view[start:stop]
        at = stop + 4


def capture(file: str, offset: int, length: int, head: dict[str, str], block: memoryview) -> dict:
    kind = head["warc-type"]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    raw = bytes(block[:4096])
    cut = raw.index(b"\r\n\r\n") + 4
    size = int(dict((k.lower(), v) for k, v in _HEADER.findall(raw[raw.index(b"\r\n") + 2 : cut - 2]))[b"content-length"])
    if kind == "response":
        payload = block[cut:]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{file}: the payload at byte {offset} doesn't match its digest")
    name = lambda h: h.removeprefix("<urn:page:").removesuffix(">") or None
    refers = head.get("warc-refers-to")
    uri = head["warc-target-uri"]
    return {"url_key": url_key(uri), "ts": head["warc-date"], "id": name(head["warc-record-id"]), "url": uri, "bytes": size, "digest": digest, "kind": kind, "refers": name(refers) if refers else None, "file": file, "at": offset, "length": length}


_CAPTURE = pa.struct([("url_key", pa.string()), ("ts", pa.string()), ("id", pa.string()), ("url", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
_DDL = "url_key string, ts string, id string, url string, bytes bigint, digest string, kind string, refers string, file string, at bigint, length bigint"


def order(c: dict) -> tuple:
    """The place of a capture: URL key, timestamp, then page (numbers before other names)."""
    i = c["id"] or ""
    return (c["url_key"].encode(), c["ts"], (0, int(i), "") if i.removeprefix("-").isdecimal() else (1, 0, i), c["file"], c["at"])


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of the match below it, node 0 the winner."""

    def __init__(self, runs: list[Iterable], key):
        self.key, self.runs = key, [iter(r) for r in runs]
        k = self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.tree = [-1] * max(1, k)
        for leaf in range(k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k:
            w = self.tree[0]
            if self.heads[w] is None:
                return
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            self._play(w)


def _runs(splitters: list[tuple]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                run = sorted((capture(path, *r) for r in parse(content.as_buffer().to_pybytes())), key=order)
                slices: dict[int, list] = {}
                for c in run:
                    slices.setdefault(bisect_right(splitters, order(c)[:3]), []).append(c)
                yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(slices.values(), pa.list_(_CAPTURE))], ["part", "slice"])

    return read


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slices: dict[int, list] = {}
    for batch in batches:
        for p, s in zip(batch.column("part").to_pylist(), batch.column("slice")):
            slices.setdefault(p, []).append(s.values)
    for p in sorted(slices):
        # Runs stay in Arrow form; the tree holds one row of each.
        tree, held, n = LoserTree([(x.as_py() for x in s) for s in slices.pop(p)], order), [], 0
        for c in tree:
            held.append(c | {"part": p, "rank": n})
            n += 1
            if len(held) == 4096:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_struct_array(pa.array(rows, pa.struct([("part", pa.int32()), ("rank", pa.int64()), *_CAPTURE])))


def capture_index(spark, path: str, urls: DataFrame | None = None, ranges: int = 1) -> DataFrame:
    """The captures of the archives in `path`, in global order of (part, rank).

    `urls`: a column of URLs, or columns of URLs, timestamps and page ids, from a sample of which the
    splitters come; its size doesn't matter for the result. With timestamps and ids the captures of one
    URL part too; without, they stand in one range.
    """
    bounded_batches(spark)
    splitters: list[tuple] = []
    ranges = min(ranges, MOST_RANGES)
    if ranges > 1 and urls is not None:
        n = urls.count()
        seen = urls.sample(min(1.0, SAMPLE * ranges / max(n, 1)), 7).limit(2 * SAMPLE * ranges).collect()
        keys = sorted(order({"url_key": url_key(r[0]), "ts": r[1], "id": r[2], "file": "", "at": 0})[:3] if len(r) > 2 else (url_key(r[0]).encode(),) for r in seen)
        splitters = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = files.mapInArrow(_runs(splitters), f"part int, slice array<struct<{_DDL.replace(' ', ':').replace(',:', ',')}>>")
    return runs.repartitionById(len(splitters) + 1, F.col("part")).mapInArrow(_merge, f"part int, rank bigint, {_DDL}")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", when: Column | None = None, min_bytes: int = 0) -> DataFrame:
    """Archives `pages` and returns the index read back from the archives (see write_archives, capture_index), keys as text."""
    spark = pages.sparkSession
    path = write_archives(pages, key, url, html, when, min_bytes)
    ranges = parts(scan_bytes(pages.select(key, url, html)), RANGE_BYTES)
    sampled = pages.select(F.col(f"`{url}`").cast("string").alias("url"), _stamp(when).alias("ts"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"))
    return capture_index(spark, path, sampled, ranges)
