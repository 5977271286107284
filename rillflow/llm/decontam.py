"""Benchmark decontamination by Wu-Manber search for all word windows of the test items at once.

Texts are reduced to bytes first: A-Z lower-cased, every run of other non-word bytes one space, a
space at both ends. A window is then ` w1 w2 ... `, so that a plain substring is a whole-word match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import bounded_batches, fresh, kept, written

WINDOW = 10
#: Bytes of test windows that are searched for in one pass; more make further passes.
BLOCK_BYTES = 32 << 20
#: Windows shorter than this are searched apart, for they allow shorter jumps only.
SHORT = 24

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b + 32 if 0x41 <= b <= 0x5A else b) in _WORD else 0x20 for b in range(256))

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("spans", T.ArrayType(T.LongType(), False), False),
    ]
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    w = words(text)
    if not w:
        return set()
    return {b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))}


class WuManber:
    """Finds every occurrence of any of `patterns` (non-empty, distinct).

    `shift` has, for each block of bytes that stands in the first `m` bytes of a pattern, how far its
    last place is from their end; other blocks allow the longest jump. At a jump of 0 the block is the
    suffix of some patterns' first `m` bytes: `buckets` lists these, and each is compared directly.
    """

    def __init__(self, patterns: list[bytes]):
        m = self.m = min(map(len, patterns))
        b = self.b = max(1, min(12, m // 2))
        self.default = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[tuple[bytes, int]]] = {}
        for k, p in enumerate(patterns):
            for j in range(b, m + 1):
                block = p[j - b : j]
                if m - j < self.shift.get(block, self.default):
                    self.shift[block] = m - j
            self.buckets.setdefault(p[m - b : m], []).append((p, k))

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, index of the pattern) of each occurrence."""
        m, b, get, default, buckets = self.m, self.b, self.shift.get, self.default, self.buckets
        at, end = m, len(text)
        while at <= end:
            jump = get(text[at - b : at], default)
            if jump:
                at += jump
                continue
            for p, k in buckets[text[at - b : at]]:
                if text.startswith(p, at - m):
                    yield at - m, k
            at += 1


class Searcher:
    """The compiled windows of one block of test items."""

    def __init__(self, owners: dict[bytes, list[str]]):
        self.patterns = list(owners)
        self.owners = [owners[p] for p in self.patterns]
        groups = [[p for p in self.patterns if len(p) < SHORT], [p for p in self.patterns if len(p) >= SHORT]]
        index = {p: k for k, p in enumerate(self.patterns)}
        self.matchers = [(WuManber(g), [index[p] for p in g]) for g in groups if g]
        self.n_words = [p.count(b" ") - 1 for p in self.patterns]

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged ranges of hit words, items."""
        w = words(text)
        if not w:
            return 0, [], set()
        flat = b" " + b" ".join(w) + b" "
        found = [(at, ks[k]) for matcher, ks in self.matchers for at, k in matcher.find(flat)]
        if not found:
            return len(w), [], set()
        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
        firsts = np.searchsorted(spaces, [at for at, _ in found]).tolist()
        ranges = sorted({(f, f + self.n_words[k]) for f, (_, k) in zip(firsts, found)})
        items = {i for k in {k for _, k in found} for i in self.owners[k]}
        return len(w), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _blocks(bench: DataFrame, item: str, text: str, size: int, block_bytes: int) -> Iterator[dict[bytes, list[str]]]:
    """Windows with the ids of their items, in blocks of bounded size; the driver holds one at a time."""
    rows = bench.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    block: dict[bytes, set[str]] = {}
    held = 0
    for r in rows.toLocalIterator():
        for p in windows(r["t"], size):
            held += 0 if p in block else len(p) + 100
            block.setdefault(p, set())
            if r["i"] is not None:
                block[p].add(r["i"])
        if held >= block_bytes:
            yield {p: sorted(i) for p, i in block.items()}
            block, held = {}, 0
    if block:
        yield {p: sorted(i) for p, i in block.items()}


def _pass(shared, before: bool):
    def one(texts: pa.Array, sofar: pa.Array | None = None) -> pa.Array:
        searcher = _searcher(shared)
        old = sofar.to_pylist() if before else [None] * len(texts)
        out = []
        for t, o in zip(texts.to_pylist(), old):
            n, ranges, items = searcher.hits(t)
            if o:
                ranges = merged(sorted(ranges + list(zip(o["spans"][::2], o["spans"][1::2]))))
                items |= set(o["items"])
            out.append({"n_words": n, "n_hit": sum(z - a for a, z in ranges), "items": sorted(items), "spans": [x for r in ranges for x in r]})
        return pa.array(out, _ARROW)

    if before:

        def search(texts: pa.Array, sofar: pa.Array) -> pa.Array:
            return one(texts, sofar)

    else:

        def search(texts: pa.Array) -> pa.Array:
            return one(texts)

    return F.arrow_udf(search, HITS)


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])


def _searcher(shared) -> Searcher:
    """A worker compiles a block once and keeps one block."""
    return kept(shared, lambda: Searcher(shared.value))


def benchmark_hits(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text", window: int = WINDOW, into: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with a struct column `into` (renamed if taken): n_words, n_hit, items (sorted ids), spans (flat word ranges).

    A null or wordless text has no words and no hits; a null or wordless item has no windows; a hit on
    an item whose id is null counts as a hit without naming an item. Equal rows are kept and judged
    alike. Without windows nothing is hit. A block of windows of at most `block_bytes` is broadcast at a
    time; a larger benchmark makes further narrow passes with a table between two, so nothing is dropped.
    No shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    into = fresh(docs, into)
    out, n = docs, 0
    for block in _blocks(bench, item, bench_text, window, block_bytes):
        # One block is searched at a time: what the passes before found is a table.
        out = written(out, "hits") if n else out
        shared = spark.sparkContext.broadcast(block)
        args = [F.col(text).cast("string")] + ([F.col(into)] if n else [])
        out = out.withColumn(into, _pass(shared, n > 0)(*args))
        n += 1
    if not n:
        shared = spark.sparkContext.broadcast({})
        out = out.withColumn(into, _pass(shared, False)(F.col(text).cast("string")))
    return out


def decontaminated(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """`docs` without the rows that hold a window of any item."""
    name = fresh(docs, "hits")
    out = benchmark_hits(docs, bench, into=name, **kw)
    return out.where(F.col(name)["n_hit"] == 0).select(*[f"`{c}`" for c in docs.columns])
