"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, union-find.

A line is lower-cased and its white space collapsed before shingling. Lines that are equal but for
white space at their ends are one text. One changed character (its shingles being no others' too) leaves
lines of 39 characters and more similar; shorter ones are further apart than the threshold. One line of each class of similar lines stays: the first by
(document id, text hash, line number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm import linking
from rillflow.llm.common import bounded_batches, forget, fresh, mix, parts, scan_bytes, settled, written

#: Characters of a shingle: a power of two, so that hashes double.
SHINGLE = 4
#: At a similarity of 0.8, 39 bands of 8 minima miss eight candidates in ten thousand, at 0.9 not one in a million;
#: unlike lines of one language (0.1 to 0.3) hardly ever share one.
BANDS, ROWS = 39, 8
LEAST = 0.8
#: Bits of a sketch. Of two lines at the threshold a tenth of the bits differ; more than APART do in about one pair of ten thousand
#: (one in a thousand under 12 characters), and in all but one of two hundred pairs of unlike lines.
SKETCH, APART = 128, 32
#: Bins of a line: each holds the least hash of the shingles that fall into it.
BINS = BANDS * ROWS
#: Lines and characters signed at a time (they fit the processor's caches); characters of a long line at a time.
CHUNK, CHUNK_CHARS, PIECE = 256, 1 << 16, 1 << 20
#: Lines of a task whose keys are sent together (65,536 at most); bytes of documents of a part of the keys.
SENT, PART_BYTES = 1 << 15, 8 << 20
#: What counts as white space at the ends of a line, for Spark as for Python (fixed values).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_SPACES = "".join(c for c in SPACES if c < "\x80")
U64 = np.uint64

_RNG = np.random.default_rng(20)
#: An empty bin borrows from others: after k rounds it has looked at 2**k - 1 of them, in an order of its own.
_BORROW = [_RNG.permutation(BINS) for _ in range(12)]
_MULTIPLY = _RNG.integers(0, 1 << 63, ROWS, dtype=U64) * U64(2) + U64(1)
#: In each band another 16 bits of a line's hash tell copies of it from other lines of the same key.
_CHECK = _RNG.integers(0, 1 << 63, BANDS, dtype=U64) * U64(2) + U64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=U64))[:, None]
_EMPTY = np.uint32(0xFFFFFFFF)


def _flat(lines: list[str]) -> list[str]:
    """Lines in lower case, their white space collapsed and stripped, as long as a shingle at least."""
    text = "\n".join(lines)
    if "  " in text or any(c in text for c in (SPACES if not text.isascii() else _ASCII_SPACES) if c not in " \n"):
        flat = [" ".join(x.split()) for x in text.lower().split("\n")]
    else:
        flat = text.lower().split("\n")
    return [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in flat]


def _shingles(flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, one after another, and where each line's start; a short line is one shingle."""
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    h = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    step = 1
    while step < SHINGLE:
        h = h[:-step] * np.uint64((0x9E3779B97F4A7C15 * step | 1) % (1 << 64)) + h[step:]
        step *= 2
    h = mix(h)
    counts = size - SHINGLE + 1
    inside = np.ones(len(h), bool)
    ends = np.cumsum(size)[:-1]
    for back in range(1, SHINGLE):
        inside[ends - back] = False
    starts = np.zeros(len(flat), np.int64)
    np.cumsum(counts[:-1], out=starts[1:])
    return h[inside], starts


def features(lines: list[str]) -> list[linking.Features]:
    if not lines:
        return []
    h, starts = _shingles(_flat([x.strip() for x in lines]))
    found = [np.unique(x) for x in np.split(h, starts[1:])]
    return [(x, None, float(len(x))) for x in found]


def _fill(low: np.ndarray, lines: list[str], flat: bool = False) -> None:
    """Puts the least hashes of lines into the columns of `low` (bins by lines)."""
    h, starts = _shingles(lines if flat else _flat(lines))
    column = np.repeat(np.arange(len(lines)), np.diff(np.append(starts, len(h))))
    bins = ((h >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    np.minimum.at(low.reshape(-1), bins * low.shape[1] + column, h.astype(np.uint32))


def _borrowed(low: np.ndarray) -> np.ndarray:
    """Fills empty bins from others, by the same order of bins for all lines: each stays the minimum of a random one."""
    np.copyto(low, low[_BORROW[0]], where=low == _EMPTY)
    flat, width = low.reshape(-1), low.shape[1]
    cells = np.flatnonzero(flat == _EMPTY)
    for order in _BORROW[1:]:
        if not len(cells):
            return low
        row = cells // width
        found = flat[cells + (order[row] - row) * width]
        ok = found != _EMPTY
        flat[cells[ok]] = found[ok]
        cells = cells[~ok]
    flat[cells] = low.min(0)[cells % width]
    return low


def _combined(low: np.ndarray) -> np.ndarray:
    """A key for each band of bins."""
    bands = low.reshape(BANDS, ROWS, -1)
    out = np.repeat(_BAND, low.shape[1], 1)
    for r, m in enumerate(_MULTIPLY):
        out += bands[:, r] * m
    return mix(out)


def signed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (one-permutation MinHash, empty bins borrowing from others) and sketches (a bit of every other bin), one row a line."""
    keys, bits = np.empty((len(lines), BANDS), np.int64), np.empty((len(lines), SKETCH // 64), np.int64)
    at = 0
    while at < len(lines):
        stop, size = at, 0
        while stop < len(lines) and stop < at + CHUNK and (stop == at or size + len(lines[stop]) <= CHUNK_CHARS):
            size += len(lines[stop])
            stop += 1
        low = np.full((BINS, stop - at), _EMPTY, np.uint32)
        if size <= PIECE:
            _fill(low, lines[at:stop])
        else:
            # One long line, by pieces that share the shingles' overlap.
            text = _flat(lines[at:stop])[0]
            for k in range(0, max(1, len(text) - SHINGLE + 1), PIECE):
                _fill(low, [text[k : k + PIECE + SHINGLE - 1]], True)
        low = _borrowed(low)
        keys[at:stop] = _combined(low).T.view(np.int64)
        bits[at:stop] = np.packbits((low[: 2 * SKETCH : 2] & np.uint32(1)).astype(np.uint8), axis=0).T.copy().view(np.int64)
        at = stop
    return keys, bits


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys, one row a line."""
    return signed(lines)[0]


def _sender(n: int):
    """From texts to rows (part, lot, data): by ranges of keys the band keys of a lot of distinct lines, with check bits and numbers of the lines,
    and their hashes and sketches (part by the lot; here the lot's number is turned over)."""

    def send(lot: int, lines: list[str], hashes: list[int]) -> Iterator[pa.RecordBatch]:
        h = np.array(hashes, U64)
        keys, bits = signed(lines)
        yield _sent(hashes[0] % n, ~lot, h.tobytes() + np.ascontiguousarray(bits.T).tobytes())
        check = (h[:, None] * _CHECK >> U64(48)).astype(np.uint16).reshape(-1)
        keys = keys.view(U64).reshape(-1)
        part = ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.uint16 if n <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        low, check, line = keys[order].astype(np.uint32), check[order], (order // BANDS).astype(np.uint16)
        cuts = np.append(0, np.cumsum(np.bincount(part, minlength=n)))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            z = slice(cuts[p], cuts[p + 1])
            yield _sent(p, lot, low[z].tobytes() + check[z].tobytes() + line[z].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        task = TaskContext.get()
        lot = (task.partitionId() if task else 0) << 20
        # Lines of a lot that are equal send their keys once.
        held: dict[int, str] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                for x in t.split("\n"):
                    x = x.strip()
                    if x:
                        held.setdefault(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42), x)
                    if len(held) >= SENT:
                        yield from send(lot, list(held.values()), list(held))
                        held, lot = {}, lot + 1
        if held:
            yield from send(lot, list(held.values()), list(held))

    return run


def _sent(part: int, lot: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lot], pa.int64()), pa.array([data], pa.binary())], ["part", "lot", "data"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of a part that distinct lines share, and sketches (see linking.classes_of); a line's id is its first lot and its number there."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for p, lot, raw in zip(*(b.column(c).to_pylist() for c in ("part", "lot", "data"))):
            if lot < 0:
                h, *bits = np.frombuffer(raw, np.int64).reshape(1 + SKETCH // 64, -1)
                yield linking.sketch_rows((~lot << 16) + np.arange(len(h)), *bits, h)
            else:
                held.setdefault(p, []).append((lot, raw))
    for p in sorted(held):
        rows = held.pop(p)
        sizes = [len(x) // 8 for _, x in rows]
        key = np.concatenate([np.frombuffer(x, np.uint32, n) for (_, x), n in zip(rows, sizes)])
        check = np.concatenate([np.frombuffer(x, np.uint16, n, 4 * n) for (_, x), n in zip(rows, sizes)])
        line = np.concatenate([(lot << 16) + np.frombuffer(x, np.uint16, n, 6 * n).astype(np.int64) for (lot, x), n in zip(rows, sizes)])
        del rows
        yield from linking.shared_groups(key, line, p << 32, check)


def _groups(docs: DataFrame, text: str) -> DataFrame:
    n = parts(scan_bytes(docs), PART_BYTES)
    rows = settled(docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null"), "line-texts")
    rows = rows.mapInArrow(_sender(n), "part int, lot bigint, data binary")
    return written(rows.repartitionById(n, F.col("part")).mapInArrow(_meet, linking.GROUPS), "line-bands")


def _exploded(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(f"`{text}`").cast("string")
    k = F.col(f"`{key}`")
    some = docs.where(k.isNotNull() & t.isNotNull()).select(k.alias("doc"), F.xxhash64(t).alias("th"), F.split(t, "\n", -1).alias("all"))
    # Apart, or every line would carry its whole text along.
    some = some.select("doc", "th", F.posexplode("all").alias("no", "line")).where("line <> ''")
    # From a generator a body is trimmed once, not again for the filter.
    some = some.select("doc", "th", "no", F.explode(F.array(F.btrim("line", F.lit(SPACES)))).alias("body")).where("body <> ''")
    return some.select("doc", "th", "no", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"))


def _pick():
    def pick(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        """The lines of the given numbers."""
        out = []
        for t, wanted in zip(texts.to_pylist(), numbers.to_pylist()):
            t = t.split("\n")
            out.append([t[n] for n in wanted])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(pick, T.ArrayType(T.StringType()))


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row a non-blank line: doc, th (text hash), no (from 0), class (struct doc, th, no of the line that stays), kept.

    Null texts and rows whose key is null take no part. Rows that share a key and a text are one
    document (their equal lines are judged alike); rows that share a key only are different ones. No
    documents: no rows. Other columns don't matter.
    """
    bounded_batches(docs.sparkSession)
    lines = written(_exploded(docs, key, text), "lines")
    at = F.struct("doc", "th", "no")
    # Hashes of 128 bits tell lines apart; candidates go by the first 64, where the line of the least other half
    # stands for all.
    nodes = written(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")), "line-nodes")
    doc, th, wanted = (fresh(docs, c) for c in ("doc", "th", "wanted"))
    asked: list[DataFrame] = []

    def texts(ids: DataFrame) -> DataFrame:
        some = linking.sifted(nodes, ["h1"], ids, ["x"])
        some = written(some.join(ids, nodes["h1"] == ids["x"]).select("id", "h1", "h2", "n", "first"), "line-candidates")
        lines_asked = ids.count()
        if some.count() > lines_asked:
            some = some.join(some.groupBy("h1").agg(F.min("h2").alias("h2")), ["h1", "h2"], "left_semi").dropDuplicates(["h1"])
            for before in asked:
                some = some.join(before.select("h1"), "h1", "left_anti")
            some = written(some.select("id", "h1", "h2", "n", "first"), "line-candidates")
        asked.append(some)
        # A document gives the wanted ones of its lines, so that no other line travels.
        places = some.groupBy(F.col("first.doc").alias(doc), F.col("first.th").alias(th)).agg(F.collect_list(F.struct("first.no", "id")).alias(wanted))
        places = written(places, "line-documents")
        t = docs[f"`{text}`"].cast("string")
        near = linking.sifted(docs, [f"`{key}`", F.xxhash64(t)], places, [doc, th])
        near = near.join(linking.bounded(places), (docs[f"`{key}`"] == places[doc]) & (F.xxhash64(t) == places[th]))
        near = near.select(F.col(f"{wanted}.id").alias("id"), _pick()(t, F.col(f"{wanted}.no")).alias("text"))
        found = written(near.select(F.explode(F.arrays_zip("id", "text")).alias("x")).select("x.id", "x.text"), "line-texts")
        # Rows that repeat key and text give their lines again.
        return found if found.count() == lines_asked else written(found.dropDuplicates(["id"]), "line-texts")

    found = linking.classes_of(_groups(docs.where(F.col(f"`{key}`").isNotNull()), text), texts, features, least, APART)
    named = asked[0]
    for some in asked[1:]:
        named = named.unionAll(some)
    classed = written(named.join(linking.bounded(found), "id").select("h1", "h2", "n", "class", "first"), "line-groups")
    stays = written(classed.groupBy("class").agg(F.min("first").alias("stays"), F.count("*").alias("rows")), "line-classes")
    again = nodes.where("n > 1").join(linking.bounded(classed.select("h1", "h2")), ["h1", "h2"], "left_anti")
    lookup = linking.spread(classed, stays, ["class"], "rows").select("h1", "h2", "stays", F.col("n").alias("rows"))
    lookup = written(lookup.unionAll(again.select("h1", "h2", F.col("first").alias("stays"), F.col("n").alias("rows"))), "line-lookup")
    out = linking.spread(lines, lookup, ["h1", "h2"], "rows", "left")
    return out.select("doc", "th", "no", F.coalesce("stays", at).alias("class"), F.coalesce(F.col("stays") == at, F.lit(True)).alias("kept"))


def _drop():
    def drop(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts.to_pylist(), gone.to_pylist()):
            if g:
                g = set(g)
                t = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g)
            out.append(t)
        return pa.array(out, pa.string())

    return F.arrow_udf(drop, T.StringType())


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """`docs` with the lines removed that don't stay (see line_classes); all rows and other columns are kept as they are."""
    found = line_classes(docs, key, text, least).where("not kept").groupBy("doc", "th").agg(F.collect_set("no").alias("gone"))
    doc, th, gone = (fresh(docs, c) for c in ("doc", "th", "gone"))
    found = written(found.toDF(doc, th, gone), "lines-gone")
    keyed = docs.withColumn(th, F.xxhash64(F.col(f"`{text}`").cast("string")))
    rest: Column = _drop()(F.col(f"`{text}`"), F.col(gone))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def cleaned(some: DataFrame) -> DataFrame:
        joined = some.join(linking.bounded(found), (F.col(f"`{key}`") == F.col(doc)) & (some[th] == found[th]), "left")
        return joined.select(*[F.when(F.col(gone).isNull(), c).otherwise(rest).alias(name) if name == text else c for name, c in zip(docs.columns, columns)])

    if found.count() <= linking.BROADCAST_ROWS:
        return cleaned(keyed)
    # Documents that keep all lines don't travel.
    touched = linking.sieve(found, [doc, th])(F.col(f"`{key}`"), th)
    return keyed.where(~touched).select(*columns).unionAll(cleaned(keyed.where(touched)))
