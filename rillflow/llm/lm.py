"""Scoring by an interpolated modified Kneser-Ney bigram model.

Tokens are the maximal runs of bytes other than white space, A-Z lower-cased, then one end a text. The
model is counted in Spark and stored as sorted arrays in files that workers map into memory:

* words: hashes in order, a word's id being its rank, and counts; one file a range of hashes;
* pairs: (id before << 32 | id) in order and counts (one byte; larger ones apart), one file a range;
  the ranges are split within the words that come most often, so that none of them fills a range;
* per word: number of distinct words before it, and the weight that it gives the lower order.

What tasks send on is packed and pre-aggregated. The files are written by Spark's text writer (one
binary row a file, then a line feed), so that commits and retries work on any file system; workers map
local files in place and others through `SparkContext.addFile`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import bounded_batches, fresh, kept, parts, scan_bytes, work_dir

#: Bytes of documents for each file of the model.
PART_BYTES, MOST_PARTS = 16 << 20, 4096
#: Words and pairs that a worker holds before it sends them on; words whose ids it keeps.
HELD, HELD_PAIRS = 400_000, 3_000_000
END = b"\n"
END_HASH = xxhash.xxh3_64_intdigest(END)
U64 = np.uint64


def tokens(text: str | None) -> list[bytes]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w.append(END)
    return w


# ---- packed exchange -------------------------------------------------------------------------------


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _dealt(keys: np.ndarray, values: list[np.ndarray], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their values, cut at the splitters: (part, data) rows."""
    cuts = [0, *np.searchsorted(keys, splitters, "left").tolist(), len(keys)]
    for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if z > a:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed([keys[a:z], *(v[a:z] for v in values)])])], ["part", "data"])


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Number of arrays, then for each its length in bytes, padded data; 8-byte words."""
    out = [U64(len(arrays)).tobytes()]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        out += [U64(len(raw)).tobytes(), raw, b"\0" * (-len(raw) % 8)]
    return b"".join(out)


def _unpacked(raw, kinds: list) -> list[np.ndarray]:
    at, out = 8, []
    for kind in kinds:
        size = int(np.frombuffer(raw, U64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size + -size % 8
    return out


def _gathered(batches: Iterator[pa.RecordBatch], kinds: list) -> dict[int, list[np.ndarray]]:
    held: dict[int, list] = {}
    for b in batches:
        for p, raw in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
            held.setdefault(p, []).append(_unpacked(raw, kinds))
    return {p: [np.concatenate(x) for x in zip(*rows)] for p, rows in held.items()}


_ROW = "part int, data binary"


def _row(part: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(arrays)])], ["part", "data"])


def _stored(df: DataFrame, purpose: str) -> dict[int, str]:
    """Writes the data of each part into a file; the files by part."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.select(F.col("data").cast("string").alias("value"), "part").write.partitionBy("part").text(path)
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = system.listFiles(top, True), {}
    while files.hasNext():
        at = files.next().getPath()
        if at.getParent().getName().startswith("part="):
            where = at.toString()
            if not where.startswith("file:"):
                spark.sparkContext.addFile(where)
            found[int(at.getParent().getName()[5:])] = where
    return found


def _mapped(where: str) -> np.ndarray:
    path = "/" + where.removeprefix("file:").lstrip("/") if where.startswith("file:") else SparkFiles.get(where.rsplit("/", 1)[1])
    return np.memmap(path, np.uint8, "r")


# ---- the stored model ------------------------------------------------------------------------------


@dataclass
class Stored:
    """Where the model's arrays are, and its constants."""

    words: dict[int, str]
    offsets: list[int]
    hash_splitters: np.ndarray
    pairs: dict[int, str]
    pair_splitters: np.ndarray
    lower: dict[int, str]
    tokens: int
    texts: int
    types: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_total: int
    lower_mass: float


class Model:
    """The arrays of a stored model, mapped into memory; the start of a text is the word of id `types`."""

    def __init__(self, stored: Stored):
        self.s = stored
        n = len(stored.offsets)
        none = _packed([np.zeros(0)] * 3)
        load = lambda files, p: _mapped(files[p]) if p in files else none
        self.words = [_unpacked(load(stored.words, p), [U64, np.int64]) for p in range(n)]
        self.lower = [_unpacked(load(stored.lower, p), [np.int64, np.float64]) for p in range(n)] if stored.lower else []
        self.pairs = [_unpacked(load(stored.pairs, p), [U64, np.uint8, np.int64, np.int64]) if p in stored.pairs else None for p in range(len(stored.pair_splitters) + 1)] if stored.pairs else []
        self.at: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of words, -1 for unknown ones."""
        at = self.at
        new = [w for w in set(words) if w not in at]
        if new:
            if len(at) > HELD:
                at.clear()
                new = list(set(words))
            hashes = np.fromiter((END_HASH if w == END else xxhash.xxh3_64_intdigest(w) for w in new), U64, len(new))
            at.update(zip(new, self.find(hashes).tolist()))
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        order = np.argsort(hashes)
        hashes, out = hashes[order], np.full(len(hashes), -1, np.int64)
        cuts = [0, *np.searchsorted(hashes, self.s.hash_splitters, "left").tolist(), len(hashes)]
        for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
            keys = self.words[p][0]
            if z > a and len(keys):
                k = np.minimum(np.searchsorted(keys, hashes[a:z]), len(keys) - 1)
                out[a:z] = np.where(keys[k] == hashes[a:z], k + self.s.offsets[p], -1)
        back = np.empty_like(out)
        back[order] = out
        return back

    def of_ids(self, arrays: list, column: int, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids, all known."""
        cuts = [*np.searchsorted(ids, self.s.offsets, "left").tolist(), len(ids)]
        return np.concatenate([arrays[p][column][ids[a:z] - self.s.offsets[p]] for p, (a, z) in enumerate(zip(cuts, cuts[1:]))]) if len(ids) else np.zeros(0)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs, 0 for unseen ones."""
        out = np.zeros(len(keys), np.int64)
        cuts = [0, *np.searchsorted(keys, self.s.pair_splitters, "left").tolist(), len(keys)]
        for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if z > a and self.pairs and self.pairs[p] is not None:
                known, small, where, large = self.pairs[p]
                k = np.minimum(np.searchsorted(known, keys[a:z]), len(known) - 1)
                count = small[k].astype(np.int64)
                if len(where):
                    big = np.flatnonzero(count == 255)
                    count[big] = large[np.searchsorted(where, k[big])]
                out[a:z] = np.where(known[k] == keys[a:z], count, 0)
        return out

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text: tokens, known tokens, base score, model score."""
        s = self.s
        split = [tokens(t) for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        starts = np.cumsum(size) - size
        ids = self.ids([w for x in split for w in x])
        distinct, back = np.unique(ids, return_inverse=True)
        known = distinct >= 0
        count, below = np.zeros(len(distinct), np.int64), np.zeros(len(distinct))
        before = np.zeros(len(distinct), np.int64)
        if known.any():
            count[known] = self.of_ids(self.words, 1, distinct[known])
            before[known] = self.of_ids(self.lower, 0, distinct[known])
            below[known] = self.of_ids(self.lower, 1, distinct[known])
        # Lower order: continuation counts, interpolated with the uniform distribution over all words and an unknown one.
        uniform = 1 / (s.types + 1)
        low = (np.maximum(before - _discount(before, s.lower_discounts), 0) / s.lower_total + s.lower_mass * uniform) if s.lower_total else np.full(len(distinct), uniform)
        base = np.log10((count + 1) / (s.tokens + (s.types + 1)))
        previous = np.empty(len(ids), np.int64)
        previous[1:] = ids[:-1]
        previous[starts] = s.types
        p = low[back].copy()
        seen = (previous >= 0) if s.types else np.zeros(len(ids), bool)
        if seen.any():
            context, weight = np.ones(len(ids)), np.ones(len(ids))
            context[1:], weight[1:] = count[back[:-1]], below[back[:-1]]
            context[starts], weight[starts] = s.texts, self.lower[-1][1][-1]
            pairs = (previous[seen].astype(U64) << U64(32)) | np.where(ids[seen] < 0, s.types, ids[seen]).astype(U64)
            unique, where = np.unique(pairs, return_inverse=True)
            c = self.pair_counts(unique)
            higher = np.maximum(c - _discount(c, s.discounts), 0)[where]
            p[seen] = higher / context[seen] + weight[seen] * p[seen]
        total = lambda x: np.add.reduceat(x, starts)
        return [size, total((count > 0)[back].astype(np.int64)), total(base[back]), total(np.log10(p))]


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams that come once to four times; 0.5, 1 and 1.5 where these don't give any."""
    out = []
    for k, other in ((1, 0.5), (2, 1.0), (3, 1.5)):
        ok = n[0] and n[1] and n[k - 1]
        d = k - (k + 1) * (n[0] / (n[0] + 2 * n[1])) * n[k] / n[k - 1] if ok else other
        out.append(d if 0 < d < k else other)
    return tuple(out)




def _model(shared) -> Model:
    return kept(shared, lambda: Model(shared.value))


# ---- counting --------------------------------------------------------------------------------------


def _count_words(splitters: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out():
            keys = np.fromiter((END_HASH if w == END else xxhash.xxh3_64_intdigest(w) for w in held), U64, len(held))
            keys, n = _summed(keys, np.fromiter(held.values(), np.int64, len(held)))
            held.clear()
            return _dealt(keys, [n], splitters)

        get = held.get
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in tokens(t):
                    held[w] = get(w, 0) + 1
                if len(held) > HELD:
                    yield from out()
        yield from out()

    return count


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, (keys, n) in _gathered(batches, [U64, np.int64]).items():
        yield _row(p, list(_summed(keys, n)))


def _count_pairs(shared, splitters: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for b in batches:
            split = [tokens(t) for t in b.column(0).to_pylist()]
            size = np.fromiter(map(len, split), np.int64, len(split))
            ids = model.ids([w for x in split for w in x]).astype(U64)
            before = np.empty_like(ids)
            before[1:] = ids[:-1]
            before[np.cumsum(size) - size] = model.s.types
            k, n = np.unique((before << U64(32)) | ids, return_counts=True)
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > HELD_PAIRS:
                yield from _dealt(*_one(keys, counts), splitters)
        yield from _dealt(*_one(keys, counts), splitters)

    def _one(keys, counts):
        k, n = _summed(np.concatenate(keys), np.concatenate(counts))
        del keys[1:], counts[1:]
        return k, [n]

    return count


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, (keys, n) in _gathered(batches, [U64, np.int64]).items():
        keys, n = _summed(keys, n)
        big = np.flatnonzero(n >= 255)
        yield _row(p, [keys, np.minimum(n, 255).astype(np.uint8), big, n[big]])


def _over(spark: SparkSession, files: dict[int, str], task: Callable, schema: str) -> DataFrame:
    """`task` over the files, one a task."""
    rows = spark.createDataFrame(sorted(files.items()), "part int, file string")
    return rows.repartitionById(max(files) + 1, "part").mapInArrow(task, schema)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for f in b.column("file").to_pylist():
            small = _unpacked(_mapped(f), [U64, np.uint8])[1]
            n = np.bincount(small, minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array([int(n[k])]) for k in (1, 2, 3, 4)], ["n1", "n2", "n3", "n4"])


def _neighbours(splitters: np.ndarray, d: tuple[float, float, float]):
    """For each file of pairs: by word, how many distinct words stand before it, and the discounts that it saves as a context."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column("file").to_pylist():
                keys, small = _unpacked(_mapped(f), [U64, np.uint8])
                after, n = np.unique(keys & U64(0xFFFFFFFF), return_counts=True)
                yield from _dealt(after, [n.astype(np.int64), np.zeros(len(after))], splitters)
                before = keys >> U64(32)
                first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
                saved = np.add.reduceat(_discount(small, d), first)
                yield from _dealt(before[first], [np.zeros(len(first), np.int64), saved], splitters)

    return count


def _merge_lower(shared, offsets: list[int], types: int, texts: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _model(shared).words
        for p, (ids, n, saved) in _gathered(batches, [U64, np.int64, np.float64]).items():
            last = p == len(offsets) - 1
            count = np.append(words[p][1], texts) if last else words[p][1]
            at = ids.astype(np.int64) - offsets[p]
            before = np.bincount(at, n, len(count)).astype(np.int64)
            yield _row(p, [before, np.bincount(at, saved, len(count)) / count])

    return merge


def _tally_lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for f in b.column("file").to_pylist():
            before = _unpacked(_mapped(f), [np.int64])[0]
            n = np.bincount(np.minimum(before, 5), minlength=6)
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*n[1:5], (before > 2).sum(), before.sum())], ["n1", "n2", "n3", "n4", "more", "total"])


def train(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> Stored:
    """A model of the texts of `docs`; a null counts as the empty text, every row counts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sc = spark.sparkContext
    some = docs.select(F.col(text).cast("string").alias("text"))
    size = scan_bytes(docs.select(text))
    # Parts grow with the data, so that workers map a bounded number of files.
    n = parts(size, max(part_bytes, math.ceil(size / MOST_PARTS)))
    split = (np.arange(1, n, dtype=np.float64) / n * 2.0**64).astype(U64)
    counted = some.mapInArrow(_count_words(split), _ROW).repartitionById(n, F.col("part")).mapInArrow(_merge_words, _ROW)
    words = _stored(counted, "lm-words")
    if not words:
        return Stored({}, [0], np.zeros(0, U64), {}, np.zeros(0, U64), {}, 0, 0, 0, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0, 1.0)

    # Sizes of the parts, and the words that alone fill half a part or more: at most 2 n of them.
    def sizes(batches):
        for b in batches:
            for p, f in zip(b.column("part").to_pylist(), b.column("file").to_pylist()):
                keys, count = _unpacked(_mapped(f), [U64, np.int64])
                end = count[keys == U64(END_HASH)].sum()
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([len(keys)]), pa.array([int(count.sum())]), pa.array([int(end)])], ["part", "types", "tokens", "texts"])

    found = _over(spark, words, sizes, "part bigint, types bigint, tokens bigint, texts bigint").collect()
    by_part = {r["part"]: r for r in found}
    offsets, types = [], 0
    for p in range(n):
        offsets.append(types)
        types += by_part[p]["types"] if p in by_part else 0
    total, texts = sum(r["tokens"] for r in found), sum(r["texts"] for r in found)
    if types >= 1 << 32:
        raise ValueError("the model holds fewer than 2**32 distinct words")
    stored = Stored(words, offsets, split, {}, np.zeros(0, U64), {}, total, texts, types, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0, 1.0)

    def frequent(batches):
        for b in batches:
            for p, f in zip(b.column("part").to_pylist(), b.column("file").to_pylist()):
                count = _unpacked(_mapped(f), [U64, np.int64])[1]
                at = np.flatnonzero(count * 2 * n > total)
                yield pa.RecordBatch.from_arrays([pa.array(at + offsets[p]), pa.array(count[at])], ["id", "count"])

    often = [(types, texts)] + [(r["id"], r["count"]) for r in _over(spark, words, frequent, "id bigint, count bigint").collect()]
    borders = {(types * k // n) << 32 for k in range(1, n)}
    for i, c in often:
        pieces = max(1, math.ceil(2 * n * c / total))
        borders |= {(i << 32) + (types * k // pieces if k else 0) for k in range(pieces)} | {(i + 1) << 32}
    stored.pair_splitters = np.array(sorted(b for b in borders if 0 < b < 1 << 64), U64)
    shared = sc.broadcast(stored)
    pairs = some.mapInArrow(_count_pairs(shared, stored.pair_splitters), _ROW)
    stored.pairs = _stored(pairs.repartitionById(len(stored.pair_splitters) + 1, F.col("part")).mapInArrow(_merge_pairs, _ROW), "lm-pairs")

    tally = _over(spark, stored.pairs, _tally, "n1 bigint, n2 bigint, n3 bigint, n4 bigint").groupBy().sum().first()
    stored.discounts = discounts([int(x) for x in tally])
    # The last range also holds the start of a text, whose id is the number of words.
    starts = np.array(offsets[1:], U64)
    near = _over(spark, stored.pairs, _neighbours(starts, stored.discounts), _ROW).repartitionById(n, F.col("part"))
    stored.lower = _stored(near.mapInArrow(_merge_lower(shared, offsets, types, texts), _ROW), "lm-lower")
    tally = _over(spark, stored.lower, _tally_lower, "n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint, total bigint").groupBy().sum().first()
    n1, n2, n3, n4, more, stored.lower_total = (int(x) for x in tally)
    d = stored.lower_discounts = discounts([n1, n2, n3, n4])
    stored.lower_mass = (d[0] * n1 + d[1] * n2 + d[2] * more) / stored.lower_total
    return stored


SCORES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def scored(docs: DataFrame, stored: Stored, text: str = "text", into: str = "lm") -> DataFrame:
    """`docs` with a struct column `into` (renamed if taken): n_tokens, n_known, base_score, score (log10 of the text's probability).

    A null text counts as empty: one token, the end. Words not met in training have the probability of
    one unknown word; a model of no texts gives every token the probability 1. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(stored)

    def score(texts: pa.Array) -> pa.Array:
        model, held = _model(shared), texts.to_pylist()
        found = [model.score(held[i : i + 500]) for i in range(0, len(held), 500)]
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, k) for k in (np.int64, np.int64, float, float)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=SCORES.names)

    return docs.withColumn(fresh(docs, into), F.arrow_udf(score, SCORES)(F.col(text).cast("string")))


def perplexity(lm: Column) -> Column:
    """Per token, of the struct that `scored` gives."""
    return F.pow(F.lit(10.0), -lm["score"] / lm["n_tokens"])
