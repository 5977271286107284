"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; its weight is its count in the document times the mean inverse document
frequency of its words. Document frequencies are counted over all documents; words in fewer than
`RARE` of them weigh as if they were in that share, so at most (mean distinct words) / RARE words are
broadcast. Samples agree with the probability of the weighted Jaccard similarity; they are banded, and
candidates are verified by the exact weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm import linking
from rillflow.llm.common import bounded_batches, fresh, kept, mix, written
from rillflow.llm.decontam import words

SHINGLE = 5
#: At a similarity of 0.8, 10 bands of 3 samples miss a candidate in a thousand.
BANDS, ROWS = 10, 3
LEAST = 0.8
RARE = 1e-3
#: Words that a worker keeps hashes or counts of.
HELD = 500_000

_RNG = np.random.default_rng(6)
_SEEDS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAIN = 1 << 16
_R = _RNG.gamma(2, 1, _GRAIN).astype(np.float32)
_LN_C = np.log(_RNG.gamma(2, 1, _GRAIN)).astype(np.float32)
_BETA = _RNG.random(_GRAIN).astype(np.float32)


class Weigher:
    """Features of texts; keeps the hashes and weights of words that it has met."""

    def __init__(self, idf: dict[int, float], rarest: float):
        self.idf, self.rarest, self.at = idf, rarest, {}
        self.hashes: list[int] = []
        self.weights: list[float] = []
        self.arrays = (np.zeros(0, np.uint64), np.zeros(0))

    def _index(self, w: list[bytes]) -> np.ndarray:
        at = self.at
        if len(at) > HELD:
            at.clear()
            self.hashes, self.weights = [], []
        new = [x for x in set(w) if x not in at]
        for x in new:
            h = xxhash.xxh3_64_intdigest(x)
            at[x] = len(self.hashes)
            self.hashes.append(h)
            self.weights.append(self.idf.get(h, self.rarest))
        if new or len(self.arrays[0]) != len(self.hashes):
            if len(self.arrays[0]) < len(self.hashes) - len(new) or len(self.hashes) == len(new):
                self.arrays = (np.array(self.hashes, np.uint64), np.array(self.weights))
            else:
                n = len(self.arrays[0])
                self.arrays = (np.append(self.arrays[0], np.array(self.hashes[n:], np.uint64)), np.append(self.arrays[1], self.weights[n:]))
        return np.fromiter(map(at.__getitem__, w), np.int64, len(w))

    def many(self, texts: list[str | None]) -> list[linking.Features]:
        split = [words(t) for t in texts]
        flat = self._index([x for w in split for x in w])
        h, weight = self.arrays[0][flat], self.arrays[1][flat]
        out, at = [], 0
        for w in split:
            out.append(_shingles(h[at : at + len(w)], weight[at : at + len(w)]))
            at += len(w)
        return out


def _shingles(h: np.ndarray, weight: np.ndarray) -> linking.Features:
    """Sorted distinct hashes of runs of five words (of all words, if fewer) and their weights."""
    if not len(h):
        return h, weight, 0.0
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    key, total = np.full(n, size, np.uint64), np.zeros(n)
    for j in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        key ^= key >> np.uint64(29)
        total += weight[j : j + n]
    key, first, count = np.unique(mix(key), return_index=True, return_counts=True)
    weights = count * total[first] / size
    return key, weights, float(weights.sum())


def samples(f: linking.Features) -> np.ndarray:
    """Consistent weighted samples, as hashes of (feature, quantised weight)."""
    h, w, _ = f
    g = (h[None, :] ^ _SEEDS[:, None]) * _ODD[:, None]
    g ^= g >> np.uint64(32)
    low = np.uint64(_GRAIN - 1)
    r = _R[g & low]
    t = np.floor(np.log(w).astype(np.float32)[None, :] / r + (beta := _BETA[(g >> np.uint64(16)) & low]))
    ln_a = _LN_C[(g >> np.uint64(32)) & low] - r * (t - beta + np.float32(1))
    best = ln_a.argmin(1)
    return mix(h[best] + t[np.arange(len(t)), best].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def keys(f: linking.Features) -> np.ndarray:
    if not len(f[0]):
        return np.zeros(0, np.int64)
    s = samples(f).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, r])
    return key.astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def out():
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts.values(), pa.int64())], ["word", "n"])

    docs = 0
    for b in batches:
        for t in b.column(0).to_pylist():
            docs += 1
            for w in set(words(t)):
                counts[w] = counts.get(w, 0) + 1
        if len(counts) > HELD:
            yield out()
            counts.clear()
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs], pa.int64())], ["word", "n"])


def word_weights(docs: DataFrame, text: str = "text", rare: float = RARE) -> tuple[dict[int, float], float]:
    """Inverse document frequencies by word hash, and that of all rarer words."""
    counts = docs.select(F.col(text).cast("string")).mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    least = max(1.0, rare * total)
    often = counts.where((F.col("word").isNotNull()) & (F.col("n") >= least)).toArrow()
    idf = lambda n: 1 + math.log((total + 1) / (n + 1))
    hashes = often.column("word").to_numpy().astype(np.uint64).tolist()
    return {h: idf(n) for h, n in zip(hashes, often.column("n").to_pylist())}, idf(least)




class _Shared:
    """Features by broadcast word weights; a worker keeps one weigher."""

    def __init__(self, shared):
        self.shared = shared

    def weigher(self) -> Weigher:
        return kept(self.shared, lambda: Weigher(*self.shared.value))

    def __call__(self, texts: list[str | None]) -> list[linking.Features]:
        return [f for i in range(0, len(texts), 200) for f in self.weigher().many(texts[i : i + 200])]


def _keys(shared: _Shared):
    def sign(texts: pa.Array) -> pa.Array:
        return pa.array([keys(f) for f in shared(texts.to_pylist())], pa.list_(pa.int64()))

    return F.arrow_udf(sign, T.ArrayType(T.LongType()))


def document_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, rare: float = RARE) -> DataFrame:
    """One row for each row of `docs` with a key: id, h1, h2 (text hashes), class (smallest key of its class).

    Equal texts are one class, null and empty texts too (a null counts as empty). Texts without words
    are similar to equal ones only; fewer than five words make one shingle. Rows whose key is null take
    no part. Rows that share a key are classed by their texts. No documents: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    some = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), t.alias("text"))
    features = _Shared(spark.sparkContext.broadcast(word_weights(some, "text", rare)))
    hashed = some.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    rows = written(hashed.select("id", "h1", "h2", _keys(features)("text").alias("keys")), "signatures")
    nodes = rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.any_value("keys").alias("keys"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "text-nodes")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = written(nodes.join(ids, nodes["node"] == ids["id"]).select("node", "h1", "h2", "first"), "text-candidates")
        found = linking.sifted(hashed, ["id", "h1"], wanted, ["first", "h1"])
        found = found.join(linking.bounded(wanted), ["h1", "h2"]).where(F.col("id") == F.col("first"))
        found = written(found.select(F.col("node").alias("id"), "text"), "candidate-texts")
        # Rows that repeat key and text give it again.
        return found if found.count() == wanted.count() else written(found.dropDuplicates(["id"]), "candidate-texts")

    found = linking.classes(nodes.select(F.col("node").alias("id"), "keys"), texts, features, least).withColumnRenamed("id", "node")
    named = nodes.select("node", "h1", "h2", "first").join(linking.bounded(found), "node", "left")
    named = written(named.withColumn("class", F.coalesce("class", "node")), "text-classes")
    smallest = named.groupBy("class").agg(F.min("first").alias("smallest"))
    named = written(named.join(smallest, "class").select("h1", "h2", "smallest"), "named-texts")
    return rows.drop("keys").join(linking.bounded(named), ["h1", "h2"]).select("id", "h1", "h2", F.col("smallest").alias("class"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, rare: float = RARE) -> DataFrame:
    """The rows of `docs` whose key is the smallest of their class, one of rows that repeat key and text, and the rows without a key."""
    h1, h2, id_, n = (fresh(docs, c) for c in ("h1", "h2", "id", "n"))
    found = document_classes(docs, key, text, least, rare).groupBy("id", "h1", "h2", "class").agg(F.count("*").alias("n"))
    # Those that go and those of which one stays are few; the texts of others don't travel.
    found = written(found.where("id <> class or n > 1").select(F.col("id").alias(id_), F.col("h1").alias(h1), F.col("h2").alias(h2), F.when(F.col("id") == F.col("class"), F.col("n")).alias(n)), "documents-judged")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = docs.where(F.col(key).isNotNull()).withColumn(h1, F.xxhash64(t)).withColumn(h2, F.xxhash64(F.lit(1), t))
    on = (F.col(key) == F.col(id_)) & (hashed[h1] == found[h1]) & (hashed[h2] == found[h2])
    columns = [hashed[f"`{c}`"] for c in docs.columns]
    if found.count() <= linking.BROADCAST_ROWS:
        out = hashed.join(F.broadcast(found), on, "left_anti").select(*columns)
    else:
        judged = linking.sieve(found, [id_, h1, h2])(key, h1, h2)
        out = hashed.where(~judged).select(*columns).unionAll(hashed.where(judged).join(found, on, "left_anti").select(*columns))
    again = found.where(F.col(n) > 1)
    if not again.isEmpty():
        out = out.unionAll(hashed.join(linking.bounded(again), on, "left_semi").dropDuplicates([key, h1, h2]).select(*docs.columns))
    return out.unionAll(docs.where(F.col(key).isNull()))
