"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each of `BOOKS` codebooks. The books
start as k-means of residuals and are refined by least squares over codes that a beam search picks with
all inner products between codewords at hand. Scoring looks a query's inner products with codewords up
and adds them (for `l2`, the stored norm of the decoded vector too; an inner product needs none); the
best share of a shard's distinct vectors is then measured exactly. Each shard holds its vectors beside
their codes, one byte a book, so that exact measuring needs no join. A task merges what its shards find
and sends `k` rows a query on. Vectors of different lengths are different spaces, each with its books.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rillflow.llm.common import bounded_batches, parts, ragged, scan_bytes, written

#: The books are fitted on at most so many vectors, those with the smallest hashes of their ids.
FIT_ROWS = 16_384
BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 4, 1
#: Bytes of vectors of a shard; the share of its distinct vectors that is measured exactly for a query, and the least number, in multiples of k.
SHARD_BYTES, SHARE, LEAST = 16 << 20, 0.02, 4
#: Queries broadcast at a time, and scored at a time.
QUERY_BLOCK, SCORE_BLOCK = 100_000, 128


class Books:
    def __init__(self, words: np.ndarray):
        self.m, self.k, self.d = words.shape
        self.flat = np.ascontiguousarray(words.reshape(self.m * self.k, self.d), dtype=np.float32)
        self.gram = self.flat @ self.flat.T
        self.norms = np.ascontiguousarray(np.diag(self.gram))

    def encode(self, x: np.ndarray, beam: int = BEAM, chunk: int = 512) -> np.ndarray:
        """Codes (as indices into `flat`) of least squared error that the beam search finds."""
        out = [self._encode(x[i : i + chunk].astype(np.float32), beam) for i in range(0, len(x), chunk)]
        return np.concatenate(out) if out else np.zeros((0, self.m), np.int32)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, k = len(x), self.k
        own = self.norms - 2 * (x @ self.flat.T)
        cost, codes = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int32)
        for m in range(self.m):
            block = slice(m * k, (m + 1) * k)
            next_ = cost[:, :, None] + own[:, None, block]
            for j in range(m):
                next_ += 2 * self.gram[codes[:, :, j], block]
            next_ = next_.reshape(n, -1)
            keep = min(beam, next_.shape[1])
            best = np.argpartition(next_, keep - 1, axis=1)[:, :keep] if keep < next_.shape[1] else np.tile(np.arange(keep), (n, 1))
            cost = np.take_along_axis(next_, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k + m * k)[:, :, None].astype(np.int32)], axis=2)
        return codes[np.arange(n), cost.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.flat[codes].sum(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1) - 2 * (x[i : i + 4096] @ c.T)).argmin(1) for i in range(0, len(x), 4096)])
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return c


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 1) -> Books:
    """Books fitted on the rows of `x` (at least one)."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    k = min(words, len(x))
    rest, found = x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, k, rng)
        near = np.concatenate([((c * c).sum(1) - 2 * (rest[i : i + 4096] @ c.T)).argmin(1) for i in range(0, len(x), 4096)])
        rest -= c[near]
        found.append(c)
    out = Books(np.stack(found))
    for _ in range(rounds):
        codes = out.encode(x)
        width = books * k
        gram = np.bincount((codes[:, :, None].astype(np.int64) * width + codes[:, None, :]).ravel(), minlength=width * width).reshape(width, width).astype(np.float64)
        right = np.zeros((width, x.shape[1]))
        for m in range(books):
            np.add.at(right, codes[:, m], x)
        gram[np.diag_indices(width)] += 1e-2
        better = Books(np.linalg.solve(gram, right + 1e-2 * out.flat).reshape(books, k, -1))
        if ((x - better.decode(better.encode(x))) ** 2).sum() >= ((x - out.decode(codes)) ** 2).sum():
            break
        out = better
    return out


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, d) of the rows that take part: id not null, a vector of finite components that isn't zero, and its length."""
    v = F.col(vector)
    ok = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(key).alias("id"), v.alias("v"), F.size(v).alias("d"))


def _matrix(column, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _index(books, kind):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs = [], []
        for b in batches:
            if b.num_rows:
                ids.append(b.column("id").to_numpy(zero_copy_only=False))
                vs.append(_matrix(b.column("v"), kind))
        if not ids:
            return
        ids, v = np.concatenate(ids), np.concatenate(vs)
        by_id = np.argsort(ids, kind="stable")
        ids, v = ids[by_id], v[by_id] + 0.0
        # Equal vectors are coded once; `group` has each row's vector, rows in order of their ids.
        _, first, group = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
        v = v[first]
        codes = books.value.encode(v)
        rows = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[rows], np.arange(len(v) + 1))
        norms = (books.value.decode(codes) ** 2).sum(1)
        codes = (codes - np.arange(codes.shape[1]) * books.value.k).astype(np.uint8)
        blobs = (ids[rows].astype(np.int64), starts.astype(np.int64), v, codes, norms.astype(np.float32))
        yield pa.RecordBatch.from_pydict({n: [x.tobytes()] for n, x in zip(("ids", "starts", "v", "codes", "norms"), blobs)} | {"d": pa.array([v.shape[1]], pa.int32())})

    return build


def exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    q, v = q.astype(np.float64), v.astype(np.float64)
    return (v * q).sum(1) if metric == "ip" else -((v - q) ** 2).sum(1)


def _scores(t: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of table entries: one row a query, one column a vector."""
    out = np.empty((t.shape[1], len(codes)), np.float32)
    for i in range(0, len(codes), 2048):
        s = t[codes[i : i + 2048, 0]]
        for m in range(1, codes.shape[1]):
            s += t[codes[i : i + 2048, m]]
        out[:, i : i + 2048] = s.T
    return out


def _search(books, queries, kind, k: int, metric: str, share: float, rerank: int | None, base: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, (qids, qs) = books.value, queries.value
        tables = (b.flat @ qs.astype(np.float32).T) * np.float32(1 if metric == "ip" else 2)
        # The best of this task's shards so far, by query.
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(qids)
        for batch in batches:
            for r in batch.to_pylist():
                ids, starts = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["starts"], np.int64)
                v = np.frombuffer(r["v"], kind).reshape(-1, r["d"])
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(v), -1) + np.arange(b.m) * b.k
                norms = np.frombuffer(r["norms"], np.float32)
                keep = min(rerank or max(LEAST * k, math.ceil(share * len(v))), len(v))
                for at in range(0, len(qids), SCORE_BLOCK):
                    scores = _scores(np.ascontiguousarray(tables[:, at : at + SCORE_BLOCK]), codes)
                    if metric != "ip":
                        scores -= norms
                    for j in range(len(scores)):
                        near = np.argpartition(-scores[j], keep - 1)[:keep] if keep < len(v) else np.arange(len(v))
                        s = exact(qs[at + j], v[near], metric)
                        # A vector's rows tie; beyond its k + 1 smallest ids none can be among the k nearest.
                        take = np.minimum(starts[near + 1] - starts[near], k + 1)
                        rows = ragged(starts[near], take)
                        who, s = ids[rows], np.repeat(s, take)
                        other = who != qids[at + j]
                        who, s = (np.concatenate(x) for x in zip(best[at + j], (who[other], s[other])))
                        first = np.lexsort((who, -s))[:k]
                        best[at + j] = who[first], s[first]
        for at in range(0, len(qids), SCORE_BLOCK):
            some = best[at : at + SCORE_BLOCK]
            n = [len(w) for w, _ in some]
            q = np.arange(at, at + len(some))
            columns = np.repeat(base + q, n), np.repeat(qids[q], n), np.concatenate([w for w, _ in some]), np.concatenate([s for _, s in some])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "query_id", "vec_id", "score"])

    return search


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, metric: str = "ip", share: float = SHARE, rerank: int | None = None, fit_rows: int = FIT_ROWS, shard_bytes: int = SHARD_BYTES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The `k` nearest rows of `df` for each row of `queries` (of the same columns): query_id, rank, vec_id, score.

    `metric`: `ip` (largest inner product) or `l2` (score: minus the squared distance); ties go to the
    smaller id. Only `usable` rows take part, other columns don't matter; integer ids. A query's candidates
    are the rows of its length. Each row of `queries` is a query of its own, even if it repeats an id; rows
    with the query's id are not its candidates. Fewer than `k` candidates: all of them. No usable rows: no
    rows. The books are fitted on `fit_rows` rows at most; all rows are indexed. `share` of a shard's distinct
    vectors (`LEAST` times `k` at least), or else `rerank` of them, are measured exactly for a query. Blocks of `query_block` queries
    are broadcast, one after another.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = np.float64 if isinstance(df.schema[vector].dataType.elementType, T.DoubleType) else np.float32
    rows, asks = usable(df, key, vector), usable(queries, key, vector)
    sizes = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}
    blocks = {r["d"]: parts(r["count"], query_block) for r in asks.groupBy("d").count().collect()}
    found, schema = None, "q bigint, query_id bigint, vec_id bigint, score double"
    every = sum(n * d for d, n in sizes.items())
    base = 0
    for d in sorted(sizes.keys() & blocks.keys()):
        here = rows.where(F.col("d") == d).select("id", "v")
        some = here.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").toArrow()
        books = spark.sparkContext.broadcast(fit(np.unique(_matrix(some.column("v"), kind), axis=0)))
        shards = here.repartition(parts(scan_bytes(df.select(key, vector)) * sizes[d] * d / every, shard_bytes))
        index = written(shards.mapInArrow(_index(books, kind), "ids binary, starts binary, v binary, codes binary, norms binary, d int"), "aq-index")
        # A task for each core, each with as many shards.
        index = index.coalesce(max(1, spark.sparkContext.defaultParallelism))
        mine = asks.where(F.col("d") == d).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks[d])).alias("block"))
        mine = written(mine.repartition("block"), "aq-queries") if blocks[d] > 1 else mine
        for n in range(blocks[d]):
            block = mine.where(F.col("block") == n).toArrow()
            if not block.num_rows:
                continue
            shared = spark.sparkContext.broadcast((block.column("id").to_numpy().astype(np.int64), _matrix(block.column("v"), kind)))
            part = index.mapInArrow(_search(books, shared, kind, k, metric, share, rerank, base << 40), schema)
            part = written(part, "aq-found") if blocks[d] > 1 else part
            found = part if found is None else found.unionAll(part)
            base += 1
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
