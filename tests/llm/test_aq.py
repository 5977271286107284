import math

import numpy as np
import pytest

from rillflow.llm import aq, queries

from .helpers import DATA

D = "vec_id long, embedding array<float>, note string"


def brute(rows, k, metric="ip"):
    out = []
    for q, x in rows:
        s = [(aq.exact(np.float32(x), np.float32([v]), metric)[0], i) for i, v in rows if i != q]
        out += [(q, n + 1, i, t) for n, (t, i) in enumerate(sorted(s, key=lambda y: (-y[0], y[1]))[:k])]
    return sorted(out)


def test_ties_and_unusable_rows(spark):
    good = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(100 + i, [float(i), -1.0]) for i in range(7)]
    bad = [(1000, None), (1001, [0.0, 0.0]), (1002, [1.0, None]), (1003, [math.nan, 1.0]), (1004, [math.inf, 1.0]), (1005, [1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], D)
    for metric in ("ip", "l2"):
        for shard in (1 << 24, 1 << 30):
            got = aq.nearest(df, df, k=5, metric=metric, shard_bytes=shard, query_block=30)
            assert sorted(map(tuple, got.collect())) == brute(good, 5, metric)


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [3.0, 1.0], "")], D)
    assert sorted(map(tuple, aq.nearest(df, df, k=20).collect())) == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]
    assert aq.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("rerank", [None, 60])
def test_recall_and_scores(spark, rerank):
    """Also where, as in large shards, three in a hundred vectors are measured exactly."""
    every = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    found = queries.op3_nearest(spark, f"{DATA}/sf0.1") if rerank is None else aq.nearest(every, every.where("vec_id % 20 = 0"), rerank=rerank)
    got = found.toPandas()
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").toPandas()
    v = np.stack(rows.embedding).astype(np.float64)
    ids = rows.vec_id.to_numpy()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        hit += len(set(ids[best]) & set(g.vec_id))
        at = {i: x for i, x in zip(ids, s)}
        assert np.allclose([at[i] for i in g.vec_id], g.score, rtol=0, atol=1e-12) and sorted(g["rank"]) == list(range(1, 21))
    assert got.query_id.nunique() == 100 and hit >= 0.9 * 2000


def test_books_beat_their_start():
    x = np.random.default_rng(3).normal(size=(600, 8)).astype(np.float32)
    error = lambda b: ((x - b.decode(b.encode(x))) ** 2).sum()
    assert error(aq.fit(x, 3, 16, 3)) <= error(aq.fit(x, 3, 16, 0))


def test_lengths_are_spaces_of_their_own(spark):
    """The commonest length among the queries isn't that among the rows."""
    rows = [(i, [float(i % 7), 1.0, float(i % 3), 2.0]) for i in range(40)] + [(20 * i, [1.0, float(i)]) for i in range(100, 103)]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], D)
    got = sorted(map(tuple, aq.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()))
    want = [x for d in (4, 2) for x in brute([r for r in rows if len(r[1]) == d], 5) if x[0] % 20 == 0]
    assert got == sorted(want)
