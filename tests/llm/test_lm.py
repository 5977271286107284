import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import lm, queries

from .helpers import DATA

TEXTS = ["the cat sat on the mat", "The cat ate  the\trat", "a dog", "", None, "the the the the", "a cat\x1fsat on É é", "the dog sat on the cat", "a dog"] + ["one two three"] * 300


def brute(train):
    """Interpolated modified Kneser-Ney by dictionaries; a function from (context, word) to a probability."""
    uni, bi = Counter(), Counter()
    for t in train:
        w = lm.tokens(t)
        uni.update(w)
        bi.update(zip([None, *w], w))
    before, after, total = Counter(), defaultdict(list), Counter()
    for (u, w), c in bi.items():
        before[w] += 1
        after[u].append(c)
        total[u] += c
    coc = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    d, e = lm.discounts(coc(bi.values())), lm.discounts(coc(before.values()))
    cut = lambda c, d: 0 if not c else d[min(c, 3) - 1]
    all_before = sum(before.values())
    mass = sum(cut(c, e) for c in before.values()) / all_before

    def p(u, w):
        low = max(before[w] - cut(before[w], e), 0) / all_before + mass / (len(uni) + 1)
        if u not in total:
            return low
        c = bi[u, w]
        return max(c - cut(c, d), 0) / total[u] + sum(cut(c, d) for c in after[u]) / total[u] * low

    return uni, p


@pytest.mark.parametrize("part_bytes", [1 << 30, 1 << 22])
def test_against_dictionaries(spark, part_bytes):
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(TEXTS)], "doc_id long, text string, LM string").repartition(6)
    stored = lm.train(docs, part_bytes=part_bytes)
    uni, p = brute(TEXTS)
    assert stored.tokens == sum(uni.values()) and stored.types == len(uni) and stored.texts == len(TEXTS)
    more = ["unknown words here", "the zebra sat", "cat", None, "x " * 50000]
    probe = spark.createDataFrame([(n, t, "x") for n, t in enumerate(TEXTS[:12] + more)], "doc_id long, text string, LM string")
    got = lm.scored(probe, stored)
    assert got.columns == ["doc_id", "text", "LM", "lm_"]
    for r in got.collect():
        w = lm.tokens(r.text)
        assert r.lm_.n_tokens == len(w) and r.lm_.n_known == sum(uni[x] > 0 for x in w)
        assert r.lm_.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (stored.tokens + len(uni) + 1)) for x in w))
        assert r.lm_.score == pytest.approx(sum(math.log10(p(u, x)) for u, x in zip([None, *w], w)))
    words = [*uni, b"unknown"]
    for u in [None, b"the", b"three", lm.END, b"cat"]:
        assert sum(p(u, w) for w in words) == pytest.approx(1)


def test_no_texts(spark):
    docs = spark.createDataFrame([], "text string")
    one = spark.createDataFrame([("a b",), (None,)], "text string")
    got = lm.scored(one, lm.train(docs)).orderBy(F.desc("text")).collect()
    assert [(r.lm.n_tokens, r.lm.n_known, r.lm.base_score, r.lm.score) for r in got] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


def test_held_out_texts_are_likelier_than_by_counts_alone(spark):
    got = queries.op1_lm(spark, f"{DATA}/sf0.1").toPandas()
    held = got[got.held_out]
    assert len(got) == 10_000 and 1000 < len(held) < 2000
    assert held.score.sum() > 0.9 * held.base_score.sum() and np.isfinite(got.score).all()
    assert got.train_tokens.nunique() == 1 and got[~got.held_out].n_tokens.sum() == got.train_tokens.iloc[0]
    assert (got[~got.held_out].n_tokens == got[~got.held_out].n_known).all()
