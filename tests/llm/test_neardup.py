import math
import random

import numpy as np
import pytest

from rillflow.llm import decontam, linking, neardup

from .test_linking import closure

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "st", "tu", "vo", "wi", "xa")]


def texts():
    rng = random.Random(9)
    out = []
    for g in range(12):
        base = [rng.choice(WORDS) for _ in range(120)]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return out + out[:3] + ["", None, "!!", "one two", "One, two", "one two three", None]


def brute(all_texts, least, rare):
    split = [decontam.words(t) for t in all_texts]
    df = {}
    for w in split:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    n = len(split)
    idf = {x: 1 + math.log((n + 1) / (max(c, max(1.0, rare * n)) + 1)) for x, c in df.items()}
    bags = []
    for w in split:
        k, bag = min(5, len(w)), {}
        for i in range(len(w) - k + 1 if k else 0):
            s = tuple(w[i : i + k])
            bag[s] = bag.get(s, 0) + sum(idf[x] for x in s) / k
        bags.append(bag)
    links = []
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            low = sum(min(v, b.get(s, 0)) for s, v in a.items())
            high = sum(a.values()) + sum(b.values()) - low
            if (all_texts[i] or "") == (all_texts[j] or "") or (high and low / high >= least):
                links.append((i, j))
    return closure(range(n), links)


@pytest.mark.parametrize("rare", [1e-3, 0.5])
def test_classes_against_all_pairs(spark, rare):
    t = texts()
    df = spark.createDataFrame([(i, x, "n") for i, x in enumerate(t)] + [(None, t[0], "n")], "doc_id long, text string, H1 string")
    got = {r.id: r["class"] for r in neardup.document_classes(df, rare=rare).collect()}
    assert got == brute([*t, t[0]] if rare < 0 else t, neardup.LEAST, rare)
    out = neardup.deduplicated(df, rare=rare)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: -1 if x is None else x) == [None, *sorted(set(got.values()))]


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in neardup.deduplicated(df).collect()) == [(1, "a b c d e f"), (3, "")]
    assert neardup.deduplicated(df.limit(0)).count() == 0


def test_samples_collide_as_often_as_texts_are_similar():
    rng = np.random.default_rng(4)
    same, n = 0, 0
    for trial in range(60):
        h = np.unique(rng.integers(0, 1 << 62, 150).astype(np.uint64))
        wa = rng.random(120) + 0.5
        wb = np.append(wa[20:], rng.random(len(h) - 120) + 0.5)
        a, b = (h[:120], wa, wa.sum()), (h[20:], wb, wb.sum())
        same += (neardup.samples(a) == neardup.samples(b)).sum()
        n += neardup.BANDS * neardup.ROWS * linking.weighted_jaccard(a, b)
    assert same / n == pytest.approx(1, abs=0.1)


def test_documents_that_stay_do_not_travel(spark, monkeypatch):
    texts = ["one two three four five six", "a b c d e f g h", "", "x y z", "one two three four five six", "m n o p q r s t u v"]
    df = spark.createDataFrame([*enumerate(texts), (1, texts[1]), (None, "x y z")], "doc_id long, text string")
    want = sorted(map(str, [*enumerate(texts[:4]), (5, texts[5]), (None, "x y z")]))
    rows = lambda out: sorted(str(tuple(r)) for r in out.collect())
    monkeypatch.setattr(neardup.linking, "BROADCAST_ROWS", 2)
    assert rows(neardup.deduplicated(df.where("doc_id <> 1"))) == [w for w in want if not w.startswith(("(1,", "(None"))]
    out = neardup.deduplicated(df.where("doc_id <> 1"))
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    for bound in (0, 2, 50_000):
        monkeypatch.setattr(neardup.linking, "BROADCAST_ROWS", bound)
        assert rows(neardup.deduplicated(df)) == want
