import random

import numpy as np
import pytest

from rillflow.llm import linking


def closure(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bound", [0, linking.FOREST_EDGES])
@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, monkeypatch, shape, bound):
    monkeypatch.setattr(linking, "FOREST_EDGES", bound)
    rng = random.Random(shape)
    links = {"chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(80)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "none": []}[shape]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    want = {n: c for n, c in closure({x for e in links for x in e}, links).items()}
    alone = {n for n in want if list(want.values()).count(want[n]) == 1}
    assert {r.id: r["class"] for r in linking.components(df).collect()} == {n: c for n, c in want.items() if n not in alone}


def letters(text):
    h = np.array(sorted({ord(c) for c in text}), np.uint64)
    return h, np.ones(len(h)), float(len(h))


def test_no_link_between_classes_is_lost(spark, monkeypatch):
    """All texts share one key; many are unlike its smallest id but like one another."""
    monkeypatch.setattr(linking, "BLOCK", 4)
    monkeypatch.setattr(linking, "SPLIT", 3)
    rng = random.Random(2)
    texts = {i: "".join(rng.sample("abcdefgh", rng.randrange(3, 8))) for i in range(60)}
    nodes = spark.createDataFrame([(i, [7, 8 + i % 2]) for i in texts], "id long, keys array<long>")
    table = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = linking.classes(nodes, lambda ids: table.join(ids, "id"), lambda x: list(map(letters, x)), 0.8)
    links = [(a, b) for a in texts for b in texts if a < b and linking.weighted_jaccard(letters(texts[a]), letters(texts[b])) >= 0.8]
    want = closure(texts, links)
    have = {r.id: r["class"] for r in got.collect()}
    assert {i: have.get(i, i) for i in texts} == want


def test_weighted_jaccard():
    a = (np.array([1, 3, 5], np.uint64), np.array([1.0, 2.0, 3.0]), 6.0)
    b = (np.array([3, 5, 9], np.uint64), np.array([1.0, 4.0, 1.0]), 6.0)
    assert linking.weighted_jaccard(a, b) == pytest.approx(4 / 8)
    empty = (np.zeros(0, np.uint64), np.zeros(0), 0.0)
    assert linking.weighted_jaccard(a, empty) == 0 == linking.weighted_jaccard(empty, empty)


def test_a_text_is_asked_for_once(spark):
    """The blocks compare texts that the stars have fetched; their sketches are all near."""
    texts = {1: "abcdefgh", 2: "mnopqrstuv", 3: "mnopqrstu", 4: "wxyz"}
    rows = [(7, None, 1, 4, 4, 0)] + [(7, i, 1, None, 4, None) for i in texts] + [(None, i, 0, 0, None, None) for i in texts]
    table, asked = spark.createDataFrame(list(texts.items()), "id long, text string"), []

    def fetch(ids):
        asked.extend(r.id for r in ids.collect())
        return table.join(ids.select("id"), "id")

    got = linking.classes_of(spark.createDataFrame(rows, linking.GROUPS), fetch, lambda x: list(map(letters, x)), 0.8, 32)
    assert {r.id: r["class"] for r in got.collect()} == {2: 2, 3: 2}
    assert sorted(asked) == [1, 2, 3, 4]


def test_sieve(spark):
    rows = spark.range(0, 3000, 3).selectExpr("id", "id + 1 AS b")
    test = linking.sieve(rows, ["id", "b"])
    got = spark.range(6000).selectExpr("id", "id + 1 AS b").where(test("id", "b")).collect()
    assert {r.id for r in got} >= set(range(0, 3000, 3)) and len(got) < 1600
