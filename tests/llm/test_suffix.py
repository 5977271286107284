import hashlib
import random

import pytest

from rillflow.llm import queries, suffix

from .helpers import SMALL


def brute(docs, length):
    """(id, n_bytes, spans, kept) by a dictionary of all windows."""
    least = {}
    for i, t in docs:
        if i is not None:
            raw = (t or "").encode()
            for k in range(len(raw) - length + 1):
                w = raw[k : k + length]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if i is not None and least[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        edges = [k for k in range(len(raw) + 1) if (gone[k] if k < len(raw) else 0) != (gone[k - 1] if k else 0)]
        out.append((i, len(raw), edges, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def texts():
    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("abcdeé \n", k=n))
    passages = [make(n) for n in (49, 50, 51, 80, 300)]
    docs = [(5, "a" * 400), (4, "a" * 60), (3, "ab" * 100), (9, "ab" * 80 + "c"), (7, None), (8, ""), (None, passages[4]), (6, "x" + "a" * 49 + "y"), (2, make(3000) * 2)]
    for k in range(40):
        docs.append((100 + k, make(rng.randrange(90)) + rng.choice(passages) + make(rng.randrange(60)) + rng.choice(passages)[rng.randrange(30) :]))
    docs += [(50, docs[20][1]), (200, docs[20][1]), (200, docs[21][1]), (200, docs[20][1])]
    return docs


@pytest.mark.parametrize("options", [{}, {"hot": 3, "group_bytes": 1 << 23, "part_bytes": 1 << 24}, {"memory": 0, "part_bytes": 1 << 25, "group_bytes": 1 << 24}])
def test_against_all_windows(spark, options):
    docs = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, g string, rid int").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.spans, bytes(r.kept)) for r in suffix.repeated_bytes(df, **options).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=order) == sorted(brute(docs, 50), key=order)


def test_no_documents(spark):
    assert suffix.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {i: (n, len(raw_gone), len(e) // 2, hashlib.sha256(k).hexdigest()) for i, n, e, k in brute(docs, 50) for raw_gone in [range(n - len(k))]}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, SMALL).collect()}
    assert got == want and sum(n for _, n, _, _ in want.values()) > 0
