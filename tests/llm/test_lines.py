import random

import pyarrow as pa

from rillflow.llm import linking, lines

from .test_linking import closure


def brute(docs, least):
    """Kept (doc, th-less) lines by comparing all pairs of distinct lines."""
    at = {}
    for d, t in docs:
        for n, x in enumerate((t or "").split("\n")):
            if d is not None and x.strip():
                at.setdefault(x.strip(), set()).add((d, n))
    texts = sorted(at)
    sets = {}
    for x in texts:
        y = " ".join(x.lower().split()).ljust(lines.SHINGLE, "\0")
        sets[x] = {y[i : i + lines.SHINGLE] for i in range(len(y) - lines.SHINGLE + 1)}
    links = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    root = closure(range(len(texts)), links)
    groups = {}
    for i, x in enumerate(texts):
        groups.setdefault(root[i], set()).update(at[x])
    return {p: min(g) for g in groups.values() for p in g}


BASE = "the quick brown fox jumps over the lazy dog while nobody watches it from the window, which is a pity for everyone involved"
DOCS = [
    (1, f"{BASE}\nshort\n\nunique line number one that nothing else resembles at all"),
    (2, f"{BASE.replace('window', 'widow')}\nother text here\n  {BASE}  \nshort"),
    (3, f"{BASE.upper()}\nSHORT\nx\nx\nX"),
    (4, None), (5, ""), (6, "é" * 300 + "\n" + "é" * 301), (None, BASE), (7, " \n\t\n"), (8, ("w " * 9000) + "tail\n" + ("w " * 9000) + "tail"),
]


def test_classes_against_all_pairs(spark):
    df = spark.createDataFrame([(d, t, "en") for d, t in DOCS], "doc_id long, text string, NO string")
    got = lines.line_classes(df).collect()
    want = brute(DOCS, lines.LEAST)
    assert {(r.doc, r.no): (r["class"].doc, r["class"].no) for r in got} == want
    assert {(r.doc, r.no) for r in got if r.kept} == set(want.values())


def test_clean(spark):
    df = spark.createDataFrame([(d, t, "en") for d, t in DOCS], "doc_id long, text string, NO string")
    out = lines.deduplicated(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == DOCS[0][1] and got[2] == "other text here" and got[3] == "x" and got[4] is None and got[5] == "" and got[None] == BASE and got[7] == " \n\t\n"
    assert lines.deduplicated(df.limit(0)).count() == 0


def test_equal_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a line that is here twice"), (1, "a line that is here twice"), (1, "something else that is different"), (2, "a line that is here twice")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.deduplicated(df).collect())
    assert got == [(1, "a line that is here twice")] * 2 + [(1, "something else that is different"), (2, "")]


def test_few_pairs_at_the_threshold_share_no_band():
    rng, tail, pairs = random.Random(4), 20, 3000
    one = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    # 8 shared shingles for each one of a tail: a similarity of 0.8.
    starts = [one(8 * tail + lines.SHINGLE - 1) for _ in range(pairs)]
    a, b = (lines.signatures([x + one(tail) for x in starts]) for _ in range(2))
    missed = int((~(a == b).any(1)).sum())
    assert missed <= 0.002 * pairs, missed


def test_one_changed_character_of_40_to_60(spark):
    texts = ["order 48213 was shipped from berlin on monday", "the quick brown fox jumps over a lazy dog by night, twice"]
    texts = [x[:40] for x in texts] + texts
    pairs = [(x, x[: len(x) // 2] + "7" + x[len(x) // 2 + 1 :]) for x in texts]
    for a, b in map(lines.features, pairs):
        assert linking.similar(a, b, lines.LEAST)
    df = spark.createDataFrame([(1, pairs[-1][0]), (2, pairs[-1][1])], "doc_id long, text string")
    assert [r.kept for r in lines.line_classes(df).orderBy("doc").collect()] == [True, False]


def test_keys_of_a_line_travel_in_eight_bytes_each():
    """However many parts there are; copies in other lots count once, by the first."""
    rng = random.Random(5)
    texts = ["\n".join("".join(rng.choices("abcdefghij ", k=60)) for _ in range(40)) for _ in range(50)]
    docs = [pa.RecordBatch.from_pydict({"text": texts})]
    for n in (1, 500):
        sent = list(lines._sender(n)(iter(docs)))
        data = sum(len(b.column("data")[0].as_py()) for b in sent)
        assert data <= 2000 * (8 * lines.BANDS + 24), data
    first = [b for b in sent if b.column("lot")[0].as_py() >= 0]
    again = [b.set_column(1, "lot", pa.array([9], pa.int64())) for b in first]
    assert not [r for b in lines._meet(iter(first + again)) for r in b.to_pylist()]


def test_tables_beyond_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(d, t, "en") for d, t in DOCS] + [(1, DOCS[0][1], "en")], "doc_id long, text string, NO string")
    want = sorted(map(str, lines.deduplicated(df).collect()))
    monkeypatch.setattr(linking, "BROADCAST_ROWS", 0)
    assert sorted(map(str, lines.deduplicated(df).collect())) == want
