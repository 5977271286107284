import re

from rillflow.llm import decontam, queries, sql

from .helpers import SMALL, duck, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w, hit, found = WORD.findall(lower), set(), set()
    for item, t in items:
        b = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        k = min(size, len(b))
        wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found |= {item} if item is not None else set()
    return len(w), len(hit), sorted(found)


def test_against_brute_force(spark):
    items = [("a", "One two Three four"), ("b", "é ü x"), ("c", None), ("d", "  "), (None, "five six"), ("a", "zz"), ("e", "one two three four five six seven")]
    texts = ["one TWO, three-four one two", "x é ü x é ü x", None, "", "!!!", "zz zz zzz", "five six seven one two three four five six seven " * 40, "ONE two"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts * 2)], "doc_id long, text string, Hits string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (decontam.BLOCK_BYTES, 1):
        out = decontam.benchmark_hits(docs, bench, window=3, block_bytes=block)
        assert out.columns == ["doc_id", "text", "Hits", "hits_"]
        for r in out.collect():
            assert (r.hits_.n_words, r.hits_.n_hit, r.hits_["items"]) == brute(r.text, items, 3)
    kept = decontam.decontaminated(docs, bench, window=3)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {None, "", "!!!", "ONE two"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.benchmark_hits(docs, bench).collect()[0].hits.n_words == 2
    assert decontam.benchmark_hits(docs.limit(0), bench).count() == 0


def test_query_equals_sql(spark):
    same(queries.op9_decontamination(spark, SMALL).toPandas(), duck(SMALL, sql.OP9), ["doc_id"])
