import base64
import hashlib
import random

from pyspark.sql import functions as F

from rillflow.llm import queries, sql, warc

from .helpers import SMALL, duck, same


def test_loser_tree_merges_like_sorted():
    rng = random.Random(5)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_round_trip(spark):
    rows = [(5, "http://b.a/x\r\nInjected: 1", "é\r\n\r\nWARC/1.1", 1), (3, "http://www.b.a.c/", "é\r\n\r\nWARC/1.1", 1), (9, None, None, 1), (8, "%%[", "", 1), (None, "u", "", 1), (3, "http://www.b.a.c/", "é\r\n\r\nWARC/1.1", 2), (7, "http://a.a:81/p?q", "x" * 100_000, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.archived(pages).orderBy("part", "rank").collect()
    assert sorted((r.id, r.kind, r.refers) for r in got if r.id) == [("3", "response", None)] * 2 + [("5", "revisit", "3"), ("7", "response", None), ("8", "response", None), ("9", "revisit", "8")]
    texts = {str(i): (h or "").encode() for i, _, h, _ in rows}
    for r in got:
        p = texts.get(r.id, b"")
        assert r.bytes == len(p) and r.digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
    assert [warc.order(r.asDict()) for r in got] == sorted(warc.order(r.asDict()) for r in got)
    assert {r.kind for r in warc.archived(pages, min_bytes=10**6).collect()} == {"response"}
    assert warc.archived(pages.limit(0)).count() == 0


def test_ranges_are_globally_ordered(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") * 7919 % 50, F.lit(".org/"), F.col("id")).alias("url"), F.lit("x").alias("html"))
    path = warc.write_archives(pages.repartition(5))
    got = warc.capture_index(spark, path, pages.select("url"), 6).collect()
    assert len(got) == 3000 and len({r.part for r in got}) > 3
    got.sort(key=lambda r: (r.part, r["rank"]))
    keys = [warc.order(r.asDict()) for r in got]
    assert keys == sorted(keys)


def test_query_equals_sql(spark):
    same(queries.op7_warc(spark, SMALL).toPandas(), duck(SMALL, sql.OP7), ["page_id"])
