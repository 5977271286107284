import numpy as np

from rillflow.llm import quality, queries

from .helpers import DATA


def test_query_on_held_out_labels(spark):
    d = f"{DATA}/sf0.1"
    got = queries.op8_quality(spark, d).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 500
    assert (held.predicted == held.quality).mean() > 0.98


def test_columns_equal_rules(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "x", "A B C\n\n| a | b |", "é" * 50, "word " * 20000] + [" ".join(rng.choice(["THE", "a", "!!", "cat", "x|y"], 30)) for _ in range(200)]
    x = np.array([quality.statistics(t) for t in texts])
    rules = quality.fit(x, np.array([float(t is not None and "|" in t and len(t) % 2 == 0) for t in texts]))
    assert rules.rules
    df = spark.createDataFrame([(t, n, 1.0) for n, t in enumerate(texts)], "text string, n int, Score double")
    got = quality.scored(df, rules)
    assert got.columns == ["text", "n", "Score", "score_"]
    out = {r.n: r.score_ for r in got.collect()}
    assert np.allclose([out[n] for n in range(len(texts))], rules.scores(x), atol=1e-12)
    kept = quality.accepted(df, rules)
    assert kept.columns == df.columns and {r.n for r in kept.collect()} == {n for n in out if out[n] >= quality.CUTOFF}
    assert quality.scored(df.limit(0), rules).count() == 0


def test_too_few_labels_give_a_constant(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    rules = quality.learn(docs, none)
    assert {r.score for r in quality.scored(docs, rules).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    assert quality.learn(docs, one).scores(np.zeros((1, len(quality.STATISTICS))))[0] == 0.75


def test_query_equals_plain_evaluation(spark):
    """All rows of a small table, learnt and scored without Spark."""
    import zlib

    import duckdb

    from .helpers import SMALL

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SMALL}/labels.parquet'").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    x = {i: quality.statistics(t) for i, t in docs}
    rows = sorted((i, q, *x[i]) for i, q in labels if not held(i) and i in x and q in (0, 1))
    rules = quality.fit(np.array([r[2:] for r in rows]), np.array([float(r[1]) for r in rows]))
    want = dict(zip(x, rules.scores(np.array(list(x.values())))))
    got = queries.op8_quality(spark, SMALL).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: held(i) for i in x} and len(got) == len(docs)
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == int(r.score >= 0.3) for r in got)
