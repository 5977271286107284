import os
import zlib

import numpy as np
import pytest

from rillflow.llm import lines, neardup, packing, quality

from . import test_decontam, test_lines, test_neardup, test_packing
from .helpers import SMALL

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with repeats, contamination and junk, few enough for comparing all pairs."""
    d = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(70)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    text = docs.collect()
    more = [(1000, text[3].text, "en", "x", 1), (1001, None, "en", "x", None), (1002, "", None, None, 0), (1003, text[5].text + " and more", "en", "x", 1), (1004, bench.first().text + "\nSomething else entirely.", "en", "x", 1), (None, text[6].text, "en", "x", 1), (1000, text[3].text, "en", "x", 1)]
    docs.unionAll(spark.createDataFrame(more, docs.schema)).write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


def test_against_a_brute_force_pipeline(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{small}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    by_id = {d[0]: d[1] for d in docs}
    rows = sorted((i, q, *quality.statistics(by_id[i])) for i, q in labels if i in by_id)
    x = np.array([r[2:] for r in rows])
    rules = quality.fit(x, np.array([float(r[1]) for r in rows]))
    docs = [d for d in docs if rules.scores(np.array([quality.statistics(d[1])]))[0] >= quality.CUTOFF]
    stays = test_lines.brute([d[:2] for d in docs], lines.LEAST)
    cut = lambda d: d[1] if d[1] is None or d[0] is None else "\n".join(x for n, x in enumerate(d[1].split("\n")) if stays.get((d[0], n), (d[0], n)) == (d[0], n))
    docs = [(d[0], cut(d)) for d in docs]
    known = sorted({d for d in docs if d[0] is not None}, key=lambda d: d[0])
    first = test_neardup.brute([t for _, t in known], neardup.LEAST, neardup.RARE)
    docs = [d for n, d in enumerate(known) if first[n] == n] + [d for d in docs if d[0] is None]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = [d for d in docs if not test_decontam.brute(d[1], items, 10)[1]]
    want = sorted((d[0] if d[0] is not None else -1, *p) for d in docs for p in test_packing.brute(d[1], packing.CAPACITY))
    got = corpus_pipeline.run(spark, small).toPandas()
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= packing.CAPACITY and list(g.offset) == [0, *g.length.cumsum()[:-1]]


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert [(f.name, f.dataType) for f in stage(spark, docs, small).schema] == [(f.name, f.dataType) for f in docs.schema]
    assert os.path.isdir(small)
