import duckdb
import numpy as np

from rillflow.llm import lines, queries

from .helpers import SMALL
from .test_linking import closure


def test_query_against_all_pairs_of_a_table(spark):
    """Every line of the small documents: nothing is linked that isn't similar, and all but few that are."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    at: dict[str, list] = {}
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if x.strip():
                at.setdefault(x.strip(), []).append((d, n))
    texts, grams = list(at), {}
    sets = []
    for x in texts:
        y = " ".join(x.lower().split()).ljust(lines.SHINGLE, "\0")
        sets.append([grams.setdefault(g, len(grams)) for g in {y[i : i + lines.SHINGLE] for i in range(len(y) - lines.SHINGLE + 1)}])
    m = np.zeros((len(texts), len(grams)), np.float32)
    for k, s in enumerate(sets):
        m[k, s] = 1
    both, size = m @ m.T, m.sum(1)
    a, b = np.nonzero(np.triu(both >= lines.LEAST * (size[:, None] + size - both) - 1e-4, 1))
    root = closure(range(len(texts)), list(zip(a.tolist(), b.tolist())))
    true_class = {p: root[k] for k, x in enumerate(texts) for p in at[x]}
    got = queries.op5_line_dedup(spark, SMALL).collect()
    assert len(got) == len(true_class)
    found = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got}
    assert all(true_class[p] == true_class[c] for p, c in found.items())
    first: dict = {}
    for p in sorted(true_class):
        first.setdefault(true_class[p], p)
    missed = sum(found[p] != first[true_class[p]] for p in found)
    assert missed <= 0.002 * len(found), missed
