import array
import random
import zlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillflow.llm import packing, queries

from .helpers import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(text, capacity):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]
    return [(n, at, len(p), zlib.crc32(array.array("I", p).tobytes())) for n, at in enumerate(range(0, len(ids), capacity)) for p in [ids[at : at + capacity]]]


def whole(bins, lengths, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(b and sum(lengths[i] for i in b) <= capacity for b in bins)


TEXTS = ["Hello, WORLD's don't", "", None, "ÉCOLE straße ŒUVRE 東京 12.5", "é ẛ̣", "a<|endoftext|>b <|ENDOFTEXT|>", "ΑΣ Σ", "x\x1cy z w\tq", "word!!  ''' '' it's", "İstanbul ĳ", "tail " * 5000, "_a_b_ (c) [d]"]


def test_pieces_equal_the_tokenizers(spark):
    docs = spark.createDataFrame([(n % 9, t, "s") for n, t in enumerate(TEXTS * 2)], "doc_id long, text string, Pieces string")
    for capacity in (2048, 7):
        got = packing.packed(docs, PATH, capacity=capacity, ids=True).toPandas()
        want = sorted((n % 9, *p) for n, t in enumerate(TEXTS * 2) for p in brute(t, capacity))
        assert sorted(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert g.length.sum() <= capacity and list(g.offset) == [0, *g.length.cumsum()[:-1]]
        assert all(zlib.crc32(array.array("I", x).tobytes()) == c for x, c in zip(got.ids, got.ids_crc32))
    assert packing.packed(docs.limit(0), PATH).count() == 0


def test_chunks_equal_whole_texts():
    e, rng = packing.Encoder(open(PATH, encoding="utf-8").read()), random.Random(3)
    assert e.by_chunk
    parts = [*"aZéÉßΣ'.,!<|>_-1٣東 \n\t́ \x1f", "'s", "<|endoftext|>", "the", " ", "Don't"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert e(t) == e._whole([t])[0], t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_search_keeps_all_and_never_needs_more_bins(lengths):
    first = packing.best_fit(lengths, 50)
    whole(first, lengths, 50)
    bins = packing.pack(lengths, 50)
    whole(bins, lengths, 50)
    assert -(-sum(lengths) // 50) <= len(bins) <= len(first)


def test_search_empties_bins_that_best_fit_leaves():
    rng = random.Random(1)
    lengths = [rng.choice([rng.randint(300, 900), rng.randint(600, 1100)]) for _ in range(2000)]
    first, bins = packing.best_fit(lengths, 2048), packing.pack(lengths)
    whole(bins, lengths, 2048)
    assert len(bins) < len(first)
    # an exchange is needed: 6 + 4 and 5 + 3 + 2 fill two bins, best fit by length needs three
    assert len(packing.pack([6, 5, 4, 3, 2], 10)) == 2


def test_query_needs_few_sequences(spark):
    got = queries.op4_packing(spark, f"{DATA}/sf0.01").toPandas()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.01 + 1


def test_search_gives_any_two_of_a_bin_of_many_lengths():
    lengths = [36, 2, 22, 45, 20, 11, 29, 16, 29, 57, 55, 42, 60, 39, 22, 48, 32, 2, 36, 37, 33, 38, 33, 18, 13, 43, 50, 43, 19, 45, 31, 48, 26, 33, 34, 14, 27, 9]
    bins = packing.Search(lengths, [list(range(18)), list(range(18, 36)), [36, 37]], 600).run()
    whole(bins, lengths, 600)
    assert len(bins) == 2


def test_search_tries_every_bin():
    lengths, tried = [501] * 300, []
    search = packing.Search(lengths, [[i] for i in range(300)], 1000)
    empty = search._empty
    search._empty = lambda a: tried.append(a) or empty(a)
    whole(search.run(), lengths, 1000)
    assert sorted(tried) == list(range(300))


def test_search_empties_bins_of_real_documents():
    """Best fit in order of arrival needs more bins than the total allows; the search gets there."""
    import duckdb

    encode = packing.Encoder(open(PATH, encoding="utf-8").read())
    lengths = []
    for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/sf0.01/documents.parquet' ORDER BY doc_id").fetchall():
        n = len(encode(t or "")) // 4 + 1
        lengths += [packing.CAPACITY] * (n // packing.CAPACITY) + [n % packing.CAPACITY] * (n % packing.CAPACITY > 0)
    long = [i for i, n in enumerate(lengths) if n >= packing.SMALL * packing.CAPACITY]
    search = packing.Search(lengths, packing.best_fit(lengths, packing.CAPACITY, long), packing.CAPACITY)
    search.run()
    assert search.emptied > 0
    bins = packing.pack(lengths)
    whole(bins, lengths, packing.CAPACITY)
    assert len(bins) == -(-sum(lengths) // packing.CAPACITY)
