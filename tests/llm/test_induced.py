import random

import numpy as np
import pytest

from rillflow.llm import induced


def naive(text, depth):
    order = sorted(range(len(text) + 1), key=lambda i: text[i:], reverse=True)
    out = []
    for k, i in enumerate(order):
        n = 0
        if k:
            a, b = text[order[k - 1] :], text[i:]
            while n < min(len(a), len(b), depth) and a[n] == b[n]:
                n += 1
        out.append((i, n))
    return out


def runs(elements, depth):
    """Common prefixes in order, and the positions of each run that agrees for `depth` bytes as a set."""
    out = []
    for at, lcp in elements:
        if lcp < depth or not out:
            out.append((lcp, set()))
        out[-1][1].add(at)
    return out


@pytest.mark.parametrize("buffer, memory, step", [(1 << 16, 1 << 20, 1 << 16), (3, 0, 5), (2, 4, 2)])
def test_against_naive_sorting(tmp_path, monkeypatch, buffer, memory, step):
    monkeypatch.setattr(induced, "STEP", step)
    rng = random.Random(buffer)
    texts = [b"a", b"banana", b"mississippi", b"a" * 90, b"ab" * 60, b"\xff\x00" * 5 + b"\x00", bytes(range(255, -1, -1))]
    texts += [bytes(rng.choices(b"ab" if n % 2 else b"abcd", k=rng.randrange(1, 140))) for n in range(60)]
    base = bytes(rng.choices(b"abcdefgh ", k=80))
    texts += [base + b"x" + base[10:70] + b"\xff" + base]
    for t in texts:
        for depth in (4, 50):
            s = induced.Sorter(np.frombuffer(t, np.uint8), depth, str(tmp_path), buffer, memory)
            assert runs([(int(x["at"]), int(x["lcp"])) for b in s.backwards() for x in b], depth) == runs(naive(t, depth), depth), (t, depth)


def test_recursion(tmp_path):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 50, 200):
        for width in (1, 2, 5):
            s = rng.integers(0, width, n)
            want = induced.in_memory(s)
            assert sorted(want.tolist()) == list(range(n))
            assert (np.argsort(want) == sorted(range(n), key=lambda i: s[i:].tolist())).all()
            assert (induced.by_heap(s, str(tmp_path), 4) == want).all()
