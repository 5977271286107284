import numpy as np
import pyarrow as pa

from rillflow.llm import linking


def test_near_blocks_against_all_pairs():
    """Blocks that go over batches, sketches with the sign bit set."""
    rng, n = np.random.default_rng(1), 300
    key, role = np.sort(rng.integers(0, 20, n)), rng.integers(0, 2, n)
    order = np.lexsort((role, key))
    key, role, kind = key[order], role[order], rng.integers(0, 3, n)
    s1, s2 = rng.integers(-4, 4, n), rng.integers(-(2**62), 2**62, n) // 2**56
    t = pa.table({"key": key, "block": key * 0, "rest": key * 0, "role": role, "id": np.arange(n), "class": kind, "s1": s1, "s2": s2})
    apart = lambda i, j: sum((int(s[i] ^ s[j]) & (1 << 64) - 1).bit_count() for s in (s1, s2))
    want = {x for i in range(n) for j in range(n) if key[i] == key[j] and role[i] < role[j] and kind[i] != kind[j] and apart(i, j) <= 20 for x in (i, j)}
    for size in (17, 1000):
        got = [x for b in linking._near_blocks(20)(iter(t.to_batches(max_chunksize=size))) for x in b.column("id").to_pylist()]
        assert sorted(got) == sorted(want) and 0 < len(want) < n
