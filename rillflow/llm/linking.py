"""Classes of similar texts from band keys: candidate links, exact verification, distributed union-find.

Texts that share a band key are candidates. First each is compared with the smallest id of its key
only, so that a group of n makes n links, not n squared; the verified links give classes. Then, where
one key holds several classes, every pair of texts from different classes is compared in blocks, which
emit verified links only. So no link that joins two classes is lost, whatever the size of a group.

Large groups are split: a head's members are dealt by salt, blocks by hashes of ids. Nothing is
collected; intermediate results are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import mix, ragged, written

#: Members compared with one copy of their head; texts of a block.
SPLIT, BLOCK = 256, 128
#: Pairs of sketches compared at a time.
PAIRS = 1 << 18
#: Tables of at most so many ids or keys (8 to 40 bytes each) are broadcast.
BROADCAST_ROWS = 50_000
#: Bits of a sieve for each of its keys, and the binary logarithm of all at most (16 MB), whatever the number of keys.
SIEVE_BITS, SIEVE_MOST = 16, 27
#: Forests of at most so many edges are merged in one task.
FOREST_EDGES = 500_000

#: Sorted distinct hashes, positive weights (None: all 1), sum of the weights.
Features = tuple[np.ndarray, np.ndarray | None, float]


def weighted_jaccard(a: Features, b: Features) -> float:
    """Sum of minima over sum of maxima. Two empty ones: 0."""
    (ka, wa, ta), (kb, wb, tb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    both = kb.take(kb.searchsorted(ka), mode="clip") == ka
    if wa is None or wb is None:
        low = np.count_nonzero(both)
        return float(low / (ta + tb - low))
    low = np.minimum(wa[both], wb[kb.searchsorted(ka[both])]).sum()
    return float(low / (ta + tb - low))


def similar(a: Features, b: Features, least: float) -> bool:
    """Whether the similarity is at least `least`; it can't exceed the ratio of the sums."""
    return min(a[2], b[2]) >= least * max(a[2], b[2]) * (1 - 1e-9) and weighted_jaccard(a, b) >= least


def bounded(df: DataFrame) -> DataFrame:
    """Hints a broadcast of a written table if its count is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spread(large: DataFrame, small: DataFrame, on: list[str], rows: str, how: str = "inner") -> DataFrame:
    """`large` joined with a written table `small` of distinct keys, whose column `rows` says how many rows of `large` have the key.

    Beyond the bound of a broadcast only the keys that hold a thousandth of those rows (a thousand at most) are
    broadcast; the other keys shuffle, so that none makes a large task.
    """
    if small.count() <= BROADCAST_ROWS:
        return large.join(F.broadcast(small.drop(rows)), on, how)
    total = small.agg(F.sum(rows)).first()[0]
    hot = F.broadcast(small.where(F.col(rows) * 1000 > total).drop(rows))
    cold = small.where(F.col(rows) * 1000 <= total).drop(rows)
    return large.join(hot, on).unionByName(large.join(hot, on, "left_anti").join(cold, on, how))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits at the given places, by segments of 8 KB; a segment's places are in one task."""
    at = np.unique(np.concatenate([np.zeros(0, np.int64), *[b.column(0).to_numpy() for b in batches]]))
    for part in np.split(at, np.flatnonzero(np.diff(at >> 16)) + 1):
        if len(part):
            bits = np.zeros(1 << 16, bool)
            bits[part & 0xFFFF] = True
            yield pa.RecordBatch.from_pydict({"segment": [int(part[0] >> 16)], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def sieve(small: DataFrame, on: list[str]) -> Callable[..., Column]:
    """A condition on as many columns as `on`, true for all values that the written table `small` has, and for few others."""
    k = min(SIEVE_MOST, max(16, (SIEVE_BITS * small.count()).bit_length()))
    place = lambda *c: F.shiftrightunsigned(F.xxhash64(F.lit(11), *c), 64 - k)
    rows = small.select(place(*on).alias("at")).repartition(F.shiftright("at", 16)).mapInArrow(_segments, "segment bigint, bits binary")
    bits = np.zeros(1 << k - 3, np.uint8)
    for r in rows.toArrow().to_pylist():
        bits[r["segment"] << 13 : r["segment"] + 1 << 13] = np.frombuffer(r["bits"], np.uint8)
    shared = small.sparkSession.sparkContext.broadcast(bits)

    def there(at: pa.Array) -> pa.Array:
        at = at.to_numpy()
        return pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return lambda *c: F.arrow_udf(there, T.BooleanType())(place(*c))


def sifted(large: DataFrame, columns: list, small: DataFrame, on: list[str]) -> DataFrame:
    """`large` before a join with a written table `small` that keeps matches only: if the join shuffles, most other rows go first."""
    return large if small.count() <= BROADCAST_ROWS else large.where(sieve(small, on)(*columns))


class _Union:
    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _forest(*names: str):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = _Union()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                union.join(x, y)
        roots = {x: union.find(x) for x in list(union.up)}
        roots |= {r: r for r in set(roots.values())}
        yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], list(names))

    return grow


def components(links: DataFrame) -> DataFrame:
    """(id, class) of every id in `links` (two bigint columns): the class is the smallest id of its component.

    Each partition first contracts its links to a forest by union-find. Forests within a bound are merged
    by one more task. Beyond it two steps alternate until nothing changes: every id hands its larger neighbours, and then its smaller ones, to the smallest.
    Minima are pre-aggregated, so that an id of many links costs no task more than its share.
    """
    a, b = links.columns
    both = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edges = written(both.mapInArrow(_forest("u", "v"), "u bigint, v bigint").where("u <> v").distinct(), "edges")
    if edges.count() <= FOREST_EDGES:
        return edges.coalesce(1).mapInArrow(_forest("id", "class"), "id bigint, class bigint")
    state = None
    while True:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m"))
        large = around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("class")).withColumnRenamed("u", "id")
    return roots.unionAll(roots.select(F.col("class").alias("id"), "class").distinct())


def _stars(features: Callable[[list[str]], list[Features]], least: float):
    """Rows (head, shares, salt, role, id, text) in order; role 0 is the head's own text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for b in batches:
            found = []
            for h, n, s, role, i, f in zip(*(b.column(c).to_pylist() for c in ("head", "shares", "salt", "role", "id")), features(b.column("text").to_pylist())):
                if role == 0:
                    key, head = (h, n, s), f
                elif key == (h, n, s) and similar(head, f, least):
                    found.append((h, i))
            yield _pairs(found)

    return check


def _blocks(features: Callable[[list[str]], list[Features]], least: float):
    """Rows (key, block, rest, role, id, class, text) in order; role 0 are the texts that all of the block are compared with."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, union = None, [], _Union()
        for b in batches:
            found = []
            for k, bl, r, role, i, c, f in zip(*(b.column(x).to_pylist() for x in ("key", "block", "rest", "role", "id", "class")), features(b.column("text").to_pylist())):
                if key != (k, bl, r):
                    key, held, union = (k, bl, r), [], _Union()
                if role == 0:
                    held.append((i, c, f))
                    continue
                for j, d, g in held:
                    if union.find(c) != union.find(d) and similar(f, g, least):
                        union.join(c, d)
                        found.append((i, j))
            yield _pairs(found)

    return check


def _near_blocks(apart: int):
    """Of the rows of blocks (as of _blocks, with sketches) those that another class has a near sketch for."""

    def near(t: pa.Table) -> pa.RecordBatch:
        """Whole blocks."""
        names = ("key", "block", "rest", "role", "class", "s1", "s2")
        key, block, rest, role, kind, s1, s2 = (t.column(c).to_numpy() for c in names)
        s1, s2 = s1.view(np.uint64), s2.view(np.uint64)  # bits of a signed number are counted without its sign
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (rest[1:] != rest[:-1])))
        size = np.diff(np.append(first, len(key)))
        held = np.add.reduceat(role == 0, first)
        right = size - held
        keep = np.zeros(len(key), bool)
        # All held rows of a block against all others of it, some blocks at a time.
        at = 0
        pairs = np.cumsum(held * right)
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right")))
            of = slice(at, stop)
            b = np.repeat(ragged(first[of] + held[of], right[of]), np.repeat(held[of], right[of]))
            a = ragged(np.repeat(first[of], right[of]), np.repeat(held[of], right[of]))
            ok = kind[a] != kind[b]
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(s1[a] ^ s1[b]) + np.bitwise_count(s2[a] ^ s2[b]) <= apart
            keep[a[ok]] = keep[b[ok]] = True
            at = stop
        out = t.filter(pa.array(keep)).combine_chunks()
        return out.to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], out.schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rest.append(b)
            t = pa.Table.from_batches(rest)
            # The last block may go on.
            last = [t.column(c).to_numpy() for c in ("key", "block", "rest")]
            cut = int(np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in last])))[-1])
            if cut:
                yield near(t.slice(0, cut))
                rest = t.slice(cut).to_batches()
        if rest:
            yield near(pa.Table.from_batches(rest))

    return check


def _pairs(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], ["a", "b"])


def _slot(c: Column, n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), c), n)


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))


def _shares(n: str) -> Column:
    return F.ceil(F.col(n) / SPLIT)


#: Rows of groups: one with no id for each key (least and largest id, number of ids, their hash), and one for each id of a key of three or more.
GROUPS = "key bigint, id bigint, lo bigint, hi bigint, n bigint, x bigint"


def shared_groups(key: np.ndarray, ids: np.ndarray, base: int = 0, check: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of GROUPS for the keys (plus `base`) that distinct ids share; of keys with the same ids one. Ids of one key
    whose `check` is equal are copies, for which the smallest stands."""
    if len(key) < 1 << 32 and key.dtype == np.uint32:
        # Sorting values is many times faster than sorting positions by them.
        both = np.sort((key.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64))
        order = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = np.diff(both >> np.uint64(32)) == 0
    else:
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
    order = order[np.append(same, False) | np.append(False, same)] if len(order) > 1 else order[:0]
    key, ids = key[order].astype(np.int64), ids[order]
    if check is not None:
        check = check[order]
        order = np.lexsort((ids, check, key))
        key, ids, check = key[order], ids[order], check[order]
        new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))[: len(key)]
        key, ids = key[new], ids[new]
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))[: len(key)]
    key, ids = key[new], ids[new]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    n = np.diff(np.append(first, len(key)))
    first, n = first[n > 1], n[n > 1]
    if not len(first):
        return
    lo, hi = ids[first], ids[first + n - 1]
    hashed = np.append(np.uint64(0), np.bitwise_xor.accumulate(mix(ids.view(np.uint64) + np.uint64(1))))
    x = (hashed[first + n] ^ hashed[first]).view(np.int64)
    once = np.unique(np.stack([lo, hi, n, x]), axis=1, return_index=True)[1]
    first, n, lo, hi, x = (c[once] for c in (first, n, lo, hi, x))
    for a in range(0, len(first), 1 << 16):
        z = slice(a, a + (1 << 16))
        yield _group_rows(key[first[z]] + base, None, lo[z], hi[z], n[z], x[z])
    large = n > 2
    at, of = ragged(first[large], n[large]), np.repeat(np.flatnonzero(large), n[large])
    for a in range(0, len(at), 1 << 16):
        z, o = at[a : a + (1 << 16)], of[a : a + (1 << 16)]
        yield _group_rows(key[z] + base, ids[z], lo[o], None, n[o], None)


def _group_rows(*columns) -> pa.RecordBatch:
    size = max(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["key", "id", "lo", "hi", "n", "x"])


def sketch_rows(ids: np.ndarray, s1: np.ndarray, s2: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Rows of GROUPS that hold sketches, and what `texts` knows an id by."""
    return _group_rows(None, ids, s1, s2, None, x)


def classes(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], features: Callable[[list[str]], list[Features]], least: float) -> DataFrame:
    """classes_of for a cheap table (id bigint, keys array<bigint>) with unique ids."""
    bands = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "id")
    sums = [F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x")]
    shared = written(bands.groupBy("key").agg(*sums).where("n > 1"), "bands")
    # Members of large keys by salted halves of the join: a key may hold a third of all ids.
    large = shared.where("n > 2").select("key", "lo", "n", _each(_shares("n")).alias("salt"))
    hot = bounded(written(shared.where(F.col("n") > SPLIT).select("key", "n"), "hot-keys"))
    members = bands.join(hot, "key", "left").withColumn("salt", _slot(F.col("id"), F.coalesce(_shares("n"), F.lit(1)), 9)).drop("n")
    members = members.join(bounded(written(large, "large-keys")), ["key", "salt"])
    none = F.lit(None).cast("bigint")
    groups = shared.select("key", none.alias("id"), "lo", "hi", "n", "x").unionAll(members.select("key", "id", "lo", none.alias("hi"), "n", none.alias("x")))
    return classes_of(written(groups, "groups"), texts, features, least)


def classes_of(groups: DataFrame, texts: Callable[[DataFrame], DataFrame], features: Callable[[list[str]], list[Features]], least: float, apart: int | None = None) -> DataFrame:
    """(id, class) of the ids that are similar to another: the smallest id of their class.

    `groups`: a written table of GROUPS, the candidates. `texts`: from a table of ids to a written table
    (id, text) of distinct texts, asked once for an id. `features`: from texts to their weighted features; `least`: similarity. `apart`: rows without a
    key hold an id's sketch (128 bits in lo, hi) and x, which the table of ids has too; pairs whose sketches differ
    in more bits are no candidates, so their texts don't travel.
    """
    # Keys of equal members (equal counts, extremes and hashes) say the same: one of them is enough.
    alone = groups.where("id is null and n > 2").groupBy("lo", "hi", "n", "x").agg(F.min("key").alias("key"))
    large = alone.select("key", _each(_shares("n")).alias("salt"))
    members = groups.where("id is not null and key is not null").select("key", "id", "lo", "n", _slot(F.col("id"), _shares("n"), 9).alias("salt"))
    grouped = written(members.join(bounded(written(large, "large")), ["key", "salt"]), "grouped")
    pairs = groups.where("id is null and n = 2").select(F.col("lo").alias("head"), F.col("hi").alias("id"), "n")
    pairs = pairs.unionAll(grouped.where("id <> lo").select(F.col("lo").alias("head"), "id", "n")).groupBy("head", "id").agg(F.max("n").alias("n"))
    # A head's members in shares of about SPLIT, each with a copy of the head.
    pairs = written(pairs.select("head", "id", _shares("n").alias("shares")), "candidates")
    ids = written(pairs.select(F.explode(F.array("head", "id")).alias("id")).distinct(), "candidate-ids")
    bits = None
    if apart is not None:
        bits = groups.where("key is null").select("id", F.col("lo").alias("s1"), F.col("hi").alias("s2"), "x")
        bits = sifted(bits, ["id"], ids, ["id"])
        bits = written(bits.join(bounded(ids), "id", "left_semi").dropDuplicates(["id"]), "sketches")
        heads = _heads(pairs).join(bits, "id").select("head", "shares", "salt", F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("x").alias("head_x"))
        members = _members(pairs).join(bits, "id").join(heads, ["head", "shares", "salt"])
        pairs = written(members.where(_differ("s1", "h1") + _differ("s2", "h2") <= apart).select("head", "id", "shares", "head_x", "x"), "near-candidates")
        ids = F.array(F.struct(F.col("head").alias("id"), F.col("head_x").alias("x")), F.struct("id", "x"))
        ids = written(pairs.select(F.explode(ids).alias("i")).select("i.*").distinct(), "near-ids")
    wanted = texts(bounded(ids))
    links = _verified(pairs, wanted, features, least)
    first = written(components(links), "classes")

    # Keys of more than two texts that hold several classes: every other class against all texts.
    known = grouped.select("key", "id", "salt").join(bounded(first), "id", "left").withColumn("class", F.coalesce("class", "id"))
    known = written(known, "known")
    sizes = known.groupBy("key", "class").agg(F.count("*").alias("count"))
    mains = sizes.groupBy("key").agg(F.max_by("class", F.struct("count", "class")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most")).where("most < n")
    mains = written(mains.select("key", "main", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("rests"), _each(_shares("n")).alias("salt")), "mains")
    if mains.isEmpty():
        return first
    mixed = known.join(bounded(mains), ["key", "salt"])
    block, rest = _slot(F.col("id"), F.col("blocks"), 5), _slot(F.col("id"), F.col("rests"), 7)
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1)
    place = lambda block, rest, role: F.struct(block.alias("block"), rest.alias("rest"), F.lit(role).alias("role"))
    left = F.transform(F.when(F.col("class") != F.col("main"), upto("blocks")).otherwise(F.array().cast("array<bigint>")), lambda b: place(b, rest, 0))
    right = F.transform(upto("rests"), lambda r: place(block, r, 1))
    rows = mixed.select("key", F.explode(F.concat(left, right)).alias("at"), "id", "class").select("key", "at.*", "id", "class")
    in_order = ("key", "block", "rest"), ("key", "block", "rest", "role")
    if bits is not None:
        # Only texts that have a near sketch in another class of their block travel.
        rows = rows.join(bits, "id").select("key", "block", "rest", "role", "id", "class", "s1", "s2", "x")
        rows = rows.repartition(*in_order[0]).sortWithinPartitions(*in_order[1]).mapInArrow(_near_blocks(apart), rows.schema)
        rows = written(rows, "near-in-blocks")
        if rows.isEmpty():
            return first
        ids = written(rows.select("id", "x").distinct(), "near-in-blocks-ids")
        missing = written(ids.join(wanted.select("id"), "id", "left_anti"), "texts-missing")
        if not missing.isEmpty():
            wanted = wanted.unionAll(texts(bounded(missing)))
        wanted = wanted.join(bounded(ids), "id", "left_semi")
    rows = rows.join(wanted, "id").select("key", "block", "rest", "role", "id", "class", "text")
    rows = rows.repartition(*in_order[0]).sortWithinPartitions(*in_order[1])
    more = written(rows.mapInArrow(_blocks(features, least), "a bigint, b bigint"), "more-links")
    if more.isEmpty():
        return first
    return written(components(links.unionAll(more)), "classes")


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select("head", "shares", _slot(F.col("id"), F.col("shares"), 3).alias("salt"), F.lit(1).alias("role"), "id")


def _heads(pairs: DataFrame) -> DataFrame:
    return pairs.select("head", "shares").distinct().select("head", "shares", _each(F.col("shares")).alias("salt"), F.lit(0).alias("role"), F.col("head").alias("id"))


def _verified(pairs: DataFrame, wanted: DataFrame, features: Callable[[list[str]], list[Features]], least: float) -> DataFrame:
    """Links of the pairs (head, id, shares) whose texts are similar."""
    rows = _heads(pairs).unionAll(_members(pairs)).join(wanted, "id").select("head", "shares", "salt", "role", "id", "text")
    rows = rows.repartition("head", "shares", "salt").sortWithinPartitions("head", "shares", "salt", "role")
    return written(rows.mapInArrow(_stars(features, least), "a bigint, b bigint"), "links")
