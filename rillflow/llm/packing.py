"""Packing of tokenised documents into sequences: best fit, then swap-based local search.

Documents are encoded whole, closed by an end id and cut only where they exceed a sequence. Pieces are
dealt to shards of bounded size, each packed on its own: best fit in order of arrival, then a local
search over underfull bins. It takes the emptiest bin and hands its documents to other bins by moves,
exchanges of one or two for one or two, each raising the sum of squared fills, until the bin is empty
or nothing helps; then the next, for as long as anything helps and fewer bins may do. Small documents
come last and fill the gaps. A shard wastes less than one sequence by its bounds.
"""

from __future__ import annotations

import array
import heapq
import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import bounded_batches, fresh, kept, parts, scan_bytes

CAPACITY = 2048
#: Bytes of documents of a shard.
SHARD_BYTES = 64 << 20
#: Documents below this share of a sequence are held back until bins of the others are emptied.
SMALL = 1 / 16
#: Chunks of text whose ids a worker keeps.
HELD = 500_000

_CORE = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to those of the tokenizer.

    For a tokenizer that drops white space, lower-cases and marks ends of words, chunks between spaces
    are encoded apart and kept; new chunks of plain letters are encoded together and cut at the marks.
    Texts that this doesn't hold for surely (special tokens, other normal forms) are encoded whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        mark = parsed["model"].get("end_of_word_suffix")
        kinds = {x["type"] for x in (parsed.get("normalizer") or {}).get("normalizers", [])}
        split = ((parsed.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_chunk = bool(mark) and {"NFC", "Lowercase"} <= kinds and split.get("behavior") == "Removed" and split.get("invert") is True
        self.kept: dict[str, bytes] = {"": b""}
        if self.by_chunk:
            vocabulary = parsed["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 2, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(mark)]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        kept = self.kept
        cut = [(c, _CORE.fullmatch(c)) for c in chunks]
        plain = list({p for _, m in cut if m for p in m.groups() if p and p not in kept and p[0].isalpha()})
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(plain):
                raw = ids.tobytes()
                for p, a, z in zip(plain, [0, *stops[:-1].tolist()], stops.tolist()):
                    kept[p] = raw[4 * a : 4 * z]
            else:
                kept.update(zip(plain, self._whole(plain)))
        tails = list({m[2] for _, m in cut if m and m[2] not in kept} | {c for c, m in cut if not m})
        kept.update(zip(tails, self._whole(tails)))
        for c, m in cut:
            if m and c not in kept:
                kept[c] = kept[m[1]] + kept[m[2]]

    def __call__(self, text: str) -> bytes:
        if not self.by_chunk or "<|" in text or "Σ" in text or not unicodedata.is_normalized("NFC", text):
            return self._whole([text])[0]
        chunks = text.lower().replace("\n", " ").replace("\t", " ").split(" ")
        kept = self.kept
        try:
            return b"".join(map(kept.__getitem__, chunks))
        except KeyError:
            if len(kept) > HELD:
                kept.clear()
                kept[""] = b""
            self._learn([c for c in set(chunks) if c not in kept])
            return b"".join(map(kept.__getitem__, chunks))




def _encoder(spec) -> Encoder:
    return kept(spec, lambda: Encoder(spec.value))


_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_WITH_IDS = pa.struct([*_PIECE, ("ids", pa.list_(pa.int32()))])
_DDL = "piece:int,start:bigint,length:bigint,ids_crc32:bigint"


def _cut(spec, capacity: int, end: int, ids: bool):
    close = np.uint32(end).tobytes()

    def cut(texts: pa.Array) -> pa.Array:
        encode, out = _encoder(spec), []
        for t in texts.to_pylist():
            raw = encode(t or "") + close
            rows = []
            for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                row = {"piece": n, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                rows.append(row | {"ids": np.frombuffer(part, np.int32)} if ids else row)
            out.append(rows)
        return pa.array(out, pa.list_(_WITH_IDS if ids else _PIECE))

    return F.arrow_udf(cut, f"array<struct<{_DDL}{',ids:array<int>' if ids else ''}>>")


def best_fit(lengths: list[int], capacity: int, order: Iterable[int] | None = None, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Bins (lists of positions): documents in `order` (that of arrival), each into the fullest bin that it fits; `bins` are filled first."""
    bins = [list(b) for b in bins or ()]
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit f is set if a bin has f free
    for b, held in enumerate(bins):
        free = capacity - sum(lengths[i] for i in held)
        if free:
            by_free[free].append(b)
            some |= 1 << free
    for i in range(len(lengths)) if order is None else order:
        n = lengths[i]
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                some ^= 1 << free
            bins[b].append(i)
        else:
            b, free = len(bins), capacity
            bins.append([i])
        free -= n
        if free:
            by_free[free].append(b)
            some |= 1 << free
    return bins


class Search:
    """Local search over the bins of a shard; `lengths` by position, bins as lists of positions.

    Every bin offers what it can give in exchange: nothing (a move), one document or two, by the sum of
    their lengths. For each sum there is a set of the amounts of free space of the bins that offer it,
    so the best taker of a document is found without a look at every bin.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.whole = [b for b in bins if sum(lengths[i] for i in b) == capacity]
        self.bins = [b for b in bins if sum(lengths[i] for i in b) < capacity]
        self.fill = [sum(lengths[i] for i in b) for b in self.bins]
        self.least = -(-sum(lengths[i] for b in bins for i in b) // capacity)
        self.emptied = 0
        #: By sum: bit f says that a bin with f free may offer it; by sum and free space, those bins (some have changed since).
        self.frees = [0] * (capacity + 1)
        self.offers: dict[tuple[int, int], list[tuple[int, int]]] = {}
        #: The longest document that a bin offering the sum may take for it.
        self.reach = np.full(capacity + 1, -1, np.int64)
        self.version = [0] * len(self.bins)

    def _sums(self, b: int) -> Iterable[int]:
        """What bin `b` can give: 0, and all sums of one or two of its documents."""
        own = [self.lengths[i] for i in self.bins[b]]
        if len(own) <= 12:
            return {0, *own, *(n + m for n, m in itertools.combinations(own, 2))}
        x = np.array(own)
        pairs = x[:, None] + x
        return np.unique(np.concatenate([[0], x, pairs[np.triu_indices(len(x), 1)]])).tolist()

    def _way(self, b: int, total: int) -> tuple[int, ...]:
        """Documents of bin `b` that make up an offered sum."""
        by: dict[int, int] = {}
        for i in self.bins[b] if total else ():
            n = self.lengths[i]
            if n == total:
                return (i,)
            if total - n in by:
                return (by[total - n], i)
            by[n] = i
        return ()

    def _offer(self, b: int) -> None:
        self.version[b] += 1
        free = self.capacity - self.fill[b]
        if not free or not self.bins[b]:
            return
        entry, bit, frees, offers = (b, self.version[b]), 1 << free, self.frees, self.offers
        for n in self._sums(b):
            offers.setdefault((n, free), []).append(entry)
            frees[n] |= bit
            if self.reach[n] < n + free:
                self.reach[n] = n + free

    def _taker(self, n: int, fill: int) -> tuple[int, int] | None:
        """(bin, sum) of the bin that takes a document of length `n` for the least in exchange, so that the sum of squares rises."""
        start = 0
        while start < n:
            back = start + int((self.reach[start:n] >= n).argmax())
            if self.reach[back] < n:
                return None
            moved = n - back
            fits = self.frees[back] >> moved
            while fits:
                # The fullest bins first.
                free = moved + (fits & -fits).bit_length() - 1
                held = self.offers[back, free]
                while held and self.version[held[-1][0]] != held[-1][1]:
                    held.pop()
                if not held:
                    self.frees[back] ^= 1 << free
                elif self.capacity - free + moved > fill:
                    return held[-1][0], back
                else:
                    break  # the others are emptier still
                fits = self.frees[back] >> moved
            self.reach[back] = back + self.frees[back].bit_length() - 1 if self.frees[back] else -1
            start = back + 1
        return None

    def _give(self, a: int, given: tuple[int, ...]) -> bool:
        """Hands `given` of bin `a` to the bin that takes them for the least in exchange."""
        n = sum(self.lengths[i] for i in given)
        found = self._taker(n, self.fill[a])
        if not found:
            return False
        b, back = found
        taken = self._way(b, back)
        self.bins[a] = [i for i in self.bins[a] if i not in given] + list(taken)
        self.bins[b] = [i for i in self.bins[b] if i not in taken] + list(given)
        self.fill[a] -= n - back
        self.fill[b] += n - back
        self._offer(b)
        return True

    def _given(self, a: int) -> Iterator[tuple[int, ...]]:
        """One document of each length, then two of each pair of lengths, the longest first."""
        by: dict[int, list[int]] = {}
        for i in sorted(self.bins[a], key=lambda i: -self.lengths[i]):
            by.setdefault(self.lengths[i], []).append(i)
        yield from ((x[0],) for x in by.values())
        for n, m in itertools.combinations_with_replacement(by, 2):
            if n != m:
                yield by[n][0], by[m][0]
            elif len(by[n]) > 1:
                yield by[n][0], by[n][1]

    def _empty(self, a: int) -> bool:
        """Hands over what it can of bin `a`; whether anything was."""
        self.version[a] += 1  # it takes nothing itself meanwhile
        some = False
        while self.bins[a] and any(self._give(a, x) for x in self._given(a)):
            some = True
        self.emptied += not self.bins[a]
        self._offer(a)
        return some

    def run(self) -> list[list[int]]:
        for b in range(len(self.bins)):
            if len(self.whole) + len(self.bins) > self.least:
                self._offer(b)
        again = True
        while again:
            again = False
            # The emptiest first, as they stand when their turn comes.
            heap = [(f, a) for a, f in enumerate(self.fill) if self.bins[a] and f < self.capacity]
            heapq.heapify(heap)
            tried: set[int] = set()
            while heap and len(self.whole) + len(self.bins) - self.emptied > self.least:
                f, a = heapq.heappop(heap)
                if a in tried or not self.bins[a] or self.fill[a] == self.capacity:
                    continue
                if f != self.fill[a]:
                    heapq.heappush(heap, (self.fill[a], a))
                    continue
                tried.add(a)
                again = self._empty(a) or again
            again = again and len(self.whole) + len(self.bins) - self.emptied > self.least
        return self.whole + [b for b in self.bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions of `lengths` (each from 1 to `capacity`).

    Documents from a share `SMALL` of a sequence on go in by best fit in order of arrival, and the search
    empties bins of them; the smaller ones then fill the gaps, by decreasing length, and the search goes
    on. Where that takes more than the least number that the total allows, the search also starts from
    best fit of all documents, by arrival and by decreasing length, and the smallest result counts.
    """
    if not lengths:
        return []
    long = [i for i, n in enumerate(lengths) if n >= SMALL * capacity]
    small = sorted((i for i, n in enumerate(lengths) if n < SMALL * capacity), key=lambda i: -lengths[i])
    bins = Search(lengths, best_fit(lengths, capacity, long), capacity).run()
    search = Search(lengths, best_fit(lengths, capacity, small, bins), capacity)
    found = [search.run()]
    if len(found[0]) > search.least:
        for order in (None, sorted(range(len(lengths)), key=lambda i: -lengths[i])):
            found.append(Search(lengths, best_fit(lengths, capacity, order), capacity).run())
    return min(found, key=len)


def _place(capacity: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_pylist()
        base = TaskContext.get().partitionId() << 32
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n, b in enumerate(pack(lengths, capacity)):
            at = 0
            for i in b:
                sequence[i], offset[i] = base + n, at
                at += lengths[i]
        yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches(4096)

    return place


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, ids: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a piece: the key, piece, start, length, ids_crc32, [ids], sequence_id, offset.

    `tokenizer`: path of a tokenizers file on the driver; its bytes are broadcast. A null or empty text
    is one piece of the end id. Rows that repeat a key or a text are packed each. Other columns don't
    matter. No rows: no rows. Documents of more than `capacity` ids are cut, the last piece being shorter.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    name = fresh(docs.select(key), "pieces")
    rows = docs.select(F.col(key), F.explode(_cut(spec, capacity, end, ids)(F.col(text).cast("string"))).alias(name))
    rows = rows.select(key, f"{name}.*").repartition(parts(scan_bytes(docs.select(key, text)), shard_bytes))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_place(capacity), f"{kinds}, sequence_id bigint, offset bigint")
