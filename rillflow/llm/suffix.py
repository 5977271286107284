"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller id.

Each window of `length` bytes belongs to its anchor: the leftmost of its `KGRAM`-byte strings with the
least hash. Equal windows have equal anchors, so windows meet at their anchor's hash:

1. anchors are counted; those of one document only are done with (most are);
2. the context of an anchor (the text of all windows that belong to it there) is compared by hash with
   the others of its anchor: where a smaller document has it too, all of it goes;
3. contexts that are their document's own but share with another of their anchor the bytes that half a
   window adds to it on the left or on the right (equal windows do) are sorted: each shard of anchors gets a suffix array with common prefixes by external induced sorting, and runs of suffixes
   that agree for `length` bytes give the smallest document of each window.

An anchor of `HOT` or more documents would make a large group in step 3, so its windows are compared in
step 2 one by one, as contexts of their own. What goes to a task is packed and pre-aggregated by groups
of documents, so that even a string in every document costs a task no more than a row a group. Groups
stay where they are (a bucketed table): only hashes and verdicts travel, and the verdicts come back in
the order in which the hashes were sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import induced
from rillflow.llm.common import mix, parts, ragged, scan_bytes, work_dir, written
from rillflow.llm.lm import _packed, _unpacked

LENGTH, KGRAM = 50, 16
HOT = 4096
#: Bytes of documents of a group and of a shard; bytes handled at a time.
GROUP_BYTES, PART_BYTES, CHUNK = 2 << 20, 4 << 20, 1 << 16
U64 = np.uint64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.cumprod(np.append(U64(1), np.full(n - 1, b, U64)), dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Texts:
    """Documents of one group, in order of their row ids, and their windows' anchors."""

    def __init__(self, table: pa.Table, length: int):
        table = table.sort_by("rid")
        self.length = length
        self.ids = table.column("id").to_numpy(zero_copy_only=False)
        self.raw = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        found, at, n = [], 0, len(self.raw)
        while at < n:
            stop, size = at, 0
            while stop < n and (stop == at or size + len(self.raw[stop]) <= CHUNK):
                size += len(self.raw[stop])
                stop += 1
            found.append(self._anchors(at, stop))
            at = stop
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, U64)] * 7
        #: By anchor: document, first and last window start, hash, hash of the context, of the bytes to the left and right.
        self.doc, self.low, self.high, self.hash, self.context, self.left, self.right = columns

    def _prefix(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * power[:-1], out=total[1:])
        return total, inverse

    def _anchors(self, start: int, stop: int) -> tuple[np.ndarray, ...]:
        length = self.length
        size = np.array([len(x) for x in self.raw[start:stop]], np.int64)
        begin = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(self.raw[start:stop]), np.uint8)
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2 + (np.zeros(0, np.uint32),) * 2
        if not (size >= length).any():
            return none
        total, inverse = self._prefix(raw)
        n = len(raw) - KGRAM + 1
        gram = mix((total[KGRAM:] - total[:-KGRAM]) * inverse[:n])
        value, place = (gram >> U64(32)).astype(np.uint32), np.arange(n, dtype=np.int32)
        width = length - KGRAM + 1
        step = 1
        while step < width:
            shift = min(step, width - step)
            left = value[:-shift] <= value[shift:]
            place = np.where(left, place[:-shift], place[shift:])
            value = np.minimum(value[:-shift], value[shift:])
            step += shift
        long = np.flatnonzero(size >= length)
        count = size[long] - length + 1
        at = ragged(begin[long], count)
        doc = np.repeat(long, count)
        anchor = place[at]
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
        last = np.append(first[1:], len(at)) - 1
        low, high, doc, anchor = at[first], at[last], doc[first], anchor[first]
        end = high + length
        context = mix((total[end] - total[low]) * inverse[low] + U64(0xC2B2AE3D27D4EB4F) * ((end - low).astype(U64) * U64(1 << 20) + (anchor - low).astype(U64)))
        # A window has at least half of its other bytes on one side of the anchor; 0: no window here has.
        half = (length - KGRAM + 1) // 2
        sides = []
        for ok, a in ((low <= anchor - half, anchor - half), (end >= anchor + KGRAM + half, anchor)):
            a = np.where(ok, a, 0)
            z = np.where(ok, a + KGRAM + half, 0)
            sides.append(np.where(ok, (mix((total[z] - total[a]) * inverse[a]) >> U64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0)))
        # The least of hashes are small ones: mixed again, they spread evenly.
        return doc + start, low - begin[doc], high - begin[doc], mix(gram[anchor] + U64(5)), context, *sides

    def hot_windows(self, anchors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows of some anchors as anchors of their own."""
        out: list[tuple] = []
        for d in np.unique(self.doc[anchors]).tolist():
            own = anchors[self.doc[anchors] == d] if len(anchors) < 1000 else anchors[np.searchsorted(self.doc[anchors], d) : np.searchsorted(self.doc[anchors], d, "right")]
            at = ragged(self.low[own], self.high[own] - self.low[own] + 1)
            total, inverse = self._prefix(np.frombuffer(self.raw[d], np.uint8))
            h = (total[at + self.length] - total[at]) * inverse[at]
            none = np.zeros(len(at), np.uint32)
            out.append((np.full(len(at), d), at, at, mix(h + U64(11)), mix(h + U64(77)), none, none))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else ()

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes, and in how many documents each is (255: or more)."""
        order = np.lexsort((self.ids[self.doc], self.hash))
        h, d = self.hash[order], self.ids[self.doc[order]]
        new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
        h = h[new]
        h, n = np.unique(h, return_counts=True)
        return h, np.minimum(n, 255).astype(np.uint8)

    def shared(self, verdict: np.ndarray) -> None:
        """Keeps the anchors that are in other documents too; splits hot ones into windows."""
        kind = verdict[np.unique(self.hash, return_inverse=True)[1]]
        hot = self.hot_windows(np.flatnonzero(kind == 2))
        columns = [x[kind == 1] for x in (self.doc, self.low, self.high, self.hash, self.context, self.left, self.right)]
        columns = [np.concatenate(x) for x in zip(columns, hot)] if hot else columns
        order = np.lexsort((self.ids[columns[0]], columns[4], columns[3]))
        self.doc, self.low, self.high, self.hash, self.context, self.left, self.right = (x[order] for x in columns)
        new = np.append(True, (self.hash[1:] != self.hash[:-1]) | (self.context[1:] != self.context[:-1]))[: len(order)]
        #: The first entry of each (hash, context), of the smallest document here; the entry's number among them.
        self.first = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1
        self.own = self.ids[self.doc] == self.ids[self.doc[self.first]][self.entry] if len(order) else np.zeros(0, bool)

    def removed(self, verdict: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        """By document, its removed spans as rows (start, stop), merged."""
        gone = ~self.own | (verdict[self.entry] == 1) if len(self.entry) else np.zeros(0, bool)
        doc, start, stop = [self.doc[gone]], [self.low[gone]], [self.high[gone] + self.length]
        starts = np.searchsorted(self.entry, np.arange(len(self.first) + 1))
        for entry, a, z in found:
            # A span of a context holds wherever this document has the context.
            n = starts[entry + 1] - starts[entry]
            where = ragged(starts[entry], n)
            keep = self.own[where]
            doc.append(self.doc[where][keep])
            start.append((self.low[where] + np.repeat(a, n))[keep])
            stop.append((self.low[where] + np.repeat(z, n))[keep])
        doc, start, stop = (np.concatenate(x).astype(np.int64) for x in (doc, start, stop))
        order = np.lexsort((start, doc))
        doc, start, stop = doc[order], start[order], stop[order]
        cuts = np.searchsorted(doc, np.arange(len(self.raw) + 1))
        return [_merged(start[a:z], stop[a:z]) for a, z in zip(cuts[:-1], cuts[1:])]


def _merged(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(stop)
    new = np.append(True, start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([start[first], reach[np.append(first[1:], len(start)) - 1]], 1)


_SENT = "part int, g int, data binary"
_BACK = "stage int, part int, g int, data binary"


def _cuts(hashes: np.ndarray, n: int) -> list[int]:
    """Where sorted hashes part into `n` equal ranges."""
    borders = (np.arange(1, n, dtype=np.float64) / n * 2.0**64).astype(U64)
    return [0, *np.searchsorted(hashes, borders, "left").tolist(), len(hashes)]


def _send(g: int, hashes: np.ndarray, others: list[np.ndarray], n: int) -> pa.Table:
    cuts, rows = _cuts(hashes, n), ([], [], [])
    for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if z > a:
            for row, x in zip(rows, (p, g, _packed([hashes[a:z], *(o[a:z] for o in others)]))):
                row.append(x)
    return pa.table([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["part", "g", "data"])


def _answers(right: pa.Table, stage: int) -> list[bytes]:
    rows = [(p, d) for s, p, d in zip(*(right.column(c).to_pylist() for c in ("stage", "part", "data"))) if s == stage]
    return [d for _, d in sorted(rows)]


def _verdict(right: pa.Table, stage: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(d, np.uint8) for d in _answers(right, stage))])


def _reply(stage: int, part: int, groups: list[int], sizes: list[int], verdict: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = 0
    for g, n in zip(groups, sizes):
        yield _back(stage, part, g, verdict[at : at + n].astype(np.uint8).tobytes())
        at += n


def _back(stage: int, part: int, g: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([stage], pa.int32()), pa.array([part], pa.int32()), pa.array([g], pa.int32()), pa.array([data])], ["stage", "part", "g", "data"])


def _by_part(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple[int, list[int], list[int], list[np.ndarray]]]:
    """(part, groups, their sizes, concatenated columns) of what groups sent."""
    held: dict[int, list] = {}
    for b in batches:
        for p, g, raw in zip(*(b.column(c).to_pylist() for c in ("part", "g", "data"))):
            held.setdefault(p, []).append((g, _unpacked(raw, kinds)))
    for p in sorted(held):
        rows = sorted(held.pop(p), key=lambda r: r[0])
        yield p, [g for g, _ in rows], [len(x[0]) for _, x in rows], [np.concatenate(c) for c in zip(*(x for _, x in rows))]


def _judge_anchors(hot: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, groups, sizes, (h, n) in _by_part(batches, [U64, np.uint8]):
            _, back = np.unique(h, return_inverse=True)
            total = np.bincount(back, n)[back]
            yield from _reply(0, p, groups, sizes, np.where(total >= hot, 2, total >= 2))

    return judge


def _judge_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, groups, sizes, (h, c, d, left, right) in _by_part(batches, [U64, U64, np.int64, np.uint32, np.uint32]):
        order = np.lexsort((d, c, h))
        sh, sc, sd = h[order], c[order], d[order]
        new_h = np.append(True, sh[1:] != sh[:-1])
        new = new_h | np.append(True, sc[1:] != sc[:-1])
        first = np.flatnonzero(new)
        least = sd[first][np.cumsum(new) - 1]
        anchor = (np.cumsum(new_h) - 1)[first].astype(U64) << U64(32)
        like = np.zeros(len(first), bool)
        for side in (left, right):
            side = side[order][first]
            _, back, n = np.unique(anchor | side.astype(U64), return_inverse=True, return_counts=True)
            like |= (n[back] > 1) & (side > 0)
        verdict = np.empty(len(h), np.uint8)
        verdict[order] = np.where(sd > least, 1, np.where(like[np.cumsum(new) - 1], 2, 0))
        yield from _reply(1, p, groups, sizes, verdict)


def _sort_contexts(length: int, memory: int):
    """Suffix array of the contexts of a shard; answers with the spans of windows that smaller documents have."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for p, g, raw in zip(*(b.column(c).to_pylist() for c in ("part", "g", "data"))):
                held.setdefault(p, []).append((g, *_unpacked(raw, [np.int64, np.int64, np.int64, np.uint8])))
        for p in sorted(held):
            rows = held.pop(p)
            size = np.concatenate([r[3] for r in rows])
            doc = np.concatenate([r[2] for r in rows])
            begin = np.cumsum(size + 1) - size - 1
            text = np.concatenate([r[4] for r in rows])
            owner = np.repeat(np.arange(len(size)), size + 1)
            # Windows within a context, by the start.
            window = np.zeros(len(text) + 1, bool)
            window[ragged(begin, size - length + 1)] = True
            gone = np.zeros(len(text) + 1, bool)
            run: list[np.ndarray] = []

            def close():
                at = np.concatenate(run) if run else np.zeros(0, np.int64)
                run.clear()
                at = at[window[at]]
                if len(at) > 1:
                    d = doc[owner[at]]
                    gone[at[d > d.min()]] = True

            for x in induced.Sorter(text, length, in_memory_names=memory).backwards():
                # A run goes on where the common prefix is a whole window.
                cuts = np.flatnonzero(x["lcp"] < length)
                at = x["at"]
                if not len(cuts):
                    run.append(at)
                    continue
                run.append(at[: cuts[0]])
                close()
                inner = np.flatnonzero(np.diff(np.append(cuts, len(at))) > 1)
                for k in inner[: -1 if len(inner) and inner[-1] == len(cuts) - 1 else None].tolist():
                    run.append(at[cuts[k] : cuts[k + 1]])
                    close()
                run.append(at[cuts[-1] :])
            close()
            starts = np.flatnonzero(gone)
            of = owner[starts]
            a, z = starts - begin[of], starts - begin[of] + length
            at = 0
            for g, entry, _, s, _ in rows:
                lo, hi = np.searchsorted(of, [at, at + len(s)])
                if hi > lo:
                    yield _back(2, p, g, _packed([entry[of[lo:hi] - at], a[lo:hi], z[lo:hi]]))
                at += len(s)

    return sort


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, part_bytes: int = PART_BYTES, group_bytes: int = GROUP_BYTES, memory: int = induced.IN_MEMORY) -> DataFrame:
    """One row for each row of `docs`: the key, n_bytes, spans (removed runs: start, stop, start, ...), kept (the other bytes).

    A null text counts as empty. Rows that share a key have nothing removed for one another's sake. A row
    whose key is null takes no part: it is returned whole. Integer keys; other columns don't matter. No rows: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    size = scan_bytes(docs)
    n, groups = parts(size, part_bytes), parts(size, group_bytes)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups)
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int"))
    name = f"repeated_{uuid.uuid4().hex}"
    # Buckets need a name in the catalogue; the files stay when it is dropped.
    rows.repartition(buckets, "g").write.bucketBy(buckets, "g").format("parquet").option("path", work_dir(spark, "repeated")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    known = table.where("id is not null")

    def count(key: tuple, left: pa.Table) -> pa.Table:
        return _send(key[0].as_py(), *_listed(Texts(left, length).counted()), n)

    def contexts(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        t = Texts(left, length)
        t.shared(_verdict(right, 0))
        return _send(key[0].as_py(), t.hash[t.first], [t.context[t.first], t.ids[t.doc[t.first]].astype(np.int64), t.left[t.first], t.right[t.first]], n)

    def texts(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        t = Texts(left, length)
        t.shared(_verdict(right, 0))
        entry = np.flatnonzero(_verdict(right, 1) == 2)
        at = t.first[entry]
        cuts, rows = _cuts(t.hash[at], n), ([], [], [])
        for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if z > a:
                own = at[a:z].tolist()
                pieces = [t.raw[t.doc[k]][t.low[k] : t.high[k] + length] for k in own]
                # No text in UTF-8 holds the byte that parts contexts.
                raw = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
                data = _packed([entry[a:z], t.ids[t.doc[at[a:z]]].astype(np.int64), np.array([len(x) for x in pieces], np.int64), raw])
                for row, x in zip(rows, (p, key[0].as_py(), data)):
                    row.append(x)
        return pa.table([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["part", "g", "data"])

    def result(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        t = Texts(left, length)
        t.shared(_verdict(right, 0))
        spans = t.removed(_verdict(right, 1), [tuple(_unpacked(d, [np.int64] * 3)) for d in _answers(right, 2)])
        kept = []
        for raw, s in zip(t.raw, spans):
            edges = [0, *s.ravel().tolist(), len(raw)]
            kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])))
        return pa.table([pa.array(t.ids.astype(np.int64)), pa.array([len(x) for x in t.raw], pa.int64()), pa.array([s.ravel() for s in spans], pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    def sent(df: DataFrame) -> DataFrame:
        return df.repartitionById(n, F.col("part"))

    first = sent(known.groupBy("g").applyInArrow(count, _SENT)).mapInArrow(_judge_anchors(hot), _BACK)
    back = written(first, "anchors-judged")
    second = sent(known.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(contexts, _SENT)).mapInArrow(_judge_contexts, _BACK)
    back = back.unionAll(written(second, "contexts-judged"))
    third = sent(known.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(texts, _SENT)).mapInArrow(_sort_contexts(length, memory), _BACK)
    back = back.unionAll(written(third, "windows-judged"))
    out = known.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(result, "id bigint, n_bytes bigint, spans array<bigint>, kept binary")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    alone = table.where("id is null").select("id", F.octet_length(raw).cast("bigint").alias("n_bytes"), F.array().cast("array<bigint>").alias("spans"), raw.alias("kept"))
    return out.unionAll(alone).withColumnRenamed("id", key)


def _listed(pair: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    return pair[0], [pair[1]]
