"""Suffix arrays with common prefixes by external induced sorting.

The sorter keeps what it has in flight in disk-backed queues: priority is by first symbol, and induction
fills each symbol's queue in order, so a queue is a run that is appended at one end and read at the
other; beyond its buffer it lives in a file. Elements are suffix tuples (position, common prefix with the
element before, capped at `depth`). Leftmost S-type (LMS) substrings are sorted by a first induction and
named; where names repeat, the reduced string is sorted recursively, in memory if it fits the budget and
else by scalar induction over a priority queue of sorted runs on disk. A second induction carries the
common prefixes: of two neighbours in a queue it is one more than the least between their sources.
"""

from __future__ import annotations

import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np

#: Elements of a queue or a heap that stay in memory.
BUFFER = 1 << 18
#: Elements that a step of an induction handles.
STEP = 1 << 16
#: Reduced strings of at most so many names are sorted in memory.
IN_MEMORY = 8 << 20

ELEMENT = np.dtype([("at", np.int64), ("lcp", np.uint8)])


class Queue:
    """A run of elements, first in first out; what exceeds the buffer goes to a file."""

    def __init__(self, folder: str, buffer: int = BUFFER):
        self.folder, self.buffer = folder, buffer
        self.head: list[np.ndarray] = []
        self.tail: list[np.ndarray] = []
        self.held = self.on_disk = self.read = self.size = 0
        self.file = None

    def push(self, items: np.ndarray) -> None:
        if not len(items):
            return
        self.size += len(items)
        self.tail.append(items)
        self.held += len(items)
        if self.held > self.buffer:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.folder)
            self.file.seek(self.on_disk * ELEMENT.itemsize)
            for x in self.tail:
                self.file.write(x.tobytes())
                self.on_disk += len(x)
            self.tail, self.held = [], 0

    def pop(self, most: int = STEP) -> np.ndarray:
        """The next elements, at most `most`; none if the queue is empty."""
        if self.read < self.on_disk:
            self.file.seek(self.read * ELEMENT.itemsize)
            out = np.frombuffer(self.file.read(min(most, self.on_disk - self.read) * ELEMENT.itemsize), ELEMENT)
            self.read += len(out)
        elif self.tail:
            out = np.concatenate(self.tail) if len(self.tail) > 1 else self.tail[0]
            self.tail, self.held = ([out[most:]], len(out) - most) if len(out) > most else ([], 0)
            out = out[:most]
        else:
            out = np.zeros(0, ELEMENT)
        self.size -= len(out)
        return out

    def all(self) -> Iterator[np.ndarray]:
        while len(x := self.pop()):
            yield x

    def backwards(self) -> Iterator[np.ndarray]:
        """All elements from the last to the first; empties the queue."""
        for x in reversed(self.tail):
            yield x[::-1]
        end = self.on_disk
        while end > self.read:
            begin = max(self.read, end - STEP)
            self.file.seek(begin * ELEMENT.itemsize)
            yield np.frombuffer(self.file.read((end - begin) * ELEMENT.itemsize), ELEMENT)[::-1]
            end = begin
        self.tail, self.held, self.size, self.read = [], 0, 0, self.on_disk


class Heap:
    """A priority queue of (key, order, value) integers: a heap in memory, sorted runs on disk."""

    def __init__(self, folder: str, buffer: int = BUFFER):
        self.folder, self.buffer = folder, buffer
        self.heap: list[tuple[int, int, int]] = []
        self.runs: list[tuple[tuple[int, int, int], int, object]] = []

    def push(self, item: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.buffer:
            run = tempfile.TemporaryFile(dir=self.folder)
            for x in sorted(self.heap):
                run.write(struct.pack("<qqq", *x))
            self.heap = []
            run.seek(0)
            self._next(len(self.runs), run)

    def _next(self, n: int, run) -> None:
        raw = run.read(24)
        if raw:
            heapq.heappush(self.runs, (struct.unpack("<qqq", raw), n, run))

    def peek(self) -> tuple[int, int, int] | None:
        best = self.heap[0] if self.heap else None
        if self.runs and (best is None or self.runs[0][0] < best):
            best = self.runs[0][0]
        return best

    def pop(self) -> tuple[int, int, int]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, n, run = heapq.heappop(self.runs)
            self._next(n, run)
            return item
        return heapq.heappop(self.heap)


def in_memory(names: np.ndarray, most: int | None = None) -> np.ndarray:
    """Ranks of the suffixes of a string of integers by their first `most` integers (all), by doubling."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    n, step = len(names), 1
    while step < min(n, most or n) and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        step *= 2
    return rank


def by_heap(names: np.ndarray, folder: str, buffer: int = BUFFER) -> np.ndarray:
    """Ranks of the suffixes of a string of integers, by scalar induction; recursive."""
    n = len(names)
    if n < 3 or len(np.unique(names)) == n:
        return in_memory(names)
    s = np.append(names + 1, 0)
    kind = np.zeros(n + 1, bool)
    kind[n] = True
    for i in range(n - 1, -1, -1):
        kind[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and kind[i + 1])
    lms = [i for i in range(1, n + 1) if kind[i] and not kind[i - 1]]

    def induce(seeds: list[int]) -> Iterator[int]:
        """Suffix positions in order, from LMS positions in order."""
        larger, count = Heap(folder, buffer), 0
        by_symbol = sorted(range(len(seeds)), key=lambda k: (s[seeds[k]], k))
        at, out = 0, Heap(folder, buffer)
        while at < len(by_symbol) or larger.peek() is not None:
            top = larger.peek()
            if top is not None and (at == len(by_symbol) or top[0] <= s[seeds[by_symbol[at]]]):
                c, _, i = larger.pop()
                out.push((-c, -count, i))
            else:
                i = seeds[by_symbol[at]]
                at += 1
            count += 1
            if i and not kind[i - 1]:
                larger.push((int(s[i - 1]), count, i - 1))
        smaller, found, count = Heap(folder, buffer), [], 0
        smaller.push((0, 0, n))
        while out.peek() is not None or smaller.peek() is not None:
            x, y = out.peek(), smaller.peek()
            # Backwards; within a symbol the S-type suffixes are the larger ones.
            i = (smaller if x is None or (y is not None and y[0] <= x[0]) else out).pop()[2]
            found.append(i)
            count += 1
            if i and kind[i - 1]:
                smaller.push((-int(s[i - 1]), count, i - 1))
        return reversed(found)

    is_lms = set(lms)
    order = [i for i in induce(lms) if i in is_lms]
    ends = dict(zip(lms, [*lms[1:], n]))
    name, names_of, before = -1, {}, None
    for i in order:
        piece = tuple(s[i : ends[i] + 1])
        if piece != before:
            name, before = name + 1, piece
        names_of[i] = name
    if name + 1 < len(lms):
        ranks = by_heap(np.array([names_of[i] for i in lms]), folder, buffer)
        order = [i for _, i in sorted(zip(ranks.tolist(), lms))]
    out = np.zeros(n, np.int64)
    for r, i in enumerate(x for x in induce(order) if x < n):
        out[i] = r
    return out


class Sorter:
    """Sorts the suffixes of `text` (non-empty bytes) by their first `depth` (below 255) bytes at least and gives them with common prefixes capped at `depth`.

    LMS suffixes are two bytes apart or more, so their first depth / 2 + 1 names tell `depth` bytes.
    """

    def __init__(self, text: np.ndarray, depth: int, folder: str | None = None, buffer: int = BUFFER, in_memory_names: int = IN_MEMORY):
        self.depth, self.folder, self.buffer, self.budget = depth, folder or tempfile.gettempdir(), buffer, in_memory_names
        n = self.n = len(text)
        # Symbol 0 is the end.
        self.s = np.zeros(n + 1, np.int16)
        self.s[:n] = text.astype(np.int16) + 1
        change = np.flatnonzero(self.s[1:] != self.s[:-1])
        nearest = change[np.searchsorted(change, np.arange(n))] if n < 1 << 16 else self._next_change(change)
        self.small = np.ones(n + 1, bool)  # S-type
        self.small[:n] = self.s[:n] < self.s[nearest + 1]
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.symbols = np.flatnonzero(np.bincount(self.s, minlength=258))

    def _next_change(self, change: np.ndarray) -> np.ndarray:
        out = np.empty(self.n, np.int64)
        lengths = np.diff(np.append(-1, change))
        out[:] = np.repeat(change, lengths)[: self.n]
        return out

    def _queues(self) -> dict[int, Queue]:
        return {int(c): Queue(self.folder, self.buffer) for c in self.symbols}

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes a and b, capped."""
        out = np.zeros(len(a), np.uint8)
        live = np.arange(len(a))
        for k in range(self.depth):
            x, y = a[live] + k, b[live] + k
            ok = (x <= self.n) & (y <= self.n)
            live, x, y = live[ok], x[ok], y[ok]
            live = live[(self.s[x] == self.s[y]) & (self.s[x] != 0)]
            if not len(live):
                break
            out[live] += 1
        return out

    def _spread(self, items: np.ndarray, wanted: np.ndarray, queues: dict[int, Queue], least: np.ndarray | None) -> None:
        """Pushes the suffixes before `items` where wanted; `lcp` of an item is with the item before it.

        `least[c]`: the least common prefix since the last push to c, -1 before the first; None: no prefixes are asked for.
        """
        picked = np.flatnonzero(wanted)
        if least is not None and len(items):
            lcp = items["lcp"].astype(np.int16)
            before, lowest = least.copy(), lcp.min()
            np.minimum(least, lowest, out=least)
        if not len(picked):
            return
        targets = self.s[items["at"][picked] - 1]
        by_target = np.argsort(targets, kind="stable")
        picked, targets = picked[by_target], targets[by_target]
        first = np.flatnonzero(np.append(True, targets[1:] != targets[:-1]))
        heads, ends = targets[first], np.append(first[1:], len(picked))
        out = np.zeros(len(picked), ELEMENT)
        out["at"] = items["at"][picked] - 1
        if least is not None:
            # The least of lcp over (previous pick of the target, this pick]: a sparse table of minima.
            begin = np.zeros(len(picked), np.int64)
            begin[1:] = picked[:-1] + 1
            begin[first] = 0
            level = np.frexp((picked - begin + 1).astype(np.float64))[1] - 1
            table, value = lcp, np.empty(len(picked), np.int16)
            for k in range(int(level.max()) + 1):
                here = np.flatnonzero(level == k)
                value[here] = np.minimum(table[begin[here]], table[picked[here] - (1 << k) + 1])
                if k < level.max():
                    table = np.minimum(table[: -(1 << k)], table[1 << k :])
            value[first] = np.minimum(value[first], before[heads])
            out["lcp"] = np.minimum(value + 1, self.depth)
            # What has passed since the last pick of each target.
            back = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.depth)
            least[heads] = back[picked[ends - 1] + 1]
        for c, a, z in zip(heads.tolist(), first.tolist(), ends.tolist()):
            queues[c].push(out[a:z])

    def _seam(self, last: int, first: int) -> int:
        return int(self._common(np.array([last]), np.array([first]))[0])

    def _induce(self, seeds: dict[int, Queue], whole: bool) -> Iterator[np.ndarray]:
        """Elements backwards, from the largest suffix to the smallest; `lcp` is with the element given before (the next larger).

        `seeds`: LMS suffixes by symbol. Unless `whole`, their order within a symbol is any.
        """
        larger, kept = self._queues(), self._queues()
        least = np.full(258, -1, np.int16) if whole else None
        for c in self.symbols.tolist():
            last = -1
            while len(x := larger[c].pop()):
                kept[c].push(x)
                last = int(x["at"][-1])
                ok = x["at"] > 0
                before = self.s[np.maximum(x["at"] - 1, 0)]
                self._spread(x, ok & (before >= c), larger, least)
            start = True
            for x in seeds[c].all():
                if start:
                    x = x.copy()
                    x["lcp"][0] = self._seam(last, int(x["at"][0])) if whole and last >= 0 else 0
                    start = False
                self._spread(x, x["at"] > 0, larger, least)
        smaller = self._queues()
        least = np.full(258, -1, np.int16) if whole else None
        end = np.zeros(1, ELEMENT)
        end["at"] = self.n
        smaller[0].push(end)
        for c in self.symbols[::-1].tolist():
            last = -1
            while len(x := smaller[c].pop()):
                yield x
                last = int(x["at"][-1])
                before = self.s[np.maximum(x["at"] - 1, 0)]
                self._spread(x, (x["at"] > 0) & (before <= c) & self.small[x["at"] - 1], smaller, least)
            carry = None
            for x in kept[c].backwards():
                # An element's lcp was with the smaller neighbour, which now comes after it.
                y = x.copy()
                y["lcp"][1:] = x["lcp"][:-1]
                y["lcp"][0] = carry if carry is not None else self._seam(last, int(x["at"][0])) if whole and last >= 0 else 0
                carry = x["lcp"][-1]
                yield y
                before = self.s[np.maximum(y["at"] - 1, 0)]
                self._spread(y, (y["at"] > 0) & (before < c), smaller, least)

    def _by_symbol(self, order: np.ndarray, whole: bool) -> dict[int, Queue]:
        """LMS positions in order, as elements in the queues of their symbols."""
        queues = self._queues()
        for a in range(0, len(order), STEP):
            at = order[a : a + STEP]
            x = np.zeros(len(at), ELEMENT)
            x["at"] = at
            if whole:
                before = np.append(order[a - 1] if a else at[0], at[:-1])
                x["lcp"] = self._common(before, at)
                if not a:
                    x["lcp"][0] = 0
            symbols = self.s[at]
            for c in np.unique(symbols).tolist():
                queues[c].push(x[symbols == c])
        return queues

    def _names(self, order: np.ndarray) -> np.ndarray:
        """Names of LMS substrings, by position among the LMS suffixes; `order`: their positions, sorted by substring."""
        where = np.searchsorted(self.lms, order)
        ends = np.append(self.lms[1:], self.n)
        length = ends[where] - order + 1
        same = np.append(False, length[1:] == length[:-1])
        live = np.flatnonzero(same)
        k = 0
        while len(live):
            live = live[length[live] > k]
            if not len(live):
                break
            differ = (self.s[order[live] + k] != self.s[order[live - 1] + k]) | (self.small[order[live] + k] != self.small[order[live - 1] + k])
            same[live[differ]] = False
            live = live[~differ]
            k += 1
        names = np.empty(len(order), np.int64)
        names[where] = np.cumsum(~same) - 1
        return names

    def backwards(self) -> Iterator[np.ndarray]:
        """All suffixes from the largest to the smallest as elements (the end's own is the last, at n): `lcp` with the one before."""
        first = self._induce(self._by_symbol(self.lms, False), False)
        is_lms = np.zeros(self.n + 1, bool)
        is_lms[self.lms] = True
        order = np.concatenate([x["at"][is_lms[x["at"]]] for x in first])[::-1]
        names = self._names(order)
        if names.max(initial=0) + 1 < len(names):
            ranks = in_memory(names, self.depth // 2 + 1) if len(names) <= self.budget else by_heap(names, self.folder, self.buffer)
            order = self.lms[np.argsort(ranks, kind="stable")]
        yield from self._induce(self._by_symbol(order, True), True)
