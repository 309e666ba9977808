"""External induced suffix sorting, one shard at a time.

Queues hold suffix tuples (first symbol, kind, order, position) and keep at most ``memory`` of them
in memory: beyond that they write sorted runs to a folder and merge their heads.  The suffixes that
begin a rise (LMS) are sorted by recursion over their names; from them all other suffixes are induced,
those before a fall in ascending order, then those before a rise in descending order.  Common-prefix
values follow in text order and are carried to the sorted order through a queue as well.

The folder is the caller's; within a Spark job it has to be one the task owns.  Symbols are read
through memory maps.  This is the exact reference for repeated spans, not their main path: README.md
says why.

Defined results: no texts or empty texts have no repeats; texts are kept apart by separators that
match nothing.
"""

from __future__ import annotations

import heapq
import os
import pickle
from collections.abc import Iterable, Iterator

import numpy as np


class DiskQueue:
    """A priority queue of tuples that spills sorted runs to a folder."""

    def __init__(self, folder: str, memory: int = 1 << 18):
        self.folder, self.memory = folder, max(2, memory)
        self.heap: list[tuple] = []
        self.heads: list[tuple[tuple, int, Iterator[tuple]]] = []
        self.runs = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        keep = len(self.heap) // 4  # what comes out next stays
        path = os.path.join(self.folder, f"run-{id(self):x}-{self.runs}")
        with open(path, "wb") as out:
            for i in range(keep, len(self.heap), 1024):
                pickle.dump(self.heap[i : i + 1024], out)
        del self.heap[keep:]
        self._open(self._read(path))

    @staticmethod
    def _read(path: str) -> Iterator[tuple]:
        with open(path, "rb") as run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    break
        os.unlink(path)

    def _open(self, run: Iterator[tuple]) -> None:
        self.runs += 1
        if (first := next(run, None)) is not None:
            heapq.heappush(self.heads, (first, self.runs, run))

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, number, run = self.heads[0]
            if (following := next(run, None)) is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, number, run))
            return item
        return heapq.heappop(self.heap)

    def __bool__(self) -> bool:
        return bool(self.heap or self.heads)


def _file(folder: str, name: str, n: int) -> np.ndarray:
    return np.memmap(os.path.join(folder, name), np.int64, "w+", shape=(max(1, n),))[:n]


def _sorted_lms(text: np.ndarray, rises: np.ndarray, lms: np.ndarray, folder: str, memory: int, depth: int) -> list[int]:
    """LMS positions in the order of their suffixes."""
    names = DiskQueue(folder, memory)
    # of equal symbols the falling one is smaller; without this a part could pass for another's beginning
    kinds = 2 * np.asarray(text) + rises
    ends = np.append(lms[1:], len(text) - 1)
    for k, (i, j) in enumerate(zip(lms.tolist(), ends.tolist())):
        names.push((tuple(kinds[i : j + 1].tolist()), k))
    reduced = np.zeros(len(lms), np.int64)
    last, name = None, 0
    while names:
        symbols, k = names.pop()
        if last is not None and symbols != last:
            name += 1
        reduced[k], last = name, symbols
    if name + 1 == len(lms):
        order = np.argsort(reduced)
    else:
        order = suffix_array(reduced, folder, memory, depth + 1)
    return lms[order].tolist()


def suffix_array(text: np.ndarray, folder: str, memory: int = 1 << 18, depth: int = 0) -> np.ndarray:
    """Positions in the order of the suffixes; the end of the text is smaller than any symbol."""
    n = len(text)
    out = _file(folder, f"suffixes-{depth}", n)
    if n < 2:
        out[:] = 0
        return out
    # a suffix rises if it is smaller than the next one; the last one falls (to the end)
    step = np.sign(np.diff(text))
    same = np.flatnonzero(step)
    following = np.searchsorted(same, np.arange(n - 1))
    rises = np.zeros(n, bool)
    has = following < len(same)
    rises[:-1][has] = step[same[following[has]]] > 0
    lms = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    seeds = _sorted_lms(text, rises, lms, folder, memory, depth) if len(lms) > 1 else lms.tolist()
    queue = DiskQueue(folder, memory)
    # ascending: the end induces the last suffix; falling suffixes precede rising ones of the same symbol
    for order, i in enumerate(seeds):
        queue.push((int(text[i]), 1, order, i))
    queue.push((int(text[n - 1]), 0, -1, n - 1))
    falling = DiskQueue(folder, memory)
    count = 0
    while queue:
        symbol, kind, _, i = queue.pop()
        if kind == 0:
            falling.push((-symbol, 1, -count, i))
        if i and not rises[i - 1]:
            queue.push((int(text[i - 1]), 0, count, i - 1))
        count += 1
    # descending: rising suffixes follow falling ones of the same symbol, so they come first here
    queue, at, count = falling, n, 0
    while queue:
        _, _, _, i = queue.pop()
        at -= 1
        out[at] = i
        if i and rises[i - 1]:
            queue.push((-int(text[i - 1]), 0, count, i - 1))
        count += 1
    return out


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, folder: str, memory: int = 1 << 18) -> np.ndarray:
    """Common-prefix length of each suffix with the one before it in order."""
    n = len(text)
    out = _file(folder, "prefixes", n)
    by_place = DiskQueue(folder, memory)
    for rank in range(n):
        by_place.push((int(suffixes[rank]), rank, int(suffixes[rank - 1]) if rank else -1))
    by_rank = DiskQueue(folder, memory)
    h = 0
    while by_place:  # in text order a suffix loses one symbol at most
        i, rank, j = by_place.pop()
        if j < 0:
            h = 0
        else:
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
        by_rank.push((rank, h))
        h = max(0, h - 1)
    while by_rank:
        rank, h = by_rank.pop()
        out[rank] = h
    return out


def repeated_ranges(texts: Iterable[bytes], length: int, folder: str, memory: int = 1 << 18) -> list[list[tuple[int, int]]]:
    """For each text the maximal byte ranges covered by strings of ``length`` bytes that start elsewhere too."""
    data, starts, at = [], [], 0
    for k, t in enumerate(texts):
        starts.append(at)
        data.append(np.frombuffer(t, np.uint8).astype(np.int64))
        data.append(np.array([256 + k], np.int64))  # a separator of its own
        at += len(t) + 1
    if not data:
        return []
    text = np.concatenate(data)
    suffixes = suffix_array(text, folder, memory)
    prefixes = common_prefixes(text, suffixes, folder, memory)
    cover = np.zeros(len(text) + 1, np.int64)
    for rank in range(len(text)):
        if prefixes[rank] >= length or rank + 1 < len(text) and prefixes[rank + 1] >= length:
            cover[suffixes[rank]] += 1
            cover[min(len(text), suffixes[rank] + length)] -= 1
    inside = np.cumsum(cover)[:-1] > 0
    out = []
    for start, end in zip(starts, [*starts[1:], len(text)]):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside[start : end - 1].astype(np.int8), [0]))))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out
