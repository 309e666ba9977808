"""Runs: stretches of words that repeat with a period, found on a harmonic grid.

The words are those between ASCII white space, compared whole.  A run is a stretch with smallest period q
and at least ``max(least, exponent * q)`` words that no neighbouring word extends.  For every period p the
grid has the positions jp; a run of two periods or more holds two neighbours jp and (j+1)p, so the
longest common extensions of such pairs, forward and backward, show every run.  Extensions are range
minima of common-prefix values: over the suffix array of the words forward, over that of the reversed
words backward.

Texts of an Arrow batch are worked on together.  A run is covered by strings of ``_GRAM`` words that occur
twice in the document, so only stretches of such strings enter the suffix arrays; each is followed by
a symbol of its own, which ends every extension.  That screen loses nothing.  Memory is some 300 bytes a word
of one slice of at most ``_SLICE_BYTES`` of text, or of one longer document; a document of a single
word repeated needs the most.

Defined results: null, empty and blank texts have no words and no runs; repeated and null identifiers are
rows like any others; an empty table gives an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm._bytes import groups, mix

#: A run of at least six words and four periods holds a string of five words twice, one period apart.
_GRAM = 5
_SLICE_BYTES, _GRID_POINTS = 2 << 20, 1 << 20

SCHEMA = (
    "id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string"
)


class RangeMinimum:
    """Minima of ranges of an array: prefix and suffix minima of blocks, a sparse table of whole blocks."""

    _BLOCK = 16

    def __init__(self, values: np.ndarray):
        b, n = self._BLOCK, len(values)
        blocks = np.full((max(1, -(-n // b)), b), np.iinfo(np.int32).max, np.int32)
        blocks.reshape(-1)[:n] = values
        self.values = blocks.reshape(-1)
        self.ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [blocks.min(axis=1)]
        while len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def at(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last], both included, first <= last."""
        b = self._BLOCK
        out = np.minimum(self.behind[first], self.ahead[last])
        left, right = first // b, last // b
        between = np.flatnonzero(right - left > 1)
        if len(between):
            lo, hi = left[between] + 1, right[between]
            level = np.log2(hi - lo).astype(np.int64)
            for k in np.unique(level):
                of = np.flatnonzero(level == k)
                table = self.levels[k]
                out[between[of]] = np.minimum(out[between[of]], np.minimum(table[lo[of]], table[hi[of] - (1 << int(k))]))
        inside = np.flatnonzero(left == right)
        if len(inside):
            place, end = first[inside].copy(), last[inside]
            low = self.values[place]
            for _ in range(b - 1):
                np.minimum(place + 1, end, out=place)
                np.minimum(low, self.values[place], out=low)
            out[inside] = low
        return out


class Extensions:
    """Longest common extensions of pairs of positions, from the suffix array of ``symbols``."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        # ranks by the first 1, 2, 4, ... symbols, until all suffixes differ; an end is smaller than any symbol
        ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        order = np.argsort(ranks[0], kind="stable")
        width = 1
        while n and int(ranks[-1][order[-1]]) < n - 1:
            last = ranks[-1]
            key = last.astype(np.int64) * (n + 1)
            key[:-width] += last[width:].astype(np.int64) + 1
            order = np.argsort(key)
            ordered = key[order]
            new = np.zeros(n, np.int32)
            new[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
            ranks.append(new)
            width *= 2
        self.n, self.place = n, ranks[-1]
        # common prefixes of neighbours in the suffix array, by descending powers of two
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        common = np.zeros(max(0, n - 1), np.int32)
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero(np.maximum(a, b) < n)
            same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            a[same] += 1 << k
            b[same] += 1 << k
            common[same] += 1 << k
        self.minimum = RangeMinimum(common)

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common string that begins at i and at j (i < j; 0 beyond the end)."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero(j < self.n)
        x, y = self.place[i[inside]], self.place[j[inside]]
        out[inside] = self.minimum.at(np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64) - 1)
        return out


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ..."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _grid(starts: np.ndarray, ends: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(jp, p) of all pairs jp, (j+1)p inside the stretches, in portions."""
    periods = (ends - starts) // exponent
    periods[ends - starts < least] = 0
    stretch, p = np.repeat(np.arange(len(starts)), periods), _ramp(periods) + 1
    first = -(-starts[stretch] // p)
    pairs = np.maximum(0, (ends[stretch] - 1) // p - first)
    for lo, hi in groups(pairs.tolist(), _GRID_POINTS):
        n = pairs[lo:hi]
        step = np.repeat(p[lo:hi], n)
        yield (np.repeat(first[lo:hi], n) + _ramp(n)) * step, step


def periodic_runs(symbols: np.ndarray, bounds: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start and period.

    ``bounds`` are the ends of the stretches in ``symbols``; each stretch ends with a symbol that occurs nowhere else.
    """
    starts, ends = np.concatenate(([0], bounds))[:-1], bounds - 1
    n = len(symbols)
    found: list[np.ndarray] = []
    ahead = back = None
    for i, p in _grid(starts, ends, least, exponent):
        if ahead is None:
            ahead, back = Extensions(symbols), Extensions(symbols[::-1])
        forward = ahead.at(i, i + p)
        backward = back.at(n - (i + p), n - i)  # what ends just before both
        hit = np.flatnonzero(forward + backward + p >= np.maximum(least, exponent * p))
        if len(hit):
            run = np.stack((i[hit] - backward[hit], (i + p + forward)[hit], p[hit]), axis=1)
            new = np.concatenate(([True], (run[1:] != run[:-1]).any(axis=1)))  # neighbours on the grid show the same run
            found.append(np.unique(run[new], axis=0))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    every = np.unique(np.concatenate(found), axis=0)  # by start, end, period: the smallest period of a stretch comes first
    smallest = np.concatenate(([True], (every[1:, :2] != every[:-1, :2]).any(axis=1)))
    every = every[smallest]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def _stretches(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words lie in a string of _GRAM words that its document holds twice."""
    n = len(words) - _GRAM + 1
    inside = np.zeros(len(words), bool)
    if n <= 0:
        return inside
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.uint64)
    key = mix(document[:n] + np.uint64(1))
    for k in range(_GRAM):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].astype(np.uint64) + np.uint64(1))
    whole = np.flatnonzero(document[:n] == document[_GRAM - 1 :])
    order = whole[np.argsort(key[whole])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words) + 1, np.int32)
    edge[order[twice]] += 1
    np.subtract.at(edge, order[twice] + _GRAM, 1)
    return np.cumsum(edge[:-1]) > 0


def _runs_of(words: np.ndarray, offsets: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all documents; positions count over the whole slice."""
    if least <= _GRAM or exponent < 4:  # the screen doesn't hold for shorter runs
        inside = np.ones(len(words), bool)
    else:
        inside = _stretches(words, offsets)
    # a stretch ends with its document
    border = np.zeros(len(words) + 1, bool)
    border[offsets] = True
    apart = ~inside
    cut = np.flatnonzero(inside & (border[:-1] | np.concatenate(([True], apart[:-1]))))
    stop = np.flatnonzero(inside & (border[1:] | np.concatenate((apart[1:], [True])))) + 1
    long = stop - cut >= least
    cut, stop = cut[long], stop[long]
    size = stop - cut
    total = int(size.sum())
    symbols = np.empty(total + len(cut), np.int64)
    bounds = np.cumsum(size + 1)
    symbols[bounds - 1] = -1 - np.arange(len(cut))
    of = np.ones(len(symbols), bool)
    of[bounds - 1] = False
    symbols[of] = words[np.repeat(cut, size) + _ramp(size)]
    start, finish, period = periodic_runs(symbols, bounds, least, exponent)
    stretch = np.searchsorted(bounds, start, "right")
    shift = cut[stretch] - (bounds[stretch] - size[stretch] - 1)
    return start + shift, finish + shift, period


def _slice(texts: pa.Array, least: int, exponent: int) -> tuple[list, ...]:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    filled = pc.not_equal(lists.values, "")  # white space at either end leaves an empty word
    full = filled.to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(full)))[lists.offsets.to_numpy()].astype(np.int64)
    flat = lists.values.filter(filled)
    words = flat.dictionary_encode().indices.to_numpy()
    start, end, period = _runs_of(words, offsets, least, exponent)
    # a word goes if a run holds it after the run's first period
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.subtract.at(edge, end, 1)
    keep = np.cumsum(edge[:-1]) == 0
    kept_offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    kept = pa.ListArray.from_arrays(pa.array(kept_offsets, pa.int32()), flat.filter(pa.array(keep)))
    collapsed = [hashlib.sha256(memoryview(t.as_buffer())).hexdigest() for t in pc.binary_join(kept, pa.scalar(" ", pa.large_string()))]
    document = np.searchsorted(offsets, start, "right") - 1
    rows = np.split(np.stack((start - offsets[document], end - start, period), axis=1), np.searchsorted(document, np.arange(1, len(texts))))
    found, digests, longest = [], [], []
    for own in rows:
        every = own.tolist()
        found.append([{"start": s, "length": n, "period": p} for s, n, p in every])
        digests.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in every).encode()).hexdigest())
        longest.append(min(every, key=lambda r: (-r[1], r[0], r[2])) if every else None)
    return np.diff(offsets).tolist(), found, digests, longest, collapsed


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """One row per input row: its runs, the longest one (ties: smallest start, then period) and digests.

    ``runs_sha256`` is of the lines ``start,length,period`` of all runs, ``collapsed_sha256`` of the words
    left when each run keeps its first period only, joined by a space.  Columns as in ``SCHEMA``.
    """
    if least < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for lo, hi in groups(sizes, _SLICE_BYTES):
                n_words, found, digests, longest, collapsed = _slice(texts.slice(lo, hi - lo), least, exponent)
                part = lambda k: [r and r[k] for r in longest]  # noqa: E731, B023
                arrays = [
                    ids.slice(lo, hi - lo),
                    pa.array(n_words, pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    *(pa.array(part(k), pa.int64()) for k in range(3)),
                    pa.array([r and 1000 * r[1] // r[2] for r in longest], pa.int64()),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    pa.array(digests),
                    pa.array(collapsed),
                ]
                yield pa.RecordBatch.from_arrays(
                    arrays, ["id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256"]
                )

    return rows.mapInArrow(scan, SCHEMA)


def drop_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``docs`` without the words that repeat a run's first period; texts without a run stay as they are."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for text in texts:
                words = (text or "").encode().split()
                start, end, period = _runs_of(_numbered(words), np.array([0, len(words)]), least, exponent)
                if len(start):
                    gone = {i for s, e, p in zip(start.tolist(), end.tolist(), period.tolist()) for i in range(s + p, e)}
                    text = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(cut, schema)


def _numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
