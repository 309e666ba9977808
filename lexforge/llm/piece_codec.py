"""SentencePiece encoding and decoding for merge-type vocabularies.

A chunk's characters are its first symbols.  An agenda, ordered by score and then from left to
right, holds each pair of neighbours whose joint text is in the vocabulary; the best pair merges,
and the pairs it forms with its neighbours enter the agenda.  Symbols that aren't in the vocabulary
fall back to byte pieces.  Every distinct chunk that the agenda encodes is checked, in the Arrow
batch where it turns up, against the sentencepiece library; a difference raises an error.

Texts are cut before a space that follows another character, as no piece holds a space inside (that
is tested on the vocabulary; else a text is one chunk), chunks between characters that no piece has
side by side, and each distinct chunk or part is encoded once while it stays in a bounded cache.

Defined results: null texts are empty, have no ids and decode to the empty text; repeated and null
identifiers are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm._tokens import GROUP_BYTES, ChunkCache, without_collection

#: Marks cuts inside Arrow; texts that hold it go another way.
CUT = "\x01"
SPACE = "▁"
_NEVER = float("inf")
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """Encoder and decoder read from a model file's bytes."""

    def __init__(self, model: bytes, check: bool = True, cache: int = 200_000):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        size = range(self.library.get_piece_size())
        self.pieces = [self.library.id_to_piece(i) for i in size]
        self.bytes = {i: int(self.pieces[i][3:-1], 16) for i in size if self.library.is_byte(i)}
        self.fallback = {b: i for i, b in self.bytes.items()}
        self.unknown = self.library.unk_id()
        self.silent = {i for i in size if self.library.is_control(i)}
        special = self.silent | {self.unknown} | self.bytes.keys()
        self.rank = {p: (-self.library.get_score(i), i) for i, p in enumerate(self.pieces) if i not in special}
        self.scores = {p: score for p, (score, _) in self.rank.items()}
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank)
        self.shown = [
            bytes([self.bytes[i]]) if i in self.bytes else b"" if i in self.silent else p.encode() for i, p in enumerate(self.pieces)
        ]
        # No merge spans two characters that stand side by side in no piece: there a chunk is cut too.
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.check = check
        self.cache = ChunkCache(self._values, cache)
        self.parts = ChunkCache(lambda parts: map(self.merge, parts), cache)

    def cut(self, chunk: str) -> list[str]:
        """The parts of a chunk that merge each on their own."""
        pairs = self.pairs
        at = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in pairs]
        if not at:
            return [chunk]
        return [chunk[i:j] for i, j in zip([0, *at], [*at, len(chunk)])]

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk in which spaces are written as the space symbol."""
        rank = self.rank
        ids = []
        for s in self._short(chunk) if len(chunk) <= 24 else self._long(chunk):
            if (found := rank.get(s)) is not None:
                ids.append(found[1])
            elif self.fallback:
                ids += [self.fallback[b] for b in s.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _short(self, chunk: str) -> list[str]:
        """The merged symbols; the agenda is a list of the ranks of all pairs, from left to right."""
        scores, symbols = self.scores, list(chunk)
        agenda = [scores.get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = scores.get(symbols[i] + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = scores.get(symbols[i - 1] + symbols[i], _NEVER)
        return symbols

    def _long(self, chunk: str) -> list[str]:
        """The merged symbols; the agenda is a heap of ranks and places."""
        scores, symbols = self.scores, list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((scores[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has merged with another since
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                joint = pair + symbols[after[i]]
                if joint in scores:
                    heapq.heappush(agenda, (scores[joint], i, joint))
            if before[i] >= 0:
                joint = symbols[before[i]] + pair
                if joint in scores:
                    heapq.heappush(agenda, (scores[joint], before[i], joint))
        return [s for s in symbols if s]

    def _values(self, chunks: list[str]) -> Iterator[tuple[str, int, bytes]]:
        found = []
        for start in range(0, len(chunks), 4096):
            for values in self.parts.of([self.cut(c) for c in chunks[start : start + 4096]]):
                found.append(values[0] if len(values) == 1 else [i for v in values for i in v])
        if self.check:
            # The library puts a space symbol before what it is given, as most chunks begin with one.
            # Those that follow a line break are given with it, and its ids stand before theirs.
            asked = [c[1:].replace(SPACE, " ") if c[0] == SPACE else "\n" + c for c in chunks]
            told = self.library.encode(asked, num_threads=1)
            head = self.library.encode("\n")
            for chunk, ids, other in zip(chunks, found, told, strict=True):
                whole = ids if chunk[0] == SPACE else head + ids
                if whole != other and chunk != SPACE:  # an empty text has no ids there
                    raise ValueError(f"{chunk!r}: {ids} here, {other} by the library")
        for ids in found:
            yield ",".join(map(str, ids)), len(ids), self.surface(ids)

    def surface(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, space symbols and all."""
        shown = self.shown
        return b"".join([shown[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        shown = SPACE + text.replace(" ", SPACE)
        if self.whole:
            return [shown]
        if SPACE + SPACE in shown or shown[-1] == SPACE:
            return _CHUNK.findall(shown)
        return [SPACE + c for c in shown[1:].split(SPACE)]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for part in self.cut(c) for i in self.merge(part)]

    def decode(self, ids: list[int]) -> str:
        return self.text(self.surface(ids))

    @staticmethod
    def text(surface: bytes) -> str:
        shown = surface.decode("utf-8", "replace").replace(SPACE, " ")
        return shown[1:] if shown[:1] == " " else shown

    def digests(self, column) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text) of each text of an Arrow array."""
        import pyarrow.compute as pc

        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(column):  # in groups of bounded size
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + GROUP_BYTES)))
            yield from self._group(column.slice(start, end - start))
            start = end

    def _group(self, column) -> Iterator[tuple[int, str, str]]:
        import pyarrow.compute as pc

        first, nothing = pa.scalar(SPACE, pa.large_string()), pa.scalar("", pa.large_string())
        shown = pc.binary_join_element_wise(first, pc.replace_substring(column, " ", SPACE), nothing)
        plain = pc.invert(pc.match_substring_regex(shown, rf"\A{SPACE}\z|{SPACE}{SPACE}|{SPACE}\z|{CUT}")).to_numpy(zero_copy_only=False)
        plain &= not self.whole
        values: dict[int, list[str]] = {}
        for i in np.flatnonzero(~plain).tolist():
            values[i] = self.chunks(column[i].as_py())
        # The texts of the others are cut by Arrow: at each space, and around line breaks, which no piece holds.
        marked = pc.replace_substring(shown.filter(pa.array(plain)), SPACE, CUT + SPACE)
        if not any("\n" in p for p in self.rank):
            marked = pc.replace_substring(marked, "\n", f"{CUT}\n{CUT}")
        cut = pc.split_pattern(marked, CUT)
        found = cut.values.dictionary_encode()
        known = found.dictionary.to_pylist()
        got = [("", 0, b"")] * len(known)
        asked = [i for i, c in enumerate(known) if c]
        for i, value in zip(asked, self.cache.of([[known[i] for i in asked]])[0], strict=True):
            got[i] = value
        counts = np.fromiter((v[1] for v in got), np.int64, len(got))
        which = found.indices.to_numpy(zero_copy_only=False)
        offsets = cut.offsets.to_numpy()
        total = np.concatenate(([0], np.cumsum(counts[which])))
        numbers = (total[offsets[1:]] - total[offsets[:-1]]).tolist()

        def joined(strings, kind) -> list:
            parts = pa.array(strings, kind).take(found.indices)
            return pc.binary_join(pa.LargeListArray.from_arrays(cut.offsets, parts), pa.scalar(b"" if kind == pa.large_binary() else "", kind)).to_pylist()

        # each chunk's ids end with a comma, of which the last one of a text goes
        ids = iter(zip(numbers, joined([v[0] + "," if v[1] else "" for v in got], pa.large_string()), joined([v[2] for v in got], pa.large_binary())))
        for i in range(len(column)):
            if plain[i]:
                n, told, surface = next(ids)
                told = told[:-1]
            else:
                parts = self.cache.of([values[i]])[0]
                n, told, surface = sum(v[1] for v in parts), ",".join(v[0] for v in parts), b"".join(v[2] for v in parts)
            yield n, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(self.text(surface).encode()).hexdigest()


_loaded: dict[tuple[str, bool], PieceCodec] = {}


def _encode(batches: Iterator[pa.RecordBatch], model: bytes, key: tuple[str, bool]) -> Iterator[pa.RecordBatch]:
    codec = _loaded.get(key)
    if codec is None:
        codec = _loaded[key] = PieceCodec(model, key[1])
    for batch in batches:
        with without_collection():
            rows = list(codec.digests(batch.column(1)))
        if rows:
            n, ids, shown = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(shown)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Digests of the ids and of the decoded text of every document (columns of :data:`ROWS`)."""
    raw = open(model_path, "rb").read()
    model, key = docs.sparkSession.sparkContext.broadcast(raw), (hashlib.sha256(raw).hexdigest(), check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode(batches, model.value, key)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ROWS)
