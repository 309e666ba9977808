"""Whole-text encoding with public tokenizers, one distinct chunk at a time.

A text is cut only where no token of the tokenizers used here spans: at the added tokens (such as
<|endoftext|>, which is one id wherever it stands), at single spaces between two characters that
aren't white space and, in texts of plain characters, around lone full stops, commas and line breaks.  So the ids of a text are the ids of its chunks in order, and each distinct chunk
is encoded once while it stays in a bounded two-generation cache.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Longer chunks are encoded each time and never cached.
LONGEST_CACHED = 64
#: Bytes of text that are encoded together.
GROUP_BYTES = 4_000_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A word that is one token run of its own in both vocabularies' splitting patterns.
_WORD = re.compile(f"[{_LETTERS}]+")
_SPACED_WORD = re.compile(f" [{_LETTERS}]+")
#: What keeps a text from being cut at its full stops, commas and line breaks as well: a character
#: outside the plain ones, an apostrophe, two white spaces or two marks in a row, a mark after a
#: space, a space at either end.
_NOT_SIMPLE_RE2 = r"[^ -~\nÀ-ÖØ-öø-ÿ]|'|[ \n]{2}|[!-/:-@\[-`{-~]{2}|[ \n][.,]|\A |[ ]\z"


def cut_any(text: str) -> list[str]:
    """The chunks of any text.  A chunk stands after a space; if it begins with "\\1", it doesn't."""
    if not text:
        return []
    chunks = _CUT.split(text)
    return ["\1" + chunks[0], *["\0" + c if c[0] in "\0\1" else c for c in chunks[1:]]]


@contextmanager
def without_collection() -> Iterator[None]:
    """Caches hold many objects and no cycles: collecting garbage would only walk them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class ChunkCache:
    """chunk -> value, holding about ``2 * limit`` of the chunks used last."""

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = 250_000):
        self.encode, self.limit, self.new, self.old = encode, limit, {}, {}

    def of(self, texts_chunks: list[list[str]]) -> list[list]:
        """The values of each text's chunks."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = set()
        for chunks in texts_chunks:
            missing.update(set(chunks).difference(new))
        for chunk in [c for c in missing if c in old]:
            new[chunk] = old[chunk]
            missing.discard(chunk)
        ask = list(missing)
        passing = {}
        for chunk, value in zip(ask, self.encode(ask), strict=True):
            (new if len(chunk) <= LONGEST_CACHED else passing)[chunk] = value
        if passing:
            return [[new[c] if c in new else passing[c] for c in chunks] for chunks in texts_chunks]
        return [list(map(new.__getitem__, chunks)) for chunks in texts_chunks]


class Encoder:
    """Token ids of chunks and texts by one tokenizer, as little-endian unsigned integers."""

    def __init__(self, model: bytes, width: int, split: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.split, self.kind = split, np.dtype(f"<u{width}")
        # The library finds added tokens first and encodes what stands between them by itself.
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("added tokens that depend on their surroundings aren't supported")
        longest = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        # Which ids begin (byte) or end (word) a word: with them, many words are encoded as one text.
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("Ġ") if split == "byte" else token.endswith("</w>")
        self.cache = ChunkCache(self._chunks)

    def cut(self, text: str) -> list[str]:
        """The chunks of any text; an added token is a chunk of its own."""
        if self.added is None or not self.added.search(text):
            return cut_any(text)
        parts = enumerate(self.added.split(text))
        return [chunk for k, part in parts for chunk in (["\1" + part] if k % 2 else cut_any(part))]

    def _alone(self, strings: list[str]) -> list[bytes]:
        import numpy as np

        return [
            np.array(e.ids, self.kind).tobytes()
            for start in range(0, len(strings), 4096)
            for e in self.tokenizer.encode_batch_fast(strings[start : start + 4096], add_special_tokens=False)
        ]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single plain words, encoded in texts of many."""
        import numpy as np

        out: list[bytes] = []
        space = "" if self.split == "byte" else " "
        texts = [space.join(words[i : i + 512]) for i in range(0, len(words), 512)]
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else ():
            ids = np.array(e.ids, self.kind)
            at = np.flatnonzero(self.edge[ids])
            at = np.append(at, len(ids)) if self.split == "byte" else np.concatenate(([0], at + 1))
            data, at = ids.tobytes(), (at * self.kind.itemsize).tolist()
            out += [data[i:j] for i, j in zip(at, at[1:])]
        if len(out) != len(words):
            raise ValueError("words can't be told apart in the ids of their text")
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        if self.split == "byte":
            shown = [c[1:] if c[:1] == "\1" else " " + c.removeprefix("\0") for c in chunks]
        else:
            shown = [c[1:] if c[:1] in ("\0", "\1") else c for c in chunks]
        word = (_SPACED_WORD if self.split == "byte" else _WORD).fullmatch
        single = [c for c in shown if word(c)]
        known = dict(zip(single, self._words(single), strict=True))
        rest = [c for c in shown if c not in known]
        known |= zip(rest, self._alone(rest), strict=True)
        return [known[c] for c in shown]

    def texts(self, column) -> list[bytes]:
        """The ids of each text of an Arrow array of strings; null is empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column.cast(pa.large_string()), "")
        special = pc.or_(pc.match_substring_regex(column, _NOT_SIMPLE_RE2), pc.equal(column, "")).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(column)
        places = np.flatnonzero(~special)
        if len(places):
            plain = column.take(pa.array(places))
            if self.split == "word":
                plain = pc.utf8_lower(plain)
            for mark, marked in ((".", " \1."), (",", " \1,"), ("\n", " \1\n \1")):
                plain = pc.replace_substring(plain, mark, marked)
            first, nothing = pa.scalar("\1", pa.large_string()), pa.scalar("", pa.large_string())
            cut = pc.split_pattern(pc.binary_join_element_wise(first, plain, nothing), " ")
            found = cut.values.dictionary_encode()
            ids = self.cache.of([found.dictionary.to_pylist()])[0]
            size = self.kind.itemsize
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // size
            pool = np.frombuffer(b"".join(ids), self.kind)
            starts = np.cumsum(lengths) - lengths
            which = found.indices.to_numpy(zero_copy_only=False)
            many = lengths[which]
            ends = np.cumsum(many)
            data = pool[np.repeat(starts[which] - (ends - many), many) + np.arange(ends[-1])].tobytes()
            at = np.concatenate(([0], ends))[cut.offsets.to_numpy()] * size
            for place, i, j in zip(places.tolist(), at[:-1].tolist(), at[1:].tolist()):
                out[place] = data[i:j]
        others = np.flatnonzero(special).tolist()
        for place, values in zip(others, self.cache.of([self.cut(column[i].as_py()) for i in others]), strict=True):
            out[place] = b"".join(values)
        return out


_loaded: dict[tuple, Encoder] = {}


def encode_texts(column, model: bytes, key: str, width: int, split: str) -> Iterator[bytes]:
    """Token ids of each text of an Arrow array as little-endian unsigned integers of ``width`` bytes.

    ``split`` names the vocabulary's rule: "byte" writes the space before a word into its token,
    "word" lower-cases, drops white space and marks the end of a word.
    """
    import numpy as np

    encoder = _loaded.get((key, width))
    if encoder is None:
        encoder = _loaded[key, width] = Encoder(model, width, split)
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):  # in groups of bounded size
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + GROUP_BYTES)))
        with without_collection():
            found = encoder.texts(column.slice(start, end - start))
        yield from found
        start = end
