"""Byte ranges that repeat in a corpus: every byte of a string of ``length`` bytes that starts
anywhere else too, in the same text or another.

External induced suffix sorting, the usual way, has to carry each suffix of the corpus through
disk-backed queues several times; README.md gives the figures by which that can't meet the limits
here.  What is kept of it is its principle: sort a sample of positions that the text itself
determines, and induce the rest.

For a start p, the window of ``length`` bytes holds a first and a last run of ``window`` positions;
the position with the smallest hash of its next ``gram`` bytes in each (the leftmost of several)
depends on nothing outside the string at p, so equal strings share both.  Starts with the same two
positions form a piece.  A piece has a core (from the first position through the last one's gram),
which every string starting in it contains, and a hull, the union of these strings.

1. Cores that occur once rule out all starts of their pieces: most of a corpus ends here.
2. A hull that occurs more than once proves all starts of its pieces.
3. What is left, at the borders of matches, is decided start by start, by the strings themselves
   (as 64-bit hashes within the group of their core).

All three are equi-joins and counts over hashes; groups of any size are counted before a shuffle.
A bitmap filter of checked size keeps what can't match from moving.

Ranges at a length are found inside the ranges at a smaller one, so both come at little more than
the cost of the smaller.

Defined results: null texts are empty and have no ranges; texts shorter than ``length`` have none
and match nothing; rows that repeat an identifier and a text are two places of the same string; null
identifiers are documents like any other; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm._bytes import Rolling, byte_table, groups, mix
from lexforge.llm._hits import hit_filter, split
from lexforge.llm._store import discard, materialise

_GRAM_TABLE, _STRING_TABLE = byte_table(2, fold=False), byte_table(3, fold=False)
_GROUP = 1 << 19
#: Longer texts are cut into overlapping segments; pieces that this cuts are decided in step 3.
_SEGMENT = 1 << 20
#: Cores with more distinct hulls than this are decided start by start rather than hull by hull.
MOST_HULLS = 32768

PIECES = "core long, hull long, doc long, at int, n int"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())


def _sampling(length: int) -> tuple[int, int]:
    """(gram, window) for strings of ``length`` bytes."""
    if length < 16:
        raise ValueError("length is at least 16")
    gram = max(8, min(32, length // 8))
    return gram, max(4, (length - gram) * 3 // 4)


def _smallest(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each ``window`` neighbouring keys."""
    n = len(keys) - window + 1
    size = -(-len(keys) // window) * window
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])


def cut_pieces(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(core, hull, text number, first start, number of starts) of the pieces of some texts."""
    gram, window = _sampling(length)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams, strings = Rolling(data, _GRAM_TABLE), Rolling(data, _STRING_TABLE)
    place = np.arange(len(data) - gram + 1, dtype=np.int64)
    # the hash above, the position below: ties go to the leftmost
    keys = (mix(grams.at(place, place + gram)) & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    chosen = (_smallest(keys, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    gap = length - window - gram + 1
    first, last = chosen[: len(data) - length + 1], chosen[gap : gap + len(data) - length + 1]
    limits = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    number = np.repeat(np.arange(len(texts)), np.diff(limits))[: len(first)]
    start = np.arange(len(first))
    inside = start + length <= limits[number + 1]
    turn = np.ones(len(first), bool)
    turn[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (number[1:] != number[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(turn)
    n = np.diff(np.append(at, len(first)))
    at, n = at[inside[at]], n[inside[at]]
    core = mix(grams.at(first[at], last[at] + gram) + (last[at] - first[at]).astype(np.uint64))
    hull = mix(strings.at(at, at + n - 1 + length) + n.astype(np.uint64))
    return core.view(np.int64), hull.view(np.int64), number[at], at - limits[number[at]], n


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text or b""
            for off in range(0, len(data) - length + 1, _SEGMENT):
                parts.append((doc, off, data[off : off + _SEGMENT + length - 1]))
        for i, j in groups([len(p[2]) for p in parts], _GROUP):
            core, hull, number, at, n = cut_pieces([p[2] for p in parts[i:j]], length)
            docs = np.array([p[0] for p in parts[i:j]], np.int64)[number]
            offs = np.array([p[1] for p in parts[i:j]], np.int64)[number]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip((core, hull, docs, (at + offs).astype(np.int32), n.astype(np.int32)), _TYPES)],
                ["core", "hull", "doc", "at", "n"],
            )


def _hulls(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The text of each asked piece's hull: core, doc, at, n, weight, hull."""
    for batch in batches:
        rows, size = [], 0
        for doc, text, asked in zip(*(batch.column(k).to_pylist() for k in range(3))):
            data = text or b""
            for piece in asked:
                at, n = piece["at"], piece["n"]
                rows.append((piece["core"], doc, at, n, piece["weight"], data[at : at + n - 1 + length]))
                size += n + length
            if size > 1 << 22:
                yield _batch(rows, HULLS)
                rows, size = [], 0
        if rows:
            yield _batch(rows, HULLS)


HULLS = "core long, doc long, at int, n int, weight int, hull binary"
STARTS = "core long, string long, doc long, start int, weight int"
RANGES = "doc long, start int, end int"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[t]) for v, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _strings(hulls: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings that start in the hulls, one hull after the other."""
    out = [np.zeros(0, np.int64)]
    for i, j in groups([len(h) for h in hulls], _GROUP):
        n = counts[i:j]
        data = np.frombuffer(b"".join(hulls[i:j]), np.uint8)
        first = np.cumsum(n + length - 1) - (n + length - 1)
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first, n) + own
        out.append(mix(Rolling(data, _STRING_TABLE).at(at, at + length)).view(np.int64))
    return np.concatenate(out)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))


def _starts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row per start: columns of :data:`STARTS`."""
    for batch in batches:
        core, doc, at, n, weight = _columns(batch)
        hulls = batch.column(5).to_pylist()
        for i, j in groups([len(h) for h in hulls], _GROUP):
            m = n[i:j]
            own = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            out = (np.repeat(core[i:j], m), _strings(hulls[i:j], m, length), np.repeat(doc[i:j], m), np.repeat(at[i:j], m) + own, np.repeat(weight[i:j], m))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["core", "string", "doc", "start", "weight"])


def _decide(rows: list[tuple], length: int) -> pa.RecordBatch | None:
    """Ranges of the starts, in pieces of weight 1, whose string stands elsewhere in its core's group."""
    core, doc, at, n, weight = (np.array(v, np.int64) for v in list(zip(*rows))[:5])
    strings = _strings([r[5] for r in rows], n, length)
    # the core into the hash: a group of equal strings is one core's
    keys = mix(strings.view(np.uint64) + mix(np.repeat(core, n).view(np.uint64)))
    _, place = np.unique(keys, return_inverse=True)
    times = np.bincount(place, np.repeat(weight, n))
    again = (times[place] > 1) & (np.repeat(weight, n) == 1)
    piece = np.repeat(np.arange(len(n)), n)
    edge = np.concatenate(([True], piece[1:] != piece[:-1]))
    opens = np.flatnonzero(again & (edge | ~np.concatenate(([False], again[:-1]))))
    closes = np.flatnonzero(again & (np.concatenate((edge[1:], [True])) | ~np.concatenate((again[1:], [False]))))
    if not len(opens):
        return None
    own = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    start, end = at[piece[opens]] + own[opens], at[piece[closes]] + own[closes] + length
    return pa.RecordBatch.from_arrays([pa.array(doc[piece[opens]]), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc", "start", "end"])


def _decided(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Decides whole groups of rows that come ordered by core, a bounded number of hulls at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if len(held) >= 2048 and row[0] != held[-1][0]:
                if (found := _decide(held, length)) is not None:
                    yield found
                held = []
            held.append(row)
    if held and (found := _decide(held, length)) is not None:
        yield found


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc, text, ...): a key for each row and its text's bytes.

    Where the identifiers are unique, they are the keys.  Rows that repeat one, or have none, are
    told apart by a 64-bit hash of identifier and text; equal rows share their key.
    """
    own_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    unclear = docs.groupBy(own_id.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL")
    key = own_id if unclear.isEmpty() else F.xxhash64(own_id, text)
    return docs.select(key.alias("doc"), text.cast("binary").alias("text"), *more)


def _found(texts: DataFrame, length: int) -> DataFrame:
    """(doc, ranges) of texts given as (doc, text): written, one row for each text with repeats."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, length)

    def hull_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _hulls(batches, length)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _starts(batches, length)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decided(batches, length)

    pieces = materialise(texts.where(F.octet_length("text") >= length).mapInArrow(cut, PIECES), "pieces")
    cores = materialise(pieces.groupBy("core").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("core"), "cores")
    likely, _ = split(pieces, "core", hit_filter(cores, "core"))
    shared = materialise(likely.join(cores, "core"), "shared-pieces")
    discard(pieces, cores)
    hulls = materialise(
        shared.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "at", "n")).alias("one")), "hulls"
    )
    # What the filters of hulls that occur once don't know occurs more often: hot hulls need no join.
    # Of two independent filters, one in some 300 hulls that occur more often passes both by chance.
    pair, columns = F.xxhash64("core", "hull").alias("pair"), shared.columns
    once = hulls.where("times = 1").select("hull", pair)
    maybe, sure = split(shared, "hull", hit_filter(once, "hull"))
    unsure, more = split(maybe.select("*", pair), "pair", hit_filter(once, "pair"))
    checked = unsure.join(hulls.where("times > 1").select("core", "hull"), ["core", "hull"])
    known = sure.unionByName(more.select(*columns)).unionByName(checked.select(*columns))
    proven = known.select("doc", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + length).alias("end"))
    # Cores with several hulls, one of which occurs once: their starts are compared one by one.
    mixed = materialise(
        hulls.groupBy("core").agg(F.count(F.lit(1)).alias("hulls"), F.min("times").alias("least")).where("hulls > 1 AND least = 1"), "mixed-cores"
    )
    asked = hulls.join(mixed, "core").select("core", F.least("times", F.lit(2)).cast("int").alias("weight"), "one.*")
    per_doc = materialise(asked.groupBy("doc").agg(F.collect_list(F.struct("core", "at", "n", "weight")).alias("asked")), "asked-pieces")
    near, _ = split(texts, "doc", hit_filter(per_doc, "doc"))
    # the same row may stand twice in the table: then its hulls occur twice, and deciding twice is harmless
    tested = near.join(per_doc, "doc").select("doc", "text", "asked").mapInArrow(hull_texts, HULLS)
    crowded = mixed.where(F.col("hulls") > MOST_HULLS).select("core")
    if crowded.isEmpty():
        crowds = None
    else:  # a core with very many hulls is dealt out start by start
        crowded, tested = materialise(crowded, "crowded-cores"), materialise(tested, "hulls")
        crowds, tested = tested.join(crowded, "core", "left_semi"), tested.join(crowded, "core", "left_anti")
    decided = tested.repartition(F.col("core")).sortWithinPartitions("core").mapInArrow(decide, RANGES)
    if crowds is not None:
        single = materialise(crowds.mapInArrow(starts, STARTS).distinct(), "starts")
        again = single.groupBy("core", "string").agg(F.sum("weight").alias("times")).where("times > 1").select("core", "string")
        decided = decided.unionByName(
            single.where("weight = 1")
            .join(materialise(again, "repeated-strings"), ["core", "string"])
            .select("doc", "start", (F.col("start") + length).cast("int").alias("end"))
        )
    found = proven.unionByName(decided).groupBy("doc")
    ranges = materialise(found.agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    discard(shared, hulls, mixed, per_doc)
    return ranges


def repeated_ranges(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ranges): for each text with repeats, its key and [start, end) byte ranges, which may overlap."""
    return _found(_texts(docs, id_col, text_col), length)


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The maximal ranges of at least ``length`` bytes: doc, off, text."""
    for batch in batches:
        rows, size = [], 0
        for doc, data, spans in zip(batch.column(0).to_pylist(), batch.column(1), merged(batch.column(2)), strict=True):
            data = data.as_py()
            for start, end in spans:
                if end - start >= length:
                    rows.append((doc, start, data[start:end]))
                    size += end - start
            if size > 1 << 22:
                yield _batch(rows, SEGMENTS)
                rows, size = [], 0
        if rows:
            yield _batch(rows, SEGMENTS)


SEGMENTS = "doc long, off int, text binary"


def _found_within(texts: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """(doc, ranges) at a greater length than that of ``ranges``.

    A string that repeats consists of shorter strings that repeat too, so it lies inside one of their
    maximal ranges: these are all the texts that are left to look at.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segments(batches, length)

    near, _ = split(texts.select("doc", "text"), "doc", hit_filter(ranges, "doc"))
    # equal rows share a key and their ranges: each of them is a place of its own
    cuts = near.join(ranges, "doc").select("doc", "text", "ranges").mapInArrow(cut, SEGMENTS)
    segments = materialise(cuts.withColumn("segment", F.monotonically_increasing_id()), "segments")
    found = _found(segments.select(F.col("segment").alias("doc"), "text"), length)
    moved = F.transform("ranges", lambda r: F.struct((r["start"] + F.col("off")).alias("start"), (r["end"] + F.col("off")).alias("end")))
    placed = segments.select("doc", "off", "segment").join(found.select(F.col("doc").alias("segment"), "ranges"), "segment").select("doc", moved.alias("ranges"))
    out = materialise(placed.groupBy("doc").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")
    discard(segments, found)
    return out


def merged(ranges: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Disjoint, maximal ranges in order, for each row of a list column of (start, end)."""
    many = pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False)
    values = ranges.flatten()
    if not len(values):
        return [[] for _ in many]
    # rows lie apart on one line, so one pass merges them all
    row = np.repeat(np.arange(len(many), dtype=np.int64) << 32, many)
    start, end = (row + pc.struct_field(values, k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    start, end = start[new], reach[np.append(new[1:] - 1, len(reach) - 1)]
    at = np.searchsorted(start >> 32, np.arange(len(many) + 1)).tolist()
    pairs = list(zip((start & 0xFFFFFFFF).tolist(), (end & 0xFFFFFFFF).tolist()))
    return [pairs[i:j] for i, j in zip(at, at[1:])]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]])


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, data, spans, places in zip(batch.column(0).to_pylist(), batch.column(1), merged(batch.column(2)), merged(batch.column(3)), strict=True):
            data = data.as_py()
            kept = hashlib.sha256(without(data, spans)).hexdigest()
            rows.append((doc_id, len(data), sum(e - s for s, e in spans), len(spans), kept, len(places), sum(e - s for s, e in places)))
        if rows:
            yield _batch(rows, DIGESTS)


def removal_digests(docs: DataFrame, length: int = 400, passage: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: columns of :data:`DIGESTS`.

    n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes) are those of strings of
    ``length`` bytes.  n_passages and passage_bytes count the maximal ranges, and their bytes, that
    strings of ``passage`` bytes cover (at most ``length``, which is the default).
    """
    passage = length if passage is None else passage
    if not 0 < passage <= length:
        raise ValueError("a passage has at most the length of what is removed")
    texts = _texts(docs, id_col, text_col, F.col(id_col).cast("long").alias("doc_id"))
    passages = _found(texts.select("doc", "text"), passage)
    ranges = passages if passage == length else _found_within(texts, passages, length)
    likely, clean = split(texts, "doc", hit_filter(passages, "doc"))
    both = likely.join(passages.withColumnRenamed("ranges", "passages"), "doc", "left").join(ranges, "doc", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    asked = both.select("doc_id", "text", F.coalesce("ranges", none), F.coalesce("passages", none))
    zero = F.lit(0).cast("long")
    return asked.mapInArrow(_digests, DIGESTS).unionByName(
        clean.select(
            "doc_id",
            F.octet_length("text").cast("long").alias("n_bytes"),
            zero.alias("n_removed"),
            zero.alias("n_spans"),
            F.sha2("text", 256).alias("kept_sha256"),
            zero.alias("n_passages"),
            zero.alias("passage_bytes"),
        )
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # a range may begin or end inside a character, of which nothing stays then
        kept = [without(data.as_py(), spans).decode("utf-8", "ignore") for data, spans in zip(batch.column(1), merged(batch.column(2)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["row", "kept"])


def drop_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; repeated ranges are cut out of the texts (null stays null)."""
    # the row travels as one column, so that its names clash with none of those used here
    texts = _texts(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    ranges = _found(texts.select("doc", "text"), length)
    likely, clean = split(texts, "doc", hit_filter(ranges, "doc"))
    asked = likely.join(ranges, "doc", "left").select("row", "text", F.coalesce("ranges", F.array().cast("array<struct<start:int,end:int>>")))
    schema = T.StructType([texts.schema["row"], T.StructField("kept", T.StringType())])
    done = asked.mapInArrow(_kept, schema)
    own = [F.col("row").getField(c) for c in docs.columns]
    cut = [F.when(v.isNotNull(), F.col("kept")).otherwise(v).alias(c) if c == text_col else v.alias(c) for c, v in zip(docs.columns, own)]
    return done.select(*cut).unionByName(clean.select(*(v.alias(c) for c, v in zip(docs.columns, own))))
