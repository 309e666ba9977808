"""Vector best-fit packing of token sequences.

A piece asks for (tokens, one document, squared length as attention cost); a bin offers a capacity
of each.  Pieces come longest first, and each goes to the open bin that, under every constraint,
leaves the smallest weighted norm of residuals (``rule="norm"``) or has the largest weighted
dot-product with it (``rule="dot"``); if none has room, a bin is opened.

By default a bin takes as many documents as it would take pieces of four ids, which binds only where
such pieces fill whole bins, and the squared length of one full piece, which every piece has to fit:
as squares add up to less than the square of their sum, that one never binds alone.  Both residuals
weigh a quarter of the tokens' one in the choice of a bin, so that among bins left about equally
full, documents and attention are spread.

Pieces are dealt by a hash into shards of about ``shard_pieces`` pieces, packed independently, so
memory is bounded and equal lengths never meet in one task.  A shard leaves about one bin partly
filled, a share of less than 1 in 1000 of the bins at the default.

Defined results: a null text is an empty one, a piece that has the end id alone; documents longer
than a bin are cut into full pieces and a rest; repeated identifiers are packed each; an empty
table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm._store import materialise
from lexforge.llm._tokens import encode_texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def _cut(batches: Iterator[pa.RecordBatch], model: bytes, key: str, end: bytes, capacity: int, split: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1), model, key, 4, split), strict=True):
            ids += end
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
        if rows:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*rows), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", split: str = "word"
) -> DataFrame:
    """The pieces of at most ``capacity`` ids of every document."""
    raw = open(tokenizer_path, "rb").read()
    model, key = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, model.value, key, end, capacity, split)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(pieces, PIECES)


#: Weights of the residual tokens, documents and attention cost.
WEIGHTS = (1.0, 0.25, 0.25)


def best_fit(lengths: np.ndarray, capacity: int, max_documents: int, max_attention: float, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; bins are numbered from 0 as they are opened."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is 'norm' or 'dot'")
    room = np.array([capacity, max_documents, max_attention], float)
    scale = np.array(weights, float) / room**2
    order = np.argsort(-lengths, kind="stable")
    least = np.minimum.accumulate(lengths[order][::-1])[::-1]  # the shortest that is still to come
    left = np.empty((1024, 3))
    names = np.empty(1024, np.int64)
    used = opened = 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for step, item in enumerate(order):
        need = np.array([lengths[item], 1.0, float(lengths[item]) ** 2])
        if step % 256 == 0 and used:  # bins that take nothing more are closed
            live = (left[:used, 0] >= least[step]) & (left[:used, 1] >= 1) & (left[:used, 2] >= float(least[step]) ** 2)
            n = int(live.sum())
            left[:n], names[:n] = left[:used][live], names[:used][live]
            used = n
        rest = left[:used] - need
        score = (rest * rest) @ scale if rule == "norm" else -(left[:used] @ (scale * need))
        score[(rest < 0).any(axis=1)] = np.inf
        at = int(score.argmin()) if used else -1
        if at < 0 or score[at] == np.inf:
            if (need > room).any():
                raise ValueError(f"a piece of {lengths[item]} ids fits no bin")
            if used == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            at, used = used, used + 1
            left[at], names[at] = room, opened
            opened += 1
        bins[item], offsets[item] = names[at], capacity - left[at, 0]
        left[at] -= need
    return bins, offsets


def pack(
    pieces: DataFrame,
    capacity: int,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    shard_pieces: int = 16384,
) -> DataFrame:
    """``pieces`` (columns of :data:`PIECES`) with sequence_id and offset.

    Without a number, ``max_documents`` is a quarter of ``capacity`` and ``max_attention`` its square.
    """
    most_documents, most_attention = max_documents or max(1, capacity // 4), max_attention or float(capacity) ** 2
    shards = max(1, math.ceil(pieces.count() / shard_pieces))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="first")
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, most_documents, most_attention, weights, rule)
        return rows.drop(columns="shard").assign(sequence_id=int(key[0]) * (1 << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(one, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, **options) -> DataFrame:
    """Encode, cut and pack ``docs``."""
    return pack(materialise(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity, **options)
