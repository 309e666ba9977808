"""Product codes of vectors: each part of a vector becomes the number of its nearest codebook entry.

Components x become integers floor(scale * x), so that every sum is exact and no result depends on the
order of adding.  The vectors are turned once into columnar blocks (per block and part one NumPy
array, dimensions by rows) and written.  A round is one RDD ``treeAggregate`` over the blocks: distances
to all entries of a codebook accumulate dimension by dimension, ``np.add.at`` adds the rows of every
entry to int64 tensors of sums and counts, and the tensors merge through a reduction tree.  Only these
tensors, whose size doesn't depend on the number of vectors, come to the driver; the codebooks, equally
small, go out with the tasks.

Hot labels never meet in one task: errors are added up per label before the shuffle, the sums of labels
with more than one row in ``_HOT`` are broadcast (``_HOT`` labels at most), and the others join by label.

Defined results: vectors that are null or hold null or non-finite components drop out; vectors of unequal
length or of a length that ``parts`` doesn't divide are filled up with zeros; with fewer vectors than
entries the codebooks have fewer; without vectors the result is empty.  Null identifiers come last when the
first entries are chosen, rows of one identifier are ordered by their vector; both are coded like others.
Integers whose sums could pass 64 bits (components from some 2**20 on) are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm._store import materialise

#: Rows of a block, and depth of the reduction tree.
_BLOCK_ROWS, _DEPTH = 4096, 3
#: A label with more than one row in so many is hot.
_HOT = 1024
#: Largest magnitude of an integer component.
_MOST = 1 << 32


def _whole(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label and the integer components of the vectors that take part."""
    vector = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", bad))
    # beyond _MOST the value only has to be seen to be too large
    clipped = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(_MOST * 4.0)), F.lit(_MOST * -4.0))).cast("long")
    return rows.select("id", "label", F.transform("v", clipped).alias("q"))


def _nearest(block: list[np.ndarray], books: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For every part the nearest entry of each row, and the squared distances added over the parts."""
    n = block[0].shape[1]
    error, codes = np.zeros(n, np.int64), []
    for part, book in zip(block, books):
        distance = np.zeros((len(book), n), np.int64)
        for d in range(part.shape[0]):  # dimension by dimension
            step = part[d][None, :] - book[:, d][:, None]
            step *= step
            distance += step
        code = distance.argmin(axis=0)  # the first of equals
        codes.append(code)
        error += distance[code, np.arange(n)]
    return codes, error


def _block(row, parts: int) -> list[np.ndarray]:
    """The columnar arrays of a written block."""
    data = np.frombuffer(row["data"], np.int32).astype(np.int64)
    return list(data.reshape(parts, -1, row["rows"]))


def _add(sums: tuple[np.ndarray, np.ndarray], block: list[np.ndarray], books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, _ = _nearest(block, books)
    total, count = sums
    for k, (part, code) in enumerate(zip(block, codes)):
        np.add.at(total[k], code, part.T)
        np.add.at(count[k], code, 1)
    return sums


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    np.add(a[0], b[0], out=a[0])
    np.add(a[1], b[1], out=a[1])
    return a


def code_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, codes, error of every vector that takes part; the final codebook of each part).

    ``codes`` has one byte a part, ``error`` is the squared distance to the coded vector.  The codebooks start as
    the vectors of the smallest identifiers; an entry that no part chooses stays as it is.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("parts and rounds can't be negative, and entries are 1..256")
    whole = _whole(df, id_col, vector_col, label_col, scale)
    label_type = whole.schema["label"].dataType
    out_schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label_type), T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])
    largest = F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))
    seen = whole.agg(F.max(F.size("q")).alias("length"), F.max(largest).alias("largest"), F.count(F.lit(1)).alias("n")).first()
    if not seen["n"]:
        return df.sparkSession.createDataFrame([], out_schema), [np.zeros((0, 0), np.int64)] * parts
    # every part is at least one component wide
    width = max(1, -(-seen["length"] // parts))
    length, most = width * parts, seen["largest"] or 0
    if length * (2 * most) ** 2 >= 1 << 63 or most * seen["n"] >= 1 << 63:
        raise ValueError("components are too large for exact 64-bit sums")
    first = whole.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    start = np.zeros((len(first), length), np.int64)
    for at, row in enumerate(first):
        start[at, : len(row["q"])] = row["q"]
    books = [start[:, k * width : (k + 1) * width].copy() for k in range(parts)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                piece = batch.slice(at, _BLOCK_ROWS)
                lists, n = piece.column(2), piece.num_rows
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                rows = np.zeros((n, length), np.int32)
                rows[np.arange(length)[None, :] < sizes[:, None]] = flat
                data = np.ascontiguousarray(rows.T).tobytes()  # parts, dimensions, rows
                block = [pa.array([n], pa.int32()), pa.array([data], pa.binary())]
                keys = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), piece.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *block], ["ids", "labels", "rows", "data"])

    block_schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label_type)), T.StructField("rows", T.IntegerType()), T.StructField("data", T.BinaryType())])
    # uncompressed, so that a part of the scan, which one Arrow batch may hold, is as large as it looks
    blocks = materialise(whole.mapInArrow(pack, block_schema), "code-blocks", {"compression": "uncompressed"})
    columns = blocks.select("rows", "data").rdd.map(lambda row: _block(row, parts))
    for _ in range(rounds):
        zero = (np.zeros((parts, len(first), width), np.int64), np.zeros((parts, len(first)), np.int64))
        now = books
        total, count = columns.treeAggregate(zero, lambda sums, block, now=now: _add(sums, block, now), _merge, _DEPTH)
        used = count > 0
        mean = total // np.maximum(count, 1)[:, :, None]  # numpy's // floors
        books = [np.where(used[k][:, None], mean[k], books[k]) for k in range(parts)]
    final = books

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                n = row.column(2)[0].as_py()
                block = _block({"rows": n, "data": row.column(3)[0].as_buffer()}, parts)
                codes, error = _nearest(block, final)
                code = np.stack(codes, axis=1).astype(np.uint8)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * parts), pa.py_buffer(code.tobytes())])
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), row.column(1).flatten(), packed, pa.array(error)], ["id", "label", "codes", "error"])

    return blocks.mapInArrow(assign, out_schema), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` and ``label_error``, the error summed over all rows of the same label (nulls are one label)."""
    coded = materialise(coded, "codes")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__rows"))
    sums, n = materialise(sums, "code-labels"), coded.count()
    hot = sums.where(F.col("__rows") * _HOT > n).drop("__rows")  # fewer than _HOT labels
    rest = sums.where(F.col("__rows") * _HOT <= n).drop("__rows")
    same = F.col("label").eqNullSafe(F.col("__label"))
    marked = coded.join(F.broadcast(hot), same, "left").drop("__label")
    other = marked.where("label_error IS NULL").drop("label_error").join(rest, same).drop("__label")
    return marked.where("label_error IS NOT NULL").unionByName(other)


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal integers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
