"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record is: length (unsigned 64 bits), masked checksum of the length (32 bits), payload, masked
checksum of the payload; everything is little-endian.  The mask is the usual rotation by 15 bits
plus a constant, over CRC-32.  A payload is: document id (signed 64 bits), flags (bit 0: the id is
null), bytes per token id (2 if all ids of the vocabulary fit, else 4), then the ids.  Beside each
file lies an index: for each record its document id and its offset.

Documents are dealt by ranges of their id, so files in order of their number hold ascending ids.
Each task writes files of its own name and returns a manifest row; only files in the written
manifest count, so a repeated task leaves no doubled records.

Defined results: null texts are empty sequences with the end id alone; null ids come first; equal
ids are ordered by text; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import hashlib
import random
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm._store import materialise, new_folder
from lexforge.llm._tokens import encode_texts

_LENGTH = struct.Struct("<Q")
_SUM = struct.Struct("<I")
_HEAD = struct.Struct("<qBB")
_ENTRY = struct.Struct("<qQ")

MANIFEST = "shard int, path string, index_path string, n_records long, n_ids long, n_bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))))


def unframe(stream) -> Iterator[bytes]:
    """The payloads of a file; a wrong checksum or a cut file raises ValueError."""
    while head := stream.read(12):
        if len(head) != 12 or _SUM.unpack(head[8:])[0] != masked(head[:8]):
            raise ValueError("bad record length")
        size = _LENGTH.unpack(head[:8])[0]
        payload, check = stream.read(size), stream.read(4)
        if len(payload) != size or len(check) != 4 or _SUM.unpack(check)[0] != masked(payload):
            raise ValueError("bad record payload")
        yield payload


def filesystem(uri: str):
    """(file system, path) for a URI of any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _write_shard(
    batches: Iterator[pa.RecordBatch], model: bytes, key: str, folder: str, end_id: int, width: int, split: str
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    name = f"part-{shard:06d}-{uuid.uuid4().hex}"
    out = index = None
    records = ids = at = 0
    end = end_id.to_bytes(width, "little")
    for batch in batches:
        for doc_id, got in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1), model, key, width, split), strict=True):
            if out is None:
                out = files.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20)
                index = files.open_output_stream(f"{root}/{name}.idx", buffer_size=1 << 16)
            data = frame(_HEAD.pack(doc_id or 0, doc_id is None, width) + got + end)
            index.write(_ENTRY.pack(doc_id or 0, at))
            out.write(data)
            at += len(data)
            ids += len(got) // width + 1
            records += 1
    if out is not None:
        out.close()
        index.close()
        row = [[shard], [f"{folder}/{name}.rec"], [f"{folder}/{name}.idx"], [records], [ids], [at]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
            ["shard", "path", "index_path", "n_records", "n_ids", "n_bytes"],
        )


def write_records(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    split: str = "byte",
) -> DataFrame:
    """Write the records of all documents in ascending order of their id; returns the manifest."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "records")
    model = open(tokenizer_path, "rb").read()
    size = max(Tokenizer.from_buffer(model).get_vocab_size(), end_id + 1)
    shared, key, width = spark.sparkContext.broadcast(model), hashlib.sha256(model).hexdigest(), 2 if size <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write_shard(batches, shared.value, key, folder, end_id, width, split)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return materialise(ordered.mapInArrow(write, MANIFEST), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "file", "record"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, inner = filesystem(path)
            rows = []
            with files.open_input_stream(inner, buffer_size=1 << 20) as stream:
                for number, payload in enumerate(unframe(stream)):
                    doc_id, null, width = _HEAD.unpack_from(payload)
                    ids = np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype("<u4")
                    rows.append((None if null else doc_id, start, len(ids), zlib.crc32(ids.tobytes()), path, number))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types, strict=True)], names)


def read_digests(manifest: DataFrame) -> DataFrame:
    """One row per record, read from the files: doc_id, start, n_tokens, ids_crc32, file, record."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    return files.repartition(max(1, manifest.count()), F.col("path")).mapInArrow(
        _reader, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, record long"
    )


def read_shuffled(path: str, index_path: str, seed: int) -> Iterator[tuple[int | None, list[int]]]:
    """(document id, token ids) of one file in an order drawn from ``seed``, by means of its index."""
    import numpy as np

    files, inner = filesystem(index_path)
    with files.open_input_stream(inner) as stream:
        entries = list(_ENTRY.iter_unpack(stream.read()))
    random.Random(seed).shuffle(entries)
    files, inner = filesystem(path)
    with files.open_input_file(inner) as file:
        for _, offset in entries:
            file.seek(offset)
            payload = next(unframe(file))
            doc_id, null, width = _HEAD.unpack_from(payload)
            yield None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).tolist()
