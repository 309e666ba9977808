"""A sink whose tables are whole at any moment: ``df.write.format("manifested").mode(...).save(folder)``.

Every task writes one file under a name of its own and tells it in its commit message; the driver then writes one manifest
that names all files of the table, under the next generation's number, which only one writer can take.  Readers follow the
latest manifest, so files of failed, aborted or running writes are never read, and what was there before stays
readable until it is replaced.  Of two writers that began at the same generation the second one fails if it meant to
replace the table, and goes on from the first one's state if it appends.

Layout ``parquet`` holds any columns; ``text`` holds one string column ``value``, a line a row.  Files and manifests are readable
by their owner alone.  The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType, _parse_datatype_string

_MANIFESTS, _DATA = "_manifests", "data"


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


@dataclass
class _File(InputPartition):
    path: str


def _folder(options: dict) -> str:
    return options["path"].removeprefix("file://").rstrip("/")


def generations(folder: str) -> list[int]:
    try:
        return sorted(int(n.removesuffix(".json")) for n in os.listdir(f"{folder}/{_MANIFESTS}") if n.endswith(".json"))
    except FileNotFoundError:
        return []


def manifest(folder: str, generation: int | None = None) -> dict | None:
    """The manifest of a generation, by default the latest; null for a folder without any."""
    known = generations(folder)
    if not known:
        return None
    with open(f"{folder}/{_MANIFESTS}/{known[-1] if generation is None else generation:012}.json", encoding="utf-8") as f:
        return json.load(f)


def vacuum(folder: str, keep_generations: int = 1, older_than_s: float = 86_400.0) -> list[str]:
    """Delete manifests but the latest ones, and files that none of those names and no running write can have made: their names.

    Tasks that die with their worker leave files behind; ``older_than_s`` must be longer than any write takes.
    """
    folder = folder.removeprefix("file://").rstrip("/")
    known = generations(folder)
    for g in known[: len(known) - keep_generations]:
        os.unlink(f"{folder}/{_MANIFESTS}/{g:012}.json")
    named = {f["file"] for g in known[-keep_generations:] for f in manifest(folder, g)["files"]}
    gone = []
    for e in os.scandir(f"{folder}/{_DATA}"):
        if f"{_DATA}/{e.name}" not in named and e.stat().st_mtime <= time.time() - older_than_s:
            os.unlink(e.path)
            gone.append(e.name)
    return gone


def _take(folder: str, generation: int, content: dict) -> bool:
    """Write a generation's manifest, unless another writer has taken the number."""
    os.makedirs(f"{folder}/{_MANIFESTS}", exist_ok=True)
    draft = f"{folder}/{_MANIFESTS}/.{uuid.uuid4().hex}"
    with os.fdopen(os.open(draft, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
        json.dump(content, f)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(draft, f"{folder}/{_MANIFESTS}/{generation:012}.json")  # fails where the name is taken
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)
    return True


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.folder, self.layout, self.overwrite = _folder(options), options.get("layout", "parquet"), overwrite
        self.schema = schema.json()
        if self.layout not in ("parquet", "text"):
            raise ValueError("layout is 'parquet' or 'text'")
        if self.layout == "text" and [(f.name, f.dataType.simpleString()) for f in schema.fields] != [("value", "string")]:
            raise ValueError("text takes one string column, value")
        known = generations(self.folder)
        self.began_at = known[-1] if known else 0

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        os.makedirs(f"{self.folder}/{_DATA}", exist_ok=True)
        name = f"{_DATA}/{uuid.uuid4().hex}.{'jsonl' if self.layout == 'text' else 'parquet'}"
        rows, sink = 0, None
        with os.fdopen(os.open(f"{self.folder}/{name}", os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as out:
            for batch in iterator:
                rows += batch.num_rows
                if self.layout == "text":
                    out.writelines((line or "").encode() + b"\n" for line in batch.column(0).to_pylist())
                    continue
                if sink is None:
                    sink = pq.ParquetWriter(out, batch.schema)
                sink.write_batch(batch)
            if sink is not None:
                sink.close()
            out.flush()
            os.fsync(out.fileno())
        if rows:
            return _Written(name, rows)
        os.unlink(f"{self.folder}/{name}")
        return _Written(None, 0)

    def commit(self, messages: list[_Written | None]) -> None:
        new = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.file]
        at = self.began_at
        while True:
            before = manifest(self.folder, at) if at else None
            if before and not self.overwrite and (before["layout"], before["schema"]) != (self.layout, self.schema):
                self.abort(messages)
                raise ValueError("the table has other columns or another layout")
            files = new if self.overwrite or not before else before["files"] + new
            if _take(self.folder, at + 1, {"layout": self.layout, "schema": self.schema, "files": files}):
                return
            if self.overwrite:
                self.abort(messages)
                raise RuntimeError(f"another writer replaced generation {at} of {self.folder}")
            at += 1

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None and m.file and os.path.exists(f"{self.folder}/{m.file}"):
                os.unlink(f"{self.folder}/{m.file}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder = _folder(options)
        self.generation = int(options["generation"]) if "generation" in options else None
        self.names = schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        found = manifest(self.folder, self.generation)
        self_files = found["files"] if found else []
        return [_File(f"{self.folder}/{f['file']}") for f in self_files] or [_File("")]

    def read(self, partition: _File):
        if partition.path.endswith(".jsonl"):
            with open(partition.path, encoding="utf-8", newline="\n") as lines:
                yield from ((line.removesuffix("\n"),) for line in lines)
        elif partition.path:
            for batch in pq.ParquetFile(partition.path).iter_batches(columns=self.names):
                yield batch


class ManifestedDataSource(DataSource):
    """``format("manifested")``; options layout (writing) and generation (reading)."""

    @classmethod
    def name(cls) -> str:
        return "manifested"

    def schema(self) -> StructType:
        found = manifest(_folder(self.options))
        if found is None:
            raise FileNotFoundError(f"no table in {_folder(self.options)}")
        return StructType.fromJson(json.loads(found["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema, overwrite)


def write(df: DataFrame, folder: str, mode: str = "append", **options: str) -> None:
    _register(df.sparkSession)
    df.write.format("manifested").mode(mode).options(**options).save(folder)


def read(spark: SparkSession, folder: str, empty: str | None = None) -> DataFrame:
    """The table in a folder; with ``empty`` (a schema), a table without rows where there is none yet."""
    _register(spark)
    if empty is not None and manifest(folder.removeprefix("file://").rstrip("/")) is None:
        return spark.createDataFrame([], _parse_datatype_string(empty))
    return spark.read.format("manifested").load(folder)


def _register(spark: SparkSession) -> None:
    from lexforge.shipping import ship

    ship(spark)
    spark.dataSource.register(ManifestedDataSource)
