"""Vectors from a pluggable embedder, and their cache on disk."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.sources import manifested

BATCH, MAX_DIMENSIONS = 32, 8192


def content_key(path: str = "path", text: str = "text"):
    return F.sha2(F.concat(F.col(path), F.lit("\0"), F.col(text)), 256)


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """key, embedding of each chunk; the embedder sees 32 texts at a time and must answer each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                part = batch.iloc[i : i + BATCH]
                vectors = embedder(part["text"].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(vectors)} vectors")
                if any(not v or len(v) > MAX_DIMENSIONS for v in vectors):
                    raise ValueError("a vector is empty or too long")
                yield pd.DataFrame({"key": part["key"].tolist(), "embedding": [[float(x) for x in v] for v in vectors]})

    return chunks.select("key", "text").mapInPandas(run, "key string, embedding array<double>")


def http_embedder(url: str, model: str, timeout: float = 120.0, most_bytes: int = 8 << 20) -> Callable[[list[str]], list[list[float]]]:
    """An embedder that posts ``{"model", "input", "truncate": false}`` as JSON and reads ``{"embeddings"}``.

    It is called where the chunks are, by the tasks; no proxy is used, and a reply that is too long,
    no JSON or without a vector for each text is an error.
    """

    def ask(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts, "truncate": False}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(request, timeout=timeout) as reply:
            data = reply.read(most_bytes + 1)
        if len(data) > most_bytes:
            raise ValueError("the reply is too long")
        vectors = json.loads(data).get("embeddings")
        if not isinstance(vectors, list) or len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts, {len(vectors) if isinstance(vectors, list) else 'no'} vectors")
        return vectors

    return ask


class VectorCache:
    """Vectors by content key and identity of the embedder: one manifested table for each identity.

    A torn, failed or second write leaves what was there before (:mod:`lexforge.sources.manifested`).
    """

    _SCHEMA = "key string, embedding array<double>"

    def __init__(self, spark: SparkSession, folder: str, identity: str):
        self.spark, self.identity = spark, identity
        self.folder = f"{folder.rstrip('/')}/{hashlib.sha256(identity.encode()).hexdigest()[:16]}"

    def load(self) -> DataFrame:
        return manifested.read(self.spark, self.folder, empty=self._SCHEMA)

    def save(self, vectors: DataFrame) -> None:
        """Replace this identity's vectors."""
        sizes = vectors.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).head()
        if sizes["a"] != sizes["b"]:
            raise ValueError("vectors of unequal length")
        manifested.write(vectors.select("key", "embedding"), self.folder, "overwrite")


def refreshed(chunks: DataFrame, cache: VectorCache, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors of the current chunks: kept ones by exact content, the others made; stale ones fall away."""
    kept = cache.load()
    current = chunks.select("key", "text").dropDuplicates(["key"])
    made = embed(current.join(kept, "key", "left_anti"), embedder)
    cache.save(current.join(kept, "key").select("key", "embedding").unionByName(made))
    return cache.load()
