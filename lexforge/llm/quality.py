"""Quality scores from random-indexing word vectors and a two-layer network.

A token (a run of letters and digits, or of other marks, letters A-Z folded) has an index vector of
random signs drawn from its hash, and falls into one of ``BUCKETS`` buckets.  Random indexing adds
up, over the whole corpus, the index vectors of each bucket's neighbours: its word vector.  A
document pools its tokens' word vectors, their index vectors, and the products of neighbouring
index vectors; a two-layer network, fitted with numpy on a bounded sample of labelled rows
(``per_label`` of each label, and a bounded number of bytes), turns that into a logit, and a temperature chosen on rows kept back
calibrates the probability.

Defined results: null and empty texts pool to zeros; without rows of both labels every score is the
share of label 1 (1 with no labels at all, so that nothing is rejected unheard); repeated
identifiers are scored each.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm._bytes import Rolling, byte_table, groups, mix, runs
from lexforge.llm._labels import sample_labelled, sigmoid

BUCKETS, DIM = 4096, 32
FEATURES = 3 * DIM + 2
_GROUP = 1 << 19
#: 0 white space, 1 letters and digits (and all bytes of other scripts), 2 other marks.
_CLASS = np.array(
    [0 if b in b" \t\n\r\v\f" else 1 if chr(b).isalnum() and b < 128 or b >= 128 else 2 for b in range(256)], np.int8
)
_TABLE = byte_table(9, fold=True)


class Tokens:
    """Tokens of some texts: bucket, index vector and document of each."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = _CLASS[data]
        turn = np.flatnonzero(np.diff(kind, prepend=np.int8(-1)))
        ends = np.append(turn[1:], len(data))
        real = kind[turn] > 0
        start, end = turn[real], ends[real]
        h = mix(Rolling(data, _TABLE).at(start, end) + (end - start).astype(np.uint64))
        limits = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.searchsorted(start, np.concatenate(([0], limits)))  # of each document's tokens
        self.bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
        signs = np.unpackbits((h >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        self.index = signs.astype(np.float32) * 2 - 1
        self.inner = np.ones(len(h), bool)  # whether the next token is of the same document
        self.inner[self.first[1:][self.first[1:] > 0] - 1] = False


def _cooccurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BUCKETS, DIM))
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
        texts = [p for t in texts for p in _parts(t)]
        for i, j in groups([len(t) for t in texts], _GROUP):
            t = Tokens(texts[i:j])
            left = np.flatnonzero(t.inner)
            seen += np.bincount(t.bucket, minlength=BUCKETS)
            for d in range(DIM):
                column = t.index[:, d]
                total[:, d] += np.bincount(t.bucket[left], column[left + 1], BUCKETS)
                total[:, d] += np.bincount(t.bucket[left + 1], column[left], BUCKETS)
    rows = np.flatnonzero(seen)
    if len(rows):
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(seen[rows]), *(pa.array(total[rows, d]) for d in range(DIM))],
            ["bucket", "seen", *(f"v{d}" for d in range(DIM))],
        )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors of all buckets over the whole corpus: a matrix of fixed size."""
    schema = "bucket long, seen long, " + ", ".join(f"v{d} double" for d in range(DIM))
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(_cooccurrences, schema)
    sums = parts.groupBy("bucket").agg(F.sum("seen").alias("seen"), *(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM)))
    out = np.zeros((BUCKETS, DIM), np.float32)
    for row in sums.collect():  # at most BUCKETS rows
        v = np.array(row[2:])
        out[row["bucket"]] = v / max(1e-9, np.linalg.norm(v))
    return out


def _parts(text: bytes) -> list[bytes]:
    """A long text in parts of about a group's size, cut at white space."""
    out, at = [], 0
    while len(text) - at > 2 * _GROUP:
        end = text.find(b" ", at + _GROUP)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _sums(texts: list[bytes], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the pooled vectors of each text, and its number of tokens."""
    t = Tokens(texts)
    n = np.diff(t.first)
    out = np.zeros((len(texts), 3 * DIM))
    if len(t.bucket):
        full = np.flatnonzero(n > 0)
        at = t.first[:-1][full]
        joint = np.zeros_like(t.index)
        left = np.flatnonzero(t.inner)
        joint[left] = t.index[left] * t.index[left + 1]
        for k, part in enumerate((vectors[t.bucket], t.index, joint)):
            out[full, k * DIM : (k + 1) * DIM] = np.add.reduceat(part, at, axis=0)
    return out, n


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """The features of each text.  Long texts are pooled by parts; pairs across their borders don't count."""
    parts = [_parts(t) for t in texts]
    flat = [p for ps in parts for p in ps]
    done = [_sums(flat[i:j], vectors) for i, j in groups([len(p) for p in flat], _GROUP)]
    sums, counts = (np.concatenate([d[k] for d in done]) for k in (0, 1))
    owner = np.repeat(np.arange(len(texts)), [len(ps) for ps in parts])
    total, n = np.zeros((len(texts), 3 * DIM)), np.bincount(owner, counts, len(texts))
    np.add.at(total, owner, sums)
    out = np.zeros((len(texts), FEATURES), np.float32)
    full = n > 0
    out[full, :-2] = total[full] / n[full, None]
    out[full, -2] = np.log1p(n[full])
    out[full, -1] = np.log1p([len(x) for x in texts])[full] - out[full, -2]
    return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, steps: int = 300, seed: int = 0) -> dict:
    """A two-layer network by Adam, and its temperature from every fifth row, which is kept back."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    back, fit = order[::5], np.setdiff1d(order, order[::5])
    if len({*y[fit]}) < 2 or len({*y[back]}) < 2:
        back = fit = order
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z = ((x - mean) / scale).astype(np.float64)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    a, b, w = z[fit], y[fit], weight[fit] / weight[fit].sum()
    for step in range(1, steps + 1):
        h = np.tanh(a @ p[0] + p[1])
        g = w * (sigmoid(h @ p[2] + p[3]) - b)
        gh = np.outer(g, p[2]) * (1 - h * h)
        grads = [a.T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "scale": scale, "layers": p, "temperature": 1.0}
    logits, wb = logit(x[back], model), weight[back]

    def loss(t: float) -> float:
        q = np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)
        return float(-(wb * (y[back] * np.log(q) + (1 - y[back]) * np.log(1 - q))).sum())

    model["temperature"] = min(np.geomspace(0.05, 8, 80), key=loss)
    return model


def logit(x: np.ndarray, model: dict) -> np.ndarray:
    w1, b1, w2, b2 = model["layers"]
    return (np.tanh(((x - model["mean"]) / model["scale"]) @ w1 + b1) @ w2 + b2) / model["temperature"]


def fit(rows: list[tuple[str, int]], counts: dict[int, int], vectors: np.ndarray) -> dict:
    """The whole model; ``counts`` are the frequencies of the labels, of which ``rows`` are a sample."""
    if {label for _, label in rows} != {0, 1}:
        return {"share": counts.get(1, 0) / sum(counts.values()) if counts else 1.0}
    texts = [t.encode() for t, _ in rows]
    x = np.concatenate([pooled(texts[i:j], vectors) for i, j in groups([len(t) for t in texts], _GROUP)])
    y = np.array([label for _, label in rows], float)
    have = Counter(label for _, label in rows)
    weight = np.where(y == 1, counts[1] / have[1], counts[0] / have[0])
    return train(x, y, weight) | {"vectors": vectors}


def _score(batches: Iterator[pa.RecordBatch], packed: bytes, first: str = "doc_id") -> Iterator[pa.RecordBatch]:
    model = pickle.loads(packed)
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        if "share" in model:
            scores = np.full(len(texts), model["share"])
        else:
            parts = [pooled(texts[i:j], model["vectors"]) for i, j in groups([len(t) for t in texts], _GROUP)]
            scores = sigmoid(logit(np.concatenate(parts), model)) if parts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [first, "score"])


def _fitted(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label: str, per_label: int) -> Broadcast:
    rows, counts = sample_labelled(docs, labels, label, usable, per_label, id_col, text_col)
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(rows, counts, word_vectors(docs, text_col))))


def score_documents(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
    per_label: int = 4000,
) -> DataFrame:
    """(doc_id, score) of every document.  ``usable``: condition over ``id``, which labels may be used."""
    shared = _fitted(docs, labels, usable, id_col, text_col, label, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(batches, shared.value)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def drop_poor(
    docs: DataFrame, labels: DataFrame, usable: Column, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
    per_label: int = 4000,
) -> DataFrame:
    """The rows of ``docs`` whose own text reaches the score ``least``, with all their columns."""
    shared = _fitted(docs, labels, usable, id_col, text_col, label, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(batches, shared.value, "row")

    # the row travels as one column through the scorer: no join, and no clash of names
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.where(F.col("score") >= least).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
