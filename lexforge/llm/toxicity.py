"""Toxicity by compression distance with two zstandard dictionaries.

Texts are lower-cased, everything but letters becomes a space, and windows of ``window`` words are
compressed twice: with a dictionary trained on ordinary text, and with one that also holds dictionaries
trained on toxic windows.  Toxic training texts are mostly ordinary, so what they are trained on are the
parts that strings of 4 to 10 bytes mark which toxic documents hold more often than chance explains (a
log-likelihood ratio; there is no least share).  This is done per group of like documents (by byte pairs,
not by the column lang), so a large language doesn't crowd out a small one.  What a window saves with the
second dictionary is its distance; the savings of a document enter its group's calibrated threshold (a
logistic function).

The dictionaries, the savings and the threshold are fitted on a bounded sample of labelled rows
(``per_label`` of each label); every document is scored over its whole text.

Defined results: null and empty texts have no savings and get the score of such a text; with no rows
of one of the labels, every score is the share of toxic labels (0 with no labels at all); equal
texts get equal scores; repeated identifiers are scored each.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm._labels import fit_logistic, sample_labelled, sigmoid

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Lengths of the strings that mark toxic windows, bits of their hashes, and hashed byte pairs of a profile.
_LENGTHS, _BITS, _PROFILE = range(4, 11), 23, 1024
#: Savings (bytes) from which a window counts; how many of the largest savings are averaged; and all features.
_LEVELS, _TOP = (1, 2, 3), 4
_FEATURES = len(_LEVELS) + 4


def normal(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(_PLAIN)


def windows(data: bytes, words: int) -> list[bytes]:
    """Windows of so many words; each second one starts in the middle of the one before."""
    found = data.split()
    return [b" " + b" ".join(found[i : i + words]) + b" " for i in range(0, len(found), words // 2)]


def _dictionary(content: bytes, level: int, least: int):
    set_up = zstandard.ZstdCompressionParameters.from_level(
        1, min_match=least, strategy=zstandard.STRATEGY_DFAST, window_log=17, hash_log=16, chain_log=16,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(compression_params=set_up)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=set_up)


class Distance:
    """Compares windows under both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes, window: int = 16):
        self.window = window
        self.pairs = [(_dictionary(ordinary, 1, m).compress, _dictionary(toxic, 1, m).compress) for m in (6, 7)]

    def savings(self, text: str) -> np.ndarray:
        some = windows(normal(text), self.window)
        if not some:
            return np.zeros(0)
        # two match lengths err differently: their mean is the distance
        return np.array([sum(len(o(w)) - len(t(w)) for o, t in self.pairs) for w in some]) / len(self.pairs)

    def features(self, text: str) -> np.ndarray:
        d = self.savings(text)
        if not len(d):
            return np.zeros(_FEATURES)
        top = min(12.0, np.sort(d)[::-1][:_TOP].mean())
        return np.r_[d.mean(), np.maximum(d, 0).mean(), [(d >= k).mean() for k in _LEVELS], top, math.log1p(len(d))]


def _distinct(texts: list[bytes]) -> list[bytes]:
    """Without texts of which a quarter of the four-word shingles came before: copies say nothing new."""
    seen: set[int] = set()
    kept = []
    for t in texts:
        words = t.split()
        own = {hash(tuple(words[i : i + 4])) for i in range(max(1, len(words) - 3))}
        if 4 * len(own & seen) < len(own):
            kept.append(t)
        seen |= own
    return kept


def _profile(data: bytes) -> np.ndarray:
    """Roots of the frequencies of hashed byte pairs, of length one."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    v = np.sqrt(np.bincount(((a[:-1] * 31 + a[1:]) * 2654435761 >> 7) % _PROFILE, minlength=_PROFILE))
    return v / max(1e-9, float(np.linalg.norm(v)))


def _groups(x: np.ndarray, k: int, like: float = 0.8, rounds: int = 12) -> np.ndarray:
    """Centres of at most ``k`` groups of profiles (languages and scripts fall apart): spherical k-means from far points."""
    c = [x[0]]
    while len(c) < k:
        near = (x @ np.array(c).T).max(1)
        if near.min() > like:
            break
        c.append(x[int(near.argmin())])
    c = np.array(c)
    k = len(c)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-9
    return c


def _hashes(data: bytes) -> list[tuple[int, np.ndarray]]:
    """For each length of strings, the hash of the string at each position."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    h = np.zeros(len(a), np.uint64)
    found = []
    for n in range(1, min(_LENGTHS[-1], len(a)) + 1):
        h = h[: len(a) - n + 1] * np.uint64(0x100000001B3) + a[n - 1 :] + np.uint64(n)
        if n >= _LENGTHS[0]:
            found.append((n, ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)))
    return found


def _frequencies(texts: list[bytes]) -> np.ndarray:
    """How many of the texts hold the strings of each hash."""
    c = np.zeros(1 << _BITS, np.uint16 if len(texts) < 1 << 16 else np.uint32)
    for text in texts:
        found = _hashes(text)
        if found:
            c[np.unique(np.concatenate([h for _, h in found]))] += 1
    return c


def _evidence(t: np.ndarray, n_t: int, o: np.ndarray, n_o: int) -> np.ndarray:
    """Log-likelihood ratio of each hash that toxic texts hold more often than chance over all of them explains, else 0."""
    out = np.zeros(len(t), np.float32)
    at = np.flatnonzero(t >= 3)
    if not len(at) or not n_o:
        return out
    a, b = t[at].astype(float), o[at].astype(float)

    def likelihood(k, n, p):
        return k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))

    both = (a + b) / (n_t + n_o)
    g = 2 * (likelihood(a, n_t, a / n_t) + likelihood(b, n_o, b / n_o) - likelihood(a, n_t, both) - likelihood(b, n_o, both))
    sure = (g > 2 * math.log(max(2, len(at)))) & (a / n_t > 2 * b / n_o)
    out[at[sure]] = g[sure]
    return out


def _marked(text: bytes, evidence: np.ndarray, share: float = 0.8) -> bytes:
    """The parts of a toxic text that strings with evidence cover; weaker ones that overlap stronger ones take no part."""
    best, found = np.zeros(len(text), np.float32), []
    for n, h in _hashes(text):
        at = np.flatnonzero(evidence[h])
        if len(at):
            g = evidence[h[at]]
            found.append((n, at, g))
            for j in range(n):
                best[at + j] = np.maximum(best[at + j], g)
    edge = np.zeros(len(text) + 1, np.int32)
    for n, at, g in found:
        at = at[g >= share * np.max([best[at + j] for j in range(n)], axis=0)]
        edge[at] += 1
        edge[at + n] -= 1
    return np.frombuffer(text, np.uint8)[np.cumsum(edge[:-1]) > 0].tobytes()


def _train(samples: list[bytes], size: int, **how: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it is the dictionary itself
        return b"\n".join(samples[-200:])[-size:]


def _pair(ordinary: bytes, toxic: bytes) -> tuple[bytes, bytes]:
    """Both dictionaries; the ordinary one is filled with bytes no text holds, so that offsets cost the same in both."""
    return ordinary + b"\0" * len(toxic), ordinary + toxic


def fit(
    rows: list[tuple[str, int]], counts: dict[int, int], window: int = 24, dictionary_bytes: int = 8192, groups: int = 6, group_bytes: int = 512, folds: int = 3
) -> dict:
    """Dictionaries and thresholds from labelled texts; ``counts`` are the label frequencies.

    Toxic windows are marked and trained on per group, so that no language crowds out the others
    (``group_bytes`` each), and each group has its threshold.  The thresholds are fitted on savings
    with toxic dictionaries that were trained without the text in question (``folds``).
    """
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if {label for _, label in rows} != {0, 1}:
        return {"share": share}
    texts = [b" " + b" ".join(normal(t).split()) + b" " for t, _ in rows]
    y = np.array([label for _, label in rows], float)
    x = np.array([_profile(t) for t in texts])
    centres = _groups(x, groups)
    groups = len(centres)
    group = (x @ centres.T).argmax(1)
    del x
    fold = np.array([zlib.crc32(t) % folds for t in texts])
    kept = np.zeros(len(rows), bool)
    for v in (0, 1):
        own = np.flatnonzero(y == v)
        new = {id(t) for t in _distinct([texts[i] for i in own])}
        kept[[i for i in own if id(texts[i]) in new]] = True
    pieces = [w for i in np.flatnonzero(kept & (y == 0)) for w in windows(texts[i], window)]
    ordinary = _train(pieces, dictionary_bytes) or b" " * 8
    del pieces
    toxic = [b""] * (folds + 1)  # by the fold left out; the last leaves out none
    for g in range(groups):
        parts = [[np.flatnonzero(kept & (group == g) & (y == v) & (fold == f)) for f in range(folds)] for v in (0, 1)]
        seen = [[_frequencies([texts[i] for i in part]) for part in parts[v]] for v in (0, 1)]
        for out in range(folds + 1):
            rest = [f for f in range(folds) if f != out]
            total = [sum(seen[v][f].astype(np.int32) for f in rest) for v in (0, 1)]
            n_o, n_t = (sum(len(parts[v][f]) for f in rest) for v in (0, 1))
            evidence = _evidence(total[1], n_t, total[0], n_o)
            samples = [m for f in rest for i in parts[1][f] if len(m := _marked(texts[i], evidence)) >= 8]
            if samples:
                toxic[out] += _train(samples, group_bytes, k=20, d=8)
    features = np.zeros((len(rows), _FEATURES))
    for out in range(folds):
        distance = Distance(*_pair(ordinary, toxic[out]), window)
        for i in np.flatnonzero(fold == out):
            features[i] = distance.features(rows[i][0])
    first, second = _pair(ordinary, toxic[folds])
    model = {"share": share, "ordinary": first, "toxic": second, "window": window, "centres": centres}
    have = Counter(label for _, label in rows)
    weight = np.where(y == 1, counts[1] / have[1], counts[0] / have[0])
    weight /= weight.mean()

    def threshold(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = features[of]
        mean, scale = z.mean(0), z.std(0) + 1e-6
        return mean, scale, fit_logistic((z - mean) / scale, y[of], weight[of], ridge=0.05)

    model["threshold"] = threshold(np.arange(len(rows)))
    # a group with too few rows of either label takes the threshold of all
    model["thresholds"] = [
        threshold(np.flatnonzero(group == g)) if min((y[group == g] == v).sum() for v in (0, 1)) >= 5 else model["threshold"] for g in range(groups)
    ]
    return model


_ready: dict[str, Distance] = {}


def score_text(text: str, model: dict, distance: Distance | None) -> float:
    if distance is None:
        return model["share"]
    data = b" " + b" ".join(normal(text).split()) + b" "
    mean, scale, weights = model["thresholds"][int((model["centres"] @ _profile(data)).argmax())]
    return float(sigmoid((distance.features(text) - mean) / scale @ weights[:-1] + weights[-1]))


def _score(batches: Iterator[pa.RecordBatch], packed: bytes, key: str) -> Iterator[pa.RecordBatch]:
    model = pickle.loads(packed)
    distance = None
    if "threshold" in model:
        distance = _ready.get(key)
        if distance is None:
            distance = _ready[key] = Distance(model["ordinary"], model["toxic"], model["window"])
    for batch in batches:
        scores = [score_text(t or "", model, distance) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score_documents(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
    per_label: int = 4000, window: int = 24,
) -> DataFrame:
    """(doc_id, score) of every document.  ``usable``: condition over ``id``, which labels may be used."""
    rows, counts = sample_labelled(docs, labels, label, usable, per_label, id_col, text_col)
    packed = pickle.dumps(fit(rows, counts, window))
    shared, key = docs.sparkSession.sparkContext.broadcast(packed), hashlib.sha256(packed).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(batches, shared.value, key)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")
