"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct word shingles (64-bit hashes).  Its sketch has ``REGISTERS``
buckets; a bucket keeps the smallest hash that falls into it as a count of leading zeros and
``MANTISSA`` bits after the first one.  Empty buckets take over the register of a filled bucket,
chosen by a fixed random order, so that two sketches agree in a register about as often as the
sets overlap, however small they are.  ``BANDS`` bands of compressed registers propose pairs; the
overlap estimated from all registers, corrected for chance collisions of compressed registers,
discards hopeless ones (five standard errors below the threshold), and the rest is confirmed on
the full sets.

Groups of any size stay cheap.  Documents with equal sets are one node.  In a band's bucket every
node is compared with the smallest one only; buckets that fall apart after that are gathered into
families, and there every node outside the largest component is compared with all others in blocks
of ``BLOCK`` nodes, of which only links that join two components come out.

Defined results: null texts and texts without words have empty sets and are linked with nothing; a
text with fewer words than a shingle is one shingle; rows that repeat an identifier are one node;
null identifiers are linked with nothing unless an equal set has an identifier; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm._bytes import Rolling, byte_table, groups, mix, runs
from lexforge.llm._store import materialise
from lexforge.llm.components import components

REGISTERS, BANDS, MANTISSA = 192, 32, 10
BLOCK = 512
#: Pairs of one pivot that are verified together.
PART = 256
_ROWS = REGISTERS // BANDS
_GROUP = 1 << 19
_TABLE = byte_table(1, fold=True)
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_ORDER = np.random.default_rng(17).random((REGISTERS, REGISTERS)).astype(np.float32)
np.fill_diagonal(_ORDER, -1)  # a filled bucket keeps its own register
_MULTIPLIERS = np.random.default_rng(23).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Chance that two unequal minima give the same register: equal leading zeros (1/3), equal mantissas.
COLLISION = 1 / 3 / (1 << MANTISSA)

SKETCH = "doc_id long, n_shingles long, set_key binary, sketch binary"


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words; long data go in segments that end at white space."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + 2 * _GROUP)
        while end < len(data) and not _SPACE[data[end]]:
            ahead = np.flatnonzero(_SPACE[data[end : end + _GROUP]])
            end += int(ahead[0]) if len(ahead) else min(_GROUP, len(data) - end)
        part = data[at:end]
        first, last = runs(~_SPACE[part])
        hashes.append(mix(Rolling(part, _TABLE).at(first, last) + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    start, word = _words(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    limits = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    shingle = np.zeros(len(word), np.uint64)
    for k in range(words):
        n = len(word) - k
        if n > 0:
            shingle[:n] += mix(word[k:] * _MULTIPLIERS[k])
    shingle = mix(shingle)
    for i, j in zip(limits[:-1].tolist(), limits[1:].tolist()):
        if j - i >= words:
            yield np.unique(shingle[i : j - words + 1])
        elif j > i:  # the whole sequence, apart from any full shingle
            few = word[i:j] * _MULTIPLIERS[: j - i]
            yield mix(np.array([few.sum(dtype=np.uint64) + np.uint64(j - i)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def sketch(members: np.ndarray) -> np.ndarray:
    """The registers (16 bits each) of a set that isn't empty."""
    h = mix(members * np.uint64(0xD6E8FEB86659FD93))
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    np.minimum.at(low, bucket.astype(np.int64), mix(h))
    filled = np.flatnonzero(low != np.iinfo(np.uint64).max)
    least = np.maximum(low, np.uint64(1))
    # leading zeros from the float's exponent; a value that rounds up to a power of two is set right
    bits = np.floor(np.log2(least.astype(np.float64))).astype(np.int64)
    bits = np.minimum(bits, 63)
    bits -= (least >> bits.astype(np.uint64)) == 0
    zeros = 63 - bits
    shifted = (least << (zeros + 1).clip(0, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    register = ((zeros << MANTISSA) | shifted.astype(np.int64)).astype(np.uint16)
    if len(filled) < REGISTERS:
        empty = np.flatnonzero(low == np.iinfo(np.uint64).max)
        register[empty] = register[filled[_ORDER[np.ix_(empty, filled)].argmin(axis=1)]]
    return register


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        sizes, keys, found = [], [], []
        for i, j in groups([len(t) for t in texts], _GROUP):
            for members in shingle_sets(texts[i:j], words):
                sizes.append(len(members))
                keys.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None)
                found.append(sketch(members).tobytes() if len(members) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())],
            ["doc_id", "n_shingles", "set_key", "sketch"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scale = _MULTIPLIERS[:_ROWS]
    for batch in batches:
        if not len(batch):
            continue
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, _ROWS)
        keys = mix((registers.astype(np.uint64) * scale).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MULTIPLIERS[40])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"]
        )


def _full_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        sets = [m for i, j in groups([len(t) for t in texts], _GROUP) for m in shingle_sets(texts[i:j], words)]
        nodes = batch.column(0).to_pylist()
        for i, j in groups([8 * len(m) for m in sets], 1 << 24):
            full = [m for m in sets[i:j] if len(m)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n for n, m in zip(nodes[i:j], sets[i:j]) if len(m)], pa.int64()),
                    pa.array([sketch(m).tobytes() for m in full], pa.binary()),
                    pa.array([m.tobytes() for m in full], pa.binary()),
                ],
                ["node", "sketch", "members"],
            )


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (over the last axis), without chance collisions."""
    return ((a == b).mean(axis=-1) - COLLISION) / (1 - COLLISION)


def margin(threshold: float) -> float:
    """The estimate below which a pair is discarded: five standard errors under the threshold."""
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) / REGISTERS)


def _linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    least = margin(percent / 100)
    for batch in batches:
        rows = []
        for a, b, sa, sb, ma, mb in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if estimate(np.frombuffer(sa, np.uint16), np.frombuffer(sb, np.uint16)) < least:
                continue
            x, y = np.frombuffer(ma, np.uint64), np.frombuffer(mb, np.uint64)
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                if _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    rows.append((a, b))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], ["a", "b"])


def _block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between different components among the row nodes and column nodes of a block."""
    # a node may be on both sides: it is read once
    rows = rows.sort_values(["node", "side"], kind="stable")
    left = rows[rows["side"] == 0].drop_duplicates("node")
    right = rows[rows["side"] == 1].drop_duplicates("node")
    out = []
    if len(left) and len(right):
        sets = [np.frombuffer(m, np.uint64) for m in right["members"]]
        sizes = np.array([len(s) for s in sets])
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        sketches = np.frombuffer(b"".join(right["sketch"]), np.uint16).reshape(-1, REGISTERS)
        nodes, root = right["node"].to_numpy(), dict(zip(rows["node"], rows["comp"], strict=True))
        parent = {c: c for c in root.values()}

        def top(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        least = margin(percent / 100)
        for node, own, packed in zip(left["node"], left["sketch"], left["members"], strict=True):
            likely = np.flatnonzero(estimate(sketches, np.frombuffer(own, np.uint16)) >= least)
            likely = [k for k in likely.tolist() if top(root[nodes[k]]) != top(root[node])]
            if not likely:
                continue
            mine = np.frombuffer(packed, np.uint64)
            at = np.searchsorted(values, mine).clip(max=len(values) - 1)
            mark = np.zeros(len(values), bool)
            mark[at[values[at] == mine]] = True
            common = np.add.reduceat(mark[place], starts, dtype=np.int64)
            for k in likely:
                a, b = top(root[nodes[k]]), top(root[node])
                if a != b and _linked(int(common[k]), len(mine), int(sizes[k]), percent):
                    parent[max(a, b)] = min(a, b)
                    out.append((min(int(node), int(nodes[k])), max(int(node), int(nodes[k]))))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _within_families(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links that comparisons with the smallest node of a bucket have missed."""
    placed = materialise(
        members.where("n > 2").join(found, "node", "left").select("key", "node", "pivot", F.coalesce("root", "node").alias("comp")), "placed"
    )
    apart = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
    active = materialise(placed.join(materialise(apart, "apart"), "key"), "active")
    if active.isEmpty():
        return None
    family = components(active.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    nodes = materialise(
        active.select("node", "comp").distinct().join(family.select("node", F.col("root").alias("family")), "node"), "family-nodes"
    )
    sizes = nodes.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m"))
    # the largest component of each family, and how many nodes are in it and in all
    stats = sizes.groupBy("family").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"))
    stats = stats.select(
        "family",
        F.col("top.comp").alias("largest"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"),
        F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int")).alias("rows"),
    )
    spread = nodes.join(materialise(stats, "families"), "family")
    h = F.xxhash64("node")
    # A node outside the largest component stands in one row block, against all column blocks; every
    # node stands in one column block, against all row blocks.
    sides = F.array(
        F.when(
            F.col("comp") != F.col("largest"),
            F.struct(F.lit(0).alias("side"), F.pmod(h, F.col("rows")).cast("int").alias("at"), (F.col("columns") - 1).alias("last")),
        ),
        F.struct(F.lit(1).alias("side"), F.pmod(h, F.col("columns")).cast("int").alias("at"), (F.col("rows") - 1).alias("last")),
    )
    dealt = (
        spread.select("family", "node", "comp", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s"))
        .select("family", "node", "comp", "s.*")
        .select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
        .select(
            "family",
            "node",
            "comp",
            "side",
            F.when(F.col("side") == 0, F.col("at")).otherwise(F.col("other")).alias("i"),
            F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("at")).alias("j"),
        )
    )

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _block_links(rows, percent)

    return dealt.join(sets, "node").groupBy("family", "i", "j").applyInPandas(block, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    percent = round(100 * threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sketches(batches, words)

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _full_sets(batches, words)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verify(batches, percent)

    sketched = materialise(texts.mapInArrow(sketches, SKETCH), "sketches")
    classes = materialise(
        sketched.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes"
    )
    first = sketched.join(classes.where("node IS NOT NULL"), "set_key").where("doc_id = node").select("node", "sketch")
    bands = materialise(first.mapInArrow(_bands, "key long, node long"), "bands")
    buckets = materialise(
        bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("pivot <> last").drop("last"),
        "buckets",
    )
    members = materialise(bands.join(buckets, "key"), "members")
    pairs = materialise(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    involved = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "involved")
    sets = materialise(
        texts.join(involved, "doc_id", "left_semi").mapInArrow(full_sets, "node long, sketch binary, members binary"), "sets"
    )
    # A popular pivot's pairs are dealt into parts of about PART; its set goes to each of them once.
    popular = pairs.groupBy("a").agg(F.floor(F.count(F.lit(1)) / PART).cast("int").alias("more")).where("more > 0")
    popular = materialise(popular, "popular-pivots")
    salted = pairs.join(popular, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("more") + 1), F.lit(0)).cast("int"))
    pivots = sets.join(popular, sets["node"] == popular["a"], "left").select(
        F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.coalesce("more", F.lit(0)))).alias("part"), F.col("sketch").alias("sa"), F.col("members").alias("ma")
    )
    with_b = salted.drop("more").join(sets.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("members").alias("mb")), "b")
    with_both = with_b.join(pivots, ["a", "part"])
    links = materialise(with_both.select("a", "b", "sa", "sb", "ma", "mb").mapInArrow(verify, "a long, b long"), "pivot-links")
    found = materialise(components(links), "components")
    more = _within_families(members, found, sets, percent)
    if more is not None:
        more = materialise(more, "family-links")
        if not more.isEmpty():
            found = materialise(components(links.unionByName(more)), "components")
    placed = sketched.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left").join(found, "node", "left")
    component = F.coalesce("root", "node", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates, with all columns."""
    kept = near_groups(docs, id_col, text_col, words, threshold).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    same = F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("k.__kept_id"))
    return docs.alias("d").join(kept.alias("k"), same, "left_semi")
