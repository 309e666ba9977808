"""Approximate nearest neighbours in robust-pruned directed graphs, one graph per shard.

Vectors are grouped into classes of equal ones (a class lists its smallest identifiers, as many as
any answer can hold), and classes are dealt by a hash into shards of about ``shard_rows``.  Largest
inner product becomes smallest distance by one more coordinate that makes all norms of a shard
equal.  A shard's graph grows batch by batch: greedy beam searches from the medoid propose
neighbours, relaxed pruning (``alpha``) keeps diverse edges, and edges back are added and pruned
likewise.  Query classes go in blocks to every shard; beam search there finds candidates, which are
scored in double precision on the original vectors and merged.

Shards are written as rows of packed arrays in the shared folder; losing an executor loses no
graph.  Every row is indexed, whatever the sample or size.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do those whose length isn't the commonest (ties: the smaller); rows that repeat an
identifier and a vector count once; null identifiers take no part; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm._store import materialise

INDEX = "shard int, n int, dim int, start int, reps binary, vectors binary, graph binary"
FOUND = "query_class long, rep long, score double"


class Graph:
    """Directed graph over the rows of ``x`` (augmented, float32), squared Euclidean distance."""

    def __init__(self, x: np.ndarray, degree: int, edges: np.ndarray | None = None, start: int | None = None):
        self.x, self.degree = x, degree
        self.norms = (x * x).sum(1)
        self.edges = np.full((len(x), degree), -1, np.int32) if edges is None else edges
        self.start = int(((x - x.mean(0)) ** 2).sum(1).argmin()) if start is None else start

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances (up to the query's norm) of each query to its row of ids; -1 is infinitely far."""
        d = self.norms[ids] - 2 * np.matmul(self.x[ids], q[:, :, None])[:, :, 0]
        d[ids < 0] = np.inf
        return d

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``beam`` nearest that a greedy search meets, nearest first."""
        n = len(q)
        ids = np.full((n, beam), -1, np.int32)
        ids[:, 0] = self.start
        d = np.full((n, beam), np.inf, np.float32)
        d[:, 0] = self.distances(q, ids[:, :1])[:, 0]
        done = np.zeros((n, beam), bool)
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), np.inf, d[live])
            pick = np.argpartition(open_, min(width, beam) - 1, axis=1)[:, :width]
            take = np.isfinite(np.take_along_axis(open_, pick, 1))
            going = take.any(1)
            live, pick, take = live[going], pick[going], take[going]
            if not len(live):
                break
            chosen = np.take_along_axis(ids[live], pick, 1)
            mark = done[live]
            np.put_along_axis(mark, pick, np.take_along_axis(mark, pick, 1) | take, 1)
            done[live] = mark
            near = np.where(take[:, :, None], self.edges[chosen], -1).reshape(len(live), -1)
            # the same node from several of the chosen, or in the beam already, counts once
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = near[:, (near >= 0).any(0)]
            if not near.shape[1]:
                continue
            known = (near[:, :, None] == ids[live][:, None, :]).any(2)
            near[known] = -1
            all_ids = np.concatenate([ids[live], near], 1)
            all_d = np.concatenate([d[live], self.distances(q[live], near)], 1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            d[live] = np.take_along_axis(all_d, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        ids[~np.isfinite(d)] = -1
        return ids, d

    def prune(self, points: np.ndarray, near: np.ndarray, alpha: float) -> np.ndarray:
        """Up to ``degree`` diverse neighbours of each point out of its candidates (-1: none)."""
        near = near.copy()
        near[near == points[:, None]] = -1
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        x = self.x[near]
        d = ((x - self.x[points][:, None, :]) ** 2).sum(2)
        d[near < 0] = np.inf
        norms = self.norms[near]
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        out = np.full((len(points), self.degree), -1, np.int32)
        rows = np.arange(len(points))
        alive = d.copy()
        for k in range(self.degree):
            best = alive.argmin(1)
            ok = np.isfinite(alive[rows, best])
            if not ok.any():
                break
            out[ok, k] = near[rows[ok], best[ok]]
            gone = alpha * between[rows, best] <= d
            alive[gone & ok[:, None]] = np.inf
            alive[rows, best] = np.inf
        return out

    def link_back(self, points: np.ndarray, alpha: float) -> None:
        """Edges from the new neighbours of ``points`` to them."""
        kept = self.edges[points]
        source = np.repeat(points, self.degree)[kept.ravel() >= 0]
        target = kept.ravel()[kept.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        for low, high in ((1, 8), (8, 32), (32, 128), (128, 1 << 30)):  # by how many come in: even widths
            some = np.flatnonzero((many >= low) & (many < high))
            step = max(1, 65536 // (self.degree + min(high, int(many.max(initial=1)))))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                wide = int(many[part].max())
                new = np.full((len(part), wide), -1, np.int32)
                column = np.arange(wide)
                fits = column < many[part][:, None]
                new[fits] = source[(first[part][:, None] + column)[fits]]
                near = np.concatenate([self.edges[nodes[part]], new], 1)
                self.edges[nodes[part]] = self.prune(nodes[part], near, alpha)


def build(x: np.ndarray, degree: int, beam: int, alpha: float, seed: int = 0) -> Graph:
    """The graph of the rows of ``x``; batches of points double up to a fiftieth of all."""
    graph = Graph(x, degree)
    order = np.random.default_rng(seed).permutation(len(x))
    order = np.concatenate(([graph.start], order[order != graph.start])).astype(np.int32)
    at = min(len(x), degree + 1)
    first = order[:at]
    graph.edges[first] = graph.prune(first, np.tile(first, (at, 1)), alpha)
    graph.link_back(first, alpha)
    while at < len(x):
        step = min(len(x) - at, at, max(64, len(x) // 50), 1024)
        points = order[at : at + step]
        near, _ = graph.search(x[points], beam)
        graph.edges[points] = graph.prune(points, near, alpha)
        graph.link_back(points, alpha)
        at += step
    return graph


def augmented(v: np.ndarray) -> np.ndarray:
    """With one more coordinate that makes all norms equal: nearest is then largest inner product."""
    squares = (v.astype(np.float64) ** 2).sum(1)
    return np.c_[v, np.sqrt(np.maximum(squares.max() - squares, 0))].astype(np.float32)


def _build_shard(rows: pd.DataFrame, degree: int, beam: int, alpha: float) -> pd.DataFrame:
    rows = rows.sort_values("rep")
    v = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    graph = build(augmented(v), degree, beam, alpha)
    return pd.DataFrame(
        {
            "shard": [rows["shard"].iloc[0]],
            "n": [len(rows)],
            "dim": [v.shape[1]],
            "start": [graph.start],
            "reps": [rows["rep"].to_numpy().astype("<i8").tobytes()],
            "vectors": [v.astype("<f8").tobytes()],
            "graph": [graph.edges.astype("<i4").tobytes()],
        }
    )


def _search_shard(queries: pd.DataFrame, index: pd.DataFrame, beam: int, want: int) -> pd.DataFrame:
    empty = pd.DataFrame({"query_class": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(queries) or not len(index):
        return empty
    row = index.iloc[0]
    reps = np.frombuffer(row["reps"], "<i8")
    v = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], row["dim"])
    edges = np.frombuffer(row["graph"], "<i4").reshape(row["n"], -1)
    graph = Graph(augmented(v), edges.shape[1], edges, int(row["start"]))
    q = np.stack(queries["embedding"].to_numpy()).astype(np.float64)
    out = []
    for i in range(0, len(q), 512):
        part = q[i : i + 512]
        ids, _ = graph.search(np.c_[part, np.zeros(len(part))].astype(np.float32), beam)
        score = np.einsum("qkd,qd->qk", v[ids], part)
        score[ids < 0] = -np.inf
        order = np.lexsort((reps[ids], -score), axis=1)[:, :want]
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        names = np.repeat(queries["query_class"].to_numpy()[i : i + 512], ids.shape[1]).reshape(ids.shape)
        real = ids >= 0
        out.append(pd.DataFrame({"query_class": names[real], "rep": reps[ids[real]], "score": score[real]}))
    return pd.concat(out) if out else empty


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL"
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("embedding", lambda x: x != 0))
    lengths = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    return v.where(F.size("embedding") == dim)


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 16384,
    block_rows: int = 16384,
    degree: int = 40,
    build_beam: int = 64,
    beam: int = 192,
    alpha: float = 1.2,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of each query, as found.

    ``is_query``: condition over ``vec_id``.
    """
    rows = materialise(usable_vectors(rows, id_col, vector_col).distinct(), "vectors")
    # Only the smallest ids of a class can be in an answer; the limit is applied before the shuffle too.
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = materialise(
        few.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "vector-classes"
    )
    shards = max(1, math.ceil(classes.count() / shard_rows))

    def build_one(group: pd.DataFrame) -> pd.DataFrame:
        return _build_shard(group, degree, build_beam, alpha)

    index = materialise(
        classes.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), "rep", "embedding")
        .groupBy("shard")
        .applyInPandas(build_one, INDEX),
        "graphs",
    )
    queries = rows.where(is_query).join(classes.select("embedding", "rep"), "embedding")
    queries = materialise(queries.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query_class")), "vector-queries")
    asked = materialise(
        classes.join(queries.select(F.col("query_class").alias("rep")).distinct(), "rep", "left_semi").select(
            F.col("rep").alias("query_class"), "embedding"
        ),
        "asked",
    )
    blocks = max(1, math.ceil(asked.count() / block_rows))
    spread = asked.withColumn("block", F.pmod(F.xxhash64("query_class"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search_one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search_shard(left, right, max(beam, k + 1), k + 1)

    found = spread.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInPandas(search_one, FOUND)
    by_score = Window.partitionBy("query_class").orderBy(F.desc("score"), "rep")
    found = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1).drop("place")
    listed = found.join(classes.select("rep", "ids"), "rep").select("query_class", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    answers = materialise(
        listed.groupBy("query_class").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found")), "answers"
    )
    told = queries.join(answers, "query_class").select(
        "query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "hit")
    )
    return told.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id"), F.col("hit.score"))
