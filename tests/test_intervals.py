"""Dyadic interval joins against brute force, and their cost on crowded keys."""

import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import graph, intervals, sessions

RANGES = "k string, s long, e long, id int"


def random_ranges(rnd, n, low=-40, high=60):
    rows = []
    for i in range(n):
        s = rnd.randint(low, high)
        rows.append((rnd.choice("ab"), s, s + rnd.choice([-1, 0, 0, 1, 5, 17, 64, 1000]), i))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_nodes_cover_a_range_once(spark, seed):
    rows = random_ranges(random.Random(seed), 200)
    found = {}
    for r in intervals.range_nodes(spark.createDataFrame(rows, RANGES), "s", "e").collect():
        found.setdefault(r["id"], []).extend(range(r["node"] << r["level"], (r["node"] + 1) << r["level"]))
    for _, s, e, i in rows:
        assert sorted(found.get(i, [])) == list(range(s, e + 1))


@pytest.mark.parametrize("seed", range(3))
def test_joins_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    spans = [*random_ranges(rnd, 60), ("a", None, 3, 900), ("a", 3, None, 901), (None, 0, 9, 902)]
    points = [(rnd.choice("abc"), rnd.randint(-60, 90), i) for i in range(80)] + [("a", None, 80), (None, 3, 81)]
    pts, rng = spark.createDataFrame(points, "k string, at long, p int"), spark.createDataFrame(spans, RANGES)
    within = lambda k, x, r: k is not None and k == r[0] and None not in (x, r[1], r[2]) and r[1] <= x <= r[2]
    got = sorted((r["p"], r["id"]) for r in intervals.stab(pts, rng, ["k"], "at", "s", "e").collect())
    assert got == sorted((p, r[3]) for k, x, p in points for r in spans if within(k, x, r))
    best = {(r["k"], r["at"]): r["m"] for r in intervals.best_around(pts, rng, ["k"], "at", "s", "e", F.col("id"), "m").collect()}
    assert best == {(k, x): min(ids) for k, x, _ in points if (ids := [r[3] for r in spans if within(k, x, r)])}
    top = {(r["k"], r["s"], r["e"]): r["p"] for r in intervals.over_range(rng, pts, ["k"], "at", "s", "e", "p").collect()}
    assert top == {r[:3]: max(ps) for r in spans if (ps := [p for k, x, p in points if within(k, x, r)])}


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(5)
    a, b = random_ranges(rnd, 70), random_ranges(rnd, 70)
    left = spark.createDataFrame(a, "k string, start long, end long, id int")
    right = spark.createDataFrame(b, "k string, start long, end long, other int")
    got = sorted((r["id"], r["other"], r["other_start"], r["other_end"]) for r in intervals.overlapping(left, right, ["k"]).collect())
    assert got == sorted((x[3], y[3], y[1], y[2]) for x in a for y in b if x[0] == y[0] and max(x[1], y[1]) <= min(x[2], y[2]))


def test_coverage_equals_brute_force(spark):
    rnd = random.Random(8)
    reads = []
    for i in range(150):
        s = rnd.randint(1, 60)
        reads.append((rnd.choice("xy"), rnd.randint(1, 90), rnd.choice("pq"), s, s + rnd.choice([0, 1, 3, 9, 40])))
    reads = sorted(set(reads))
    df = spark.createDataFrame(reads, "session string, sequence int, path string, start int, end int")
    got = {tuple(r)[:5]: r["covered"] for r in sessions.redundant_reads(df).collect()}
    for x in reads:
        before = {n for y in reads if (y[0], y[2]) == (x[0], x[2]) and y[1] < x[1] for n in range(y[3], y[4] + 1)}
        assert got[x] == set(range(x[3], x[4] + 1)).issubset(before), x


def test_coverage_of_huge_ranges(spark):
    big = 10**12
    rows = [("s", 1, "p", 1, big), ("s", 2, "p", big + 1, 2 * big), ("s", 3, "p", 5, 2 * big), ("s", 4, "p", 5, 2 * big + 1), ("s", 5, "p", 0, 0)]
    df = spark.createDataFrame(rows, "session string, sequence int, path string, start long, end long")
    assert {r["sequence"]: r["covered"] for r in sessions.redundant_reads(df).collect()} == {1: False, 2: False, 3: True, 4: False, 5: False}
    nodes = intervals.range_nodes(df, "start", "end").groupBy("sequence").count().agg(F.max("count")).head()[0]
    assert nodes <= 2 * 42  # two a doubling


def test_a_crowded_key_makes_no_more_than_the_result(spark):
    n = 200_000  # pairs of equal key: 4 * 10^10
    spans = spark.range(n).select(F.lit("f").alias("path"), (F.col("id") * 10).alias("line"), (F.col("id") * 10 + 3).alias("end_line"), F.concat(F.lit("d"), F.col("id")).alias("name"))
    points = spark.range(n).select(F.lit("f").alias("path"), (F.col("id") * 10 + F.col("id") % 8).alias("line"))
    found = graph.locate(points, spans, ["path"])
    assert found.where("span_name IS NOT NULL").count() == n // 2 and found.count() == n
    pairs = intervals.stab(points.withColumnRenamed("line", "at"), spans, ["path"], "at", "line", "end_line")
    assert pairs.count() == n // 2


def test_deep_nesting_makes_no_pairs(spark):
    n = 30_000  # every point lies in half of the spans on average: 4.5 * 10^8 pairs
    spans = spark.range(n).select(F.lit("f").alias("path"), F.col("id").alias("line"), (2 * n - F.col("id")).alias("end_line"), F.col("id").cast("string").alias("name"))
    points = spark.range(n).select(F.lit("f").alias("path"), F.col("id").alias("line"))
    found = graph.locate(points, spans, ["path"]).where("span_name = CAST(line AS STRING)")
    assert found.count() == n


def test_calls_inside_spans(spark):
    symbols = spark.createDataFrame([("a", "outer", 1, 20), ("a", "inner", 5, 9), ("a", "bare", 30, 30), ("b", "outer", 1, 20)], "path string, name string, line int, end_line int")
    calls = [("a", 6, "x"), ("a", 6, "x"), ("a", 9, "y"), ("a", 12, "x"), ("a", 25, "z"), ("b", 40, "x")]
    refs = spark.createDataFrame(calls, "path string, line int, name string").withColumn("kind", F.lit("call"))
    got = {(r["path"], r["name"]): (r["calls"], r["names"]) for r in graph.calls_within(symbols, refs).collect()}
    assert got == {("a", "outer"): (4, ["x", "y"]), ("a", "inner"): (3, ["x", "y"]), ("a", "bare"): (0, []), ("b", "outer"): (0, [])}
    among = graph.calls_among(symbols, refs, spark.createDataFrame([("y",), ("z",)], "name string"))
    assert sorted((r["name"], r["called"]) for r in among.collect()) == [("inner", "y"), ("outer", "y")]
