"""Exact medians against sorted lists, in groups of any shape."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import measures
from lexforge.operators.selection import attach, exact_medians, with_medians


def middle(values):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    return v[(len(v) - 1) // 2], v[len(v) // 2]


@pytest.mark.parametrize("seed", range(3))
def test_medians_equal_sorted_lists(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in [None, "a", "b", "c", "d", "e"]:
        make = {"a": lambda: rnd.gauss(0, 1), "b": lambda: float(rnd.randint(0, 2)), "c": lambda: 10.0 ** rnd.randint(-300, 300), "d": lambda: 7.0}.get(k, lambda: rnd.choice([-1.0, 1e18, float("inf"), 0.0]))
        rows += [(k, make() if rnd.random() < 0.9 else None) for _ in range(rnd.choice([1, 2, 3, 50, 3000]))]
    rows += [("nulls", None)] * 5
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: (r["n"], r["lower"], r["upper"]) for r in exact_medians(df, ["k"], "v").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: (len(v), *middle(v)) for k, v in groups.items()}
    summary = df.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.median("v").alias("m"))
    out = with_medians(summary, df, ["k"], {"median": "v", "negative": -F.col("v")})
    for r in out.collect():
        assert r["m"] is None and r["median"] is None or r["median"] == pytest.approx(r["m"])
        assert r["median"] is None or r["negative"] == -r["median"]


def test_medians_of_a_large_group(spark):
    n = 2_000_001
    df = spark.range(n).select(((F.col("id") * 48_271) % n).cast("double").alias("v"), F.lit(1).alias("k"))
    found = exact_medians(df, ["k"], "v")
    assert [tuple(r) for r in found.collect()] == [(1, n, 1_000_000.0, 1_000_000.0, 1_000_000.0)]
    same = df.select("k", F.when(F.col("v") < 10, -1).otherwise(5).alias("v"))  # one value crowds the bracket: one row
    assert [r["median"] for r in exact_medians(same, ["k"], "v").collect()] == [5.0]


def test_no_groups_and_no_values(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (float("nan"),)], "v double")
    (row,) = exact_medians(df, [], "v").collect()
    assert (row["n"], row["lower"], row["upper"]) == (3, 4.0, 4.0)  # NaN is the largest
    assert exact_medians(df.where("v > 1e9 AND v < 2e9"), [], "v").count() == 0
    told = measures.distribution(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, v double"), ["k"], "v", total=True)
    assert {tuple(r[c] for c in ("k", "n", "mean", "median", "min", "max", "sum")) for r in told.collect()} == {("a", 2, 1.5, 1.5, 1.0, 2.0, 3.0), ("b", 0, None, None, None, None, None)}
    up = measures.upper_median(spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("a", 5)], "k string, v int"), ["k"], "v")
    assert [tuple(r) for r in up.collect()] == [("a", 5)]


def test_attach_splits_hot_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, "hot").when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = {(r["id"], r["top"]) for r in rows.join(groups, rows["k"].eqNullSafe(groups["k"])).collect()}
    assert {(r["id"], r["top"]) for r in attach(rows, groups, ["k"], "n").collect()} == want


def test_page_cut_equals_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 9), rnd.choice("abcd"), n, rnd.randint(1, n)) for n in (rnd.randint(1, 30) for _ in range(200))]
    fractions = (0.9, 0.5, 0.1)
    got = {(r["fraction"], r["questions"], r["any_lost"], r["all_lost"]) for r in measures.page_cut(spark.createDataFrame(rows, "question int, identity string, page_rows int, position int"), fractions).collect()}
    want = set()
    for f in fractions:
        alive = {}
        for q, i, n, p in rows:
            alive.setdefault(q, {}).setdefault(i, []).append(p <= max(1, round(n * f)))
        lost = [[not any(v) for v in own.values()] for own in alive.values()]
        want.add((f, len(lost), sum(map(any, lost)), sum(map(all, lost))))
    assert got == want
