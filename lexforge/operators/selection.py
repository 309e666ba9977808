"""Exact medians of groups of any size, in bounded memory.

A first pass brackets the middle of every group between two approximate percentiles, whose error in rank is bounded
(``_ACCURACY``); a second pass counts what lies below the bracket and, value by value, what lies inside it, and the ranks in the
middle are looked up there.  Inside are some ``2 * _MARGIN`` of a group's distinct values, so no task holds a group; equal values
are one row.  Should a bracket miss the middle, the job fails rather than give another value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks around the middle that the bracket takes in, as a share of the group, and the percentiles' accuracy (1 / error).
_MARGIN, _ACCURACY = 0.001, 10_000
#: A group with more than one row in so many is hot.
_HOT = 1024


def _same(left: str, right: str, by: list[str]) -> Column:
    tests = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by]
    return reduce(Column.__and__, tests, F.lit(True))


def attach(rows: DataFrame, groups: DataFrame, by: list[str], size: str) -> DataFrame:
    """``rows`` with the further columns of their group's row, no group meeting in one task.

    ``groups`` has one row a group, ``size`` counts its rows.  Groups of more than one row in ``_HOT``, fewer than that in
    number, are broadcast; the others join by their key.  Nulls are a key like others.
    """
    more = [c for c in groups.columns if c not in by]
    total = groups.agg(F.sum(size).alias("__total"))
    sized = groups.join(F.broadcast(total), F.lit(True))  # one row
    hot = sized.where(F.col(size) * _HOT > F.col("__total")).drop("__total")
    rest = sized.where(F.col(size) * _HOT <= F.col("__total")).drop("__total")
    marked = rows.alias("r").join(F.broadcast(hot).alias("h"), _same("r", "h", by), "left")
    known = marked.where(F.col(f"h.{size}").isNotNull()).select("r.*", *[f"h.{c}" for c in more])
    other = marked.where(F.col(f"h.{size}").isNull()).select("r.*").alias("r").join(rest.alias("g"), _same("r", "g", by))
    return known.unionByName(other.select("r.*", *[f"g.{c}" for c in more]))


def exact_medians(rows: DataFrame, by: list[str], value: Column | str) -> DataFrame:
    """(by, n, lower, upper, median) of the values that aren't null: the two in the middle (one twice, if n is odd) and their mean.

    Groups without values have no row; NaN counts as the largest value; null keys are groups like others.
    """
    value = F.col(value) if isinstance(value, str) else value
    held = rows.select(*by, value.alias("__value")).where("__value IS NOT NULL")
    # NaN has no place among the sketch's percentiles: infinity stands for it
    near = F.col("__value").cast("double")
    held = held.withColumn("__near", F.when(F.isnan(near), F.lit(float("inf"))).otherwise(near))
    sides = [F.lit(0.5 - _MARGIN), F.lit(0.5 + _MARGIN)]
    bracket = held.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__near", F.array(*sides), F.lit(_ACCURACY)).alias("__sides"))
    bracket = bracket.select(*by, "n", F.col("__sides")[0].alias("__low"), F.col("__sides")[1].alias("__high"))
    marked = attach(held, bracket, by, "n").where(F.col("__near") <= F.col("__high"))
    below = F.col("__near") < F.col("__low")
    counted = marked.groupBy(*by, "n", (~below).alias("__inside"), F.when(~below, F.col("__value")).alias("__value")).agg(F.count(F.lit(1)).alias("__count"))
    running = F.sum("__count").over(Window.partitionBy(*by).orderBy("__inside", "__value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("__upto", running)
    at = lambda rank: F.min(F.when(F.col("__upto") >= rank, F.struct("__inside", "__value")))
    found = placed.groupBy(*by, "n").agg(at(F.floor((F.col("n") + 1) / 2)).alias("__l"), at(F.floor(F.col("n") / 2) + 1).alias("__u"))
    checked = F.when(F.col("__l.__inside") & F.col("__u.__inside"), F.col("__l.__value")).otherwise(F.raise_error(F.lit("a bracket missed its median")).cast("double"))
    mean = (F.col("lower").cast("double") + F.col("upper").cast("double")) / 2
    return found.select(*by, "n", checked.alias("lower"), F.col("__u.__value").alias("upper")).withColumn("median", mean)


def with_medians(summary: DataFrame, rows: DataFrame, by: list[str], values: dict[str, Column | str], which: str = "median") -> DataFrame:
    """``summary`` (one row a group) with a column of each name: the exact median of that value, null without values.

    ``which`` may be ``lower`` or ``upper`` instead.
    """
    for name, value in values.items():
        own = exact_medians(rows, by, value).select(*by, F.col(which).alias(name))
        summary = summary.alias("r").join(own.alias("m"), _same("r", "m", by), "left").select("r.*", F.col(f"m.{name}").alias(name))
    return summary
