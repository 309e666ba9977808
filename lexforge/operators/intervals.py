"""Joins of points and ranges by equal keys, at a cost that follows the result.

A range of whole numbers is cut into its dyadic nodes: blocks [k 2^level, (k+1) 2^level), at most two
a level, that cover it exactly once.  A position lies in one node of each level.  So a range holds a position
where a node of the one equals a node of the other, in exactly one place: the join is an equi-join on (keys, level,
node) that makes the pairs asked for and no others, however many ranges and positions share a key.  Where only a
minimum or maximum over the pairs is asked for, nodes are aggregated before they meet, and no pairs are made at all.

Ranges are inclusive; one that ends before it starts holds nothing; null bounds and positions match nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of nodes that a range can need: its width has 63 bits at most.
_LEVELS = 62


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by.cast("int"))


def _nodes(start: Column, end: Column) -> Column:
    """array<struct<level, node>>: the dyadic nodes that cover start..end."""
    start, stop = start.cast("long"), end.cast("long") + 1
    top = F.least(F.lit(_LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(stop - start, F.lit(1)).cast("double"))).cast("int")))

    def of_level(level: Column) -> Column:
        left, right = -_shift(-start, level), _shift(stop, level)
        open_ = left < right
        # an odd left end and an odd right end can't be part of a block of the next level
        first = F.when(open_ & (F.pmod(left, F.lit(2)) == 1), left)
        last = F.when(open_ & (F.pmod(right, F.lit(2)) == 1), right - 1)
        found = F.array(F.struct(level.alias("level"), first.alias("node")), F.struct(level.alias("level"), last.alias("node")))
        return F.filter(found, lambda n: n["node"].isNotNull())

    return F.when(stop > start, F.flatten(F.transform(F.sequence(F.lit(0), top), of_level)))


def range_nodes(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """``ranges`` with a row for each dyadic node: columns level and node."""
    return ranges.withColumn("__n", F.explode(_nodes(F.col(start), F.col(end)))).select(*ranges.columns, F.col("__n.level").alias("level"), F.col("__n.node").alias("node"))


def point_nodes(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """``points`` with a row for each level that the widest of ``ranges`` can need: columns level and node."""
    width = F.col(end).cast("long") - F.col(start).cast("long") + 1
    top = ranges.agg(F.least(F.lit(_LEVELS), F.ceil(F.log2(F.greatest(F.max(width), F.lit(1)).cast("double"))).cast("int")).alias("__top"))
    leveled = points.where(F.col(at).isNotNull()).join(F.broadcast(top), F.lit(True))  # one row
    leveled = leveled.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("__top")))).drop("__top")
    return leveled.withColumn("node", _shift(F.col(at).cast("long"), F.col("level")))


def stab(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each point with each range around it, on equal keys: the columns of both, each pair once.

    Apart from ``keys`` the tables have different column names.
    """
    placed = point_nodes(points, at, ranges, start, end)
    return placed.join(range_nodes(ranges, start, end), [*keys, "level", "node"]).drop("level", "node")


def best_around(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, value: Column, name: str, most: Callable = F.min) -> DataFrame:
    """(keys, at, name): for each distinct position the least (or greatest) ``value`` of the ranges around it.

    Positions outside all ranges don't appear.
    """
    where = points.select(*keys, at).distinct()
    nodes = range_nodes(ranges, start, end).groupBy(*keys, "level", "node").agg(most(value).alias(name))
    met = point_nodes(where, at, ranges, start, end).join(nodes, [*keys, "level", "node"])
    return met.groupBy(*keys, at).agg(most(name).alias(name))


def over_range(ranges: DataFrame, points: DataFrame, keys: list[str], at: str, start: str, end: str, value: str, most: Callable = F.max) -> DataFrame:
    """(keys, start, end, value): for each distinct range the greatest (or least) value of the points inside it."""
    own = ranges.select(*keys, start, end).distinct()
    nodes = point_nodes(points, at, own, start, end).groupBy(*keys, "level", "node").agg(most(value).alias(value))
    return range_nodes(own, start, end).join(nodes, [*keys, "level", "node"]).groupBy(*keys, start, end).agg(most(value).alias(value))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", prefix: str = "other_") -> DataFrame:
    """Pairs of ranges with equal keys that share a position, each once; the bounds of ``right`` get the prefix.

    Either the right one starts inside the left one, or the left one starts inside the right one, after its start.
    """
    other = right.withColumnsRenamed({start: prefix + start, end: prefix + end}).where(F.col(prefix + end) >= F.col(prefix + start))
    own = left.where(F.col(end) >= F.col(start))
    columns = [*left.columns, *[c for c in other.columns if c not in keys]]
    starts_inside = stab(other, own, keys, prefix + start, start, end)
    after = other.withColumn("__after", F.col(prefix + start) + 1)
    holds_start = stab(own, after, keys, start, "__after", prefix + end)
    return starts_inside.select(*columns).unionByName(holds_start.select(*columns))


def covered_before(ranges: DataFrame, keys: list[str], order: str, start: str = "start", end: str = "end") -> DataFrame:
    """``ranges`` and ``covered``: whether those of equal keys and smaller ``order`` cover the range together.

    Only places where some range starts, or ends just before, can be the first that is not covered.  Each such place knows
    the smallest order of the ranges around it; a range is covered if the greatest of those inside it is smaller than its own.
    """
    own = ranges.where(F.col(end) >= F.col(start))
    edges = own.select(*keys, F.explode(F.array(F.col(start).cast("long"), F.col(end).cast("long") + 1)).alias("__at"))
    first = best_around(edges, own.select(*keys, start, end, order), keys, "__at", start, end, F.col(order), "__first")
    last = over_range(own, first, keys, "__at", start, end, "__first")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in [*keys, start, end]]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = ranges.alias("r").join(last.alias("l"), condition, "left")
    return joined.select("r.*", F.coalesce(F.col("l.__first") < F.col(f"r.{order}"), F.lit(False)).alias("covered"))
