"""Connected components of a table of links, by alternating star contractions.

Each round points every node at the smallest node it knows of and re-links its neighbours to that
one; links halve in depth, so a chain of n nodes takes about log n rounds.  Rounds are written to the
shared folder, and only their counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm._hits import hit_filter, split
from lexforge.llm._store import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of each linked node; root is the smallest node of its component.

    Null ends and self links are dropped; repeated links count once; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct()
    edges = materialise(edges, "links")
    while True:
        # Large star: everyone larger than a node links to the smallest that the node knows.
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # A node that points nowhere knows of none smaller: its links stay as they are, and the many
        # links of a hub at the centre of a star need no join.
        inner, outer = split(edges, "u", hit_filter(edges.select("v"), "v"))
        large = (
            inner.join(least.withColumnRenamed("v", "u"), "u")  # for u < v: v links to the least of u
            .select("v", F.col("m").alias("u"))
            .unionByName(outer.select("v", "u"))
            .unionByName(least.select("v", F.col("m").alias("u")))
            .where("u < v")
            .distinct()
        )
        # Small star: what a node points at is linked to the smallest of it.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
            .where("u < v")
            .distinct()
        )
        after = materialise(small, "links")
        # Done when every node that is pointed at points nowhere, and each points at one.
        deep = after.select(F.col("u").alias("v")).distinct().join(after.select("v").distinct(), "v", "left_semi")
        several = after.groupBy("v").count().where("count > 1").select("v")
        edges = after
        if deep.unionByName(several).isEmpty():
            break
    roots = edges.select("u").distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        roots.select(F.col("u").alias("node"), F.col("u").alias("root"))
    )
