"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Every document is logged (identifier, digest) and falls into a memtable of about ``memtable_rows``
rows.  A memtable is flushed as a run: a file set of its own with one entry per digest, sorted by
digest.  Compaction merges ``fan_in`` sorted runs into one of the next level, and so on until one run
is left; an entry keeps, for its digest, the surviving identifier and the number of rows.

The runs' filters decide what has to be compacted.  A filter holds the slots (64-bit hashes) of a
run's digests; slots that stand in one filter only belong to digests that no other run has, so these
entries are final as they were flushed.  Entries with contested slots alone are merged further.

Digests with several rows are hits.  A bitmap filter of checked size, broadcast to the scan, lets only
their texts move, and these are compared byte by byte: the smallest and the largest text of a digest
are one string, or the digest has failed.  Digests that fail (collisions) are grouped by the text itself.

A hot group never meets in one task: texts and entries are aggregated before each shuffle, a merge
gets at most ``fan_in`` entries of a digest, and the log is joined through its runs, of which each
holds at most ``memtable_rows`` of a group's rows.

Defined results: a null text counts as empty; a null identifier loses against any other; rows that
repeat an identifier each count, and each of them is kept if it carries the identifier that stays
and a text of that group; an empty table gives an empty result; further input columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm._hits import hit_filter, split
from lexforge.llm._store import materialise


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Texts of ASCII alone take the faster built-in."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _normal_text(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _normal(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    norm = docs.select(
        F.col(id_col).cast("long").alias("id"),
        _normal_text(text_col).alias("norm"),
    )
    sha = F.unhex(F.sha2("norm", 256))
    return norm.withColumn("sha", sha).withColumn("digest", F.substring("sha", 1, digest_bytes))


def _compacted(runs: DataFrame, tables: int, fan_in: int, best: Callable[[str], Column]) -> DataFrame:
    """(digest, keep_id, group_size) of the digests with several rows, from the runs of level 0."""
    slots = runs.groupBy(F.xxhash64("digest").alias("slot")).agg(F.count(F.lit(1)).alias("filters"))
    contested = materialise(slots.where("filters > 1").select("slot"), "dedup-contested")
    open_, final = split(runs.withColumn("slot", F.xxhash64("digest")), "slot", hit_filter(contested, "slot"))
    columns = ["digest", "keep_id", "group_size"]
    level, buckets = open_.select(*columns, "run"), 1
    while tables > 1:
        tables, buckets = math.ceil(tables / fan_in), buckets * fan_in
        # a run grows with its level, so it is dealt into as many files of the first run's size
        dealt = level.withColumn("run", F.floor(F.col("run") / fan_in)).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
        merged = (
            dealt.repartition("run", "bucket")
            .groupBy("run", "bucket", "digest")
            .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
        level = materialise(merged.drop("bucket").sortWithinPartitions("run", "digest"), "dedup-level", by=["run"])
    return materialise(level.select(*columns).unionByName(final.select(*columns)).where("group_size > 1"), "dedup-several")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    memtable_rows: int = 16384,
    fan_in: int = 16,
    digest_bytes: int = 32,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``keep`` says whether the smallest or the largest identifier of a group stays.
    ``digest_bytes`` shortens the index key; results don't depend on it, as hits are verified.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.max if keep == "largest" else F.min
    rows = _normal(docs, id_col, text_col, digest_bytes)
    tables = max(1, math.ceil(docs.count() / memtable_rows))
    log = materialise(
        rows.select("id", "sha", "digest", F.pmod(F.xxhash64("id", "digest"), F.lit(tables)).alias("run")), "dedup-log"
    )
    flushed = log.groupBy("run", "digest").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    runs = materialise(flushed.repartition(F.col("run")).sortWithinPartitions("run", "digest"), "dedup-run", by=["run"])
    several = _compacted(runs, tables, fan_in, best)
    entries = materialise(
        runs.select("digest", "run").join(several, "digest").select("digest", "run", "keep_id", "group_size"), "dedup-entries"
    )

    # Hits get byte verification.
    hits, _ = split(rows.select("norm", "digest"), "digest", hit_filter(several, "digest"))
    extremes = hits.groupBy("digest").agg(F.min("norm").alias("first"), F.max("norm").alias("last")).where("first <> last")
    # a digest of one row that the filter let pass has one text, and so never fails
    failed = materialise(extremes.select("digest"), "dedup-failed")
    found = (
        log.join(entries, ["digest", "run"], "left")
        .select(
            "id",
            F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            "sha",
            "digest",
        )
    )
    if not failed.isEmpty():
        apart = rows.join(failed, "digest", "left_semi")
        by_text = apart.groupBy("norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.join(failed, "digest", "left_anti").unionByName(
            apart.join(by_text, "norm").select("id", "keep_id", "group_size", "sha", "digest")
        )
    return found.select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_groups(docs, id_col, text_col, keep).where("kept").select("id", F.unhex("text_sha256").alias("sha")).distinct()
    # rows that repeat an identifier are told apart by their digest
    own = _normal_text(text_col)
    # the row travels as one column, so that its names clash with none of those used here
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(own, 256)).alias("sha"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.sha") == F.col("k.sha"))
    found = rows.alias("d").join(kept.alias("k"), same, "left_semi")
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
