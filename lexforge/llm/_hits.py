"""A bitmap filter that lets only likely members of a key set move.

Its size follows the number of keys, which is counted first, up to ``MOST_BITS`` (64 MB).  Beyond
``MOST_BITS / LEAST_BITS_A_KEY`` keys no filter is made: every row counts as likely, and the join
that follows shuffles all rows once.  A filter never loses a member.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
BITS_A_KEY, LEAST_BITS_A_KEY = 16, 4
_PAGE_BITS = 32768


@dataclass(frozen=True)
class HitFilter:
    """``pages`` holds (__page, __bits), ``bits`` bits in all; None lets everything through."""

    bits: int
    pages: DataFrame | None


def _page(key: Column, bits: int) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.floor(at / _PAGE_BITS).cast("long"), F.pmod(at, F.lit(_PAGE_BITS)).cast("long")


def hit_filter(keys: DataFrame, key: str) -> HitFilter:
    """A filter of the values in column ``key`` of a written table."""
    n = keys.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_A_KEY):
        bits *= 2
    if n * LEAST_BITS_A_KEY > bits:
        return HitFilter(bits, None)
    page, at = _page(F.col(key), bits)
    pages = keys.select(page.alias("__page"), at.alias("__at")).groupBy("__page").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    return HitFilter(bits, pages)


def split(rows: DataFrame, key: str, filter: HitFilter) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a member in column ``key``, rows that surely have none)."""
    if filter.pages is None:
        return rows, rows.where(F.lit(False))
    page, at = _page(F.col(key), filter.bits)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.pmod(F.col("__at"), F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    marked = (
        rows.withColumn("__page", page)
        .withColumn("__at", at)
        .join(F.broadcast(filter.pages), "__page", "left")
        .withColumn("__hit", F.coalesce(hit, F.lit(False)))
        .drop("__page", "__at", "__bits")
    )
    return marked.where("__hit").drop("__hit"), marked.where("NOT __hit").drop("__hit")
