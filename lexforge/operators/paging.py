"""Pages: bounds, cuts and byte budgets."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Limits of a page.
MAX_LIMIT, MAX_OFFSET, DEFAULT_LIMIT, PAGE_BYTES = 100, 10_000, 20, 64 * 1024

_THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"


@dataclass
class Page:
    results: list[dict]
    has_more: bool = False
    next_offset: int | None = None
    extra: dict = field(default_factory=dict)


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}")
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be 0..{MAX_OFFSET}")


def check_query(query: str) -> None:
    if not query.strip() or len(query.encode()) > 4096:
        raise ValueError("a query has 1..4096 bytes and isn't blank")


def page(df: DataFrame, order: list[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> Page:
    """One page of ``df`` in a total order; one row more is read to tell whether others follow."""
    check_page(limit, offset)
    rows = df.orderBy(*order).offset(offset).limit(limit + 1).collect()
    more = len(rows) > limit
    return Page([plain(r) for r in rows[:limit]], more, offset + limit if more else None)


def plain(row: Row) -> dict:
    """A row as a dictionary without nulls and empty lists."""
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None and v != []}


#: Rows a page can need: those skipped, those shown and one more.
DEEPEST = MAX_OFFSET + MAX_LIMIT + 1


def page_per(df: DataFrame, key: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """For each value of ``key`` rows offset+1..offset+limit+1; column ``place`` counts from 1.

    The selection has two steps: each part of the input keeps its own first offset + limit + 1 rows of a key, and
    only these meet.  Spark does so for ranks up to a threshold, which is raised to the deepest page.
    """
    check_page(limit, offset)
    conf = df.sparkSession.conf
    if int(conf.get(_THRESHOLD)) < DEEPEST:
        conf.set(_THRESHOLD, str(DEEPEST))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = df.withColumn("place", place).where(F.col("place") <= offset + limit + 1)
    return ranked.where(F.col("place") > offset)


def fit(found: Page, offset: int = 0, most: int = PAGE_BYTES) -> Page:
    """The page with as many leading results as fit into ``most`` bytes of JSON, one at least."""
    kept, size = [], 0
    for row in found.results:
        size += len(json.dumps(row, ensure_ascii=False, separators=(",", ":"), default=str).encode()) + 1
        if kept and size > most:
            break
        kept.append(row)
    if len(kept) == len(found.results):
        return found
    return Page(kept, True, offset + len(kept), found.extra)


def within_budget(df: DataFrame, cost: Column, order: list[Column], budget: int, by: list[str] | None = None) -> DataFrame:
    """Leading rows whose running cost stays within the budget (rows after the first overflow go)."""
    window = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(cost).over(window)).where(F.col("running") <= budget)


def uniform(df: DataFrame, columns: list[str]) -> dict:
    """Values that all rows of a page share in ``columns`` (to be hoisted off the rows), else nothing."""
    rows = df.select(*columns).distinct().limit(2).collect()
    return rows[0].asDict() if len(rows) == 1 else {}
