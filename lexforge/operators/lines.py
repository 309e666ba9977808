"""Files as lines: exact search and bounded reads."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import snippet as snippet_at
from lexforge.functions.text import split_lines
from lexforge.operators.paging import check_query, page_per, within_budget

#: Bounds of a read.
READ_DEFAULT_LINES, READ_MAX_LINES, READ_BYTES, READ_LINE_COST = 100, 500, 32 * 1024, 64
MAX_PATTERNS = 8
#: Lines of a ranked region, and characters of its excerpt.
REGION_LINES, REGION_CHARS = 500, 500
#: Syntax of Java's expressions that linear-time engines don't have.
_REJECTED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|[*+?}]\+|\\k<")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of every line of ``files(path, text)``."""
    return files.select("path", F.posexplode(split_lines(F.col("text"))).alias("at", "text")).select(
        "path", (F.col("at") + 1).alias("line"), "text"
    )


def scope(path: str | None, column: Column | None = None) -> Column:
    """A file, or everything below a directory, by whole components; no path is everything."""
    column = F.col("path") if column is None else column
    return F.lit(True) if not path else (column == path) | column.startswith(path.rstrip("/") + "/")


def within(files: DataFrame, path: str | None) -> DataFrame:
    """The files of a scope.  The prefix is said apart, since sources can take that, but no choice of two tests."""
    return files.where(F.col("path").startswith(path.rstrip("/"))).where(scope(path)) if path else files


def path_order(column: str = "path") -> Column:
    """Paths ordered component by component."""
    return F.split(F.col(column), "/")


def match(text: Column, pattern: str, regex: bool = False, case_sensitive: bool = True) -> Column:
    check_query(pattern)
    if regex:
        if _REJECTED.search(pattern):
            raise ValueError("look-around, back references and possessive quantifiers aren't supported")
        return text.rlike(pattern if case_sensitive else "(?iu)" + pattern)
    if case_sensitive:
        return F.contains(text, F.lit(pattern))
    return text.rlike("(?iu)" + re.escape(pattern))


def exact_matches(
    files: DataFrame, patterns: list[str], path: str | None = None, regex: bool = False, case_sensitive: bool = True
) -> DataFrame:
    """Matching lines (not occurrences): pattern, path, line, text.  One scan serves all patterns."""
    if not 1 <= len(patterns) <= MAX_PATTERNS:
        raise ValueError(f"1..{MAX_PATTERNS} patterns")
    text = F.col("text")
    tests = [match(text, p, regex, case_sensitive) for p in patterns]
    some = reduce(Column.__or__, tests)
    # a binary file ends at its first NUL; a file without any of the patterns makes no lines at all
    kept = files.where(scope(path)).withColumn("text", F.substring_index("text", "\0", 1))
    if not regex and case_sensitive:
        kept = kept.where(some)
    found = lines(kept).where(some)
    if len(patterns) == 1:
        return found.select(F.lit(patterns[0]).alias("pattern"), "path", "line", "text")
    # lines that hold any of the patterns, by far the fewest, are asked for each
    hits = F.array_compact(F.array(*[F.when(test, F.lit(p)) for p, test in zip(patterns, tests)]))
    return found.select(F.explode(hits).alias("pattern"), "path", "line", "text")


def snippet(pattern: str, regex: bool = False, case_sensitive: bool = True, text: str = "text") -> Column:
    """struct(snippet, truncated) around the first match of a pattern in a line that it matches."""
    expression = pattern if regex else re.escape(pattern)
    at = F.regexp_instr(F.col(text), F.lit(expression if case_sensitive else "(?iu)" + expression))
    return snippet_at(F.col(text), F.greatest(at - 1, F.lit(0)))


def search_exact(
    files: DataFrame,
    patterns: list[str],
    path: str | None = None,
    regex: bool = False,
    case_sensitive: bool = True,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """A page of matches for each pattern: pattern, path, line, snippet, truncated, place; one row over the limit tells of more."""
    found = exact_matches(files, patterns, path, regex, case_sensitive)
    cut = page_per(found, "pattern", [path_order(), F.col("line")], limit, offset)
    # snippets are cut for the rows of the pages only
    around = F.coalesce(*[F.when(F.col("pattern") == p, snippet(p, regex, case_sensitive)) for p in patterns])
    return cut.select("pattern", "path", "line", around.alias("s"), "place").select("pattern", "path", "line", "s.snippet", "s.truncated", "place")


def files_searched(files: DataFrame, path: str | None = None) -> DataFrame:
    """How many files a search walks, whatever it finds."""
    return files.where(scope(path)).agg(F.count(F.lit(1)).alias("files_searched"))


def read_cost(text: Column) -> Column:
    """Bytes a line costs in a read: its JSON-escaped length and 64."""
    return F.octet_length(F.to_json(F.array(text))) - 4 + READ_LINE_COST


def read_source(files: DataFrame, path: str | None, start: int = 1, end: int | None = None, budget: int | None = READ_BYTES) -> DataFrame:
    """Lines start..end (100 by default, 500 at most) of one file or of each file, as far as the budget goes; without one, all of them."""
    if start < 1 or (end is not None and end < start):
        raise ValueError("lines count from 1 and end doesn't come before start")
    last = min(end if end is not None else start + READ_DEFAULT_LINES - 1, start + READ_MAX_LINES - 1)
    some = lines(files.where(F.col("path") == path) if path else files).where(F.col("line").between(start, last))
    if budget is None:
        return some
    return within_budget(some, read_cost(F.col("text")), [F.col("line")], budget, ["path"]).select("path", "line", "text")


def excerpts(files: DataFrame, regions: DataFrame, chars: int = REGION_CHARS) -> DataFrame:
    """path, start_line, end_line, excerpt, excerpt_truncated of regions: their current lines, cut to ``chars``.

    A region ends 499 lines after its start at the latest.
    """
    clamped = F.least(F.col("end_line"), F.col("start_line") + REGION_LINES - 1)
    wanted = regions.select("path", "start_line", clamped.alias("end_line")).distinct()
    inside = lines(files).join(wanted, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    told = inside.groupBy("path", "start_line", "end_line").agg(body.alias("body"))
    return told.select("path", "start_line", "end_line", F.substring("body", 1, chars).alias("excerpt"), (F.char_length("body") > chars).alias("excerpt_truncated"))


def path_filter(files: DataFrame, include: list[str], exclude: list[str], suffixes: list[str]) -> DataFrame:
    """The cut of a corpus: below any included folder, below no excluded one, with one of the suffixes."""
    inside = F.lit(not include)
    for p in include:
        inside = inside | scope(p)
    for p in exclude:
        inside = inside & ~scope(p)
    ends = F.lit(not suffixes)
    for s in suffixes:
        ends = ends | F.col("path").endswith(s)
    return files.where(inside & ends)


#: Digits of a path's digest that name a node of the fingerprint's tree, from the leaves up.
FINGERPRINT_LEVELS = (6, 4, 2)


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest of all (path, content digest) pairs, whatever order the files come in.

    The digest of a tree: files meet by the first digits of their path's digest, then at most 256 nodes
    meet in one of the level above, so that no row grows with the corpus (some 600 files a leaf at 10^10).
    Null texts count as empty; a repeated path counts as often as it stands there; no files give the
    digest of an empty text.
    """
    merged = F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256)
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    level = files.select(F.sha2("path", 256).alias("node"), F.concat_ws(" ", "path", content).alias("entry"))
    for digits in FINGERPRINT_LEVELS:
        met = level.groupBy(F.substring("node", 1, digits).alias("node")).agg(merged.alias("digest"))
        level = met.select("node", F.concat_ws(" ", "node", "digest").alias("entry"))
    return level.agg(merged.alias("fingerprint"))


def distinct_contents(files: DataFrame) -> DataFrame:
    """Files of which the same content came earlier (by path) dropped; column copies counts them."""
    kept = files.groupBy(F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("bytes"))
    return kept.agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))
