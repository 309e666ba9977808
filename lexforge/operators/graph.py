"""Symbols, callers and multi-hop traces.

Tables: ``symbols(name, kind, path, line, end_line, container, family)`` and ``refs(name, kind, path,
line, column, caller, family)``.  Edges are calls: from a caller's name to the called name.
Namesakes share their edges; results are candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.intervals import best_around, point_nodes, range_nodes
from lexforge.operators.lines import path_order, scope
from lexforge.scratch import discard, materialise, new_folder

#: Rows per relation in an inspection, and caps of caller pages.
RELATION_CAPS = {"definition": 3, "inbound": 6, "outbound": 6, "member": 8}
MAX_DEFINITIONS, MAX_IMPORTS, MAX_RELATIONSHIPS, MAX_ROOTS, MAX_EXAMPLES = 5, 20, 50, 5, 10
MAX_DEPTH, DEFAULT_DEPTH, NEAREST = 5, 3, 5


def find_symbol(symbols: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Definitions of a name within a scope."""
    return symbols.where((F.col("name") == name) & scope(path))


def resolution(candidates: Column) -> Column:
    return F.when(candidates == 0, "unresolved").when(candidates == 1, "unique_name_candidate").otherwise("ambiguous")


def callers(refs: DataFrame, symbols: DataFrame, name: str | None = None, path: str | None = None, include_references: bool = False) -> DataFrame:
    """Call sites with the number of definitions their name may mean, within one language family.

    ``path`` scopes the call sites, not the definitions.  A column ``package`` of both tables, where
    present and not null on a call, narrows the definitions to that folder.
    """
    sites = refs.where(scope(path)) if include_references else refs.where("kind = 'call'").where(scope(path))
    if name is not None:
        sites = sites.where(F.col("name") == name)
    if "package" in refs.columns:
        folder = F.regexp_replace("path", r"/?[^/]*$", "")
        defs = symbols.select("name", "family", folder.alias("def_folder")).groupBy("name", "family", "def_folder").count()
        joined = sites.join(defs, ["name", "family"], "left").withColumn(
            "fits", F.when(F.col("package").isNull() | (F.col("package") == F.col("def_folder")), F.col("count")).otherwise(0)
        )
        found = joined.groupBy(*[sites[c] for c in sites.columns]).agg(F.coalesce(F.sum("fits"), F.lit(0)).alias("candidates"))
    else:
        # definitions are counted before the join: a call site stays one row
        defs = symbols.groupBy("name", "family").agg(F.count(F.lit(1)).alias("candidates"))
        found = sites.join(defs, ["name", "family"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return found.withColumn("resolution", resolution(F.col("candidates")))


def degrees(refs: DataFrame, path: str | None = None) -> DataFrame:
    """name, inbound and outbound: call sites of a name, and calls in bodies of that name, in scope."""
    calls = refs.where("kind = 'call'").where(scope(path))
    into = calls.select("name", F.lit(1).alias("i"), F.lit(0).alias("o"))
    out = calls.where("caller IS NOT NULL").select(F.col("caller").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    return into.unionByName(out).groupBy("name").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))


def orientation(degree: DataFrame, direction: str) -> DataFrame:
    """Names whose asked side is empty while the other isn't: the question may be the wrong way round."""
    asked, other = ("inbound", "outbound") if direction == "callers" else ("outbound", "inbound")
    note = F.when((F.col(asked) == 0) & (F.col(other) > 0), F.lit(f"no {asked} calls, but {other} ones exist"))
    return degree.withColumn("note", note)


def relations(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """name, relation, path, line, other: the one-hop neighbourhood of every name.

    Inbound and outbound rows are distinct per (path, other name), the earliest line of each.
    """
    calls = refs.where("kind = 'call'")
    definition = symbols.select("name", F.lit("definition").alias("relation"), "path", "line", F.col("kind").alias("other"))
    inbound = (
        calls.where("caller IS NOT NULL")
        .groupBy("name", "path", F.col("caller").alias("other"))
        .agg(F.min("line").alias("line"))
        .select("name", F.lit("inbound").alias("relation"), "path", "line", "other")
    )
    outbound = (
        calls.where("caller IS NOT NULL")
        .groupBy(F.col("caller").alias("of"), "path", F.col("name").alias("other"))
        .agg(F.min("line").alias("line"))
        .select(F.col("of").alias("name"), F.lit("outbound").alias("relation"), "path", "line", "other")
    )
    member = symbols.where("container IS NOT NULL").select(
        F.col("container").alias("name"), F.lit("member").alias("relation"), "path", "line", F.col("name").alias("other")
    )
    return definition.unionByName(inbound).unionByName(outbound).unionByName(member)


def inspect(symbols: DataFrame, refs: DataFrame, name: str | None = None, path: str | None = None) -> DataFrame:
    """The first rows of each relation (``RELATION_CAPS``) and the full count beside each."""
    found = relations(symbols, refs).where(scope(path))
    if name is not None:
        found = found.where(F.col("name") == name)
    by = Window.partitionBy("name", "relation")
    caps = F.create_map(*[F.lit(x) for pair in RELATION_CAPS.items() for x in pair])
    placed = found.withColumn("place", F.row_number().over(by.orderBy(path_order(), "line", "other")))
    totals = found.groupBy("name", "relation").agg(F.count(F.lit(1)).alias("total"))
    return placed.where(F.col("place") <= F.element_at(caps, F.col("relation"))).join(totals, ["name", "relation"])


def bucketed_edges(refs: DataFrame, here: str, path: str | None = None) -> tuple[DataFrame, str]:
    """(distinct call edges of a scope, written once in buckets by the end that is expanded; the table's name).

    A join by that end reads the buckets as they lie: the edges don't move again, whatever the number of levels.
    """
    spark = refs.sparkSession
    edges = refs.where("kind = 'call' AND caller IS NOT NULL").where(scope(path))
    edges = edges.select("caller", F.col("name").alias("callee"), "path", "line").distinct()
    folder = new_folder(spark, "edges")
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges.write.bucketBy(buckets, here).sortBy(here).option("path", folder).saveAsTable(name)
    table = spark.table(name)
    table._lexforge_path = folder
    return table, name


def expand(edges: DataFrame, frontier: DataFrame, here: str) -> DataFrame:
    """The edges that leave a frontier (column at)."""
    return edges.join(frontier, edges[here] == frontier["at"], "left_semi")


def trace(refs: DataFrame, root: str, direction: str = "callees", depth: int = DEFAULT_DEPTH, path: str | None = None) -> DataFrame:
    """Edges reachable from a name: depth, caller, callee, path, line; each name is expanded once.

    The edges are written once, in buckets; then there is one join a level, at most five, to which only the
    frontier moves.  Levels and frontiers are written to the shared folder, so none is computed twice.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1..{MAX_DEPTH}")
    if direction not in ("callers", "callees"):
        raise ValueError("direction is 'callers' or 'callees'")
    spark = refs.sparkSession
    here, there = ("caller", "callee") if direction == "callees" else ("callee", "caller")
    edges, name = bucketed_edges(refs, here, path)
    frontier = visited = spark.range(1).select(F.lit(root).alias("at"))
    levels = None
    for level in range(1, depth + 1):
        step = materialise(expand(edges, frontier, here).withColumn("depth", F.lit(level)), "trace-level")
        levels = step if levels is None else levels.unionByName(step)
        if level < depth:
            frontier = materialise(step.select(F.col(there).alias("at")).distinct().join(visited, "at", "left_anti"), "trace-frontier")
            if frontier.isEmpty():
                break
            visited = visited.unionByName(frontier)
    spark.sql(f"DROP TABLE {name}")
    discard(edges)
    return levels.select("depth", "caller", "callee", "path", "line")


#: Characters at the beginning of a name by which names that hold it are found.
_BEGINNING = 3


def _beginning(name: Column) -> Column:
    return F.substring(name, 1, _BEGINNING)


def _grams(name: Column) -> Column:
    """Whatever the beginning of a name inside this one can be: its distinct parts of that length or less."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(name), F.lit(1)))
    parts = F.transform(places, lambda i: F.array(*(F.substring(name, i, F.lit(k)) for k in range(1, _BEGINNING + 1))))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(parts)))


def nearest_names(names: DataFrame, wanted: DataFrame, k: int = NEAREST) -> DataFrame:
    """For each wanted name the closest known names: wanted, name, score, rank.

    Shared tokens count floor(N / df) if they discriminate (df <= 2 or df * 20 <= N); a name that
    contains the other, in any case, counts N more.
    """
    from lexforge.functions.text import concept_tokens

    known = names.select("name").distinct()
    n = known.agg(F.count(F.lit(1)).alias("n"))
    tokens = known.select("name", F.explode(F.array_distinct(concept_tokens(F.col("name")))).alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))  # n is one row
    df = df.where((F.col("df") <= 2) | (F.col("df") * 20 <= F.col("n"))).select("token", F.floor(F.col("n") / F.col("df")).alias("w"))
    asked = wanted.select(F.col("name").alias("wanted")).distinct()
    asked_tokens = asked.select("wanted", F.explode(F.array_distinct(concept_tokens(F.col("wanted")))).alias("token"))
    shared = tokens.join(df, "token").join(asked_tokens, "token").select("wanted", "name", "w")
    # The longer name holds the beginning of the shorter one: equal keys first, then the whole names.
    low_known, low_asked = F.lower("name"), F.lower("wanted")
    around = known.select("name", F.explode(_grams(low_known)).alias("key")).join(asked.select("wanted", _beginning(low_asked).alias("key")), "key")
    within = known.select("name", _beginning(low_known).alias("key")).join(asked.select("wanted", F.explode(_grams(low_asked)).alias("key")), "key")
    held = around.where(F.contains(low_known, low_asked)).union(within.where(F.contains(low_asked, low_known)))
    inside = held.select("wanted", "name").distinct().join(F.broadcast(n))
    both = shared.unionByName(inside.select("wanted", "name", F.col("n").alias("w")))
    scored = both.groupBy("wanted", "name").agg(F.sum("w").alias("score"))
    rank = F.row_number().over(Window.partitionBy("wanted").orderBy(F.desc("score"), "name"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def file_relationships(refs: DataFrame, symbols: DataFrame, name: str, imports: DataFrame | None = None) -> DataFrame:
    """Files that call a name against files that define it (the first five), and their imports' candidates."""
    calls = refs.where((F.col("name") == name) & (F.col("kind") == "call")).select("path").distinct()
    defs = symbols.where(F.col("name") == name).orderBy(path_order(), "line").limit(MAX_DEFINITIONS)
    defs = defs.select(F.col("path").alias("target")).distinct()
    found = calls.join(F.broadcast(defs), F.col("path") != F.col("target")).withColumn("kind", F.lit("name_reference"))  # five rows at most
    if imports is not None:
        named = imports.join(calls, "path", "left_semi").select("path", F.explode("candidate_files").alias("target"))
        found = found.unionByName(named.withColumn("kind", F.lit("import")))
    return found.distinct().orderBy("path", "target", "kind").limit(MAX_RELATIONSHIPS)


def page_imports(imports: DataFrame, paths: DataFrame, most: int = MAX_IMPORTS) -> DataFrame:
    """The first imports of a page's files, by path and line, each with ``more``: whether the page has others.

    ``imports``: path, line, statement, ...; ``paths``: path.  One row over the limit is looked for, no more.
    """
    order = [path_order(), F.col("line"), F.col("statement")]
    found = imports.join(paths.select("path").distinct(), "path", "left_semi").orderBy(*order).limit(most + 1)
    placed = found.withColumn("__place", F.row_number().over(Window.orderBy(*order)))  # most + 1 rows
    more = placed.agg((F.count(F.lit(1)) > most).alias("more"))
    return placed.where(F.col("__place") <= most).drop("__place").join(F.broadcast(more), F.lit(True))  # one row


def locate(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "line") -> DataFrame:
    """Each point with the innermost span around it: shortest first, then by name; null without one.

    Spans are aggregated per dyadic node before they meet the points, so deep nesting makes no pairs.
    """
    inner = spans.select(*keys, F.col("name").alias("span_name"), F.col("line").alias("span_line"), F.col("end_line").alias("span_end"))
    shortest = F.struct((F.col("span_end") - F.col("span_line")).alias("size"), "span_name", "span_line", "span_end")
    best = best_around(points, inner, keys, at, "span_line", "span_end", shortest, "s")
    return points.join(best, [*keys, at], "left").select(*points.columns, "s.span_name", "s.span_line", "s.span_end")


def _calls_inside(symbols: DataFrame, sites: DataFrame) -> DataFrame:
    """path, name, line, end_line, called, calls: the names called inside each span, with the number of sites.

    Sites of one name are counted per dyadic node before they meet the spans.
    """
    own = symbols.select("path", "name", "line", "end_line").distinct()
    nodes = point_nodes(sites, "at", own, "line", "end_line").groupBy("path", "level", "node", "called").agg(F.count(F.lit(1)).alias("n"))
    met = range_nodes(own, "line", "end_line").join(nodes, ["path", "level", "node"])
    return met.groupBy("path", "name", "line", "end_line", "called").agg(F.sum("n").alias("calls"))


def calls_within(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Definitions with the number of call sites inside their span, and the distinct names called."""
    sites = refs.where("kind = 'call'").select("path", F.col("line").alias("at"), F.col("name").alias("called"))
    spans = ["path", "name", "line", "end_line"]
    found = _calls_inside(symbols, sites).groupBy(*spans).agg(F.sum("calls").alias("calls"), F.array_sort(F.collect_set("called")).alias("names"))
    every = symbols.select(*spans).distinct().join(found, spans, "left")
    return every.select(*spans, F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def calls_among(symbols: DataFrame, refs: DataFrame, names: DataFrame) -> DataFrame:
    """Which of some names (column name) each definition's body calls: path, name, line, end_line, called."""
    wanted = names.select(F.col("name").alias("called")).distinct()
    sites = refs.where("kind = 'call'").select("path", F.col("line").alias("at"), F.col("name").alias("called")).join(wanted, "called", "left_semi")
    return _calls_inside(symbols, sites).drop("calls")


def coverage(files: DataFrame, skipped: DataFrame, budget_files: int = 20_000) -> DataFrame:
    """What an answer rests on: files parsed, skipped by reason, examples, whether a budget cut it."""
    parsed = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    lost = skipped.agg(
        F.count(F.lit(1)).alias("skipped"),
        F.count_if(F.col("reason") == "too_large").alias("too_large"),
        F.count_if(F.col("reason") == "not_text").alias("not_text"),
    )
    few = skipped.select("path").distinct().orderBy("path").limit(MAX_EXAMPLES).agg(F.array_sort(F.collect_list("path")).alias("examples"))
    lost = lost.join(F.broadcast(few))
    return parsed.join(F.broadcast(lost)).withColumn("budget_truncated", F.col("files") > budget_files)  # both are one row
