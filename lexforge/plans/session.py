"""The session: seven read-only operations over one source tree, each a page of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions.text import LANGUAGES, boundary_pattern, family, language, scan_tokens
from lexforge.operators import graph, lines, retrieval
from lexforge.operators.intervals import stab
from lexforge.operators.paging import Page, check_page, check_query, fit, page
from lexforge.parse import source
from lexforge.sources.repo import go_module, read_repo, resolve

#: The operations, those on by default, and presets of them.
OPERATIONS = ("search_exact", "read_source", "find_symbol", "find_callers", "inspect_symbol", "trace_dependencies", "search_concept")
DEFAULT = ("search_exact", "read_source", "find_callers", "search_concept")
PROFILES = {
    "A": (),
    "B": ("search_exact", "read_source"),
    "C": ("search_exact", "read_source", "find_symbol", "find_callers", "inspect_symbol", "trace_dependencies"),
    "D": OPERATIONS,
}
#: Chunks are made of definitions but these.
NOT_CHUNKED = ("module", "impl", "namespace")


@dataclass
class Session:
    """Questions about the files below ``root``; every question reads the tree as it is then."""

    spark: SparkSession
    root: str
    no_ignore: bool = False
    enabled: tuple[str, ...] = OPERATIONS
    ranker: str = "lexical"
    semantic: Callable[[DataFrame, str, int], DataFrame] | None = None
    _held: DataFrame | None = field(default=None, init=False, repr=False)

    def files(self, path: str | None = None) -> DataFrame:
        """The files below a path; nothing outside it is opened."""
        found = lines.within(read_repo(self.spark, self.root, no_ignore=self.no_ignore), path)
        return found.select("path", "text", language(F.col("path")).alias("language"), family(F.col("path")).alias("family"))

    def sources(self) -> DataFrame:
        """The files of a known language; no others are opened."""
        found = read_repo(self.spark, self.root, no_ignore=self.no_ignore).where(F.col("suffix").isin(sorted(LANGUAGES)))
        return found.select("path", "text", language(F.col("path")).alias("language"), family(F.col("path")).alias("family"))

    def release(self) -> None:
        """Give back what the last question kept in memory."""
        if self._held is not None:
            self._held.unpersist()
            self._held = None

    def _allowed(self, name: str) -> None:
        if name not in self.enabled:
            raise ValueError(f"{name} isn't enabled")

    def search_exact(self, query: str | None = None, queries: list[str] | None = None, path: str | None = None, regex: bool = False, case_sensitive: bool = True, limit: int = 20, offset: int = 0) -> Page:
        self._allowed("search_exact")
        if (query is None) == (queries is None):
            raise ValueError("give either query or queries")
        patterns = [query] if queries is None else queries
        if path:
            resolve(self.root, path)
        check_page(limit, offset)
        # one job: the files are counted while they are scanned
        walked = Observation()
        files = self.files(path).observe(walked, F.count(F.lit(1)).alias("files_searched"))
        rows = lines.search_exact(files, patterns, None, regex, case_sensitive, limit, offset).collect()
        order = {p: i for i, p in enumerate(patterns)}
        rows.sort(key=lambda r: (order[r["pattern"]], r["place"]))
        more = any(r["place"] > offset + limit for r in rows)
        kept = [{k: r[k] for k in ("pattern", "path", "line", "snippet", "truncated")} for r in rows if r["place"] <= offset + limit]
        return fit(Page(kept, more, offset + limit if more else None, {"files_searched": walked.get["files_searched"]}), offset)

    def read_source(self, path: str, start_line: int = 1, end_line: int | None = None) -> Page:
        self._allowed("read_source")
        resolve(self.root, path)
        files = self.files(path).where(F.col("path") == path)
        total = lines.lines(files).agg(F.max("line")).head()[0]
        if total is None or start_line > total:
            raise ValueError("start is past the end of the file")
        rows = lines.read_source(files, path, start_line, end_line).orderBy("line").collect()
        if not rows:
            raise ValueError("the line is longer than a page")
        last = rows[-1]["line"]
        return Page([{"line": r["line"], "text": r["text"]} for r in rows], last < total, None, {"next_line": last + 1 if last < total else None, "total_lines": total})

    def _parsed(self, pattern: str | None, references: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(files, symbols, refs) of the source files that hold a pattern: the filter comes before the parser."""
        files = self.sources()
        some = files.where(F.col("text").rlike(pattern)) if pattern else files
        self.release()
        rows = self._held = source.parse(some, references).persist()
        return files, source.symbols(rows), source.refs(rows)

    def find_symbol(self, name: str, path: str | None = None, limit: int = 20, offset: int = 0) -> Page:
        self._allowed("find_symbol")
        check_query(name)
        _, symbols, _ = self._parsed(boundary_pattern(name))
        found = page(graph.find_symbol(symbols, name, path), [lines.path_order(), F.col("line"), F.col("id")], limit, offset)
        if not found.results and not offset:
            found.extra["nearest"] = self.suggest(name)
        return found

    def suggest(self, name: str) -> list[str]:
        """The nearest known names, looked for in files that hold any of the name's tokens."""
        tokens = scan_tokens(name)
        if not tokens:
            return []
        near = retrieval.candidate_files(self.sources(), name).select("path")
        rows = source.parse(self.sources().join(F.broadcast(near), "path", "left_semi"))  # 400 paths at most
        asked = self.spark.range(1).select(F.lit(name).alias("name"))
        return [r["name"] for r in graph.nearest_names(source.symbols(rows), asked).orderBy("rank").collect()]

    def find_callers(self, name: str, path: str | None = None, include_references: bool = False, limit: int = 20, offset: int = 0) -> Page:
        self._allowed("find_callers")
        check_query(name)
        files, symbols, refs = self._parsed(boundary_pattern(name), include_references)
        module = go_module(self.files("go.mod"))
        if module:
            rows = source.parse(files.where((F.col("family") == "go") & F.col("text").rlike(boundary_pattern(name))))
            refs = source.go_packages(refs, source.imports(rows, files), module)
        found = page(graph.callers(refs, symbols, name, path, include_references), [lines.path_order(), F.col("line"), F.col("column")], limit, offset)
        for r in found.results:
            r.pop("family", None)
        shared = {k: {r.get(k) for r in found.results} for k in ("resolution", "candidates")}
        for k, values in shared.items():
            if len(values) == 1 and found.results:
                found.extra[k] = values.pop()
                for r in found.results:
                    r.pop(k, None)
        found.extra["relationships"] = [r.asDict() for r in graph.file_relationships(refs, symbols, name).collect()]
        if not found.results and not offset and symbols.where(F.col("name") == name).isEmpty():
            found.extra["nearest"] = self.suggest(name)
        return fit(found, offset)

    def inspect_symbol(self, name: str, path: str | None = None) -> Page:
        self._allowed("inspect_symbol")
        _, symbols, refs = self._parsed(boundary_pattern(name))
        rows = graph.inspect(symbols, refs, name, path).orderBy("relation", "place").collect()
        totals = {r["relation"]: r["total"] for r in rows}
        shown = [{k: r[k] for k in ("relation", "path", "line", "other")} for r in rows]
        counts = {k: sum(r["relation"] == k for r in rows) for k in totals}
        return Page(shown, any(totals[k] > counts[k] for k in totals), None, {"totals": totals})

    def trace_dependencies(self, name: str, direction: str = "callees", depth: int = 3, path: str | None = None, limit: int = 20, offset: int = 0) -> Page:
        self._allowed("trace_dependencies")
        _, _, refs = self._parsed(None)
        edges = graph.trace(refs, name, direction, depth, path)
        found = page(edges, [F.col("depth"), F.col("caller"), F.col("callee"), lines.path_order(), F.col("line")], limit, offset)
        if not found.results:
            note = graph.orientation(graph.degrees(refs, path), direction).where((F.col("name") == name) & F.col("note").isNotNull()).head()
            if note:
                found.extra["note"] = note["note"]
        return fit(found, offset)

    def chunks(self, files: DataFrame) -> DataFrame:
        """doc, path, start_line, end_line, text of every definition with the comment block above it."""
        rows = source.symbols(source.parse(files)).where(~F.col("kind").isin(list(NOT_CHUNKED)))
        # comment lines in a row are an island; what ends right above a definition belongs to it, 30 lines at most
        comment = F.ltrim("code").rlike(r'^(//|/\*|\*|#|""")')
        every = lines.lines(files).select("path", F.col("line").alias("at"), F.col("text").alias("code"))
        island = F.col("at") - F.count_if(comment).over(Window.partitionBy("path").orderBy("at"))
        comments = every.withColumn("island", island).where(comment)
        first = F.min("at").over(Window.partitionBy("path", "island"))
        ends = comments.select("path", (F.col("at") + 1).alias("line"), first.alias("first"))
        placed = rows.join(ends, ["path", "line"], "left").withColumn("first", F.greatest(F.coalesce("first", "line"), F.col("line") - 30))
        spans = placed.select("id", "path", "name", "container", F.col("line").alias("start_line"), "end_line", "first")
        inside = stab(every, spans, ["path"], "at", "first", "end_line")
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "\n")
        grouped = inside.groupBy("id", "path", "name", "container", "start_line", "end_line").agg(body.alias("body"))
        text = F.concat_ws(" ", "path", "container", "name", "body")
        return grouped.select(F.col("id").alias("doc"), "path", "start_line", "end_line", text.alias("text"))

    def search_concept(self, query: str, path: str | None = None, limit: int = 10, offset: int = 0, fields: tuple[str, ...] = ()) -> Page:
        """Definitions by lexical, semantic or fused rank; statistics are those of the candidate files.

        ``fields=("excerpt",)`` adds the beginning of each hit's current text.
        """
        self._allowed("search_concept")
        if set(fields) - {"excerpt"}:
            raise ValueError("the only further field is excerpt")
        check_query(query)
        check_page(limit, offset)
        files = self.sources()
        near = retrieval.candidate_files(files, query).select("path")
        chunks = self.chunks(files.join(F.broadcast(near), "path", "left_semi"))  # 400 paths at most
        ranked = None
        if self.ranker in ("lexical", "hybrid"):
            one = self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"))
            scored = retrieval.bm25(chunks, one).join(chunks.select("doc", "path", "start_line", "end_line"), "doc").where(lines.scope(path))
            ranked = retrieval.top_k(scored, 500, by=None, ties=[lines.path_order(), F.col("start_line")])
        if self.ranker in ("semantic", "hybrid"):
            if self.semantic is None:
                raise ValueError("no semantic ranker is set")
            dense = check_ranking(self.semantic(chunks, query, 500), lines.lines(files), 500)
            if ranked is None:
                ranked = dense
            else:
                fused = retrieval.fuse(dense, ranked, ["path", "start_line"])
                ends = dense.select("path", "start_line", "end_line").unionByName(ranked.select("path", "start_line", "end_line")).groupBy("path", "start_line").agg(F.min("end_line").alias("end_line"))
                ranked = fused.join(ends, ["path", "start_line"])
        end = F.least(F.col("end_line"), F.col("start_line") + lines.REGION_LINES - 1).alias("end_line")
        shown = ranked.select("path", "start_line", end, F.round("score", 6).alias("score"), "rank")
        found = page(shown, [F.col("rank")], limit, offset)
        self._label(found, files)
        if fields:
            self._quote(found, files)
        return fit(found, offset)

    def _label(self, found: Page, files: DataFrame) -> None:
        """Each hit's innermost definition: name and, where it starts elsewhere than the hit, its line."""
        if not found.results:
            return
        hits = self.spark.createDataFrame([(r["path"], int(r["start_line"])) for r in found.results], "path string, line int")
        some = files.join(F.broadcast(hits.select("path").distinct()), "path", "left_semi")  # a page of paths
        named = {(r["path"], r["line"]): r for r in graph.locate(hits.distinct(), source.symbols(source.parse(some)), ["path"]).collect()}
        for r in found.results:
            label = named.get((r["path"], r["start_line"]))
            if label is not None and label["span_name"]:
                r["symbol"] = label["span_name"]
                if label["span_line"] != r["start_line"]:
                    r["symbol_line"] = label["span_line"]

    def _quote(self, found: Page, files: DataFrame) -> None:
        """Each hit's excerpt, from the files as they are."""
        if not found.results:
            return
        regions = self.spark.createDataFrame([(r["path"], int(r["start_line"]), int(r["end_line"])) for r in found.results], "path string, start_line int, end_line int")
        some = files.join(F.broadcast(regions.select("path").distinct()), "path", "left_semi")  # a page of paths
        told = {(r["path"], r["start_line"], r["end_line"]): r for r in lines.excerpts(some, regions).collect()}
        for r in found.results:
            row = told.get((r["path"], r["start_line"], r["end_line"]))
            if row is not None:
                r["excerpt"] = row["excerpt"]
                if row["excerpt_truncated"]:
                    r["excerpt_truncated"] = True

    def locate(self, path: str, line: int) -> dict | None:
        """The innermost definition around a line."""
        rows = source.symbols(source.parse(self.files(path).where(F.col("path") == path)))
        point = self.spark.range(1).select(F.lit(path).alias("path"), F.lit(line).alias("line"))
        row = graph.locate(point, rows, ["path"]).head()
        return row.asDict() if row and row["span_name"] else None


def check_ranking(hits: DataFrame, all_lines: DataFrame, limit: int) -> DataFrame:
    """A pluggable ranker's rows (path, start_line, end_line, score), verified: any bad row fails the whole page."""
    size = all_lines.groupBy("path").agg(F.max("line").alias("total"))
    rows = hits.join(size, "path", "left")
    bad = (
        F.col("total").isNull()
        | F.col("score").isNull()
        | F.isnan("score")
        | (F.abs("score") == float("inf"))
        | (F.col("start_line") < 1)
        | (F.col("end_line") < F.col("start_line"))
        | (F.col("end_line") - F.col("start_line") >= 500)
        | (F.col("end_line") > F.col("total"))
    )
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).head()
    if told["bad"] or told["n"] > limit:
        raise ValueError("the ranker's page isn't valid")
    return retrieval.top_k(rows.drop("total"), limit, by=None, ties=[lines.path_order(), F.col("start_line")])
