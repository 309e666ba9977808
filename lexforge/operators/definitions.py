"""Definitions, their spans, and calls in source text, by column expressions and windows.

This is the independent reading of sources beside the parsers: comments and strings are blanked, lines are matched against the
patterns of their language, and spans follow from indentation (Python) or from matched braces.  Every file is a row until its
lines are taken apart; after that lines of one path and level meet, never a whole file in Python.

Tables: ``files(path, text)`` give ``symbols(path, name, kind, line, end_line, family)`` and ``calls(path, line, name, caller)``.
Files of other languages and null texts give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import family
from lexforge.operators.graph import locate

#: What is blanked: comments and strings of Python, and of the languages with braces.
_HASH = r"#[^\n]*|(?s:\"\"\".*?(?:\"\"\"|\z))|(?s:'''.*?(?:'''|\z))|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_SLASH = r"//[^\n]*|(?s:/\*.*?(?:\*/|\z))|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`?"

#: Per family the lines that define something: (kind or null where the pattern's first group says it, pattern, group of the name).
DEFINES: dict[str, list[tuple[str | None, str, int]]] = {
    "python": [(None, r"^\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", 2)],
    "rust": [(None, r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|default)\s+)*(fn|struct|enum|trait|mod|union)\s+([A-Za-z_]\w*)", 2)],
    "go": [(None, r"^(func)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", 2), (None, r"^(type)\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b", 2)],
    "java": [
        (None, r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)", 2),
        ("method", r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*[A-Za-z_$][\w$<>\[\],.? ]*\s+([A-Za-z_$][\w$]*)\s*\([^;{]*(?:\{|$)", 1),
    ],
    "ecmascript": [
        (None, r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum)\s*\*?\s+([A-Za-z_$][\w$]*)", 2),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)", 1),
        ("method", r"^\s+(?:(?:public|private|protected|static|readonly|async|get|set)\s+)*([A-Za-z_$][\w$]*)\s*\([^;{]*\)\s*(?::[^;{]+)?\{", 1),
    ],
    "c": [
        (None, r"^\s*(?:typedef\s+)?(struct|union|enum|class|namespace)\s+([A-Za-z_]\w*)[^;=()]*\{?\s*$", 2),
        ("function", r"^[A-Za-z_][\w\s*&:<>,~]*?[\s*&]([A-Za-z_~]\w*)\s*\([^;{]*(?:\{|$)", 1),
    ],
}
#: Words before a bracket that call nothing, in any of the languages.
RESERVED = (
    "if", "else", "for", "while", "switch", "match", "return", "catch", "with", "and", "or", "not", "in", "is", "as", "assert", "await", "async", "elif", "except", "lambda", "yield", "def",
    "class", "fn", "func", "function", "new", "sizeof", "typeof", "throw", "synchronized", "move", "loop", "let", "const", "static", "try", "super", "this",
)


def blank(text: Column, path: Column) -> Column:
    """The text with comments and strings as spaces: every line and column stays where it is."""

    def without(pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        gaps = F.split(text, pattern, -1)
        filled = F.concat(F.transform(found, lambda t: F.regexp_replace(t, r"[^\n]", " ")), F.array(F.lit("")))
        return F.array_join(F.zip_with(gaps, filled, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")

    return F.when(family(path) == "python", without(_HASH)).when(family(path).isNotNull(), without(_SLASH))


def source_lines(files: DataFrame) -> DataFrame:
    """path, family, line, code (blanked), indent and blank of every line of the files whose language is known."""
    kept = files.select("path", family(F.col("path")).alias("family"), blank(F.col("text"), F.col("path")).alias("text")).where("text IS NOT NULL")
    rows = kept.select("path", "family", F.posexplode(F.split("text", r"\r?\n", -1)).alias("at", "code"))
    indent = F.char_length(F.regexp_extract(F.replace("code", F.lit("\t"), F.lit("        ")), "^( *)", 1))
    return rows.select("path", "family", (F.col("at") + 1).alias("line"), "code", indent.alias("indent"), (F.trim("code") == "").alias("blank"))


def _definition(of: str) -> Column:
    """array<struct<kind, name>> with what a line defines, by the first pattern of its family that fits; empty if none does."""
    tries = []
    for kind, pattern, group in DEFINES[of]:
        named = F.regexp_extract("code", pattern, group)
        is_one = (named != "") & ~named.isin(*RESERVED)
        said = F.regexp_extract("code", pattern, 1) if kind is None else F.lit(kind)
        tries.append(F.when(is_one, F.struct(said.alias("kind"), named.alias("name"))))
    return F.coalesce(*tries)


def definition_lines(lines: DataFrame) -> DataFrame:
    """path, family, line, indent, kind, name, code of the lines that define something."""
    found = F.coalesce(*[F.when(F.col("family") == f, _definition(f)) for f in DEFINES])
    return lines.withColumn("__d", found).where("__d IS NOT NULL").select("path", "family", "line", "indent", "code", "__d.kind", "__d.name")


def _first_after(points: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """``points`` (path, level, line, ...) with ``name``: the first event's line of equal path and level that isn't before theirs."""
    both = points.withColumn("__event", F.lit(None).cast("int")).unionByName(events.withColumn("__event", F.col("line")), allowMissingColumns=True)
    # from the end backwards, so that the frame only grows
    ahead = Window.partitionBy("path", "level").orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.min("__event").over(ahead)).where("__event IS NULL").drop("__event")


def _indented(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Spans by indentation: a definition ends with the last line before one that is indented no further."""
    rows = lines.where("family = 'python' AND NOT blank")
    w = Window.partitionBy("path").orderBy("line")
    before, last = F.lag("indent").over(w), F.lag("line").over(w)
    steps = rows.select("path", "line", "indent", before.alias("before"), last.alias("last")).where("indent <= before")
    # a line ends whatever stands between its own indentation and that of the line before
    events = steps.select("path", F.explode(F.sequence("indent", "before")).alias("level"), "line", "last")
    points = found.where("family = 'python'").withColumn("level", F.col("indent")).withColumn("line", F.col("line") + 1)
    ended = _first_after(points, events.select("path", "level", "line"), "__stop").withColumn("line", F.col("line") - 1)
    lasts = steps.select("path", F.col("line").alias("__stop"), F.col("last").alias("__last"))
    ends = rows.groupBy("path").agg(F.max("line").alias("__eof"))
    joined = ended.join(lasts, ["path", "__stop"], "left").join(ends, "path")
    return joined.withColumn("end_line", F.coalesce("__last", "__eof")).drop("__stop", "__last", "__eof", "level")


def _braced(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Spans by braces: a definition ends where the first brace that opens at its level after it is closed; without one, on its own line."""
    rows = lines.where("family <> 'python'").withColumn("__b", F.regexp_extract_all("code", F.lit(r"([{}])"), F.lit(1)))
    step = F.aggregate("__b", F.lit(0), lambda n, b: n + F.when(b == "{", 1).otherwise(-1))
    running = F.sum(step).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    deep = rows.withColumn("__depth", (running - step).cast("int"))
    # the level that each brace opens or closes
    marks = deep.where(F.size("__b") > 0).select("path", "line", "__depth", F.posexplode("__b").alias("at", "brace"), "__b")
    so_far = F.aggregate(F.slice("__b", F.lit(1), F.col("at")), F.lit(0), lambda n, b: n + F.when(b == "{", 1).otherwise(-1))
    level = F.col("__depth") + so_far - F.when(F.col("brace") == "}", 1).otherwise(0)
    marks = marks.select("path", level.alias("level"), "line", "brace").withColumn("level", F.col("level").cast("int"))
    points = found.where("family <> 'python'").join(deep.select("path", "line", F.col("__depth").alias("level")), ["path", "line"])
    opened = _first_after(points, marks.where("brace = '{'").select("path", "level", "line"), "__open")
    # a definition that ends with a semicolon, or before another brace could open, has no body
    bodyless = F.col("code").rlike(r";\s*$") & ~F.contains("code", F.lit("{"))
    opened = opened.withColumn("__from", F.when(~bodyless, F.col("__open"))).withColumn("__line", F.col("line"))
    closing = _first_after(opened.withColumn("line", F.coalesce("__from", "line")), marks.where("brace = '}'").select("path", "level", "line"), "__close")
    end = F.when(F.col("__from").isNotNull(), F.coalesce("__close", "__from"))
    return closing.withColumn("end_line", F.coalesce(end, "__line")).withColumn("line", F.col("__line")).drop("__open", "__from", "__line", "__close", "level")


def symbols(files: DataFrame) -> DataFrame:
    """path, name, kind, line, end_line, family of every definition."""
    lines = source_lines(files)
    found = definition_lines(lines)
    columns = ["path", "name", "kind", "line", "end_line", "family"]
    return _indented(lines, found).select(*columns).unionByName(_braced(lines, found).select(*columns))


def calls(files: DataFrame) -> DataFrame:
    """path, line, name, caller of every name before an opening bracket that isn't a definition's own or a reserved word; caller is the innermost definition, or null."""
    lines = source_lines(files)
    own = definition_lines(lines).select("path", "line", F.col("name").alias("__own"))
    named = F.regexp_extract_all("code", F.lit(r"([A-Za-z_$][\w$]*)(?=\s*!?\s*\()"), F.lit(1))
    found = lines.select("path", "line", F.posexplode(named).alias("at", "name")).where(~F.col("name").isin(*RESERVED))
    # the first mention of the name that its line defines is the definition
    first = F.row_number().over(Window.partitionBy("path", "line", "name").orderBy("at"))
    sites = found.withColumn("__n", first).join(own, ["path", "line"], "left").where(F.col("__own").isNull() | (F.col("name") != F.col("__own")) | (F.col("__n") > 1))
    spans = symbols(files).select("path", "name", "line", "end_line")
    return locate(sites.select("path", "line", "name"), spans, ["path"]).select("path", "line", "name", F.col("span_name").alias("caller"))
