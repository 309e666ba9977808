"""Registered queries over parsed source files, each beside its SQL.

Every part gives one small file, in one of six languages by its key; the SQL states from the keys alone
what the files define, call and import.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import definitions
from lexforge.parse import source
from lexforge.plans.queries import files, query, table
from lexforge.sources.tables import spread

#: Name and text of the file of a part, by its key modulo six: {k} the key, {n} the next key of the language, {h} a helper's number.
_FILES = [
    ("p/m{k}.py", "import p.m{n}\n# call(x)\nclass K{k}:\n    def run(self):\n        return helper{h}(self)\n\ndef helper{h}(x):\n    return 'no(call)'\n"),
    ("p/m{k}.rs", "mod x{k};\nstruct S{k};\nimpl S{k} {\n    fn run(&self) { helper{h}(1); }\n}\nfn helper{h}(x: i32) {} // fn not_this() {}\n"),
    ("p/m{k}.ts", "import {a} from './m{n}';\nclass C{k} {\n  run(x: number): void { helper{h}(x); }\n}\nfunction helper{h}(x: number) { return 'go()'; }\n"),
    ("p/m{k}.go", 'package p\n\nimport r "ex.com/m/real{h}"\n\nfunc (t *T) Run() { r.Do{k}(t) }\nfunc helper{h}(x int) {}\n'),
    ("p/E{k}.java", "import p.E{n};\nclass E{k} {\n  int run() { return helper{h}(1); }\n  int helper{h}(int x) { return x; }\n}\n"),
    ("p/m{k}.c", '#include "m{n}.c"\nstatic int helper{h}(int x) {\n  return x;\n}\nint run(void) {\n  return helper{h}(1); /* no(1) */\n}\n'),
]


def _filled(template: str):
    """A template with the numbers of its part, as a column; other braces stay."""
    k = F.col("p_partkey")
    column = F.lit(template)
    for mark, value in (("{k}", k), ("{n}", k + 6), ("{h}", k % 5)):
        column = F.replace(column, F.lit(mark), value.cast("string"))
    return column


def _sources(spark, sf_dir):
    kind = F.col("p_partkey") % 6
    path, text = F.lit(None), F.lit(None)
    for i, (name, content) in enumerate(_FILES):
        path, text = F.when(kind == i, _filled(name)).otherwise(path), F.when(kind == i, _filled(content)).otherwise(text)
    return table(spark, sf_dir, "part").select(path.alias("path"), text.alias("text"))


_KEYS = """k AS (SELECT p_partkey AS k, p_partkey % 6 AS kind, p_partkey % 5 AS h,
  CASE WHEN p_partkey % 6 = 4 THEN 'p/E' ELSE 'p/m' END || p_partkey || ['.py', '.rs', '.ts', '.go', '.java', '.c'][p_partkey % 6 + 1] AS path FROM part)"""


def _rows(columns: str, rows: list[tuple]) -> str:
    """A table of literals; the first value is the kind of file, texts hold {k} and {h}."""
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS r(kind, {columns})"


_SYMBOLS = [
    (0, "K{k}", "class", 3, 5, None), (0, "run", "function", 4, 5, "K{k}"), (0, "helper{h}", "function", 7, 8, None),
    (1, "S{k}", "struct", 2, 2, None), (1, "run", "function", 4, 4, "S{k}"), (1, "helper{h}", "function", 6, 6, None),
    (2, "C{k}", "class", 2, 4, None), (2, "run", "method", 3, 3, "C{k}"), (2, "helper{h}", "function", 5, 5, None),
    (3, "Run", "method", 5, 5, "T"), (3, "helper{h}", "function", 6, 6, None),
    (4, "E{k}", "class", 2, 5, None), (4, "run", "method", 3, 3, "E{k}"), (4, "helper{h}", "method", 4, 4, "E{k}"),
    (5, "helper{h}", "function", 2, 4, None), (5, "run", "function", 5, 7, None),
]


def _named(column: str) -> str:
    return f"replace(replace(r.{column}, '{{k}}', CAST(k AS VARCHAR)), '{{h}}', CAST(h AS VARCHAR))"


@query(
    f"WITH {_KEYS} SELECT path, {_named('name')} AS name, r.what AS kind, CAST(r.line AS INTEGER) AS line, CAST(r.end_line AS INTEGER) AS end_line, {_named('container')} AS container "
    f"FROM k JOIN {_rows('name, what, line, end_line, container', _SYMBOLS)} ON k.kind = r.kind"
)
def parsed_symbols(spark, sf_dir):
    """Definitions with their spans and containers."""
    return source.symbols(source.parse(_sources(spark, sf_dir))).select("path", "name", "kind", "line", "end_line", "container")


_CALLS = [(0, "helper{h}", 5, 16, "run"), (1, "helper{h}", 4, 21, "run"), (2, "helper{h}", 3, 26, "run"), (3, "Do{k}", 5, 23, "Run"), (4, "helper{h}", 3, 22, "run"), (5, "helper{h}", 6, 10, "run")]


@query(
    f"WITH {_KEYS} SELECT path, {_named('name')} AS name, CAST(r.line AS INTEGER) AS line, CAST(r.col AS INTEGER) AS \"column\", r.caller AS caller, CASE WHEN k.kind = 3 THEN 'r.Do' || k ELSE '' END AS expression "
    f"FROM k JOIN {_rows('name, line, col, caller', _CALLS)} ON k.kind = r.kind"
)
def parsed_calls(spark, sf_dir):
    """Calls alone, as a snapshot keeps them; names in comments, texts and parameters are none."""
    return source.refs(source.parse(_sources(spark, sf_dir))).select("path", "name", "line", "column", "caller", "expression")


_USES = [(0, "self", 5, 24, "run"), (2, "x", 3, 34, "run"), (3, "r", 5, 21, "Run"), (3, "t", 5, 28, "Run"), (4, "x", 4, 31, "helper{h}"), (5, "x", 3, 10, "helper{h}")]


@query(
    f"WITH {_KEYS} SELECT path, r.name AS name, CAST(r.line AS INTEGER) AS line, {_named('caller')} AS caller "
    f"FROM k JOIN {_rows('name, line, col, caller', _USES)} ON k.kind = r.kind"
)
def parsed_uses(spark, sf_dir):
    """Identifiers that are neither defined, called, imported nor declared as parameters where they stand."""
    found = source.refs(source.parse(_sources(spark, sf_dir), references=True))
    return found.where(F.col("kind") == "possible_reference").select("path", "name", "line", "caller")


@query(
    f"""WITH {_KEYS} SELECT k.path, CAST(CASE WHEN k.kind = 3 THEN 3 ELSE 1 END AS INTEGER) AS line,
  CASE k.kind WHEN 0 THEN 'import p.m' || (k.k + 6) WHEN 1 THEN 'mod x' || k.k || ';' WHEN 2 THEN 'import {{a}} from ''./m' || (k.k + 6) || ''''
    WHEN 3 THEN 'import r "ex.com/m/real' || k.h || '"' WHEN 4 THEN 'import p.E' || (k.k + 6) || ';' ELSE '#include "m' || (k.k + 6) || '.c"' END AS statement,
  coalesce(o.path, '') AS files, CASE WHEN o.path IS NULL THEN 'unresolved' ELSE 'possible_local_module' END AS resolution
FROM k LEFT JOIN k o ON o.k = k.k + 6 AND k.kind NOT IN (1, 3)"""
)
def resolved_imports(spark, sf_dir):
    """Imports, and the files of the tree that they may mean."""
    tree = _sources(spark, sf_dir)
    found = source.imports(source.parse(tree), tree)
    return found.select("path", "line", "statement", F.array_join("candidate_files", ",").alias("files"), "resolution")


@query(f"WITH {_KEYS} SELECT path, 'Do' || k AS name, 'real' || h AS package FROM k WHERE kind = 3")
def go_call_packages(spark, sf_dir):
    """Calls through an import's alias, with the folder of the module that it means."""
    rows = source.parse(_sources(spark, sf_dir).where(F.col("path").endswith(".go")))
    calls = source.refs(rows).where(F.col("kind") == "call")
    named = rows.where(F.col("table") == "import").select("path", "statement")
    return source.go_packages(calls, named, "ex.com/m").select("path", "name", "package")


#: Budgets of an index, files and bytes: small ones, so that a budget binds on these tables.
_MOST_FILES, _MOST_BYTES = 150, 200_000


@query(
    f"""WITH f AS (SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, strlen(text) AS bytes FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS place, sum(bytes) OVER (ORDER BY string_split(path, '/') ROWS UNBOUNDED PRECEDING) AS total FROM f)
SELECT path FROM o WHERE place <= {_MOST_FILES} AND total <= {_MOST_BYTES}"""
)
def indexed_files(spark, sf_dir):
    """The leading files, by path, that the budgets of an index admit."""
    return source.budgeted(files(spark, sf_dir), _MOST_FILES, _MOST_BYTES).select("path")


# ---- definitions by column expressions ---------------------------------------------------------

#: Every line of a text that has two words becomes a function that calls something, in Python or in Rust.
_CODE = """w AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_extract_all(l, '[a-z]{2,}')), lambda w: len(w) > 1) AS ls FROM documents),
f AS (SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.rs' END AS path, doc_id % 2 = 0 AS py, i, ls[i] AS w FROM w, unnest(range(1, len(ls) + 1)) AS u(i)),
g AS (SELECT path, py, w[1] || '_' || i AS name, w[2] || '_c' AS called, CAST(CASE WHEN py THEN 2 ELSE 3 END * (i - 1) + 1 AS INTEGER) AS line FROM f)"""


def _coded(spark, sf_dir):
    words = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_extract_all(x, F.lit("([a-z]{2,})"), F.lit(1))), lambda w: F.size(w) > 1)
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("ls"))
    name = lambda w, i: F.concat(w[0], F.lit("_"), (i + 1).cast("string"))
    py = lambda w, i: F.concat(F.lit("def "), name(w, i), F.lit("(x):  # def no_"), w[1], F.lit("()\n    return "), w[1], F.lit('_c(x, "'), w[0], F.lit('(")'))
    rs = lambda w, i: F.concat(F.lit("fn "), name(w, i), F.lit("() { // {\n    "), w[1], F.lit("_c(); /* no_"), w[0], F.lit("() { */\n}"))
    even = F.col("doc_id") % 2 == 0
    code = F.array_join(F.when(even, F.transform("ls", py)).otherwise(F.transform("ls", rs)), "\n")
    return spread(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(even, ".py").otherwise(".rs")).alias("path"), code.alias("text")))


@query(f"WITH {_CODE} SELECT path, name, line, CAST(line + CASE WHEN py THEN 1 ELSE 2 END AS INTEGER) AS end_line, CASE WHEN py THEN 'def' ELSE 'fn' END AS kind FROM g")
def native_symbols(spark, sf_dir):
    return definitions.symbols(_coded(spark, sf_dir)).select("path", "name", F.col("line").cast("int").alias("line"), F.col("end_line").cast("int").alias("end_line"), "kind")


@query(f"WITH {_CODE} SELECT path, CAST(line + 1 AS INTEGER) AS line, called AS name, name AS caller FROM g")
def native_calls(spark, sf_dir):
    return definitions.calls(_coded(spark, sf_dir)).select("path", F.col("line").cast("int").alias("line"), "name", "caller")
