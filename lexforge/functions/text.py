"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the retrieval interface.
MAX_QUERY_BYTES, EXCERPT_CHARS, SNIPPET_BEFORE_BYTES, SNIPPET_CHARS = 4096, 300, 120, 500
MAX_SCAN_TOKENS, MIN_TOKEN_BYTES = 64, 3

#: File suffix -> (grammar, family).
LANGUAGES = {
    "rs": ("rust", "rust"), "py": ("python", "python"), "js": ("typescript", "ecmascript"), "mjs": ("typescript", "ecmascript"),
    "cjs": ("typescript", "ecmascript"), "ts": ("typescript", "ecmascript"), "mts": ("typescript", "ecmascript"),
    "cts": ("typescript", "ecmascript"), "jsx": ("tsx", "ecmascript"), "tsx": ("tsx", "ecmascript"), "go": ("go", "go"),
    "java": ("java", "java"), "c": ("c", "c"), "h": ("cpp", "c"), "cc": ("cpp", "c"), "cpp": ("cpp", "c"), "cxx": ("cpp", "c"),
    "c++": ("cpp", "c"), "hh": ("cpp", "c"), "hpp": ("cpp", "c"), "hxx": ("cpp", "c"), "h++": ("cpp", "c"), "ipp": ("cpp", "c"),
    "tpp": ("cpp", "c"),
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Grammar of a source path; null for other files."""
    table = F.create_map(*[F.lit(x) for s, (g, _) in LANGUAGES.items() for x in (s, g)])
    return F.element_at(table, suffix(path))


def family(path: Column) -> Column:
    """Language family of a source path; null for other files."""
    table = F.create_map(*[F.lit(x) for s, (_, f) in LANGUAGES.items() for x in (s, f)])
    return F.element_at(table, suffix(path))


def split_lines(text: Column) -> Column:
    """Lines without their ends: no empty line after a final line break, one CR before it dropped."""
    parts = F.split(text, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, r"\r$", ""))


def concept_tokens(text: Column) -> Column:
    """Lower-cased words of a text: for each alphanumeric word its camel-case parts, then the whole.

    ``wrapParagraph_width`` gives wrap, paragraph, wrapparagraph, width; a word without humps is
    given once; duplicates stay.
    """
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def parts(word: Column) -> Column:
        pieces = F.split(F.regexp_replace(word, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", "\u0001"), "\u0001")
        low = F.transform(pieces, F.lower)
        return F.when(F.size(low) > 1, F.concat(low, F.array(F.lower(word)))).otherwise(low)

    # texts without humps, by far the most, are lower-cased and cut in one go
    humps = text.rlike(r"[\p{Ll}\p{N}]\p{Lu}")
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.when(humps, F.flatten(F.transform(words, parts))).otherwise(plain)


def query_tokens(text: str) -> list[str]:
    """The same tokens of a query string, on the driver."""
    out: list[str] = []
    for word in re.findall(r"[^\W_]+", text):
        pieces = re.sub(r"(?<=[^\W_])(?=[A-ZÀ-Þ])", "\x01", word).split("\x01")
        joined: list[str] = []
        for p in pieces:  # a hump follows a lower-case letter or a digit only
            if joined and not (joined[-1][-1].islower() or joined[-1][-1].isdigit()):
                joined[-1] += p
            else:
                joined.append(p)
        out += [p.lower() for p in joined]
        if len(joined) > 1:
            out.append(word.lower())
    return out


def scan_tokens(query: str) -> list[str]:
    """Tokens to scan files for: three bytes at least, each once, the first 64 by alphabet."""
    return sorted({t for t in query_tokens(query) if len(t.encode()) >= MIN_TOKEN_BYTES})[:MAX_SCAN_TOKENS]


def glob_escape(path: str) -> str:
    return re.sub(r"([*?\[\]{}!\\])", r"\\\1", path)


def boundary_pattern(name: str) -> str:
    """A pattern for a whole name: word boundaries only at sides that are word characters."""
    left = r"\b" if re.match(r"\w", name) else ""
    right = r"\b" if re.search(r"\w$", name) else ""
    return left + re.escape(name) + right


def concept_pattern(token: str) -> str:
    """A token at a left boundary of letters and digits (an underscore separates), in any case."""
    return r"(?iu)(^|[^0-9A-Za-z])" + re.escape(token)


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def snippet(line: Column, before: Column) -> Column:
    """struct(snippet, truncated): 500 characters of a line, from 120 bytes before a match on.

    ``before`` is how many characters stand before the match; a start inside a character moves left.
    """
    # 120 characters hold the 120 bytes; the shortest end of them that does is what is shown
    head = F.substring(line, F.greatest(before - SNIPPET_BEFORE_BYTES, F.lit(0)) + 1, F.least(before, F.lit(SNIPPET_BEFORE_BYTES)))
    sizes = F.sequence(F.lit(1), F.lit(SNIPPET_BEFORE_BYTES))
    enough = F.array_min(F.filter(sizes, lambda n: F.octet_length(F.right(head, n)) >= SNIPPET_BEFORE_BYTES))
    left = before - F.when(F.octet_length(head) < SNIPPET_BEFORE_BYTES, F.char_length(head)).otherwise(enough)
    shown = F.substring(line, left + 1, F.lit(SNIPPET_CHARS))
    return F.struct(shown.alias("snippet"), ((left > 0) | (F.char_length(line) - left > SNIPPET_CHARS)).alias("truncated"))


#: The tools of the structural class.
STRUCTURAL = ("find_symbol", "find_callers", "trace_dependencies")


def method_class(tool: Column) -> Column:
    """The class of a tool: the structural ones are one class, any other is its own."""
    return F.when(tool.isin(*STRUCTURAL), "structural").otherwise(tool)


def normal_path(path: Column) -> Column:
    """``.`` and empty components dropped, ``\\`` written as ``/``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(parts, "/")


def tidy_path(path: Column) -> Column:
    """A path without empty and ``.`` components, each ``..`` taking the one before it along; nothing left is ``.``."""
    absolute = path.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        before = F.try_element_at(kept, F.lit(-1))
        return (
            F.when((part == "") | (part == "."), kept)
            .when((part == "..") & (before != ".."), F.slice(kept, F.lit(1), F.size(kept) - 1))
            .when((part == "..") & absolute, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(kept, "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(F.when(F.size(kept) == 0, ".").otherwise(joined))


#: What a tool takes an argument for that isn't given.
DEFAULTS: dict[str, dict[str, object]] = {
    "search_exact": {"path": ".", "regex": False, "case_sensitive": True, "limit": 20, "offset": 0},
    "find_symbol": {"path": ".", "limit": 20, "offset": 0},
    "find_callers": {"path": ".", "include_references": False, "limit": 20, "offset": 0},
    "trace_dependencies": {"direction": "callers", "depth": 3, "path": ".", "limit": 20, "offset": 0},
    "search_concept": {"limit": 20, "offset": 0},
    "read_source": {"start_line": 1},
}
#: Fixed value: a read without an end shows its start and so many lines more.
READ_ON = 99


def signature(tool: Column, arguments: dict[str, Column]) -> Column:
    """Canonical JSON of a call: the tool's own defaults filled in, a read's end said, the path tidied, names in order, nulls left out."""
    names = set(arguments) | {name for own in DEFAULTS.values() for name in own} | {"end_line"}
    filled = {}
    for name in names:
        own = [(t, values[name]) for t, values in DEFAULTS.items() if name in values]
        options = [F.when(tool == t, F.lit(value)) for t, value in own]
        filled[name] = F.coalesce(*([arguments[name]] if name in arguments else []), *options, F.lit(None))
    filled["end_line"] = F.coalesce(filled["end_line"].cast("long"), F.when(tool == "read_source", filled["start_line"] + READ_ON))
    filled["path"] = tidy_path(filled["path"])
    return F.to_json(F.struct(tool.alias("tool"), *[filled[name].alias(name) for name in sorted(filled)]))


def _named(tests: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]))


def call_labels(tool: Column, query: Column, regex: Column, results: Column, failed: Column) -> Column:
    """What can be seen of a call: error or empty; of an exact search also escaped pipes, several alternatives, several words as a literal."""
    exact, is_regex = tool == "search_exact", F.coalesce(regex, F.lit(False))
    escaped = F.contains(query, F.lit("\\|"))
    alternatives = F.filter(F.split(F.replace(query, F.lit("\\|"), F.lit("|")), r"\|", -1), lambda part: part.rlike(r"\S"))
    return _named(
        [
            ("error", failed),
            ("empty", ~failed & (results == 0)),
            ("escaped_pipe_regex", exact & escaped & is_regex),
            ("escaped_pipe_literal", exact & escaped & ~is_regex),
            ("alternation_shaped", exact & F.contains(query, F.lit("|")) & (F.size(alternatives) > 1)),
            ("literal_multiword", exact & ~is_regex & query.rlike(r"(?s)\S.* .*\S")),
        ]
    )


def word_pieces(name: Column) -> Column:
    """Lower-cased pieces of more than two letters of an identifier or a text, each once."""
    found = F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda p: F.char_length(p) > 2), F.lower))


def names_target(message: Column, identities: Column) -> Column:
    """Whether a message echoes a piece of the last name of any identity (``path::Owner::name``)."""
    leaves = F.transform(identities, lambda i: F.element_at(F.split(i, "::"), -1))
    return F.arrays_overlap(word_pieces(message), word_pieces(F.array_join(leaves, " ")))


def vocabulary(text: Column) -> Column:
    """Distinct lower-cased words of three characters or more, and the pieces of more than two letters inside them."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_]{2,})"), F.lit(1))
    inside = F.regexp_extract_all(F.array_join(words, " "), F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?![a-z]))"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(words, F.filter(inside, lambda p: F.char_length(p) > 2)), F.lower))


#: What a trailer of a commit message begins with.
TRAILERS = (
    "signed-off-by", "co-authored-by", "reviewed-by", "acked-by", "tested-by", "reported-by", "suggested-by", "cc", "fixes", "closes", "close", "resolves", "link", "bug",
    "change-id", "reviewed-on", "differential revision", "pull-request", "pr", "see also", "ref", "refs",
)


def clean_message(message: Column) -> Column:
    """The prose of a commit message: without trailers, comment lines and addresses, at most one blank line in a row."""
    rows = F.transform(F.split(message, r"\r?\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    trailer = r"(?i)^\s*(" + "|".join(TRAILERS) + r")\s*[:#]"
    prose = F.array_join(F.filter(rows, lambda x: ~x.rlike(trailer) & ~x.rlike(r"^\s*#")), "\n")
    bare = F.regexp_replace(F.regexp_replace(prose, r"https?://\S+", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def strip_identifiers(text: Column) -> Column:
    """A question without what looks like code: words with an underscore, colon, quote, brace or bracket, or a source file's suffix."""
    words = F.filter(F.split(text, r"[\s,.]+", -1), lambda w: (w != "") & ~w.rlike(r'[_:{}"\[\]]') & ~w.isin("JSON", "Return"))
    return F.array_join(words, " ")


#: Words of questions that aren't taken for names.
PROSE = (
    "that", "this", "which", "with", "when", "where", "from", "into", "each", "every", "returns", "return", "identify", "answer", "question", "object", "objects", "method", "methods",
    "class", "classes", "function", "functions", "definition", "definitions", "symbol", "symbols", "name", "names", "path", "value", "values", "list", "json", "call", "calls", "called",
    "caller", "callers", "module", "modules", "package", "packages", "field", "fields", "model", "models", "first", "second", "other", "same", "only", "their", "there", "those", "these",
    "through", "without", "within", "before", "after", "then", "than", "must", "does", "have", "been", "using", "used", "uses", "make", "made", "over", "some", "such", "both", "while",
    "whose", "what", "given", "line", "lines", "code", "source", "file", "files", "text", "type", "types",
)


def term_scores(text: Column) -> Column:
    """array<struct<term, weight>>, one for each time a name stands in a question: 5 inside backticks, and anywhere 3 if it looks like code, else 1.

    Names have four characters at least; words of prose count in backticks only.
    """
    names = lambda of: F.regexp_extract_all(of, F.lit(r"([A-Za-z_][A-Za-z0-9_]{3,})"), F.lit(1))
    quoted = F.array_join(F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), F.lit(1)), " ")
    plain = F.filter(names(text), lambda t: ~F.lower(t).isin(*PROSE))
    return F.concat(
        F.transform(names(quoted), lambda t: F.struct(t.alias("term"), F.lit(5).alias("weight"))),
        F.transform(plain, lambda t: F.struct(t.alias("term"), F.when(t.rlike("[_A-Z]"), 3).otherwise(1).alias("weight"))),
    )


def question_terms(questions: DataFrame, key: str, text: str, forbidden: str | None = None) -> DataFrame:
    """(key, term, weight) of the names that each question supplies, without those in its array ``forbidden``."""
    kept = term_scores(F.col(text))
    if forbidden is not None:
        kept = F.filter(kept, lambda t: ~F.array_contains(F.coalesce(forbidden, F.array()), t["term"]))
    rows = questions.select(key, F.explode(kept).alias("t"))
    return rows.groupBy(key, F.col("t.term").alias("term")).agg(F.sum("t.weight").alias("weight"))


def _literal(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}_\s])", r"\\$1")


def name_variants(name: Column) -> Column:
    """Lower-cased spellings of an identifier that prose might use: itself, its words apart, its words joined."""
    words = F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"(?<=[a-z0-9])(?=[A-Z])", " "), r"^\s+|\s+$", "")
    apart = F.lower(F.regexp_replace(words, r"\s+", " "))
    return F.array_distinct(F.array(F.lower(name), apart, F.replace(apart, F.lit(" "), F.lit(""))))


def clean_comment(comment: Column, name: Column) -> Column:
    """The prose of a doc comment, without links, code, tags, comment marks and any spelling of the name it is about."""
    bare = comment
    for noise in (r"\{@\w+\s+[^}]*\}", r"`[^`]*`", r"(?m)^\s*@\w+.*$", r"[*/]+"):
        bare = F.regexp_replace(bare, noise, " ")
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^ | $", "")
    # the longest spelling first
    longest = F.reverse(F.array_sort(F.transform(name_variants(name), lambda v: F.struct(F.char_length(v), v.alias("v")))))
    return tidy(F.aggregate(longest, tidy(bare), lambda kept, v: F.regexp_replace(kept, F.concat(F.lit("(?iu)"), _literal(v["v"])), F.lit(" "))))


def schema_tokens(minified_json: Column) -> Column:
    return F.octet_length(minified_json) / 4


def figure(cell: str) -> tuple[float, float]:
    """(value, half of the last printed digit) of a figure such as ``764 k`` or ``1.29 M``."""
    found = re.fullmatch(r"\s*(-?[\d,  ]*\d(?:\.(\d+))?)\s*([kKMG%]?)\s*", cell)
    if not found:
        raise ValueError(f"no figure: {cell!r}")
    scale = {"": 1.0, "%": 1.0, "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9}[found[3]]
    value = float(re.sub(r"[,  ]", "", found[1]))
    return value * scale, 0.5 * scale * 10 ** -len(found[2] or "")


def figures(cell: Column) -> Column:
    """struct(value, half) of printed figures such as ``764 k``, ``1,290`` or ``12 %``: half is that of the last printed digit; null for other texts."""
    parts = r"^\s*(-?[0-9][0-9, \u00a0\u202f]*)(?:\.([0-9]+))?\s*([kKMG%]?)\s*$"
    whole = F.regexp_replace(F.regexp_extract(cell, parts, 1), "[, \u00a0\u202f]", "")
    decimals, unit = F.regexp_extract(cell, parts, 2), F.regexp_extract(cell, parts, 3)
    scale = F.when(unit.isin("k", "K"), 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)
    value = F.concat(whole, F.lit("."), decimals, F.lit("0")).cast("double") * scale
    return F.when(cell.rlike(parts), F.struct(value.alias("value"), (0.5 * scale * F.pow(F.lit(10.0), -F.char_length(decimals))).alias("half")))
