"""Building experiments: plans, suites, samples and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.lines import lines


def plan(tasks: DataFrame, systems: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """Every repetition of every task on every system, with a place drawn from the seed.

    A plan is this product by definition; how it is made is left to the sizes of its sides.
    """
    reps = F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition")
    cells = tasks.select("*", reps).crossJoin(systems)
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cells.columns]), 256)
    return cells.withColumn("draw", digest)


#: Cells of one combination of factors that are held in one row, on average, while pairs are made.
CELL_BLOCK = 512


def one_factor_contrasts(cells: DataFrame, factors: list[str]) -> DataFrame:
    """Pairs of cells that differ in exactly one factor.

    The result grows with the square of a combination's cells, so blocks of cells of one combination are what is joined on the
    other factors, and factors are compared once a pair of blocks.  Pairs of blocks are dealt over all tasks before they are spelled out.
    """
    sizes = cells.groupBy(*factors).agg(F.count(F.lit(1)).alias("__n"))
    dealt = cells.join(sizes, factors).withColumn("__block", F.pmod(F.xxhash64("cell"), F.ceil(F.col("__n") / CELL_BLOCK)))
    held = F.transform(F.collect_list(F.struct("cell")), lambda s: s["cell"])  # of plain values, null ones would be lost
    blocks = dealt.groupBy(*factors, "__block").agg(held.alias("__cells"))
    out = None
    for factor in factors:
        rest = [f for f in factors if f != factor]
        other = blocks.select(*rest, F.col(factor).alias("other"), F.col("__cells").alias("__others"))
        found = blocks.join(other, rest) if rest else blocks.crossJoin(other)
        found = found.where(F.col(factor) < F.col("other")).select(F.lit(factor).alias("factor"), "__cells", "__others")
        out = found if out is None else out.unionByName(found)
    out = out.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return out.select("factor", F.explode("__cells").alias("cell"), "__others").select("factor", "cell", F.explode("__others").alias("other_cell"))


def unique_and_used(symbols: DataFrame, uses: DataFrame, name: str, key: str) -> DataFrame:
    """Names defined once whose definition is used."""
    once = symbols.groupBy(name).agg(F.count(F.lit(1)).alias("c"), F.min(key).alias(key)).where("c = 1").drop("c")
    return once.join(uses.select(key).distinct(), key, "left_semi").select(name, key)


def sample_by_hash(rows: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows in an order drawn from the seed: the same rows however the table is stored."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]), 256)
    return rows.orderBy(digest, *key).limit(n)


def refusals(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows with the first rule that refuses them; null where none does."""
    reason = None
    for name, test in rules:
        reason = F.when(test, F.lit(name)) if reason is None else reason.when(test, F.lit(name))
    return rows.withColumn("refusal", reason)


def refusal_histogram(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return refusals(rows, rules).groupBy("refusal").agg(F.count(F.lit(1)).alias("n"))


def mechanical_rules(min_words: int = 6, max_words: int = 60) -> list[tuple[str, Column]]:
    """Rules over candidates (symbol, comment, definitions): one definition, a comment of a fair length that hides the name."""
    words = F.size(F.split(F.trim("comment"), r"\s+"))
    return [
        ("several definitions", F.col("definitions") != 1),
        ("no comment", F.coalesce(F.trim("comment"), F.lit("")) == ""),
        ("too short", words < min_words),
        ("too long", words > max_words),
        ("names the symbol", F.contains(F.lower("comment"), F.lower("symbol"))),
    ]


def commit_rules() -> list[tuple[str, Column]]:
    """Rules over commits (message, identities, files): something changed, little enough, and not given away."""
    return [
        ("no message", F.coalesce(F.trim("message"), F.lit("")) == ""),
        ("no symbol changed", F.size("identities") == 0),
        ("too many symbols", F.size("identities") > 5),
        ("only tests", F.forall("files", lambda f: is_test_path(f))),
        ("leaks the answer", F.exists("identities", lambda i: leaks(F.col("message"), i))),
    ]


#: Folders, files and names of test code, and the line that opens a test scope.
TEST_FOLDER = r"(^|/)(tests?|testing|spec|specs|__tests__)(/|$)"
TEST_FILE = r"(?i)(^|[._-])(test|spec)s?[._]|_test\.|\.test\.|\.spec\."
TEST_NAME = r"^(test[_A-Z]|Test[A-Z]|should[A-Z])"
TEST_SCOPE = r"^\s*#\[cfg\(test\)\]"


def is_test_path(path: Column) -> Column:
    """Test code by its path: a test folder, or a file named as a test."""
    return path.rlike(TEST_FOLDER) | F.element_at(F.split(path, "/"), -1).rlike(TEST_FILE)


def is_test_name(leaf: Column) -> Column:
    return leaf.rlike(TEST_NAME)


def test_code(definitions: DataFrame, files: DataFrame) -> DataFrame:
    """``definitions`` (path, leaf, line) and ``is_test``: by path, by name, or declared below a line of its file that opens a test scope.

    Of several declarations of a name in a file the first counts.
    """
    marker = lines(files).where(F.col("text").rlike(TEST_SCOPE)).groupBy("path").agg(F.min("line").alias("__marker"))
    first = definitions.groupBy("path", "leaf").agg(F.min("line").alias("__first"))
    below = first.join(marker, "path").where("__first > __marker").select("path", "leaf", F.lit(True).alias("__below"))
    found = definitions.join(below, ["path", "leaf"], "left")
    return found.withColumn("is_test", is_test_path(F.col("path")) | is_test_name(F.col("leaf")) | F.col("__below").isNotNull()).drop("__below")


def whole_word(prose: Column, token: Column) -> Column:
    """Whether a token stands in a text with no word character on either side."""
    quoted = F.regexp_replace(token, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return (token != "") & F.regexp_like(prose, F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")))


def leaks(prose: Column, identity: Column, defined: Column | None = None) -> Column:
    """Whether prose holds the last name of an identity (``path::Owner::name``), or its file's stem, as a whole word.

    With ``defined`` (an array of names) a stem counts only if something of that name is defined.
    """
    parts = F.split(identity, "::")
    stem = F.regexp_replace(F.element_at(F.split(F.element_at(parts, 1), "/"), -1), r"(?<=.)\.[^.]*$", "")
    by_stem = whole_word(prose, stem) if defined is None else whole_word(prose, stem) & F.array_contains(defined, stem)
    return whole_word(prose, F.element_at(parts, -1)) | by_stem


def contamination(tool: Column, path: Column, allowed: list[str], root: str) -> Column:
    """Why a call disqualifies its trial: a tool that isn't allowed, or an absolute path outside the corpus."""
    outside = path.startswith("/") & ~((path == root) | path.startswith(root.rstrip("/") + "/"))
    return F.when(~tool.isin(allowed), "tool not allowed").when(F.coalesce(outside, F.lit(False)), "path outside the corpus")


def suite_problems(questions: DataFrame, files: DataFrame) -> DataFrame:
    """task_id, severity, problem: doubled ids, blanks, missing evidence files, evidence not in its file."""
    out = questions.groupBy("task_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("task_id", F.lit("error").alias("severity"), F.lit("doubled id").alias("problem"))
    blank = questions.where(F.coalesce(F.trim("question"), F.lit("")) == "").select("task_id", F.lit("error").alias("severity"), F.lit("blank question").alias("problem"))
    no_gold = questions.where("expected_json IS NULL").select("task_id", F.lit("error").alias("severity"), F.lit("no answer").alias("problem"))
    evidence = questions.select("task_id", F.explode("evidence").alias("e")).select("task_id", "e.path", F.explode("e.contains").alias("part"))
    lost = evidence.join(files.select("path"), "path", "left_anti").select("task_id", F.lit("error").alias("severity"), F.concat(F.lit("no file "), "path").alias("problem"))
    absent = evidence.join(files, "path").where(~F.contains("text", F.col("part"))).select("task_id", F.lit("error").alias("severity"), F.concat(F.lit("not in "), "path").alias("problem"))
    thin = questions.where(F.size(F.coalesce("evidence", F.array())) == 0).select("task_id", F.lit("warning").alias("severity"), F.lit("no evidence").alias("problem"))
    for more in (blank, no_gold, lost.distinct(), absent.distinct(), thin):
        out = out.unionByName(more)
    return out


def competency(rows: DataFrame) -> DataFrame:
    """``rows`` and ``satisfied``, ``score``: a right answer in the right form, found in the way the task asks for.

    ``rows``: correct, format_correct, kind, file, expected (array of lines) and calls (name, regex, limit, path, start_line, end_line,
    lines: those delivered of ``file``, none where the call failed).  Kinds: ``regex`` - one regular-expression search delivers
    just the expected lines; ``paging`` - nothing but searches of one or two rows a page, which deliver the expected lines
    together; ``read`` - nothing but reads of that file's one line.  Any other kind asks for nothing.
    """
    wanted = F.array_sort("expected")
    searches = F.filter("calls", lambda c: c["name"] == "search_exact")
    by_regex = F.exists(searches, lambda c: F.coalesce(c["regex"], F.lit(False)) & (F.array_sort(c["lines"]) == wanted))
    small = F.forall("calls", lambda c: (c["name"] == "search_exact") & F.coalesce(c["limit"], F.lit(20)).between(1, 2))
    together = F.array_sort(F.array_distinct(F.flatten(F.transform(searches, lambda c: c["lines"])))) == wanted
    one = F.element_at("expected", 1)
    reads = F.forall(
        "calls", lambda c: (c["name"] == "read_source") & (c["path"] == F.col("file")) & (c["start_line"] == one) & (c["end_line"] == one) & (c["lines"] == F.array(one))
    )
    any_call = F.size("calls") > 0
    way = F.when(F.col("kind") == "regex", by_regex).when(F.col("kind") == "paging", any_call & small & together).when(F.col("kind") == "read", any_call & reads).otherwise(True)
    way = F.coalesce(way, F.lit(False))
    return rows.withColumn("satisfied", way).withColumn("score", (F.col("correct") & F.col("format_correct") & way).cast("int"))


def true_callers(uses: DataFrame, spans: DataFrame) -> DataFrame:
    """Definitions around textual uses of a name (path, line), innermost only, each once."""
    from lexforge.operators.graph import locate

    return locate(uses, spans, ["path"]).where("span_name IS NOT NULL").select("path", F.col("span_name").alias("caller")).distinct()


def localisation_rules() -> list[tuple[str, Column]]:
    """Rules over imported localisation tasks (issue, gold, defined): gold exists, is unique, isn't test code, isn't given away."""
    return [
        ("no issue text", F.coalesce(F.trim("issue"), F.lit("")) == ""),
        ("no gold", F.size("gold") == 0),
        ("gold isn't in the corpus", F.size(F.array_except("gold", "defined")) > 0),
        ("only test code", F.forall("gold", lambda g: is_test_path(F.element_at(F.split(g, "::"), 1)))),
        ("leaks the answer", F.forall("gold", lambda g: leaks(F.col("issue"), g))),
    ]


def lower_bound(identities: Column, tool_path: Column | None = None) -> Column:
    """struct: gold identities (``path::...``), their files, the least number of lexical calls that can name them, calls of the proven path.

    A search names lines, not the definitions around them: one search, then a read for each file.
    """
    files = F.size(F.array_distinct(F.transform(identities, lambda i: F.substring_index(i, "::", 1))))
    steps = F.lit(None).cast("int") if tool_path is None else F.nullif(F.size(tool_path), F.lit(0))
    return F.struct(
        F.size(identities).alias("gold_identities"), files.alias("gold_files"), F.when(F.size(identities) > 0, files + 1).otherwise(0).alias("minimum_lexical_calls"), steps.alias("structural_calls")
    )


def reformulated(concepts: Column, identifiers: Column, terms: Column) -> Column:
    """A rewritten query: concepts, then identifiers, then further terms."""
    return F.concat_ws(" ", concepts, identifiers, terms)
