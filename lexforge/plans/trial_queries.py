"""Registered queries over the rules of trials: labels, signatures, verdicts, grades.  Inputs are made of the tables' own texts.

Each SQL states the rule anew, beside the same adapter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import grading, text
from lexforge.operators import graph, lines, measures, sessions, suites
from lexforge.plans.queries import CALLS, FILES, GRAPH, calls, files, query, refs, symbols, table
from lexforge.plans.study_queries import _SHOWN, _pick, _shown, _sql_list

# ---- calls -------------------------------------------------------------------------------------

#: Tools that stand for the event types, so that both structural and other classes occur.
_TOOL_OF = {"click": "find_symbol", "view": "find_callers", "error": "search_exact", "purchase": "read_source", "signup": "search_concept"}
_TOOL_CASE = "CASE tool " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TOOL_OF.items()) + " END"
_CLASS = "CASE WHEN {0} IN ('find_symbol', 'find_callers', 'trace_dependencies') THEN 'structural' ELSE {0} END"


@query(
    f"""WITH {CALLS}, n AS (SELECT * REPLACE ({_TOOL_CASE} AS tool) FROM calls), c AS (SELECT *, {_CLASS.format("tool")} AS class FROM n),
m AS (SELECT *, lag(tool) OVER w AS b, lag(class) OVER w AS bc FROM c WINDOW w AS (PARTITION BY session ORDER BY sequence))
SELECT session, count(*) AS calls, count(*) FILTER (NOT failed) AS completed, count(*) FILTER (failed) AS errors, count(*) FILTER (tool <> b) AS switches,
  count(*) FILTER (class <> bc) AS method_switches, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(latency_ms), 4) AS latency_ms FROM m GROUP BY session"""
)
def session_summary(spark, sf_dir):
    tool = F.element_at(F.create_map(*[F.lit(x) for pair in _TOOL_OF.items() for x in pair]), F.col("tool"))
    return sessions.session_summary(calls(spark, sf_dir).withColumn("tool", tool)).withColumn("latency_ms", F.round("latency_ms", 4))


_TOOLS = ["search_exact", "search_exact", "find_symbol", "read_source", "search_concept", "search_exact"]
_SEARCHES = f"""searches AS (SELECT conv_id AS session, turn AS sequence, role, {_sql_list(_TOOLS)}[length(text) % 6 + 1] AS tool,
  CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, '.', '|') WHEN 2 THEN replace(text, ', ', '\\|') ELSE replace(replace(text, ' ', '_'), chr(10), '_') END AS query,
  length(text) % 5 = 0 AS regex, length(text) % 4 AS results, length(text) % 7 = 0 AS failed FROM conversations),
labelled AS (SELECT *, list_filter([CASE WHEN failed THEN 'error' END, CASE WHEN NOT failed AND results = 0 THEN 'empty' END,
  CASE WHEN tool = 'search_exact' AND contains(query, '\\|') THEN CASE WHEN regex THEN 'escaped_pipe_regex' ELSE 'escaped_pipe_literal' END END,
  CASE WHEN tool = 'search_exact' AND contains(query, '|') AND len(list_filter(string_split(replace(query, '\\|', '|'), '|'), lambda p: regexp_matches(p, '[^ \\t\\n\\r\\f\\v]'))) > 1 THEN 'alternation_shaped' END,
  CASE WHEN tool = 'search_exact' AND NOT regex AND contains(regexp_replace(query, '^\\s+|\\s+$', '', 'g'), ' ') THEN 'literal_multiword' END], lambda l: l IS NOT NULL) AS labels FROM searches)"""


def _searches(spark, sf_dir):
    t, n = F.col("text"), F.char_length("text")
    asked = F.when(F.col("turn") % 4 == 0, t).when(F.col("turn") % 4 == 1, F.replace(t, F.lit("."), F.lit("|"))).when(F.col("turn") % 4 == 2, F.replace(t, F.lit(", "), F.lit("\\|")))
    asked = asked.otherwise(F.replace(F.replace(t, F.lit(" "), F.lit("_")), F.lit("\n"), F.lit("_")))
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("sequence"), "role", _pick(n, _TOOLS).alias("tool"), asked.alias("query"), (n % 5 == 0).alias("regex"), (n % 4).alias("results"), (n % 7 == 0).alias("failed")
    )
    return rows.withColumn("labels", text.call_labels(F.col("tool"), F.col("query"), F.col("regex"), F.col("results"), F.col("failed")))


@query(f"WITH {_SEARCHES} SELECT session, sequence, array_to_string(labels, ' ') AS labels FROM labelled")
def call_labels(spark, sf_dir):
    return _searches(spark, sf_dir).select("session", "sequence", F.array_join("labels", " ").alias("labels"))


@query(
    f"""WITH {_SEARCHES}, c AS (SELECT session % 5 AS condition, labels FROM labelled),
h AS (SELECT condition, string_agg(label || '=' || n, ' ' ORDER BY label) AS labels FROM (SELECT condition, label, count(*) AS n FROM c, unnest(labels) AS u(label) GROUP BY ALL) GROUP BY condition)
SELECT condition, count(*) AS calls, count(*) FILTER (list_contains(c.labels, 'empty')) AS empty_calls, round(count(*) FILTER (list_contains(c.labels, 'empty')) / count(*), 9) AS empty_share, any_value(h.labels) AS labels
FROM c LEFT JOIN h USING (condition) GROUP BY condition"""
)
def label_histogram(spark, sf_dir):
    found = measures.label_report(_searches(spark, sf_dir).withColumn("condition", F.col("session") % 5), "condition")
    told = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ")
    return found.withColumn("empty_share", F.round("empty_share", 9)).withColumn("labels", told)


@query(
    f"""WITH {_SEARCHES}, p AS (SELECT *, results AS r, CASE session % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS most, CASE WHEN sequence % 3 = 2 THEN 20 ELSE 0 END AS at FROM searches)
SELECT session, sequence, CASE WHEN EXISTS (SELECT 1 FROM p b WHERE b.session = a.session AND b.tool = a.tool AND b.role = a.role AND b.at <> 0) THEN 'page_followed' ELSE 'page_truncated_not_followed' END AS label
FROM p a WHERE r >= most"""
)
def pages_followed(spark, sf_dir):
    rows = _searches(spark, sf_dir).withColumn("query", F.col("role")).withColumn("limit", F.when(F.col("session") % 3 == 0, 2).when(F.col("session") % 3 == 1, 1))
    return sessions.page_labels(rows.withColumn("offset", F.when(F.col("sequence") % 3 == 2, 20).otherwise(0))).select("session", "sequence", "label")


_ASKED = ["search_exact", "find_symbol", "find_callers", "trace_dependencies", "search_concept", "read_source", "other"]
_WRITTEN = ["./src/../lib//a", None, "../x", "/a/../../b", "a/./b/", "..", "a/../..", "./"]
_TIDY = ["lib/a", None, "../x", "/b", "a/b", "..", "..", "."]


@query(
    f"""WITH a AS (SELECT event_id AS k, {_sql_list(_ASKED)}[event_id % 7 + 1] AS tool, {_sql_list(_TIDY)}[event_id % 8 + 1] AS path, CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS most,
  CASE WHEN event_id % 4 > 0 THEN event_id % 90 + 1 END AS first, CASE WHEN event_id % 5 = 0 THEN event_id % 90 + 50 END AS last FROM events),
b AS (SELECT k, tool, CASE WHEN tool = 'search_exact' THEN ',"case_sensitive":true' ELSE '' END || CASE WHEN tool = 'trace_dependencies' THEN ',"depth":3,"direction":"callers"' ELSE '' END
  || coalesce(',"end_line":' || coalesce(last, CASE WHEN tool = 'read_source' THEN coalesce(first, 1) + 99 END), '') || CASE WHEN tool = 'find_callers' THEN ',"include_references":false' ELSE '' END
  || coalesce(',"limit":' || coalesce(most, CASE WHEN tool NOT IN ('read_source', 'other') THEN 20 END), '') || CASE WHEN tool NOT IN ('read_source', 'other') THEN ',"offset":0' ELSE '' END
  || coalesce(',"path":"' || coalesce(path, CASE WHEN tool NOT IN ('read_source', 'other', 'search_concept') THEN '.' END) || '"', '') || CASE WHEN tool = 'search_exact' THEN ',"regex":false' ELSE '' END
  || coalesce(',"start_line":' || coalesce(first, CASE WHEN tool = 'read_source' THEN 1 END), '') AS rest FROM a)
SELECT k AS event_id, '{{"tool":"' || tool || '"' || rest || '}}' AS signature FROM b"""
)
def request_signatures(spark, sf_dir):
    k = F.col("event_id")
    given = {"path": _pick(k, _WRITTEN), "limit": F.when(k % 3 > 0, k % 50), "start_line": F.when(k % 4 > 0, k % 90 + 1), "end_line": F.when(k % 5 == 0, k % 90 + 50)}
    return table(spark, sf_dir, "events").select("event_id", text.signature(_pick(k, _ASKED), given).alias("signature"))


# ---- words, messages, questions ----------------------------------------------------------------


@query(
    r"""WITH p AS (SELECT doc_id, lang || 'Source' AS leaf, list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace(text || ' HTTPServer', '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: length(x) > 2), lambda x: lower(x))) AS pieces FROM documents)
SELECT doc_id, sha256(array_to_string(list_sort(pieces), ' ')) AS pieces, list_contains(pieces, 'source') OR length(leaf) > 8 AND list_contains(pieces, leaf[:length(leaf) - 6]) AS names_target FROM p"""
)
def identifier_pieces(spark, sf_dir):
    told = F.concat("text", F.lit(" HTTPServer"))
    target = F.array(F.concat(F.lit("a/b.py::Owner::"), "lang", F.lit("Source")))
    pieces = F.sha2(F.array_join(F.array_sort(text.word_pieces(told)), " "), 256)
    return table(spark, sf_dir, "documents").select("doc_id", pieces.alias("pieces"), text.names_target(told, target).alias("names_target"))


_TRAILER = "|".join(text.TRAILERS)
_MORE = r"\nSigned-off-by: a\n  # note\nsee https://x.y/z?q=1 end  \n\n\n\nRefs #3\nlast\n\n"


@query(
    f"""WITH a AS (SELECT doc_id, text || replace('{_MORE}', '\\n', chr(10)) AS m FROM documents),
b AS (SELECT doc_id, list_transform(string_split(m, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')) AS l FROM a),
c AS (SELECT doc_id, array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '(?i)^\\s*({_TRAILER})\\s*[:#]') AND NOT regexp_matches(x, '^\\s*#')), chr(10)) AS m FROM b)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(m, 'https?://[^ \\t\\n\\r\\f\\v]+', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS message FROM c"""
)
def commit_messages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.clean_message(F.concat("text", F.lit(_MORE.replace("\\n", "\n")))).alias("message"))


_CODE = ' see a_b in src/x.rs: "q" [k] JSON, Return it'


@query(
    f"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text || '{_CODE}', '[ \\t\\n\\r\\f\\v,.]+'), lambda w: w <> '' AND NOT regexp_matches(w, '[_:{{}}"\\[\\]]') AND w NOT IN ('JSON', 'Return')), ' ') AS question,
'concept ' || lang || ' fix' || doc_id || ' term' AS rewritten FROM documents"""
)
def bare_questions(spark, sf_dir):
    """Questions without what looks like code, and queries put together anew."""
    d = F.col("doc_id").cast("string")
    again = suites.reformulated(F.concat(F.lit("concept "), F.col("lang")), F.concat(F.lit("fix"), d), F.lit("term"))
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_identifiers(F.concat("text", F.lit(_CODE))).alias("question"), again.alias("rewritten"))


_PROSE = "(" + ", ".join(f"'{w}'" for w in text.PROSE) + ")"


@query(
    f"""WITH q AS (SELECT doc_id, lang, replace(text, ' ' || lang || ' ', ' `' || lang || '_name that` ') || ' where `parse_it` and parse_it Upper' AS q FROM documents),
t AS (SELECT doc_id, lang, 5 AS w, unnest(regexp_extract_all(array_to_string(regexp_extract_all(q, '`([^`]+)`', 1), ' '), '[A-Za-z_][A-Za-z0-9_]{{3,}}')) AS term FROM q
  UNION ALL SELECT doc_id, lang, 1 AS w, unnest(regexp_extract_all(q, '[A-Za-z_][A-Za-z0-9_]{{3,}}')) FROM q)
SELECT doc_id, term, CAST(sum(CASE WHEN w = 5 THEN 5 WHEN regexp_matches(term, '[_A-Z]') THEN 3 ELSE 1 END) AS BIGINT) AS weight FROM t
WHERE (w = 5 OR lower(term) NOT IN {_PROSE}) AND term <> lang || '_name' GROUP BY ALL"""
)
def question_weights(spark, sf_dir):
    quoted = F.replace("text", F.concat(F.lit(" "), "lang", F.lit(" ")), F.concat(F.lit(" `"), "lang", F.lit("_name that` ")))
    asked = table(spark, sf_dir, "documents").select("doc_id", F.concat(quoted, F.lit(" where `parse_it` and parse_it Upper")).alias("q"), F.array(F.concat("lang", F.lit("_name"))).alias("gold"))
    return text.question_terms(asked, "doc_id", "q", "gold")


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{2,}') AS w FROM documents),
i AS (SELECT doc_id, w, list_filter(regexp_extract_all(regexp_replace(array_to_string(w, ' '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+'), lambda x: length(x) > 2) AS i FROM w)
SELECT doc_id, CAST(len(list_distinct(list_transform(list_concat(w, i), lambda x: lower(x)))) AS INTEGER) AS words FROM i"""
)
def text_vocabulary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.vocabulary(F.col("text"))).alias("words"))


_NAME_OF = {"en": "ofThe", "de": "in_der", "fr": "deLa", "es": "queLa"}
_APART = {"en": "of the", "de": "in der", "fr": "de la", "es": "que la"}


def _by_lang(values: dict[str, str]) -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(
    f"""WITH a AS (SELECT doc_id, lang, '/** ' || text || ' {{@link a.b}} `code span` ' || chr(10) || '  @param q text' || chr(10) || '*/' AS c FROM documents),
b AS (SELECT doc_id, lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '\\{{@[0-9A-Za-z_]+\\s+[^}}]*\\}}', ' ', 'g'), '`[^`]*`', ' ', 'g'), '(?m)^\\s*@[0-9A-Za-z_]+.*$', ' ', 'g'), '[*/]+', ' ', 'g') AS c FROM a),
t AS (SELECT doc_id, lang, trim(regexp_replace(c, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM b),
v AS (SELECT doc_id, lang, regexp_replace(c, {_by_lang(_APART)}, ' ', 'gi') AS c FROM t),
w AS (SELECT doc_id, lang, regexp_replace(regexp_replace(c, 'in_der', ' ', 'gi'), replace({_by_lang(_APART)}, ' ', ''), ' ', 'gi') AS c, regexp_replace(c, replace({_by_lang(_APART)}, ' ', ''), ' ', 'gi') AS d FROM v)
SELECT doc_id, trim(regexp_replace(CASE WHEN lang = 'de' THEN c ELSE d END, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS prose FROM w WHERE lang IN ('en', 'de', 'fr', 'es')"""
)
def comment_prose(spark, sf_dir):
    """Doc comments without links, code, tags and any spelling of the name they stand above."""
    comment = F.concat(F.lit("/** "), "text", F.lit(" {@link a.b} `code span` \n  @param q text\n*/"))
    name = F.element_at(F.create_map(*[F.lit(x) for pair in _NAME_OF.items() for x in pair]), F.col("lang"))
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin(*_NAME_OF))
    return d.select("doc_id", text.clean_comment(comment, name).alias("prose"))


# ---- test code, leaks, suites ------------------------------------------------------------------

_ENDS = ["/tests/a.rs", "_test.go", "/a.spec.ts", "/contest.rs", "/testing/b.py"]
_SCOPED = f"""f AS (SELECT lang || '/' || doc_id || coalesce({_sql_list(_ENDS)}[doc_id % 12 + 1], '.rs') AS path, replace(text, chr(10) || 'L', chr(10) || ' #[cfg(test)]' || chr(10) || 'L') AS text FROM documents),
l AS (SELECT path, CAST(n AS INTEGER) AS line, x AS text FROM f, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(x, n) WHERE NOT (x = '' AND n = len(string_split(text, chr(10))))),
d AS (SELECT path, line, CASE WHEN line % 11 = 0 THEN 'test_' ELSE '' END || regexp_extract(text, '^[A-Za-z]+') AS leaf FROM l WHERE regexp_matches(text, '^[A-Za-z]+'))"""


@query(
    f"""WITH {_SCOPED}, m AS (SELECT path, min(line) AS marker FROM l WHERE regexp_matches(text, '^\\s*#\\[cfg\\(test\\)\\]') GROUP BY path),
b AS (SELECT path, leaf, min(line) AS first FROM d GROUP BY ALL),
t AS (SELECT d.path, d.leaf, regexp_matches(d.path, '{suites.TEST_FOLDER}') OR regexp_matches(string_split(d.path, '/')[-1], '{suites.TEST_FILE}') OR regexp_matches(d.leaf, '{suites.TEST_NAME}') OR coalesce(b.first > m.marker, FALSE) AS is_test
  FROM d JOIN b USING (path, leaf) LEFT JOIN m ON m.path = d.path)
SELECT path, count(*) AS definitions, count(*) FILTER (is_test) AS tests FROM t GROUP BY path"""
)
def test_code(spark, sf_dir):
    k = F.col("doc_id")
    end = F.coalesce(F.try_element_at(F.array(*[F.lit(e) for e in _ENDS]), (k % 12 + 1).cast("int")), F.lit(".rs"))
    some = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), k.cast("string"), end).alias("path"), F.replace("text", F.lit("\nL"), F.lit("\n #[cfg(test)]\nL")).alias("text"))
    first = F.regexp_extract("text", "^[A-Za-z]+", 0)
    definitions = lines.lines(some).where(first != "").select("path", "line", F.concat(F.when(F.col("line") % 11 == 0, "test_").otherwise(""), first).alias("leaf"))
    return suites.test_code(definitions, some).groupBy("path").agg(F.count(F.lit(1)).alias("definitions"), F.count_if("is_test").alias("tests"))


_LEAVES = ["the", "License", "les", "a.b", "ing", "der"]
_STEMS = ["with", "la", "Und", "of"]
_SPELT = r"regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])' || replace({1}, '.', '\.') || '($|[^\p{{L}}\p{{N}}\p{{M}}_])')"


@query(
    f"""WITH a AS (SELECT doc_id, text, {_sql_list(_LEAVES)}[doc_id % 6 + 1] AS leaf, {_sql_list(_STEMS)}[doc_id % 4 + 1] AS stem FROM documents)
SELECT doc_id, {_SPELT.format("text", "leaf")} OR (stem IN ('with', 'la') AND {_SPELT.format("text", "stem")}) AS leaks, {_SPELT.format("text", "leaf")} OR {_SPELT.format("text", "stem")} AS leaks_any FROM a"""
)
def prose_leaks(spark, sf_dir):
    k = F.col("doc_id")
    identity = F.concat(F.lit("src/deep/"), _pick(k, _STEMS), F.lit(".py::Owner::"), _pick(k, _LEAVES))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", suites.leaks(F.col("text"), identity, F.array(F.lit("with"), F.lit("la"))).alias("leaks"), suites.leaks(F.col("text"), identity).alias("leaks_any"))


@query(
    r"""WITH a AS (SELECT doc_id, lang AS symbol, CASE WHEN doc_id % 9 > 0 THEN text END AS comment, doc_id % 3 AS definitions FROM documents),
b AS (SELECT *, CASE WHEN comment IS NOT NULL THEN len(regexp_split_to_array(trim(comment), '\s+')) ELSE -1 END AS words FROM a)
SELECT CASE WHEN definitions <> 1 THEN 'several definitions' WHEN coalesce(trim(comment), '') = '' THEN 'no comment' WHEN words < 30 THEN 'too short' WHEN words > 300 THEN 'too long' WHEN contains(lower(comment), lower(symbol)) THEN 'names the symbol' END AS refusal, count(*) AS n FROM b GROUP BY 1"""
)
def mechanical_refusals(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("symbol"), F.when(k % 9 > 0, F.col("text")).alias("comment"), (k % 3).alias("definitions"))
    return suites.refusal_histogram(rows, suites.mechanical_rules(30, 300))


_GOLD_NAMES = ["p.py::the", "q.py::license", "r.py::ing", "s.py::der", "t.py::xyzzy", "u.py::les", "v.py::w"]


def _leaked(ids: str, prose: str, negate: str = "") -> str:
    leaf, stem = _SPELT.format(prose, "split_part(i, '::', 2)"), _SPELT.format(prose, "split_part(split_part(i, '::', 1), '.', 1)")
    return f"len(list_filter({ids}, lambda i: {negate} ({leaf} OR {stem})))"


@query(
    f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN text ELSE ' ' END AS message, {_sql_list(_GOLD_NAMES)}[1:doc_id % 8] AS ids FROM documents)
SELECT CASE WHEN trim(message) = '' THEN 'no message' WHEN doc_id % 8 = 0 THEN 'no symbol changed' WHEN doc_id % 8 > 5 THEN 'too many symbols' WHEN doc_id % 3 = 0 THEN 'only tests'
  WHEN {_leaked("ids", "message")} > 0 THEN 'leaks the answer' END AS refusal, count(*) AS n FROM a GROUP BY 1"""
)
def commit_refusals(spark, sf_dir):
    k = F.col("doc_id")
    ids = F.slice(F.array(*[F.lit(n) for n in _GOLD_NAMES]), F.lit(1), (k % 8).cast("int"))
    changed = F.when(k % 3 == 0, F.array(F.lit("tests/a.py"))).otherwise(F.array(F.lit("src/a.py"), F.lit("tests/a.py")))
    rows = table(spark, sf_dir, "documents").select(F.when(k % 10 > 0, F.col("text")).otherwise(" ").alias("message"), ids.alias("identities"), changed.alias("files"))
    return suites.refusal_histogram(rows, suites.commit_rules())


@query(
    f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN text END AS issue, {_sql_list(_GOLD_NAMES)}[1:doc_id % 3] AS gold FROM documents)
SELECT CASE WHEN coalesce(trim(issue), '') = '' THEN 'no issue text' WHEN doc_id % 3 = 0 THEN 'no gold' WHEN doc_id % 5 = 0 THEN 'gold isn''t in the corpus'
  WHEN {_leaked("gold", "issue", "NOT")} = 0 THEN 'leaks the answer' END AS refusal, count(*) AS n FROM a GROUP BY 1"""
)
def localisation_refusals(spark, sf_dir):
    k, names = F.col("doc_id"), F.array(*[F.lit(n) for n in _GOLD_NAMES])
    defined = F.when(k % 5 == 0, F.array(F.lit("z::z"))).otherwise(names)
    rows = table(spark, sf_dir, "documents").select(F.when(k % 10 > 0, F.col("text")).alias("issue"), F.slice(names, F.lit(1), (k % 3).cast("int")).alias("gold"), defined.alias("defined"))
    return suites.refusal_histogram(rows, suites.localisation_rules())


@query(
    f"""WITH {FILES}, q AS (SELECT doc_id // 2 AS task_id, doc_id, path FROM files)
SELECT task_id, 'error' AS severity, 'doubled id' AS problem FROM q GROUP BY task_id HAVING count(*) > 1
UNION ALL SELECT task_id, 'error', 'blank question' FROM q WHERE doc_id % 7 = 0 UNION ALL SELECT task_id, 'error', 'no answer' FROM q WHERE doc_id % 5 = 0
UNION ALL SELECT DISTINCT task_id, 'error', 'no file gone/' || path FROM q WHERE doc_id % 17 > 0 AND doc_id % 11 = 0
UNION ALL SELECT DISTINCT task_id, 'error', 'not in ' || path FROM q WHERE doc_id % 17 > 0 AND doc_id % 11 > 0 AND doc_id % 13 = 0
UNION ALL SELECT task_id, 'warning', 'no evidence' FROM q WHERE doc_id % 17 = 0"""
)
def suite_problems(spark, sf_dir):
    f, k = files(spark, sf_dir), F.col("doc_id")
    holds = F.when(k % 13 == 0, F.array(F.col("text"), F.lit("xyzzy$"))).otherwise(F.array("text"))
    proof = F.struct(F.when(k % 11 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path"), holds.alias("contains"))
    q = f.select(
        F.floor(k / 2).alias("task_id"), F.when(k % 7 == 0, " ").otherwise("what").alias("question"), F.when(k % 5 > 0, F.lit("{}")).alias("expected_json"), F.when(k % 17 > 0, F.array(proof)).alias("evidence")
    )
    return suites.suite_problems(q, f.select("path", "text"))


_CALL_OF = """c AS (SELECT l_orderkey AS o, l_orderkey % 4 AS kind, CASE WHEN l_orderkey % 4 = 2 THEN CASE WHEN l_suppkey % 9 > 0 THEN 'read_source' ELSE 'find_symbol' END WHEN l_suppkey % 7 > 0 THEN 'search_exact' ELSE 'read_source' END AS name,
  l_suppkey % 2 = 0 AS regex, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 3 END AS most, CASE WHEN l_orderkey % 4 = 2 THEN [3] WHEN l_linenumber % 2 = 1 THEN [1, 2] ELSE [2] END AS lines, CASE WHEN l_partkey % 8 > 0 THEN 3 ELSE 4 END AS last FROM lineitem)"""


@query(
    f"""WITH {_CALL_OF}, s AS (SELECT o, any_value(kind) AS kind, coalesce(bool_or(name = 'search_exact' AND regex AND lines = [1, 2]), FALSE) AS by_regex,
  bool_and(name = 'search_exact' AND coalesce(most, 20) BETWEEN 1 AND 2) AND list_sort(list_distinct(flatten(list(lines) FILTER (name = 'search_exact')))) = [1, 2] AS by_page, bool_and(name = 'read_source' AND last = 3) AS by_read FROM c GROUP BY o)
SELECT o AS session, CASE kind WHEN 0 THEN by_regex WHEN 1 THEN coalesce(by_page, FALSE) WHEN 2 THEN by_read ELSE TRUE END AS satisfied,
  CAST(CASE WHEN o % 5 > 0 AND o % 6 > 0 AND CASE kind WHEN 0 THEN by_regex WHEN 1 THEN coalesce(by_page, FALSE) WHEN 2 THEN by_read ELSE TRUE END THEN 1 ELSE 0 END AS INTEGER) AS score FROM s"""
)
def competency_scores(spark, sf_dir):
    o, s, p = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
    read = o % 4 == 2
    name = F.when(read, F.when(s % 9 > 0, "read_source").otherwise("find_symbol")).otherwise(F.when(s % 7 > 0, "search_exact").otherwise("read_source"))
    shown = F.when(read, F.array(F.lit(3))).when(F.col("l_linenumber") % 2 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    call = F.struct(
        name.alias("name"), (s % 2 == 0).alias("regex"), F.when(p % 5 > 0, p % 3).alias("limit"), F.lit("f.py").alias("path"), F.lit(3).alias("start_line"), F.when(p % 8 > 0, 3).otherwise(4).alias("end_line"), shown.alias("lines")
    )
    per = table(spark, sf_dir, "lineitem").groupBy(o.alias("session")).agg(F.collect_list(call).alias("calls"))
    k = F.col("session")
    kind = F.when(k % 4 == 0, "regex").when(k % 4 == 1, "paging").when(k % 4 == 2, "read").otherwise("free")
    expected = F.when(k % 4 == 2, F.array(F.lit(3))).otherwise(F.array(F.lit(2), F.lit(1)))
    rows = per.select("session", "calls", kind.alias("kind"), F.lit("f.py").alias("file"), expected.alias("expected"), (k % 5 > 0).alias("correct"), (k % 6 > 0).alias("format_correct"))
    return suites.competency(rows).select("session", "satisfied", "score")


# ---- verdicts ----------------------------------------------------------------------------------

_MODES = f"""{_SHOWN}, t AS (SELECT conv_id AS trial, conv_id % 4 AS condition, CASE WHEN conv_id % 6 = 0 THEN 1.0 ELSE 0.5 END AS credit,
  CASE WHEN conv_id % 5 > 0 THEN list_distinct(list(role) FILTER (turn < 1 + conv_id % 3)) END AS got FROM conversations GROUP BY conv_id),
w AS (SELECT *, EXISTS (SELECT 1 FROM shown s WHERE s.session = trial AND s.path = 'assistant' AND s.start <= trial % 17 + 2 AND s."end" >= trial % 17) AS saw FROM t)"""


@query(
    f"""WITH {_MODES} SELECT condition, CASE WHEN credit = 1 THEN 'correct' WHEN NOT saw THEN 'never_saw_evidence' WHEN got IS NULL OR len(got) = 0 THEN 'incomplete'
  WHEN len(list_filter(got, lambda g: g NOT IN ('assistant', 'user'))) = 0 AND len(got) < 2 THEN 'incomplete' ELSE 'misread' END AS mode, count(*) AS n FROM w GROUP BY ALL"""
)
def failure_modes(spark, sf_dir):
    k = F.col("conv_id")
    said = F.collect_set(F.when(F.col("turn") < 1 + k % 3, F.col("role")))
    trials = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("said")).select(
        k.alias("trial"), k.alias("task_id"), (k % 4).alias("condition"), F.when(k % 6 == 0, 1.0).otherwise(0.5).alias("credit"), F.when(k % 5 > 0, F.col("said")).alias("got"), F.array(F.lit("assistant"), F.lit("user")).alias("gold")
    )
    wanted = trials.select("task_id", F.lit("assistant").alias("path"), (F.col("task_id") % 17).alias("start"), (F.col("task_id") % 17 + 2).alias("end"))
    shown = _shown(spark, sf_dir).withColumnRenamed("session", "trial")
    return measures.failure_modes(measures.saw_evidence(shown, wanted, trials))


_SIDES = """r AS (SELECT conv_id AS k, list_distinct(flatten(list(string_split(text, ' ')) FILTER (turn = 0))) AS gold, list_distinct(flatten(list(string_split(text, ' ')) FILTER (role = 'assistant'))) AS seen,
  coalesce(list_distinct(flatten(list(string_split(text, ' ')) FILTER (role = 'user' AND turn > 0))), []) AS control, sum(length(text)) % 3 AS t, sum(length(text)) % 2 + 1 AS c FROM conversations GROUP BY conv_id),
m AS (SELECT *, list_filter(gold, lambda x: NOT list_contains(seen, x)) AS missing FROM r WHERE gold IS NOT NULL AND seen IS NOT NULL)"""


@query(
    f"""WITH {_SIDES} SELECT count(*) AS questions_paired, count(*) FILTER (t < c) AS treatment_regressions, count(*) FILTER (t > c) AS treatment_improvements, count(*) FILTER (t < c AND len(missing) > 0) AS premature_stop,
count(*) FILTER (t < c AND len(missing) = 0) AS evidence_seen, count(*) FILTER (t < c AND len(list_filter(missing, lambda x: list_contains(control, x))) > 0) AS expansion_skipped FROM m"""
)
def closure_verdicts(spark, sf_dir):
    words = F.split("text", " ")
    told = lambda when: F.array_distinct(F.flatten(F.collect_list(F.when(when, words))))
    size = F.sum(F.char_length("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        told(F.col("turn") == 0).alias("gold"), told(F.col("role") == "assistant").alias("seen"), told((F.col("role") == "user") & (F.col("turn") > 0)).alias("control_seen"),
        (size % 3).alias("treatment_credit"), (size % 2 + 1).alias("control_credit"),
    )
    return measures.closure_report(rows.where((F.size("gold") > 0) & (F.size("seen") > 0)))


_REACH = """r AS (SELECT role, length(text) % 5 = 0 AS solved, CASE WHEN length(text) % 3 = 1 THEN length(text) % 4 END AS depth, contains(text, 'ing') AS seed_defined, contains(text, 'la') AS workable, contains(text, 'er') AS visible, strlen(text) AS b FROM conversations),
v AS (SELECT *, CASE WHEN solved THEN 'solved' WHEN depth IS NOT NULL THEN 'wrong_reach' WHEN NOT seed_defined THEN CASE WHEN workable THEN 'unchosen' ELSE 'unavailable' END WHEN workable THEN 'unchosen' WHEN visible THEN 'wrong_level' ELSE 'unavailable' END AS verdict FROM r)"""


@query(
    f"""WITH {_REACH} SELECT role, count(*) AS structural_decisions, count(*) FILTER (verdict = 'unavailable') AS unavailable, count(*) FILTER (verdict = 'unchosen') AS unchosen, count(*) FILTER (verdict = 'wrong_level') AS wrong_level,
count(*) FILTER (verdict = 'wrong_reach') AS wrong_reach, count(*) FILTER (depth = 0) AS at_gold, count(*) FILTER (depth = 1) AS one_hop, count(*) FILTER (depth > 1) AS two_to_five_hops, count(*) FILTER (depth IS NULL) AS unreachable,
count(*) FILTER (seed_defined) AS indexed_seeds, CAST(sum(b) AS BIGINT) AS returned_bytes_total, median(b) AS returned_bytes_median FROM v GROUP BY role"""
)
def reach_verdicts(spark, sf_dir):
    n, t = F.char_length("text"), F.col("text")
    rows = table(spark, sf_dir, "conversations").select(
        "role", (n % 5 == 0).alias("solved"), F.when(n % 3 == 1, n % 4).alias("depth"), F.contains(t, F.lit("ing")).alias("seed_defined"), F.contains(t, F.lit("la")).alias("workable"), F.contains(t, F.lit("er")).alias("visible"),
        F.octet_length("text").alias("returned_bytes"),
    )
    return measures.reach_report(rows, ["role"])


_TAIL = """CASE WHEN len(p) > 1 AND regexp_matches(p[-2], '^\\p{Lu}') THEN p[-2] || '::' || p[-1] ELSE p[-1] END"""


def _tails(symbols: str) -> str:
    parts = "list_filter(regexp_split_to_array(s, '::|/'), lambda x: x <> '' AND NOT suffix(x, '.rs'))"
    return f"list_sort(list_transform(list_transform({symbols}, lambda s: {parts}), lambda p: coalesce({_TAIL}, 'none')))"


@query(
    f"""WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '[A-Za-z]')) AS w FROM documents),
a AS (SELECT doc_id, list_transform(w, lambda x: 'src/a.rs::' || x) AS gold, CASE doc_id % 4 WHEN 0 THEN list_transform(w, lambda x: 'src/a.rs::' || x) WHEN 1 THEN list_transform(w, lambda x: 'b.rs::' || x) WHEN 2 THEN list_transform(w, lambda x: 'Owner::' || x) END AS got FROM w),
t AS (SELECT doc_id % 3 AS condition, doc_id % 4 = 0 AS strict, coalesce({_tails("got")} = {_tails("gold")}, FALSE) AS alike FROM a)
SELECT condition, count(*) AS trials, count(*) FILTER (strict) AS strict, count(*) FILTER (strict OR alike) AS symbol_resolved, count(*) FILTER (alike AND NOT strict) AS notation_only FROM t GROUP BY 1"""
)
def notation_diagnostic(spark, sf_dir):
    k = F.col("doc_id")
    words = F.filter(F.split("text", " "), lambda x: x.rlike("[A-Za-z]"))
    spelt = lambda head: F.transform("w", lambda x: F.concat(F.lit(head), x))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    got = F.when(k % 4 == 0, spelt("src/a.rs::")).when(k % 4 == 1, spelt("b.rs::")).when(k % 4 == 2, spelt("Owner::"))
    return measures.notation(rows.select((k % 3).alias("condition"), (k % 4 == 0).alias("strict"), spelt("src/a.rs::").alias("gold"), got.alias("got")), ["condition"])


@query(
    """WITH o AS (SELECT o_custkey AS "group", CAST(round(o_totalprice / 5000) AS BIGINT) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders),
w AS (SELECT "group", max(v) FILTER (place = 1) AS a, max(v) FILTER (place = 2) AS b FROM o GROUP BY 1) SELECT "group", CASE WHEN a <> 0 AND abs(a - b) <= greatest(1, 0.02 * a) THEN CAST(a AS DOUBLE) END AS converged FROM w"""
)
def convergence(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("run"), F.round(F.col("o_totalprice") / 5000).alias("tokens"))
    return measures.converged(r)


# ---- end to end --------------------------------------------------------------------------------

_E2E = {
    "input_tokens": "o_orderkey % 997", "output_tokens": "o_custkey % 89", "reasoning_tokens": "CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 31 END", "retrieval_bytes": "o_orderkey % 4099",
    "context_token_turns": "o_orderkey % 8209", "retrieval_calls": "o_orderkey % 13", "source_reads": "o_orderkey % 7", "retrieval_latency_ms": "CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 1009 END",
    "wall_time_ms": "o_custkey % 5003", "calls_to_first_hit": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END", "calls_after_first_hit": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 11 END",
    "bytes_after_first_hit": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 2053 END", "input_tokens_after_first_hit": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 499 END",
}
_TRIALS = {
    "system": "o_orderpriority", "category": "CASE WHEN o_custkey % 9 > 0 THEN o_orderstatus END", "task_id": "o_custkey", "status": "CASE WHEN o_orderkey % 10 > 0 THEN 'completed' ELSE 'failed' END",
    "correct": "o_orderkey % 2 = 0", "resolved_correct": "o_orderkey % 2 = 0 OR o_orderkey % 5 = 0", "resolved_credit": "CAST(o_orderkey % 5 AS DOUBLE) / 4", "budget_exhausted": "o_orderkey % 17 = 0", "cost_usd": "CAST(o_custkey % 64 AS DOUBLE) / 16",
    "first_hit_call": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END", "answered_without_evidence": "o_orderkey % 3 = 0 AND o_orderkey % 4 > 0", "contaminated": "CASE WHEN o_orderkey % 8 > 0 THEN o_orderkey % 19 = 0 END", **_E2E,
}


def _rounded(value: str, where: str = "TRUE") -> str:
    return f"round_even(median(CAST({value} AS DOUBLE)) FILTER ({where}), 1)"


_E2E_COLUMNS = ", ".join(f"{_rounded(m)} AS {m}_median, round_even(avg(CAST({m} AS DOUBLE)), 1) AS {m}_mean, count({m}) AS {m}_n" for m in _E2E)


@query(
    f"""WITH t AS (SELECT {", ".join(f"{v} AS {n}" for n, v in _TRIALS.items())} FROM orders), u AS (SELECT * REPLACE (NULL AS category) FROM t UNION ALL SELECT * REPLACE (coalesce(category, 'uncategorized') AS category) FROM t)
SELECT system, category, count(*) AS trials, count(DISTINCT task_id) AS questions, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (correct) AS correct, count(*) FILTER (resolved_correct) AS resolved_correct,
round_even(avg(resolved_credit), 3) AS resolved_credit_mean, count(*) FILTER (budget_exhausted) AS budget_exhausted, round_even(sum(cost_usd), 4) AS cost_usd, count(first_hit_call) AS trials_with_hit, count(*) FILTER (answered_without_evidence) AS answered_without_evidence,
count(*) FILTER (contaminated) AS contaminated, count(*) FILTER (answered_without_evidence AND NOT resolved_correct) AS wrong_without_evidence, {_E2E_COLUMNS},
{_rounded("input_tokens", "resolved_correct")} AS resolved_input_tokens_median, {_rounded("retrieval_bytes", "resolved_correct")} AS resolved_retrieval_bytes_median FROM u GROUP BY ALL"""
)
def end_to_end_measures(spark, sf_dir):
    return measures.end_to_end(table(spark, sf_dir, "orders").select(*[F.expr(v).alias(n) for n, v in _TRIALS.items()]))


# ---- grades ------------------------------------------------------------------------------------

_SETS = """w AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(text, '[a-z]{5,}')) AS w FROM documents)"""


def _replies(spark, sf_dir, kinds: int):
    """doc_id, lang, gold, and a reply made of the gold's words in the way its kind says."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{5,})"), F.lit(1)))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("w"), (F.col("doc_id") % kinds).alias("kind"))
    payload = lambda items: F.to_json(F.struct(items.alias("answer")))
    gold, back = payload(F.col("w")), payload(F.reverse("w"))
    fenced = lambda body: F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    made = [
        gold, back, payload(F.concat(F.col("w"), F.slice("w", 1, 1))), payload(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))), F.concat(F.lit("So:\n"), fenced(back), F.lit("\nDone.")),
        F.concat(F.lit("```\nfn f\n```\n"), fenced(gold)), F.concat(fenced(gold), F.lit("\n"), fenced(gold)), F.concat(F.lit('{"answer":[],'), F.substring(gold, 2, 1 << 30)), F.concat(F.lit("It is "), gold, F.lit(" I think")),
        F.concat(gold, F.lit(" or "), back), F.array_join("w", " "), F.lit(None).cast("string"),
    ]
    reply = F.coalesce(*[F.when(F.col("kind") == i, m) for i, m in enumerate(made[:kinds])])
    return rows.select("doc_id", "lang", "w", "kind", gold.alias("gold"), reply.alias("reply"))


@query(
    f"""WITH {_SETS}, k AS (SELECT doc_id, doc_id % 12 AS kind, len(w) AS n FROM w)
SELECT doc_id, kind IN (0, 1, 4) OR (kind IN (2, 3) AND n = 0) AS correct_v2, kind IN (0, 1, 4, 5) OR (kind IN (2, 3) AND n = 0) AS correct_v3, kind IN (0, 1, 2, 3) AS format_v2, kind IN (0, 1, 2, 3) AS format_v3 FROM k"""
)
def strict_grades(spark, sf_dir):
    """Replies made of each text's own words: in any order, one twice, one missing, fenced, fenced twice, a key twice, in prose."""
    rows = _replies(spark, sf_dir, 12)
    told = rows.select("doc_id", *[grading.strict_grade(F.col("reply"), F.col("gold"), F.lit(True), v).alias(f"g{v}") for v in (2, 3)])
    return told.select("doc_id", *[F.coalesce(f"g{v}.{c}", F.lit(False)).alias(f"{n}_v{v}") for v in (2, 3) for c, n in (("correct", "correct"), ("format_correct", "format"))])


@query(
    f"""WITH {_SETS}, k AS (SELECT lang, doc_id % 12 AS kind, len(w) AS n, doc_id % 10 = 0 AS gone, doc_id % 4 = 0 AS first FROM w),
o AS (SELECT *, CASE WHEN gone THEN 'excluded_unfinished' WHEN kind IN (0, 1, 4, 8) OR (kind IN (2, 3) AND n = 0) THEN 'payload_matches' WHEN kind IN (2, 3) THEN 'payload_differs' ELSE 'manual_review' END AS outcome FROM k)
SELECT lang AS arm, outcome, count(*) AS n, count(*) FILTER (first AND NOT gone) AS original_passes, count(*) FILTER (NOT first AND outcome = 'payload_matches') AS recovered FROM o GROUP BY ALL"""
)
def payload_audit(spark, sf_dir):
    k = F.col("doc_id")
    rows = _replies(spark, sf_dir, 12).select(F.col("lang").alias("arm"), F.when(k % 10 > 0, "completed").otherwise("failed").alias("status"), (k % 4 == 0).alias("correct"), F.col("reply").alias("answer"), "gold", F.lit(True).alias("as_set"))
    return measures.payload_audit(rows, ["arm"])


_CREDIT = """w AS (SELECT DISTINCT doc_id, lang, regexp_replace(source, '[^a-z0-9]', '', 'g') AS source, unnest(regexp_extract_all(text, '[a-z]{6,}')) AS word FROM documents),
d AS (SELECT DISTINCT lang || '/' || source || '.py' AS path, lang, source, word FROM w), n AS (SELECT word, count(*) AS n FROM d GROUP BY word), s AS (SELECT word, source, count(*) AS n FROM d GROUP BY ALL),
a AS (SELECT doc_id, word, CASE doc_id % 3 WHEN 0 THEN n.n = 1 WHEN 1 THEN s.n = 1 ELSE TRUE END AS sure FROM w JOIN n USING (word) JOIN s USING (word, source) WHERE length(word) % 4 > 0)"""


@query(
    f"""WITH {_CREDIT}, g AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1), m AS (SELECT doc_id, count(*) FILTER (sure) AS hit, count(*) FILTER (NOT sure) AS extra FROM a GROUP BY 1)
SELECT doc_id, round(greatest(0, (coalesce(hit, 0) - coalesce(extra, 0)) / n), 9) AS credit FROM g LEFT JOIN m USING (doc_id)"""
)
def graded_credit(spark, sf_dir):
    """Gold: where each word of a text stands; answers: some of the words, bare, with their file, or with their whole path."""
    source = F.regexp_replace("source", "[^a-z0-9]", "")
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{6,})"), F.lit(1))))
    w = table(spark, sf_dir, "documents").select("doc_id", "lang", source.alias("source"), words.alias("word"))
    path = F.concat("lang", F.lit("/"), "source", F.lit(".py"))
    index = w.select(path.alias("path"), F.lit(None).cast("string").alias("owner"), F.col("word").alias("name")).distinct()
    gold = w.select("doc_id", F.concat_ws("::", path, "word").alias("symbol"))
    k = F.col("doc_id")
    spelt = F.when(k % 3 == 0, F.col("word")).when(k % 3 == 1, F.concat("source", F.lit(".py::"), "word", F.lit("()"))).otherwise(F.concat(path, F.lit("::"), "word"))
    answers = w.where(F.char_length("word") % 4 > 0).select("doc_id", spelt.alias("symbol"))
    return grading.set_credit(answers, gold, index, ["doc_id"]).withColumn("credit", F.round("credit", 9))


@query(
    """WITH w AS (SELECT doc_id, list_transform(string_split(lower(text), ' '), lambda x: x) AS w FROM documents), a AS (SELECT doc_id, w[1:len(w) // 2] AS q, w[len(w) // 3 + 1:len(w) // 3 + len(w) // 2] AS o, w[len(w) // 4 + 1:len(w)] AS r FROM w)
SELECT doc_id AS task_id, CAST(len(list_distinct(list_filter(r, lambda x: list_contains(q, x) AND NOT list_contains(o, x)))) AS INTEGER) AS from_question,
  CAST(len(list_distinct(list_filter(r, lambda x: list_contains(o, x) AND NOT list_contains(q, x)))) AS INTEGER) AS from_observed,
  CAST(len(list_distinct(list_filter(r, lambda x: list_contains(o, x) AND list_contains(q, x)))) AS INTEGER) AS from_both,
  CAST(len(list_distinct(list_filter(r, lambda x: NOT list_contains(o, x) AND NOT list_contains(q, x)))) AS INTEGER) AS new FROM a"""
)
def query_vocabulary(spark, sf_dir):
    words, n = F.split(F.lower("text"), " "), F.size("w")
    half, third, quarter = (F.floor(n / k).cast("int") for k in (2, 3, 4))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), words.alias("w")).select(
        "task_id", F.slice("w", F.lit(1), half).alias("question"), F.slice("w", third + 1, half).alias("observed"), F.slice("w", quarter + 1, n - quarter).alias("rewritten")
    )
    return measures.vocabulary_provenance(rows)


# ---- neighbourhoods, imports, lower bounds -------------------------------------------------------


@query(
    f"""WITH {GRAPH}, d AS (SELECT name, 'definition' AS relation, path, line, 'page' AS other FROM symbols),
i AS (SELECT name, 'inbound' AS relation, path, min(line) AS line, caller AS other FROM calls GROUP BY name, path, caller), o AS (SELECT caller AS name, 'outbound' AS relation, path, min(line) AS line, name AS other FROM calls GROUP BY caller, path, name),
m AS (SELECT nullif(regexp_extract(path, '://([^/]+)', 1), '') AS name, 'member' AS relation, path, line, name AS other FROM symbols)
SELECT * FROM d UNION ALL SELECT * FROM i UNION ALL SELECT * FROM o UNION ALL SELECT * FROM m WHERE name IS NOT NULL"""
)
def one_hop_relations(spark, sf_dir):
    """Everything one hop away from every name; a pair of names counts once per file and side, at its first line."""
    return graph.relations(symbols(spark, sf_dir), refs(spark, sf_dir))


@query(
    f"""WITH {FILES}, i AS (SELECT path, line, regexp_extract(text, '^[A-Za-z]+') AS statement FROM lines WHERE regexp_matches(text, '^[A-Za-z]+') AND regexp_matches(path, '^(en|fr)/')),
p AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/'), line, statement) AS place FROM i) SELECT path, line, statement, (SELECT count(*) FROM p) > 20 AS more FROM p WHERE place <= 20"""
)
def page_imports(spark, sf_dir):
    """The first words of lines as imports; the page is the files of two languages."""
    f = files(spark, sf_dir)
    word = F.regexp_extract("text", "^[A-Za-z]+", 0)
    imports = lines.lines(f).where(word != "").select("path", "line", word.alias("statement"))
    return graph.page_imports(imports, f.where(F.col("path").rlike("^(en|fr)/")).select("path"))


@query(
    """WITH g AS (SELECT conv_id, list_distinct(flatten(list(list_transform(regexp_extract_all(text, '[a-z]{6,}'), lambda w: 'src/' || w[1:2] || '.py::' || w)))) AS ids, count(*) FILTER (role = 'assistant') AS steps FROM conversations GROUP BY conv_id)
SELECT conv_id AS task_id, CAST(len(ids) AS INTEGER) AS gold_identities, CAST(len(list_distinct(list_transform(ids, lambda i: split_part(i, '::', 1)))) AS INTEGER) AS gold_files,
CAST(CASE WHEN len(ids) > 0 THEN 1 + len(list_distinct(list_transform(ids, lambda i: split_part(i, '::', 1)))) ELSE 0 END AS INTEGER) AS minimum_lexical_calls, CAST(nullif(steps, 0) AS INTEGER) AS structural_calls FROM g"""
)
def lexical_bounds(spark, sf_dir):
    named = F.transform(F.regexp_extract_all("text", F.lit("([a-z]{6,})"), F.lit(1)), lambda w: F.concat(F.lit("src/"), F.substring(w, 1, 2), F.lit(".py::"), w))
    per = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("task_id")).agg(
        F.array_distinct(F.flatten(F.collect_list(named))).alias("ids"), F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("steps")
    )
    return per.select("task_id", suites.lower_bound(F.col("ids"), F.col("steps")).alias("b")).select("task_id", "b.*")
