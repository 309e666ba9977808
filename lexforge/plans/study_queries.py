"""Further registered queries: audits, suites, logs and text functions, each beside its SQL.

Adapters derive the operators' inputs from the tables, mostly by remainders of keys, so that every
branch of an operator is met; the SQL contains the same adapters and states the operators' rules anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.operators import graph, lines, measures, power, retrieval, sessions, suites
from lexforge.plans.queries import CALLS, FILES, GRAPH, _busiest, _spans, calls, files, query, refs, symbols, table
from lexforge.sources import logs


def _pick(column, values):
    """The value at the remainder of a key, as the SQL's [..][key % n + 1]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


# ---- paths, names and prose --------------------------------------------------------------------

_LANGUAGE_ROWS = ", ".join(f"('{s}', '{g}', '{f}')" for s, (g, f) in text.LANGUAGES.items())


@query(
    f"""WITH m(suffix, language, family) AS (VALUES {_LANGUAGE_ROWS}),
p AS (SELECT lower(w[1:1 + length(w) % 2]) AS suffix FROM documents, unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}')) AS u(w))
SELECT language, family, count(*) AS files FROM p JOIN m USING (suffix) GROUP BY ALL"""
)
def language_families(spark, sf_dir):
    """Every word of the texts names a file whose suffix is its first letter or two."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1))).alias("w"))
    path = F.concat(F.lit("d.x/"), "w", F.lit("."), F.substring(F.col("w"), F.lit(1), 1 + F.char_length("w") % 2))
    named = words.select(text.language(path).alias("language"), text.family(path).alias("family"))
    return named.where("language IS NOT NULL").groupBy("language", "family").agg(F.count(F.lit(1)).alias("files"))


_NAMES = ["the", "then.", "ing"]


@query(
    r"SELECT name, count(*) AS files FROM documents, (SELECT unnest([{'name': 'the', 'p': '\bthe\b'}, {'name': 'then.', 'p': '\bthen\.'}, {'name': 'ing', 'p': '\bing\b'}], recursive := true)) "
    r"WHERE regexp_matches(text, p) GROUP BY name UNION ALL SELECT 'any of them', count(*) FROM documents WHERE regexp_matches(text, '\bthe\b|\bthen\.|\bing\b')"
)
def whole_name_files(spark, sf_dir):
    """Files that hold a name as a whole, and those eligible for any of several names, in one scan."""
    tests = [(n, text.boundary_pattern(n)) for n in _NAMES] + [("any of them", "|".join(map(text.boundary_pattern, _NAMES)))]
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in tests]), lambda x: x.isNotNull())
    return files(spark, sf_dir).select(F.explode(hits).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("files"))


@query(
    """SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'tool not allowed' WHEN event_id % 3 = 1 THEN 'path outside the corpus' END AS reason FROM events"""
)
def disallowed_calls(spark, sf_dir):
    path = _pick(F.col("event_id"), ["/repo/a.py", "/repository/b.py", "src/c.py"])
    reason = suites.contamination(F.col("event_type"), path, ["click", "view"], "/repo")
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query(
    r"""WITH w AS (SELECT doc_id, './' || replace(replace(text, ' ', '\'), ',', '/.') || '//./a.py' AS p FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split(replace(p, '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS path FROM w"""
)
def normal_paths(spark, sf_dir):
    """Each text as a path: words are folders, with components that say nothing at the commas."""
    written = F.concat(F.lit("./"), F.replace(F.replace("text", F.lit(" "), F.lit("\\")), F.lit(","), F.lit("/.")), F.lit("//./a.py"))
    return table(spark, sf_dir, "documents").select("doc_id", text.normal_path(written).alias("path"))


# ---- search: snippets, binary files ------------------------------------------------------------


@query(
    f"""WITH cut AS (SELECT lang || '/' || CAST(doc_id AS VARCHAR) AS path, split_part(text, ' the ', 1) AS text FROM documents)
SELECT path, count(*) AS matching_lines FROM (SELECT path, unnest(string_split(text, chr(10))) AS l FROM cut) WHERE contains(l, 'er') GROUP BY path"""
)
def binary_cut(spark, sf_dir):
    """A file is searched up to its first NUL."""
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    some = table(spark, sf_dir, "documents").select(path.alias("path"), F.replace("text", F.lit(" the "), F.lit("\0")).alias("text"))
    return lines.exact_matches(some, ["er"]).groupBy("path").agg(F.count(F.lit(1)).alias("matching_lines"))


@query(
    f"""WITH {FILES}, hit AS (SELECT path, line, text, regexp_replace(text, '(?s)(?:[Ll]i[cz]en[cs]e).*', '') AS before FROM lines WHERE regexp_matches(text, '[Ll]i[cz]en[cs]e')),
p AS (SELECT *, CASE WHEN strlen(before) < 120 THEN length(before) ELSE list_min(list_filter(range(1, 121), lambda i: strlen(right(before, i)) >= 120)) END AS back FROM hit)
SELECT path, line, substr(text, length(before) - back + 1, 500) AS snippet, length(before) > back OR length(text) - length(before) + back > 500 AS truncated FROM p"""
)
def match_snippets(spark, sf_dir):
    pattern = "[Ll]i[cz]en[cs]e"
    found = lines.exact_matches(files(spark, sf_dir), [pattern], regex=True)
    return found.select("path", "line", lines.snippet(pattern, regex=True).alias("s")).select("path", "line", "s.snippet", "s.truncated")


@query(
    f"""WITH {FILES}, r AS (SELECT path, CAST(doc_id % 3 + 1 AS INTEGER) AS start_line, CAST(doc_id % 3 + 1 + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 499 END AS INTEGER) AS end_line FROM files),
b AS (SELECT r.path, start_line, end_line, string_agg(text, chr(10) ORDER BY line) AS body FROM r JOIN lines l ON l.path = r.path AND l.line BETWEEN start_line AND end_line GROUP BY ALL)
SELECT path, start_line, end_line, substr(body, 1, 500) AS excerpt, length(body) > 500 AS excerpt_truncated FROM b"""
)
def region_excerpts(spark, sf_dir):
    f, k = files(spark, sf_dir), F.col("doc_id")
    start = (k % 3 + 1).cast("int")
    regions = f.select("path", start.alias("start_line"), (start + F.when(k % 2 == 0, 2).otherwise(9999)).alias("end_line"))
    return lines.excerpts(f, regions)


# ---- call graph --------------------------------------------------------------------------------


def _mixed_refs(spark, sf_dir):
    return refs(spark, sf_dir).withColumn("kind", F.when(F.col("line") % 2 == 0, "reference").otherwise("call"))


@query(
    f"""WITH {GRAPH}, d AS (SELECT name, count(*) AS n FROM symbols GROUP BY name)
SELECT CASE WHEN line % 2 = 0 THEN 'reference' ELSE 'call' END AS kind, CASE WHEN d.n IS NULL THEN 'unresolved' WHEN d.n = 1 THEN 'unique_name_candidate' ELSE 'ambiguous' END AS resolution, count(*) AS sites
FROM refs LEFT JOIN d USING (name) GROUP BY ALL"""
)
def reference_sites(spark, sf_dir):
    found = graph.callers(_mixed_refs(spark, sf_dir), symbols(spark, sf_dir), include_references=True)
    return found.groupBy("kind", "resolution").agg(F.count(F.lit(1)).alias("sites"))


@query(f"WITH {GRAPH}, top AS (SELECT name FROM symbols GROUP BY name ORDER BY count(*) DESC, name LIMIT 1) SELECT name, path, line FROM symbols WHERE name IN (SELECT name FROM top)")
def find_symbol(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return graph.find_symbol(s, _busiest(s, "name")).select("name", "path", "line")


@query(
    f"""WITH {GRAPH}, i AS (SELECT name, count(*) AS inbound FROM refs GROUP BY name), o AS (SELECT caller AS name, count(*) AS outbound FROM calls GROUP BY 1),
d AS (SELECT name, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound FROM i FULL JOIN o USING (name))
SELECT name, outbound, 'no inbound calls, but outbound ones exist' AS note FROM d WHERE inbound = 0 AND outbound > 0"""
)
def orientation_notes(spark, sf_dir):
    return graph.orientation(graph.degrees(refs(spark, sf_dir)), "callers").where("note IS NOT NULL").select("name", "outbound", "note")


@query(
    f"""WITH {FILES}, s AS (SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'too_large' WHEN doc_id % 3 = 0 THEN 'not_text' ELSE 'unreadable' END AS reason FROM files WHERE path NOT LIKE 'en/%'),
x AS (SELECT path FROM s ORDER BY path LIMIT 10)
SELECT (SELECT count(*) FROM files WHERE path LIKE 'en/%') AS files, (SELECT CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM files WHERE path LIKE 'en/%') AS bytes, (SELECT count(*) FROM s) AS skipped,
  (SELECT count(*) FROM s WHERE reason = 'too_large') AS too_large, (SELECT count(*) FROM s WHERE reason = 'not_text') AS not_text,
  (SELECT string_agg(path, ' ' ORDER BY path) FROM x) AS examples, (SELECT count(*) FROM files WHERE path LIKE 'en/%') > 100 AS budget_truncated"""
)
def answer_coverage(spark, sf_dir):
    f = files(spark, sf_dir)
    reason = F.when(F.col("doc_id") % 2 == 0, "too_large").when(F.col("doc_id") % 3 == 0, "not_text").otherwise("unreadable")
    out = graph.coverage(f.where(lines.scope("en")), f.where(~lines.scope("en")).select("path", reason.alias("reason")), budget_files=100)
    return out.withColumn("examples", F.array_join("examples", " "))


_LOCATED = """spans AS (SELECT conv_id, turn AS line, turn + 1 + length(text) % 4 AS end_line, role || '-' || CAST(turn AS VARCHAR) AS name FROM conversations)"""


@query(
    f"""WITH {_LOCATED}, u AS (SELECT conv_id, turn + 1 AS line FROM conversations WHERE contains(text, 'ing')),
a AS (SELECT u.conv_id, u.line, s.name, s.line AS s, s.end_line AS e FROM u JOIN spans s ON s.conv_id = u.conv_id AND u.line BETWEEN s.line AND s.end_line),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv_id, line ORDER BY e - s, name) = 1)
SELECT DISTINCT conv_id, name AS caller FROM b"""
)
def true_callers(spark, sf_dir):
    uses = table(spark, sf_dir, "conversations").where(F.contains("text", F.lit("ing"))).select(F.col("conv_id").alias("path"), (F.col("turn") + 1).alias("line"))
    found = suites.true_callers(uses, _spans(spark, sf_dir).withColumnRenamed("conv_id", "path"))
    return found.withColumnRenamed("path", "conv_id")


@query(
    f"""WITH {_LOCATED}, c AS (SELECT conv_id, turn AS at, role AS called FROM conversations),
n AS (SELECT unnest(['assistant', 'system']) AS called)
SELECT DISTINCT s.conv_id, s.name, s.line, c.called FROM spans s JOIN c ON c.conv_id = s.conv_id AND c.at BETWEEN s.line AND s.end_line JOIN n USING (called)"""
)
def calls_among(spark, sf_dir):
    sites = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), F.lit("call").alias("kind"), F.col("role").alias("name"))
    names = spark.sql("SELECT explode(array('assistant', 'system')) AS name")
    found = graph.calls_among(_spans(spark, sf_dir).withColumnRenamed("conv_id", "path"), sites, names)
    return found.select(F.col("path").alias("conv_id"), "name", "line", "called")


@query(f"WITH {GRAPH} SELECT name, path, count(*) AS definitions FROM symbols GROUP BY ALL")
def duplicate_definitions(spark, sf_dir):
    return measures.definition_counts(symbols(spark, sf_dir))


# ---- logs and streams --------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT user_id AS session, event_id // 3 % 40 AS sequence, CASE WHEN event_id % 2 = 0 THEN 's' ELSE 'e' END AS kind, event_id AS ts, event_type AS tool, round(value, 4) AS latency, event_id % 9 AS results FROM events),
p AS (SELECT session, sequence, arg_min(tool, ts) FILTER (kind = 's') AS tool, min(ts) FILTER (kind = 's') AS started_ms, min(ts) FILTER (kind = 'e') AS ended_ms, arg_min(latency, ts) FILTER (kind = 'e') AS latency_ms,
  arg_min(results, ts) FILTER (kind = 'e') AS results, count(*) FILTER (kind = 's') AS starts, count(*) FILTER (kind = 'e') AS ends FROM e GROUP BY ALL)
SELECT *, CASE WHEN starts > 1 THEN 'duplicate start' WHEN ends > 1 THEN 'duplicate end' WHEN starts = 0 THEN 'end without start' WHEN ends = 0 THEN 'unfinished' END AS warning FROM p"""
)
def paired_events(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), (F.floor(k / 3) % 40).alias("sequence"), F.when(k % 2 == 0, "tool_start").otherwise("tool_end").alias("event"), k.alias("timestamp_ms"),
        F.col("event_type").alias("tool"), F.round("value", 4).alias("latency_ms"), (k % 9).alias("result_count"), F.lit(None).cast("string").alias("error"),
    )
    return sessions.pair_events(e).drop("error")


_SHOWN = """e AS (SELECT conv_id AS session, turn AS sequence, CASE WHEN length(text) % 7 > 0 THEN role END AS path, length(text) % 17 AS line, CASE WHEN length(text) % 5 > 0 THEN length(text) % 17 + length(text) % 9 - 3 END AS end_line FROM conversations),
shown AS (SELECT session, sequence, path, line AS start, greatest(coalesce(end_line, line), line) AS "end" FROM e WHERE path IS NOT NULL AND line >= 1)"""


def _shown(spark, sf_dir):
    n = F.char_length("text")
    place = F.struct(F.when(n % 7 > 0, F.col("role")).alias("path"), (n % 17).alias("line"), F.when(n % 5 > 0, n % 17 + n % 9 - 3).alias("end_line"))
    return sessions.location_ranges(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("sequence"), F.array(place).alias("locations")))


@query(f"WITH {_SHOWN} SELECT * FROM shown")
def shown_ranges(spark, sf_dir):
    return _shown(spark, sf_dir)


@query(f"""WITH {_SHOWN} SELECT a.session, a.path, b.sequence AS shown_by, a.sequence FROM shown a JOIN shown b USING (session, path) WHERE b.sequence < a.sequence AND greatest(a.start, b.start) <= least(a."end", b."end")""")
def follow_up_reads(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return sessions.follow_ups(shown, shown)


@query(
    """WITH s AS (SELECT o_custkey AS trial, o_orderkey // 2 AS id, o_orderkey AS pos, o_orderkey % 100 AS fresh, o_orderkey % 7 AS made, o_orderkey % 50 AS held, o_orderkey % 30 AS output FROM orders),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY trial, id ORDER BY pos) = 1)
SELECT trial, CAST(sum(fresh + made + held) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(held) AS BIGINT) AS cache_read FROM f GROUP BY trial"""
)
def stream_usage(spark, sf_dir):
    """Input is fresh, cache-created and cache-read tokens; a message told in several lines counts once."""
    k = F.col("o_orderkey")
    usage = F.struct((k % 100).alias("input_tokens"), (k % 30).alias("output_tokens"), (k % 50).alias("cache_read_input_tokens"), (k % 7).alias("cache_creation_input_tokens"))
    message = F.struct(F.floor(k / 2).cast("string").alias("id"), usage.alias("usage"))
    told = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trial"), k.alias("pos"), F.to_json(F.struct(F.lit("assistant").alias("type"), message.alias("message"))).alias("value"))
    return logs.stream_steps(told, "claude").groupBy("trial").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cache_read").alias("cache_read"))


def _codex(spark, sf_dir):
    k = F.col("event_id")
    item = F.struct(
        F.when(k % 4 == 0, "command_execution").when(k % 4 == 1, "agent_message").otherwise("mcp_tool_call").alias("type"), F.when(k % 4 > 1, F.col("event_type")).alias("tool"),
        F.concat(F.lit("ls "), k.cast("string")).alias("command"), F.when(k % 4 > 1, F.col("props")).alias("arguments"), F.col("event_type").alias("aggregated_output"),
    )
    usage = F.when(k % 3 == 0, F.struct((k % 100).alias("input_tokens"), (k % 10).alias("output_tokens")))
    value = F.to_json(F.struct(F.lit("item.completed").alias("type"), item.alias("item"), usage.alias("usage")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trial"), k.alias("pos"), value.alias("value"))


@query("SELECT user_id AS trial, event_id AS pos, CASE WHEN event_id % 4 > 1 THEN event_type ELSE 'shell' END AS name, event_type AS body, CASE WHEN event_id % 4 > 1 THEN props ELSE 'ls ' || event_id END AS request FROM events WHERE event_id % 4 <> 1")
def stream_calls(spark, sf_dir):
    return logs.stream_calls(_codex(spark, sf_dir), "codex").select("trial", "pos", "name", "body", "request")


@query(
    """SELECT user_id AS trial, nullif(count(*) FILTER (event_id % 4 <> 1), 0) AS tool_calls,
CASE WHEN count(*) FILTER (event_id % 4 <> 1) > 0 THEN coalesce(string_agg(DISTINCT CASE WHEN event_id % 4 > 1 THEN event_type ELSE 'shell' END, ' ' ORDER BY CASE WHEN event_id % 4 > 1 THEN event_type ELSE 'shell' END) FILTER (event_id % 4 <> 1 AND (event_id % 4 = 0 OR event_type NOT IN ('click', 'view'))), '') END AS unexpected,
CAST(sum(event_id % 100) FILTER (event_id % 3 = 0) AS BIGINT) AS input, CAST(sum(event_id % 10) FILTER (event_id % 3 = 0) AS BIGINT) AS output
FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 4 <> 1) > 0 OR count(*) FILTER (event_id % 3 = 0) > 0"""
)
def stream_reduction(spark, sf_dir):
    found = logs.stream_summary(_codex(spark, sf_dir), "codex", ["click", "view"])
    return found.select("trial", "tool_calls", F.array_join("unexpected", " ").alias("unexpected"), "input", "output")


@query("SELECT o_orderpriority AS system, CAST(sum(o_orderkey % 100) AS BIGINT) AS input_tokens, CAST(sum(o_orderkey % 7) AS BIGINT) AS reasoning_tokens, round(sum(o_totalprice), 2) AS cost_usd FROM orders GROUP BY 1")
def usage_totals(spark, sf_dir):
    k = F.col("o_orderkey")
    usage = F.struct((k % 100).alias("input_tokens"), (k % 7).alias("reasoning_tokens"), F.col("o_totalprice").alias("cost_usd"))
    r = logs.usage_columns(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("system"), usage.alias("usage")))
    return r.groupBy("system").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"), F.round(F.sum("cost_usd"), 2).alias("cost_usd"))


# ---- trials: measures and audits ---------------------------------------------------------------


@query("SELECT l_returnflag AS arm, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, CAST(sum(l_quantity) AS DOUBLE) AS sum FROM lineitem GROUP BY 1")
def distribution_totals(spark, sf_dir):
    out = measures.distribution(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "arm"), ["arm"], F.col("l_quantity").cast("double"), total=True)
    return out.withColumn("mean", F.round("mean", 6))


@query("SELECT l_returnflag AS arm, l_linestatus AS kind, round_even(median(l_quantity), 1) AS median, round_even(avg(l_quantity), 1) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY ALL")
def rounded_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "arm", "l_linestatus": "kind"})
    return measures.rounded_stat(rows, ["arm", "kind"], F.col("l_quantity").cast("double"))


@query(
    """SELECT o_orderpriority AS system, count(*) AS planned, count(*) FILTER (o_orderstatus = 'F' AND (o_orderkey % 7 = 0 OR o_orderkey % 3 > 0) AND (o_orderkey % 5 = 0 OR o_orderkey % 4 > 0) AND o_orderkey % 11 > 0) AS eligible FROM orders GROUP BY 1"""
)
def eligible_trials(spark, sf_dir):
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("system"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
        F.when(k % 7 > 0, F.when(k % 3 > 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("shell")))).alias("unexpected_tools"),
        F.when(k % 5 > 0, k % 4 > 0).alias("payload_matches"), F.when(k % 11 == 0, F.lit(False)).alias("repository_unchanged"),
    )
    return r.groupBy("system").agg(F.count(F.lit(1)).alias("planned"), F.count_if(measures.eligible(r)).alias("eligible"))


@query("SELECT o_custkey AS task, o_orderpriority AS system, min(o_orderkey) AS attempt FROM orders GROUP BY ALL")
def first_attempts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("system"), F.col("o_orderkey").alias("attempt"))
    return measures.first_attempts(o, ["task", "system"])


@query("SELECT p_partkey AS tool, CASE WHEN p_size % 3 = 0 THEN 'pays: unique solves' WHEN p_partkey % 200 > p_size * (p_partkey % 7) THEN 'pays: saves tokens' ELSE 'does not pay' END AS verdict FROM part")
def tool_verdicts(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    verdict = measures.tool_verdict(F.when(s % 3 == 0, 1).otherwise(0), s, k % 7, k % 200)
    return table(spark, sf_dir, "part").select(k.alias("tool"), verdict.alias("verdict"))


@query(
    "SELECT o_orderpriority AS language, round(sum(o_orderkey % 3) / sum(o_orderkey % 3 + o_orderkey % 2), 9) AS precision, round(sum(o_orderkey % 3) / sum(o_orderkey % 3 + o_orderkey % 5), 9) AS recall, CAST(sum(o_orderkey % 3) AS BIGINT) AS agreed FROM orders GROUP BY 1"
)
def audit_precision(spark, sf_dir):
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("language"), (k % 3).alias("agreed"), (k % 3 + k % 2).alias("returned"), (k % 3 + k % 5).alias("expected"))
    out = measures.micro_precision_recall(r, ["language"])
    return out.withColumn("precision", F.round("precision", 9)).withColumn("recall", F.round("recall", 9))


@query(
    "SELECT l_linenumber AS rung, count(*) AS n, count(nullif(l_partkey % 6, 0)) AS found, median(nullif(l_partkey % 6, 0)) AS median_rank, round(avg(nullif(l_partkey % 6, 0)), 9) AS mean_rank, CAST(sum(l_suppkey) AS BIGINT) AS bytes, CAST(median(l_quantity) AS DOUBLE) AS median_latency_ms FROM lineitem GROUP BY 1"
)
def scale_rungs(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("rung"), F.nullif(F.col("l_partkey") % 6, F.lit(0)).alias("rank"), F.col("l_suppkey").alias("bytes"), F.col("l_quantity").cast("double").alias("latency_ms")
    )
    return retrieval.rung_summary(cells).withColumn("mean_rank", F.round("mean_rank", 9))


@query(
    """SELECT o_orderpriority AS cell, count(*) AS n, count(*) FILTER (o_orderkey % 6 = 0) AS strict, count(*) FILTER (o_orderkey % 3 = 2) AS resolved, CAST(sum(o_orderkey % 3 / 2.0) AS DOUBLE) AS credit, count(*) FILTER (o_orderkey % 2 = 0) AS evidence,
count(*) FILTER (o_orderkey % 5 = 0) AS declined, count(*) FILTER (o_orderkey % 5 > 0 AND o_orderkey % 3 = 0) AS fabricated FROM orders GROUP BY 1"""
)
def answer_cells(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("cell"), (k % 6 == 0).alias("strict"), (k % 3 / 2.0).cast("double").alias("credit"), (k % 2 == 0).alias("evidence"), F.when(k % 5 > 0, F.lit("a")).alias("answer")
    )
    return measures.answer_cells(rows, ["cell"])


_ARM_MEANS = "a AS (SELECT o_orderstatus AS study, o_orderpriority AS arm, avg(o_totalprice) AS v FROM orders GROUP BY ALL)"


@query(f"WITH {_ARM_MEANS} SELECT x.study, x.arm, y.arm AS other, round(y.v / x.v - 1, 6) AS ratio FROM a x JOIN a y ON x.study = y.study AND x.arm <> y.arm")
def arm_ratios(spark, sf_dir):
    arms = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("study"), F.col("o_orderpriority").alias("arm")).agg(F.avg("o_totalprice").alias("v"))
    return measures.ratios(arms, "v").withColumn("ratio", F.round("ratio", 6))


@query("SELECT o_orderkey AS trial, o_orderkey % 10 / 10 AS before, CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE o_orderkey % 10 / 10 END AS after FROM orders WHERE o_orderkey % 4 = 0")
def regraded(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = o.select(k.alias("trial"), (k % 10 / 10).alias("credit"))
    new = o.select(k.alias("trial"), F.when(k % 4 == 0, 1.0).otherwise(k % 10 / 10).alias("credit"))
    return measures.regrade_changes(old, new, ["trial"])


@query(
    """WITH s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 250000)
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'other' WHEN o_orderkey % 3 = 0 THEN 'shape' WHEN o_orderkey % 2 = 1 THEN 'unqualified' ELSE 'wrong' END AS verdict, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM s) GROUP BY 1"""
)
def never_solved(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), (F.col("o_totalprice") > 250000).alias("resolved"), F.when(k % 5 > 0, F.lit("a")).alias("answer"), (k % 3 > 0).alias("format_correct"), (k % 2 == 1).alias("tail_correct")
    )
    return measures.never_solved(rows).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderpriority AS corpus, count(*) AS n, count(*) FILTER (list_contains([k % 2, k % 3, k % 5, k % 7, k % 11], k % 9)) AS with_identifiers,
count(*) FILTER (list_contains([k % 13, k % 17, 8], k % 9)) AS without_identifiers FROM (SELECT *, o_orderkey AS k FROM orders) GROUP BY 1"""
)
def medium_suitability(spark, sf_dir):
    k = F.col("o_orderkey")
    many = F.array(*[k % m for m in (2, 3, 5, 7, 11, 9)])  # the sixth is past the cut
    few = F.array(k % 13, k % 17, F.lit(8).cast("long"))
    return measures.suitability(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("corpus"), F.array(k % 9).alias("gold_files"), many.alias("files_with"), few.alias("files_without")))


@query(
    """SELECT o_custkey AS document, count(*) AS launches, count(*) FILTER (o_orderkey % 4 = 1) AS suppressing, count(*) FILTER (o_orderkey % 4 = 0) AS carrying,
CASE WHEN bool_or(o_orderkey % 4 = 0) AND bool_or(o_orderkey % 4 = 1) THEN 'mixed' WHEN bool_or(o_orderkey % 4 = 0) THEN 'carried' WHEN bool_or(o_orderkey % 4 = 1) THEN 'suppressed' ELSE 'unknown' END AS verdict FROM orders GROUP BY 1"""
)
def prompt_evidence(spark, sf_dir):
    k = F.col("o_orderkey")
    return measures.prompt_evidence(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), (k % 4 == 0).alias("carries"), (k % 4 == 1).alias("suppresses")))


_MASS = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + CASE WHEN k > 0 THEN k * ln(r) ELSE 0 END + CASE WHEN k < n THEN (n - k) * ln(1 - r) ELSE 0 END)"
_POWER = f"""one AS (SELECT count(*) AS n FROM supplier), ks AS (SELECT n, unnest(range(0, n + 1)) AS k FROM one), rates AS (SELECT round(i * 0.001, 3) AS margin, least(1.0, round(i * 0.001, 3) + 0.5) AS r FROM (SELECT unnest(range(0, 501)) AS i)),
null_mass AS (SELECT k, sum(m) OVER (ORDER BY k DESC) AS tail FROM (SELECT k, {_MASS.replace("(r)", "(0.5)").replace("- r)", "- 0.5)")} AS m FROM ks)), c AS (SELECT min(k) AS k FROM null_mass WHERE tail <= 0.05),
curve AS (SELECT CAST(margin AS DOUBLE) AS margin, least(1.0, sum(CASE WHEN r >= 1 THEN CASE WHEN k = n THEN 1.0 ELSE 0.0 END ELSE {_MASS.replace("ln(1 - r)", "ln(greatest(1 - r, 1e-300))")} END)) AS power FROM rates, ks WHERE k >= (SELECT k FROM c) GROUP BY margin)"""


def _trials(spark, sf_dir) -> int:
    """A trial for each supplier."""
    return table(spark, sf_dir, "supplier").count()


@query(f"WITH {_POWER} SELECT margin, round(power, 6) AS power FROM curve")
def power_curve(spark, sf_dir):
    return power.power_curve(spark, _trials(spark, sf_dir), 0.5).withColumn("power", F.round("power", 6))


@query(f"WITH {_POWER} SELECT (SELECT n FROM one) AS trials, CAST((SELECT k FROM c) AS INTEGER) AS critical, (SELECT min(margin) FROM curve WHERE power >= 0.8) AS reachable")
def reachable_margin(spark, sf_dir):
    n = _trials(spark, sf_dir)
    found = spark.range(1).select(F.lit(n).cast("long").alias("trials"))
    return found.select("trials", F.lit(power.critical_value(spark, n, 0.5)).cast("int").alias("critical"), F.lit(power.reachable_margin(spark, n, 0.5)).cast("double").alias("reachable"))


# ---- suites ------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT p_partkey, sha256('7|' || CAST(p_partkey AS VARCHAR)) AS d FROM part) SELECT p_partkey FROM p ORDER BY d, p_partkey LIMIT 50"""
)
def hashed_sample(spark, sf_dir):
    return suites.sample_by_hash(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 50, seed=7)
