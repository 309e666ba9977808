import math
import re

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.operators import graph, lines, measures, paging, power, retrieval, sessions, suites
from lexforge.parse import source
from lexforge.plans import compose, render
from lexforge.plans.session import Session
from lexforge.scratch import materialise


def files(spark, **named):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v) for k, v in named.items()], "path string, text string")


# ---- text ----


def test_tokens(spark):
    df = spark.createDataFrame([("wrapParagraph_width HTTPServer v2Beta the the",)], "t string")
    got = df.select(text.concept_tokens(F.col("t"))).head()[0]
    assert got == ["wrap", "paragraph", "wrapparagraph", "width", "httpserver", "v2", "beta", "v2beta", "the", "the"]
    assert text.query_tokens("wrapParagraph_width HTTPServer") == ["wrap", "paragraph", "wrapparagraph", "width", "httpserver"]
    assert text.scan_tokens("a of Zebra the é") == ["the", "zebra"]


def test_patterns_and_snippets():
    assert text.boundary_pattern("~Engine") == r"\~Engine\b" or text.boundary_pattern("~Engine") == r"~Engine\b"
    assert text.figure("764 k") == (764000.0, 500.0)
    assert text.glob_escape("a[1]*") == r"a\[1\]\*"


def test_snippets(spark):
    """120 bytes before the first match, moved left to a character; 500 characters."""
    rows = ["é" * 100 + "needle" + "x" * 600, "short needle", "aé" * 59 + "ab" + "needle needle", "a" * 120 + "needle", "a" * 121 + "needle" + "b" * 374]
    got = [tuple(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string").orderBy("i").select(lines.snippet("needle")).collect()]

    def want(t):
        data, at = t.encode(), max(0, t.encode().index(b"needle") - 120)
        while at and data[at] & 0xC0 == 0x80:
            at -= 1
        rest = data[at:].decode()
        return rest[:500], at > 0 or len(rest) > 500

    assert got == [want(t) for t in rows]
    assert [r[0].snippet for r in spark.createDataFrame([("x" * 300 + "NEEdle",)], "text string").select(lines.snippet("e+d", True, False)).collect()] == ["x" * 119 + "NEEdle"]


def test_lines_and_search(spark):
    f = files(spark, a_dot_rs="alpha\r\nbeta alpha\n\ngamma", b__c_dot_rs="alpha\0alpha\nbeta\n", empty="")
    got = [(r.path, r.line, r.text) for r in lines.lines(f).orderBy("path", "line").collect()]
    assert got[:4] == [("a.rs", 1, "alpha"), ("a.rs", 2, "beta alpha"), ("a.rs", 3, ""), ("a.rs", 4, "gamma")]
    rows = lines.search_exact(f, ["alpha", "beta"], limit=2).orderBy("pattern", "place").collect()
    assert [(r.pattern, r.path, r.line) for r in rows] == [("alpha", "a.rs", 1), ("alpha", "a.rs", 2), ("alpha", "b/c.rs", 1), ("beta", "a.rs", 2)]
    apart = [lines.search_exact(f, [p], limit=2).count() for p in ("alpha", "beta")]
    assert sum(apart) == len(rows)  # batched equals one by one
    assert lines.search_exact(f, ["É"], case_sensitive=False).count() == 0
    with pytest.raises(ValueError):
        lines.search_exact(f, ["(?=x)"], regex=True)
    with pytest.raises(ValueError):
        lines.search_exact(f, [" "])
    assert lines.files_searched(f, "b").head()[0] == 1


def test_path_order_and_scope(spark):
    df = spark.createDataFrame([("a-b/x",), ("a/b",), ("a",)], "path string")
    assert [r.path for r in df.orderBy(lines.path_order()).collect()] == ["a", "a/b", "a-b/x"]
    assert [r.path for r in df.where(lines.scope("a")).orderBy("path").collect()] == ["a", "a/b"]


def test_read_budget(spark):
    f = files(spark, x="\n".join(["y" * 100] * 600))
    assert lines.read_source(f, "x").count() == 100
    assert lines.read_source(f, "x", 1, 600).count() == 32768 // 164
    with pytest.raises(ValueError):
        lines.read_source(f, "x", 0)


def test_pages(spark):
    df = spark.range(45)
    seen, offset = [], 0
    while offset is not None:
        p = paging.page(df, [F.col("id")], 20, offset)
        seen += [r["id"] for r in p.results]
        offset = p.next_offset
    assert seen == list(range(45))
    with pytest.raises(ValueError):
        paging.check_page(101, 0)
    big = paging.Page([{"t": "x" * 30000}] * 5)
    assert len(paging.fit(big).results) == 2 and paging.fit(big).next_offset == 2
    assert paging.uniform(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), ["a"]) == {"a": 1}


# ---- ranking ----


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog cat"), (3, "")], "doc int, text string")
    q = spark.createDataFrame([(0, "red fox fox")], "query_id int, text string")
    got = {r.doc: r.score for r in retrieval.bm25(docs, q).collect()}
    idf = lambda df: math.log(1 + (2 - df + 0.5) / (df + 0.5))
    w = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 3))
    assert got[1] == pytest.approx(idf(2) * w(1, 2) + idf(1) * w(1, 2))
    assert got[2] == pytest.approx(idf(2) * w(2, 4)) and 3 not in got


def test_rare_words_beat_frequent_ones(spark):
    decoys = {f"decoy{i}_dot_rs": "common common common\n" * 5 for i in range(60)}
    f = files(spark, answer_dot_rs="// x\n" * 400 + "the zyzzyva appears once", **decoys)
    assert retrieval.candidate_files(f, "common zyzzyva").head().path == "answer.rs"


def test_fusion_and_cosine(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "k string, rank int")
    assert [r.k for r in retrieval.fuse(a, b, ["k"]).orderBy("rank").collect()] == ["y", "x", "z"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [float("nan"), 1.0])], "vec_id int, embedding array<double>")
    got = retrieval.dense_top_k(v, [1.0, 0.0], 5).orderBy("rank").collect()
    assert [(r.doc, round(r.score, 6)) for r in got] == [(1, 1.0), (3, 0.707107)]


def test_ranking_measures(spark):
    r = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "task_id string, rank int")
    m = retrieval.ranking_measures(r, []).head()
    assert m.mrr == pytest.approx((1 + 0.25) / 3) and (m.recall_1, m.recall_3, m.recall_5, m.recall_10) == (1, 1, 2, 2)


# ---- graph ----


def chain(spark):
    symbols = [("leaf", 1), ("middle", 2), ("top", 3), ("spin", 4), ("spin_helper", 5)]
    s = spark.createDataFrame([(n, "function", "chain.rs", i, i, None, "rust") for n, i in symbols], "name string, kind string, path string, line int, end_line int, container string, family string")
    edges = [("middle", "leaf", 2), ("top", "middle", 3), ("spin", "spin_helper", 4), ("spin_helper", "spin", 5)]
    r = spark.createDataFrame([(n, "call", "chain.rs", i, 1, c, "rust") for c, n, i in edges], "name string, kind string, path string, line int, column int, caller string, family string")
    return s, r


def test_trace(spark):
    _, r = chain(spark)
    down = graph.trace(r, "top", "callees", 3).orderBy("depth").collect()
    assert [(e.depth, e.caller, e.callee) for e in down] == [(1, "top", "middle"), (2, "middle", "leaf")]
    assert graph.trace(r, "leaf", "callers", 1).count() == 1
    assert graph.trace(r, "spin", "callees", 5).count() == 2  # a cycle ends
    with pytest.raises(ValueError):
        graph.trace(r, "x", "callees", 6)


def test_callers_and_inspection(spark):
    s, r = chain(spark)
    twice = s.unionByName(s.where("name = 'leaf'").withColumn("path", F.lit("other.rs")))
    got = {x.name: (x.candidates, x.resolution) for x in graph.callers(r, twice).collect()}
    assert got["leaf"] == (2, "ambiguous") and got["middle"] == (1, "unique_name_candidate")
    gone = graph.callers(r, s.where("name = 'nothing'"), "leaf").head()
    assert (gone.candidates, gone.resolution) == (0, "unresolved")
    many = spark.createDataFrame([("hub", "call", f"f{i}.ts", 1, 1, f"c{i}", "e") for i in range(8)], r.schema)
    rows = graph.inspect(s, many, "hub").collect()
    assert len(rows) == 6 and {x.total for x in rows} == {8}


def test_nearest_names_and_locate(spark):
    names = spark.createDataFrame([("parse_file",), ("parse_text",), ("render",), ("load",)], "name string")
    asked = spark.createDataFrame([("parse_files",)], "name string")
    got = [x.name for x in graph.nearest_names(names, asked).orderBy("rank").collect()]
    assert got[0] == "parse_file"
    spans = spark.createDataFrame([("a", "outer", 1, 10), ("a", "inner", 3, 5)], "path string, name string, line int, end_line int")
    pts = spark.createDataFrame([("a", 4), ("a", 9), ("b", 1)], "path string, line int")
    assert {(x.path, x.line): x.span_name for x in graph.locate(pts, spans, ["path"]).collect()} == {("a", 4): "inner", ("a", 9): "outer", ("b", 1): None}


def test_contained_names_equal_brute_force(spark):
    known = ["", "a", "ab", "abc", "xabcx", "Abcdef", "été", "l'été", "get", "get_all", "getter", "zz"]
    asked = ["", "A", "bc", "abcd", "ABCDEFG", "ét", "get", "target", "nothing"]
    names = spark.createDataFrame([(k,) for k in [*known, "get", None]], "name string")
    wanted = spark.createDataFrame([(a,) for a in [*asked, "get", None]], "name string")
    got = graph.nearest_names(names, wanted, k=100).collect()
    n = len(known) + 1  # the unnamed one counts
    held = {(a, k) for a in asked for k in known if a.lower() in k.lower() or k.lower() in a.lower()}
    assert {(r.wanted, r.name) for r in got if r.score >= n} == held
    assert len(got) == len({(r.wanted, r.name) for r in got})
    assert graph.nearest_names(names.where("false"), wanted).count() == 0


def test_fingerprint_depends_on_paths_and_contents_alone(spark):
    rows = [(f"d{i % 3}/f{i}", str(i)) for i in range(40)]

    def told(some):
        return lines.fingerprint(spark.createDataFrame(some, "path string, text string")).head()[0]

    first = told(rows)
    assert told(rows[::-1]) == first
    assert len({first, told(rows[1:]), told([*rows[1:], ("d0/f0", "x")]), told([*rows[1:], ("d0/g0", "0")]), told([])}) == 5
    assert told([("a", None)]) == told([("a", "")])


def test_index_budgets(spark):
    tree = spark.createDataFrame([("b/z", "xxxx"), ("a", "xx"), ("b", "xx"), ("b/a", "xx"), ("c", "x")], "path string, text string")

    def kept(most_files, most_bytes):
        return sorted(r.path for r in source.budgeted(tree, most_files, most_bytes).collect())

    assert kept(10, 100) == ["a", "b", "b/a", "b/z", "c"]
    assert kept(3, 100) == ["a", "b", "b/a"]
    assert kept(10, 6) == ["a", "b", "b/a"]
    assert kept(10, 9) == ["a", "b", "b/a"] and kept(0, 9) == []


# ---- sessions ----


def test_pairing(spark):
    e = [("s", 1, "tool_start", "search_exact", 1, None), ("s", 1, "tool_end", "search_exact", 2, 5.0), ("s", 2, "tool_start", "x", 3, None), ("s", 3, "tool_end", "x", 4, 1.0), ("s", 4, "tool_start", "x", 5, None), ("s", 4, "tool_start", "x", 6, None), ("s", 4, "tool_end", "x", 7, 1.0)]
    df = spark.createDataFrame(e, "session string, sequence int, event string, tool string, timestamp_ms long, latency_ms double").withColumn("result_count", F.lit(1)).withColumn("error", F.lit(None).cast("string"))
    assert {r.sequence: r.warning for r in sessions.pair_events(df).collect()} == {1: None, 2: "unfinished", 3: "end without start", 4: "duplicate start"}


def test_redundant_reads_and_budget(spark):
    reads = spark.createDataFrame([("s", 1, "p", 1, 5), ("s", 2, "p", 4, 9), ("s", 3, "p", 2, 8), ("s", 4, "p", 8, 12)], "session string, sequence int, path string, start int, end int")
    assert {r.sequence: r.covered for r in sessions.redundant_reads(reads).collect()} == {1: False, 2: False, 3: True, 4: False}
    calls = spark.createDataFrame([("s", i, 40) for i in range(1, 5)], "session string, sequence int, bytes int")
    assert [r.forwarded for r in sessions.budget_meter(calls, 10, 100).orderBy("sequence").collect()] == [True, True, False, False]


# ---- measures ----


def test_differences(spark):
    rows = [("t1", "A", 10.0, True), ("t1", "B", 7.0, True), ("t2", "A", 5.0, False), ("t2", "B", 9.0, True), ("t3", "A", 1.0, True)]
    df = spark.createDataFrame(rows, "task string, arm string, v double, eligible boolean")
    d = {r.task: r.difference for r in measures.pair_differences(df, ["task"], "arm", [("A", "B")], "v").collect()}
    assert d == {"t1": 3.0, "t2": None}
    added = measures.pair_differences(df, ["task"], "arm", [("A", "B")], "v", sign="added").where("task = 't1'").head()
    assert added.difference == -3.0


def test_medians_and_cuts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert measures.upper_median(df, [], "v").head()["median"] == 3.0
    k = spark.range(1).select(*[measures.kept_rows(F.lit(n), F.lit(f)).alias(f"k{i}") for i, (n, f) in enumerate([(5, 0.5), (7, 0.5), (1, 0.1), (10, 0.25)])]).head()
    assert tuple(k) == (2, 4, 1, 2)  # half to even, one at least


def test_verdicts(spark):
    v = spark.range(1).select(measures.tool_verdict(F.lit(0), F.lit(100.0), F.lit(3), F.lit(301.0)), measures.tool_verdict(F.lit(1), F.lit(1e9), F.lit(3), F.lit(0.0)), measures.tool_verdict(F.lit(0), F.lit(100.0), F.lit(3), F.lit(300.0))).head()
    assert tuple(v) == ("pays: saves tokens", "pays: unique solves", "does not pay")


def test_power(spark):
    got = {r.successes: r.tail for r in power.tails(spark, 30, 0.6).collect()}
    want = {k: sum(math.comb(30, i) * 0.6**i * 0.4 ** (30 - i) for i in range(k, 31)) for k in range(31)}
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    c = power.critical_value(spark, 30, 0.6)
    assert want[c] <= 0.05 < want[c - 1]
    m = power.reachable_margin(spark, 30, 0.6)
    tail = lambda p: sum(math.comb(30, i) * p**i * (1 - p) ** (30 - i) for i in range(c, 31))
    assert tail(0.6 + m) >= 0.8 > tail(0.6 + m - 0.0011)
    assert {r.successes: r.tail for r in power.tails(spark, 4, 1.0).collect()}[4] == 1.0
    assert power.measurable(30, 0.97) == {"headroom": False, "floor": True}


def test_suites(spark):
    t = spark.createDataFrame([("t1",), ("t2",)], "task string")
    s = spark.createDataFrame([("A",), ("B",)], "system string")
    assert suites.plan(t, s, 3, 1).count() == 12
    cells = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, "y", "q")], "cell int, a string, b string")
    assert {(r.factor, r.cell, r.other_cell) for r in suites.one_factor_contrasts(cells, ["a", "b"]).collect()} == {("a", 1, 2), ("b", 2, 3)}
    p = spark.createDataFrame([("src/test_a.py",), ("tests/x.py",), ("src/contest.py",), ("a_test.go",)], "p string")
    assert [r[0] for r in p.select(suites.is_test_path(F.col("p"))).collect()] == [True, True, False, True]



# ---- a source tree end to end ----


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "src/chain.rs").write_text("pub fn leaf() {}\n// joins the widgets\npub fn middle() { leaf(); }\npub fn top() {\n    middle();\n}\n")
    (root / "src/util.py").write_text("def helper():\n    return 1\n\ndef service():\n    return helper()\n")
    (root / "src/__init__.py").write_text("")
    (root / "skip.rs").write_text("fn leaf() {}\n")
    (root / ".hidden.rs").write_text("fn leaf() {}\n")
    (root / "bin.rs").write_bytes(b"fn leaf\0")
    (root / ".ignore").write_text("skip.rs\n")
    (root / "target").mkdir()
    (root / "target/x.rs").write_text("fn leaf() {}")
    return str(root)


def test_session(spark, tree):
    s = Session(spark, tree)
    assert [r.path for r in s.files().orderBy("path").collect()] == ["src/__init__.py", "src/chain.rs", "src/util.py"]
    found = s.search_exact(query="leaf")
    assert [(r["path"], r["line"]) for r in found.results] == [("src/chain.rs", 1), ("src/chain.rs", 3)] and found.extra["files_searched"] == 3
    assert [r["text"] for r in s.read_source("src/chain.rs", 3, 3).results] == ["pub fn middle() { leaf(); }"]
    assert s.read_source("src/chain.rs", 1, 2).extra["next_line"] == 3
    assert s.find_symbol("middle").results[0]["line"] == 3
    assert [r["caller"] for r in s.find_callers("helper").results] == ["service"]
    traced = s.trace_dependencies("top", "callees", 2).results
    assert [(e["depth"], e["callee"]) for e in traced] == [(1, "middle"), (2, "leaf")]
    assert {(r["relation"], r["other"]) for r in s.inspect_symbol("middle").results} == {("definition", "function"), ("inbound", "top"), ("outbound", "leaf")}
    assert s.search_concept("joins widgets").results[0]["start_line"] == 3  # the comment is in the chunk, not in the region
    assert s.locate("src/chain.rs", 5)["span_name"] == "top"
    assert "middle" in s.find_symbol("midle_middle").extra["nearest"]
    for bad in ("../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            s.read_source(bad)


def test_composition_and_rendering(spark, tree):
    s = Session(spark, tree)
    pages = compose.run_plan(s, [{"tool": "search_exact", "arguments": {"query": "joins"}}, {"tool": "read_source", "arguments": {"path": "$1.path", "start_line": 3, "end_line": 3}}])
    shown = render.render(pages[1])
    assert "results[1] line\ttext" in shown and "pub fn middle" in shown
    from lexforge.sources.logs import rendered_rows

    page = paging.Page([{"a": "x\ty\nz\\", "b": 1.5}, {"a": "q"}])
    assert rendered_rows(render.render(page)) == [{"a": "x\ty\nz\\", "b": "1.500"}, {"a": "q"}]
    assert compose.crawl(s, ["leaf"], [("src/chain.rs", "leaf")])["found"] == 1


def test_trace_moves_its_edges_once(spark):
    rows = [(f"n{i}", "call", f"p{i % 7}", i, f"n{i // 3}") for i in range(1, 2000)]
    refs = spark.createDataFrame(rows, "name string, kind string, path string, line int, caller string")
    edges, name = graph.bucketed_edges(refs, "caller")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = spark.range(3).select(F.concat(F.lit("n"), F.col("id")).alias("at"))
        for _ in range(3):  # level 3 and those before: the only exchange is the frontier's
            step = graph.expand(edges, frontier, "caller")
            plan = step._jdf.queryExecution().executedPlan().toString()
            edges_side = plan[plan.index("SortMergeJoin") :].split("Exchange")[0]
            assert plan.count("Exchange") == 1 and "Bucketed: true" in edges_side
            frontier = materialise(step.select(F.col("callee").alias("at")).distinct(), "test")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    found = {(r["depth"], r["callee"]) for r in graph.trace(refs, "n0", "callees", 3).collect()}
    assert found == {(1, "n1"), (1, "n2"), (2, "n3"), (2, "n4"), (2, "n5"), (2, "n6"), (2, "n7"), (2, "n8")} | {(3, f"n{i}") for i in range(9, 27)}


def test_contrasts_are_dealt_over_tasks(spark):
    """Pairs of large combinations of factors come from many tasks, each pair once; a combination's cells don't meet one another."""
    cells = spark.range(3600).select(F.col("id").alias("cell"), (F.col("id") % 3).alias("a"), F.lit("x").alias("b")).coalesce(1)
    found = suites.one_factor_contrasts(cells, ["a", "b"])
    parts = found.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("cell").alias("x"), F.sum("other_cell").alias("y")).collect()
    of = [1200 * (1199 * 1200 // 2) * 3 + i * 1200 * 1200 for i in range(3)]  # sums of a combination's cells, each standing in 1200 pairs
    assert sum(p.n for p in parts) == 3 * 1200 * 1200
    assert (sum(p.x for p in parts), sum(p.y for p in parts)) == (2 * of[0] + of[1], of[1] + 2 * of[2])
    assert max(p.n for p in parts) < 0.6 * 3 * 1200 * 1200
    odd = spark.createDataFrame([(None, 1, "x"), (7, 1, "x"), (7, 1, "x"), (8, 2, "x"), (9, None, "x"), (10, 2, None)], "cell int, a int, b string")
    assert sorted(map(tuple, suites.one_factor_contrasts(odd, ["a", "b"]).select("cell", "other_cell").collect()), key=str) == [(7, 8), (7, 8), (None, 8)]


def test_imports_bring_no_tree_to_the_driver(spark):
    """However small Spark expects parsed rows and paths to be, nothing is broadcast; doubled rows and imports without candidates stay."""
    tree = spark.createDataFrame([("p/a.py", ""), ("p/b.py", ""), ("p/b.py", "")], "path string, text string")
    raw = [("p/a.py", 1, "import p.b", ["p/b.py", "p/b/__init__.py"]), ("p/a.py", 1, "import p.b", ["p/b.py"]), ("p/a.py", 2, "import q", ["q.py"]), ("p/a.py", 3, "use r", [])]
    rows = spark.createDataFrame([("import", *r) for r in raw], "table string, path string, line int, statement string, candidate_files array<string>")
    found = source.imports(rows, tree)
    got = sorted((r.line, r.candidate_files, r.resolution) for r in found.collect())
    assert got == [(1, ["p/b.py"], "possible_local_module")] * 2 + [(2, [], "unresolved"), (3, [], "unresolved")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_bm25_scores_move_nowhere(spark, monkeypatch):
    """Scores of few queries are added up beside the postings; of many they meet by token, with the same result."""
    chunks = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7 + 1)) + " w0") for i in range(50)] + [(50, "...")], "doc int, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} none") for q in range(4)], "query_id int, text string")
    found = retrieval.bm25(chunks, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc#", plan) and not re.search(r"hashpartitioning\(query_id#\d+, doc#", plan)
    few = {(r.query_id, r.doc): round(r.score, 9) for r in found.collect()}
    monkeypatch.setattr(retrieval, "MOST_ASKED", 0)
    many = {(r.query_id, r.doc): round(r.score, 9) for r in retrieval.bm25(chunks, asked).collect()}
    assert few == many and len(few) > 50


def test_first_relevant_without_tasks(spark):
    ranked = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (2, 5, 1), (3, 9, 1)], "task_id int, doc int, rank int")
    relevant = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "task_id int, doc int")
    want = sorted(map(tuple, retrieval.first_relevant(ranked, relevant, relevant.select("task_id").distinct()).collect()))
    assert want == sorted(map(tuple, retrieval.first_relevant(ranked, relevant).collect())) == [(1, 1), (2, None)]
