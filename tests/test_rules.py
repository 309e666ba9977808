"""Rules of trials on small cases, those among them where a simpler rule would fail."""

import json

import pytest
from pyspark.sql import functions as F

from lexforge.functions import grading, text
from lexforge.operators import measures, sessions, suites


def column(spark, made, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(made).collect()]


def test_classes_labels_and_pages(spark):
    tools = [("find_symbol",), ("find_callers",), ("trace_dependencies",), ("search_exact",), ("search_concept",)]
    assert column(spark, text.method_class(F.col("t")), tools, "t string") == ["structural"] * 3 + ["search_exact", "search_concept"]
    calls = [
        ("search_exact", "a|b", True, 3, False), ("search_exact", r"a\|b", False, 0, False), ("search_exact", r"a\|b", True, 1, False), ("search_exact", "a|", False, 1, False), ("search_exact", "a\n b", False, 1, False),
        ("search_exact", " a ", False, 1, False), ("search_concept", "how is a|b c", False, 0, False), ("search_exact", None, None, 0, True), ("find_symbol", "x", None, None, False),
    ]
    got = column(spark, text.call_labels(F.col("tool"), F.col("query"), F.col("regex"), F.col("results"), F.col("failed")), calls, "tool string, query string, regex boolean, results int, failed boolean")
    assert got == [["alternation_shaped"], ["empty", "escaped_pipe_literal", "alternation_shaped"], ["escaped_pipe_regex", "alternation_shaped"], [], ["literal_multiword"], [], ["empty"], ["error"], []]
    pages = [("s", 1, "t", "q", 20, 20, 0), ("s", 2, "t", "q", 5, 20, 20), ("s", 3, "t", None, 9, 9, 0), ("s", 4, "u", "q", 20, 20, 0), ("s", 5, "t", None, 1, 9, 3), ("r", 1, "t", "q", 30, 20, 0), ("r", 2, "t", "q", 1, None, None)]
    labels = sessions.page_labels(spark.createDataFrame(pages, "session string, sequence int, tool string, query string, results int, limit int, offset int"))
    assert {(r["session"], r["sequence"]): r["label"].split("_")[1] for r in labels.collect()} == {("s", 1): "followed", ("s", 3): "followed", ("s", 4): "truncated", ("r", 1): "truncated"}


def test_signatures(spark):
    rows = [("read_source", "a/../b.py", None, None), ("read_source", "./b.py", 5, 7), ("search_exact", None, None, None), ("search_concept", None, None, None), ("other", "/../x/", None, None)]
    made = text.signature(F.col("tool"), {"path": F.col("path"), "start_line": F.col("first"), "end_line": F.col("last")})
    got = [json.loads(x) for x in column(spark, made, rows, "tool string, path string, first int, last int")]
    assert got == [
        {"tool": "read_source", "path": "b.py", "start_line": 1, "end_line": 100}, {"tool": "read_source", "path": "b.py", "start_line": 5, "end_line": 7},
        {"tool": "search_exact", "path": ".", "regex": False, "case_sensitive": True, "limit": 20, "offset": 0}, {"tool": "search_concept", "limit": 20, "offset": 0}, {"tool": "other", "path": "/x"},
    ]
    paths = [("",), ("a/./b/../c",), ("../../a",), ("/..",), ("a/..",), ("a/../../b",)]
    assert column(spark, text.tidy_path(F.col("p")), paths, "p string") == [".", "a/c", "../../a", "/", ".", "../b"]


def test_words_and_prose(spark):
    assert column(spark, text.word_pieces(F.col("t")), [("HTTPServer_parseIt is v2beta99",)], "t string") == [["http", "server", "parse", "beta"]]
    targets = [("parse the header", ["a.py::Owner::parseHeader"]), ("the owner", ["a.py::Owner::run"]), ("it", ["b::itIs"])]
    assert column(spark, text.names_target(F.col("m"), F.col("i")), targets, "m string, i array<string>") == [True, False, False]
    assert sorted(column(spark, text.vocabulary(F.col("t")), [("fooBar_x of HTTPServer ab",)], "t string")[0]) == ["bar", "foo", "foobar_x", "http", "httpserver", "server"]
    message = "Fix it (#12)\n\nSee https://a.b/c now\n# comment\nCc: x\nCloses #3\n\n\n\nMore prose  \nSigned-off-by: me\n"
    assert column(spark, text.clean_message(F.col("m")), [(message,)], "m string") == ["Fix it (#12)\n\nSee  now\n\nMore prose"]
    assert column(spark, text.strip_identifiers(F.col("t")), [('Return the a_b of src/x.rs, as JSON: "q" [k] or plain words.',)], "t string") == ["the of src/x rs as or plain words"]
    asked = spark.createDataFrame([(1, "where is `parse_it that` and parse_it in Upper or lower lower", ["Upper"])], "id int, q string, gold array<string>")
    assert {r["term"]: r["weight"] for r in text.question_terms(asked, "id", "q", "gold").collect()} == {"parse_it": 11, "that": 5, "lower": 2}
    comment = "/** Runs the fooBar twice, foo bar or FOOBARS.\n * @param x it\n * see {@link a b} `code` */"
    assert column(spark, text.clean_comment(F.col("c"), F.col("n")), [(comment, "fooBar")], "c string, n string") == ["Runs the twice, or S. @param x it see"]
    assert column(spark, text.clean_comment(F.col("c"), F.col("n")), [("a\n@return b\nfoo.bar", "o.b")], "c string, n string") == ["a fo ar"]


def test_test_code_and_leaks(spark):
    files = spark.createDataFrame([("src/a.rs", "fn one() {}\n #[cfg(test)]\nmod t {\nfn two() {}\n}\n"), ("tests/b.rs", "fn x() {}\n"), ("c/test_d.py", "def x\n")], "path string, text string")
    rows = [("src/a.rs", "one", 1), ("src/a.rs", "two", 4), ("src/a.rs", "one", 5), ("src/a.rs", "shouldRun", 1), ("tests/b.rs", "x", 1), ("c/test_d.py", "x", 1), ("contest/e.py", "tester", 1)]
    found = suites.test_code(spark.createDataFrame(rows, "path string, leaf string, line int"), files)
    assert {(r["path"], r["leaf"], r["line"]): r["is_test"] for r in found.collect()} == dict(zip(rows, [False, True, False, True, True, True, False]))
    prose = [("fix Streams in the parser", "a/Streams.java::X::run"), ("fix Streams", "a/b.py::Streams"), ("fix restreams", "a/streams.py::go"), ("fix parser", "a/parser.py::go"), ("a.b went", "x.py::a.b")]
    assert column(spark, suites.leaks(F.col("m"), F.col("i")), prose, "m string, i string") == [True, True, False, True, True]
    assert column(spark, suites.leaks(F.col("m"), F.col("i"), F.array(F.lit("Streams"))), prose, "m string, i string") == [True, True, False, False, True]


def test_competency(spark):
    call = "struct<name:string,regex:boolean,limit:int,path:string,start_line:int,end_line:int,lines:array<int>>"
    search = lambda lines, regex=True, limit=None: ("search_exact", regex, limit, None, None, None, lines)
    read = lambda a, b, lines, path="t.py": ("read_source", None, None, path, a, b, lines)
    rows = [
        ("regex", [2, 1], [search([1, 2])]), ("regex", [1, 2], [search([1, 2], regex=False)]), ("regex", [1], [search([1, 2])]), ("paging", [1, 2, 3], [search([1, 2], limit=2), search([3], limit=1)]),
        ("paging", [1, 2], [search([1, 2])]), ("paging", [1], [search([1], limit=1), read(1, 1, [1])]), ("read", [9], [read(9, 9, [9])]), ("read", [9], [read(8, 9, [9])]), ("read", [9], []), ("free", [1], []),
    ]
    df = spark.createDataFrame([(i, k, "t.py", e, c, True, True) for i, (k, e, c) in enumerate(rows)], f"id int, kind string, file string, expected array<int>, calls array<{call}>, correct boolean, format_correct boolean")
    assert [r["score"] for r in suites.competency(df).orderBy("id").collect()] == [1, 0, 0, 1, 0, 0, 1, 0, 0, 1]


def test_verdicts_of_trials(spark):
    rows = [(0.0, 1.0, ["a"], [], ["a"]), (0.0, 1.0, ["a"], ["a"], []), (0.0, 1.0, ["a"], [], []), (1.0, 1.0, ["a"], ["a"], []), (1.0, 0.5, ["a"], [], [])]
    df = spark.createDataFrame(rows, "treatment_credit double, control_credit double, gold array<string>, seen array<string>, control_seen array<string>")
    assert sorted((r["verdict"], r["expansion_skipped"]) for r in measures.closure(df).collect()) == [("evidence_seen", False), ("premature_stop", False), ("premature_stop", True)]
    assert measures.closure_report(df).head().asDict() == {"questions_paired": 5, "treatment_regressions": 3, "treatment_improvements": 1, "premature_stop": 2, "evidence_seen": 1, "expansion_skipped": 1}
    modes = [(False, None, ["a"]), (True, None, ["a"]), (True, [], ["a"]), (True, ["a"], ["a", "b"]), (True, ["x"], ["a", "b"]), (True, ["a", "x"], ["a", "b"]), (False, ["a"], ["a", "b"])]
    got = column(spark, measures.failure_mode(F.col("saw"), F.col("got"), F.col("gold")), modes, "saw boolean, got array<string>, gold array<string>")
    assert got == ["never_saw_evidence", "incomplete", "incomplete", "incomplete", "misread", "misread", "never_saw_evidence"]
    trials = spark.createDataFrame([(1, "q"), (2, "q"), (3, "r")], "trial int, task_id string")
    wanted = spark.createDataFrame([("q", "f", 5, 6), ("r", "f", 1, 10**9)], "task_id string, path string, start long, end long")
    shown = spark.createDataFrame([(1, "f", 1, 5), (2, "f", 1, 4), (2, "g", 5, 6), (3, "f", 10**8, 10**8)], "trial int, path string, start long, end long")
    assert {r["trial"]: r["saw"] for r in measures.saw_evidence(shown, wanted, trials).collect()} == {1: True, 2: False, 3: True}
    reach = [(True, None, False, False, False), (False, 2, True, True, True), (False, None, False, False, True), (False, None, False, True, True), (False, None, True, True, True), (False, None, True, False, True), (False, None, True, False, False)]
    cols = [F.col(c) for c in ("solved", "depth", "seed", "workable", "visible")]
    assert column(spark, measures.reach_verdict(*cols), reach, "solved boolean, depth int, seed boolean, workable boolean, visible boolean") == ["solved", "wrong_reach", "unavailable", "unchosen", "unchosen", "wrong_level", "unavailable"]
    runs = [("a", 1, 100.0), ("a", 2, 98.5), ("b", 1, 2.0), ("b", 2, 1.0), ("c", 1, 5.0), ("d", 1, 1.0), ("d", 2, 0.0), ("e", 1, 97.0), ("e", 2, 100.0)]
    settled = measures.converged(spark.createDataFrame(runs, "`group` string, run int, tokens double"))
    assert {r["group"]: r["converged"] for r in settled.collect()} == {"a": 98.5, "b": 1.0, "c": None, "d": None, "e": None}
    assert column(spark, measures.tail(F.col("s")), [("src/a.rs::Owner::f",), ("a::b",), ("x.rs",), ("Owner/f",), ("f",), ("Élan::g",)], "s string") == ["Owner::f", "b", "x.rs", "Owner::f", "f", "Élan::g"]


def test_end_to_end_is_one_code_path(spark):
    base = dict.fromkeys(measures.END_TO_END)
    trials = [
        {"system": "A", "category": c, "task_id": t, "status": "completed", "correct": ok, "resolved_correct": ok, "resolved_credit": 1.0 if ok else 0.25, "budget_exhausted": None, "cost_usd": 0.5, "first_hit_call": h,
         "answered_without_evidence": h is None, "contaminated": False, **base, "input_tokens": n, "retrieval_bytes": 10 * n}
        for c, t, ok, h, n in [("x", "t1", True, 1, 10), ("x", "t1", False, None, 20), ("x", "t2", True, 2, 40), (None, "t3", False, None, 5)]
    ]
    kinds = {"system": "string", "category": "string", "task_id": "string", "status": "string", "correct": "boolean", "resolved_correct": "boolean", "resolved_credit": "double", "budget_exhausted": "boolean", "cost_usd": "double", "first_hit_call": "int", "answered_without_evidence": "boolean", "contaminated": "boolean"}
    df = spark.createDataFrame([tuple(t.values()) for t in trials], ", ".join(f"{c} {kinds.get(c, 'long')}" for c in trials[0]))
    got = {r["category"]: r for r in measures.end_to_end(df).collect()}
    assert set(got) == {None, "x", "uncategorized"}
    every, x = got[None], got["x"]
    assert (every["trials"], every["questions"], every["correct"], every["wrong_without_evidence"], every["trials_with_hit"], every["cost_usd"]) == (4, 3, 2, 2, 2, 2.0)
    assert (every["input_tokens_median"], every["input_tokens_mean"], every["input_tokens_n"], every["resolved_input_tokens_median"]) == (15.0, 18.8, 4, 25.0)
    assert (x["trials"], x["questions"], x["input_tokens_median"], x["resolved_retrieval_bytes_median"], x["resolved_credit_mean"]) == (3, 2, 20.0, 250.0, 0.75)
    assert every["output_tokens_median"] is None and every["output_tokens_n"] == 0 and got["uncategorized"]["trials"] == 1


GOLD = '{"answer": ["a", "b"]}'
FENCED = "```json\n%s\n```"


@pytest.mark.parametrize(
    "reply, v2, v3",
    [
        (' {"answer": ["b", "a"]} ', (True, True), (True, True)), ('{"answer": ["a", "a", "b"]}', (False, True), (False, True)), ('{"answer": ["a"], "answer": ["a", "b"]}', (False, False), (False, False)),
        ("So\n" + FENCED % GOLD + "\nyes", (True, False), (True, False)), ("```rust\nfn f() {}\n```\n" + FENCED % GOLD, (False, False), (True, False)), ("```c++\n" + GOLD + "\n```", (False, False), (True, False)), (FENCED % "x" + "\n" + FENCED % GOLD, (False, False), (True, False)), (FENCED % GOLD + FENCED % GOLD, (False, False), (False, False)),
        (GOLD + " and " + GOLD, (False, False), (False, False)), (GOLD + "] }", (False, False), (False, False)), (GOLD + "} ]", (False, False), (False, False)), (GOLD + "," + GOLD, (False, False), (False, False)),
        ('{"answer": "a"}', (False, True), (False, True)), ('{"other": ["a", "b"]}', (False, False), (False, False)), ("", (False, False), (False, False)), (None, (False, None), (False, None)),
    ],
)
def test_strict_grades(spark, reply, v2, v3):
    df = spark.createDataFrame([(reply,)], "r string")
    for version, want in ((2, v2), (3, v3)):
        got = df.select(grading.strict_grade(F.col("r"), F.lit(GOLD), F.lit(True), version).alias("g")).select("g.*").head()
        assert (got["correct"], bool(got["format_correct"])) == (want[0], bool(want[1]))


def test_values_apart(spark):
    pairs = [("1", "true"), ("1", "1"), ("[1, 2]", "[2, 1]"), ('{"x": 1, "y": [2]}', '{"y":[2],"x":1}'), ("null", "null"), ('"a"', '["a"]'), ("1", "1.0"), ("1.5", "1.50"), ("[1, 2]", "[2.0, 1]")]
    rows = [('{"answer": %s}' % a, '{"answer": %s}' % b) for a, b in pairs]
    for as_set, want in ((False, [False, True, False, True, True, False, False, True, False]), (True, [False, True, True, True, True, False, False, True, False])):
        assert column(spark, grading.strict_grade(F.col("r"), F.col("g"), F.lit(as_set))["correct"], rows, "r string, g string") == want


def test_answers_in_prose(spark):
    replies = [('so {"answer": [1, 2]} it is',), ('{"answer": 1} or {"answer": {"k": 2}}',), (FENCED % '{"answer": 3}' + ' {"answer": 4}',), ("nothing",), (None,)]
    assert column(spark, grading.lenient_answer(F.col("r")), replies, "r string") == ["[1,2]", '{"k":2}', "3", None, None]
    values = [('"a"',), ('["a","b"]',), ('{"x":"a","y":["b","c"]}',), ("1",)]
    assert [sorted(v) for v in column(spark, grading.flat_strings(F.col("v")), values, "v string")][:3] == [["a"], ["a", "b"], ["a", "b", "c"]]
    payloads = [("I say {\"answer\": {\"a\": 1}} so",), ("{\"a\": 1} {\"b\": 2}",), ("```json\n{\"a\": 1}\n```",), ("``` {\"a\": 1}",), ("none",), ("{broken",)]
    assert column(spark, measures.payload(F.col("r")), payloads, "r string") == ['{"answer": {"a": 1}}', None, '{"a": 1}', None, None, None]


def test_symbols_resolve_by_what_is_written_around_them(spark):
    index = spark.createDataFrame([("net/server.go", "Server", "handle"), ("net/client.go", "Client", "handle"), ("db/base.py", "Model", "from_db"), ("a.rs", None, "g"), ("b.rs", None, "g"), ("b.rs", None, "g")], "path string, owner string, name string")
    asked = ["net/server.go:(*Server).handle()", "Client::handle", "handle", "base.py::Model.from_db", "from_db", "b.rs::g", "g", "unknown", "Other::handle"]
    got = {r["symbol"]: r["path"] for r in grading.resolve_symbols(spark.createDataFrame([(a,) for a in asked], "symbol string"), index).collect()}
    assert [got[a] for a in asked] == ["net/server.go", "net/client.go", None, "db/base.py", "db/base.py", "b.rs", None, None, None]
    gold = spark.createDataFrame([(1, "net/client.go::Client::handle"), (1, "b.rs::g"), (2, "b.rs::g"), (3, "x")], "task int, symbol string")
    said = spark.createDataFrame([(1, "client.handle"), (1, "b::g()"), (1, "from_db"), (2, "a.rs::g"), (4, "y")], "task int, symbol string")
    assert {r["task"]: r["credit"] for r in grading.set_credit(said, gold, index, ["task"]).collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}


def test_audit_and_labels(spark):
    rows = [("completed", True, GOLD, "a"), ("completed", False, "It is " + GOLD, "a"), ("completed", False, '{"answer": []}', "a"), ("completed", False, "no", "a"), ("failed", True, GOLD, "a")]
    df = spark.createDataFrame(rows, "status string, correct boolean, answer string, arm string").withColumn("gold", F.lit(GOLD)).withColumn("as_set", F.lit(True))
    got = {r["outcome"]: (r["n"], r["original_passes"], r["recovered"]) for r in measures.payload_audit(df, ["arm"]).collect()}
    assert got == {"payload_matches": (2, 1, 1), "payload_differs": (1, 0, 0), "manual_review": (1, 0, 0), "excluded_unfinished": (1, 0, 0)}
    labels = spark.createDataFrame([("c", ["empty", "x"]), ("c", []), ("c", None), ("d", [])], "arm string, labels array<string>")
    assert {r["arm"]: (r["calls"], r["empty_calls"], round(r["empty_share"], 3), r["labels"]) for r in measures.label_report(labels, "arm").collect()} == {"c": (3, 1, 0.333, {"empty": 1, "x": 1}), "d": (1, 0, 0.0, {})}
