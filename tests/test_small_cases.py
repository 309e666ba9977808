"""Run folders, pluggable rankers, composed calls and freshness."""

import json

import pytest
from pyspark.sql import functions as F

from lexforge.operators import lines
from lexforge.plans import compose
from lexforge.plans.session import Session, check_ranking
from lexforge.sources import logs


def test_run_folders(spark, tmp_path):
    for trial, attempt, status in (("trial-0001", None, "completed"), ("trial-0002", 1, "failed"), ("trial-0002", 12, "completed")):
        at = tmp_path / trial / (f"attempt-{attempt:02}" if attempt else "")
        at.mkdir(parents=True, exist_ok=True)
        (at / "run.json").write_text(json.dumps({"task_id": "t", "system": "A", "status": status, "usage": {"input_tokens": 5}}, indent=1))
        (at / "other.json").write_text("{}")
    runs = logs.read_runs(spark, str(tmp_path))
    assert sorted((r["trial"], r["attempt"], r["status"]) for r in runs.collect()) == [("trial-0001", 0, "completed"), ("trial-0002", 1, "failed"), ("trial-0002", 12, "completed")]
    assert logs.usage_columns(runs).agg(F.sum("input_tokens")).head()[0] == 15


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "a.py").write_text("import b\n\n\ndef one():\n    return b.two()\n")
    (root / "b.py").write_text("def two():\n    return 2\n")
    return Session(spark, str(root))


def test_a_rankers_page_is_whole_or_refused(spark, session):
    every = lines.lines(session.files())
    schema = "path string, start_line int, end_line int, score double"
    good = [("a.py", 4, 5, 0.5), ("b.py", 1, 2, 0.9)]
    ranked = check_ranking(spark.createDataFrame(good, schema), every, 2)
    assert [(r["path"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [("b.py", 1), ("a.py", 2)]
    for bad in [("c.py", 1, 1, 0.1), ("a.py", 0, 1, 0.1), ("a.py", 2, 1, 0.1), ("a.py", 1, 9, 0.1), ("a.py", 1, 1, float("nan")), ("a.py", 1, 1, float("inf")), ("a.py", 1, 1, None)]:
        with pytest.raises(ValueError, match="page isn't valid"):
            check_ranking(spark.createDataFrame([*good[:1], bad], schema), every, 2)
    with pytest.raises(ValueError, match="page isn't valid"):
        check_ranking(spark.createDataFrame(good, schema), every, 1)


def test_steps_refer_to_earlier_results(session):
    pages = compose.run_plan(session, [{"tool": "find_symbol", "arguments": {"name": "one"}}, {"tool": "read_source", "arguments": {"path": "$1.path", "start_line": "$1.line"}}])
    assert pages[1].results[0] == {"line": 4, "text": "def one():"}
    assert compose.value_of("$1.path[0]", pages) == "a.py" and compose.value_of("no reference", pages) == "no reference"
    for lost in ("$3.path", "$1.path[7]", "$1.nothing"):
        with pytest.raises(ValueError):
            compose.value_of(lost, pages)
    with pytest.raises(ValueError):
        compose.run_plan(session, [])
    path = [{"tool": "search_exact", "arguments": {"query": "two"}, "expect": ["b.py", "nowhere.py"]}]
    assert compose.path_problems(path, session) == ["step 1: 'nowhere.py' isn't shown"]


def test_every_question_reads_the_tree_anew(spark, tmp_path):
    (tmp_path / "x.py").write_text("def early(): pass\n")
    s = Session(spark, str(tmp_path))
    assert len(s.find_symbol("early").results) == 1
    (tmp_path / "x.py").write_text("def later(): pass\n")
    assert s.find_symbol("early").results == [] and len(s.find_symbol("later").results) == 1
    assert s.search_exact("later").extra["files_searched"] == 1
