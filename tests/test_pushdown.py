"""What a question about a tree opens, and how deep pages and chunks are made."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith, StringStartsWith

from lexforge.operators import lines
from lexforge.operators.paging import page_per
from lexforge.plans.session import Session
from lexforge.sources import repo


@pytest.fixture
def tree(tmp_path):
    for path, text in {
        "src/a.py": "def one():\n    pass\n", "src/deep/b.py": "x = 1\n", "src/deep/c.txt": "plain\n", "srcs/d.py": "y = 2\n", "docs/e.md": "words\n", ".gitignore": "*.log\n",
        "src/f.log": "lost\n", "docs/.ignore": "g.md\n", "docs/g.md": "lost\n", "src/deep/.gitignore": "!kept.log\n", "src/deep/kept.log": "kept\n", "top.py": "z = 3\n",
    }.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return tmp_path


EVERY = ["docs/e.md", "src/a.py", "src/deep/b.py", "src/deep/c.txt", "src/deep/kept.log", "srcs/d.py", "top.py"]


def opened(monkeypatch, root, filters, tasks=repo.FOLDER_TASKS, **options):
    seen = []
    monkeypatch.setattr(repo, "load_text", lambda path: seen.append(os.path.relpath(path, root)) or ("", 0, None))
    monkeypatch.setattr(repo, "FOLDER_TASKS", tasks)
    reader = repo._Reader({"path": str(root), **options})
    rest = list(reader.pushFilters(filters))
    for part in reader.partitions():
        list(reader.read(part))
    return sorted(seen), rest


@pytest.mark.parametrize("tasks", [1, 2, 256])
def test_only_what_can_match_is_opened(monkeypatch, tree, tasks):
    assert opened(monkeypatch, tree, [], tasks) == (EVERY, [])
    assert opened(monkeypatch, tree, [], tasks, scope="src") == ([p for p in EVERY if p.startswith("src/")], [])
    assert opened(monkeypatch, tree, [StringStartsWith(("path",), "src/deep")], tasks)[0] == ["src/deep/b.py", "src/deep/c.txt", "src/deep/kept.log"]
    assert opened(monkeypatch, tree, [EqualTo(("path",), "src/deep/b.py")], tasks)[0] == ["src/deep/b.py"]
    assert opened(monkeypatch, tree, [In(("suffix",), ("py", "rs")), StringStartsWith(("path",), "src")], tasks)[0] == ["src/a.py", "src/deep/b.py", "srcs/d.py"]
    assert opened(monkeypatch, tree, [StringEndsWith(("path",), ".md")], tasks)[0] == ["docs/e.md"]
    large = GreaterThan(("bytes",), 5)
    assert opened(monkeypatch, tree, [large], tasks) == (EVERY, [large])  # Spark's own


def test_folders_that_cannot_match_are_not_entered(monkeypatch, tree):
    reader = repo._Reader({"path": str(tree)})
    list(reader.pushFilters([StringStartsWith(("path",), "src/deep/")]))
    entered = []
    listed = repo._listed
    monkeypatch.setattr(repo, "_listed", lambda root, relative, *rest: entered.append(relative) or listed(root, relative, *rest))
    reader.partitions()
    assert entered == ["", "src", "src/deep"]


def test_a_scoped_search_opens_its_scope_only(spark, tree):
    """Through Spark: files outside the scope keep the access time they were given."""
    long_ago = (1, time.time())
    probe = tree / "probe.py"
    probe.write_text("x")
    os.utime(probe, long_ago)
    probe.read_text()
    if probe.stat().st_atime == 1:
        pytest.skip("the file system keeps no access times")
    probe.unlink()

    def touched(ask):
        for p in EVERY:
            os.utime(tree / p, long_ago)
        found = ask(Session(spark, str(tree)))
        return found, [p for p in EVERY if (tree / p).stat().st_atime != 1]

    found, seen = touched(lambda s: s.search_exact("x", path="src"))
    assert [r["path"] for r in found.results] == ["src/deep/b.py"] and found.extra["files_searched"] == 4
    assert [p for p in seen if not p.startswith("src")] == []
    found, seen = touched(lambda s: s.find_symbol("one"))
    assert [r["path"] for r in found.results] == ["src/a.py"]
    assert all(p.endswith(".py") for p in seen)


def test_a_search_is_one_job(spark, tree):
    context = spark.sparkContext
    session = Session(spark, str(tree))
    context.setJobGroup("one", "one search")
    try:
        found = session.search_exact(queries=["x", "=", "nowhere"])
        jobs = context.statusTracker().getJobIdsForGroup("one")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert found.extra["files_searched"] == len(EVERY) and len(found.results) == 4
    scans = [s for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds]
    assert len(jobs) <= 2 and len(set(scans)) <= 3  # AQE starts the scan's stage and the result's; the tree is read once


def test_deep_pages_move_few_rows(spark):
    rows = spark.range(200_000, numPartitions=4).select((F.col("id") % 2).alias("key"), F.hash("id").alias("v"))
    cut = page_per(rows, "key", [F.col("v")], 100, 10_000)
    got = {k: [r["v"] for r in cut.where(F.col("key") == k).orderBy("place").collect()] for k in (0, 1)}
    for k in (0, 1):
        every = sorted(r["v"] for r in rows.where(F.col("key") == k).collect())
        assert got[k] == every[10_000:10_101]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")  # each part is cut before anything moves
    cut.collect()
    moved = _shuffled(cut)
    assert 0 < moved <= 4 * 2 * 10_101


def _shuffled(df):
    """Records written by the exchanges of a plan that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.getClass().getSimpleName()
    plan = plan.executedPlan() if text == "AdaptiveSparkPlanExec" else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        while name.endswith("QueryStageExec"):
            node = node.plan()
            name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_chunks_take_the_comment_block_above(spark, tmp_path):
    long = "\n".join(f"# note {i}" for i in range(40))
    (tmp_path / "m.py").write_text(f"# apart\n\n# one\n# two\ndef f():\n    # inner\n    return 1\n\n{long}\ndef g():\n    return 2\n\ndef h():\n    return 3\n")
    s = Session(spark, str(tmp_path))
    got = {r["text"].split(" ")[1]: (r["start_line"], r["text"].split(" ", 2)[2]) for r in s.chunks(s.sources()).collect()}
    assert got["f"][1] == "# one\n# two\ndef f():\n    # inner\n    return 1"
    assert got["g"][1].split("\n")[0] == "# note 10" and got["g"][1].count("# note") == 30  # thirty lines at most
    assert got["h"][1] == "def h():\n    return 3"


def test_lines_of_any_pattern_are_asked_for_each(spark):
    files = spark.createDataFrame([("a", "x y\nx\ny\nz\n")], "path string, text string")
    found = lines.exact_matches(files, ["x", "y", "q"]).collect()
    assert sorted((r["pattern"], r["line"]) for r in found) == [("x", 1), ("x", 2), ("y", 1), ("y", 3)]
