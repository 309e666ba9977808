"""Commit history and committed snapshots, from a repository made here."""

import hashlib
import subprocess

import pytest
from pyspark.sql import functions as F

from lexforge.parse import source
from lexforge.sources import history


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("history")

    def run(*arguments):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *arguments], check=True, capture_output=True)

    def commit(message, **files):
        for name, text in files.items():
            at = root / name.replace("__", "/").replace("_dot_", ".")
            at.parent.mkdir(exist_ok=True)
            at.write_text(text)
        run("add", "-A")
        run("commit", "-m", message)

    run("init", "-q")
    commit("first", src__a_dot_py="def one():\n    return 1\n\n\ndef two():\n    return 2\n", note_dot_txt="x\n")
    commit("change two\n\nwith words", src__a_dot_py="def one():\n    return 1\n\n\ndef two():\n    return 22\n", src__b_dot_py="def new():\n    pass\n")
    commit("white space", src__a_dot_py="def one():\n    return  1\n\n\ndef two():\n    return 22\n")
    commit("prose", note_dot_txt="y\n")
    return str(root)


def first(repo):
    return subprocess.run(["git", "-C", repo, "rev-list", "--max-parents=0", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()


def test_commits(spark, repo):
    found = history.commits(spark, repo, first(repo)).orderBy("position").collect()
    assert [r.message for r in found] == ["change two\n\nwith words", "white space", "prose"]
    assert [[(c.path, c.lines) for c in r.changes] for r in found] == [[("src/a.py", [6])], [], []]
    newest = history.commits(spark, repo, first(repo), limit=1, newest_first=True).collect()
    assert [r.message for r in newest] == ["prose"]
    assert history.commits(spark, repo, "HEAD").count() == 0
    with pytest.raises(RuntimeError):
        history.commits(spark, repo, "nowhere")


def test_touched_definitions(spark, repo):
    told = history.commits(spark, repo, first(repo))
    got = history.touched_definitions(told, repo, lambda files: source.symbols(source.parse(files))).collect()
    assert [(r.path, r["name"]) for r in got] == [("src/a.py", "two")]


def test_snapshot(spark, repo):
    got = {r.path: r for r in history.snapshot(spark, repo).collect()}
    assert sorted(got) == ["src/a.py", "src/b.py"]
    text = "def new():\n    pass\n"
    assert tuple(got["src/b.py"])[1:] == (text, hashlib.sha256(text.encode()).hexdigest(), len(text), 2)
    with pytest.raises(ValueError):
        history.snapshot(spark, repo, suffixes=("go",))


def test_what_a_diff_says(spark):
    hunks = "@@ -3,2 +3 @@ f\n-a\n-b\n+c\n@@ -9,0 +9,4 @@\n+@@ -77 +1 @@\n@@ -20 +24 @@\n"
    diff = (
        f"diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n{hunks}"
        "diff --git a/new.py b/new.py\nnew file mode 100644\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+x\n"
        "diff --git a/old.rs b/now.rs\nsimilarity index 90%\nrename from old.rs\nrename to now.rs\n--- a/old.rs\n+++ b/now.rs\n@@ -1 +1 @@\n-a\n+b\n"
        "diff --git a/n.txt b/n.txt\n--- a/n.txt\n+++ b/n.txt\n@@ -1 +1 @@\n-a\n+b\n"
        "diff --git a/b.go b/b.go\nBinary files a/b.go and b/b.go differ\n"
        "diff --git a/d/y.go b/d/y.go\n--- a/d/y.go\n+++ b/d/y.go\n@@ -5 +5,2 @@\n--- a/z.go\n+rename from here\n"
    )
    got = spark.createDataFrame([(diff,), ("",)], "d string").select(history.file_changes(F.col("d")).alias("c")).collect()
    assert [[(c["path"], c["lines"]) for c in r["c"]] for r in got] == [[("x.py", [3, 4, 9, 20]), ("d/y.go", [5])], []]


def test_slices_of_the_history(spark, repo, monkeypatch):
    every = {(r["position"], r["commit"], r["message"]) for r in history.commits(spark, repo, first(repo)).collect()}
    monkeypatch.setattr(history, "COMMITS_PER_TASK", 2)
    assert {(r["position"], r["commit"], r["message"]) for r in history.commits(spark, repo, first(repo)).collect()} == every
    assert sorted(r["message"] for r in history.commits(spark, repo, first(repo), limit=2).collect()) == ["change two\n\nwith words", "white space"]


def test_odd_files_are_refused(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_bytes(b"x = 1\0\n")
    run("add", "-A")
    run("commit", "-qm", "nul")
    with pytest.raises(Exception, match="not a source file: a.py"):
        history.snapshot(spark, str(tmp_path)).collect()
    (tmp_path / "a.py").write_bytes("é\r\nx".encode())
    (tmp_path / "l.py").symlink_to("a.py")
    run("add", "-A")
    run("commit", "-qm", "link")
    with pytest.raises(ValueError, match="not a plain file"):
        history.snapshot(spark, str(tmp_path))
    (tmp_path / "l.py").unlink()
    run("add", "-A")
    run("commit", "-qm", "plain")
    assert [(r["text"], r["lines"]) for r in history.snapshot(spark, str(tmp_path)).collect()] == [("é\r\nx", 2)]
