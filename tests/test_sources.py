import json

import pytest
from pyspark.sql import functions as F

from lexforge.parse.blank import without_literals
from lexforge.parse.source import parse_text
from lexforge.sources import logs, repo, vectors


def names(parsed, kind=None):
    return [s["name"] for s in parsed.symbols if kind in (None, s["kind"])]


def calls(parsed):
    return [(r["name"], r["caller"]) for r in parsed.refs if r["kind"] == "call"]


def test_python():
    p = parse_text("b.py", "from a.b import c\nclass K:\n    def m(self, x=1):\n        return self.go(x) + helper\n\ndef helper():\n    return f()()\n")
    assert [(s["name"], s["container"], s["line"], s["end_line"]) for s in p.symbols] == [("K", None, 2, 4), ("m", "K", 3, 4), ("helper", None, 6, 7)]
    assert calls(p) == [("go", "m"), ("f", "helper")]
    assert ("helper", "m") in [(r["name"], r["caller"]) for r in p.refs if r["kind"] == "possible_reference"]
    assert p.imports[0]["candidate_files"] == ["a/b.py", "a/b/__init__.py"]


def test_rust():
    p = parse_text("src/lib.rs", 'mod x;\nimpl Foo {\n    fn top(&self) { middle(); println!("{}", hidden()); }\n}\nstruct Foo;\nfn middle() {} // fn not_this() {}\n')
    assert names(p) == ["top", "Foo", "middle"] and p.symbols[0]["container"] == "Foo"
    assert calls(p) == [("middle", "top")] and p.imports[0]["candidate_files"] == ["src/x.rs", "src/x/mod.rs"]


def test_typescript():
    p = parse_text("a/c.ts", "import {a} from './lib';\nclass Base { run(x: number): void { this.go(); new Thing(x); } }\nconst arrow = (a) => { return helper(a); };\nconst plain = 3;\n")
    assert names(p) == ["Base", "run", "arrow"]
    assert calls(p) == [("go", "run"), ("Thing", "run"), ("helper", "arrow")]
    assert p.imports[0]["candidate_files"][:2] == ["a/lib.ts", "a/lib.tsx"]


def test_go_java_c():
    g = parse_text("d.go", 'package m\n\nimport r "ex.com/m/real"\n\nfunc (t *T) Run() { r.Do() }\n')
    assert g.symbols[0]["container"] == "T" and calls(g) == [("Do", "Run")] and [r for r in g.refs if r["name"] == "Do"][0]["qualifier"] == "r"
    j = parse_text("E.java", "import a.b.C;\nclass E {\n  E(int x) { make(x); }\n  int run() { return new Helper<A>(1).go(); }\n}\n")
    assert names(j) == ["E", "E", "run"] and ("Helper", "run") in calls(j)
    c = parse_text("f.c", '#include "fs.h"\n#define MAX(a,b) ((a)>(b))\nstruct inode { int a; };\nstatic struct inode *get(struct inode *p) {\n  return find(p);\n}\ntypedef struct { int x; } thing_t;\n')
    assert names(c) == ["MAX", "inode", "get", "thing_t"] and calls(c) == [("find", "get")]
    x = parse_text("g.cpp", "int Engine::start(int a) {\n  return new Widget(a)->run();\n}\n")
    assert x.symbols[0]["container"] == "Engine" and calls(x) == [("Widget", "start"), ("run", "start")]
    assert not parse_text("x.txt", "fn a() {}").symbols and not parse_text("bad.py", "def (").symbols


def test_blanking_keeps_places():
    source = 'a = "x{y}" # b {\nc = 1\n'
    bare = without_literals(source, "python")
    assert len(bare) == len(source) and "{" not in bare and bare.count("\n") == 2


def test_ignore_rules():
    match = lambda line, path: bool(repo.Rule.parse(line).pattern.match(path))
    assert match("*.log", "a/b.log") and not match("/x", "a/x") and match("a/**/b", "a/c/d/b") and match("**/t", "t")
    assert match("d?g[!x]", "doga") and not match("d?g[!x]", "dogx") and repo.Rule.parse("!keep").negated and repo.Rule.parse("# c") is None


def test_roots_and_paths(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "l").symlink_to(tmp_path / "a")
    assert repo.resolve(str(tmp_path), "a").endswith("a")
    for bad in ("/a", "../a", "l", "a" * 5000):
        with pytest.raises(ValueError):
            repo.resolve(str(tmp_path), bad)
    assert repo.root_from_uri("file:///tmp/a%20b") == "/tmp/a b"
    with pytest.raises(ValueError):
        repo.root_from_uri("file:///")


def test_skipped_files(spark, tmp_path):
    (tmp_path / "ok.rs").write_text("x")
    (tmp_path / "nul.rs").write_bytes(b"a\0")
    (tmp_path / "big.rs").write_bytes(b"a" * (repo.MAX_FILE_BYTES + 1))
    got = {r.path: r.reason for r in repo.read_repo(spark, str(tmp_path), skipped=True).collect()}
    assert got == {"ok.rs": None, "nul.rs": "not_text", "big.rs": "too_large"}


def test_events(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    logs.write_log_line(str(log), {"event": "tool_start", "session_id": "s", "sequence": 1, "tool": "x", "timestamp_ms": 5})
    with log.open("a") as f:
        f.write('{"event": "tool_e')
    events, bad = logs.read_events(spark, str(log))
    assert events.count() == 1 and bad.count() == 1 and log.stat().st_mode & 0o777 == 0o600


def test_streams(spark):
    claude = [
        {"type": "assistant", "message": {"id": "m1", "content": [{"type": "tool_use", "id": "u1", "name": "Read", "input": {"file_path": "a.rs"}}], "usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 10, "cache_creation_input_tokens": 5}}},
        {"type": "assistant", "message": {"id": "m1", "content": [], "usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 10, "cache_creation_input_tokens": 5}}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "content": "text"}]}},
    ]
    lines = spark.createDataFrame([("t", i, json.dumps(e)) for i, e in enumerate(claude)], "trial string, pos int, value string")
    call = logs.stream_calls(lines, "claude").head()
    assert (call.name, call.body, call.read) == ("Read", "text", "a.rs")
    steps = logs.stream_steps(lines, "claude").collect()
    assert len(steps) == 1 and steps[0].input == 16
    codex = [{"type": "item.completed", "item": {"type": "command_execution", "command": "ls", "aggregated_output": "x"}}, {"type": "turn.completed", "usage": {"input_tokens": 7, "output_tokens": 1, "cached_input_tokens": 3}}]
    lines = spark.createDataFrame([("t", i, json.dumps(e)) for i, e in enumerate(codex)], "trial string, pos int, value string")
    row = logs.stream_summary(lines, "codex", ["shell"]).head()
    assert (row.tool_calls, row.input, row.cache_read, row.unexpected) == (1, 7, 3, [])


def test_vector_cache(spark, tmp_path):
    asked = []

    def embedder(texts):
        return [[float(len(t)), 1.0] for t in texts]

    chunks = spark.createDataFrame([("p", "aa"), ("p", "bbb")], "path string, text string").withColumn("key", vectors.content_key())
    cache = vectors.VectorCache(spark, str(tmp_path / "cache"), "model-1")
    assert cache.load().count() == 0
    assert vectors.refreshed(chunks, cache, embedder).count() == 2
    more = chunks.where("text = 'aa'")

    def broken(texts):
        raise AssertionError("nothing is to be made")

    assert vectors.refreshed(more, cache, broken).count() == 1  # reused, and the stale vector is gone
    assert vectors.VectorCache(spark, str(tmp_path / "cache"), "model-2").load().count() == 0
    assert not asked


def test_references_leave_out_parameters_and_reserved_words():
    """What parameters declare, types of the language, modifiers and names of properties aren't uses."""

    def uses(path, text):
        return [r["name"] for r in parse_text(path, text).refs if r["kind"] == "possible_reference"]

    assert uses("a.ts", "const f = async <T>(a: Foo, b = bar()): Promise<string> => { const q: number = a.b + 0x1F; return g(type as any, ...rest); };\n") == ["Promise", "q", "a", "type", "rest"]
    assert uses("b.rs", "impl<T: Clone> Foo<T> for Bar<T> {\n    fn go<U>(&self, x: Vec<u8>) -> Option<Baz> { let y: Qux = x; y }\n}\n") == ["Foo", "T", "T", "Option", "Baz", "y", "Qux", "x", "y"]
    assert uses("c.go", "package m\nfunc (t *T) Do(a int) (n int, err error) { return a, nil }\n") == ["a"]
    java = parse_text("F.java", "class F { void a() { if (x) b(); else c(); synchronized (this) { d(); } } }\n")
    assert [x["name"] for x in java.symbols] == ["F", "a"] and [r["name"] for r in java.refs if r["kind"] == "call"] == ["b", "c", "d"]
    assert uses("E.java", "package p.q;\nclass E { Foo run(int x) { return this.make(x, y); } }\n") == ["Foo", "x", "y"]
    assert uses("d.c", "#ifdef A\nstatic struct inode *get(struct inode *p) { int i = 0; return find(p, include); }\n#endif\n") == ["A", "inode", "i", "p", "include"]
    e = parse_text("e.py", "def f(a: X = y, *, k=make(z)) -> R:\n    g = lambda q=w: q + a\n")
    assert [(r["kind"], r["name"]) for r in e.refs if r["line"] == 1] == [("call", "make"), ("possible_reference", "R")]
    assert [r["name"] for r in e.refs if r["line"] == 2] == ["g", "w", "q", "a"]
