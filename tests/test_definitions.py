"""Definitions, spans and calls by column expressions, in each language."""

import pytest
from pyspark.sql import functions as F

from lexforge.operators import definitions

CODE = {
    "a.py": 'class A:\n    """def no():"""\n    x = 1  # def never():\n\n    def run(self, k):\n        s = "def s(): {"\n        if k:\n            return helper(k)\n\n        return self.run(2)\n\n\nasync def last(): pass\nprint(A())\n',
    "b.rs": 'pub struct S { a: u8 }\n// fn no() {\nimpl S {\n    pub fn one(&self) -> u8 {\n        /* fn two() {\n        } */\n        two(self.a, "{ }")\n    }\n    fn decl(&self);\n}\nmod t {\n    fn two(x: u8) -> u8 { x }\n}\n',
    "c.go": "package m\nfunc (s *S) Run(a int) {\n\tif a > 0 { go do(a) }\n}\ntype S struct {\n\tn int\n}\n",
    "D.java": "class D {\n    private static int go(int a)\n    {\n        return new E(a).f();\n    }\n    void g() { go(1); }\n}\n",
    "e.ts": "export const h = async (a: number) => {\n  return k(`x ${f()}`);\n};\nclass F {\n  m(a) {\n    h(a);\n  }\n}\n",
    "f.c": "struct p {\n  int a;\n};\nstatic int add(int a,\n               int b)\n{\n  return sub(a);\n}\nint proto(int a);\n",
    "g.txt": "def f(): g()\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([*CODE.items(), ("n.py", None), ("z.py", "")], "path string, text string")


def test_blanking_keeps_places(spark, files):
    for r in files.where("text IS NOT NULL").select("path", "text", definitions.blank(F.col("text"), F.col("path")).alias("b")).collect():
        if r["path"] == "g.txt":
            assert r["b"] is None
            continue
        assert len(r["b"]) == len(r["text"]) and [i for i, c in enumerate(r["b"]) if c == "\n"] == [i for i, c in enumerate(r["text"]) if c == "\n"]
        assert all(b in (t, " ") for b, t in zip(r["b"], r["text"]))
        assert "never" not in r["b"] and "no(" not in r["b"]


def test_symbols(spark, files):
    got = {}
    for r in definitions.symbols(files).collect():
        got.setdefault(r["path"], set()).add((r["name"], r["kind"], r["line"], r["end_line"]))
    assert got == {
        "a.py": {("A", "class", 1, 10), ("run", "def", 5, 10), ("last", "def", 13, 13)},
        "b.rs": {("S", "struct", 1, 1), ("one", "fn", 4, 8), ("decl", "fn", 9, 9), ("t", "mod", 11, 13), ("two", "fn", 12, 12)},
        "c.go": {("Run", "func", 2, 4), ("S", "type", 5, 7)},
        "D.java": {("D", "class", 1, 7), ("go", "method", 2, 5), ("g", "method", 6, 6)},
        "e.ts": {("h", "function", 1, 3), ("F", "class", 4, 8), ("m", "method", 5, 7)},
        "f.c": {("p", "struct", 1, 3), ("add", "function", 4, 8)},
    }


def test_calls(spark, files):
    got = {}
    for r in definitions.calls(files).collect():
        got.setdefault(r["path"], set()).add((r["line"], r["name"], r["caller"]))
    assert got == {
        "a.py": {(8, "helper", "run"), (10, "run", "run"), (14, "print", None), (14, "A", None)},
        "b.rs": {(7, "two", "one")},
        "c.go": {(3, "do", "Run")},
        "D.java": {(4, "E", "go"), (4, "f", "go"), (6, "go", "g")},
        "e.ts": {(2, "k", "h"), (6, "h", "m")},
        "f.c": {(7, "sub", "add"), (9, "proto", None)},
    }


def test_a_long_file(spark):
    n = 20_000
    code = "".join(f"def f{i}():\n    if x:\n        g{i}()\n" for i in range(n))
    found = definitions.symbols(spark.createDataFrame([("big.py", code)], "path string, text string"))
    assert found.where("end_line = line + 2").count() == n
