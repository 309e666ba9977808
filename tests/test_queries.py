"""Every registered query that has SQL equals it on the smallest tables; every one runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
REFERENCE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def shown(v):
        if isinstance(v, float):
            return f"{v:.6f}"
        return repr(v)

    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", REFERENCE)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql()[name]
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), want.columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_llm():
    """The guard lets everything else work where the subpackage is gone."""
    import subprocess
    import sys

    code = "import sys; sys.modules['lexforge.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_contrasts_cover_all_parts(spark, duck):
    """Every cell of part takes part, against pairs counted by brute force."""
    cells = duck.sql("select p_partkey, p_brand, p_type, p_size from part").fetchall()
    want = {
        ("abz"[i - 1], x[0], y[0])
        for x in cells
        for y in cells
        for i in (1, 2, 3)
        if x[i] < y[i] and all(x[j] == y[j] for j in (1, 2, 3) if j != i)
    }
    got = [tuple(r) for r in entry.queries()["one_factor_contrasts"](spark, SF).select("factor", "cell", "other_cell").collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_read_range_keeps_long_lines(spark, tmp_path):
    """Lines beyond the budget of a page are rows of the SQL as well."""
    texts = [(1, "a\n" + "b" * 40_000 + "\nc\nd\ne", "en", "src0", 40_009), (2, "a\nb\n" + "é" * 20_000 + "\n", "de", "src1", 20_005)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = entry.queries()["read_range"](spark, str(tmp_path)), con.sql(entry.oracle_sql()["read_range"])
    assert len(want.fetchall()) == 5
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), want.columns)


def test_gold_moves_no_texts(spark, duck, monkeypatch):
    """Few passages come to the texts; of many, keys and ids meet first, with the same result."""
    from lexforge.plans import queries

    found = queries._gold(spark, SF)
    assert "hashpartitioning(doc_id#" not in found._jdf.queryExecution().executedPlan().toString()
    few = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(queries, "_MOST_KEYS", 0)
    assert few == sorted(map(tuple, queries._gold(spark, SF).collect()))
    assert few == sorted(duck.sql("select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)").fetchall()) and few


@pytest.mark.parametrize("name", ["ranker_tiers", "mrr_recall"])
def test_passages_are_looked_up_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_intersect(") == 1
