"""Vector codes, balanced shards and periodic runs against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import queries
from lexforge.llm.label_shards import _flow, shard_documents
from lexforge.llm.periodic_runs import Extensions, RangeMinimum, drop_runs, find_runs
from lexforge.llm.vector_codes import code_vectors, codebooks_digest, with_label_errors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


# ---- periodic runs


def plain_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed, n):
    rnd, texts = random.Random(seed), []
    for _ in range(n):
        letters = "abcde"[: rnd.choice([1, 2, 3, 5])]
        words = [rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 6, 7, 30, 90]))]
        if words and rnd.random() < 0.5:
            a, p = rnd.randrange(len(words)), rnd.randint(1, 7)
            words = [words[a + (i - a) % p] if i >= a and a + p <= len(words) else w for i, w in enumerate(words)]
        texts.append(rnd.choice(["", " ", "\n"]) + rnd.choice([" ", "\t \n"]).join(words) + rnd.choice(["", "  "]))
    return texts


def test_range_minimum_and_extensions():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 700)
    first = rng.integers(0, 700, 3000)
    last = np.minimum(699, first + rng.integers(0, 700, 3000))
    assert RangeMinimum(values).at(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]
    symbols = rng.integers(0, 2, 300)
    ext = Extensions(symbols)
    for i, j in rng.integers(0, 300, (400, 2)).tolist():
        if i < j:
            n = 0
            while j + n < 300 and symbols[i + n] == symbols[j + n]:
                n += 1
            assert ext.at(np.array([i]), np.array([j])).tolist() == [n]


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_brute_force(spark, least, exponent):
    texts = [*random_texts(7, 120), None, "", " \t", "ä ä ä ä ä ä ß", "x y x y x y x y x y x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for row in find_runs(docs, least=least, exponent=exponent).collect():
        words = WORD.findall(texts[row["id"]] or "")
        want = plain_runs(words, least, exponent)
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == want
        assert (row["n_words"], row["n_runs"]) == (len(words), len(want))
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
        best = min(want, key=lambda r: (-r[1], r[0], r[2])) if want else (None, None, None)
        assert (row["start"], row["length"], row["period"]) == best


def test_runs_of_odd_tables(spark):
    rows = [(1, "a b " * 9, "x"), (1, "a b " * 9, "y"), (None, None, None), (2, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("id", F.lit(0)).withColumn("start", F.lit(1))
    found = find_runs(docs).collect()
    assert sorted((r["id"] or 0, r["n_runs"], r["period"] or 0) for r in found) == [(0, 0, 0), (1, 1, 2), (1, 1, 2), (2, 0, 0)]
    cut = drop_runs(docs)
    assert cut.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in cut.collect() if r["text"]) == [(1, "a b"), (1, "a b"), (2, "z")]
    none = spark.createDataFrame([], DOCS)
    assert find_runs(none).count() == 0 and drop_runs(none).count() == 0


def test_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "go " * 60_000), (2, " ".join(str(i % 500) for i in range(50_000)))], DOCS)
    found = {r["id"]: (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in find_runs(docs).collect()}
    assert found == {1: (1, 0, 60_000, 1, 60_000_000), 2: (1, 0, 50_000, 500, 100_000)}


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_query_of_runs(spark, tmp_path):
    texts = [" ".join(f"w{(i * k) % 97}" for i in range(k % 60)) for k in range(300)] + [None, "", "  "]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        words = planted(i, WORD.findall(text or ""))
        want = plain_runs(words)
        assert found[i]["n_runs"] == len(want)
        assert found[i]["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % r for r in want).encode()).hexdigest()
        assert found[i]["collapsed_sha256"] == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
    assert sum(r["n_runs"] > 0 for r in found.values()) > 5


# ---- vector codes


def plain_codes(vectors, parts, entries, rounds, scale=4096):
    """vectors: (id, label, list) that take part, by id."""
    length = max(len(v) for _, _, v in vectors)
    width = max(1, math.ceil(length / parts))
    whole = [[math.floor(scale * x) for x in v] + [0] * (width * parts - len(v)) for _, _, v in vectors]
    cut = [[q[k * width : (k + 1) * width] for q in whole] for k in range(parts)]
    books = [[list(v) for v in part[:entries]] for part in cut]

    def nearest(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), c) for c, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            own = {}
            for v in cut[k]:
                own.setdefault(nearest(v, books[k])[1], []).append(v)
            for c, vs in own.items():
                books[k][c] = [sum(x) // len(vs) for x in zip(*vs)]
    out = []
    for i, (vec_id, label, _) in enumerate(vectors):
        found = [nearest(cut[k][i], books[k]) for k in range(parts)]
        out.append((vec_id, label, "".join(f"{c:02x}" for _, c in found), sum(d for d, _ in found)))
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(*row, sums[row[1]]) for row in out], digest


def coded(df, **options):
    rows, books = code_vectors(df, **options)
    found = [(r["id"], r["label"], bytes(r["codes"]).hex(), r["error"], r["label_error"]) for r in with_label_errors(rows).collect()]
    return found, codebooks_digest(books)


def by_label(rows):
    return sorted(rows, key=repr)


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("n, length, parts, entries", [(300, 16, 8, 16), (9, 8, 4, 16), (120, 10, 4, 5), (40, 3, 8, 4)])
def test_codes_equal_brute_force(spark, n, length, parts, entries):
    rnd = random.Random(n)
    rows = [(i * 3 % 1009, [rnd.choice([-1, 1]) * rnd.random() for _ in range(length)], rnd.choice([None, 1, 2, 3])) for i in range(n)]
    rows += [(5001 + i, [0.25] * length, 7) for i in range(n)]  # a third and more of one vector and one label
    got, digest = coded(spark.createDataFrame(rows, VECTORS).repartition(5), parts=parts, entries=entries, rounds=3)
    want, books = plain_codes(sorted((i, label, v) for i, v, label in rows), parts, entries, 3)
    assert by_label(got) == by_label(want) and digest == books


def test_codes_of_odd_tables(spark):
    bad = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, float("-inf")]]
    good = [[0.5, -0.5], [0.5, -0.5], [0.25], [], [1.0, 2.0, 3.0]]
    rows = [(i, v, None) for i, v in enumerate([*bad, *good])] + [(9, [1.0, 2.0, 3.0], 4)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("x")).withColumn("codes", F.lit(0)).withColumn("rows", F.lit(0))
    got, digest = coded(df, parts=2, entries=2, rounds=2)
    want, books = plain_codes([(i, label, v) for i, v, label in rows if i >= 5], 2, 2, 2)
    assert by_label(got) == by_label(want) and digest == books
    assert coded(spark.createDataFrame([], VECTORS))[0] == []
    assert coded(spark.createDataFrame([(1, None, 1)], VECTORS))[0] == []
    with pytest.raises(ValueError, match="too large"):
        code_vectors(spark.createDataFrame([(1, [1e300], 1)], VECTORS))


def test_codes_of_null_identifiers(spark):
    rows = [(None, [1.0, 1.0], 1), (2, [0.0, 0.0], 1), (1, [3.0, 3.0], 2)]
    found, books = code_vectors(spark.createDataFrame(rows, VECTORS), parts=2, entries=2, rounds=0)
    assert [b.tolist() for b in books] == [[[3 * 4096], [0]]] * 2  # the smallest identifiers, nulls last
    assert {r["id"]: bytes(r["codes"]) for r in found.collect()} == {None: b"\x01\x01", 1: b"\x00\x00", 2: b"\x01\x01"}


def test_query_of_codes(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(16)], i % 3 or None) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_vector_codes(spark, str(tmp_path)).collect()
    exact = [(i, label, [float(np.float32(x)) for x in v]) for i, v, label in rows]
    want, books = plain_codes(exact, 8, 16, 6)
    assert {(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got} == {(i, c, e, s, books) for i, _, c, e, s in want}


# ---- shards


def check_law(rows, texts, shards):
    """Counts, sizes and slots hold; returns the number of links that are cut (to the strongest shard of a text)."""
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        own = (texts[r["id"]] or "").encode()
        assert r["size"] == len(own) + 1 and r["text_crc32"] == zlib.crc32(own)
    placed = {}
    for r in rows:
        placed.setdefault(texts[r["id"]] or "", Counter())[r["shard"]] += 1
    return {t: c for t, c in placed.items() if len(c) > 1}


def table_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_groups_stay_whole_and_a_hot_one_fills_as_few_shards_as_can_be(spark):
    rnd = random.Random(4)
    texts = ["hot"] * 300 + [f"own {i}" for i in range(400)] + [None, "", None]
    for k in range(40):
        texts += [f"copy {k} ü"] * rnd.choice([2, 2, 3, 5, 12])
    rnd.shuffle(texts)
    cut = check_law(shard_documents(table_of(spark, texts)).collect(), texts, 8)
    assert set(cut) == {"hot"} and len(cut["hot"]) == math.ceil(300 / (len(texts) / 8))


def test_all_documents_linked(spark):
    texts = [f"pair {i // 2}" for i in range(160)]
    cut = check_law(shard_documents(table_of(spark, texts), shards=2, rounds=8).collect(), texts, 2)
    assert len(cut) <= 8  # no free document makes room: only swaps move


def test_shards_of_odd_tables(spark):
    assert shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    few = shard_documents(table_of(spark, ["a", "b", "a"]), shards=8, rounds=1).collect()
    assert len(few) == 3 and sorted(r["slot"] for r in few) == [0, 0, 0]  # a row for a shard, though two are linked
    rows = [(1, "a", 9), (1, "a", 9), (None, None, 9), (None, "b", 9), (2, "c" * 100_000, 9)]
    docs = spark.createDataFrame(rows, DOCS + ", shard int").withColumn("id", F.lit("x")).withColumn("group", F.lit(1)).withColumn("members", F.lit(1))
    found = shard_documents(docs, shards=2).collect()
    assert sorted(Counter(r["shard"] for r in found).values()) == [2, 3]
    assert sorted(r["size"] for r in found) == [1, 2, 2, 2, 100_001]
    same = [r["shard"] for r in found if r["id"] == 1]
    assert len(same) == 2 and len(set(same)) == 1


def test_shards_by_a_column(spark):
    docs = spark.range(240).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 90, F.floor(F.col("id") / 10)).alias("site"))
    rows = shard_documents(docs, group=F.coalesce(F.col("site").cast("string"), F.concat(F.lit("own "), F.col("doc_id"))), shards=4).collect()
    shards = {}
    for r in rows:
        if r["id"] < 90:
            shards.setdefault(r["id"] // 10, set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    assert set(Counter(r["shard"] for r in rows).values()) == {60}


def test_flow_respects_quotas():
    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randint(2, 6)
        quotas = [rnd.randint(1, 50) for _ in range(n)]
        loads = [rnd.randint(0, q) for q in quotas]
        wanted = {(s, t): rnd.randint(0, loads[s] // n) for s in range(n) for t in range(n) if s != t}
        flow = _flow(wanted, loads, quotas)
        after = list(loads)
        for (s, t), k in flow.items():
            assert 0 < k <= wanted[s, t]
            after[s] -= k
            after[t] += k
        assert all(a <= q for a, q in zip(after, quotas))
    assert _flow({(0, 1): 5, (1, 0): 5}, [9, 9], [9, 9]) == {(0, 1): 5, (1, 0): 5}  # swaps need no room


def test_query_of_shards(spark, tmp_path):
    texts = ["x"] * 30 + [f"own {i}" for i in range(71)] + [None]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_label_shards(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = [{**r.asDict(), "id": r["doc_id"]} for r in out.collect()]
    cut = check_law(rows, texts, 8)
    assert set(cut) <= {"x"} and {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
