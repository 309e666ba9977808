"""The query functions over small tables, each against a plain version of its contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import packing, quality, queries, vector_graph

DOCS = "doc_id long, text string"


def texts(seed=3, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ß", "The"]
    made = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 40, 120]))) for _ in range(n)]
    for i in range(0, n, 3):
        made.append(made[i])
        own = made[i].split()
        made.append(" ".join([*own[: len(own) // 2], "changed", *own[len(own) // 2 :]]))
    passage = " ".join(rnd.choice(words) for _ in range(130))
    made += [f"x{k} {passage} y{k}" for k in range(3)] + [None, "", "  ", "THE é", "the é"]
    rnd.shuffle(made)
    return made


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(list(enumerate(texts())), DOCS).write.parquet(f"{at}/documents.parquet")
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 12)).astype("float32")
    v[7] = v[120]
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(300, None, 1), (320, [0.0] * 12, 1), (340, [float("nan")] * 12, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def run(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def test_op1(spark, folder):
    sets = {}
    for i, t in enumerate(texts()):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and 100 * both >= 85 * either:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, folder, "op1_near_dedup")} == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_op2(spark, folder):
    data = [(t or "").encode() for t in texts()]
    places = {}
    for i, d in enumerate(data):
        for k in range(len(d) - 399):
            places.setdefault(d[k : k + 400], []).append((i, k))
    gone = [set() for _ in data]
    for where in places.values():
        if len(where) > 1:
            for i, k in where:
                gone[i].update(range(k, k + 400))
    rows = {r["doc_id"]: r for r in run(spark, folder, "op2_repeated_spans")}
    assert sum(map(len, gone)) > 1000
    for i, d in enumerate(data):
        kept = bytes(b for k, b in enumerate(d) if k not in gone[i])
        spans = sum(k in gone[i] and k - 1 not in gone[i] for k in range(len(d)))
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) == (len(d), len(gone[i]), spans, hashlib.sha256(kept).hexdigest())


def test_op3(spark, folder):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    at, want = 0, set()
    for i, t in enumerate(texts()):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want.add((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, folder, "op3_token_records")} == want


def test_op5(spark, folder):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in queries.table(spark, folder, "embeddings").where("vec_id < 300").collect()}
    got = {}
    for r in run(spark, folder, "op5_nearest_vectors"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        scores = {i: float(np.dot(v[q], v[i])) for i in v if i != q}
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 21)) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == pytest.approx(scores[i], rel=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(sorted(scores, key=lambda i: (-scores[i], i))[:20]))
    assert hits >= 0.9 * 20 * len(got)


def test_op6(spark, folder):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts())}
    rows = run(spark, folder, "op6_best_fit_packing")
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == {
        (i, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(np.array(x[k : k + 4096], "<u4").tobytes())) for i, x in ids.items() for k in range(0, len(x), 4096)
    }
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len({r["sequence_id"] for r in rows}) == -(-sum(map(len, ids.values())) // 4096)


def test_op7(spark, folder):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in enumerate(texts()):
        ids = model.encode(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, folder, "op7_sentencepiece")} == want


def test_recall_in_a_full_shard(spark):
    """Default parameters, as many vectors as a shard holds: brute force agrees on at least nine in ten."""
    n, rng = 16_000, np.random.default_rng(9)
    centres = rng.normal(size=(60, 24))
    v = (centres[rng.integers(0, 60, n)] + 0.7 * rng.normal(size=(n, 24))).astype("float32")
    df = spark.createDataFrame(((i, x.tolist()) for i, x in enumerate(v)), "vec_id long, embedding array<float>")
    asked = list(range(0, n, 100))
    got = {}
    for r in vector_graph.nearest(df, F.col("vec_id") % 100 == 0, k=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = v[asked].astype(float) @ v.T.astype(float)
    hits = 0
    for q, row in zip(asked, scores):
        row[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-row, kind="stable")[:20].tolist()))
    assert hits / (20 * len(asked)) >= 0.9


def test_drop_poor_of_odd_tables(spark):
    clashing = ["id", "score", "row", "label", "quality", "prediction"]
    rows = [(1, "a good text of words"), (1, "a good text of words"), (2, None), (3, ""), (None, "w " * 20_000), (4, "bad bad")]
    docs = spark.createDataFrame([(i, t, *(f"{c}{i}" for c in clashing)) for i, t in rows], DOCS + ", " + ", ".join(f"`{c}` string" for c in clashing))
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    kept = quality.drop_poor(docs, labels, usable=F.lit(True))
    assert kept.columns == docs.columns
    out = kept.collect()
    assert all(tuple(r)[2:] == tuple(f"{c}{r['doc_id']}" for c in clashing) for r in out)
    assert sum(r["doc_id"] == 1 for r in out) in (0, 2)  # rows of one identifier and text fare alike
    assert quality.drop_poor(docs, labels, usable=F.lit(True), least=0.0).count() == len(rows)
    assert quality.drop_poor(docs.limit(0), labels, usable=F.lit(True)).count() == 0


def test_pack_ignores_further_columns(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], DOCS)
    for c in ("id", "piece", "start", "length", "sequence_id", "offset", "shard", "ids"):
        docs = docs.withColumn(c, F.lit("x"))
    out = packing.pack_documents(docs, queries.tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=64).collect()
    assert len(out) == 3 and {r["offset"] for r in out} != {None} and sum(r["length"] for r in out) == max(r["offset"] + r["length"] for r in out)
