"""Exact and near deduplication, repeated spans, components: against brute force."""

import hashlib
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import components, exact_dedup, near_dedup, repeated_spans

DOCS = "doc_id long, text string, digest int, id string, memtable string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], DOCS)


def lower(t):
    return (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


EDGE = [(1, None), (2, ""), (3, "Abc É"), (4, "aBC É"), (5, "abc é"), (6, "z" * 200_000), (7, "Z" * 200_000), (None, "abc É"), (8, "only"), (8, "only"), (9, " ")]


@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, digest_bytes, keep):
    rows = EDGE + [(100 + i, random.Random(i).choice(["p", "q", "r"]) * (1 + i % 9)) for i in range(200)]
    got = exact_dedup.exact_groups(frame(spark, rows), keep=keep, memtable_rows=16, digest_bytes=digest_bytes).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        best = (max if keep == "largest" else min)(ids)
        want.append((i, best, len(groups[lower(t)]), i == best, hashlib.sha256(lower(t).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_drop_exact_keeps_columns(spark):
    df = frame(spark, [(1, "A"), (2, "a"), (3, "b")])
    kept = exact_dedup.drop_exact(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (5, 5)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0d]+", lower(text))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_brute(rows, k, percent):
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {rows[i][0]: (len(sets[i]), rows[top(i)][0], top(i) == i) for i in range(len(rows))}


def variants(rng, base, n, share):
    out = []
    for _ in range(n):
        words = list(base)
        for i in rng.sample(range(len(words)), int(len(words) * rng.random() * share)):
            words[i] = "w" + str(rng.randrange(10**9))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.85), (5, 0.8)])
def test_near_groups(spark, k, threshold):
    rng = random.Random(k)
    texts = ["", None, "one", "ONE", "one two", "a b c", "A  b\tc", "a b c d"]
    for size, n, share in ((40, 60, 0.12), (120, 120, 0.1), (7, 10, 0.3), (400, 20, 0.05)):
        texts += variants(rng, ["t" + str(rng.randrange(10**6)) for _ in range(size)], n, share)
    rows = sorted(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(frame(spark, rows), words=k, threshold=threshold).collect()}
    assert got == near_brute(rows, k, round(100 * threshold))


def test_blocks_agree_with_one_block(spark, monkeypatch):
    rng = random.Random(9)
    rows = list(enumerate(variants(rng, ["t" + str(rng.randrange(10**6)) for _ in range(150)], 150, 0.15)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(frame(spark, rows), words=3, threshold=0.85).collect()}
    assert got == near_brute(rows, 3, 85)


def test_near_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "x y z"), (5, "a b c d e f"), (5, "q r s t"), (6, "q r s t"), (6, "q r s t")]
    got = sorted((((r.doc_id or -1), r.component_id, r.kept) for r in near_dedup.near_groups(frame(spark, rows), words=3).collect()), key=str)
    assert [g for g in got if g[0] == 6] == [(6, 5, False)] * 2 and (-1, 5, False) in got and (-1, None, True) in got
    assert near_dedup.near_groups(frame(spark, [])).count() == 0
    assert sorted(r.doc_id for r in near_dedup.drop_near(frame(spark, rows[2:]), words=3).collect()) == [5, 5]


def test_estimate_and_registers():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2600], rng.integers(0, 1 << 63, 400, dtype=np.uint64)])
    found = near_dedup.estimate(near_dedup.sketch(np.unique(a)), near_dedup.sketch(np.unique(b)))
    assert abs(found - 2600 / 3400) < 0.16
    small = near_dedup.sketch(np.array([12345], np.uint64))
    assert len(set(small.tolist())) == 1


def spans_brute(rows, length):
    data = {i: (t or "").encode() for i, t in rows}
    places = {}
    for i, b in data.items():
        for p in range(len(b) - length + 1):
            places.setdefault(b[p : p + length], []).append((i, p))
    out = {}
    cover = {i: np.zeros(len(b) + 1, bool) for i, b in data.items()}
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                cover[i][p : p + length] = True
    for i, b in data.items():
        c = cover[i][:-1]
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        out[i] = (len(b), int(c.sum()), int((np.diff(np.concatenate(([0], c.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def span_texts(rng):
    piece = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [piece(rng.randrange(10, 120)) for _ in range(12)]
    out = [None, "", "short", "ab" * 100, "a" * 90, "a" * 33]
    for _ in range(60):
        out.append("".join(rng.choice(shared) if rng.random() < 0.4 else piece(rng.randrange(5, 60)) for _ in range(rng.randrange(1, 8))))
    return out + [out[20], out[20][3:], out[21][:-5], "x" + out[22]]


@pytest.mark.parametrize(("length", "most"), [(20, 32768), (33, 32768), (64, 32768), (33, 1)])
def test_repeated_spans(spark, monkeypatch, length, most):
    monkeypatch.setattr(repeated_spans, "MOST_HULLS", most)
    rows = list(enumerate(span_texts(random.Random(length))))
    got = {r.doc_id: tuple(r)[1:5] for r in repeated_spans.removal_digests(frame(spark, rows), length).collect()}
    assert got == spans_brute(rows, length)


def test_repeats_within_a_text_and_segments(spark, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(1, long + long[1000:1100] + "z"), (2, long[300:420]), (3, "q" * 50)]
    want = spans_brute(rows, 40)
    pieces = {t: np.concatenate(repeated_spans.cut_pieces([t.encode()], 40)[4:]).sum() for _, t in rows}
    assert pieces[rows[0][1]] == len(rows[0][1]) - 39  # each start is in one piece
    got = {r.doc_id: tuple(r)[1:5] for r in repeated_spans.removal_digests(frame(spark, rows), 40).collect()}
    assert got == want
    # texts cut into overlapping segments give the same starts
    monkeypatch.setattr(repeated_spans, "_SEGMENT", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([rows[0][1].encode()])], ["doc", "text"])
    starts = sorted(s for b in repeated_spans._pieces(iter([batch]), 40) for a, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist()) for s in range(a, a + n))
    assert starts == list(range(len(rows[0][1]) - 39))


def test_drop_repeats(spark):
    shared = "this passage of words stands in both of the texts é"
    df = frame(spark, [(1, "aé " + shared + " tail one"), (2, "b " + shared + " other"), (3, None), (4, "clean")])
    kept = repeated_spans.drop_repeats(df, 20)
    got = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == df.columns and got[3] is None and got[4] == "clean" and shared not in got[1] and got[1].endswith("tail one")
    assert repeated_spans.removal_digests(frame(spark, []), 20).count() == 0
    twice = frame(spark, [(1, shared), (1, shared)])  # the same row twice: two places of one string
    assert [r.n_removed for r in repeated_spans.removal_digests(twice, 20).collect()] == [len(shared.encode())] * 2


def test_repeated_spans_with_passages(spark):
    """The registered lengths: 400 bytes are removed, passages of 200 counted."""
    rng = random.Random(11)
    piece = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared = [piece(n) for n in (30, 45, 60, 75, 90, 150)]
    texts = [" ".join(rng.choice(shared) if rng.random() < 0.3 else piece(rng.randrange(20, 120)) for _ in range(6)) for _ in range(60)]
    texts += [None, "", texts[0], texts[1][37:], shared[3], "x" * 900, texts[2] + texts[2]]
    rows = list(enumerate(texts))
    found = repeated_spans.removal_digests(frame(spark, rows), 400, passage=200).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in found} == spans_brute(rows, 400)
    assert {r.doc_id: (r.passage_bytes, r.n_passages) for r in found} == {i: v[1:3] for i, v in spans_brute(rows, 200).items()}
    again = rows[:8] + [(0, texts[3]), (0, texts[3]), (None, texts[4])]  # repeated identifiers, and none
    want = spans_brute([(k, t) for k, (_, t) in enumerate(again)], 400)
    got = [(r.doc_id, *tuple(r)[1:5]) for r in repeated_spans.removal_digests(frame(spark, again), 400, passage=200).collect()]
    assert sorted(got, key=str) == sorted(((i, *want[k]) for k, (i, _) in enumerate(again)), key=str)


CLASHING = ["id", "sha", "row", "doc", "ranges", "__note", "__page", "__at", "__ranges", "__doc", "__kept", "__kept_id", "kept", "score", "digest", "run", "node"]


@pytest.mark.parametrize("operator", [exact_dedup.drop_exact, near_dedup.drop_near, repeated_spans.drop_repeats])
def test_clashing_names(spark, operator):
    shared = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "one " + shared), (2, "one " + shared), (3, "clean"), (4, None)]
    df = spark.createDataFrame([(i, t, *(f"{c}{i}" for c in CLASHING)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    kept = operator(df)
    assert kept.columns == df.columns
    for r in kept.collect():
        assert tuple(r)[2:] == tuple(f"{c}{r.doc_id}" for c in CLASHING)


def test_drop_exact_repeated_ids(spark):
    rows = [(1, "x"), (1, "y"), (0, "y"), (2, None), (3, "")]
    kept = exact_dedup.drop_exact(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(0, "y"), (1, "x"), (2, "")]


def test_runs_levels_and_filters(spark, monkeypatch):
    """Runs are sorted file sets; only contested entries are merged; levels end in one run."""
    import glob

    import pyarrow.parquet as pq

    written = []

    def spy(df, name, *args, **kw):
        out = materialise(df, name, *args, **kw)
        written.append((name, out._lexforge_path.removeprefix("file://"), out.count()))
        return out

    materialise = exact_dedup.materialise
    monkeypatch.setattr(exact_dedup, "materialise", spy)
    rows = [(i, f"text {i if i % 10 else 0}") for i in range(2000)]
    got = exact_dedup.exact_groups(frame(spark, rows), memtable_rows=100, fan_in=4).collect()
    assert sum(r.kept for r in got) == 1801 and {r.group_size for r in got} == {1, 200}
    by = {}
    for name, path, n in written:
        by.setdefault(name, []).append((path, n))
    (runs, _), *rest = by["dedup-run"]
    assert not rest and len(glob.glob(runs + "/run=*")) == 20
    for f in glob.glob(runs + "/run=*/*.parquet"):
        digests = pq.ParquetFile(f).read(["digest"]).column(0).to_pylist()
        assert digests == sorted(digests)
    levels = [n for _, n in by["dedup-level"]]
    assert len(levels) == 3 and levels[0] < 200 and levels[-1] < 40  # of 1801 digests; 20 runs, 5, 2, 1
    assert by["dedup-several"][0][1] == 1 and by["dedup-failed"][0][1] == 0
