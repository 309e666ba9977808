"""The streams against the batch operators, over several micro-batches and restarts."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import sessions
from lexforge.streaming import log

MINUTE, BEGIN = 60_000, 1_700_000_000_000
CALLS = "session string, sequence long, bytes long, tool string"
_names = itertools.count()


class Stream:
    """A folder that grows by one file a batch, and a query over it that is stopped and started from its checkpoint."""

    def __init__(self, spark, tmp_path, make, schema=None):
        self.spark, self.folder, self.make, self.schema = spark, tmp_path / "in", make, schema
        self.checkpoint, self.out = str(tmp_path / "checkpoint"), str(tmp_path / "out")
        self.folder.mkdir()
        self.files = 0

    def add(self, rows):
        path = self.folder / f"{self.files:04}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_000_000 + self.files, 1_000_000 + self.files))
        self.files += 1

    def run(self):
        source = log.read_log(self.spark, str(self.folder), 1) if self.schema is None else self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder))
        writer = self.make(source).writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint)
        query = writer.outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        if query.exception():
            raise query.exception()
        return self.spark.read.parquet(self.out).collect()


@pytest.fixture(autouse=True)
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def event(sequence, kind, at, session="s", **more):
    return {"session_id": session, "sequence": sequence, "event": f"tool_{kind}", "tool": "search", "timestamp_ms": BEGIN + at, **more}


def test_pairing_by_event_time(spark, tmp_path):
    stream = Stream(spark, tmp_path, lambda events: log.pair_stream(events, timeout_ms=10 * MINUTE, settle_ms=MINUTE, late_ms=2 * MINUTE))
    batches = [
        [event(1, "start", 0), event(2, "end", 1000, latency_ms=3.0, result_count=1), event(3, "start", 5000)],
        [event(2, "start", 500), event(1, "end", 2000, result_count=4, latency_ms=9.5), event(4, "start", 6000), event(4, "start", 7000)],  # 2: its end came first
        [event(5, "end", 90_000, error="lost"), event(4, "end", 8000), event(4, "end", 95_000)],  # doubled at both ends
    ]
    for rows in batches[:2]:
        stream.add(rows)
    assert stream.run() == []  # nothing is over yet
    stream.add(batches[2])
    stream.run()
    later = [event(9, "start", 40 * MINUTE), event(9, "end", 40 * MINUTE + 10)]
    stream.add(later)
    got = stream.run()  # the third start from the checkpoint; the watermark passes all others
    every = spark.read.schema(log.EVENTS).json([str(p) for p in stream.folder.iterdir()]).withColumnRenamed("session_id", "session")
    want = {tuple(r) for r in sessions.pair_events(every).where("sequence < 9").select("session", "sequence", "tool", "started_ms", "ended_ms", "latency_ms", "results", "error", "warning").collect()}
    columns = ["session", "sequence", "tool", "started_ms", "ended_ms", "latency_ms", "results", "error", "warning"]
    assert {tuple(r[c] for c in columns) for r in got} == want
    assert {r["sequence"]: r["warning"] for r in got} == {1: None, 2: None, 3: "unfinished", 4: "duplicate start", 5: "end without start"}
    # behind the watermark: dropped, and nothing is told twice
    stream.add([event(3, "end", 6000), event(10, "start", 80 * MINUTE)])
    again = stream.run()
    assert sorted(r["sequence"] for r in again) == [1, 2, 3, 4, 5, 9]


def meter_rows(seed, sessions_=3, n=14):
    rnd = random.Random(seed)
    rows = [{"session": f"s{k}", "sequence": i, "bytes": rnd.randint(0, 60), "tool": rnd.choice(["read", "read", "search"])} for k in range(sessions_) for i in range(1, n + 1)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_meter_and_policy_whatever_the_batches(spark, tmp_path, seed):
    rows, rnd = meter_rows(seed), random.Random(seed)
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], CALLS)
    (tmp_path / "m").mkdir()
    (tmp_path / "p").mkdir()
    meter = Stream(spark, tmp_path / "m", lambda calls: log.meter_stream(calls, 10, 300, 7), CALLS)
    policy = Stream(spark, tmp_path / "p", lambda calls: log.policy_stream(calls, ["search"]), CALLS)
    cuts = sorted(rnd.sample(range(1, len(rows)), 3))
    for part, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        meter.add(rows[lo:hi])
        policy.add(rows[lo:hi])
        if part == 1:  # both are stopped once, with rows held
            meter.run()
    got = {(r["session"], r["sequence"], r["attempt"], r["forwarded"], r["delivered"], r["exhausted"]) for r in meter.run()}
    assert got == {tuple(r) for r in sessions.budget_meter(batch, 10, 300, 7).select("session", "sequence", "attempt", "forwarded", "delivered", "exhausted").collect()}
    told = {}
    for r in policy.run():
        told[r["session"]] = told.get(r["session"], 0) + 1
    want = {r["session"]: r["violations"] for r in sessions.first_tool_policy(batch, ["search"]).collect()}
    assert {s: told.get(s, 0) for s in want} == want


def test_a_gap_ends_when_nothing_older_can_follow(spark, tmp_path):
    row = lambda s, at, size=10: {"session": "s", "sequence": s, "bytes": size, "timestamp_ms": BEGIN + at}
    stream = Stream(spark, tmp_path, lambda calls: log.meter_stream(calls, 99, 35, late_ms=MINUTE), "session string, sequence long, bytes long, timestamp_ms long")
    stream.add([row(1, 1000), row(3, 3000), row(4, 4000)])
    assert [r["sequence"] for r in stream.run()] == [1]  # 2 is missing
    stream.add([row(2, 2000), row(2, 2000)])  # late, and doubled
    assert sorted((r["sequence"], r["forwarded"]) for r in stream.run()) == [(1, True), (2, True), (3, True), (4, False)]
    stream.add([row(7, 7000)])  # 5 and 6 never come
    stream.add([{"session": "other", "sequence": 1, "bytes": 1, "timestamp_ms": BEGIN + 10 * MINUTE}])
    assert sorted((r["session"], r["sequence"], r["attempt"]) for r in stream.run()) == [("other", 1, 1), ("s", 1, 1), ("s", 2, 2), ("s", 3, 3), ("s", 4, 4), ("s", 7, 5)]


def test_batch_meter_of_the_same_log(spark):
    df = spark.createDataFrame([tuple(r.values()) for r in meter_rows(3, 1, 5)], CALLS)
    assert sessions.budget_meter(df, 2, 10**6).where(F.col("forwarded")).count() == 2
