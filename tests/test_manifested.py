"""The manifested sink: whole tables whatever fails, and whoever else writes."""

import os
import stat

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexforge.sources import logs, manifested
from lexforge.sources.manifested import _Writer, _Written

ONE = StructType([StructField("value", StringType())])


def ids(spark, folder):
    return sorted(r["id"] for r in manifested.read(spark, folder).collect())


def test_round_trip_append_and_replace(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(10, numPartitions=3).select("id", F.array(F.col("id") * 1.5, F.lit(None)).alias("v"), F.when(F.col("id") > 4, "ü").alias("s"))
    manifested.write(rows, folder)
    assert sorted(map(tuple, manifested.read(spark, folder).collect())) == sorted(map(tuple, rows.collect()))
    manifested.write(rows.where("id < 2"), folder)
    assert ids(spark, folder) == [0, 0, 1, 1, *range(2, 10)]
    manifested.write(rows.where("id = 7"), folder, "overwrite")
    assert ids(spark, folder) == [7] and manifested.generations(folder) == [1, 2, 3]
    assert spark.read.format("manifested").option("generation", 2).load(folder).count() == 12  # earlier states stay readable
    manifested.write(rows.where("id > 99"), folder, "overwrite")
    assert ids(spark, folder) == []
    assert {stat.S_IMODE(os.stat(os.path.join(top, n)).st_mode) for top, _, names in os.walk(folder) for n in names} == {0o600}


def test_a_failed_task_leaves_the_old_state(spark, tmp_path):
    folder = str(tmp_path / "t")
    manifested.write(spark.range(5), folder)
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("torn")).cast("long")).otherwise(F.col("id")).alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="torn"):
            manifested.write(broken, folder, mode)
        assert ids(spark, folder) == [0, 1, 2, 3, 4] and manifested.generations(folder) == [1]
    named = {f["file"].split("/")[1] for f in manifested.manifest(folder)["files"]}
    left = set(os.listdir(f"{folder}/data")) - named  # what killed tasks had begun; no manifest names it
    assert manifested.vacuum(folder) == []  # a write might still be running
    assert set(manifested.vacuum(folder, older_than_s=0)) == left and ids(spark, folder) == [0, 1, 2, 3, 4]


def test_the_second_of_two_writers(tmp_path):
    options = {"path": str(tmp_path / "t"), "layout": "text"}
    (tmp_path / "t" / "data").mkdir(parents=True)
    for n in "abcd":
        (tmp_path / "t" / "data" / n).write_text(n)
    first, second, third = (_Writer(options, ONE, overwrite) for overwrite in (True, True, False))
    first.commit([_Written("data/a", 1), None])
    with pytest.raises(RuntimeError, match="another writer"):
        second.commit([_Written("data/b", 1)])
    assert [f["file"] for f in manifested.manifest(options["path"])["files"]] == ["data/a"]
    assert not (tmp_path / "t" / "data" / "b").exists()  # it took its files back
    third.commit([_Written("data/c", 1)])  # an append goes on from the first one's state
    assert [f["file"] for f in manifested.manifest(options["path"])["files"]] == ["data/a", "data/c"]
    with pytest.raises(ValueError, match="other columns"):
        _Writer({"path": options["path"]}, StructType([StructField("n", LongType())]), False).commit([_Written("data/d", 1)])
    assert manifested.generations(options["path"]) == [1, 2]


def test_log_records_are_appended_whole(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert logs.appended_events(spark, folder).count() == 0
    events = spark.createDataFrame([("tool_start", "s", 1, "a\nb"), ("tool_end", "s", 1, None)], "event string, session_id string, sequence long, tool string")
    logs.append_events(events, folder)
    logs.append_events(events.where("event = 'tool_end'"), folder)
    assert sorted((r["event"], r["sequence"], r["tool"]) for r in logs.appended_events(spark, folder).collect()) == [("tool_end", 1, None)] * 2 + [("tool_start", 1, "a\nb")]
    lines = [x for f in manifested.manifest(folder)["files"] for x in open(f"{folder}/{f['file']}").read().splitlines()]
    assert len(lines) == 3
