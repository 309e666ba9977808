"""Registered queries that go through streams, logs and sinks: the tables' rows are written as logs first, then read as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.plans.queries import CALLS, calls, query, table
from lexforge.scratch import new_folder
from lexforge.sources import logs, manifested
from lexforge.streaming import log

#: Milliseconds between events that follow each other, and the time of the first.
_STEP, _BEGIN = 1000, 1_700_000_000_000


def _run(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that its source holds, as a table."""
    spark = stream.sparkSession
    out = new_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, f"{name}-checkpoint"))
    done = writer.outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _logged(rows: DataFrame, name: str) -> tuple[SparkSession, str]:
    """A folder with the rows as JSON lines."""
    folder = new_folder(rows.sparkSession, name)
    rows.write.json(folder)
    return rows.sparkSession, folder


@query(
    f"""WITH e AS (SELECT user_id AS session, event_id // 3 % 40 AS sequence, event_id % 2 = 0 AS starts, {_BEGIN} + event_id * {_STEP} AS ts, event_type AS tool, event_id % 9 AS results FROM events),
p AS (SELECT session, sequence, arg_min(tool, ts) FILTER (starts) AS tool, min(ts) FILTER (starts) AS started_ms, min(ts) FILTER (NOT starts) AS ended_ms, arg_min(results, ts) FILTER (NOT starts) AS results,
  count(*) FILTER (starts) AS starts, count(*) FILTER (NOT starts) AS ends FROM e GROUP BY ALL)
SELECT *, CASE WHEN starts > 1 THEN 'duplicate start' WHEN ends > 1 THEN 'duplicate end' WHEN starts = 0 THEN 'end without start' WHEN ends = 0 THEN 'unfinished' END AS warning FROM p"""
)
def stream_pairs(spark, sf_dir):
    """The call log as a stream, paired by event time; an event far ahead ends the wait for all others."""
    k = F.col("event_id")
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("user_id").cast("string").alias("session_id"), (F.floor(k / 3) % 40).alias("sequence"), F.when(k % 2 == 0, "tool_start").otherwise("tool_end").alias("event"),
        (_BEGIN + k * _STEP).alias("timestamp_ms"), F.col("event_type").alias("tool"), (k % 9).alias("result_count"),
    )
    span = (events.agg(F.max("event_id")).head()[0] or 0) * _STEP
    spark, folder = _logged(rows, "call-log")
    ahead = spark.createDataFrame([("", 0, "tool_start", _BEGIN + 10 * span + 10**9)], "session_id string, sequence long, event string, timestamp_ms long")
    ahead.coalesce(1).write.mode("append").json(folder)
    # all events of a call are awaited, however far apart
    paired = _run(log.pair_stream(log.read_log(spark, folder), timeout_ms=2 * span, settle_ms=2 * span, late_ms=2 * span), "pairs")
    return paired.where("session <> ''").select(F.col("session").cast("long").alias("session"), "sequence", "tool", "started_ms", "ended_ms", "results", "starts", "ends", "warning")


_METER_SQL = f"""WITH {CALLS}, r AS (SELECT *, sum(bytes) OVER (PARTITION BY session ORDER BY sequence) AS total FROM calls), c AS (SELECT *, bool_or(sequence > 40 OR total > 400) OVER (PARTITION BY session ORDER BY sequence) AS closed FROM r)
SELECT session, CAST(sequence AS BIGINT) AS sequence, CAST(sequence AS BIGINT) AS attempt, NOT closed AS forwarded, CAST(CASE WHEN closed THEN 7 ELSE bytes END AS BIGINT) AS delivered, closed AS exhausted FROM c"""


def _call_stream(spark, sf_dir):
    """The numbered calls as a log whose files are read one batch each, in no order of the sequence."""
    rows = calls(spark, sf_dir).select(F.col("session").cast("string").alias("session"), F.col("sequence").cast("long").alias("sequence"), F.col("bytes").cast("long").alias("bytes"), "tool")
    spark, folder = _logged(rows.repartition(4, F.xxhash64("session", "sequence")), "calls")
    return spark.readStream.schema("session string, sequence long, bytes long, tool string").option("maxFilesPerTrigger", 2).json(folder)


@query(_METER_SQL)
def stream_meter(spark, sf_dir):
    metered = _run(log.meter_stream(_call_stream(spark, sf_dir), 40, 400, 7), "metered")
    return metered.withColumn("session", F.col("session").cast("long"))


@query(f"WITH {CALLS}, f AS (SELECT *, min(CASE WHEN tool IN ('click', 'view') THEN sequence END) OVER (PARTITION BY session) AS g FROM calls) SELECT session, CAST(sequence AS BIGINT) AS sequence, tool FROM f WHERE g IS NULL OR sequence < g")
def stream_policy(spark, sf_dir):
    told = _run(log.policy_stream(_call_stream(spark, sf_dir), ["click", "view"]), "violations")
    return told.withColumn("session", F.col("session").cast("long"))


@query(
    """SELECT event_type AS tool, count(*) AS records, count(*) FILTER (event_id % 3 = 0) AS again FROM events GROUP BY 1"""
)
def appended_log(spark, sf_dir):
    """Log records appended in two goes through the manifested sink, and read back."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.lit("tool_end").alias("event"), F.col("user_id").cast("string").alias("session_id"), k.alias("sequence"), F.col("event_type").alias("tool"), (k % 3).alias("result_count"))
    folder = new_folder(spark, "appended")
    logs.append_events(rows.where("result_count > 0"), folder)
    logs.append_events(rows.where("result_count = 0"), folder)
    return logs.appended_events(spark, folder).groupBy("tool").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("result_count") == 0).alias("again"))


@query("SELECT label, count(*) AS vectors, count(DISTINCT embedding) AS distinct_vectors FROM embeddings GROUP BY label")
def replaced_vectors(spark, sf_dir):
    """Vectors replaced in the manifested cache: the later write is what is read."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    folder = new_folder(spark, "vectors")
    manifested.write(rows.where("label = 1"), folder)
    manifested.write(rows, folder, "overwrite")
    return manifested.read(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("embedding").alias("distinct_vectors"))


@query("SELECT event_id % 4 = 1 AS torn, count(*) AS n FROM events GROUP BY 1")
def tolerant_log(spark, sf_dir):
    """A log of which every fourth line is torn: whole records are read, the others are warnings."""
    k = F.col("event_id")
    record = F.to_json(F.struct(F.lit("tool_end").alias("event"), F.col("user_id").cast("string").alias("session_id"), k.alias("sequence"), F.col("event_type").alias("tool")))
    folder = new_folder(spark, "torn")
    table(spark, sf_dir, "events").select(F.when(k % 4 == 1, F.substring(record, F.lit(1), F.char_length(record) - 9)).otherwise(record).alias("value")).write.text(folder)
    events, warnings = logs.read_events(spark, folder)
    both = events.select(F.lit(False).alias("torn")).unionByName(warnings.select(F.lit(True).alias("torn")))
    return both.groupBy("torn").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice / 1000, 1) AS k, l_quantity AS q, l_linenumber % 3 AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE kind WHEN 0 THEN round(k * 1000, 4) WHEN 1 THEN CAST(q AS DOUBLE) ELSE round(round(k / 10, 2) * 1000000, 4) END AS value, CAST(CASE kind WHEN 0 THEN 50.0 WHEN 1 THEN 0.5 ELSE 5000.0 END AS DOUBLE) AS half FROM c"""
)
def printed_figures(spark, sf_dir):
    """Figures as documents print them (12.3 k, 17, 1.23 M), read back with half of their last digit."""
    thousands = F.round(F.col("l_extendedprice") / 1000, 1)
    kind = F.col("l_linenumber") % 3
    cell = F.when(kind == 0, F.concat(F.format_string("%.1f", thousands), F.lit(" k"))).when(kind == 1, F.col("l_quantity").cast("int").cast("string"))
    cell = cell.otherwise(F.concat(F.format_string("%.2f", F.round(thousands / 10, 2)), F.lit(" M")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.figures(cell).alias("f")).select("l_orderkey", "l_linenumber", F.round("f.value", 4).alias("value"), "f.half")
