"""Call logs, run folders and client streams, read with fixed schemas."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = (
    "event string, schema_version int, session_id string, run_id string, profile string, sequence long, request_id string, tool string, "
    "arguments string, timestamp_ms long, latency_ms double, result_count long, response_bytes long, retrieval_bytes long, error string, "
    "coverage string, backend string, index_note string, "
    "locations array<struct<path:string,line:int,end_line:int,resolution:string>>"
)
RUNS = (
    "task_id string, system string, repetition int, status string, answer string, "
    "usage struct<input_tokens:long,output_tokens:long,reasoning_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long,cost_usd:double>, "
    "client_error string, unexpected_tools array<string>, mcp_failures array<string>, payload_matches boolean, format_correct boolean, "
    "correct boolean, grading string, resolved_credit double, resolved_correct boolean, wall_time_ms double, repository_unchanged boolean, "
    "attempted_calls int, forwarded_calls int, retrieval_bytes long, delivered_bytes long, tool_latency_ms double, budget_exhausted boolean, "
    "tool_sequence array<string>, upstream_calls map<string,int>"
)
CALLS = "trial string, pos int, name string, body string, request string, read string, latency_ms double"


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, warnings): lines that aren't whole JSON objects are warnings, not failures."""
    raw = spark.read.schema(EVENTS + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"))
    bad = raw.where(F.col("_corrupt").isNotNull() | F.col("event").isNull())
    return raw.where(F.col("_corrupt").isNull() & F.col("event").isNotNull()).drop("_corrupt"), bad.select("file", F.col("_corrupt").alias("line"))


def append_events(events: DataFrame, path: str) -> None:
    """Append log records as JSON lines: all of them, or none where a task fails."""
    from lexforge.sources import manifested

    manifested.write(events.select(F.to_json(F.struct("*")).alias("value")), path, "append", layout="text")


def appended_events(spark: SparkSession, path: str) -> DataFrame:
    """The records appended so far."""
    from lexforge.sources import manifested

    lines = manifested.read(spark, path, empty="value string")
    return lines.select(F.from_json("value", EVENTS).alias("e")).select("e.*")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run.json below a folder, with its trial and attempt from the path (attempt 0 without one)."""
    raw = spark.read.schema(RUNS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run.json").json(folder)
    file = F.col("_metadata.file_path")
    return raw.select(
        "*",
        F.regexp_extract(file, r"(trial-[^/]+)", 1).alias("trial"),
        F.coalesce(F.nullif(F.regexp_extract(file, r"attempt-0*([0-9]+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("attempt"),
    )


def usage_columns(runs: DataFrame) -> DataFrame:
    return runs.select("*", "usage.*").drop("usage")


_CODEX = "type string, item struct<type:string,tool:string,command:string,arguments:string,aggregated_output:string,text:string>, usage struct<input_tokens:long,output_tokens:long,cached_input_tokens:long>"
_OPENCODE = "type string, part struct<type:string,tool:string,text:string,state:struct<input:string,output:string,time:struct<start:long,end:long>>,tokens:struct<input:long,output:long,reasoning:long,cache:struct<read:long,write:long>>,cost:double>"
_CLAUDE = (
    "type string, message struct<id:string,content:array<struct<type:string,id:string,name:string,input:string,tool_use_id:string,content:string,text:string>>,"
    "usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>>"
)


def stream_calls(lines: DataFrame, client: str) -> DataFrame:
    """Tool calls of a client's event stream (trial, pos, value: one JSON line) in one schema (:data:`CALLS`)."""
    none = F.lit(None)
    if client == "codex":
        e = lines.select("trial", "pos", F.from_json("value", _CODEX).alias("e")).where("e.type = 'item.completed' AND e.item.type IN ('command_execution', 'mcp_tool_call')")
        return e.select(
            "trial", "pos", F.coalesce("e.item.tool", F.lit("shell")).alias("name"), F.col("e.item.aggregated_output").alias("body"),
            F.coalesce("e.item.arguments", "e.item.command").alias("request"), none.cast("string").alias("read"), none.cast("double").alias("latency_ms"),
        )
    if client == "opencode":
        e = lines.select("trial", "pos", F.from_json("value", _OPENCODE).alias("e")).where("e.part.type = 'tool'")
        took = (F.col("e.part.state.time.end") - F.col("e.part.state.time.start")).cast("double")
        return e.select(
            "trial", "pos", F.col("e.part.tool").alias("name"), F.col("e.part.state.output").alias("body"), F.col("e.part.state.input").alias("request"),
            F.get_json_object("e.part.state.input", "$.filePath").alias("read"), took.alias("latency_ms"),
        )
    if client == "claude":
        parts = lines.select("trial", "pos", F.from_json("value", _CLAUDE).alias("e")).select("trial", "pos", F.posexplode("e.message.content").alias("at", "c"))
        use = parts.where("c.type = 'tool_use'").select("trial", "pos", "at", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.input").alias("request"))
        result = parts.where("c.type = 'tool_result'").select("trial", F.col("c.tool_use_id").alias("id"), F.col("c.content").alias("body")).dropDuplicates(["trial", "id"])
        return use.join(result, ["trial", "id"], "left").select(
            "trial", "pos", "name", "body", "request", F.get_json_object("request", "$.file_path").alias("read"), none.cast("double").alias("latency_ms")
        )
    raise ValueError("client is 'codex', 'opencode' or 'claude'")


def stream_steps(lines: DataFrame, client: str) -> DataFrame:
    """Model steps (trial, pos, input, output, reasoning, cache_read, cost).

    Claude's input is fresh, cache-created and cache-read tokens together, and a message that is told
    in several lines counts once; the others report their whole input themselves.
    """
    zero, no_cost = F.lit(0).cast("long"), F.lit(None).cast("double")
    if client == "codex":
        e = lines.select("trial", "pos", F.from_json("value", _CODEX).alias("e")).where("e.usage IS NOT NULL")
        return e.select("trial", "pos", F.col("e.usage.input_tokens").alias("input"), F.col("e.usage.output_tokens").alias("output"), zero.alias("reasoning"), F.coalesce("e.usage.cached_input_tokens", zero).alias("cache_read"), no_cost.alias("cost"))
    if client == "opencode":
        e = lines.select("trial", "pos", F.from_json("value", _OPENCODE).alias("e")).where("e.part.tokens IS NOT NULL")
        t = "e.part.tokens."
        return e.select("trial", "pos", F.col(t + "input").alias("input"), F.col(t + "output").alias("output"), F.coalesce(t + "reasoning", zero).alias("reasoning"), F.coalesce(t + "cache.read", zero).alias("cache_read"), F.col("e.part.cost").alias("cost"))
    if client == "claude":
        e = lines.select("trial", "pos", F.from_json("value", _CLAUDE).alias("e")).where("e.message.usage IS NOT NULL")
        w = Window.partitionBy("trial", "e.message.id").orderBy("pos")
        e = e.withColumn("place", F.row_number().over(w)).where("place = 1")
        u = "e.message.usage."
        total = F.coalesce(u + "input_tokens", zero) + F.coalesce(u + "cache_creation_input_tokens", zero) + F.coalesce(u + "cache_read_input_tokens", zero)
        return e.select("trial", "pos", total.alias("input"), F.col(u + "output_tokens").alias("output"), zero.alias("reasoning"), F.coalesce(u + "cache_read_input_tokens", zero).alias("cache_read"), no_cost.alias("cost"))
    raise ValueError("client is 'codex', 'opencode' or 'claude'")


def stream_summary(lines: DataFrame, client: str, allowed: list[str]) -> DataFrame:
    """Per trial: calls, total usage and the tools that aren't allowed."""
    c = stream_calls(lines, client).groupBy("trial").agg(F.count(F.lit(1)).alias("tool_calls"), F.array_sort(F.collect_set(F.when(~F.col("name").isin(allowed), F.col("name")))).alias("unexpected"))
    s = stream_steps(lines, client).groupBy("trial").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cache_read").alias("cache_read"))
    return c.join(s, "trial", "full")


def rendered_rows(text: str) -> list[dict]:
    """Rows of a rendered table (``results[N] col<TAB>col``, then one line per row) as dictionaries."""
    out: list[dict] = []
    columns: list[str] = []
    left = 0
    for line in text.split("\n"):
        if left and columns:
            cells = [c.replace("\\t", "\t").replace("\\n", "\n").replace("\\\\", "\\") for c in line.split("\t")]
            out.append({k: v for k, v in zip(columns, cells) if v != ""})
            left -= 1
        elif line.startswith("results[") and "]" in line:
            count, _, head = line[8:].partition("]")
            left, columns = int(count), head.strip(" :").split("\t")
    return out


def write_log_line(path: str, record: dict) -> None:
    """One record of a local log; the file is readable by its owner alone."""
    import os

    handle = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o600)
    with os.fdopen(handle, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False, separators=(",", ":")) + "\n")


def read_plan(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
