"""Call logs: pairing, order, coverage and what follows what.

``calls``: session, sequence (order within a session), tool, request (canonical arguments), failed,
results, bytes, latency_ms; start_order and end_order where starts and ends interleave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import method_class
from lexforge.operators.intervals import covered_before, overlapping


def _in_order(by: str = "session") -> object:
    return Window.partitionBy(by).orderBy("sequence")


def pair_events(events: DataFrame) -> DataFrame:
    """One row per (session, sequence): start and end columns, and a warning where they don't pair.

    Of doubled starts or ends the first (by timestamp) counts.
    """
    first = lambda kind, column: F.min_by(column, F.when(F.col("event") == kind, F.col("timestamp_ms")))
    starts, ends = F.count_if(F.col("event") == "tool_start"), F.count_if(F.col("event") == "tool_end")
    out = events.groupBy("session", "sequence").agg(
        first("tool_start", "tool").alias("tool"),
        F.min(F.when(F.col("event") == "tool_start", F.col("timestamp_ms"))).alias("started_ms"),
        F.min(F.when(F.col("event") == "tool_end", F.col("timestamp_ms"))).alias("ended_ms"),
        first("tool_end", "latency_ms").alias("latency_ms"),
        first("tool_end", "result_count").alias("results"),
        first("tool_end", "error").alias("error"),
        starts.alias("starts"),
        ends.alias("ends"),
    )
    warning = (
        F.when(F.col("starts") > 1, "duplicate start")
        .when(F.col("ends") > 1, "duplicate end")
        .when(F.col("starts") == 0, "end without start")
        .when(F.col("ends") == 0, "unfinished")
    )
    return out.withColumn("warning", warning)


def session_summary(calls: DataFrame) -> DataFrame:
    """Counters per session, among them switches of the tool and of its class between neighbours."""
    w = _in_order()
    marked = calls.withColumn("tool_before", F.lag("tool").over(w)).withColumn("class_before", F.lag(method_class(F.col("tool"))).over(w))
    return marked.groupBy("session").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("failed")).alias("completed"),
        F.count_if("failed").alias("errors"),
        F.count_if(F.col("tool") != F.col("tool_before")).alias("switches"),
        F.count_if(method_class(F.col("tool")) != F.col("class_before")).alias("method_switches"),
        F.sum("bytes").alias("bytes"),
        F.sum("latency_ms").alias("latency_ms"),
    )


def tool_switches(calls: DataFrame) -> DataFrame:
    """How often one tool follows another within sessions."""
    before = F.lag("tool").over(_in_order())
    pairs = calls.withColumn("before", before).where("before IS NOT NULL")
    return pairs.groupBy("before", "tool").agg(F.count(F.lit(1)).alias("n"))


def prior_completed(calls: DataFrame) -> DataFrame:
    """Each call with the call completed last before it started (order by end_order): an as-of join.

    Starts and completions are merged into one order per session and the last completion is carried
    forward, so no pairs are made.
    """
    start = calls.select("session", F.col("start_order").alias("at"), F.lit(1).alias("kind"), F.struct(*calls.columns).alias("row"))
    done = calls.where("end_order IS NOT NULL").select(
        "session", F.col("end_order").alias("at"), F.lit(0).alias("kind"), F.struct(*calls.columns).alias("row")
    )
    w = Window.partitionBy("session").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = start.unionByName(done)
    last = F.last(F.when(F.col("kind") == 0, F.col("row")), ignorenulls=True).over(w)
    return both.withColumn("prior", last).where("kind = 1").select("row.*", "prior")


def fallbacks(calls: DataFrame) -> DataFrame:
    """Calls of another class right after one that failed or found nothing, with the reason."""
    found = prior_completed(calls).where("prior IS NOT NULL")
    empty = F.coalesce(F.col("prior.results") == 0, F.lit(False))
    reason = F.when(F.col("prior.failed"), "error").when(empty, "empty")
    return found.where(method_class(F.col("tool")) != method_class(F.col("prior.tool"))).withColumn("reason", reason).where("reason IS NOT NULL")


def duplicate_requests(calls: DataFrame) -> DataFrame:
    """Calls whose request succeeded earlier in the session: session, sequence, first_sequence."""
    ok = F.when(~F.col("failed"), F.col("sequence"))
    w = Window.partitionBy("session", "request").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("first_sequence", F.min(ok).over(w)).where("first_sequence IS NOT NULL").select("session", "sequence", "first_sequence")


def first_tool(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session").agg(F.min_by("tool", "sequence").alias("first_tool"))


def redundant_reads(reads: DataFrame) -> DataFrame:
    """Reads (session, sequence, path, start, end; inclusive) with whether earlier reads cover them all.

    A range costs the nodes it is cut into, some two per doubling of its length; no lines are exploded.
    """
    found = covered_before(reads.select("session", "sequence", "path", "start", "end"), ["session", "path"], "sequence")
    return found.groupBy("session", "sequence", "path", "start", "end").agg(F.bool_and("covered").alias("covered"))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of inclusive ranges (start, end) with equal keys that share a position."""
    return overlapping(left, right.select(*keys, "start", "end"), keys)


def token_turns(records: DataFrame, trial: str = "trial", order: str = "pos", size: Column | None = None) -> DataFrame:
    """Context a trial carries: bytes / 4 of each record times the records that follow it and itself."""
    size = F.octet_length("body") if size is None else size
    w = Window.partitionBy(trial)
    place = F.row_number().over(w.orderBy(order)) - 1
    marked = records.select(trial, size.alias("bytes"), place.alias("at"), F.count(F.lit(1)).over(w).alias("n"))
    return marked.groupBy(trial).agg(F.sum(F.col("bytes") / 4 * (F.col("n") - F.col("at"))).alias("token_turns"))


def first_hit(records: DataFrame, hit: Column, trial: str = "trial", order: str = "pos") -> DataFrame:
    """Per trial: position of the first record with evidence, and records and bytes after it."""
    w = Window.partitionBy(trial)
    marked = records.withColumn("__first", F.min(F.when(hit, F.col(order))).over(w))
    after = F.col(order) > F.col("__first")
    return marked.groupBy(trial).agg(
        F.max("__first").alias("first_pos"),
        F.count_if(after).alias("records_after"),
        F.coalesce(F.sum(F.when(after, F.octet_length("body"))), F.lit(0)).alias("bytes_after"),
    )


def visible(text: Column, path: Column, leaf: Column) -> Column:
    return F.contains(text, path) & F.contains(text, leaf)


def page_labels(calls: DataFrame) -> DataFrame:
    """Full pages (results >= limit) with ``label``: whether any call of the session asks the same tool for the same query at an offset.

    ``calls``: session, tool, query, results, limit, offset.
    """
    asked = calls.where("offset <> 0").select("session", "tool", "query").distinct()
    full = calls.where("results >= limit").alias("c")
    same = (F.col("c.session") == F.col("a.session")) & (F.col("c.tool") == F.col("a.tool")) & F.col("c.query").eqNullSafe(F.col("a.query"))
    followed = full.join(asked.alias("a"), same, "left").select("c.*", F.col("a.session").isNotNull().alias("followed"))
    return followed.withColumn("label", F.when(F.col("followed"), "page_followed").otherwise("page_truncated_not_followed")).drop("followed")


def budget_meter(calls: DataFrame, most_calls: int, most_bytes: int, failure_bytes: int = 0) -> DataFrame:
    """A shared budget per session as running sums: forwarded, delivered bytes and the exhausted latch.

    Attempts count before the check; a response over the byte budget is replaced by a failure, whose
    bytes are charged, and closes the session for all later calls.
    """
    w = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    running = calls.withColumn("attempt", F.row_number().over(_in_order())).withColumn("total", F.sum("bytes").over(w))
    over = (F.col("attempt") > most_calls) | (F.col("total") > most_bytes)
    latched = running.withColumn("over", over.cast("int")).withColumn("closed", F.max("over").over(w) == 1)
    return latched.select(
        "session",
        "sequence",
        "attempt",
        (F.col("attempt") <= most_calls).alias("counted"),
        (~F.col("closed")).alias("forwarded"),
        F.when(F.col("closed"), F.lit(failure_bytes)).otherwise(F.col("bytes")).alias("delivered"),
        F.col("closed").alias("exhausted"),
    )


def first_tool_policy(calls: DataFrame, allowed: list[str]) -> DataFrame:
    """Sessions that start with another tool than the allowed ones, and their calls before an allowed one."""
    good = F.col("tool").isin(allowed)
    first_good = F.min(F.when(good, F.col("sequence"))).over(Window.partitionBy("session"))
    marked = calls.withColumn("first_good", first_good)
    before = F.col("first_good").isNull() | (F.col("sequence") < F.col("first_good"))
    return marked.groupBy("session").agg(F.count_if(before).alias("violations"), F.min_by("tool", "sequence").alias("first_tool"))


def location_ranges(events: DataFrame) -> DataFrame:
    """session, sequence, path, start, end of what each call showed; a location without an end is one line."""
    e = events.select("session", "sequence", F.explode("locations").alias("l")).where("l.path IS NOT NULL AND l.line IS NOT NULL AND l.line >= 1")
    end = F.greatest(F.coalesce("l.end_line", "l.line"), F.col("l.line"))
    return e.select("session", "sequence", F.col("l.path").alias("path"), F.col("l.line").alias("start"), end.alias("end"))


def follow_ups(calls: DataFrame, ranges: DataFrame) -> DataFrame:
    """Later reads of a session that overlap what an earlier call showed: both sequences and the path."""
    shown = ranges.select("session", "path", "start", "end", F.col("sequence").alias("shown_by"))
    both = overlapping(calls.select("session", "path", "start", "end", "sequence"), shown, ["session", "path"])
    return both.where(F.col("shown_by") < F.col("sequence")).select("session", "path", "shown_by", "sequence")
