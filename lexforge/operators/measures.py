"""Distributions, matched comparisons, strata, ablations and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.grading import strict_grade
from lexforge.operators.intervals import overlapping
from lexforge.operators.selection import exact_medians, with_medians


def distribution(rows: DataFrame, by: list[str], value: Column | str, total: bool = False) -> DataFrame:
    """count, mean, median, min and max (and sum) of the values that aren't null, per group; the median is exact at any size."""
    held = rows.select(*by, (F.col(value) if isinstance(value, str) else value).alias("value"))
    stats = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")]
    out = held.groupBy(*by).agg(*stats, *([F.sum("value").alias("sum")] if total else []))
    return with_medians(out, held, by, {"median": "value"})


def rounded_stat(rows: DataFrame, by: list[str], value: Column | str) -> DataFrame:
    """Median and mean, half to even at one decimal, and the count, per group."""
    found = distribution(rows, by, value)
    return found.select(*by, F.bround("median", 1).alias("median"), F.bround("mean", 1).alias("mean"), "n")


def upper_median(rows: DataFrame, by: list[str], value: Column | str) -> DataFrame:
    """(by, median): the value in the middle of each group, the upper one of two."""
    return exact_medians(rows, by, value).select(*by, F.col("upper").alias("median"))


def eligible(runs: DataFrame) -> Column:
    """Completed, nothing unexpected, repository unchanged, payload as planned."""
    return (
        (F.col("status") == "completed")
        & (F.size(F.coalesce("unexpected_tools", F.array())) == 0)
        & F.coalesce("payload_matches", F.lit(True))
        & F.coalesce("repository_unchanged", F.lit(True))
    )


def first_attempts(runs: DataFrame, by: list[str], attempt: str = "attempt") -> DataFrame:
    """The first attempt of each trial; a retry never replaces it."""
    least = runs.groupBy(*by).agg(F.min(attempt).alias(attempt))
    return runs.join(least, [*by, attempt], "left_semi")


def pair_differences(runs: DataFrame, keys: list[str], arm: str, pairs: list[tuple[str, str]], value: str, sign: str = "saved") -> DataFrame:
    """Matched rows of two arms by ``keys``: baseline, variant and their difference.

    ``sign="saved"`` is baseline - variant, ``"added"`` is variant - baseline; a column ``eligible``,
    where present, makes the difference null unless both rows are.  One pass: arms become columns.
    """
    arms = sorted({a for p in pairs for a in p})
    ok = F.col("eligible") if "eligible" in runs.columns else F.lit(True)
    wide = runs.where(F.col(arm).isin(arms)).groupBy(*keys).agg(
        *[F.max(F.when((F.col(arm) == a), F.col(value))).alias(f"v{i}") for i, a in enumerate(arms)],
        *[F.bool_and(F.when(F.col(arm) == a, ok)).alias(f"ok{i}") for i, a in enumerate(arms)],
        *[F.count_if(F.col(arm) == a).alias(f"n{i}") for i, a in enumerate(arms)],
    )
    parts = []
    for base, variant in pairs:
        i, j = arms.index(base), arms.index(variant)
        gap = F.col(f"v{i}") - F.col(f"v{j}") if sign == "saved" else F.col(f"v{j}") - F.col(f"v{i}")
        parts.append(
            F.struct(
                F.lit(base).alias("baseline"),
                F.lit(variant).alias("variant"),
                F.col(f"v{i}").alias("baseline_value"),
                F.col(f"v{j}").alias("variant_value"),
                F.when(F.col(f"ok{i}") & F.col(f"ok{j}"), gap).alias("difference"),
                ((F.col(f"n{i}") > 0) & (F.col(f"n{j}") > 0)).alias("matched"),
            )
        )
    return wide.select(*keys, F.explode(F.array(*parts)).alias("p")).select(*keys, "p.*").where("matched").drop("matched")


def pair_summary(differences: DataFrame, by: tuple[str, ...] = ("baseline", "variant")) -> DataFrame:
    d = F.col("difference")
    out = differences.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count(d).alias("comparable"),
        F.count_if(d > 0).alias("fewer"),
        F.count_if(d == 0).alias("equal"),
        F.count_if(d < 0).alias("more"),
        F.avg(d).alias("mean"),
        F.sum(d).alias("sum"),
    )
    return with_medians(out, differences, list(by), {"median": "difference"})


def leave_one_out(rows: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """Mean of a group without each of its items in turn, from group and item totals (no pairs)."""
    per = rows.groupBy(*by, item).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    total = rows.groupBy(*by).agg(F.sum(value).alias("all_s"), F.count(value).alias("all_c"))
    rest = F.col("all_c") - F.col("c")
    return per.join(total, by).select(*by, item, ((F.col("all_s") - F.col("s")) / F.nullif(rest, F.lit(0))).alias("mean_without"), rest.alias("n_without"))


def system_summary(runs: DataFrame, system: str = "system") -> DataFrame:
    """Planned, recorded, eligible, correct in several senses, cost, and cost of a resolved task."""
    ok = F.col("eligible")
    resolved = F.count_if(ok & F.col("resolved_correct"))
    cost = F.sum(F.when(ok, F.col("cost")))
    return runs.groupBy(system).agg(
        F.count(F.lit(1)).alias("planned"),
        F.count("status").alias("recorded"),
        F.count_if(ok).alias("eligible"),
        F.count_if(ok & F.col("correct")).alias("correct"),
        resolved.alias("resolved"),
        cost.alias("cost"),
        (cost / F.nullif(resolved, F.lit(0))).alias("cost_per_resolved"),
    )


def strata(rows: DataFrame, system: str, category: str, measures: list[Column]) -> DataFrame:
    """The same measures per system and per (system, category) in one pass; level says which."""
    sets = rows.groupingSets([[F.col(system)], [F.col(system), F.col(category)]], F.col(system), F.col(category))
    return sets.agg(*measures, F.grouping(category).alias("level"))


def rolled_up(rows: DataFrame, group: str, profile: str, measures: list[Column]) -> DataFrame:
    """Measures per (group, profile), with the pseudo-group "all" over all groups."""
    sets = rows.groupingSets([[F.col(profile)], [F.col(group), F.col(profile)]], F.col(group), F.col(profile))
    out = sets.agg(*measures, F.grouping(group).alias("__all"))
    return out.withColumn(group, F.when(F.col("__all") == 1, F.lit("all")).otherwise(F.col(group).cast("string"))).drop("__all")


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A map from value to count for each group; values are counted before they meet."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("histogram"))


def quality_separation(arms: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """Tasks that only one of two arms solves, their net, and whether it reaches the sign-test floor."""
    wide = arms.groupBy("task_id").agg(
        F.max(F.when(F.col("arm") == a, F.col("correct").cast("int"))).alias("x"),
        F.max(F.when(F.col("arm") == b, F.col("correct").cast("int"))).alias("y"),
    )
    gained, lost = F.count_if((F.col("y") > F.col("x"))), F.count_if((F.col("x") > F.col("y")))
    return wide.agg(gained.alias("gained"), lost.alias("lost"), (gained - lost).alias("net"), (F.abs(gained - lost) >= least).alias("separated"))


def ablation(rows: DataFrame, full: str, arms: dict[str, str]) -> DataFrame:
    """Arms with one tool removed against the full system: tool, regressions, improvements, turns and tokens avoided.

    ``arms``: arm -> removed tool.  ``rows``: system, task_id, correct, turns, tokens.
    """
    base = rows.where(F.col("system") == full).select("task_id", F.col("correct").alias("c0"), F.col("turns").alias("t0"), F.col("tokens").alias("k0"))
    tool = F.element_at(F.create_map(*[F.lit(x) for p in arms.items() for x in p]), F.col("system"))
    cut = rows.where(F.col("system").isin(list(arms))).withColumn("tool", tool).join(base, "task_id")
    return cut.groupBy("tool").agg(
        F.count_if(F.col("c0") & ~F.col("correct")).alias("regressions"),
        F.count_if(~F.col("c0") & F.col("correct")).alias("improvements"),
        F.sum(F.col("turns") - F.col("t0")).alias("turns_avoided"),
        F.sum(F.col("tokens") - F.col("k0")).alias("tokens_avoided"),
    )


def tool_verdict(unique_solves: Column, schema_tokens: Column, turns: Column, saving: Column) -> Column:
    """A tool pays by solving what nothing else solves, or by saving more than its schema costs over all turns."""
    cost = schema_tokens * turns
    return F.when(unique_solves > 0, "pays: unique solves").when(saving > cost, "pays: saves tokens").otherwise("does not pay")


def unique_solves(rows: DataFrame) -> DataFrame:
    """Tasks that exactly one system solves."""
    solved = rows.where("correct").groupBy("task_id").agg(F.count_distinct("system").alias("n"), F.min("system").alias("system"))
    return solved.where("n = 1").groupBy("system").agg(F.count(F.lit(1)).alias("unique_solves"))


def micro_precision_recall(rows: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averages over rows with counts agreed, returned and expected."""
    a, r, e = F.sum("agreed"), F.sum("returned"), F.sum("expected")
    return rows.groupBy(*by).agg((a / F.nullif(r, F.lit(0))).alias("precision"), (a / F.nullif(e, F.lit(0))).alias("recall"), a.alias("agreed"))


def set_difference(expected: DataFrame, returned: DataFrame, on: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, marked missing or extra."""
    missing = expected.select(*on).distinct().join(returned.select(*on).distinct(), on, "left_anti").withColumn("kind", F.lit("missing"))
    extra = returned.select(*on).distinct().join(expected.select(*on).distinct(), on, "left_anti").withColumn("kind", F.lit("extra"))
    return missing.unionByName(extra)


def never_solved(rows: DataFrame) -> DataFrame:
    """Trials of tasks that no trial resolved, with a verdict: wrong, unqualified, shape or other."""
    solved = rows.where("resolved").select("task_id").distinct()
    verdict = (
        F.when(F.col("answer").isNull(), "other")
        .when(~F.col("format_correct"), "shape")
        .when(F.col("tail_correct"), "unqualified")
        .otherwise("wrong")
    )
    return rows.join(solved, "task_id", "left_anti").withColumn("verdict", verdict)


def tail(symbol: Column) -> Column:
    """The last name of a spelled symbol, with its owner where that begins with a capital; parts that name a ``.rs`` file don't count."""
    parts = F.filter(F.split(symbol, "::|/"), lambda p: (p != "") & ~p.endswith(".rs"))
    last, owner = F.try_element_at(parts, F.lit(-1)), F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2)))
    return F.when(owner.rlike(r"^\p{Lu}"), F.concat_ws("::", owner, last)).otherwise(F.coalesce(last, symbol))


def notation(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per condition: trials, answers that agree strictly, and those that agree once symbols are cut to their tails.

    ``rows``: strict (the payload matches), got and gold (arrays; got is null without an answer).
    """
    alike = F.array_sort(F.transform("got", tail)) == F.array_sort(F.transform("gold", tail))
    resolved = F.col("strict") | F.coalesce(alike, F.lit(False))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"), F.count_if("strict").alias("strict"), F.count_if(resolved).alias("symbol_resolved"), F.count_if(resolved & ~F.col("strict")).alias("notation_only")
    )


def closure(rows: DataFrame) -> DataFrame:
    """``rows`` where a treatment scores below control, with ``verdict`` (did it stop early, or see the evidence?) and ``expansion_skipped``.

    What was never retrieved is the gold that isn't among ``seen``; an expansion was skipped where control did see some of that.
    """
    missing = F.array_except("gold", "seen")
    early = F.size(missing) > 0
    found = rows.where("treatment_credit < control_credit")
    return found.select("*", F.when(early, "premature_stop").otherwise("evidence_seen").alias("verdict"), (early & F.arrays_overlap(missing, "control_seen")).alias("expansion_skipped"))


def closure_report(rows: DataFrame) -> DataFrame:
    """One row: pairs, regressions, improvements, and how many regressions stopped early, saw the evidence, skipped an expansion.

    A skipped expansion is counted beside the premature stop that it is.
    """
    counts = rows.agg(
        F.count(F.lit(1)).alias("questions_paired"),
        F.count_if(F.col("treatment_credit") < F.col("control_credit")).alias("treatment_regressions"),
        F.count_if(F.col("treatment_credit") > F.col("control_credit")).alias("treatment_improvements"),
    )
    verdicts = closure(rows).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("premature_stop", "evidence_seen")], F.count_if("expansion_skipped").alias("expansion_skipped")
    )
    return counts.join(F.broadcast(verdicts), F.lit(True))  # one row each


def saw_evidence(delivered: DataFrame, wanted: DataFrame, trials: DataFrame) -> DataFrame:
    """``trials`` (trial, task_id, ...) and ``saw``: whether any delivered range (trial, path, start, end) meets a wanted one (task_id, path, start, end)."""
    asked = wanted.join(trials.select("trial", "task_id"), "task_id").select("trial", "path", "start", "end")
    met = overlapping(delivered.select("trial", "path", "start", "end"), asked, ["trial", "path"]).select("trial").distinct().withColumn("__met", F.lit(True))
    return trials.join(met, "trial", "left").withColumn("saw", F.col("__met").isNotNull()).drop("__met")


def failure_mode(saw: Column, got: Column, gold: Column) -> Column:
    """Why a trial failed: it never saw the evidence; gave part of the gold, or nothing; or misread what it saw."""
    nothing = got.isNull() | (F.size(got) == 0)
    part = (F.size(F.array_except(got, gold)) == 0) & (F.size(got) < F.size(gold))
    return F.when(~saw, "never_saw_evidence").when(nothing | part, "incomplete").otherwise("misread")


def failure_modes(trials: DataFrame, by: str = "condition") -> DataFrame:
    """Per condition and mode (``correct`` among them) the number of trials; ``trials``: credit, saw, got, gold."""
    mode = F.when(F.col("credit") == 1, "correct").otherwise(failure_mode(F.col("saw"), F.col("got"), F.col("gold")))
    return trials.groupBy(by, mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def reach_verdict(solved: Column, depth: Column, seed_defined: Column, workable: Column, visible: Column) -> Column:
    """Why a seeded expansion did or didn't lead to the answer.

    ``depth``: hops from the seed to the gold, null if unreachable; ``workable``: a seed that reaches the gold was in sight;
    ``visible``: any definition was.
    """
    return (
        F.when(solved, "solved")
        .when(depth.isNotNull(), "wrong_reach")
        .when(workable, "unchosen")
        .when(seed_defined & visible, "wrong_level")
        .otherwise("unavailable")
    )


def reach_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: decisions, each verdict but ``solved``, how far the seeds lie from the gold, seeds that are indexed, bytes returned.

    ``rows``: solved, depth, seed_defined, workable, visible, returned_bytes.
    """
    depth = F.col("depth")
    verdict = reach_verdict(F.col("solved"), depth, F.col("seed_defined"), F.col("workable"), F.col("visible"))
    out = rows.withColumn("verdict", verdict).groupBy(*by).agg(
        F.count(F.lit(1)).alias("structural_decisions"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("unavailable", "unchosen", "wrong_level", "wrong_reach")],
        F.count_if(depth == 0).alias("at_gold"),
        F.count_if(depth == 1).alias("one_hop"),
        F.count_if(depth > 1).alias("two_to_five_hops"),
        F.count_if(depth.isNull()).alias("unreachable"),
        F.count_if("seed_defined").alias("indexed_seeds"),
        F.sum("returned_bytes").alias("returned_bytes_total"),
    )
    return with_medians(out, rows, by, {"returned_bytes_median": "returned_bytes"})


#: Names of the distributions among the end-to-end measures.
END_TO_END = (
    "input_tokens", "output_tokens", "reasoning_tokens", "retrieval_bytes", "context_token_turns", "retrieval_calls", "source_reads", "retrieval_latency_ms", "wall_time_ms",
    "calls_to_first_hit", "calls_after_first_hit", "bytes_after_first_hit", "input_tokens_after_first_hit",
)


def end_to_end(rows: DataFrame, system: str = "system", category: str = "category") -> DataFrame:
    """Every end-to-end measure per system (``category`` null) and per category of a system, by one and the same code.

    ``rows``: one trial each, with task_id, status, correct, resolved_correct, resolved_credit, budget_exhausted, cost_usd,
    first_hit_call, answered_without_evidence, contaminated and the columns in ``END_TO_END``.  Each of those has a median and a
    mean (half to even at one decimal) and a count; input tokens and retrieval bytes also have a median over the resolved trials.
    A trial without a category is ``uncategorized``.  Every trial counts in two buckets, so nothing is computed twice over.
    """
    buckets = F.array(F.lit(None).cast("string"), F.coalesce(category, F.lit("uncategorized")))
    both = rows.withColumn("__bucket", F.explode(buckets)).drop(category).withColumnRenamed("__bucket", category)
    by = [system, category]
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    blind = on("answered_without_evidence")
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_distinct("task_id").alias("questions"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(on("correct")).alias("correct"),
        F.count_if(on("resolved_correct")).alias("resolved_correct"),
        F.bround(F.avg("resolved_credit"), 3).alias("resolved_credit_mean"),
        F.count_if(on("budget_exhausted")).alias("budget_exhausted"),
        F.bround(F.sum("cost_usd"), 4).alias("cost_usd"),
        F.count("first_hit_call").alias("trials_with_hit"),
        F.count_if(blind).alias("answered_without_evidence"),
        F.count_if(on("contaminated")).alias("contaminated"),
        F.count_if(blind & ~on("resolved_correct")).alias("wrong_without_evidence"),
    )
    # the distributions as rows: one selection serves all of them
    resolved = {f"resolved_{m}": F.when(on("resolved_correct"), F.col(m)) for m in ("input_tokens", "retrieval_bytes")}
    values = {**{m: F.col(m) for m in END_TO_END}, **resolved}
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value")) for m, v in values.items()])
    long = both.select(*by, F.explode(pairs).alias("p")).select(*by, "p.measure", "p.value")
    stats = rounded_stat(long, [*by, "measure"], "value")
    wide = stats.groupBy(*by).agg(
        *[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in END_TO_END for c in ("median", "mean", "n")],
        *[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"{m}_median") for m in resolved],
    )
    same = F.col(f"o.{system}").eqNullSafe(F.col(f"w.{system}")) & F.col(f"o.{category}").eqNullSafe(F.col(f"w.{category}"))
    return out.alias("o").join(wide.alias("w"), same).select("o.*", *[f"w.{c}" for c in wide.columns if c not in by])


def converged(runs: DataFrame, order: str = "run", value: str = "tokens", within: float = 0.02) -> DataFrame:
    """(group, converged): the last value of each group, if the one before it lies within 2 % of it, or within 1; else null.

    A last value of zero and a single run don't count as settled.
    """
    last = runs.groupBy("group").agg(F.max_by(value, order).alias("last"), F.max(order).alias("__last"))
    before = runs.join(last.select("group", "__last"), "group").where(F.col(order) < F.col("__last")).groupBy("group").agg(F.max_by(value, order).alias("before"))
    near = F.abs(F.col("last") - F.col("before")) <= F.greatest(F.lit(1.0), within * F.col("last"))
    return last.join(before, "group", "left").select("group", F.when((F.col("last") != 0) & near, F.col("last")).alias("converged"))


def ratios(arms: DataFrame, value: str) -> DataFrame:
    """Relative differences of every ordered pair of arms of a study (a study has a handful of arms)."""
    other = arms.select("study", F.col("arm").alias("other"), F.col(value).alias("other_value"))
    both = arms.join(other, "study").where("arm <> other")
    return both.select("study", "arm", "other", (F.col("other_value") / F.nullif(F.col(value), F.lit(0)) - 1).alias("ratio"))


def kept_rows(n: Column, fraction: Column) -> Column:
    """Rows of a page that stay when a fraction is cut to: half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(n * fraction).cast("int"))


def page_cut(sightings: DataFrame, fractions: tuple[float, ...] = (0.9, 0.75, 0.5, 0.34, 0.25, 0.1)) -> DataFrame:
    """Identities at risk when ranked pages are cut: per fraction, questions with any and with all lost.

    ``sightings``: question, identity, page_rows, position (from 1).  An identity survives if any of
    its sightings lies within the kept rows.
    """
    # one bit a fraction: a sighting says where it lives, an identity lives where any does, a question loses where one doesn't
    bits = [F.when(F.col("position") <= kept_rows(F.col("page_rows"), F.lit(f)), F.lit(1 << i)).otherwise(0) for i, f in enumerate(fractions)]
    alive = sightings.groupBy("question", "identity").agg(F.bit_or(reduce(Column.__add__, bits)).alias("alive"))
    per = alive.groupBy("question").agg(F.bit_and("alive").alias("every"), F.bit_or("alive").alias("some"))
    tests = [F.struct(F.lit(f).alias("fraction"), (F.col("every").bitwiseAND(1 << i) == 0).alias("any_lost"), (F.col("some").bitwiseAND(1 << i) == 0).alias("all_lost")) for i, f in enumerate(fractions)]
    told = per.select(F.explode(F.array(*tests)).alias("t")).select("t.*")
    return told.groupBy("fraction").agg(F.count(F.lit(1)).alias("questions"), F.count_if("any_lost").alias("any_lost"), F.count_if("all_lost").alias("all_lost"))


def page_bands(sightings: DataFrame, bands: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """How many sightings lie within each leading part of their page."""
    share = F.col("position") / F.col("page_rows")
    band = reduce(lambda acc, b: acc.when(share <= b, F.lit(b)), bands[1:], F.when(share <= bands[0], F.lit(bands[0])))
    return sightings.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def degrade(pages: DataFrame, fraction: float, order: list[Column], blind: list[str], page: str = "page") -> DataFrame:
    """A worse server: pages cut to a fraction of their rows, attribution columns dropped."""
    w = Window.partitionBy(page)
    cut = pages.withColumn("__at", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    return cut.where(F.col("__at") <= kept_rows(F.col("__n"), F.lit(fraction))).drop("__at", "__n", *blind)


def definition_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("name", "path").agg(F.count(F.lit(1)).alias("definitions"))


def discovery_calls(calls: DataFrame, arm: str = "arm", trial: str = "trial", script: str = "script") -> DataFrame:
    """Mean number of distinct scripts a trial of each arm runs."""
    per = calls.groupBy(arm, trial).agg(F.count_distinct(script).alias("n"))
    return per.groupBy(arm).agg(F.avg("n").alias("mean_scripts"), F.count(F.lit(1)).alias("trials"))


def vocabulary_provenance(rows: DataFrame) -> DataFrame:
    """Where a rewritten query's words come from: question, observations, both, neither (array columns)."""
    q, o, r = F.col("question"), F.col("observed"), F.col("rewritten")
    return rows.select(
        "task_id",
        F.size(F.array_intersect(r, F.array_except(q, o))).alias("from_question"),
        F.size(F.array_intersect(r, F.array_except(o, q))).alias("from_observed"),
        F.size(F.array_intersect(r, F.array_intersect(q, o))).alias("from_both"),
        F.size(F.array_except(F.array_except(r, q), o)).alias("new"),
    )


def regrade_changes(old: DataFrame, new: DataFrame, key: list[str], value: str = "credit", least: float = 1e-9) -> DataFrame:
    """Rows whose score changed when graded again."""
    joined = old.select(*key, F.col(value).alias("before")).join(new.select(*key, F.col(value).alias("after")), key)
    return joined.where(F.abs(F.col("before") - F.col("after")) > least)


def label_report(rows: DataFrame, by: str, labels: str = "labels") -> DataFrame:
    """Per condition: calls, empty ones and their share, and a map from label to count."""
    held = F.coalesce(F.col(labels), F.array())
    empty = F.count_if(F.array_contains(held, "empty"))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), empty.alias("empty_calls"), (empty / F.count(F.lit(1))).alias("empty_share"))
    counts = histogram(rows.select(by, F.explode(labels).alias("label")), [by], "label")
    named = out.alias("o").join(counts.alias("c"), F.col(f"o.{by}").eqNullSafe(F.col(f"c.{by}")), "left")
    return named.select("o.*", F.coalesce("c.histogram", F.create_map().cast("map<string,bigint>")).alias("labels"))


def answer_cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per cell: strict and resolved answers, credit, evidence seen, declined and fabricated answers."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("strict").alias("strict"),
        F.count_if(F.col("credit") >= 1).alias("resolved"),
        F.sum("credit").alias("credit"),
        F.count_if("evidence").alias("evidence"),
        F.count_if(F.col("answer").isNull()).alias("declined"),
        F.count_if(F.col("answer").isNotNull() & (F.col("credit") == 0)).alias("fabricated"),
    )


def prompt_evidence(launches: DataFrame, by: str = "document") -> DataFrame:
    """Launches per prompt document: how many suppress it, how many carry it, and what follows."""
    carrying, suppressing = F.count_if("carries"), F.count_if("suppresses")
    verdict = F.when((carrying > 0) & (suppressing > 0), "mixed").when(carrying > 0, "carried").when(suppressing > 0, "suppressed").otherwise("unknown")
    return launches.groupBy(by).agg(F.count(F.lit(1)).alias("launches"), suppressing.alias("suppressing"), carrying.alias("carrying"), verdict.alias("verdict"))


def arm_totals(rows: DataFrame, by: tuple[str, ...] = ("study", "arm")) -> DataFrame:
    """Published totals of each arm: trials, correct, input tokens, calls, token-turns, answers without evidence."""
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if("correct").alias("correct"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("calls").alias("calls"),
        F.sum("token_turns").alias("token_turns"),
        F.count_if(F.col("correct") & F.col("first_pos").isNull()).alias("answered_without_evidence"),
    )
    return with_medians(out, rows, list(by), {"calls_to_first_evidence": "first_pos"})


def excess_calls(calls: DataFrame, base: str, other: str) -> DataFrame:
    """Per task: how many calls of ``base`` exceed those of ``other``, in all and without empty ones."""
    per = calls.groupBy("task_id").agg(
        *[F.count_if(F.col("arm") == a).alias(f"{n}_all") for n, a in (("base", base), ("other", other))],
        *[F.count_if((F.col("arm") == a) & ~F.col("empty")).alias(f"{n}_found") for n, a in (("base", base), ("other", other))],
    )
    return per.select("task_id", (F.col("base_all") - F.col("other_all")).alias("excess"), (F.col("base_found") - F.col("other_found")).alias("excess_found"))


def payload(reply: Column) -> Column:
    """The one JSON object of a reply (as text), null if there is none or more than one: fences come in one pair or not at all."""
    fences = (F.octet_length(reply) - F.octet_length(F.replace(reply, F.lit("```"), F.lit("")))) / 3
    body = F.when(F.locate("{", reply) > 0, F.substring(reply, F.locate("{", reply), F.char_length(reply)))
    # the object ends at the first closing brace up to which the text is whole
    pieces = F.split(body, r"\}", -1)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(pieces, F.lit(1), k), "}"), F.lit("}")))
    first = F.try_element_at(F.filter(ends, lambda c: F.try_parse_json(c).isNotNull()), F.lit(1))
    rest = F.substring(body, F.char_length(first) + 1, F.char_length(body))
    return F.when(fences.isin(0, 2) & ~F.contains(rest, F.lit("{")), first)


def payload_audit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group and outcome the trials: what the one JSON object of an answer says of the gold, whatever stands around it.

    ``rows``: status, correct (as first graded), answer, gold (JSON ``{"answer": ...}``), as_set.  Outcomes: payload_matches,
    payload_differs, manual_review (no single well-formed object), excluded_unfinished.  ``recovered`` counts matches that were
    graded wrong, ``original_passes`` what was graded right.
    """
    graded = strict_grade(payload(F.col("answer")), F.col("gold"), F.col("as_set"))
    outcome = (
        F.when(F.col("status") != "completed", "excluded_unfinished")
        .when(~F.coalesce(graded["format_correct"], F.lit(False)), "manual_review")
        .when(graded["correct"], "payload_matches")
        .otherwise("payload_differs")
    )
    right = F.coalesce("correct", F.lit(False))
    done = rows.withColumn("outcome", outcome)
    return done.groupBy(*by, "outcome").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(right & (F.col("outcome") != "excluded_unfinished")).alias("original_passes"),
        F.count_if(~right & (F.col("outcome") == "payload_matches")).alias("recovered"),
    )


def suitability(rows: DataFrame) -> DataFrame:
    """Per medium: tasks whose gold files are among the first five with, and without, identifiers in the query."""
    return rows.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.arrays_overlap("gold_files", F.slice("files_with", 1, 5))).alias("with_identifiers"),
        F.count_if(F.arrays_overlap("gold_files", F.slice("files_without", 1, 5))).alias("without_identifiers"),
    )
