"""Exact binomial tails, critical values, power and reachable margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Step of the margin grid and the least expected count of either outcome.
GRID, LEAST_EXPECTED = 0.001, 2


def log_factorials(spark: SparkSession, n: int) -> DataFrame:
    """k, lf = ln k! for 0..n (n rows, made by one running sum)."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return spark.range(n + 1).select(F.col("id").cast("int").alias("k")).withColumn("lf", F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(0.0)).over(w))


def _masses(spark: SparkSession, trials: int, rates: DataFrame) -> DataFrame:
    """rate, successes, mass: in log space, so that large n neither over- nor underflows."""
    a = log_factorials(spark, trials)
    b = a.select((F.lit(trials) - F.col("k")).alias("k"), F.col("lf").alias("lr"))
    total = F.lit(0.0)
    top = a.where(F.col("k") == trials).select(F.col("lf").alias("ln"))
    k, r = F.col("k"), F.col("rate")
    logp = F.col("ln") - F.col("lf") - F.col("lr") + F.when(k > 0, k * F.log(r)).otherwise(total) + F.when(k < trials, (trials - k) * F.log(1 - r)).otherwise(total)
    mass = F.when(r <= 0, (k == 0).cast("double")).when(r >= 1, (k == trials).cast("double")).otherwise(F.exp(logp))
    # trials + 1 rows and a grid of at most 1001 rates
    return a.join(b, "k").join(F.broadcast(top)).join(F.broadcast(rates)).select("rate", k.alias("successes"), mass.alias("mass"))


def tails(spark: SparkSession, trials: int, rate: float) -> DataFrame:
    """trials, successes, tail = P(X >= successes)."""
    rates = spark.range(1).select(F.lit(float(rate)).alias("rate"))
    w = Window.orderBy(F.desc("successes")).rowsBetween(Window.unboundedPreceding, 0)
    return _masses(spark, trials, rates).select(F.lit(trials).alias("trials"), "successes", F.least(F.lit(1.0), F.sum("mass").over(w)).alias("tail"))


def tails_of(rows: DataFrame, trials: str = "trials", successes: str = "successes", rate: str = "rate") -> DataFrame:
    """``rows`` (one for each arm, say) and ``tail`` = P(X >= successes) of its own trials and rate, exactly.

    A row costs as many masses as it has trials beyond its successes; rates lie strictly between 0 and 1.
    """
    spark = rows.sparkSession
    most = rows.agg(F.max(trials)).head()[0] or 0
    lf = log_factorials(spark, int(most))
    asked = rows.select(trials, successes, rate).distinct()
    each = asked.select("*", F.explode(F.sequence(successes, trials)).alias("__k")).withColumn("__rest", F.col(trials) - F.col("__k"))
    for column, name in (("__k", "__a"), ("__rest", "__b"), (trials, "__n")):
        each = each.join(lf.select(F.col("k").alias(column), F.col("lf").alias(name)), column)
    logp = F.col("__n") - F.col("__a") - F.col("__b") + F.col("__k") * F.log(rate) + F.col("__rest") * F.log(1 - F.col(rate))
    found = each.groupBy(trials, successes, rate).agg(F.least(F.lit(1.0), F.sum(F.exp(logp))).alias("tail"))
    return rows.join(found, [trials, successes, rate], "left")


def critical_value(spark: SparkSession, trials: int, null_rate: float, alpha: float = 0.05) -> int | None:
    """The least number of successes whose tail under the null is at most alpha."""
    row = tails(spark, trials, null_rate).where(F.col("tail") <= alpha).agg(F.min("successes")).head()
    return row[0]


def power_curve(spark: SparkSession, trials: int, null_rate: float, alpha: float = 0.05) -> DataFrame:
    """margin, power over the grid of margins above the null rate."""
    critical = critical_value(spark, trials, null_rate, alpha)
    steps = int(round((1 - null_rate) / GRID))
    rates = spark.range(steps + 1).select(F.round(F.col("id") * GRID, 3).alias("margin"))
    rates = rates.withColumn("rate", F.least(F.lit(1.0), F.col("margin") + null_rate))
    if critical is None:
        return rates.select("margin", F.lit(0.0).alias("power"))
    mass = _masses(spark, trials, rates.select("rate")).where(F.col("successes") >= critical).groupBy("rate").agg(F.least(F.lit(1.0), F.sum("mass")).alias("power"))
    return rates.join(mass, "rate").select("margin", "power")


def reachable_margin(spark: SparkSession, trials: int, null_rate: float, power: float = 0.8, alpha: float = 0.05) -> float | None:
    """The smallest margin of the grid that is found with the given power."""
    return power_curve(spark, trials, null_rate, alpha).where(F.col("power") >= power).agg(F.min("margin")).head()[0]


def measurable(trials: int, rate: float) -> dict[str, bool]:
    """Whether a control leaves room above it and stands above the floor."""
    return {"headroom": trials * (1 - rate) >= LEAST_EXPECTED, "floor": trials * rate >= LEAST_EXPECTED}
