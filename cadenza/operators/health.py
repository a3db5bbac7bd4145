"""Source health and run logs: streaks, retention, policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.quality import first_of
from cadenza.schema import RULES, Rules


def latest_status(runs: DataFrame) -> DataFrame:
    """Per source the last run, the last success with its count, and failures in a row since.

    runs is (source, t, ok, n). Of runs of the same source and time one counts, failures first.
    """
    runs = first_of(runs, ["source", "t"], F.col("ok"), F.col("n").desc())
    good = F.when(F.col("ok"), F.col("t"))
    out = runs.groupBy("source").agg(F.max("t").alias("tested_at"), F.max(good).alias("last_success"), F.max_by("ok", "t").alias("ok"), F.max_by("n", good).alias("last_success_count"))
    # Counted in a second pass, so no source's runs stand in one row.
    since = runs.select("source", "t", F.col("ok").alias("__ok")).join(out.select("source", "last_success"), "source").filter(~F.col("__ok") & (F.col("last_success").isNull() | (F.col("t") > F.col("last_success"))))
    failures = since.groupBy("source").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    return out.join(failures, "source", "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0).cast("long")))


def unhealthy(status: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Sources that never succeeded or failed too often in a row."""
    return status.filter(F.col("last_success").isNull() | (F.col("consecutive_failures") >= rules.failures_in_a_row))


def status_text() -> Column:
    """One cell of the status table."""
    count = F.coalesce(F.col("last_success_count").cast("string"), F.lit("0"))
    return F.when(F.col("ok"), F.concat(F.lit("ok, "), count, F.lit(" events"))).otherwise(F.concat(F.lit("failed "), F.col("consecutive_failures").cast("string"), F.lit("x, last success "), F.coalesce(F.date_format("last_success", "yyyy-MM-dd"), F.lit("never"))))


def last_runs(runs: DataFrame, keep: int = RULES.kept_runs) -> DataFrame:
    """The newest runs of each source; a run of the same time replaces an earlier row."""
    runs = first_of(runs, ["source", "t"], F.col("ok"), F.col("n").desc())
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("t").desc()))
    return runs.withColumn("rank", rank).filter(F.col("rank") <= keep)


def retained(runs: DataFrame, group: str, time: str, clean: str, keep: int = 30, least_clean: int = 5) -> DataFrame:
    """The newest runs, and older clean ones until there are enough clean ones."""
    newest = Window.partitionBy(group).orderBy(F.col(time).desc())
    rank, n_clean = F.row_number().over(newest), F.sum(F.col(clean).cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    marked = runs.withColumn("rank", rank).withColumn("n_clean", n_clean)
    return marked.filter((F.col("rank") <= keep) | (F.col(clean) & (F.col("n_clean") <= least_clean)))


def run_summary(results: DataFrame) -> DataFrame:
    """Passed, failed and skipped of each test run; a run without failures is clean."""
    count = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return results.groupBy("run").agg(count("passed"), count("failed"), count("skipped"), F.count(F.lit(1)).alias("total")).withColumn("clean", F.col("failed") == 0)


def failed_first(sources: DataFrame, status: DataFrame) -> DataFrame:
    """Sources to run, those that failed last time first, each part in its given order."""
    rows = sources.join(status.select("source", "ok"), "source", "left")
    return rows.orderBy(F.coalesce("ok", F.lit(True)), "rank")


def status_table(status: DataFrame) -> DataFrame:
    """A line of a Markdown table for each source, in order of its name."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), cell(F.col("source").cast("string")), F.lit(" | "), cell(status_text()), F.lit(" |"))
    return status.select(F.col("source"), line.alias("line")).orderBy("source")


def top_values(df: DataFrame, value: Column, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(n)
