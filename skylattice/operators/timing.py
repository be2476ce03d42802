"""Timing of logs: duplicates, reversals, intervals, jitter and dropouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings
from .pieces import by_row, by_time, picked, quantiles, ranked, scan


def intervals(log: DataFrame) -> DataFrame:
    """Rows (log_id, timestamp, interval): positive steps between the distinct times of each log, in order."""
    times = log.filter(F.col("timestamp").isNotNull()).select("log_id", "timestamp").distinct()
    steps = scan(times, by_time(F.col("timestamp")), ("timestamp",), priors={"_before": F.col("timestamp")})
    return steps.select("log_id", "timestamp", (F.col("timestamp") - F.col("_before")).alias("interval")).filter("interval > 0")


def dropouts(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (log_id, start_s, end_s, gap_s): intervals above the multiple of the log's median."""
    steps = intervals(log)
    usual = quantiles(steps, "interval", {"median_s": 0.5})
    far = steps.join(usual, "log_id").filter(F.col("interval") > F.col("median_s") * settings.dropout_multiplier)
    return far.select("log_id", (F.col("timestamp") - F.col("interval")).alias("start_s"), F.col("timestamp").alias("end_s"), F.col("interval").alias("gap_s"))


def order_counts(log: DataFrame) -> DataFrame:
    """Rows (log_id, n_rows, n_duplicate, n_reverse) over all rows in row order.  Null is one of the values that repeat; a step
    from or to a null is no reversal."""
    steps = scan(log.select("log_id", "ord", "timestamp"), by_row(), ("ord",), priors={"_before": F.col("timestamp")})
    by_value = steps.groupBy("log_id", "timestamp").agg(F.count("*").alias("n"), F.count_if(F.col("timestamp") < F.col("_before")).alias("back"))
    return by_value.groupBy("log_id").agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_duplicate"), F.sum("back").alias("n_reverse"))


def analyze_timing(full: DataFrame, analysis: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a log of ``full``: counts over the full log, and timing of the analysis rows (null and not available below two
    distinct times)."""
    counts = order_counts(full)
    steps = ranked(intervals(analysis), "interval")
    middle = steps.groupBy("log_id").agg(picked(0.5).alias("median_s"))
    off = F.col("v") - F.col("median_s")  # moments about the median: exact zeros stay zero
    sums = steps.join(middle, "log_id").groupBy("log_id").agg(
        F.first("median_s").alias("median_s"), F.sum(F.col("n") * F.col("v")).alias("duration_s"), (F.sum(F.col("n") * off) / F.sum("n")).alias("shift"), (F.sum(F.col("n") * off * off) / F.sum("n")).alias("square"),
        F.sum(F.when(F.col("v") > F.col("median_s") * settings.dropout_multiplier, F.col("n"))).alias("n_dropout"),
    )
    usual = sums.withColumns({"mean_s": F.col("median_s") + F.col("shift"), "std_s": F.sqrt(F.greatest(F.col("square") - F.col("shift") * F.col("shift"), F.lit(0.0)))})
    out = counts.join(usual, "log_id", "left")
    available = F.col("median_s").isNotNull()
    return out.select(
        "log_id", available.alias("available"), "n_duplicate", "n_reverse", "mean_s", "median_s", "std_s", F.try_divide(F.lit(1.0), F.col("median_s")).alias("frequency_hz"),
        F.try_divide(F.col("std_s"), F.col("median_s")).alias("jitter"), "duration_s", F.when(available, F.coalesce("n_dropout", F.lit(0))).alias("n_dropout"),
    )


def interval_vectors(log: DataFrame) -> DataFrame:
    """Rows (log_id, intervals): all intervals of a log in order of time."""
    return intervals(log).groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "interval"))), lambda x: x["interval"]).alias("intervals"))
