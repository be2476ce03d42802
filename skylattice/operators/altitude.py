"""Altitude tracking: errors between setpoint and estimate, and their steady state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings
from .pieces import by_row, quantiles, scan


def tracking_rows(log: DataFrame) -> DataFrame:
    """Rows with setpoint and estimate, with ``error`` = setpoint - estimate."""
    return log.filter(F.col("altitude_setpoint").isNotNull() & F.col("ekf_altitude").isNotNull()).withColumn("error", F.col("altitude_setpoint") - F.col("ekf_altitude"))


def altitude_error(log: DataFrame) -> DataFrame:
    """One row a log with two or more rows of both values: size and spread of the error."""
    e, rows = F.col("error"), tracking_rows(log)
    sums = rows.groupBy("log_id").agg(
        F.sqrt(F.avg(e * e)).alias("rmse_m"), F.avg(F.abs(e)).alias("mae_m"), F.avg(e).alias("mean_error_m"), F.stddev_pop(e).alias("error_std_m"),
        F.max(F.abs(e)).alias("max_abs_error_m"), F.count("*").alias("n"),
    ).filter("n >= 2")
    high = quantiles(rows.select("log_id", F.abs(e).alias("size")), "size", {"p95_abs_error_m": 0.95})
    return sums.join(high, "log_id").select("log_id", "rmse_m", "mae_m", "mean_error_m", "error_std_m", "max_abs_error_m", "p95_abs_error_m", "n")


def steady_state_error(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (log_id, steady_state_error_m): mean error of the last rows in row order, a fraction of all (half to even), one at least."""
    rows = scan(tracking_rows(log).select("log_id", "ord", "error"), by_row(), ("ord",), sums={"_place": F.lit(1)}, totals={"_n": F.lit(1)})
    last = F.greatest(F.lit(1), F.expr(f"bround(_n * {settings.steady_fraction}D)"))
    return rows.filter((F.col("_n") - F.col("_place") < last) & (F.col("_n") >= 2)).groupBy("log_id").agg(F.avg("error").alias("steady_state_error_m"))


def analyze_altitude(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Error, steady state and the response to the primary step, one row a log."""
    from .steps import primary_step

    metrics = altitude_error(log).join(steady_state_error(log, settings), "log_id", "left")
    return metrics.join(primary_step(log, settings), "log_id", "left").withColumn("available", F.lit(True))
