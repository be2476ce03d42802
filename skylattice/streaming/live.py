"""Timing of logs while they arrive: the batch measures that a window of event time can give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_windows(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Per log and window of ``ts``: rows, span, mean altitude error and saturation share.  Rows later than the watermark are left out;
    state is bounded by open windows."""
    error = F.col("altitude_setpoint") - F.col("ekf_altitude")
    return stream.withWatermark("ts", late).groupBy("log_id", F.window("ts", width)).agg(
        F.count("*").alias("rows"), (F.max("timestamp") - F.min("timestamp")).alias("span_s"), F.sqrt(F.avg(error * error)).alias("rmse_m"), F.avg((F.abs("throttle_correction") >= 160).cast("int")).alias("saturation_ratio"),
    )


def live_sessions(stream: DataFrame, late: str = "10 minutes", gap: str = "30 seconds") -> DataFrame:
    """Per log, stretches of armed rows without a gap in event time."""
    return stream.filter("armed").withWatermark("ts", late).groupBy("log_id", F.session_window("ts", gap)).agg(F.count("*").alias("rows"))
