"""Actuators: throttle correction, its saturation, and the motors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, motor_spread
from ..settings import MOTORS, Settings
from .segments import islands


def saturation_runs(log: DataFrame, settings: Settings = Settings(), samples_without_time: bool = False) -> DataFrame:
    """Rows (log_id, max_continuous_saturation_s): the longest run in row order of corrections at the limit (a null ends it), from its
    first to its last row.  Without times: null, or the number of rows if asked for."""
    kept = log.select("log_id", "ord", "throttle_correction", *(["timestamp"] if "timestamp" in log.columns else []))
    runs = islands(kept, full=F.abs("throttle_correction") >= settings.correction_limit).filter("on_full")
    if "timestamp" not in log.columns:
        length = F.count("*").cast("double") if samples_without_time else F.lit(None).cast("double")
    else:
        length = F.coalesce(F.greatest(F.lit(0.0), finite(F.max_by("timestamp", "pos")) - finite(F.min_by("timestamp", "pos"))), F.lit(0.0))
    longest = runs.groupBy("log_id", "run_full").agg(length.alias("length")).groupBy("log_id").agg(F.max("length").alias("length"))
    known = log.groupBy("log_id").agg(F.count("throttle_correction").alias("_n")).filter("_n > 0")
    zero = F.lit(0.0) if "timestamp" in log.columns or samples_without_time else F.lit(None).cast("double")
    return known.join(longest, "log_id", "left").select("log_id", F.coalesce("length", zero).alias("max_continuous_saturation_s"))


def motor_metrics(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (log_id, motor, mean_pwm, std_pwm, saturation_ratio) of the motors that have values."""
    motors = [m for m in MOTORS if m in log.columns]
    long = log.select("log_id", F.explode(F.array(*[F.struct(F.lit(m).alias("motor"), F.col(m).alias("pwm")) for m in motors])).alias("m")).select("log_id", "m.motor", "m.pwm").filter("pwm IS NOT NULL")
    full = ((F.col("pwm") <= settings.motor_min) | (F.col("pwm") >= settings.motor_max)).cast("int")
    return long.groupBy("log_id", "motor").agg(F.avg("pwm").alias("mean_pwm"), F.stddev_pop("pwm").alias("std_pwm"), F.avg(full).alias("saturation_ratio"))


def analyze_actuators(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a log.  Columns that the log lacks give nulls; available if any measure is known."""
    c, limit, none = F.col("throttle_correction"), settings.correction_limit, F.lit(None).cast("double")
    share = lambda test: F.avg(F.when(c.isNotNull(), test.cast("int")))
    motors = [F.col(m) for m in MOTORS if m in log.columns]
    has_c = "throttle_correction" in log.columns
    out = log.groupBy("log_id").agg(
        (F.avg("throttle_base") if "throttle_base" in log.columns else F.first(none)).alias("mean_base_throttle_pwm"),
        (F.avg(c) if has_c else F.first(none)).alias("mean_throttle_correction_pwm"), (F.stddev_pop(c) if has_c else F.first(none)).alias("correction_std_pwm"),
        (share(F.abs(c) >= limit) if has_c else F.first(none)).alias("correction_saturation_ratio"), (share(c >= limit) if has_c else F.first(none)).alias("positive_saturation_ratio"),
        (share(c <= -limit) if has_c else F.first(none)).alias("negative_saturation_ratio"), (F.avg(motor_spread(motors)) if len(motors) > 1 else F.first(none)).alias("mean_motor_spread_pwm"),
    )
    if has_c:
        out = out.join(saturation_runs(log, settings), "log_id", "left")
    else:
        out = out.withColumn("max_continuous_saturation_s", none)
    if motors:
        most = motor_metrics(log, settings).groupBy("log_id").agg(F.max("std_pwm").alias("max_motor_std_pwm"), F.max("saturation_ratio").alias("max_motor_saturation_ratio"))
        out = out.join(most, "log_id", "left")
    else:
        out = out.withColumn("max_motor_std_pwm", none).withColumn("max_motor_saturation_ratio", none)
    known = [x for x in out.columns if x != "log_id"]
    return out.withColumn("available", F.coalesce(*known).isNotNull())
