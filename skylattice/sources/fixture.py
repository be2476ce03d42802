"""Canonical flight logs derived from the ``events`` table: one log a user, and the same in SQL.

Times are whole milliseconds, so Spark and SQL agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import MOTORS


def flight_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("ord", (F.row_number().over(w) - 1).cast("long")).withColumn("gaps", F.sum((F.col("event_id") % 53 == 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("time_ms", 40 * F.col("ord") + 200 * F.col("gaps") + F.col("event_id") % 5)
    level = F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(1.5)), (F.floor(F.col("ord") / 20) % 3 + 1).cast("int"))
    e = e.withColumn("altitude_setpoint", level)
    e = e.withColumn("ekf_altitude", F.coalesce(F.lag("altitude_setpoint", 3).over(w), "altitude_setpoint") + (F.col("event_id") % 11 - 5).cast("double") / 100.0)
    e = e.withColumn("reference_altitude", F.coalesce(F.lag("ekf_altitude", 2).over(w), "ekf_altitude") + 0.1)
    motor = lambda k, m: (1300 + F.col("event_id") * k % m).cast("double")
    return e.select(
        F.col("user_id").alias("log_id"), "ord", "time_ms", (F.col("time_ms") / 1000.0).alias("timestamp"), "altitude_setpoint", "ekf_altitude", "reference_altitude",
        F.lit(1400.0).alias("throttle_base"), ((F.col("value") - 50.0) * 4.0).alias("throttle_correction"),
        *[motor(k, m).alias(name) for name, k, m in zip(MOTORS, (37, 74, 111, 997), (401, 401, 401, 801), strict=True)],
        (F.col("ord") >= 3).alias("armed"), (F.col("event_type") != "error").alias("althold_active"),
    )


#: CTEs that define ``flight_log`` in SQL.
LOG_SQL = """
e0 AS (SELECT event_id, user_id, event_type, value, row_number() OVER w - 1 AS ord,
         sum((event_id % 53 = 0)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS gaps
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
e1 AS (SELECT *, 40 * ord + 200 * gaps + event_id % 5 AS time_ms, [1.0::DOUBLE, 2.0::DOUBLE, 1.5::DOUBLE][((ord // 20) % 3 + 1)::INT] AS sp FROM e0),
e2 AS (SELECT *, coalesce(lag(sp, 3) OVER w, sp) + (event_id % 11 - 5)::DOUBLE / 100.0::DOUBLE AS ekf FROM e1 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
flight_log AS (
  SELECT user_id AS log_id, ord, time_ms, time_ms::DOUBLE / 1000.0::DOUBLE AS timestamp, sp AS altitude_setpoint, ekf AS ekf_altitude,
    coalesce(lag(ekf, 2) OVER w, ekf) + 0.1::DOUBLE AS reference_altitude, 1400.0::DOUBLE AS throttle_base, (value - 50.0::DOUBLE) * 4.0::DOUBLE AS throttle_correction,
    (1300 + event_id * 37 % 401)::DOUBLE AS motor_1, (1300 + event_id * 74 % 401)::DOUBLE AS motor_2, (1300 + event_id * 111 % 401)::DOUBLE AS motor_3,
    (1300 + event_id * 997 % 801)::DOUBLE AS motor_4, ord >= 3 AS armed, event_type <> 'error' AS althold_active
  FROM e2 WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""
