"""Diagnostic rules as data: each hypothesis adds up scored conditions on the metrics of a log, in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import MOTORS


@dataclass(frozen=True)
class Hypothesis:
    id: str
    title: str
    requires: tuple[str, ...]
    test: str
    limitation: str = ""


@dataclass(frozen=True)
class Rule:
    """A condition that holds adds ``delta``; one that fails takes a quarter of it away; a null one changes nothing."""

    hypothesis: str
    name: str
    delta: int
    observed: str  # SQL over the metrics of a log
    condition: str
    threshold: str


ALTITUDE = ("altitude_setpoint", "ekf_altitude")
SENSORS = ("ekf_altitude", "reference_altitude")
HYPOTHESES = (
    Hypothesis("incorrect_hover_pwm", "Hover throttle is set wrong", ("throttle_correction",), "Step the hover throttle and compare the steady mean correction."),
    Hypothesis("altitude_p_gain_high", "Altitude P gain is too high", ALTITUDE, "Lower the P gain a little and compare oscillation and settling."),
    Hypothesis("altitude_i_gain_high", "Altitude I gain is too high", (*ALTITUDE, "throttle_correction"), "Lower the I gain a little and compare slow error and correction bias.", "The integrator is not logged; only indirect measures are used."),
    Hypothesis("integrator_windup", "The integrator winds up", (*ALTITUDE, "throttle_correction"), "Log the integrator and its clamp; time the return from saturation.", "Without the integrator's state windup cannot be confirmed."),
    Hypothesis("throttle_correction_saturation", "Throttle correction saturates", ("throttle_correction",), "Check the correction limit against the real output limits."),
    Hypothesis("reference_sensor_noise_or_vibration", "The reference sensor is noisy or shaken", SENSORS, "Compare the error spectrum before and after a change of mounting."),
    Hypothesis("reference_ekf_bias", "Reference and estimate differ by a bias", SENSORS, "Check origin and datum; compare the bias before and after flight.", "A different origin or datum also gives a lasting bias."),
    Hypothesis("sensor_control_delay", "A sensor or the control responds late", (*SENSORS, "timestamp"), "Log raw, filtered and control values on one clock.", "Lag also reflects common inputs and filters."),
    Hypothesis("task_period_instability", "The task period is unstable", ("timestamp",), "Log task run time and missed deadlines.", "Jitter of the log is not jitter of the task."),
    Hypothesis("timestamp_logging_problem", "Time stamps or logging are faulty", ("timestamp",), "Log a monotonic clock and a sequence counter."),
    Hypothesis("cg_asymmetry", "The centre of gravity is off", MOTORS, "Measure the centre of gravity; compare mean outputs in hover.", "Attitude and current are needed to tell this from uneven thrust."),
    Hypothesis("motor_propeller_imbalance", "Motors or propellers are uneven", MOTORS, "Swap motors or propellers and see whether the deviation moves.", "A command does not measure thrust."),
)
RULES = (
    Rule("incorrect_hover_pwm", "mean correction", 45, "mean_throttle_correction_pwm", "abs({x}) >= 25", ">= 25 us"),
    Rule("incorrect_hover_pwm", "steady error", 25, "steady_state_error_m", "abs({x}) >= 0.15D", ">= 0.15 m"),
    Rule("altitude_p_gain_high", "error spread", 30, "error_std_m", "{x} >= 0.2D", ">= 0.2 m"),
    Rule("altitude_p_gain_high", "oscillation peak", 45, "peak_ratio", "{x} >= 0.15D AND dominant_frequency_hz BETWEEN 0.15D AND 3.0D", ">= 0.15"),
    Rule("altitude_i_gain_high", "saturation", 30, "correction_saturation_ratio", "{x} >= 0.1D", ">= 0.1"),
    Rule("altitude_i_gain_high", "slow oscillation", 25, "dominant_frequency_hz", "{x} > 0 AND {x} <= 0.5D", "<= 0.5 Hz"),
    Rule("integrator_windup", "continuous saturation", 40, "max_continuous_saturation_s", "{x} >= 0.5D", ">= 0.5 s"),
    Rule("integrator_windup", "saturation", 25, "correction_saturation_ratio", "{x} >= 0.2D", ">= 0.2"),
    Rule("integrator_windup", "slow settling", 15, "settling_time_s", "{x} >= 3.0D", ">= 3 s"),
    Rule("throttle_correction_saturation", "saturation", 70, "correction_saturation_ratio", "{x} >= 0.05D", ">= 0.05"),
    Rule("reference_sensor_noise_or_vibration", "difference spread", 30, "difference_std_m", "{x} >= 0.15D", ">= 0.15 m"),
    Rule("reference_sensor_noise_or_vibration", "motor correlation", 35, "motor_error_correlation", "{x} >= 0.35D", ">= 0.35"),
    Rule("reference_sensor_noise_or_vibration", "fast peak", 15, "dominant_frequency_hz", "{x} >= 1.0D", ">= 1 Hz"),
    Rule("reference_ekf_bias", "mean bias", 55, "bias_m", "abs({x}) >= 0.2D", ">= 0.2 m"),
    Rule("reference_ekf_bias", "lasting bias", 20, "difference_std_m", "abs(bias_m) >= 0.2D AND {x} < abs(bias_m)", "spread < bias"),
    Rule("sensor_control_delay", "lag", 50, "estimated_lag_s", "CASE WHEN reliable THEN abs({x}) >= 0.1D END", ">= 0.1 s"),
    Rule("sensor_control_delay", "lag correlation", 15, "max_correlation", "CASE WHEN reliable THEN {x} >= 0.5D END", ">= 0.5"),
    Rule("task_period_instability", "jitter", 50, "jitter", "{x} >= 0.1D", ">= 0.1"),
    Rule("task_period_instability", "dropouts", 20, "n_dropout", "{x} > 0", "> 0"),
    Rule("timestamp_logging_problem", "duplicate times", 30, "n_duplicate", "{x} > 0", "> 0"),
    Rule("timestamp_logging_problem", "reversed times", 35, "n_reverse", "{x} > 0", "> 0"),
    Rule("timestamp_logging_problem", "dropouts", 25, "n_dropout", "{x} > 0", "> 0"),
    Rule("cg_asymmetry", "motor spread", 50, "mean_motor_spread_pwm", "{x} >= 80", ">= 80 us"),
    Rule("motor_propeller_imbalance", "motor spread", 45, "mean_motor_spread_pwm", "{x} >= 100", ">= 100 us"),
    Rule("motor_propeller_imbalance", "motor variation", 25, "max_motor_std_pwm", "{x} >= 60", ">= 60 us"),
)
METRICS = tuple(dict.fromkeys([*(r.observed for r in RULES), "bias_m", "reliable"]))


def applied(rule: Rule, dialect: str = "spark") -> str:
    """SQL of the change that a rule makes to a score."""
    test = rule.condition.format(x=rule.observed)
    if dialect != "spark":
        for number in ("0.05", "0.15", "0.1", "0.2", "0.35", "0.5", "1.0", "3.0"):
            test = test.replace(f"{number}D", f"{number}::DOUBLE")
    return f"CASE WHEN ({test}) THEN {rule.delta} WHEN NOT ({test}) THEN {-max(1, rule.delta // 4)} ELSE 0 END"


def _score(deltas: list[Column]) -> Column:
    """Deltas added one by one, the sum kept within 0 and 100 after each."""
    return F.aggregate(F.array(*deltas), F.lit(0), lambda score, d: F.greatest(F.lit(0), F.least(F.lit(100), score + d)))


def evaluate(metrics: DataFrame, available: tuple[str, ...]) -> DataFrame:
    """Rows (log_id, rank, hypothesis, score, n_met, n_unmet, missing, details) of every log and hypothesis, by score.

    ``metrics`` has one row a log with the columns in METRICS (null: not known); ``available`` are the columns of the log.
    """
    rows = []
    for h in HYPOTHESES:
        rules = [r for r in RULES if r.hypothesis == h.id]
        deltas = [F.expr(applied(r)) for r in rules]
        details = F.array(*[F.struct(F.lit(r.name).alias("rule"), d.alias("delta"), F.when(d > 0, "met").when(d < 0, "unmet").otherwise("not computable").alias("result"), F.col(r.observed).cast("double").alias("observed"), F.lit(r.threshold).alias("threshold")) for r, d in zip(rules, deltas, strict=True)])
        missing = F.array(*[F.lit(p) for p in sorted(set(h.requires) - set(available))]).cast("array<string>")
        limits = [x for x in (h.limitation, "Columns are missing; the score may be too low." if set(h.requires) - set(available) else "") if x]
        rows.append(F.struct(F.lit(h.id).alias("hypothesis"), _score(deltas).alias("score"), missing.alias("missing"), F.array(*map(F.lit, limits)).cast("array<string>").alias("limitations"), details.alias("details")))
    out = metrics.select("log_id", F.explode(F.array(*rows)).alias("h")).select("log_id", "h.*")
    rank = F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("score"), "hypothesis"))
    count = lambda result: F.size(F.filter("details", lambda d: d["result"] == result)).cast("long")
    return out.withColumn("rank", rank.cast("long")).withColumn("n_met", count("met")).withColumn("n_unmet", count("unmet"))
