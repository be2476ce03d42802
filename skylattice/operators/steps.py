"""Step responses: changes of the setpoint between plateaus, and how the altitude follows each.

Every row of a log carries its ``group``: how many change groups have begun up to it.  The rows of a group from its last change
point on are the plateau behind it and, at the same time, the plateau before the next group.  So everything is a window over a
log or over (log, group), on one shuffle by log: rows are never joined to steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, median
from ..settings import Settings
from .altitude import tracking_rows
from .pieces import by_row, scan

#: Seconds of a plateau that count, gap that merges changes, longest change, fewest plateau rows, and the floors of the threshold.
WINDOW_S, MERGE_S, LONGEST_S, NEAREST = 0.5, 0.25, 0.75, 2
FLOOR_M, SHARE, NOISE = 0.05, 0.05, 5.0


def per_log():
    return Window.partitionBy("log_id")


def per_group():
    return Window.partitionBy("log_id", "group")


def up_to(window, last: int = 0):
    return window.rowsBetween(Window.unboundedPreceding, last)


def step_rows(log: DataFrame) -> DataFrame:
    """Rows of logs fit for steps (five or more, finite, strictly increasing times) with ``pos`` from 0, ``n``, and the noise and threshold of
    their log; noise is the scaled median deviation of the changes."""
    at = per_log().orderBy("pos")
    rows = tracking_rows(log).select("log_id", "ord", "timestamp", "altitude_setpoint", "ekf_altitude")
    rows = rows.withColumn("pos", F.row_number().over(per_log().orderBy("ord")) - 1)
    rows = rows.withColumn("dt", F.col("timestamp") - F.lag("timestamp").over(at)).withColumn("dsp", F.col("altitude_setpoint") - F.lag("altitude_setpoint").over(at))
    bad = finite(F.col("timestamp")).isNull() | finite(F.col("altitude_setpoint")).isNull()
    rows = rows.withColumn("n", F.count("*").over(per_log())).withColumn("least", F.min("dt").over(per_log())).withColumn("bad", F.count_if(bad).over(per_log())).filter("n >= 5 AND least > 0 AND bad = 0")
    rows = rows.withColumn("range", F.max("altitude_setpoint").over(per_log()) - F.min("altitude_setpoint").over(per_log())).filter("range > 0")
    rows = rows.withColumn("mid", median(F.col("dsp")).over(per_log()))
    rows = rows.withColumn("noise", 1.4826 * median(F.abs(F.col("dsp") - F.col("mid"))).over(per_log()))
    threshold = F.greatest(F.lit(FLOOR_M), SHARE * F.col("range"), NOISE * F.col("noise"))
    return rows.withColumn("threshold", threshold).drop("ord", "dt", "least", "bad", "mid", "range")


def grouped_rows(log: DataFrame) -> DataFrame:
    """Step rows with ``point`` (a change above the threshold), ``group``, and of the group: ``first`` and ``last`` position, ``t_first``,
    ``t_last``; of the next one ``after`` and ``t_next`` (position and time where it begins)."""
    at = per_log().orderBy("pos")
    rows = step_rows(log).withColumn("point", F.coalesce(F.abs("dsp") >= F.col("threshold"), F.lit(False)))
    before = F.last(F.when(F.col("point"), F.col("timestamp")), ignorenulls=True).over(up_to(at, -1))
    rows = rows.withColumn("new", F.col("point") & F.coalesce(F.col("timestamp") - before > MERGE_S, F.lit(True)))
    rows = rows.withColumn("group", F.sum(F.col("new").cast("long")).over(up_to(at)))
    own = lambda f, c: f(F.when(F.col("point"), F.col(c))).over(per_group())
    rows = rows.withColumn("first", own(F.min, "pos")).withColumn("last", own(F.max, "pos")).withColumn("t_first", own(F.min, "timestamp")).withColumn("t_last", own(F.max, "timestamp"))
    back = up_to(per_log().orderBy(F.desc("pos")), -1)
    ahead = lambda c: F.last(F.when(F.col("new"), F.col(c)), ignorenulls=True).over(back)
    return rows.withColumn("after", F.coalesce(ahead("pos"), F.col("n"))).withColumn("t_next", ahead("timestamp"))


def plateaus(log: DataFrame) -> DataFrame:
    """Grouped rows with ``initial``, ``final`` and ``amplitude`` of their group where it is a step with stable plateaus on both sides; rows
    of other groups are left out.  Rejected groups still bound their neighbours."""
    rows = grouped_rows(log).withColumn("flat", F.coalesce(F.col("pos") >= F.col("last"), F.lit(True)))
    side = Window.partitionBy("log_id", "group", "flat")
    behind, ahead = F.col("timestamp") <= F.col("t_last") + WINDOW_S, F.col("timestamp") >= F.col("t_next") - WINDOW_S
    rows = rows.withColumn("n_flat", F.count("*").over(side))

    def chosen(near: Column, order: Column) -> Column:
        """The rows within the time window if they are enough, else the nearest ones."""
        enough = F.sum(near.cast("long")).over(side) >= NEAREST
        return F.col("flat") & (F.col("n_flat") >= NEAREST) & F.when(enough, near).otherwise(F.row_number().over(side.orderBy(order)) <= NEAREST)

    rows = rows.withColumn("_behind", chosen(behind, F.asc("pos"))).withColumn("_ahead", chosen(ahead, F.desc("pos")))
    for name in ("_behind", "_ahead"):
        value = F.when(F.col(name), F.col("altitude_setpoint"))
        rows = rows.withColumn(f"{name}_mid", median(value).over(per_group())).withColumn(f"{name}_swing", F.max(value).over(per_group()) - F.min(value).over(per_group()))
    prior = lambda c: F.max(F.when(F.col("new"), F.col(f"_prior{c}"))).over(per_group())
    for c in ("_mid", "_swing"):
        rows = rows.withColumn(f"_prior{c}", F.lag(f"_ahead{c}").over(per_log().orderBy("pos")))
    rows = rows.withColumn("initial", prior("_mid")).withColumn("final", F.col("_behind_mid")).withColumn("amplitude", F.col("final") - F.col("initial"))
    slack = F.greatest(F.lit(FLOOR_M * 0.5), F.abs("amplitude") * 0.02, F.col("noise") * NOISE)
    steady = (prior("_swing") <= slack) & (F.col("_behind_swing") <= slack)
    step = rows.withColumn("_step", (F.col("t_last") - F.col("t_first") <= LONGEST_S) & (F.abs("amplitude") >= F.col("threshold")) & steady).filter("_step")
    return step.select("log_id", "group", "pos", "timestamp", "ekf_altitude", "first", "t_first", "after", "initial", "final", "amplitude")


def step_events(log: DataFrame) -> DataFrame:
    """Rows (log_id, first, t_first, after, initial, final, amplitude) of steps with stable plateaus on both sides."""
    return plateaus(log).filter("pos = first").select("log_id", "first", "t_first", "after", "initial", "final", "amplitude")


def step_responses(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a step: rise and settling time, overshoot, undershoot, and the reason why a time is missing."""
    way, size, step = F.signum("amplitude"), F.abs("amplitude"), per_group().orderBy("pos")
    rows = plateaus(log).withColumn("progress", way * (F.col("ekf_altitude") - F.col("initial"))).withColumn("t0", F.lag("timestamp").over(step)).withColumn("p0", F.lag("progress").over(step))

    def crossing(share: float) -> Column:
        goal = share * size
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(goal - F.col("p0"), F.col("progress") - F.col("p0"))))
        at = F.when(F.col("p0").isNull() | (F.col("progress") <= F.col("p0")), F.col("timestamp")).otherwise(F.col("t0") + part * (F.col("timestamp") - F.col("t0")))
        return F.min_by(F.when(F.col("progress") >= goal, at), F.when(F.col("progress") >= goal, F.col("pos"))).over(per_group())

    rows = rows.withColumn("t10", crossing(0.1)).withColumn("t90", crossing(0.9)).withColumn("t_end", F.max("timestamp").over(per_group()))
    inside = F.abs(F.col("ekf_altitude") - F.col("final")) <= F.greatest(size * settings.settle_fraction, F.lit(settings.settle_floor))
    rows = rows.withColumn("calm", F.coalesce(inside, F.lit(False))).withColumn("run", F.sum((~F.col("calm")).cast("long")).over(up_to(step)))
    run, calm_at = Window.partitionBy("log_id", "group", "run"), F.when(F.col("calm"), F.col("timestamp"))
    rows = rows.withColumn("from_s", F.min(calm_at).over(run)).withColumn("to_s", F.max(calm_at).over(run))
    early = F.when(F.col("timestamp") <= F.coalesce("t10", "t_end"), -F.col("progress"))
    same = lambda c: F.any_value(c).alias(c)
    out = rows.groupBy("log_id", "group").agg(
        *map(same, ("first", "t_first", "initial", "final", "amplitude", "t10", "t90")), F.min(F.when(F.col("to_s") - F.col("from_s") >= settings.dwell_s, F.col("from_s"))).alias("settled_at"),
        F.greatest(F.lit(0.0), F.max(way * (F.col("ekf_altitude") - F.col("final")))).alias("overshoot_m"), F.greatest(F.lit(0.0), F.max(early)).alias("undershoot_m"),
    )
    reason = F.when(F.col("t10").isNull(), "below_10_percent").when(F.col("t90").isNull(), "below_90_percent").when(F.col("settled_at").isNull(), "not_settled")
    return out.select(
        "log_id", F.col("first").cast("long").alias("step_pos"), F.col("t_first").alias("timestamp_s"), F.when(F.col("amplitude") > 0, "up").otherwise("down").alias("direction"),
        F.col("initial").alias("initial_setpoint_m"), F.col("final").alias("final_setpoint_m"), F.col("amplitude").alias("amplitude_m"),
        F.when(F.col("t90") >= F.col("t10"), F.col("t90") - F.col("t10")).alias("rise_time_s"), (F.col("settled_at") - F.col("t_first")).alias("settling_time_s"),
        "overshoot_m", "undershoot_m", reason.alias("reason"),
    )


def step_state(log: DataFrame) -> DataFrame:
    """Rows (log_id, input_reason) of every log: why no step can be looked for (no_timestamp, too_few_rows, times_not_increasing), else null.

    As the logs are as long as they like, the order of times is looked at in pieces.
    """
    if "timestamp" not in log.columns or not {"altitude_setpoint", "ekf_altitude"} <= set(log.columns):
        reason = "no_timestamp" if "timestamp" not in log.columns else "too_few_rows"
        return log.select("log_id").distinct().withColumn("input_reason", F.lit(reason))
    rows = scan(tracking_rows(log).select("log_id", "ord", "timestamp"), by_row(), ("ord",), sums={"_place": F.lit(1)}, priors={"_before": F.col("timestamp")})
    wrong = finite(F.col("timestamp")).isNull() | ((F.col("_place") > 1) & ~F.coalesce(F.col("timestamp") > F.col("_before"), F.lit(False)))
    facts = rows.groupBy("log_id").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"))
    reason = F.when(F.coalesce("n", F.lit(0)) < 5, "too_few_rows").when(F.col("wrong") > 0, "times_not_increasing")
    return log.select("log_id").distinct().join(facts, "log_id", "left").select("log_id", reason.alias("input_reason"))


def step_report(log: DataFrame, settings: Settings = Settings(), responses: DataFrame | None = None) -> DataFrame:
    """One row for every log: its steps in order (``step_responses``, or ``responses`` where they are at hand), the index of the primary one, and why dynamic measures are missing:
    the reason of the input, no_step, or that of the primary step (null: none is missing)."""
    state = step_state(log)
    if not {"timestamp", "altitude_setpoint", "ekf_altitude"} <= set(log.columns):
        return state.select("log_id", F.col("input_reason").alias("dynamic_metrics_reason"), F.lit(None).cast("long").alias("primary_step_index"), F.array().cast(STEP_LIST).alias("step_responses"))
    steps = step_responses(log, settings) if responses is None else responses
    found = steps.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in steps.columns if c != "log_id")))).alias("step_responses"))  # step_pos leads
    found = found.withColumn("_most", F.array_max(F.transform("step_responses", lambda r: F.abs(r["amplitude_m"]))))
    place = F.array_position(F.transform("step_responses", lambda r: F.abs(r["amplitude_m"])), F.col("_most")) - 1  # the first of equals
    found = found.withColumn("primary_step_index", place)
    out = state.join(found, "log_id", "left")
    reason = F.coalesce("input_reason", F.when(F.col("step_responses").isNull(), "no_step").otherwise(F.get("step_responses", F.col("primary_step_index").cast("int"))["reason"]))
    return out.select("log_id", reason.alias("dynamic_metrics_reason"), "primary_step_index", F.coalesce("step_responses", F.array().cast(STEP_LIST)).alias("step_responses"))


#: The type of ``step_responses`` in a report.
STEP_LIST = (
    "array<struct<step_pos:bigint,timestamp_s:double,direction:string,initial_setpoint_m:double,final_setpoint_m:double,amplitude_m:double,rise_time_s:double,settling_time_s:double,"
    "overshoot_m:double,undershoot_m:double,reason:string>>"
)


def primary_step(log: DataFrame, settings: Settings = Settings(), responses: DataFrame | None = None) -> DataFrame:
    """One row a log with steps: the step of largest amplitude, the earliest of equals, with its index among the steps."""
    w = per_log()
    steps = (step_responses(log, settings) if responses is None else responses).withColumn("primary_step_index", F.row_number().over(w.orderBy("step_pos")) - 1).withColumn("n_steps", F.count("*").over(w))
    best = steps.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(F.abs("amplitude_m")), "step_pos"))).filter("_rank = 1")
    return best.select("log_id", F.col("primary_step_index").cast("long").alias("primary_step_index"), "n_steps", "amplitude_m", "rise_time_s", "settling_time_s", "overshoot_m", "undershoot_m", F.col("reason").alias("step_reason"))
