"""Registered queries outside the training-data subpackage: each operator over all logs of ``events``, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import actuator, altitude, catalogue, lag, mapping, profile, segments, spectrum, steps, timing, transform
from .operators.resample import detrended, uniform_grid
from .plans import analysis, explain, oracle
from .plans.oracle import final
from .settings import LagSettings
from .sources.fixture import flight_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zero."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(flight_log(spark, sf_dir)))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def raw_log(log: DataFrame) -> DataFrame:
    """The logs as text columns under names of their own, with gaps and bad values."""
    whole = lambda c: F.round(c).cast("long").cast("string")
    bad = F.when(F.col("ord") % 10 == 0, "").when(F.col("ord") % 17 == 0, "NA").when(F.col("ord") % 13 == 0, "bad")
    return log.select(
        "log_id", "ord", F.col("time_ms").cast("string").alias("time_ms"), whole(F.col("altitude_setpoint") * 100).alias("alt_sp"), whole(F.col("ekf_altitude") * 100).alias("ekf_alt"),
        bad.otherwise(whole(F.col("throttle_correction"))).alias("alt_corr"), F.col("motor_1").cast("long").cast("string").alias("pwm_1"), F.col("motor_2").cast("long").cast("string").alias("pwm_2"),
        F.when(F.col("armed"), "true").otherwise("false").alias("is_armed"), F.when(F.col("althold_active"), "1").otherwise("0").alias("alt_hold"), F.when(F.col("althold_active"), "cruise").otherwise("fault").alias("note"),
    )


RAW_PROFILE = mapping.Profile(
    {
        "timestamp": mapping.Mapping("time_ms"), "altitude_setpoint": mapping.Mapping("alt_sp", "centimeters"), "ekf_altitude": mapping.Mapping("ekf_alt", "centimeters", scale=2.0, offset=1.0, invert_sign=True),
        "throttle_correction": mapping.Mapping("alt_corr", "us"), "motor_1": mapping.Mapping("pwm_1", "us"), "armed": mapping.Mapping("is_armed", "boolean"), "althold_active": mapping.Mapping("alt_hold", "boolean"),
    }
)


@query(final(oracle.PROFILE, "prof", 'log_id position "column" type n n_distinct first_values', "missing_ratio minimum maximum mean std"))
def b2_column_profile(log: DataFrame) -> DataFrame:
    return profile.profile_columns(raw_log(log)).withColumn("first_values", F.array_join("first_values", "|", "null")).drop("zero_one")


@query()
def c9_mapping_candidates(log: DataFrame) -> DataFrame:
    facts = profile.profile_columns(raw_log(log)).select("log_id", "position", "column", "type", "minimum", "maximum", "zero_one")
    return mapping.candidates(facts).select("log_id", "parameter", "column", "confidence", "status")


@query(final(oracle.RAW + r""",
tr AS (SELECT log_id, ord, time_ms::DOUBLE * 0.001::DOUBLE AS timestamp, alt_sp::DOUBLE * 0.01::DOUBLE AS altitude_setpoint, (-1.0::DOUBLE * ekf_alt::DOUBLE * 2.0::DOUBLE + 1.0::DOUBLE) * 0.01::DOUBLE AS ekf_altitude,
  CASE WHEN regexp_full_match(alt_corr, '[+-]?\d+') THEN alt_corr::DOUBLE END AS throttle_correction, pwm_1::DOUBLE AS motor_1, is_armed = 'true' AS armed, alt_hold = '1' AS althold_active FROM raw)""", "tr", "log_id ord armed althold_active", "timestamp altitude_setpoint ekf_altitude throttle_correction motor_1"))
def d1_transform(log: DataFrame) -> DataFrame:
    return transform.transform(raw_log(log), RAW_PROFILE)[0]


@query(final(oracle.RAW + ", f AS (SELECT log_id, 'throttle_correction' AS parameter, count(*) AS n FROM raw WHERE alt_corr = 'bad' GROUP BY log_id)", "f", "log_id parameter n"))
def d3_conversion_failures(log: DataFrame) -> DataFrame:
    return transform.conversion_failures(raw_log(log), RAW_PROFILE)


@query(final("""
t0 AS (SELECT DISTINCT log_id, time_ms::DOUBLE AS t FROM flight_log), t1 AS (SELECT *, t - lag(t) OVER (PARTITION BY log_id ORDER BY t) AS step FROM t0),
t2 AS (SELECT log_id, count(*) AS n_distinct, median(step) FILTER (step > 0) AS step, max(t) - min(t) AS span FROM t1 GROUP BY log_id),
t3 AS (SELECT log_id, n_distinct, list_filter([CASE WHEN 1 / step BETWEEN 0.2 AND 2000 AND span > 0 AND span <= 172800 THEN 'seconds' END, CASE WHEN 1 / (step * 0.001::DOUBLE) BETWEEN 0.2 AND 2000 AND span > 0 AND span * 0.001::DOUBLE <= 172800 THEN 'milliseconds' END,
  CASE WHEN 1 / (step * 0.000001::DOUBLE) BETWEEN 0.2 AND 2000 AND span > 0 AND span * 0.000001::DOUBLE <= 172800 THEN 'microseconds' END], lambda x: x IS NOT NULL) AS units FROM t2),
t4 AS (SELECT log_id, CASE WHEN len(units) = 1 AND n_distinct >= 2 THEN units[1] END AS unit, CASE WHEN n_distinct < 2 THEN 0.0 WHEN len(units) = 1 AND n_distinct >= 3 THEN 0.85 WHEN len(units) = 1 THEN 0.6 WHEN len(units) > 1 THEN 0.4 ELSE 0.2 END::DOUBLE AS confidence, n_distinct, len(units)::BIGINT AS n_units FROM t3)""", "t4", "log_id unit n_distinct n_units", "confidence"))
def d9_time_unit(log: DataFrame) -> DataFrame:
    return transform.infer_time_unit(log.select("log_id", F.col("time_ms").cast("double").alias("timestamp")))


@query(final("""
u0 AS (SELECT log_id, CASE log_id % 3 WHEN 0 THEN time_ms::DOUBLE WHEN 1 THEN time_ms::DOUBLE * 1000 ELSE ord::DOUBLE END AS raw FROM flight_log),
u1 AS (SELECT *, raw - lag(raw) OVER (PARTITION BY log_id ORDER BY raw) AS step FROM (SELECT DISTINCT log_id, raw FROM u0)),
u2 AS (SELECT log_id, count(*) AS n_distinct, median(step) FILTER (step > 0) AS step, max(raw) - min(raw) AS span FROM u1 GROUP BY log_id),
u3 AS (SELECT log_id, n_distinct, list_filter([CASE WHEN 1 / step BETWEEN 0.2 AND 2000 AND span > 0 AND span <= 172800 THEN 1.0::DOUBLE END, CASE WHEN 1 / (step * 0.001::DOUBLE) BETWEEN 0.2 AND 2000 AND span > 0 AND span * 0.001::DOUBLE <= 172800 THEN 0.001::DOUBLE END,
  CASE WHEN 1 / (step * 0.000001::DOUBLE) BETWEEN 0.2 AND 2000 AND span > 0 AND span * 0.000001::DOUBLE <= 172800 THEN 0.000001::DOUBLE END], lambda x: x IS NOT NULL) AS units FROM u2),
u4 AS (SELECT u.log_id, CASE WHEN len(units) = 1 AND n_distinct >= 3 THEN raw * units[1] END AS time, CASE WHEN len(units) = 1 AND n_distinct >= 3 THEN NULL WHEN n_distinct < 2 THEN 'too_few_times' WHEN len(units) > 1 THEN 'several_units_fit' WHEN len(units) = 0 THEN 'no_unit_fits' ELSE 'low_confidence' END AS reason FROM u0 u JOIN u3 USING (log_id)),
u5 AS (SELECT log_id, reason, count(*) AS n, min(time) AS start_s, max(time) AS end_s FROM u4 GROUP BY log_id, reason)""", "u5", "log_id reason n", "start_s end_s"))
def d10_units_of_logs(log: DataFrame) -> DataFrame:
    """Logs in milliseconds, microseconds and row numbers together: each is converted by its own unit or refused with the reason."""
    clock = F.when(F.col("log_id") % 3 == 0, F.col("time_ms")).when(F.col("log_id") % 3 == 1, F.col("time_ms") * 1000).otherwise(F.col("ord"))
    raw = log.select("log_id", "ord", clock.cast("string").alias("clock"))
    good, refused, _ = transform.transform_each(raw, mapping.Profile({"timestamp": mapping.Mapping("clock")}))
    done = good.groupBy("log_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("start_s"), F.max("timestamp").alias("end_s"))
    left = refused.join(raw, "log_id").groupBy("log_id", "reason").agg(F.count("*").alias("n"))
    return done.unionByName(left, allowMissingColumns=True).select("log_id", "reason", "n", "start_s", "end_s")


@query(final(oracle.SEGMENTS, "segments", "log_id kind segment rows start_index end_index", "start_s end_s"))
def e1_segments(log: DataFrame) -> DataFrame:
    return segments.detect_segments(log)


@query(final("w AS (SELECT log_id, ord, timestamp FROM flight_log WHERE timestamp BETWEEN 0.5::DOUBLE AND 2.0::DOUBLE)", "w", "log_id ord", "timestamp"))
def e3_time_range(log: DataFrame) -> DataFrame:
    return segments.select_time_range(log, F.lit(2.0), F.lit(0.5)).select("log_id", "ord", "timestamp")


@query(final(oracle.SEGMENTS + ", pick AS (SELECT f.log_id, 'altitude_hold' AS phase, count(*) AS rows, min(f.timestamp) AS start_s, max(f.timestamp) AS end_s FROM flight_log f JOIN segments s ON f.log_id = s.log_id AND s.kind = 'althold' AND s.segment = 1 AND f.timestamp BETWEEN least(s.start_s, s.end_s) AND greatest(s.start_s, s.end_s) GROUP BY f.log_id)", "pick", "log_id phase rows", "start_s end_s"))
def e4_segment_selection(log: DataFrame) -> DataFrame:
    return segments.select_segment(log).groupBy("log_id", "phase").agg(F.count("*").alias("rows"), F.min("timestamp").alias("start_s"), F.max("timestamp").alias("end_s"))


@query(final(oracle.STEPS_OF_TIME + """,
fx AS (SELECT log_id, count(*) AS rows, count(*) FILTER (timestamp IS NULL) AS nulls, bool_or(armed) AS a, bool_or(althold_active) AS h FROM flight_log GROUP BY log_id), fy AS (SELECT * FROM fx JOIN tm USING (log_id)),
ms AS (SELECT log_id, 'warning' AS severity, 'short_log' AS code, rows AS n FROM fy WHERE rows < 20 UNION ALL SELECT log_id, 'error', 'invalid_timestamp', nulls FROM fy WHERE nulls > 0
  UNION ALL SELECT log_id, 'warning', 'duplicate_timestamp', n_duplicate FROM fy WHERE n_duplicate > 0 UNION ALL SELECT log_id, 'warning', 'reverse_timestamp', n_reverse FROM fy WHERE n_reverse > 0
  UNION ALL SELECT log_id, 'warning', 'timestamp_gap_spikes', n_dropout FROM fy WHERE n_dropout > 0 UNION ALL SELECT log_id, 'warning', 'no_armed_segment', 1 FROM fy WHERE NOT a UNION ALL SELECT log_id, 'warning', 'no_althold_active_segment', 1 FROM fy WHERE NOT h)""", "ms", "log_id severity code n"))
def e5_validation(log: DataFrame) -> DataFrame:
    return segments.validate(log)


@query(final("""rw AS (SELECT log_id, ord, CASE WHEN ord % 31 = 0 THEN NULL ELSE (time_ms // 80 * 80 - CASE WHEN ord % 23 = 0 THEN 1000 ELSE 0 END)::DOUBLE * 0.001::DOUBLE END AS t, CASE WHEN ord % 29 = 0 THEN 'inf' WHEN ord % 7 = 0 THEN NULL ELSE 'x' END AS ref, event_kind FROM (SELECT *, CASE WHEN althold_active THEN 'cruise' ELSE 'fault' END AS event_kind FROM flight_log)),
st AS (SELECT log_id, t, t - lag(t) OVER (PARTITION BY log_id ORDER BY t) AS step FROM (SELECT DISTINCT log_id, t FROM rw WHERE t IS NOT NULL)), md AS (SELECT log_id, median(step) AS m FROM st WHERE step > 0 GROUP BY log_id),
sp AS (SELECT log_id, count(*) AS n FROM st JOIN md USING (log_id) WHERE step > 3 * m GROUP BY log_id),
fa AS (SELECT log_id, count(*) AS rows, count(*) FILTER (t IS NULL) AS no_time, count(*) - count(DISTINCT t) - max((t IS NULL)::INT) AS dup, count(*) FILTER (back) AS rev, count(*) FILTER (ref = 'inf') AS inf, count(*) FILTER (ref IS NULL) AS no_ref, (count(DISTINCT event_kind) <= 1)::INT + (count(DISTINCT t) <= 1)::INT + (count(DISTINCT CASE WHEN ref = 'inf' THEN ref WHEN ref = 'x' THEN ord::VARCHAR END) <= 1)::INT + 1 AS constant
  FROM (SELECT *, t < lag(t) OVER (PARTITION BY log_id ORDER BY ord) AS back FROM rw) GROUP BY log_id),
va AS (
  SELECT 'whole' AS variant, log_id, 'error' AS severity, 'duplicate_columns' AS code, 1 AS n FROM fa UNION ALL SELECT 'whole', log_id, 'warning', 'short_log', rows FROM fa WHERE rows < 20 UNION ALL SELECT 'whole', log_id, 'warning', 'constant_columns', constant FROM fa
  UNION ALL SELECT 'whole', log_id, 'warning', 'missing_values', no_time + no_ref FROM fa WHERE no_time + no_ref > 0 UNION ALL SELECT 'whole', log_id, 'error', 'invalid_timestamp', no_time FROM fa WHERE no_time > 0 UNION ALL SELECT 'whole', log_id, 'warning', 'duplicate_timestamp', dup FROM fa WHERE dup > 0
  UNION ALL SELECT 'whole', log_id, 'warning', 'reverse_timestamp', rev FROM fa WHERE rev > 0 UNION ALL SELECT 'whole', log_id, 'warning', 'timestamp_gap_spikes', n FROM sp UNION ALL SELECT 'whole', log_id, 'warning', 'infinite_values', inf FROM fa WHERE inf > 0
  UNION ALL SELECT 'whole', log_id, 'error', 'missing_ekf', 1 FROM fa UNION ALL SELECT 'whole', log_id, 'info', 'missing_motors', 1 FROM fa UNION ALL SELECT 'whole', -1 - log_id, 'error', 'empty_csv', 0 FROM fa
  UNION ALL SELECT 'bare', log_id, 'warning', 'short_log', rows FROM fa WHERE rows < 20 UNION ALL SELECT 'bare', log_id, s, c, 1 FROM fa, (VALUES ('error', 'missing_timestamp'), ('error', 'missing_ekf'), ('warning', 'missing_reference_altitude'), ('info', 'missing_motors'), ('warning', 'no_armed_segment'), ('warning', 'no_althold_active_segment')) v(s, c))""", "va", "variant log_id severity code n"))
def e5_file_validation(log: DataFrame) -> DataFrame:
    """Every code: logs as texts with gaps and infinities and logs that lack most columns, and ids without rows."""
    time = F.floor(F.col("time_ms") / 80) * 80 - F.when(F.col("ord") % 23 == 0, 1000).otherwise(0)
    raw = log.select(
        "log_id", "ord", F.lit("abc").alias("file_hash"), F.when(F.col("ord") % 31 == 0, F.lit("NA")).otherwise(time.cast("string")).alias("time_ms"),
        F.when(F.col("ord") % 29 == 0, "inf").when(F.col("ord") % 7 == 0, "").otherwise(F.col("ord").cast("string")).alias("baro"), F.when(F.col("althold_active"), "cruise").otherwise("fault").alias("note"), F.lit("A").alias("site"),
    )
    read = transform.transform(raw, mapping.Profile({"timestamp": mapping.Mapping("time_ms", "milliseconds"), "reference_altitude": mapping.Mapping("baro")}))[0]
    whole = segments.validate(read, raw=raw, duplicate_columns=("note",), expected=log.select("log_id").union(log.select(-1 - F.col("log_id"))))
    bare = segments.validate(log.select("log_id", "ord", F.lit(False).alias("armed"), F.lit(None).cast("boolean").alias("althold_active")))
    return whole.withColumn("variant", F.lit("whole")).union(bare.withColumn("variant", F.lit("bare"))).select("variant", "log_id", "severity", "code", "n")


@query(final("c AS (SELECT log_id, ord, timestamp, event_second FROM (SELECT log_id, ord, timestamp, ord // 2 AS event_second, row_number() OVER (PARTITION BY log_id, ord // 2 ORDER BY ord) AS nth FROM flight_log) WHERE nth = 1), d AS (SELECT c.log_id, c.ord, c.event_second::DOUBLE AS timestamp, g.n - g.m AS n_duplicate, 0::BIGINT AS n_reverse FROM c JOIN (SELECT log_id, count(*) AS n, count(DISTINCT ord // 2) AS m FROM flight_log GROUP BY log_id) g USING (log_id))", "d", "log_id ord n_duplicate n_reverse", "timestamp"))
def e6_unique_time(log: DataFrame) -> DataFrame:
    halved = log.select("log_id", "ord", F.floor(F.col("ord") / 2).cast("double").alias("timestamp"))
    return segments.sorted_unique_time(halved).select("log_id", "ord", "timestamp", "n_duplicate", "n_reverse")


@query(final(oracle.STEPS_OF_TIME, "tm", "log_id available n_duplicate n_reverse n_dropout", "mean_s median_s std_s frequency_hz jitter duration_s"))
def f1_timing(log: DataFrame) -> DataFrame:
    return timing.analyze_timing(log, log)


@query(final(oracle.STEPS_OF_TIME, "dr", "log_id", "start_s end_s gap_s"))
def f6_dropouts(log: DataFrame) -> DataFrame:
    return timing.dropouts(log)


@query(final(oracle.STEPS_OF_TIME + ", v AS (SELECT log_id, count(*) AS n, array_to_string(list(round(interval * 1000)::BIGINT ORDER BY timestamp), ',') AS intervals_ms FROM iv GROUP BY log_id)", "v", "log_id n intervals_ms"))
def f7_intervals(log: DataFrame) -> DataFrame:
    return timing.interval_vectors(log).select("log_id", F.size("intervals").cast("long").alias("n"), F.array_join(F.transform("intervals", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("intervals_ms"))


@query(final(f"{oracle.TRACK}, {oracle.G1}", "g1", "log_id n", "rmse_m mae_m mean_error_m error_std_m max_abs_error_m p95_abs_error_m"))
def g1_altitude_error(log: DataFrame) -> DataFrame:
    return altitude.altitude_error(log)


@query(final(f"{oracle.TRACK}, {oracle.G2}", "g2", "log_id", "steady_state_error_m"))
def g2_steady_state(log: DataFrame) -> DataFrame:
    return altitude.steady_state_error(log)


@query(final(oracle.STEPS, "ev", "log_id first after", "t_first initial final amplitude"))
def g4_step_events(log: DataFrame) -> DataFrame:
    return steps.step_events(log).select("log_id", F.col("first").cast("long").alias("first"), F.col("after").cast("long").alias("after"), "t_first", "initial", "final", "amplitude")


@query(final(oracle.STEPS, "sr_", "log_id step_pos direction reason", "timestamp_s initial_setpoint_m final_setpoint_m amplitude_m rise_time_s settling_time_s overshoot_m undershoot_m"))
def g11_step_responses(log: DataFrame) -> DataFrame:
    return steps.step_responses(log)


@query(final(oracle.STEPS, "pm", "log_id primary_step_index n_steps step_reason", "amplitude_m rise_time_s settling_time_s overshoot_m undershoot_m"))
def g14_primary_step(log: DataFrame) -> DataFrame:
    return steps.primary_step(log)


@query(final(oracle.ACTUATOR, "act", "log_id available", "mean_base_throttle_pwm mean_throttle_correction_pwm correction_std_pwm correction_saturation_ratio positive_saturation_ratio negative_saturation_ratio mean_motor_spread_pwm max_continuous_saturation_s max_motor_std_pwm max_motor_saturation_ratio"))
def h1_actuators(log: DataFrame) -> DataFrame:
    return actuator.analyze_actuators(log)


@query(final(oracle.ACTUATOR, "mm", "log_id motor", "mean_pwm std_pwm saturation_ratio"))
def h5_motors(log: DataFrame) -> DataFrame:
    return actuator.motor_metrics(log)


@query(final(oracle.SENSOR, "sn", "log_id n", "reference_mean_m ekf_mean_m reference_std_m ekf_std_m bias_m difference_std_m correlation motor_error_correlation correction_step_correlation"))
def i1_sensor_statistics(log: DataFrame) -> DataFrame:
    return lag.sensor_statistics(log)


@query(final(oracle.LAG, "lg_d", "log_id k", "t ref ekf"))
def i6_uniform_grid(log: DataFrame) -> DataFrame:
    """The longest stretch of every log on its grid, detrended."""
    samples, facts = lag.prepared(log, LagSettings())
    enough = facts.filter("n_original >= 20 AND n_times >= 20 AND n_grid >= 20").select("log_id")
    return detrended(uniform_grid(samples.join(enough, "log_id"), "n_grid", ("ref", "ekf")), ("ref", "ekf")).select("log_id", "k", "t", "ref", "ekf")


@query(final(oracle.LAG, "lr", "log_id lag n", "r"))
def i10_lag_correlations(log: DataFrame) -> DataFrame:
    return lag.lag_correlations(log)[0]


@query(final(oracle.LAG_BEST, "lagx", "log_id interpolated caveat reliable confidence reason at_boundary overlap sign_mismatch n_original n_grid gap_excluded n_duplicate reordered", "estimated_lag_s max_correlation search_limit_s second_best peak_separation dt"))
def i14_lag_analysis(log: DataFrame) -> DataFrame:
    return lag.lag_analysis(log)


@query(final(oracle.SPECTRUM, "sp", "log_id j", "frequency_hz power"))
def j3_power_spectrum(log: DataFrame) -> DataFrame:
    return spectrum.power_spectrum(log)


@query(final(oracle.SPECTRUM, "sp", "log_id j", "frequency_hz power"))
def j3_dft_spectrum(log: DataFrame) -> DataFrame:
    return spectrum.dft_power(log)


@query(final(oracle.SPECTRUM, "pk", "log_id rank", "frequency_hz power ratio total_power"))
def j4_spectral_peaks(log: DataFrame) -> DataFrame:
    return spectrum.spectral_peaks(spectrum.power_spectrum(log))


@query(final(oracle.SPECTRUM, "fq", "log_id irregular n_grid available", "dominant_frequency_hz peak_ratio total_power nyquist_hz min_frequency_hz"))
def j6_frequency(log: DataFrame) -> DataFrame:
    return spectrum.analyze_frequency(log)


@query(final(oracle.HYPOTHESIS_SQL, "hr", "log_id rank hypothesis score n_met n_unmet"))
def l14_hypotheses(log: DataFrame) -> DataFrame:
    return analysis.diagnose(log, log).select("log_id", "rank", "hypothesis", "score", "n_met", "n_unmet")


@query()
def m1_documents(log: DataFrame) -> DataFrame:
    chosen = segments.select_segment(log)
    return analysis.documents(log, chosen, messages=segments.validate(log))


_DOCUMENT_SQL = oracle.HYPOTHESIS_SQL + """,
er AS (SELECT log_id, ord, timestamp, timestamp - lag(timestamp) OVER (PARTITION BY log_id ORDER BY ord) AS dt FROM flight_log),
es AS (SELECT log_id, count(*) AS rows, min(dt) AS least, min(timestamp) AS start_s, max(timestamp) AS end_s FROM er GROUP BY log_id),
dl AS (SELECT hr.log_id, string_agg(hypothesis || '=' || score, ' ' ORDER BY rank) AS hypotheses FROM hr GROUP BY hr.log_id),
do_ AS (SELECT es.log_id, 'custom' AS phase, 'other' AS source, rows, coalesce(tm.n_dropout, 0)::BIGINT AS n_dropouts, coalesce(pm.n_steps, 0)::BIGINT AS n_steps, pm.primary_step_index::BIGINT AS primary_step_index,
  CASE WHEN rows < 5 THEN 'too_few_rows' WHEN least <= 0 THEN 'times_not_increasing' WHEN pm.log_id IS NULL THEN 'no_step' ELSE pm.step_reason END AS reason, 4::BIGINT AS n_motors, dl.hypotheses,
  g1.rmse_m IS NOT NULL AS altitude_available, fq.dominant_frequency_hz IS NOT NULL AS frequency_available, start_s, end_s, g1.rmse_m, pm.settling_time_s, act.mean_throttle_correction_pwm, act.correction_saturation_ratio, fq.dominant_frequency_hz, sn.bias_m
  FROM es LEFT JOIN tm USING (log_id) LEFT JOIN pm USING (log_id) LEFT JOIN dl USING (log_id) LEFT JOIN g1 USING (log_id) LEFT JOIN act USING (log_id) LEFT JOIN sn USING (log_id) LEFT JOIN fq USING (log_id))"""


@query(final(_DOCUMENT_SQL, "do_", "log_id phase source rows n_dropouts n_steps primary_step_index reason n_motors hypotheses altitude_available frequency_available", "start_s end_s rmse_m settling_time_s"))
def m1_sections(log: DataFrame) -> DataFrame:
    """The documents of whole logs, read back: states, lists and reasons of every section."""
    kind = (
        "struct<flight_phase:string,reference_altitude_source:string,analysis_window:struct<start_s:double,end_s:double,rows:bigint>,rule_based_hypotheses:array<struct<hypothesis:string,score:bigint>>,metrics:struct<timing:struct<dropouts:array<struct<gap_s:double>>>,"
        "altitude:struct<available:boolean,rmse_m:double,settling_time_s:double,primary_step_index:bigint,dynamic_metrics_reason:string,step_responses:array<struct<step_pos:bigint>>>,actuator:struct<motors:array<struct<motor:string>>>,frequency:struct<available:boolean>>>"
    )
    read = analysis.documents(log, log).select("log_id", F.from_json("document", kind).alias("d")).select("log_id", "d.*")
    ranked = F.array_join(F.transform("rule_based_hypotheses", lambda h: F.concat(h.hypothesis, F.lit("="), h.score.cast("string"))), " ")
    size = lambda c: F.size(c).cast("long")
    return read.select(
        "log_id", F.col("flight_phase").alias("phase"), F.col("reference_altitude_source").alias("source"), "analysis_window.rows", size("metrics.timing.dropouts").alias("n_dropouts"), size("metrics.altitude.step_responses").alias("n_steps"),
        "metrics.altitude.primary_step_index", F.col("metrics.altitude.dynamic_metrics_reason").alias("reason"), size("metrics.actuator.motors").alias("n_motors"), ranked.alias("hypotheses"), F.col("metrics.altitude.available").alias("altitude_available"),
        F.col("metrics.frequency.available").alias("frequency_available"), "analysis_window.start_s", "analysis_window.end_s", "metrics.altitude.rmse_m", "metrics.altitude.settling_time_s",
    )


@query(final(_DOCUMENT_SQL, "do_", "log_id phase source rows hypotheses", "rmse_m mean_throttle_correction_pwm correction_saturation_ratio dominant_frequency_hz bias_m"))
def m3_features(log: DataFrame) -> DataFrame:
    """The payloads of whole logs, read back."""
    kind = (
        "struct<flight_phase:string,reference_altitude_source:string,analysis_window:struct<row_count:bigint>,rule_based_hypotheses:array<struct<hypothesis:string,score:bigint>>,features:struct<altitude_rmse_m:double,mean_throttle_correction_pwm:double,correction_saturation_ratio:double,"
        "dominant_frequency_hz:double,reference_ekf_bias_m:double>>"
    )
    read = analysis.summary_payload(log, log, language="English").select("log_id", F.from_json("payload", kind).alias("d")).select("log_id", "d.*")
    ranked = F.array_join(F.transform("rule_based_hypotheses", lambda h: F.concat(h.hypothesis, F.lit("="), h.score.cast("string"))), " ")
    own = ("features.mean_throttle_correction_pwm", "features.correction_saturation_ratio", "features.dominant_frequency_hz")
    return read.select("log_id", F.col("flight_phase").alias("phase"), F.col("reference_altitude_source").alias("source"), F.col("analysis_window.row_count").alias("rows"), ranked.alias("hypotheses"), F.col("features.altitude_rmse_m").alias("rmse_m"), *own, F.col("features.reference_ekf_bias_m").alias("bias_m"))


def _every_table(sql: str):
    """Registers a query that reads other tables than ``events``."""

    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


_ANSWER_SQL = """
t AS (SELECT conv_id, turn, (conv_id * 7 + turn * 3) % 9 AS k, '{"summary":"' || role || '","hypothesis_review":[{"hypothesis_id":"h' || turn || '","priority":' || (turn + 1) || ',"explanation":"e","supporting_evidence":["a"],"counter_evidence":[],"uncertainties":[]}],"additional_hypotheses":[],"recommended_experiments":[],"missing_data_requests":["x"]}' AS base FROM conversations),
a AS (SELECT conv_id, turn, CASE k WHEN 1 THEN replace(base, '{"summary"', '{"extra":1,"summary"') WHEN 2 THEN replace(base, '"additional_hypotheses":[],', '') WHEN 3 THEN replace(base, '"additional_hypotheses":[]', '"additional_hypotheses":"x"') WHEN 4 THEN replace(base, '"explanation":"e"', '"explanation":"e","more":[]')
  WHEN 5 THEN substring(base, 1, length(base) - 1) WHEN 6 THEN replace(base, '["x"]', '["x",7]') WHEN 7 THEN replace(base, '"priority":', '"priority":-') WHEN 8 THEN replace(base, '"uncertainties":[]', '"uncertainties":null') ELSE base END AS answer FROM t)"""


@_every_table("WITH" + _ANSWER_SQL + """,
b AS (SELECT conv_id, turn, CASE WHEN json_valid(answer) THEN answer END AS j FROM a),
f AS (
  SELECT conv_id, turn, '$:not_json' AS fault FROM b WHERE j IS NULL
  UNION ALL SELECT conv_id, turn, '$.' || k || ':unknown_key' FROM (SELECT *, unnest(json_keys(j)) AS k FROM b WHERE j IS NOT NULL) WHERE k NOT IN ('summary', 'hypothesis_review', 'additional_hypotheses', 'recommended_experiments', 'missing_data_requests')
  UNION ALL SELECT conv_id, turn, '$.' || k || ':missing_key' FROM b, (VALUES ('summary'), ('hypothesis_review'), ('additional_hypotheses'), ('recommended_experiments'), ('missing_data_requests')) v(k) WHERE j IS NOT NULL AND NOT list_contains(json_keys(j), k)
  UNION ALL SELECT conv_id, turn, '$.' || k || ':wrong_type' FROM b, (VALUES ('summary', 'VARCHAR'), ('hypothesis_review', 'ARRAY'), ('additional_hypotheses', 'ARRAY'), ('recommended_experiments', 'ARRAY'), ('missing_data_requests', 'ARRAY')) v(k, kind) WHERE j IS NOT NULL AND list_contains(json_keys(j), k) AND json_type(j, '$.' || k) <> kind
  UNION ALL SELECT conv_id, turn, '$.missing_data_requests[' || i || ']:wrong_type' FROM (SELECT *, unnest(range(json_array_length(j, '$.missing_data_requests')::BIGINT)) AS i FROM b WHERE j IS NOT NULL) WHERE json_type(j, '$.missing_data_requests[' || i || ']') <> 'VARCHAR'
  UNION ALL SELECT conv_id, turn, '$.hypothesis_review[0].' || k || ':unknown_key' FROM (SELECT *, unnest(json_keys(j, '$.hypothesis_review[0]')) AS k FROM b WHERE j IS NOT NULL) WHERE k NOT IN ('hypothesis_id', 'priority', 'explanation', 'supporting_evidence', 'counter_evidence', 'uncertainties')
  UNION ALL SELECT conv_id, turn, '$.hypothesis_review[0].uncertainties:wrong_type' FROM b WHERE json_type(j, '$.hypothesis_review[0].uncertainties') <> 'ARRAY'
  UNION ALL SELECT conv_id, turn, '$.hypothesis_review[0].priority:below_one' FROM b WHERE (j->>'$.hypothesis_review[0].priority')::BIGINT < 1),
g AS (SELECT conv_id, turn, string_agg(fault, ' ' ORDER BY fault) AS faults, count(*) AS n FROM f GROUP BY conv_id, turn)
SELECT b.conv_id, b.turn, coalesce(g.n, 0)::BIGINT AS n_faults, coalesce(g.faults, '') AS faults, CASE WHEN g.n IS NULL THEN (j->>'$.hypothesis_review[0].priority')::BIGINT END AS priority FROM b LEFT JOIN g USING (conv_id, turn)""")
def m10_strict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from every turn, most with one fault: good ones are typed, bad ones reported."""
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    checked = explain.strict(spark.sql("WITH" + _ANSWER_SQL + " SELECT * FROM a"))
    said = F.array_join(F.array_sort(F.transform("faults", lambda f: F.concat_ws(":", f.path, f.code))), " ")
    return checked.select("conv_id", "turn", F.size("faults").cast("long").alias("n_faults"), said.alias("faults"), F.col("parsed.hypothesis_review")[0]["priority"].alias("priority"))


_NAMES = ("time", "alt_sp", "alt_est", "baro", "pwm_1", "pwm_2", "armed", "hold")


@query(final("""
cn AS (SELECT log_id, position, "column" FROM (SELECT DISTINCT log_id FROM flight_log), (VALUES """ + ", ".join(f"({k}, '{n}')" for k, n in enumerate(_NAMES)) + """) v(position, "column") WHERE (log_id // 3 + position) % 5 <> 0 UNION ALL SELECT DISTINCT log_id, 99, 'extra_' || (log_id % 6) FROM flight_log),
hd AS (SELECT log_id, list("column" ORDER BY position) AS held FROM cn GROUP BY log_id),
pf AS (SELECT 'p' || log_id AS profile, (SELECT held FROM hd h WHERE h.log_id = l.log_id) AS saved_for, list_filter(['time', 'alt_est', CASE WHEN log_id % 2 = 0 THEN 'baro' END, CASE WHEN log_id % 3 = 0 THEN 'pwm_2' END, CASE WHEN log_id % 5 = 0 THEN 'extra_' || (log_id % 6) END], lambda x: x IS NOT NULL) AS wanted FROM (SELECT DISTINCT log_id FROM flight_log) l),
mt AS (SELECT h.log_id, profile, saved_for = held AS exact, len(wanted) AS n_columns, list_sort(list_filter(wanted, lambda x: NOT list_contains(held, x))) AS missing FROM hd h, pf),
mk AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY exact DESC, len(missing), n_columns DESC, profile) AS rank, profile, exact, n_columns, array_to_string(missing, ' ') AS missing FROM mt WHERE len(missing) <= 1 OR exact)""", "mk", "log_id rank profile exact n_columns missing"))
def m16_profile_matches(log: DataFrame) -> DataFrame:
    """Every log against a profile saved for each log: exact headers first, then profiles that lack at most one column."""
    ids = log.select("log_id").distinct()
    named = F.array(*[F.when((F.floor(F.col("log_id") / 3) + k) % 5 != 0, F.struct(F.lit(k).alias("position"), F.lit(n).alias("column"))) for k, n in enumerate(_NAMES)], F.struct(F.lit(99).alias("position"), F.concat(F.lit("extra_"), (F.col("log_id") % 6).cast("string")).alias("column")))
    columns = ids.select("log_id", F.explode(F.filter(named, lambda c: c.isNotNull())).alias("c")).select("log_id", "c.*")
    wanted = F.array(F.lit("time"), F.lit("alt_est"), F.when(F.col("log_id") % 2 == 0, "baro"), F.when(F.col("log_id") % 3 == 0, "pwm_2"), F.when(F.col("log_id") % 5 == 0, F.concat(F.lit("extra_"), (F.col("log_id") % 6).cast("string"))))
    logs = catalogue.headers_of(columns)
    profiles = logs.select(F.concat(F.lit("p"), F.col("log_id").cast("string")).alias("profile"), "header_hash", F.filter(wanted, lambda c: c.isNotNull()).alias("columns"))
    return catalogue.dealt(logs, catalogue.rankings(logs, profiles, lacks=1).withColumn("missing", F.array_join("missing", " ")))


@query()
def m3_payloads(log: DataFrame) -> DataFrame:
    return analysis.summary_payload(log, segments.select_segment(log))
