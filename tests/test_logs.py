"""Log operators on small logs with known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import actuator, altitude, lag, profile, segments, spectrum, steps, timing
from skylattice.plans import analysis, rules
from skylattice.settings import LagSettings, Settings


def log(spark, **columns):
    """One log (id 1) from columns; ``ord`` is the position."""
    n = len(next(iter(columns.values())))
    kinds = {"armed": "boolean", "althold_active": "boolean"}
    rows = [(1, k, *[None if columns[c][k] is None else (bool if c in kinds else float)(columns[c][k]) for c in columns]) for k in range(n)]
    return spark.createDataFrame(rows, "log_id long, ord long, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))


def test_rmse(spark):
    x = altitude.altitude_error(log(spark, altitude_setpoint=[1, 1, 1], ekf_altitude=[0, 1, 2])).first()
    assert x.rmse_m == pytest.approx(math.sqrt(2 / 3)) and x.mae_m == pytest.approx(2 / 3) and x.n == 3
    assert altitude.altitude_error(log(spark, altitude_setpoint=[1, None], ekf_altitude=[0, 1])).count() == 0


def test_steady_state_uses_the_last_rows(spark):
    x = log(spark, altitude_setpoint=[0] * 10, ekf_altitude=[9] * 8 + [1, 3])
    assert altitude.steady_state_error(x).first().steady_state_error_m == -2


def step_log(spark, response, n=31, at=5, rate=10.0):
    t = [k / rate for k in range(n)]
    return log(spark, timestamp=t, altitude_setpoint=[0.0 if k < at else 1.0 for k in range(n)], ekf_altitude=[response(x) for x in t])


def test_step_response(spark):
    """A ramp from 0 to 1 within a second after the step, then a dip over the target."""
    x = steps.step_responses(step_log(spark, lambda t: -0.1 if t == 0.5 else min(1.0, max(0.0, t - 0.5)) if t < 1.5 else 1.1 if t < 1.75 else 1.0)).first()
    assert x.timestamp_s == 0.5 and x.direction == "up" and x.amplitude_m == 1
    assert 0.7 < x.rise_time_s < 0.85 and x.overshoot_m == pytest.approx(0.1) and x.undershoot_m == pytest.approx(0.1)
    assert x.settling_time_s == pytest.approx(1.3) and x.reason is None


def test_step_that_misses(spark):
    x = steps.step_responses(step_log(spark, lambda t: min(0.5, max(0.0, t - 0.5)))).first()
    assert x.reason == "below_90_percent" and x.rise_time_s is None and x.settling_time_s is None


def test_several_steps_and_the_primary(spark):
    level = [0] * 30 + [1] * 30 + [0.5] * 30 + [2] * 31
    x = log(spark, timestamp=[k / 10 for k in range(121)], altitude_setpoint=level, ekf_altitude=level)
    assert [r.amplitude_m for r in steps.step_responses(x).orderBy("step_pos").collect()] == [1, -0.5, 1.5]
    assert steps.primary_step(x).first().primary_step_index == 2
    tie = [0] * 30 + [1] * 20 + [0] * 21
    assert steps.primary_step(log(spark, timestamp=[k / 10 for k in range(71)], altitude_setpoint=tie, ekf_altitude=tie)).first().primary_step_index == 0


def test_ramps_and_bad_times_make_no_step(spark):
    ramp = [min(1, max(0, (k - 10) / 20)) for k in range(51)]
    assert steps.step_responses(log(spark, timestamp=[k / 10 for k in range(51)], altitude_setpoint=ramp, ekf_altitude=ramp)).count() == 0
    level = [0] * 5 + [1] * 6
    assert steps.step_responses(log(spark, timestamp=[0, 1, 2, 3, 3, 5, 6, 7, 8, 9, 10], altitude_setpoint=level, ekf_altitude=level)).count() == 0
    merged = [0] * 5 + [0.5] + [1] * 15
    one = steps.step_events(log(spark, timestamp=[k / 10 for k in range(21)], altitude_setpoint=merged, ekf_altitude=merged)).collect()
    assert len(one) == 1 and one[0].t_first == 0.5 and one[0].amplitude == 1


def test_actuators(spark):
    x = log(spark, timestamp=[0, 1, 2, 3], throttle_correction=[160, 170, -160, 0], motor_1=[1000, 1500, 1500, 2000], motor_2=[1050, 1450, 1550, 1950])
    got = actuator.analyze_actuators(x).first()
    assert got.correction_saturation_ratio == 0.75 and got.positive_saturation_ratio == 0.5 and got.mean_motor_spread_pwm == 50 and got.max_continuous_saturation_s == 2
    assert actuator.saturation_runs(x.drop("timestamp"), samples_without_time=True).first().max_continuous_saturation_s == 3
    assert actuator.saturation_runs(x.drop("timestamp")).first().max_continuous_saturation_s is None
    broken = log(spark, timestamp=[0, 1, 2, 3], throttle_correction=[200, None, 200, 200])
    assert actuator.saturation_runs(broken).first().max_continuous_saturation_s == 1
    only = actuator.analyze_actuators(log(spark, timestamp=[0, 1])).first()
    assert not only.available and only.mean_throttle_correction_pwm is None


def test_timing(spark):
    x = log(spark, timestamp=[0, 0.1, 0.1, 0.05, 1.0, None, None])
    got = timing.analyze_timing(x, x).first()
    assert got.n_duplicate == 2 and got.n_reverse == 1 and got.n_dropout == 1 and got.available
    assert timing.dropouts(x).first().gap_s == pytest.approx(0.9)
    one = timing.analyze_timing(log(spark, timestamp=[1.0]), log(spark, timestamp=[1.0])).first()
    assert not one.available and one.n_dropout is None


def test_segments(spark):
    x = log(spark, timestamp=[0, 1, 2, 3, 4, 5], armed=[0, 1, 1, None, 1, 1], althold_active=[1, 1, 1, 1, 0, 1])
    got = {(r.kind, r.segment, r.start_s, r.end_s, r.rows) for r in segments.detect_segments(x).collect()}
    assert got == {("armed", 1, 1, 2, 2), ("armed", 2, 4, 5, 2), ("althold", 1, 1, 2, 2), ("althold", 2, 5, 5, 1)}
    assert segments.select_segment(x).count() == 2 and segments.select_segment(x, "custom", start_s=4, end_s=2).count() == 3
    assert {r.phase for r in segments.select_segment(x, "full").collect()} == {"full_log"}


def test_validation_codes(spark):
    x = log(spark, timestamp=[0, 1, 1, 0.5, None], ekf_altitude=[1, math.inf, 1, 1, 1], armed=[0, 0, 0, 0, 0])
    codes = {r.code for r in segments.validate(x, duplicate_columns=("t",)).collect()}
    assert codes == {"short_log", "duplicate_columns", "invalid_timestamp", "duplicate_timestamp", "reverse_timestamp", "infinite_values", "missing_reference_altitude", "missing_motors", "no_armed_segment"}
    assert {r.code for r in segments.validate(log(spark, armed=[1] * 30)).collect()} >= {"missing_timestamp", "missing_ekf"}


def test_unique_time(spark):
    got = segments.sorted_unique_time(log(spark, timestamp=[0, 2, 2, 1, None])).orderBy("timestamp").collect()
    assert [r.timestamp for r in got] == [0, 1, 2] and got[0].n_duplicate == 1 and got[0].n_reverse == 1


def rich(t):
    return math.sin(2 * math.pi * 0.4 * t) + 0.5 * math.sin(2 * math.pi * 0.13 * t + 1) + 0.7 * math.exp(-((t - 6) ** 2)) - 0.6 * math.exp(-((t - 14) ** 2) / 2)


def lag_log(spark, shift, jitter=0.0, n=500, sign=1.0):
    rng = np.random.default_rng(1)
    t = [k * 0.04 + (float(rng.normal(0, jitter)) if jitter else 0.0) for k in range(n)]
    return log(spark, timestamp=t, reference_altitude=[sign * rich(x - shift) for x in t], ekf_altitude=[rich(x) for x in t])


@pytest.mark.parametrize("shift,jitter", [(0.0, 0), (0.32, 0), (-0.2, 0), (0.32, 0.004)])
def test_lag_is_found(spark, shift, jitter):
    x = lag.lag_analysis(lag_log(spark, shift, jitter)).first()
    assert abs(x.estimated_lag_s - shift) <= 0.05 and x.reliable and x.confidence == "high"


def test_lag_that_cannot_be_trusted(spark):
    constant = log(spark, timestamp=[k * 0.04 for k in range(100)], reference_altitude=[1.0] * 100, ekf_altitude=[rich(k * 0.04) for k in range(100)])
    assert lag.lag_analysis(constant).first().reason == "flat_signal"
    assert lag.lag_analysis(lag_log(spark, 0.0, n=10)).first().reason == "too_few_samples"
    assert lag.lag_analysis(lag_log(spark, 0.0, sign=-1.0)).first().reason in ("sign_mismatch", "at_boundary")
    periodic = log(spark, timestamp=[k * 0.04 for k in range(500)], reference_altitude=[math.sin(2 * math.pi * k * 0.04) for k in range(500)], ekf_altitude=[math.sin(2 * math.pi * k * 0.04) for k in range(500)])
    assert lag.lag_analysis(periodic).first().reason == "ambiguous"


def test_lag_splits_at_gaps_and_averages_equal_times(spark):
    t = [k * 0.04 + (5.0 if k >= 150 else 0) for k in range(450)]
    x = log(spark, timestamp=[*t, t[3]], reference_altitude=[*(rich(a) for a in t), rich(t[3])], ekf_altitude=[*(rich(a) for a in t), rich(t[3])])
    got = lag.lag_analysis(x).first()
    assert got.gap_excluded and got.n_duplicate == 1 and got.reordered and got.n_grid == 300 and abs(got.estimated_lag_s) < 0.05


def test_sensor_statistics(spark):
    got = lag.sensor_statistics(log(spark, reference_altitude=[1.2, 2.2, 3.2, math.inf], ekf_altitude=[1, 2, 3, 4], throttle_correction=[5, 5, 5, 5])).first()
    assert got.n == 3 and got.bias_m == pytest.approx(0.2) and got.correlation == pytest.approx(1) and got.correction_step_correlation is None


def test_spectrum(spark):
    t = [k / 25 for k in range(1500)]
    x = log(spark, timestamp=t, ekf_altitude=[math.sin(2 * math.pi * 0.3 * a) for a in t])
    got = spectrum.analyze_frequency(x).first()
    assert got.dominant_frequency_hz == pytest.approx(0.3, abs=0.04) and 0 < got.peak_ratio <= 1 and not got.irregular
    assert spectrum.analyze_frequency(log(spark, timestamp=t[:31], ekf_altitude=t[:31])).count() == 0
    short = log(spark, timestamp=t[:400], ekf_altitude=[rich(a) for a in t[:400]])
    a, b = ({r.j: r.power for r in f(short).collect()} for f in (spectrum.power_spectrum, spectrum.dft_power))
    assert a.keys() == b.keys() and all(a[j] == pytest.approx(b[j], rel=1e-6, abs=1e-12) for j in a)


def test_profile(spark):
    rows = [(1, 0, "1", "yes", "x", None), (1, 1, "2.5", "no", "1d", None), (1, 2, "NA", "", "3", None), (1, 3, "inf", "on", "4", None)]
    got = {r.column: r for r in profile.profile_columns(spark.createDataFrame(rows, "log_id long, ord long, a string, b string, c string, d string")).collect()}
    assert [got[c].type for c in "abcd"] == ["numeric", "boolean", "string", "unknown"]
    assert got["a"].maximum == 2.5 and got["a"].missing_ratio == 0.25 and got["a"].first_values == ["1", "2.5", None, "inf"] and got["c"].minimum == 3


def metrics(spark, **values):
    row = {m: values.get(m) for m in rules.METRICS}
    types = ", ".join(f"{m} {'boolean' if m == 'reliable' else 'double'}" for m in rules.METRICS)
    return spark.createDataFrame([(1, *[None if v is None else v if isinstance(v, bool) else float(v) for v in row.values()])], "log_id long, " + types)


def test_rules(spark):
    score = lambda **v: {r.hypothesis: r for r in rules.evaluate(metrics(spark, **v), ("timestamp",)).collect()}
    sure = score(estimated_lag_s=0.3, max_correlation=0.9, reliable=True)["sensor_control_delay"]
    assert sure.score == 65 and [d.delta for d in sure.details] == [50, 15] and sure.missing == ["ekf_altitude", "reference_altitude"]
    assert score(estimated_lag_s=0.3, max_correlation=0.9, reliable=False)["sensor_control_delay"].score == 0
    low = score(mean_throttle_correction_pwm=1, steady_state_error_m=1)["incorrect_hover_pwm"]
    assert low.score == 25 and [d.delta for d in low.details] == [-11, 25]  # kept above 0 before the second rule
    ranked = rules.evaluate(metrics(spark), ()).orderBy("rank").collect()
    assert len(ranked) == 12 and [r.hypothesis for r in ranked] == sorted(r.hypothesis for r in ranked)


def test_documents(spark):
    t = [k * 0.04 for k in range(100)]
    x = log(spark, timestamp=t, altitude_setpoint=[1.0] * 100, ekf_altitude=[rich(a) for a in t], reference_altitude=[rich(a) for a in t], armed=[1] * 100, althold_active=[1] * 100)
    doc = json.loads(analysis.documents(x, segments.select_segment(x), messages=segments.validate(x)).first().document)
    assert doc["schema_version"] == "1.1" and doc["flight_phase"] == "altitude_hold" and doc["analysis_window"]["rows"] == 100
    assert len(doc["rule_based_hypotheses"]) == 12 and doc["metrics"]["actuator"]["max_motor_std_pwm"] is None and "missing_motors" in [m["code"] for m in doc["validation_messages"]]


def test_settings_are_parameters(spark):
    x = log(spark, timestamp=[0, 1, 2], throttle_correction=[50, 60, 0])
    assert actuator.analyze_actuators(x, Settings(correction_limit=50)).first().correction_saturation_ratio == pytest.approx(2 / 3)
    assert lag.lag_analysis(lag_log(spark, 0.32), LagSettings(reach_s=0.2)).first().reason == "at_boundary"
    assert x.filter(F.col("ord") < 0).count() == 0 and timing.analyze_timing(x.limit(0), x.limit(0)).count() == 0


def test_spectrum_of_long_logs(spark):
    t = [k / 25 for k in range(2700)]
    x = log(spark, timestamp=t, ekf_altitude=[math.sin(2 * math.pi * 0.3 * v) + 0.2 * math.cos(9 * v) for v in t])
    grid = np.array([r.x for r in spectrum.error_grid(x).orderBy("k").collect()])
    f, p = spectrum.welch(grid, 25.0)
    for of in (spectrum.power_spectrum, spectrum.dft_power):
        got = of(x).orderBy("j").collect()
        assert [r.frequency_hz for r in got] == pytest.approx(f[1:]) and [r.power for r in got] == pytest.approx(p[1:], abs=1e-9)


def test_logs_without_times_or_flags_have_no_segments(spark):
    from skylattice.operators import segments

    log = spark.createDataFrame([(1, 0, 0.5, True)], "log_id long, ord long, timestamp double, armed boolean")
    for some in (log.drop("timestamp"), log.drop("armed")):
        assert segments.detect_segments(some).count() == 0 and segments.select_segment(some).count() == 0 and "phase" in segments.select_segment(some).columns
