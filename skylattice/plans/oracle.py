"""SQL (DuckDB) for the registered queries, on the same tables.  Doubles are rounded to six places on both sides."""

from __future__ import annotations

from ..settings import MOTORS, Settings
from ..sources.fixture import LOG_SQL
from .rules import HYPOTHESES, RULES, applied

S = Settings()


def final(ctes: str, table: str, plain: str, doubles: str = "") -> str:
    """Close a chain of CTEs with a SELECT of columns as they are and of rounded doubles (without negative zero)."""
    columns = plain.split() + [f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split()]
    return f"WITH {LOG_SQL}{ctes and ','}{ctes} SELECT {', '.join(columns)} FROM {table}"


TRACK = "tr AS (SELECT *, altitude_setpoint - ekf_altitude AS err FROM flight_log WHERE altitude_setpoint IS NOT NULL AND ekf_altitude IS NOT NULL)"
G1 = "g1 AS (SELECT log_id, sqrt(avg(err * err)) AS rmse_m, avg(abs(err)) AS mae_m, avg(err) AS mean_error_m, stddev_pop(err) AS error_std_m, max(abs(err)) AS max_abs_error_m, quantile_cont(abs(err), 0.95) AS p95_abs_error_m, count(*) AS n FROM tr GROUP BY log_id HAVING count(*) >= 2)"
G2 = """g2 AS (SELECT log_id, avg(err) AS steady_state_error_m FROM (
  SELECT log_id, err, row_number() OVER (PARTITION BY log_id ORDER BY ord DESC) AS back, count(*) OVER (PARTITION BY log_id) AS n FROM tr)
  WHERE back <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) GROUP BY log_id)"""
SEGMENTS = """
pos AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ord) - 1 AS pos FROM flight_log),
flags AS (SELECT log_id, pos, timestamp, 'armed' AS kind, coalesce(armed, false) AS flag FROM pos
  UNION ALL SELECT log_id, pos, timestamp, 'althold', coalesce(armed, false) AND coalesce(althold_active, false) FROM pos),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY log_id, kind ORDER BY pos) AS island FROM flags WHERE flag),
runs AS (SELECT log_id, kind, island, arg_min(timestamp, pos) AS start_s, arg_max(timestamp, pos) AS end_s, count(*) AS rows, min(pos) AS start_index, max(pos) AS end_index FROM islands GROUP BY ALL),
segments AS (SELECT *, row_number() OVER (PARTITION BY log_id, kind ORDER BY start_index) AS segment FROM runs)"""
STEPS_OF_TIME = """
times AS (SELECT DISTINCT log_id, timestamp FROM flight_log WHERE timestamp IS NOT NULL),
iv AS (SELECT * FROM (SELECT log_id, timestamp, timestamp - lag(timestamp) OVER (PARTITION BY log_id ORDER BY timestamp) AS interval FROM times) WHERE interval > 0),
us AS (SELECT log_id, avg(interval) AS mean_s, median(interval) AS median_s, stddev_pop(interval) AS std_s, max(timestamp) - min(timestamp - interval) AS duration_s FROM iv GROUP BY log_id),
dr AS (SELECT log_id, timestamp - interval AS start_s, timestamp AS end_s, interval AS gap_s FROM iv JOIN us USING (log_id) WHERE interval > median_s * 3.0::DOUBLE),
oc AS (SELECT log_id, count(*) - count(DISTINCT timestamp) - max((timestamp IS NULL)::BIGINT) AS n_duplicate, coalesce(sum(back), 0)::BIGINT AS n_reverse
  FROM (SELECT *, (timestamp < lag(timestamp) OVER (PARTITION BY log_id ORDER BY ord))::BIGINT AS back FROM flight_log) GROUP BY log_id),
tm AS (SELECT log_id, median_s IS NOT NULL AS available, n_duplicate, n_reverse, mean_s, median_s, std_s, 1.0::DOUBLE / median_s AS frequency_hz, std_s / median_s AS jitter, duration_s,
  CASE WHEN median_s IS NOT NULL THEN coalesce(nd, 0) END AS n_dropout
  FROM oc LEFT JOIN us USING (log_id) LEFT JOIN (SELECT log_id, count(*) AS nd FROM dr GROUP BY log_id) USING (log_id))"""
_MAX, _MIN = f"greatest({', '.join(MOTORS)})", f"least({', '.join(MOTORS)})"
ACTUATOR = f"""
sat AS (SELECT log_id, pos, timestamp, pos - row_number() OVER (PARTITION BY log_id ORDER BY pos) AS island FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ord) AS pos FROM flight_log) WHERE abs(throttle_correction) >= 160),
sr AS (SELECT log_id, max(length) AS length FROM (SELECT log_id, greatest(0.0::DOUBLE, arg_max(timestamp, pos) - arg_min(timestamp, pos)) AS length FROM sat GROUP BY log_id, island) GROUP BY log_id),
ml AS (UNPIVOT (SELECT log_id, {', '.join(MOTORS)} FROM flight_log) ON {', '.join(MOTORS)} INTO NAME motor VALUE pwm),
mm AS (SELECT log_id, motor, avg(pwm) AS mean_pwm, stddev_pop(pwm) AS std_pwm, avg((pwm <= 1000 OR pwm >= 2000)::INT) AS saturation_ratio FROM ml GROUP BY log_id, motor),
ac AS (SELECT log_id, avg(throttle_base) AS mean_base_throttle_pwm, avg(throttle_correction) AS mean_throttle_correction_pwm, stddev_pop(throttle_correction) AS correction_std_pwm,
  avg((abs(throttle_correction) >= 160)::INT) AS correction_saturation_ratio, avg((throttle_correction >= 160)::INT) AS positive_saturation_ratio, avg((throttle_correction <= -160)::INT) AS negative_saturation_ratio,
  avg({_MAX} - {_MIN}) AS mean_motor_spread_pwm FROM flight_log GROUP BY log_id),
act AS (SELECT ac.*, coalesce(length, 0.0::DOUBLE) AS max_continuous_saturation_s, sd AS max_motor_std_pwm, sx AS max_motor_saturation_ratio, true AS available FROM ac LEFT JOIN sr USING (log_id)
  LEFT JOIN (SELECT log_id, max(std_pwm) AS sd, max(saturation_ratio) AS sx FROM mm GROUP BY log_id) USING (log_id))"""
_CORR = lambda x, y: f"CASE WHEN count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) >= 3 AND stddev_pop({x}) FILTER ({y} IS NOT NULL) * stddev_pop({y}) FILTER ({x} IS NOT NULL) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) FILTER ({y} IS NOT NULL) * stddev_pop({y}) FILTER ({x} IS NOT NULL)) END"
SENSOR = f"""
sn0 AS (SELECT *, reference_altitude - ekf_altitude AS d, reference_altitude - lag(reference_altitude) OVER (PARTITION BY log_id ORDER BY ord) AS rs, (motor_1 + motor_2 + motor_3 + motor_4) / 4 AS mo FROM flight_log),
sn1 AS (SELECT *, abs(d) AS ad FROM sn0),
sn AS (SELECT log_id, avg(reference_altitude) AS reference_mean_m, avg(ekf_altitude) AS ekf_mean_m, stddev_pop(reference_altitude) AS reference_std_m, stddev_pop(ekf_altitude) AS ekf_std_m, avg(d) AS bias_m, stddev_pop(d) AS difference_std_m,
  {_CORR('reference_altitude', 'ekf_altitude')} AS correlation, {_CORR('mo', 'ad')} AS motor_error_correlation, {_CORR('throttle_correction', 'rs')} AS correction_step_correlation, count(*) AS n FROM sn1 GROUP BY log_id HAVING count(*) >= 3)"""


def _grid(name: str, samples: str, values: list[str]) -> str:
    """Grid of ``samples`` (log_id, timestamp, values, t0, dt, n_grid) by an as-of join, then least squares over k taken off."""
    line = ", ".join(f"coalesce(s.{v} + (s.{v}1 - s.{v}) / (s.t1 - s.timestamp) * (g.t - s.timestamp), s.{v}) AS {v}" for v in values)
    nexts = ", ".join(f"lead({v}) OVER w AS {v}1" for v in values)
    flat = ", ".join(f"{v} - avg({v}) OVER p - coalesce(covar_pop({v}, k::DOUBLE) OVER p / nullif(var_pop(k::DOUBLE) OVER p, 0), 0) * (k - avg(k::DOUBLE) OVER p) AS {v}" for v in values)
    return f"""
{name}_s AS (SELECT *, lead(timestamp) OVER w AS t1, {nexts} FROM {samples} WINDOW w AS (PARTITION BY log_id ORDER BY timestamp)),
{name}_k AS (SELECT log_id, dt, n_grid, k, t0 + k * dt AS t FROM (SELECT log_id, t0, dt, n_grid, unnest(range(n_grid)) AS k FROM (SELECT DISTINCT log_id, t0, dt, n_grid FROM {samples}))),
{name}_g AS (SELECT g.log_id, g.k, g.t, g.dt, g.n_grid, {line} FROM {name}_k g ASOF JOIN {name}_s s ON g.log_id = s.log_id AND g.t >= s.timestamp),
{name}_d AS (SELECT log_id, k, t, dt, n_grid, {flat} FROM {name}_g WINDOW p AS (PARTITION BY log_id))"""


LAG = (
    """
lm AS (SELECT log_id, timestamp, avg(reference_altitude) AS ref, avg(ekf_altitude) AS ekf FROM flight_log GROUP BY log_id, timestamp),
lc AS (SELECT log_id, count(*) AS n_original, count(*) - count(DISTINCT timestamp) AS n_duplicate, coalesce(max(back), 0) > 0 AS reordered
  FROM (SELECT *, (timestamp < lag(timestamp) OVER (PARTITION BY log_id ORDER BY ord))::INT AS back FROM flight_log) GROUP BY log_id),
lstep AS (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY log_id ORDER BY timestamp) AS step FROM lm),
lu AS (SELECT log_id, count(*) AS n_times, median(step) AS dt FROM lstep GROUP BY log_id),
lp AS (SELECT l.*, dt, sum(coalesce((step > 3.0::DOUBLE * dt)::INT, 0)) OVER (PARTITION BY l.log_id ORDER BY timestamp)::BIGINT AS part FROM lstep l JOIN lu USING (log_id)),
lpo AS (SELECT *, abs(timestamp - due) - greatest(1e-12, dt * 1e-7) - 1e-7 * abs(due) AS off FROM (SELECT *, min(timestamp) OVER (PARTITION BY log_id, part) + (row_number() OVER (PARTITION BY log_id, part ORDER BY timestamp) - 1) * dt AS due FROM lp)),
lz AS (SELECT *, max(part) OVER (PARTITION BY log_id) AS n_gaps FROM (SELECT log_id, part, min(timestamp) AS t0, max(timestamp) - min(timestamp) AS duration, count(*) AS n_part, max(off) AS off FROM lpo GROUP BY log_id, part)),
lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY duration DESC, n_part DESC, t0) AS rk FROM lz WHERE n_part >= 2) WHERE rk = 1),
lf AS (SELECT *, least(2.0::DOUBLE, duration * 0.25::DOUBLE) AS limit_s, (floor(duration / dt + 1e-9) + 1)::BIGINT AS n_grid FROM lc LEFT JOIN lu USING (log_id) LEFT JOIN lb USING (log_id)),
lf2 AS (SELECT *, floor(limit_s / dt + 1e-9)::BIGINT AS most, greatest(20, ceil(0.3::DOUBLE * n_grid))::BIGINT AS least_n FROM lf),
ls AS (SELECT p.log_id, p.timestamp, p.ref, p.ekf, p.dt, f.t0, f.n_grid FROM lp p JOIN lf2 f ON p.log_id = f.log_id AND p.part = f.part WHERE n_original >= 20 AND n_times >= 20 AND f.n_grid >= 20),"""
    + _grid("lg", "ls", ["ref", "ekf"])
    + """,
ln AS (SELECT * FROM (SELECT *, stddev_pop(ref) OVER (PARTITION BY log_id) AS sr, stddev_pop(ekf) OVER (PARTITION BY log_id) AS se FROM lg_d) WHERE sr >= 1e-6 AND se >= 1e-6),
lx AS (SELECT a.log_id, a.lag, count(*) AS n, stddev_pop(b.ref / b.sr) AS sr, stddev_pop(a.ekf / a.se) AS se, covar_pop(b.ref / b.sr, a.ekf / a.se) AS c, any_value(least_n) AS least_n
  FROM (SELECT n.log_id, n.k, n.ekf, n.se, least_n, unnest(range(-most, most + 1)) AS lag FROM ln n JOIN lf2 f USING (log_id) WHERE most >= 1) a JOIN ln b ON a.log_id = b.log_id AND b.k = a.k + a.lag GROUP BY a.log_id, a.lag),
lr AS (SELECT log_id, lag, n, c / (sr * se) AS r FROM lx WHERE n >= greatest(least_n, 3) AND sr >= 1e-6 AND se >= 1e-6)"""
)
LAG_BEST = (
    LAG
    + """,
q1 AS (SELECT *, row_number() OVER w AS pos, count(*) OVER p AS n_lags, max(r) OVER p AS r_max, min(r) OVER p AS r_min, lag(r) OVER w AS r0, lead(r) OVER w AS r1 FROM lr WINDOW p AS (PARTITION BY log_id), w AS (PARTITION BY log_id ORDER BY lag)),
q2 AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY (abs(r - r_max) <= 1e-12) DESC, abs(lag), lag) AS rk FROM q1),
q3 AS (SELECT *, max(pos) FILTER (rk = 1) OVER (PARTITION BY log_id) AS best FROM q2),
q4 AS (SELECT log_id, max(r) AS second FROM q3 WHERE abs(pos - best) > 2 AND ((r > r0 AND r > r1) OR (pos = 1 AND coalesce(r >= r1, true)) OR (pos = n_lags AND coalesce(r >= r0, true))) GROUP BY log_id),
q5 AS (SELECT f.*, q.lag, q.n AS overlap, q.pos, q.n_lags, q.r_max, q.r_min, second, q.r_max - second AS apart, least(limit_s, most * dt) AS lim, lv.log_id IS NOT NULL AS live
  FROM lf2 f LEFT JOIN (SELECT * FROM q3 WHERE rk = 1) q USING (log_id) LEFT JOIN q4 USING (log_id) LEFT JOIN (SELECT DISTINCT log_id FROM ln) lv USING (log_id)),
q6 AS (SELECT *, n_original < 20 OR n_times < 20 AS few, (pos - 1 <= 1 OR pos >= n_lags - 1) AS edge, (r_min <= -0.5::DOUBLE AND abs(r_min) > r_max + 0.05::DOUBLE) AS wrong FROM q5),
q7 AS (SELECT *, CASE WHEN few THEN 'too_few_samples' WHEN dt IS NULL THEN 'no_interval' WHEN duration IS NULL OR n_grid < 20 THEN 'segment_too_short' WHEN NOT live THEN 'flat_signal' WHEN most < 1 THEN 'segment_too_short' WHEN lag IS NULL THEN 'no_candidate'
  WHEN edge THEN 'at_boundary' WHEN wrong THEN 'sign_mismatch' WHEN r_max < 0.5::DOUBLE THEN 'weak' WHEN apart < 0.05::DOUBLE THEN 'ambiguous' WHEN overlap < least_n THEN 'small_overlap' END AS reason FROM q6),
lagx AS (SELECT log_id, CASE WHEN NOT few AND duration IS NOT NULL AND n_grid >= 20 THEN n_part <> n_grid OR off > 0 END AS interpolated, 'check the sensor type and the datum of the reference' AS caveat, greatest(-lim, least(lim, lag * dt)) AS estimated_lag_s, r_max AS max_correlation, lag IS NOT NULL AND reason IS NULL AS reliable,
  CASE WHEN lag IS NULL THEN 'unavailable' WHEN reason IS NOT NULL THEN 'low' WHEN r_max >= 0.7::DOUBLE AND coalesce(apart >= 0.1::DOUBLE, true) THEN 'high' ELSE 'medium' END AS confidence, reason,
  CASE WHEN NOT few AND live THEN lim END AS search_limit_s, CASE WHEN lag IS NOT NULL THEN edge END AS at_boundary, second AS second_best, apart AS peak_separation, overlap, CASE WHEN lag IS NOT NULL THEN wrong END AS sign_mismatch,
  n_original, CASE WHEN NOT few THEN n_grid END AS n_grid, CASE WHEN NOT few THEN dt END AS dt, CASE WHEN NOT few THEN coalesce(n_gaps, 0) > 0 END AS gap_excluded, n_duplicate, reordered FROM q7)"""
)
SPECTRUM = (
    """
fr AS (SELECT log_id, timestamp, x, timestamp - lag(timestamp) OVER (PARTITION BY log_id ORDER BY timestamp) AS step FROM
  (SELECT log_id, timestamp, altitude_setpoint - ekf_altitude AS x, row_number() OVER (PARTITION BY log_id, timestamp ORDER BY ord) AS nth FROM flight_log) WHERE nth = 1),
fu AS (SELECT log_id, median(step) AS dt, stddev_pop(step) AS sd, min(timestamp) AS t0, max(timestamp) AS t1 FROM fr GROUP BY log_id HAVING count(*) >= 32),
fs AS (SELECT log_id, timestamp, x, t0, dt, sd / dt > 0.01::DOUBLE AS irregular, ceil((t1 + dt / 2 - t0) / dt)::BIGINT AS n_grid FROM fr JOIN fu USING (log_id)),"""
    + _grid("fg", "fs", ["x"])
    + """,
fe AS (SELECT *, size - size // 2 AS hop FROM (SELECT *, least(n_grid, 1024)::BIGINT AS size FROM fg_d)),
fi AS (SELECT log_id, segment, k - segment * hop AS i, size, dt, x FROM (SELECT *, unnest(range(greatest(0, ceil((k - size + 1)::DOUBLE / hop)::BIGINT), least((n_grid - size) // hop, k // hop) + 1)) AS segment FROM fe)),
fw AS (SELECT log_id, segment, i, size, dt, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / size)) AS xw, pow(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / size), 2) AS ww FROM fi),
fj AS (SELECT log_id, segment, j, dt, size, sum(xw * cos(2 * pi() * j * i / size)) AS re, sum(xw * sin(2 * pi() * j * i / size)) AS im, sum(ww) AS ww FROM (SELECT *, unnest(range(1, size // 2 + 1)) AS j FROM fw) GROUP BY ALL),
sp AS (SELECT log_id, j, min(j / (size * dt)) AS frequency_hz, avg((re * re + im * im) * dt / ww * CASE WHEN 2 * j = size THEN 1 ELSE 2 END) AS power FROM fj GROUP BY log_id, j),
sp1 AS (SELECT *, lag(power) OVER w AS p0, lead(power) OVER w AS p1, frequency_hz - lag(frequency_hz) OVER w AS width FROM sp WINDOW w AS (PARTITION BY log_id ORDER BY j)),
spa AS (SELECT log_id, sum((power + p0) / 2 * width) AS total, median(width) AS bin FROM sp1 GROUP BY log_id),
sp2 AS (SELECT *, coalesce(power > p0 AND power > p1, false) AS peak FROM sp1),
sp3 AS (SELECT *, bool_or(peak) OVER (PARTITION BY log_id) AS anypeak, row_number() OVER (PARTITION BY log_id ORDER BY peak DESC, power DESC, j) AS rank FROM sp2),
pk AS (SELECT log_id, rank, frequency_hz, power, coalesce(power * bin / nullif(total, 0), 0) AS ratio, total AS total_power FROM sp3 JOIN spa USING (log_id) WHERE CASE WHEN anypeak THEN peak AND rank <= 3 ELSE rank = 1 END),
fq AS (SELECT p.log_id, p.frequency_hz AS dominant_frequency_hz, p.ratio AS peak_ratio, p.total_power, 0.5::DOUBLE / dt AS nyquist_hz, 1.0::DOUBLE / (dt * n_grid) AS min_frequency_hz, irregular, n_grid, true AS available
  FROM pk p JOIN (SELECT DISTINCT log_id, dt, n_grid, irregular FROM fs) s USING (log_id) WHERE rank = 1)"""
)
STEPS = f"""{TRACK},
st0 AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY log_id) AS n FROM tr),
st1 AS (SELECT *, timestamp - lag(timestamp) OVER w AS dt, altitude_setpoint - lag(altitude_setpoint) OVER w AS dsp FROM st0 WINDOW w AS (PARTITION BY log_id ORDER BY pos)),
st AS (SELECT * FROM st1 WHERE log_id IN (SELECT log_id FROM st1 GROUP BY log_id HAVING count(*) >= 5 AND min(dt) > 0)),
sm AS (SELECT log_id, median(dsp) AS mid, max(altitude_setpoint) - min(altitude_setpoint) AS span FROM st GROUP BY log_id),
sl AS (SELECT log_id, noise, greatest(0.05::DOUBLE, 0.05::DOUBLE * span, 5.0::DOUBLE * noise) AS threshold FROM (SELECT st.log_id, 1.4826::DOUBLE * median(abs(dsp - mid)) AS noise, any_value(span) AS span FROM st JOIN sm USING (log_id) WHERE dsp IS NOT NULL GROUP BY st.log_id) WHERE span > 0),
cp AS (SELECT st.*, noise, threshold, coalesce((timestamp - lag(timestamp) OVER (PARTITION BY st.log_id ORDER BY pos) > 0.25::DOUBLE)::INT, 1) AS fresh FROM st JOIN sl USING (log_id) WHERE abs(dsp) >= threshold),
cg AS (SELECT *, sum(fresh) OVER (PARTITION BY log_id ORDER BY pos) AS grp FROM cp),
gr0 AS (SELECT log_id, grp, any_value(noise) AS noise, any_value(threshold) AS threshold, any_value(n) AS n, min(pos) AS first, max(pos) AS last, min(timestamp) AS t_first, max(timestamp) AS t_last FROM cg GROUP BY log_id, grp),
gr AS (SELECT * FROM (SELECT *, coalesce(lag(last) OVER w, 0) AS before, coalesce(lead(first) OVER w, n) AS after FROM gr0 WINDOW w AS (PARTITION BY log_id ORDER BY grp)) WHERE t_last - t_first <= 0.75::DOUBLE),
pn AS (SELECT gr.*, st.pos, st.timestamp, st.altitude_setpoint AS sp, st.pos < gr.first AS lft, CASE WHEN st.pos < gr.first THEN gr.first - st.pos ELSE st.pos - gr.last END AS dist,
  CASE WHEN st.pos < gr.first THEN st.timestamp >= t_first - 0.5::DOUBLE ELSE st.timestamp <= t_last + 0.5::DOUBLE END AS timed
  FROM gr JOIN st ON gr.log_id = st.log_id AND st.pos >= before AND st.pos < after AND (st.pos < gr.first OR st.pos >= gr.last)),
pw AS (SELECT *, sum(timed::INT) OVER p AS n_timed, count(*) OVER p AS n_all, row_number() OVER (PARTITION BY log_id, grp, lft ORDER BY dist) AS rk FROM pn WINDOW p AS (PARTITION BY log_id, grp, lft)),
ev0 AS (SELECT log_id, grp, first, t_first, after, noise, threshold, median(sp) FILTER (lft) AS initial, median(sp) FILTER (NOT lft) AS final, max(sp) FILTER (lft) - min(sp) FILTER (lft) AS sw_l, max(sp) FILTER (NOT lft) - min(sp) FILTER (NOT lft) AS sw_r
  FROM pw WHERE n_all >= 2 AND CASE WHEN n_timed >= 2 THEN timed ELSE rk <= 2 END GROUP BY ALL),
ev AS (SELECT *, final - initial AS amplitude FROM ev0 WHERE abs(final - initial) >= threshold AND sw_l <= greatest(0.025::DOUBLE, abs(final - initial) * 0.02::DOUBLE, noise * 5.0::DOUBLE) AND sw_r <= greatest(0.025::DOUBLE, abs(final - initial) * 0.02::DOUBLE, noise * 5.0::DOUBLE)),
rs AS (SELECT ev.*, st.pos, st.timestamp AS t, st.ekf_altitude AS alt, sign(amplitude) * (st.ekf_altitude - initial) AS pr FROM ev JOIN st ON ev.log_id = st.log_id AND st.pos >= ev.first AND st.pos < ev.after),
rl AS (SELECT *, lag(t) OVER w AS t0, lag(pr) OVER w AS p0 FROM rs WINDOW w AS (PARTITION BY log_id, first ORDER BY pos)),
ra AS (SELECT log_id, first, t_first, initial, final, amplitude, max(t) AS t_end, greatest(0.0::DOUBLE, max(sign(amplitude) * (alt - final))) AS overshoot_m,
  {", ".join(f"arg_min(CASE WHEN p0 IS NULL OR pr <= p0 THEN t ELSE t0 + greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({q}::DOUBLE * abs(amplitude) - p0) / (pr - p0))) * (t - t0) END, pos) FILTER (pr >= {q}::DOUBLE * abs(amplitude)) AS {n}" for q, n in (("0.1", "t10"), ("0.9", "t90")))}
  FROM rl GROUP BY log_id, first, t_first, initial, final, amplitude),
ru AS (SELECT rl.log_id, rl.first, greatest(0.0::DOUBLE, max(-pr)) AS undershoot_m FROM rl JOIN ra ON rl.log_id = ra.log_id AND rl.first = ra.first WHERE t <= coalesce(t10, t_end) GROUP BY rl.log_id, rl.first),
rc AS (SELECT log_id, first, t, sum((NOT ok)::INT) OVER (PARTITION BY log_id, first ORDER BY pos) AS run, ok FROM (SELECT *, abs(alt - final) <= greatest(abs(amplitude) * 0.05::DOUBLE, 0.01::DOUBLE) AS ok FROM rs)),
rt AS (SELECT log_id, first, min(a) AS settled_at FROM (SELECT log_id, first, run, min(t) AS a, max(t) AS b FROM rc WHERE ok GROUP BY log_id, first, run) WHERE b - a >= 0.5::DOUBLE GROUP BY log_id, first),
sr_ AS (SELECT ra.log_id, ra.first AS step_pos, t_first AS timestamp_s, CASE WHEN amplitude > 0 THEN 'up' ELSE 'down' END AS direction, initial AS initial_setpoint_m, final AS final_setpoint_m, amplitude AS amplitude_m,
  CASE WHEN t90 >= t10 THEN t90 - t10 END AS rise_time_s, settled_at - t_first AS settling_time_s, overshoot_m, coalesce(undershoot_m, 0.0::DOUBLE) AS undershoot_m,
  CASE WHEN t10 IS NULL THEN 'below_10_percent' WHEN t90 IS NULL THEN 'below_90_percent' WHEN settled_at IS NULL THEN 'not_settled' END AS reason
  FROM ra LEFT JOIN ru ON ra.log_id = ru.log_id AND ra.first = ru.first LEFT JOIN rt ON ra.log_id = rt.log_id AND ra.first = rt.first),
pm AS (SELECT log_id, idx AS primary_step_index, n_steps, amplitude_m, rise_time_s, settling_time_s, overshoot_m, undershoot_m, reason AS step_reason FROM
  (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY step_pos) - 1 AS idx, count(*) OVER (PARTITION BY log_id) AS n_steps, row_number() OVER (PARTITION BY log_id ORDER BY abs(amplitude_m) DESC, step_pos) AS rk FROM sr_) WHERE rk = 1)"""
METRICS = ",".join([STEPS, G1, G2, STEPS_OF_TIME, ACTUATOR, SENSOR, LAG_BEST, SPECTRUM]) + """,
mt AS (SELECT tm.log_id, tm.n_duplicate, tm.n_reverse, tm.jitter, tm.n_dropout, g1.error_std_m, g2.steady_state_error_m, pm.settling_time_s, act.mean_throttle_correction_pwm, act.correction_saturation_ratio, act.max_continuous_saturation_s, act.mean_motor_spread_pwm,
  act.max_motor_std_pwm, sn.bias_m, sn.difference_std_m, sn.motor_error_correlation, lagx.estimated_lag_s, lagx.max_correlation, lagx.reliable, fq.dominant_frequency_hz, fq.peak_ratio
  FROM tm LEFT JOIN g1 USING (log_id) LEFT JOIN g2 USING (log_id) LEFT JOIN pm USING (log_id) LEFT JOIN act USING (log_id) LEFT JOIN sn USING (log_id) LEFT JOIN lagx USING (log_id) LEFT JOIN fq USING (log_id))"""


def _hypotheses() -> str:
    parts = []
    for h in HYPOTHESES:
        deltas = ", ".join(applied(r, "duckdb") for r in RULES if r.hypothesis == h.id)
        parts.append(f"SELECT log_id, '{h.id}' AS hypothesis, [{deltas}] AS d FROM mt")
    return METRICS + ",\nhy AS (" + "\nUNION ALL ".join(parts) + """),
hs AS (SELECT log_id, hypothesis, list_reduce(list_prepend(0, d), lambda a, x: greatest(0, least(100, a + x)))::INT AS score, len(list_filter(d, lambda x: x > 0))::BIGINT AS n_met, len(list_filter(d, lambda x: x < 0))::BIGINT AS n_unmet FROM hy),
hr AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY score DESC, hypothesis) AS rank FROM hs)"""


HYPOTHESIS_SQL = _hypotheses()
RAW = """raw AS (SELECT log_id, ord, time_ms::VARCHAR AS time_ms, round(altitude_setpoint * 100)::BIGINT::VARCHAR AS alt_sp, round(ekf_altitude * 100)::BIGINT::VARCHAR AS ekf_alt,
  CASE WHEN ord % 10 = 0 THEN '' WHEN ord % 17 = 0 THEN 'NA' WHEN ord % 13 = 0 THEN 'bad' ELSE round(throttle_correction)::BIGINT::VARCHAR END AS alt_corr,
  motor_1::BIGINT::VARCHAR AS pwm_1, motor_2::BIGINT::VARCHAR AS pwm_2, CASE WHEN armed THEN 'true' ELSE 'false' END AS is_armed, CASE WHEN althold_active THEN '1' ELSE '0' END AS alt_hold,
  CASE WHEN althold_active THEN 'cruise' ELSE 'fault' END AS note FROM flight_log)"""
_RAW_COLUMNS = ("time_ms", "alt_sp", "ekf_alt", "alt_corr", "pwm_1", "pwm_2", "is_armed", "alt_hold", "note")
PROFILE = RAW + ",\ncells AS (" + " UNION ALL ".join(f"SELECT log_id, ord, {k} AS position, '{c}' AS \"column\", CASE WHEN {c} NOT IN ('', 'NA') THEN {c} END AS v FROM raw" for k, c in enumerate(_RAW_COLUMNS)) + r"""),
cells2 AS (SELECT *, CASE WHEN regexp_full_match(v, '[+-]?\d+') THEN v::DOUBLE END AS x, sum((v IS NOT NULL)::INT) OVER (PARTITION BY log_id, position ORDER BY ord) AS nth, row_number() OVER (PARTITION BY log_id, position ORDER BY ord) AS place FROM cells),
prof AS (SELECT log_id, position, "column", CASE WHEN count(v) = 0 THEN 'unknown' WHEN bool_and(lower(v) IN ('true','false','0','1','yes','no','on','off')) FILTER (v IS NOT NULL AND nth <= 500) THEN 'boolean'
  WHEN avg((x IS NOT NULL)::INT) FILTER (v IS NOT NULL) >= 0.95 THEN 'numeric' ELSE 'string' END AS type, count(v) AS n, avg((v IS NULL)::INT) AS missing_ratio, min(x) AS minimum, max(x) AS maximum, avg(x) AS mean, CASE WHEN count(x) > 1 THEN stddev_samp(x) END AS std,
  count(DISTINCT v) AS n_distinct, array_to_string(list(coalesce(v, 'null') ORDER BY ord) FILTER (place <= 5), '|') AS first_values FROM cells2 GROUP BY log_id, position, "column")"""
