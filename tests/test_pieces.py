"""Running values and quantiles over pieces, against plain windows; every piece is small here."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.operators import actuator, altitude, pieces, segments, timing, transform


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(pieces, "PIECE_ROWS", 7)
    monkeypatch.setattr(pieces, "PIECE_S", 0.3)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(2)
    rows = []
    for log_id, n in ((1, 400), (2, 30), (3, 1), (4, 60)):
        for k in range(n):
            time = None if rng.random() < 0.03 else round(0.04 * (k + rng.choice([0, 0, 0, -3, 5, 40])), 3)
            flag = lambda p: None if rng.random() < 0.05 else rng.random() < p
            rows.append((log_id, 3 * k, time, None if rng.random() < 0.1 else rng.gauss(0, 150), rng.gauss(1, 1), rng.gauss(1, 1), flag(0.9) if log_id != 2 else True, flag(0.7)))
    return spark.createDataFrame(rows, "log_id long, ord long, timestamp double, throttle_correction double, altitude_setpoint double, ekf_altitude double, armed boolean, althold_active boolean").repartition(6)


def test_scan_equals_windows(log, small_pieces):
    on = F.coalesce(F.col("armed"), F.lit(False))
    got = pieces.scan(log, pieces.by_row(), ("ord",), sums={"upto": ~on}, priors={"before": F.col("timestamp")}, totals={"n": F.lit(1), "off": ~on})
    w = Window.partitionBy("log_id").orderBy("ord")
    whole = Window.partitionBy("log_id")
    want = log.withColumns({"upto": F.sum((~on).cast("long")).over(w), "before": F.lag("timestamp").over(w), "n": F.count("*").over(whole), "off": F.sum((~on).cast("long")).over(whole)})
    rows = lambda df: sorted(map(str, df.select("log_id", "ord", "upto", "before", "n", "off").collect()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_equal_the_plain_aggregate(spark, log, p):
    rng = random.Random(1)
    values = [(k % 3, rng.choice([0.0, -0.0, 1.5, -2.5, rng.gauss(0, 1e-3), rng.gauss(0, 1e9), float("inf"), None])) for k in range(900)] + [(7, None), (8, 3.25), (9, float("nan")), (9, 1.0)]
    table = spark.createDataFrame(values, "log_id long, v double")
    got = {r.log_id: str(r.q) for r in pieces.quantiles(table, "v", {"q": p}).collect()}
    want = {r.log_id: str(r.q) for r in table.filter("v IS NOT NULL").groupBy("log_id").agg(F.percentile("v", p).alias("q")).collect()}
    assert {k: v.replace("-0.0", "0.0") for k, v in got.items()} == {k: v.replace("-0.0", "0.0") for k, v in want.items()}


def test_pieces_never_fall_where_values_rise(spark):
    values = sorted({s * m * 10.0**e for s in (-1, 1) for m in (1.0, 1.0000001, 2.0, 3.999999, 4.0) for e in range(-300, 300, 7)} | {0.0, float("inf"), float("-inf"), 5e-324, -5e-324})
    got = [r.p for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", pieces.by_value(F.col("v")).alias("p")).orderBy("v").collect()]
    assert got == sorted(got)


def runs_of(rows, flag):
    """Maximal runs in row order: (start time, end time, rows, first place, last place)."""
    out, held = [], []
    for k, r in enumerate([*rows, None]):
        if r is not None and flag(r):
            held.append((k, r))
        elif held:
            out.append((held[0][1].timestamp, held[-1][1].timestamp, len(held), held[0][0], held[-1][0]))
            held = []
    return out


def test_operators_go_on_across_pieces(log, small_pieces):
    by_log = {}
    for r in log.orderBy("log_id", "ord").collect():
        by_log.setdefault(r.log_id, []).append(r)
    got = sorted((r.log_id, r.kind, r.segment, r.start_s, r.end_s, r.rows, r.start_index, r.end_index) for r in segments.detect_segments(log).collect())
    want = [(i, kind, n, *run) for i, rows in by_log.items() for kind, flag in (("armed", lambda r: r.armed), ("althold", lambda r: r.armed and r.althold_active)) for n, run in enumerate(runs_of(rows, flag), 1)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    counts = {r.log_id: (r.n_rows, r.n_duplicate, r.n_reverse) for r in timing.order_counts(log).collect()}
    for i, rows in by_log.items():
        times = [r.timestamp for r in rows]
        assert counts[i] == (len(times), len(times) - len(set(times)), sum(a is not None and b is not None and b < a for a, b in zip(times, times[1:])))
    steps = {}
    for r in timing.intervals(log).collect():
        steps.setdefault(r.log_id, []).append((r.timestamp, r.interval))
    for i, rows in by_log.items():
        times = sorted({r.timestamp for r in rows if r.timestamp is not None})
        assert sorted(steps.get(i, [])) == [(b, b - a) for a, b in zip(times, times[1:])]
    full = {r.log_id: r.max_continuous_saturation_s for r in actuator.saturation_runs(log).collect()}
    for i, rows in by_log.items():
        spans = [max(0.0, (b or 0) - (a or 0)) if a is not None and b is not None else 0.0 for a, b, *_ in runs_of(rows, lambda r: r.throttle_correction is not None and abs(r.throttle_correction) >= 160)]
        if any(r.throttle_correction is not None for r in rows):
            assert full[i] == pytest.approx(max(spans, default=0.0))
    calm = {r.log_id: r.steady_state_error_m for r in altitude.steady_state_error(log).collect()}
    for i, rows in by_log.items():
        errors = [r.altitude_setpoint - r.ekf_altitude for r in rows]
        if len(errors) >= 2:
            last = errors[-max(1, round(len(errors) * 0.2)) :]
            assert calm[i] == pytest.approx(sum(last) / len(last))


def test_one_log_of_many_pieces(spark):
    long = spark.range(0, 9 * pieces.PIECE_ROWS, 1, 8).select(F.lit(1).cast("long").alias("log_id"), F.col("id").alias("ord"), (F.col("id") / 25.0).alias("timestamp"), (F.col("id") % 1000 >= 10).alias("armed"), F.lit(True).alias("althold_active"), (F.col("id") % 320).cast("double").alias("throttle_correction"))
    found = segments.detect_segments(long).groupBy("kind").agg(F.count("*").alias("n"), F.max("rows").alias("most")).collect()
    n = 9 * pieces.PIECE_ROWS
    assert {(r.kind, r.n, r.most) for r in found} == {(k, -(-n // 1000), 990) for k in ("armed", "althold")}
    r = timing.analyze_timing(long, long).first()
    assert (r.n_duplicate, r.n_reverse, r.n_dropout) == (0, 0, 0) and r.median_s == pytest.approx(0.04)
    assert transform.infer_time_unit(long).first().n_distinct == n
    assert actuator.saturation_runs(long).first().max_continuous_saturation_s == pytest.approx(159 / 25)
