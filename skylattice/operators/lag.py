"""Sensor comparison: how the reference altitude relates to the estimate, and by how much it lags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, median, motor_mean, safe_corr
from ..settings import MOTORS, LagSettings
from ..storage import stored
from .resample import detrended, uniform_grid
from .segments import W

#: Codes of the reasons why a lag is missing or not to be relied on.
REASONS = ("too_few_samples", "no_interval", "segment_too_short", "flat_signal", "no_candidate", "at_boundary", "sign_mismatch", "weak", "ambiguous", "small_overlap")
CAVEATS = {"barometer": "pressure, propeller wash and mounting affect a barometer", "gnss": "datum and satellite visibility affect a GNSS altitude", "other": "check the sensor type and the datum of the reference"}


def sensor_statistics(log: DataFrame) -> DataFrame:
    """One row a log with three or more finite pairs: means, spreads, bias, and correlations (null where one side is constant)."""
    r, e = finite(F.col("reference_altitude")), finite(F.col("ekf_altitude"))
    rows = log.withColumn("_r", r).withColumn("_e", e).filter("_r IS NOT NULL AND _e IS NOT NULL").withColumn("_d", F.col("_r") - F.col("_e"))
    rows = rows.withColumn("_step", F.col("_r") - F.lag("_r").over(W()))
    motors = [F.col(m) for m in MOTORS if m in log.columns]
    none = F.lit(None).cast("double")
    out = rows.groupBy("log_id").agg(
        F.avg("_r").alias("reference_mean_m"), F.avg("_e").alias("ekf_mean_m"), F.stddev_pop("_r").alias("reference_std_m"), F.stddev_pop("_e").alias("ekf_std_m"),
        F.avg("_d").alias("bias_m"), F.stddev_pop("_d").alias("difference_std_m"), safe_corr(F.col("_r"), F.col("_e")).alias("correlation"),
        (safe_corr(motor_mean(motors), F.abs("_d")) if motors else F.first(none)).alias("motor_error_correlation"),
        (safe_corr(F.col("throttle_correction"), F.col("_step")) if "throttle_correction" in log.columns else F.first(none)).alias("correction_step_correlation"), F.count("*").alias("n"),
    )
    return out.filter("n >= 3")


def prepared(log: DataFrame, s: LagSettings) -> tuple[DataFrame, DataFrame]:
    """(samples of the longest stretch without a large gap, facts of every log).  Equal times are averaged."""
    rows = log.select("log_id", "ord", *[finite(F.col(c)).alias(c) for c in ("timestamp", "reference_altitude", "ekf_altitude")]).dropna()
    rows = rows.withColumn("_back", (F.col("timestamp") < F.lag("timestamp").over(W())).cast("int"))
    counts = rows.groupBy("log_id").agg(F.count("*").alias("n_original"), F.coalesce(F.max("_back"), F.lit(0)).cast("boolean").alias("reordered"), (F.count("*") - F.count_distinct("timestamp")).alias("n_duplicate"))
    means = rows.groupBy("log_id", "timestamp").agg(F.avg("reference_altitude").alias("ref"), F.avg("ekf_altitude").alias("ekf"))
    wt = Window.partitionBy("log_id").orderBy("timestamp")
    means = means.withColumn("step", F.col("timestamp") - F.lag("timestamp").over(wt))
    per = Window.partitionBy("log_id")
    means = means.withColumn("n_times", F.count("*").over(per)).withColumn("dt", median(F.col("step")).over(per))
    parts = means.withColumn("part", F.sum(F.coalesce((F.col("step") > s.gap * F.col("dt")).cast("int"), F.lit(0))).over(wt))
    inside = Window.partitionBy("log_id", "part")
    due = F.min("timestamp").over(inside) + (F.row_number().over(inside.orderBy("timestamp")) - 1) * F.col("dt")
    parts = parts.withColumn("off", F.abs(F.col("timestamp") - due) - F.greatest(F.lit(1e-12), F.col("dt") * 1e-7) - 1e-7 * F.abs(due))  # above zero: beside the grid
    parts = stored(parts, "lag_samples")  # read by the facts and by the grid
    usual = parts.groupBy("log_id").agg(F.first("n_times").alias("n_times"), F.first("dt").alias("dt"))
    sizes = parts.groupBy("log_id", "part").agg(F.min("timestamp").alias("t0"), (F.max("timestamp") - F.min("timestamp")).alias("duration"), F.count("*").alias("n_part"), F.max("off").alias("off")).withColumn("n_gaps", F.max("part").over(Window.partitionBy("log_id")))
    best = sizes.filter("n_part >= 2").withColumn("_rank", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("duration"), F.desc("n_part"), "t0"))).filter("_rank = 1").drop("_rank")
    facts = counts.join(usual, "log_id", "left").join(best, "log_id", "left").withColumn("n_grid", (F.floor(F.col("duration") / F.col("dt") + 1e-9) + 1).cast("long"))
    facts = stored(facts, "lag_facts")  # one row a log
    return parts.drop("n_times", "off").join(facts.select("log_id", "part", "t0", "n_grid"), ["log_id", "part"]), facts


#: Grid points of a log that one task compares; longer logs are cut, each piece with as many neighbours as the largest lag.
PIECE = 8192


def _sums(key: tuple, table: pa.Table) -> pa.Table:
    """Of one piece, for each lag: pairs of an estimate at k and a reference at k + lag, and the sums of their moments."""
    table = table.sort_by("k")
    k, own = table.column("k").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
    ref, most = table.column("ref").to_numpy(), table.column("most")[0].as_py()
    at, ekf = np.flatnonzero(own), table.column("ekf").to_numpy()[own]
    total = [np.concatenate([[0.0], np.cumsum(x)]) for x in (ref, ref * ref, ekf, ekf * ekf)]
    lag = np.arange(-most, most + 1)
    lo, hi = np.maximum(0, -int(at[0]) - lag), np.minimum(len(at), len(k) - int(at[0]) - lag)  # the grid has no holes
    lag, lo, hi = (x[lo < hi] for x in (lag, lo, hi))
    r0, r1 = at[0] + lo + lag, at[0] + hi + lag
    moments = [t[b] - t[a] for t, (a, b) in zip(total, ((r0, r1), (r0, r1), (lo, hi), (lo, hi)), strict=True)]
    products = [float(ref[a:b] @ ekf[c:d]) for a, b, c, d in zip(r0.tolist(), r1.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    values = [pa.array(lag), pa.array(hi - lo), *map(pa.array, moments), pa.array(products, pa.float64())]
    return pa.table([pa.array(np.full(len(lag), key[0].as_py()), pa.int64()), *values], names=["log_id", "lag", "n", "r1", "r2", "e1", "e2", "re"])


def lag_correlations(log: DataFrame, s: LagSettings = LagSettings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (log_id, lag, n, r) of every admissible lag, facts of every log, the logs with a live signal).

    The grid is dealt to pieces of a log once, with the neighbours that its lags reach; the lags are run through inside a piece, and
    only the moments of each lag are added up across pieces.
    """
    samples, facts = prepared(log, s)
    enough = facts.filter((F.col("n_original") >= max(4, s.pairs[0])) & (F.col("n_times") >= max(4, s.pairs[0])) & (F.col("n_grid") >= max(4, s.pairs[0])))
    grid = detrended(uniform_grid(samples.join(enough.select("log_id"), "log_id"), "n_grid", ("ref", "ekf")), ("ref", "ekf"))
    grid = grid.filter((F.col("ref_std") >= s.still) & (F.col("ekf_std") >= s.still)).select("log_id", "k", "n_grid", "dt", (F.col("ref") / F.col("ref_std")).alias("ref"), (F.col("ekf") / F.col("ekf_std")).alias("ekf"))
    bound = F.least(F.lit(max(0.0, s.reach_s)), F.col("duration") * 0.25)
    facts = facts.withColumn("limit_s", bound).withColumn("most", F.floor(F.col("limit_s") / F.col("dt") + 1e-9).cast("long")).withColumn("least", F.greatest(F.lit(s.pairs[0]), F.ceil(s.pairs[1] * F.col("n_grid"))).cast("long"))
    lags = facts.select("log_id", "most", "least").filter("most >= 1")
    size = F.greatest(F.lit(PIECE).cast("long"), F.col("most"))
    piece = lambda k: F.floor(k / size).cast("long")
    near = F.sequence(piece(F.greatest(F.col("k") - F.col("most"), F.lit(0))), piece(F.least(F.col("k") + F.col("most"), F.col("n_grid") - 1)))
    dealt = grid.join(lags, "log_id").withColumn("piece", F.explode(near)).withColumn("own", F.col("piece") == piece(F.col("k")))
    sums = dealt.select("log_id", "piece", "k", "own", "most", "ref", "ekf").groupBy("log_id", "piece").applyInArrow(_sums, "log_id long, lag long, n long, r1 double, r2 double, e1 double, e2 double, re double")
    by_lag = sums.groupBy("log_id", "lag").agg(*[F.sum(c).alias(c) for c in ("n", "r1", "r2", "e1", "e2", "re")])
    mean = lambda c: F.col(c) / F.col("n")
    spread = lambda one, two: F.sqrt(F.greatest(mean(two) - mean(one) * mean(one), F.lit(0.0)))
    by_lag = by_lag.withColumn("sr", spread("r1", "r2")).withColumn("se", spread("e1", "e2")).withColumn("c", mean("re") - mean("r1") * mean("e1"))
    by_lag = by_lag.join(lags.select("log_id", "least"), "log_id").filter((F.col("n") >= F.greatest("least", F.lit(3))) & (F.col("sr") >= s.still) & (F.col("se") >= s.still))
    table = stored(by_lag.select("log_id", "lag", "n", (F.col("c") / (F.col("sr") * F.col("se"))).alias("r")), "lags")  # a row for each log and lag
    return table, facts, facts.join(grid.filter("k = 0").select("log_id"), "log_id").select("log_id")


def lag_analysis(log: DataFrame, s: LagSettings = LagSettings(), source: str = "other") -> DataFrame:
    """One row a log with finite triples: the lag of best correlation (positive: the reference is later), how far it can be relied on, and why not;
    whether the samples had to be interpolated onto the grid, and what to mind about a reference of that ``source``."""
    table, facts, alive = lag_correlations(log, s)
    per = Window.partitionBy("log_id")
    at = per.orderBy("lag")
    c = table.withColumn("pos", F.row_number().over(at)).withColumn("n_lags", F.count("*").over(per)).withColumn("r_max", F.max("r").over(per)).withColumn("r_min", F.min("r").over(per))
    tied = (F.abs(F.col("r") - F.col("r_max")) <= 1e-12).cast("int")
    c = c.withColumn("rank", F.row_number().over(per.orderBy(F.desc(tied), F.abs("lag"), "lag"))).withColumn("best", F.max(F.when(F.col("rank") == 1, F.col("pos"))).over(per))
    # equal neighbours form one plateau; a plateau inside counts as a peak at its middle
    c = c.withColumn("level", F.sum(F.coalesce((F.col("r") != F.lag("r").over(at)).cast("int"), F.lit(0))).over(at))
    flat = c.groupBy("log_id", "level").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("r").alias("r"), F.first("n_lags").alias("n_lags"), F.first("best").alias("best"))
    fw = Window.partitionBy("log_id").orderBy("level")
    flat = flat.withColumn("r0", F.lag("r").over(fw)).withColumn("r1", F.lead("r").over(fw))
    inner = flat.filter((F.col("r") > F.col("r0")) & (F.col("r") > F.col("r1"))).select("log_id", "r", "best", F.floor((F.col("lo") + F.col("hi")) / 2).alias("pos"))
    edge = c.withColumn("r_next", F.lead("r").over(at)).withColumn("r_prior", F.lag("r").over(at)).filter(((F.col("pos") == 1) & (F.coalesce(F.col("r") >= F.col("r_next"), F.lit(True)))) | ((F.col("pos") == F.col("n_lags")) & F.coalesce(F.col("r") >= F.col("r_prior"), F.lit(True))))
    peaks = inner.select("log_id", "r", "best", "pos").union(edge.select("log_id", "r", "best", "pos"))
    second = peaks.filter(F.abs(F.col("pos") - F.col("best")) > s.near).groupBy("log_id").agg(F.max("r").alias("second"))
    top = c.filter("rank = 1").join(second, "log_id", "left").select("log_id", "lag", F.col("n").alias("overlap"), "pos", "n_lags", "r_max", "r_min", "second")
    live = alive.withColumn("live", F.lit(True))
    out = facts.join(top, "log_id", "left").join(live, "log_id", "left")
    few = (F.col("n_original") < max(4, s.pairs[0])) | (F.col("n_times") < max(4, s.pairs[0]))
    limit = F.least("limit_s", F.col("most") * F.col("dt"))
    apart = F.col("r_max") - F.col("second")
    boundary = (F.col("pos") - 1 <= s.ends) | (F.col("pos") >= F.col("n_lags") - s.ends)
    sign = (F.col("r_min") <= -s.usable.correlation) & (F.abs("r_min") > F.col("r_max") + s.usable.apart)
    short = F.col("duration").isNull() | (F.col("n_grid") < max(4, s.pairs[0]))
    reason = (
        F.when(few, "too_few_samples").when(F.col("dt").isNull(), "no_interval").when(short, "segment_too_short").when(F.col("live").isNull(), "flat_signal").when(F.col("most") < 1, "segment_too_short")
        .when(F.col("lag").isNull(), "no_candidate").when(boundary, "at_boundary").when(sign, "sign_mismatch").when(F.col("r_max") < s.usable.correlation, "weak").when(apart < s.usable.apart, "ambiguous").when(F.col("overlap") < F.col("least"), "small_overlap")
    )
    high = (F.col("r_max") >= s.good.correlation) & F.coalesce(apart >= s.good.apart, F.lit(True))
    out = out.withColumn("reason", reason)
    confidence = F.when(F.col("lag").isNull(), "unavailable").when(F.col("reason").isNotNull(), "low").when(high, "high").otherwise("medium")
    gridded = ~few & ~F.coalesce(short, F.lit(True))
    return out.select(
        "log_id", F.when(gridded, (F.col("n_part") != F.col("n_grid")) | (F.col("off") > 0)).alias("interpolated"), F.lit(CAVEATS[source]).alias("caveat"), F.greatest(-limit, F.least(limit, F.col("lag") * F.col("dt"))).alias("estimated_lag_s"), F.col("r_max").alias("max_correlation"), (F.col("lag").isNotNull() & F.col("reason").isNull()).alias("reliable"),
        confidence.alias("confidence"), "reason", F.when(~few & ~F.coalesce(short, F.lit(True)) & F.col("live"), limit).alias("search_limit_s"), F.when(F.col("lag").isNotNull(), boundary).alias("at_boundary"),
        F.col("second").alias("second_best"), apart.alias("peak_separation"), "overlap", F.when(F.col("lag").isNotNull(), sign).alias("sign_mismatch"), "n_original", F.when(~few, F.col("n_grid")).alias("n_grid"), F.when(~few, F.col("dt")).alias("dt"),
        F.when(~few, F.coalesce(F.col("n_gaps"), F.lit(0)) > 0).alias("gap_excluded"), "n_duplicate", "reordered",
    )
