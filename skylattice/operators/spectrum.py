"""Power spectrum of the altitude error (Welch), its peaks and their share.

A segment of a log is one group of samples; its spectrum is a NumPy transform inside a grouped Arrow task.  Everything around it (the
series, the grid, detrending, peaks) is DataFrame work.  ``dft_power`` is the same transform as sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, median
from .resample import detrended, uniform_grid

LONGEST = 1024


def error_series(log: DataFrame, least: int = 32) -> DataFrame:
    """Samples (log_id, timestamp, x, t0, dt, n_grid, irregular) of setpoint - estimate (the estimate alone without a setpoint); of
    equal times the first row counts; logs with fewer than ``least`` samples give none."""
    value = F.col("altitude_setpoint") - F.col("ekf_altitude") if "altitude_setpoint" in log.columns else F.col("ekf_altitude")
    rows = log.select("log_id", "ord", finite(F.col("timestamp")).alias("timestamp"), finite(value).alias("x")).dropna()
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("log_id", "timestamp").orderBy("ord"))).filter("_nth = 1")
    wt = Window.partitionBy("log_id").orderBy("timestamp")
    rows = rows.withColumn("step", F.col("timestamp") - F.lag("timestamp").over(wt))
    usual = rows.groupBy("log_id").agg(F.count("*").alias("n"), median(F.col("step")).alias("dt"), F.stddev_pop("step").alias("sd"), F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1")).filter((F.col("n") >= least) & (F.col("dt") > 0))
    usual = usual.withColumn("n_grid", F.ceil((F.col("t1") + F.col("dt") / 2 - F.col("t0")) / F.col("dt")).cast("long")).withColumn("irregular", F.col("sd") / F.col("dt") > 0.01)
    return rows.select("log_id", "timestamp", "x").join(usual.select("log_id", "t0", "dt", "n_grid", "irregular"), "log_id")


def error_grid(log: DataFrame) -> DataFrame:
    """The detrended series on its uniform grid: (log_id, k, t, n_grid, dt, x, x_std)."""
    return detrended(uniform_grid(error_series(log), "n_grid", ("x",)), ("x",))


def welch(x: np.ndarray, rate: float, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density averaged over half-overlapping segments under a periodic Hann window; a tail that fills no segment is left out."""
    size = min(len(x), longest)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(x) - size + 1, size - size // 2)
    power = np.mean([np.abs(np.fft.rfft(x[a : a + size] * window)) ** 2 for a in starts], axis=0) / (rate * (window**2).sum())
    power[1 : len(power) - (size % 2 == 0)] *= 2
    return np.arange(len(power)) * rate / size, power


def welch_segments(log: DataFrame) -> DataFrame:
    """The grid dealt to half-overlapping segments of at most ``LONGEST`` points: (log_id, segment, i, size, dt, x); a tail that fills none is left out."""
    g = error_grid(log).withColumn("size", F.least("n_grid", F.lit(LONGEST).cast("long")))
    g = g.withColumn("hop", F.col("size") - F.floor(F.col("size") / 2))
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("k") - F.col("size") + 1) / F.col("hop")).cast("long"))
    high = F.least(F.floor((F.col("n_grid") - F.col("size")) / F.col("hop")), F.floor(F.col("k") / F.col("hop"))).cast("long")
    g = g.withColumn("low", low).withColumn("high", high).filter("low <= high").withColumn("segment", F.explode(F.sequence("low", "high")))
    return g.select("log_id", "segment", (F.col("k") - F.col("segment") * F.col("hop")).alias("i"), "size", "dt", "x")


def _averaged(power: DataFrame) -> DataFrame:
    return power.groupBy("log_id", "j").agg(F.min("frequency_hz").alias("frequency_hz"), F.avg("power").alias("power"))


def power_spectrum(log: DataFrame) -> DataFrame:
    """Rows (log_id, j, frequency_hz, power) without the constant term; a task holds one segment at a time."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        f, p = welch(table.column("x").to_numpy(), 1.0 / table.column("dt")[0].as_py())
        return pa.table({"log_id": pa.array([key[0].as_py()] * (len(f) - 1), pa.int64()), "j": pa.array(np.arange(1, len(f))), "frequency_hz": f[1:], "power": p[1:]})

    parts = welch_segments(log).select("log_id", "segment", "i", "dt", "x").groupBy("log_id", "segment")
    return _averaged(parts.applyInArrow(run, "log_id long, j long, frequency_hz double, power double"))


def dft_power(log: DataFrame) -> DataFrame:
    """The same spectrum of all logs, as a sum over the samples of each segment for each frequency: no Python at all."""
    g = welch_segments(log)
    window = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("i").cast("double") / F.col("size"))
    g = g.select("log_id", "segment", "i", "size", "dt", (F.col("x") * window).alias("xw"), (window * window).alias("ww")).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("size") / 2).cast("long"))))
    angle = 2 * math.pi * F.col("j") * F.col("i") / F.col("size")
    sums = g.groupBy("log_id", "segment", "size", "dt", "j").agg(F.sum(F.col("xw") * F.cos(angle)).alias("re"), F.sum(F.col("xw") * F.sin(angle)).alias("im"), F.sum("ww").alias("ww"))
    sides = F.when(F.col("j") * 2 == F.col("size"), 1.0).otherwise(2.0)
    return _averaged(sums.select("log_id", "j", (F.col("j") / (F.col("size") * F.col("dt"))).alias("frequency_hz"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.col("dt") / F.col("ww") * sides).alias("power")))


def spectral_peaks(spectrum: DataFrame, top: int = 3) -> DataFrame:
    """Rows (log_id, rank, frequency_hz, power, ratio): the strongest strict local maxima, or the strongest bin where there is none."""
    w, per = Window.partitionBy("log_id").orderBy("j"), Window.partitionBy("log_id")
    s = spectrum.withColumn("p0", F.lag("power").over(w)).withColumn("p1", F.lead("power").over(w)).withColumn("width", F.col("frequency_hz") - F.lag("frequency_hz").over(w))
    area = s.groupBy("log_id").agg(F.sum((F.col("power") + F.col("p0")) / 2 * F.col("width")).alias("total"), median(F.col("width")).alias("bin"))
    s = s.withColumn("peak", F.coalesce((F.col("power") > F.col("p0")) & (F.col("power") > F.col("p1")), F.lit(False)))
    s = s.withColumn("any", F.bool_or("peak").over(per)).withColumn("rank", F.row_number().over(per.orderBy(F.desc("peak"), F.desc("power"), "j")))
    s = s.filter(F.when(F.col("any"), F.col("peak") & (F.col("rank") <= top)).otherwise(F.col("rank") == 1))
    return s.join(area, "log_id").select("log_id", F.col("rank").cast("long").alias("rank"), "frequency_hz", "power", F.coalesce(F.try_divide(F.col("power") * F.col("bin"), F.col("total")), F.lit(0.0)).alias("ratio"), F.col("total").alias("total_power"))


def analyze_frequency(log: DataFrame, spectrum: DataFrame | None = None) -> DataFrame:
    """One row a log with a spectrum: dominant frequency, its share of the power, resolution and limits."""
    series = error_series(log).groupBy("log_id").agg(F.first("dt").alias("dt"), F.first("n_grid").alias("n_grid"), F.first("irregular").alias("irregular"))
    top = spectral_peaks(power_spectrum(log) if spectrum is None else spectrum, 1).select("log_id", F.col("frequency_hz").alias("dominant_frequency_hz"), F.col("ratio").alias("peak_ratio"), "total_power")
    return top.join(series, "log_id").select("log_id", "dominant_frequency_hz", "peak_ratio", "total_power", (0.5 / F.col("dt")).alias("nyquist_hz"), (1.0 / (F.col("dt") * F.col("n_grid"))).alias("min_frequency_hz"), "irregular", "n_grid", F.lit(True).alias("available"))
