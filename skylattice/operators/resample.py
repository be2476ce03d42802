"""Uniform time grids: linear interpolation between the samples around each grid time, and detrending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def uniform_grid(samples: DataFrame, count: str, values: tuple[str, ...], keys: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Rows (keys, k, t, values) on the grid t = t0 + k * dt.

    ``samples`` has keys, timestamp (distinct in a key), the values, and per key ``t0``, ``dt`` and the grid's size in column ``count``.
    Every stretch between two samples makes the grid times inside it, so there is no join by time; beyond the last sample its
    value holds.
    """
    w = Window.partitionBy(*keys).orderBy("timestamp")
    s = samples.withColumn("t1", F.lead("timestamp").over(w))
    for v in values:
        s = s.withColumn(f"{v}_next", F.lead(v).over(w))
    near = F.greatest(F.lit(0), F.floor((F.col("timestamp") - F.col("t0")) / F.col("dt")).cast("long") - 1)
    upto = F.least(F.col(count) - 1, F.coalesce(F.ceil((F.col("t1") - F.col("t0")) / F.col("dt")).cast("long") + 1, F.col(count) - 1))
    grid = s.filter(near <= upto).withColumn("k", F.explode(F.sequence(near, upto))).withColumn("t", F.col("t0") + F.col("k") * F.col("dt"))
    grid = grid.filter((F.col("t") >= F.col("timestamp")) & F.coalesce(F.col("t") < F.col("t1"), F.lit(True)))
    line = lambda v: F.coalesce(F.col(v) + (F.col(f"{v}_next") - F.col(v)) / (F.col("t1") - F.col("timestamp")) * (F.col("t") - F.col("timestamp")), F.col(v))
    return grid.select(*keys, "k", "t", count, "dt", *[line(v).alias(v) for v in values])


def detrended(grid: DataFrame, values: tuple[str, ...], keys: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Take each key's least-squares line over k off the values; adds ``<value>_std`` of what is left."""
    per = Window.partitionBy(*keys)
    k = F.col("k").cast("double")
    mid, spread = F.avg(k).over(per), F.var_pop(k).over(per)
    out = grid
    for v in values:
        slope = F.coalesce(F.try_divide(F.covar_pop(F.col(v), k).over(per), spread), F.lit(0.0))
        out = out.withColumn(f"_{v}", F.col(v) - F.avg(v).over(per) - slope * (k - mid))
    out = out.drop(*values).withColumnsRenamed({f"_{v}": v for v in values})
    for v in values:
        out = out.withColumn(f"{v}_std", F.stddev_pop(v).over(per))
    return out
