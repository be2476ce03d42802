"""Profiles of raw text columns of many logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, present, to_number

#: Texts that make a boolean column.
BOOLEAN_TEXTS = ("true", "false", "0", "1", "yes", "no", "on", "off")


def unpivoted(raw: DataFrame) -> DataFrame:
    """Rows (log_id, ord, position, column, value) of all text columns; texts that stand for missing are null."""
    names = [c for c in raw.columns if c not in ("log_id", "ord")]
    cells = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c).alias("column"), present(F.col(c).cast("string")).alias("value")) for k, c in enumerate(names)])
    return raw.select("log_id", "ord", F.explode(cells).alias("c")).select("log_id", "ord", "c.*")


def profile_columns(raw: DataFrame, samples: int = 5, looked_at: int = 500, share: float = 0.95) -> DataFrame:
    """One row a log and column: semantic type, non-null count, missing share, range, mean, spread (ddof 1), distinct count, and the values of its first rows, nulls too.

    A column is boolean if its first ``looked_at`` known values all are; numeric if ``share`` of all known values parse; unknown if
    none is known.
    """
    cells = unpivoted(raw)
    w = Window.partitionBy("log_id", "position").orderBy("ord")
    cells = cells.withColumn("place", F.row_number().over(w)).withColumn("nth", F.sum(F.col("value").isNotNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("number", to_number(F.col("value")))
    known = F.col("value").isNotNull()
    x = finite(F.col("number"))
    boolean = F.bool_and(F.when(known & (F.col("nth") <= looked_at), F.lower(F.trim("value")).isin(*BOOLEAN_TEXTS)))
    kind = F.when(F.count("value") == 0, "unknown").when(boolean, "boolean").when(F.avg(F.when(known, F.col("number").isNotNull().cast("int"))) >= share, "numeric").otherwise("string")
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.struct("place", "value")))), lambda v: v["value"])
    return cells.groupBy("log_id", "position", "column").agg(
        kind.alias("type"), F.count("value").alias("n"), F.avg((~known).cast("int")).alias("missing_ratio"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"), F.count_distinct("value").alias("n_distinct"), first.alias("first_values"), F.bool_and(F.when(x.isNotNull(), x.isin(0.0, 1.0))).alias("zero_one"),
    )
