"""Running values over logs of any length: a log is dealt to pieces, each is summed up in one row, and what lies before a piece is carried into it.

A window over a whole log is one task, however long the log is.  Here windows see one piece only; the rows of a log's summary, one a piece,
are all that is ever ordered together.  Pieces follow from the values of a row alone, so nothing is sampled, written or collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a log in one piece by row number, and seconds in one by time: 64,000 rows at the fastest plausible rate.
PIECE_ROWS, PIECE_S = 1 << 16, 32.0
#: Pieces of values to each doubling: neighbours in a piece differ by less than a part in 5,000.
PIECES_A_DOUBLING = 4096


def by_row(order: Column | None = None) -> Column:
    """The piece of a row by ``ord``, the number of the row in its log."""
    return F.floor((F.col("ord") if order is None else order) / F.lit(PIECE_ROWS)).cast("long")


def by_time(time: Column) -> Column:
    """The piece of a time; infinite and NaN times have the outermost ones."""
    far = F.lit(1 << 62)
    return F.when(F.isnan(time) | (time >= 1e15), far).when(time <= -1e15, -far).otherwise(F.floor(time / F.lit(PIECE_S)).cast("long"))


def by_value(value: Column) -> Column:
    """The piece of a double by sign and logarithm, which never falls where the value rises; NaN comes last."""
    size = F.floor((F.least(F.log2(F.abs(value)), F.lit(1100.0)) + 1100.0) * float(PIECES_A_DOUBLING)).cast("long") + 1
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def scan(rows: DataFrame, piece: Column, order: tuple[str, ...], keys: tuple[str, ...] = ("log_id",), sums: Mapping[str, Column] | None = None, priors: Mapping[str, Column] | None = None, totals: Mapping[str, Column] | None = None) -> DataFrame:
    """``rows`` with, under the names given: ``sums``, running sums of integers up to and with the row; ``priors``, the value of the row before (null for the first);
    ``totals``, sums over the whole log.

    ``piece`` must not fall where ``order`` rises; ``order`` tells the rows of a key apart.
    """
    sums, priors, totals = dict(sums or {}), dict(priors or {}), dict(totals or {})
    here = rows.withColumn("_piece", piece)
    at = [*keys, "_piece"]
    last = F.struct(*order)
    summary = here.groupBy(*at).agg(
        *[F.coalesce(F.sum(e.cast("long")), F.lit(0)).alias(f"_sum_{n}") for n, e in sums.items()],
        *[F.max_by(F.struct(e.alias("v")), last).alias(f"_last_{n}") for n, e in priors.items()],
        *[F.coalesce(F.sum(e.cast("long")), F.lit(0)).alias(f"_all_{n}") for n, e in totals.items()],
    )
    log = Window.partitionBy(*keys)
    ahead, whole = log.orderBy("_piece"), log.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = summary.select(
        *at,
        *[F.coalesce(F.sum(f"_sum_{n}").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_sum_{n}") for n in sums],
        *[F.lag(f"_last_{n}").over(ahead).alias(f"_last_{n}") for n in priors],
        *[F.sum(f"_all_{n}").over(whole).alias(n) for n in totals],
    )
    inside = Window.partitionBy(*at).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = here.withColumns({f"_in_{n}": F.sum(e.cast("long")).over(upto) for n, e in sums.items()} | {f"_in_{n}": F.lag(F.struct(e.alias("v"))).over(inside) for n, e in priors.items()})
    joined = local.join(before, at)
    out = joined.withColumns(
        {n: F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.col(f"_sum_{n}") for n in sums} | {n: F.coalesce(F.col(f"_in_{n}"), F.col(f"_last_{n}"))["v"] for n in priors}
    )
    return out.drop("_piece", *[f"_{k}_{n}" for n in sums for k in ("in", "sum")], *[f"_{k}_{n}" for n in priors for k in ("in", "last")])


def ranked(rows: DataFrame, value: str, keys: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Rows (keys, v, n, upto, of): the distinct values of a double column with their number, the number of values up to and with them, and of all.

    Equal values are counted before they travel.  Counts by pieces of the values, added up, tell what lies before a piece, and only inside a piece
    values are put in order; no state holds the values of a log.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    return scan(counts, by_value(F.col("v")), ("v",), keys, sums={"upto": F.col("n")}, totals={"of": F.col("n")})


def picked(p: float) -> Column:
    """The exact quantile of a key of ``ranked`` rows as an aggregate: between two values by linear interpolation."""
    place = F.lit(float(p)) * (F.col("of") - 1)  # from 0
    low = F.floor(place).cast("long")
    held = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("v")))
    part = F.max(place - low)
    a, b = held(low), held(F.least(low + 1, F.col("of") - 1))
    return F.when(part == 0, a).otherwise((1 - part) * a + part * b)


def quantiles(rows: DataFrame, value: str, wanted: Mapping[str, float], keys: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """One row for each of ``keys`` with a value: exact quantiles of a double column."""
    return ranked(rows, value, keys).groupBy(*keys).agg(*[picked(p).alias(n) for n, p in wanted.items()])
