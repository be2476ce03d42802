"""Scalar and aggregate expressions with the library's treatment of nulls, NaN and infinities.

A NaN is a missing value; infinities stay until an operator asks for finite values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as missing, as delimited readers treat them.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Texts of booleans, lower case.
TRUE = ("1", "true", "yes", "on", "armed", "active")
FALSE = ("0", "false", "no", "off", "disarmed", "inactive")

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"^\s*[+-]?(inf|infinity|Inf|Infinity|INF|INFINITY)\s*$"


def present(raw: Column) -> Column:
    """The text, or null where it stands for a missing value."""
    return F.when(~raw.isin(*MISSING), raw)


def to_number(raw: Column) -> Column:
    """Double of a text; null where it is none.  Type suffixes (1d, 1f) are no numbers."""
    infinite = F.when(F.trim(raw).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(raw.rlike(_NUMBER), F.trim(raw).try_cast("double")).when(raw.rlike(_INFINITY), infinite)


def to_boolean(raw: Column) -> Column:
    text = F.lower(F.trim(raw.cast("string")))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def median(c: Column) -> Column:
    return F.percentile(c, 0.5)


def safe_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation of rows with both values finite; null for too few rows or a constant side."""
    both = finite(x).isNotNull() & finite(y).isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (spread > 0), F.try_divide(F.covar_pop(a, b), spread))


def motor_mean(motors: list[Column]) -> Column:
    """Mean of the motors that have a value."""
    known = F.filter(F.array(*motors), lambda m: m.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, m: s + m), F.size(known))


def motor_spread(motors: list[Column]) -> Column:
    """Largest minus smallest motor; 0 for one motor, null for none."""
    return F.greatest(*motors) - F.least(*motors) if len(motors) > 1 else motors[0] - motors[0]
