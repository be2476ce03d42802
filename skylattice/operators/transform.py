"""From raw text columns to canonical parameters, and the unit of time."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, present, to_boolean, to_number
from ..settings import BOOLEAN, GROUPS, PARAMETERS, UNITS
from .mapping import Mapping, Profile
from .pieces import by_value, quantiles, scan

#: Last tokens of column names that state a unit of time.
TIME_TOKENS = {
    "s": "seconds", "sec": "seconds", "secs": "seconds", "second": "seconds", "seconds": "seconds",
    "ms": "milliseconds", "msec": "milliseconds", "millisecond": "milliseconds", "milliseconds": "milliseconds",
    "us": "microseconds", "usec": "microseconds", "microsecond": "microseconds", "microseconds": "microseconds",
}
FASTEST_HZ, SLOWEST_HZ, LONGEST_S = 2000.0, 0.2, 48 * 3600.0


class AmbiguousTime(ValueError):
    """The unit of time has to be chosen."""


def time_unit_of_name(column: str | None) -> str | None:
    text = unicodedata.normalize("NFKC", column or "").replace("µ", "u").replace("μ", "u").lower()
    found = re.findall(r"[a-z]+|[0-9]+", text)
    return TIME_TOKENS.get(found[-1]) if found else None


def infer_time_unit(log: DataFrame) -> DataFrame:
    """Rows (log_id, unit, confidence, n_distinct, n_units): units in which the usual step and the duration of a log are plausible."""
    t = log.select("log_id", finite(F.col("timestamp")).alias("t")).dropna().distinct()
    spans = t.groupBy("log_id").agg(F.count("*").alias("n_distinct"), (F.max("t") - F.min("t")).alias("span"))
    # pieces by value, as the unit is not known; a step is never zero between distinct times
    steps = scan(t, by_value(F.col("t")), ("t",), priors={"before": F.col("t")}).select("log_id", (F.col("t") - F.col("before")).alias("step"))
    f = spans.join(quantiles(steps, "step", {"step": 0.5}), "log_id", "left")
    fits = []
    for unit, factor in UNITS["time"].items():
        if factor:
            rate = F.try_divide(F.lit(1.0), F.col("step") * factor)
            span = F.col("span") * factor
            fits.append(F.when(rate.between(SLOWEST_HZ, FASTEST_HZ) & (span > 0) & (span <= LONGEST_S), F.lit(unit)))
    f = f.withColumn("units", F.filter(F.array(*fits), lambda u: u.isNotNull()))
    one, enough = F.size("units") == 1, F.col("n_distinct") >= 3
    confidence = F.when(F.col("n_distinct") < 2, 0.0).when(one & enough, 0.85).when(one, 0.6).when(F.size("units") > 1, 0.4).otherwise(0.2)
    return f.select("log_id", F.when(one & (F.col("n_distinct") >= 2), F.col("units")[0]).alias("unit"), confidence.alias("confidence"), "n_distinct", F.size("units").cast("long").alias("n_units"))


def resolve_time_unit(profile: Profile, mapping: Mapping, values: DataFrame | None = None) -> str:
    """The profile's unit, else the mapping's, else what the name says, else what every log's values say; AmbiguousTime otherwise."""
    for unit in (profile.time_unit, mapping.unit or "auto"):
        if unit not in UNITS["time"]:
            raise ValueError(f"unknown time unit: {unit}")
        if unit != "auto":
            return unit
    if named := time_unit_of_name(mapping.column):
        return named
    if values is not None:
        found = infer_time_unit(values).agg(F.min("unit").alias("a"), F.max("unit").alias("b"), F.min("confidence").alias("c")).first()
        if found.a and found.a == found.b and found.c >= 0.85:
            return found.a
    raise AmbiguousTime("the unit of time cannot be told; choose one")


def time_units(values: DataFrame, profile: Profile, mapping: Mapping, least: float = 0.85) -> DataFrame:
    """Rows (log_id, unit, confidence, n_distinct, n_units, decided_by) of every log of ``values`` (log_id, timestamp): the unit that the profile, the mapping or the
    column's name states, else what a log's own values say with ``least`` confidence; ``unit`` is null where that is ambiguous."""
    stated = [(by, u) for by, u in (("profile", profile.time_unit), ("mapping", mapping.unit or "auto"), ("name", time_unit_of_name(mapping.column) or "auto")) if u != "auto"]
    for _, unit in stated:
        if unit not in UNITS["time"]:
            raise ValueError(f"unknown time unit: {unit}")
    if stated:
        by, unit = stated[0]
        none = F.lit(None)
        return values.select("log_id").distinct().select("log_id", F.lit(unit).alias("unit"), none.cast("double").alias("confidence"), none.cast("long").alias("n_distinct"), none.cast("long").alias("n_units"), F.lit(by).alias("decided_by"))
    logs = values.select("log_id").distinct().join(infer_time_unit(values), "log_id", "left")
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False))
    return logs.select("log_id", F.when(sure, F.col("unit")).alias("unit"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"), F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"), F.when(sure, "values").alias("decided_by"))


def _value(parameter: str, m: Mapping) -> Column:
    raw = present(F.col(f"`{m.column}`").cast("string"))
    if parameter in BOOLEAN:
        return to_boolean(raw)
    return F.lit(-1.0 if m.invert_sign else 1.0) * to_number(raw) * m.scale + m.offset


def transform(raw: DataFrame, profile: Profile) -> tuple[DataFrame, list[str]]:
    """The canonical log (log_id, ord and the mapped parameters) in one projection, and warnings about columns that are missing."""
    maps = {p: profile.parameters[p] for p in PARAMETERS if p in profile.parameters}
    warnings = [f"missing_column:{m.column}" for m in maps.values() if m.column not in raw.columns]
    maps = {p: m for p, m in maps.items() if m.column in raw.columns}
    values = {p: _value(p, m) for p, m in maps.items()}
    if "timestamp" in maps:
        unit = resolve_time_unit(profile, maps["timestamp"], raw.select("log_id", values["timestamp"].alias("timestamp")))
        values["timestamp"] = values["timestamp"] * UNITS["time"][unit]
    for p, m in maps.items():
        if p not in BOOLEAN and p != "timestamp":
            values[p] = values[p] * UNITS[GROUPS[p]].get(m.unit, 1.0)
    return raw.select("log_id", "ord", *[v.alias(p) for p, v in values.items()]), warnings


def transform_each(raw: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame, list[str]]:
    """(canonical logs, refused logs, warnings about missing columns): as ``transform``, but with a unit of time for each log.

    Logs whose unit cannot be told are rows (log_id, reason, confidence, n_distinct, n_units) of the second table; the others are converted.
    """
    m = profile.parameters.get("timestamp")
    if m is None or m.column not in raw.columns:
        out, warnings = transform(raw, profile)
        kinds = "log_id long, reason string, confidence double, n_distinct long, n_units long"
        return out, raw.sparkSession.createDataFrame([], kinds), warnings
    units = time_units(raw.select("log_id", _value("timestamp", m).alias("timestamp")), profile, m)
    plain, warnings = transform(raw, Profile(profile.parameters, "seconds"))
    factor = F.coalesce(*[F.when(F.col("unit") == u, F.lit(f)) for u, f in UNITS["time"].items() if f])
    known = plain.join(units.filter("unit IS NOT NULL").select("log_id", "unit"), "log_id")
    out = known.withColumn("timestamp", F.col("timestamp") * factor).select(*plain.columns)
    reason = F.when(F.col("n_distinct") < 2, "too_few_times").when(F.col("n_units") > 1, "several_units_fit").when(F.col("n_units") == 0, "no_unit_fits").otherwise("low_confidence")
    return out, units.filter("unit IS NULL").select("log_id", reason.alias("reason"), "confidence", "n_distinct", "n_units"), warnings


def conversion_failures(raw: DataFrame, profile: Profile) -> DataFrame:
    """Rows (log_id, parameter, n): known texts that are no value of their parameter."""
    maps = {p: m for p, m in profile.parameters.items() if m.column in raw.columns}
    counts = [F.struct(F.lit(p).alias("parameter"), F.count_if(present(F.col(f"`{m.column}`").cast("string")).isNotNull() & _value(p, m).isNull()).alias("n")) for p, m in maps.items()]
    return raw.groupBy("log_id").agg(F.array(*counts).alias("c")).select("log_id", F.explode("c").alias("c")).select("log_id", "c.*").filter("n > 0")
