"""Segments of a log: runs of a flag in row order, and ranges of time.  Every operator works on many logs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import present
from ..settings import BOOLEAN, MOTORS, NUMERIC, Settings
from .pieces import by_row, scan


def W():
    return Window.partitionBy("log_id").orderBy("ord")


def has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def islands(df: DataFrame, **flags: Column) -> DataFrame:
    """Rows with ``pos``, their place in the log from 0, and for each flag ``on_<name>`` and ``run_<name>``, the number of its maximal run (a null is
    false).  Runs go on across the pieces of a long log."""
    on = {n: F.coalesce(f, F.lit(False)) for n, f in flags.items()}
    counted = scan(df, by_row(), ("ord",), sums={"pos": F.lit(1)} | {f"run_{n}": ~f for n, f in on.items()})
    return counted.withColumns({"pos": F.col("pos") - 1} | {f"on_{n}": f for n, f in on.items()})


def detect_segments(log: DataFrame) -> DataFrame:
    """Rows (log_id, kind, segment, start_s, end_s, rows, start_index, end_index): runs of armed, and of altitude hold while armed.

    Start and end are the times of the first and last row of a run, not its least and greatest times.  Logs without times, or
    without either flag, have no segments.
    """
    if not has(log, "timestamp"):
        log = log.withColumn("timestamp", F.lit(None).cast("double")).limit(0)
    if not has(log, "armed") and not has(log, "althold_active"):
        log = log.withColumn("armed", F.lit(False)).limit(0)
    flags = {}
    armed = F.coalesce(F.col("armed"), F.lit(False)) if has(log, "armed") else F.lit(True)
    if has(log, "armed"):
        flags["armed"] = armed
    if has(log, "althold_active"):
        flags["althold"] = armed & F.coalesce(F.col("althold_active"), F.lit(False))
    kind = F.explode(F.filter(F.array(*[F.when(F.col(f"on_{n}"), F.struct(F.lit(n).alias("kind"), F.col(f"run_{n}").alias("run"))) for n in flags]), lambda k: k.isNotNull()))
    rows = islands(log.select("log_id", "ord", "timestamp", *(c for c in BOOLEAN if has(log, c))), **flags).select("log_id", "pos", "timestamp", kind.alias("k"))
    runs = rows.groupBy("log_id", "k.kind", "k.run").agg(F.min_by("timestamp", "pos").alias("start_s"), F.max_by("timestamp", "pos").alias("end_s"), F.count("*").alias("rows"), F.min("pos").alias("start_index"), F.max("pos").alias("end_index"))
    numbered = scan(runs, by_row(F.col("start_index")), ("start_index",), ("log_id", "kind"), sums={"segment": F.lit(1)})
    return numbered.select("log_id", "kind", "segment", "start_s", "end_s", "rows", "start_index", "end_index")


def select_time_range(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows with a time between the bounds, both included and in either order."""
    return log.filter(F.col("timestamp").between(F.least(start, end), F.greatest(start, end)))


PHASES = {"full": "full_log", "auto_althold": "altitude_hold", "althold": "altitude_hold", "armed": "armed", "custom": "custom"}


def select_segment(log: DataFrame, mode: str = "auto_althold", segment: int = 1, start_s: float | None = None, end_s: float | None = None) -> DataFrame:
    """The analysis rows of each log, with ``phase``.  Modes: full, custom (a time range), armed, althold, and auto_althold
    (the first altitude-hold run).  Rows are chosen by the run's range of times; logs without the run yield no rows."""
    phase = F.lit(PHASES[mode])
    if mode == "full":
        return log.withColumn("phase", phase)
    if mode == "custom":
        return select_time_range(log, F.lit(start_s), F.lit(end_s)).withColumn("phase", phase)
    kind = "armed" if mode == "armed" else "althold"
    runs = detect_segments(log).filter((F.col("kind") == kind) & (F.col("segment") == (1 if mode == "auto_althold" else segment)))
    runs = runs.select("log_id", F.col("start_s").alias("_from"), F.col("end_s").alias("_to"))
    if not has(log, "timestamp"):
        return log.limit(0).withColumn("phase", phase)
    return select_time_range(log.join(runs, "log_id"), F.col("_from"), F.col("_to")).drop("_from", "_to").withColumn("phase", phase)


def sorted_unique_time(log: DataFrame) -> DataFrame:
    """Rows with a time, the first of each time, and ``n_duplicate``/``n_reverse`` of their log."""
    timed = log.filter(F.col("timestamp").isNotNull())
    timed = scan(timed, by_row(), ("ord",), priors={"_before": F.col("timestamp")})
    timed = timed.withColumn("_nth", F.row_number().over(Window.partitionBy("log_id", "timestamp").orderBy("ord")))
    counts = timed.groupBy("log_id").agg(F.count_if(F.col("_nth") > 1).alias("n_duplicate"), F.count_if(F.col("timestamp") < F.col("_before")).alias("n_reverse"))
    return timed.filter("_nth = 1").drop("_nth", "_before").join(counts, "log_id")


def validate(log: DataFrame, settings: Settings = Settings(), raw: DataFrame | None = None, duplicate_columns: tuple[str, ...] = (), expected: DataFrame | None = None) -> DataFrame:
    """Rows (log_id, severity, code, n) of findings, one aggregate a log.

    ``raw``: the log's text columns, for checks of the file; texts that stand for missing values are missing there, and ``file_hash`` is no column of the file.
    ``expected``: log ids (``log_id``) that should be there; those without a row have ``empty_csv`` and nothing else.
    """
    columns = set(log.columns)
    numeric = [c for c in NUMERIC if c in columns]
    aggs = [F.count("*").alias("rows")]
    if "timestamp" in columns:
        aggs += [F.sum(F.col("timestamp").isNull().cast("long")).alias("null_time")]
    endless = [F.coalesce((F.abs(F.col(c)) == float("inf")).cast("long"), F.lit(0)) for c in numeric]
    aggs.append(F.sum(sum(endless, F.lit(0))).alias("infinite"))
    for flag in BOOLEAN:
        if flag in columns:
            aggs.append(F.coalesce(F.bool_or(F.coalesce(F.col(flag), F.lit(False))), F.lit(False)).alias(f"any_{flag}"))
    facts = log.groupBy("log_id").agg(*aggs)
    if "timestamp" in columns:
        from .timing import analyze_timing

        facts = facts.join(analyze_timing(log, log, settings).select("log_id", "n_duplicate", "n_reverse", "n_dropout"), "log_id", "left")
    checks = [("warning", "short_log", F.when(F.col("rows") < settings.min_rows, F.col("rows")))]
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    always = F.lit(1).cast("long")
    if raw is not None:
        texts = [present(F.col("`" + c.replace("`", "``") + "`").cast("string")) for c in raw.columns if c not in ("log_id", "ord", "file_hash")]
        constant = sum(((F.count_distinct(c) <= 1).cast("long") for c in texts), F.lit(0))
        missing = sum((F.count_if(c.isNull()) for c in texts), F.lit(0))
        facts = facts.join(raw.groupBy("log_id").agg(constant.alias("constant"), missing.alias("missing")), "log_id", "left")
        checks += [("warning", "constant_columns", positive("constant")), ("warning", "missing_values", positive("missing"))]
    if duplicate_columns:
        checks.append(("error", "duplicate_columns", F.lit(len(duplicate_columns)).cast("long")))
    if "timestamp" in columns:
        checks += [("error", "invalid_timestamp", positive("null_time")), ("warning", "duplicate_timestamp", positive("n_duplicate")), ("warning", "reverse_timestamp", positive("n_reverse")), ("warning", "timestamp_gap_spikes", positive("n_dropout"))]
    else:
        checks.append(("error", "missing_timestamp", always))
    checks.append(("warning", "infinite_values", positive("infinite")))
    if "ekf_altitude" not in columns:
        checks.append(("error", "missing_ekf", always))
    if "reference_altitude" not in columns:
        checks.append(("warning", "missing_reference_altitude", always))
    if not set(MOTORS) <= columns:
        checks.append(("info", "missing_motors", always))
    for flag, code in zip(BOOLEAN, ("no_armed_segment", "no_althold_active_segment"), strict=True):
        if flag in columns:
            checks.append(("warning", code, F.when(~F.col(f"any_{flag}"), always)))
    found = F.filter(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), n.cast("long").alias("n")) for s, c, n in checks]), lambda x: x["n"].isNotNull())
    out = facts.select("log_id", F.explode(found).alias("m")).select("log_id", "m.severity", "m.code", "m.n")
    if expected is None:
        return out
    lacking = expected.select("log_id").distinct().join(log.select("log_id").distinct(), "log_id", "left_anti")
    return out.union(lacking.select("log_id", F.lit("error"), F.lit("empty_csv"), F.lit(0).cast("long")))
