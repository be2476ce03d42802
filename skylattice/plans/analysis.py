"""The whole analysis of many logs: all metrics, the scored hypotheses, and one result document a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.actuator import analyze_actuators, motor_metrics
from ..operators.altitude import altitude_error, steady_state_error
from ..operators.lag import CAVEATS, lag_analysis, sensor_statistics
from ..operators.mapping import reference_source
from ..operators.spectrum import analyze_frequency, power_spectrum, spectral_peaks
from ..operators.steps import primary_step, step_report, step_responses
from ..operators.timing import analyze_timing, dropouts
from ..settings import MOTORS, PARAMETERS, Settings
from ..storage import stored
from .explain import forbidden_fields
from .rules import METRICS, evaluate

SCHEMA_VERSION = "1.1"


def _read_often(full: DataFrame, analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The logs, written once: every section reads them."""
    same = analysis is full
    full = stored(full, "logs")
    return full, full if same else stored(analysis, "analysis")


def log_metrics(full: DataFrame, analysis: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One wide row a log of ``full``.  Timing counts see the full log, everything else the analysis rows; sections join by log_id, one to one."""
    return _metrics(*_read_often(full, analysis), settings)


def _metrics(full: DataFrame, analysis: DataFrame, settings: Settings, responses: DataFrame | None = None, spectrum: DataFrame | None = None) -> DataFrame:
    timing = analyze_timing(full, analysis, settings).withColumnRenamed("available", "timing_available").withColumnRenamed("duration_s", "timing_duration_s")
    parts = [altitude_error(analysis).drop("n"), steady_state_error(analysis, settings), primary_step(analysis, settings, responses), analyze_actuators(analysis, settings).drop("available")]
    if {"reference_altitude", "ekf_altitude"} <= set(analysis.columns):
        lag = lag_analysis(analysis, settings.lag).select("log_id", "estimated_lag_s", "max_correlation", "reliable", "confidence", F.col("reason").alias("lag_reason"))
        parts += [sensor_statistics(analysis).drop("n", "reference_mean_m", "ekf_mean_m", "reference_std_m", "ekf_std_m"), lag]
    parts.append(analyze_frequency(analysis, spectrum).drop("available", "n_grid"))
    out = timing
    for p in parts:
        out = out.join(p, "log_id", "left")
    for m in METRICS:
        if m not in out.columns:
            out = out.withColumn(m, F.lit(None).cast("boolean" if m == "reliable" else "double"))
    return stored(out, "metrics")


def diagnose(full: DataFrame, analysis: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return evaluate(log_metrics(full, analysis, settings), tuple(c for c in analysis.columns if c in PARAMETERS))


#: Fields of a document's sections of metrics, where ``log_metrics`` has them; lists are added by ``sections``.
SECTIONS = {
    "timing": ("timing_available", "n_duplicate", "n_reverse", "mean_s", "median_s", "std_s", "frequency_hz", "jitter", "timing_duration_s", "n_dropout"),
    "altitude": ("rmse_m", "mae_m", "mean_error_m", "error_std_m", "max_abs_error_m", "p95_abs_error_m", "steady_state_error_m", "amplitude_m", "rise_time_s", "settling_time_s", "overshoot_m", "undershoot_m", "n_steps"),
    "actuator": (
        "mean_base_throttle_pwm", "mean_throttle_correction_pwm", "correction_std_pwm", "correction_saturation_ratio", "positive_saturation_ratio", "negative_saturation_ratio", "max_continuous_saturation_s",
        "mean_motor_spread_pwm", "max_motor_std_pwm", "max_motor_saturation_ratio",
    ),
    "sensor_comparison": ("bias_m", "difference_std_m", "correlation", "motor_error_correlation", "correction_step_correlation", "estimated_lag_s", "max_correlation", "reliable", "confidence", "lag_reason"),
    "frequency": ("dominant_frequency_hz", "peak_ratio", "total_power", "nyquist_hz", "min_frequency_hz", "irregular"),
}
#: A section is available if this field is known.
KNOWN_BY = {"timing": "median_s", "altitude": "rmse_m", "sensor_comparison": "bias_m", "frequency": "dominant_frequency_hz"}


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row a log: its rows as a list of structs in the order of the columns."""
    return rows.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def sections(metrics: DataFrame, analysis: DataFrame, settings: Settings = Settings(), source: str = "other", lists_too: bool = True, responses: DataFrame | None = None, spectrum: DataFrame | None = None) -> DataFrame:
    """Rows (log_id, metrics) of every log of ``metrics``: nested sections with a flag ``available`` and, but for ``lists_too`` false, reasons and the lists of steps, dropouts, motors and peaks.
    ``responses`` and ``spectrum`` are used where they are at hand."""
    clean = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes}
    out = metrics
    lists: dict[str, list] = {n: [] for n in SECTIONS}
    if lists_too:
        out = metrics.drop("primary_step_index").join(step_report(analysis, settings, responses), "log_id", "left")
        lists["altitude"] = ["dynamic_metrics_reason", "primary_step_index", "step_responses"]
    if lists_too and "timestamp" in analysis.columns:
        out = out.join(_listed(dropouts(analysis, settings), "dropouts", "start_s", "end_s", "gap_s"), "log_id", "left")
        lists["timing"] = ["dropouts"]
    if lists_too and any(m in analysis.columns for m in MOTORS):
        out = out.join(_listed(motor_metrics(analysis, settings), "motors", "motor", "mean_pwm", "std_pwm", "saturation_ratio"), "log_id", "left")
        lists["actuator"] = ["motors"]
    if lists_too and {"timestamp", "altitude_setpoint", "ekf_altitude"} <= set(analysis.columns):
        peaks = spectral_peaks(power_spectrum(analysis) if spectrum is None else spectrum)
        out = out.join(_listed(peaks, "peaks", "rank", "frequency_hz", "power", "ratio"), "log_id", "left")
        lists["frequency"] = ["peaks"]
    whole = []
    for name, fields in SECTIONS.items():
        held = [c for c in fields if c in metrics.columns]
        by = [c for c in ([KNOWN_BY[name]] if name in KNOWN_BY else fields) if c in metrics.columns]  # any field of the actuators will do
        known = F.exists(F.array(*[F.col(c).isNotNull() for c in by]).cast("array<boolean>"), lambda x: x) if by else F.lit(False)
        more = [F.coalesce(F.col(c), F.array()).alias(c) if c in ("dropouts", "motors", "peaks") else F.col(c) for c in lists[name]]
        more += [F.lit(CAVEATS[source]).alias("caveat")] if name == "sensor_comparison" else []
        whole.append(F.struct(known.alias("available"), *[clean[c] for c in held if c != "timing_available"], *more).alias(name))
    return out.select("log_id", F.struct(*whole).alias("metrics"))


def documents(full: DataFrame, analysis: DataFrame, settings: Settings = Settings(), mapping: dict[str, str] | None = None, messages: DataFrame | None = None, source: str = "auto") -> DataFrame:
    """Rows (log_id, document), one for every log of ``full``: the result of a log as JSON.  NaN and infinities are null, null fields are kept.

    ``source`` of the reference altitude is told by the name of its column in ``mapping`` where it is auto.
    """
    return _told(full, analysis, settings, mapping, messages, source).select("log_id", F.to_json("document", {"ignoreNullFields": "false"}).alias("document"))


def _told(full: DataFrame, analysis: DataFrame, settings: Settings, mapping: dict[str, str] | None, messages: DataFrame | None, source: str, lists_too: bool = True) -> DataFrame:
    mapping = mapping or {p: p for p in PARAMETERS if p in analysis.columns}
    source = reference_source(mapping.get("reference_altitude"), source)
    full, analysis = _read_often(full, analysis)
    responses = spectrum = None
    if lists_too and {"timestamp", "altitude_setpoint", "ekf_altitude"} <= set(analysis.columns):  # read by the metrics and by the lists
        responses, spectrum = stored(step_responses(analysis, settings), "steps"), stored(power_spectrum(analysis), "spectrum")
    metrics = _metrics(full, analysis, settings, responses, spectrum)
    found = evaluate(metrics, tuple(c for c in analysis.columns if c in PARAMETERS))
    ranked = _listed(found, "hypotheses", "rank", "hypothesis", "score", "missing", "limitations", "details")
    times = [F.min("timestamp").alias("start_s"), F.max("timestamp").alias("end_s")] if "timestamp" in analysis.columns else [F.first(F.lit(None).cast("double")).alias(n) for n in ("start_s", "end_s")]
    phase = F.first("phase") if "phase" in analysis.columns else F.first(F.lit("custom"))
    window = analysis.groupBy("log_id").agg(F.struct(*times, F.count("*").alias("rows")).alias("analysis_window"), phase.alias("flight_phase"))
    nothing = F.struct(F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), F.lit(0).cast("long").alias("rows"))
    out = sections(metrics, analysis, settings, source, lists_too, responses, spectrum).join(ranked, "log_id").join(window, "log_id", "left").withColumn("analysis_window", F.coalesce("analysis_window", nothing))
    kind = "array<struct<severity:string,code:string,n:bigint>>"
    out = out.join(_listed(messages, "messages", "severity", "code", "n"), "log_id", "left") if messages is not None else out.withColumn("messages", F.lit(None).cast(kind))
    out = out.withColumn("messages", F.coalesce("messages", F.array().cast(kind)))
    missing = sorted(set(mapping) - set(analysis.columns))
    pairs = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) if kv[1] for x in kv]) if any(mapping.values()) else F.create_map().cast("map<string,string>")
    warned = F.transform(F.filter("messages", lambda m: m["severity"].isin("error", "warning")), lambda m: m["code"])
    document = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "log_id", F.coalesce("flight_phase", F.lit("custom")).alias("flight_phase"), F.lit(source).alias("reference_altitude_source"), "analysis_window", pairs.alias("parameter_mapping"), "metrics",
        F.col("hypotheses").alias("rule_based_hypotheses"), F.array(*map(F.lit, missing)).cast("array<string>").alias("missing_parameters"), F.col("messages").alias("validation_messages"), warned.alias("analysis_warnings"),
    )
    return out.select("log_id", document.alias("document"))


def summary_payload(full: DataFrame, analysis: DataFrame, settings: Settings = Settings(), mapping: dict[str, str] | None = None, messages: DataFrame | None = None, source: str = "auto", language: str | None = None) -> DataFrame:
    """Rows (log_id, payload): what an explanation may see of a document; never rows of the log.  A field of a forbidden name is an error before anything runs."""
    d = lambda path: F.col(f"document.{path}")
    features = F.struct(
        d("metrics.altitude.rmse_m").alias("altitude_rmse_m"), d("metrics.actuator.mean_throttle_correction_pwm"), d("metrics.actuator.correction_saturation_ratio"),
        d("metrics.frequency.dominant_frequency_hz"), d("metrics.sensor_comparison.bias_m").alias("reference_ekf_bias_m"),
    )
    window = F.struct(d("analysis_window.start_s"), d("analysis_window.end_s"), d("analysis_window.rows").alias("row_count"))
    fields = [d("flight_phase"), d("reference_altitude_source"), window.alias("analysis_window"), d("parameter_mapping"), features.alias("features"), d("rule_based_hypotheses"), d("missing_parameters"), d("analysis_warnings")]
    fields += [F.lit(language).alias("response_language")] if language else []
    out = _told(full, analysis, settings, mapping, messages, source, lists_too=False).select("log_id", F.struct(*fields).alias("payload"))
    if found := forbidden_fields(out.schema["payload"].dataType):
        raise ValueError(f"raw data must stay here: {', '.join(found)}")
    return out.select("log_id", F.to_json("payload", {"ignoreNullFields": "false"}).alias("payload"))
