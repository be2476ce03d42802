"""Reports of result documents: JSON, Markdown and HTML, one each a log, rendered by the executors."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import HYPOTHESES

#: Texts of the codes that documents carry; other languages pass a table of their own.
TEXTS = {
    "title": "Flight log report", "window": "Analysis window", "quality": "Data quality", "metrics": "Metrics", "hypotheses": "Hypotheses", "notes": "Notes",
    "disclaimer": "Scores rank what to review first; they are not probabilities.", "none": "none",
    "short_log": "The log is short", "duplicate_columns": "Column names repeat", "constant_columns": "Columns never change", "missing_values": "Values are missing", "missing_timestamp": "There is no time column", "invalid_timestamp": "Times are missing or invalid",
    "duplicate_timestamp": "Times repeat", "reverse_timestamp": "Times run backwards", "timestamp_gap_spikes": "There are large gaps in time", "infinite_values": "Values are infinite", "missing_ekf": "There is no altitude estimate",
    "missing_reference_altitude": "There is no reference altitude", "missing_motors": "Motor outputs are missing", "no_armed_segment": "The vehicle is never armed", "no_althold_active_segment": "Altitude hold is never active",
}


def _number(v) -> str:
    return "–" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def _measures(metrics: dict) -> list[tuple[str, object]]:
    """Plain measures by name, those of a section after its name."""
    return [m for k, v in metrics.items() for m in ([(f"{k}, {n}", x) for n, x in _measures(v)] if isinstance(v, dict) else [] if isinstance(v, list) else [(k, v)])]


def markdown(document: dict, texts: dict[str, str] = TEXTS) -> str:
    """A document as Markdown; list-valued metrics are left to the JSON."""
    say = lambda code: texts.get(code, TEXTS.get(code, code))
    window = document.get("analysis_window") or {}
    titles = {h.id: h.title for h in HYPOTHESES}
    out = [f"# {say('title')}", "", f"## {say('window')}", "", f"- {document.get('flight_phase')}: {_number(window.get('start_s'))} – {_number(window.get('end_s'))} s, {window.get('rows')} rows", "", f"## {say('quality')}", ""]
    out += [f"- {m['severity']}: {say(m['code'])} ({m['n']})" for m in document.get("validation_messages", [])] or [f"- {say('none')}"]
    out += ["", f"## {say('metrics')}", ""] + [f"- {k}: {_number(v)}" for k, v in _measures(document.get("metrics") or {})]
    out += ["", f"## {say('hypotheses')}", ""]
    for h in document.get("rule_based_hypotheses", []):
        out += [f"### {titles.get(h['hypothesis'], h['hypothesis'])} ({h['score']}/100)", ""]
        out += [f"- {d['rule']} {d['threshold']}: {d['result']} ({_number(d['observed'])}, {d['delta']:+d})" for d in h.get("details", [])]
        out += [f"- {x}" for x in h.get("limitations", [])] + [f"- missing: {', '.join(h['missing'])}"] * bool(h.get("missing")) + [""]
    return "\n".join([*out, f"## {say('notes')}", "", say("disclaimer"), ""])


def page(text: str) -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"></head><body><pre>{html.escape(text)}</pre></body></html>'


def reports(documents: DataFrame, texts: dict[str, str] = TEXTS) -> DataFrame:
    """Rows (log_id, json, markdown, html) of documents (log_id, document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [json.loads(d) for d in batch.column("document").to_pylist()]
            written = [markdown(d, texts) for d in parsed]
            pretty = [json.dumps(d, ensure_ascii=False, indent=2, allow_nan=False) for d in parsed]
            yield pa.RecordBatch.from_arrays([batch.column("log_id"), pa.array(pretty, pa.string()), pa.array(written, pa.string()), pa.array([page(w) for w in written], pa.string())], names=["log_id", "json", "markdown", "html"])

    return documents.select("log_id", "document").mapInArrow(run, "log_id long, json string, markdown string, html string")


def write_reports(documents: DataFrame, folder: str) -> None:
    """One table of reports for each format below ``folder``."""
    done = reports(documents)
    for kind in ("json", "markdown", "html"):
        done.select("log_id", F.col(kind).alias("content")).write.mode("overwrite").parquet(f"{folder}/{kind}")
