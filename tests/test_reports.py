"""Reports, the border to an explaining service, and streams."""

import inspect
import json
import re

import pytest

from skylattice.operators import lag, spectrum, steps
from skylattice.plans import analysis, explain, report
from skylattice.streaming import live

DOCUMENT = {
    "flight_phase": "armed", "analysis_window": {"start_s": 0.0, "end_s": 1.23456789, "rows": 9}, "metrics": {"rmse_m": 0.5, "peaks": [1]}, "validation_messages": [{"severity": "warning", "code": "short_log", "n": 9}],
    "rule_based_hypotheses": [{"hypothesis": "cg_asymmetry", "score": 50, "missing": ["motor_1"], "limitations": ["<careful>"], "details": [{"rule": "motor spread", "delta": 50, "result": "met", "observed": 90.0, "threshold": ">= 80 us"}]}],
}


def test_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, json.dumps(DOCUMENT))], "log_id long, document string")
    row = report.reports(docs).first()
    assert json.loads(row.json) == DOCUMENT and "1.23457 s" in row.markdown and "The log is short (9)" in row.markdown and "50/100" in row.markdown and "peaks" not in row.markdown
    assert "&lt;careful&gt;" in row.html
    report.write_reports(docs, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "html")).count() == 1


def test_border():
    assert explain.forbidden_keys({"a": [{"Rows": 1}], "csv": 2}) == ["a.Rows", "csv"]

    class Client:
        def generate(self, payload):
            raise TimeoutError("secret text of a provider")

    with pytest.raises(explain.ExplainError) as e:
        explain.explain(Client(), "{}")
    assert e.value.code == "timeout" and "secret" not in str(e.value)
    with pytest.raises(ValueError):
        explain.explain(Client(), '{"records": []}')
    assert explain.base_url("https://x.test/v1/v1/") == "https://x.test/v1" and explain.base_url("http://h:1") == "http://h:1/v1"
    with pytest.raises(ValueError):
        explain.base_url("x")


def test_live_windows(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:0{k}:00", float(k), 1.0, 0.5, 200.0 if k % 2 else 0.0, True) for k in range(8)]
    table = spark.createDataFrame(rows, "log_id long, t string, timestamp double, altitude_setpoint double, ekf_altitude double, throttle_correction double, armed boolean").selectExpr("log_id", "cast(t as timestamp) ts", "timestamp", "altitude_setpoint", "ekf_altitude", "throttle_correction", "armed")
    table.write.parquet(str(tmp_path / "in"))
    for name, make in (("windows", live.live_windows), ("sessions", live.live_sessions)):
        q = make(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append" if name == "sessions" else "complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    got = spark.sql("SELECT * FROM windows").collect()
    assert sum(r.rows for r in got) == 8 and all(r.rmse_m == 0.5 for r in got)


def test_every_code_has_a_text_in_both_languages():
    from skylattice.operators import lag, segments, steps
    from skylattice.plans import language, rules

    said = {c for m in (segments, steps) for c in re.findall(r'"([a-z]+(?:_[a-z0-9]+)+)"', inspect.getsource(m.validate if m is segments else m.step_state) + (inspect.getsource(steps.step_responses) if m is steps else ""))}
    codes = {c for c in said if c in language.TEXTS} | set(lag.REASONS) | set(lag.CAVEATS.values()) | {r.name for r in rules.RULES} | {"met", "unmet", "not computable", "empty_csv", "no_step", "too_few_rows", "times_not_increasing", "no_timestamp"}
    codes |= set(re.findall(r'\("(?:error|warning|info)", "([a-z_]+)"', inspect.getsource(segments.validate))) | set(re.findall(r'"(below_10_percent|below_90_percent|not_settled)"', inspect.getsource(steps.step_responses)))
    assert len(codes) > 55 and all(len(language.TEXTS[c]) == 2 and all(language.TEXTS[c]) for c in codes)
    for en, ko in language.TEXTS.values():
        assert set(re.findall(r"{\w+}", en)) == set(re.findall(r"{\w+}", ko))


def test_documents_in_a_language(spark):
    from skylattice.plans import language

    document = {"flight_phase": "lag", "metrics": {"altitude": {"dynamic_metrics_reason": "no_step", "n": 1}}, "messages": [{"severity": "warning", "code": "short_log", "n": 7}, {"code": "new_code"}], "rule_based_hypotheses": [{"hypothesis": "lag", "details": [{"rule": "lag", "result": "met"}]}]}
    table = spark.createDataFrame([(1, json.dumps(document), "x"), (2, None, "y")], "log_id long, document string, `a.b` string")
    got = language.localised(table, language.texts(spark), "ko")
    assert got.columns == table.columns
    rows = {r.log_id: r.document for r in got.collect()}
    said = json.loads(rows[1])
    assert rows[2] is None and said["messages"] == [{"severity": "warning", "code": "로그가 7행으로 짧음", "n": 7}, {"code": "new_code"}] and said["flight_phase"] == "lag"
    assert said["rule_based_hypotheses"] == [{"hypothesis": "lag", "details": [{"rule": "지연", "result": "충족"}]}] and said["metrics"]["altitude"] == {"dynamic_metrics_reason": language.TEXTS["no_step"][1], "n": 1}
    own = spark.createDataFrame([("de", "no_step", "Kein Sprung")], "language string, code string, text string")
    assert json.loads(language.localised(table, language.texts(spark).union(own), "de").filter("log_id = 1").first().document)["metrics"]["altitude"]["dynamic_metrics_reason"] == "Kein Sprung"
    with pytest.raises(ValueError, match="no texts"):
        language.localised(table, own, "fr")


def test_steps_and_spectra_are_computed_once(spark, monkeypatch):
    """A document's metrics and lists come from the same steps and spectrum; a payload shows no lists and makes none."""
    calls = {"plateaus": 0, "welch_segments": 0, "step_state": 0, "motor_metrics": 0}

    def counted(module, name):
        own = getattr(module, name)

        def call(*args, **more):
            calls[name] += 1
            return own(*args, **more)

        monkeypatch.setattr(module, name, call)

    for module, name in ((steps, "plateaus"), (spectrum, "welch_segments"), (steps, "step_state"), (analysis, "motor_metrics")):
        counted(module, name)
    for module in (analysis, lag):
        monkeypatch.setattr(module, "stored", lambda df, name: df)  # only the plans are looked at
    log = spark.createDataFrame([], "log_id long, ord long, timestamp double, altitude_setpoint double, ekf_altitude double, motor_1 double")
    assert analysis.documents(log, log).columns == ["log_id", "document"]
    assert calls == {"plateaus": 1, "welch_segments": 1, "step_state": 1, "motor_metrics": 1}
    assert analysis.summary_payload(log, log).columns == ["log_id", "payload"]
    assert calls == {"plateaus": 2, "welch_segments": 2, "step_state": 1, "motor_metrics": 1}
