"""Strict answers, and the catalogue of mapping profiles."""

import itertools
import json
import random
import re

from pyspark.sql import functions as F

from skylattice.operators import catalogue, mapping
from skylattice.plans import explain

REVIEW = {"hypothesis_id": "h", "priority": 1, "explanation": "e", "supporting_evidence": ["a"], "counter_evidence": [], "uncertainties": []}
TRIAL = {"title": "t", "purpose": "p", "variables_to_change": [], "variables_to_log": ["x"], "expected_observation": "o", "safety_notes": []}
GOOD = {"summary": "s", "hypothesis_review": [REVIEW, REVIEW | {"priority": 7}], "additional_hypotheses": [], "recommended_experiments": [TRIAL], "missing_data_requests": ["é"]}


def test_answers_are_taken_as_they_are_or_refused(spark):
    cases = {
        json.dumps(GOOD): [],
        json.dumps(GOOD | {"hypothesis_review": [], "recommended_experiments": []}): [],
        json.dumps(GOOD | {"hypothesis_review": [REVIEW, REVIEW | {"priority": 0}]}): ["$.hypothesis_review[1].priority:below_one"],
        json.dumps(GOOD | {"hypothesis_review": [REVIEW | {"priority": "1"}]}): ["$.hypothesis_review[0].priority:wrong_type"],
        json.dumps(GOOD | {"hypothesis_review": [REVIEW | {"priority": 1.5, "z": None}]}): ["$.hypothesis_review[0].z:unknown_key", "$.hypothesis_review[0].priority:wrong_type"],
        json.dumps(GOOD | {"b": 1, "a": {"x": []}}): ["$.a:unknown_key", "$.b:unknown_key"],
        json.dumps({k: v for k, v in GOOD.items() if k != "summary"}): ["$.summary:missing_key"],
        json.dumps(GOOD | {"summary": None}): ["$.summary:wrong_type"],
        json.dumps(GOOD | {"missing_data_requests": ["x", 1, None, ["y"]]}): [f"$.missing_data_requests[{k}]:wrong_type" for k in (1, 2, 3)],
        json.dumps(GOOD | {"recommended_experiments": [5, {k: v for k, v in TRIAL.items() if k != "title"}]}): ["$.recommended_experiments[0]:wrong_type", "$.recommended_experiments[1].title:missing_key"],
        json.dumps(GOOD | {"additional_hypotheses": "x"}): ["$.additional_hypotheses:wrong_type"],
        json.dumps([GOOD]): ["$:wrong_type"],
        '{"summary": "a", "summary": "b"}': ["$:not_json"],
        "{": ["$:not_json"],
        "": ["$:not_json"],
        None: ["$:not_json"],
    }
    table = spark.createDataFrame([(t,) for t in cases], "answer string")
    rows = {r.answer: r for r in explain.strict(table).collect()}
    assert {t: [f"{f.path}:{f.code}" for f in rows[t].faults] for t in cases} == cases
    assert all((rows[t].parsed is None) == bool(cases[t]) for t in cases)
    assert rows[json.dumps(GOOD)].parsed.asDict(recursive=True) == GOOD


def test_profiles_that_fit(spark):
    rng = random.Random(5)
    names = list("abcdefgh")
    headers = {k: rng.sample(names, rng.randint(1, 8)) for k in range(25)} | {100: [" a", "b "]}
    profiles = {f"p{k}": (rng.sample(names, rng.randint(1, 5)), mapping.header_hash(headers[k]) if k % 2 else None) for k in range(20)}
    columns = spark.createDataFrame([(i, k, c) for i, h in headers.items() for k, c in enumerate(h)], "log_id long, position int, column string").repartition(3)
    saved = spark.createDataFrame([(n, h, c) for n, (c, h) in profiles.items()], "profile string, header_hash string, columns array<string>")
    assert {r.log_id: r.header_hash for r in catalogue.headers_of(columns).collect()} == {i: mapping.header_hash(h) for i, h in headers.items()}
    for lacks in (0, 1, 2):
        got = {}
        for r in catalogue.matches(columns, saved, lacks).orderBy("log_id", "rank").collect():
            got.setdefault(r.log_id, []).append((r.profile, r.exact, r.n_columns, r.missing))
        want = {}
        for (i, h), (n, (c, saved_for)) in itertools.product(headers.items(), profiles.items()):
            missing, exact = sorted(set(c) - {x.strip() for x in h}), saved_for == mapping.header_hash(h)
            if len(missing) <= min(lacks, len(c) - 1) or exact:
                want.setdefault(i, []).append((n, exact, len(c), missing))
        assert got == {i: sorted(rows, key=lambda r: (not r[1], len(r[3]), -r[2], r[0])) for i, rows in want.items()}
    plan = catalogue.matches(columns, saved, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan
    assert catalogue.matches(columns.limit(0), saved).count() == 0 and catalogue.matches(columns, saved.limit(0)).select(F.count("*")).first()[0] == 0


def test_popular_headers_are_spread_over_tasks(spark, monkeypatch):
    """One header of all logs, and profiles of few kinds: every task makes a part of the answers, and logs without an id keep theirs."""
    monkeypatch.setattr(catalogue, "LIST", 4, raising=False)
    columns = spark.createDataFrame([(i or None, k, c) for i in range(60) for k, c in enumerate("abc")], "log_id long, position int, column string")
    saved = spark.createDataFrame([(f"p{k:02}", None, ["a", "b"] if k % 2 else ["a", "x"]) for k in range(50)], "profile string, header_hash string, columns array<string>")
    got = catalogue.matches(columns, saved, 1).withColumn("task", F.spark_partition_id()).collect()
    order = [f"p{k:02}" for k in (*range(1, 50, 2), *range(0, 50, 2))]
    assert sorted((r.log_id or 0, r.rank, r.profile, r.missing) for r in got) == [(i, k + 1, p, ["x"] if k >= 25 else []) for i in range(60) for k, p in enumerate(order)]
    tasks = [sum(r.task == t for r in got) for t in {r.task for r in got}]
    assert len(tasks) == 4 and max(tasks) < len(got) / 2


def test_rows_of_a_pair_of_lists_do_not_pile_up(spark):
    """Ranks and logs are unrolled in compiled steps of their own; one step for both holds all rows of a pair before the first goes out."""
    logs = spark.createDataFrame([(k, "h") for k in range(20)], "log_id long, header_hash string")
    ranking = spark.createDataFrame([("h", k + 1, f"p{k}") for k in range(30)], "header_hash string, rank long, profile string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = catalogue.dealt(logs, ranking)
        steps = re.findall(r"\*\((\d+)\) Generate inline", dealt._jdf.queryExecution().executedPlan().toString())
        got = sorted(map(tuple, dealt.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(steps) == len(set(steps)) == 2
    assert got == [(i, k + 1, f"p{k}") for i in range(20) for k in range(30)]
