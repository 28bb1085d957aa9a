from __future__ import annotations

import json
import os

import pytest

from movekit.operators import runlog as R
from movekit.plans import gates as G
from movekit.plans import integrity as I
from movekit.session import scratch

SHA = "sha256:" + "a" * 64


def command(**change):
    base = {
        "id": "c1",
        "args": ["run", "--x", "1"],
        "exit_code": 0,
        "output": "ok",
        "error": "",
        "attempt_count": 1,
        "attempts": [attempt(1)],
        "started_at": "2024-01-01T00:00:00Z",
        "completed_at": "2024-01-01T00:00:01Z",
        "duration_ms": 1000,
        "data_rows": 5,
        "data_bytes": 50,
        "data_sha256": SHA,
    }
    return {**base, **change}


def attempt(n, **change):
    return {"attempt": n, "exit_code": 0, "started_at": "2024-01-01T00:00:00Z", "completed_at": "2024-01-01T00:00:01Z", "duration_ms": 10, **change}


def read(spark, *commands, stage="export", status="succeeded"):
    run = {"stage": stage, "status": status, "project_id": "p", "payload_hash": "h", "generated_at": "2024-01-01T00:00:02Z", "commands": list(commands)}
    path = scratch(spark, "run").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/run.json", "w") as f:
        json.dump(run, f, indent=1)
    return R.read_evidence(spark, path)


def rules(df):
    return sorted(r["rule"] for r in df.collect())


def test_sound_run(spark):
    runs = read(spark, command(), command(id="c2"))
    assert rules(R.runlog_violations(runs)) == rules(R.attempt_violations(runs)) == rules(R.audit_violations(runs)) == []


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"id": " "}, "id_required"),
        ({"exit_code": None}, "exit_code_required"),
        ({"exit_code": 2}, "exit_code_conflicts"),
        ({"error": "boom"}, "error_conflicts"),
        ({"args": []}, "args_required"),
        ({"args": ["run", ""]}, "arg_empty"),
        ({"completed_at": "2023-01-01T00:00:00Z"}, "completed_before_started"),
        ({"started_at": ""}, "started_malformed"),
        ({"duration_ms": None}, "duration_required"),
        ({"duration_ms": -1}, "duration_negative"),
        ({"cdc_applied_changes": -1}, "changes_negative"),
        ({"data_rows": -1}, "rows_negative"),
        ({"data_bytes": -1}, "bytes_negative"),
        ({"data_rows": None, "data_sha256": ""}, "rows_and_bytes_must_come_together"),
        ({"data_rows": None, "data_bytes": None}, "digest_needs_rows_and_bytes"),
        ({"data_sha256": "sha256:1"}, "digest_malformed"),
    ],
)
def test_command_rules(spark, change, rule):
    assert rules(R.runlog_violations(read(spark, command(**change)))) == [rule]


def test_run_rules(spark):
    assert rules(R.runlog_violations(read(spark))) == ["no_commands"]
    assert rules(R.runlog_violations(read(spark, command(), status="failed"))) == ["failed_without_failure"]
    assert rules(R.runlog_violations(read(spark, command(exit_code=1), command(id="c2"), status="failed"))) == []
    twice = R.runlog_violations(read(spark, command(), command(id=" c1"), command(id="c1"), command(id="c3"))).collect()
    assert [(r["command_id"], r["rule"]) for r in twice] == [("c1", "id_repeated")]


def test_attempt_rules(spark):
    cases = [
        ({"attempt_count": None}, ["attempts_need_count"]),
        ({"attempt_count": 0, "attempts": []}, ["count_below_one"]),
        ({"attempt_count": 2}, ["count_differs"]),
        ({"attempt_count": 3, "attempts": []}, []),
        ({"attempt_count": 2, "attempts": [attempt(1), attempt(3)]}, ["misnumbered"]),
        ({"attempts": [attempt(1, exit_code=None, duration_ms=-1)]}, ["duration_negative", "exit_code_required"]),
    ]
    for change, want in cases:
        assert rules(R.attempt_violations(read(spark, command(**change)))) == want


def test_audits_required(spark):
    bare = command(data_rows=None, data_bytes=None, data_sha256="")
    assert rules(R.audit_violations(read(spark, bare))) == ["audit_incomplete"]
    assert rules(R.audit_violations(read(spark, bare, status="failed"))) == []
    assert rules(R.audit_violations(read(spark, bare, stage="cdc"))) == []
    other = {**bare, "args": ["run", "--engine=magic"]}
    assert rules(R.audit_violations(read(spark, other, stage="import"))) == []
    bulk = {**bare, "args": ["run", "--engine", "Any-Import-Into"]}
    assert rules(R.audit_violations(read(spark, bulk, stage="import"), vendor="any")) == ["audit_incomplete"]
    assert rules(R.audit_violations(read(spark, bulk, stage="import"))) == []


def test_summary_and_failures(spark):
    runs = read(spark, command(), command(id="c2", exit_code=3, output="token=abc\n" + "x" * 300, attempt_count=None), status="failed")
    total = R.runlog_summary(runs).head()
    assert (total["commands"], total["failed"], total["attempts"], total["data_rows"], total["longest_ms"]) == (2, 1, 2, 10, 1000)
    failed = R.failed_commands(runs).head()
    assert failed["exit_code"] == 3 and "abc" not in failed["detail"] and len(failed["detail"]) == 160
    assert R.command_summary(read(spark, command(output=" "))).head()["output"] == "(empty)"


def items(spark, **change):
    base = {"item_id": "c1", "project": "p", "stage": "export", "fingerprint": "h", "args": ["run", "--x", "1"], **change}
    return spark.createDataFrame([tuple(base.values())], "item_id string, project string, stage string, fingerprint string, args array<string>")


def test_resume(spark):
    assert R.pending_work(items(spark), read(spark, command())).count() == 0
    for change in ({"fingerprint": "other"}, {"item_id": "c9"}, {"args": ["run"]}):
        assert R.pending_work(items(spark, **change), read(spark, command())).count() == 1
    for change in ({"exit_code": 1}, {"error": "x"}, {"data_rows": None}):
        assert R.pending_work(items(spark), read(spark, command(**change))).count() == 1
    hidden = read(spark, command(args=["run", "--password", "<redacted>"]))
    assert R.pending_work(items(spark, args=["run", "--password", "x"]), hidden).count() == 0
    assert R.pending_work(items(spark, stage="cdc"), read(spark, command(), stage="cdc")).count() == 1
    assert R.pending_work(items(spark, stage="cdc"), read(spark, command(cdc_applied_changes=0), stage="cdc")).count() == 0


CHUNK = "project string, chunk_id string, chunk_no long, source_object string, target_object string, output_uri string, predicate string"
JOB = "project string, job_id string, target_object string, source_uri string, depends_on string"


def chunk(spark, **change):
    base = {"project": "p", "chunk_id": "k1", "chunk_no": 1, "source_object": "d.s.t", "target_object": "x.t", "output_uri": "u/1", "predicate": "1 = 1", **change}
    return spark.createDataFrame([tuple(base.values())], CHUNK)


def job(spark, **change):
    base = {"project": "p", "job_id": "j1", "target_object": "x.t", "source_uri": "u/1", "depends_on": "k1", **change}
    return spark.createDataFrame([tuple(base.values())], JOB)


def test_plan_integrity(spark):
    assert I.plan_violations(chunk(spark), job(spark)).count() == 0
    assert rules(I.dependency_violations(chunk(spark), job(spark, depends_on="k2"))) == ["dependency_missing"]
    assert rules(I.dependency_violations(chunk(spark), job(spark, source_uri="u/2"))) == ["uri_differs"]
    assert rules(I.dependency_violations(chunk(spark).where("false"), job(spark))) == []
    assert rules(I.chunk_violations(chunk(spark).unionByName(chunk(spark)))) == ["id_repeated"]
    assert rules(I.job_violations(job(spark).unionByName(job(spark)))) == ["id_repeated"]
    assert rules(I.chunk_violations(chunk(spark, predicate="todo"))) == ["predicate_unresolved"]
    many = job(spark).unionByName(job(spark, job_id="j2", source_uri="v/1"))
    assert I.source_directories(many).head()["data_source_uri"] is None
    assert I.source_directories(job(spark)).head()["data_source_uri"] == "u"


def test_gates(spark):
    projects = spark.createDataFrame([("p", "online"), ("q", "offline")], "project string, mode string")
    runs = spark.createDataFrame(
        [("p", s, f"p{s}{n}", st, f"2024-01-0{n}T00:00:00Z") for s in ("export", "import", "validation", "cdc") for n, st in ((1, "failed"), (2, "succeeded"))]
        + [("q", s, f"q{s}", "succeeded", "2024-01-01T00:00:00Z") for s in ("export", "import")],
        "project string, stage string, run_id string, status string, generated_at string",
    )
    results = spark.createDataFrame([("p", "passed"), ("q", "passed")], "project string, status string")
    ckpt = spark.createDataFrame([("p", "caught_up")], "project string, status string")
    rows = G.gates(projects, runs, results, ckpt)
    assert rows.count() == 6 + 4
    decision = {r["project"]: (r["go"], r["open_gates"]) for r in G.go_decision(rows).collect()}
    assert decision == {"p": (True, 0), "q": (False, 1)}
    invalid = spark.createDataFrame([("pcdc2",)], "run_id string")
    assert {r["project"]: r["open_gates"] for r in G.go_decision(G.gates(projects, runs, results, ckpt, invalid)).collect()}["p"] == 1


def test_empty_plans(spark):
    projects = spark.createDataFrame([("p",), ("q",)], "project string")
    checks = spark.createDataFrame([("p", "row-count"), ("q", "other")], "project string, type string")
    gaps = I.empty_plans(projects, chunk(spark), job(spark), job(spark), checks).collect()
    assert sorted((r["project"], r["rule"]) for r in gaps) == [
        ("q", "no_chunks"),
        ("q", "no_jobs"),
        ("q", "no_supported_checks"),
        ("q", "no_tracked_tables"),
    ]
