"""Whether a project may go over to the target, and whether its validation has passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.functions.redact import redact_expr
from movekit.functions.scalars import rfc3339, strip


def latest_runs(runs: DataFrame) -> DataFrame:
    """Status of the newest run per project and stage."""
    return runs.groupBy("project", "stage").agg(
        F.max_by(F.struct("run_id", "status"), F.struct(rfc3339(F.col("generated_at")), F.col("run_id"))).alias("r")
    ).select("project", "stage", "r.run_id", "r.status")


def _stage_flags(runs: DataFrame, invalid_runs: DataFrame | None) -> DataFrame:
    """One row per project: did the newest run of each stage succeed and hold to the run rules?"""
    newest = latest_runs(runs)
    if invalid_runs is not None:
        bad = invalid_runs.select("run_id").distinct().withColumn("_bad", F.lit(True))
        newest = newest.join(bad, "run_id", "left")
    else:
        newest = newest.withColumn("_bad", F.lit(None).cast("boolean"))
    good = (strip("status") == "succeeded") & F.col("_bad").isNull()
    flag = lambda stage: F.bool_or((F.col("stage") == stage) & good).alias(f"{stage}_run")
    return newest.groupBy("project").agg(*[flag(s) for s in ("export", "import", "validation", "cdc")])


def gates(
    projects: DataFrame,
    runs: DataFrame,
    results: DataFrame,
    checkpoints: DataFrame,
    invalid_runs: DataFrame | None = None,
) -> DataFrame:
    """One row per project and gate. Offline projects (``mode``) have no replication gates.

    ``results`` and ``checkpoints`` hold one status per project.
    """
    joined = (
        projects.select("project", "mode")
        .join(_stage_flags(runs, invalid_runs), "project", "left")
        .join(results.select("project", F.col("status").alias("_validation")), "project", "left")
        .join(checkpoints.select("project", F.col("status").alias("_checkpoint")), "project", "left")
    )

    def gate(name: str, passed: Column, needed: Column | None = None) -> Column:
        row = F.struct(F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"))
        return row if needed is None else F.when(needed, row)

    online = F.coalesce(F.col("mode"), F.lit("")) != "offline"
    rows = F.array(
        gate("export_run", F.col("export_run")),
        gate("import_run", F.col("import_run")),
        gate("validation_run", F.col("validation_run")),
        gate("validation_status", F.col("_validation") == "passed"),
        gate("cdc_run", F.col("cdc_run"), online),
        gate("cdc_checkpoint", F.col("_checkpoint") == "caught_up", online),
    )
    return joined.select("project", F.inline(F.filter(rows, lambda g: g.isNotNull())))


def go_decision(gate_rows: DataFrame) -> DataFrame:
    return gate_rows.groupBy("project").agg(F.bool_and("passed").alias("go"), F.count_if(~F.col("passed")).alias("open_gates"))


def validation_status(
    projects: DataFrame, diffs: DataFrame, check_violations: DataFrame, runs: DataFrame, failures: DataFrame
) -> DataFrame:
    """project, check, passed, message.

    ``diffs`` (project, manual_items) comes from the schema diff; ``check_violations``
    (project, check_id, rule) from the check plan; ``failures`` (run_id, ...) lists failed
    commands. A project without a validation run is judged on the other two.
    """
    manual = diffs.groupBy("project").agg(F.sum("manual_items").alias("_manual"))
    broken = check_violations.groupBy("project").agg(F.count(F.lit(1)).alias("_broken"))
    failed = failures.groupBy("run_id").agg(F.count(F.lit(1)).alias("_failed"))
    newest = latest_runs(runs.where(F.col("stage") == "validation")).join(failed, "run_id", "left")
    run = newest.select("project", F.col("status").alias("_status"), F.coalesce("_failed", F.lit(0)).alias("_failed"))
    joined = projects.select("project").join(manual, "project", "left").join(broken, "project", "left").join(run, "project", "left")
    items, wrong = F.coalesce("_manual", F.lit(0)), F.coalesce("_broken", F.lit(0))

    def line(name: str, passed: Column, good: str, bad: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"), passed.alias("passed"), redact_expr(F.when(passed, F.lit(good)).otherwise(bad)).alias("message")
        )

    rows = F.array(
        line("schema_review", items == 0, "no items left", F.concat(items.cast("string"), F.lit(" items left to review"))),
        line("check_plan", wrong == 0, "check plan is sound", F.concat(wrong.cast("string"), F.lit(" broken rules"))),
        F.when(
            F.col("_status").isNotNull(),
            line(
                "validation_run",
                F.col("_status") == "succeeded",
                "validation run succeeded",
                F.concat(F.lit("validation run failed, commands: "), F.col("_failed").cast("string")),
            ),
        ),
    )
    return joined.select("project", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def validation_outcome(lines: DataFrame) -> DataFrame:
    """One status per project: passed only if every line passed."""
    return lines.groupBy("project").agg(F.when(F.bool_and("passed"), "passed").otherwise("failed").alias("status"))
