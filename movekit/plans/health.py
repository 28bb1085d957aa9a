"""State of replication: lag, retention, staleness, alerts and who is told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movekit.functions.lsn import lsn_bytes, parse_lsn, require_lsn
from movekit.functions.scalars import blank, rfc3339, strip

# Severities in rising order, and names accepted for an alert threshold.
SEVERITIES = ("none", "ok", "warning", "critical")
THRESHOLDS = {"": "critical", "critical": "critical", "warning": "warning", "ok": "ok", "always": "ok", "none": "none", "disabled": "none"}


def _alert(severity: str, code: str):
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))


def health_tables(
    tracked: DataFrame, checkpoint: DataFrame, low_marks: DataFrame | None = None, max_lsn: str | None = None
) -> DataFrame:
    """One row per tracked table with lag_status, retention_status and its alerts[]."""
    if max_lsn is not None:
        lsn_bytes(max_lsn, "max_lsn")
    entries = checkpoint.where(~blank(F.col("source_object"))).select(
        "project",
        "source_object",
        F.lit(True).alias("_seen"),
        F.col("from_lsn").alias("checkpoint_from_lsn"),
        F.col("to_lsn").alias("checkpoint_to_lsn"),
        "applied_changes",
        "completed_at",
    )
    rows = tracked.select("project", "source_object", "target_object").join(entries, ["project", "source_object"], "left")
    if low_marks is None:
        rows = rows.withColumn("min_lsn", F.lit(None).cast("string"))
    else:
        rows = rows.join(low_marks.select("source_object", strip("min_lsn").alias("min_lsn")), "source_object", "left")
    seen = F.col("_seen").isNotNull()
    at = F.when(seen, require_lsn(F.col("checkpoint_to_lsn"), "checkpoint to_lsn"))
    rows = rows.withColumns({"_at": at, "_top": parse_lsn(F.lit(max_lsn)), "_low": F.when(~blank(F.col("min_lsn")), require_lsn(F.col("min_lsn"), "min_lsn"))})
    lag = (
        F.when(~seen | F.col("_top").isNull(), "unknown")
        .when(F.col("_at") < F.col("_top"), "behind")
        .when(F.col("_at") == F.col("_top"), "caught_up")
        .otherwise("ahead")
    )
    retention = (
        F.when(~seen | F.col("_low").isNull(), "unknown").when(F.col("_at") < F.col("_low"), "expired").otherwise("covered")
    )
    rows = rows.withColumns({"lag_status": lag, "retention_status": retention})
    alerts = F.array(
        F.when(~seen, _alert("critical", "checkpoint_missing")),
        F.when(F.col("lag_status") == "behind", _alert("warning", "cdc_lag")),
        F.when(F.col("lag_status") == "ahead", _alert("critical", "checkpoint_ahead")),
        F.when(F.col("retention_status") == "expired", _alert("critical", "retention_expired")),
    )
    return rows.select(
        "project",
        "source_object",
        "target_object",
        "checkpoint_from_lsn",
        "checkpoint_to_lsn",
        "min_lsn",
        F.lit(max_lsn).alias("max_lsn"),
        "lag_status",
        "retention_status",
        "applied_changes",
        "completed_at",
        F.filter(alerts, lambda a: a.isNotNull()).alias("alerts"),
    )


def _project_rows(states: DataFrame, now: str, max_age_seconds: int) -> DataFrame:
    """Age of each project's checkpoint and the alerts that concern the project as a whole."""
    updated = F.when(
        ~blank(F.col("updated_at")),
        F.coalesce(rfc3339(F.col("updated_at")), F.raise_error(F.lit("checkpoint updated_at must be RFC3339")).cast("timestamp")),
    )
    age = F.greatest(F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(updated), F.lit(0))
    rows = states.withColumn("age_seconds", F.floor(age / 1_000_000).cast("long"))
    stale = (F.lit(max_age_seconds) > 0) & (F.col("age_seconds") > max_age_seconds)
    alerts = F.array(
        F.when(F.lower(strip("status")) == "failed", _alert("critical", "checkpoint_failed")),
        F.when(stale, _alert("critical", "checkpoint_stale")),
    )
    return rows.select(
        "project",
        strip("status").alias("checkpoint_status"),
        "age_seconds",
        F.filter(alerts, lambda a: a.isNotNull()).alias("alerts"),
    )


def health_alerts(tables: DataFrame, states: DataFrame, now: str, max_age_seconds: int = 0) -> DataFrame:
    """All alerts: project, source_object (empty for the project itself), severity, code."""
    of_tables = tables.select("project", "source_object", F.explode("alerts").alias("a"))
    of_projects = _project_rows(states, now, max_age_seconds).select(
        "project", F.lit("").alias("source_object"), F.explode("alerts").alias("a")
    )
    return of_projects.unionByName(of_tables).select("project", "source_object", "a.severity", "a.code")


def health_summary(tables: DataFrame, states: DataFrame, now: str, max_age_seconds: int = 0) -> DataFrame:
    """One row per project: counts of tracked, lagging and expired tables, age and worst severity."""

    def worst(alerts):
        return F.aggregate(
            alerts, F.lit(0), lambda top, a: F.greatest(top, F.when(a["severity"] == "critical", 2).otherwise(1))
        )

    by_project = tables.groupBy("project").agg(
        F.count(F.lit(1)).alias("tracked_tables"),
        F.count_if(F.col("lag_status") == "behind").alias("lagging_tables"),
        F.count_if(F.col("retention_status") == "expired").alias("expired_tables"),
        F.max(worst(F.col("alerts"))).alias("_tables"),
    )
    projects = _project_rows(states, now, max_age_seconds).withColumn("_project", worst(F.col("alerts"))).drop("alerts")
    rank = F.greatest(F.coalesce("_tables", F.lit(0)), F.coalesce("_project", F.lit(0)))
    return by_project.join(projects, "project", "full").select(
        "project",
        "checkpoint_status",
        "age_seconds",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tracked_tables", "lagging_tables", "expired_tables")],
        F.when(rank == 2, "critical").when(rank == 1, "warning").otherwise("ok").alias("status"),
    )


def route_alerts(summary: DataFrame, minimum: str = "critical", fail_on_warning: bool = False) -> DataFrame:
    """Adds ``notify`` (status reaches the threshold) and ``exit_code`` to a health summary."""
    chosen = THRESHOLDS.get(minimum.strip().lower())
    if chosen is None:
        raise ValueError(f"invalid alert threshold {minimum!r}")
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(strip("status"))) - 1
    notify = F.lit(False) if chosen == "none" else rank >= SEVERITIES.index(chosen)
    failing = (F.col("status") == "critical") | (F.lit(fail_on_warning) & (F.col("status") == "warning"))
    return summary.withColumns({"notify": notify, "exit_code": F.when(failing, 1).otherwise(0)})


def append_history(summary: DataFrame, path: str, generated_at: str) -> None:
    """Add a report to the history, one JSON line per project."""
    summary.withColumn("generated_at", F.lit(generated_at)).write.mode("append").json(path)


def latest_health(spark, path: str, schema) -> DataFrame:
    """The newest report of every project in the history."""
    history = spark.read.schema(schema).json(path)
    values = [c for c in history.columns if c != "project"]
    return (
        history.groupBy("project")
        .agg(F.max_by(F.struct(*values), rfc3339(F.col("generated_at"))).alias("r"))
        .select("project", "r.*")
    )
