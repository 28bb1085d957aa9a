"""Run logs: one row per run with its nested commands and their attempts.

Rules are evaluated inside each row or after exploding commands; only uniqueness and run totals
need a shuffle, and both are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movekit.functions.redact import redact_args, redact_expr
from movekit.functions.scalars import blank, compact, engine_name, is_digest, rfc3339, strip
from movekit.plans.ranges import broken_rules

ATTEMPT = (
    "struct<attempt:int,exit_code:int,output:string,error:string,started_at:string,completed_at:string,duration_ms:bigint>"
)
COMMAND = (
    "struct<id:string,args:array<string>,exit_code:int,output:string,error:string,attempt_count:int,"
    f"attempts:array<{ATTEMPT}>,started_at:string,completed_at:string,duration_ms:bigint,"
    "cdc_applied_changes:bigint,data_rows:bigint,data_bytes:bigint,data_sha256:string>"
)
RUN = (
    "stage string, status string, project_id string, source_cluster_id string, payload_hash string, "
    f"generated_at string, commands array<{COMMAND}>"
)
# Import engines whose runs must state rows, bytes and digest.
AUDITED_ENGINES = ("sql-insert", "import-into", "lightning")
DETAIL, SUMMARY = 160, 240


def read_evidence(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Run documents, one per file (or per line without ``multiline``); ``run_id`` is their file."""
    return (
        spark.read.schema(RUN)
        .option("multiLine", str(multiline).lower())
        .json(path)
        .select(F.col("_metadata.file_path").alias("run_id"), F.col("project_id").alias("project"), "*")
        .drop("project_id")
    )


def commands_of(runs: DataFrame) -> DataFrame:
    """One row per command: run_id, project, stage, status, position and the struct ``c``."""
    return runs.select(
        "run_id", "project", "stage", "status", "payload_hash", F.posexplode("commands").alias("position", "c")
    )


def _engine(args: Column, vendor: str = "") -> Column:
    """Value of ``--engine v`` or ``--engine=v``; the first occurrence counts."""
    hits = F.filter(
        F.transform(
            args,
            lambda a, i: F.when((a == "--engine") & (i + 1 < F.size(args)), strip(F.get(args, i + 1))).when(
                a.startswith("--engine="), strip(F.substring_index(a, "--engine=", -1))
            ),
        ),
        lambda v: v.isNotNull(),
    )
    return engine_name(F.get(hits, F.lit(0)), vendor)


def audit_required(stage: Column, args: Column, vendor: str = "") -> Column:
    """Exports and imports by known engines, whose names may carry the prefix ``vendor``."""
    stage = strip(stage)
    return (stage == "export") | ((stage == "import") & _engine(args, vendor).isin(*AUDITED_ENGINES))


def _audit_complete(c: Column) -> Column:
    counts = (c["data_rows"] >= 0) & (c["data_bytes"] >= 0)
    return F.coalesce(counts, F.lit(False)) & is_digest(c["data_sha256"])


def _time_rules(started: Column, completed: Column, duration: Column) -> list[tuple[str, Column]]:
    begin, end = rfc3339(started), rfc3339(completed)
    return [
        ("started_malformed", begin.isNull()),
        ("completed_malformed", end.isNull()),
        ("completed_before_started", F.coalesce(end < begin, F.lit(False))),
        ("duration_required", duration.isNull()),
        ("duration_negative", F.coalesce(duration < 0, F.lit(False))),
    ]


def _command_rules(c: Column) -> list[tuple[str, Column]]:
    done = strip("status") == "succeeded"
    negative = lambda name: F.coalesce(c[name] < 0, F.lit(False))
    args = F.coalesce(c["args"], F.array().cast("array<string>"))
    rows, size, digest = c["data_rows"], c["data_bytes"], c["data_sha256"]
    return [
        ("id_required", blank(c["id"])),
        ("exit_code_required", c["exit_code"].isNull()),
        ("exit_code_conflicts", done & F.coalesce(c["exit_code"] != 0, F.lit(False))),
        ("error_conflicts", done & ~blank(c["error"])),
        ("args_required", F.size(args) == 0),
        ("arg_empty", F.exists(args, blank)),
        *_time_rules(c["started_at"], c["completed_at"], c["duration_ms"]),
        ("changes_negative", negative("cdc_applied_changes")),
        ("rows_and_bytes_must_come_together", rows.isNull() != size.isNull()),
        ("digest_needs_rows_and_bytes", ~blank(digest) & (rows.isNull() | size.isNull())),
        ("rows_negative", negative("data_rows")),
        ("bytes_negative", negative("data_bytes")),
        ("digest_malformed", ~blank(digest) & ~is_digest(digest)),
    ]


def runlog_violations(runs: DataFrame) -> DataFrame:
    """run_id, command_id (empty for the run itself), rule.

    One pass without a shuffle: a run is one row, so its own rules and repeated ids are worked
    out there and travel with its first command.
    """
    commands = F.coalesce(F.col("commands"), F.from_json(F.lit("[]"), f"array<{COMMAND}>"))
    failing = F.exists("_all", lambda c: F.coalesce(c["exit_code"] != 0, F.lit(False)) | ~blank(c["error"]))
    ids = F.array_sort(F.filter(F.transform("_all", lambda c: strip(c["id"])), lambda x: x != ""))
    twins = F.array_distinct(F.filter("_ids", lambda x, i: (i > 0) & (F.get(F.col("_ids"), i - 1) == x)))
    pair = lambda who, rule: F.named_struct(F.lit("command_id"), who, F.lit("rule"), rule)
    of_run = broken_rules(
        [
            ("no_commands", F.size("_all") == 0),
            ("failed_without_failure", (strip("status") == "failed") & (F.size("_all") > 0) & ~failing),
        ]
    )
    whole = (
        runs.select("run_id", "status", commands.alias("_all"))
        .withColumn("_ids", ids)
        .select(
            "run_id",
            "status",
            F.concat(
                F.transform(of_run, lambda r: pair(F.lit(""), r)), F.transform(twins, lambda x: pair(x, F.lit("id_repeated")))
            ).alias("_run"),
            F.posexplode_outer("_all").alias("position", "c"),
        )
    )
    name = strip(F.coalesce(F.col("c.id"), F.lit("")))
    own = F.when(F.col("c").isNotNull(), broken_rules(_command_rules(F.col("c")))).otherwise(F.array().cast("array<string>"))
    first = F.coalesce(F.col("position") == 0, F.lit(True))
    none = F.array().cast("array<struct<command_id:string,rule:string>>")
    rows = whole.select("run_id", name.alias("_name"), F.when(first, F.col("_run")).otherwise(none).alias("_run"), own.alias("_own"))
    return rows.select(
        "run_id", F.inline(F.concat("_run", F.transform("_own", lambda r: pair(F.col("_name"), r))))
    )


def attempt_violations(runs: DataFrame) -> DataFrame:
    """run_id, command_id, attempt (0 for the command itself), rule."""
    flat = commands_of(runs).select("run_id", strip("c.id").alias("command_id"), "c.attempt_count", "c.attempts")
    count, tries = F.col("attempt_count"), F.coalesce(F.col("attempts"), F.from_json(F.lit("[]"), f"array<{ATTEMPT}>"))
    of_commands = flat.select(
        "run_id",
        "command_id",
        F.lit(0).alias("attempt"),
        F.explode(
            broken_rules(
                [
                    ("attempts_need_count", count.isNull() & (F.size(tries) > 0)),
                    ("count_below_one", F.coalesce(count < 1, F.lit(False))),
                    ("count_differs", count.isNotNull() & (F.size(tries) > 0) & (F.size(tries) != count)),
                ]
            )
        ).alias("rule"),
    )
    single = flat.where(count.isNotNull()).select("run_id", "command_id", F.posexplode("attempts").alias("i", "a"))
    a = F.col("a")
    rules = [
        ("misnumbered", ~F.coalesce(a["attempt"] == F.col("i") + 1, F.lit(False))),
        ("exit_code_required", a["exit_code"].isNull()),
        *_time_rules(a["started_at"], a["completed_at"], a["duration_ms"]),
    ]
    of_attempts = single.select("run_id", "command_id", (F.col("i") + 1).alias("attempt"), F.explode(broken_rules(rules)).alias("rule"))
    return of_commands.unionByName(of_attempts)


def audit_violations(runs: DataFrame, vendor: str = "") -> DataFrame:
    """Commands of successful export and import runs without complete rows, bytes and digest."""
    c = F.col("c")
    lacking = (strip("status") == "succeeded") & audit_required(F.col("stage"), c["args"], vendor) & ~_audit_complete(c)
    return commands_of(runs).where(lacking).select("run_id", strip("c.id").alias("command_id"), F.lit("audit_incomplete").alias("rule"))


def _attempts(c: Column) -> Column:
    return F.coalesce(c["attempt_count"], F.when(F.size(c["attempts"]) > 0, F.size(c["attempts"])))


def command_summary(runs: DataFrame) -> DataFrame:
    """One row per command for a report; output and error are redacted, output shortened."""
    c = F.col("c")
    return commands_of(runs).select(
        "run_id",
        "project",
        "stage",
        "position",
        c["id"].alias("command_id"),
        c["exit_code"].alias("exit_code"),
        _attempts(c).alias("attempts"),
        c["duration_ms"].alias("duration_ms"),
        c["data_rows"].alias("data_rows"),
        c["data_bytes"].alias("data_bytes"),
        c["cdc_applied_changes"].alias("applied_changes"),
        compact(redact_expr(c["output"]), SUMMARY, "(empty)").alias("output"),
        strip(redact_expr(F.coalesce(c["error"], F.lit("")))).alias("error"),
    )


def failed_commands(runs: DataFrame) -> DataFrame:
    """Commands with a non-zero exit code and a short, redacted excerpt of their output."""
    c = F.col("c")
    return commands_of(runs).where(c["exit_code"] != 0).select(
        "run_id", "position", c["id"].alias("command_id"), c["exit_code"].alias("exit_code"), compact(redact_expr(c["output"]), DETAIL).alias("detail")
    )


def runlog_summary(runs: DataFrame) -> DataFrame:
    """Totals per project and stage."""
    c = F.col("c")
    total = lambda name: F.coalesce(F.sum(c[name]), F.lit(0))
    return commands_of(runs).groupBy("project", "stage").agg(
        F.count(F.lit(1)).alias("commands"),
        F.count_if(F.coalesce(c["exit_code"] != 0, F.lit(False))).alias("failed"),
        F.coalesce(F.sum(_attempts(c)), F.lit(0)).cast("long").alias("attempts"),
        total("duration_ms").alias("duration_ms"),
        F.coalesce(F.max(c["duration_ms"]), F.lit(0)).alias("longest_ms"),
        total("data_rows").alias("data_rows"),
        total("data_bytes").alias("data_bytes"),
        total("cdc_applied_changes").alias("applied_changes"),
    )


def pending_work(items: DataFrame, runs: DataFrame, vendor: str = "") -> DataFrame:
    """Work items (item_id, project, stage, fingerprint, args[]) without a reusable success.

    A success is reusable when it ran for the same fingerprint with the same arguments (as given
    or redacted), ended cleanly and carries the figures its stage must have.
    """
    c = F.col("c")
    clean = (c["exit_code"] == 0) & blank(c["error"])
    changes = (F.col("stage") != "cdc") | c["cdc_applied_changes"].isNotNull()
    audited = ~audit_required(F.col("stage"), c["args"], vendor) | _audit_complete(c)
    # Arguments meet as one digest, so that the join hashes a short key instead of an array.
    key = lambda args: F.sha2(F.to_json(args), 256)
    done = (
        commands_of(runs)
        .where(clean & changes & audited)
        .select("project", "stage", F.col("payload_hash").alias("fingerprint"), c["id"].alias("item_id"), key(c["args"]).alias("_args"))
        .distinct()  # repeats of one item collapse on the map side
    )
    ids = ["project", "stage", "fingerprint", "item_id"]
    keyed = items.withColumns({"_raw": key(F.col("args")), "_red": key(redact_args(F.col("args")))})
    # One equi-join per form of the arguments: no pair of candidates is compared beyond the hash of its key.
    for form in ("_raw", "_red"):
        keyed = keyed.join(done.withColumnRenamed("_args", form), [*ids, form], "left_anti")
    return keyed.select(*items.columns)
