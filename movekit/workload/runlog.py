"""Run logs, plan integrity and gates: every event becomes a run with up to three commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movekit.operators import runlog as R
from movekit.plans import dependencies as D
from movekit.plans import gates as G
from movekit.plans import integrity as I
from movekit.session import scratch
from movekit.workload import query, table

def _stage() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "signup", "export").when(kind == "view", "validation").when(kind == "purchase", "cdc").otherwise("import")


def _text(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _args(password: Column) -> Column:
    e = F.col("event_id")
    engine = F.when(e % 5 == 0, "other").otherwise("sql-insert")
    return F.array(F.lit("run"), F.lit("--engine"), engine, F.lit("--password"), password, F.lit("--id"), e.cast("string"))


def _attempt(j: Column) -> Column:
    e = F.col("event_id")
    return F.struct(
        F.when(e % 59 == 16, j + 1).otherwise(j).cast("int").alias("attempt"),
        F.when(e % 61 == 17, None).otherwise(0).cast("int").alias("exit_code"),
        F.lit("").alias("output"),
        F.lit("").alias("error"),
        F.lit("2024-01-01T00:00:10Z").alias("started_at"),
        F.when(e % 67 == 18, "2024-01-01T00:00:05Z").otherwise("2024-01-01T00:00:20.5Z").alias("completed_at"),
        F.when(e % 71 == 19, -5).otherwise(10).cast("long").alias("duration_ms"),
    )


def _command(i: Column) -> Column:
    e = F.col("event_id")
    tries = F.when(e % 53 == 15, 1).when((e % 3 == 0) & (e % 2 == 0), 0).otherwise(1 + e % 3).cast("int")
    none = F.from_json(F.lit("[]"), f"array<{R.ATTEMPT}>")
    changes = F.when((_stage() == "cdc") & (e % 7 != 1), e % 100 - F.when(e % 79 == 21, 200).otherwise(0))
    password = F.when(e % 2 == 0, "<redacted>").otherwise(_text("pw", e))
    return F.struct(
        F.when(e % 11 == 4, "c0").when((e + i) % 41 == 12, " ").otherwise(_text("c", i)).alias("id"),
        F.when(e % 23 == 8, F.array().cast("array<string>")).when(e % 43 == 13, F.array(F.lit("run"), F.lit(" "))).otherwise(_args(password)).alias("args"),
        F.when((e + i) % 13 == 5, 1).when((e + i) % 17 == 6, None).otherwise(0).cast("int").alias("exit_code"),
        F.concat(F.lit("exported rows: "), e.cast("string"), F.lit("\n token=abc"), e.cast("string")).alias("output"),
        F.when((e + i) % 19 == 7, _text("boom secret=x", e)).otherwise("").alias("error"),
        F.when(e % 3 == 0, None).when(e % 47 == 14, 0).otherwise(1 + e % 3).cast("int").alias("attempt_count"),
        F.when(tries > 0, F.transform(F.sequence(F.lit(1), tries), _attempt)).otherwise(none).alias("attempts"),
        F.when(e % 31 == 10, "soon").otherwise("2024-01-01T00:00:01Z").alias("started_at"),
        F.when(e % 29 == 9, "2024-01-01T00:00:00Z").otherwise("2024-01-01T00:00:09+00:00").alias("completed_at"),
        F.when(e % 37 == 11, -1).when(e % 73 == 20, None).otherwise(e * 10 + i).cast("long").alias("duration_ms"),
        changes.cast("long").alias("cdc_applied_changes"),
        F.when(e % 9 == 2, None).otherwise(e).cast("long").alias("data_rows"),
        F.when((e % 9 == 2) | (e % 83 == 22), None).otherwise(e * 8).cast("long").alias("data_bytes"),
        F.when(e % 8 == 3, "").when(e % 89 == 23, "sha256:zz").otherwise(F.concat(F.lit("sha256:"), F.sha2(e.cast("string"), 256))).alias("data_sha256"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    numbers = F.when(e % 4 > 0, F.sequence(F.lit(0).cast("long"), e % 4 - 1)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf_dir, "events").select(
        _text("r", e).alias("run_id"),
        _text("p", F.col("user_id")).alias("project"),
        _stage().alias("stage"),
        F.when(e % 7 == 0, "failed").otherwise("succeeded").alias("status"),
        _text("h", e % 3).alias("payload_hash"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("generated_at"),
        F.transform(numbers, _command).alias("commands"),
    )


RUNS = """run AS (SELECT event_id AS e, 'r' || event_id AS run_id, 'p' || user_id AS project,
 CASE event_type WHEN 'signup' THEN 'export' WHEN 'view' THEN 'validation' WHEN 'purchase' THEN 'cdc' ELSE 'import' END AS stage,
 CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status, 'h' || (event_id % 3) AS payload_hash,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS generated_at FROM events),
cmd AS (SELECT *, CASE WHEN e % 11 = 4 THEN 'c0' WHEN (e + i) % 41 = 12 THEN '' ELSE 'c' || i END AS command_id,
 CASE WHEN e % 23 = 8 THEN 'none' WHEN e % 43 = 13 THEN 'blank' WHEN e % 5 = 0 THEN 'other' ELSE 'sql' END AS arg_kind,
 CASE WHEN (e + i) % 13 = 5 THEN 1 WHEN (e + i) % 17 = 6 THEN NULL ELSE 0 END AS exit_code,
 CASE WHEN (e + i) % 19 = 7 THEN 'boom secret=<redacted>' ELSE '' END AS error,
 CASE WHEN e % 3 = 0 THEN NULL WHEN e % 47 = 14 THEN 0 ELSE 1 + e % 3 END AS attempt_count,
 CASE WHEN e % 53 = 15 THEN 1 WHEN e % 3 = 0 AND e % 2 = 0 THEN 0 ELSE 1 + e % 3 END AS tries,
 e % 31 = 10 AS soon, e % 29 = 9 AS back, CASE WHEN e % 37 = 11 THEN -1 WHEN e % 73 = 20 THEN NULL ELSE e * 10 + i END AS duration_ms,
 CASE WHEN stage = 'cdc' AND e % 7 <> 1 THEN e % 100 - CASE WHEN e % 79 = 21 THEN 200 ELSE 0 END END AS changes,
 CASE WHEN e % 9 = 2 THEN NULL ELSE e END AS data_rows, CASE WHEN e % 9 = 2 OR e % 83 = 22 THEN NULL ELSE e * 8 END AS data_bytes,
 CASE WHEN e % 8 = 3 THEN '' WHEN e % 89 = 23 THEN 'bad' ELSE 'good' END AS digest FROM (SELECT *, unnest(range(0, e % 4)) AS i FROM run)),
flag AS (SELECT *, (stage = 'export' OR (stage = 'import' AND arg_kind <> 'other')) AS must_audit,
 data_rows IS NOT NULL AND data_bytes IS NOT NULL AND digest = 'good' AS audited FROM cmd)"""


@query(
    f"""WITH {RUNS} SELECT run_id, '' AS command_id, 'no_commands' AS rule FROM run WHERE e % 4 = 0
UNION ALL SELECT run_id, '', 'failed_without_failure' FROM cmd WHERE status = 'failed' GROUP BY run_id HAVING NOT bool_or(COALESCE(exit_code <> 0, false) OR error <> '')
UNION ALL SELECT run_id, command_id, 'id_required' FROM cmd WHERE command_id = ''
UNION ALL SELECT run_id, command_id, 'exit_code_required' FROM cmd WHERE exit_code IS NULL
UNION ALL SELECT run_id, command_id, 'exit_code_conflicts' FROM cmd WHERE status = 'succeeded' AND exit_code = 1
UNION ALL SELECT run_id, command_id, 'error_conflicts' FROM cmd WHERE status = 'succeeded' AND error <> ''
UNION ALL SELECT run_id, command_id, 'args_required' FROM cmd WHERE arg_kind = 'none'
UNION ALL SELECT run_id, command_id, 'arg_empty' FROM cmd WHERE arg_kind = 'blank'
UNION ALL SELECT run_id, command_id, 'started_malformed' FROM cmd WHERE soon
UNION ALL SELECT run_id, command_id, 'completed_before_started' FROM cmd WHERE back AND NOT soon
UNION ALL SELECT run_id, command_id, 'duration_required' FROM cmd WHERE duration_ms IS NULL
UNION ALL SELECT run_id, command_id, 'duration_negative' FROM cmd WHERE duration_ms < 0
UNION ALL SELECT run_id, command_id, 'changes_negative' FROM cmd WHERE changes < 0
UNION ALL SELECT run_id, command_id, 'rows_and_bytes_must_come_together' FROM cmd WHERE (data_rows IS NULL) <> (data_bytes IS NULL)
UNION ALL SELECT run_id, command_id, 'digest_needs_rows_and_bytes' FROM cmd WHERE digest <> '' AND (data_rows IS NULL OR data_bytes IS NULL)
UNION ALL SELECT run_id, command_id, 'digest_malformed' FROM cmd WHERE digest = 'bad'
UNION ALL SELECT run_id, command_id, 'id_repeated' FROM cmd WHERE command_id <> '' GROUP BY run_id, command_id HAVING COUNT(*) > 1"""
)
def run_log_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runlog_violations(runs(spark, sf_dir))


@query(
    f"""WITH {RUNS}, t AS (SELECT *, unnest(range(1, tries + 1)) AS attempt FROM cmd WHERE attempt_count IS NOT NULL)
SELECT run_id, command_id, CAST(0 AS INTEGER) AS attempt, 'attempts_need_count' AS rule FROM cmd WHERE attempt_count IS NULL AND tries > 0
UNION ALL SELECT run_id, command_id, 0, 'count_below_one' FROM cmd WHERE attempt_count < 1
UNION ALL SELECT run_id, command_id, 0, 'count_differs' FROM cmd WHERE tries > 0 AND tries <> attempt_count
UNION ALL SELECT run_id, command_id, CAST(attempt AS INTEGER), 'misnumbered' FROM t WHERE e % 59 = 16
UNION ALL SELECT run_id, command_id, CAST(attempt AS INTEGER), 'exit_code_required' FROM t WHERE e % 61 = 17
UNION ALL SELECT run_id, command_id, CAST(attempt AS INTEGER), 'completed_before_started' FROM t WHERE e % 67 = 18
UNION ALL SELECT run_id, command_id, CAST(attempt AS INTEGER), 'duration_negative' FROM t WHERE e % 71 = 19"""
)
def run_attempt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.attempt_violations(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT run_id, command_id, 'audit_incomplete' AS rule FROM flag WHERE status = 'succeeded' AND must_audit AND NOT audited")
def run_audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.audit_violations(runs(spark, sf_dir))


SUMMARY = f"""WITH {RUNS} SELECT project, stage, COUNT(*) AS commands, COUNT(*) FILTER (WHERE exit_code <> 0) AS failed,
 CAST(COALESCE(SUM(COALESCE(attempt_count, CASE WHEN tries > 0 THEN tries END)), 0) AS BIGINT) AS attempts,
 CAST(COALESCE(SUM(duration_ms), 0) AS BIGINT) AS duration_ms, CAST(COALESCE(MAX(duration_ms), 0) AS BIGINT) AS longest_ms,
 CAST(COALESCE(SUM(data_rows), 0) AS BIGINT) AS data_rows, CAST(COALESCE(SUM(data_bytes), 0) AS BIGINT) AS data_bytes,
 CAST(COALESCE(SUM(changes), 0) AS BIGINT) AS applied_changes FROM cmd GROUP BY project, stage"""


@query(SUMMARY)
def run_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runlog_summary(runs(spark, sf_dir))


@query(SUMMARY)
def run_log_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as JSON documents and read with the run schema."""
    path = scratch(spark, "runs")
    runs(spark, sf_dir).withColumnRenamed("project", "project_id").drop("run_id").write.json(path)
    read = R.read_evidence(spark, path, multiline=False)
    return R.runlog_summary(read)


@query(
    f"""WITH {RUNS} SELECT run_id, project, stage, CAST(i AS INTEGER) AS position, CASE WHEN command_id = '' THEN ' ' ELSE command_id END AS command_id,
 'exported rows: ' || e || ' token=<redacted>' AS output, error FROM cmd"""
)
def run_command_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ["run_id", "project", "stage", "position", "command_id", "output", "error"]
    return R.command_summary(runs(spark, sf_dir)).select(*shown)


@query(
    f"""WITH {RUNS} SELECT run_id, CAST(i AS INTEGER) AS position, CASE WHEN command_id = '' THEN ' ' ELSE command_id END AS command_id, CAST(exit_code AS INTEGER) AS exit_code,
 'exported rows: ' || e || ' token=<redacted>' AS detail FROM cmd WHERE exit_code <> 0"""
)
def run_failed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.failed_commands(runs(spark, sf_dir))


@query(
    f"""WITH {RUNS} SELECT 'c0' AS item_id, project, stage, CASE WHEN e % 27 = 24 THEN 'new' ELSE payload_hash END AS fingerprint, e FROM run
WHERE e % 27 = 24 OR NOT EXISTS (SELECT 1 FROM flag f WHERE f.e = run.e AND command_id = 'c0' AND exit_code = 0 AND error = '' AND arg_kind IN ('sql', 'other')
 AND (f.stage <> 'cdc' OR changes IS NOT NULL) AND (NOT must_audit OR audited))"""
)
def run_pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    items = table(spark, sf_dir, "events").select(
        F.lit("c0").alias("item_id"),
        _text("p", F.col("user_id")).alias("project"),
        _stage().alias("stage"),
        F.when(e % 27 == 24, "new").otherwise(_text("h", e % 3)).alias("fingerprint"),
        _args(_text("pw", e)).alias("args"),
        e.alias("e"),
    )
    return R.pending_work(items, runs(spark, sf_dir)).drop("args")


# -- plan integrity -------------------------------------------------------------------------------

def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        _text("p", F.col("o_custkey")).alias("project"),
        F.when(o % 23 == 4, "").when(o % 29 == 5, "twin").otherwise(_text("k", o)).alias("chunk_id"),
        o.alias("chunk_no"),
        F.when(o % 31 == 6, "x").when(o % 37 == 7, " ").otherwise("db.dbo.t").alias("source_object"),
        F.when(o % 41 == 8, "a.b.c").otherwise("shop.t").alias("target_object"),
        F.when(o % 43 == 9, "").otherwise(F.concat(F.lit("s3a://b/"), (o % 3).cast("string"), F.lit("/"), o.cast("string"), F.lit(".csv"))).alias("output_uri"),
        F.when(o % 47 == 10, "TODO: split").otherwise("1 = 1").alias("predicate"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    extra = F.when(o % 61 == 13, "ID").when(o % 67 == 14, "@a b").when(o % 71 == 15, "").otherwise("@skip")
    return table(spark, sf_dir, "orders").select(
        _text("p", F.col("o_custkey")).alias("project"),
        F.when(o % 29 == 6, "twin").otherwise(_text("import-", o)).alias("job_id"),
        F.when(o % 53 == 11, "").otherwise("shop.t").alias("target_object"),
        F.concat(F.lit("s3a://b/"), (o % 3).cast("string"), F.lit("/"), (o + F.when(o % 59 == 12, 1).otherwise(0)).cast("string"), F.lit(".csv")).alias("source_uri"),
        F.when(o % 73 == 16, "").when(o % 79 == 17, "ghost").otherwise(_text("k", o)).alias("depends_on"),
        F.array(F.lit("id"), F.lit("name"), extra).alias("fields"),
    )


PLANS = """ch AS (SELECT o_orderkey AS k, 'p' || o_custkey AS project, CASE WHEN o_orderkey % 23 = 4 THEN '' WHEN o_orderkey % 29 = 5 THEN 'twin' ELSE 'k' || o_orderkey END AS item FROM orders),
jb AS (SELECT o_orderkey AS k, 'p' || o_custkey AS project, CASE WHEN o_orderkey % 29 = 6 THEN 'twin' ELSE 'import-' || o_orderkey END AS item,
 CASE WHEN o_orderkey % 73 = 16 THEN '' WHEN o_orderkey % 79 = 17 THEN 'ghost' ELSE 'k' || o_orderkey END AS dep FROM orders),
named AS (SELECT DISTINCT project, item FROM ch WHERE item <> ''),
dep AS (SELECT jb.project, jb.item, jb.dep, CASE WHEN named.item IS NULL THEN 'dependency_missing' WHEN k % 43 <> 9 AND k % 59 = 12 THEN 'uri_differs' END AS rule
 FROM jb LEFT JOIN named ON named.project = jb.project AND named.item = jb.dep WHERE dep <> '' AND EXISTS (SELECT 1 FROM named n WHERE n.project = jb.project)),
bad AS (SELECT project, 'chunk' AS kind, item, 'id_required' AS rule FROM ch WHERE item = ''
UNION ALL SELECT project, 'chunk', item, 'source_malformed' FROM ch WHERE k % 31 = 6
UNION ALL SELECT project, 'chunk', item, 'source_required' FROM ch WHERE k % 37 = 7 AND k % 31 <> 6
UNION ALL SELECT project, 'chunk', item, 'target_malformed' FROM ch WHERE k % 41 = 8
UNION ALL SELECT project, 'chunk', item, 'output_required' FROM ch WHERE k % 43 = 9
UNION ALL SELECT project, 'chunk', item, 'predicate_unresolved' FROM ch WHERE k % 47 = 10
UNION ALL SELECT project, 'chunk', item, 'id_repeated' FROM ch WHERE item <> '' GROUP BY project, item HAVING COUNT(*) > 1
UNION ALL SELECT project, 'job', item, 'target_required' FROM jb WHERE k % 53 = 11
UNION ALL SELECT project, 'job', item, 'dependency_required' FROM jb WHERE dep = ''
UNION ALL SELECT project, 'job', item, 'field_repeated' FROM jb WHERE k % 61 = 13
UNION ALL SELECT project, 'job', item, 'variable_malformed' FROM jb WHERE k % 67 = 14 AND k % 61 <> 13
UNION ALL SELECT project, 'job', item, 'field_empty' FROM jb WHERE k % 71 = 15 AND k % 67 <> 14 AND k % 61 <> 13
UNION ALL SELECT project, 'job', item, 'id_repeated' FROM jb GROUP BY project, item HAVING COUNT(*) > 1
UNION ALL SELECT project, 'job', item, rule FROM dep WHERE rule IS NOT NULL)"""


@query(f"WITH {PLANS} SELECT * FROM bad")
def plan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.plan_violations(chunks(spark, sf_dir), jobs(spark, sf_dir))


@query(f"WITH {PLANS} SELECT project, item AS job_id, dep AS depends_on, rule FROM dep WHERE rule IS NOT NULL")
def plan_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dependency_violations(chunks(spark, sf_dir), jobs(spark, sf_dir))


@query(
    """WITH d AS (SELECT 'p' || o_custkey AS project, COUNT(DISTINCT o_orderkey % 3) AS dirs, MIN('s3a://b/' || (o_orderkey % 3)) AS dir FROM orders GROUP BY 1)
SELECT project, dirs, CASE WHEN dirs = 1 THEN dir END AS data_source_uri FROM d"""
)
def plan_source_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.source_directories(jobs(spark, sf_dir))


@query(
    """WITH s AS (SELECT 'p' || c_custkey AS project, c_custkey AS k FROM customer)
SELECT project, 'export' AS plan, 'status_required' AS rule FROM s WHERE k % 7 = 1
UNION ALL SELECT project, 'export', 'status_unsupported' FROM s WHERE k % 7 = 2
UNION ALL SELECT project, 'export', 'format_unsupported' FROM s WHERE k % 11 = 3
UNION ALL SELECT project, 'export', 'compression_unsupported' FROM s WHERE k % 13 = 4
UNION ALL SELECT project, 'export', 'null_encoding_unsupported' FROM s WHERE k % 17 = 5
UNION ALL SELECT project, 'export', 'engine_unsupported' FROM s WHERE k % 19 = 6
UNION ALL SELECT project, 'export', 'compression_with_bulk_import' FROM s WHERE k % 19 <> 6 AND k % 3 = 0 AND k % 2 = 0 AND k % 13 <> 4"""
)
def plan_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    settings = table(spark, sf_dir, "customer").select(
        _text("p", k).alias("project"),
        F.lit("export").alias("plan"),
        F.when(k % 7 == 1, "").when(k % 7 == 2, "done").otherwise("approved").alias("status"),
        F.when(k % 11 == 3, "orc").otherwise("CSV").alias("format"),
        F.when(k % 13 == 4, "zip").when(k % 2 == 0, "gzip").otherwise("none").alias("compression"),
        F.when(k % 17 == 5, "words").otherwise("bitmap").alias("null_encoding"),
        F.when(k % 38 == 6, "magic").when(k % 19 == 6, "qdb-lightning").when(k % 3 == 0, "xdb-import-into").otherwise("").alias("engine"),
    )
    return I.settings_violations(settings, vendor="xdb")


@query(
    """WITH pj AS (SELECT 'p' || c_custkey AS project FROM customer), ch AS (SELECT 'p' || o_custkey AS project FROM orders),
ev AS (SELECT 'p' || user_id AS project, event_type FROM events), r AS (SELECT unnest(['no_chunks', 'no_jobs', 'no_tracked_tables', 'no_supported_checks']) AS rule)
SELECT project, rule FROM pj, r WHERE CASE WHEN rule IN ('no_chunks', 'no_jobs') THEN project NOT IN (SELECT project FROM ch)
 WHEN rule = 'no_tracked_tables' THEN project NOT IN (SELECT project FROM ev) ELSE project NOT IN (SELECT project FROM ev WHERE event_type <> 'view') END"""
)
def plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects without chunks, jobs, tracked tables (users) or checks (their events, views unknown)."""
    events = table(spark, sf_dir, "events").select(
        _text("p", F.col("user_id")).alias("project"), F.when(F.col("event_type") == "view", "look").otherwise("checksum").alias("type")
    )
    return I.empty_plans(projects(spark, sf_dir), chunks(spark, sf_dir), jobs(spark, sf_dir), events, events)


# -- gates ----------------------------------------------------------------------------------------


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _text("p", k).alias("project"),
        F.when(k % 3 == 0, "offline").otherwise("online").alias("mode"),
        F.when(k % 2 == 0, "passed").otherwise("failed").alias("validation"),
        F.when(k % 5 != 1, "caught_up").otherwise("running").alias("checkpoint"),
    )


GATES = f"""WITH {RUNS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, stage ORDER BY generated_at DESC, run_id DESC) AS rn FROM run) WHERE rn = 1),
ok AS (SELECT project, stage FROM top WHERE status = 'succeeded' AND run_id NOT IN (SELECT run_id FROM flag WHERE status = 'succeeded' AND must_audit AND NOT audited)),
pj AS (SELECT c_custkey AS k, 'p' || c_custkey AS project FROM customer),
gate AS (SELECT project, 'export_run' AS gate, project IN (SELECT project FROM ok WHERE stage = 'export') AS passed FROM pj
UNION ALL SELECT project, 'import_run', project IN (SELECT project FROM ok WHERE stage = 'import') FROM pj
UNION ALL SELECT project, 'validation_run', project IN (SELECT project FROM ok WHERE stage = 'validation') FROM pj
UNION ALL SELECT project, 'validation_status', k % 2 = 0 FROM pj
UNION ALL SELECT project, 'cdc_run', project IN (SELECT project FROM ok WHERE stage = 'cdc') FROM pj WHERE k % 3 <> 0
UNION ALL SELECT project, 'cdc_checkpoint', k % 5 <> 1 FROM pj WHERE k % 3 <> 0)"""


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_runs, known = runs(spark, sf_dir), projects(spark, sf_dir)
    return G.gates(
        known,
        all_runs,
        known.select("project", F.col("validation").alias("status")),
        known.select("project", F.col("checkpoint").alias("status")),
        R.audit_violations(all_runs),
    )


@query(GATES + " SELECT * FROM gate")
def cutover_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(spark, sf_dir)


@query(GATES + " SELECT project, bool_and(passed) AS go, COUNT(*) FILTER (WHERE NOT passed) AS open_gates FROM gate GROUP BY project")
def cutover_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.go_decision(_gates(spark, sf_dir))


VALIDATION = f"""WITH {RUNS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY generated_at DESC, run_id DESC) AS rn FROM run WHERE stage = 'validation') WHERE rn = 1),
pj AS (SELECT c_custkey AS k, 'p' || c_custkey AS project, CASE WHEN c_custkey % 4 = 1 THEN c_custkey % 9 ELSE 0 END AS items FROM customer),
line AS (SELECT project, 'schema_review' AS "check", items = 0 AS passed, CASE WHEN items = 0 THEN 'no items left' ELSE items || ' items left to review' END AS message FROM pj
UNION ALL SELECT project, 'check_plan', k % 6 <> 1, CASE WHEN k % 6 <> 1 THEN 'check plan is sound' ELSE '1 broken rules' END FROM pj
UNION ALL SELECT pj.project, 'validation_run', status = 'succeeded', CASE WHEN status = 'succeeded' THEN 'validation run succeeded' ELSE 'validation run failed, commands: ' ||
 (SELECT COUNT(*) FROM cmd WHERE cmd.run_id = top.run_id AND exit_code <> 0) END FROM pj JOIN top ON top.project = pj.project)"""


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("project", _text("p", k))
    diffs = rows.select("project", F.when(k % 4 == 1, k % 9).otherwise(0).alias("manual_items"))
    broken = rows.where(k % 6 == 1).select("project", F.lit("id").alias("check_id"), F.lit("id_required").alias("rule"))
    all_runs = runs(spark, sf_dir)
    return G.validation_status(rows, diffs, broken, all_runs, R.failed_commands(all_runs))


@query(VALIDATION + " SELECT * FROM line")
def validation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validation(spark, sf_dir)


@query(VALIDATION + " SELECT project, CASE WHEN bool_and(passed) THEN 'passed' ELSE 'failed' END AS status FROM line GROUP BY project")
def validation_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.validation_outcome(_validation(spark, sf_dir))


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a table: its import needs its chunk and the import of an earlier part, its check the import, its brand's
    gate all checks; some chunks wait for their own check, which is a cycle."""
    k = F.col("p_partkey")
    kind = lambda name, key: F.concat(F.lit(name), key.cast("string"))
    pair = lambda node, needs: F.struct(node.alias("node"), needs.alias("depends_on"))
    pairs = F.array(
        pair(kind("import-", k), kind("chunk-", k)),
        pair(kind("import-", k), F.when(k > 1, kind("import-", F.floor(k / 2)))),
        pair(kind("check-", k), kind("import-", k)),
        pair(kind("gate-", F.col("p_brand")), kind("check-", k)),
        pair(F.when(k % 97 == 3, kind("chunk-", k)), kind("check-", k)),
    )
    return table(spark, sf_dir, "part").select(F.explode(pairs).alias("e")).select("e.*").dropna()


EDGES = """edge AS (SELECT 'import-' || p_partkey AS node, 'chunk-' || p_partkey AS depends_on FROM part
UNION SELECT 'import-' || p_partkey, 'import-' || (p_partkey // 2) FROM part WHERE p_partkey > 1
UNION SELECT 'check-' || p_partkey, 'import-' || p_partkey FROM part
UNION SELECT 'gate-' || p_brand, 'check-' || p_partkey FROM part
UNION SELECT 'chunk-' || p_partkey, 'check-' || p_partkey FROM part WHERE p_partkey % 97 = 3)"""


@query(
    f"""WITH RECURSIVE {EDGES}, open AS (SELECT 'chunk-' || p_partkey AS node FROM part WHERE p_size % 49 = 1
UNION SELECT edge.node FROM edge JOIN open ON edge.depends_on = open.node) SELECT node FROM open"""
)
def plan_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done anew when the chunks of some parts change."""
    mark = lambda f: table(spark, sf_dir, "part").select(F.concat(F.lit("chunk-"), "p_partkey").alias("node"), f.alias("fingerprint"))
    changed = D.changed_items(mark(F.col("p_size").cast("string")), mark(F.when(F.col("p_size") % 49 != 1, F.col("p_size").cast("string"))))
    return D.reopened(_part_edges(spark, sf_dir), changed).select("node")


@query(
    f"""WITH RECURSIVE {EDGES}, reach AS (SELECT node, depends_on AS root FROM edge WHERE depends_on LIKE 'chunk-%'
 AND CAST(substr(depends_on, 7) AS BIGINT) % 97 = 3 UNION SELECT edge.node, reach.root FROM edge JOIN reach ON edge.depends_on = reach.node),
loop AS (SELECT root AS node FROM reach WHERE node = root),
below AS (SELECT node FROM loop UNION SELECT edge.node FROM edge JOIN below ON edge.depends_on = below.node),
above AS (SELECT node FROM loop UNION SELECT edge.depends_on FROM edge JOIN above ON edge.node = above.node)
SELECT node FROM below INTERSECT SELECT node FROM above"""
)
def plan_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan items that wait for themselves."""
    return D.cyclic(_part_edges(spark, sf_dir))
