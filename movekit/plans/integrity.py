"""Soundness of export and import plans: chunks(project, chunk_id, ...), jobs(project, job_id, ...), settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.functions.scalars import ENGINES, blank, engine_name, has_todo, source_name_ok, strip, target_name_ok
from movekit.plans.checks import CHECK_TYPES
from movekit.plans.ranges import repeated, violations

# Accepted settings of a plan.
PLAN_STATES = ("draft", "reviewed", "approved")
FORMATS = ("", "csv")
CODECS = ("", "none", "gzip")
NULL_ENCODINGS = ("", "bitmap", "backslash-n")


def _low(name: str) -> Column:
    return F.lower(strip(F.coalesce(F.col(name), F.lit(""))))


def dependency_violations(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs whose export chunk does not exist or writes elsewhere. A project without chunks is not checked."""
    known = (
        chunks.where(~blank(F.col("chunk_id")))
        .groupBy("project", strip("chunk_id").alias("_dep"))
        .agg(F.max_by(strip("output_uri"), "chunk_no").alias("_uri"))
    )
    checked = jobs.where(~blank(F.col("depends_on"))).withColumn("_dep", strip("depends_on"))
    planned = known.select("project").distinct()
    joined = checked.join(planned, "project", "left_semi").join(
        known.withColumn("_known", F.lit(True)), ["project", "_dep"], "left"
    )
    uri = strip("source_uri")
    rule = F.when(F.col("_known").isNull(), "dependency_missing").when(
        ~blank(uri) & ~blank(F.col("_uri")) & (uri != F.col("_uri")), "uri_differs"
    )
    return joined.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("project", "job_id", "depends_on", "rule")


def chunk_violations(chunks: DataFrame) -> DataFrame:
    source, target = F.col("source_object"), F.col("target_object")
    named = chunks.withColumn("chunk_id", strip(F.coalesce("chunk_id", F.lit(""))))
    ids = ["project", "chunk_id"]
    rules = [
        ("id_required", F.col("chunk_id") == ""),
        ("source_required", blank(source)),
        ("source_malformed", ~blank(source) & ~source_name_ok(source)),
        ("target_required", blank(target)),
        ("target_malformed", ~blank(target) & ~target_name_ok(target)),
        ("output_required", blank(F.col("output_uri"))),
        ("predicate_unresolved", has_todo(F.col("predicate"))),
    ]
    return violations(named, ids, rules).unionByName(repeated(named.where("chunk_id <> ''"), ids, "id_repeated"))


def job_violations(jobs: DataFrame) -> DataFrame:
    """Jobs with optional ``fields``: blanks, bad variables and repeated names are reported too."""
    target = F.col("target_object")
    named = jobs.withColumn("job_id", strip(F.coalesce("job_id", F.lit(""))))
    if "fields" not in jobs.columns:
        named = named.withColumn("fields", F.array().cast("array<string>"))
    fields = F.coalesce(F.col("fields"), F.array().cast("array<string>"))
    given = F.transform(F.filter(fields, lambda f: ~blank(f)), lambda f: F.lower(strip(f)))
    variable = lambda f: f.startswith("@") & ~f.rlike("^@[a-z0-9_.$]+$")
    ids = ["project", "job_id"]
    rules = [
        ("id_required", F.col("job_id") == ""),
        ("target_required", blank(target)),
        ("target_malformed", ~blank(target) & ~target_name_ok(target)),
        ("source_required", blank(F.col("source_uri"))),
        ("dependency_required", blank(F.col("depends_on"))),
        ("field_empty", F.exists(fields, blank)),
        ("variable_malformed", F.exists(given, variable)),
        ("field_repeated", F.size(F.array_distinct(given)) < F.size(given)),
    ]
    return violations(named, ids, rules).unionByName(repeated(named.where("job_id <> ''"), ids, "id_repeated"))


def settings_violations(settings: DataFrame, vendor: str = "") -> DataFrame:
    """Plan-level settings: project, plan, status, format, compression, null_encoding, engine.

    ``vendor`` is the prefix that engine names may carry.
    """
    status, engine, codec = strip(F.coalesce("status", F.lit(""))), engine_name(F.col("engine"), vendor), _low("compression")
    return violations(
        settings,
        ["project", "plan"],
        [
            ("status_required", status == ""),
            ("status_unsupported", (status != "") & ~status.isin(*PLAN_STATES)),
            ("format_unsupported", ~_low("format").isin(*FORMATS)),
            ("compression_unsupported", ~codec.isin(*CODECS)),
            ("null_encoding_unsupported", ~_low("null_encoding").isin(*NULL_ENCODINGS)),
            ("engine_unsupported", ~engine.isin(*ENGINES)),
            ("compression_with_bulk_import", (engine == "import-into") & (codec == "gzip")),
        ],
    )


def source_directories(jobs: DataFrame) -> DataFrame:
    """Per project the one directory all its jobs read, or that there are several (directory engines need one)."""
    folder = F.regexp_replace(strip("source_uri"), "/[^/]*$", "")
    by_folder = jobs.select("project", folder.alias("dir")).distinct()
    found = by_folder.groupBy("project").agg(F.count(F.lit(1)).alias("dirs"), F.min("dir").alias("dir"))
    return found.select("project", "dirs", F.when(F.col("dirs") == 1, F.col("dir")).alias("data_source_uri"))


def empty_plans(projects: DataFrame, chunks: DataFrame, jobs: DataFrame, tracked: DataFrame, checks: DataFrame) -> DataFrame:
    """Projects that have no chunk, job, tracked table or check of a known type: project, rule."""
    parts = [
        (chunks, "no_chunks"),
        (jobs, "no_jobs"),
        (tracked, "no_tracked_tables"),
        (checks.where(F.col("type").isin("row-count", *CHECK_TYPES)), "no_supported_checks"),
    ]
    # One row per project and plan that is filled; what is missing from the full list is empty.
    filled = None
    for plan, rule in parts:
        rows = plan.select("project", F.lit(rule).alias("rule")).distinct()
        filled = rows if filled is None else filled.unionByName(rows)
    wanted = projects.select("project", F.explode(F.array(*[F.lit(rule) for _, rule in parts])).alias("rule"))
    return wanted.join(filled, ["project", "rule"], "left_anti")


def plan_violations(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """All rules of both plans: project, kind, item, rule."""
    of_chunks = chunk_violations(chunks).select("project", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item"), "rule")
    of_jobs = job_violations(jobs).select("project", F.lit("job").alias("kind"), F.col("job_id").alias("item"), "rule")
    of_links = dependency_violations(chunks, jobs).select("project", F.lit("job").alias("kind"), F.col("job_id").alias("item"), "rule")
    return of_chunks.unionByName(of_jobs).unionByName(of_links)
