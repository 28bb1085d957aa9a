"""Differences between a reviewed baseline, the plans made from it and the catalog of today.

Table frames here have source_object and ``columns``: array of (name, type) in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.functions.scalars import SPACES, blank, source_name_ok, strip
from movekit.session import by_key


def table_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables (source_object, ...) with their ordered columns; a table without columns keeps none."""
    ordered = columns.groupBy("source_object").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "name", "type"))).alias("_c")
    )
    listed = F.transform("_c", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))
    none = F.array().cast("array<struct<name:string,type:string>>")
    return tables.join(by_key(ordered), "source_object", "left").withColumn("columns", F.coalesce(listed, none)).drop("_c")


def _key(name: Column) -> Column:
    return F.lower(strip(name))


def _shape(columns: Column) -> Column:
    return F.transform(columns, lambda c: F.struct(_key(c["name"]), _key(c["type"])))


def _shown(columns: Column) -> Column:
    named = lambda c: F.when(blank(c["type"]), strip(c["name"])).otherwise(
        F.concat(strip(c["name"]), F.lit(":"), strip(c["type"]))
    )
    return F.array_join(F.transform(F.coalesce(columns, F.array().cast("array<struct<name:string,type:string>>")), named), ", ")


def detect_drift(baseline: DataFrame, inventory: DataFrame, baseline_status: str = "reviewed") -> DataFrame:
    """Issues: table_missing (manual), columns_changed and table_added (repairable).

    ``inventory`` covers the whole catalog and marks the project's tables with ``in_scope``:
    a baseline table counts as missing only when the whole catalog lacks it, and only tables in
    scope are added. A baseline that was never reviewed has no drift.
    """
    old = baseline.where(~blank(F.col("source_object"))).select(
        _key(F.col("source_object")).alias("_k"), strip("source_object").alias("old_name"), F.col("columns").alias("old")
    )
    new = inventory.select(
        _key(F.col("source_object")).alias("_k"), F.col("source_object").alias("new_name"), F.col("columns").alias("new"), "in_scope"
    )
    joined = old.join(by_key(new), "_k", "full")
    code = (
        F.when(F.col("new_name").isNull(), "table_missing")
        .when(F.col("old_name").isNull(), F.when(F.col("in_scope"), "table_added"))
        .when(_shape(F.col("old")) != _shape(F.col("new")), "columns_changed")
    )
    return (
        joined.where(F.lit(baseline_status.strip() == "reviewed"))
        .withColumn("code", code)
        .where(F.col("code").isNotNull())
        .select(
            F.when(F.col("code") == "table_missing", "manual_required").otherwise("auto_repairable").alias("classification"),
            F.coalesce("old_name", "new_name").alias("source_object"),
            "code",
            _shown(F.col("old")).alias("baseline_columns"),
            _shown(F.col("new")).alias("inventory_columns"),
        )
    )


def in_report_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy("classification", "source_object", "code")


def drift_decision(issues: DataFrame) -> DataFrame:
    """One row: issues, whether anything drifted and whether it can be repaired without a person."""
    manual = F.coalesce(F.bool_or(F.col("classification") == "manual_required"), F.lit(False))
    return issues.agg(F.count(F.lit(1)).alias("issues"), manual.alias("_m")).select(
        "issues",
        (F.col("issues") > 0).alias("drift_detected"),
        F.col("_m").alias("needs_person"),
        ((F.col("issues") > 0) & ~F.col("_m")).alias("repairable"),
    )


def _same(left: Column, right: Column) -> Column:
    trimmed = lambda names: F.transform(names, _key)
    return F.coalesce(trimmed(left) == trimmed(right), F.lit(False))


def check_objects(objects: DataFrame, inventory: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """Objects used by a plan (label, source_object) against the catalog and the reviewed baseline.

    Blank and malformed names are left to the plan's own rules; a two-part name is never found.
    """
    used = objects.where(~blank(F.col("source_object")) & source_name_ok(F.col("source_object"))).withColumn(
        "_k", _key(F.col("source_object"))
    )
    now = inventory.select(_key(F.col("source_object")).alias("_k"), F.col("columns").alias("now"), F.lit(True).alias("_now"))
    joined = used.join(by_key(now), "_k", "left")
    rule = F.when(F.col("_now").isNull(), "missing_from_catalog")
    if reviewed is not None:
        was = reviewed.select(_key(F.col("source_object")).alias("_k"), F.col("columns").alias("was"), F.lit(True).alias("_was"))
        joined = joined.join(by_key(was), "_k", "left")
        rule = rule.when(F.col("_was").isNull(), "missing_from_baseline").when(
            _shape(F.col("was")) != _shape(F.col("now")), "columns_differ_from_baseline"
        )
    return joined.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("label", "source_object", "rule")


def check_tracked(tracked: DataFrame, captured: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tracked tables whose columns or keys no longer equal the catalog's.

    ``captured`` has source_object and columns[] of every catalog table; ``indexes`` has
    source_object, columns[], unique, primary_key and filtered.
    """
    now = captured.select(_key(F.col("source_object")).alias("_k"), F.col("columns").alias("now"))
    usable = indexes.where(
        (F.col("primary_key") | F.col("unique")) & ~F.col("filtered") & (F.size("columns") > 0)
    ).select(_key(F.col("source_object")).alias("_k"), F.transform("columns", _key).alias("_key_columns"))
    keys = usable.groupBy("_k").agg(F.collect_set("_key_columns").alias("keys"))
    joined = tracked.withColumn("_k", _key(F.col("source_object"))).join(by_key(now), "_k", "left").join(by_key(keys), "_k", "left")
    has_key = F.coalesce(F.array_contains("keys", F.transform("key_columns", _key)), F.lit(False))
    rules = F.array(
        F.when(F.col("now").isNull(), F.lit("missing_from_catalog")),
        F.when(F.col("now").isNotNull() & ~_same(F.col("columns"), F.col("now")), F.lit("columns_differ")),
        F.when(F.col("now").isNotNull() & ~has_key, F.lit("key_differs")),
    )
    return joined.select("source_object", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def check_fields(jobs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Import jobs (job_id, source_object, fields[]) whose named fields differ from the catalog columns."""
    named = F.filter("fields", lambda f: ~blank(f) & ~strip(f).startswith("@"))
    now = inventory.select(
        _key(F.col("source_object")).alias("_k"),
        F.filter(F.transform("columns", lambda c: c["name"]), lambda n: ~blank(n)).alias("now"),
    )
    listed = jobs.where((F.size("fields") > 0) & ~blank(F.col("source_object"))).withColumn("_k", _key(F.col("source_object")))
    return (
        listed.join(by_key(now), "_k", "left")
        .withColumn("rule", F.when(F.col("now").isNull(), "missing_from_catalog").when(~_same(named, F.col("now")), "fields_differ"))
        .where(F.col("rule").isNotNull())
        .select("job_id", "source_object", "rule")
    )


def sql_objects(statements: DataFrame, sql: str = "source_sql") -> DataFrame:
    """Three-part names after FROM or JOIN in each statement, quotes and brackets stripped."""
    words = F.split(strip(F.regexp_replace(F.coalesce(F.col(sql), F.lit("")), SPACES, " ")), " ")
    bare = lambda w: F.regexp_replace(w, r"^[(),;]+|[(),;]+$", "")
    name = lambda w: F.regexp_replace(F.regexp_replace(bare(w), r"[\[\]`\"]", ""), "^[,;]+|[,;]+$", "")
    spread = statements.withColumn("_w", words)
    after = F.transform(
        F.col("_w"), lambda w, i: F.when(F.lower(bare(w)).isin("from", "join"), name(F.get(F.col("_w"), i + 1)))
    )
    kept = F.filter(after, lambda o: o.isNotNull() & (F.size(F.split(o, r"\.")) == 3) & source_name_ok(o))
    return spread.withColumn("source_object", F.explode(kept)).drop("_w")
