"""Planning and validating checks between source and target tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.functions.scalars import blank, has_todo, safe_name, source_name_ok, strip, target_name_ok
from movekit.operators.reconcile import DEFAULT_BUCKETS, DEFAULT_MODULO, MAX_BUCKETS
from movekit.plans.ranges import violations

# Check types in report order; ``row-count`` is another spelling of the first.
CHECK_TYPES = ("row_count", "checksum", "sampled_hash", "bucketed_count", "business_sql")
SQL_TYPES = CHECK_TYPES[1:]


def _ident(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def _object(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, r"\."), _ident), ".")


def plan_checks(
    scope: DataFrame,
    checksum: bool = True,
    sampled: bool = True,
    bucketed: bool = False,
    modulo: int = DEFAULT_MODULO,
    buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """Checks for every table of the scope: schema, table, source_object, target_object,
    numeric_columns[], sample_column.

    Sums need exact-numeric columns, samples and buckets an integer column; SQL is text that
    :func:`movekit.operators.reconcile.sql_check` runs. One row per check, one per bucket.
    """
    modulo = modulo if modulo > 0 else DEFAULT_MODULO
    buckets = buckets if buckets > 0 else DEFAULT_BUCKETS
    if bucketed and buckets > MAX_BUCKETS:
        raise ValueError(f"bucket count must be between 1 and {MAX_BUCKETS}")
    stem = safe_name(F.concat_ws(".", "schema", "table"))
    numeric = F.coalesce(F.col("numeric_columns"), F.array().cast("array<string>"))
    term = lambda c: F.concat(F.lit("COALESCE(CAST("), _ident(c), F.lit(" AS DECIMAL(38, 6)), 0)"))
    total = F.concat(F.lit("SELECT COALESCE(SUM("), F.array_join(F.transform(numeric, term), " + "), F.lit("), 0) FROM "))
    key = F.concat(F.lit("CAST("), _ident(F.col("sample_column")), F.lit(" AS BIGINT)"))
    has_numbers, has_key = F.size(numeric) > 0, ~blank(F.col("sample_column"))
    rest = F.concat(F.lit(" WHERE "), key, F.lit(f" % {modulo} = 0"))
    source, target = F.col("source_object"), F.col("target_object")
    null = F.lit(None).cast("string")

    def check(suffix: Column, kind: str, head: Column | None, tail: Column | None = None) -> Column:
        text = lambda obj: null if head is None else F.concat(head, _object(obj), tail if tail is not None else F.lit(""))
        return F.struct(
            F.concat(stem, suffix).alias("check_id"),
            F.lit(kind).alias("type"),
            text(source).alias("source_sql"),
            text(target).alias("target_sql"),
        )

    listed = [F.array(check(F.lit(".row-count"), "row_count", None))]
    if checksum:
        listed.append(F.array(F.when(has_numbers, check(F.lit(".checksum"), "checksum", total))))
    if sampled:
        listed.append(F.array(F.when(has_numbers & has_key, check(F.lit(".sampled-hash"), "sampled_hash", total, rest))))
    if bucketed:
        count = F.lit("SELECT COUNT(*) FROM ")
        one = lambda b: F.when(
            has_key,
            check(
                F.concat(F.lit(".bucket-count."), b.cast("string")),
                "bucketed_count",
                count,
                F.concat(F.lit(" WHERE ABS("), key, F.lit(f") % {buckets} = "), b.cast("string")),
            ),
        )
        listed.append(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), one))
    every = F.filter(F.concat(*listed), lambda c: c.isNotNull())
    return scope.select("source_object", "target_object", F.explode(every).alias("c")).select(
        "c.check_id", "c.type", "source_object", "target_object", "c.source_sql", "c.target_sql"
    )


def validate_checks(checks: DataFrame) -> DataFrame:
    """Broken rules of a check plan; checks of unknown type are passed over."""
    rows_type = F.col("type").isin("row_count", "row-count")
    known = rows_type | F.col("type").isin(*SQL_TYPES)
    source, target = F.col("source_object"), F.col("target_object")
    left, right = F.col("source_sql"), F.col("target_sql")
    sql_type = ~rows_type
    ours = checks.where(known).withColumn("check_id", strip(F.coalesce("check_id", F.lit(""))))
    rules = [
        ("id_required", F.col("check_id") == ""),
        ("source_required", rows_type & blank(source)),
        ("source_malformed", rows_type & ~blank(source) & ~source_name_ok(source)),
        ("target_required", rows_type & blank(target)),
        ("target_malformed", rows_type & ~blank(target) & ~target_name_ok(target)),
        ("predicate_unresolved", rows_type & has_todo(F.col("predicate"))),
        ("target_predicate_unresolved", rows_type & has_todo(F.col("target_predicate"))),
        ("source_sql_required", sql_type & blank(left)),
        ("target_sql_required", sql_type & blank(right)),
        ("source_sql_unresolved", sql_type & has_todo(left)),
        ("target_sql_unresolved", sql_type & has_todo(right)),
    ]
    twice = (
        ours.where("check_id <> ''").groupBy("check_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .select("check_id", F.lit("id_repeated").alias("rule"))
    )
    return violations(ours, ["check_id"], rules).unionByName(twice)


def check_type_summary(checks: DataFrame) -> DataFrame:
    """Checks per known type with its place in the report; types without checks are left out."""
    kind = F.when(F.col("type") == "row-count", "row_count").otherwise(F.col("type"))
    place = F.array_position(F.array(*[F.lit(t) for t in CHECK_TYPES]), F.col("type"))
    return (
        checks.select(kind.alias("type"))
        .where(F.col("type").isin(*CHECK_TYPES))
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("checks"))
        .withColumn("place", place.cast("int"))
    )


def check_type_line(checks: DataFrame) -> DataFrame:
    """The summary as one line of text, in report order (at most five types)."""
    counted = check_type_summary(checks)
    parts = F.array_sort(F.collect_list(F.struct("place", "checks", "type")))
    line = F.array_join(F.transform("p", lambda x: F.concat_ws(" ", x["checks"].cast("string"), x["type"])), ", ")
    return counted.agg(parts.alias("p")).select(
        F.when(F.size("p") == 0, "0 supported checks").otherwise(line).alias("summary")
    )
