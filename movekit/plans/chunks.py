"""Planning chunked exports and their import jobs, and splitting a table by predicates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.functions.scalars import safe_name
from movekit.sources.csvio import EXTENSIONS, check_compression

DEFAULT_CHUNK_ROWS = 1_000_000


def plan_chunks(
    tables: DataFrame,
    uri_prefix: str,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    compression: str = "none",
    id_from_target: bool = False,
) -> DataFrame:
    """One row per chunk of every table (schema, table, source_object, target_object, row_count).

    ``ceil(rows / chunk_rows)`` chunks, one for an empty table; the last takes the remainder.
    Ids are ``<schema>.<table>.000001``; the split predicate of a multi-chunk table is filled in
    from :func:`split_predicates`.
    """
    if not uri_prefix.strip():
        raise ValueError("a URI prefix is required")
    if chunk_rows <= 0:
        raise ValueError("chunk size must be positive")
    extension = EXTENSIONS[check_compression(compression)]
    rows, size = F.col("row_count"), F.lit(chunk_rows).cast("long")
    count = F.when(rows > 0, F.expr(f"(row_count + {chunk_rows - 1}L) div {chunk_rows}L")).otherwise(F.lit(1).cast("long"))
    prefix = safe_name(F.col("target_object") if id_from_target else F.concat_ws(".", "schema", "table"))
    number = F.col("chunk_no")
    width = F.when(number < 1_000_000, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string"))
    left = rows - (number - 1) * size
    return (
        tables.withColumn("_chunks", count)
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_chunks"))))
        .select(
            F.concat(prefix, F.lit("."), width).alias("chunk_id"),
            "source_object",
            "target_object",
            "chunk_no",
            F.col("_chunks").alias("chunks"),
            F.when(rows > 0, F.least(left, size)).otherwise(F.lit(0).cast("long")).alias("estimated_rows"),
            F.when(F.col("_chunks") == 1, "1 = 1")
            .otherwise(F.concat(F.lit("TODO: split "), "source_object", F.lit(" chunk "), number.cast("string")))
            .alias("predicate"),
        )
        .withColumn("output_uri", F.concat(F.lit(uri_prefix.rstrip("/") + "/"), "chunk_id", F.lit("." + extension)))
    )


def plan_jobs(chunks: DataFrame) -> DataFrame:
    """One import job per chunk, reading what the chunk wrote."""
    return chunks.select(
        F.concat(F.lit("import-"), "chunk_id").alias("job_id"),
        "target_object",
        F.col("output_uri").alias("source_uri"),
        F.col("chunk_id").alias("depends_on"),
    )


def _literal(value) -> str:
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'" if value.tzinfo is None else f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, Decimal):
        return f"{value}BD"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return str(value)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def split_bounds(df: DataFrame, key: str, chunks: int) -> list:
    """Ascending inner bounds of ``chunks`` ranges of similar size; fewer where one value fills several."""
    points = [i / chunks for i in range(1, chunks)]
    found = df.agg(F.percentile_approx(F.col("`" + key.replace("`", "``") + "`"), points, max(10_000, 20 * chunks)).alias("b")).head()["b"] if points else []
    return sorted(set(found or []))


def range_of(value: Column, bounds: Sequence, kind: T.DataType) -> Column:
    """The number of ``bounds`` (ascending) at or below ``value``, 0 without a value.

    A binary search in one constant array, so the time hardly depends on the number of bounds.
    """
    if not bounds:
        return F.lit(0)
    if isinstance(kind, T.TimestampType):  # its text depends on the time zone
        edges = F.array(*[F.lit(b) for b in bounds])
    else:
        edges = F.split(F.lit("\n".join(str(b) for b in bounds)), "\n").cast(T.ArrayType(kind))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when((low + step <= len(bounds)) & (F.get(edges, low + step - 1) <= value), low + step).otherwise(low),
    )


def split_predicates(df: DataFrame, key: str, chunks: int, tiebreak: Sequence[str] = ()) -> list[str]:
    """Predicates that put every row, NULL keys included, in exactly one chunk of similar size.

    Bounds come from one mergeable quantile sketch over the key column. A key value so frequent
    that it fills several chunks is split further by a hash of the ``tiebreak`` columns, or of all
    columns where none are given; only rows equal in all of these stay together. Keys without quantiles
    (text, binary) are split by hash.
    """
    if chunks <= 1:
        return ["1 = 1"]
    name = "`" + key.replace("`", "``") + "`"
    kind = df.schema[key].dataType
    if isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType)):
        return [f"pmod(xxhash64({name}), {chunks}) = {i}" for i in range(chunks)]
    points = [i / chunks for i in range(1, chunks)]
    bounds = df.agg(F.percentile_approx(F.col(name), points, max(10_000, 20 * chunks)).alias("b")).head()["b"] or []
    steps: list[list] = []  # [value, how many bounds fell on it]
    for bound in bounds:
        if steps and steps[-1][0] == bound:
            steps[-1][1] += 1
        else:
            steps.append([bound, 1])
    if not steps:
        return ["1 = 1"]
    spread = ", ".join("`" + c.replace("`", "``") + "`" for c in tiebreak or _hashable(df))
    out = [f"{name} < {_literal(steps[0][0])}"]
    for i, (value, times) in enumerate(steps):
        low, high = _literal(value), _literal(steps[i + 1][0]) if i + 1 < len(steps) else None
        below = f" AND {name} < {high}" if high else ""
        if times > 1 and spread:
            out += [f"{name} = {low} AND pmod(xxhash64({spread}), {times}) = {j}" for j in range(times)]
            out.append(f"{name} > {low}{below}")
        else:
            out.append(f"{name} >= {low}{below}")
    out.append(f"{name} IS NULL")
    return out


def chunk_coverage(df: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """How many rows fall in how many chunks; a sound split has the single row ``hits = 1``."""
    held = F.array(*[F.coalesce(F.expr(f"({p})"), F.lit(False)) for p in predicates])
    hits = F.size(F.array_remove(held, False))
    return df.select(hits.alias("hits")).groupBy("hits").agg(F.count(F.lit(1)).alias("n"))
