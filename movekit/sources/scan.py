"""Table scans: catalog tables, files and JDBC, with an optional predicate text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_object(name: str) -> list[str]:
    parts = [p.strip() for p in name.strip().split(".")]
    if len(parts) not in (2, 3) or "" in parts:
        raise ValueError(f"{name!r} must be schema.table or database.schema.table")
    return parts


def quoted(name: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in split_object(name))


def where(df: DataFrame, predicate: str | None) -> DataFrame:
    return df.where(F.expr(predicate)) if predicate and predicate.strip() else df


def scan(spark: SparkSession, obj: str, predicate: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A catalog table (``schema.table``) or a path (anything with a slash); filters reach the source."""
    df = spark.read.format(fmt).load(obj) if "/" in obj else spark.table(quoted(obj))
    return where(df, predicate)


def jdbc_scan(
    spark: SparkSession,
    url: str,
    obj: str,
    predicates: Sequence[str] | None = None,
    predicate: str | None = None,
    properties: Mapping[str, str] | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A database table, one task and one connection per chunk predicate."""
    options = {"fetchsize": str(fetch_size), **(properties or {})}
    split_object(obj)
    if predicates:
        df = spark.read.jdbc(url, obj, predicates=list(predicates), properties=options)
    else:
        df = spark.read.jdbc(url, obj, properties=options)
    return where(df, predicate)


def jdbc_append(
    df: DataFrame, url: str, table: str, batch: int = 1000, properties: Mapping[str, str] | None = None
) -> None:
    """Append with batched inserts; one transaction per task."""
    if batch <= 0:
        raise ValueError("batch size must be positive")
    df.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=dict(properties or {}))
