"""What in a catalog has no direct counterpart in the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.functions.scalars import strip
from movekit.operators.catalog import Inventory


def _rows(df: DataFrame, item: Column, *rules: tuple[str, str, Column]) -> DataFrame:
    """One row per rule that holds, from one pass over ``df``."""
    hits = F.array(
        *[F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, cond in rules]
    )
    return df.select(item.alias("object"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(
        "object", "h.severity", "h.code"
    )


def findings(inventory: Inventory) -> DataFrame:
    """object, severity (blocker/warning), code. Type rules look at the whole type text."""
    kind = F.lower(strip("type"))
    in_table = F.concat_ws(".", "database", "schema", "table", "name")
    always = F.lit(True)
    parts = [
        _rows(
            inventory.columns,
            in_table,
            ("blocker", "type_xml", kind == "xml"),
            ("blocker", "type_rowversion", kind.isin("rowversion", "timestamp")),
            ("warning", "computed_column", F.col("computed")),
        ),
        _rows(
            inventory.indexes,
            in_table,
            ("warning", "filtered_index", F.col("filtered")),
            ("warning", "included_columns", F.size("included_columns") > 0),
        ),
        _rows(inventory.triggers, in_table, ("blocker", "trigger", always)),
        _rows(inventory.routines, F.concat_ws(".", "database", "schema", "name"), ("blocker", "routine", always)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def findings_summary(found: DataFrame) -> DataFrame:
    severity = F.col("severity")
    return found.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(severity == "blocker").alias("blockers"),
        F.count_if(severity == "warning").alias("warnings"),
        F.count_if(~severity.isin("blocker", "warning")).alias("other"),
    )
