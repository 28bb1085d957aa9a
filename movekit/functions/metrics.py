"""Row, byte and digest figures read out of command output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.functions.scalars import is_digest

# Labels printed by the commands of each stage.
ROWS = {"export": "exported rows:", "import": "imported rows:"}
BYTES = {"export": "output bytes:", "import": "input bytes:"}
DIGEST = {"export": "output sha256:", "import": "input sha256:"}
CHANGES = {"cdc": "applied changes:"}


def _label(stage: Column, labels: dict[str, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for name, label in labels.items():
        chosen = F.when(stage == name, F.lit(label)).otherwise(chosen)
    return chosen


def _values(lines: Column, label: Column) -> Column:
    """Trimmed text after ``label`` on every line that starts with it."""
    hits = F.filter(lines, lambda line: F.coalesce(line.startswith(label), F.lit(False)))
    return F.transform(hits, lambda line: F.trim(F.substr(line, F.length(label) + 1)))


def _count(text: Column) -> Column:
    number = F.when(text.rlike(r"^\+?\d+$"), text).try_cast("long")
    return number


def extract_metrics(log: DataFrame, stage: str = "stage", output: str = "output") -> DataFrame:
    """Adds data_rows, data_bytes, data_sha256, applied_changes and ``metrics_error``.

    The last rows/bytes line and the first digest/changes line count; rows and bytes must come
    together, numbers must be non-negative, and a cdc log must state its applied changes.
    """
    kind = F.col(stage)
    lines = F.transform(F.split(F.coalesce(F.col(output), F.lit("")), "\n"), lambda x: F.trim(F.translate(x, "\r\t", "  ")))
    work = log.withColumn("_lines", lines).withColumns(
        {
            "_rows": _values(F.col("_lines"), _label(kind, ROWS)),
            "_bytes": _values(F.col("_lines"), _label(kind, BYTES)),
            "_sha": F.get(_values(F.col("_lines"), _label(kind, DIGEST)), F.lit(0)),
            "_chg": F.get(_values(F.col("_lines"), _label(kind, CHANGES)), F.lit(0)),
        }
    )
    rows, size = F.col("_rows"), F.col("_bytes")
    bad = lambda values: F.exists(values, lambda v: _count(v).isNull())
    error = (
        F.when(bad(rows), "rows_not_a_count")
        .when(bad(size), "bytes_not_a_count")
        .when((F.size(rows) > 0) != (F.size(size) > 0), "rows_and_bytes_must_come_together")
        .when(F.col("_sha").isNotNull() & ~is_digest(F.col("_sha")), "digest_malformed")
        .when((kind == "cdc") & F.col("_chg").isNull(), "changes_missing")
        .when(F.col("_chg").isNotNull() & _count(F.col("_chg")).isNull(), "changes_not_a_count")
    )
    last = lambda values: F.get(values, F.size(values) - 1)
    return work.withColumns(
        {
            "metrics_error": error,
            "data_rows": F.when(error.isNull(), _count(last(rows))),
            "data_bytes": F.when(error.isNull(), _count(last(size))),
            "data_sha256": F.when(error.isNull(), F.col("_sha")),
            "applied_changes": F.when(error.isNull(), _count(F.col("_chg"))),
        }
    ).drop("_lines", "_rows", "_bytes", "_sha", "_chg")
