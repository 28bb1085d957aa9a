"""Evidence of what was written: rows, bytes and SHA-256 per file, and one digest per set of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movekit.sources.csvio import BITMAP, check_header, read_header, read_text


def stored_files(spark: SparkSession, path: str, glob: str = "*.csv*") -> DataFrame:
    """uri, bytes and sha256 of each stored object, read by Spark whatever its size or store.

    A file is one value of one task, so exports should keep files at chunk size; one beyond the
    reader's own limit for a value fails the audit.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.col("_metadata.file_path").alias("uri"),
        F.col("length").alias("bytes"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"),
    )


def audit_files(spark: SparkSession, path: str, multiline: bool = True, glob: str = "*.csv*") -> DataFrame:
    """Per file: decoded rows, stored bytes and digest. Rows count on the map side before they meet."""
    header = read_header(spark, path)
    rows = (
        read_text(spark, path, header, multiline)
        .select(F.col("_metadata.file_path").alias("uri"))
        .groupBy("uri")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return (
        stored_files(spark, path, glob)
        .join(rows, "uri", "left")
        .select("uri", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes", "sha256")
    )


def reject_bitmap(spark: SparkSession, path: str) -> None:
    """Files bound for a loader that reads ``\\N`` must not carry the bitmap column any more."""
    if check_header(read_header(spark, path)):
        raise ValueError(f"{path} still carries the column {BITMAP}")


def manifest_audit(audits: DataFrame, groups: Sequence[str] = (), order: str = "position") -> DataFrame:
    """Totals and one digest per set of files over ``uri TAB rows TAB bytes TAB sha256 LF`` in plan order.

    A chained digest has to see its lines in order. They are sorted within their group by the
    shuffle (which spills to disk) and fed to a running hash, so a task holds one batch of lines
    and one hash state, whatever the number of files.
    """
    keys = list(groups)
    lines = audits.select(
        *[F.col(k).cast("string").alias(k) for k in keys],
        F.col(order).cast("long").alias("_at"),
        "rows",
        "bytes",
        F.concat_ws("\t", F.col("uri"), F.col("rows").cast("string"), F.col("bytes").cast("string"), F.col("sha256")).alias("_line"),
    )
    placed = lines.repartition(*[F.col(k) for k in keys]) if keys else lines.repartition(1)
    shape = ", ".join([f"{k} string" for k in keys] + ["files long", "rows long", "bytes long", "sha256 string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "files", "rows", "bytes", "sha256"]
        current, state, totals = None, hashlib.sha256(), [0, 0, 0]
        for batch in batches:
            finished = []
            groups = list(zip(*[batch[k] for k in keys], strict=True)) if keys else [()] * len(batch)
            for group, line, n, size in zip(groups, batch["_line"], batch["rows"], batch["bytes"], strict=True):
                if group != current:
                    if current is not None:
                        finished.append([*current, *totals, "sha256:" + state.hexdigest()])
                    current, state, totals = group, hashlib.sha256(), [0, 0, 0]
                state.update(f"{line}\n".encode())
                totals = [totals[0] + 1, totals[1] + int(n), totals[2] + int(size)]
            yield pd.DataFrame(finished, columns=names)
        if current is not None:
            yield pd.DataFrame([[*current, *totals, "sha256:" + state.hexdigest()]], columns=names)

    return placed.sortWithinPartitions(*keys, "_at").mapInPandas(run, shape)
