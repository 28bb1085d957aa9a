"""Chunked export and typed load."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.plans.chunks import range_of
from movekit.session import folder_names
from movekit.sources.csvio import BITMAP, check_compression, write_csv

CHUNK = "chunk_id"


def export_chunks(
    df: DataFrame,
    path: str,
    chunk_rows: int,
    null_encoding: str = "bitmap",
    compression: str = "none",
    key: str | None = None,
    partitions: int | None = None,
    tiebreak: Sequence[str] = (),
) -> None:
    """Write a table as CSV files of at most ``chunk_rows`` rows.

    Without ``key`` every input split writes its own files: no shuffle, and no key value, however
    frequent, can make one task larger than another. With ``key`` rows are ranged so that each
    file covers a key interval; equal keys spread by the hash of ``tiebreak`` and exact copies by
    the input split they came from (both repeatable when a task is retried).
    """
    if chunk_rows <= 0:
        raise ValueError("chunk size must be positive")
    out = df
    if key:
        spread = F.xxhash64(*[F.col(c) for c in tiebreak]) if tiebreak else F.lit(0).cast("long")
        ranged = df.withColumns({"_hash": spread, "_split": F.spark_partition_id()})
        order = [F.col(key), F.col("_hash"), F.col("_split")]
        out = (ranged.repartitionByRange(partitions, *order) if partitions else ranged.repartitionByRange(*order)).drop(
            "_hash", "_split"
        )
    write_csv(out, path, null_encoding, compression, chunk_rows)


def chunk_folder(path: str, chunk_id: str) -> str:
    """Where :func:`export_planned` puts a chunk; it is the chunk's output URI."""
    return f"{path.rstrip('/')}/{CHUNK}={chunk_id}"


def export_planned(
    df: DataFrame,
    path: str,
    chunks: Mapping[str, str],
    null_encoding: str = "bitmap",
    compression: str = "none",
    rows_per_file: int = 0,
) -> None:
    """Write every planned chunk (id -> predicate) to its own folder, all in one pass over the table.

    Rows gather by chunk before the write; a chunk far above the usual size is split over several
    tasks at run time, so a hot key slows nothing down. A row outside every chunk fails the job.
    """
    for chunk_id, predicate in chunks.items():
        if "TODO" in predicate.upper():
            raise ValueError(f"predicate of chunk {chunk_id} is unresolved")
    place = F
    for chunk_id, predicate in chunks.items():
        place = place.when(F.expr(f"({predicate})"), F.lit(chunk_id))
    outside = F.raise_error(F.lit("a row belongs to no chunk of the plan"))
    tagged = df.withColumn(CHUNK, place.otherwise(outside)).hint("rebalance", CHUNK)
    write_csv(tagged, path, null_encoding, compression, rows_per_file, by=[CHUNK])
    _headers_of_empty(df, path, chunks, null_encoding, compression)


def _headers_of_empty(df: DataFrame, path: str, chunks: Iterable[str], null_encoding: str, compression: str) -> None:
    """A chunk without rows still has its header: one listing tells which, one job writes all of them."""
    missing = sorted(set(chunks) - {x.removeprefix(f"{CHUNK}=") for x in folder_names(df.sparkSession, path)})
    if not missing:
        return
    names = [*df.columns, BITMAP] if null_encoding == "bitmap" else df.columns
    line = ",".join('"' + n.replace('"', '""') + '"' if any(c in n for c in ',"\r\n') else n for n in names)
    rows = df.sparkSession.createDataFrame([(c, line) for c in missing], f"{CHUNK} string, value string")
    rows.write.mode("append").partitionBy(CHUNK).option("compression", check_compression(compression)).text(path)


def export_ranged(
    df: DataFrame,
    path: str,
    key: str,
    bounds: Sequence,
    chunk_ids: Sequence[str],
    null_encoding: str = "bitmap",
    compression: str = "none",
    rows_per_file: int = 0,
) -> None:
    """Write chunks that are ranges of ``key``, any number of them, in one pass over the table.

    Chunk ``i`` holds the keys from ``bounds[i - 1]`` (ascending) up to below ``bounds[i]``; rows without a
    key go to the first. A row finds its chunk by a binary search in one constant array, so the time
    hardly depends on the number of chunks.
    """
    if len(chunk_ids) != len(bounds) + 1 or any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("chunks need one id more than ascending bounds")
    ids = F.split(F.lit("\n".join(chunk_ids)), "\n")
    place = range_of(F.col("`" + key.replace("`", "``") + "`"), bounds, df.schema[key].dataType)
    tagged = df.withColumn(CHUNK, F.get(ids, place)).hint("rebalance", CHUNK)
    write_csv(tagged, path, null_encoding, compression, rows_per_file, by=[CHUNK])
    _headers_of_empty(df, path, chunk_ids, null_encoding, compression)


def require_empty(target: DataFrame) -> None:
    """Fail unless the target holds no row; stops at the first one found."""
    if not target.limit(1).isEmpty():
        raise RuntimeError("target table is not empty")


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the target in its order, cast to its types; a value that does not fit fails.

    Text for a binary column is the Base64 that the export wrote.
    """
    by_name = {c.lower(): c for c in df.columns}
    missing = [f.name for f in schema if f.name.lower() not in by_name]
    if missing:
        raise ValueError(f"columns missing from the load: {missing}")
    extra = set(by_name) - {f.name.lower() for f in schema}
    if extra:
        raise ValueError(f"columns unknown to the target: {sorted(extra)}")

    def value(field: T.StructField) -> Column:
        text = F.col(f"`{by_name[field.name.lower()]}`")
        from_text = isinstance(field.dataType, T.BinaryType) and isinstance(df.schema[by_name[field.name.lower()]].dataType, T.StringType)
        return (F.unbase64(text) if from_text else text.cast(field.dataType)).alias(field.name)

    return df.select(*[value(f) for f in schema])


def load_append(df: DataFrame, path: str, schema: T.StructType, only_if_empty: DataFrame | None = None) -> None:
    """Append typed rows to a table's files, optionally only when the table is still empty."""
    if only_if_empty is not None:
        require_empty(only_if_empty)
    typed(df, schema).write.mode("append").parquet(path)
