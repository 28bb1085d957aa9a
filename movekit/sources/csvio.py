"""CSV that keeps NULL and empty text apart.

``bitmap`` adds a last column with one ``0``/``1`` per value column (``1`` = NULL) and writes NULL
as empty text. ``backslash-n`` writes NULL as ``\\N``. ``none`` has no NULLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.functions.scalars import render
from movekit.sources.csvsplits import parse_records, split_records

BITMAP = "__null_bitmap"
NULL_TEXT = "\\N"
ENCODINGS = ("bitmap", "backslash-n", "none")
EXTENSIONS = {"none": "csv", "gzip": "csv.gz"}

_DIALECT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def check_compression(codec: str, bulk_import: bool = False) -> str:
    """``none`` or ``gzip``; the database's own bulk import reads plain files only."""
    codec = codec.strip().lower() or "none"
    if codec not in EXTENSIONS:
        raise ValueError(f"unsupported compression {codec!r}; one of {', '.join(EXTENSIONS)}")
    if bulk_import and codec != "none":
        raise ValueError(f"compression {codec} cannot be combined with bulk import")
    return codec


def check_header(columns: Sequence[str], bitmap: str = BITMAP) -> bool:
    """No empty name, no repeated name, the bitmap only in last place. Returns whether it is there."""
    seen: set[str] = set()
    for name in columns:
        lowered = name.strip().lower()
        if not lowered:
            raise ValueError("empty column name in header")
        if lowered in seen:
            raise ValueError(f"duplicate column {name} in header")
        seen.add(lowered)
    if bitmap.lower() in seen and columns[-1].strip() != bitmap:
        raise ValueError(f"column {bitmap} must be the last one")
    return bitmap.lower() in seen


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def render_csv_values(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every column as the text it has in the file; NULL stays NULL. ``keep`` columns pass through last."""
    values = [render(_q(f.name), f.dataType).alias(f.name) for f in df.schema if f.name not in keep]
    return df.select(*values, *[_q(c) for c in keep])


def encode_null_bitmap(df: DataFrame, bitmap: str = BITMAP, keep: Sequence[str] = ()) -> DataFrame:
    if bitmap.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"source column {bitmap} collides with the reserved name")
    bits = F.concat(*[F.when(_q(c).isNull(), "1").otherwise("0") for c in df.columns if c not in keep])
    text = render_csv_values(df.withColumn(bitmap, bits), keep)
    values = [F.coalesce(_q(c), F.lit("")).alias(c) for c in text.columns if c not in keep]
    return text.select(*values, *[_q(c) for c in keep])


def encode_backslash_n(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """NULL as ``\\N``. Text that cannot be told from NULL, or a row that would be blank, fails."""
    text = render_csv_values(df, keep)
    names = [c for c in text.columns if c not in keep]

    def cell(name: str) -> Column:
        value = F.when(_q(name) == NULL_TEXT, F.raise_error(F.lit(f"column {name} holds the NULL marker as text")))
        if len(names) == 1:
            value = value.when(_q(name) == "", F.raise_error(F.lit(f"column {name} would be a blank line")))
        return value.otherwise(F.coalesce(_q(name), F.lit(NULL_TEXT))).alias(name)

    return text.select(*[cell(c) for c in names], *[_q(c) for c in keep])


def encode(df: DataFrame, null_encoding: str = "bitmap", keep: Sequence[str] = ()) -> DataFrame:
    if null_encoding not in ENCODINGS:
        raise ValueError(f"unsupported NULL encoding {null_encoding!r}; one of {', '.join(ENCODINGS)}")
    if null_encoding == "bitmap":
        return encode_null_bitmap(df, keep=keep)
    if null_encoding == "backslash-n":
        return encode_backslash_n(df, keep)
    text = render_csv_values(df, keep)
    return text.na.fill("", [c for c in text.columns if c not in keep])


def write_csv(
    df: DataFrame,
    path: str,
    null_encoding: str = "bitmap",
    compression: str = "none",
    rows_per_file: int = 0,
    mode: str = "errorifexists",
    by: Sequence[str] = (),
) -> None:
    """Write encoded rows; nothing is visible until the job commits. ``by`` columns become folders."""
    codec = check_compression(compression)
    out = encode(df, null_encoding, by).write.options(**_DIALECT).options(nullValue="", emptyValue="", compression=codec)
    out = out.option("maxRecordsPerFile", rows_per_file).mode(mode)
    (out.partitionBy(*by) if by else out).csv(path)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names as written in the first file, repeated ones included."""
    options = {k: v for k, v in _DIALECT.items() if k != "header"}
    first = spark.read.options(**options).option("header", "false").option("multiLine", "true").csv(path).head(1)
    if not first:
        raise ValueError(f"no header in {path}")
    return [v or "" for v in first[0]]


def read_text(spark: SparkSession, path: str, columns: Sequence[str], multiline: bool = True, splits: bool = False) -> DataFrame:
    """All-text rows. Every file's header must equal ``columns``; a ragged row fails the read.

    ``multiline`` allows line breaks inside values, which makes each file one split: keep files
    at chunk size, or let ``splits`` find the records in splits of any file at the price of reading it twice.
    Column pruning is off so that even a bare count checks every row's width.
    """
    if splits and multiline:
        records = split_records(spark, path, len(columns))
        if records is not None:
            return parse_records(records, columns, {**_DIALECT, "header": "false", "nullValue": "", "emptyValue": ""})
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(schema)
        .options(**_DIALECT)
        .option("nullValue", "")  # no mark in the text: what NULL is, the decoders say
        .option("emptyValue", "")
        .option("mode", "FAILFAST")
        .option("enforceSchema", "false")
        .option("multiLine", str(multiline).lower())
        .option("columnPruning", "false")
        .csv(path)
    )


def decode_null_bitmap(df: DataFrame, bitmap: str = BITMAP) -> DataFrame:
    """Restore NULLs. A bitmap of the wrong length or with other characters fails the job."""
    names = [c for c in df.columns if c != bitmap]
    bits = F.when(_q(bitmap).rlike(f"^[01]{{{len(names)}}}$"), _q(bitmap)).otherwise(
        F.raise_error(F.concat(F.lit(f"bad NULL bitmap, want {len(names)} digits: "), F.coalesce(_q(bitmap), F.lit("NULL"))))
    )
    checked = df.withColumn(bitmap, bits)
    return checked.select(
        *[
            F.when(F.substring(_q(bitmap), i + 1, 1) == "0", F.coalesce(_q(c), F.lit(""))).alias(c)
            for i, c in enumerate(names)
        ]
    )


def split_bad_bitmaps(df: DataFrame, bitmap: str = BITMAP) -> tuple[DataFrame, DataFrame]:
    """Quarantine instead of failing: (decoded good rows, raw bad rows)."""
    good = F.coalesce(_q(bitmap).rlike(f"^[01]{{{len(df.columns) - 1}}}$"), F.lit(False))
    return decode_null_bitmap(df.where(good), bitmap), df.where(~good)


def decode_backslash_n(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~_q(c).eqNullSafe(NULL_TEXT), F.coalesce(_q(c), F.lit(""))).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, null_encoding: str = "bitmap", multiline: bool = True, splits: bool = False) -> DataFrame:
    """Decoded text rows of exported files, plain or gzip; ``splits`` reads one large file by many tasks."""
    header = read_header(spark, path)
    has_bitmap = check_header(header)
    raw = read_text(spark, path, header, multiline, splits)
    if has_bitmap:
        if null_encoding == "backslash-n":
            raise ValueError("files still carry the NULL bitmap column; export with backslash-n")
        return decode_null_bitmap(raw)
    if null_encoding == "backslash-n":
        return decode_backslash_n(raw)
    return raw.select(*[F.coalesce(_q(c), F.lit("")).alias(c) for c in raw.columns])


def project_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Columns by position; a field ``@name`` skips its position.

    Checks what the list may hold: no blanks, no repeated column or variable, variable names of
    letters, digits, ``_``, ``.`` and ``$``.
    """
    check_fields(fields)
    if len(fields) != len(df.columns):
        raise ValueError(f"{len(fields)} fields for {len(df.columns)} columns")
    picked = [(f.strip(), c) for f, c in zip(fields, df.columns, strict=True) if not f.strip().startswith("@")]
    return df.select(*[_q(c).alias(f) for f, c in picked])


def check_fields(fields: Sequence[str]) -> None:
    seen: set[str] = set()
    for raw in fields:
        field = raw.strip()
        if not field:
            raise ValueError("empty field")
        if field.startswith("@"):
            name = field[1:]
            if not name or not all(ch.isascii() and (ch.isalnum() or ch in "_.$") for ch in name):
                raise ValueError(f"invalid variable {field!r}")
        if field.lower() in seen:
            raise ValueError(f"duplicate field {field!r}")
        seen.add(field.lower())
