"""Scalar expressions shared by checks, plans and logs. All are built-in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = T.DecimalType(38, 6)

# The white space that separates words in command output.
SPACES = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sample_pred(key: Column, modulo: int) -> Column:
    """Keys divisible by ``modulo``; NULL keys are not sampled, the sign follows the dividend."""
    return key.cast("long") % F.lit(modulo) == 0


def bucket_id(key: Column, buckets: int) -> Column:
    """``abs(key) % buckets``; a NULL key belongs to no bucket."""
    return F.abs(key.cast("long")) % F.lit(buckets)


def numeric_row_sum(columns: Sequence[Column]) -> Column:
    """Sum of one row's exact numbers, each widened to DECIMAL(38,6) and NULL read as 0."""
    return reduce(add, [F.coalesce(c.cast(EXACT), F.lit(0).cast(EXACT)) for c in columns]).cast(EXACT)


def render_double(value: Column) -> Column:
    """Shortest text of a double: plain digits for exponents -4..20, ``d.de±XX`` beyond."""
    text = value.cast("double").cast("string")
    size = F.abs(value.cast("double"))
    plain = F.regexp_replace(text, r"\.0$", "")
    large = F.regexp_replace(text.try_cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    small = F.regexp_replace(text.try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E-?(\d+)$", 1)
    power = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    scientific = F.concat(mantissa, F.lit("e"), F.when(text.contains("E-"), "-").otherwise("+"), power)
    return (
        F.when(value.isNull(), None)
        .when(F.isnan(value.cast("double")), "NaN")
        .when(text == "Infinity", "+Inf")
        .when(text == "-Infinity", "-Inf")
        .when(~text.contains("E"), plain)
        .when((size >= 1e7) & (size < 1e21), large)
        .when((size >= 1e-4) & (size < 1), small)
        .otherwise(scientific)
    )


def render_timestamp(value: Column, instant: bool = False) -> Column:
    """RFC 3339 text in UTC without trailing zeros in the fraction, whatever the session time zone.

    ``instant`` marks a value that is a point in time; others are wall-clock values shown as they are.
    """
    clock = value.cast("timestamp_ntz")
    if instant:
        clock = F.timestamp_add("MICROSECOND", F.unix_micros(value), F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.concat(F.translate(clock.cast("string"), " ", "T"), F.lit("Z"))


def render(value: Column, dtype: T.DataType) -> Column:
    """Text of one value as it travels in CSV or in a scalar comparison; NULL stays NULL.

    Bytes travel as Base64, as they need not be text in any character set.
    """
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return render_timestamp(value, isinstance(dtype, T.TimestampType))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return render_double(value)
    return value.cast("string")


def normalize_scalar(value: Column, dtype: T.DataType) -> Column:
    """Text used to compare one query result with another; NULL compares equal to NULL."""
    return F.coalesce(render(value, dtype), F.lit("<NULL>"))


def type_base(text: Column) -> Column:
    """``nvarchar(32)`` -> ``nvarchar``."""
    return F.regexp_extract(F.lower(F.trim(text)), r"^([^( \t]*)", 1)


def type_param(text: Column) -> Column:
    """Text between the first ``(`` and the last ``)``, empty when there is none."""
    return F.trim(F.regexp_extract(text, r"^[^(]*\((.*)\)", 1))


def has_todo(text: Column) -> Column:
    """An unresolved marker left in a predicate or statement."""
    return F.coalesce(F.upper(text).contains("TODO"), F.lit(False))


# The characters of Unicode's White_Space property.
WHITE_SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def compact(text: Column, limit: int, empty: str = "") -> Column:
    """One line of at most ``limit`` characters, cut with ``...``.

    A chain in which every step reads the one before once; the first step leaves single blanks
    alone, so that most of a text is copied as it is.
    """
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U) \s+|[^\S ]\s*", " "))
    cut = F.regexp_replace(line, rf"(?s)^(.{{{limit - 3}}}).{{4,}}\z", "$1...")
    return F.regexp_replace(cut, "^$", empty) if empty else cut


def _name_ok(name: Column, sizes: Sequence[int]) -> Column:
    parts = F.split(strip(F.coalesce(name, F.lit(""))), r"\.")
    return F.size(parts).isin(*sizes) & F.forall(parts, lambda part: strip(part) != "")


def source_name_ok(name: Column) -> Column:
    """``schema.table`` or ``database.schema.table``, no empty part."""
    return _name_ok(name, (2, 3))


def target_name_ok(name: Column) -> Column:
    """``table`` or ``database.table``, no empty part."""
    return _name_ok(name, (1, 2))


def safe_name(name: Column) -> Column:
    """A name usable in ids and file names."""
    trimmed = strip(name)
    return F.when(trimmed == "", F.lit("object")).otherwise(F.regexp_replace(trimmed, "[^A-Za-z0-9_.-]+", "_"))


def is_digest(text: Column) -> Column:
    """``sha256:`` followed by 64 hex digits."""
    return F.coalesce(strip(text).rlike("^sha256:[0-9A-Fa-f]{64}$"), F.lit(False))


def rfc3339(text: Column) -> Column:
    """Instant of an RFC 3339 text with optional fraction, NULL when malformed."""
    value = strip(text)
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(value.rlike(shape), value.try_cast("timestamp"))


# The import engines. The last two are also known with their vendor's name in front.
ENGINES = ("sql-insert", "import-into", "lightning")


def engine_name(text: Column, vendor: str = "") -> Column:
    """Import engine in its short form: lower case, default ``sql-insert``, this vendor's prefix dropped.

    A name with any other prefix stays as it is, and so is none of ``ENGINES``.
    """
    name = F.lower(strip(F.coalesce(text, F.lit(""))))
    for engine in ENGINES[1:] if vendor else ():
        name = F.when(name == f"{vendor}-{engine}", F.lit(engine)).otherwise(name)
    return F.when(name == "", F.lit(ENGINES[0])).otherwise(name)
