"""Log sequence numbers: ten bytes, written ``0x`` + 20 hex digits, ordered as unsigned bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LSN_BYTES = 10


def lsn_bytes(text: str, field: str = "lsn") -> bytes:
    """Value of an LSN text given on the driver; malformed text is an error."""
    digits = text.strip().removeprefix("0x").removeprefix("0X")
    try:
        value = bytes.fromhex(digits) if digits.isalnum() else b""
    except ValueError:
        value = b""
    if len(value) != LSN_BYTES:
        raise ValueError(f"{field} {text!r} must be a 10-byte hex value")
    return value


def _digits(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^(0x)?(0X)?", "")


def is_lsn(text: Column) -> Column:
    """True for well-formed text; false (never NULL) otherwise."""
    return F.coalesce(_digits(text).rlike(f"^[0-9A-Fa-f]{{{2 * LSN_BYTES}}}$"), F.lit(False))


def parse_lsn(text: Column) -> Column:
    """Binary value of an LSN text, NULL when it is malformed."""
    return F.when(is_lsn(text), F.unhex(_digits(text)))


def require_lsn(text: Column, field: str) -> Column:
    """Like :func:`parse_lsn`, but malformed text fails the job."""
    return F.when(is_lsn(text), F.unhex(_digits(text))).otherwise(
        F.raise_error(F.concat(F.lit(f"{field} must be a 10-byte hex value: "), F.coalesce(text, F.lit("NULL"))))
    )


def format_lsn(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def range_ok(from_lsn: Column, to_lsn: Column) -> Column:
    """Both texts are LSNs and ``from <= to``; Spark compares binary as unsigned bytes."""
    return is_lsn(from_lsn) & is_lsn(to_lsn) & F.coalesce(parse_lsn(from_lsn) <= parse_lsn(to_lsn), F.lit(False))


_LOW_DIGITS = 10
_LOW_SPAN = 16**_LOW_DIGITS


def lsn_number(value: Column) -> Column:
    """An LSN as an exact integer in the same order.

    Grouped min/max over binary needs a sort-based aggregate; over decimals it hashes.
    """
    digits = F.hex(value)
    high = F.conv(F.substring(digits, 1, _LOW_DIGITS), 16, 10).cast("decimal(13,0)")
    low = F.conv(F.substring(digits, _LOW_DIGITS + 1, _LOW_DIGITS), 16, 10).cast("decimal(13,0)")
    return (high * F.lit(_LOW_SPAN).cast("decimal(13,0)") + low).cast("decimal(25,0)")


def lsn_text_of_number(number: Column) -> Column:
    high = F.floor(number / F.lit(_LOW_SPAN).cast("decimal(13,0)")).cast("long")
    low = (number - high.cast("decimal(13,0)") * F.lit(_LOW_SPAN).cast("decimal(13,0)")).cast("long")
    part = lambda half: F.lpad(F.lower(F.hex(half)), _LOW_DIGITS, "0")
    return F.concat(F.lit("0x"), part(high), part(low))
