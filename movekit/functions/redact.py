"""Removing credentials from text, URLs and argument lists before they are stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Replacement marker, words that make a key secret, and characters that end a URL.
MARKER = "<redacted>"
SECRET_WORDS = (
    "PASSWORD",
    "PASSWD",
    "PWD",
    "TOKEN",
    "SECRET",
    "PRIVATE[_-]?KEY",
    "ACCESS[_-]?KEY",
    "CLIENT[_-]?SECRET",
    "SAS",
    "SIGNATURE",
    "SIG",
)
SECRET_KEY_EXACT = ("pwd", "sig", "signature", "sas")
SECRET_KEY_PART = ("password", "passwd", "token", "secret", "private[-_]key", "access[-_]key")
SECRET_KEY_TAIL = ("[-_]sig", "[-_]signature")
URL_END = r"\s\"'`<>()\[\]{}"

_SECRET_KEY = "(?:" + "|".join(
    [*SECRET_KEY_EXACT]
    + [f"[^=&#?{URL_END}]*(?:" + "|".join(SECRET_KEY_PART) + f")[^=&#{URL_END}]*"]
    + [f"[^=&#?{URL_END}]*(?:" + "|".join(SECRET_KEY_TAIL) + ")"]
) + ")"
# The look-behind is an ASCII word boundary, so accented letters end a word.
_ASSIGNMENT = (
    r"(?i)(?<![A-Za-z0-9_])([A-Z0-9_]*(?:" + "|".join(SECRET_WORDS) + r")[A-Z0-9_-]*)"
    r"([\t\n\f\r ]*[:=][\t\n\f\r ]*)(\"[^\"]*\"|'[^']*'|[^\t\n\f\r ,;&|]+)"
)
_PLAIN_WORDS = ("PASSWORD", "PASSWD", "PWD", "TOKEN", "SECRET", "KEY", "SAS", "SIGNATURE", "SIG")
_BACKWARDS = r"(?i)[:=][\t\n\f\r ]*[A-Z0-9_-]*?(?:" + "|".join(w[::-1] for w in _PLAIN_WORDS) + ")"
_SCHEME = r"([A-Za-z][A-Za-z0-9+.-]*://)"
_LONE_USER = rf"{_SCHEME}[^/?#@:{URL_END}]+@"
_USER_SECRET = rf"{_SCHEME}([^/?#@:{URL_END}]*):[^/?#{URL_END}]*@"
_QUERY_SECRET = rf"(?i)([?&])({_SECRET_KEY})=[^&#{URL_END}]*"
_FLAG_NAME = "(?i)^(?:" + "|".join(
    [*SECRET_KEY_EXACT]
    + [".*(?:" + "|".join(SECRET_KEY_PART) + ").*"]
    + [".*(?:" + "|".join(SECRET_KEY_TAIL) + ")"]
) + ")$"


def redact_urls_expr(text: Column) -> Column:
    """User passwords (or lone users) and secret query values; parameter order is kept."""
    step = F.regexp_replace(text, _LONE_USER, f"$1{MARKER}@")
    step = F.regexp_replace(step, _USER_SECRET, f"$1$2:{MARKER}@")
    step = F.regexp_replace(step, _QUERY_SECRET, f"$1$2={MARKER}")
    return F.when(text.contains("://"), step).otherwise(text)


def _may_assign(text: Column) -> Column:
    """Whether any ``:`` or ``=`` has a secret word in the key before it.

    Looking backwards from the few separators is several times cheaper than trying every word
    as a key. It accepts a superset of what the replacement changes, so nothing is missed, and
    redacting URLs first never creates a new key.
    """
    return (text.contains("=") | text.contains(":")) & F.reverse(text).rlike(_BACKWARDS)


def redact_assignments_expr(text: Column) -> Column:
    """``key=value`` and ``key: value`` where the key names a secret."""
    return F.when(_may_assign(text), F.regexp_replace(text, _ASSIGNMENT, f"$1$2{MARKER}")).otherwise(text)


def redact_expr(text: Column) -> Column:
    urls = redact_urls_expr(text)
    return F.when(_may_assign(text), F.regexp_replace(urls, _ASSIGNMENT, f"$1$2{MARKER}")).otherwise(urls)


def redact_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: redact_expr(F.col(c)) for c in columns})


def redact_urls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: redact_urls_expr(F.col(c)) for c in columns})


def _secret_flag(flag: Column) -> Column:
    return F.regexp_replace(F.trim(flag), "^-+", "").rlike(_FLAG_NAME)


def redact_args(args: Column) -> Column:
    """Argument list with the values of secret flags replaced, in ``--f v``, ``--f=v`` and ``-f v`` form.

    Each element is redacted and classified once; the fold then carries whether the next element
    is the value of a secret flag, so a value that itself looks like a flag hides no third element.
    """

    def classify(arg: Column) -> Column:
        name = F.substring_index(arg, "=", 1)
        inline = arg.startswith("--") & arg.contains("=")
        secret = F.when(arg.startswith("--"), _secret_flag(name)).when(arg.startswith("-"), _secret_flag(arg)).otherwise(False)
        return F.struct(arg.alias("arg"), name.alias("name"), inline.alias("inline"), secret.alias("secret"))

    def shown(state: Column, a: Column) -> Column:
        own = F.when(a["inline"] & a["secret"], F.concat(a["name"], F.lit("=" + MARKER))).otherwise(a["arg"])
        hide = ~state["hide"] & a["secret"] & ~a["inline"]
        text = F.when(state["hide"], F.lit(MARKER)).otherwise(own)
        return F.struct(F.concat(state["out"], F.array(text)).alias("out"), hide.alias("hide"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))
    parts = F.transform(F.transform(args, redact_expr), classify)
    return F.when(args.isNotNull(), F.aggregate(parts, start, shown, lambda s: s["out"]))
