from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.functions import lsn as L
from movekit.functions import redact as R
from movekit.functions import scalars as S
from movekit.functions.metrics import extract_metrics


def one(spark, value, expr, kind="string"):
    schema = T.StructType([T.StructField("x", T.DataType.fromDDL(kind))])
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).head()["y"]


def many(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expr(F.col("x")).alias("y"))
    return [r["y"] for r in df.orderBy("i").collect()]


def test_lsn_parse_format_and_order(spark):
    texts = ["0x" + "0" * 19 + "1", "0X" + "F" * 20, "ab" * 10, "0x12", "zz" * 10, None, " 0x" + "0a" * 10 + " "]
    shown = many(spark, texts, lambda c: L.format_lsn(L.parse_lsn(c)))
    assert shown == ["0x" + "0" * 19 + "1", "0x" + "f" * 20, "0x" + "ab" * 10, None, None, None, "0x" + "0a" * 10]
    low, high = "0x7f" + "0" * 18, "0x80" + "0" * 18
    assert one(spark, low, lambda c: L.range_ok(c, F.lit(high))) is True
    assert one(spark, high, lambda c: L.range_ok(c, F.lit(low))) is False
    numbers = many(spark, ["0x" + "f" * 20, "0x" + "0" * 20], lambda c: L.lsn_number(L.parse_lsn(c)))
    assert [int(n) for n in numbers] == [2**80 - 1, 0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**80 - 1), min_size=1, max_size=30))
def test_lsn_number_round_trip(spark, values):
    texts = [f"0x{v:020x}" for v in values]
    assert [int(n) for n in many(spark, texts, lambda c: L.lsn_number(L.parse_lsn(c)))] == values
    assert many(spark, texts, lambda c: L.lsn_text_of_number(L.lsn_number(L.parse_lsn(c)))) == texts


def test_malformed_lsn_fails_when_required(spark):
    with pytest.raises(Exception, match="10-byte hex"):
        one(spark, "0x12", lambda c: L.require_lsn(c, "from_lsn"))


def test_sample_follows_the_dividend_and_skips_null(spark):
    assert many(spark, [-6, -7, 0, 9, None], lambda c: S.sample_pred(c, 3), "long") == [True, False, True, True, None]
    assert many(spark, [-5, 21, None], lambda c: S.bucket_id(c, 16), "long") == [5, 5, None]


def test_smallest_long_has_no_bucket(spark):
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        one(spark, -(2**63), lambda c: S.bucket_id(c, 16), "long")


DOUBLES = {
    1.0: "1",
    0.1: "0.1",
    -2.5: "-2.5",
    1e7: "10000000",
    123456789.125: "123456789.125",
    1e20: "100000000000000000000",
    1e21: "1e+21",
    1.5e300: "1.5e+300",
    0.0001: "0.0001",
    0.000123: "0.000123",
    1e-5: "1e-05",
    -3.25e-7: "-3.25e-07",
    math.inf: "+Inf",
    -math.inf: "-Inf",
    0.0: "0",
}


def test_double_text(spark):
    assert many(spark, list(DOUBLES), S.render_double, "double") == [DOUBLES[k] for k in DOUBLES]


def test_timestamp_text(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-02 03:04:05'), (2, TIMESTAMP_NTZ '2024-01-02 03:04:05.120'),
        (3, TIMESTAMP_NTZ '2024-01-02 03:04:50.000001'), (4, CAST(NULL AS TIMESTAMP_NTZ)) AS t(i, x)"""
    )
    got = [r[0] for r in df.orderBy("i").select(S.normalize_scalar(F.col("x"), df.schema["x"].dataType)).collect()]
    assert got == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.12Z", "2024-01-02T03:04:50.000001Z", "<NULL>"]


def test_instants_are_shown_in_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT TIMESTAMP '2024-03-10T07:30:00.25Z' AS t, TIMESTAMP_NTZ '2024-03-10 02:30:00' AS n, TIMESTAMP '1969-12-31T23:59:59.5Z' AS o")
        got = tuple(df.select(*[S.render(F.col(f.name), f.dataType) for f in df.schema]).head())
        assert got == ("2024-03-10T07:30:00.25Z", "2024-03-10T02:30:00Z", "1969-12-31T23:59:59.5Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_compact(spark):
    long = "word " * 80
    assert many(spark, ["", None, " a\n\tb ", "x" * 160, "x" * 161], lambda c: S.compact(c, 160)) == ["", "", "a b", "x" * 160, "x" * 157 + "..."]
    assert one(spark, "  \n ", lambda c: S.compact(c, 240, "(empty)")) == "(empty)"
    assert one(spark, long, lambda c: S.compact(c, 240)) == long.strip()[:237] + "..."


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab \t\n\x0b\x85\xa0 é"), max_size=40), min_size=1, max_size=20))
def test_compact_equals_split_and_join(spark, texts):
    want = [" ".join(t.split()) for t in texts]
    want = [w if len(w) <= 12 else w[:9] + "..." for w in want]
    assert many(spark, texts, lambda c: S.compact(c, 12)) == want


def test_redaction_hides_secrets_and_keeps_digests(spark):
    digest = "sha256:" + "a" * 64
    text = (
        f"password=hunter2, token: abc AWS_SECRET_ACCESS_KEY='x y' digest {digest} "
        "mysql://root:pw@host/db https://h/p?sig=s1&x=1&Access-Token=t2#f client-secret = \"q r\"; (http://lone@h/)"
    )
    shown = one(spark, text, R.redact_expr)
    for secret in ("hunter2", "abc", "x y", ":pw@", "s1", "t2", "q r", "lone"):
        assert secret not in shown, (secret, shown)
    assert digest in shown and "mysql://root:<redacted>@host/db" in shown and "x=1" in shown
    assert one(spark, "", R.redact_expr) == "" and one(spark, None, R.redact_expr) is None


def test_accented_letter_ends_a_word(spark):
    assert one(spark, "épassword=abc", R.redact_expr) == "épassword=<redacted>"


WORDS = st.sampled_from(["password", "tok", "token", "=", ":", " ", "x", "é", "-", "_", "sig", "key", "access", "\n", "'", '"', ",", "://", "@", "?", "&"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(WORDS, max_size=14).map("".join), min_size=1, max_size=30))
def test_backward_test_never_misses(spark, texts):
    """The cheap test in front of the replacement must not change any result."""
    direct = many(spark, texts, lambda c: F.regexp_replace(R.redact_urls_expr(c), R._ASSIGNMENT, f"$1$2{R.MARKER}"))
    assert many(spark, texts, R.redact_expr) == direct


def test_redact_args(spark):
    cases = [
        (["run", "--password", "x", "--token=y", "-sig", "z", "end"], ["run", "--password", "<redacted>", "--token=<redacted>", "-sig", "<redacted>", "end"]),
        (["--secret", "--token", "shown"], ["--secret", "<redacted>", "shown"]),
        (["--url", "http://u:p@h/?sig=1", "--plain=1"], ["--url", "http://u:<redacted>@h/?sig=<redacted>", "--plain=1"]),
        (["--password"], ["--password"]),
        ([], []),
        (None, None),
    ]
    got = many(spark, [c[0] for c in cases], R.redact_args, "array<string>")
    assert got == [c[1] for c in cases]


def test_metrics(spark):
    sha = "sha256:" + "0f" * 32
    rows = [
        ("export", f"exported rows: 5\noutput bytes: 70\noutput sha256: {sha}\n", None, 5, 70, sha, None),
        ("import", "imported rows: 5", "rows_and_bytes_must_come_together", None, None, None, None),
        ("export", "exported rows: -5\noutput bytes: 1", "rows_not_a_count", None, None, None, None),
        ("cdc", "done\n applied changes: 12", None, None, None, None, 12),
        ("cdc", "done", "changes_missing", None, None, None, None),
        ("validation", "exported rows: x", None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, stage string, output string")
    got = extract_metrics(df).orderBy("i").collect()
    for r, want in zip(got, rows, strict=True):
        assert (r["metrics_error"], r["data_rows"], r["data_bytes"], r["data_sha256"], r["applied_changes"]) == want[2:]


def test_names(spark):
    names = ["dbo.t", "db.dbo.t", "t", "a..b", "a.b.c.d", "", None, " dbo . t "]
    assert many(spark, names, S.source_name_ok) == [True, True, False, False, False, False, False, True]
    assert many(spark, names, S.target_name_ok) == [True, False, True, False, False, False, False, True]
    assert many(spark, ["a b/c", "  ", "x.y-z"], S.safe_name) == ["a_b_c", "object", "x.y-z"]


def test_rfc3339_and_digests(spark):
    stamps = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5+02:00", "2024-01-01", "2024-02-30T00:00:00Z", "soon", None]
    assert [v is not None for v in many(spark, stamps, S.rfc3339)] == [True, True, False, False, False, False]
    assert many(spark, ["sha256:" + "a" * 64, "sha256:xy", None], S.is_digest) == [True, False, False]


def test_engine_names(spark):
    names = [None, "\t", "X-Import-Into", "lightning", "magic", "y-lightning"]
    assert many(spark, names, lambda c: S.engine_name(c, "x")) == ["sql-insert", "sql-insert", "import-into", "lightning", "magic", "y-lightning"]
    assert many(spark, ["x-lightning"], S.engine_name) == ["x-lightning"]


def test_white_space_of_any_kind_is_blank(spark):
    assert many(spark, ["\n", "\u00a0\t\u2003", "", None, "\u200b", "a\n"], S.blank) == [True, True, True, True, False, False]
