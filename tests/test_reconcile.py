from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from movekit.operators import reconcile as R


@pytest.fixture(scope="module")
def pair(spark):
    rows = [(i, i * 2, None if i % 5 == 0 else i) for i in range(-20, 200)] + [(None, 7, 7)]
    source = spark.createDataFrame(rows, "id long, a long, b long").cache()
    return source, source.where("id <> 17 OR id IS NULL")


def table(df):
    return {r["check"]: (r["source_value"], r["target_value"], r["matched"]) for r in df.collect()}


def test_fused_equals_single_checks(pair):
    source, target = pair
    spec = R.TableSpec(numeric=["a", "b"], key="id", modulo=17, buckets=8)
    fused = table(R.reconcile(source, target, spec))
    assert fused["row_count"] == ("221", "220", False)
    assert fused["checksum"] == table(R.checksum_check(source, target, ["a", "b"]))["checksum"]
    assert fused["sampled_hash"] == table(R.sampled_check(source, target, ["a", "b"], "id", 17))["sampled_hash"]
    for r in R.bucketed_check(source, target, "id", 8).collect():
        assert fused[f"bucketed_count.{r['bucket']}"] == (str(r["source_count"]), str(r["target_count"]), r["matched"])
    assert len(fused) == 3 + 8


def test_null_keys_count_but_are_in_no_bucket(pair):
    source, _ = pair
    buckets = R.bucketed_check(source, source, "id", 4).agg(F.sum("source_count")).head()[0]
    assert buckets == source.count() - 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, a long")
    got = table(R.reconcile(empty, empty, R.TableSpec(numeric=["a"], key="id", buckets=2)))
    assert got == {
        "row_count": ("0", "0", True),
        "checksum": ("0.000000", "0.000000", True),
        "sampled_hash": ("0.000000", "0.000000", True),
        "bucketed_count.0": ("0", "0", True),
        "bucketed_count.1": ("0", "0", True),
    }


def test_checks_follow_the_columns(pair):
    source, target = pair
    assert set(table(R.reconcile(source, target, R.TableSpec()))) == {"row_count"}
    assert set(table(R.reconcile(source, target, R.TableSpec(numeric=["a"])))) == {"row_count", "checksum"}
    with pytest.raises(ValueError):
        R.checksum_check(source, target, [])
    with pytest.raises(ValueError, match="1024"):
        R.bucketed_check(source, target, "id", 1025)


def test_predicates_differ_per_side(pair):
    source, target = pair
    spec = R.TableSpec(source_predicate="id >= 0", target_predicate="id > -1 OR id = 17")
    assert table(R.reconcile(source, target, spec))["row_count"] == ("200", "199", False)


def test_scalar_contract(spark):
    assert R.single_scalar(spark.sql("SELECT CAST(1.50 AS DECIMAL(9,2)) AS v")) == "1.50"
    assert R.single_scalar(spark.sql("SELECT CAST(NULL AS INT) AS v")) == "<NULL>"
    for sql, match in (("SELECT 1, 2", "one column"), ("SELECT 1 WHERE false", "no row"), ("SELECT explode(array(1,2))", "more than one")):
        with pytest.raises(ValueError, match=match):
            R.single_scalar(spark.sql(sql))
    same = table(R.sql_check(spark, "SELECT NULL", "SELECT NULL"))["business_sql"]
    assert same == ("<NULL>", "<NULL>", True)
    assert table(R.sql_check(spark, "SELECT 1.0", "SELECT 1.00"))["business_sql"][2] is False
    with pytest.raises(Exception, match="want 1"):
        R.sql_check(spark, "SELECT explode(array(1,2))", "SELECT 1").collect()


def test_a_failed_check_hides_nothing(pair):
    source, target = pair
    results = R.run_checks([R.row_count_check(source, target), R.row_count_check(source, source)])
    assert [r["status"] for r in results.collect()].count("failed") == 1
    outcome = R.checks_outcome(results).head()
    assert (outcome["checks"], outcome["failed"], outcome["status"]) == (2, 1, "failed")


def test_one_scan_per_side_and_no_cross_join(spark, sf_dir):
    from movekit.workload import reconciliation as W

    df = W.reconcile_fused(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "o_orderdate" not in plan  # only the compared columns are read
    assert "SortAggregate" not in plan


def test_exact_sum_equals_widening_every_value(spark):
    """Limbs and native decimals against the plain definition, with extreme and missing values."""
    big = 2**63 - 1
    rows = [(big, -5, "12345678.25", "0.12345675", None, 1.5), (-big - 1, 7, "-0.01", "0.0000005", "9.9", None), (None, None, None, None, None, 2.25)] * 3
    df = spark.createDataFrame(rows, "a long, b int, c string, d string, e string, f double").selectExpr(
        "a", "b", "cast(c as decimal(18,2)) c", "cast(d as decimal(18,8)) d", "cast(e as decimal(38,6)) e", "f"
    )
    columns = ["a", "b", "c", "d", "e", "f"]
    from movekit.functions.scalars import numeric_row_sum

    want = str(df.agg(F.sum(numeric_row_sum([F.col(c) for c in columns]))).head()[0])
    got = table(R.checksum_check(df, df, columns))["checksum"]
    assert got == (want, want, True)
    fused = table(R.reconcile(df, df.where("b > 0"), R.TableSpec(numeric=columns, key="b", modulo=7, buckets=4)))
    assert fused["checksum"][0] == want
    sampled = str(df.where("b % 7 = 0").agg(F.sum(numeric_row_sum([F.col(c) for c in columns]))).head()[0])
    assert fused["sampled_hash"][:2] == (sampled, sampled)
