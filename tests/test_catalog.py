from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from movekit.operators import catalog as C
from movekit.operators import drift as D
from movekit.operators import findings as N
from movekit.operators import type_map as M
from movekit.plans import checks as K
from movekit.session import scratch

SCOPE = C.Scope("sales", ["dbo"], "shop")


def table(name, columns, rows=0, **more):
    fields = [{"name": c[0], "type": c[1], "computed": len(c) > 2} for c in columns]
    return {"name": name, "row_count": rows, "columns": fields, **more}


def read(spark, *tables, schema="dbo", status="discovered", routines=()):
    doc = {"status": status, "databases": [{"name": "sales", "schemas": [{"name": schema, "tables": list(tables), "routines": list(routines)}]}]}
    path = scratch(spark, "inv").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/inventory.json", "w") as f:
        json.dump(doc, f, indent=1)
    return C.read_inventory(spark, path)


ORDERS = [("id", "int"), ("customer_id", "bigint"), ("amount", "decimal(18,2)"), ("status", "nvarchar(32)"), ("updated_at", "datetime2")]
PK = {"name": "pk", "columns": ["id"], "unique": True, "primary_key": True}


def test_quickstart_inventory(spark):
    inv = read(spark, table("orders", ORDERS, 1000, indexes=[PK]))
    assert C.choose_keys(inv.indexes).head()["key_columns"] == ["id"]
    assert C.sample_column(inv.columns).head()["sample_column"] == "id"
    assert C.numeric_columns(inv.columns).head()["numeric_columns"] == ["id", "customer_id", "amount"]
    assert C.choose_columns(inv.columns).head()["columns"] == [c[0] for c in ORDERS]
    stats = C.inventory_stats(inv).head()
    assert (stats["databases"], stats["tables"], stats["columns"]) == (1, 1, 5)
    doc = C.table_documents(inv).head()
    assert [c["name"] for c in doc["columns"]] == [c[0] for c in ORDERS] and doc["row_count"] == 1000


def test_unknown_status_fails(spark):
    with pytest.raises(Exception, match="unsupported inventory status"):
        read(spark, table("t", [("a", "int")]), status="half").tables.collect()


def test_key_choice(spark):
    indexes = [
        {"name": "a", "columns": ["x"], "unique": True, "filtered": True},
        {"name": "b", "columns": [], "unique": True},
        {"name": "c", "columns": ["y", "z"], "unique": True},
        {"name": "d", "columns": ["w"], "unique": True},
    ]
    inv = read(spark, table("t", [("x", "int")], indexes=indexes))
    assert C.choose_keys(inv.indexes).head()["key_columns"] == ["y", "z"]
    with_pk = read(spark, table("t", [("x", "int")], indexes=[*indexes, {"name": "p", "columns": ["k"], "primary_key": True}]))
    assert C.choose_keys(with_pk.indexes).head()["key_columns"] == ["k"]


def test_findings(spark):
    columns = [("id", "int"), ("payload", "xml"), ("total", "decimal", True), ("rv", "rowversion")]
    index = {"name": "ix", "columns": ["id"], "filtered": True, "included_columns": ["total"]}
    inv = read(
        spark,
        table("orders", columns, indexes=[index], triggers=[{"name": "tr"}]),
        routines=[{"name": "proc", "type": "SQL_STORED_PROCEDURE"}],
    )
    found = N.findings(inv)
    summary = N.findings_summary(found).head()
    assert (summary["total"], summary["blockers"], summary["warnings"], summary["other"]) == (7, 4, 3, 0)
    assert "sales.dbo.proc" in {r["object"] for r in found.collect()}


def test_schema_diff(spark):
    columns = [("id", "int"), ("customer_name", "nvarchar"), ("computed_total", "decimal", True), ("payload", "xml"), ("rv", "rowversion")]
    inv = read(spark, table("orders", columns))
    mapped = M.map_types(C.project_scope(inv.columns, SCOPE))
    types = {r["name"]: r["target_type"] for r in mapped.collect()}
    assert types == {"id": "INT", "customer_name": "VARCHAR(255)", "computed_total": "DECIMAL", "payload": "TEXT", "rv": "VARBINARY(8)"}
    summary = M.schema_diff_summary(mapped).head()
    assert (summary["tables"], summary["columns"], summary["manual_items"]) == (1, 5, 3)
    diff = M.schema_diff(mapped).head()
    assert diff["manual_review"] and [c["name"] for c in diff["columns"]] == [c[0] for c in columns]


def test_computed_column_keeps_the_code_of_its_type(spark):
    inv = read(spark, table("t", [("x", "xml", True), ("y", "int", True), ("z", "tinyint")]))
    rows = {r["name"]: r for r in M.map_types(inv.columns).collect()}
    assert rows["x"]["code"] == "type_xml" and "expression" in rows["x"]["note"]
    assert rows["y"]["code"] == "computed_column" and rows["z"]["warning"] and rows["z"]["spark_type"] == "smallint"


def test_declared_sizes(spark):
    df = spark.createDataFrame(
        [("a", "decimal", 9, 18, 2), ("b", "nvarchar", 64, 0, 0), ("c", "varchar", -1, 0, 0), ("d", "varbinary", 16, 0, 0), ("e", "int", 4, 10, 0)],
        "name string, type string, max_length int, precision int, scale int",
    ).withColumn("computed", F.lit(False))
    types = {r["name"]: (r["target_type"], r["spark_type"]) for r in M.map_types(df, sized=True).collect()}
    assert types == {
        "a": ("DECIMAL(18,2)", "decimal(18,2)"),
        "b": ("VARCHAR(32)", "string"),
        "c": ("TEXT", "string"),
        "d": ("VARBINARY(16)", "binary"),
        "e": ("INT", "int"),
    }


def test_target_schema_and_conform(spark):
    inv = read(spark, table("orders", ORDERS))
    schema = M.target_schema(M.map_types(inv.columns))
    assert [f.dataType.simpleString() for f in schema] == ["int", "bigint", "decimal(18,2)", "string", "timestamp_ntz"]
    text = spark.createDataFrame(
        [("1", "2", "3.50", "ok", "2024-01-01T10:00:00.5Z"), ("x", None, "1e", "bad", None)],
        "id string, customer_id string, amount string, status string, updated_at string",
    )
    good, bad = M.conform(text, schema)
    assert good.count() == 1 and str(good.head()["updated_at"]) == "2024-01-01 10:00:00.500000"
    assert bad.head()["misfits"] == ["id", "amount"]
    stamps = spark.createDataFrame([("2024-01-01T00:00:00.1234567Z",), ("2024-01-01T00:00:00.1234560Z",)], "t string")
    assert M.truncated_fractions(stamps, ["t"]).head()["t"] == 1


def test_scope_names(spark):
    inv = read(spark, table("orders", ORDERS))
    row = C.project_scope(inv.tables, C.Scope("SALES", ["DBO"], "shop")).head()
    assert (row["source_object"], row["target_object"]) == ("sales.dbo.orders", "shop.orders")
    row = C.project_scope(inv.tables, C.Scope("sales", ["dbo", "audit"], "shop")).head()
    assert row["target_object"] == "shop.dbo_orders"
    assert C.project_scope(inv.tables, C.Scope("sales", ["audit"], "shop")).count() == 0
    with pytest.raises(ValueError):
        C.project_scope(inv.tables, C.Scope("sales", [], "shop"))


def today(inv):
    named = lambda df: df.withColumn("source_object", SCOPE.source_object())
    return D.table_columns(named(inv.tables).withColumn("in_scope", SCOPE.contains()), named(inv.columns))


def test_drift(spark):
    before = today(read(spark, table("orders", [("ID", "INT")]), table("gone", [("a", "int")])))
    after = today(read(spark, table("orders", [("id", "int"), ("order_total", "decimal")]), table("fresh", [("a", "int")])))
    issues = {(r["code"], r["source_object"], r["classification"]) for r in D.detect_drift(before, after).collect()}
    assert issues == {
        ("columns_changed", "sales.dbo.orders", "auto_repairable"),
        ("table_missing", "sales.dbo.gone", "manual_required"),
        ("table_added", "sales.dbo.fresh", "auto_repairable"),
    }
    assert D.drift_decision(D.detect_drift(before, after)).head()["needs_person"]
    assert D.detect_drift(before, after, "draft").count() == 0
    decision = D.drift_decision(D.detect_drift(after, after)).head()
    assert (decision["issues"], decision["drift_detected"], decision["repairable"]) == (0, False, False)


def test_check_plan(spark):
    inv = read(spark, table("orders", [("id", "int"), ("total", "decimal(18,2)"), ("customer_name", "nvarchar")]), table("notes", [("t", "text")]))
    scope = (
        C.project_scope(inv.tables, SCOPE)
        .join(C.numeric_columns(inv.columns), list(C.TABLE), "left")
        .join(C.sample_column(inv.columns), list(C.TABLE), "left")
    )
    ids = {r["check_id"] for r in K.plan_checks(scope).collect()}
    assert ids == {"dbo.orders.row-count", "dbo.orders.checksum", "dbo.orders.sampled-hash", "dbo.notes.row-count"}
    buckets = K.plan_checks(scope, bucketed=True, buckets=3).where("type = 'bucketed_count'").collect()
    assert [r["check_id"] for r in sorted(buckets)] == [f"dbo.orders.bucket-count.{b}" for b in range(3)]
    assert K.plan_checks(scope, bucketed=True, buckets=0).where("type = 'bucketed_count'").count() == 16
    with pytest.raises(ValueError, match="1024"):
        K.plan_checks(scope, bucketed=True, buckets=1025)
    line = K.check_type_line(K.plan_checks(scope)).head()["summary"]
    assert line == "2 row_count, 1 checksum, 1 sampled_hash"
    nothing = K.check_type_line(K.plan_checks(scope).where("false")).head()["summary"]
    assert nothing == "0 supported checks"


def test_planned_sql_runs(spark):
    from movekit.operators.reconcile import sql_check

    spark.createDataFrame([(1, 2), (200, None)], "id long, v long").createOrReplaceTempView("planned_side")
    scope = spark.createDataFrame(
        [("s", "t", "planned_side", "planned_side", ["id", "v"], "id")],
        "schema string, table string, source_object string, target_object string, numeric_columns array<string>, sample_column string",
    )
    for r in K.plan_checks(scope, bucketed=True, buckets=2).where("source_sql IS NOT NULL").collect():
        row = sql_check(spark, r["source_sql"], r["target_sql"]).head()
        assert row["matched"]
        if r["type"] == "checksum":
            assert row["source_value"] == "203.000000"


def test_sql_objects(spark):
    df = spark.createDataFrame([("select 1 From [a].[b].[c], x JOIN (d.e.f); join g.h from\n`i`.\"j\".k)",), (None,)], "source_sql string")
    assert [r["source_object"] for r in D.sql_objects(df).collect()] == ["a.b.c", "d.e.f", "i.j.k"]


def test_plan_drift(spark):
    inv = read(spark, table("orders", [("id", "int"), ("v", "int"), ("w", "int", True)], indexes=[PK]))
    named = lambda df: df.withColumn("source_object", SCOPE.source_object())
    captured, indexes = named(C.choose_columns(inv.columns)), named(inv.indexes)
    plan = spark.createDataFrame(
        [("sales.dbo.orders", ["ID", "v"], ["id"]), ("sales.dbo.orders", ["id"], ["v"]), ("sales.dbo.gone", ["id"], ["id"])],
        "source_object string, columns array<string>, key_columns array<string>",
    )
    rules = sorted((r["source_object"], r["rule"]) for r in D.check_tracked(plan, captured, indexes).collect())
    assert rules == [("sales.dbo.gone", "missing_from_catalog"), ("sales.dbo.orders", "columns_differ"), ("sales.dbo.orders", "key_differs")]
    jobs = spark.createDataFrame(
        [("a", "sales.dbo.orders", ["id", "@x", "V", "w"]), ("b", "sales.dbo.orders", ["id"]), ("c", "sales.dbo.orders", [])],
        "job_id string, source_object string, fields array<string>",
    )
    assert [r["job_id"] for r in D.check_fields(jobs, today(inv)).collect()] == ["b"]


CATALOG_QUERIES = (
    "catalog_columns compatibility_findings drift_decision inventory_documents inventory_documents_read_back plan_drift_fields "
    "plan_drift_tracked schema_drift type_map catalog_indexes findings_totals key_columns tracked_plan plan_drift_objects check_plan"
).split()


@pytest.mark.parametrize("name", CATALOG_QUERIES)
def test_no_table_of_tables_is_broadcast(name, spark, sf_dir):
    """Tables, columns and indexes grow with the catalog: none of them passes whole through the driver."""
    from __spark_entry__ import queries

    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = [plan[j] for j in range(i + 1, next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan)))]
            assert not [x for x in below if "p_partkey" in x or "inventory-" in x], below
