from __future__ import annotations

import glob
import gzip
import hashlib
import os
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.operators import audit as A
from movekit.operators import export as X
from movekit.plans import chunks as K
from movekit.session import scratch
from movekit.sources import csvio as V
from movekit.sources import scan as S


def local(path):
    return path.removeprefix("file:")


def lines_of(path):
    out = []
    for name in sorted(glob.glob(f"{local(path)}/*.csv*")):
        opener = gzip.open if name.endswith(".gz") else open
        with opener(name, "rt", newline="") as f:
            out.append(f.read())
    return out


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(1, "Ada", True), (2, None, False)], "id long, name string, active boolean").coalesce(1)


def test_bitmap_text(spark, tiny):
    path = scratch(spark, "t")
    V.write_csv(tiny, path)
    assert lines_of(path) == ["id,name,active,__null_bitmap\n1,Ada,true,000\n2,,false,010\n"]


def test_backslash_n_text(spark, tiny):
    path = scratch(spark, "t")
    V.write_csv(tiny, path, "backslash-n")
    assert lines_of(path) == ["id,name,active\n1,Ada,true\n2,\\N,false\n"]


HOSTILE = ["", None, " ", "a,b", '"', '""', 'say "hi"', "line\nbreak", "cr\rlf\r\n", "\\", "\\\\N", "tail\\", "\t", "é漢", " lead", "trail ", "''", "null", "#x", "0", "\u0001", "\u0002x", "\u001f", "a\u0000b", "\u007f"]


@pytest.mark.parametrize("encoding", ["bitmap", "backslash-n"])
@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_hostile_values_round_trip(spark, encoding, codec):
    df = spark.createDataFrame([(i, v, HOSTILE[-1 - i]) for i, v in enumerate(HOSTILE)], "i int, a string, b string")
    path = scratch(spark, "t")
    V.write_csv(df, path, encoding, codec)
    back = V.read_csv(spark, path, encoding)
    assert {r["i"]: (r["a"], r["b"]) for r in back.collect()} == {
        str(i): (v, HOSTILE[-1 - i]) for i, v in enumerate(HOSTILE)
    }


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=12)), min_size=1, max_size=40))
def test_decode_undoes_encode(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    path = scratch(spark, "t")
    V.write_csv(df, path)
    assert [r["v"] for r in V.read_csv(spark, path).orderBy(F.col("i").cast("int")).collect()] == values


def write(spark, text, name="part.csv"):
    path = local(scratch(spark, "raw"))
    os.makedirs(path)
    with open(f"{path}/{name}", "w", newline="") as f:
        f.write(text)
    return path


def test_reads_foreign_bitmap_file(spark):
    path = write(spark, "id,name,__null_bitmap\n1,Ada,00\n2,,01\n3,,00\n")
    assert [tuple(r) for r in V.read_csv(spark, path).collect()] == [("1", "Ada"), ("2", None), ("3", "")]


def test_bad_bitmaps(spark):
    path = write(spark, "id,name,__null_bitmap\n1,Ada,0\n")
    with pytest.raises(Exception, match="bad NULL bitmap"):
        V.read_csv(spark, path).collect()
    raw = spark.createDataFrame([("1", "a", "00"), ("2", "b", "0x"), ("3", "c", None)], "id string, name string, __null_bitmap string")
    good, bad = V.split_bad_bitmaps(raw)
    assert (good.count(), bad.count()) == (1, 2)


def test_header_rules(spark):
    with pytest.raises(ValueError, match="duplicate"):
        V.read_csv(spark, write(spark, "id,name,ID\n1,2,3\n"))
    with pytest.raises(ValueError, match="empty column"):
        V.read_csv(spark, write(spark, "id,,x\n1,2,3\n"))
    with pytest.raises(ValueError, match="last"):
        V.check_header(["__null_bitmap", "id"])
    with pytest.raises(ValueError, match="collides"):
        V.encode_null_bitmap(spark.sql("SELECT 1 AS __NULL_bitmap"))


def test_every_header_and_every_row_is_checked(spark):
    path = write(spark, "id,name\n1,a\n")
    with open(f"{path}/second.csv", "w") as f:
        f.write("id,other\n2,b\n")
    with pytest.raises(Exception):
        V.read_csv(spark, path, "none").collect()
    ragged = write(spark, "id,name\n1,a\n2,b,c\n")
    with pytest.raises(Exception):
        V.read_csv(spark, ragged, "none").collect()
    with pytest.raises(Exception):
        V.read_text(spark, ragged, ["id", "name"]).count()


def test_ambiguous_text_is_rejected(spark):
    with pytest.raises(Exception, match="NULL marker"):
        V.encode_backslash_n(spark.sql("SELECT '\\\\N' AS a, 1 AS b")).collect()
    with pytest.raises(Exception, match="blank line"):
        V.encode_backslash_n(spark.sql("SELECT '' AS a")).collect()


def test_compression_rules():
    assert V.check_compression(" GZIP ") == "gzip" and V.check_compression("") == "none"
    with pytest.raises(ValueError):
        V.check_compression("zip")
    with pytest.raises(ValueError, match="bulk"):
        V.check_compression("gzip", bulk_import=True)


def test_values_as_text(spark):
    df = spark.sql("SELECT CAST('abc' AS BINARY) AS b, TIMESTAMP '2024-01-02 03:04:05.5' AS t, CAST(1.5 AS DOUBLE) AS d, CAST(2.50 AS DECIMAL(9,2)) AS m, DATE '2024-01-02' AS day")
    assert tuple(V.render_csv_values(df).head()) == ("YWJj", "2024-01-02T03:04:05.5Z", "1.5", "2.50", "2024-01-02T00:00:00Z")


def test_field_lists(spark):
    df = spark.createDataFrame([("1", "x", "y")], "a string, b string, c string")
    assert V.project_fields(df, ["id", "@skip", "name"]).collect()[0].asDict() == {"id": "1", "name": "y"}
    for fields, match in ((["id", "ID", "x"], "duplicate"), (["id", "@a b", "x"], "invalid"), (["id", "", "x"], "empty"), (["id"], "fields for")):
        with pytest.raises(ValueError, match=match):
            V.project_fields(df, fields)


def test_chunk_plan(spark):
    tables = spark.createDataFrame(
        [("dbo", "orders", "sales.dbo.orders", "shop.orders", 2_500_000), ("dbo", "none", "sales.dbo.none", "shop.none", 0)],
        "schema string, table string, source_object string, target_object string, row_count long",
    )
    chunks = K.plan_chunks(tables, "s3a://b/x/").orderBy("source_object", "chunk_no").collect()
    got = [(c["chunk_id"], c["estimated_rows"]) for c in chunks]
    assert got == [("dbo.none.000001", 0), ("dbo.orders.000001", 1_000_000), ("dbo.orders.000002", 1_000_000), ("dbo.orders.000003", 500_000)]
    assert chunks[0]["predicate"] == "1 = 1" and "TODO" in chunks[1]["predicate"]
    assert chunks[1]["output_uri"] == "s3a://b/x/dbo.orders.000001.csv"
    assert K.plan_jobs(K.plan_chunks(tables, "s3a://b/x")).count() == 4
    one = K.plan_chunks(tables, "s3a://b", compression="gzip", id_from_target=True).where("source_object like '%none'").head()
    assert one["output_uri"] == "s3a://b/shop.none.000001.csv.gz"
    with pytest.raises(ValueError):
        K.plan_chunks(tables, " ")
    with pytest.raises(ValueError):
        K.plan_chunks(tables, "x", 0)


@pytest.mark.parametrize("kind", ["long", "decimal(12,2)", "double", "date", "timestamp_ntz", "string"])
def test_split_covers_every_row_once(spark, kind):
    value = {"date": "date_add(DATE '2024-01-01', cast(id % 90 as int))", "timestamp_ntz": "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 90 as int))"}
    df = spark.range(2000).selectExpr("id", f"CASE WHEN id % 50 = 0 THEN NULL ELSE cast({value.get(kind, 'id % 90 - 45')} as {kind}) END AS k")
    predicates = K.split_predicates(df, "k", 7)
    assert [tuple(r) for r in K.chunk_coverage(df, predicates).collect()] == [(1, 2000)]


def test_hot_key_is_split(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 < 2 THEN 5 ELSE id END AS k")
    predicates = K.split_predicates(df, "k", 10, ["id"])
    assert [tuple(r) for r in K.chunk_coverage(df, predicates).collect()] == [(1, 3000)]
    assert max(df.where(F.expr(p)).count() for p in predicates) < 700


def test_export_spreads_hot_keys_and_copies(spark):
    rows = spark.range(0, 6000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "CASE WHEN id % 3 = 0 THEN 'same' ELSE cast(id as string) END AS v")
    path = scratch(spark, "x")
    X.export_chunks(rows, path, 1000, key="k", partitions=6, tiebreak=["v"])
    counts = [text.count("\n") - 1 for text in lines_of(path)]
    assert sum(counts) == 6000 and max(counts) <= 1000
    assert len(counts) >= 6


def test_planned_chunks_land_in_their_folders(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 10 END AS k")
    predicates = K.split_predicates(rows, "k", 4)
    predicates.append("k = 99")
    chunks = {f"s.t.{i:06d}": p for i, p in enumerate(predicates, 1)}
    path = scratch(spark, "x")
    X.export_planned(rows, path, chunks)
    total = 0
    for chunk_id, predicate in chunks.items():
        want = {str(r["id"]) for r in rows.where(F.expr(predicate)).collect()}
        got = [r["id"] for r in V.read_csv(spark, X.chunk_folder(path, chunk_id)).collect()]
        assert set(got) == want and len(got) == len(want)
        total += len(got)
    assert total == 1000
    with pytest.raises(Exception, match="no chunk"):
        X.export_planned(rows, scratch(spark, "x"), {"a": "k < 3"})
    with pytest.raises(ValueError, match="unresolved"):
        X.export_planned(rows, scratch(spark, "x"), {"a": "todo"})


def test_export_without_key_does_not_shuffle(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = V.encode(orders)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_audits_match_the_bytes(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    path = scratch(spark, "a")
    X.export_chunks(orders, path, 400, compression="gzip")
    found = {os.path.basename(r["uri"]): (r["rows"], r["bytes"], r["sha256"]) for r in A.audit_files(spark, path).collect()}
    for name in glob.glob(f"{local(path)}/*.csv.gz"):
        data = open(name, "rb").read()
        rows = gzip.decompress(data).count(b"\n") - 1
        assert found[os.path.basename(name)] == (rows, len(data), "sha256:" + hashlib.sha256(data).hexdigest())
    assert len(found) == len(glob.glob(f"{local(path)}/*.csv.gz"))


def test_empty_file_counts_zero(spark):
    path = write(spark, "id,name\n")
    assert A.audit_files(spark, path).head()["rows"] == 0


def test_manifest_digest(spark):
    rows = [("u2", 2, 20, "s2", 2), ("u1", 1, 10, "s1", 1)]
    df = spark.createDataFrame(rows, "uri string, rows long, bytes long, sha256 string, position long")
    want = "sha256:" + hashlib.sha256(b"u1\t1\t10\ts1\nu2\t2\t20\ts2\n").hexdigest()
    assert tuple(A.manifest_audit(df).head()) == (2, 3, 30, want)


def test_bitmap_files_are_kept_from_other_loaders(spark, tiny):
    path = scratch(spark, "t")
    V.write_csv(tiny, path)
    with pytest.raises(ValueError):
        A.reject_bitmap(spark, path)
    with pytest.raises(ValueError):
        V.read_csv(spark, path, "backslash-n")


def test_load(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.DecimalType(9, 2))])
    text = spark.createDataFrame([("1", "2.50"), ("2", None)], "ID string, v string")
    path = scratch(spark, "load")
    X.load_append(text, path, schema)
    table = spark.read.schema(schema).parquet(path)
    assert sorted(tuple(r) for r in table.collect()) == [(1, Decimal("2.50")), (2, None)]
    with pytest.raises(RuntimeError, match="not empty"):
        X.load_append(text, path, schema, only_if_empty=table)
    with pytest.raises(Exception):
        X.load_append(spark.createDataFrame([("x", "1")], "id string, v string"), scratch(spark, "bad"), schema)
    with pytest.raises(ValueError, match="missing"):
        X.typed(text.drop("v"), schema)
    with pytest.raises(ValueError, match="unknown"):
        X.typed(text.withColumn("w", F.lit(1)), schema)


def test_full_load_keeps_null(spark):
    source = spark.createDataFrame([(1, "alice"), (2, "bob"), (3, None)], "id int, customer_name string")
    path, loaded = scratch(spark, "csv"), scratch(spark, "table")
    X.export_chunks(source, path, 2)
    X.load_append(V.read_csv(spark, path), loaded, source.schema)
    assert sorted(map(tuple, spark.read.parquet(loaded).collect())) == [(1, "alice"), (2, "bob"), (3, None)]


def test_scan(spark, sf_dir):
    df = S.scan(spark, f"{sf_dir}/orders.parquet", "o_orderkey > 5").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,5)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan
    assert S.quoted(" db . s.t`x ") == "`db`.`s`.`t``x`"
    for bad in ("t", "a..b", "a.b.c.d"):
        with pytest.raises(ValueError):
            S.quoted(bad)


def test_documents_are_written_by_as_many_tasks_as_read_them(spark, tmp_path, monkeypatch):
    from movekit.workload import transfer

    rows = spark.range(60).selectExpr("id AS doc_id", "concat('a \"b\"\n', id) AS text", "'en' AS lang").repartition(3)
    rows.write.parquet(f"file://{tmp_path}/documents.parquet")
    seen, real = [], transfer.csvio.write_csv

    def noted(df, path, *a, **k):
        seen.append(df.rdd.getNumPartitions())
        return real(df, path, *a, **k)

    monkeypatch.setattr(transfer.csvio, "write_csv", noted)
    got = transfer.whole_text_in_splits(spark, f"file://{tmp_path}")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: f'a "b"\n{i}' for i in range(60)}
    assert seen[0] > 1
