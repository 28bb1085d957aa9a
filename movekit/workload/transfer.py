"""Scans, CSV with NULLs, chunk plans, exports, loads and audits on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movekit.operators import audit as A
from movekit.operators import export as X
from movekit.plans import chunks as K
from movekit.sources import csvio
from movekit.sources.scan import scan
from movekit.session import scratch
from movekit.workload import query, table


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_with_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, f"{sf_dir}/orders.parquet", "o_orderstatus = 'F' AND o_totalprice > 100000")
    return found.select("o_orderkey", "o_custkey", "o_orderstatus")


def holey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with NULLs, empty text and awkward values."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "view", None).when(kind == "error", "").when(kind == "click", ' "cl,ick"\n').otherwise(kind).alias("event_type"),
        F.when(F.col("user_id") % 3 == 0, None).otherwise(F.col("value").cast("decimal(18,2)")).alias("value"),
        F.when(F.col("user_id") % 4 == 0, None).otherwise(F.col("ts")).alias("ts"),
    )


HOLEY = """holey AS (SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN '' WHEN 'click' THEN ' "cl,ick"' || chr(10) ELSE event_type END AS event_type,
 CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS value, CASE WHEN user_id % 4 = 0 THEN NULL ELSE ts END AS ts FROM events),
txt AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(value AS VARCHAR) AS value,
 regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '\\.?0*Z$', 'Z') AS ts FROM holey)"""
BACK = f"WITH {HOLEY} SELECT * FROM txt"


@query(BACK)
def csv_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvio.render_csv_values(holey(spark, sf_dir))


@query(
    f"""WITH {HOLEY} SELECT event_id, COALESCE(event_type,'') AS event_type, COALESCE(value,'') AS value, COALESCE(ts,'') AS ts,
 '0' || CASE WHEN event_type IS NULL THEN '1' ELSE '0' END || CASE WHEN value IS NULL THEN '1' ELSE '0' END || CASE WHEN ts IS NULL THEN '1' ELSE '0' END AS __null_bitmap FROM txt"""
)
def null_bitmap_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvio.encode_null_bitmap(holey(spark, sf_dir))


def _round_trip(spark: SparkSession, sf_dir: str, encoding: str, codec: str) -> DataFrame:
    path = scratch(spark, "csv")
    csvio.write_csv(holey(spark, sf_dir), path, encoding, codec)
    return csvio.read_csv(spark, path, encoding)


@query(BACK)
def null_bitmap_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "bitmap", "none")


@query(BACK)
def null_bitmap_gzip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "bitmap", "gzip")


@query(BACK)
def backslash_n_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "backslash-n", "none")


@query(f"WITH {HOLEY} SELECT event_id, COALESCE(event_type,'') AS event_type, COALESCE(value,'') AS value, COALESCE(ts,'') AS ts FROM txt")
def plain_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "none", "gzip")


@query("SELECT doc_id, text, lang FROM documents")
def whole_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with their line breaks and quotes, through CSV and a typed load."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path, loaded = scratch(spark, "csv"), scratch(spark, "loaded")
    csvio.write_csv(docs, path)
    X.load_append(csvio.read_csv(spark, path), loaded, docs.schema)
    return spark.read.schema(docs.schema).parquet(loaded)


@query("SELECT doc_id, text, lang FROM documents")
def whole_text_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every file read by many tasks, wherever its splits fall."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path, loaded = scratch(spark, "csv"), scratch(spark, "loaded")
    csvio.write_csv(docs, path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(c) for c in names]
    try:
        for c in names:
            spark.conf.set(c, "262144")  # some splits at any scale
        X.load_append(csvio.read_csv(spark, path, splits=True), loaded, docs.schema)
    finally:
        for c, v in zip(names, before, strict=True):
            spark.conf.set(c, v)
    return spark.read.schema(docs.schema).parquet(loaded)


@query(f"WITH {HOLEY} SELECT event_id AS id, value AS amount FROM txt")
def field_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = csvio.render_csv_values(holey(spark, sf_dir))
    return csvio.project_fields(text, ["id", "@kind", "amount", "@at"])


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a table whose row count is what was ordered of it."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("row_count"))
    brand, key = F.col("p_brand"), F.col("p_partkey").cast("string")
    return (
        table(spark, sf_dir, "part")
        .join(counts, F.col("p_partkey") == F.col("l_partkey"), "left")
        .select(
            brand.alias("schema"),
            F.concat(F.lit("part "), key).alias("table"),
            F.concat(F.lit("shop."), brand, F.lit(".part "), key).alias("source_object"),
            F.concat(F.lit("target."), key).alias("target_object"),
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
        )
    )


CHUNKS = """WITH c AS (SELECT p_brand, p_partkey, CAST(COALESCE(SUM(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS row_count
 FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
n AS (SELECT *, CASE WHEN row_count > 0 THEN (row_count + 99) // 100 ELSE 1 END AS chunks FROM c),
x AS (SELECT *, unnest(range(1, chunks + 1)) AS chunk_no FROM n),
chunk AS (SELECT regexp_replace(p_brand || '.part ' || p_partkey, '[^A-Za-z0-9_.-]+', '_', 'g') || '.' || lpad(CAST(chunk_no AS VARCHAR), 6, '0') AS chunk_id,
 'shop.' || p_brand || '.part ' || p_partkey AS source_object, 'target.' || p_partkey AS target_object, chunk_no, chunks,
 CASE WHEN row_count > 0 THEN LEAST(row_count - (chunk_no - 1) * 100, 100) ELSE 0 END AS estimated_rows,
 CASE WHEN chunks = 1 THEN '1 = 1' ELSE 'TODO: split shop.' || p_brand || '.part ' || p_partkey || ' chunk ' || chunk_no END AS predicate FROM x),
plan AS (SELECT *, 's3a://bucket/full/' || chunk_id || '.csv.gz' AS output_uri FROM chunk)
"""


@query(CHUNKS + "SELECT * FROM plan")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.plan_chunks(_planned(spark, sf_dir), "s3a://bucket/full/", 100, "gzip")


@query(CHUNKS + "SELECT 'import-' || chunk_id AS job_id, target_object, output_uri AS source_uri, chunk_id AS depends_on FROM plan")
def import_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.plan_jobs(K.plan_chunks(_planned(spark, sf_dir), "s3a://bucket/full/", 100, "gzip"))


@query("SELECT CAST(1 AS INTEGER) AS hits, COUNT(*) AS n FROM orders")
def chunk_coverage_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return K.chunk_coverage(orders, K.split_predicates(orders, "o_orderkey", 8))


@query("SELECT CAST(1 AS INTEGER) AS hits, COUNT(*) AS n FROM lineitem")
def chunk_coverage_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows share one key value, some have none; the hot value is split by hash."""
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "k", F.when(F.col("l_orderkey") % 2 == 0, 7).when(F.col("l_orderkey") % 101 == 1, None).otherwise(F.col("l_suppkey"))
    )
    return K.chunk_coverage(lines, K.split_predicates(lines, "k", 8, ["l_orderkey", "l_linenumber"]))


@query("SELECT CAST(1 AS INTEGER) AS hits, COUNT(*) AS n FROM customer")
def chunk_coverage_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return K.chunk_coverage(rows, K.split_predicates(rows, "c_name", 8))


ORDERS_TEXT = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_price FROM orders"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)").alias("o_price")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", price)


@query(ORDERS_TEXT)
def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked export without a shuffle, read back and decoded."""
    path = scratch(spark, "export")
    X.export_chunks(_orders(spark, sf_dir), path, 5000)
    return csvio.read_csv(spark, path)


@query(ORDERS_TEXT)
def export_import_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "export")
    X.export_chunks(_orders(spark, sf_dir), path, 5000, key="o_custkey", partitions=8, tiebreak=["o_orderkey"])
    return csvio.read_csv(spark, path)


ALL_ORDERS_TEXT = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS o_orderdate, o_orderpriority FROM orders"""


def _all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


@query(ALL_ORDERS_TEXT)
def export_import_by_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks planned by predicates, written in one pass to a folder each and read back in one."""
    orders, path = _all_orders(spark, sf_dir), scratch(spark, "export")
    predicates = K.split_predicates(orders, "o_orderkey", 6)
    X.export_planned(orders, path, {f"dbo.orders.{i:06d}": p for i, p in enumerate(predicates, 1)})
    return csvio.read_csv(spark, X.chunk_folder(path, "*"))


@query(ALL_ORDERS_TEXT)
def export_import_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many range chunks, a quarter of them above all keys and so empty but for their header."""
    orders, path = _all_orders(spark, sf_dir), scratch(spark, "export")
    bounds = K.split_bounds(orders, "o_orderkey", 60)
    bounds += [bounds[-1] * 1000 + i for i in range(20)]
    X.export_ranged(orders, path, "o_orderkey", bounds, [f"dbo.orders.{i:06d}" for i in range(len(bounds) + 1)])
    return csvio.read_csv(spark, X.chunk_folder(path, "*"))


BYTES = "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN upper(sha256(text)) END AS digest FROM documents"


@query(BYTES)
def binary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no text, NULL among them, exported, read back and loaded into a binary column."""
    digest = F.when(F.col("doc_id") % 7 != 0, F.unhex(F.sha2("text", 256)))
    docs, path = table(spark, sf_dir, "documents").select("doc_id", digest.alias("digest")), scratch(spark, "bytes")
    X.export_chunks(docs, path, 5000)
    return X.typed(csvio.read_csv(spark, path), docs.schema).select("doc_id", F.hex("digest").alias("digest"))


ALL_TEXT = """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
 event_type || CASE WHEN user_id % 5 = 0 THEN chr(1) WHEN user_id % 5 = 1 THEN chr(31) || '"' ELSE '' END AS event_type,
 CASE WHEN user_id % 3 = 0 THEN chr(1) ELSE props END AS props FROM events"""


@query(ALL_TEXT)
def control_character_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event texts with control characters, a lone one among them, and JSON; nothing in a text means NULL."""
    user = F.col("user_id")
    tail = F.when(user % 5 == 0, "\u0001").when(user % 5 == 1, '\u001f"').otherwise("")
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.concat("event_type", tail).alias("event_type"), F.when(user % 3 == 0, "\u0001").otherwise(F.col("props")).alias("props")
    )
    path = scratch(spark, "control")
    X.export_chunks(events, path, 5000)
    return csvio.read_csv(spark, path)


@query("SELECT CAST(COUNT(*) AS BIGINT) AS loaded, true AS second_load_refused, true AS header_refused FROM orders")
def import_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load into an empty table only, and files whose header names a column twice."""
    orders, files, path = _orders(spark, sf_dir), scratch(spark, "export"), scratch(spark, "loaded")
    X.export_chunks(orders, files, 5000)
    rows = csvio.read_csv(spark, files)
    refused = []
    for target in (orders.limit(0), None):
        try:
            X.load_append(rows, path, orders.schema, only_if_empty=spark.read.parquet(path) if target is None else target)
            refused.append(False)
        except RuntimeError:
            refused.append(True)
    twice = scratch(spark, "twice")
    orders.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")).toDF("a", "b").write.option("header", "true").csv(twice)
    try:
        csvio.check_header([*csvio.read_header(spark, twice), "A"])
        wrong = False
    except ValueError:
        wrong = True
    loaded = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("loaded"))
    return loaded.withColumns({"second_load_refused": F.lit(refused == [False, True]), "header_refused": F.lit(wrong)})


@query(
    """SELECT CAST(COUNT(*) AS BIGINT) AS audited_rows, true AS bytes_known, true AS digests_match FROM orders"""
)
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per exported file add up to the table; every digest is that of the stored bytes, read on their own."""
    path = scratch(spark, "audit")
    X.export_chunks(_orders(spark, sf_dir), path, 5000, compression="gzip")
    stored = spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".gz"))
    again = stored.select(F.col("path").alias("stored"), F.sha2("content", 256).alias("digest"))
    audits = A.audit_files(spark, path)
    name = lambda c: F.substring_index(c, "/", -1)
    both = audits.join(again, name(audits["uri"]) == name(again["stored"]), "left")
    same = F.coalesce(F.col("digest") == F.substring_index("sha256", ":", -1), F.lit(False))
    return both.agg(F.sum("rows").alias("audited_rows"), F.bool_and(F.col("bytes") > 0).alias("bytes_known"), F.bool_and(same).alias("digests_match"))


@query(
    """WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS load_id, o_orderkey, 's3a://b/' || o_orderkey || '.csv' AS uri, CAST(o_orderkey % 1000 AS BIGINT) AS n, CAST(floor(o_totalprice) AS BIGINT) AS size,
 'sha256:' || sha256(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders)
SELECT load_id, CAST(COUNT(*) AS BIGINT) AS files, CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(size) AS BIGINT) AS bytes,
 'sha256:' || sha256(string_agg(uri || chr(9) || n || chr(9) || size || chr(9) || sha || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM f GROUP BY load_id"""
)
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a file of its customer's load."""
    key = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("load_id"),
        key.alias("position"),
        F.concat(F.lit("s3a://b/"), key.cast("string"), F.lit(".csv")).alias("uri"),
        (key % 1000).alias("rows"),
        F.floor("o_totalprice").cast("long").alias("bytes"),
        F.concat(F.lit("sha256:"), F.sha2(key.cast("string"), 256)).alias("sha256"),
    )
    return A.manifest_audit(files, ["load_id"])
