"""Row counts, sums, samples, buckets and business statements: orders against a damaged copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movekit.functions.scalars import bucket_id, normalize_scalar, numeric_row_sum, sample_pred
from movekit.operators import changes as C
from movekit.operators import reconcile as R
from movekit.operators.differences import differing_keys
from movekit.session import stage
from movekit.workload import query, table

NUMERIC = ["o_orderkey", "o_custkey", "o_price"]

# The copy lost some orders and has a shifted customer key in others.
SIDES = """
WITH s AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_price, o_orderstatus FROM orders),
t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 5 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
             o_price, o_orderstatus FROM s WHERE o_orderkey % 997 <> 3)
"""
SUM = """CAST(COALESCE(SUM(CAST(COALESCE(CAST(o_orderkey AS DECIMAL(38,6)),0) + COALESCE(CAST(o_custkey AS DECIMAL(38,6)),0)
 + COALESCE(CAST(o_price AS DECIMAL(38,6)),0) AS DECIMAL(38,6))),0) AS DECIMAL(38,6))"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_price"), "o_orderstatus"
    )
    shifted = F.when(F.col("o_orderkey") % 1009 == 5, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return source, source.where("o_orderkey % 997 <> 3").withColumn("o_custkey", shifted)


def _compare(check: str, source: str, target: str) -> str:
    return f"""SELECT '{check}' AS "check", s.v AS source_value, t.v AS target_value, s.v = t.v AS matched
FROM ({source}) s, ({target}) t"""


@query(SIDES + _compare("row_count", "SELECT CAST(COUNT(*) AS VARCHAR) AS v FROM s", "SELECT CAST(COUNT(*) AS VARCHAR) AS v FROM t"))
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_count_check(*sides(spark, sf_dir))


@query(
    SIDES
    + _compare(
        "row_count",
        "SELECT CAST(COUNT(*) AS VARCHAR) AS v FROM s WHERE o_orderstatus <> 'P'",
        "SELECT CAST(COUNT(*) AS VARCHAR) AS v FROM t WHERE o_orderstatus IN ('O','F')",
    )
)
def row_count_with_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_count_check(*sides(spark, sf_dir), "o_orderstatus <> 'P'", "o_orderstatus IN ('O','F')")


@query(SIDES + _compare("checksum", f"SELECT CAST({SUM} AS VARCHAR) AS v FROM s", f"SELECT CAST({SUM} AS VARCHAR) AS v FROM t"))
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.checksum_check(*sides(spark, sf_dir), NUMERIC)


@query(
    SIDES
    + _compare(
        "sampled_hash",
        f"SELECT CAST({SUM} AS VARCHAR) AS v FROM s WHERE o_orderkey % 100 = 0",
        f"SELECT CAST({SUM} AS VARCHAR) AS v FROM t WHERE o_orderkey % 100 = 0",
    )
)
def sampled_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sampled_check(*sides(spark, sf_dir), NUMERIC, "o_orderkey")


BUCKETS = """
, b AS (SELECT CAST(range AS BIGINT) AS bucket FROM range(16)),
sb AS (SELECT abs(o_orderkey) % 16 AS bucket, COUNT(*) AS n FROM s WHERE o_orderkey IS NOT NULL GROUP BY 1),
tb AS (SELECT abs(o_orderkey) % 16 AS bucket, COUNT(*) AS n FROM t WHERE o_orderkey IS NOT NULL GROUP BY 1)
"""


@query(
    SIDES
    + BUCKETS
    + """SELECT b.bucket, COALESCE(sb.n,0) AS source_count, COALESCE(tb.n,0) AS target_count,
 COALESCE(sb.n,0) = COALESCE(tb.n,0) AS matched FROM b LEFT JOIN sb USING (bucket) LEFT JOIN tb USING (bucket)"""
)
def bucketed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bucketed_check(*sides(spark, sf_dir), "o_orderkey")


FUSED = (
    SIDES
    + BUCKETS
    + ", lines AS ("
    + _compare("row_count", "SELECT CAST(COUNT(*) AS VARCHAR) AS v FROM s", "SELECT CAST(COUNT(*) AS VARCHAR) AS v FROM t")
    + " UNION ALL "
    + _compare("checksum", f"SELECT CAST({SUM} AS VARCHAR) AS v FROM s", f"SELECT CAST({SUM} AS VARCHAR) AS v FROM t")
    + " UNION ALL "
    + _compare(
        "sampled_hash",
        f"SELECT CAST({SUM} AS VARCHAR) AS v FROM s WHERE o_orderkey % 100 = 0",
        f"SELECT CAST({SUM} AS VARCHAR) AS v FROM t WHERE o_orderkey % 100 = 0",
    )
    + """ UNION ALL SELECT 'bucketed_count.' || b.bucket, CAST(COALESCE(sb.n,0) AS VARCHAR), CAST(COALESCE(tb.n,0) AS VARCHAR),
 COALESCE(sb.n,0) = COALESCE(tb.n,0) FROM b LEFT JOIN sb USING (bucket) LEFT JOIN tb USING (bucket))
"""
)
SPEC = R.TableSpec(numeric=NUMERIC, key="o_orderkey")


@query(FUSED + "SELECT * FROM lines")
def reconcile_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reconcile(*sides(spark, sf_dir), SPEC)


@query(FUSED + ", same AS (SELECT \"check\", source_value, source_value AS target_value, true AS matched FROM lines) SELECT * FROM same")
def reconcile_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, _ = sides(spark, sf_dir)
    return R.reconcile(source, source, SPEC)


SKEWED = """
WITH s AS (SELECT l_suppkey, CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_orderkey % 1009 = 5 AS INTEGER) AS off FROM lineitem),
d AS (SELECT l_suppkey, CAST(qty AS DECIMAL(38,6)) + CAST(price AS DECIMAL(38,6)) AS a, CAST(qty AS DECIMAL(38,6)) + CAST(price AS DECIMAL(38,6)) + off AS b FROM s),
v AS (SELECT CAST(CAST(SUM(a) AS DECIMAL(38,6)) AS VARCHAR) AS a, CAST(CAST(SUM(b) AS DECIMAL(38,6)) AS VARCHAR) AS b,
 CAST(CAST(COALESCE(SUM(a) FILTER (WHERE l_suppkey % 7 = 0), 0) AS DECIMAL(38,6)) AS VARCHAR) AS sa,
 CAST(CAST(COALESCE(SUM(b) FILTER (WHERE l_suppkey % 7 = 0), 0) AS DECIMAL(38,6)) AS VARCHAR) AS sb, CAST(COUNT(*) AS VARCHAR) AS n FROM d)
SELECT 'row_count' AS "check", n AS source_value, n AS target_value, true AS matched FROM v
UNION ALL SELECT 'checksum', a, b, a = b FROM v
UNION ALL SELECT 'sampled_hash', sa, sb, sa = sb FROM v
"""


@query(SKEWED)
def reconcile_lineitem_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(price) -> DataFrame:  # noqa: ANN001
        return table(spark, sf_dir, "lineitem").select(
            "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("qty"), price.cast("decimal(18,2)").alias("price")
        )

    price = F.col("l_extendedprice").cast("decimal(18,2)")
    changed = price + F.when(F.col("l_orderkey") % 1009 == 5, 1).otherwise(0)
    spec = R.TableSpec(numeric=["qty", "price"], key="l_suppkey", modulo=7, checks=("row_count", "checksum", "sampled_hash"))
    return R.reconcile(side(price), side(changed), spec)


BUSINESS_SQL = """SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS v
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'"""
BUSINESS_SQL_SCALED = BUSINESS_SQL.replace("AS DECIMAL(38,2)) AS v", "AS DECIMAL(38,3)) AS v")


@query(
    f"""SELECT 'business_sql' AS "check", CAST(a.v AS VARCHAR) AS source_value, CAST(b.v AS VARCHAR) AS target_value,
 CAST(a.v AS VARCHAR) = CAST(b.v AS VARCHAR) AS matched FROM ({BUSINESS_SQL}) a, ({BUSINESS_SQL_SCALED}) b"""
)
def business_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("lineitem", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return R.sql_check(spark, BUSINESS_SQL, BUSINESS_SQL_SCALED)


@query(
    FUSED
    + """, all_lines AS (SELECT matched FROM lines UNION ALL SELECT true FROM lines)
SELECT CAST(COUNT(*) AS BIGINT) AS checks, CAST(COUNT(*) FILTER (WHERE NOT matched) AS BIGINT) AS failed,
 CASE WHEN COUNT(*) FILTER (WHERE NOT matched) > 0 THEN 'failed' ELSE 'passed' END AS status FROM all_lines"""
)
def check_run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = sides(spark, sf_dir)
    return R.checks_outcome(R.run_checks([R.reconcile(source, target, SPEC), R.reconcile(source, source, SPEC)]))


@query(
    """SELECT event_id, COALESCE(event_id % 3 = 0, false) AS sampled, CAST(abs(user_id - 500) % 16 AS BIGINT) AS bucket,
 CAST(CAST(COALESCE(CAST(event_id AS DECIMAL(38,6)),0) + COALESCE(CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,6)),0) AS DECIMAL(38,6)) AS VARCHAR) AS row_sum,
 COALESCE(NULLIF(event_type,'view'), '<NULL>') AS shown_type,
 regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '\\.?0*Z$', 'Z') AS shown_ts
 FROM events"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("event_type", F.expr("nullif(event_type, 'view')"))
    return events.select(
        "event_id",
        F.coalesce(sample_pred(F.col("event_id"), 3), F.lit(False)).alias("sampled"),
        bucket_id(F.col("user_id") - 500, 16).alias("bucket"),
        numeric_row_sum([F.col("event_id"), F.col("value").cast("decimal(18,2)")]).cast("string").alias("row_sum"),
        normalize_scalar(F.col("event_type"), events.schema["event_type"].dataType).alias("shown_type"),
        normalize_scalar(F.col("ts"), events.schema["ts"].dataType).alias("shown_ts"),
    )


@query(
    SIDES
    + """, u AS (SELECT o_orderkey, o_custkey, o_price, o_orderstatus FROM t UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_price, o_orderstatus FROM s WHERE o_orderkey % 1013 = 7)
SELECT COALESCE(s.o_orderkey, u.o_orderkey) AS o_orderkey, CASE WHEN u.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS status,
 CAST(CASE WHEN s.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS source_rows, CAST(CASE WHEN u.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS target_rows
FROM s FULL JOIN u ON s.o_orderkey = u.o_orderkey
WHERE s.o_orderkey IS NULL OR u.o_orderkey IS NULL OR s.o_custkey <> u.o_custkey OR s.o_price <> u.o_price OR s.o_orderstatus <> u.o_orderstatus"""
)
def reconcile_differing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders the copy lost, changed or has in excess."""
    source, target = sides(spark, sf_dir)
    extra = source.where("o_orderkey % 1013 = 7").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return differing_keys(source, target.unionByName(extra), ["o_orderkey"])


@query(FUSED + "SELECT * FROM lines")
def reconcile_kept_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy damaged by three batches of changes; its sums follow the changes and the copy is never scanned again."""
    source, _ = sides(spark, sf_dir)
    keys, columns = ["o_orderkey"], ["o_orderkey", "o_custkey", "o_price"]
    k = F.col("o_orderkey")
    op = F.when(k % 997 == 3, 1).when(k % 1009 == 5, 4)
    position = F.lpad(F.hex(k), 20, "0")
    feed = source.where(op.isNotNull()).select(
        op.alias("op"), position.alias("start_lsn"), position.alias("seqval"), "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), "o_price"
    )
    copy, sums = source, stage(R.table_sums(source, SPEC, target=True), "sums")
    for n in range(3):
        net = stage(C.net_changes(feed.where(k % 3 == n), keys, columns), "net")
        removed, added = C.moved_rows(copy, net, keys, columns)
        sums = stage(R.moved_sums(sums, removed, added, SPEC, target=True), "sums")
        copy = stage(C.apply_net(copy, net, keys, columns), "version")
    return R.reconcile_sums(R.table_sums(source, SPEC), sums, SPEC)
