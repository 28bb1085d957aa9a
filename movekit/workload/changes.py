"""Change feeds and replication: events become a feed for customer; customers become tracked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movekit.functions.lsn import format_lsn, lsn_bytes, lsn_number, parse_lsn, range_ok
from movekit.operators import changes as C
from movekit.plans import health as H
from movekit.plans import ranges as P
from movekit.session import scratch, stage
from movekit.streaming.feed import catch_up
from movekit.streaming.replicate import Replica, replicate_stream
from movekit.workload import query, table

KEYS, COLUMNS = ["c_custkey"], ["c_custkey", "c_acctbal"]
NOW = "2024-06-01T00:00:00Z"


def _hex20(number):
    return F.lpad(F.lower(F.hex(number)), 20, "0")


def text_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = (
        F.when(F.col("event_type") == "signup", 2)
        .when(F.col("event_type") == "view", 3)
        .when(F.col("event_type") == "error", 1)
        .otherwise(4)
    )
    return table(spark, sf_dir, "events").select(
        op.alias("op"),
        _hex20(F.expr("event_id div 10 + 1")).alias("start_lsn"),
        _hex20(F.expr("event_id % 10 + 1")).alias("seqval"),
        F.col("user_id").alias("c_custkey"),
        F.col("value").cast("decimal(18,2)").alias("c_acctbal"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.binary_positions(text_feed(spark, sf_dir))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal")
    )


def shown(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"))


FEED = """feed AS (SELECT CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 1 ELSE 4 END AS op,
 lpad(lower(to_hex(event_id // 10 + 1)), 20, '0') AS start_lsn, lpad(lower(to_hex(event_id % 10 + 1)), 20, '0') AS seqval,
 user_id AS c_custkey, CAST(value AS DECIMAL(18,2)) AS c_acctbal FROM events),
base AS (SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal FROM customer)"""
APPLIED = f"""WITH {FEED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY start_lsn DESC, seqval DESC, op DESC) AS rn,
 bool_or(op = 1) OVER (PARTITION BY c_custkey) AS erased FROM feed WHERE op <> 3),
net AS (SELECT * FROM ranked WHERE rn = 1)
SELECT COALESCE(b.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL OR NOT n.erased THEN b.c_name END AS c_name,
 CAST(CASE WHEN n.c_custkey IS NULL THEN b.c_acctbal ELSE n.c_acctbal END AS VARCHAR) AS c_acctbal
FROM base b FULL JOIN net n ON b.c_custkey = n.c_custkey WHERE n.op IS NULL OR n.op <> 1"""


@query(APPLIED)
def cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(C.apply_changes(base(spark, sf_dir), feed(spark, sf_dir), KEYS, COLUMNS))


@query(APPLIED)
def cdc_apply_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the full outer join used when the net effect is large."""
    return shown(C.apply_changes(base(spark, sf_dir), feed(spark, sf_dir), KEYS, COLUMNS, broadcast_rows=0))


@query(APPLIED)
def cdc_apply_two_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two consecutive ranges that share their boundary position give the one-range result."""
    changes = feed(spark, sf_dir)
    top = C.feed_head(changes).head()["max_lsn"]
    middle = f"0x{int(top[2:], 16) // 2:020x}"
    first = C.apply_changes(base(spark, sf_dir), C.read_changes(changes, "0x" + "0" * 20, middle), KEYS, COLUMNS)
    version = stage(first, "version")  # each range ends in a stored table version
    return shown(C.apply_changes(version, C.read_changes(changes, middle, top), KEYS, COLUMNS))


@query(APPLIED)
def cdc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as files in scrambled order, replicated by micro-batches."""
    landing = scratch(spark, "feed")
    pieces = feed(spark, sf_dir)
    pieces.repartition(5, "seqval").write.parquet(landing)
    stream = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    replica = Replica(spark, scratch(spark, "replica"), base(spark, sf_dir), KEYS, COLUMNS)
    replicate_stream(stream, replica, scratch(spark, "query")).awaitTermination()
    return shown(replica.snapshot())


@query(APPLIED)
def cdc_stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with a fold between them; a fifth of the early changes comes late, and early ones come again."""
    changes = feed(spark, sf_dir)
    top = int(C.feed_head(changes).head()["max_lsn"][2:], 16)
    low = f"0x{top - top // 4:020x}"
    early, straggling = F.col("start_lsn") < F.lit(lsn_bytes(low)), F.pmod(F.xxhash64("start_lsn", "seqval"), F.lit(5)) == 0
    replica = Replica(spark, scratch(spark, "replica"), base(spark, sf_dir), KEYS, COLUMNS)
    replica.absorb(changes.where(early & ~straggling), 0)
    replica.fold(low, 0)
    replica.absorb(changes.where(early & straggling), 1)
    replica.absorb(changes.where(~early), 2)
    replica.fold(low, 2)
    replica.absorb(changes, 3)
    return shown(replica.snapshot())


@query(APPLIED)
def cdc_stream_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored feed followed by log ranges: a part of it first, then the rest by the same query."""
    changes = feed(spark, sf_dir)
    top = int(C.feed_head(changes).head()["max_lsn"][2:], 16)
    landing, query_dir = scratch(spark, "feed"), scratch(spark, "query")
    early = F.col("start_lsn") <= F.lit(lsn_bytes(f"0x{top // 3:020x}"))
    replica = Replica(spark, scratch(spark, "replica"), base(spark, sf_dir), KEYS, COLUMNS)
    load = lambda: spark.read.schema(changes.schema).parquet(landing)
    n = changes.count()
    for part in (early, ~early):
        changes.where(part).write.mode("append").parquet(landing)
        catch_up(load, replica, query_dir, max_changes=max(1, n // 4))
    return shown(replica.snapshot())


@query(APPLIED)
def cdc_stream_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of the feed from two sources; each fold forgets what no source can change any more, then all comes again."""
    changes = feed(spark, sf_dir)
    top = int(C.feed_head(changes).head()["max_lsn"][2:], 16)
    at = [f"0x{top * n // 4 + (n == 4):020x}" for n in range(5)]
    replica = Replica(spark, scratch(spark, "replica"), base(spark, sf_dir), KEYS, COLUMNS, sources=["odd", "even"], part_rows=500)
    lsn, late = F.col("start_lsn"), F.pmod(F.xxhash64("start_lsn", "seqval"), F.lit(5)) == 0
    for n in range(4):
        # A fifth of every quarter comes with the next one.
        quarter = (lsn >= F.lit(lsn_bytes(at[n]))) & (lsn < F.lit(lsn_bytes(at[n + 1]))) & (~late if n < 3 else F.lit(True))
        before = (lsn >= F.lit(lsn_bytes(at[n - 1]))) & (lsn < F.lit(lsn_bytes(at[n]))) & late if n else F.lit(False)
        replica.absorb(changes.where(quarter | before), n)
        replica.advance(spark.createDataFrame([("odd", at[n]), ("even", at[n + 1])], "source string, low_water string"))
        replica.fold(at[n + 1], n)
    replica.absorb(changes, 9)
    replica.vacuum()
    return shown(replica.snapshot())


@query("SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1")
def cdc_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that could not be a key of orders."""
    return C.duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@query(
    f"""WITH {FEED} SELECT CASE op WHEN 1 THEN 'delete' WHEN 3 THEN 'skip' ELSE 'upsert' END AS action,
 CAST(COUNT(*) AS BIGINT) AS n FROM feed GROUP BY 1"""
)
def cdc_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).groupBy(C.decode_op(F.col("op").cast("string")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FEED} SELECT CAST(COUNT(*) FILTER (WHERE op <> 3) AS BIGINT) AS applied_changes FROM feed")
def cdc_applied_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.applied_count(feed(spark, sf_dir))


MIDDLE = """, span AS (SELECT lpad(lower(to_hex(m // 4)), 20, '0') AS lo, lpad(lower(to_hex(m - m // 4)), 20, '0') AS hi
 FROM (SELECT MAX(event_id // 10 + 1) AS m FROM events))"""


@query(
    f"""WITH {FEED} {MIDDLE} SELECT op, '0x' || start_lsn AS start_lsn, seqval, c_custkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal
 FROM feed, span WHERE start_lsn BETWEEN lo AND hi"""
)
def cdc_read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = feed(spark, sf_dir)
    top = int(C.feed_head(changes).head()["max_lsn"][2:], 16)
    span = C.read_changes(changes, f"0x{top // 4:020x}", f"0x{top - top // 4:020x}")
    return span.select(
        "op",
        format_lsn(F.col("start_lsn")).alias("start_lsn"),
        F.lower(F.hex("seqval")).alias("seqval"),
        "c_custkey",
        F.col("c_acctbal").cast("string").alias("c_acctbal"),
    )


@query(
    f"""WITH {FEED} SELECT CASE WHEN GROUPING(c_custkey) = 1 THEN 'feed' ELSE 'source' END AS level,
 COALESCE(c_custkey, -1) AS c_custkey, '0x' || MIN(start_lsn) AS min_lsn, '0x' || MAX(start_lsn) AS max_lsn,
 CAST(COUNT(*) AS BIGINT) AS changes FROM feed GROUP BY ROLLUP (c_custkey)"""
)
def cdc_lsn_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lsn_bounds(feed(spark, sf_dir), "c_custkey").withColumn("c_custkey", F.coalesce("c_custkey", F.lit(-1)))


@query(
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '0x' || lpad(lower(to_hex(event_id)), 19, '0')
 WHEN event_id % 5 = 1 THEN '0X' || lpad(to_hex(event_id), 20, '0') ELSE lpad(lower(to_hex(event_id)), 20, '0') END AS txt FROM events)
SELECT event_id, event_id % 5 <> 0 AS valid,
 CASE WHEN event_id % 5 <> 0 THEN '0x' || lpad(lower(to_hex(event_id)), 20, '0') ELSE '-' END AS formatted,
 event_id % 5 <> 0 AND event_id <= 500 AS in_order, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS VARCHAR) ELSE '-' END AS as_number FROM t"""
)
def cdc_lsn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = (
        F.when(n % 5 == 0, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), 19, "0")))
        .when(n % 5 == 1, F.concat(F.lit("0X"), F.lpad(F.hex(n), 20, "0")))
        .otherwise(_hex20(n))
    )
    value = parse_lsn(F.col("txt"))
    return table(spark, sf_dir, "events").select(n, text.alias("txt")).select(
        n,
        value.isNotNull().alias("valid"),
        F.coalesce(format_lsn(value), F.lit("-")).alias("formatted"),
        range_ok(F.col("txt"), F.lit(f"0x{500:020x}")).alias("in_order"),
        F.coalesce(lsn_number(value).cast("string"), F.lit("-")).alias("as_number"),
    )


# -- tracked tables, checkpoints, health ----------------------------------------------------------


def _lsn_text(number):
    return F.concat(F.lit("0x"), _hex20(number))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("crm.dbo.t"), k.cast("string"))
    columns = F.array(F.lit("id"), F.lit("Name"), F.when(k % 17 == 4, "ID").otherwise("balance"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("project"),
        F.when(k % 29 == 3, "t").when(k % 31 == 7, F.concat(F.lit("crm..t"), k.cast("string"))).otherwise(name).alias("source_object"),
        F.when(k % 37 == 5, "").otherwise(F.concat(F.lit("shop.t"), k.cast("string"))).alias("target_object"),
        columns.alias("columns"),
        F.when(k % 19 == 2, F.array(F.lit("nokey"))).when(k % 23 == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("ID"))).alias("key_columns"),
        F.when(k % 41 == 8, 0).otherwise(1000).alias("apply_batch_size"),
        F.lit(168).alias("retention_hours"),
        F.when(k % 43 == 9, "0x12").otherwise(_lsn_text(k % 50 + 1)).alias("from_lsn"),
        _lsn_text(F.when(k % 47 == 10, 0).otherwise(k % 90 + 60)).alias("to_lsn"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint entries of the clean tracked names; some missing, some moved, some ahead."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 3")
    return rows.select(
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("project"),
        F.concat(F.lit("crm.dbo.t"), k.cast("string")).alias("source_object"),
        F.concat(F.when(k % 53 == 11, "other.t").otherwise("shop.t"), k.cast("string")).alias("target_object"),
        _lsn_text(F.lit(1)).alias("from_lsn"),
        _lsn_text(F.when(k % 3 == 0, k % 50 + 1).otherwise(k % 130)).alias("to_lsn"),
        F.when(k % 59 == 12, -1).otherwise(k % 7).cast("long").alias("applied_changes"),
        F.when(k % 61 == 13, "yesterday").otherwise("2024-05-01T10:00:00.5Z").alias("completed_at"),
    )


def low_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = C.lsn_bounds(feed(spark, sf_dir), "c_custkey").where("level = 'source'")
    return bounds.select(F.concat(F.lit("crm.dbo.t"), F.col("c_custkey").cast("string")).alias("source_object"), "min_lsn")


def head(spark: SparkSession, sf_dir: str) -> str:
    return C.feed_head(feed(spark, sf_dir)).head()["max_lsn"]


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), k.cast("string")).alias("project"),
        F.when(k % 9 == 1, "failed").otherwise("running").alias("status"),
        F.when(k % 5 == 2, "2024-05-31T22:30:00Z").when(k % 5 == 3, "2024-06-01T00:05:00Z").otherwise("2024-05-31T23:30:00Z").alias("updated_at"),
    )


_L = "'0x' || lpad(lower(to_hex(CAST({} AS BIGINT))), 20, '0')"
PLAN = f"""tracked AS (SELECT c_custkey AS k, 'p' || c_nationkey AS project,
 CASE WHEN c_custkey % 29 = 3 THEN 't' WHEN c_custkey % 31 = 7 THEN 'crm..t' || c_custkey ELSE 'crm.dbo.t' || c_custkey END AS source_object,
 CASE WHEN c_custkey % 37 = 5 THEN '' ELSE 'shop.t' || c_custkey END AS target_object,
 CASE WHEN c_custkey % 43 = 9 THEN '0x12' ELSE {_L.format('c_custkey % 50 + 1')} END AS from_lsn,
 {_L.format('CASE WHEN c_custkey % 47 = 10 THEN 0 ELSE c_custkey % 90 + 60 END')} AS to_lsn FROM customer),
entries AS (SELECT 'p' || c_nationkey AS project, 'crm.dbo.t' || c_custkey AS source_object,
 CASE WHEN c_custkey % 53 = 11 THEN 'other.t' ELSE 'shop.t' END || c_custkey AS target_object,
 {_L.format('1')} AS from_lsn, {_L.format('CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 + 1 ELSE c_custkey % 130 END')} AS to_lsn,
 CAST(CASE WHEN c_custkey % 59 = 12 THEN -1 ELSE c_custkey % 7 END AS BIGINT) AS applied_changes,
 CASE WHEN c_custkey % 61 = 13 THEN 'yesterday' ELSE '2024-05-01T10:00:00.5Z' END AS completed_at FROM customer WHERE c_custkey % 11 <> 3),
low AS (SELECT 'crm.dbo.t' || user_id AS source_object, '0x' || MIN(lpad(lower(to_hex(event_id // 10 + 1)), 20, '0')) AS min_lsn FROM events GROUP BY user_id),
head AS (SELECT '0x' || MAX(lpad(lower(to_hex(event_id // 10 + 1)), 20, '0')) AS max_lsn FROM events),
st AS (SELECT t.*, e.target_object AS ck_target, e.to_lsn AS ck_to, e.source_object AS seen, e.applied_changes, low.min_lsn, head.max_lsn FROM tracked t
 LEFT JOIN entries e ON t.project = e.project AND t.source_object = e.source_object
 LEFT JOIN low ON low.source_object = t.source_object, head)"""


@query(
    f"""WITH {PLAN}, named AS (
SELECT project, source_object, 'source_malformed' AS rule FROM tracked WHERE k % 29 = 3 OR k % 31 = 7
UNION ALL SELECT project, source_object, 'target_required' FROM tracked WHERE k % 37 = 5
UNION ALL SELECT project, source_object, 'batch_size_not_positive' FROM tracked WHERE k % 41 = 8
UNION ALL SELECT project, source_object, 'column_repeated' FROM tracked WHERE k % 17 = 4
UNION ALL SELECT project, source_object, 'key_not_captured' FROM tracked WHERE k % 19 = 2
UNION ALL SELECT project, source_object, 'key_required' FROM tracked WHERE k % 23 = 6 AND k % 19 <> 2
UNION ALL SELECT project, source_object, 'from_malformed' FROM tracked WHERE k % 43 = 9
UNION ALL SELECT project, source_object, 'range_reversed' FROM tracked WHERE k % 43 <> 9 AND from_lsn > to_lsn
UNION ALL SELECT project, source_object, 'source_repeated' FROM tracked GROUP BY 1, 2 HAVING COUNT(*) > 1)
SELECT * FROM named"""
)
def cdc_tracked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.validate_tracked(tracked(spark, sf_dir))


@query(
    f"""WITH {PLAN} SELECT project, source_object, 'changes_negative' AS rule FROM entries WHERE applied_changes < 0
UNION ALL SELECT project, source_object, 'completed_malformed' FROM entries WHERE completed_at = 'yesterday'
UNION ALL SELECT project, source_object, 'range_reversed' FROM entries WHERE from_lsn > to_lsn"""
)
def cdc_checkpoint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.validate_checkpoint(entries(spark, sf_dir))


START = _L.format("1")


@query(
    f"""WITH {PLAN}, r AS (SELECT *, COALESCE(ck_to, {START}) AS low FROM st),
e AS (SELECT *, CASE WHEN ck_target <> target_object THEN 'target_differs' WHEN low < min_lsn THEN 'retention_expired'
 WHEN low > max_lsn THEN 'ahead_of_source' END AS error FROM r),
p AS (SELECT project, CASE WHEN COUNT(error) > 0 THEN 'blocked' WHEN bool_or(low < max_lsn) THEN 'range_prepared' ELSE 'caught_up' END AS status FROM e GROUP BY project)
SELECT e.project, source_object, target_object, CASE WHEN status = 'range_prepared' THEN low END AS from_lsn,
 CASE WHEN status = 'range_prepared' THEN max_lsn END AS to_lsn, error, status FROM e JOIN p ON e.project = p.project"""
)
def cdc_next_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.next_ranges(
        tracked(spark, sf_dir), entries(spark, sf_dir), head(spark, sf_dir), low_marks(spark, sf_dir), f"0x{1:020x}"
    )


@query(
    f"""WITH {PLAN}, r AS (SELECT *, COALESCE(ck_to, {START}) AS low FROM st),
p AS (SELECT project, CASE WHEN bool_or(low < {_L.format(200)}) THEN 'range_prepared' ELSE 'caught_up' END AS status FROM r GROUP BY project)
SELECT r.project, source_object, target_object, CASE WHEN status = 'range_prepared' THEN low END AS from_lsn,
 CASE WHEN status = 'range_prepared' THEN {_L.format(200)} END AS to_lsn, status FROM r JOIN p ON r.project = p.project"""
)
def cdc_next_ranges_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without retention marks and moved targets every project gets its ranges."""
    steady = entries(spark, sf_dir).withColumn("target_object", F.lit(""))
    ready = P.next_ranges(tracked(spark, sf_dir), steady, f"0x{200:020x}", initial_lsn=f"0x{1:020x}")
    return ready.drop("error")


@query(
    f"""WITH {PLAN}, r AS (SELECT *, ck_to AS low FROM st),
e AS (SELECT *, CASE WHEN low IS NULL THEN 'no_start' WHEN low < min_lsn THEN 'retention_expired' WHEN low > {_L.format(100)} THEN 'range_reversed' END AS error FROM r)
SELECT project, source_object, target_object, CASE WHEN error IS NULL THEN low END AS from_lsn,
 CASE WHEN error IS NULL THEN {_L.format(100)} END AS to_lsn, error FROM e"""
)
def cdc_explicit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.explicit_range(tracked(spark, sf_dir), entries(spark, sf_dir), f"0x{100:020x}", low_marks(spark, sf_dir))


@query(
    f"""WITH {PLAN}, e AS (SELECT *, CASE WHEN ck_to IS NULL THEN CASE WHEN k % 43 <> 9 AND from_lsn < min_lsn THEN 'retention_expired' END
 WHEN ck_target <> target_object AND target_object <> '' THEN 'target_differs' WHEN ck_target <> target_object THEN 'target_differs'
 WHEN ck_to >= to_lsn THEN NULL WHEN ck_to <> from_lsn THEN 'gap' WHEN k % 43 <> 9 AND from_lsn < min_lsn THEN 'retention_expired' END AS error FROM st)
SELECT project, source_object, target_object, error IS NULL AND (ck_to IS NULL OR ck_to < to_lsn) AS needed,
 CASE WHEN error IS NULL AND ck_to >= to_lsn THEN 'already checkpointed' END AS reason, error FROM e"""
)
def cdc_apply_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.apply_needed(tracked(spark, sf_dir), entries(spark, sf_dir), low_marks(spark, sf_dir))


def cdc_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finished cdc command per customer, two customers per run."""
    k = F.col("c_custkey")
    plan = table(spark, sf_dir, "customer").select(
        k,
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("project"),
        F.concat(F.lit("crm.dbo.t"), k.cast("string")).alias("source_object"),
        F.concat(F.lit("shop.t"), k.cast("string")).alias("target_object"),
    )
    flag = lambda name, value: F.array(F.lit(name), value)
    return plan.select(
        "project",
        F.concat(F.lit("r"), F.expr("c_custkey div 2").cast("string")).alias("run_id"),
        F.when(F.expr("c_custkey div 2") % 7 == 1, "failed").otherwise("succeeded").alias("run_status"),
        (k % 2).alias("position"),
        F.concat(F.lit("c"), k.cast("string")).alias("command_id"),
        F.concat(
            F.array(F.lit("cdc")),
            flag("--source-object", F.col("source_object")),
            flag("--target-object", F.col("target_object")),
            flag("--from-lsn", _lsn_text(F.when(k % 5 == 4, 0).otherwise(k % 50 + 1))),
            flag("--to-lsn", _lsn_text(k % 90 + 60)),
        ).alias("args"),
        F.when(k % 13 == 7, F.lit(None)).otherwise(k % 100).cast("long").alias("applied_changes"),
        F.lit("2024-05-20T00:00:00Z").alias("completed_at"),
    )


SNAPSHOTS = f"""WITH {PLAN}, cmd AS (SELECT c_custkey AS k, 'p' || c_nationkey AS project, 'r' || (c_custkey // 2) AS run_id,
 CASE WHEN (c_custkey // 2) % 7 = 1 THEN 'failed' ELSE 'succeeded' END AS run_status, 'c' || c_custkey AS command_id,
 'crm.dbo.t' || c_custkey AS source_object, 'shop.t' || c_custkey AS target_object,
 {_L.format('CASE WHEN c_custkey % 5 = 4 THEN 0 ELSE c_custkey % 50 + 1 END')} AS from_lsn, {_L.format('c_custkey % 90 + 60')} AS to_lsn,
 CAST(CASE WHEN c_custkey % 13 = 7 THEN NULL ELSE c_custkey % 100 END AS BIGINT) AS applied_changes FROM customer),
j AS (SELECT c.*, t.k AS tk, t.target_object AS pt, t.from_lsn AS pf, t.to_lsn AS pto FROM cmd c
 LEFT JOIN tracked t ON t.project = c.project AND t.source_object = c.source_object),
bad AS (SELECT project, run_id, command_id, 'run_not_succeeded' AS rule FROM j WHERE run_status <> 'succeeded'
UNION ALL SELECT project, run_id, command_id, 'changes_required' FROM j WHERE applied_changes IS NULL
UNION ALL SELECT project, run_id, command_id, 'source_not_tracked' FROM j WHERE tk IS NULL
UNION ALL SELECT project, run_id, command_id, 'target_differs' FROM j WHERE tk IS NOT NULL AND target_object <> pt
UNION ALL SELECT project, run_id, command_id, 'from_differs' FROM j WHERE tk IS NOT NULL AND from_lsn <> pf
UNION ALL SELECT project, run_id, command_id, 'to_differs' FROM j WHERE tk IS NOT NULL AND to_lsn <> pto)"""


@query(SNAPSHOTS + " SELECT * FROM bad")
def cdc_snapshot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.snapshot_violations(P.snapshots_from_commands(cdc_commands(spark, sf_dir)), tracked(spark, sf_dir))


@query(
    SNAPSHOTS
    + """, good AS (SELECT cmd.* FROM cmd WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.project = cmd.project AND bad.run_id = cmd.run_id))
SELECT project, source_object, target_object, from_lsn, to_lsn, applied_changes, '2024-05-20T00:00:00Z' AS completed_at, 'caught_up' AS status FROM good
UNION ALL SELECT project, source_object, target_object, from_lsn, to_lsn, applied_changes, completed_at, 'running' FROM entries e
 WHERE NOT EXISTS (SELECT 1 FROM good WHERE good.project = e.project AND good.source_object = e.source_object)"""
)
def cdc_checkpoint_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.advance_checkpoint(
        entries(spark, sf_dir).withColumn("status", F.lit("running")),
        P.snapshots_from_commands(cdc_commands(spark, sf_dir)),
        tracked(spark, sf_dir),
        "caught_up",
    )


def finished_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished runs of a hundred tables, in no order; those of errors have failed."""
    start = F.col("event_id") * 37 % 1000
    done = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return done.select(
        F.concat(F.lit("p"), F.col("user_id") % 7).alias("project"),
        F.concat(F.lit("crm.dbo.t"), F.col("user_id") % 100).alias("source_object"),
        _lsn_text(start).alias("from_lsn"),
        _lsn_text(start + F.col("event_id") % 5).alias("to_lsn"),
    )


def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tables' checkpoints stand."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where("c_custkey % 5 <> 2").groupBy((k % 7).alias("p"), (k % 100).alias("t")).agg(F.max(k * 7 % 400).alias("at")).select(
        F.concat(F.lit("p"), "p").alias("project"), F.concat(F.lit("crm.dbo.t"), "t").alias("source_object"), _lsn_text(F.col("at")).alias("to_lsn")
    )


# By position: a unit step is covered if a run has both of its ends; islands and holes are runs of such steps.
ISLANDS = f"""WITH run AS (SELECT user_id % 7 AS p, user_id % 100 AS t, event_id * 37 % 1000 AS lo, event_id * 37 % 1000 + event_id % 5 AS hi FROM events WHERE event_type <> 'error'),
ck AS (SELECT c_custkey % 7 AS p, c_custkey % 100 AS t, MAX(c_custkey * 7 % 400) AS pos FROM customer WHERE c_custkey % 5 <> 2 GROUP BY 1, 2),
spot AS (SELECT p, t, pos, s FROM ck, LATERAL (SELECT unnest(range(pos, 1010)) AS s)),
far AS (SELECT p, t, pos, GREATEST(pos, COALESCE(MAX(hi), 0)) AS top FROM ck LEFT JOIN run USING (p, t) GROUP BY p, t, pos),
step AS (SELECT DISTINCT p, t, unnest(range(lo, hi)) AS s FROM run),
touched AS (SELECT DISTINCT p, t, unnest(range(lo, hi + 1)) AS s FROM run UNION SELECT p, t, pos FROM ck),
bare AS (SELECT spot.p, spot.t, spot.pos, spot.s FROM spot JOIN far USING (p, t) LEFT JOIN step USING (p, t, s) WHERE spot.s < far.top AND step.s IS NULL),
cut AS (SELECT b.*, x.s IS NOT NULL AS begins FROM bare b LEFT JOIN touched x USING (p, t, s)),
grp AS (SELECT *, COUNT(*) FILTER (WHERE begins) OVER (PARTITION BY p, t ORDER BY s) AS g FROM cut),
hole AS (SELECT p, t, MIN(s) AS lo, MAX(s) + 1 AS hi FROM grp GROUP BY p, t, g)
"""


@query(
    ISLANDS
    + f"""SELECT 'p' || ck.p AS project, 'crm.dbo.t' || ck.t AS source_object, {_L.format('ck.pos')} AS from_lsn,
 {_L.format('COALESCE(MIN(hole.lo), any_value(top))')} AS to_lsn, CAST(COUNT(hole.lo) AS BIGINT) AS holes
 FROM ck JOIN far USING (p, t) LEFT JOIN hole ON hole.p = ck.p AND hole.t = ck.t GROUP BY ck.p, ck.t, ck.pos"""
)
def cdc_advance_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.advance_over(standing(spark, sf_dir), finished_ranges(spark, sf_dir))


@query(ISLANDS + f"SELECT 'p' || p AS project, 'crm.dbo.t' || t AS source_object, {_L.format('lo')} AS from_lsn, {_L.format('hi')} AS to_lsn FROM hole")
def cdc_open_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.open_ranges(standing(spark, sf_dir), finished_ranges(spark, sf_dir))


HEALTH = f"""WITH {PLAN}, h AS (SELECT *, CASE WHEN seen IS NULL THEN 'unknown' WHEN ck_to < max_lsn THEN 'behind' WHEN ck_to = max_lsn THEN 'caught_up' ELSE 'ahead' END AS lag_status,
 CASE WHEN seen IS NULL OR min_lsn IS NULL THEN 'unknown' WHEN ck_to < min_lsn THEN 'expired' ELSE 'covered' END AS retention_status FROM st),
pr AS (SELECT 'p' || n_nationkey AS project, CASE WHEN n_nationkey % 9 = 1 THEN 'failed' ELSE 'running' END AS checkpoint_status,
 CASE n_nationkey % 5 WHEN 2 THEN 5400 WHEN 3 THEN 0 ELSE 1800 END AS age_seconds FROM nation),
al AS (SELECT project, '' AS source_object, 'critical' AS severity, 'checkpoint_failed' AS code FROM pr WHERE checkpoint_status = 'failed'
UNION ALL SELECT project, '', 'critical', 'checkpoint_stale' FROM pr WHERE age_seconds > 3600
UNION ALL SELECT project, source_object, 'critical', 'checkpoint_missing' FROM h WHERE seen IS NULL
UNION ALL SELECT project, source_object, 'warning', 'cdc_lag' FROM h WHERE lag_status = 'behind'
UNION ALL SELECT project, source_object, 'critical', 'checkpoint_ahead' FROM h WHERE lag_status = 'ahead'
UNION ALL SELECT project, source_object, 'critical', 'retention_expired' FROM h WHERE retention_status = 'expired'),
su AS (SELECT pr.project, checkpoint_status, CAST(age_seconds AS BIGINT) AS age_seconds, COALESCE(t.n,0) AS tracked_tables, COALESCE(t.lag,0) AS lagging_tables,
 COALESCE(t.exp,0) AS expired_tables, CASE COALESCE(a.worst,0) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS status FROM pr
 LEFT JOIN (SELECT project, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE lag_status = 'behind') AS BIGINT) AS lag,
  CAST(COUNT(*) FILTER (WHERE retention_status = 'expired') AS BIGINT) AS exp FROM h GROUP BY project) t ON t.project = pr.project
 LEFT JOIN (SELECT project, MAX(CASE severity WHEN 'critical' THEN 2 ELSE 1 END) AS worst FROM al GROUP BY project) a ON a.project = pr.project)"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.health_tables(tracked(spark, sf_dir), entries(spark, sf_dir), low_marks(spark, sf_dir), head(spark, sf_dir))


@query(HEALTH + " SELECT project, source_object, target_object, lag_status, retention_status FROM h")
def cdc_health_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("project", "source_object", "target_object", "lag_status", "retention_status")


@query(HEALTH + " SELECT * FROM al")
def cdc_health_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.health_alerts(_tables(spark, sf_dir), states(spark, sf_dir), NOW, 3600)


@query(HEALTH + " SELECT * FROM su")
def cdc_health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.health_summary(_tables(spark, sf_dir), states(spark, sf_dir), NOW, 3600)


@query(
    HEALTH
    + """ SELECT project, status, status IN ('warning','critical') AS notify,
 CAST(CASE WHEN status IN ('warning','critical') THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM su"""
)
def cdc_alert_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = H.health_summary(_tables(spark, sf_dir), states(spark, sf_dir), NOW, 3600)
    return H.route_alerts(summary, "warning", fail_on_warning=True).select("project", "status", "notify", "exit_code")


@query(HEALTH + " SELECT project, checkpoint_status, tracked_tables, status, '2024-06-01T00:00:00Z' AS generated_at FROM su")
def cdc_health_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports appended to the history; the newer one is read back."""
    summary = H.health_summary(_tables(spark, sf_dir), states(spark, sf_dir), NOW, 3600).select(
        "project", "checkpoint_status", "tracked_tables", "status"
    )
    path = scratch(spark, "history")
    H.append_history(summary.withColumn("status", F.lit("ok")), path, "2024-05-31T00:00:00Z")
    H.append_history(summary, path, NOW)
    return H.latest_health(spark, path, summary.withColumn("generated_at", F.lit("")).schema)
