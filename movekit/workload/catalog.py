"""Catalog work on system tables derived from the given ones.

Every part is a table whose columns and indexes follow from its key; lineitem rows are its
partitions, suppliers are triggers, customers are routines and nations are schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.operators import catalog as C
from movekit.operators import drift as D
from movekit.operators import findings as N
from movekit.operators import type_map as M
from movekit.plans import checks as K
from movekit.plans.ranges import plan_tracked
from movekit.session import by_key, scratch
from movekit.workload import query, table

TYPES = [*M.RULES, "decimal(18,2)", "nvarchar(32)", "NVARCHAR(MAX)", "varbinary(16)", "binary(max)", "char(3)", "rainbow"]
SCOPE = C.Scope("CRM", [f"Nation_{i}" for i in range(20)], "shop")


def system_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"))
    key = F.col("object_id")
    with_i = part.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), 3 + key % 4)))
    with_j = part.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), 1 + key % 3)))
    j, i = F.col("j"), F.col("i")
    with_k = with_j.withColumn("k", F.explode(F.when(j == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
    k = F.col("k")
    segment = F.col("c_mktsegment")
    code = F.when(segment == "AUTOMOBILE", "P ").when(segment == "BUILDING", "FN").when(segment == "FURNITURE", "IF").when(segment == "HOUSEHOLD", "TF").otherwise("V ")
    return {
        "schemas": table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").cast("long").alias("schema_id"), F.lower("n_name").alias("name")
        ),
        "tables": part.select(
            key, (key % 25).alias("schema_id"), F.concat(F.lit("t"), key.cast("string")).alias("name"), (key % 50 == 49).alias("is_ms_shipped")
        ),
        "partitions": table(spark, sf_dir, "lineitem").select(
            F.col("l_partkey").alias("object_id"), (F.col("l_linenumber") % 3).alias("index_id"), F.col("l_quantity").cast("long").alias("rows")
        ),
        "columns": with_i.select(
            key,
            i.alias("column_id"),
            F.concat(F.lit("c"), i.cast("string")).alias("name"),
            ((key * 5 + i * 3) % len(TYPES)).alias("user_type_id"),
            (i == 1).alias("is_identity"),
            ((key + i) % 7 == 0).alias("is_computed"),
        ),
        "types": spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in TYPES])).alias("user_type_id", "name")).withColumn(
            "user_type_id", F.col("user_type_id").cast("long")
        ),
        "indexes": with_j.select(
            key,
            j.alias("index_id"),
            F.when((j == 1) & (key % 40 == 7), None).when(j == 1, "pk").when(j == 2, "ux").otherwise("ix").alias("name"),
            (j <= 2).alias("is_unique"),
            ((j == 1) & (key % 6 != 5)).alias("is_primary_key"),
            ((j == 2) & (key % 4 == 1)).alias("has_filter"),
            ((j == 3) & (key % 9 == 2)).alias("is_hypothetical"),
        ),
        "index_columns": with_k.select(
            key,
            j.alias("index_id"),
            k.alias("index_column_id"),
            F.when(j == 1, 1).when(j == 2, 3 - k).otherwise(4 - k).cast("long").alias("column_id"),
            F.when(j == 2, 3 - k).when((j == 3) & (k == 2), 0).otherwise(k).alias("key_ordinal"),
            ((j == 3) & (k == 2)).alias("is_included_column"),
        ),
        "triggers": table(spark, sf_dir, "supplier").select(
            (F.col("s_suppkey") * 7).alias("parent_id"), F.concat(F.lit("tr"), F.col("s_suppkey").cast("string")).alias("name")
        ),
        "objects": table(spark, sf_dir, "customer").select(
            F.col("c_nationkey").cast("long").alias("schema_id"),
            F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("name"),
            code.alias("type"),
            segment.alias("type_desc"),
            (F.col("c_custkey") % 20 == 1).alias("is_ms_shipped"),
        ),
    }


def inventory(spark: SparkSession, sf_dir: str) -> C.Inventory:
    return C.read_catalog(system_tables(spark, sf_dir), "crm")


_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_SCOPE_LIST = ", ".join(f"'nation_{i}'" for i in range(20))
SYS = f"""own AS (SELECT p_partkey AS k, 'crm' AS "database", 'nation_' || (p_partkey % 25) AS "schema", 't' || p_partkey AS "table" FROM part WHERE p_partkey % 50 <> 49),
tabs AS (SELECT own.*, CAST(COALESCE((SELECT SUM(CAST(l_quantity AS BIGINT)) FROM lineitem WHERE l_partkey = k AND l_linenumber % 3 IN (0, 1)), 0) AS BIGINT) AS row_count FROM own),
cols AS (SELECT own.*, i AS ordinal, 'c' || i AS name, list_extract({_TYPE_LIST}, (k * 5 + i * 3) % {len(TYPES)} + 1) AS type, i = 1 AS identity, (k + i) % 7 = 0 AS computed
 FROM (SELECT *, unnest(range(1, 4 + k % 4)) AS i FROM own) own),
idx AS (SELECT * FROM (SELECT own.*, j AS position, CASE WHEN j = 1 AND k % 40 = 7 THEN NULL WHEN j = 1 THEN 'pk' WHEN j = 2 THEN 'ux' ELSE 'ix' END AS name,
 CASE j WHEN 1 THEN ['c1'] WHEN 2 THEN ['c1', 'c2'] ELSE ['c3'] END AS columns, j <= 2 AS "unique", j = 1 AND k % 6 <> 5 AS primary_key,
 j = 2 AND k % 4 = 1 AS filtered, CASE j WHEN 3 THEN ['c2'] ELSE [] END AS included_columns, j = 3 AND k % 9 = 2 AS hyp
 FROM (SELECT *, unnest(range(1, 2 + k % 3)) AS j FROM own) own) WHERE name IS NOT NULL AND NOT hyp),
trg AS (SELECT own.*, 'tr' || s_suppkey AS name FROM supplier JOIN own ON k = s_suppkey * 7),
rou AS (SELECT 'crm' AS "database", 'nation_' || c_nationkey AS "schema", 'r' || c_custkey AS name, c_mktsegment AS type FROM customer
 WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') AND c_custkey % 20 <> 1),
scoped AS (SELECT *, 'crm.' || "schema" || '.' || "table" AS source_object, 'shop.' || "schema" || '_' || "table" AS target_object FROM own WHERE "schema" IN ({_SCOPE_LIST}))"""
WITH = f"WITH {SYS} "
T3 = '"database", "schema", "table"'


@query(WITH + f"SELECT {T3}, row_count FROM tabs")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalog_tables(system_tables(spark, sf_dir), "crm")


@query(WITH + f"SELECT {T3}, ordinal, name, type, identity, computed FROM cols")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalog_columns(system_tables(spark, sf_dir), "crm")


@query(
    WITH
    + f"""SELECT {T3}, position, name, array_to_string(columns, ',') AS columns, "unique", primary_key, filtered,
 array_to_string(included_columns, ',') AS included_columns FROM idx"""
)
def catalog_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.catalog_indexes(system_tables(spark, sf_dir), "crm")
    return found.withColumns({c: F.array_join(c, ",") for c in ("columns", "included_columns")})


@query(WITH + f"SELECT {T3}, name FROM trg")
def catalog_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalog_triggers(system_tables(spark, sf_dir), "crm")


@query(WITH + 'SELECT "database", "schema", name, type FROM rou')
def catalog_routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalog_routines(system_tables(spark, sf_dir), "crm")


DOCUMENTS = (
    WITH
    + f""", c AS (SELECT k, string_agg(name || ':' || type || ':' || identity || ':' || computed, ',' ORDER BY ordinal) AS columns FROM cols GROUP BY k),
i AS (SELECT k, string_agg(name || ':' || array_to_string(columns, '+') || ':' || "unique" || ':' || primary_key || ':' || filtered || ':' || array_to_string(included_columns, '+'), ',' ORDER BY name) AS indexes FROM idx GROUP BY k),
g AS (SELECT k, string_agg(name, ',' ORDER BY name) AS triggers FROM trg GROUP BY k)
SELECT {T3}, row_count, COALESCE(c.columns, '') AS columns, COALESCE(i.indexes, '') AS indexes, COALESCE(g.triggers, '') AS triggers
FROM tabs LEFT JOIN c USING (k) LEFT JOIN i USING (k) LEFT JOIN g USING (k)"""
)


def _flat_documents(docs: DataFrame) -> DataFrame:
    s = lambda c: c.cast("string")
    column = lambda c: F.concat_ws(":", c["name"], c["type"], s(c["identity"]), s(c["computed"]))
    index = lambda x: F.concat_ws(
        ":", x["name"], F.array_join(x["columns"], "+"), s(x["unique"]), s(x["primary_key"]), s(x["filtered"]), F.array_join(x["included_columns"], "+")
    )
    return docs.withColumns(
        {
            "columns": F.array_join(F.transform("columns", column), ","),
            "indexes": F.array_join(F.transform("indexes", index), ","),
            "triggers": F.array_join("triggers", ","),
        }
    )


@query(DOCUMENTS)
def inventory_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_documents(C.table_documents(inventory(spark, sf_dir)))


@query(DOCUMENTS)
def inventory_documents_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as nested JSON, one inventory document per table, and read as flat frames."""
    docs = C.table_documents(inventory(spark, sf_dir))
    nested = docs.select(
        F.lit("discovered").alias("status"),
        F.array(
            F.struct(
                F.col("database").alias("name"),
                F.array(
                    F.struct(
                        F.col("schema").alias("name"),
                        F.array(
                            F.struct(
                                F.col("table").alias("name"),
                                "row_count",
                                F.transform("columns", lambda c: c.dropFields("ordinal")).alias("columns"),
                                "indexes",
                                F.transform("triggers", lambda t: F.struct(t.alias("name"))).alias("triggers"),
                            )
                        ).alias("tables"),
                    )
                ).alias("schemas"),
            )
        ).alias("databases"),
    )
    path = scratch(spark, "inventory")
    nested.write.json(path)
    return _flat_documents(C.table_documents(C.read_inventory(spark, path, multiline=False)))


@query(WITH + "SELECT CAST(1 AS BIGINT) AS databases, (SELECT COUNT(*) FROM tabs) AS tables, (SELECT COUNT(*) FROM cols) AS columns")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inventory_stats(inventory(spark, sf_dir))


@query(WITH + f"SELECT {T3}, source_object, target_object FROM scoped")
def project_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.project_scope(inventory(spark, sf_dir).tables, SCOPE).drop("row_count")


@query(
    WITH
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY primary_key DESC, position) AS rn FROM idx WHERE (primary_key OR "unique") AND NOT filtered)
SELECT {T3}, array_to_string(columns, ',') AS key_columns FROM r WHERE rn = 1"""
)
def key_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.choose_keys(inventory(spark, sf_dir).indexes).withColumn("key_columns", F.array_join("key_columns", ","))


@query(WITH + f"SELECT {T3}, string_agg(name, ',' ORDER BY ordinal) AS columns FROM cols WHERE NOT computed GROUP BY ALL")
def captured_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.choose_columns(inventory(spark, sf_dir).columns).withColumn("columns", F.array_join("columns", ","))


@query(
    WITH
    + f""", live AS (SELECT k, string_agg(name, ',' ORDER BY ordinal) AS columns FROM cols WHERE NOT computed GROUP BY k),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY primary_key DESC, position) AS rn FROM idx WHERE (primary_key OR "unique") AND NOT filtered)
SELECT source_object, target_object, COALESCE(live.columns, '') AS columns, COALESCE(array_to_string(r.columns, ','), '') AS key_columns,
 CAST(500 AS INTEGER) AS apply_batch_size FROM scoped LEFT JOIN live USING (k) LEFT JOIN (SELECT k, columns FROM r WHERE rn = 1) r USING (k)"""
)
def tracked_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = inventory(spark, sf_dir)
    plan = plan_tracked(C.project_scope(now.tables, SCOPE), C.choose_columns(now.columns), C.choose_keys(now.indexes), 500)
    joined = {c: F.array_join(c, ",") for c in ("columns", "key_columns")}
    return plan.drop("retention_hours", "mode").withColumns(joined)


_BASE = "regexp_extract(lower(trim(type)), '^([^( ]*)', 1)"
_INTS = "('bigint','int','smallint','tinyint')"
_NUMS = "('bigint','int','smallint','tinyint','decimal','numeric','money','smallmoney')"


@query(WITH + f"SELECT {T3}, string_agg(name, ',' ORDER BY ordinal) AS numeric_columns FROM cols WHERE NOT computed AND {_BASE} IN {_NUMS} GROUP BY ALL")
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.numeric_columns(inventory(spark, sf_dir).columns)
    return found.withColumn("numeric_columns", F.array_join("numeric_columns", ","))


@query(WITH + f"SELECT {T3}, arg_min(name, ordinal) AS sample_column FROM cols WHERE NOT computed AND {_BASE} IN {_INTS} GROUP BY ALL")
def sample_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample_column(inventory(spark, sf_dir).columns)


def _expected_target(text: str) -> tuple[str, str, str]:
    """Target type, Spark type and code of one type text, worked out by hand for the SQL side."""
    fixed = {
        "decimal(18,2)": ("DECIMAL(18,2)", "decimal(18,2)", ""),
        "nvarchar(32)": ("VARCHAR(32)", "string", ""),
        "NVARCHAR(MAX)": ("TEXT", "string", ""),
        "varbinary(16)": ("VARBINARY(16)", "binary", ""),
        "binary(max)": ("BLOB", "binary", ""),
        "char(3)": ("CHAR(3)", "string", ""),
        "rainbow": ("TEXT", "string", "type_unmapped"),
        "decimal": ("DECIMAL", "decimal(38,6)", ""),
        "numeric": ("DECIMAL", "decimal(38,6)", ""),
        "char": ("CHAR(255)", "string", ""),
        "nchar": ("CHAR(255)", "string", ""),
        "varchar": ("VARCHAR(255)", "string", ""),
        "nvarchar": ("VARCHAR(255)", "string", ""),
        "binary": ("BLOB", "binary", ""),
        "varbinary": ("BLOB", "binary", ""),
        "bigint": ("BIGINT", "bigint", ""),
        "int": ("INT", "int", ""),
        "smallint": ("SMALLINT", "smallint", ""),
        "tinyint": ("TINYINT", "smallint", ""),
        "bit": ("TINYINT(1)", "boolean", ""),
        "money": ("DECIMAL(19,4)", "decimal(19,4)", ""),
        "smallmoney": ("DECIMAL(10,4)", "decimal(10,4)", ""),
        "float": ("DOUBLE", "double", ""),
        "real": ("FLOAT", "float", ""),
        "text": ("TEXT", "string", ""),
        "ntext": ("TEXT", "string", ""),
        "date": ("DATE", "date", ""),
        "datetime": ("DATETIME", "timestamp_ntz", ""),
        "datetime2": ("DATETIME", "timestamp_ntz", ""),
        "smalldatetime": ("DATETIME", "timestamp_ntz", ""),
        "datetimeoffset": ("DATETIME", "timestamp", "type_offset"),
        "time": ("TIME", "string", ""),
        "image": ("BLOB", "binary", ""),
        "uniqueidentifier": ("CHAR(36)", "string", ""),
        "xml": ("TEXT", "string", "type_xml"),
        "rowversion": ("VARBINARY(8)", "binary", "type_rowversion"),
        "timestamp": ("VARBINARY(8)", "binary", "type_rowversion"),
        "sql_variant": ("TEXT", "string", "type_variant"),
        "hierarchyid": ("TEXT", "string", "type_hierarchy"),
        "geometry": ("BLOB", "binary", "type_spatial"),
        "geography": ("BLOB", "binary", "type_spatial"),
    }
    return fixed[text]


MAPPED = (
    SYS
    + ", rule AS (SELECT * FROM (VALUES "
    + ", ".join("('{}', '{}', '{}', '{}')".format(t, *_expected_target(t)) for t in TYPES)
    + """) v(type, target_type, spark_type, rule_code)),
mapped AS (SELECT cols.*, target_type, spark_type, rule_code <> '' OR computed AS manual_review,
 CASE WHEN rule_code = '' AND computed THEN 'computed_column' ELSE rule_code END AS code FROM cols JOIN rule ON cols.type = rule.type)"""
)


@query(f"WITH {MAPPED} SELECT {T3}, ordinal, name, type, target_type, spark_type, manual_review, code FROM mapped")
def type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = M.map_types(inventory(spark, sf_dir).columns)
    return mapped.select(*C.TABLE, "ordinal", "name", "type", "target_type", "spark_type", "manual_review", "code")


def _mapped_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.map_types(C.project_scope(inventory(spark, sf_dir).columns, SCOPE))


@query(
    f"""WITH {MAPPED} SELECT source_object, target_object, string_agg(name || ' ' || target_type, ', ' ORDER BY ordinal) AS columns,
 bool_or(manual_review) AS manual_review, COUNT(*) FILTER (WHERE manual_review) AS manual_items FROM mapped JOIN scoped USING (k) GROUP BY ALL"""
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["target_type"]))
    return M.schema_diff(_mapped_scope(spark, sf_dir)).withColumn("columns", F.array_join(shown, ", "))


@query(
    f"""WITH {MAPPED} SELECT COUNT(DISTINCT k) AS tables, COUNT(*) AS columns, COUNT(*) FILTER (WHERE manual_review) AS manual_items FROM mapped JOIN scoped USING (k)"""
)
def schema_diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.schema_diff_summary(_mapped_scope(spark, sf_dir))


FOUND = (
    SYS
    + """, found AS (SELECT "database" || '.' || "schema" || '.' || "table" || '.' || name AS object, 'blocker' AS severity, 'type_xml' AS code FROM cols WHERE type = 'xml'
UNION ALL SELECT "database" || '.' || "schema" || '.' || "table" || '.' || name, 'blocker', 'type_rowversion' FROM cols WHERE type IN ('rowversion', 'timestamp')
UNION ALL SELECT "database" || '.' || "schema" || '.' || "table" || '.' || name, 'warning', 'computed_column' FROM cols WHERE computed
UNION ALL SELECT "database" || '.' || "schema" || '.' || "table" || '.' || name, 'warning', 'filtered_index' FROM idx WHERE filtered
UNION ALL SELECT "database" || '.' || "schema" || '.' || "table" || '.' || name, 'warning', 'included_columns' FROM idx WHERE len(included_columns) > 0
UNION ALL SELECT "database" || '.' || "schema" || '.' || "table" || '.' || name, 'blocker', 'trigger' FROM trg
UNION ALL SELECT "database" || '.' || "schema" || '.' || name, 'blocker', 'routine' FROM rou)"""
)


@query(f"WITH {FOUND} SELECT * FROM found")
def compatibility_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.findings(inventory(spark, sf_dir))


@query(
    f"""WITH {FOUND} SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE severity = 'blocker') AS blockers,
 COUNT(*) FILTER (WHERE severity = 'warning') AS warnings, CAST(0 AS BIGINT) AS other FROM found"""
)
def findings_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.findings_summary(N.findings(inventory(spark, sf_dir)))


# -- casting to the mapped types ------------------------------------------------------------------

CONFORM = """t AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
 CASE WHEN o_orderkey % 97 = 3 THEN 'oops' WHEN o_orderkey % 89 = 4 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
 CASE WHEN o_orderkey % 83 = 5 THEN '2024-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)"""


def _text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("o_orderkey"),
        F.when(k % 97 == 3, "oops").when(k % 89 == 4, None).otherwise(price).alias("price"),
        F.when(k % 83 == 5, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )


CONFORMED = T.StructType(
    [T.StructField("o_orderkey", T.LongType()), T.StructField("price", T.DecimalType(18, 2)), T.StructField("day", T.DateType())]
)


@query(f"WITH {CONFORM} SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, price, day FROM t WHERE COALESCE(price, '') <> 'oops' AND day <> '2024-02-30'")
def conform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = M.conform(_text_orders(spark, sf_dir), CONFORMED)
    return good.select("o_orderkey", F.col("price").cast("string").alias("price"), F.col("day").cast("string").alias("day"))


@query(
    f"""WITH {CONFORM} SELECT o_orderkey, price, day, array_to_string(list_filter([CASE WHEN price = 'oops' THEN 'price' END, CASE WHEN day = '2024-02-30' THEN 'day' END], lambda x: x IS NOT NULL), ',') AS misfits
 FROM t WHERE price = 'oops' OR day = '2024-02-30'"""
)
def conform_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = M.conform(_text_orders(spark, sf_dir), CONFORMED)
    return bad.withColumn("misfits", F.array_join("misfits", ","))


# -- drift ----------------------------------------------------------------------------------------


def _today(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = inventory(spark, sf_dir)
    named = lambda df: df.withColumn("source_object", SCOPE.source_object())
    return D.table_columns(named(now.tables).withColumn("in_scope", SCOPE.contains()), named(now.columns))


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed columns of all parts but some: a changed type in every tenth, shipped tables included."""
    sys = system_tables(spark, sf_dir)
    k = F.col("object_id")
    known = sys["tables"].where(k % 21 != 5).join(sys["schemas"].withColumnRenamed("name", "schema"), "schema_id")
    tables = known.select(k, F.upper(F.concat_ws(".", F.lit("crm"), "schema", "name")).alias("source_object"))
    types = sys["types"].withColumnRenamed("name", "type")
    columns = (
        sys["columns"].join(types, "user_type_id").join(by_key(tables), "object_id").select(
            "source_object",
            F.col("column_id").alias("ordinal"),
            "name",
            F.when((k % 10 == 0) & (F.col("column_id") == 2), "changed").otherwise(F.col("type")).alias("type"),
        )
    )
    return D.table_columns(tables.select("source_object"), columns)


DRIFT = (
    SYS
    + f""", allp AS (SELECT p_partkey AS k, 'crm.nation_' || (p_partkey % 25) || '.t' || p_partkey AS source_object FROM part),
allc AS (SELECT k, source_object, i, 'c' || i AS name, list_extract({_TYPE_LIST}, (k * 5 + i * 3) % {len(TYPES)} + 1) AS type FROM (SELECT *, unnest(range(1, 4 + k % 4)) AS i FROM allp)),
was AS (SELECT k, string_agg(name || ':' || CASE WHEN k % 10 = 0 AND i = 2 THEN 'changed' ELSE type END, ', ' ORDER BY i) AS cols FROM allc WHERE k % 21 <> 5 GROUP BY k),
now AS (SELECT k, string_agg(name || ':' || type, ', ' ORDER BY i) AS cols FROM allc WHERE k % 50 <> 49 GROUP BY k),
issue AS (SELECT CASE WHEN now.k IS NULL THEN 'manual_required' ELSE 'auto_repairable' END AS classification,
 CASE WHEN was.k IS NULL THEN source_object ELSE upper(source_object) END AS source_object,
 CASE WHEN now.k IS NULL THEN 'table_missing' WHEN was.k IS NULL THEN 'table_added' ELSE 'columns_changed' END AS code,
 COALESCE(was.cols, '') AS baseline_columns, COALESCE(now.cols, '') AS inventory_columns
 FROM allp LEFT JOIN was USING (k) LEFT JOIN now USING (k)
 WHERE (was.k IS NOT NULL AND now.k IS NULL) OR (was.k IS NULL AND now.k IS NOT NULL AND k % 25 < 20) OR (was.k IS NOT NULL AND now.k IS NOT NULL AND lower(was.cols) <> lower(now.cols)))"""
)


@query(f"WITH {DRIFT} SELECT * FROM issue")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.in_report_order(D.detect_drift(_baseline(spark, sf_dir), _today(spark, sf_dir)))


@query(
    f"""WITH {DRIFT} SELECT COUNT(*) AS issues, COUNT(*) > 0 AS drift_detected, COUNT(*) FILTER (WHERE classification = 'manual_required') > 0 AS needs_person,
 COUNT(*) > 0 AND COUNT(*) FILTER (WHERE classification = 'manual_required') = 0 AS repairable FROM issue"""
)
def drift_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.drift_decision(D.detect_drift(_baseline(spark, sf_dir), _today(spark, sf_dir)))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan line per part: most names exist, some are misspelt, short or malformed."""
    k = F.col("p_partkey")
    full = F.concat(F.lit("CRM.nation_"), (k % 25).cast("string"), F.lit(".T"), k.cast("string"))
    name = F.when(k % 13 == 1, F.concat(F.lit("dbo.t"), k.cast("string"))).when(k % 17 == 2, "t").when(k % 19 == 3, "").otherwise(full)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("chunk "), k.cast("string")).alias("label"), name.alias("source_object"))


@query(
    f"""WITH {DRIFT}, used AS (SELECT p_partkey AS k, 'chunk ' || p_partkey AS label,
 CASE WHEN p_partkey % 13 = 1 THEN 'dbo.t' || p_partkey WHEN p_partkey % 17 = 2 THEN 't' WHEN p_partkey % 19 = 3 THEN '' ELSE 'CRM.nation_' || (p_partkey % 25) || '.T' || p_partkey END AS source_object FROM part)
SELECT label, source_object, CASE WHEN source_object LIKE 'dbo%' OR now.k IS NULL THEN 'missing_from_catalog' WHEN was.k IS NULL THEN 'missing_from_baseline' ELSE 'columns_differ_from_baseline' END AS rule
FROM used LEFT JOIN now USING (k) LEFT JOIN was USING (k)
WHERE source_object NOT IN ('', 't') AND (source_object LIKE 'dbo%' OR now.k IS NULL OR was.k IS NULL OR lower(was.cols) <> lower(now.cols))"""
)
def plan_drift_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.check_objects(_objects(spark, sf_dir), _today(spark, sf_dir), _baseline(spark, sf_dir))


def _tracked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked tables as planned: every column but the computed ones, keyed by c1; some out of date."""
    k = F.col("p_partkey")
    numbers = F.sequence(F.lit(1).cast("long"), 3 + k % 4)
    live = F.filter(numbers, lambda i: (k + i) % 7 != 0)
    names = F.transform(live, lambda i: F.concat(F.lit("C"), i.cast("string")))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("crm.nation_"), (k % 25).cast("string"), F.lit(".t"), k.cast("string")).alias("source_object"),
        F.when(k % 12 == 1, F.array(F.lit("c1"))).otherwise(names).alias("columns"),
        F.when(k % 14 == 2, F.array(F.lit("c2"), F.lit("c1"))).otherwise(F.array(F.lit("C1"))).alias("key_columns"),
    )


@query(
    WITH
    + """, plan AS (SELECT p_partkey AS k, 'crm.nation_' || (p_partkey % 25) || '.t' || p_partkey AS source_object FROM part),
have AS (SELECT k, COUNT(*) FILTER (WHERE NOT computed) AS n, bool_or(ordinal = 1 AND NOT computed) AS first_live FROM cols GROUP BY k),
keyed AS (SELECT DISTINCT k FROM idx WHERE (primary_key OR "unique") AND NOT filtered AND len(columns) = 1)
SELECT source_object, 'missing_from_catalog' AS rule FROM plan WHERE k NOT IN (SELECT k FROM own)
UNION ALL SELECT source_object, 'columns_differ' FROM plan JOIN have USING (k) WHERE k % 12 = 1 AND NOT (n = 1 AND first_live)
UNION ALL SELECT source_object, 'key_differs' FROM plan JOIN own USING (k) WHERE k % 14 = 2 OR k NOT IN (SELECT k FROM keyed)"""
)
def plan_drift_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = inventory(spark, sf_dir)
    named = lambda df: df.withColumn("source_object", SCOPE.source_object())
    return D.check_tracked(_tracked_parts(spark, sf_dir), named(C.choose_columns(now.columns)), named(now.indexes))


@query(
    WITH
    + """SELECT 'import-' || p_partkey AS job_id, 'crm.nation_' || (p_partkey % 25) || '.t' || p_partkey AS source_object,
 CASE WHEN p_partkey % 50 = 49 THEN 'missing_from_catalog' ELSE 'fields_differ' END AS rule FROM part
WHERE p_partkey % 50 = 49 OR p_partkey % 4 <> 1"""
)
def plan_drift_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import jobs whose field list was written when every table had four columns."""
    k = F.col("p_partkey")
    jobs = table(spark, sf_dir, "part").select(
        F.concat(F.lit("import-"), k.cast("string")).alias("job_id"),
        F.concat(F.lit("crm.nation_"), (k % 25).cast("string"), F.lit(".t"), k.cast("string")).alias("source_object"),
        F.array(*[F.lit(f) for f in ("c1", "@skip", "C2", "c3", "c4")]).alias("fields"),
    )
    return D.check_fields(jobs, _today(spark, sf_dir))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("SELECT COUNT(*)\nFROM [crm].[dbo].[t"), k, F.lit("] a\tjoin (crm.dbo.`u"), k, F.lit('`) b ON 1 = 1 JOIN short c, FROM x..y JOIN "a"."b"."c";')
    )
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("check "), k).alias("label"), text.alias("source_sql"))


@query(
    """SELECT 'check ' || o_orderkey AS label, unnest(['crm.dbo.t' || o_orderkey, 'crm.dbo.u' || o_orderkey, 'a.b.c']) AS source_object FROM orders"""
)
def sql_source_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sql_objects(_statements(spark, sf_dir)).drop("source_sql")


# -- check plans ----------------------------------------------------------------------------------


def _check_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = inventory(spark, sf_dir)
    scope = C.project_scope(now.tables, SCOPE)
    return scope.join(by_key(C.numeric_columns(now.columns)), list(C.TABLE), "left").join(by_key(C.sample_column(now.columns)), list(C.TABLE), "left")


PLANNED = (
    SYS
    + f""", num AS (SELECT k, string_agg('COALESCE(CAST(`' || name || '` AS DECIMAL(38, 6)), 0)', ' + ' ORDER BY ordinal) AS terms FROM cols WHERE NOT computed AND {_BASE} IN {_NUMS} GROUP BY k),
smp AS (SELECT k, arg_min(name, ordinal) AS c FROM cols WHERE NOT computed AND {_BASE} IN {_INTS} GROUP BY k),
s AS (SELECT scoped.*, "schema" || '.' || "table" AS stem, '`crm`.`' || "schema" || '`.`' || "table" || '`' AS so, '`shop`.`' || "schema" || '_' || "table" || '`' AS tgt, terms, c
 FROM scoped LEFT JOIN num USING (k) LEFT JOIN smp USING (k)),
plan AS (SELECT stem || '.row-count' AS check_id, 'row_count' AS type, source_object, target_object, NULL AS source_sql, NULL AS target_sql FROM s
UNION ALL SELECT stem || '.checksum', 'checksum', source_object, target_object, 'SELECT COALESCE(SUM(' || terms || '), 0) FROM ' || so, 'SELECT COALESCE(SUM(' || terms || '), 0) FROM ' || tgt FROM s WHERE terms IS NOT NULL
UNION ALL SELECT stem || '.sampled-hash', 'sampled_hash', source_object, target_object, 'SELECT COALESCE(SUM(' || terms || '), 0) FROM ' || so || ' WHERE CAST(`' || c || '` AS BIGINT) % 100 = 0',
 'SELECT COALESCE(SUM(' || terms || '), 0) FROM ' || tgt || ' WHERE CAST(`' || c || '` AS BIGINT) % 100 = 0' FROM s WHERE terms IS NOT NULL AND c IS NOT NULL
UNION ALL SELECT stem || '.bucket-count.' || b, 'bucketed_count', source_object, target_object, 'SELECT COUNT(*) FROM ' || so || ' WHERE ABS(CAST(`' || c || '` AS BIGINT)) % 4 = ' || b,
 'SELECT COUNT(*) FROM ' || tgt || ' WHERE ABS(CAST(`' || c || '` AS BIGINT)) % 4 = ' || b FROM s, (SELECT range AS b FROM range(4)) WHERE c IS NOT NULL)"""
)


@query(f"WITH {PLANNED} SELECT * FROM plan")
def check_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.plan_checks(_check_scope(spark, sf_dir), bucketed=True, buckets=4)


@query(f"WITH {PLANNED} SELECT type, COUNT(*) AS checks, CAST(CASE type WHEN 'row_count' THEN 1 WHEN 'checksum' THEN 2 WHEN 'sampled_hash' THEN 3 ELSE 4 END AS INTEGER) AS place FROM plan GROUP BY type")
def check_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.check_type_summary(K.plan_checks(_check_scope(spark, sf_dir), bucketed=True, buckets=4))


def _written_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check per order, with the slips that people make when they edit plans."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("row_count", "row-count", "checksum", "business_sql", "other")]), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.when(k % 23 == 4, "").when(k % 29 == 5, "same").otherwise(F.concat(F.lit("id"), text)).alias("check_id"),
        kind.alias("type"),
        F.when(k % 31 == 6, "lonely").otherwise("db.dbo.t").alias("source_object"),
        F.when(k % 37 == 7, "").otherwise("shop.t").alias("target_object"),
        F.when(k % 41 == 8, "todo: split").alias("predicate"),
        F.lit(None).cast("string").alias("target_predicate"),
        F.when(k % 43 == 9, " ").otherwise("SELECT 1").alias("source_sql"),
        F.when(k % 47 == 10, "SELECT 1 -- Todo").otherwise("SELECT 1").alias("target_sql"),
    )


@query(
    """WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 23 = 4 THEN '' WHEN o_orderkey % 29 = 5 THEN 'same' ELSE 'id' || o_orderkey END AS check_id, o_orderkey % 5 AS t FROM orders),
o AS (SELECT * FROM c WHERE t < 4)
SELECT check_id, 'id_required' AS rule FROM o WHERE check_id = ''
UNION ALL SELECT check_id, 'source_malformed' FROM o WHERE t < 2 AND k % 31 = 6
UNION ALL SELECT check_id, 'target_required' FROM o WHERE t < 2 AND k % 37 = 7
UNION ALL SELECT check_id, 'predicate_unresolved' FROM o WHERE t < 2 AND k % 41 = 8
UNION ALL SELECT check_id, 'source_sql_required' FROM o WHERE t >= 2 AND k % 43 = 9
UNION ALL SELECT check_id, 'target_sql_unresolved' FROM o WHERE t >= 2 AND k % 47 = 10
UNION ALL SELECT check_id, 'id_repeated' FROM o WHERE check_id <> '' GROUP BY check_id HAVING COUNT(*) > 1"""
)
def check_plan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.validate_checks(_written_checks(spark, sf_dir))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, len(o_orderpriority) > 8 AS too_long, o_orderkey % 5 = 0 AS rounded
 FROM orders WHERE len(o_orderpriority) > 8 OR o_orderkey % 5 = 0"""
)
def conform_sized_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text beyond its column's length and numbers that a decimal column would round."""
    k = F.col("o_orderkey")
    price = F.concat(F.floor("o_totalprice").cast("string"), F.when(k % 5 == 0, ".125").otherwise(".120"))
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("o_orderkey"), price.alias("price"), "o_orderpriority")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("price", T.DecimalType(18, 2)), T.StructField("o_orderpriority", T.StringType())])
    _, bad = M.conform(rows, schema, {"o_orderpriority": 8}, exact=True)
    has = lambda name: F.array_contains("misfits", name)
    return bad.select("o_orderkey", has("o_orderpriority").alias("too_long"), has("price").alias("rounded"))
