"""Source catalogs: from system-table extracts to flat inventory frames and per-table documents.

Inventory frames carry ``database, schema`` and, except routines, ``table``:
``tables(row_count)``, ``columns(ordinal, name, type, identity, computed)``,
``indexes(position, name, columns[], unique, primary_key, filtered, included_columns[])``,
``triggers(name)``, ``routines(name, type)``.
Frames of tables and of their parts meet by their keys in a shuffle; only types and schemas may be broadcast.
Per-table lists are bounded by what the source server allows in one table (its column limit).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movekit.functions.scalars import blank, strip, type_base
from movekit.session import by_key

Sys = Mapping[str, DataFrame]
TABLE = ("database", "schema", "table")

# Object types that count as routines, and type names for checks on numbers.
ROUTINES = ("P", "FN", "IF", "TF")
INTEGERS = ("bigint", "int", "smallint", "tinyint")
EXACT_NUMERIC = (*INTEGERS, "decimal", "numeric", "money", "smallmoney")
INVENTORY_STATES = ("", "pending", "discovered")


def _own_tables(sys: Sys, database: str) -> DataFrame:
    """User tables with their schema name."""
    tables = sys["tables"].where("is_ms_shipped = false").select("object_id", "schema_id", F.col("name").alias("table"))
    schemas = sys["schemas"].select("schema_id", F.col("name").alias("schema"))
    return tables.join(schemas, "schema_id").select("object_id", F.lit(database).alias("database"), "schema", "table")


def catalog_tables(sys: Sys, database: str) -> DataFrame:
    """Tables with their rows, summed over heap and clustered partitions.

    Partitions reduce to one row per object before the join, so the join never multiplies rows.
    """
    rows = sys["partitions"].where("index_id IN (0, 1)").groupBy("object_id").agg(F.sum("rows").alias("row_count"))
    return (
        _own_tables(sys, database)
        .join(by_key(rows), "object_id", "left")
        .groupBy(*TABLE)
        .agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))
    )


def catalog_columns(sys: Sys, database: str) -> DataFrame:
    """Columns in order, with declared sizes where the extract has them."""
    types = sys["types"].select("user_type_id", F.col("name").alias("type"))
    sizes = [c for c in ("max_length", "precision", "scale") if c in sys["columns"].columns]
    return (
        sys["columns"]
        .join(by_key(_own_tables(sys, database)), "object_id")
        .join(types, "user_type_id")
        .select(
            *TABLE,
            F.col("column_id").alias("ordinal"),
            "name",
            "type",
            F.col("is_identity").alias("identity"),
            F.col("is_computed").alias("computed"),
            *sizes,
        )
    )


def _ordered(item: Column, keep: Column) -> Column:
    """Names of one index kind in catalog order."""
    picked = F.array_sort(F.collect_list(F.when(keep, item)))
    return F.transform(picked, lambda x: x["name"])


def catalog_indexes(sys: Sys, database: str) -> DataFrame:
    """Indexes with ordered key columns and included columns; unnamed and hypothetical ones are left out."""
    columns = sys["columns"].select("object_id", "column_id", F.col("name").alias("_column"))
    parts = sys["index_columns"].join(by_key(columns), ["object_id", "column_id"], "left")
    named = sys["indexes"].where("name IS NOT NULL AND is_hypothetical = false")
    rows = named.join(by_key(_own_tables(sys, database)), "object_id").join(by_key(parts), ["object_id", "index_id"], "left")
    item = F.struct("key_ordinal", "index_column_id", F.col("_column").alias("name"))
    present = F.col("_column").isNotNull()
    return (
        rows.groupBy(*TABLE, "name")
        .agg(
            F.min("index_id").alias("position"),
            F.bool_or("is_unique").alias("unique"),
            F.bool_or("is_primary_key").alias("primary_key"),
            F.bool_or("has_filter").alias("filtered"),
            _ordered(item, present & ~F.col("is_included_column")).alias("columns"),
            _ordered(item, present & F.col("is_included_column")).alias("included_columns"),
        )
        .select(*TABLE, "position", "name", "columns", "unique", "primary_key", "filtered", "included_columns")
    )


def catalog_triggers(sys: Sys, database: str) -> DataFrame:
    triggers = sys["triggers"].select(F.col("parent_id").alias("object_id"), "name")
    return triggers.join(by_key(_own_tables(sys, database)), "object_id").select(*TABLE, "name")


def catalog_routines(sys: Sys, database: str) -> DataFrame:
    schemas = sys["schemas"].select("schema_id", F.col("name").alias("schema"))
    own = sys["objects"].where(strip("type").isin(*ROUTINES) & ~F.col("is_ms_shipped"))
    return own.join(schemas, "schema_id").select(
        F.lit(database).alias("database"), "schema", "name", F.col("type_desc").alias("type")
    )


@dataclass(frozen=True)
class Inventory:
    """The five flat frames of a catalog."""

    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame
    triggers: DataFrame
    routines: DataFrame


def read_catalog(sys: Sys, database: str) -> Inventory:
    return Inventory(
        catalog_tables(sys, database),
        catalog_columns(sys, database),
        catalog_indexes(sys, database),
        catalog_triggers(sys, database),
        catalog_routines(sys, database),
    )


_COLUMN = "struct<name:string,type:string,identity:boolean,computed:boolean>"
_INDEX = "struct<name:string,columns:array<string>,unique:boolean,primary_key:boolean,filtered:boolean,included_columns:array<string>>"
DOCUMENT = (
    "status string, databases array<struct<name:string,schemas:array<struct<name:string,"
    f"tables:array<struct<name:string,row_count:bigint,columns:array<{_COLUMN}>,indexes:array<{_INDEX}>,"
    "triggers:array<struct<name:string>>>>,routines:array<struct<name:string,type:string>>>>>>"
)


def read_inventory(spark: SparkSession, path: str, multiline: bool = True) -> Inventory:
    """Inventory documents (nested JSON) as flat frames; an unknown document status fails.

    ``multiline`` reads pretty-printed files, one document each; without it every line is a
    document and large files split.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", str(multiline).lower()).json(path)
    status = strip(F.coalesce("status", F.lit("")))
    checked = F.when(status.isin(*INVENTORY_STATES), status).otherwise(
        F.raise_error(F.concat(F.lit("unsupported inventory status "), status))
    )
    schemas = (
        docs.select(checked.alias("status"), F.explode("databases").alias("d"))
        .where(F.col("status").isNotNull())
        .select(F.col("d.name").alias("database"), F.explode("d.schemas").alias("s"))
    )
    tables = schemas.select("database", F.col("s.name").alias("schema"), F.explode("s.tables").alias("t"))
    head = [F.col("database"), F.col("schema"), F.col("t.name").alias("table")]
    no = lambda name: F.coalesce(F.col(name), F.lit(False))
    none = F.array().cast("array<string>")
    columns = tables.select(*head, F.posexplode("t.columns").alias("i", "c"))
    indexes = tables.select(*head, F.posexplode("t.indexes").alias("i", "x"))
    return Inventory(
        tables.select(*head, F.coalesce("t.row_count", F.lit(0)).alias("row_count")),
        columns.select(
            *TABLE,
            (F.col("i") + 1).alias("ordinal"),
            "c.name",
            "c.type",
            no("c.identity").alias("identity"),
            no("c.computed").alias("computed"),
        ),
        indexes.select(
            *TABLE,
            (F.col("i") + 1).alias("position"),
            "x.name",
            F.coalesce("x.columns", none).alias("columns"),
            no("x.unique").alias("unique"),
            no("x.primary_key").alias("primary_key"),
            no("x.filtered").alias("filtered"),
            F.coalesce("x.included_columns", none).alias("included_columns"),
        ),
        tables.select(*head, F.explode("t.triggers.name").alias("name")),
        schemas.select("database", F.col("s.name").alias("schema"), F.inline("s.routines")),
    )


def table_documents(inventory: Inventory) -> DataFrame:
    """One nested document per table, columns and indexes in order.

    The whole inventory is the set of these rows sorted by database, schema and table; it is kept
    as rows (JSON lines) so that no single value has to hold a whole schema.
    """
    columns = inventory.columns.groupBy(*TABLE).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "name", "type", "identity", "computed"))).alias("columns")
    )
    indexes = inventory.indexes.groupBy(*TABLE).agg(
        F.array_sort(
            F.collect_list(F.struct("name", "columns", "unique", "primary_key", "filtered", "included_columns"))
        ).alias("indexes")
    )
    triggers = inventory.triggers.groupBy(*TABLE).agg(F.array_sort(F.collect_list("name")).alias("triggers"))
    joined = inventory.tables
    for part in (columns, indexes, triggers):
        joined = joined.join(by_key(part), list(TABLE), "left")
    empty = lambda c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)).alias(c)
    return joined.select(*TABLE, "row_count", *[empty(c) for c in ("columns", "indexes", "triggers")])


def inventory_stats(inventory: Inventory) -> DataFrame:
    """Databases, tables and columns, each counted after per-database reduction."""
    tables = inventory.tables.groupBy("database").agg(F.count(F.lit(1)).alias("t"), F.lit(0).cast("long").alias("c"))
    columns = inventory.columns.groupBy("database").agg(F.lit(0).cast("long").alias("t"), F.count(F.lit(1)).alias("c"))
    by_database = tables.unionByName(columns).groupBy("database").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    return by_database.agg(
        F.count(F.lit(1)).alias("databases"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tables"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("columns"),
    )


@dataclass(frozen=True)
class Scope:
    """What a project moves: one database, some of its schemas, one target database."""

    database: str
    schemas: Sequence[str]
    target: str
    mode: str = "online"

    def contains(self) -> Column:
        lowered = [s.strip().lower() for s in self.schemas]
        return (F.lower("database") == self.database.strip().lower()) & F.lower("schema").isin(*lowered)

    def source_object(self) -> Column:
        return F.concat_ws(".", "database", "schema", "table")

    def target_object(self) -> Column:
        table = F.concat_ws("_", "schema", "table") if len(self.schemas) > 1 else F.col("table")
        return F.concat_ws(".", F.lit(self.target), table)


def project_scope(frame: DataFrame, scope: Scope) -> DataFrame:
    """Rows of the project with their source and target object names."""
    if not scope.database.strip() or not scope.schemas or not scope.target.strip():
        raise ValueError("a project needs a source database, source schemas and a target database")
    return frame.where(scope.contains()).withColumns(
        {"source_object": scope.source_object(), "target_object": scope.target_object()}
    )


def choose_keys(indexes: DataFrame) -> DataFrame:
    """Key columns per table: first unfiltered primary key, else first unfiltered unique index."""
    usable = indexes.where(
        (F.col("primary_key") | F.col("unique")) & ~F.col("filtered") & (F.size("columns") > 0)
    )
    rank = F.struct(~F.col("primary_key"), F.col("position"), F.col("name"))
    return usable.groupBy(*TABLE).agg(F.min_by("columns", rank).alias("key_columns"))


def choose_columns(columns: DataFrame) -> DataFrame:
    """Captured columns per table: named, not computed, in order."""
    kept = columns.where(~blank(F.col("name")) & ~F.col("computed"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", strip("name").alias("name"))))
    return kept.groupBy(*TABLE).agg(F.transform(ordered, lambda x: x["name"]).alias("columns"))


def numeric_columns(columns: DataFrame) -> DataFrame:
    """Exact-numeric, not computed columns per table, in order."""
    kept = columns.where(~F.col("computed") & type_base(F.col("type")).isin(*EXACT_NUMERIC))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "name")))
    return kept.groupBy(*TABLE).agg(F.transform(ordered, lambda x: x["name"]).alias("numeric_columns"))


def sample_column(columns: DataFrame) -> DataFrame:
    """First integer column per table; sampling and buckets hang on it."""
    kept = columns.where(~F.col("computed") & type_base(F.col("type")).isin(*INTEGERS))
    return kept.groupBy(*TABLE).agg(F.min_by("name", "ordinal").alias("sample_column"))


