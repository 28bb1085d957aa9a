"""Mapping source column types to target and Spark types, and casting tables accordingly."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.functions.scalars import strip, type_param

# Source type -> (target type, Spark type, review code). ``(n)`` takes the source's
# parameter, ``(n|255)`` falls back to 255 and turns ``max`` into TEXT, ``(b)`` falls back to BLOB.
RULES = {
    "bigint": ("BIGINT", "bigint", ""),
    "int": ("INT", "int", ""),
    "smallint": ("SMALLINT", "smallint", ""),
    "tinyint": ("TINYINT", "smallint", ""),
    "bit": ("TINYINT(1)", "boolean", ""),
    "decimal": ("DECIMAL(n)", "decimal(n)", ""),
    "numeric": ("DECIMAL(n)", "decimal(n)", ""),
    "money": ("DECIMAL(19,4)", "decimal(19,4)", ""),
    "smallmoney": ("DECIMAL(10,4)", "decimal(10,4)", ""),
    "float": ("DOUBLE", "double", ""),
    "real": ("FLOAT", "float", ""),
    "char": ("CHAR(n|255)", "string", ""),
    "nchar": ("CHAR(n|255)", "string", ""),
    "varchar": ("VARCHAR(n|255)", "string", ""),
    "nvarchar": ("VARCHAR(n|255)", "string", ""),
    "text": ("TEXT", "string", ""),
    "ntext": ("TEXT", "string", ""),
    "date": ("DATE", "date", ""),
    "datetime": ("DATETIME", "timestamp_ntz", ""),
    "datetime2": ("DATETIME", "timestamp_ntz", ""),
    "smalldatetime": ("DATETIME", "timestamp_ntz", ""),
    "datetimeoffset": ("DATETIME", "timestamp", "type_offset"),
    "time": ("TIME", "string", ""),
    "binary": ("BINARY(b)", "binary", ""),
    "varbinary": ("VARBINARY(b)", "binary", ""),
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
UNMAPPED = ("TEXT", "string", "type_unmapped")
COMPUTED = "computed_column"
NOTES = {
    "type_offset": "The offset is lost in the target type.",
    "type_xml": "Needs a chosen text or document form.",
    "type_rowversion": "Has no counterpart; versions must come from the application.",
    "type_variant": "Needs one declared type.",
    "type_hierarchy": "Needs an encoding of the path.",
    "type_spatial": "Needs a spatial encoding.",
    "type_unmapped": "No rule for this type.",
}
COMPUTED_NOTE = "The expression must be reviewed."


def _lookup(base: Column, at: int) -> Column:
    pairs = [F.lit(x) for name, rule in RULES.items() for x in (name, rule[at])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), base), F.lit(UNMAPPED[at]))


def _base(text: Column) -> Column:
    head = F.substring_index(F.lower(strip(text)), "(", 1)
    return strip(F.regexp_extract(head, r"^\s*(\S*)", 1))


def full_type(columns: DataFrame) -> Column:
    """Type text with its declared size, from max_length/precision/scale; bytes become characters
    for national types and a negative length means ``max``."""
    name, length = F.lower(strip("type")), F.col("max_length")
    chars = F.when(length < 0, "max").otherwise(
        F.when(name.isin("nchar", "nvarchar"), (length / 2).cast("int")).otherwise(length.cast("int")).cast("string")
    )
    return (
        F.when(F.col("type").contains("("), F.col("type"))
        .when(name.isin("decimal", "numeric") & F.col("precision").isNotNull(), F.format_string("%s(%d,%d)", "type", "precision", "scale"))
        .when(name.isin("char", "nchar", "varchar", "nvarchar", "binary", "varbinary") & length.isNotNull(), F.concat("type", F.lit("("), chars, F.lit(")")))
        .otherwise(F.col("type"))
    )


def map_types(columns: DataFrame, sized: bool = False) -> DataFrame:
    """Adds target_type, spark_type, manual_review, code, note and warning to a columns frame.

    With ``sized`` the declared sizes of the extract complete a bare type name.
    """
    text = full_type(columns) if sized else F.col("type")
    base, param = _base(text), type_param(text)
    target, spark, code = (_lookup(base, i) for i in range(3))
    stem = F.regexp_replace(target, r"\((n|n\|255|b)\)$", "")
    no_param, is_max = param == "", F.lower(param) == "max"
    with_param = F.concat(stem, F.lit("("), param, F.lit(")"))
    target_type = (
        F.when(target.endswith("(n)"), F.when(no_param, stem).otherwise(with_param))
        .when(target.endswith("(n|255)"), F.when(is_max, "TEXT").when(no_param, F.concat(stem, F.lit("(255)"))).otherwise(with_param))
        .when(target.endswith("(b)"), F.when(no_param | is_max, "BLOB").otherwise(with_param))
        .otherwise(target)
    )
    spark_type = F.when(spark == "decimal(n)", F.when(no_param, "decimal(38,6)").otherwise(F.concat(F.lit("decimal("), F.regexp_replace(param, r"\s", ""), F.lit(")")))).otherwise(spark)
    note = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv]), code), F.lit(""))
    computed = F.col("computed")
    review = (code != "") | computed
    return columns.withColumns(
        {
            "target_type": target_type,
            "spark_type": spark_type,
            "manual_review": review,
            "code": F.when((code == "") & computed, COMPUTED).otherwise(code),
            "note": strip(F.concat_ws(" ", note, F.when(computed, F.lit(COMPUTED_NOTE)))),
            "warning": F.when(base == "tinyint", "unsigned source, signed target")
            .when(spark.startswith("decimal(n") & no_param, "precision unknown")
            .otherwise(""),
        }
    )


def schema_diff(mapped: DataFrame, ids: tuple[str, ...] = ("source_object", "target_object")) -> DataFrame:
    """Per table: ordered column mappings, whether it needs review and how many items do."""
    item = F.struct("ordinal", "name", "type", "target_type", "manual_review", "code", "note")
    return mapped.groupBy(*ids).agg(
        F.array_sort(F.collect_list(item)).alias("columns"),
        F.bool_or("manual_review").alias("manual_review"),
        F.count_if("manual_review").alias("manual_items"),
    )


def schema_diff_summary(mapped: DataFrame) -> DataFrame:
    """Tables, columns and manual items over all tables."""
    by_table = mapped.groupBy("source_object").agg(F.count(F.lit(1)).alias("c"), F.count_if("manual_review").alias("m"))
    return by_table.agg(
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("columns"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("manual_items"),
    )


def target_schema(mapped_table: DataFrame) -> T.StructType:
    """Spark schema of one table from its mapped columns (one row per column of that table)."""
    rows = mapped_table.select("ordinal", "name", "spark_type").orderBy("ordinal").collect()
    return T.StructType([T.StructField(r["name"], T.DataType.fromDDL(r["spark_type"])) for r in rows])


def conform(
    df: DataFrame, schema: T.StructType, lengths: Mapping[str, int] | None = None, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows cast to ``schema``, rejected text rows with the columns that did not fit).

    ``lengths`` bounds the characters of text columns, as the n of char(n) and varchar(n) does. With
    ``exact`` a number that its decimal column would round does not fit either.
    Both results come from the same expressions over one scan each; nothing is dropped.
    """
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema}

    def wrong(field: T.StructField) -> Column:
        text, value = F.col(f"`{field.name}`"), cast[field.name]
        bad = text.isNotNull() & value.isNull()
        if lengths and field.name in lengths:
            bad = bad | F.coalesce(F.length(text) > lengths[field.name], F.lit(False))
        if exact and isinstance(field.dataType, T.DecimalType):
            digits = rf"\.\d{{{field.dataType.scale}}}\d*[1-9]"
            bad = bad | F.coalesce(text.cast("string").rlike(digits), F.lit(False))
        return bad

    misfits = F.filter(F.array(*[F.when(wrong(f), F.lit(f.name)) for f in schema]), lambda x: x.isNotNull())
    marked = df.withColumn("_misfits", misfits)
    good = marked.where(F.size("_misfits") == 0).select(*[c.alias(n) for n, c in cast.items()])
    bad = marked.where(F.size("_misfits") > 0).withColumnRenamed("_misfits", "misfits")
    return good, bad


def truncated_fractions(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many time texts of each column carry more than the six digits a timestamp keeps."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").rlike(r"\.\d{6}\d*[1-9]")).alias(c) for c in columns])
