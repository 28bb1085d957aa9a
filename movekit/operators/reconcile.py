"""Comparing a source table with its target: counts, exact-numeric sums, samples and buckets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.functions.scalars import EXACT, bucket_id, normalize_scalar, numeric_row_sum, sample_pred

DEFAULT_MODULO = 100
DEFAULT_BUCKETS = 16
MAX_BUCKETS = 1024


@dataclass(frozen=True)
class TableSpec:
    """What to compare: exact-numeric columns, the integer sampling column and both predicates."""

    numeric: Sequence[str] = ()
    key: str | None = None
    modulo: int = DEFAULT_MODULO
    buckets: int = DEFAULT_BUCKETS
    source_predicate: str | None = None
    target_predicate: str | None = None
    checks: Sequence[str] = field(default=("row_count", "checksum", "sampled_hash", "bucketed_count"))


def _where(df: DataFrame, predicate: str | None) -> DataFrame:
    return df.where(F.expr(predicate)) if predicate else df


def _bucket_limit(buckets: int) -> int:
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"bucket count must be between 1 and {MAX_BUCKETS}")
    return buckets


def _zero() -> Column:
    return F.lit(0).cast(EXACT)


_LIMBS = (0, 16, 32, 48)


@dataclass(frozen=True)
class ExactSum:
    """Sum over rows and columns of exact numbers, each read as DECIMAL(38,6) with NULL as 0.

    Wide decimals are slow to add row by row. Whole numbers, and decimals of up to 18 digits and
    six places taken as whole numbers of their last place, are cut into four 16-bit limbs that add
    up as plain longs (exact for 10^14 row-and-column cells). Longer decimals of at most six
    places are summed in their own type. All give the same number as widening every value first,
    which is what any other type gets.
    """

    fields: tuple[T.StructField, ...]

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str]) -> ExactSum:
        return ExactSum(tuple(df.select(c).schema[0] for c in columns))

    @staticmethod
    def _kind(dtype: T.DataType) -> int | str:
        """Decimal places for limbs, ``long`` for native decimals, ``wide`` for the rest."""
        if isinstance(dtype, T.IntegralType):
            return 0
        if isinstance(dtype, T.DecimalType) and 0 <= dtype.scale <= 6:
            return dtype.scale if dtype.precision <= 18 else "long"
        return "wide"

    @cached_property
    def cells(self) -> dict[str, Column]:
        """Narrow per-row columns to aggregate: ``limb_<places>_<bit>``, ``long_<n>`` and ``wide``."""
        out: dict[str, Column] = {}
        kinds = [(self._kind(f.dataType), f.name) for f in self.fields]
        for places in sorted({k for k, _ in kinds if isinstance(k, int)}):
            step = F.lit(10**places).cast(T.DecimalType(places + 1, 0))
            units = [F.col(n) if places == 0 else F.col(n) * step for k, n in kinds if k == places]
            longs = [F.coalesce(u.cast("long"), F.lit(0)) for u in units]
            for bit in _LIMBS:
                parts = [F.shiftright(v, bit) if bit == 48 else F.shiftright(v, bit).bitwiseAND(F.lit(0xFFFF)) for v in longs]
                out[f"limb_{places}_{bit}"] = reduce(add, parts)
        out |= {f"long_{i}": F.col(n) for i, (k, n) in enumerate(kinds) if k == "long"}
        wide = [F.col(n) for k, n in kinds if k == "wide"]
        if wide:
            out["wide"] = numeric_row_sum(wide)
        return out

    def sums(self, tag: str, where: Column | None = None) -> list[Column]:
        return [F.sum(F.col(c) if where is None else F.when(where, F.col(c))).alias(f"{tag}_{c}") for c in self.cells]

    def total(self, tag: str) -> Column:
        """The sum, from the columns that :meth:`sums` made."""
        by_places: dict[int, list[Column]] = {}
        rest = []
        for c in self.cells:
            value = F.col(f"{tag}_{c}")
            if not c.startswith("limb_"):
                rest.append(F.coalesce(value.cast(EXACT), _zero()))
                continue
            _, places, bit = c.split("_")
            weight = F.lit(1 << int(bit)).cast("decimal(15,0)")
            by_places.setdefault(int(places), []).append((F.coalesce(value, F.lit(0)).cast("decimal(19,0)") * weight).cast("decimal(38,0)"))
        for places, limbs in by_places.items():
            units = reduce(add, limbs).cast("decimal(38,0)")
            base = F.lit(10**places).cast(T.DecimalType(places + 1, 0))
            high = F.floor(units / base).cast("decimal(38,0)") if places else units
            low = (units - (high * base).cast("decimal(38,0)")).cast("decimal(7,0)") if places else F.lit(0).cast("decimal(7,0)")
            rest.append(high.cast(EXACT) + (low / base).cast(EXACT))
        return reduce(lambda x, y: (x + y).cast(EXACT), rest).cast(EXACT) if rest else _zero()


def _sum_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    exact = ExactSum.of(df, columns)
    return df.select(*[c.alias(n) for n, c in exact.cells.items()]).agg(*exact.sums("all")).select(exact.total("all").alias("v"))


def _pair(source: DataFrame, target: DataFrame, check: str) -> DataFrame:
    """Put two single-row results side by side as text values."""
    both = source.select(F.lit("s").alias("side"), F.col("v").cast("string").alias("v")).unionByName(
        target.select(F.lit("t").alias("side"), F.col("v").cast("string").alias("v"))
    )
    return both.agg(
        F.max(F.when(F.col("side") == "s", F.col("v"))).alias("source_value"),
        F.max(F.when(F.col("side") == "t", F.col("v"))).alias("target_value"),
    ).select(
        F.lit(check).alias("check"),
        "source_value",
        "target_value",
        F.col("source_value").eqNullSafe(F.col("target_value")).alias("matched"),
    )


def row_count_check(
    source: DataFrame, target: DataFrame, source_predicate: str | None = None, target_predicate: str | None = None
) -> DataFrame:
    count = F.count(F.lit(1)).alias("v")
    return _pair(
        _where(source, source_predicate).agg(count), _where(target, target_predicate).agg(count), "row_count"
    )


def checksum_check(
    source: DataFrame,
    target: DataFrame,
    columns: Sequence[str],
    source_predicate: str | None = None,
    target_predicate: str | None = None,
) -> DataFrame:
    if not columns:
        raise ValueError("a checksum needs at least one exact-numeric column")
    left, right = _where(source, source_predicate), _where(target, target_predicate)
    return _pair(_sum_row(left, columns), _sum_row(right, columns), "checksum")


def sampled_check(
    source: DataFrame, target: DataFrame, columns: Sequence[str], key: str, modulo: int = DEFAULT_MODULO
) -> DataFrame:
    if not columns:
        raise ValueError("a sampled sum needs at least one exact-numeric column")
    sampled = sample_pred(F.col(key), modulo)
    return _pair(_sum_row(source.where(sampled), columns), _sum_row(target.where(sampled), columns), "sampled_hash")


def bucket_counts(df: DataFrame, key: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Rows per bucket in one scan; the map side reduces to at most ``buckets`` rows per task."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(bucket_id(F.col(key), _bucket_limit(buckets)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bucketed_check(source: DataFrame, target: DataFrame, key: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """One row per bucket 0..n-1, also for buckets that hold nothing on one or both sides."""
    every = source.sparkSession.range(_bucket_limit(buckets)).withColumnRenamed("id", "bucket")
    left = bucket_counts(source, key, buckets).withColumnRenamed("n", "source_count")
    right = bucket_counts(target, key, buckets).withColumnRenamed("n", "target_count")
    return (
        every.join(left, "bucket", "left")
        .join(right, "bucket", "left")
        .select(
            "bucket",
            F.coalesce("source_count", F.lit(0)).alias("source_count"),
            F.coalesce("target_count", F.lit(0)).alias("target_count"),
            F.coalesce("source_count", F.lit(0)).eqNullSafe(F.coalesce("target_count", F.lit(0))).alias("matched"),
        )
    )


def _side(df: DataFrame, spec: TableSpec, side: str) -> DataFrame:
    """One table reduced to a row per bucket (NULL key = -1): n, total and sampled total."""
    exact = ExactSum.of(df, spec.numeric)
    key = F.col(spec.key) if spec.key else F.lit(None).cast("long")
    cells = df.select(
        F.coalesce(bucket_id(key, spec.buckets), F.lit(-1)).alias("bucket"),
        sample_pred(key, spec.modulo).alias("_in_sample"),
        *[c.alias(n) for n, c in exact.cells.items()],
    )
    sums = [*exact.sums("all"), *exact.sums("part", F.col("_in_sample"))]
    return cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *sums).select(
        F.lit(side).alias("side"), "bucket", "n", exact.total("all").alias("total"), exact.total("part").alias("sampled")
    )


def table_sums(df: DataFrame, spec: TableSpec, target: bool = False) -> DataFrame:
    """What all checks need of a table, at most ``buckets + 1`` rows: side, bucket, n, total, sampled.

    Sums are exact and so can be kept and moved by changes, see :func:`moved_sums`.
    """
    return _side(_where(df, spec.target_predicate if target else spec.source_predicate), spec, "t" if target else "s")


def moved_sums(sums: DataFrame, removed: DataFrame, added: DataFrame, spec: TableSpec, target: bool = False) -> DataFrame:
    """Kept sums after some rows left the table and others came, as :func:`moved_rows` gives them for a feed.

    Equal to :func:`table_sums` of the changed table, at the price of reading the moved rows alone.
    """
    out = table_sums(removed, spec, target)
    out = out.withColumns({c: -F.col(c) for c in ("n", "total", "sampled")})
    parts = sums.unionByName(out).unionByName(table_sums(added, spec, target))
    return parts.groupBy("side", "bucket").agg(*[F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in ("n", "total", "sampled")])


def reconcile(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """All of the table's checks from one scan per side.

    Both sides reduce to ``buckets + 1`` rows on the map side. Each bucket row then counts
    towards its own bucket check and towards the table totals. Output: check, source_value,
    target_value, matched; one row per table-level check and one per bucket
    (``bucketed_count.<b>``).
    """
    return reconcile_sums(table_sums(source, spec), table_sums(target, spec, target=True), spec)


def reconcile_sums(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """The report of :func:`reconcile` from the sums of both tables."""
    _bucket_limit(spec.buckets)
    wanted = set(spec.checks)
    if not spec.numeric:
        wanted -= {"checksum", "sampled_hash"}
    if not spec.key:
        wanted -= {"sampled_hash", "bucketed_count"}
    if not wanted:
        raise ValueError("no check applies to this table")

    reduced = source.unionByName(target)
    # Zero rows make empty tables and empty buckets show up with their zeros.
    nothing = source.sparkSession.range(-1, spec.buckets, 1, 1).select(
        F.lit("s").alias("side"),
        F.col("id").alias("bucket"),
        F.lit(0).cast("long").alias("n"),
        _zero().alias("total"),
        _zero().alias("sampled"),
    )

    def line(check: Column, value: Column, counts: bool) -> Column:
        return F.struct(check.alias("check"), F.lit(counts).alias("counts"), value.cast(EXACT).alias("v"))

    lines = [
        line(F.lit(name), F.col(c), c == "n")
        for name, c in (("row_count", "n"), ("checksum", "total"), ("sampled_hash", "sampled"))
        if name in wanted
    ]
    if "bucketed_count" in wanted:
        lines.append(line(F.concat(F.lit("bucketed_count."), F.col("bucket").cast("string")), F.col("n"), True))

    def side_value(side: str) -> Column:
        total = F.coalesce(F.sum(F.when(F.col("side") == side, F.col("v"))), _zero()).cast(EXACT)
        return F.when(F.first("counts"), total.cast("long").cast("string")).otherwise(total.cast("string"))

    return (
        reduced.unionByName(nothing)
        .select("side", F.inline(F.array(*lines)))
        .where("check <> 'bucketed_count.-1'")
        .groupBy("check")
        .agg(side_value("s").alias("source_value"), side_value("t").alias("target_value"))
        .withColumn("matched", F.col("source_value").eqNullSafe(F.col("target_value")))
    )


def single_scalar(df: DataFrame) -> str:
    """The only value of a one-row, one-column result, as comparison text."""
    if len(df.columns) != 1:
        raise ValueError(f"query must return one column, got {len(df.columns)}")
    rows = df.select(normalize_scalar(F.col(f"`{df.columns[0]}`"), df.schema[0].dataType).alias("v")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("query returned no row" if not rows else "query returned more than one row")
    return rows[0]["v"]


def _scalar_row(df: DataFrame) -> DataFrame:
    """Lazy form of :func:`single_scalar`; a wrong row count fails the job instead of the driver."""
    if len(df.columns) != 1:
        raise ValueError(f"query must return one column, got {len(df.columns)}")
    value = normalize_scalar(F.col(f"`{df.columns[0]}`"), df.schema[0].dataType)
    return df.select(value.alias("v")).limit(2).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).select(
        F.when(F.col("n") == 1, F.col("v"))
        .otherwise(F.raise_error(F.format_string("query returned %d rows, want 1", "n")))
        .alias("v")
    )


def sql_check(spark: SparkSession, source_sql: str, target_sql: str) -> DataFrame:
    """Two scalar statements over registered views, compared as text (``1.0`` differs from ``1.00``)."""
    return _pair(_scalar_row(spark.sql(source_sql)), _scalar_row(spark.sql(target_sql)), "business_sql")


def run_checks(results: Sequence[DataFrame]) -> DataFrame:
    """All comparison rows with a status; a failed check never hides the ones after it."""
    rows = results[0]
    for more in results[1:]:
        rows = rows.unionByName(more)
    return rows.withColumn("status", F.when(F.col("matched"), "passed").otherwise("failed"))


def checks_outcome(results: DataFrame) -> DataFrame:
    """Number of checks, failures and the overall status."""
    return results.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ).withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("passed"))
