"""Change feeds: decoding, reading a log range, net effect per key and applying it to a table.

The *net effect* of a set of changes holds one row per key:

``_last``   the newest change: position ``pos`` (lsn, seq, op), then the captured values ``row``
``_erased`` position of the newest delete, NULL when the key was never deleted

Both are maxima, so merging net effects is associative, commutative and idempotent. That lets
the map side pre-aggregate a hot key, lets a stream merge batches in any order, and makes a
replayed range a no-op.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.functions.scalars import strip
from movekit.functions.lsn import format_lsn, lsn_bytes, lsn_number, lsn_text_of_number, require_lsn
from movekit.session import stage

# Operation codes of a change row.
DELETE, INSERT, BEFORE, AFTER = 1, 2, 3, 4
META = ("op", "start_lsn", "seqval")

# A net effect within both limits is sent to the executors whole.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def decode_op(code: Column) -> Column:
    """``delete``, ``upsert`` or ``skip`` for an integer or numeric text; anything else fails."""
    number = strip(code.cast("string")).try_cast("int")
    return (
        F.when(number == DELETE, "delete")
        .when(number.isin(INSERT, AFTER), "upsert")
        .when(number == BEFORE, "skip")
        .otherwise(F.raise_error(F.concat(F.lit("unsupported operation "), F.coalesce(code.cast("string"), F.lit("NULL")))))
    )


def check_keys(keys: Sequence[str], columns: Sequence[str]) -> None:
    """Keys are present, unique without regard to case and part of the captured columns."""
    if not keys:
        raise ValueError("at least one key column is required")
    for label, names in (("key", keys), ("captured", columns)):
        lowered = [n.strip().lower() for n in names]
        if "" in lowered:
            raise ValueError(f"empty {label} column")
        if len(set(lowered)) != len(lowered):
            raise ValueError(f"duplicate {label} column")
    missing = {k.strip().lower() for k in keys} - {c.strip().lower() for c in columns}
    if missing:
        raise ValueError(f"key columns not captured: {sorted(missing)}")


def check_feed(feed: DataFrame, columns: Sequence[str]) -> None:
    """Operation, position and sequence come first, then the captured columns in order."""
    want = [*META, *columns]
    got = list(feed.columns)
    if [c.lower() for c in got] != [c.lower() for c in want]:
        raise ValueError(f"feed columns {got} do not match {want}")


def _binary(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.col(name) if isinstance(kind, T.BinaryType) else require_lsn(F.col(name), name)


def binary_positions(feed: DataFrame) -> DataFrame:
    """Positions as binary; a feed that stores them so keeps its filters pushed into the scan."""
    return feed.withColumns({c: _binary(feed, c) for c in META[1:]})


def check_range(from_lsn: str, to_lsn: str) -> None:
    if lsn_bytes(from_lsn, "from_lsn") > lsn_bytes(to_lsn, "to_lsn"):
        raise ValueError("from_lsn must be less than or equal to to_lsn")


def read_changes(feed: DataFrame, from_lsn: str, to_lsn: str, exclusive_lower: bool = False) -> DataFrame:
    """Changes of a log range, both ends included unless ``exclusive_lower``.

    Order matters only per key and is part of the aggregate in :func:`net_changes`, so
    nothing is sorted here.
    """
    check_range(from_lsn, to_lsn)
    lsn = F.col("start_lsn")
    start, end = F.lit(lsn_bytes(from_lsn)), F.lit(lsn_bytes(to_lsn))
    low = lsn > start if exclusive_lower else lsn >= start
    return binary_positions(feed).where(low & (lsn <= end))


def applied_count(feed: DataFrame) -> DataFrame:
    """Changes that are not before images, whatever number of rows they touch."""
    return feed.agg(F.count_if(decode_op(F.col("op")) != "skip").alias("applied_changes"))


def _values(keys: Sequence[str], columns: Sequence[str]) -> list[str]:
    lowered = {k.lower() for k in keys}
    return [c for c in columns if c.lower() not in lowered]


def net_changes(
    feed: DataFrame, keys: Sequence[str], columns: Sequence[str], count_as: str | None = None
) -> DataFrame:
    """Net effect per key of all changes in ``feed``; see the module text for its shape.

    ``count_as`` names an extra column with the number of changes behind each key.
    """
    check_keys(keys, columns)
    feed = binary_positions(feed)
    action = decode_op(F.col("op"))
    position = F.struct(
        F.col("start_lsn").alias("lsn"), F.col("seqval").alias("seq"), strip(F.col("op").cast("string")).cast("int").alias("op")
    )
    values = [F.col(c).alias(c) for c in _values(keys, columns)]
    solid = [F.coalesce(F.col(k), F.raise_error(F.lit(f"NULL key {k} in change feed"))).alias(k) for k in keys]
    changes = feed.where(action != "skip").select(
        *solid,
        F.struct(position.alias("pos"), *([F.struct(*values).alias("row")] if values else [])).alias("_last"),
        F.when(action == "delete", position).alias("_erased"),
    )
    return merge_net(changes, keys, count_as)


def merge_net(parts: DataFrame, keys: Sequence[str], count_as: str | None = None) -> DataFrame:
    """Combine net effects; ``max`` on structs compares the position first."""
    counted = [F.count(F.lit(1)).alias(count_as)] if count_as else []
    return parts.groupBy(*keys).agg(F.max("_last").alias("_last"), F.max("_erased").alias("_erased"), *counted)


def apply_net(
    target: DataFrame, net: DataFrame, keys: Sequence[str], columns: Sequence[str], broadcast: bool = False
) -> DataFrame:
    """The target table after a net effect.

    Upserts write the captured columns; columns outside the feed keep the old value unless the
    key was deleted in between. With ``broadcast`` (a net effect of proven small size) the
    target is never shuffled: it is scanned once for updates and once, keys only, to tell
    inserts from updates. Otherwise one full outer join does it with one shuffle per side.
    """
    key_names = {k.lower() for k in keys}
    values = {c.lower(): c for c in _values(keys, columns)}
    is_delete = F.col("_last.pos.op") == DELETE
    alive = F.col("_last").isNull() | ~is_delete

    def merged(f: T.StructField) -> Column:
        low = f.name.lower()
        if low in key_names:
            return F.col(f.name)
        if low in values:
            fresh = F.col("_last.row").getField(values[low]).cast(f.dataType)
            return F.when(F.col("_last").isNotNull(), fresh).otherwise(F.col(f.name)).alias(f.name)
        return F.when(F.col("_erased").isNull(), F.col(f.name)).alias(f.name)

    def inserted(f: T.StructField) -> Column:
        low = f.name.lower()
        if low in key_names:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        if low in values:
            return F.col("_last.row").getField(values[low]).cast(f.dataType).alias(f.name)
        return F.lit(None).cast(f.dataType).alias(f.name)

    if not broadcast:
        joined = target.join(net, list(keys), "full")
        return joined.where(alive).select(*[merged(f) for f in target.schema])

    small = F.broadcast(net)
    kept = target.join(small, list(keys), "left").where(alive).select(*[merged(f) for f in target.schema])
    hits = target.select(*keys).join(F.broadcast(net.select(*keys)), list(keys), "left_semi")
    fresh = net.where(~is_delete).join(hits, list(keys), "left_anti")
    return kept.unionByName(fresh.select(*[inserted(f) for f in target.schema]))


def moved_rows(
    target: DataFrame, net: DataFrame, keys: Sequence[str], columns: Sequence[str], broadcast: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The rows of a table that a net effect takes out, and those it puts in; rows of other keys are in neither.

    An update takes the old row out and puts the new one in; a change without effect does so with equal rows.
    """
    changed = F.broadcast(net.select(*keys)) if broadcast else net.select(*keys)
    out = target.join(changed, list(keys), "left_semi")
    return out, apply_net(out, net, keys, columns, broadcast)


def fits_broadcast(stored: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether stored data is small enough to broadcast.

    The row count comes from the file footers; only if that passes are the rows measured, as JSON
    text with names and NULLs, which is wider than the rows are in memory.
    """
    if stored.count() > rows:
        return False
    width = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return (stored.agg(F.sum(width.cast("long"))).head()[0] or 0) <= size


def apply_changes(
    target: DataFrame,
    feed: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    check_target: bool = False,
) -> DataFrame:
    """Apply a feed to a table.

    The net effect is written to shared storage first: it is used more than once, and its
    measured size decides between the broadcast and the shuffled join.
    ``target`` should be a stored table: write the result of one range before applying the next.
    ``check_target`` first makes sure that no key of the table is NULL or occurs twice, at the price
    of one aggregation over its keys; do so where no constraint of the target does.
    """
    check_feed(feed, columns)
    if check_target and (found := duplicate_keys(target, keys).head(3)):
        raise ValueError(f"target keys that are NULL or repeated, such as {[r.asDict() for r in found]}")
    net = stage(net_changes(feed, keys, columns), "net")
    return apply_net(target, net, keys, columns, broadcast=fits_broadcast(net, broadcast_rows))


def duplicate_keys(target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold NULL; upserts need a table where this is empty."""
    return (
        target.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    )


def lsn_bounds(feed: DataFrame, source: str, lsn: str = "start_lsn") -> DataFrame:
    """Lowest and highest position per source, and one ``feed`` row for the whole feed.

    The scan reduces to one row per source; only those rows roll up to the feed row.
    """
    number = lsn_number(_binary(feed, lsn))
    by_source = (
        feed.select(F.col(source), number.alias("_n"))
        .groupBy(source)
        .agg(F.min("_n").alias("_min"), F.max("_n").alias("_max"), F.count(F.lit(1)).alias("changes"))
    )
    return (
        by_source.rollup(source)
        .agg(F.min("_min").alias("_min"), F.max("_max").alias("_max"), F.sum("changes").alias("changes"), F.grouping(source).alias("_g"))
        .select(
            F.when(F.col("_g") == 1, "feed").otherwise("source").alias("level"),
            source,
            lsn_text_of_number(F.col("_min")).alias("min_lsn"),
            lsn_text_of_number(F.col("_max")).alias("max_lsn"),
            "changes",
        )
    )


def feed_head(feed: DataFrame, lsn: str = "start_lsn") -> DataFrame:
    """The feed-wide highest position as one row."""
    return feed.agg(format_lsn(F.max(_binary(feed, lsn))).alias("max_lsn"))

