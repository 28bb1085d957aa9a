"""From a difference between two tables to the keys that differ.

Rows fall into leaves by a hash of their key, and a leaf has a digest: its rows and the sums of two independent hashes of
their text. Leaves roll up into a tree whose nodes are the sums below them. Two tables are compared from the root
down, only below nodes that differ, and only rows of differing leaves are brought together. A stored tree can
stand for a table that is far away or has changed since.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.functions.scalars import render
from movekit.session import stage

#: Bits of the key's hash that one level of the tree adds; rows of a leaf are about ``LEAF_ROWS``.
STEP, LEAF_ROWS, MOST_BITS = 4, 256, 28
SUMS = ("n", "a_low", "a_high", "b_low", "b_high")


def _text(df: DataFrame, columns: Sequence[str]) -> Column:
    """The rendered values of some columns, NULL and empty text apart."""
    kinds = {f.name.lower(): f.dataType for f in df.schema}
    parts = [F.coalesce(F.concat(F.lit("v"), render(F.col(c), kinds[c.lower()])), F.lit("n")) for c in columns]
    return F.to_json(F.array(*parts))


def _hashed(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row's key hash and the halves of its two row hashes; halves add up exactly in 64 bits for 2^31 rows of a leaf."""
    row = _text(df, [*keys, *columns])
    a, b = F.xxhash64(F.lit("a"), row), F.xxhash64(row, F.lit("b"))
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda h: F.shiftrightunsigned(h, 32)
    return df.select(
        *keys, F.xxhash64(_text(df, keys)).alias("_hash"), low(a).alias("a_low"), high(a).alias("a_high"), low(b).alias("b_low"), high(b).alias("b_high")
    )


def _added(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    n = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), *[F.sum(c).alias(c) for c in SUMS[1:]])


def leaf_bits(rows: int) -> int:
    """Bits of the leaves for a table of so many rows, a whole number of levels."""
    return min(MOST_BITS, STEP * math.ceil(max(0.0, math.log2(max(rows, 1) / LEAF_ROWS)) / STEP))


def digest_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str], bits: int) -> DataFrame:
    """``level, node`` and the sums of each node that has rows: the leaves from one scan, all above from the leaves."""
    leaves = _hashed(df, keys, columns).withColumn("node", F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0).cast("long"))
    levels = [stage(_added(leaves, ["node"]), "digest-level")]
    for _ in range(bits // STEP):
        above = levels[-1].withColumn("node", F.shiftrightunsigned("node", STEP))
        levels.append(stage(_added(above, ["node"]), "digest-level"))
    marked = [level.select(F.lit(i).alias("level"), "node", *SUMS) for i, level in enumerate(reversed(levels))]
    return reduce(DataFrame.unionByName, marked)


def differing_leaves(source: DataFrame, target: DataFrame, bits: int) -> DataFrame:
    """Leaves whose sums differ, found from the root down; nodes below equal ones are never compared."""
    frontier = None
    for level in range(bits // STEP + 1):
        s, t = (tree.where(F.col("level") == level).select("node", F.struct(*SUMS).alias(name)) for tree, name in ((source, "s"), (target, "t")))
        if frontier is not None:
            parent = frontier.select(F.col("node").alias("parent"))
            s, t = (x.join(parent, F.shiftrightunsigned(x["node"], STEP) == F.col("parent"), "left_semi") for x in (s, t))
        frontier = stage(s.join(t, "node", "full").where(~F.col("s").eqNullSafe(F.col("t"))).select("node"), "digest-frontier")
        if frontier.isEmpty():
            break
    return frontier


def differing_keys(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, bits: int | None = None
) -> DataFrame:
    """``keys, status, source_rows, target_rows`` of every key whose rows differ: ``missing`` in the target, ``extra`` there, or
    ``changed`` (other values, or another number of rows).

    ``columns`` are compared as text, so types may differ; by default all but the keys that both tables have. NULL
    keys are keys like any other. Each table is scanned twice, pre-aggregated to leaves and then filtered to those
    that differ: what is shuffled follows the number of leaves and of rows in differing ones. Two different sets of rows are
    taken for equal only if two 64-bit sums agree by chance.
    """
    if not keys:
        raise ValueError("at least one key column is required")
    lowered = {k.lower() for k in keys}
    have = {c.lower() for c in target.columns}
    columns = [c for c in source.columns if c.lower() in have and c.lower() not in lowered] if columns is None else list(columns)
    if bits is None:
        bits = leaf_bits(max(source.count(), target.count()))
    leaves = differing_leaves(digest_tree(source, keys, columns, bits), digest_tree(target, keys, columns, bits), bits)

    def suspects(df: DataFrame, name: str) -> DataFrame:
        rows = _hashed(df, keys, columns)
        rows = rows.withColumn("node", F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0).cast("long")).join(leaves, "node", "left_semi")
        return _added(rows, [F.col(k).alias(f"{name}_{i}") for i, k in enumerate(keys)]).withColumnRenamed("n", f"{name}_rows").withColumn(name, F.struct(f"{name}_rows", *SUMS[1:])).drop(*SUMS[1:])

    s, t = suspects(source, "s"), suspects(target, "t")
    # Keys meet as text, so that types may differ on the two sides.
    texts = lambda df, name: F.array(*[F.coalesce(F.concat(F.lit("v"), render(F.col(f"{name}_{i}"), df.schema[f"{name}_{i}"].dataType)), F.lit("n")) for i in range(len(keys))])
    both = s.withColumn("key", texts(s, "s")).join(t.withColumn("key", texts(t, "t")), "key", "full")
    differ = both.where(~F.col("s").eqNullSafe(F.col("t")))
    kinds = {f.name.lower(): f.dataType for f in source.schema}
    status = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").otherwise("changed")
    return differ.select(
        *[F.when(F.col("s").isNotNull(), F.col(f"s_{i}")).otherwise(F.col(f"t_{i}").cast(kinds[k.lower()])).alias(k) for i, k in enumerate(keys)],
        status.alias("status"),
        F.coalesce("s_rows", F.lit(0)).alias("source_rows"),
        F.coalesce("t_rows", F.lit(0)).alias("target_rows"),
    )
