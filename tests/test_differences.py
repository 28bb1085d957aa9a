"""Keys that differ between two tables, against a plain comparison."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from movekit.operators import differences as D

SCHEMA = "id long, kind string, name string, amount decimal(10,2)"


def plain(source, target):
    sides = []
    for rows in (source, target):
        by = defaultdict(Counter)
        for i, kind, *rest in rows:
            by[i, kind][tuple(rest)] += 1
        sides.append(by)
    s, t = sides
    return {(k, "missing" if k not in t else "extra" if k not in s else "changed", sum(s[k].values()) if k in s else 0, sum(t[k].values()) if k in t else 0) for k in {*s, *t} if s.get(k) != t.get(k)}


def found(df):
    return {((r["id"], r["kind"]), r["status"], r["source_rows"], r["target_rows"]) for r in df.collect()}


@pytest.mark.parametrize("bits", [0, 4, 12, None])
def test_keys_equal_a_plain_comparison(spark, bits):
    rng = random.Random(3)
    source = [(rng.choice([None, *range(900)]), rng.choice(["", None, "x"]), rng.choice([None, "", "n", "v", '","']), rng.randrange(500)) for _ in range(3000)]
    target = [(i, k, n, a + (j % 211 == 0)) for j, (i, k, n, a) in enumerate(source) if j % 97] + [(5000 + j, "x", "new", j) for j in range(9)] + source[:4]
    s, t = spark.createDataFrame([(*r[:3], None) for r in source], SCHEMA), spark.createDataFrame([(*r[:3], None) for r in target], SCHEMA)
    s, t = (spark.createDataFrame(rows, "id long, kind string, name string, amount long") for rows in (source, target))
    assert found(D.differing_keys(s, t, ["id", "kind"], bits=bits)) == plain(source, target)
    wide = t.select(F.col("id").cast("decimal(20,0)").alias("id"), "kind", F.lit(1).alias("more"), "amount", "name")
    assert found(D.differing_keys(s, wide, ["id", "kind"], bits=bits)) == plain(source, target)
    assert D.differing_keys(s, s, ["id", "kind"], bits=bits).count() == 0


def test_descent_reads_only_below_what_differs(spark):
    s = spark.range(40_000).select("id", (F.col("id") % 7).alias("v"))
    t = s.withColumn("v", F.when(F.col("id") == 777, 9).otherwise(F.col("v")))
    assert D.leaf_bits(40_000) == 8 and D.leaf_bits(0) == 0 and D.leaf_bits(10**12) == 28
    trees = [D.digest_tree(x, ["id"], ["v"], 8) for x in (s, t)]
    assert {r["level"]: r["count"] for r in trees[0].groupBy("level").count().collect()} == {0: 1, 1: 16, 2: 256}
    assert D.differing_leaves(*trees, 8).count() == 1
    got = D.differing_keys(s, t, ["id"])
    assert [tuple(r) for r in got.collect()] == [(777, "changed", 1, 1)]


def test_empty_sides(spark):
    s = spark.createDataFrame([(1, "a", "b", None)], SCHEMA)
    assert found(D.differing_keys(s, s.limit(0), ["id", "kind"])) == {((1, "a"), "missing", 1, 0)}
    assert found(D.differing_keys(s.limit(0), s, ["id", "kind"])) == {((1, "a"), "extra", 0, 1)}
    assert D.differing_keys(s.limit(0), s.limit(0), ["id", "kind"]).count() == 0
    with pytest.raises(ValueError, match="key"):
        D.differing_keys(s, s, [])
