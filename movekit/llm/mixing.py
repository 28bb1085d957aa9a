"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from movekit.llm.common import n_words, narrow, shuffle_width
from movekit.session import stage


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Sources by code point, null last, take the weights in turn and share ``share`` of all sizes; no
    target exceeds ``limit`` times its source's size, what is above is shared anew by weight. The
    fixed point of that is ``min(cap, level * weight)`` for one level, which falls out of one pass over
    the sources ordered by ``cap / weight``: one row per source, whatever the number of documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # The first source whose cap is above its part of what is left sets the level for it and all after it.
    level = F.when(F.col("cap") * F.col("weights_left") > F.col("left") * F.col("weight"), F.col("left") / F.col("weights_left"))
    per = per.withColumn("level", F.first(level, ignorenulls=True).over(filled.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _coin(ids: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the id and the seed alone."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(a: float, p: float, b: float, q: float, coin: float) -> tuple[float, float]:
    """Move words between two items of sizes ``a`` and ``b`` until one probability is 0 or 1.

    ``a * p + b * q`` stays as it is, and so do the expected values of both.
    """
    mass = a * p + b * q
    up = (1.0, (mass - a) / b) if mass >= a else (mass / a, 0.0)
    down = (0.0, mass / b) if mass <= b else ((mass - b) / a, 1.0)
    if up[0] - down[0] <= 1e-15:
        return up
    return up if coin < (p - down[0]) / (up[0] - down[0]) else down


def round_block(ids: np.ndarray, sizes: np.ndarray, p: float, seed: int) -> tuple[np.ndarray, int, float]:
    """Round one block of items with the same fraction ``p``: (0 or 1 per item, residual, its fraction).

    The heaviest item is paired with all lighter ones as one item, whose members keep one common
    fraction. One of the two becomes integral, so the pool's last and lightest member is the residual
    (-1: none is left).
    """
    take, n = np.zeros(len(ids), np.int64), len(ids)
    order = np.lexsort((ids, -sizes))
    pool, coins = float(sizes.sum()), _coin(ids, seed)
    for k, i in enumerate(order):
        if p <= 1e-12 or p >= 1 - 1e-12:
            take[order[k:]] = round(p)
            return take, -1, 0.0
        if k == n - 1:
            return take, int(i), p
        a = float(sizes[i])
        pool -= a
        if pool <= 0:  # only empty items are left beside this one
            return take, int(i), p
        x, q = pivot(a, p, pool, p, coins[i])
        if 1e-12 < x < 1 - 1e-12:  # the pool became integral first
            take[order[k + 1 :]] = round(q)
            return take, int(i), x
        take[i], p = round(x), q
    return take, -1, 0.0


def round_chain(ids: np.ndarray, sizes: np.ndarray, ps: np.ndarray, seed: int) -> tuple[np.ndarray, int, float]:
    """Round items of different fractions pair by pair, heaviest first; as ``round_block``."""
    take = np.zeros(len(ids), np.int64)
    live, p = -1, 0.0
    coins = _coin(ids, seed)
    for i in np.lexsort((ids, -sizes)):
        if live < 0:
            live, p = int(i), float(ps[i])
            continue
        x, y = pivot(float(sizes[live]), p, float(sizes[i]), float(ps[i]), coins[i])
        for item, value in ((live, x), (int(i), y)):
            if value <= 1e-12 or value >= 1 - 1e-12:
                take[item] = round(value)
        rest = [(item, value) for item, value in ((live, x), (int(i), y)) if 1e-12 < value < 1 - 1e-12]
        live, p = rest[0] if rest else (-1, 0.0)
    return take, live, p


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 11,
    block_docs: int = 1024,
    fan_in: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """How often each document is taken so that every source comes near its target in words.

    Method: pivotal dependent rounding. All documents of a source have the same expected number of
    copies, ``target / source size``; its whole part is taken at once. The fractions are rounded
    together: a pair of items trades mass (words), in a random direction that keeps expectations, until
    one of the two is 0 or 1. Sources are cut into blocks of about ``block_docs`` documents by a hash
    of the id, each block leaves at most one document undecided, and those residuals meet in a
    reduction tree of ``fan_in`` per step, until one per source is left and goes to its nearer side.
    In a block the heaviest document is paired with the pool of all lighter ones, so that what stays
    undecided is light and a source's words miss the target by about one short document.
    A hot source is only more blocks; no task holds more than a block or ``fan_in`` residuals.

    Defined results: null and empty texts have size 0 and are taken with 0 words; a null source is a
    source of its own, last in order; a source without words has target 0; rows that repeat an id share
    its block and its coins and are rounded one by one; an empty table gives no rows. The coins depend
    on id and seed alone, so reruns agree; a null id draws as -1.

    Returns ``<id>, size, source_size, target, taken, copies``; ``taken`` is ``size * copies``. If ``row_col``,
    a key of the row, is named, it comes last.
    """
    spark = docs.sparkSession
    n = shuffle_width(spark)
    carried = [row_col] if row_col else []
    rows = narrow(docs, id_col, source_col, text_col, *carried).select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *carried
    )
    rows = stage(rows, "mix-sizes")
    targets = stage(source_targets(rows, weights=weights, share=share, limit=limit), "mix-targets")

    # One row per source joins to many documents: a hot source is spread by a salt over the join.
    salts = 16
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "size"), F.lit(salts)).cast("int"))
    wide = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = rows["source"].eqNullSafe(wide["source"]) & (rows["salt"] == wide["salt"])
    joined = rows.join(wide, same).select("id", rows["source"], "size", "source_size", "target", "n_docs", *carried)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("ratio", F.least(ratio, F.lit(float(limit))))
    n_blocks = F.ceil(F.col("n_docs") / F.lit(block_docs)).cast("long")
    items = joined.withColumn("block", F.pmod(F.xxhash64(F.coalesce("id", F.lit(-1)), F.lit(seed)), n_blocks))
    items = items.withColumn("base", F.floor("ratio").cast("long")).withColumn("p", F.col("ratio") - F.floor("ratio"))
    id_type = items.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, source string, size long, source_size long, target double, base long, p double, block long, take long, open boolean" + "".join(f", {c} long" for c in carried)

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].fillna(-1).to_numpy(np.int64)
        take, left, p = round_block(ids, pdf["size"].to_numpy(np.int64), float(pdf["p"].iloc[0]), seed)
        return _finish(pdf, take, left, p)

    def again(level: int):
        def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ids = pdf["id"].fillna(-1).to_numpy(np.int64)
            take, left, p = round_chain(ids, pdf["size"].to_numpy(np.int64), pdf["p"].to_numpy(np.float64), seed + level)
            return _finish(pdf, take, left, p)

        return step

    def _finish(pdf: pd.DataFrame, take: np.ndarray, left: int, p: float) -> pd.DataFrame:
        is_open = np.zeros(len(pdf), bool)
        fraction = np.zeros(len(pdf))
        if left >= 0:
            is_open[left], fraction[left] = True, p
        out = pdf[["id", "source", "size", "source_size", "target", "base", "block", *carried]].copy()
        out["p"], out["take"], out["open"] = fraction, take, is_open
        return out[["id", "source", "size", "source_size", "target", "base", "p", "block", "take", "open", *carried]]

    done = stage(items.drop("ratio", "n_docs").groupBy("source", "block").applyInPandas(first, schema), "mix-blocks")
    settled, level = [done.where("not open")], 0
    residual = done.where("open")
    most = targets.agg(F.max(F.ceil(F.col("n_docs") / F.lit(block_docs)))).first()[0] or 1
    while most > 1:
        level += 1
        most = -(-most // fan_in)
        step = residual.withColumn("block", F.floor(F.col("block") / F.lit(fan_in)).cast("long"))
        step = step.select("id", "source", "size", "source_size", "target", "base", "p", "block", *carried)
        step = stage(step.groupBy("source", "block").applyInPandas(again(level), schema), "mix-residuals")
        settled.append(step.where("not open"))
        residual = step.where("open")
    # One residual per source: it goes to the nearer side, which keeps the source nearest its target.
    out = residual.withColumn("take", F.when(F.col("p") >= 0.5, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    for part in settled:
        out = out.unionByName(part)
    copies = F.col("base") + F.col("take")
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *carried
    )
