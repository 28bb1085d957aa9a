"""Exact duplicates, with the frequent texts split off before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from movekit.llm.common import narrow
from movekit.session import stage


def exact_duplicates(docs: DataFrame, *, support: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of identical texts; the row with the largest id of each group stays.

    Method: a heavy-hitter split. Texts become SHA-256 digests, written once as a narrow table.
    A Misra-Gries pass (``freqItems``, at most ``1 / support`` counters per task) names every digest
    that may make up ``support`` of the rows. Those candidates are counted exactly, with partial sums
    in each task, and the verified winners, at most ``1 / support`` rows, are broadcast: rows of a
    frequent text get their answer on the map side and never meet in one task. The other digests,
    each below ``support`` of the rows, go through one ordinary shuffle.

    Defined results: a null text counts as empty; repeated rows (same id) are answered row by row, all
    with the same ``kept``; a null id sorts below every other, and a group of null ids alone keeps
    ``keep_id`` null and ``kept`` true; an empty table gives no rows. Other columns are ignored.

    Returns ``<id>, keep_id, group_size, kept, text_sha256``.
    """
    rows = narrow(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")
    )
    rows = stage(rows, "exact-digests")

    suspects = rows.select(F.hex("digest").alias("digest")).freqItems(["digest"], support)
    suspects = suspects.select(F.explode("digest_freqItems").alias("digest")).select(F.unhex("digest").alias("digest"))
    winners = (
        rows.join(F.broadcast(suspects), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    # At most 1 / support rows by the bound on the counters, whatever the input.
    winners = stage(winners, "exact-winners")

    split = rows.join(F.broadcast(winners), "digest", "left")
    frequent = split.where(F.col("group_size").isNotNull())
    same = W.partitionBy("digest")
    rest = split.where(F.col("group_size").isNull()).select(
        "id", "digest", F.max("id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    return frequent.select(*_answer(id_col)).unionByName(rest.select(*_answer(id_col)))


def _answer(id_col: str) -> list[Column]:
    return [
        F.col("id").alias(id_col),
        F.col("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ]
