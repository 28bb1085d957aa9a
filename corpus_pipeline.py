"""Stages that turn raw documents into training sequences.

Every stage works on all that its predecessor kept, which is written as Parquet and read again.
Decisions are per row: a stage gives its rows a key, written with them, and joins back by it, so rows that
repeat an id or have none are treated like any other. What a stage staged is removed when the next one begins:
by then its result is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movekit.llm.common import small_batches
from movekit.llm.exact import exact_duplicates
from movekit.llm.minhash import near_duplicates
from movekit.llm.mixing import mix
from movekit.llm.packing import pack_sequences
from movekit.llm.quality import score_quality
from movekit.session import STAGED, by_key, delete_path, scratch, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The key of a row within one stage.
ROW = "row_key"


#: Folders staged by stages that are done but not yet removed.
_left: list[str] = []


def _tidy(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Remove what earlier stages staged, unless ``docs`` still reads it, and note what this one stages."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f.rsplit("/", 1)[0] for f in docs.inputFiles()} if _left else set()
        names = {f.rsplit("/", 1)[-1] for f in read}
        for path in [p for p in _left if p.rsplit("/", 1)[-1] not in names]:
            delete_path(spark, path)
            _left.remove(path)
        before = len(STAGED)
        try:
            return step(spark, docs, sf_dir)
        finally:
            _left.extend(STAGED[before:])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a key each, written so that all readers see the same keys."""
    return stage(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def _only(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose key is among ``rows``; they grow with the documents, so both meet in a shuffle at any size."""
    return keyed.join(by_key(rows.select(ROW)), ROW, "left_semi").select(*COLUMNS)


@_tidy
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    labels, keyed = spark.read.parquet(f"{sf_dir}/labels.parquet"), _keyed(docs)
    with small_batches(spark):
        good = stage(score_quality(keyed, labels, row_col=ROW).where("predicted = 1").select(ROW), "pipeline-good")
    return _only(keyed, good)


@_tidy
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of identical texts stays, one with the largest id."""
    keyed = _keyed(docs)
    found = exact_duplicates(keyed.select(F.struct("doc_id", ROW).alias("own"), "text"), id_col="own")
    return _only(keyed, found.where("kept").select(f"own.{ROW}"))


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, one with the smallest id; no id comes last."""
    keyed = _keyed(docs)
    found = near_duplicates(keyed, id_col=ROW).select(ROW, "component_id").join(keyed.select(ROW, "doc_id"), ROW)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", ROW))
    return _only(keyed, found.groupBy("component_id").agg(least.alias("own")).select(f"own.{ROW}"))


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; a row per copy."""
    keyed = _keyed(docs)
    copies = mix(keyed, row_col=ROW).where("copies > 0").select(ROW, "copies")
    turns = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return keyed.join(by_key(copies), ROW).select(*COLUMNS, F.explode(turns).alias("turn")).drop("turn")


@_tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as tokens in sequences: one row per piece."""
    return pack_sequences(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", packing),
]

#: A fitted model, hashed sketches and a tokenizer are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
