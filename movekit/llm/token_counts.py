"""Tokens per document in flat token files without an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from movekit.llm.common import narrow
from movekit.llm.tokens import default_path, tokenizer
from movekit.session import scratch

#: Tokens searched at once.
BLOCK = 1 << 18


def write_tokens(docs: DataFrame, folder: str, *, end: int, width: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each task's documents as one flat file of ids, every document closed by ``end``.

    ``kind=tokens`` holds nothing but ids of ``width`` bytes, little endian; ``kind=ids`` has the
    documents' own ids in the same order, a byte that is 1 for a null id and eight of the id, closed in the same way. Both come from one
    job and are written by Spark's text writer, whose line separator is the end id.
    """
    kind = f"<u{width}"
    place = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, task, turn = tokenizer(place), TaskContext.get().partitionId(), 0
        for pdf in batches:
            out = []
            for i, none, raw in zip(pdf["id"], pdf["nameless"], own.encode([t or "" for t in pdf["text"]]), strict=True):
                ids = np.frombuffer(raw, "<u4")
                if len(ids) and (ids == end).any():
                    raise ValueError("a text holds the id that ends documents")
                if len(ids) and int(ids.max()) >= 256**width:
                    raise ValueError(f"an id of the tokenizer does not fit {width} bytes")
                out.append((task, "tokens", turn, ids.astype(kind).tobytes()))
                out.append((task, "ids", turn, bytes([none]) + int(i).to_bytes(8, "little", signed=True)))
                turn += 1
            yield pd.DataFrame(out, columns=["shard", "kind", "turn", "value"])

    own_id = F.col(id_col).cast("long")
    rows = narrow(docs, id_col, text_col).select(F.coalesce(own_id, F.lit(0)).alias("id"), own_id.isNull().alias("nameless"), F.col(text_col).alias("text"))
    rows = rows.mapInPandas(run, "shard long, kind string, turn long, value binary")
    rows = rows.sortWithinPartitions("shard", "kind", "turn").select("shard", "kind", F.col("value").cast("string").alias("value"))
    separator = int(end).to_bytes(width, "little").decode("latin-1")
    rows.write.partitionBy("shard", "kind").option("encoding", "ISO-8859-1").option("lineSep", separator).text(folder)


def count_tokens(spark: SparkSession, folder: str, *, end: int, width: int = 2) -> DataFrame:
    """``file, turn, start, n_tokens``: every document of the flat files in ``folder``, in file order.

    Method: a separator scan. Files are searched block by block with one vectorised comparison each; a
    block reports its separators, and knows nothing of its neighbours. A prefix scan over the blocks of
    a file, the number of separators so far and the last one's place, stitches documents that cross
    blocks, however many. Tokens behind the last separator are one more document.

    Defined results: an empty document has 0 tokens; an empty file has none; a file that is no whole
    number of ids is an error. A file is read by one task, so writers should keep files within its memory,
    as ``write_tokens`` does with one per input split.
    """
    kind = f"<u{width}"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if len(content) % width:
                    raise ValueError(f"{name} is no whole number of ids")
                ids = np.frombuffer(content, kind)
                for block, at in enumerate(range(0, len(ids), BLOCK)):
                    found = np.flatnonzero(ids[at : at + BLOCK] == end) + at
                    last = at + BLOCK >= len(ids)
                    yield pd.DataFrame({"file": [name], "block": [block], "size": [len(ids) if last else None], "found": [found]})

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    blocks = files.mapInPandas(scan, "file string, block long, size long, found array<long>")
    so_far = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "file",
        "size",
        "found",
        F.coalesce(F.sum(F.size("found")).over(so_far), F.lit(0)).alias("base"),
        F.coalesce(F.max(F.array_max("found")).over(so_far), F.lit(-1)).alias("prior"),
    )
    # The tokens behind a file's last separator end at its size.
    end_at = F.when(F.col("size") > F.coalesce(F.array_max("found"), F.col("prior")) + 1, F.array("size")).otherwise(F.array().cast("array<long>"))
    ends = blocks.select("file", "base", "prior", F.concat("found", end_at).alias("ends"))
    ends = ends.select("file", "base", F.concat(F.array("prior"), "ends").alias("befores"), F.posexplode("ends").alias("k", "stop"))
    start = F.get("befores", F.col("k")) + 1
    return ends.select("file", (F.col("base") + F.col("k")).alias("turn"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def document_tokens(docs: DataFrame, *, end: int = 65535, width: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as flat token files and counts the tokens of every document from them.

    ``end`` is outside the vocabulary, so that a text may hold any id, those of special tokens included.

    Defined results: null and empty texts have 0 tokens; repeated rows are counted one by one; rows
    with a null id are counted and keep it; an empty table gives no rows. Ids of the tokenizer that do not fit ``width`` are an error.

    Returns ``<id>, n_tokens``.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "flat-tokens")
    write_tokens(docs, folder, end=end, width=width, path=path, id_col=id_col, text_col=text_col)
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    if found.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long")
    counts = count_tokens(spark, f"{folder}/shard=*/kind=tokens", end=end, width=width)

    def read_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = np.frombuffer(content, np.dtype([("nameless", "u1"), ("id", "<i8"), ("end", f"V{width}")]))
                yield pd.DataFrame({"file": name, "turn": np.arange(len(rows)), "nameless": rows["nameless"] == 1, "id": rows["id"].copy()})

    ids = spark.read.format("binaryFile").load(f"{folder}/shard=*/kind=ids").select("path", "content")
    ids = ids.mapInPandas(read_ids, "file string, turn long, nameless boolean, id long")
    shard = F.regexp_extract("file", r"/shard=(\d+)/", 1)
    left, right = counts.withColumn("shard", shard), ids.withColumn("shard", shard).drop("file")
    joined = right.join(left, ["shard", "turn"])
    return joined.select(F.when(~F.col("nameless"), F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), "n_tokens")
