"""Even shards by histogram sort.

Rows are ordered by (hash of the text, hash of the id, number of the row), so equal texts are neighbours. The
shards are ranges of that order. Their splitters are found before any row moves: every round counts the exact
bytes below a few candidate keys in all partitions, keeps for each splitter the two candidates around its target
and probes between them, until one is near enough. Then the rows are exchanged once.

Law ``bytes``: all shards hold nearly the same bytes. A group of equal texts is cut only where no boundary beside
it meets the tolerance, so a hot text is spread over as many shards as it fills.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from movekit.session import stage

N_SHARDS = 16
#: A shard's size may miss its even part by so much of it, or by half of a text that no boundary can cut.
TOLERANCE = 0.001
#: Rows of a shard are sorted in parts of about so many bytes, at most ``MOST_PARTS`` of them.
PART_BYTES, MOST_PARTS = 32 << 20, 1024
#: Candidates counted in one round, over all splitters.
MOST_PROBES = 8192
#: Ranges are looked up by the first 12 of a key's bits.
BUCKET_SHIFT = 64 - 12

KEY = ("k1", "k2", "k3")
_SIGN = np.uint64(1 << 63)
_HISTOGRAM = "bucket long, bytes long, n long, least binary, most binary"


def _packed(first: pd.Series, second: pd.Series, third: pd.Series) -> np.ndarray:
    """Keys as 24 bytes each that sort as the three signed numbers do."""
    out = np.empty((len(first), 3), ">u8")
    for i, part in enumerate((first, second, third)):
        out[:, i] = part.to_numpy(np.int64).view(np.uint64) ^ _SIGN
    return out.view("S24").ravel()


def _sorted_bytes(keys: list[bytes]) -> np.ndarray:
    return np.array(sorted(set(keys)), "S24")


def _histogram(keys: DataFrame, probes: np.ndarray) -> pd.DataFrame:
    """Exact bytes, rows and outermost keys between each two of ``probes``, of batches first and then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            b = b.iloc[np.lexsort((b.k3, b.k2, b.k1))]
            packed, size = _packed(b.k1, b.k2, b.k3), b["size"].to_numpy(np.int64)
            edges = np.concatenate(([0], np.searchsorted(packed, probes), [len(b)]))
            bucket = np.flatnonzero(edges[1:] > edges[:-1])
            start, end, whole = edges[bucket], edges[bucket + 1], packed.view("V24")
            yield pd.DataFrame({"bucket": bucket, "bytes": np.add.reduceat(size, start), "n": end - start, "least": whole[start].tolist(), "most": whole[end - 1].tolist()})

    found = keys.mapInPandas(count, _HISTOGRAM).groupBy("bucket")
    rows = found.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).toPandas()
    return rows.set_index("bucket").sort_index()


@dataclass
class Splitter:
    """A boundary looked for: between two known keys, with the bytes and rows below each."""

    target: float
    tolerance: float
    low: tuple[bytes, int, int]
    high: tuple[bytes, int, int]
    least: bytes = b"\0" * 24
    most: bytes = b"\xff" * 24
    done: tuple[bytes, int] | None = None

    def settle(self, single: bool) -> None:
        """Take the nearer end if it is near enough or nothing lies between the two."""
        key, below, n = min((self.low, self.high), key=lambda end: abs(end[1] - self.target))
        if single or abs(below - self.target) <= self.tolerance:
            self.done = key, n


def _between(least: bytes, most: bytes, n: int) -> list[bytes]:
    """Up to ``n`` even steps above ``least`` and up to ``most``, in the first number of the key that differs.

    While the texts differ, candidates lie between groups of equal texts; then between ids, then between rows.
    """
    parts = [(int.from_bytes(least[i : i + 8]), int.from_bytes(most[i : i + 8])) for i in (0, 8, 16)]
    at = next((i for i, (a, b) in enumerate(parts) if a != b), None)
    if at is None:
        return []
    a, b = parts[at]
    n = min(n, b - a)
    prefix = least[: 8 * at]
    return [prefix + (a + (b - a) * (j + 1) // (n + 1) + (n == b - a)).to_bytes(8, "big") + bytes(16 - 8 * at) for j in range(n)]


def find_splitters(keys: DataFrame, targets: list[tuple[float, float]], total: int, n_rows: int) -> list[tuple[bytes, int]]:
    """Keys with about the wanted bytes below them and the rows below them, for ``(target, tolerance)`` in ascending order.

    The driver holds the candidates and one row for each range between two of them; ``keys`` has ``k1, k2, k3, size``.
    """
    ends = (b"\0" * 24, 0, 0), (b"\xff" * 24, total, n_rows)
    wanted = [Splitter(t, tol, *ends) for t, tol in targets]
    while open_ones := [s for s in wanted if s.done is None]:
        each = max(2, min(16, MOST_PROBES // len(open_ones)))
        shared: dict[tuple[bytes, bytes], int] = {}
        for s in open_ones:
            shared[s.least, s.most] = shared.get((s.least, s.most), 0) + 1
        known = [key for s in open_ones for key in (s.low[0], s.high[0])]
        probes = _sorted_bytes([*known, *(p for (a, b), n in shared.items() for p in _between(a, b, n * each))])
        found = _histogram(keys, probes)
        index = found.index.to_numpy()
        below, n = np.cumsum(found["bytes"].to_numpy()), np.cumsum(found["n"].to_numpy())
        for s in open_ones:
            # The first range that reaches the target; it has rows, so its outermost keys are known.
            i = min(int(np.searchsorted(below, s.target)), len(below) - 1)
            k, row = int(index[i]), found.iloc[i]
            low = (probes[k - 1].ljust(24, b"\0") if k else ends[0][0], int(below[i] - row["bytes"]), int(n[i] - row["n"]))
            high = (probes[k].ljust(24, b"\0") if k < len(probes) else ends[1][0], int(below[i]), int(n[i]))
            s.low, s.high, s.least, s.most = low, high, bytes(row["least"]), bytes(row["most"])
            s.settle(single=s.least == s.most)
    return [s.done for s in wanted]


def _ranges(spark: SparkSession, bounds: np.ndarray, shard_of: np.ndarray, base: np.ndarray) -> DataFrame:
    """The ranges between ``bounds``, one row for each bucket of first keys that a range meets; together they hold every key."""
    borders = [tuple(x) for x in (bounds.view(">u8").reshape(-1, 3).astype(np.uint64) ^ _SIGN).view(np.int64).tolist()]
    lows, highs = [(-(1 << 63),) * 3, *borders], [*borders, None]
    rows = []
    for i, (low, high) in enumerate(zip(lows, highs, strict=True)):
        last = (high[0] if high else (1 << 63) - 1) >> BUCKET_SHIFT
        rows += [(bucket, low, high, i, int(shard_of[i]), int(base[i])) for bucket in range(low[0] >> BUCKET_SHIFT, last + 1)]
    key = "struct<k1: long, k2: long, k3: long>"
    return spark.createDataFrame(rows, f"bucket long, low {key}, high {key}, range int, shard int, base long")


def in_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with the range that holds their key; of the few ranges of a bucket, comparisons find the one."""
    key = F.struct(*KEY)
    inside = (key >= ranges["low"]) & (ranges["high"].isNull() | (key < ranges["high"]))
    return rows.join(F.broadcast(ranges), (F.shiftright("k1", BUCKET_SHIFT) == ranges["bucket"]) & inside)


def file_row() -> Column:
    """A number for each row of a scan of Parquet files, from its file and its place there."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def shard_documents(
    docs: DataFrame,
    *,
    n_shards: int = N_SHARDS,
    tolerance: float = TOLERANCE,
    part_bytes: int = PART_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    number: Column | None = None,
) -> DataFrame:
    """``id, text, size, shard, slot`` for every row: whole texts in ``n_shards`` shards of nearly equal bytes.

    ``size`` is the number of UTF-8 bytes plus 1 (null text: 1); ``slot`` counts the rows of a shard from 0 without
    a gap, in the order of the key. Rows without an id, repeated rows and equal texts are rows like any other.
    With no rows the result is empty; shards beyond the number of rows stay empty. Further columns are left out.
    One text is never cut: a shard may exceed its part by half of the text at either end.

    ``number`` tells repeated rows apart by a number that each has again whenever ``docs`` is read, as :func:`file_row`
    does for files. Then ``docs`` is read twice and only keys are written. Without it the rows are written once, numbered.
    """
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    keyed = docs.select(
        docs[id_col],
        docs[text_col],
        size.alias("size"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k1"),
        F.xxhash64(id_col).alias("k2"),
        (F.monotonically_increasing_id() if number is None else number).alias("k3"),
    )
    if number is None:
        keyed = stage(keyed, "shard-rows")  # numbers of rows hold only once they are written
        keys = keyed.select(*KEY, "size")
    else:
        keys = stage(keyed.select(*KEY, "size"), "shard-keys")
    total, n_rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    m = max(1, min(MOST_PARTS, math.ceil(total / n_shards / part_bytes)))
    part, n_parts = total / (n_shards * m), n_shards * m
    # Borders of shards are exact to the tolerance; borders of the parts within a shard only share out the sorting.
    targets = [(part * i, part * m * tolerance if i % m == 0 else part * 0.2) for i in range(1, n_parts)] if total else []
    splitters = find_splitters(keys, targets, total, n_rows)
    bounds, place = np.unique(np.array([key for key, _ in splitters], "S24"), return_inverse=True)
    before = np.zeros(len(bounds) + 1, np.int64)
    before[place + 1] = [n for _, n in splitters]
    # Range j of the distinct splitters belongs to the part that the last of the equal ones opens.
    part_of = np.zeros(len(bounds) + 1, np.int64)
    for i, j in enumerate(place):
        part_of[j + 1] = i + 1
    shard_of = part_of // m
    first = np.array([before[shard_of == s].min() for s in shard_of])
    base = before - first

    rows = in_ranges(keyed, _ranges(docs.sparkSession, bounds, shard_of, base))
    place = F.row_number().over(W.partitionBy("range").orderBy(*KEY))
    return rows.select(id_col, text_col, "size", "shard", (F.col("base") + place - 1).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet, one folder ``shard=<n>`` for each; rows carry their slot."""
    sharded.write.partitionBy("shard").parquet(path)
