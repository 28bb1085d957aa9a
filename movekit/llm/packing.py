"""Packing of token sequences: dominance reduction, then best fit, on a table of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from movekit.llm.common import narrow
from movekit.llm.tokens import default_path, tokenizer
from movekit.session import stage

#: A run: items ``first .. first + count - 1`` of one length go to the sequences from ``sequence`` on,
#: ``each`` to a sequence, from ``offset`` on.
Run = tuple[int, int, int, int, int, int]  # length, first, count, sequence, each, offset


class _Stock:
    """How many items of each length are left, and which are taken next."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.lengths = sorted(self.left)

    def take(self, length: int, n: int) -> int:
        """Take ``n`` items; the rank of the first."""
        first = self.used[length]
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return first

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest items beside one of length ``without``."""
        out: list[int] = []
        for k in self.lengths:
            out += [k] * min(n - len(out), self.left[k] - (k == without))
            if len(out) == n:
                break
        return out

    def largest(self, limit: int, without: int) -> int | None:
        """The largest item of at most ``limit`` beside one of length ``without``."""
        at = bisect_left(self.lengths, limit + 1) - 1
        while at >= 0:
            k = self.lengths[at]
            if self.left[k] - (k == without) > 0:
                return k
            at -= 1
        return None

    def best_pair(self, limit: int, without: int) -> int:
        """The largest sum of two items that is at most ``limit``, beside one of length ``without``; 0: none."""
        there = [k for k in self.lengths if k < limit and self.left[k] - (k == without) > 0]
        best, lo, hi = 0, 0, len(there) - 1
        while lo <= hi:
            a, b = there[lo], there[hi]
            if a + b > limit or (lo == hi and self.left[a] - (a == without) < 2):
                hi -= 1
            else:
                best = max(best, a + b)
                lo += 1
        return best


def reduce_dominated(stock: _Stock, capacity: int, sequence: int) -> tuple[list[Run], int]:
    """Martello-Toth reduction: fix every small set that dominates all other sets of its largest item.

    For an item j with room r beside it and k the largest item that fits there, some optimal packing
    holds exactly {j} if nothing fits, and {j, k} if k fills r, or no two items fit into r, or no
    three fit and k is at least any pair that fits: whatever else is packed with j can change places
    with k. Equal items are fixed together, and the pass is repeated until nothing is fixed, as each fix
    may settle others.
    """
    runs: list[Run] = []
    changed = True
    while changed:
        changed = False
        for j in reversed(list(stock.lengths)):
            while stock.left.get(j):
                room = capacity - j
                k = stock.largest(room, j)
                if k is None:
                    n = stock.left[j]
                    runs.append((j, stock.take(j, n), n, sequence, 1, 0))
                    sequence, changed = sequence + n, True
                    break
                two, three = stock.smallest(2, j), stock.smallest(3, j)
                alone = len(two) < 2 or sum(two) > room
                no_triple = len(three) < 3 or sum(three) > room
                if not (k == room or alone or (no_triple and stock.best_pair(room, j) <= k)):
                    break
                n = stock.left[j] // 2 if k == j else min(stock.left[j], stock.left[k])
                if k == j:
                    runs.append((j, stock.take(j, 2 * n), 2 * n, sequence, 2, 0))
                else:
                    runs.append((j, stock.take(j, n), n, sequence, 1, 0))
                    runs.append((k, stock.take(k, n), n, sequence, 1, j))
                sequence, changed = sequence + n, True
    return runs, sequence


def best_fit(stock: _Stock, capacity: int, sequence: int) -> tuple[list[Run], int]:
    """Best fit by falling length; equal items and sequences with equal room are handled together."""
    runs: list[Run] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, count)
    rooms: list[int] = []

    def put(room: int, first: int, count: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((first, count))

    for w in reversed(list(stock.lengths)):
        n = stock.left[w]
        rank = stock.take(w, n)
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):  # nothing has room: new sequences, each filled before the next
                each = capacity // w
                count = -(-n // each)
                first, sequence = sequence, sequence + count
                put(capacity, first, count)
                continue
            room = rooms[at]
            first, count = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = room // w
            full = min(count, n // each)
            if full:
                runs.append((w, rank, full * each, first, each, capacity - room))
                put(room - each * w, first, full)
                rank, n, first, count = rank + full * each, n - full * each, first + full, count - full
            if count and n:  # fewer items left than one sequence takes
                runs.append((w, rank, n, first, n, capacity - room))
                put(room - n * w, first, 1)
                n, first, count = 0, first + 1, count - 1
            if count:
                put(room, first, count)
    return runs, sequence


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Where all items go, as runs, and the number of sequences."""
    stock = _Stock(counts)
    fixed, sequence = reduce_dominated(stock, capacity, 0)
    rest, sequence = best_fit(stock, capacity, sequence)
    return fixed + rest, sequence


def _pieces(path: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for pdf in batches:
            out = []
            for i, raw in zip(pdf["id"], own.encode([t or "" for t in pdf["text"]]), strict=True):
                raw += tail
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((i, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", "task", "turn"], dtype=object)

    return run


def _places(runs: list[Run]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    heads = table[:, 0] * (1 << 44) + table[:, 1]  # ranks stay below 2^44

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            row = table[np.searchsorted(heads, pdf["length"].to_numpy(np.int64) * (1 << 44) + rank, side="right") - 1]
            k = rank - row[:, 1]
            pdf["sequence_id"] = row[:, 3] + k // row[:, 4]
            pdf["offset"] = row[:, 5] + (k % row[:, 4]) * row[:, 0]
            yield pdf[["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack_sequences(
    docs: DataFrame, *, capacity: int = 2048, end: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All documents as tokens, packed into as few sequences of ``capacity`` tokens as best fit finds.

    A document is its token ids and then ``end``. Only longer ones are cut, into pieces of
    ``capacity``; those and the shorter last pieces are the items.

    Method: Martello-Toth dominance reduction, then best fit. Items of one length are alike, so the
    instance is a table of at most ``capacity`` counts, whatever the number of documents; it is the only
    thing the driver sees. Sets that provably dominate all alternatives are fixed for good, the smaller
    rest goes by best fit, falling lengths first. The solution is a table of runs (a length, a range of
    ranks, a range of sequences) whose size depends on the lengths alone. Each item has a rank
    among those of its length, from its turn in its task and the counts of the tasks before, so no
    task gathers a length; its run tells its place.

    Defined results: null and empty texts are one piece that holds ``end`` alone; repeated rows are packed
    one by one; null ids are carried along; an empty table gives no rows. Other columns are ignored.

    Returns ``<id>, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    rows = narrow(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    items = rows.mapInPandas(
        _pieces(path or default_path(), capacity, end),
        f"id {id_type}, piece int, start long, length long, ids_crc32 long, task long, turn long",
    )
    items = stage(items, "pack-pieces")
    per_task = items.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    per_task = stage(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan(counts, capacity)

    ranked = items.join(per_task.drop("n"), ["length", "task"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("turn")).alias("rank")
    )
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(_places(runs), schema).withColumnRenamed("id", id_col)
