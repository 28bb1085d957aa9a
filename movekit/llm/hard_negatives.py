"""Hard negatives by angular triangle filtering.

Each row stores its norm and its angles to a few reference directions. For an anchor and a row, the angle between
them is at least the largest difference of their angles to a reference and at most the smallest sum (mirrored at
180 degrees). The cosines of both, times the norms, bound the score; the bounds are widened by more than all rounding
can amount to. Rows that share their nearest reference (or label) are bounded together, by the range of their angles.
Where a group may hold a row for an anchor's windows, one matrix product in single precision narrows each pair's
interval to its rounding. Only pairs whose interval meets a window still wanted are scored, in whole numbers.

Anchors come in passes of a fixed number, sent to all tasks; every pass reads all rows where they lie. A task keeps
the best few rows for each anchor and the passes' results are merged by Spark, so nothing grows with the rows but
the time. References only decide how much is skipped, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from movekit.llm.common import narrow
from movekit.session import scratch, stage

EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Components beyond so much, once scaled, are an error.
MOST_COMPONENT = 1 << 31
#: Reference directions, and the rows they are taken from.
REFERENCES, PILOT = 16, 2048
#: Anchors of one pass: at 64 components 16,384 of them are 10 MB.
PER_PASS = 16_384
#: Rows, anchors and pairs looked at together within a task.
BLOCK, TILE, PAIRS = 1 << 14, 512, 1 << 14
#: Where so many pairs per anchor and kept row pass, the floors are raised first.
CROWD = 8

UNNAMED = np.iinfo(np.int64).max
#: The score of a place not taken yet.
NONE = np.iinfo(np.int64).min
_VECTORS = "row long, id long, named boolean, label long, norm double, q binary, angles binary"
_FOUND = "anchor long, slot int, score long, id long, named boolean, row long"


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; missing components at the end are 0."""
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def reference_directions(pilot: pd.DataFrame, width: int, n: int = REFERENCES) -> np.ndarray:
    """Unit vectors: the means of the most frequent labels of the pilot rows, then rows far from those chosen."""
    if not len(pilot) or not width:
        return np.zeros((0, max(width, 1)))
    q, labels = _matrix(pilot["q"], width), pilot["label"].to_numpy()
    kinds, counts = np.unique(labels, return_counts=True)
    chosen = [q[labels == k].mean(axis=0) for k in kinds[np.argsort(-counts, kind="stable")][:n]]
    chosen = [c / np.linalg.norm(c) for c in chosen if np.linalg.norm(c) > 0]
    norms = np.linalg.norm(q, axis=1)
    unit = q[norms > 0] / norms[norms > 0, None]
    while len(chosen) < min(n, len(unit)):
        nearest = np.abs(unit @ np.array(chosen).T).max(axis=1) if chosen else np.zeros(len(unit))
        chosen.append(unit[int(nearest.argmin())])
    return np.array(chosen[:n]).reshape(-1, width)


def _angles(q: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    cosine = (q @ references.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def bounds(
    na: np.ndarray, ta: np.ndarray, nb: np.ndarray, tb: np.ndarray, nb_most: np.ndarray | None = None, tb_most: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Safe lower and upper bounds of all scores between two sets of vectors, from norms and angles alone.

    The second set may be groups of rows: then ``nb, tb`` are the least norms and angles of each, and the last two the most.
    Angles are stored in 32 bits (2.4e-7) and the arc cosine errs by at most 1.5e-8 near its ends, so an angle errs by
    less than 1e-6 and a cosine of two of them by less than 2e-6.
    """
    nb_most, tb_most = nb if nb_most is None else nb_most, tb if tb_most is None else tb_most
    least = np.zeros((len(na), len(nb)), np.float32)
    most = np.full((len(na), len(nb)), np.pi, np.float32)
    for k in range(ta.shape[1]):
        a, low, high = ta[:, k, None], tb[None, :, k], tb_most[None, :, k]
        np.maximum(least, np.maximum(low - a, a - high), out=least)
        np.minimum(most, np.minimum(a + high, np.float32(2 * np.pi) - (a + low)), out=most)
    short, long = na[:, None] * nb[None, :], na[:, None] * nb_most[None, :]
    slack = long * 4e-6 + 1
    down, up = np.cos(most), np.cos(least)
    return np.where(down > 0, short, long) * down - slack, np.where(up > 0, long, short) * up + slack


def exact_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products of the pairs ``(i, j)``; doubles hold them exactly where norms allow, else 64-bit integers do."""
    out = np.empty(len(i), np.int64)
    kind = np.float64 if safe else np.int64
    a, b = a.astype(kind), b.astype(kind)
    for s in range(0, len(i), PAIRS):
        out[s : s + PAIRS] = np.einsum("ij,ij->i", a[i[s : s + PAIRS]], b[j[s : s + PAIRS]])
    return out


class Slab:
    """The anchors of one pass."""

    def __init__(self, rows: pd.DataFrame, width: int) -> None:
        n = len(rows)
        self.width = width
        self.row = rows["row"].to_numpy(np.int64)
        self.label = rows["label"].to_numpy(np.int64)
        self.norm = rows["norm"].to_numpy(np.float64)
        self.q = np.frombuffer(b"".join(rows["q"]), np.int32).reshape(n, width)
        self.angles = np.frombuffer(b"".join(rows["angles"]), np.float32).reshape(n, -1)


class Best:
    """The best ``k`` rows for each (anchor, slot) so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, slots: int, k: int) -> None:
        self.k, self.slots = k, slots
        self.score = np.full((n * slots, k), NONE)
        self.id = np.full((n * slots, k), UNNAMED)
        self.row = np.full((n * slots, k), -1)

    @property
    def least(self) -> np.ndarray:
        """For each anchor and slot, the score a further row must reach."""
        return self.score[:, -1].reshape(-1, self.slots)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows for places ``anchor * slots + slot``; only places that a row may enter are sorted anew."""
        least, last = self.score[place, -1], self.id[place, -1]
        enters = (score > least) | ((score == least) & (ids <= last))
        place, score, ids, rows = (x[enters] for x in (place, score, ids, rows))
        at = np.unique(place)
        place = np.concatenate((np.repeat(at, self.k), place))
        score, ids, rows = (np.concatenate((held[at].ravel(), new)) for held, new in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, ~score, place))
        first = np.searchsorted(place[order], at)
        keep = order[first[:, None] + np.arange(self.k)]
        self.score[at], self.id[at], self.row[at] = score[keep], ids[keep], rows[keep]

    def frame(self, anchors: np.ndarray) -> pd.DataFrame:
        place, rank = np.nonzero(self.row >= 0)
        score, ids, rows = (held[place, rank] for held in (self.score, self.id, self.row))
        return pd.DataFrame({"anchor": anchors[place // self.slots], "slot": (place % self.slots).astype(np.int32), "score": score, "id": ids, "named": ids != UNNAMED, "row": rows})


def _blocks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple]:
    for b in batches:
        for s in range(0, len(b), BLOCK):
            x = b.iloc[s : s + BLOCK]
            q = np.frombuffer(b"".join(x["q"]), np.int32).reshape(len(x), width)
            angles = np.frombuffer(b"".join(x["angles"]), np.float32).reshape(len(x), -1)
            yield x["row"].to_numpy(np.int64), x["id"].to_numpy(np.int64), x["label"].to_numpy(np.int64), x["norm"].to_numpy(np.float64), q, angles


def _within(product: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Pairs of a tile whose score may lie in ``low..high``, by rows; compared in the precision of the products."""
    return (product >= (low - slack).astype(np.float32)[:, None]) & (product <= (high + slack).astype(np.float32)[:, None])


def _raised(product: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """Floors raised by the pairs of a tile that surely lie in the window: its ``k``-th product, less the rounding."""
    out = floor.copy()
    for w in range(floor.shape[1]):
        sure = own & (product >= (low[:, w] + slack)[:, None]) & (product <= (high[:, w] - slack)[:, None])
        kth = np.partition(np.where(sure, product, -np.inf), -k, axis=1)[:, -k]
        np.maximum(out[:, w], kth - slack, out=out[:, w])
    return out


def _search(slab: Slab, low: np.ndarray, high: np.ndarray, k: int, same: bool, norm_limit: float):
    """A task's search: for each anchor and window ``low..high`` of scores, the best ``k`` rows of the same or another label."""
    safe = norm_limit < 2.0**52
    slots = low.shape[1]
    # Windows without a number in them would only keep the others' floors low.
    low, high = np.where(low > high, np.iinfo(np.int64).max, low), np.where(low > high, np.iinfo(np.int64).min, high)
    # A product of single precision errs by less than this part of both norms, its limits included.
    rounding = (slab.width + 8) * 2.0**-23

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(slab.row), slots, k)
        anchors = slab.q.astype(np.float32)
        for rows, ids, labels, norms, q, angles in _blocks(batches, slab.width):
            kinds = labels if same or not angles.shape[1] else angles.argmin(axis=1)
            groups = [np.flatnonzero(kinds == kind) for kind in np.unique(kinds)]
            shortest, longest = (np.array([f(norms[g]) for g in groups]) for f in (np.min, np.max))
            nearest, farthest = (np.array([f(angles[g], axis=0) for g in groups]) for f in (np.min, np.max))
            least, most = bounds(slab.norm, slab.angles, shortest, nearest, longest, farthest)
            single = q.astype(np.float32)
            for g, here in enumerate(groups):
                floor = np.maximum(low, best.least)
                may = ((most[:, g, None] >= floor) & (least[:, g, None] <= high)).any(axis=1)
                if same:
                    may &= slab.label == labels[here[0]]
                every, columns = np.flatnonzero(may), single[here].T
                for s in range(0, len(every), TILE):
                    some = every[s : s + TILE]
                    floors, tops = floor[some].astype(np.float64), high[some].astype(np.float64)
                    slack = slab.norm[some] * longest[g] * rounding
                    product = anchors[some] @ columns
                    own = slab.row[some, None] != rows[None, here] if same else slab.label[some, None] != labels[None, here]
                    wanted = _within(product, floors.min(axis=1), tops.max(axis=1), slack) & own
                    if np.count_nonzero(wanted) > CROWD * k * slots * len(some) and len(here) >= k:
                        floors = _raised(product, own, low[some], high[some], slack, floors, k)
                        wanted = np.logical_or.reduce([_within(product, floors[:, w], tops[:, w], slack) for w in range(slots)]) & own
                    i, j = np.divmod(np.flatnonzero(wanted), len(here))
                    if not len(i):
                        continue
                    score, i, j = exact_scores(slab.q[some], q[here], i, j, safe), some[i], here[j]
                    pair, slot = np.nonzero((score[:, None] >= floor[i]) & (score[:, None] <= high[i]))
                    if len(pair):
                        best.add(i[pair] * slots + slot, score[pair], ids[j[pair]], rows[j[pair]])
        yield best.frame(slab.row)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of what the tasks found for each (anchor, slot), ``rank`` from 1."""
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prepared(vectors: DataFrame) -> DataFrame:
    """Rows that take part, with labels as contracted (moved on where the id is divisible by 7) and whole components."""
    v = narrow(vectors, "vec_id", "embedding", "label")
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    v = v.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    floor = lambda x: F.floor(x.cast("double") * SCALE)
    fits = lambda x: F.when(F.abs(x.cast("double") * SCALE) < MOST_COMPONENT, floor(x)).otherwise(F.raise_error(F.lit("a vector component is too large")))
    return v.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("vec_id").cast("long"), F.lit(int(UNNAMED))).alias("id"),
        F.col("vec_id").isNotNull().alias("named"),
        label.alias("label"),
        F.transform("embedding", fits).cast("array<int>").alias("q"),
    )


def windows(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most a negative may score beside these positives; whole hundreds first, so that 64 bits hold it."""
    hundreds, rest = np.divmod(score, 100)
    return LOW * hundreds - (-LOW * rest) // 100, HIGH * hundreds + (HIGH * rest) // 100


def hard_negatives(vectors: DataFrame, *, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, per_pass: int = PER_PASS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. A row without a label or vector, or with a null or
    non-finite component, takes no part. A row without an id is never an anchor and comes last among equal scores.
    Rows that repeat an id are rows of their own, as anchors too. A shorter vector lacks components, which count as 0.
    A pair without a fitting negative gives no row; so does an empty table. Components of 2^23 and more are an error.
    """
    spark = vectors.sparkSession
    rows = stage(prepared(vectors), "vectors-whole")
    width = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    pilot = rows.orderBy(F.xxhash64("id", "row")).limit(PILOT).select("label", "q").toPandas()
    references = reference_directions(pilot, width)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = _matrix(b["q"], width)
            norms = np.sqrt((q**2).sum(axis=1))
            angles = _angles(q, norms, references) if len(references) else np.zeros((len(b), 0), np.float32)
            whole = q.astype(np.int32)
            yield b[["row", "id", "named", "label"]].assign(norm=norms, q=[x.tobytes() for x in whole], angles=[x.tobytes() for x in angles])

    stored = stage(rows.mapInPandas(store, _VECTORS), "vectors")
    anchors = stage(stored.where(F.col("named") & (F.col("id") % every == 0)), "vectors-anchors")
    limit = float(stored.agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0]) ** 2
    if limit >= 2.0**62:
        raise ValueError("vectors are too long for scores of 64 bits")
    out, passes, last = scratch(spark, "hard-negatives"), 0, -1
    while True:
        some = anchors.where(F.col("row") > last).orderBy("row").limit(per_pass).toPandas()
        if not len(some) or not width:
            break
        slab = Slab(some, width)
        last, n = int(slab.row[-1]), len(some)
        anything = np.iinfo(np.int64)
        search = _search(slab, np.full((n, 1), anything.min), np.full((n, 1), anything.max), positives, True, limit)
        top = _top(stored.mapInPandas(search, _FOUND), positives).toPandas()
        place = pd.Series(np.arange(n), index=slab.row)
        low, high = np.full((n, positives), anything.max), np.full((n, positives), anything.min)
        at, slot, score = place[top["anchor"]].to_numpy(), top["rank"].to_numpy() - 1, top["score"].to_numpy(np.int64)
        low[at, slot], high[at, slot] = windows(score)
        search = _search(slab, low, high, negatives, False, limit)
        mined = _top(stored.mapInPandas(search, _FOUND), negatives)
        pairs = spark.createDataFrame(
            pd.DataFrame({"anchor": top["anchor"], "slot": slot.astype(np.int32), "anchor_id": some["id"].to_numpy()[at], "positive_score": score, "positive": top["id"], "positive_named": top["named"]}),
            "anchor long, slot int, anchor_id long, positive_score long, positive long, positive_named boolean",
        )
        mined.join(pairs, ["anchor", "slot"]).select(
            "anchor_id",
            F.when(F.col("positive_named"), F.col("positive")).alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            F.when(F.col("named"), F.col("id")).alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        ).write.parquet(f"{out}/pass={passes}")
        passes += 1
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not passes:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{out}/pass={k}" for k in range(passes)))
