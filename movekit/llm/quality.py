"""Quality scores of texts by an additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movekit.llm.common import narrow
from movekit.session import stage

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_neighbours", "distinct_pairs", "distinct_lines",
    "upper", "symbols", "exclamation", "digits", "points", "bars", "breaks", "non_ascii", "entropy", "longest_word",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>@^~=+_\\{}[]")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,;:?")] = True


def features(text: str | None) -> list[float]:
    """Numbers about the form of a text; all 0 for null and empty ones."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = count[count > 0] / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = size - count[32] - count[9:14].sum()
    return [
        np.log(n), letters / n, len(set(words)) / n, same / n, len(pairs) / max(n - 1, 1), len(set(lines)) / len(lines),
        count[_UPPER].sum() / size, count[_SYMBOL].sum() / size, count[33] / size, count[_DIGIT].sum() / size,
        count[_POINT].sum() / n, count[124] / n, len(lines) / n, count[128:].sum() / size, -(share * np.log(share)).sum(),
        np.log(max(map(len, words))),
    ]


def _table(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    """Lookup tables per feature and per pair of features; a score is a sum of table entries."""

    edges: list[np.ndarray]
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: one lookup and addition per table for all rows at once."""
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.single):
            z += t[b[:, f]]
        for f, g, t in self.pairs:
            z += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-z))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Best split of a row of bins: (gain, bins on the left side; 0 for none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1 if gain[k] > 0 else 0


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """A tree of depth two over the bins of one feature, as its value in every bin."""
    out = np.zeros(len(g))
    _, root = _cut(g, h, ridge, least)
    for side in (slice(0, root), slice(root, len(g))) if root else (slice(0, len(g)),):
        _, k = _cut(g[side], h[side], ridge, least)
        at = side.start + k
        for leaf in (slice(side.start, at), slice(at, side.stop)):
            if leaf.stop > leaf.start:
                out[leaf] = g[leaf].sum() / (h[leaf].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """A cut of the first feature, then one of the second on each side: (gain, value in every cell)."""
    out, total = np.zeros(g.shape), -(g.sum() ** 2) / (h.sum() + ridge)
    best = (-np.inf, 0)
    for k in range(1, g.shape[0]):
        gain = sum(_cut(g[s].sum(0), h[s].sum(0), ridge, least)[0] + g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (slice(0, k), slice(k, None)))
        best = max(best, (gain, k))
    for s in (slice(0, best[1]), slice(best[1], None)):
        _, k = _cut(g[s].sum(0), h[s].sum(0), ridge, least)
        for t in (slice(0, k), slice(k, None)):
            if g[s, t].size:
                out[s, t] = g[s, t].sum() / (h[s, t].sum() + ridge)
    return best[0] + total, out


def fit(x: np.ndarray, y: np.ndarray, *, n_bins: int = 32, cycles: int = 120, n_pairs: int = 6, pair_cycles: int = 40, rate: float = 0.15, ridge: float = 2.0, least: float = 1.0) -> AdditiveModel:
    """Cyclic boosting: every round visits each feature in turn with one small step by a shallow tree.

    The features come first; then the pairs whose trees would still gain most are visited in
    the same way. Without rows of both labels the score is the share of label 1 (0.5 without rows).
    """
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    quantiles = np.linspace(0, 1, n_bins + 1)[1:-1]
    model = AdditiveModel([np.unique(np.quantile(x[:, f], quantiles)) if len(x) else np.empty(0) for f in range(x.shape[1])])
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    sizes = [len(e) + 1 for e in model.edges]
    model.single = [np.zeros(n) for n in sizes]
    if not 0 < y.sum() < len(y):
        return model
    b = model.bins(x)
    z = np.full(len(y), model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for f, n in enumerate(sizes):
            r, w = gradients()
            step = rate * _tree(np.bincount(b[:, f], r, n), np.bincount(b[:, f], w, n), ridge, least)
            model.single[f] += step
            z += step[b[:, f]]

    def cells(f: int, g: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, f] * sizes[g] + b[:, g], v, sizes[f] * sizes[g]).reshape(sizes[f], sizes[g])

    r, w = gradients()
    gains = [(_pair_tree(cells(f, g, r), cells(f, g, w), ridge, least)[0], f, g) for f, g in combinations(range(len(sizes)), 2)]
    model.pairs = [(f, g, np.zeros((sizes[f], sizes[g]))) for _, f, g in sorted(gains, reverse=True)[:n_pairs]]
    for _ in range(pair_cycles):
        for f, g, t in model.pairs:
            r, w = gradients()
            step = rate * _pair_tree(cells(f, g, r), cells(f, g, w), ridge, least)[1]
            t += step
            z += step[b[:, f], b[:, g]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: str, limit: int, id_col: str, text_col: str) -> DataFrame:
    """``text, y`` of at most ``limit`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    ids = narrow(labels, id_col, label).select(F.col(id_col).alias("id"), F.col(label).alias("y")).where("id is not null and y is not null")
    ids = ids.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).where(f"not ({fold})")
    ids = stage(ids.orderBy(F.xxhash64("id"), "id").limit(limit), "labelled-ids")
    rows = narrow(docs, id_col, text_col).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # At most ``limit`` ids.
    return rows.join(F.broadcast(ids), rows["doc"] == ids["id"]).select("text", "y")


def score_quality(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_train: int = 20_000, threshold: float = 0.3, folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """Quality of every whole text by a generalised additive model with pairwise interactions.

    Method: numbers about the form of a text (``FEATURES``) are cut into bins; cyclic boosting of
    shallow trees fits one lookup table per feature and then one per selected pair. Scoring adds table
    entries for all rows of a batch at once. It is fitted on at most ``max_train`` labelled rows, chosen by
    a hash of the id among those outside the held-out fold (crc32 of the id as text, modulo ``folds``, is
    ``held_fold``); only their features reach the driver. Labels, language, source and id are no inputs.

    Defined results: null, empty and blank texts have all features 0 and get the score of that bin; without
    labels of both kinds every score is the share of label 1; ids labelled more than once count by
    majority; repeated rows are scored one by one; a null id is not held out; an empty table gives no rows.

    Returns ``<id>, held_out, score, predicted``, and ``row_col``, a key of the row, if one is named.
    """
    fold = f"crc32(cast(cast(id as string) as binary)) % {folds} = {held_fold}"
    train = training_rows(docs, labels, label, fold, max_train, id_col, text_col)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(_table(pdf["text"]), columns=list(FEATURES)).assign(y=pdf["y"].to_numpy())

    sample = train.mapInPandas(measure, ", ".join(f"{f} double" for f in FEATURES) + ", y int").toPandas()
    sample = sample.sort_values(list(sample.columns))  # the same model whatever the order of tasks
    model = fit(sample[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES)), sample["y"].to_numpy(np.float64))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = model.score(_table(pdf["text"]))
            out = pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})
            yield out.assign(**{c: pdf[c] for c in carried})

    carried = [row_col] if row_col else []
    rows = narrow(docs, id_col, text_col, *carried).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried)
    rows = rows.withColumn("held_out", F.coalesce(F.expr(fold), F.lit(False)))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(score, f"id {id_type}, held_out boolean, score double, predicted int" + "".join(f", {c} long" for c in carried)).withColumnRenamed("id", id_col)
