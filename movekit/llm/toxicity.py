"""Toxicity of texts by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movekit.llm.common import narrow
from movekit.llm.quality import training_rows
from movekit.session import stage

# Word classes of the grammar in four languages.
TARGETS = "you your you're youre u ur yourself he she they him her them du dich dir euch sie tu te toi vous usted ustedes ti".split()
NEGATIONS = "not no never isn't aren't don't doesn't nor nicht kein keine nie pas jamais non nunca jamás".split()
REPORTS = "said says say wrote writes quoted quotes called claims claimed sagte schrieb dit écrit dijo escribió".split()
THREATS = "kill killing hurt destroy beat burn shoot stab murder töten umbringen tuer frapper matar golpear".split()

#: Letter counts of the beginnings that are learned beside whole words.
BEGINNINGS = (4, 5, 6)
_STRIP = ".,;:!?\"'()[]{}«»“”…"
_ENDS = (".", "!", "?", ";")
THREAT_WEIGHT = 3.0

#: A transducer: state, then class of the word, to the next state and a factor; "*" stands for any class.
Transducer = dict[int, dict[str, tuple[int, float]]]

#: A negation weakens the insults and threats of the next three words.
NEGATION: Transducer = {
    0: {"negation": (3, 1.0), "*": (0, 1.0)},
    **{k: {"negation": (3, 1.0), "insult": (k - 1, 0.5), "threat": (k - 1, 0.25), "*": (k - 1, 1.0)} for k in (1, 2, 3)},
}
#: A word of reporting weakens what follows in its clause.
REPORTED: Transducer = {
    0: {"report": (1, 1.0), "*": (0, 1.0)},
    1: {"insult": (1, 0.7), "threat": (1, 0.5), "*": (1, 1.0)},
}
#: An insult counts more once its clause has named a target.
TARGET: Transducer = {
    0: {"target": (1, 1.0), "*": (0, 1.0)},
    1: {"insult": (1, 1.25), "*": (1, 1.0)},
}
#: A threat counts only in a clause with a target, and one after another insult or threat counts more.
THREAT: Transducer = {
    0: {"threat": (0, 0.0), "target": (1, 1.0), "*": (0, 1.0)},
    1: {"threat": (2, 1.0), "insult": (2, 1.0), "*": (1, 1.0)},
    2: {"threat": (2, 1.25), "insult": (2, 1.1), "*": (2, 1.0)},
}
CLASSES = ("other", "insult", "threat", "target", "negation", "report")


def compose(*parts: Transducer) -> list[list[tuple[int, float]]]:
    """The product of transducers: per state and class, the next state and the product of factors."""
    start = (0,) * len(parts)
    number, queue, table = {start: 0}, [start], []
    for state in queue:
        row = []
        for c in CLASSES:
            arcs = [p[s].get(c, p[s]["*"]) for p, s in zip(parts, state, strict=True)]
            then = tuple(a[0] for a in arcs)
            if then not in number:
                number[then] = len(number)
                queue.append(then)
            row.append((number[then], math.prod(a[1] for a in arcs)))
        table.append(row)
    return table


GRAMMAR = compose(NEGATION, REPORTED, TARGET, THREAT)


def bare(word: str) -> str:
    return word.lower().strip(_STRIP)


def forms(words: set[str]) -> set[str]:
    """What may be learned from a text: its words, and the beginnings of its longer words as ``abcd*``."""
    out = set()
    for w in words:
        if w:
            out.add(w)
            out.update(w[:k] + "*" for k in BEGINNINGS if len(w) > k)
    return out


@dataclass
class Lexicon:
    """The first transducer: words to classes and weights."""

    insults: dict[str, float]

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, float, bool]] = {}
        self.classes = {w: (CLASSES.index(c), THREAT_WEIGHT * (c == "threat")) for c, ws in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS)) for w in ws}

    def look(self, word: str) -> tuple[int, float, bool]:
        """Class, weight and whether the word ends its clause."""
        found = self.known.get(word)
        if found is None:
            w = bare(word)
            weight = max([self.insults.get(w, 0.0), *(self.insults.get(w[:k] + "*", 0.0) for k in BEGINNINGS if len(w) > k)])
            c, x = (1, weight) if weight > 0 else self.classes.get(w, (0, 0.0))
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[word] = (c, x, word.endswith(_ENDS))
        return found


def clause_scores(text: str | None, lexicon: Lexicon) -> list[float]:
    """The scores of the clauses that match, each the sum of its words' weights times their factors."""
    text = text or ""
    look = lexicon.look
    known = lexicon.known
    hot = any((known.get(w) or look(w))[0] in (1, 2) for w in set(text.split()))
    if not hot:
        return []
    scores = []
    for line in text.split("\n"):
        state, total = 0, 0.0
        for w in line.split():
            c, weight, ends = look(w)
            state, factor = GRAMMAR[state][c]
            total += weight * factor
            if ends:
                if total > 0:
                    scores.append(total)
                state, total = 0, 0.0
        if total > 0:
            scores.append(total)
    return scores


def evidence(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    """Two numbers per text: the sum of its clause scores on a log scale, and the best clause's."""
    s = clause_scores(text, lexicon)
    return math.log1p(sum(s)), math.log1p(max(s, default=0.0))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights and intercept (last), by Newton's method with a small ridge on the weights."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn_insults(rows: DataFrame, *, most: int = 500, least_g2: float = 20.0, least_weight: float = 2.0) -> dict[str, float]:
    """Words and beginnings that mark label 1, with their log odds; at most ``most`` of them.

    A form is taken if its documents differ between the labels beyond chance (a likelihood ratio of
    ``least_g2``) and by at least ``least_weight`` nats.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(pdf["text"], pdf["y"], strict=True):
                seen[int(y)].update(forms({bare(w) for w in (t or "").split()}))
                seen[int(y)][""] += 1
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"form": keys, "clean": [seen[0][k] for k in keys], "toxic": [seen[1][k] for k in keys]})

    counts = rows.mapInPandas(count, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stage(counts.where("form = '' or toxic >= 3"), "toxic-forms")
    total = counts.where("form = ''").first()
    if total is None or not total["clean"] or not total["toxic"]:
        return {}
    nt, nc = float(total["toxic"]), float(total["clean"])
    t, c = F.col("toxic"), F.col("clean")
    weight = F.log((t + 0.5) / F.lit(nt + 1)) - F.log((c + 0.5) / F.lit(nc + 1))
    share = (t + c) / F.lit(nt + nc)

    def part(seen, expected):  # noqa: ANN001, ANN202
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    g2 = 2 * (part(t, share * nt) + part(c, share * nc))
    best = counts.where("form <> ''").select("form", weight.alias("weight"), g2.alias("g2")).where(f"g2 >= {least_g2} and weight >= {least_weight}")
    best = best.orderBy(F.desc("g2"), "form").limit(most)
    return {r["form"]: float(r["weight"]) for r in best.collect()}


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_train: int = 20_000, threshold: float = 0.7, folds: int = 3, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Toxicity of every whole text by a weighted finite-state grammar.

    Method: a lexicon transducer maps words to classes (insult, threat, target, negation, report) and
    weights. Its insults, words and beginnings of words, and their weights are learned from labelled rows.
    Transducers for negation, reported speech, targets and threats are composed into one table
    of states. A clause (up to a mark like ``.`` or a line break) is one run of it and scores the sum
    of its words' weights times the factors of their context; a word alone decides nothing. A logistic
    curve over a text's matched clauses makes the score. Both are fitted on at most ``max_train`` labelled
    rows, chosen by a hash of the id outside the held-out fold (crc32 of the id as text, modulo ``folds``,
    is ``held_fold``). Labels, language, source and id are no inputs.

    Defined results: null, empty and blank texts match nothing and get the score of no match; without
    labels of both kinds every score is 0; ids labelled more than once count by majority; repeated rows are
    scored one by one; a null id is not held out; an empty table gives no rows.

    Returns ``<id>, held_out, score, predicted, n_clauses``.
    """
    fold = f"crc32(cast(cast(id as string) as binary)) % {folds} = {held_fold}"
    # Read twice, and at most ``max_train`` texts.
    train = stage(training_rows(docs, labels, label, fold, max_train, id_col, text_col), "toxic-train")
    lexicon_words = learn_insults(train)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(lexicon_words)
        for pdf in batches:
            x = [evidence(t, lexicon) for t in pdf["text"]]
            yield pd.DataFrame({"total": [a for a, _ in x], "best": [b for _, b in x], "y": pdf["y"].to_numpy()})

    sample = train.mapInPandas(measure, "total double, best double, y int").toPandas().sort_values(["total", "best", "y"])
    y = sample["y"].to_numpy(np.float64)
    fitted = fit_logistic(sample[["total", "best"]].to_numpy(np.float64), y) if 0 < y.sum() < len(y) else np.array([0.0, 0.0, -30.0])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(lexicon_words)
        for pdf in batches:
            found = [clause_scores(t, lexicon) for t in pdf["text"]]
            z = np.array([math.log1p(sum(s)) * fitted[0] + math.log1p(max(s, default=0.0)) * fitted[1] + fitted[2] for s in found])
            s = 1 / (1 + np.exp(-z))
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32), "n_clauses": [len(f) for f in found]})

    rows = narrow(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(F.expr(fold), F.lit(False)))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(score, f"id {id_type}, held_out boolean, score double, predicted int, n_clauses int").withColumnRenamed("id", id_col)
