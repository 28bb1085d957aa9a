"""Quality rules: base counts of each text and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.llm.common import BLANKS, narrow, words
from movekit.session import stage

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a repeated window.
WINDOW = 8
BUCKETS = 1 << 16
_LOWEST = 1 << 15
#: Weights are kept as whole thousandths, so that sums and verdicts do not depend on any order.
SCALE = 1000
#: Documents scoring below this mean (thousandths per n-gram) are dropped.
THRESHOLD = -60
SMOOTHING = 8.0


def base_counts(words: str, text: Column) -> dict[str, Column]:
    """The counts that need no corpus: words, their characters, symbols, repeated lines and windows."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _with_repeat_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside windows of ``WINDOW`` words that occur twice or more.

    Windows are compared as text, but only in texts with enough repeated runs of four words: a window
    that occurs again repeats ``WINDOW - 3`` of them.
    """
    n = F.greatest(F.size("grams") - 2, F.lit(0))
    fours = F.zip_with(F.slice("grams", F.lit(1), n), F.slice("grams", F.lit(3), n), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("fours", fours)
    maybe = F.size("fours") - F.size(F.array_distinct("fours")) >= WINDOW - 3
    windows = F.transform(
        F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.struct(F.array_join(F.slice("w", i + 1, F.lit(WINDOW)), " ").alias("t"), i.alias("i"))
    )
    rows = rows.withColumn("windows", F.when(maybe, F.array_sort(windows))).drop("fours")
    m = F.size("windows") - 1
    # Neighbours in sorted order that are equal; both of each pair are repeated.
    equal = F.zip_with(
        F.slice("windows", F.lit(1), m),
        F.slice("windows", F.lit(2), m),
        lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    rows = rows.withColumn("at", F.when(F.col("windows").isNotNull(), F.array_sort(F.array_distinct(F.flatten(equal))))).drop("windows")
    k = F.size("at") - 1
    steps = F.zip_with(F.slice("at", F.lit(1), k), F.slice("at", F.lit(2), k), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)
    # Without a repeated window ``at`` is null or empty and its size at most 0.
    return rows.withColumn("n_repeat_words", F.when(F.size("at") > 1, covered).otherwise(F.lit(0)).cast("long")).drop("at")


def _with_grams(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Adds ``grams``, the buckets of all pairs of neighbouring words of ``w``, less ``_LOWEST`` to fit two bytes."""
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("w", F.lit(1), n),
        F.slice("w", F.lit(2), n),
        lambda a, b: (F.pmod(F.xxhash64(a, b), F.lit(n_buckets)) - _LOWEST).cast("short"),
    )
    return rows.withColumn("grams", pairs)


def ngram_weights(grams: DataFrame, trusted: DataFrame, *, n_buckets: int = BUCKETS) -> DataFrame:
    """``bucket, weight`` (whole thousandths of a nat) from ``id, grams`` rows and the ids of trusted rows.

    All rows make the raw multinomial, the trusted ones the target; both are smoothed by
    ``SMOOTHING`` per bucket. Counts are summed in each task before the shuffle, so at most
    ``n_buckets`` rows leave a task.
    """
    good = trusted.toDF("good").where("good is not null").distinct()
    # The trusted ids grow with the corpus: the rows' two-byte buckets are shuffled, nothing is broadcast.
    rows = grams.join(good.hint("shuffle_merge"), grams["id"] == good["good"], "left")
    # explode would add a filter on the size; the outer form leaves the scan alone.
    each = rows.select(F.col("good").isNotNull().cast("long").alias("good"), F.explode_outer("grams").alias("bucket"))
    each = each.withColumn("bucket", F.col("bucket").cast("int") + _LOWEST)
    counts = each.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    counts = stage(counts, "ngram-counts")
    totals = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw, target = float(totals["raw"] or 0), float(totals["target"] or 0)
    ratio = F.log((F.col("target") + F.lit(SMOOTHING)) / F.lit(target + SMOOTHING * n_buckets)) - F.log(
        (F.col("raw") + F.lit(SMOOTHING)) / F.lit(raw + SMOOTHING * n_buckets)
    )
    return counts.select("bucket", F.round(ratio * SCALE).cast("int").alias("weight"))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    n_buckets: int = BUCKETS,
    threshold: int = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base rules and the n-gram log-likelihood ratio of every document, with a fixed verdict.

    Method: pairs of neighbouring words are hashed into ``n_buckets`` (65,536 at most). The ratio of the target's to
    the raw corpus' multinomial gives each bucket a weight; a document's score is the sum of its
    weights by the number of its n-grams. It is kept if no base rule fails and the score is at least
    ``threshold`` thousandths. Weights are whole numbers, so verdicts never depend on the order of
    sums. The table of weights has ``n_buckets`` entries at most, whatever the corpus, and reaches the
    tasks as one constant array. Texts are read once: counts and buckets are written as a narrow table,
    from which both the weights and the scores come. Everything is built-in expressions.

    Defined results: null, empty and blank texts have no words, all counts 0, score 0 and fail the
    base rules (fewer than 20 words); repeated rows are judged one by one; without trusted documents all
    weights come from smoothing alone; an empty table gives no rows. Other columns are ignored.

    Returns ``<id>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    llr_sum, n_grams``.
    """
    rows = narrow(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("w", words(F.col("text")))
    rows = rows.select("id", "w", *(c.alias(k) for k, c in base_counts("w", F.col("text")).items()))
    rows = stage(_with_repeat_words(_with_grams(rows, n_buckets)).drop("w"), "ngram-rows")

    weights = ngram_weights(rows.select("id", "grams"), narrow(trusted, id_col), n_buckets=n_buckets)
    table = [0] * n_buckets
    for row in weights.collect():  # at most n_buckets rows
        table[row["bucket"]] = row["weight"]
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")

    total = F.aggregate("grams", F.lit(0).cast("long"), lambda s, b: s + F.get(constant, b.cast("int") + _LOWEST))
    rows = rows.withColumn("llr_sum", total).withColumn("n_grams", F.size("grams").cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr_sum") >= F.lit(threshold) * F.col("n_grams")))
    return rows.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_sum", "n_grams"
    )
