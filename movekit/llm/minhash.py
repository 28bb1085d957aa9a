"""Near duplicates by MinHash with tensored banding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.llm.common import narrow, shuffle_width, small_batches
from movekit.llm.components import connected_components
from movekit.llm.hashing import LOWER, U64, mix64, shingle_sets
from movekit.session import stage


def normal_words(text: str | None) -> bytes:
    """The words of a text in lower case, one space between them."""
    return b" ".join((text or "").encode().translate(LOWER).split())


#: Members of a table entry are compared in blocks of at most about so many texts and shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 18
#: Entries of up to so many texts give their few pairs as rows instead: no text has more than so many partners there.
FEW_TEXTS = 32


def collections(sets: list[np.ndarray], n_left: int, n_right: int, rows: int, seed: int) -> np.ndarray:
    """Per set, none of them empty, ``n_left + n_right`` keys of ``rows`` minhashes each."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    total = (n_left + n_right) * rows
    salts = mix64(np.arange(1, 2 * total + 1, dtype=np.uint64) + U64(seed << 32))
    keys = np.zeros((len(sets), n_left + n_right), np.uint64)
    with np.errstate(over="ignore"):
        for f in range(total):
            least = np.minimum.reduceat((flat ^ salts[2 * f]) * (salts[2 * f + 1] | U64(1)), starts)
            c, least = f // rows, mix64(least)
            keys[:, c] = mix64(keys[:, c] * U64(0x9E3779B97F4A7C15) + least + U64(c + 1))
    return keys


def _summaries(n_left: int, n_right: int, rows: int, k: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):  # few texts at a time hold memory
                yield summary(pdf.iloc[at : at + 500])

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [normal_words(t) for t in pdf["text"]]
        sets = shingle_sets(texts, k)
        digests = class_digests(texts, sets, k)
        left, right = ([None] * len(sets) for _ in range(2))
        block = [i for i, s in enumerate(sets) if len(s)]
        while block:
            part, size = [], 0
            while block and (not part or size + len(sets[block[-1]]) <= 1 << 18):
                part.append(block.pop())
                size += len(sets[part[-1]])
            keys = collections([sets[i] for i in part], n_left, n_right, rows, seed)
            for i, row in zip(part, keys.view(np.int64), strict=True):
                left[i], right[i] = row[:n_left], row[n_left:]
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "digest": digests, "n": [len(s) for s in sets], "l": left, "r": right})

    return run


def class_digests(texts: list[bytes], sets: list[np.ndarray], k: int) -> list[bytes | None]:
    """Equal for texts of the same words or the same single shingle; None without words."""
    # All shingles of a text are one only if it repeats one word or has at most ``k``: its first ``k`` words tell it.
    alike = [b" ".join(t.split(b" ", k)[:k]) if len(s) == 1 else t for t, s in zip(texts, sets, strict=True)]
    return [hashlib.blake2b(t, digest_size=16).digest() if t else None for t in alike]


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                texts = [normal_words(t) for t in pdf["text"].iloc[at : at + 500]]
                sets = shingle_sets(texts, k)
                yield pd.DataFrame({"digest": class_digests(texts, sets, k), "s": [s.view(np.int64) for s in sets]})

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, as products of 0/1 matrices."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    place, row = [], []
    for flat, sets in ((flat_a, a), (flat_b, b)):
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        met = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        place.append(at[met])
        row.append(np.repeat(np.arange(len(sets)), [len(s) for s in sets])[met])
    for c in range(0, len(common), 1 << 13):
        width = min(1 << 13, len(common) - c)
        parts = []
        for at, of, n in zip(place, row, (len(a), len(b)), strict=True):
            here = (at >= c) & (at < c + width)
            m = np.zeros((n, width), np.float32)
            m[of[here], at[here] - c] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _compare(percent: int, n_right: int):
    """Links between the two sides of a block of a table entry, in different components and first met in this table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        x, y = pdf[side == 0], pdf[side == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        xv, yv = x["v"].to_numpy(), y["v"].to_numpy()
        xc, yc = x["component"].to_numpy(), y["component"].to_numpy()
        # A pair comes once: two outside the largest component meet on both sides, one inside it only here.
        fit = (xc[:, None] != yc[None, :]) & ((yc == y["largest"].to_numpy())[None, :] | (xv[:, None] > yv[None, :]))
        nx, ny = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
        fit &= 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
        i, j = divmod(int(pdf["t"].iloc[0]), n_right)
        for c, upto in (("l", i), ("r", j)):
            p, q = np.stack(x[c].to_numpy()), np.stack(y[c].to_numpy())
            for k in range(upto):
                fit &= p[:, None, k] != q[None, :, k]
        keep_x, keep_y = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
        if not len(keep_x):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        both = overlaps([x["s"].iloc[k] for k in keep_x], [y["s"].iloc[k] for k in keep_y]).astype(np.int64)
        nx, ny = nx[keep_x], ny[:, keep_y]
        p, q = np.nonzero(fit[np.ix_(keep_x, keep_y)] & (100 * both >= percent * (nx + ny - both)))
        return pd.DataFrame({"a": xv[keep_x[p]], "b": yv[keep_y[q]]})

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    percent: int = 85,
    k: int = 5,
    n_left: int = 10,
    n_right: int = 10,
    rows: int = 3,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents linked by ``100 * |A & B| >= percent * |A | B|`` over ``k``-word shingles.

    Method: tensored banding. Two small collections of ``n_left`` and ``n_right`` keys, ``rows``
    minhashes each, are computed per document; every pair of a left and a right key is the key of one
    table, so ``n_left * n_right`` tables of ``2 * rows`` minhashes cost only
    ``(n_left + n_right) * rows`` minhashes. With the defaults 100 tables cost 60 minhashes instead of
    600, and a pair at 0.85 shares a table with probability 0.9998.

    Texts with the same words, and texts of the same single shingle (one word repeated ``k`` times or more
    often), are one class from the start; links are between classes, whatever ids they have. Inside a
    table entry, members are first compared with one of them only, a star, then in some
    entries with another one, and the confirmed links give components. Then entries that still hold
    several components have every member outside the entry's largest component compared with all
    members of other components, block by block: a task gets two blocks of texts, multiplies their shingle
    matrices and returns links alone. Pairs inside one component cannot change the result and are never
    compared; entries of a few texts give their pairs as rows. What may be missed: of pairs at exactly 0.85, about 1.5 in 10,000 share no table; the share
    falls fast above 0.85. All links are
    confirmed on full shingle sets, which are made only for documents that share an entry.

    Defined results: null, empty and blank texts have no shingles, no links and are kept; a text of
    fewer than ``k`` words is one shingle; rows that repeat an id are one document if their texts are
    equal, else all their texts are linked by the id; a null id is carried through and linked with nothing; an
    empty table gives no rows. Other columns are ignored.

    Returns ``<id>, n_shingles, component_id, kept``.
    """
    rows_in = narrow(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows_in.schema["id"].dataType.simpleString()
    summary = rows_in.mapInPandas(_summaries(n_left, n_right, rows, k, seed), f"id {id_type}, digest binary, n long, l array<bigint>, r array<bigint>")
    with small_batches(docs.sparkSession):
        summary = stage(summary, "near-summaries")
    classes = (
        summary.where("digest is not null and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.max("n").alias("n"), *(F.first(c).alias(c) for c in "lr"))
    )
    classes = stage(classes.withColumn("v", F.xxhash64("digest")), "near-classes")
    if not classes.groupBy("v").count().where("count > 1").isEmpty():
        raise RuntimeError("two of the classes share a 64-bit number; change the digest")

    table_keys = F.flatten(
        F.transform("l", lambda a, i: F.transform("r", lambda b, j: F.xxhash64(a, b, i * F.lit(n_right) + j)))
    )
    # A text of one shingle shares a class with all that have the same one; others have two or more and are similar to it by half at most.
    several = classes.where("n > 1") if percent > 50 else classes
    # A class makes a row for every table: they are dealt anew, so that no task makes more than its part.
    dealt = several.select("v", "l", "r").repartition(shuffle_width(docs.sparkSession), "v")
    entries = dealt.select("v", F.explode(table_keys).alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("v").alias("hub")).where("members > 1")
    members = stage(entries.join(shared, "key").select("key", "v", "hub"), "near-members")

    sizes = classes.select("v", "n")
    wanted = classes.select("v", "digest", "rep").join(members.select("v").distinct(), "v", "left_semi")
    repeats = _repeats(summary)
    wanted = stage(wanted, "near-candidates")
    sets = rows_in.where("id is not null").join(wanted.select(F.col("rep").alias("id")), "id", "left_semi").mapInPandas(_sets(k), "digest binary, s array<bigint>")
    sets = sets.join(wanted.select("digest", "v"), "digest").select("v", "s")
    with small_batches(docs.sparkSession):
        sets = stage(sets.dropDuplicates(["v"]) if repeats else sets, "near-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that pass on their full sets; sizes are compared first."""
        left, right = sizes.toDF("a", "na"), sizes.toDF("b", "nb")
        fit = pairs.join(left, "a").join(right, "b")
        fit = fit.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
        met = fit.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        passed = met.where(100 * both >= F.lit(percent) * (F.size("sa") + F.size("sb") - both))
        return stage(passed.select("a", "b"), "near-links")

    def mixed(entries: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of entries that hold several components, with their entry's largest one."""
        placed = entries.join(found.withColumnRenamed("id", "v"), "v", "left").select("key", "v", F.coalesce("component", "v").alias("component"))
        per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        per = per.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("size", "component")).alias("largest"))
        return stage(placed.join(per.where("parts > 1"), "key").select("key", "v", "component", "largest"), "near-mixed")

    star = members.where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct()
    links = confirmed(star)
    if repeats:  # all texts of an id belong together
        named = summary.where("digest is not null and id is not null").select("id", "digest").distinct().join(classes.select("digest", "v"), "digest")
        several = named.groupBy("id").agg(F.min("v").alias("b"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
        same_id = named.join(several, "id").where("v <> b").select(F.col("v").alias("a"), "b")
        links = links.unionByName(stage(same_id.distinct(), "near-links"))

    # Large groups of near copies whose members differ more from the first one than from others: another
    # star in every sixth entry, around a member that differs from entry to entry.
    left = mixed(members, connected_components(links))
    sixth = left.where(F.pmod("key", F.lit(6)) == 0)
    hubs = sixth.groupBy("key").agg(F.min_by(F.struct("v", "component"), F.xxhash64("v", "key")).alias("h"))
    star = sixth.join(hubs, "key").where("component <> h.component")
    star = star.select(F.greatest("v", "h.v").alias("a"), F.least("v", "h.v").alias("b")).distinct()
    links = links.unionByName(confirmed(star))

    left = mixed(left.select("key", "v"), connected_components(links))
    counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    few = left.join(counts.where(F.col("texts") <= FEW_TEXTS).select("key"), "key")
    many = left.join(counts.where(F.col("texts") > FEW_TEXTS).select("key"), "key")
    links = links.unionByName(confirmed(_few_pairs(few, classes, n_right))).unionByName(_across(many, classes, sets, table_keys, percent, n_right))
    found = stage(connected_components(links), "near-components")

    placed = classes.select("digest", "rep", "v").join(found.withColumnRenamed("id", "v"), "v", "left")
    placed = placed.select("digest", "rep", F.coalesce("component", "v").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    final = placed.join(least, "root").select(F.col("digest").alias("cd"), "component")
    known = F.when(F.col("id").isNotNull(), F.col("component"))
    out = summary.join(final, summary["digest"] == final["cd"], "left").select(
        "id", "n", F.coalesce(known, F.col("id")).alias("component")
    )
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def _few_pairs(left: DataFrame, classes: DataFrame, n_right: int) -> DataFrame:
    """Pairs ``a, b`` across the components of small table entries.

    A pair comes once: in the entry of the first left and the first right key that both have.
    """
    left = left.join(classes.select("v", "l", "r"), "v")
    outside = left.where("component <> largest").select(F.col("key").alias("x_key"), *(F.col(c).alias(f"x_{c}") for c in ("v", "component", "l", "r")))
    i = F.array_position(F.zip_with("l", "x_l", lambda a, b: a == b), True).cast("int") - 1
    j = F.array_position(F.zip_with("r", "x_r", lambda a, b: a == b), True).cast("int") - 1
    first = F.xxhash64(F.get("l", i), F.get("r", j), i * F.lit(n_right) + j)
    once = F.expr("x_component <> component and (component = largest or x_v > v)")
    pairs = outside.join(left, (F.col("x_key") == F.col("key")) & once & (first == F.col("key")))
    return pairs.select(F.greatest("x_v", "v").alias("a"), F.least("x_v", "v").alias("b"))


def _across(left: DataFrame, classes: DataFrame, sets: DataFrame, table_keys: Column, percent: int, n_right: int) -> DataFrame:
    """Links across the components of table entries; ``left`` has the members of entries with several of them."""
    dealt = _in_blocks(left, classes, sets, table_keys)
    return stage(dealt.groupBy("key", "bx", "by").applyInPandas(_compare(percent, n_right), "a long, b long"), "near-links")


def _in_blocks(left: DataFrame, classes: DataFrame, sets: DataFrame, table_keys: Column) -> DataFrame:
    """The two sides of every block of pairs of the entries.

    An entry is dealt in blocks of pairs, members outside its largest component against all, so that its size only adds
    tasks. Both sides are counted first and cut by their own size: a member is repeated once per block of the outside, and
    only members outside once per block of the entry.
    """
    outside = F.col("component") != F.col("largest")
    counted = left.join(classes.select("v", "n"), "v").groupBy("key")

    def blocks(of: Column) -> Column:
        texts, shingles = F.count_if(of), F.sum(F.when(of, F.col("n")))
        return F.greatest(F.ceil(texts / BLOCK_TEXTS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    per = counted.agg(blocks(outside).alias("nx"), blocks(F.lit(True)).alias("ny"))
    rows = left.join(per, "key").join(classes.select("v", "n", "l", "r"), "v").join(sets, "v")
    rows = rows.withColumn("t", (F.array_position(table_keys, F.col("key")) - 1).cast("int"))
    own = lambda n: F.pmod(F.xxhash64("v", "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["key", "v", "component", "largest", "n", "l", "r", "s", "t"]
    x = rows.where(outside).select(*kept, F.lit(0).alias("side"), own("nx").alias("bx"), every("ny").alias("by"))
    y = rows.select(*kept, F.lit(1).alias("side"), every("nx").alias("bx"), own("ny").alias("by"))
    return x.unionByName(y)


def _repeats(summary: DataFrame) -> bool:
    return not summary.groupBy("id").count().where("count > 1 and id is not null").isEmpty()
