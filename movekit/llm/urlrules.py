"""Allow and block rules for URLs, found by a sort-merge sweep over reversed hosts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movekit.llm.common import narrow, shuffle_width
from movekit.session import stage

# The rules of the registered query, (rule, verdict).
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
DEFAULT = "allow"
#: Closes every label of a key; it sorts below all characters of a host.
_END = "\x01"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path``; both are empty for a null url and one without ``://``."""
    rest = narrow(pages, id_col, url_col).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rest = rest.select("id", F.coalesce(_after_scheme(F.col("url")), F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return rest.select(
        "id",
        _ascii_lower(host).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def host_key(host: Column) -> Column:
    """The labels in reverse order, each closed, so that a host's subdomains follow it as one interval."""
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), _END), F.lit(_END))
    return F.when(host == "", F.lit("")).otherwise(key)


def rules_frame(spark, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """``rule, verdict`` as a DataFrame."""
    return spark.createDataFrame([*rules], "rule string, verdict string")


def apply_rules(
    pages: DataFrame, rules: DataFrame, *, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """The longest rule that fits each URL, and its verdict, or ``default`` where none fits.

    A rule ``host/path`` fits the host and all its subdomains if the URL's path starts with the
    rule's. Longest means the longest host, then the longest path.

    Method: a sort-merge range join. The reversed host with closed labels is a key under which a rule's
    host and its subdomains form one interval, and intervals of two rules are nested or apart. Rules and
    URLs are sorted together by range; the id and path also order them, so one hot host is spread over
    many tasks. A sweep keeps a stack of the rule hosts whose interval is open and pops those the
    current key has left. Each range also gets the rules that are open at its first key: these are
    found by joining the key's own prefixes, at most one per label, with the rules. Rules are never
    broadcast or collected; the driver sees nothing.

    Defined results: host and path are empty for a null url or one without ``://``, and no rule fits an
    empty host; rules with a null or empty host are ignored; of equal rules the smallest verdict counts;
    repeated pages are answered one by one; empty tables give no rows, or only defaults.

    Returns ``<id>, host, path, rule, verdict``.
    """
    spark = pages.sparkSession
    n = shuffle_width(spark)
    parsed = split_url(pages, id_col, url_col)
    id_type = parsed.schema["id"].dataType.simpleString()
    facts = rules.select(
        _ascii_lower(F.regexp_extract("rule", r"^[^/]*", 0)).alias("host"),
        F.regexp_extract("rule", r"^[^/]*(.*)", 1).alias("path"),
        F.col("rule").alias("rule"),
        F.col("verdict").alias("verdict"),
    ).where("host <> ''")
    facts = facts.groupBy("host", "path").agg(F.min("rule").alias("rule"), F.min("verdict").alias("verdict"))
    facts = facts.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "host", "path", "rule", "verdict")
    urls = parsed.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))

    ranged = facts.unionByName(urls).repartitionByRange(n, "key", "kind", "path", "id")
    ranged = stage(ranged.withColumn("part", F.spark_partition_id()), "url-ranges")

    first = ranged.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split(F.col("first"), _END, -1)
    ancestors = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), _END), F.lit(_END)),
    )
    open_keys = first.select("part", F.explode(ancestors).alias("key"))
    carried = ranged.where("kind = 0").drop("part").join(open_keys, "key").select(ranged.columns)
    both = ranged.unionByName(carried).repartition(n, "part").sortWithinPartitions("part", "key", "kind")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, stack = None, []  # stack: (key, host, {path: (rule, verdict)}) of the open intervals
        for pdf in batches:
            out = []
            for p, key, kind, i, host, path, rule, verdict in zip(*(pdf[c].array for c in ("part", "key", "kind", "id", "host", "path", "rule", "verdict")), strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}))
                    stack[-1][2][path] = (rule, verdict)
                    continue
                found = (None, default)
                for _, domain, paths in reversed(stack):
                    if host != domain and not host.endswith("." + domain):
                        continue  # a host with control characters in it
                    cut = next((c for c in range(len(path), -1, -1) if path[:c] in paths), None)
                    if cut is not None:
                        found = paths[path[:cut]]
                        break
                out.append((i, host, path, *found))
            frame = pd.DataFrame(out, columns=[id_col, "host", "path", "rule", "verdict"], dtype=object)
            yield frame

    return both.mapInPandas(sweep, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
