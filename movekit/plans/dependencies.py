"""What a changed plan item reopens: everything that depends on it, directly or through others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movekit.operators.changes import BROADCAST_ROWS
from movekit.session import by_key, stage

#: Rounds whose finds are read one by one before they are written as one table.
COMPACT = 8


def plan_edges(chunks: DataFrame, jobs: DataFrame, checks: DataFrame) -> DataFrame:
    """``node, depends_on`` of a plan: imports need their chunk, checks all imports into their target.

    ``chunks`` has project and chunk_id, ``jobs`` project, job_id, depends_on and target_object, ``checks`` project,
    check_id and target_object. Nodes are ``project/kind/id``.
    """

    def name(kind: str, column: str):
        return F.concat_ws("/", "project", F.lit(kind), F.col(column))

    held = chunks.select("project", F.col("chunk_id").alias("depends_on")).distinct()
    imports = jobs.join(held, ["project", "depends_on"], "left_semi").select(name("import", "job_id").alias("node"), name("chunk", "depends_on").alias("depends_on"))
    into = jobs.select("project", "target_object", name("import", "job_id").alias("depends_on"))
    verified = checks.join(into, ["project", "target_object"]).select(name("check", "check_id").alias("node"), "depends_on")
    return imports.unionByName(verified).distinct()


def changed_items(before: DataFrame, now: DataFrame, ids: Sequence[str] = ("node",)) -> DataFrame:
    """Items that are new or whose fingerprint differs from the one recorded; items that are gone count as changed too."""
    old = before.select(*ids, F.col("fingerprint").alias("_old"))
    both = now.select(*ids, "fingerprint").join(by_key(old), list(ids), "full")
    return both.where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).select(*ids)


def reopened(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``node, depth`` of every changed node (0) and all that depends on one, by the fewest steps to it.

    A frontier moves along the edges; each round joins only the nodes found last and leaves out those known, so cycles
    end and every edge is followed once. A frontier of at most ``BROADCAST_ROWS`` counted nodes is broadcast, a larger
    one and all that is known meet by key. The driver sees how many nodes a round found.
    """
    edges = stage(edges.select("node", "depends_on").distinct(), "plan-edges")
    frontier, depth = stage(changed.select("node").distinct().withColumn("depth", F.lit(0)), "plan-frontier"), 0
    known = [frontier]
    while found := frontier.count():
        depth += 1
        last = frontier.select(F.col("node").alias("depends_on"))
        last = F.broadcast(last) if found <= BROADCAST_ROWS else by_key(last)
        met = edges.join(last, "depends_on").select("node").distinct()
        met = met.join(by_key(_all(known).select("node")), "node", "left_anti")
        frontier = stage(met.withColumn("depth", F.lit(depth)), "plan-frontier")
        known.append(frontier)
        if len(known) > COMPACT:
            known = [stage(_all(known), "plan-known")]
    return _all(known)


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes that can never be ready: those on a cycle of dependencies, or between two cycles.

    Edges that begin at a node without dependencies or end at one that nothing needs are removed until none is left to
    remove; what remains is returned. Rounds are as many as the longest chain outside the cycles.
    """
    now = stage(edges.select("node", "depends_on").distinct(), "plan-edges")
    n = now.count()
    while n:
        needs, needed = now.select("node").distinct(), now.select(F.col("depends_on").alias("node")).distinct()
        kept = now.join(by_key(needs.select(F.col("node").alias("depends_on"))), "depends_on", "left_semi").join(by_key(needed), "node", "left_semi")
        now = stage(kept.select("node", "depends_on"), "plan-edges")
        left = now.count()
        if left == n:
            break
        n = left
    return now.select("node").distinct()
