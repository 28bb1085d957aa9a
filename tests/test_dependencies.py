"""What changed plan items reopen, against a walk in plain Python."""

from __future__ import annotations

import random

import pytest

from movekit.plans import dependencies as D

EDGES = "node string, depends_on string"


def walk(edges, changed):
    depth, todo = {c: 0 for c in changed}, list(changed)
    while todo:
        at = todo.pop(0)
        for n, d in edges:
            if d == at and n not in depth:
                depth[n] = depth[at] + 1
                todo.append(n)
    return depth


def reaches(edges):
    nodes = {x for e in edges for x in e}
    return {a: {n for n in walk(edges, [a]) if n != a} | ({a} if any(walk(edges, [n]).get(a) is not None for n, d in edges if d == a) else set()) for a in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_frontier_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(55)} | {(f"c{i + 1}", f"c{i}") for i in range(14)} | {("c3", "c9")}
    changed = {"n1", "n2", "c0", "alone"}
    df = spark.createDataFrame([*edges, *list(edges)[:5]], EDGES)
    got = {r["node"]: r["depth"] for r in D.reopened(df, spark.createDataFrame([(c,) for c in [*changed, "n1"]], "node string")).collect()}
    assert got == walk(edges, sorted(changed))
    to = reaches(edges)
    cycle = {a for a in to if a in to[a]}
    between = {n for n in to if (n in cycle or any(n in to[c] for c in cycle)) and (n in cycle or to[n] & cycle)}
    assert {r["node"] for r in D.cyclic(df).collect()} == between and "c5" in between


def test_nothing_changed_or_no_edges(spark):
    none, some = spark.createDataFrame([], EDGES), spark.createDataFrame([("b", "a"), ("c", "b")], EDGES)
    nodes = spark.createDataFrame([("b",)], "node string")
    assert D.reopened(some, nodes.limit(0)).count() == 0 and D.cyclic(none).count() == 0 and D.cyclic(some).count() == 0
    assert [tuple(r) for r in D.reopened(none, nodes).collect()] == [("b", 0)]


def test_plan_edges_and_changed_items(spark):
    chunks = spark.createDataFrame([("p", "k1"), ("p", "k2"), ("q", "k1")], "project string, chunk_id string")
    jobs = spark.createDataFrame([("p", "j1", "k1", "t"), ("p", "j2", "k2", "t"), ("p", "j3", "gone", "u")], "project string, job_id string, depends_on string, target_object string")
    checks = spark.createDataFrame([("p", "c1", "t"), ("p", "c2", "u"), ("q", "c1", "t")], "project string, check_id string, target_object string")
    edges = {tuple(r) for r in D.plan_edges(chunks, jobs, checks).collect()}
    assert edges == {("p/import/j1", "p/chunk/k1"), ("p/import/j2", "p/chunk/k2"), ("p/check/c1", "p/import/j1"), ("p/check/c1", "p/import/j2"), ("p/check/c2", "p/import/j3")}
    print_of = lambda rows: spark.createDataFrame(rows, "node string, fingerprint string")
    found = D.changed_items(print_of([("a", "1"), ("b", "1"), ("c", None)]), print_of([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)]))
    assert {r["node"] for r in found.collect()} == {"b", "d"}


@pytest.mark.parametrize("limit", [0, 10])
def test_only_a_counted_frontier_is_broadcast(spark, monkeypatch, limit):
    """Whatever is known already meets what is found by key; a frontier beyond the limit does as well."""
    plans, real = [], D.stage

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, label)

    monkeypatch.setattr(D, "stage", noted)
    monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i // 2}") for i in range(40)], EDGES)
    got = {r["node"] for r in D.reopened(edges, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert got == {f"n{i}" for i in range(41)}
    rounds = [p for label, p in plans if label == "plan-frontier"][1:]
    assert all("LeftAnti" in p and p.split("LeftAnti")[0].rstrip().splitlines()[-1].count("SortMergeJoin") for p in rounds)
    assert [p.count("BroadcastExchange") for p in rounds][0] == (1 if limit else 0) and not rounds[-1].count("BroadcastExchange") > 1
