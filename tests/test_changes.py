from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from movekit.operators import changes as C
from movekit.operators import reconcile as R
from movekit.plans import health as H
from movekit.plans import ranges as P
from movekit.session import scratch
from movekit.streaming.replicate import Replica, replicate_stream, replicate_until

KEYS, COLS = ["id"], ["id", "name"]
FEED = "op int, start_lsn string, seqval string, id long, name string"


def lsn(n):
    return f"0x{n:020x}"


def feed_of(spark, rows):
    return C.binary_positions(spark.createDataFrame([(op, lsn(a), lsn(b), k, v) for op, a, b, k, v in rows], FEED))


def content(df):
    return {r["id"]: (r["name"], r["note"]) for r in df.collect()}


def sequential(table, rows):
    """Row by row, as the feed reads."""
    out = dict(table)
    for op, _, _, k, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if op == 1:
            out.pop(k, None)
        elif op in (2, 4):
            out[k] = (v, out[k][1] if k in out else None)
    return out


@pytest.fixture(scope="module")
def start(spark):
    return {i: (f"n{i}", f"note{i}") for i in range(12)}


@pytest.fixture(scope="module")
def target(spark, start):
    return spark.createDataFrame([(k, *v) for k, v in start.items()], "id long, name string, note string").cache()


def changes(seed, n=150):
    r = random.Random(seed)
    return [(r.choice([1, 2, 3, 4, 4]), r.randint(1, 30), i, r.randint(0, 20), f"v{i}") for i in range(n)]


def test_tiny_feed(spark):
    feed = feed_of(spark, [(2, 1, 1, 1, "Ada"), (1, 2, 1, 2, "Lin")])
    table = spark.createDataFrame([(2, "Lin", "x")], "id long, name string, note string")
    assert content(C.apply_changes(table, feed, KEYS, COLS)) == {1: ("Ada", None)}
    assert C.applied_count(feed).head()[0] == 2


def test_operation_codes(spark):
    df = spark.createDataFrame([("1",), ("2",), (" 3",), ("4",)], "op string")
    assert [r[0] for r in df.select(C.decode_op(F.col("op"))).collect()] == ["delete", "upsert", "skip", "upsert"]
    with pytest.raises(Exception, match="unsupported operation"):
        spark.createDataFrame([("5",)], "op string").select(C.decode_op(F.col("op"))).collect()


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [0, 10_000])
def test_apply_equals_row_by_row(spark, target, start, seed, limit):
    rows = changes(seed)
    got = C.apply_changes(target, feed_of(spark, rows), KEYS, COLS, broadcast_rows=limit)
    assert content(got) == sequential(start, rows)


def test_hot_key(spark, target, start):
    """Most changes hit one key; the map side reduces them before the shuffle."""
    rows = changes(5, 60) + [(4, 40 + i // 10, i, 3, f"hot{i}") for i in range(400)]
    net = C.net_changes(feed_of(spark, rows).repartition(8), KEYS, COLS, count_as="n")
    plan = net._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
    assert content(C.apply_changes(target, feed_of(spark, rows), KEYS, COLS)) == sequential(start, rows)


def test_ranges_compose_and_replay_is_a_no_op(spark, target, start):
    rows = changes(3)
    feed = feed_of(spark, rows)
    first = C.apply_changes(target, C.read_changes(feed, lsn(0), lsn(15)), KEYS, COLS)
    both = C.apply_changes(first, C.read_changes(feed, lsn(15), lsn(30)), KEYS, COLS)
    assert content(both) == sequential(start, rows)
    late = C.read_changes(feed, lsn(15), lsn(30))
    again = C.apply_changes(both, late, KEYS, COLS)
    names = lambda t: {k: v[0] for k, v in content(t).items()}
    assert names(again) == names(both)
    assert C.read_changes(feed, lsn(15), lsn(30), exclusive_lower=True).count() < late.count()


def test_contracts(spark):
    with pytest.raises(ValueError, match="required"):
        C.check_keys([], COLS)
    with pytest.raises(ValueError, match="duplicate"):
        C.check_keys(["id", "ID"], COLS)
    with pytest.raises(ValueError, match="not captured"):
        C.check_keys(["other"], COLS)
    with pytest.raises(ValueError, match="do not match"):
        C.check_feed(spark.createDataFrame([], FEED), ["name", "id"])
    with pytest.raises(ValueError, match="less than or equal"):
        C.check_range(lsn(2), lsn(1))
    with pytest.raises(Exception, match="NULL key"):
        C.net_changes(feed_of(spark, [(2, 1, 1, None, "x")]), KEYS, COLS).collect()
    dup = spark.createDataFrame([(1,), (1,), (None,), (2,)], "id long")
    assert {r["id"] for r in C.duplicate_keys(dup, ["id"]).collect()} == {1, None}


def test_filters_on_positions_reach_the_scan(spark):
    path = scratch(spark, "feed")
    feed_of(spark, changes(7)).write.parquet(path)
    plan = C.read_changes(spark.read.parquet(path), lsn(3), lsn(9))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(start_lsn" in plan and "LessThanOrEqual(start_lsn" in plan


def stream_of(spark, rows, pieces, schema=None):
    path = scratch(spark, "landing")
    for piece in pieces:
        feed_of(spark, piece).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_in_any_order_with_a_replay(spark, target, start):
    rows = changes(11)
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    pieces = [shuffled[i::4] for i in range(4)]
    path = stream_of(spark, rows, [*pieces, pieces[1]])
    schema = feed_of(spark, rows[:1]).schema
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    replica = Replica(spark, scratch(spark, "replica"), target, KEYS, COLS)
    replicate_stream(feed, replica, scratch(spark, "query")).awaitTermination()
    assert content(replica.snapshot()) == sequential(start, rows)
    assert replica.progress().count() == 5
    assert replica.progress().select("query").distinct().head()[0] != "manual"
    # a new query over the same feed replays everything and changes nothing
    replicate_stream(feed, replica, scratch(spark, "query")).awaitTermination()
    assert content(replica.snapshot()) == sequential(start, rows)
    applied = sum(r[0] != 3 for r in rows) + sum(r[0] != 3 for r in pieces[1])
    assert replica.applied_changes() == 2 * applied
    assert replica.checkpoint_lsn() == lsn(max(r[1] for r in rows if r[0] != 3))


def test_retried_batch_and_fold(spark, target, start):
    rows = changes(13)
    early, late = [r for r in rows if r[1] <= 12], [r for r in rows if r[1] >= 12]
    replica = Replica(spark, scratch(spark, "replica"), target, KEYS, COLS)
    replica.absorb(feed_of(spark, early), 0)
    replica.absorb(feed_of(spark, early), 0)
    replica.fold(lsn(12), 0)
    assert replica.version()[0] == 1
    assert content(replica.snapshot()) == sequential(start, early)
    replica.absorb(feed_of(spark, early), 0)  # already part of the folded generation
    replica.absorb(feed_of(spark, late), 1)
    assert content(replica.snapshot()) == sequential(start, rows)
    replica.fold(lsn(31), 1)
    replica.fold(lsn(31), 1)
    assert content(replica.snapshot()) == sequential(start, rows)
    assert replica.applied_changes() == sum(r[0] != 3 for r in early) + sum(r[0] != 3 for r in late)


def test_soak(spark):
    """Rounds of insert, update and delete; source and target agree after each."""
    source = {1: ("a", None), 2: ("b", None)}
    table = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, name string, note string")
    landing, replica = scratch(spark, "soak"), None
    schema = feed_of(spark, [(2, 1, 1, 1, "x")]).schema
    replica = Replica(spark, scratch(spark, "replica"), table, KEYS, COLS)
    query = scratch(spark, "query")
    for n in (1, 2, 3):
        rows = [(2, n, 1, 100 + n, f"new{n}"), (3, n, 2, 1, "old"), (4, n, 3, 1, f"upd{n}")]
        rows += [(1, n, 4, 2, "b")] if n == 1 else []
        source = sequential(source, rows)
        feed_of(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        feed = spark.readStream.schema(schema).parquet(landing)
        assert replicate_until(feed, replica, query, min_applied=2) == sum(r[0] != 3 for r in rows)
        assert content(replica.snapshot()) == source
    feed = spark.readStream.schema(schema).parquet(landing)
    with pytest.raises(RuntimeError, match="required 1"):
        replicate_until(feed, replica, query, max_iterations=2, poll_seconds=0, min_applied=1)


# -- ranges and health ----------------------------------------------------------------------------

PLAN = "project string, source_object string, target_object string, from_lsn string, to_lsn string"
CKPT = "project string, source_object string, target_object string, from_lsn string, to_lsn string, applied_changes long, completed_at string"


def base(n):
    return "0x00000027000001f4" + f"{n:04x}"


def tracked(spark, low=None, high=None):
    return spark.createDataFrame([("p", "sales.dbo.orders", "shop.orders", low, high)], PLAN)


def checkpoint(spark, to, target="shop.orders"):
    return spark.createDataFrame([("p", "sales.dbo.orders", target, base(1), to, 1, "2024-01-01T00:00:00Z")], CKPT)


def marks(spark, low):
    return spark.createDataFrame([("sales.dbo.orders", low)], "source_object string, min_lsn string")


def test_next_range(spark):
    row = P.next_ranges(tracked(spark), checkpoint(spark, base(2)), base(3)).head()
    assert (row["from_lsn"], row["to_lsn"], row["status"], row["error"]) == (base(2), base(3), "range_prepared", None)
    row = P.next_ranges(tracked(spark), checkpoint(spark, base(3)), base(3)).head()
    assert (row["from_lsn"], row["status"]) == (None, "caught_up")
    errors = [
        (checkpoint(spark, base(4)), {}, "ahead_of_source"),
        (checkpoint(spark, base(2), "other"), {}, "target_differs"),
        (checkpoint(spark, base(2)), {"low_marks": marks(spark, base(3))}, "retention_expired"),
        (checkpoint(spark, ""), {}, "no_start"),
        (checkpoint(spark, "0x1"), {}, "from_malformed"),
    ]
    for ckpt, extra, error in errors:
        row = P.next_ranges(tracked(spark), ckpt, base(3), **extra).head()
        assert (row["error"], row["status"], row["from_lsn"]) == (error, "blocked", None)
    row = P.next_ranges(tracked(spark), checkpoint(spark, ""), base(3), initial_lsn=base(1)).head()
    assert row["from_lsn"] == base(1)


def test_malformed_bounds_are_errors(spark):
    for call in (
        lambda: P.next_ranges(tracked(spark), checkpoint(spark, base(2)), "0x1"),
        lambda: P.next_ranges(tracked(spark), checkpoint(spark, base(2)), base(3), initial_lsn="zz"),
        lambda: P.explicit_range(tracked(spark), checkpoint(spark, base(2)), ""),
        lambda: H.health_tables(tracked(spark), checkpoint(spark, base(2)), max_lsn="0x1"),
    ):
        with pytest.raises(ValueError, match="10-byte hex"):
            call()


def test_one_behind_table_gives_every_table_a_range(spark):
    plan = spark.createDataFrame([("p", f"d.s.t{i}", f"t.t{i}", None, None) for i in (1, 2)], PLAN)
    ckpt = spark.createDataFrame([("p", f"d.s.t{i}", f"t.t{i}", base(1), base(i + 1), 0, "") for i in (1, 2)], CKPT)
    rows = P.next_ranges(plan, ckpt, base(3)).collect()
    assert {(r["source_object"], r["from_lsn"], r["to_lsn"]) for r in rows} == {("d.s.t1", base(2), base(3)), ("d.s.t2", base(3), base(3))}


def test_explicit_range_has_no_shortcut(spark):
    row = P.explicit_range(tracked(spark), checkpoint(spark, base(3)), base(3)).head()
    assert (row["from_lsn"], row["to_lsn"]) == (base(3), base(3))
    assert P.explicit_range(tracked(spark), checkpoint(spark, base(4)), base(3)).head()["error"] == "range_reversed"


def test_apply_needed(spark):
    plan = tracked(spark, base(2), base(4))
    none = checkpoint(spark, base(2)).where("false")
    cases = [
        (none, True, None),
        (checkpoint(spark, base(2)), True, None),
        (checkpoint(spark, base(4)), False, None),
        (checkpoint(spark, base(5)), False, None),
        (checkpoint(spark, base(3)), False, "gap"),
        (checkpoint(spark, base(2), "x"), False, "target_differs"),
    ]
    for ckpt, needed, error in cases:
        row = P.apply_needed(plan, ckpt).head()
        assert (row["needed"], row["error"]) == (needed, error)
    assert P.apply_needed(plan, none, marks(spark, base(3))).head()["error"] == "retention_expired"


def test_checkpoint_advance_keeps_other_projects(spark):
    args = ["cdc", "--source-object", "sales.dbo.orders", "--target-object", "shop.orders", "--from-lsn", base(2), "--to-lsn", base(3)]
    schema = "project string, run_id string, run_status string, position long, command_id string, args array<string>, applied_changes long, completed_at string"
    commands = spark.createDataFrame([("p", "r1", "succeeded", 0, "c", args, 4, "2024-01-02T00:00:00Z")], schema)
    old = checkpoint(spark, base(2)).withColumn("status", F.lit("running"))
    other = old.withColumn("project", F.lit("q"))
    plan = tracked(spark, base(2), base(3))
    snaps = P.snapshots_from_commands(commands)
    rows = {r["project"]: r for r in P.advance_checkpoint(old.unionByName(other), snaps, plan, "caught_up").collect()}
    assert (rows["p"]["to_lsn"], rows["p"]["applied_changes"], rows["p"]["status"]) == (base(3), 4, "caught_up")
    assert rows["q"]["to_lsn"] == base(2)
    failed = snaps.withColumn("run_status", F.lit("failed"))
    assert P.advance_checkpoint(old, failed, plan).head()["to_lsn"] == base(2)
    assert {r["rule"] for r in P.snapshot_violations(failed, plan).collect()} == {"run_not_succeeded"}
    with pytest.raises(ValueError, match="unsupported"):
        P.advance_checkpoint(old, snaps, plan, "done")


def state(spark, updated, status="running"):
    return spark.createDataFrame([("p", status, updated)], "project string, status string, updated_at string")


def test_health_lag_and_stale(spark):
    tables = H.health_tables(tracked(spark), checkpoint(spark, base(2)), marks(spark, base(1)), base(3))
    states, now = state(spark, "2024-01-01T00:00:00Z"), "2024-01-01T01:30:00Z"
    alerts = {(r["severity"], r["code"]) for r in H.health_alerts(tables, states, now, 3600).collect()}
    assert alerts == {("critical", "checkpoint_stale"), ("warning", "cdc_lag")}
    row = H.health_summary(tables, states, now, 3600).head()
    assert (row["status"], row["lagging_tables"], row["age_seconds"]) == ("critical", 1, 5400)
    quiet = H.health_summary(tables, states, now, 5400).head()
    assert quiet["status"] == "warning"
    future = H.health_summary(tables, state(spark, "2024-01-02T00:00:00Z"), now, 3600).head()
    assert future["age_seconds"] == 0


def test_health_expired_missing_and_failed(spark):
    expired = H.health_tables(tracked(spark), checkpoint(spark, base(2)), marks(spark, base(3)))
    assert expired.head()["retention_status"] == "expired"
    missing = H.health_tables(tracked(spark), checkpoint(spark, base(2)).where("false"))
    alerts = H.health_alerts(missing, state(spark, "", "failed"), "2024-01-01T00:00:00Z").collect()
    assert {r["code"] for r in alerts} == {"checkpoint_missing", "checkpoint_failed"}


def test_alert_routing(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "warning"), ("c", "critical")], "project string, status string")
    pick = lambda level: {r["project"] for r in H.route_alerts(df, level).where("notify").collect()}
    assert pick("") == {"c"} and pick("warning") == {"b", "c"} and pick("always") == {"a", "b", "c"} and pick("none") == set()
    assert [r["exit_code"] for r in H.route_alerts(df).orderBy("project").collect()] == [0, 0, 1]
    with pytest.raises(ValueError):
        H.route_alerts(df, "loud")


# -- purge and parts --------------------------------------------------------------------------------


def remembered(replica):
    folded = replica._folded(replica.version()[0])
    return 0 if folded is None else folded.count()


def stated(spark, **low):
    return spark.createDataFrame([(s, lsn(n)) for s, n in low.items()], "source string, low_water string")


def test_what_is_remembered_stays_bounded(spark, target, start):
    """A long feed with deletes of ever new keys; each fold remembers the open window only."""
    replica = Replica(spark, scratch(spark, "replica"), target, KEYS, COLS, sources=["a", "b"], part_rows=3)
    fed, sizes = [], []
    for n in range(1, 6):
        at = 10 * n
        rows = [(2, at, 1, 100 + n, f"n{n}"), (1, at + 1, 1, 100 + n, "x"), (2, at + 2, 1, 200 + n, "stays"), (4, at + 3, 1, 1, f"u{n}")]
        late = [(4, at - 9, 9, 200 + n - 1, "late")] if n > 2 else []  # older than what the last fold moved, but not out of reach
        fed += rows + late
        replica.absorb(feed_of(spark, rows + late), n)
        replica.absorb(feed_of(spark, fed), 100 + n)  # everything once more
        assert content(replica.snapshot()) == sequential(start, sorted(fed, key=lambda r: r[1:3] + r[:1]))
        replica.advance(stated(spark, a=at - 6, b=at + 5))
        assert replica.expiry() == lsn(at - 6)
        replica.fold(lsn(at + 5), n)
        sizes.append(remembered(replica))
        assert content(replica.snapshot()) == sequential(start, sorted(fed, key=lambda r: r[1:3] + r[:1]))
    assert max(sizes) <= 8 and sizes[-1] <= sizes[1] + 2


def test_sources_without_a_mark_hold_everything(spark, target):
    replica = Replica(spark, scratch(spark, "replica"), target, KEYS, COLS, sources=["a", "b"])
    replica.absorb(feed_of(spark, [(1, 5, 1, 1, "x"), (2, 6, 1, 50, "y")]), 0)
    with pytest.raises(ValueError, match="every source"):
        replica.fold(upto_batch=0)
    replica.advance(stated(spark, a=20))
    assert replica.expiry() is None
    replica.fold(lsn(10), 0)
    assert remembered(replica) == 2
    replica.advance(stated(spark, b=9, c=1))
    replica.advance(stated(spark, b=3))  # no mark goes back; other sources do not count
    assert replica.expiry() == lsn(9)
    replica.fold(upto_batch=1)
    assert remembered(replica) == 0 and replica.version()[3] == lsn(9)
    assert replica.progress().count() == 1
    with pytest.raises(Exception, match="low_water"):
        replica.advance(spark.createDataFrame([("a", "0x1")], "source string, low_water string"))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_fold_writes_only_touched_parts(spark, kind):
    table = spark.range(400).select(F.col("id").cast(kind), F.lit("n").alias("name"), F.lit("o").alias("note"))
    replica = Replica(spark, scratch(spark, "replica"), table, KEYS, COLS, part_rows=50)
    feed = lambda rows: feed_of(spark, rows).withColumn("id", F.col("id").cast(kind))
    replica.absorb(feed([(4, 1, 1, 7, "a")]), 0)
    replica.fold(lsn(5), 0)
    first = replica._parts_of(1)
    assert len(first) == 8 and sum(p.rows for p in first) == 400 and all(p.base == 1 for p in first)
    rows = [(2, 6, i, 400 + i, "b") for i in range(200)] if kind == "long" else [(4, 6, 1, 9, "b")]
    replica.absorb(feed([*rows, (1, 7, 1, 399, "c")]), 1)
    replica.fold(lsn(9), 1)
    second = replica._parts_of(2)
    assert 0 < sum(p.base == 2 for p in second) <= 2 and sum(p.base == 1 for p in second) >= 6
    want = {str(r["id"]): r["name"] for r in table.collect()} | {"7": "a"} | {str(r[3]): r[4] for r in rows}
    del want["399"]
    assert {str(r["id"]): r["name"] for r in replica.snapshot().collect()} == want
    if kind == "long":  # the last range has grown to five times its size: the next fold divides it
        assert max(p.rows for p in second) > 200
        replica.absorb(feed([(4, 10, 1, 500, "d")]), 2)
        replica.fold(lsn(12), 2)
        assert max(p.rows for p in replica._parts_of(3)) < 100
        assert {str(r["id"]): r["name"] for r in replica.snapshot().collect()} == want | {"500": "d"}
    before = replica.snapshot().count()
    replica.vacuum(keep=1)
    assert replica.snapshot().count() == before


def test_a_fold_that_broke_off_is_begun_anew(spark, target, start):
    rows = changes(13)
    replica = Replica(spark, scratch(spark, "replica"), target, KEYS, COLS, part_rows=2)
    replica.absorb(feed_of(spark, rows[:20]), 0)
    write = Replica._write_manifest
    try:
        Replica._write_manifest = lambda *a: (_ for _ in ()).throw(OSError("lost"))
        with pytest.raises(OSError, match="lost"):
            replica.fold(lsn(12), 0)
    finally:
        Replica._write_manifest = write
    assert content(replica.snapshot()) == sequential(start, rows[:20])
    replica.fold(lsn(12), 0)
    replica.absorb(feed_of(spark, rows[20:]), 1)
    assert content(replica.snapshot()) == sequential(start, rows)


# -- runs out of order ------------------------------------------------------------------------------


def test_checkpoints_move_over_filled_holes(spark):
    schema = "project string, source_object string, from_lsn string, to_lsn string"
    runs = [("p", "a", 30, 40), ("p", "a", 10, 20), ("p", "a", 12, 15), ("p", "a", 55, 55), ("p", "b", 5, 9), ("q", "a", 0, 90), ("p", "a", 10, 20)]
    at = spark.createDataFrame([("p", "a", lsn(10)), ("p", "b", lsn(4)), ("p", "c", lsn(7)), ("p", "a", lsn(9))], "project string, source_object string, to_lsn string")

    def rows(fn, some):
        df = spark.createDataFrame([(p, s, lsn(a), lsn(b)) for p, s, a, b in some], schema)
        return sorted((r["source_object"], *(int(r[c], 16) for c in ("from_lsn", "to_lsn"))) for r in fn(at, df).collect())

    assert rows(P.advance_over, runs) == [("a", 10, 20), ("b", 4, 4), ("c", 7, 7)]
    assert rows(P.open_ranges, runs) == [("a", 20, 30), ("a", 40, 55), ("b", 4, 5)]
    assert rows(P.advance_over, [*runs, ("p", "a", 18, 31)]) == [("a", 10, 40), ("b", 4, 4), ("c", 7, 7)]
    assert rows(P.open_ranges, [*runs, ("p", "a", 18, 31), ("p", "b", 4, 5)]) == [("a", 40, 55)]
    assert rows(P.open_ranges, []) == []
    with pytest.raises(Exception, match="range reversed"):
        rows(P.advance_over, [("p", "a", 9, 3)])


# -- sums kept current ------------------------------------------------------------------------------


def test_sums_follow_the_changes(spark):
    spec = R.TableSpec(numeric=["id", "v"], key="id", modulo=3, buckets=4, target_predicate="v IS NULL OR v < 900")
    table = spark.createDataFrame([(i, i * 10) for i in range(40)], "id long, v long")
    sums, rng = R.table_sums(table, spec, target=True), random.Random(6)
    for n in range(3):
        rows = [(rng.choice([1, 2, 4]), n + 1, i, rng.randrange(60), rng.choice(["5", "950", None])) for i in range(30)]
        net = C.net_changes(feed_of(spark, rows).select("op", "start_lsn", "seqval", "id", F.col("name").cast("long").alias("v")), ["id"], ["id", "v"])
        removed, added = C.moved_rows(table, net, ["id"], ["id", "v"], broadcast=n == 1)
        sums = R.moved_sums(sums, removed, added, spec, target=True)
        table = spark.createDataFrame(C.apply_net(table, net, ["id"], ["id", "v"]).collect(), "id long, v long")
        sums = spark.createDataFrame(sums.collect(), sums.schema)
        source = R.table_sums(table, spec)
        got, want = R.reconcile_sums(source, sums, spec).collect(), R.reconcile(table, table, spec).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 7


def test_a_fold_writes_a_part_as_one_file(spark):
    base = spark.range(200).selectExpr("id", "cast(id AS string) AS name").repartition(4).localCheckpoint()
    replica = Replica(spark, scratch(spark, "replica"), base, ["id"], ["id", "name"], part_rows=50)
    feed = spark.range(0, 200, 3).selectExpr("4 AS op", f"'{lsn(3)}' AS start_lsn", f"'{lsn(1)}' AS seqval", "id", "'new' AS name")
    replica.absorb(feed, 0)
    replica.fold(lsn(9), 0)
    for name in ("base", "folded"):
        stored = spark.read.parquet(f"{replica.path}/{name}/v=1").select("part", F.input_file_name().alias("f")).distinct()
        assert stored.groupBy("part").count().where("count > 1").isEmpty()
    parts = replica._parts_of(1)
    assert len(parts) == 4 and sum(p.rows for p in parts) == 200
    assert replica.snapshot().where("name = 'new'").count() == 67
