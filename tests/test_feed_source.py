"""The change feed as a streaming source of log ranges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from movekit.session import scratch
from movekit.streaming import feed as S
from movekit.streaming.replicate import Replica
from test_changes import COLS, KEYS, changes, content, feed_of, lsn, sequential


@pytest.fixture(scope="module")
def start():
    return {i: (f"n{i}", f"note{i}") for i in range(12)}


@pytest.fixture(scope="module")
def target(spark, start):
    return spark.createDataFrame([(k, *v) for k, v in start.items()], "id long, name string, note string")


def stored(spark, rows, path=None):
    path = path or scratch(spark, "feed")
    feed_of(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return path


def test_ranges_cover_the_feed_and_cut_no_position(spark):
    rows = [(2, a, i, i, "x") for a in range(1, 41) for i in range(30 if a == 7 else 3)]
    feed = feed_of(spark, rows)
    ends = S.range_ends(feed, S.NOTHING, 15)
    assert ends == sorted(set(ends)) and ends[-1] == lsn(40) and 6 <= len(ends) <= 11
    n = [sum(lo < lsn(r[1]) <= hi for r in rows) for lo, hi in zip([S.NOTHING, *ends], ends, strict=False)]
    assert sum(n) == len(rows) and max(x for x in n) <= 45 and min(n) > 0
    assert S.range_ends(feed, lsn(40), 15) == [] and S.range_ends(feed, lsn(38), 100) == [lsn(40)]
    with pytest.raises(ValueError, match="at least one"):
        S.range_ends(feed, S.NOTHING, 0)


def test_ranges_of_the_reader():
    reader = S.LsnRangeReader({"steps": '["0x03", "0x07"]', "after": "0x00", "low": "0x02"})
    assert reader.initialOffset() == {"lsn": "0x00"}
    assert [reader.latestOffset()["lsn"] for _ in range(3)] == ["0x03", "0x07", "0x07"]
    assert reader.partitions({"lsn": "0x07"}, {"lsn": "0x07"}) == []
    part = reader.partitions({"lsn": "0x03"}, {"lsn": "0x07"})[0]
    assert list(reader.read(part)) == [("0x03", "0x07")]
    again = S.LsnRangeReader({"steps": '["0x03", "0x07"]', "after": "0x00"})
    again.partitions({"lsn": "0x00"}, {"lsn": "0x03"})  # what the engine asks for first after a restart
    assert again.latestOffset() == {"lsn": "0x07"}


def test_a_query_goes_on_where_it_was(spark, target, start):
    rows = changes(21)
    early = [r for r in rows if r[1] <= 18]
    path, query = stored(spark, early), scratch(spark, "query")
    load = lambda: spark.read.parquet(path)
    replica = Replica(spark, scratch(spark, "replica"), target, KEYS, COLS)
    assert S.catch_up(load, replica, query, max_changes=25) >= 3
    assert content(replica.snapshot()) == sequential(start, early)
    assert S.catch_up(load, replica, query, max_changes=25) == 0
    stored(spark, [r for r in rows if r[1] > 18], path)
    assert S.catch_up(load, replica, query, max_changes=1000) == 1
    assert content(replica.snapshot()) == sequential(start, rows)
    assert replica.applied_changes() == sum(r[0] != 3 for r in rows)  # no range came twice
    assert replica.checkpoint_lsn() == lsn(max(r[1] for r in rows if r[0] != 3))


def test_a_failed_range_is_read_again(spark, target, start):
    rows = changes(22)
    path, query = stored(spark, rows), scratch(spark, "query")
    load = lambda: spark.read.parquet(path)
    replica = Replica(spark, scratch(spark, "replica"), target, KEYS, COLS)
    absorb, calls = Replica.absorb, []

    def fails_once(self, batch, batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            raise OSError("lost while writing")
        absorb(self, batch, batch_id)

    try:
        Replica.absorb = fails_once
        with pytest.raises(Exception, match="lost while writing"):
            S.catch_up(load, replica, query, max_changes=40)
        S.catch_up(load, replica, query, max_changes=40)
    finally:
        Replica.absorb = absorb
    assert calls[1] == calls[2] and content(replica.snapshot()) == sequential(start, rows)
    assert replica.applied_changes() == sum(r[0] != 3 for r in rows)


def test_changes_that_are_gone_are_an_error(spark, target):
    path, query = stored(spark, [(2, a, 1, a, "x") for a in range(1, 6)]), scratch(spark, "query")
    replica = Replica(spark, scratch(spark, "replica"), target, KEYS, COLS)
    S.catch_up(lambda: spark.read.parquet(path), replica, query)
    later = stored(spark, [(2, a, 1, a, "x") for a in range(20, 25)])
    feed = spark.read.parquet(later)
    assert S.low_mark(feed) == lsn(20)
    with pytest.raises(Exception, match="are gone"):
        S.catch_up(lambda: feed, replica, query, retained_from=S.low_mark(feed))
    new = Replica(spark, scratch(spark, "replica"), target, KEYS, COLS)
    assert S.catch_up(lambda: feed.where(F.lit(True)), new, scratch(spark, "query"), after=lsn(21), retained_from=lsn(20)) == 1
    assert {r for r in content(new.snapshot()) if r > 19} == {22, 23, 24}
