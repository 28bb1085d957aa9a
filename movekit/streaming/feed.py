"""A change feed as a streaming source whose offsets are log positions.

The source hands out ranges of positions, not rows: each micro-batch is one range ``(from, to]``, and the changes in
it are read from the stored feed by Spark with the range pushed into the scan. Spark's own checkpoint therefore
holds log positions. A batch that is run again reads the same range; a restarted query goes on after the last
range it finished; how many changes a batch may have is decided before it starts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from movekit.functions.lsn import LSN_BYTES, format_lsn, lsn_bytes, lsn_number, lsn_text_of_number
from movekit.operators.changes import binary_positions, read_changes
from movekit.streaming.replicate import Replica

NOTHING = "0x" + "00" * LSN_BYTES
#: Ranges that one catch-up may be divided into; a feed further behind takes larger ones.
MOST_RANGES = 10_000


class LsnRange(InputPartition):
    def __init__(self, start: str, end: str) -> None:
        self.start, self.end = start, end


class LsnRangeReader(DataSourceStreamReader):
    """Offsets are ``{"lsn": position}``: everything up to and with it has been handed out."""

    def __init__(self, options: dict[str, str]) -> None:
        self.steps: list[str] = json.loads(options["steps"])
        self.after, self.low = options["after"], options.get("low") or None
        self.at: str | None = None

    def initialOffset(self) -> dict:
        return {"lsn": self.after}

    def latestOffset(self) -> dict:
        """The end of the next range: one step beyond what was handed out, or where that was if there is no more."""
        at = self.at or self.after
        self.at = next((s for s in self.steps if s > at), at)
        return {"lsn": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at or self.after, end["lsn"])
        if start["lsn"] >= end["lsn"]:
            return []
        if self.low and NOTHING < start["lsn"] < self.low and start["lsn"] != self.after:
            raise ValueError(f"changes after {start['lsn']} are gone: the feed begins at {self.low}")
        return [LsnRange(start["lsn"], end["lsn"])]

    def read(self, partition: LsnRange) -> Iterator[tuple]:
        yield (partition.start, partition.end)

    def commit(self, end: dict) -> None:
        """Nothing is kept here; the feed has its own retention."""


class LsnRangeSource(DataSource):
    """Options: ``steps`` (ends of the ranges as JSON, ascending), ``after`` (where a new query starts), ``low``."""

    @classmethod
    def name(cls) -> str:
        return "lsn_ranges"

    def schema(self) -> str:
        return "from_lsn string, to_lsn string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LsnRangeReader(dict(self.options))


def range_ends(feed: DataFrame, after: str, max_changes: int) -> list[str]:
    """Ends of ranges of about ``max_changes`` changes each beyond a position; the last one is the head of the feed.

    A position is never cut, so the changes of one transaction stay together even if they are more.
    """
    if max_changes < 1:
        raise ValueError("a batch must admit at least one change")
    number = lsn_number(F.col("start_lsn"))
    ahead = binary_positions(feed).where(F.col("start_lsn") > F.lit(lsn_bytes(after)))
    n, head = ahead.agg(F.count(F.lit(1)), format_lsn(F.max("start_lsn"))).head()
    if not n:
        return []
    parts = min(MOST_RANGES, math.ceil(n / max_changes))
    if parts == 1:
        return [head]
    points = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = ahead.agg(F.percentile_approx(number, points, max(10_000, 20 * parts)).alias("p")).select(F.explode("p").alias("p"))
    ends = {r[0] for r in found.select(lsn_text_of_number(F.col("p"))).collect()}
    return sorted({*ends, head})


def low_mark(feed: DataFrame) -> str | None:
    """The lowest position the feed still has."""
    return binary_positions(feed).agg(format_lsn(F.min("start_lsn"))).head()[0]


def catch_up(
    load: Callable[[], DataFrame],
    replica: Replica,
    query_dir: str,
    max_changes: int = 1_000_000,
    after: str = NOTHING,
    retained_from: str | None = None,
) -> int:
    """Replicate the feed that ``load`` gives up to its present head, range by range; the number of ranges.

    ``after`` is where a new query starts; a query with a checkpoint goes on where it was. ``retained_from`` is the
    lowest position that the feed is known to hold completely: a query that stands below it fails instead of
    leaving out changes.
    """
    spark = replica.spark
    spark.dataSource.register(LsnRangeSource)
    done = max(filter(None, (_reached(spark, query_dir), after)))
    steps = range_ends(load(), done, max_changes)
    ranges = 0

    def absorb(batch: DataFrame, batch_id: int) -> None:
        nonlocal ranges
        for row in batch.collect():  # one range
            replica.absorb(read_changes(load(), row["from_lsn"], row["to_lsn"], exclusive_lower=True), batch_id)
            ranges += 1

    options = {"steps": json.dumps(steps), "after": after, "low": retained_from or ""}
    stream = spark.readStream.format("lsn_ranges").options(**options).load()
    query = stream.writeStream.foreachBatch(absorb).option("checkpointLocation", query_dir).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return ranges


def _reached(spark: SparkSession, query_dir: str) -> str | None:
    """The highest position in the offsets of a query's checkpoint, finished or not."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{query_dir}/offsets")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    lines = spark.read.text(f"{query_dir}/offsets").where(F.col("value").startswith('{"lsn"'))
    return lines.agg(F.max(F.get_json_object("value", "$.lsn"))).head()[0]
