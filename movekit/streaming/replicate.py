"""Continuous replication with Structured Streaming.

Each micro-batch is reduced to its net effect and appended to a change log; the current table is
``base`` with the merged log applied. A batch therefore costs what its changes cost, not what the
table holds. ``fold`` moves settled changes into the base from time to time; the base is kept in parts, ranges
of the first key column, and only parts with settled changes are written anew.

What a fold moved is remembered as long as an older change of the same key may still come. Every source states a low-water
position below which it has delivered all; below the least of them nothing can come that is not there, so
what is remembered of older changes, tombstones included, is dropped and changes that come again are left out.

Layout under ``path`` (all on shared storage)::

    log/gen=<g>/batch=<query>-<id>         net effect of one batch, rewritten whole when it is retried
    progress/gen=<g>/batch=<query>-<id>    applied changes and highest position of that batch
    base/v=<g>/part=<p>                    rows of a part as written by the fold to generation g
    folded/v=<g>/part=<p>                  net effect of changes in that part that an older change may still meet
    parts/v=<g>                            the parts of generation g and where each was last written
    marks/v=<n>                            low-water position of each source
    versions/v=<g>                         one row per finished generation; the highest one is current

Batch ids count within one streaming query, so folders carry the query's id: a query started anew
with a lost checkpoint replays its feed without touching, or being taken for, earlier batches.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.functions.lsn import format_lsn, lsn_bytes, require_lsn
from movekit.operators.changes import apply_net, binary_positions, fits_broadcast, merge_net, net_changes
from movekit.plans.chunks import range_of, split_bounds
from movekit.session import delete_path, folder_names, path_exists, stage

PROGRESS = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("applied_changes", T.LongType()),
        T.StructField("max_lsn", T.StringType()),
    ]
)
VERSIONS = T.StructType(
    [
        T.StructField("generation", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("upto_batch", T.LongType()),
        T.StructField("low_water", T.StringType()),
        T.StructField("expiry", T.StringType()),
    ]
)
MARKS = T.StructType([T.StructField("source", T.StringType()), T.StructField("low_water", T.StringType())])


MANUAL = "manual"


def _query_id(batch: DataFrame) -> str:
    """Id of the streaming query that runs this batch; it stays the same across restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or MANUAL


@dataclass(frozen=True)
class Part:
    """A range of the first key column from ``low`` on (None: from the start), or a class of its hash.

    ``base`` and ``folded`` are the generations that last wrote its rows and its remembered net effect (None: there
    are none); ``top`` is the highest position remembered.
    """

    part: int
    low: object
    rows: int
    base: int | None
    folded: int | None
    top: str | None


@dataclass
class Replica:
    """A table kept current from a change feed.

    ``sources`` names the feeds that take part; once all have stated a low-water position (:meth:`advance`), what no
    change can meet any more is dropped. ``part_rows`` is the wanted number of rows of a part of the base.
    """

    spark: SparkSession
    path: str
    base: DataFrame
    keys: Sequence[str]
    columns: Sequence[str]
    sources: Sequence[str] = ()
    part_rows: int = 1_000_000

    # -- state -------------------------------------------------------------------------------

    def _rows(self, part: str, schema: T.StructType) -> DataFrame | None:
        path = f"{self.path}/{part}"
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").json(path) if path_exists(self.spark, path) else None

    def version(self) -> tuple[int, str | None, int, str | None]:
        """Current generation, the last batch (query, id) it contains and its low-water position."""
        return self._version()[:4]

    def _version(self) -> tuple[int, str | None, int, str | None, str | None]:
        rows = self._rows("versions", VERSIONS)
        top = rows.orderBy(F.desc("generation")).head(1) if rows is not None else []
        return tuple(top[0]) if top else (0, None, -1, None, None)

    def _numbered(self, part: str) -> list[int]:
        """Finished versions of a small table, in order."""
        path = f"{self.path}/{part}"
        found = folder_names(self.spark, path) if path_exists(self.spark, path) else []
        return sorted(n for n in (int(x.removeprefix("v=")) for x in found) if path_exists(self.spark, f"{path}/v={n}/_SUCCESS"))

    def marks(self) -> DataFrame:
        """The low-water position of each source, as last stated."""
        found = self._numbered("marks")
        if not found:
            return self.spark.createDataFrame([], MARKS)
        return self.spark.read.schema(MARKS).json(f"{self.path}/marks/v={found[-1]}")

    def advance(self, marks: DataFrame) -> None:
        """State low-water positions (``source, low_water``): all changes below have been absorbed. None goes back."""
        stated = marks.select("source", format_lsn(require_lsn(F.col("low_water"), "low_water")).alias("low_water"))
        found = self._numbered("marks")
        now = self.marks().unionByName(stated).groupBy("source").agg(F.max("low_water").alias("low_water"))
        # A mark is one small row per source; the last two tables stay for readers.
        now.coalesce(1).write.mode("overwrite").json(f"{self.path}/marks/v={(found or [-1])[-1] + 1}")
        for old in found[:-1]:
            delete_path(self.spark, f"{self.path}/marks/v={old}")

    def expiry(self) -> str | None:
        """The least low-water position of all sources; None as long as one has stated none."""
        if not self.sources:
            return None
        own = self.marks().where(F.col("source").isin(list(self.sources)))
        n, least = own.agg(F.count_distinct("source"), F.min("low_water")).head()
        return least if n == len(set(self.sources)) else None

    def progress(self) -> DataFrame:
        """Batches since the last fold, and those before it as one row per query."""
        rows = self._rows(f"progress/gen={self.version()[0]}", PROGRESS)
        if rows is None:
            return self.spark.createDataFrame([], PROGRESS)
        # A batch that ran again after a fold counts once.
        return rows.groupBy("query", "batch").agg(F.max("applied_changes").alias("applied_changes"), F.max("max_lsn").alias("max_lsn"))

    def applied_changes(self) -> int:
        return self.progress().agg(F.coalesce(F.sum("applied_changes"), F.lit(0))).head()[0]

    def checkpoint_lsn(self) -> str | None:
        return self.progress().agg(F.max("max_lsn")).head()[0]

    def _parts_of(self, generation: int) -> list[Part]:
        """The parts of a generation, by lower bound; one row each, so their number follows the size of the base."""
        if generation == 0:
            return []
        rows = self.spark.read.parquet(f"{self.path}/parts/v={generation}").collect()
        return sorted((Part(*r) for r in rows), key=lambda p: (p.low is not None, p.low if p.low is not None else 0, p.part))

    def _base(self, generation: int, parts: Sequence[Part] | None = None) -> DataFrame:
        """The base, or some of its parts."""
        if generation == 0:
            return self.base
        parts = self._parts_of(generation) if parts is None else parts
        paths = [f"{self.path}/base/v={p.base}/part={p.part}" for p in parts if p.base is not None]
        schema = self.base.schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _ranged(self) -> bool:
        kind = {f.name.lower(): f.dataType for f in self.base.schema}[self.keys[0].lower()]
        return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))

    def _part_column(self, parts: Sequence[tuple[int, object]]) -> Column:
        """The part of a row, from ``(part, low)`` in order."""
        key = F.col(self.keys[0])
        if not self._ranged():
            return F.pmod(F.xxhash64(key), F.lit(len(parts))).cast("int")
        kind = {f.name.lower(): f.dataType for f in self.base.schema}[self.keys[0].lower()]
        ids = F.split(F.lit(",".join(str(p) for p, _ in parts)), ",").cast("array<int>")
        return F.get(ids, range_of(key, [low for _, low in parts[1:]], kind))

    def _net_schema(self, feed: T.StructType | None = None) -> T.StructType:
        fields = {f.name.lower(): f for f in self.base.schema}
        position = [
            T.StructField("lsn", T.BinaryType()),
            T.StructField("seq", T.BinaryType()),
            T.StructField("op", T.IntegerType()),
        ]
        lowered = {k.lower() for k in self.keys}
        values = [T.StructField(c, fields[c.lower()].dataType) for c in self.columns if c.lower() not in lowered]
        newest = [T.StructField("pos", T.StructType(position))]
        if values:
            newest.append(T.StructField("row", T.StructType(values)))
        return T.StructType(
            [T.StructField(k, fields[k.lower()].dataType) for k in self.keys]
            + [T.StructField("_last", T.StructType(newest)), T.StructField("_erased", T.StructType(position))]
        )

    def _parts(self, generation: int) -> DataFrame | None:
        """Net effects of every batch logged since the generation began, not yet merged."""
        path = f"{self.path}/log/gen={generation}"
        if not path_exists(self.spark, path):
            return None
        return self.spark.read.schema(self._net_schema()).option("recursiveFileLookup", "true").parquet(path)

    def snapshot(self) -> DataFrame:
        """The table as of the last finished batch; a small log never shuffles the base."""
        generation, *_ = self.version()
        parts, base = self._parts(generation), self._base(generation)
        if parts is None:
            return base
        return apply_net(base, merge_net(parts, self.keys), self.keys, self.columns, broadcast=fits_broadcast(parts))

    # -- writing -----------------------------------------------------------------------------

    def _typed(self, feed: DataFrame) -> DataFrame:
        fields = {f.name.lower(): f.dataType for f in self.base.schema}
        return feed.withColumns({c: F.col(c).cast(fields[c.lower()]) for c in self.columns})

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """Log one micro-batch. A retried batch replaces its own files and nothing else."""
        generation, folded_query, upto, low_water, expiry = self._version()
        query = _query_id(batch)
        if query == folded_query and batch_id <= upto:
            return
        changes = self._typed(binary_positions(batch))
        if expiry:  # delivered before, by every source
            changes = changes.where(F.col("start_lsn") >= F.lit(lsn_bytes(expiry)))
        net = net_changes(changes, self.keys, self.columns, count_as="changes")
        if low_water:
            net = self._with_folded(net, changes, generation, low_water)
        path = f"{self.path}/log/gen={generation}/batch={query}-{batch_id}"
        net.write.mode("overwrite").parquet(path)
        # Counted from the finished files, so retried tasks are never counted twice.
        done = self.spark.read.parquet(path)
        done.agg(
            F.lit(query).alias("query"),
            F.lit(batch_id).cast("long").alias("batch"),
            F.coalesce(F.sum("changes"), F.lit(0)).alias("applied_changes"),
            format_lsn(F.max("_last.pos.lsn")).alias("max_lsn"),
        ).coalesce(1).write.mode("overwrite").json(f"{self.path}/progress/gen={generation}/batch={query}-{batch_id}")

    def _folded(self, generation: int, parts: Sequence[Part] | None = None) -> DataFrame | None:
        """Net effect of what earlier generations moved into the base and an older change may still meet."""
        parts = self._parts_of(generation) if parts is None else parts
        paths = [f"{self.path}/folded/v={p.folded}/part={p.part}" for p in parts if p.folded is not None]
        return self.spark.read.schema(self._net_schema()).parquet(*paths) if paths else None

    def _with_folded(self, net: DataFrame, changes: DataFrame, generation: int, low_water: str) -> DataFrame:
        """``net`` with what the base already holds of keys that have changes below the low-water position.

        Together they give the newest row and the newest delete, so a change that comes late merges in its
        place and a replay changes nothing.
        """
        folded = self._folded(generation)
        if folded is None:
            return net
        late = changes.where(F.col("start_lsn") < F.lit(lsn_bytes(low_water))).select(*self.keys).distinct()
        held = folded.join(late, list(self.keys), "left_semi").withColumn("changes", F.lit(0).cast("long"))
        newest = [F.max("_last").alias("_last"), F.max("_erased").alias("_erased"), F.sum("changes").alias("changes")]
        return net.unionByName(held.select(*net.columns)).groupBy(*self.keys).agg(*newest)

    def _planned(self, generation: int, settled: DataFrame) -> tuple[list[Part], list[Part], list[tuple[int, object]]]:
        """Parts that stay, parts to write anew, and ``(part, low)`` of what those become; large ones are divided."""
        if generation == 0:
            n = max(1, math.ceil(self.base.count() / self.part_rows))
            lows = split_bounds(self.base, self.keys[0], n) if self._ranged() else list(range(1, n))
            return [], [], [(i, low if self._ranged() else None) for i, low in enumerate([None, *lows])]
        parts = self._parts_of(generation)
        hit = {r[0] for r in settled.select(self._part_column([(p.part, p.low) for p in parts])).distinct().collect()}
        kept, touched = [p for p in parts if p.part not in hit], [p for p in parts if p.part in hit]
        new, following = [], max(p.part for p in parts) + 1
        for p in touched:
            new.append((p.part, p.low))
            if p.rows > 2 * self.part_rows and self._ranged():
                inner = [x for x in split_bounds(self._base(generation, [p]), self.keys[0], math.ceil(p.rows / self.part_rows)) if p.low is None or x > p.low]
                new += [(following + i, low) for i, low in enumerate(inner)]
                following += len(inner)
        return kept, touched, new

    def fold(self, low_water: str | None = None, upto_batch: int = -1, query: str = MANUAL) -> None:
        """Start a new generation: changes below ``low_water`` (by default the sources' least position) move into the base.

        Only call it between batches of ``query``. Keys whose newest change is at or above the position stay in
        the log, so replays remain no-ops. Only parts of the base that hold settled keys are written anew, and only as much
        of their net effect is remembered as an older change may still meet. Finished generations are left in place for
        readers until :meth:`vacuum`; the versions row is written last, so a fold that breaks off is begun anew.
        """
        generation, _, _, _, before = self._version()
        expiry = max(filter(None, (self.expiry(), before)), default=None)
        low_water = low_water or expiry
        if low_water is None:
            raise ValueError("a low-water position is required until every source has stated one")
        following, parts = generation + 1, self._parts(generation)
        net = stage(merge_net(parts, self.keys), "fold-net") if parts is not None else self.spark.createDataFrame([], self._net_schema())
        below = F.col("_last.pos.lsn") < F.lit(lsn_bytes(low_water))
        settled = net.where(below)
        net.where(~below).write.mode("overwrite").parquet(f"{self.path}/log/gen={following}/batch=-1")
        kept, touched, new = self._planned(generation, settled)
        reach = F.col("_last.pos.lsn") >= F.lit(lsn_bytes(expiry)) if expiry else F.lit(True)
        # A part outside the fold forgets what it remembers once all of it is out of reach.
        kept = [p if p.top is None or not expiry or p.top >= expiry else Part(p.part, p.low, p.rows, p.base, None, None) for p in kept]
        written = self._write_parts(generation, following, touched, new, settled, reach) if new else []
        self._write_manifest(following, kept + written)
        self._carry_progress(generation, following, upto_batch, query)
        row = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip((following, query, upto_batch, low_water, expiry), VERSIONS, strict=True)]
        self.spark.range(1).select(*row).write.mode("overwrite").json(f"{self.path}/versions/v={following}")

    def _write_parts(self, generation: int, following: int, touched: list[Part], new: list[tuple[int, object]], settled: DataFrame, reach: Column) -> list[Part]:
        place = self._place_within(new, touched, generation)
        base = apply_net(self._base(generation, touched or None), settled, self.keys, self.columns, broadcast=fits_broadcast(settled))
        # Rows of a part meet before they are written: a task that held some of every part would write a file for each.
        base.withColumn("part", place).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/base/v={following}")
        before = self._folded(generation, touched)
        folded = settled if before is None else merge_net(settled.unionByName(before), self.keys)
        folded.where(reach).withColumn("part", place).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/folded/v={following}")

        def stored(name: str, schema: T.StructType) -> DataFrame:
            return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{self.path}/{name}/v={following}")

        rows = {r["part"]: r["n"] for r in stored("base", self.base.schema).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        tops = stored("folded", self._net_schema()).groupBy("part").agg(format_lsn(F.max("_last.pos.lsn")).alias("top")).collect()
        top = {r["part"]: r["top"] for r in tops}
        return [Part(p, low, rows.get(p, 0), following if p in rows else None, following if p in top else None, top.get(p)) for p, low in new]

    def _place_within(self, new: list[tuple[int, object]], touched: list[Part], generation: int) -> Column:
        """The part of a row that belongs to one of ``new``."""
        if self._ranged() or generation == 0:
            return self._part_column(new)
        return self._part_column([(p.part, None) for p in self._parts_of(generation)])

    def _write_manifest(self, following: int, parts: list[Part]) -> None:
        kind = {f.name.lower(): f.dataType for f in self.base.schema}[self.keys[0].lower()]
        names = T.StructType(
            [T.StructField("part", T.IntegerType()), T.StructField("low", kind), T.StructField("rows", T.LongType())]
            + [T.StructField(c, T.LongType()) for c in ("base", "folded")]
            + [T.StructField("top", T.StringType())]
        )
        rows = [(p.part, p.low, p.rows, p.base, p.folded, p.top) for p in parts]
        self.spark.createDataFrame(rows, names).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts/v={following}")

    def _carry_progress(self, generation: int, following: int, upto_batch: int, query: str) -> None:
        """Progress so far as one file; the batches of ``query`` up to the fold as one row."""
        rows = self._rows(f"progress/gen={generation}", PROGRESS)
        if rows is None:
            return
        done = (F.col("query") == query) & (F.col("batch") <= upto_batch)
        batch = F.when(done, F.lit(upto_batch).cast("long")).otherwise(F.col("batch"))
        carried = rows.groupBy("query", batch.alias("batch")).agg(F.sum("applied_changes").alias("applied_changes"), F.max("max_lsn").alias("max_lsn"))
        carried.coalesce(1).write.mode("overwrite").json(f"{self.path}/progress/gen={following}/batch=-1")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the last ``keep`` generations reads. No reader of an older one may be left."""
        generation = self.version()[0]
        stay = range(max(1, generation - keep + 1), generation + 1)
        used = {(name, g, p.part) for v in stay for p in self._parts_of(v) for name, g in (("base", p.base), ("folded", p.folded)) if g is not None}
        for name in ("base", "folded"):
            for g in self._numbered(name):
                path = f"{self.path}/{name}/v={g}"
                for folder in folder_names(self.spark, path) if g <= generation else ():
                    if (name, g, int(folder.removeprefix("part="))) not in used:
                        delete_path(self.spark, f"{path}/{folder}")
        for g in range(0, stay.start):
            for old in (f"log/gen={g}", f"progress/gen={g}", f"parts/v={g}"):
                delete_path(self.spark, f"{self.path}/{old}")


def replicate_stream(feed: DataFrame, replica: Replica, query_dir: str, trigger: dict | None = None):
    """Start the stream. ``trigger`` defaults to everything available now, then stop."""
    return (
        feed.writeStream.foreachBatch(lambda batch, batch_id: replica.absorb(batch, batch_id))
        .option("checkpointLocation", query_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def replicate_until(
    feed: DataFrame,
    replica: Replica,
    query_dir: str,
    max_iterations: int = 1,
    max_idle: int = 1,
    poll_seconds: float = 5.0,
    min_applied: int = 0,
) -> int:
    """Catch up repeatedly until the iteration or idle limit; returns the applied changes."""
    before = replica.applied_changes()
    last, idle = before, 0
    for iteration in range(max_iterations):
        if iteration:
            time.sleep(poll_seconds)
        replicate_stream(feed, replica, query_dir).awaitTermination()
        now = replica.applied_changes()
        idle = idle + 1 if now == last else 0
        last = now
        if idle >= max_idle:
            break
    applied = last - before
    if applied < min_applied:
        raise RuntimeError(f"applied {applied} changes, required {min_applied}")
    return applied
