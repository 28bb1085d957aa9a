"""One large CSV file read by many tasks, line breaks inside quoted values included.

Whether a line begins a record depends on the number of quotes before it in its file, so:

1. every split of a file counts its quotes, and keeps the lines before its first and after its last record for both
   cases, that it begins inside a value or not;
2. a running sum over the splits of each file tells how each split begins, which picks the pieces that are real, and
   pieces of a record that crosses splits are put together;
3. every split is read again and cut into records, each parsed by Spark's own CSV expression.

Quotes are doubled inside quoted values and occur nowhere else, as the writer here and the format's standard have it; a bare
quote fails the job, and so does a row of another width. Lines end in LF or, if a file's header does, in CRLF. A
gzip file is one split. Blank lines are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movekit.session import stage

#: Pieces of records at a split's ends are kept up to this size by the first pass; longer ones are read when needed.
PIECE_BYTES = 1 << 20
#: Beyond so many splits their table is not broadcast and files are read whole (200,000 splits of 128 MB are 25 TB).
MOST_SPLITS = 200_000

_ENDS = (
    "file long, block long, quotes long, crlf boolean, head binary, head_closes boolean, head_long boolean, "
    "tail0 binary, tail0_long boolean, tail0_first boolean, tail1 binary, tail1_long boolean"
)
_RECORDS = "file long, block long, kind int, first boolean, record binary"
#: Kinds of rows: whole records, the end of a record begun in an earlier split, the start of one that goes on.
WHOLE, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("value").cast("binary").alias("value"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


class _Buffer:
    """Lines up to a size; beyond it only the fact that there were more."""

    def __init__(self, limit: int | None) -> None:
        self.limit, self.lines, self.size, self.over = limit, [], 0, False

    def add(self, lines: list[bytes]) -> None:
        if self.over:
            return
        self.size += sum(map(len, lines)) + len(lines)
        if self.limit is not None and self.size > self.limit:
            self.over, self.lines = True, []
        else:
            self.lines += lines

    def text(self) -> bytes | None:
        return None if self.over else b"\n".join(self.lines)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Batches cut where the split changes; a task may read several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("file", "block"))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


class _Ends:
    """What the first pass keeps of one split."""

    def __init__(self, block: int, limit: int) -> None:
        self.block, self.limit, self.quotes, self.crlf = block, limit, 0, None
        self.head, self.closed = _Buffer(limit), False
        self.tails, self.first = [None, None], True

    def read(self, values: pa.Array) -> None:
        n = pc.count_substring(values, '"').to_numpy().astype(np.int64)
        after = self.quotes + np.cumsum(n)
        before = after - n
        if not self.closed:
            odd = np.flatnonzero(after % 2 == 1)
            stop = int(odd[0]) + 1 if len(odd) else len(values)
            self.head.add(values.slice(0, stop).to_pylist())
            self.closed = bool(len(odd))
        if self.block == 0 and self.crlf is None and len(even := np.flatnonzero(after % 2 == 0)):
            self.crlf = values[int(even[0])].as_py().endswith(b"\r")
        for parity in (0, 1):
            starts = np.flatnonzero(before % 2 == parity)
            if len(starts):
                last = int(starts[-1])
                self.tails[parity] = _Buffer(self.limit)
                self.tails[parity].add(values.slice(last).to_pylist())
                if parity == 0:
                    self.first = self.first and last == 0 and self.quotes == 0 and self.seen == 0
            elif self.tails[parity] is not None:
                self.tails[parity].add(values.to_pylist())
        self.quotes = int(after[-1])
        self.seen += len(values)

    seen = 0

    def row(self) -> dict:
        none = _Buffer(self.limit)
        none.over = True
        even, odd = (t or none for t in self.tails)
        return {
            "quotes": self.quotes, "crlf": self.crlf, "head": self.head.text(), "head_closes": self.closed, "head_long": self.head.over,
            "tail0": even.text(), "tail0_long": even.over, "tail0_first": self.block == 0 and self.first, "tail1": odd.text(), "tail1_long": odd.over and self.tails[1] is not None,
        }


def _ends(limit: int):
    schema = T._parse_datatype_string(_ENDS)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out() -> pa.RecordBatch:
            row = {"file": key[0], "block": key[1], **state.row()}
            types = {"file": pa.int64(), "block": pa.int64(), "quotes": pa.int64(), "head": pa.binary(), "tail0": pa.binary(), "tail1": pa.binary()}
            return pa.record_batch([pa.array([row[c]], types.get(c, pa.bool_())) for c in names], names)

        for at, batch in _by_split(batches):
            if at != key:
                if key is not None:
                    yield out()
                key, state = at, _Ends(at[1], limit)
            state.read(batch.column(0))
        if key is not None:
            yield out()

    return run


def _check(record: bytes, width: int) -> None:
    """Quotes only around fields, and as many fields as the header has."""
    outside = record.split(b'"')[::2]
    fields = 1
    for i, part in enumerate(outside):
        fields += part.count(b",")
        opens, closes = i < len(outside) - 1, i > 0
        if not part and 0 < i < len(outside) - 1:
            continue  # a doubled quote
        if (opens and part and not part.endswith(b",")) or (closes and part and not part.startswith(b",")):
            raise ValueError(f"bare quote in record {record[:200]!r}")
    if fields != width:
        raise ValueError(f"{fields} fields instead of {width} in record {record[:200]!r}")


def _records(width: int, pieces: bool):
    """Cuts lines into records; ``pieces`` gives the incomplete ones at the ends of splits and nothing else."""
    names = ["file", "block", "kind", "first", "record"]

    def batch_of(key: tuple[int, int], rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
        n = len(rows)
        return pa.record_batch(
            [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, inside, crlf, kind, first = None, [], False, False, WHOLE, False
        for at, batch in _by_split(batches):
            if at != key:
                if key is not None and pieces and held:
                    yield batch_of(key, [(HEAD if kind == HEAD else TAIL, first, b"\n".join(held))])
                key, held = at, []
                inside, crlf = (bool(batch.column(batch.schema.get_field_index(c))[0].as_py()) for c in ("odd", "crlf"))
                kind, first = (HEAD if inside else WHOLE), at[1] == 0
            values = batch.column(0)
            quotes = pc.count_substring(values, '"').to_numpy()
            commas = pc.count_substring(values, ",").to_numpy()
            rows = []
            for line, n, c in zip(values.to_pylist(), quotes, commas, strict=True):
                if n == 0 and not inside:
                    # The usual case: a line that is a record.
                    if crlf and line.endswith(b"\r"):
                        line = line[:-1]
                    if line and not pieces:
                        if c + 1 != width:
                            raise ValueError(f"{c + 1} fields instead of {width} in record {line[:200]!r}")
                        rows.append((WHOLE, first, line))
                    first = first and not line
                    continue
                held.append(line)
                if n % 2:
                    inside = not inside
                if inside:
                    continue
                record = held[0] if len(held) == 1 else b"\n".join(held)
                if crlf and record.endswith(b"\r"):
                    record = record[:-1]
                if kind == HEAD:
                    if pieces:
                        rows.append((HEAD, False, record))
                elif not pieces:
                    _check(record, width)
                    rows.append((WHOLE, first, record))
                held, kind, first = [], WHOLE, False
            if rows:
                yield batch_of(key, rows)
        if key is not None and pieces and held:
            yield batch_of(key, [(HEAD if kind == HEAD else TAIL, first, b"\n".join(held))])

    return run


def _checked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.column(1).to_pylist():
                _check(record, width)
            yield batch

    return run


def split_records(spark: SparkSession, path: str, width: int, piece_bytes: int = PIECE_BYTES, most_splits: int = MOST_SPLITS) -> DataFrame | None:
    """``first, record`` for every record of the files at ``path``: ``first`` marks the header of each file.

    None if there are more splits than may be broadcast.
    """
    ends = stage(_lines(spark, path).mapInArrow(_ends(piece_bytes), _ENDS), "csv-ends")
    light = ends.select("file", "block", "quotes", "crlf", "head_closes", "head_long", "tail0_long", "tail1_long", F.col("tail0").isNotNull().alias("even_start"), F.col("tail1").isNotNull().alias("odd_start"))
    n, n_keys = light.count(), light.select("file", "block").distinct().count()
    if n != n_keys:
        raise ValueError(f"{n} splits with {n_keys} keys: files share a hash, or changed while they were read")
    if light.groupBy("file").agg(F.sum("quotes").alias("n")).where("n % 2 = 1").count():
        raise ValueError("a quoted value is never closed")
    if n > most_splits:
        return None
    order = W.partitionBy("file").orderBy("block")
    so_far = F.coalesce(F.sum("quotes").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = light.withColumn("odd", so_far % 2 == 1).withColumn("crlf", F.coalesce(F.first("crlf", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(False)))
    # A record goes on beyond the split if the quotes up to its end are odd; it began here if a line begins one.
    open_end = (F.col("quotes") + F.col("odd").cast("long")) % 2 == 1
    starts = F.when(F.col("odd"), F.col("odd_start") | F.col("tail1_long")).otherwise(F.lit(True))
    known = known.withColumn("has_tail", open_end & starts)
    # Records that cross splits are numbered by the splits they begin in: a head ends the last one begun before.
    known = stage(known.withColumn("n", F.count_if("has_tail").over(order.rowsBetween(W.unboundedPreceding, 0))), "csv-splits")
    lines = _lines(spark, path).join(F.broadcast(known.select("file", "block", "odd", "crlf", F.lit(True).alias("met"))), ["file", "block"], "left")
    met = F.when(F.col("met"), F.col("odd")).otherwise(F.raise_error(F.lit("the splits of the files changed while they were read")))
    lines = lines.select("value", "file", "block", met.cast("boolean").alias("odd"), "crlf")
    whole = lines.mapInArrow(_records(width, pieces=False), _RECORDS).select("first", "record")

    # Records that cross splits.
    late = F.when(F.col("odd"), F.col("head_long") | (F.col("has_tail") & F.col("tail1_long"))).otherwise(F.col("has_tail") & F.col("tail0_long"))
    cut = known.join(ends.select("file", "block", "head", "tail0", "tail0_first", "tail1"), ["file", "block"]).withColumn("late", late)
    near = cut.where("(odd OR has_tail) AND NOT late")
    ends_cr = F.col("head_closes") & F.col("crlf") & (F.right(F.col("head").cast("string"), F.lit(1)) == "\r")
    trimmed = F.when(ends_cr, F.expr("substring(head, 1, octet_length(head) - 1)")).otherwise(F.col("head"))
    tail = F.when(F.col("odd"), F.col("tail1")).otherwise(F.col("tail0"))
    parts = near.where("odd").select("file", "block", F.lit(HEAD).alias("kind"), F.lit(False).alias("first"), trimmed.alias("record")).unionByName(
        near.where("has_tail").select("file", "block", F.lit(TAIL).alias("kind"), (~F.col("odd") & F.col("tail0_first")).alias("first"), tail.alias("record"))
    )
    if not cut.where("late").isEmpty():
        far = lines.join(F.broadcast(known.withColumn("late", late).where("late").select("file", "block")), ["file", "block"], "left_semi")
        parts = parts.unionByName(far.select("value", "file", "block", "odd", "crlf").mapInArrow(_records(width, pieces=True), _RECORDS))
    if parts.isEmpty():
        return whole
    begun = F.when((F.col("kind") == HEAD) & F.col("has_tail"), F.col("n") - 1).otherwise(F.col("n"))
    numbered = parts.join(known.select("file", "block", "n", "has_tail"), ["file", "block"]).withColumn("n", begun)
    # Within a split its head comes before its tail.
    joined = numbered.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("block", "kind", "record"))).alias("p"), F.bool_or("first").alias("first"))
    text = F.array_join(F.transform("p", lambda x: x["record"].cast("string")), "\n")
    crossing = joined.select("first", text.cast("binary").alias("record")).mapInArrow(_checked(width), "first boolean, record binary")
    return whole.unionByName(crossing)


def parse_records(records: DataFrame, columns: Sequence[str], options: dict[str, str]) -> DataFrame:
    """All-text columns of records; each header must equal ``columns`` and is left out."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    parsed = F.from_csv(F.col("record").cast("string"), schema.simpleString()[len("struct<") : -1].replace(":", " "), {**options, "mode": "FAILFAST", "multiLine": "true"})
    names = F.concat_ws("\0", *[F.coalesce(parsed.getField(f.name), F.lit("")) for f in schema])
    same = F.when(names == F.lit("\0".join(columns)), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("header differs: "), names)).cast("boolean"))
    rows = records.where(F.when(F.col("first"), same).otherwise(F.lit(True))).select(parsed.alias("row"))

    def field(i: int, name: str) -> Column:
        return F.col("row").getField(f"c{i}").alias(name)

    return rows.select(*[field(i, c) for i, c in enumerate(columns)])
