"""Log ranges of tracked tables: validity, next range, explicit range, what is left to apply, checkpoints.

Plan tables have one row per tracked table: project, source_object, target_object, columns[],
key_columns[], apply_batch_size, from_lsn, to_lsn (LSNs as text). Checkpoint tables have
project, source_object, target_object, from_lsn, to_lsn, applied_changes, completed_at.
Joins are plain equi-joins; the optimizer broadcasts a side when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from movekit.functions.lsn import format_lsn, is_lsn, lsn_bytes, parse_lsn, range_ok, require_lsn
from movekit.functions.scalars import blank, rfc3339, source_name_ok, strip, target_name_ok
from movekit.session import by_key

ID = ("project", "source_object")
# States of a checkpoint.
CHECKPOINT_STATES = ("not_started", "planned", "running", "caught_up", "failed")


def broken_rules(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules whose condition holds, as an array; one row can break several."""
    return F.array_remove(F.array(*[F.when(cond, F.lit(name)).otherwise("") for name, cond in rules]), "")


def violations(df: DataFrame, ids: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per broken rule, identified by ``ids``."""
    return df.select(*ids, F.explode(broken_rules(rules)).alias("rule"))


def repeated(df: DataFrame, ids: Sequence[str], rule: str) -> DataFrame:
    """Ids that occur more than once, reported once each; pre-aggregated before the shuffle."""
    return df.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*ids, F.lit(rule).alias("rule"))


def _has_blank(names: Column) -> Column:
    return F.exists(names, lambda x: blank(x))


def _has_twins(names: Column) -> Column:
    lowered = F.transform(F.filter(names, lambda x: ~blank(x)), lambda x: F.lower(strip(x)))
    return F.size(F.array_distinct(lowered)) < F.size(lowered)


def _names(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def validate_tracked(tracked: DataFrame, require_range: bool = True) -> DataFrame:
    """Broken rules of tracked tables: names, uniqueness, batch size, retention, columns, keys, range."""
    source, target = F.col("source_object"), F.col("target_object")
    columns, keys = _names("columns"), _names("key_columns")
    lowered = lambda names: F.transform(names, lambda x: F.lower(strip(x)))
    rules = [
        ("retention_not_positive", F.coalesce(F.col("retention_hours") <= 0, F.lit(True))),
        ("source_required", blank(source)),
        ("source_malformed", ~blank(source) & ~source_name_ok(source)),
        ("target_required", blank(target)),
        ("target_malformed", ~blank(target) & ~target_name_ok(target)),
        ("batch_size_not_positive", F.coalesce(F.col("apply_batch_size") <= 0, F.lit(True))),
        ("columns_required", F.size(columns) == 0),
        ("column_empty", _has_blank(columns)),
        ("column_repeated", _has_twins(columns)),
        ("key_required", F.size(keys) == 0),
        ("key_empty", _has_blank(keys)),
        ("key_repeated", _has_twins(keys)),
        ("key_not_captured", F.size(F.array_except(F.filter(lowered(keys), lambda k: k != ""), lowered(columns))) > 0),
    ]
    if require_range:
        low, high = F.col("from_lsn"), F.col("to_lsn")
        rules += [
            ("from_malformed", ~is_lsn(low)),
            ("to_malformed", ~is_lsn(high)),
            ("range_reversed", is_lsn(low) & is_lsn(high) & ~range_ok(low, high)),
        ]
    clean = tracked.withColumn("source_object", strip(F.coalesce(source, F.lit(""))))
    twice = repeated(clean.where(F.col("source_object") != ""), ID, "source_repeated")
    return violations(clean, ID, rules).unionByName(twice)


def validate_checkpoint(entries: DataFrame) -> DataFrame:
    """Broken rules of checkpoint entries."""
    source, target, low, high = (F.col(c) for c in ("source_object", "target_object", "from_lsn", "to_lsn"))
    done = F.col("completed_at")
    return violations(
        entries,
        ID,
        [
            ("source_required", blank(source)),
            ("source_malformed", ~blank(source) & ~source_name_ok(source)),
            ("target_required", blank(target)),
            ("target_malformed", ~blank(target) & ~target_name_ok(target)),
            ("from_malformed", ~is_lsn(low)),
            ("to_malformed", ~is_lsn(high)),
            ("range_reversed", is_lsn(low) & is_lsn(high) & ~range_ok(low, high)),
            ("changes_required", F.col("applied_changes").isNull()),
            ("changes_negative", F.coalesce(F.col("applied_changes") < 0, F.lit(False))),
            ("completed_required", blank(done)),
            ("completed_malformed", ~blank(done) & rfc3339(done).isNull()),
        ],
    )


def _with_state(tracked: DataFrame, checkpoint: DataFrame, low_marks: DataFrame | None) -> DataFrame:
    """Tracked tables with their checkpoint (ck_*) and retention low mark (min_lsn), if any.

    Of several entries for one table the highest position counts, malformed ones before all others, so
    that they are reported. Low marks may name their project; those of one cluster then say nothing about
    a table of the same name in another.
    """
    state = checkpoint.where(~blank(F.col("source_object"))).select(
        *ID, F.col("target_object").alias("ck_target"), strip(F.col("to_lsn")).alias("ck_to")
    )
    rank = F.struct(~blank(F.col("ck_to")) & ~is_lsn(F.col("ck_to")), parse_lsn(F.col("ck_to")), F.col("ck_to"), F.col("ck_target"))
    state = state.groupBy(*ID).agg(F.max_by(F.struct("ck_target", "ck_to"), rank).alias("s")).select(*ID, "s.*")
    joined = tracked.join(state, list(ID), "left")
    if low_marks is None:
        return joined.withColumn("min_lsn", F.lit(None).cast("string"))
    by = [c for c in ("project", "source_object") if c in low_marks.columns]
    marks = low_marks.select(*by, strip(F.col("min_lsn")).alias("min_lsn"))
    malformed = ~blank(F.col("min_lsn")) & ~is_lsn(F.col("min_lsn"))
    marks = marks.groupBy(*by).agg(F.max_by("min_lsn", F.struct(malformed, parse_lsn(F.col("min_lsn")), F.col("min_lsn"))).alias("min_lsn"))
    return joined.join(marks, by, "left")


def _bad_mark() -> Column:
    return ~blank(F.col("min_lsn")) & ~is_lsn(F.col("min_lsn"))


def _expired(from_lsn: Column) -> Column:
    return ~blank(F.col("min_lsn")) & F.coalesce(parse_lsn(from_lsn) < parse_lsn(F.col("min_lsn")), F.lit(False))


def _moved() -> Column:
    return ~blank(F.col("ck_target")) & (F.col("ck_target") != F.col("target_object"))


def next_ranges(
    tracked: DataFrame,
    checkpoint: DataFrame,
    max_lsn: str,
    low_marks: DataFrame | None = None,
    initial_lsn: str | None = None,
) -> DataFrame:
    """Per tracked table the range from its checkpoint to ``max_lsn``, and its project's status.

    ``error`` names why a table has no range; one such table holds back its whole project
    (status ``blocked``). A project whose tables all stand at ``max_lsn`` is ``caught_up`` and
    gets no range; otherwise every table of it gets one (``range_prepared``).
    """
    lsn_bytes(max_lsn, "max_lsn")
    if initial_lsn and initial_lsn.strip():
        lsn_bytes(initial_lsn, "initial_lsn")
    start = F.when(blank(F.col("ck_to")), F.lit(initial_lsn)).otherwise(F.col("ck_to"))
    low, high = F.col("_from"), F.lit(max_lsn.strip())
    rows = _with_state(tracked, checkpoint, low_marks).withColumn("_from", start)
    error = (
        F.when(_moved(), "target_differs")
        .when(blank(low), "no_start")
        .when(~is_lsn(low), "from_malformed")
        .when(_bad_mark(), "min_malformed")
        .when(_expired(low), "retention_expired")
        .when(parse_lsn(low) > parse_lsn(high), "ahead_of_source")
    )
    rows = rows.withColumn("error", error).withColumn("_behind", F.coalesce(parse_lsn(low) < parse_lsn(high), F.lit(False)))
    projects = rows.groupBy("project").agg(
        F.when(F.count("error") > 0, "blocked")
        .when(F.bool_or("_behind"), "range_prepared")
        .otherwise("caught_up")
        .alias("status")
    )
    prepared = F.col("status") == "range_prepared"
    return rows.join(projects, "project").select(
        *ID,
        "target_object",
        F.when(prepared, low).alias("from_lsn"),
        F.when(prepared, high).alias("to_lsn"),
        "error",
        "status",
    )


def explicit_range(
    tracked: DataFrame,
    checkpoint: DataFrame,
    to_lsn: str,
    low_marks: DataFrame | None = None,
    from_lsn: str | None = None,
) -> DataFrame:
    """Range up to a stated end; no caught-up shortcut."""
    lsn_bytes(to_lsn, "to_lsn")
    if from_lsn and from_lsn.strip():
        lsn_bytes(from_lsn, "from_lsn")
    start = F.when(blank(F.col("ck_to")), F.lit(from_lsn)).otherwise(F.col("ck_to"))
    low, high = F.col("_from"), F.lit(to_lsn.strip())
    error = (
        F.when(blank(low), "no_start")
        .when(~is_lsn(low), "from_malformed")
        .when(_bad_mark(), "min_malformed")
        .when(_expired(low), "retention_expired")
        .when(~range_ok(low, high), "range_reversed")
    )
    rows = _with_state(tracked, checkpoint, low_marks).withColumn("_from", start).withColumn("error", error)
    return rows.select(
        *ID,
        "target_object",
        F.when(F.col("error").isNull(), low).alias("from_lsn"),
        F.when(F.col("error").isNull(), high).alias("to_lsn"),
        "error",
    )


def apply_needed(tracked: DataFrame, checkpoint: DataFrame, low_marks: DataFrame | None = None) -> DataFrame:
    """Whether the planned range of each table is still to be applied.

    Without a checkpoint it is. A checkpoint at or past the range end means it is done; one that
    is behind must stand exactly at the range start, else there is a gap.
    """
    low, high, mark = F.col("from_lsn"), F.col("to_lsn"), F.col("ck_to")
    fresh = blank(mark)
    done = ~fresh & F.coalesce(parse_lsn(mark) >= parse_lsn(high), F.lit(False))
    error = (
        F.when(~is_lsn(high), "to_malformed")
        .when(_bad_mark(), "min_malformed")
        .when(fresh & _expired(low), "retention_expired")
        .when(fresh, None)
        .when(_moved(), "target_differs")
        .when(~is_lsn(mark), "checkpoint_malformed")
        .when(done, None)
        .when(mark != strip(low), "gap")
        .when(_expired(low), "retention_expired")
    )
    rows = _with_state(tracked, checkpoint, low_marks).withColumn("error", error)
    needed = F.col("error").isNull() & ~done
    return rows.select(
        *ID,
        "target_object",
        needed.alias("needed"),
        F.when(F.col("error").isNull() & done, "already checkpointed").alias("reason"),
        "error",
    )


def arg_value(args: Column, flag: str) -> Column:
    """Trimmed element after ``flag`` in an argument list, NULL when absent or blank."""
    at = F.array_position(args, flag).cast("int")
    value = strip(F.when((at > 0) & (at < F.size(args)), F.get(args, at)))
    return F.when(value != "", value)


def snapshots_from_commands(commands: DataFrame) -> DataFrame:
    """Checkpoint candidates from cdc commands: project, run_id, command_id, args[], figures, times."""
    args = F.col("args")
    return commands.select(
        "project",
        "run_id",
        "run_status",
        "position",
        "command_id",
        arg_value(args, "--source-object").alias("source_object"),
        arg_value(args, "--target-object").alias("target_object"),
        arg_value(args, "--from-lsn").alias("from_lsn"),
        arg_value(args, "--to-lsn").alias("to_lsn"),
        "applied_changes",
        "completed_at",
    )


def snapshot_violations(snapshots: DataFrame, tracked: DataFrame) -> DataFrame:
    """Why a finished run may not advance the checkpoint, one row per command and rule."""
    plan = tracked.select(
        *ID,
        F.col("target_object").alias("plan_target"),
        F.col("from_lsn").alias("plan_from"),
        F.col("to_lsn").alias("plan_to"),
    )
    joined = snapshots.join(plan, list(ID), "left")
    known = F.col("plan_target").isNotNull()
    low, high = F.col("from_lsn"), F.col("to_lsn")
    differs = lambda a, b: known & F.col(a).isNotNull() & ~F.col(a).eqNullSafe(F.col(b))
    return violations(
        joined,
        ["project", "run_id", "command_id"],
        [
            ("run_not_succeeded", ~F.col("run_status").eqNullSafe("succeeded")),
            ("changes_required", F.col("applied_changes").isNull()),
            ("source_required", F.col("source_object").isNull()),
            ("target_required", F.col("target_object").isNull()),
            ("from_malformed", ~is_lsn(low)),
            ("to_malformed", ~is_lsn(high)),
            ("range_reversed", is_lsn(low) & is_lsn(high) & ~range_ok(low, high)),
            ("source_not_tracked", F.col("source_object").isNotNull() & ~known),
            ("target_differs", differs("target_object", "plan_target")),
            ("from_differs", differs("from_lsn", "plan_from")),
            ("to_differs", differs("to_lsn", "plan_to")),
        ],
    )


def advance_checkpoint(
    checkpoint: DataFrame, snapshots: DataFrame, tracked: DataFrame, status: str = "running"
) -> DataFrame:
    """Checkpoint table after finished runs; a run with any violation advances nothing.

    Entries are replaced by key, so projects and tables outside the runs keep theirs.
    """
    if status not in CHECKPOINT_STATES:
        raise ValueError(f"unsupported checkpoint status {status!r}; one of {', '.join(CHECKPOINT_STATES)}")
    rejected = snapshot_violations(snapshots, tracked).select("project", "run_id").distinct()
    good = snapshots.join(rejected, ["project", "run_id"], "left_anti")
    entry = F.struct("target_object", "from_lsn", "to_lsn", "applied_changes", "completed_at")
    newest = (
        good.groupBy(*ID)
        .agg(F.max_by(entry, F.struct(rfc3339(F.col("completed_at")), F.col("run_id"), F.col("position"))).alias("e"))
        .select(*ID, "e.*", F.lit(status).alias("status"))
    )
    kept = checkpoint.join(newest.select(*ID), list(ID), "left_anti")
    return kept.select(*newest.columns).unionByName(newest)


def range_islands(finished: DataFrame, ids: Sequence[str] = ID) -> DataFrame:
    """The union of finished ranges per table: one row for each stretch without a hole.

    Ranges hold both ends and the next one begins where the last one ended, so two belong together when they share a
    position. Order and repetition of the runs do not matter. Malformed and reversed ranges fail the job.
    """
    low, high = require_lsn(F.col("from_lsn"), "from_lsn"), require_lsn(F.col("to_lsn"), "to_lsn")
    sound = F.when(low <= high, high).otherwise(F.raise_error(F.concat(F.lit("range reversed: "), F.col("from_lsn"), F.lit(" "), F.col("to_lsn"))).cast("binary"))
    # Equal ranges, and those of one start, need only their farthest end.
    ranges = finished.select(*ids, low.alias("low"), sound.alias("high")).groupBy(*ids, "low").agg(F.max("high").alias("high"), F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*ids).orderBy("low")
    reached = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce(F.col("low") > reached, F.lit(True))
    numbered = ranges.withColumn("opens", opens).withColumn("island", F.count_if("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = numbered.groupBy(*ids, "island").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("runs"))
    return found.select(*ids, format_lsn(F.col("low")).alias("from_lsn"), format_lsn(F.col("high")).alias("to_lsn"), "runs")


def _reached(checkpoint: DataFrame, finished: DataFrame) -> DataFrame:
    """Islands of finished ranges and checkpoint positions that are not wholly below the checkpoint, with their place."""
    place = checkpoint.groupBy(*ID).agg(F.max(require_lsn(F.col("to_lsn"), "to_lsn")).alias("at"))
    point = place.select(*ID, format_lsn(F.col("at")).alias("from_lsn"), format_lsn(F.col("at")).alias("to_lsn"))
    ranges = finished.select(*ID, "from_lsn", "to_lsn").join(place.select(*ID), list(ID), "left_semi")
    islands = range_islands(ranges.unionByName(point)).join(place, list(ID)).where(parse_lsn(F.col("to_lsn")) >= F.col("at"))
    return islands.withColumn("place", F.row_number().over(W.partitionBy(*ID).orderBy("from_lsn")))


def advance_over(checkpoint: DataFrame, finished: DataFrame) -> DataFrame:
    """How far each checkpoint may move over runs that finished in any order.

    ``checkpoint`` has a position ``to_lsn`` per table, ``finished`` the ranges of succeeded runs. The position moves to
    the end of the stretch it stands in, and no farther than the first hole; ``holes`` counts those above it.
    """
    first = F.col("place") == 1
    return _reached(checkpoint, finished).groupBy(*ID).agg(
        format_lsn(F.first("at")).alias("from_lsn"),
        F.max(F.when(first, F.col("to_lsn"))).alias("to_lsn"),
        (F.count(F.lit(1)) - 1).alias("holes"),
    )


def open_ranges(checkpoint: DataFrame, finished: DataFrame) -> DataFrame:
    """What runs have still to cover: each hole between a checkpoint and the farthest finished range, ends included."""
    order = W.partitionBy(*ID).orderBy("place")
    holes = _reached(checkpoint, finished).withColumn("hole", F.lag("to_lsn").over(order))
    return holes.where(F.col("hole").isNotNull()).select(*ID, F.col("hole").alias("from_lsn"), F.col("from_lsn").alias("to_lsn"))


def plan_tracked(
    tables: DataFrame,
    captured: DataFrame,
    keys: DataFrame,
    apply_batch_size: int = 1000,
    retention_hours: int = 168,
    mode: str = "cdc",
) -> DataFrame:
    """Tracked-table plan of a project scope: captured and key columns of every table.

    ``tables`` carries source_object and target_object next to database, schema and table;
    ``captured`` and ``keys`` come from the catalog. A table without columns or without a usable
    key gets an empty list, which :func:`validate_tracked` then reports.
    """
    ids = ["database", "schema", "table"]
    none = F.array().cast("array<string>")
    return (
        tables.join(by_key(captured), ids, "left")
        .join(by_key(keys), ids, "left")
        .select(
            "source_object",
            "target_object",
            F.coalesce("columns", none).alias("columns"),
            F.coalesce("key_columns", none).alias("key_columns"),
            F.lit(apply_batch_size if apply_batch_size > 0 else 1000).alias("apply_batch_size"),
            F.lit(retention_hours if retention_hours > 0 else 168).alias("retention_hours"),
            F.lit(mode).alias("mode"),
        )
    )
