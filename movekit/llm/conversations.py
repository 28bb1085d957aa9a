"""Repair of conversations by generalised LR parsing of their roles.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turn. The grammar is ``S -> P | s P | (nothing)``, ``P -> u a | P u a``. The parser reads the rows and, at
every one, forks into all edits: keep it, give it the role of a user or assistant, delete it, insert an empty turn
before it. Stacks that share their lower part share its nodes, and where two forks reach the same stack only the one
with the smaller (cost, audit) goes on, so no more than eight stacks are ever alive.

Ordinary conversations are one row each, an array of their turns, after one shuffle; Python sees a letter for each
turn. Long ones, up to any share of all rows, are cut into runs of turns: a run is a table from the stack before it
to the stacks after it, tables are joined up a tree, and the choice is handed down the tree to the runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from json import dumps, loads

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from movekit.llm.common import BLANKS, narrow, shuffle_width
from movekit.session import stage

ROW = ("conv_id", "turn", "role", "text")
#: A conversation within both limits is handled as one value, any other in runs of ``RUN`` turns and groups of ``FAN``.
MOST_ROWS, MOST_BYTES = 512, 8 << 20
RUN, FAN = 1024, 32
#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# The grammar's LR(0) states. Shifts by state and role; states that reduce, by the number of symbols they pop;
# where P leads from the state below; states in which the conversation may end.
SHIFT = {0: {"s": 3, "u": 4}, 2: {"u": 5}, 3: {"u": 4}, 4: {"a": 7}, 5: {"a": 8}, 6: {"u": 5}}
REDUCE = {7: 2, 8: 3}
GOTO = {0: 2, 3: 6}
ENDS = (0, 2, 6)
#: The role on top of a stack, by its state.
LAST = {0: "", 3: "s", 4: "u", 5: "u", 2: "a", 6: "a"}
FULL = {"u": "user", "a": "assistant"}

Value = tuple[int, str]


@dataclass(frozen=True, eq=False)
class Node:
    """A state and the stack below it; equal stacks are the same node."""

    state: int
    below: Node | None


_nodes: dict[tuple[int, Node | None], Node] = {}
_pushed: dict[tuple[Node, str], Node | None] = {}


def node(state: int, below: Node | None) -> Node:
    if (found := _nodes.get((state, below))) is None:
        found = _nodes[state, below] = Node(state, below)
    return found


def push(top: Node, role: str) -> Node | None:
    """The stack after a role, reduced as far as it goes; None if the grammar has no such turn there."""
    if (top, role) not in _pushed:
        to = SHIFT.get(top.state, {}).get(role)
        now = None if to is None else node(to, top)
        while now is not None and now.state in REDUCE:
            base = now
            for _ in range(REDUCE[now.state]):
                base = base.below
            now = node(GOTO[base.state], base)
        _pushed[top, role] = now
    return _pushed[top, role]


def name_of(stack: Node) -> str:
    """The states of a stack from its bottom."""
    return (name_of(stack.below) if stack.below else "") + str(stack.state)


def stack_of(name: str) -> Node:
    below = None
    for state in name:
        below = node(int(state), below)
    return below


def _better(tops: dict[Node, Value], stack: Node | None, cost: int, audit: str) -> bool:
    """Merge a fork into equal tops; whether it is the better one."""
    if stack is None or ((old := tops.get(stack)) is not None and old <= (cost, audit)):
        return False
    tops[stack] = (cost, audit)
    return True


def _insert(tops: dict[Node, Value]) -> dict[Node, Value]:
    """``tops`` with all turns that may be inserted here."""
    tops, todo = dict(tops), list(tops)
    while todo:
        stack = todo.pop()
        cost, audit = tops[stack]
        for role in "ua":
            if _better(tops, to := push(stack, role), cost + INSERT, audit + "I"):
                todo.append(to)
    return tops


def _read(tops: dict[Node, Value], letter: str) -> dict[Node, Value]:
    """All stacks after a turn: ``d`` must go, capitals are truncated, ``x`` is a role the grammar lacks."""
    new: dict[Node, Value] = {}
    extra, role = TRUNCATED * letter.isupper(), letter.lower()
    for stack, (cost, audit) in _insert(tops).items():
        _better(new, stack, cost + DELETE, audit + "D")
        if letter == "d":
            continue
        _better(new, push(stack, role), cost + KEEP + extra, audit + "K")
        for other in "ua":
            _better(new, push(stack, other), cost + REROLE + extra, audit + "R")
    return new


def _end(tops: dict[Node, Value]) -> Value:
    return min(value for stack, value in _insert(tops).items() if stack.state in ENDS)


@lru_cache(1 << 16)
def repair(letters: str) -> Value:
    """The cheapest edits of a whole conversation, ties the least in ASCII: (cost, audit)."""
    tops = {node(0, None): (0, "")}
    for letter in letters:
        tops = _read(tops, letter)
    return _end(tops)


def _stacks() -> list[str]:
    """All stacks the grammar can have."""
    found, todo = [], [node(0, None)]
    while todo:
        stack = todo.pop()
        found.append(name_of(stack))
        todo += [to for role in "sua" if (to := push(stack, role)) and name_of(to) not in found and to not in todo]
    return sorted(set(found))


STACKS = _stacks()


def run_table(letters: str) -> list[tuple[str, str, int, str]]:
    """(stack before, stack after, cost, audit) of a run of turns, the best for each pair."""
    out = []
    for name in STACKS:
        tops = {stack_of(name): (0, "")}
        for letter in letters:
            tops = _read(tops, letter)
        out += [(name, name_of(stack), *value) for stack, value in tops.items()]
    return out


def join_tables(tables: Iterable[list]) -> list[tuple[str, str, int, str]]:
    """One table for consecutive runs."""
    now = {(s, s): (0, "") for s in STACKS}
    for table in tables:
        by: dict[str, list] = {}
        for before, after, cost, audit in table:
            by.setdefault(before, []).append((after, cost, audit))
        new: dict[tuple[str, str], Value] = {}
        for (start, middle), (cost, audit) in now.items():
            for after, more, edits in by.get(middle, ()):
                value = (cost + more, audit + edits)
                if (start, after) not in new or value < new[start, after]:
                    new[start, after] = value
        now = new
    return [(a, b, *value) for (a, b), value in now.items()]


def choose(tables: list[list], start: str, end: str) -> list[tuple[str, str]]:
    """(stack before, stack after) of each of the runs on the best way from ``start`` to ``end``."""
    best: dict[str, tuple[int, str, tuple]] = {start: (0, "", ())}
    for table in tables:
        new: dict[str, tuple[int, str, tuple]] = {}
        for before, after, cost, audit in table:
            if before in best:
                c, a, way = best[before]
                value = (c + cost, a + audit)
                if after not in new or value < new[after][:2]:
                    new[after] = (*value, (way, (before, after)))
        best = new
    way, out = best[end][2], []
    while way:
        way, step = way
        out.append(step)
    return out[::-1]


def steps(audit: str, last: str, letters: str) -> list[tuple[str, str | None, int]]:
    """Each edit with the role it gives (None: the row's own) and the row it reads (-1: none).

    ``last`` is the role before, as its initial; the roles of kept rows are in ``letters``.
    """
    out, row = [], 0
    for edit in audit:
        role = None
        if edit in "RI":
            last = "a" if last == "u" else "u"
            role = FULL[last]
        elif edit == "K":
            last = letters[row].lower()
        out.append((edit, role, -1 if edit == "I" else row))
        row += edit != "I"
    return out


# -- rows ------------------------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20; null values count as one space.

    0 drops the row (``gone``: a conversation stays known without rows), 1 empties its text, 2 removes ``.!?``,
    3 repeats the row, 4 sets the role to ``user``.
    """
    filled = narrow(rows, *ROW).select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ROW[:2])).cast("binary")) % 20).alias("fault"),
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(1), F.when(fault == 3, 2).otherwise(1))
    return filled.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fault == 0).alias("gone"), F.explode(copies).alias("copy")
    ).drop("copy")


def _same() -> Column:
    """Equal for turns of equal role and text."""
    return F.sha2(F.concat_ws("\0", "role", "text").cast("binary"), 256)


def _blank(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS)) == ""


def _cut(text: Column) -> Column:
    return ~F.right(F.btrim(text, F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")


def _letter(role: Column, goes: Column, cut: Column) -> Column:
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(goes, "d").when(cut, F.upper(known)).otherwise(known)


def _illegal(roles: Column) -> Column:
    """Pairs of adjacent roles, by their initials, that are not su, ua or au."""
    first = F.slice(roles, 1, F.greatest(F.size(roles) - 1, F.lit(0)))
    pairs = F.zip_with(first, F.slice(roles, 2, F.greatest(F.size(roles), F.lit(1))), lambda a, b: F.concat(F.substring(a, 1, 1), F.substring(b, 1, 1)))
    return F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))).cast("long")


def _on(fn, kind: str):
    """A vectorised function as a Spark function; made where it is used, since a type needs a session."""
    return F.pandas_udf(fn, kind)


_STEPS = "array<struct<edit string, role string, row int>>"


def _named(edits: list[tuple]) -> list[dict]:
    return [dict(zip(("edit", "role", "row"), e, strict=True)) for e in edits]


def _planned(letters: pd.Series) -> pd.DataFrame:
    found = [repair(x) for x in letters]
    edits = [_named(steps(audit, "", x)) for (_, audit), x in zip(found, letters, strict=True)]
    return pd.DataFrame({"cost": [c for c, _ in found], "audit": [a for _, a in found], "steps": edits})


@dataclass
class Repaired:
    """``summary``: one row per conversation. ``turns``: the repaired turns, ``place`` giving their order."""

    summary: DataFrame
    turns: DataFrame


SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _ordinary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    turn = F.when(~F.col("gone"), F.struct("turn", "role", _same().alias("same"), "text"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    marked = one.withColumn("same", F.transform("rows", lambda r: r["same"])).withColumn(
        "rows",
        F.transform(
            "rows",
            lambda r, i: F.struct(
                r["turn"].alias("turn"),
                r["role"].alias("role"),
                r["text"].alias("text"),
                _blank(r["text"]).alias("blank"),
                (F.array_position("same", r["same"]) <= i).alias("again"),
                _cut(r["text"]).alias("cut"),
            ),
        ),
    )
    letters = F.array_join(F.transform("rows", lambda r: _letter(r["role"], r["blank"] | r["again"], r["cut"])), "")
    planned = stage(marked.drop("same").withColumn("plan", _on(_planned, f"cost long, audit string, steps {_STEPS}")(letters)), "conversations")
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())

    def count(fault):
        return F.size(F.filter("rows", fault)).cast("long")

    kept = F.transform(
        F.filter("plan.steps", lambda s: s["edit"] != "D"),
        lambda s: F.struct(
            s["edit"].alias("edit"),
            F.coalesce(s["role"], F.get("rows", s["row"])["role"]).alias("role"),
            F.coalesce(F.get("rows", s["row"])["text"], F.lit("")).alias("text"),
        ),
    )
    done = planned.withColumn("kept", kept)
    lines = F.transform("kept", lambda k: F.concat(k["role"], F.lit(":"), k["text"]))
    summary = done.select(
        "conv_id",
        F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long").alias("gaps"),
        count(lambda r: r["blank"]).alias("blank"),
        count(lambda r: ~r["blank"] & r["again"]).alias("duplicate"),
        count(lambda r: ~r["blank"] & ~r["again"] & r["cut"]).alias("truncated"),
        _illegal(F.transform("rows", lambda r: r["role"])).alias("illegal"),
        F.col("plan.cost").alias("cost"),
        F.col("plan.audit").alias("audit"),
        F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"),
    )
    repaired = done.select("conv_id", F.posexplode("kept").alias("n", "k")).select("conv_id", F.array(F.lit(0).cast("long"), F.col("n").cast("long")).alias("place"), "k.*")
    return summary, repaired


#: The table of a run as JSON text.
_TABLE = "array<struct<before string, after string, cost long, audit string>>"


def _packed(table: list[tuple]) -> str:
    return dumps([dict(zip(("before", "after", "cost", "audit"), r, strict=True)) for r in table])


def _unpacked(table: str) -> list[tuple]:
    return [(r["before"], r["after"], r["cost"], r["audit"]) for r in loads(table)]


def _run_tables(letters: pd.Series) -> pd.Series:
    return pd.Series([_packed(run_table(x)) for x in letters], dtype=object)


def _joined(tables: pd.Series) -> pd.Series:
    return pd.Series([_packed(join_tables(map(_unpacked, several))) for several in tables], dtype=object)


def _best_end(table: pd.Series) -> pd.DataFrame:
    """The best way through a whole conversation, with the turns inserted at its end."""
    out = []
    for t in table:
        ways = [(after, *_end({stack_of(after): (cost, audit)})) for before, after, cost, audit in _unpacked(t) if before == "0"]
        out.append(("0", *min(ways, key=lambda w: w[1:])))
    return pd.DataFrame(out, columns=["before", "after", "cost", "audit"])


def _chosen(tables: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    ways = (choose([_unpacked(t) for t in several], start, end) for several, start, end in zip(tables, before, after, strict=True))
    return pd.Series([[{"before": b, "after": a} for b, a in way] for way in ways], dtype=object)


def _run_steps(letters: pd.Series, before: pd.Series, audit: pd.Series) -> pd.Series:
    return pd.Series([_named(steps(edits, LAST[int(b[-1])], x)) for x, b, edits in zip(letters, before, audit, strict=True)])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's lines, which come in order; nothing but the hash is held."""
    key, state = None, None
    for b in batches:
        for conv, line in zip(b["conv_key"], b["line"], strict=True):
            if conv != key:
                if key is not None:
                    yield pd.DataFrame({"conv_key": [key], "repaired_sha256": [state.hexdigest()]})
                key, state = conv, sha256()
            else:
                state.update(b"\n")
            state.update(line.encode())
    if key is not None:
        yield pd.DataFrame({"conv_key": [key], "repaired_sha256": [state.hexdigest()]})


def _last_role(name: Column) -> Column:
    """``u`` if the last turn of a stack is a user's, by its name; else a user's is next."""
    return F.when(F.right(name, F.lit(1)).isin("4", "5"), "u").otherwise("a")


def _long(rows: DataFrame, run: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Conversations of any length: no task holds more than ``run`` turns or ``fan`` tables of one."""
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))
    rows = rows.where(~F.col("gone")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows.withColumns({"conv_key": key, "same": _same()}), "long-rows")
    first = rows.groupBy("conv_key", "same").agg(F.min(F.struct("turn")).alias("first"))
    faults = rows.join(first, ["conv_key", "same"]).select(
        "conv_id", "conv_key", "turn", "role", "text", "same", _blank(F.col("text")).alias("blank"), _cut(F.col("text")).alias("cut"),
        (~F.struct("turn").eqNullSafe(F.col("first"))).alias("later"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"),
    )
    # Ranges of (conversation, turn, role, digest), so one conversation is spread over as many tasks as it fills.
    order = ("conv_key", "turn", "role", "same", "copy")
    dealt = faults.repartitionByRange(max(2, shuffle_width(spark)), *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    placed = stage(dealt.withColumn("again", F.col("later") | (F.col("copy") > 1)).withColumn("at", number).withColumn("run", F.floor(F.col("at") / run)), "long-turns")
    letter = _letter(F.col("role"), F.col("blank") | F.col("again"), F.col("cut"))
    listed = F.sort_array(F.collect_list(F.struct("at", letter.alias("letter"), "role")))
    runs = placed.groupBy("conv_key", "run").agg(listed.alias("turns"))
    runs = runs.select("conv_key", "run", F.array_join(F.transform("turns", lambda t: t["letter"]), "").alias("letters"), F.transform("turns", lambda t: t["role"]).alias("roles"))
    runs = stage(runs, "long-runs")
    # The place of a run among those of its conversation, from its number and its outer roles alone.
    order = W.partitionBy("conv_key").orderBy("run")
    between = F.array(F.lag("last").over(order), F.col("first"))
    places = runs.select("conv_key", "run", F.element_at("roles", 1).alias("first"), F.element_at("roles", -1).alias("last"))
    places = places.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).withColumn("between", between)
    inner = runs.select("conv_key", "run", "letters", _illegal(F.col("roles")).alias("illegal"))
    runs = inner.join(places, ["conv_key", "run"]).withColumn("illegal", F.col("illegal") + _illegal(F.col("between")))
    runs = stage(runs.select("conv_key", "run", "rank", "letters", "illegal"), "long-places")
    # Up the tree: tables of FAN consecutive runs become one.
    levels = [stage(runs.select("conv_key", "rank", _on(_run_tables, "string")("letters").alias("table")), "long-tables")]
    while (levels[-1].agg(F.max("rank")).first()[0] or 0) > 0:
        group = levels[-1].groupBy("conv_key", F.floor(F.col("rank") / fan).alias("rank"))
        several = group.agg(F.sort_array(F.collect_list(F.struct("rank", "table"))).alias("several"))
        tables = F.transform("several", lambda s: s["table"])
        levels.append(stage(several.select("conv_key", "rank", _on(_joined, "string")(tables).alias("table")), "long-tables"))
    whole = stage(levels[-1].select("conv_key", _on(_best_end, "before string, after string, cost long, audit string")("table").alias("best")), "long-best")
    # Down the tree: each run learns the stacks before and after it.
    way = whole.select("conv_key", F.lit(0).cast("long").alias("rank"), "best.before", "best.after")
    for level in reversed(levels[:-1]):
        group = level.groupBy("conv_key", F.floor(F.col("rank") / fan).alias("rank"))
        several = group.agg(F.sort_array(F.collect_list(F.struct("rank", "table"))).alias("several"))
        found = several.join(way, ["conv_key", "rank"]).select(
            "conv_key", "several", _on(_chosen, "array<struct<before string, after string>>")(F.transform("several", lambda s: s["table"]), "before", "after").alias("way")
        )
        both = found.select("conv_key", F.explode(F.arrays_zip(F.transform("several", lambda s: s["rank"]).alias("rank"), F.col("way").alias("way"))).alias("x"))
        way = stage(both.select("conv_key", F.col("x.rank").alias("rank"), "x.way.before", "x.way.after"), "long-ways")
    edits = levels[0].join(way, ["conv_key", "rank"]).select(
        "conv_key", "rank", "before",
        F.element_at(F.filter(F.from_json("table", _TABLE), lambda t: (t["before"] == F.col("before")) & (t["after"] == F.col("after"))), 1)["audit"].alias("audit"),
    )
    edits = edits.join(runs.select("conv_key", "rank", "run", "letters"), ["conv_key", "rank"])
    each = edits.select("conv_key", "run", F.posexplode(_on(_run_steps, _STEPS)("letters", "before", "audit")).alias("n", "s")).where("s.edit <> 'D'")
    start = placed.groupBy("conv_key", "run").agg(F.min("at").alias("start"))
    each = each.join(start, ["conv_key", "run"]).select(
        "conv_key", "run", "n", F.col("s.edit").alias("edit"), F.col("s.role").alias("given"), F.when(F.col("s.row") >= 0, F.col("start") + F.col("s.row")).alias("at")
    )
    texts = placed.select("conv_key", "at", "role", "text")
    turns = each.join(texts, ["conv_key", "at"], "left").select(
        "conv_key", F.array(F.col("run"), F.col("n").cast("long")).alias("place"), "edit", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Turns inserted at the very end belong to no run.
    last = edits.groupBy("conv_key").agg(F.sum(F.length("audit")).alias("n"), F.max("run").alias("run"))
    tail = whole.join(last, "conv_key").select(
        "conv_key", F.col("run"), _last_role(F.col("best.after")).alias("role"), (F.length("best.audit") - F.col("n")).cast("int").alias("more")
    ).where("more > 0")
    tail = tail.select("conv_key", "run", "role", F.explode(F.sequence(F.lit(1), F.col("more"))).alias("n")).select(
        "conv_key",
        F.array(F.col("run") + 1, F.col("n").cast("long")).alias("place"),
        F.lit("I").alias("edit"),
        F.when((F.col("role") == "u") == (F.col("n") % 2 == 1), "assistant").otherwise("user").alias("role"),
        F.lit("").alias("text"),
    )
    turns = stage(turns.unionByName(tail), "long-repaired")
    streamed = turns.select("conv_key", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_key").sortWithinPartitions("conv_key", "place")
    digest = streamed.select("conv_key", "line").mapInPandas(_digests, "conv_key string, repaired_sha256 string")
    span = placed.groupBy("conv_key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"),
        F.count_if("blank").alias("blank"),
        F.count_if(~F.col("blank") & F.col("again")).alias("duplicate"),
        F.count_if(~F.col("blank") & ~F.col("again") & F.col("cut")).alias("truncated"),
    )
    distinct = placed.where("turn IS NOT NULL").select("conv_key", "turn").distinct().groupBy("conv_key").agg(F.count(F.lit(1)).alias("distinct"))
    illegal = runs.groupBy("conv_key").agg(F.sum("illegal").alias("illegal"))
    summary = span.join(illegal, "conv_key").join(whole, "conv_key").join(distinct, "conv_key", "left").join(digest, "conv_key", "left").select(
        "conv_id",
        F.when(F.col("distinct").isNull(), 0).otherwise(F.col("span") - F.col("distinct")).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal",
        F.col("best.cost").alias("cost"),
        F.col("best.audit").alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
    names = span.select("conv_key", "conv_id")
    return summary, turns.join(names, "conv_key").select("conv_id", "place", "edit", "role", "text")


def repair_conversations(rows: DataFrame, *, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, run: int = RUN, fan: int = FAN) -> Repaired:
    """Faults, cheapest repair and repaired turns of every conversation.

    ``rows`` are those of :func:`damage` (or any with ``conv_id, turn, role, text`` and a ``gone`` flag). Rows are read by
    turn, nulls first, ties by role and a digest of the text, so repeated rows are adjacent. A turn's first fault counts: blank, then
    duplicate (role and text seen earlier), then truncated. Blank and duplicate turns must go. A role whose initial is
    not s, u or a (an empty one too) cannot stay as it is. A null ``conv_id`` is a conversation like any other;
    conversations without rows get zeros and an empty audit. Very long ones are cut into runs.
    """
    rows = stage(rows.select(*ROW, "gone"), "damaged")
    sizes = rows.groupBy("conv_id").agg(F.count_if(~F.col("gone")).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long_ids = stage(sizes.where((F.col("n") > most_rows) | ((F.col("bytes") > most_bytes) & (F.col("n") > 0))).select(F.col("conv_id").alias("long_id")), "long-ids")
    if long_ids.isEmpty():
        return Repaired(*_ordinary(rows))
    match = F.col("conv_id").eqNullSafe(F.col("long_id"))
    few, more = _ordinary(rows.join(long_ids, match, "left_anti")), _long(rows.join(long_ids, match, "left_semi"), run, fan)
    return Repaired(few[0].unionByName(more[0]), few[1].unionByName(more[1]))
