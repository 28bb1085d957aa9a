"""Hard negatives, sharding and conversation repair against brute force and on odd inputs."""

from __future__ import annotations

import heapq
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from movekit import session
from movekit.llm import conversations, hard_negatives, sharding
from movekit.llm.conversations import damage, repair_conversations
from movekit.llm.queries import op12_sharding, op13_conversation_repair
from movekit.llm.sharding import shard_documents, write_shards

# 11 hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, row string, id string, q string, norm string"


def brute_negatives(rows):
    sound = [(i, [int(np.floor(256 * x)) for x in e], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, e, lab in rows if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda s, i: (-s, i is None, i or 0)
    out = []
    for k, (i, a, lab) in enumerate(sound):
        if i is None or i % 50:
            continue
        scored = [(dot(a, b), j, other) for m, (j, b, other) in enumerate(sound) if m != k]
        for p, pos in sorted(((s, j) for s, j, other in scored if other == lab), key=lambda x: key(*x))[:5]:
            fit = sorted(((s, j) for s, j, other in scored if other != lab and 50 * p <= 100 * s <= 95 * p), key=lambda x: key(*x))[:3]
            out += [(i, pos, r, j, p, s) for r, (s, j) in enumerate(fit, 1)]
    return Counter(out)


def vector_rows(n, width, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, width))
    rows = [(int(i), [float(x) for x in centre[i % 4] * (i % 3) + rng.normal(size=width) * 0.3], int(i % 4)) for i in range(n)]
    rows[5:8] = [(5, None, 1), (6, [float("nan")] * width, 1), (None, rows[7][1], 3)]
    rows[20:23] = [(20, [None] + rows[20][1][1:], 0), (21, rows[21][1], None), (22, [float("inf")] * width, 2)]
    rows += [(50, rows[50][1], 2), (50, rows[50][1], 2), (None, rows[50][1], 1), (1000, [], 1), (1001, [0.5], 0), (1050, [0.0] * width, 2), (-50, rows[0][1], 0), (-49, rows[1][1], 9)]
    rows += [(200 + i, rows[100][1], i % 2) for i in range(60)]  # ties
    return rows


@pytest.mark.parametrize("per_pass", [3, 1000])
def test_negatives_equal_brute_force(spark, per_pass):
    rows = vector_rows(180, 6)
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)
    assert Counter(map(tuple, hard_negatives.hard_negatives(df, per_pass=per_pass).collect())) == brute_negatives(rows)


def test_rows_of_the_own_label_hide_no_negative(spark):
    """Many rows of the anchor's label surely lie in the window, above the few negatives that do."""
    rng = np.random.default_rng(8)
    axis = np.zeros(8)
    axis[0] = 1.0
    tilted = axis * 0.6 + np.eye(8)[1] * 0.8
    rows = [(1 + i + (1 + i) // 6, (axis * 4 + rng.normal(size=8) * 0.001).tolist(), 0) for i in range(6)]
    rows += [(50, (axis * 4).tolist(), 0)] + [(401 + 7 * i, (axis * 2.8 + rng.normal(size=8) * 0.001).tolist(), 0) for i in range(60)]
    rows += [(1002 + 7 * i, (tilted * 4 + rng.normal(size=8) * 0.001).tolist(), 1) for i in range(9)]
    got = hard_negatives.hard_negatives(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS))
    found = Counter(map(tuple, got.collect()))
    assert found == brute_negatives(rows) and len(found) >= 15


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(none).count() == 0
    blank = spark.createDataFrame([(0, [], 1, *"xxxx"), (50, [], 1, *"xxxx"), (1, [], 2, *"xxxx")], VECTORS)
    assert hard_negatives.hard_negatives(blank).count() == 0


def test_bounds_hold_and_skip_pairs():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(3, 16))
    q = np.floor(256 * np.concatenate([c + rng.normal(size=(40, 16)) * 0.05 for c in centre] + [np.zeros((1, 16)), centre[:1] * 1e5]))
    pilot = hard_negatives.pd.DataFrame({"q": list(q[:120]), "label": [i // 40 for i in range(120)]})
    norms = np.linalg.norm(q, axis=1)
    angles = hard_negatives._angles(q, norms, hard_negatives.reference_directions(pilot, 16))
    least, most = hard_negatives.bounds(norms, angles, norms, angles)
    scores = q @ q.T
    assert (least <= scores).all() and (scores <= most).all()
    top = np.sort(scores[0])[-5]
    assert (most[0] >= top).mean() < 0.6  # other clusters are left out by their angles alone


def test_bounds_hold_for_groups_of_rows():
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(3, 16))
    q = np.floor(256 * np.concatenate([c * (1 + i) + rng.normal(size=(40, 16)) * 0.05 for i, c in enumerate([*centre, -centre[0]])]))
    pilot = hard_negatives.pd.DataFrame({"q": list(q), "label": [i // 40 for i in range(160)]})
    norms = np.linalg.norm(q, axis=1)
    angles = hard_negatives._angles(q, norms, hard_negatives.reference_directions(pilot, 16))
    groups = [slice(0, 40), slice(40, 80), slice(80, 120), slice(120, 160), slice(30, 90), slice(7, 8)]
    first, last = ([(f(norms[g]), f(angles[g], axis=0)) for g in groups] for f in (np.min, np.max))
    ranges = [np.array(x) for x in (*zip(*first, strict=True), *zip(*last, strict=True))]
    least, most = hard_negatives.bounds(norms, angles, *ranges)
    for k, g in enumerate(groups):
        scores = q @ q[g].T
        assert (least[:, k] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, k]).all()
    assert (most[0] < np.sort(q @ q[0])[-5]).sum() >= 3  # whole groups are left out


def test_search_scores_few_pairs_of_random_vectors(monkeypatch):
    """Angles tell random vectors little; products in single precision leave only pairs near the floors to be scored."""
    rng = np.random.default_rng(11)
    n, width, anchors = 6000, 24, 80
    q = np.floor(256 * rng.normal(size=(n, width)))
    q[3000:3400] = q[5]
    norms, ids, labels = np.linalg.norm(q, axis=1), rng.permutation(n), rng.integers(0, 4, n)
    references = hard_negatives.reference_directions(hard_negatives.pd.DataFrame({"q": list(q[:500]), "label": labels[:500]}), width)
    rows = hard_negatives.pd.DataFrame({"row": np.arange(n), "id": ids, "named": True, "label": labels, "norm": norms})
    rows["q"] = [x.tobytes() for x in q.astype(np.int32)]
    rows["angles"] = [x.tobytes() for x in hard_negatives._angles(q, norms, references)]
    slab = hard_negatives.Slab(rows[:anchors], width)
    scores = (q[:anchors] @ q.T).astype(np.int64)
    top = np.sort(scores, axis=1)[:, ::-1][:, 1:6]
    low, high = top // 2, top * 95 // 100
    low[3], high[3] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    low[7, 2], high[7, 2] = -900, -1000
    scored, exact = [], hard_negatives.exact_scores
    monkeypatch.setattr(hard_negatives, "exact_scores", lambda a, b, i, j, safe: scored.append(len(i)) or exact(a, b, i, j, safe))
    for same, k, lo, hi in [(False, 3, low, high), (True, 5, np.full((anchors, 1), -(2**62)), np.full((anchors, 1), 2**62))]:
        found = next(hard_negatives._search(slab, lo, hi, k, same, float(norms.max()) ** 2)(rows[s : s + 2000] for s in range(0, n, 2000)))
        want = Counter()
        for a in range(anchors):
            own = (labels == labels[a]) & (np.arange(n) != a) if same else labels != labels[a]
            for w in range(lo.shape[1]):
                fit = [r for r in np.flatnonzero(own & (scores[a] >= lo[a, w]) & (scores[a] <= hi[a, w])) if same or lo[a, w] <= hi[a, w]]
                want.update((a, w, scores[a, r], ids[r], r) for r in sorted(fit, key=lambda r: (-scores[a, r], ids[r]))[:k])
        assert Counter(found[["anchor", "slot", "score", "id", "row"]].itertuples(index=False, name=None)) == want
    assert sum(scored) < 0.2 * n * anchors


def test_long_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=5) * 2.0**20).tolist(), int(i % 3)) for i in range(150)]
    rows += [(200 + i, [x + i % 3 / 256 for x in rows[100][1]], i % 2) for i in range(30)]  # scores that single precision cannot tell apart
    got = hard_negatives.hard_negatives(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS))
    found = Counter(map(tuple, got.collect()))
    assert found == brute_negatives(rows) and found


def test_long_vectors_are_scored_in_whole_numbers():
    a = np.array([[2**30 + 1, 2**30 - 1]], np.int32)
    got = hard_negatives.exact_scores(a, a, np.array([0]), np.array([0]), safe=False)
    assert got[0] == (2**30 + 1) ** 2 + (2**30 - 1) ** 2


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e9], 1, *"xxxx")], VECTORS)).count()


# 12 sharding


def check_shards(rows, texts, n_shards=16):
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t in texts)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    sizes = [sum(r["size"] for r in by[s]) for s in range(n_shards)]
    assert set(by) <= set(range(n_shards))
    largest, part = max((r["size"] for r in rows), default=0), sum(sizes) / n_shards
    assert all(abs(x - part) <= largest + 0.002 * part for x in sizes)
    return by


def test_shards_hold_all_rows_evenly(spark, documents, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows = op12_sharding(spark, sf_dir).collect()
    check_shards(rows, texts)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in texts}
    assert all(r["text_crc32"] == crc[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    again = op12_sharding(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in rows) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_shards_of_odd_rows(odd, none):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_shards(shard_documents(odd).collect(), texts)
    assert shard_documents(none).count() == 0
    one = odd.where("doc_id = 6")
    assert [(r["shard"] in range(16), r["slot"]) for r in shard_documents(one).collect()] == [(True, 0)]


def test_hot_and_repeated_rows_are_spread(spark):
    texts = [(i, "the same text in a third of all rows") for i in range(1500)] + [(None, "no id")] * 1500 + [(i, f"text {i} " * (i % 7)) for i in range(1500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    by = check_shards(shard_documents(df, part_bytes=2000).collect(), texts)
    small = [t for t, n in Counter(t for _, t in texts).items() if n < 5]
    split = sum(len({s for s, rs in by.items() for r in rs if r["text"] == t}) > 1 for t in small[:50])
    assert split == 0
    assert len({s for s, rs in by.items() for r in rs if r["text"] == "no id"}) >= 3


def test_rows_of_files_are_numbered_by_their_place(spark, tmp_path):
    """Repeated rows of several files: read twice, each row keeps its number, and no text is written before the exchange."""
    texts = [(i, "the same text in a third of all rows") for i in range(1500)] + [(None, "no id")] * 1500 + [(i, f"text {i} " * (i % 7)) for i in range(1500)] + [(7, None)] * 9
    spark.createDataFrame(texts, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "docs"))
    before = len(session.STAGED)
    sharded = shard_documents(spark.read.parquet(str(tmp_path / "docs")), part_bytes=2000, number=sharding.file_row())
    by = check_shards(sharded.collect(), texts)
    assert Counter((r["doc_id"], r["text"]) for rs in by.values() for r in rs) == Counter(texts)
    assert len({s for s, rs in by.items() for r in rs if r["text"] == "no id"}) >= 3
    assert {c for path in session.STAGED[before:] for c in spark.read.parquet(path).columns} == {"k1", "k2", "k3", "size"}


def test_the_query_writes_no_texts_and_exchanges_them_once(spark, sf_dir):
    before = len(session.STAGED)
    plan = op12_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert {c for path in session.STAGED[before:] for c in spark.read.parquet(path).columns} == {"k1", "k2", "k3", "size"}
    assert plan.count("Exchange hashpartitioning") == 1 and "ArrowEvalPython" not in plan


def test_ranges_hold_every_key_once(spark):
    rng = random.Random(9)
    keys = [(rng.choice([5, -5, 2**62, rng.randrange(-(2**63), 2**63)]), rng.randrange(3), i) for i in range(400)]
    keys += [(-(2**63),) * 3, (2**63 - 1,) * 3]
    packed = sharding._packed(*(sharding.pd.Series([k[i] for k in keys]) for i in range(3)))
    bounds = np.unique(np.concatenate((packed[::9], np.array([b"\0" * 24, b"\xff" * 24], "S24"))))
    at = np.arange(len(bounds) + 1)
    ranges = sharding._ranges(spark, bounds, at, at)
    rows = spark.createDataFrame(keys, "k1 long, k2 long, k3 long")
    got = sharding.in_ranges(rows, ranges).select("k1", "k2", "k3", "range").collect()
    want = np.searchsorted(bounds, packed, side="right")
    assert Counter(map(tuple, got)) == Counter((*k, int(r)) for k, r in zip(keys, want, strict=True))


def test_small_groups_of_equal_texts_stay_together(spark):
    texts = [(i, f"text number {i // 5}") for i in range(4000)]
    by = check_shards(shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)
    where = defaultdict(set)
    for s, rs in by.items():
        for r in rs:
            where[r["text"]].add(s)
    assert sum(len(x) > 1 for x in where.values()) <= 15


def test_probes_close_in_on_hot_keys():
    rng = random.Random(4)
    keys = sorted([(5, rng.randrange(2**40), i) for i in range(600)] + [(9, 1, i) for i in range(600)] + [(rng.randrange(-(2**62), 2**62), 0, i) for i in range(300)])
    packed = sharding._packed(*(sharding.pd.Series([k[i] for k in keys]) for i in range(3)))
    assert list(packed) == sorted(packed)
    least, most = packed[0].ljust(24, b"\0"), packed[-1].ljust(24, b"\0")
    probes = sharding._between(least, most, 16)
    assert len(probes) == 16 and all(least < p <= most and p[8:] == bytes(16) for p in probes)
    inside = sharding._between(packed[keys.index((9, 1, 0))].ljust(24, b"\0"), packed[keys.index((9, 1, 599))].ljust(24, b"\0"), 700)
    assert len(inside) == 599 and len(set(inside)) == 599


def test_shards_are_written_as_folders(spark, documents, tmp_path):
    sharded = shard_documents(documents, n_shards=4)
    write_shards(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"shard={i}" for i in range(4)}
    assert back.count() == documents.count() and back.select(F.sum("size")).first()[0] == sharded.select(F.sum("size")).first()[0]


# 13 conversations

BLANK = "\t\n\x0b\x0c\r "


def brute_damage(rows):
    out, convs = [], {c for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return convs, out


def brute_repair(turns):
    """Shortest path over (rows read, role last given), heap ordered by (cost, audit)."""
    must, cut, seen = [], [], set()
    for _, role, text in turns:
        bare = text.strip(BLANK)
        must.append("blank" if not bare else "duplicate" if (role, text) in seen else None)
        cut.append(bool(bare) and bare[-1] not in ".!?")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, n, last, kept = heapq.heappop(heap)
        if n == len(turns) and last in ("", "a"):
            break
        if (n, last) in done:
            continue
        done.add((n, last))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        give = "a" if last == "u" else "u"
        full = {"u": "user", "a": "assistant"}[give]
        heapq.heappush(heap, (cost + 5, audit + "I", n, give, (*kept, f"{full}:")))
        if n < len(turns):
            _, role, text = turns[n]
            heapq.heappush(heap, (cost + 2, audit + "D", n + 1, last, kept))
            if not must[n]:
                extra = 5 * cut[n]
                if role[:1] and role[0] in follow:
                    heapq.heappush(heap, (cost + extra, audit + "K", n + 1, role[0], (*kept, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", n + 1, give, (*kept, f"{full}:{text}")))
    faults = Counter(must)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    truncated = sum(c and not m for c, m in zip(cut, must, strict=True))
    return gaps, faults["blank"], faults["duplicate"], truncated, illegal, cost, audit, sha256("\n".join(kept).encode()).hexdigest(), list(kept)


def brute_conversations(rows):
    convs, damaged = brute_damage(rows)
    by = {c: [] for c in convs}
    for conv, turn, role, text in damaged:
        by[conv].append((turn, role, text))
    order = lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), sha256(f"{t[1]}\0{t[2]}".encode()).hexdigest())
    return {c: brute_repair(sorted(ts, key=order)) for c, ts in by.items()}


SCHEMA = "conv_id long, turn long, role string, text string, letters string, n string, at string, rows string, gone string"


def odd_conversations(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(0, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "usher", "User"])
            text = rng.choice(["Fine.", "Is it?", "No!", "and so", "", " \n", None, "ü ", f"Text {turn}.", f"more {turn}", " ."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2, turn * 3]), role, text))
    rows += [(900, t, ["user", "assistant"][t % 2], f"word {t} " * 3 + ".") for t in range(90)]
    rows += [(901, 1, "user", "same.")] * 40 + [(902, None, "user", "same.")] * 40
    rows += [(903, t, "assistant", "x " * 40_000) for t in range(2)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"most_rows": 0, "run": 3, "fan": 2}, {"most_rows": 8, "run": 16, "fan": 4}, {"most_bytes": 200, "run": 5}])
def test_conversations_equal_brute_force(spark, limits):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA)
    got = repair_conversations(damage(df), **limits)
    want = brute_conversations(rows)
    found = {r["conv_id"]: tuple(r[c] for c in conversations.SUMMARY[1:]) for r in got.summary.collect()}
    assert len(found) == got.summary.count() == len(want)
    wrong = {c: (found.get(c), w[:8]) for c, w in want.items() if found.get(c) != w[:8]}
    assert not wrong, list(wrong.items())[:2]
    turns = defaultdict(list)
    for r in sorted(got.turns.collect(), key=lambda r: r["place"]):
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(turns[c] == w[8] for c, w in want.items())


def test_conversations_of_nothing(spark):
    assert repair_conversations(damage(spark.createDataFrame([], SCHEMA))).summary.count() == 0


def test_conversation_query_on_all_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r[c] for c in conversations.SUMMARY[1:]) for r in op13_conversation_repair(spark, sf_dir).collect()}
    assert found == {c: w[:8] for c, w in brute_conversations(rows).items()}


def test_tables_of_runs_join_as_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        letters = "".join(rng.choice("suaxSUAXdua") for _ in range(rng.randrange(1, 30)))
        cuts = sorted(rng.randrange(len(letters) + 1) for _ in range(3))
        parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True)]
        joined = conversations.join_tables(map(conversations.run_table, parts))
        ways = [conversations._end({conversations.stack_of(after): (c, a)}) for before, after, c, a in joined if before == "0"]
        assert min(ways) == conversations.repair(letters)
    assert len(conversations.STACKS) == 8
