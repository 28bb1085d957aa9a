"""The pipeline's stages, each against what it got."""

from __future__ import annotations

from collections import Counter

import numpy as np

import corpus_pipeline as C
from movekit.llm.mixing import mix
from movekit.llm.quality import score_quality
from test_operators import brute_near, brute_targets, pairs_of, words


def test_stages_follow_their_operators(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    start, good, exact, near, mixed, packed = (Counter(pairs_of(df)) if "text" in df.columns else df.collect() for df in seen)
    rejected = {r["doc_id"] for r in score_quality(docs, labels).where("predicted = 0").collect()}
    assert good == Counter({p: n for p, n in start.items() if p[0] not in rejected})
    last = {t: i for i, t in sorted(good)}
    assert exact == Counter({(i, t): 1 for t, i in last.items()})
    keep = {i for i, _, c, _ in brute_near(list(exact)) if i == c}
    assert near == Counter({p: n for p, n in exact.items() if p[0] in keep})
    copies = {r["doc_id"]: r["copies"] for r in mix(seen[3]).collect()}
    assert mixed == Counter({p: copies[p[0]] for p in near if copies[p[0]]})
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter({i: n for (i, _), n in mixed.items()})


def test_stages_take_odd_rows(spark, odd, none, sf_dir):
    for df in (odd, none):
        for _, stage in C.STAGES:
            out = stage(spark, df, sf_dir)
            assert out.count() >= 0


def test_stages_decide_by_row(spark, odd, tmp_path):
    """Repeated rows, ids with several texts and rows without an id, each stage against brute force."""
    rng = np.random.default_rng(8)
    good = [" ".join(f"word{x}" for x in rng.integers(0, 5000, 60)) + "." for _ in range(320)]
    junk = ["#$ %% || " * int(n) for n in rng.integers(10, 60, 80)]
    rows = [(1000 + i, t, f"s{i % 3}") for i, t in enumerate(good[:200] + junk[:60])]
    marks = [(1000 + i, int(i < 200)) for i in range(260)]
    rows += [(None, t, f"s{i % 3}") for i, t in enumerate(good[200:260] + junk[60:])]
    rows += [(5000, t, "s1") for t in good[260:270] + junk[:3]] + [(6000, good[271], "s2")] * 4 + [(None, good[272], "s2")] * 3 + [(7000, good[272], "s0")]
    rows += [(None, good[273] + " tail", "s0"), (8001, good[273], "s1"), (8000, good[273].upper(), "s1")]
    rows += [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    unique = [(i if i is not None and 1000 <= i < 1260 else 10_000 + k, t) for k, (i, t, _) in enumerate(rows)]
    right = {r["doc_id"]: r["predicted"] for r in score_quality(spark.createDataFrame(unique, "doc_id long, text string"), labels).collect()}

    def frame(some):
        return spark.createDataFrame([(i, t, None, s, None) for i, t, s in some], "doc_id long, text string, lang string, source string, n_chars long")

    def out(stage, some):
        return Counter((r["doc_id"], r["text"], r["source"]) for r in stage(spark, frame(some), str(tmp_path)).collect())

    want = Counter(r for r, (u, _) in zip(rows, unique, strict=True) if right[u])
    assert {bool(right[u]) for (i, _, _), (u, _) in zip(rows, unique, strict=True) if i is None} == {True, False}
    assert out(C.quality_classifier, rows) == want

    last = {}
    for i, t, s in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        last[t or ""] = i
    got = out(C.exact_dedup, rows)
    assert Counter((i, t or "") for i, t, _ in got.elements()) == Counter((i, t) for t, i in last.items())

    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    keep = {k for k, _, c, _ in brute_near([(k, t) for k, (_, t, _) in enumerate(order)]) if k == c}
    got = out(C.near_dedup, rows)
    assert Counter((i, t) for i, t, _ in got.elements()) == Counter((i, t) for k, (i, t, _) in enumerate(order) if k in keep)

    some = [r for r in rows if len(words(r[1])) < 1000]
    sizes, taken = Counter(), Counter()
    for _, t, s in some:
        sizes[s] += len(words(t))
    got = out(C.mix_sources, some)
    for (_, t, s), n in got.items():
        taken[s] += n * len(words(t))
    assert all(n <= 2 * Counter(some)[r] for r, n in got.items())
    assert all(abs(taken[s] - x) <= 180 for s, x in brute_targets(sizes).items())


def test_registered(spark, sf_dir):
    from __spark_entry__ import queries

    names = list(queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names
