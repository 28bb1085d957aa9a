"""Every operator against brute force and on odd inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from movekit.llm import minhash, mixing, packing, quality, suffix, toxicity
from movekit.llm.exact import exact_duplicates
from movekit.llm.minhash import near_duplicates
from movekit.llm.mixing import mix
from movekit.llm.ngram_llr import BUCKETS, SCALE, SMOOTHING, THRESHOLD, quality_rules
from movekit.llm.packing import pack_sequences
from movekit.llm.quality import score_quality
from movekit.llm.suffix import repeated_passages
from movekit.llm.token_counts import count_tokens, document_tokens
from movekit.llm.tokens import WordTokenizer, default_path
from movekit.llm.toxicity import score_toxicity
from movekit.llm.urlrules import RULES, apply_rules, rules_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 quality


def test_quality_on_held_out_rows(documents, labels, spark):
    got = {r["doc_id"]: r for r in score_quality(documents, labels).collect()}
    assert len(got) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    right = [r["predicted"] == q for i, q in ((x["doc_id"], x["quality"]) for x in labels.collect()) for r in (got[i],) if r["held_out"]]
    assert sum(right) / len(right) > 0.8


def test_additive_model_learns_an_interaction():
    x = np.random.default_rng(1).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert (0, 1) in {(f, g) for f, g, _ in model.pairs}


def test_quality_on_odd_rows(odd, none, labels):
    got = score_quality(odd, labels).collect()
    assert len(got) == odd.count() and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert score_quality(none, labels).count() == 0
    alone = score_quality(odd, labels.limit(0)).collect()
    assert {round(r["score"], 9) for r in alone} == {0.5}


# 2 rules


def brute_rules(pairs, trusted):
    texts = [(i, words(t), t or "") for i, t in pairs]

    def bucket(a, b):
        h = xxhash.xxh64_intdigest(b, seed=xxhash.xxh64_intdigest(a, seed=42))
        return (h - (1 << 64) if h >= 1 << 63 else h) % BUCKETS

    grams = [[bucket(a.encode(), b.encode()) for a, b in zip(w, w[1:], strict=False)] for _, w, _ in texts]
    raw, target = Counter(), Counter()
    for (i, _, _), g in zip(texts, grams, strict=True):
        raw.update(g)
        if i in trusted:
            target.update(g)
    nr, nt = sum(raw.values()), sum(target.values())
    weight = {
        b: round(SCALE * (math.log((target[b] + SMOOTHING) / (nt + SMOOTHING * BUCKETS)) - math.log((n + SMOOTHING) / (nr + SMOOTHING * BUCKETS))))
        for b, n in raw.items()
    }
    out = []
    for (i, w, t), g in zip(texts, grams, strict=True):
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        cover = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        total = sum(weight[b] for b in g)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed, not failed and total >= THRESHOLD * len(g), total, len(g)))
    return Counter(out)


def test_rules_equal_brute_force(documents, labels, odd, none):
    trusted = labels.where("quality = 1")
    ids = {r["doc_id"] for r in trusted.collect()}
    for df in (documents, odd):
        assert Counter(map(tuple, quality_rules(df, trusted).collect())) == brute_rules(pairs_of(df), ids)
    assert quality_rules(none, trusted).count() == 0
    assert quality_rules(odd, trusted.limit(0)).count() == odd.count()


# 3 near duplicates


def brute_near(pairs, percent=85):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in pairs:
        w = words((t or "").translate(table))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(pairs):
        for b in range(a):
            j = pairs[b][0]
            both = len(sets[a] & sets[b])
            if i is not None and j is not None and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i), find(i) == i) for (i, _), s in zip(pairs, sets, strict=True))


def test_near_duplicates_equal_brute_force(documents, odd, none):
    for df in (documents, odd):
        assert Counter(map(tuple, near_duplicates(df).collect())) == brute_near(pairs_of(df))
    assert near_duplicates(none).count() == 0


def test_near_duplicates_in_a_group_whose_smallest_is_far_from_most(spark):
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(120, 2 if i else 6, replace=False):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, near_duplicates(df).collect())) == brute_near(rows)


def test_texts_that_share_an_id_are_linked(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = lambda w: " ".join(w[:-1] + ["other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (7, "alone " * 3), (7, "alone " * 3), (8, "far away from all")]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 8)}


def test_blocks_of_near_misses_keep_every_link(spark, monkeypatch):
    """A group whose members share table entries and mostly are no links; blocks are small, so every kind of pair occurs."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.choice(400, int(rng.integers(2, 12)), replace=False):
            text[at] = f"x{i}_{at}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 16)
    got = Counter(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_near(rows) and 1 < len({r[2] for r in got}) < 150


def test_overlaps_equal_set_sizes():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 20_000, n).astype(np.uint64)) for n in (1, 5, 9000, 300, 300, 15_000)]
    got = minhash.overlaps(sets[:3], sets[2:])
    assert [[int(x) for x in r] for r in got] == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]


def test_near_duplicates_of_one_repeated_word(spark):
    texts = ["x " * 5, "X " * 6, "x " * 9, "x " * 500, "x " * 4, "x y", "ha " * 7, "ha " * 6, "x x x x x y"]
    rows = [*enumerate(texts, 1), (1, "x " * 7), (None, "x " * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 50):
        assert Counter(map(tuple, near_duplicates(df, percent=percent).collect())) == brute_near(rows, percent)


# 4 packing


def test_packing_round_trip(documents, odd, none):
    own = WordTokenizer(default_path())
    for df in (documents, odd):
        got = pack_sequences(df, capacity=256).collect()
        want = Counter()
        for i, t in pairs_of(df):
            ids = np.array(own.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
            for p, at in enumerate(range(0, len(ids), 256)):
                want[(i, p, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 256
        total = sum(r["length"] for r in got)
        assert len(by) <= 1.05 * math.ceil(total / 256) + 1
    assert pack_sequences(none).count() == 0


def least_bins(items, capacity):
    """The fewest bins, by search."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in {x: n for n, x in enumerate(bins)}.values():
            if bins[b] + items[k] <= capacity:
                bins[b] += items[k]
                go(k + 1, bins)
                bins[b] -= items[k]
        bins.append(items[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_dominance_reduction_keeps_an_optimum():
    rng = np.random.default_rng(3)
    for _ in range(150):
        items = rng.integers(1, 20, rng.integers(1, 9)).tolist()
        stock = packing._Stock(dict(Counter(items)))
        runs, fixed = packing.reduce_dominated(stock, 20, 0)
        rest = [k for k, n in stock.left.items() for _ in range(n)]
        assert sum(r[2] for r in runs) + len(rest) == len(items)
        assert fixed + (least_bins(rest, 20) if rest else 0) == least_bins(items, 20)


# 5 mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, target, capped = 1.5 * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        live = [s for s in order if s not in capped]
        target = {s: 2.0 * sizes[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in live) for s in live}
        over = {s for s in live if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mixing_meets_targets(documents, odd, none):
    for df in (documents, odd):
        source = {}
        sizes = defaultdict(int)
        for r in df.select("doc_id", "source", "text").collect():
            source[r["doc_id"]] = r["source"]
            sizes[r["source"]] += len(words(r["text"]))
        got = mix(df).collect()
        assert len(got) == df.count()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(df).collect()), key=repr)
        want, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
        for r in got:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
            assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
            taken[s] += r["taken"]
            largest[s] = max(largest[s], r["size"])
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert mix(none).count() == 0


def test_blocks_and_tree_keep_mass(spark):
    rows = [(i, "w " * (1 + i % 50), "one" if i % 3 else "two") for i in range(3000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_docs=16, fan_in=4).collect()
    for target in {r["target"] for r in got}:
        taken = sum(r["taken"] for r in got if r["target"] == target)
        assert abs(taken - target) <= 100
    assert len(got) == 3000


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b, p, q = *rng.integers(1, 30, 2).astype(float), *rng.uniform(0.05, 0.95, 2)
        ends = np.array([mixing.pivot(a, p, b, q, c) for c in (np.arange(2000) + 0.5) / 2000])
        assert np.allclose(ends @ [a, b], a * p + b * q)
        assert np.allclose(ends.mean(0), [p, q], atol=2e-3)
        assert (np.isclose(ends, 0) | np.isclose(ends, 1)).any(axis=1).all()


# 6 exact duplicates


def test_exact_duplicates_equal_brute_force(documents, odd, none):
    for df in (documents, odd):
        pairs, groups = pairs_of(df), defaultdict(list)
        for i, t in pairs:
            groups[t or ""].append(i)
        want = Counter()
        for i, t in pairs:
            ids = groups[t or ""]
            keep = max((x for x in ids if x is not None), default=None)
            want[(i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
        for support in (0.002, 0.3):
            assert Counter(map(tuple, exact_duplicates(df, support=support).collect())) == want
    assert exact_duplicates(none).count() == 0


# 7 toxicity


def test_toxicity_on_held_out_rows(spark, labels, documents):
    got = {r["doc_id"]: r for r in score_toxicity(documents, labels).collect()}
    assert len(got) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    clean = [got[x["doc_id"]]["predicted"] for x in labels.where("toxic = 0").collect()]
    assert sum(clean) <= 0.03 * len(clean)


def test_grammar_reads_clauses():
    lexicon = toxicity.Lexicon({"fool": 4.0, "blockh*": 3.0})
    score = lambda t: sum(toxicity.clause_scores(t, lexicon))
    assert score("") == 0 and score("a fine day") == 0 and score("you are kind") == 0
    assert score("you fool") > score("a fool") == 4.0 > score("not a fool") > score("he said: never a fool") > 0
    assert score("i will kill you") == 0 < score("you i will kill")
    assert score("blockheads everywhere") == 3.0
    assert toxicity.clause_scores("you. fool", lexicon) == [4.0]


def test_toxicity_learns_and_takes_odd_rows(spark, odd, none, labels):
    rows = [(i, f"word{i % 7} and more text. {'zounds you' if i % 4 == 0 else 'fine'} here.") for i in range(400)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)
    assert score_toxicity(odd, labels).count() == odd.count()
    assert score_toxicity(none, labels).count() == 0
    assert {r["predicted"] for r in score_toxicity(odd, labels.limit(0)).collect()} == {0}


# 8 token counts


def test_token_counts_equal_the_tokenizer(documents, odd, none):
    own = WordTokenizer(default_path())
    for df in (documents, odd):
        want = Counter((i, len(own.tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs_of(df))
        assert Counter((r["doc_id"], r["n_tokens"]) for r in document_tokens(df).collect()) == want
    assert document_tokens(none).count() == 0


def test_separators_across_blocks(spark, tmp_path, monkeypatch):
    from movekit.llm import token_counts

    monkeypatch.setattr(token_counts, "BLOCK", 4)
    rng = np.random.default_rng(4)
    want = set()
    for f in range(20):
        ids = rng.choice([7, 9], rng.integers(0, 40), p=[0.15, 0.85]).astype("<u2")
        (tmp_path / f"f{f}.bin").write_bytes(ids.tobytes())
        start, turn = 0, 0
        for k, x in enumerate(ids):
            if x == 7:
                want.add((f"f{f}.bin", turn, start, k - start))
                start, turn = k + 1, turn + 1
        if start < len(ids):
            want.add((f"f{f}.bin", turn, start, len(ids) - start))
    got = {(r["file"].rsplit("/")[-1], r["turn"], r["start"], r["n_tokens"]) for r in count_tokens(spark, str(tmp_path), end=7).collect()}
    assert got == want


def test_special_tokens_are_those_of_the_tokenizer_file(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_path())
    texts = ["hello <|endoftext|> world", "<|startoftext|>a<|endoftext|><|endoftext|>", "x<|ENDOFTEXT|>y <|endoftext|>.", "<|endof text|>", "it's <|endoftext|>\x1c!", "plain"]
    want = {i: np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4") for i, t in enumerate(texts)}
    assert want[0].tolist() == [3306, 49407, 1002]
    assert WordTokenizer(default_path()).encode(texts) == [x.tobytes() for x in want.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in pack_sequences(df).collect()}
    assert packed == {i: (len(x) + 1, zlib.crc32(np.append(x, 0).astype("<u4").tobytes())) for i, x in want.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in document_tokens(df).collect()} == {i: len(x) for i, x in want.items()}


# 9 repeated passages


def brute_repeats(pairs, size=50):
    raw, first = [(i, (t or "").encode()) for i, t in pairs], {}
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - size + 1):
                first[b[k : k + size]] = min(i, first.get(b[k : k + size], i))
    out = Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if i is not None and first[b[k : k + size]] < i:
                gone[k : k + size] = True
        edge = np.diff(np.concatenate(([False], gone)).astype(int))
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(rest).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block_bytes", [6 << 20, 20_000])
def test_repeats_equal_brute_force(documents, odd, none, block_bytes):
    for df in (documents, odd):
        got = repeated_passages(df, block_bytes=block_bytes, bucket_bytes=100_000).drop("spans").collect()
        assert Counter(map(tuple, got)) == brute_repeats(pairs_of(df))
    assert repeated_passages(none).count() == 0


def test_repeats_with_hot_names_equal_brute_force(spark, odd):
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz    "))
    text = lambda n: "".join(rng.choice(letters, n))
    footer, short = text(60), text(51)
    rows = [(int(i), text(80) + footer + text(30) + (short if i % 2 else "") + text(int(i) % 25)) for i in rng.permutation(150)]
    rows += [(7, footer * 2), (200, footer), (None, footer), (201, text(10) + footer[5:]), (202, footer[:49])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot_rows, frame, pairs in ((20, df, rows), (1 << 17, df, rows), (0, odd, pairs_of(odd))):
        got = repeated_passages(frame, block_bytes=3000, bucket_bytes=100_000, hot_rows=hot_rows).drop("spans").collect()
        assert Counter(map(tuple, got)) == brute_repeats(pairs)


def test_hot_names_do_not_meet_in_one_range():
    rng = np.random.default_rng(9)
    footer, docs = rng.bytes(60), [(k, rng.bytes(80)) for k in range(60)]
    texts = [t[:40] + footer + t[40:] for _, t in docs]
    blocks = [suffix.Block(np.arange(a, a + 20), np.full(20, 140), b"".join(texts[a : a + 20])) for a in (0, 20, 40)]
    sent = pd.concat([suffix._messages(b, *np.unique(x.sampled(40), return_counts=True), 40, 1) for b, x in enumerate(blocks)])
    for hot_rows, most in ((30, 30), (1000, 60)):
        told = suffix._shared_names(hot_rows)((0,), sent).assign(place=None)
        in_range = Counter()
        for b, x in enumerate(blocks):
            found = suffix.Occurrences(x, told[told["block"] == b], 40, 1)
            for _, own in found.parts(1):
                in_range.update(bytes(r[suffix.ROOM : suffix.ROOM + suffix.NAME]) for r in found.rows[own])
        assert max(in_range.values(), default=0) <= most and (hot_rows == 30 or max(in_range.values()) > 30)


def test_cover_meets_every_pair_of_places():
    for i in range(suffix.PERIOD):
        for j in range(suffix.PERIOD):
            assert any((i + d) % suffix.PERIOD in suffix.COVER and (j + d) % suffix.PERIOD in suffix.COVER for d in range(suffix.PERIOD))


# 10 URL rules


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = []
    for rule, verdict in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(h), len(p), rule, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "nothing", "http://", "http://NET/", "http://a.net", "http://a.net/x?y#z", "http://example.net/en/1", "http://x.Example.net/en", "s://b.org/fr/",
            "s://org/fr/a", "s://notorg/fr/a", "s://example.com/de/", "s://example.com.de/de/", "s://a.b.example.com/de/x://y", "s://..net/", "s://net:80/", "s://x\x01net/", "s://net?q=://example.com/de/"]
    rows = [(k, u, "x", "x", "x") for k, u in enumerate(urls * 3)] + [(None, "http://net/", "x", "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, id string, rule string, host string")
    got = Counter(map(tuple, apply_rules(pages, rules_frame(spark, RULES)).collect()))
    assert got == Counter((i, *brute_rule(u)) for i, u, *_ in rows)
    assert apply_rules(pages.limit(0), rules_frame(spark, RULES)).count() == 0
    assert {r["verdict"] for r in apply_rules(pages, rules_frame(spark, RULES).limit(0)).collect()} == {"allow"}


def test_members_of_a_large_entry_are_repeated_by_the_outside_only(spark, monkeypatch):
    from pyspark.sql import functions as F

    from movekit.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 4)
    left = spark.createDataFrame([(7, v, 0 if v > 1 else 100 + v, 0) for v in range(40)], "key long, v long, component long, largest long")
    classes = spark.createDataFrame([(v, 3, [v], [v]) for v in range(40)], "v long, n long, l array<bigint>, r array<bigint>")
    sets = spark.createDataFrame([(v, [v, 1000, 1001]) for v in range(40)], "v long, s array<bigint>")
    dealt = minhash._in_blocks(left, classes, sets, F.array(F.lit(7).cast("long"))).collect()
    blocks = {}
    for r in dealt:
        blocks.setdefault((r["bx"], r["by"]), []).append((r["side"], r["v"]))
    met = [(x, y) for rows in blocks.values() for s, x in rows if s == 0 for t, y in rows if t == 1]
    assert sorted(met) == [(x, y) for x in (0, 1) for y in range(40)]
    assert len(dealt) == 40 + 2 * 10
