"""Repeated passages of bytes, found by a distributed difference-cover suffix order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movekit.llm.common import narrow
from movekit.llm.hashing import U64, mix64
from movekit.session import stage

#: Period of the sample and a perfect difference set for it (fixed values): for any two positions there
#: is exactly one shift below the period that moves both into the sample.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
#: Bytes of a prefix that must be equal, and of the sampled names that decide about it.
PREFIX = 50
NAME = PREFIX - PERIOD + 1  # 30

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


_BASE = 0x9E3779B97F4A7C15
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
#: Columns of a context: the bytes before a name, the name, the bytes behind it, and how many of both there are.
ROOM = PERIOD - 1
WIDTH = NAME + 2 * ROOM


def _power(n: int) -> np.uint64:
    return U64(pow(_BASE, n, 1 << 64))


def names(data: np.ndarray) -> np.ndarray:
    """The name of the ``NAME`` bytes (30) from each position on: a triple of names of 10 bytes.

    Names of 1, 2, 4 and 8 bytes are made in turn from pairs of shorter ones, and 10 bytes are 8 and 2.
    Equal strings have equal names.
    """
    n = len(data) - NAME + 1
    out = np.empty(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, 1 << 19):  # in pieces, as each step makes arrays of eight bytes a byte
            m = min(n - at, 1 << 19)
            one = _VALUE[data[at : at + m + NAME - 1]]
            two = one[:-1] + one[1:] * _power(1)
            four = two[:-2] + two[2:] * _power(2)
            eight = four[:-4] + four[4:] * _power(4)
            ten = eight[: m + 20] + two[8 : m + 28] * _power(8)
            out[at : at + m] = mix64(ten[:m] + ten[10 : 10 + m] * _power(10) + ten[20 : 20 + m] * _power(20))
    return out


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending numbers as their differences, byte plane by byte plane, compressed."""
    step = np.diff(sorted_values, prepend=U64(0))
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _hint(blocks: DataFrame, size: int = 110_000) -> bytes:
    """Some text of the first block, for compressing short pieces of text; no result depends on it."""
    first = blocks.select("text").first()
    return zstandard.ZstdDecompressor().decompress(first["text"])[:size] if first else b""


def _dictionary(hint: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(hint or bytes(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _loose(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


class Block:
    """Some documents, one after the other, and the names of their strings."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, text: bytes):
        self.ids, self.lengths = ids, lengths
        self.data = np.frombuffer(text, np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.name = names(self.data)
        # Sampled positions count from the start of their document; a name must not cross its end.
        at = [s + np.flatnonzero(np.resize(_IN_COVER, e - s - NAME + 1)) for s, e in zip(self.starts, self.ends, strict=True) if e - s >= PREFIX]
        self.sample = np.concatenate(at) if at else np.empty(0, np.int64)

    def sampled(self, bits: int) -> np.ndarray:
        """The leading bits of the sampled names."""
        return self.name[self.sample] >> U64(64 - bits)

    def contexts(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows of ``WIDTH`` bytes around the names at ``at``, 0 beyond the document, and the room on both sides."""
        before = np.minimum(at - self.starts[doc], ROOM)
        behind = np.minimum(self.ends[doc] - at - NAME, ROOM)
        padded = np.concatenate((np.zeros(ROOM, np.uint8), self.data, np.zeros(WIDTH, np.uint8)))
        out = np.empty((len(at), WIDTH + 2), np.uint8)
        out[:, :WIDTH] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
        column = np.arange(WIDTH)
        for part in range(0, len(at), 1 << 15):
            own = slice(part, part + (1 << 15))
            out[own, :WIDTH][(column < ROOM - before[own, None]) | (column >= ROOM + NAME + behind[own, None])] = 0
        out[:, WIDTH], out[:, WIDTH + 1] = before, behind
        return out


def _cuts(values: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """Where the ascending values go over from one bucket to the next; a bucket is a range of names."""
    edges = np.array([(b << bits) // n_buckets for b in range(1, n_buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))


def _messages(block: int, values: np.ndarray, counts: np.ndarray, bits: int, n_buckets: int) -> pd.DataFrame:
    """One packed row per bucket from distinct ascending values and how often each is there."""
    cuts, out = _cuts(values, bits, n_buckets), []
    for b in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[b], cuts[b + 1])
        out.append((int(b), block, pack(values[own]), _squeeze(counts[own].astype(np.uint32)) if (counts[own] > 1).any() else None))
    return pd.DataFrame(out, columns=["bucket", "block", "names", "counts"])


def _within(at: np.ndarray, n: int, after: int) -> np.ndarray:
    """Which of ``n`` places are in ``at`` or at most ``after`` places behind one that is."""
    count = np.zeros(n + 1, np.int32)
    count[at + 1] = 1
    count = np.cumsum(count, dtype=np.int32)
    first = np.maximum(np.arange(n) - after, 0)
    return count[1:] > count[first]


def _distinct(values: np.ndarray) -> np.ndarray:
    v = np.sort(values)
    return v[np.concatenate(([True], v[1:] != v[:-1]))[: len(v)]]


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _answers(values: np.ndarray, replies: pd.DataFrame, bits: int, n_buckets: int, column: str = "bits") -> np.ndarray:
    """The replied bit of each of the distinct ascending values."""
    cuts, out = _cuts(values, bits, n_buckets), np.zeros(len(values), bool)
    for b, blob in zip(replies["bucket"], replies[column], strict=True):
        out[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8))[: cuts[b + 1] - cuts[b]]
    return out


def _gather(block_bytes: int):
    """Documents to blocks of about ``block_bytes``, named by task and turn; a long text is one alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pd.DataFrame:
            lengths = np.array([len(t) for t in texts], np.int64).tobytes()
            text = zstandard.ZstdCompressor(level=6).compress(b"".join(texts))
            return pd.DataFrame({"block": [turn], "ids": [np.array(ids, np.int64).tobytes()], "lengths": [lengths], "text": [text]})

        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                raw = t.encode()
                if ids and size + len(raw) > block_bytes:
                    yield block()
                    turn, ids, texts, size = turn + 1, [], [], 0
                ids.append(i)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield block()

    return run


def _open(row: tuple) -> Block:
    text = zstandard.ZstdDecompressor().decompress(row.text) if len(row.lengths) else b""
    return Block(np.frombuffer(row.ids, np.int64), np.frombuffer(row.lengths, np.int64), text)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One narrow row per document: where it is, its id, length and digest."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            text, at, out = zstandard.ZstdDecompressor().decompress(row.text), 0, []
            for place, (i, n) in enumerate(zip(np.frombuffer(row.ids, np.int64), np.frombuffer(row.lengths, np.int64), strict=True)):
                out.append((row.block, place, i, n, hashlib.sha256(text[at : at + n]).digest()))
                at += n
            yield pd.DataFrame(out, columns=["block", "place", "id", "n_bytes", "sha"])


def _sample_messages(bits: int, n_buckets: int):
    """Sort the sampled names of each block and send each distinct one to the bucket of its range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield _messages(row.block, *np.unique(_open(row).sampled(bits), return_counts=True), bits, n_buckets)

    return run


def _shared_names(hot_rows: int):
    """Which names of each block another block has too, and which occur more than ``hot_rows`` times in all."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in pdf["names"]]
        every = np.concatenate(parts)
        order = np.sort(every)
        twice = _distinct(order[1:][order[1:] == order[:-1]])
        counts = np.concatenate([np.ones(len(p), np.int64) if x is None else _loose(x, np.uint32) for p, x in zip(parts, pdf["counts"], strict=True)])
        # A name above the limit is one that many blocks have or one block has often.
        few = (counts > 1) | _member(every, twice)
        value, of = np.unique(every[few], return_inverse=True)
        hot = value[np.bincount(of, counts[few], len(value)) > hot_rows]
        bits = [np.packbits(_member(p, twice)).tobytes() for p in parts]
        hots = [np.packbits(m).tobytes() if (m := _member(p, hot)).any() else None for p in parts]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "bits": bits, "hot": hots})

    return run


def _repeated_in_block(block: Block, sampled: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Sampled names that two live documents of this block have."""
    doc = np.repeat(np.arange(len(block.ids), dtype=np.int32), block.lengths)[block.sample]
    at = np.flatnonzero(live[doc])
    # Positions are in the order of documents, so a stable order keeps a name's documents together.
    order = at[np.argsort(sampled[at], kind="stable")]
    v, d = sampled[order], doc[order]
    return _distinct(v[1:][(v[1:] == v[:-1]) & (d[1:] != d[:-1])])


class Occurrences:
    """The repeated sampled names of a block, in the order in which they are sent; those of hot names come last."""

    def __init__(self, block: Block, told: pd.DataFrame, bits: int, n_buckets: int):
        live = np.ones(len(block.ids), bool)
        live[told["place"][told["bucket"] < 0].to_numpy(np.int64)] = False  # copies of whole texts
        sampled = block.sampled(bits)
        distinct = _distinct(sampled)
        shared = distinct[_answers(distinct, told[told["bucket"] >= 0], bits, n_buckets)]
        repeated = _member(sampled, shared) | _member(sampled, _repeated_in_block(block, sampled, live))
        at = block.sample[repeated]
        doc = np.searchsorted(block.ends, at, side="right")
        at, doc = at[live[doc]], doc[live[doc]]
        rows = block.contexts(at, doc)
        # The same context comes once per block, for its smallest id.
        key = _row_keys(rows)
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(key)]
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        head = order[new]
        if not (rows == rows[head[group]]).all():  # two contexts with one key: none is merged
            head = group = np.arange(len(key))
        first = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(first, group, block.ids[doc])
        bucket = (block.name[at[head]] >> U64(32)) * U64(n_buckets) >> U64(32)
        is_hot = distinct[_answers(distinct, told[told["hot"].notna()], bits, n_buckets, "hot")]
        bucket[_member(block.name[at[head]] >> U64(64 - bits), is_hot)] = n_buckets
        self.sent = np.lexsort((at[head], bucket))  # places next to each other overlap, which compresses well
        self.bucket, self.first, self.rows = bucket[self.sent].astype(np.int64), first[self.sent], rows[head[self.sent]]
        turn = np.empty(len(head), np.int64)
        turn[self.sent] = np.arange(len(head))
        self.at, self.id, self.of = at, block.ids[doc], turn[group]

    def parts(self, n_buckets: int) -> list[tuple[int, slice]]:
        cuts = np.searchsorted(self.bucket, np.arange(n_buckets + 1))
        return [(int(b), slice(cuts[b], cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts))]

    def hot(self, n_buckets: int) -> slice:
        """The contexts of hot names."""
        return slice(int(np.searchsorted(self.bucket, n_buckets)), len(self.bucket))


def _strings(rows: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Per shift: the contexts that have it, the distinct 50-byte strings there, which one each has, and their smallest ids."""
    inside = _shifts(rows[:, WIDTH], rows[:, WIDTH + 1])
    for d in range(PERIOD):
        own = np.flatnonzero(inside & np.uint32(1 << d))
        if len(own):
            text = np.ascontiguousarray(rows[own, ROOM - d : WIDTH - d]).view(f"V{PREFIX}").ravel()
            distinct, of = np.unique(text, return_inverse=True)
            least = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least, of, ids[own])
            yield d, own, [x.tobytes() for x in distinct], of, least


def _hot_strings(bits: int, n_buckets: int):
    """The distinct 50-byte strings around the hot names of a block, each with its smallest id."""

    def run(key: tuple, blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple[int, bytes], int] = {}
        for row in blocks.itertuples(index=False):
            found = Occurrences(_open(row), told, bits, n_buckets)
            own = found.hot(n_buckets)
            for _, _, texts, _, least in _strings(found.rows[own], found.first[own]):
                for t, i in zip(texts, least.tolist(), strict=True):
                    out[row.block, t] = min(i, out.get((row.block, t), i))
        return pd.DataFrame([(b, t, i) for (b, t), i in out.items()], columns=["block", "string", "id"])

    return run


def _hot_earlier(found: Occurrences, n_buckets: int, elsewhere: dict[bytes, int]) -> np.ndarray:
    """As ``_earlier`` for the contexts of hot names, given the smallest ids of strings that other blocks have earlier."""
    own = found.hot(n_buckets)
    rows, ids = found.rows[own], found.first[own]
    gone, here = np.zeros(len(rows), np.uint32), dict(elsewhere)
    for _, _, texts, _, least in _strings(rows, ids):
        for t, i in zip(texts, least.tolist(), strict=True):
            here[t] = min(i, here.get(t, i))
    for d, at, texts, of, _ in _strings(rows, ids):
        gone[at] |= (np.array([here[t] for t in texts], np.int64)[of] < ids[at]).astype(np.uint32) << np.uint32(d)
    return gone


def _row_keys(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    with np.errstate(over="ignore"):
        key = np.zeros(len(rows), np.uint64)
        for column in wide.view(np.uint64).T:
            key = mix64(key * U64(_BASE) + column)
    return key


def _shifts(before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Bit d: the 50 bytes that start d bytes before the name lie within the document."""
    low = np.maximum(ROOM - behind.astype(np.int64), 0)
    high = np.minimum(before.astype(np.int64), ROOM)
    every = (np.int64(1) << (high + 1)) - (np.int64(1) << np.minimum(low, high + 1))
    return every.astype(np.uint32)


def _context_messages(bits: int, n_buckets: int, hint: bytes):
    """Every repeated sampled name of a block sends its surroundings to the name's range."""

    def run(key: tuple, blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out, pack_rows = [], zstandard.ZstdCompressor(level=5, dict_data=_dictionary(hint))
        for row in blocks.itertuples(index=False):
            found = Occurrences(_open(row), told, bits, n_buckets)
            for b, own in found.parts(n_buckets):
                table, places = np.unique(found.first[own], return_inverse=True)
                rows = pack_rows.compress(found.rows[own].tobytes())
                out.append((b, row.block, rows, table.tobytes(), _squeeze(places.astype(np.uint32))))
        return pd.DataFrame(out, columns=["bucket", "block", "rows", "ids", "places"])

    return run


def _earlier_documents(hint: bytes):
    """The merge of one range, given what the contexts were compressed with."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        unpack_rows = zstandard.ZstdDecompressor(dict_data=_dictionary(hint))
        return _earlier(pdf, [np.frombuffer(unpack_rows.decompress(x), np.uint8) for x in pdf["rows"]])

    return run


def _earlier(pdf: pd.DataFrame, parts: list[np.ndarray]) -> pd.DataFrame:
    """Merge one range of names: for each context, which of its 21 strings start in a smaller document too.

    A suffix that is not sampled itself is reached from the sampled name ``d`` bytes on. For every
    ``d`` the 50-byte prefixes are sorted, by a key of their bytes, and neighbours are compared byte by
    byte; the smallest id of a run of equal ones is the document that keeps the string.
    """
    rows = np.concatenate(parts).reshape(-1, WIDTH + 2)
    ids = np.concatenate([np.frombuffer(t, np.int64)[_loose(x, np.uint32)] for t, x in zip(pdf["ids"], pdf["places"], strict=True)])
    inside = _shifts(rows[:, WIDTH], rows[:, WIDTH + 1])
    keys = np.empty((PERIOD, len(rows)), np.uint64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(WIDTH, U64(_BASE)))
        for part in range(0, len(rows), 1 << 14):
            own = slice(part, part + (1 << 14))
            total = np.zeros((len(rows[own]), WIDTH + 1), np.uint64)
            np.cumsum(_VALUE[rows[own, :WIDTH]] * powers, axis=1, out=total[:, 1:])
            for d in range(PERIOD):
                span = total[:, WIDTH - d] - total[:, ROOM - d]
                keys[d, own] = mix64(span * U64(pow(_BASE, -(ROOM - d), 1 << 64)))
    gone = np.zeros(len(rows), np.uint32)
    for d in range(PERIOD):
        own = np.flatnonzero(inside & np.uint32(1 << d))
        if not len(own):
            continue
        order = own[np.argsort(keys[d, own])]
        same = keys[d, order][1:] == keys[d, order][:-1]
        a, b = order[:-1][same], order[1:][same]
        same[same] = (rows[a, ROOM - d : WIDTH - d] == rows[b, ROOM - d : WIDTH - d]).all(axis=1)
        start = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.repeat(np.minimum.reduceat(ids[order], start), np.diff(np.concatenate((start, [len(order)]))))
        gone[order] |= (least < ids[order]).astype(np.uint32) << np.uint32(d)
    cuts = np.cumsum([0, *(len(_loose(x, np.uint32)) for x in pdf["places"])])
    bits = [_squeeze(gone[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "bits": bits})


def _removals(bits: int, n_buckets: int):
    """What the documents of a block lose: bytes covered by a string that also starts in a smaller one."""

    def run(key: tuple, blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        told, merged = replies[replies["phase"] == 1], replies[replies["phase"] == 2]
        hot = replies[replies["phase"] == 3]
        out = []
        for row in blocks.itertuples(index=False):
            block = _open(row)
            found = Occurrences(block, told, bits, n_buckets)
            gone = np.zeros(len(found.rows), np.uint32)
            answers = dict(zip(merged["bucket"], merged["bits"], strict=True))
            for b, own in found.parts(n_buckets):
                gone[own] = _loose(answers[b], np.uint32)
            if found.hot(n_buckets).start < len(found.rows):
                elsewhere = dict(zip(hot["bits"], hot["place"].tolist(), strict=True))
                gone[found.hot(n_buckets)] = _hot_earlier(found, n_buckets, elsewhere)
            every = _shifts(found.rows[:, WIDTH], found.rows[:, WIDTH + 1])
            mask = np.where(found.id > found.first[found.of], every[found.of], gone[found.of])
            starts = np.zeros(len(block.data), bool)
            for d in range(PERIOD):
                starts[found.at[(mask >> np.uint32(d)) & np.uint32(1) == 1] - d] = True
            removed = _within(np.flatnonzero(starts), len(block.data), PREFIX - 1)
            for p, (s, e) in enumerate(zip(block.starts, block.ends, strict=True)):
                cut = removed[s:e]
                if not cut.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([False], cut, [False])).astype(np.int8)))
                spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                out.append((row.block, p, int(cut.sum()), spans, hashlib.sha256(block.data[s:e][~cut].tobytes()).digest()))
        return pd.DataFrame(out, columns=["block", "place", "n_removed", "spans", "kept_sha"])

    return run


def repeated_passages(
    docs: DataFrame, *, block_bytes: int = 6 << 20, bucket_bytes: int = 8 << 20, hot_rows: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes covered by a 50-byte string that also starts in a document with a smaller id.

    Method: a distributed difference-cover order of the suffixes, as deep as 50 bytes need it.

    1. *Sample and sort.* Of every 21 positions of a document, counted from its start, the five of a perfect
       difference set are sampled. Two equal 50-byte strings, wherever they start, have one common shift
       below 21 at which both are sampled, and the 30 bytes there are equal. Each sampled position gets
       the name of its 30 bytes, a triple of names of 10 bytes, made in turn from shorter
       names. Names are sorted per block and meet by ranges; those of two documents are repeated.
    2. *Merge the remaining suffixes.* A suffix, sampled or not, can only repeat if a repeated name lies less
       than 21 bytes on. Each repeated name sends its surroundings (20 bytes before and behind) to the
       range of its name, where the 50-byte prefixes at every shift are sorted.
    3. *Compare adjacent prefixes.* Neighbours that are equal byte by byte are one string; the smallest id
       of the run keeps it.

    The recursion ends at the 50 bytes that count, deeper order would change nothing; and order by a key
    of the bytes instead of the alphabet is enough, as only equal neighbours matter. Names of different
    strings may coincide; that only adds candidates.

    Texts that are equal as a whole are found first by digest; their copies are removed entirely and take
    no part in steps 2 and 3. Blocks of text are written once. What is shuffled are packed
    ascending names per block and range, of which a frequent string has at most one per block, with their
    counts. A name's surroundings differ from document to document, so those of a name that occurs more than
    ``hot_rows`` times in all do not meet in one range: each block sends every distinct 50-byte string around
    it once, with its smallest id, an aggregation takes the minimum of each string, and blocks hear of strings
    that are elsewhere in a smaller document.

    Defined results: null and empty texts have 0 bytes; texts shorter than 50 bytes lose nothing;
    rows that repeat an id never remove each other's bytes; a null id removes nothing and loses nothing;
    an empty table gives no rows. Other columns are ignored.

    Returns ``<id>, n_bytes, n_removed, n_spans, spans, kept_sha256``; spans are half open byte ranges.
    """
    rows = narrow(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    blocks = rows.where("id is not null").select(F.col("id").cast("long"), "text")
    blocks = blocks.mapInPandas(_gather(block_bytes), "block long, ids binary, lengths binary, text binary")
    blocks = stage(blocks, "suffix-blocks")

    where = "block long, place long, id long, n_bytes long, sha binary"
    known = stage(blocks.mapInPandas(_digests, where), "suffix-documents")
    total = known.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets, hint = -(-max(total, 1) // bucket_bytes), _hint(blocks)
    bits = min(64, max(32, int(total * len(COVER) / PERIOD).bit_length() + 9))

    # Written on its own, so that the join below reads a frequent text's rows in parts.
    firsts = stage(known.groupBy("sha").agg(F.min(F.struct("id", "block", "place")).alias("rep")), "suffix-firsts")
    known = known.join(firsts, "sha").select("block", "place", "id", "n_bytes", "sha", "rep")
    known = stage(known, "suffix-copies")
    copies = known.where("block <> rep.block or place <> rep.place").select(
        "block", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("binary").alias("hot"), "place"
    )

    reply = "block long, bucket long, bits binary"
    sampled = blocks.mapInPandas(_sample_messages(bits, n_buckets), "bucket long, block long, names binary, counts binary")
    shared = sampled.groupBy("bucket").applyInPandas(_shared_names(hot_rows), f"{reply}, hot binary").withColumn("place", F.lit(-1).cast("long"))
    told = stage(shared.unionByName(copies), "suffix-shared")

    contexts = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        _context_messages(bits, n_buckets, hint), "bucket long, block long, rows binary, ids binary, places binary"
    )
    earlier = contexts.groupBy("bucket").applyInPandas(_earlier_documents(hint), reply).withColumn("place", F.lit(-1).cast("long"))
    replies = told.withColumn("phase", F.lit(1)).unionByName(earlier.withColumn("phase", F.lit(2)), allowMissingColumns=True)
    if not told.where("hot is not null").isEmpty():
        strings = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_hot_strings(bits, n_buckets), "block long, string binary, id long")
        strings = stage(strings, "suffix-hot")
        least = strings.groupBy("string").agg(F.min("id").alias("place"), F.max("id").alias("most")).where("place < most").drop("most")
        better = strings.join(stage(least, "suffix-least"), "string").where("place < id").select("block", F.lit(-2).cast("long").alias("bucket"), F.col("string").alias("bits"), "place")
        replies = replies.unionByName(better.withColumn("phase", F.lit(3)), allowMissingColumns=True)
    cut = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        _removals(bits, n_buckets), "block long, place long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha binary"
    )
    cut = stage(cut, "suffix-cuts").toDF("b", "p", "n_removed", "spans", "kept_sha")

    out = known.join(cut, (F.col("rep.block") == F.col("b")) & (F.col("rep.place") == F.col("p")), "left")
    whole = (F.col("id") > F.col("rep.id")) & (F.col("n_bytes") >= PREFIX)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    out = out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.lower(F.hex(F.when(whole, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    )
    nameless = rows.where("id is null").select(
        F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        none.alias("spans"), F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )
    out = out.unionByName(nameless)
    return out.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans", "kept_sha256")
