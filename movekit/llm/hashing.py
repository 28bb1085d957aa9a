"""Vectorised hashing of words and word shingles inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below ``n`` (kept and grown as needed)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of ``text``, words being parted by single white space bytes."""
    data = np.frombuffer(text, np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=total[1:])
        return starts, mix64((total[ends] - total[starts]) * _power(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: list[bytes], limit: int = 1 << 19) -> Iterator[list[int]]:
    """Positions of ``texts`` in runs of about ``limit`` bytes; a longer text is a run of its own."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(t) + 1
    if run:
        yield run


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text; fewer words count as one shingle."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    for run in chunks(texts):
        sizes = np.array([len(texts[i]) + 1 for i in run])
        starts, words = word_hashes(b"\n".join(texts[i] for i in run))
        bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        with np.errstate(over="ignore"):
            shingles = np.zeros(max(len(words) - k + 1, 0), np.uint64)
            for j in range(k):
                shingles += words[j : j + len(shingles)] * U64((0xA24BAED4963EE407 * (2 * j + 3)) & (2**64 - 1))
            shingles = mix64(shingles)
            for i, a, b in zip(run, bounds[:-1], bounds[1:], strict=True):
                if b - a >= k:
                    s = np.sort(shingles[a : b - k + 1])
                    out[i] = s[np.concatenate(([True], s[1:] != s[:-1]))]
                elif b > a:
                    few = words[a:b] * (np.arange(b - a, dtype=np.uint64) * U64(2) + U64(0x7F4A7C15))
                    out[i] = mix64(np.array([few.sum() + U64(b - a)], np.uint64))
    return out
