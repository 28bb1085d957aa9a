"""Token ids of whole texts, with each distinct word handed to the tokenizer once per worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Latin letters whose lower case and composed form are one letter each, with at most one mark behind.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: White space to ``str.split`` but not to the tokenizer.
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_CACHE_LIMIT = 800_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids as little-endian 32-bit bytes, equal to those of the tokenizer in the file.

    For tokenizers that part texts at white space and mark word ends: the ids of a text are those of
    its words one after the other. Words are kept in a bounded table; plain words missing there are
    encoded together as one text and told apart by their end marks, all others one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.is_end = np.zeros(self.size, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._whole(m) for m in ".,"} | {"": b""}
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: set[str]) -> None:
        if len(self.words) + len(missing) > _CACHE_LIMIT:
            self.words.clear()
        if len(self.stems) + len(missing) > _CACHE_LIMIT:
            self.stems.clear()
        plain, stems = [], set()
        for w in missing:
            m = _PLAIN.fullmatch(w)
            if m is None:
                self.words[w] = self._whole(w)
                continue
            stem = m[1].lower()
            plain.append((w, stem, m[2]))
            if stem not in self.stems:
                stems.add(stem)
        if stems:
            listed = sorted(stems)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(listed)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(listed):
                raw, at = ids.tobytes(), 0
                for stem, e in zip(listed, (ends * 4).tolist(), strict=True):
                    self.stems[stem] = raw[at:e]
                    at = e
            else:
                for stem in listed:
                    self.stems[stem] = self._whole(stem)
        for w, stem, mark in plain:
            self.words[w] = self.stems[stem] + self.marks[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            few = texts[at : at + 256]
            parts = [None if _ODD_SPACE.search(t) else t.split() for t in few]
            found = [None if p is None else list(map(self.words.get, p)) for p in parts]
            gaps = [(p, f, [k for k, x in enumerate(f) if x is None]) for p, f in zip(parts, found, strict=True) if f is not None and None in f]
            if gaps:
                self._learn({p[k] for p, _, ks in gaps for k in ks})
                for p, f, ks in gaps:
                    for k in ks:
                        f[k] = self.words[p[k]]
            out += [self._whole(t) if f is None else b"".join(f) for t, f in zip(few, found, strict=True)]
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per worker, kept between tasks."""
    return WordTokenizer(path)
