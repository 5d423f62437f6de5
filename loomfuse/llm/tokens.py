"""Public tokenizers over Arrow text columns, with a cache of words.

White space ends a word for the tokenizer, so a text's ids are those of its words one after the other. A
word's ids are looked up by its 64-bit hash and its length in a direct-mapped cache; only words that are
not there go to the tokenizer. Cores and a full stop or comma after an ASCII letter are separate words."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from loomfuse.llm.common import hash_spans, ragged, spans

DEFAULT = "word_bpe_49k.json"
#: Words that the tokenizer's normalization leaves as they are and that it splits at one known place: small letters, then marks or none.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([!#$%&*.,:;?]*)").fullmatch
#: How the tokenizer writes bytes: those that print in Latin-1 as they are, the others as signs from 256 on, in their order.
_PRINT = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINT)}
SLOTS, MOST_WORDS = 1 << 20, 1_500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class WordTokens:
    def __init__(self, path: str | None = None, end: int | None = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.end = end
        self._clear()

    def _clear(self) -> None:
        self.keys, self.sizes, self.at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0
        self.first, self.count, self.words = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 0
        self.fixed = self._add([".", ","])
        if self.end is not None:
            self._grow(1, 1)
            self.pool[self.used], self.first[self.words], self.count[self.words] = self.end, self.used, 1
            self.used, self.words = self.used + 1, self.words + 1

    def _grow(self, words: int, ids: int) -> None:
        while self.used + ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.words + words > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))

    def _add(self, words: list[str]) -> np.ndarray:
        """Entries of new words. The pre-tokens of a plain one go to the model alone; others go through all of the tokenizer."""
        found: list = [None] * len(words)
        rest, model = [], self.tokenizer.model
        for i, w in enumerate(words):
            if m := PLAIN(w):
                letters = m[1] if m[1].isascii() else m[1].encode().decode("latin-1").translate(BYTES)
                found[i] = [t.id for part in (letters, m[2]) if part for t in model.tokenize(part)]
            else:
                rest.append(i)
        for k in range(0, len(rest), 2000):
            part = rest[k : k + 2000]
            got = self.tokenizer.encode([words[i] for i in part], is_pretokenized=True, add_special_tokens=False)
            ids = got.ids
            upto = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part) + 1)).tolist() if ids else [0] * (len(part) + 1)
            for i, a, z in zip(part, upto, upto[1:]):
                found[i] = ids[a:z]
        count = np.array([len(f) for f in found], np.int64)
        total = int(count.sum())
        self._grow(len(words), total)
        begin = self.words
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.count[begin : begin + len(words)], self.first[begin : begin + len(words)] = count, self.used + np.cumsum(count) - count
        self.used, self.words = self.used + total, begin + len(words)
        return np.arange(begin, self.words)

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        lower = b"<|" not in raw  # else a special token's text could arise
        h, size = hash_spans(data, starts, ends, lower=lower), (ends - starts).astype(np.int32)
        slot = (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        out = self.at[slot].astype(np.int64)
        miss = np.flatnonzero((self.keys[slot] != h) | (self.sizes[slot] != size))
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            w = miss[one]
            text = [raw[a:z].lower() if lower else raw[a:z] for a, z in zip(starts[w].tolist(), ends[w].tolist())]
            new = self._add([x.decode() for x in text])
            out[miss] = new[back]
            self.keys[slot[w]], self.sizes[slot[w]], self.at[slot[w]] = h[w], size[w], new
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each with the end id where there is one."""
        if self.words > MOST_WORDS:
            self._clear()
        starts, ends, upto = spans(data, offsets)
        if len(starts):
            last, prev = data[ends - 1], data[np.maximum(ends - 2, 0)] | 32
            dot = ((last == 46) | (last == 44)) & (ends - starts > 1) & (prev >= 97) & (prev <= 122)
            word = self.entries(data, starts, ends - dot)
            place = np.arange(len(word)) + np.cumsum(dot) - dot
            entry = np.empty(len(word) + int(dot.sum()), np.int64)
            entry[place] = word
            entry[place[dot] + 1] = self.fixed[(last[dot] == 44).astype(np.int64)]
            stop = upto + np.r_[0, np.cumsum(dot)][upto]
        else:
            entry, stop = np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        if self.end is not None:
            entry = np.insert(entry, stop[1:], 2)  # the entry of the end id comes after those of the two marks
            stop = stop + np.arange(len(stop))
        count = self.count[entry]
        return self.pool[ragged(self.first[entry], count)], np.r_[0, np.cumsum(count, dtype=np.int64)][stop]


_MADE: dict = {}


def word_tokens(path: str | None = None, end: int | None = 2) -> WordTokens:
    """One for each process."""
    if (path, end) not in _MADE:
        _MADE.clear()
        _MADE[path, end] = WordTokens(path, end)
    return _MADE[path, end]


def release_tools() -> None:
    """Drop the process's tokenizer and its cache."""
    _MADE.clear()
