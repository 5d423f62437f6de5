"""Token counts by distinct pre-tokens: pieces are counted once for each, joined to the documents' pre-token frequencies and summed.

Three passes, in none of which a text's ids exist:
  1. each task finds the distinct pre-tokens of its documents and in how many of them they are; the tasks' lists are
     summed by pre-token, and the byte-pair model cuts each pre-token of the corpus once (the dictionary, written);
  2. each task counts the pre-tokens of its documents again. The dictionary's common entries (those with at least a
     ``COMMON``-th of all frequencies, hence at most ``COMMON`` of them) are broadcast and summed on the spot; every other
     pre-token of a document is a row (document, pre-token, frequency);
  3. these rows are joined with the dictionary and summed by document. No key of that join is frequent.

Pre-tokens are the library's own. White space ends one, but for a blank before a word, so that a text is taken apart at
ASCII white space and each chunk (a word with the blank before it, a run of white space) is cut once a process, by the
library unless it is plainly a word of ASCII letters. Texts with other white space, or with the special token's string, which the library takes for that token, go to it whole.

Null text is the empty text, with no tokens. Rows are counted one by one, so a repeated row is returned as often as it is there.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import buffers, cut, hash_spans, norm_docs, pieces, ragged, real_id, release, spans

FILE, SPECIAL, LIMIT = "byte_bpe_50k.json", "<|endoftext|>", 1024
#: At most so many entries of the dictionary are broadcast, of at most 40 bytes each.
COMMON = 1 << 20
SLOTS, MOST_PRE, MOST_IDS, MOST_CHARS = 1 << 20, 700_000, 8_000_000, 48_000_000
#: A chunk that needs no library: a blank or none, ASCII letters, a mark or none. The library writes a leading blank as Ġ.
PLAIN = re.compile(rb"( ?)([A-Za-z]+)([.,;:!?]?)")
#: White space beyond ASCII, or the special token.
WHOLE = regex.compile(r"(?! )\p{Z}|[\x85\u180e]|<\|endoftext\|>")
#: Between a letter or digit and a mark, or a letter and a digit, pre-tokens always part.
SAFE = regex.compile(r"(?<=[0-9A-Za-zа-яぁ-ゖァ-ヺ一-龥가-힣])(?=[!-/:-@\[-`{-~，。、！？])|(?<=[A-Za-z])(?=[0-9])")
PART = 1 << 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def tokenizer(path: str | None = None):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or default_path())


class PreTokens:
    """Pre-tokens of texts as numbers, with a cache of chunks by their 64-bit hash and length. One for each process."""

    def __init__(self, path: str | None = None):
        self.cut = tokenizer(path).pre_tokenizer.pre_tokenize_str
        self.epoch = 0
        self._clear()

    def _clear(self) -> None:
        self.epoch += 1
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.chars = 0
        self.keys, self.sizes, self.at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.first, self.count, self.chunks = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.pool, self.used = np.zeros(1 << 17, np.int32), 0

    def full(self) -> bool:
        return len(self.names) > MOST_PRE or self.used > MOST_IDS or self.chars > MOST_CHARS

    def _numbers(self, text: str) -> list[int]:
        out: list[int] = []
        at, n = 0, len(text)
        while at < n:  # a long text in parts, to bound the library's lists
            end = n
            if n - at > PART and (m := SAFE.search(text, at + PART)):
                end = m.start()
            out += [self._one(name) for name, _ in self.cut(text[at:end])]
            at = end
        return out

    def _one(self, name: str) -> int:
        i = self.number.get(name)
        if i is None:
            i = self.number[name] = len(self.names)
            self.names.append(name)
            self.chars += len(name)
        return i

    def _chunk(self, chunk: bytes) -> list[int]:
        m = PLAIN.fullmatch(chunk)
        if not m:
            return self._numbers(chunk.decode())
        word = self._one(("Ġ" if m[1] else "") + m[2].decode())
        return [word, self._one(m[3].decode())] if m[3] else [word]

    def whole(self, text: str) -> np.ndarray:
        """Pre-tokens of a text that may hold the special token, cut by the library from end to end."""
        out: list[int] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                out.append(self._one(SPECIAL))
            out += self._numbers(part)
        return np.array(out, np.int64)

    def _add(self, texts: list[bytes]) -> np.ndarray:
        found = [self._chunk(t) for t in texts]
        size, ids = len(found), sum(map(len, found))
        while self.chunks + size > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        count = np.array([len(f) for f in found], np.int64)
        self.pool[self.used : self.used + ids] = [i for f in found for i in f]
        new = np.arange(self.chunks, self.chunks + size)
        self.count[new], self.first[new] = count, self.used + np.cumsum(count) - count
        self.chunks, self.used = self.chunks + size, self.used + ids
        return new

    def _entries(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h, size = hash_spans(data, starts, ends), ends - starts
        slot = (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        out = self.at[slot]
        miss = np.flatnonzero((self.keys[slot] != h) | (self.sizes[slot] != size))
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            w = miss[one]
            new = self._add([raw[a:z] for a, z in zip(starts[w].tolist(), ends[w].tolist())])
            out[miss] = new[back]
            self.keys[slot[w]], self.sizes[slot[w]], self.at[slot[w]] = h[w], size[w], new
        return out

    def frequencies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pre-token, how often) of the texts, each pair once, by document."""
        raw, n = data.tobytes(), len(offsets) - 1
        odd = np.zeros(n, bool)
        docs, ids = [], []
        for i in range(n):
            text = raw[offsets[i] : offsets[i + 1]]
            if (not text.isascii() or b"<|" in text) and WHOLE.search(text := text.decode()):
                odd[i] = True
                got = self.whole(text)
                docs.append(np.full(len(got), i))
                ids.append(got)
        starts, ends, upto = spans(data, offsets)
        of = np.repeat(np.arange(n), np.diff(upto))
        before = np.r_[0, ends[:-1]] if len(ends) else ends
        head = upto[:-1][np.diff(upto) > 0]
        before[head] = offsets[:-1][np.diff(upto) > 0]  # a text's first word: the gap begins with the text
        gap = starts - before
        blank = (gap > 0) & (data[np.maximum(starts - 1, 0)] == 0x20) if len(starts) else gap > 0
        last = np.where(np.diff(upto) > 0, ends[np.maximum(upto[1:], 1) - 1] if len(ends) else 0, offsets[:-1])
        tail = last < offsets[1:]
        for a, z, d in (
            (starts - blank, ends, of), (before[gap > 1], starts[gap > 1] - 1, of[gap > 1]), (starts[(gap > 0) & ~blank] - 1, starts[(gap > 0) & ~blank], of[(gap > 0) & ~blank]), (last[tail], offsets[1:][tail], np.flatnonzero(tail)),
        ):
            use = ~odd[d]
            e = self._entries(raw, data, a[use], z[use])
            count = self.count[e]
            docs.append(np.repeat(d[use], count))
            ids.append(self.pool[ragged(self.first[e], count)].astype(np.int64))
        width = max(1, len(self.names))
        pair, often = np.unique(np.concatenate(docs) * width + np.concatenate(ids), return_counts=True)
        return pair // width, pair % width, often


_MADE: dict = {}


def pre_tokens(path: str | None = None) -> PreTokens:
    if path not in _MADE:
        _MADE.clear()
        _MADE[path] = PreTokens(path)
    return _MADE[path]


def corpus_pre_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """pre, docs: the pre-tokens of all texts, each once, and in how many texts they are."""
    names = ["pre", "docs"]

    def run(batches):
        tool = pre_tokens(path)
        seen, epoch = np.zeros(0, np.int64), tool.epoch

        def out():
            at = np.flatnonzero(seen)
            for k in range(0, len(at), 100_000):
                part = at[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([tool.names[i] for i in part.tolist()], pa.string()), pa.array(seen[part])], names)

        for batch in batches:
            for b in pieces(batch, "text"):
                if tool.full():
                    yield from out()
                    tool._clear()
                    seen = np.zeros(0, np.int64)
                _, ids, _ = tool.frequencies(*buffers(b.column(1)))
                more = np.bincount(ids, minlength=len(tool.names))
                more[: len(seen)] += seen
                seen = more
        yield from out()

    return docs.mapInArrow(run, "pre string, docs long").groupBy("pre").agg(F.sum("docs").alias("docs"))


def with_pieces(pre: DataFrame, path: str | None = None) -> DataFrame:
    """Adds n_pieces, how many pieces the byte-pair model cuts a pre-token into."""

    def run(batches):
        model = tokenizer(path).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([1 if p == SPECIAL else len(model.tokenize(p)) for p in b.column(0).to_pylist()], pa.int64())], ["pre", "docs", "n_pieces"])

    return pre.mapInArrow(run, "pre string, docs long, n_pieces long")


def short(pre: str) -> str:
    """A pre-token, or the digest of a long one."""
    return pre if len(pre) <= 16 else hashlib.blake2b(pre.encode(), digest_size=16).hexdigest()


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, common: int = COMMON) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), n_pre_tokens."""
    spark, texts = docs.sparkSession, norm_docs(docs)
    words = cut(with_pieces(corpus_pre_tokens(texts, path), path), "pre-tokens")
    total = words.agg(F.sum("docs")).first()[0] or 0
    top = words.where(F.col("docs") * common >= total).select("pre", "n_pieces").toArrow()
    often = spark.sparkContext.broadcast(dict(zip(map(short, top.column(0).to_pylist()), top.column(1).to_pylist())))
    kind = "row long, doc_id long, n_bytes long, n_tokens long, n_pre_tokens long, pre string, often long"

    def run(batches):
        tool, known = pre_tokens(path), often.value
        size, epoch = np.zeros(0, np.int64), tool.epoch
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for b in pieces(batch, "text"):
                if tool.full():
                    tool._clear()
                if epoch != tool.epoch:
                    size, epoch = np.zeros(0, np.int64), tool.epoch
                data, offsets = buffers(b.column(1))
                d, ids, n = tool.frequencies(data, offsets)
                fresh = [known.get(short(p), -1) for p in tool.names[len(size) :]]
                size = np.r_[size, np.array(fresh, np.int64)]
                each = size[ids]
                here, count = each >= 0, b.num_rows
                rows = row + np.arange(count)
                tokens = np.bincount(d[here], weights=(each * n)[here], minlength=count).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows), b.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(np.bincount(d, weights=n, minlength=count).astype(np.int64)), pa.nulls(count, pa.string()), pa.nulls(count, pa.int64())], kind_names)
                if len(rest := np.flatnonzero(~here)):
                    none = pa.nulls(len(rest), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[d[rest]]), none, none, none, none, pa.array([tool.names[i] for i in ids[rest].tolist()], pa.string()), pa.array(n[rest])], kind_names)
                row += count

    kind_names = [x.split()[0] for x in kind.split(", ")]
    found = cut(texts.mapInArrow(run, kind), "token-counts")
    rest = found.where("pre is not null").select("row", "pre", "often").join(words.select("pre", "n_pieces"), "pre")
    rest = rest.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("often") * F.col("n_pieces")).alias("n_tokens"), F.lit(None).cast("long").alias("n_pre_tokens"))
    every = found.where("pre is null").select(rest.columns).unionByName(rest)
    got = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.max("n_pre_tokens").alias("n_pre_tokens"))
    return got.select(real_id(), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_pre_tokens")
