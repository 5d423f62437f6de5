"""Language-model scores of whole texts.

The model is one causal self-attention layer in numpy over the words of a text, each read as the first of its ids of a public subword
tokenizer; words end at white space, and a text with an end of its own. For each word it attends to the words before it in its window (masked softmax,
relative position bias; a key carries its token and the one before it) and mixes with that: ``EXPERTS`` learned distributions of the first id, each
followed by the word's other ids by trigrams (``Spelling``); the frequency of the word in training; and a copy of an attended word. All are
distributions over words, so that their mixture is one. Texts are cut into windows of ``WIDE`` words that overlap by half; each word is scored
once, by the window that has most context before it. First ids beyond the ``TOP`` most frequent share a token and are split by their counts.

Learning reads training documents only (crc32 of the id's text modulo 5 is not 1), and all of them: word counts, counts of all subword
trigrams and bigrams within words, and attention by averaged local training, one trainer for each ``SHARE`` words. A training text's own
occurrences are taken off the counts while it trains attention.

Texts are read once. A task numbers the words of its documents by chunk and sends each distinct one to its bucket; there words are
counted and cut into ids; the buckets ask for the counts of their subword n-grams, and answer the chunks. No vocabulary of words is
broadcast or gathered. Words are told apart by 64-bit hashes; words that differ only in letters that the tokenizer does not tell apart count apart.

Null text is empty: one end. A null id counts as the empty text in the split. Repeated rows are scored alike, and counted
each. Without training documents the counts are zero and the model is uniform over its ids.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import NO_ID, buffers, cut, hash_spans, mix, no_subnormals, norm_docs, one_thread, pieces, ragged, real_id, release, shuffle_parts, spans
from loomfuse.llm.tokens import release_tools, word_tokens

WIDE, STEP, TOP, EXPERTS, KEY = 64, 32, 2048, 24, 12
#: Windows scored, and trained on, at once; batches a training step.
BATCH, TRAIN_BATCH, GROUP = 96, 48, 4
#: Words that a task numbers in one chunk; words of training texts for each trainer.
CHUNK_WORDS, SHARE = 700_000, 4_000_000
#: Documents that give the experts their start; steps that a trainer takes at least, going over its windows again if they are few.
FIRST_DOCS, LEAST_STEPS = 1500, 200
#: The id that ends a text, that of a word's end, what stands before a word's first id, any context; and how many there are.
END, STOP, BEFORE, ANY, IDS = 49407, 49408, 49409, 65535, 49410
#: Weight of the shorter context.
SMOOTH = 2.0
#: Exponentials of scores (of gates) up to these, with sums of at least that, stay far inside float32; else a row loses its largest first.
MOST_SCORE, MOST_GATE, LEAST_TOTAL = 30.0, 80.0, 1e-10


def held_out(doc_id: int) -> bool:
    return zlib.crc32(b"" if doc_id == NO_ID else str(doc_id).encode()) % 5 == 1


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpacked(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    ends = 8 + 8 * n + np.cumsum(sizes)
    return [np.frombuffer(raw, t, int(s) // np.dtype(t).itemsize, int(z - s)) for t, s, z in zip(types, sizes, ends)]


# ---- the model ---------------------------------------------------------------------------------


class Vocabulary:
    """First ids to model tokens: 0 begins a text, 1 stands for all rare ids, others by frequency."""

    def __init__(self, counts: np.ndarray, top: int = TOP):
        best = np.argsort(-counts, kind="stable")[: top - 2]
        self.of = np.ones(len(counts), np.int32)
        self.of[best] = np.arange(2, len(best) + 2)
        self.size = len(best) + 2
        rare = np.where(self.of == 1, counts + 0.5, 0.0)
        self.log_rare = np.where(self.of == 1, np.log(np.maximum(rare, 1e-300) / max(rare.sum(), 1e-300)), 0.0)


def clusters(counts: np.ndarray, r: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Shares of each row in ``EXPERTS`` clusters: a mixture of multinomials, by expectation and maximisation."""
    base = (counts.sum(0) + 0.1) / (counts.sum() + 0.1 * counts.shape[1])
    share = r.dirichlet(np.ones(EXPERTS) * 0.1, len(counts))
    for turn in range(rounds):
        p = share.T @ counts + 20 * base
        logs = counts @ np.log(p / p.sum(1, keepdims=True)).T + np.log(share.mean(0) + 1e-6)
        logs *= min(1.0, 0.02 * 2 ** (turn / 3))  # cooled slowly, so that clusters do not freeze at once
        share = softmax(logs)
    return share


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


class Attention:
    """Parameters, forward pass and gradients. Windows are token matrices (n, WIDE + 1): what stands before, then the tokens."""

    NAMES = ("q", "k", "k2", "v", "gate", "out", "bias", "near", "expert")

    def __init__(self, vocab: Vocabulary | None = None, seen=None, seed: int = 7, **given):
        """A start from ``seen``: for some documents the counts of their words' tokens."""
        if given:
            self.__dict__.update(given)
            return
        r, n = np.random.default_rng(seed), vocab.size
        f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.q, self.k, self.k2 = f(n, KEY), f(n, KEY), f(n, KEY)
        self.near = (-0.01 * np.arange(WIDE)).astype(np.float32)
        heads = seen if seen is not None and len(seen) else np.ones((1, n))
        share = clusters(heads, r)
        start = share.T @ heads + 2.0 * (heads.sum(0) + 0.01) / (heads.sum() + 0.01 * n)
        every = share.T @ heads + 50.0 * (heads.sum(0) + 0.5) / (heads.sum() + 0.5 * n)
        every /= every.sum(1, keepdims=True)
        start[:, 0] = 1e-12  # never predicted
        self.expert = np.log(start / start.sum(1, keepdims=True)).T.astype(np.float32)
        # the mean over the context of log-likelihood ratios tells the cluster; ``out`` turns it into weights
        self.v = np.log(every / (share.mean(0) @ every)).T.astype(np.float32)
        self.out = np.c_[12.0 * np.eye(EXPERTS), np.zeros((EXPERTS, 2))].astype(np.float32)
        self.gate, self.bias = np.zeros((n, EXPERTS + 2), np.float32), np.zeros(EXPERTS + 2, np.float32)
        self.bias[:-2] = np.log(share.mean(0) + 1e-3)
        self.bias[-2:] = 1.0, -1.0  # the word's frequency, and the copy

    def params(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.NAMES}

    def ready(self) -> Attention:
        """What follows from the parameters: chances of the experts, values with a one (its sum over attention is the total), gates with their bias."""
        z = self.expert.astype(np.float64)
        z = np.exp(z - z.max(0))
        self.p = (z / z.sum(0)).astype(np.float32)
        self.v_one = np.concatenate([self.v, np.ones((len(self.v), 1), np.float32)], 1)
        self.gate_bias = self.gate + self.bias
        return self

    def attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Attention, not divided by its totals, and its sums of ``v``, the last of which is that total."""
        lag, seen = lags(first, k.shape[1])
        keys = k.transpose(0, 2, 1)
        a = np.matmul(q, keys)
        if a.max() < MOST_SCORE and np.abs(self.near).max() < MOST_SCORE:
            np.exp(a, out=a)
            a *= np.where(seen, np.exp(self.near)[lag], np.float32(0))
            c = np.matmul(a, v)
            if c[..., -1].min() > LEAST_TOTAL:
                return a, c
        a = np.matmul(q, keys)
        a += np.where(seen, self.near[lag], np.float32(-1e4))
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        return a, np.matmul(a, v)

    def forward(self, x: np.ndarray, first: int, words: np.ndarray, often: np.ndarray, rest: np.ndarray, keep: bool = False):
        """Log probabilities of the words at x[:, first + 1 :]. x: the token before each place, then that place's own; words: which word each
        is (-1: none; of places that count none but the first sees such a one); often: the words' frequencies, and rest: log chances of their ids
        but the first, both from ``first`` on."""
        m = x.shape[1] - 1  # places; place i predicts x[:, i + 1] from x[:, : i + 1]
        own, before = x[:, 1 + first :], x[:, :m]
        q = rows_of(self.q, before[:, first:])
        q *= np.float32(KEY**-0.5)
        # key j is the token at x[:, j], with the one before it; place i sees j <= i
        shifted = np.concatenate([before[:, :1] * 0, before[:, :-1]], 1)
        k, v = rows_of(self.k, before), rows_of(self.v_one, before)
        k += rows_of(self.k2, shifted)
        a, c = self.attend(q, k, v, first)
        total = c[..., -1]
        c = c[..., :-1] / total[..., None]
        g = c.reshape(-1, EXPERTS) @ self.out
        g += rows_of(self.gate_bias, before[:, first:].ravel())
        g = shares(g).reshape(*q.shape[:2], -1)
        # pairs (place, key) of the same word; a place beyond the end of its text has none
        same = np.flatnonzero(words[:, None, :m] == np.where(words < 0, -2, words)[:, 1 + first :, None])
        of = same // m
        copy = np.bincount(of, a.reshape(-1)[same], total.size).reshape(total.shape)
        start = (words[:, :1] < 0).astype(np.float32)  # attention on what stands before the text falls back on frequency
        copy += a[..., 0] * start * often
        copy = (copy / total).astype(np.float32)
        e = rows_of(self.p, own)
        by_expert, by_word = np.einsum("nij,nij->ni", g[..., :-2], e), g[..., -2] * often + g[..., -1] * copy
        with np.errstate(divide="ignore"):
            logp = np.logaddexp(np.log(np.maximum(by_expert, 1e-37)) + rest, np.log(by_word))
        return (logp, (q, k, v, a, total, c, g, same, of, start, copy, e, own, before, shifted)) if keep else logp

    def gradients(self, x: np.ndarray, first: int, words: np.ndarray, often: np.ndarray, rest: np.ndarray, mask: np.ndarray, places: float = 0.0):
        """Loss over the places of ``mask``, divided by their number or ``places``, and its gradients."""
        logp, (q, k, v, a, total, c, g, same, of, start, copy, e, own, before, shifted) = self.forward(x, first, words, often, rest, True)
        share = (mask / np.float32(places or mask.sum())).astype(np.float32)[..., None]
        inverse = np.exp(np.minimum(-logp, 60)).astype(np.float32)
        post = np.empty_like(g)
        np.multiply(g[..., :-2], e, out=post[..., :-2])
        post[..., :-2] *= np.exp(np.minimum(rest - logp, 60)).astype(np.float32)[..., None]
        post[..., -2], post[..., -1] = g[..., -2] * often * inverse, g[..., -1] * copy * inverse
        dz = g - post
        dz *= share
        flat = dz.reshape(-1, dz.shape[-1])
        d = {"bias": np.ones(len(flat), np.float32) @ flat, "out": c.reshape(-1, EXPERTS).T @ flat}
        size = len(self.q)
        # of scores: a / total * (dc v - pull of copied words - their mean over attention); the mean goes by the one of ``v``
        dc, pull = (flat @ self.out.T).reshape(c.shape), g[..., -1] * inverse * share[..., 0]
        down = np.concatenate([dc, (pull * copy - np.einsum("nij,nij->ni", dc, c))[..., None]], -1)
        down /= total[..., None]
        pull /= total
        ds = np.matmul(down, v.transpose(0, 2, 1))
        ds.reshape(-1)[same] -= pull.reshape(-1)[of]
        ds[..., 0] -= pull * often * start
        ds *= a
        lag, seen = lags(first, k.shape[1])
        d["near"] = np.bincount(lag.ravel(), np.where(seen, ds.sum(0), 0).ravel(), WIDE).astype(np.float32)
        dk = np.matmul(ds.transpose(0, 2, 1), q)
        dq = np.matmul(ds, k)
        dq *= np.float32(KEY**-0.5)
        by_query, by_key = (dq, dz), (dk, np.matmul(a.transpose(0, 2, 1), down)[..., :-1])
        if first:
            sums = scatter(before[:, first:], size, *by_query) + scatter(before, size, *by_key)
        else:
            sums = scatter(before, size, *by_query, *by_key)
        d["q"], d["gate"], d["k"], d["v"] = sums
        (d["k2"],) = scatter(shifted, size, dk)
        soft = post[..., :-2] * share
        d["expert"] = self.p * (np.ones(len(flat), np.float32) @ soft.reshape(-1, EXPERTS)) - scatter(own, size, soft)[0]
        return float(-(logp * share[..., 0]).sum()), d

    def train(self, windows, rate: float = 0.02) -> Attention:
        """Adam over ``GROUP`` batches of windows (the arguments of ``gradients``) at a time; small batches stay in the cache."""
        m = {k: np.zeros_like(v) for k, v in self.params().items()}
        v = {k: np.zeros_like(x) for k, x in m.items()}
        self.losses, held = [], []

        def step() -> None:
            places, t = float(sum(batch[-1].sum() for batch in held)), len(self.losses) + 1
            losses, parts = zip(*(self.gradients(*batch, places) for batch in held))
            self.losses.append(sum(losses))
            lr = rate / np.sqrt(1 + t / 200) / (1 - 0.9**t)
            for k in self.NAMES:
                d = parts[0][k]
                for more in parts[1:]:
                    d += more[k]
                m[k] *= 0.9
                m[k] += np.float32(0.1) * d
                d *= d
                v[k] *= 0.98
                v[k] += np.float32(0.02) * d
                np.sqrt(v[k] * np.float32(1 / (1 - 0.98**t)), out=d)
                d += 1e-7
                np.divide(m[k], d, out=d)
                d *= np.float32(lr)
                getattr(self, k)[...] -= d
            held.clear()
            self.ready()

        self.ready()
        for batch in windows:
            held.append(batch)
            if len(held) == GROUP:
                step()
        if held:
            step()
        return self


@cache
def lags(first: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each key lies behind each place from ``first`` on, within ``WIDE``; which keys it sees."""
    lag = np.arange(first, m)[:, None] - np.arange(m)[None]
    return np.clip(lag, 0, WIDE - 1), lag >= 0


def shares(g: np.ndarray) -> np.ndarray:
    """Softmax of rows."""
    if g.max() < MOST_GATE:
        e = np.exp(g)
        total = e @ np.ones(g.shape[-1], np.float32)
        if total.min() > LEAST_TOTAL:
            e /= total[:, None]
            return e
    return softmax(g)


def rows_of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(table, at, 0)


def scatter(at: np.ndarray, size: int, *rows: np.ndarray) -> list[np.ndarray]:
    """Sums of rows by token."""
    at = at.ravel().astype(np.uint16)
    order = np.argsort(at, kind="stable")
    at = at[order]
    head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out = []
    for r in rows:
        total = np.zeros((size, r.shape[-1]), np.float32)
        total[at[head]] = np.add.reduceat(np.take(r.reshape(-1, r.shape[-1]), order, 0), head, 0)
        out.append(total)
    return out


def windows_of(n: np.ndarray, overlap: bool = True):
    """(place of the first word in its text, text, first place that counts) of windows over texts of ``n`` words: first windows whole, later ones
    by their second half, or without overlap."""
    step = STEP if overlap else WIDE
    for later in (False, True):
        if later:
            count = np.maximum(-(-(n - WIDE) // step), 0)
            of = np.repeat(np.arange(len(n)), count)
            turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = (STEP * (turn + 1)) if overlap else WIDE * (turn + 1)
        else:
            of, at = np.flatnonzero(n > 0), np.zeros((n > 0).sum(), np.int64)
        if len(of):
            yield at, of, WIDE - STEP if later and overlap else 0


class Texts:
    """Documents of a chunk as arrays over their words, ends of texts included."""

    def __init__(self, token: np.ndarray, word: np.ndarray, often: np.ndarray, rest: np.ndarray, off: np.ndarray):
        self.token, self.word, self.often, self.rest, self.off = token, word, often, rest, off

    def batches(self, overlap: bool, batch: int = BATCH):
        """((x, first, words, often, rest), index of each place that counts or -1), the arguments of ``Attention.forward``."""
        begin, n = self.off[:-1], np.diff(self.off)
        for begins, of, first in windows_of(n, overlap):
            for i in range(0, len(of), batch):
                p, t = begins[i : i + batch, None] + np.arange(-1, WIDE), of[i : i + batch]
                inside = (p >= 0) & (p < n[t][:, None])
                index = np.where(inside, begin[t][:, None] + p, 0)
                at = np.where(inside, index, -1)[:, 1 + first :]
                far = index[:, 1 + first :]
                yield (np.where(inside, self.token[index], 0), first, np.where(inside, self.word[index], -1), self.often[far], self.rest[far]), at

    def log_probs(self, model: Attention) -> np.ndarray:
        out = np.zeros(len(self.token))
        for args, at in self.batches(True):
            got = model.forward(*args)
            out[at[at >= 0]] = got[at >= 0]
        return out

    def training(self):
        """Training batches: every word once; places beyond a text's end are masked."""
        for args, at in self.batches(False, TRAIN_BATCH):
            yield (*args, at >= 0)


# ---- words ---------------------------------------------------------------------------------------


def ask(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, blob, n, docs. Bucket -1: a chunk's documents (ids, words in each, number of each word); n training words, docs documents.
    Others: the distinct words of the chunk that fall to the bucket, with their counts in training texts. A chunk's words are numbered by
    bucket, then hash."""

    def run(batches):
        held, size, turn = [], 0, 0

        def flush():
            nonlocal turn
            chunk = TaskContext.get().partitionId() << 32 | turn
            turn += 1
            hashes = np.concatenate([x[2] for x in held])
            one, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            bucket = (one >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(one), np.int64)
            number[order] = np.arange(len(one))
            edge = np.cumsum([0, *(len(x[2]) for x in held)])
            of = [number[back[a:z]][x[4]] for a, z, x in zip(edge, edge[1:], held)]
            ids, sizes, of, learn = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate(of), np.concatenate([x[5] for x in held])
            count = np.bincount(of[learn], minlength=len(one))
            text = [w for x in held for w in x[3]]
            upto = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = [(-1, chunk, packed(ids, sizes, of.astype(np.int32)), int(learn.sum()), len(ids))]
            for b in np.flatnonzero(np.diff(upto)).tolist():
                mine = order[upto[b] : upto[b + 1]]
                words = b" ".join(text[i] for i in first[mine].tolist())
                rows.append((b, chunk, packed(count[upto[b] : upto[b + 1]], np.frombuffer(words, np.uint8)), None, None))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "chunk", "blob", "n", "docs"])

        for b in batches:
            for part in pieces(b, "text", 1 << 22):
                ids = np.array(part.column(0).to_pylist(), np.int64)
                data, off = buffers(part.column(1))
                starts, ends, upto = spans(data, off)
                one, first, back = np.unique(hash_spans(data, starts, ends, lower=True), return_index=True, return_inverse=True)
                raw = data.tobytes().lower()
                text = [raw[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())]
                learn = np.repeat(np.array([not held_out(i) for i in ids.tolist()]), np.diff(upto))
                held.append((ids, np.diff(upto), one, text, back, learn))
                size += len(starts) + len(ids)
                if size > CHUNK_WORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, chunk long, blob binary, n long, docs long")


def contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id before each, and the one before that, within its word; ``first``: where words begin."""
    ids = ids.astype(np.int64)
    one = np.r_[BEFORE, ids[:-1]][: len(ids)]
    one[first] = BEFORE
    two = np.r_[BEFORE, one[:-1]][: len(ids)]
    two[first] = BEFORE
    return one, two


class Words:
    """Distinct words of a bucket as ids, each with ``STOP`` after its last; a word without ids is ``STOP`` alone."""

    def __init__(self, ids: np.ndarray, off: np.ndarray):
        self.ids, self.off = np.insert(ids.astype(np.int64), off[1:], STOP), off + np.arange(len(off))
        self.starts = self.ids[self.off[:-1]] if len(off) > 1 else self.ids[:0]
        first = np.zeros(len(self.ids), bool)
        first[self.off[:-1]] = True
        self.rest = np.flatnonzero(~first)  # places of ids but the first
        self.of = (np.searchsorted(self.off, self.rest, "right") - 1) if len(self.rest) else self.rest
        one, two = contexts(self.ids, first)
        self.three = (two << 32 | one << 16 | self.ids)[self.rest]
        self.two = (ANY << 32 | one << 16 | self.ids)[self.rest]


def gram_buckets(parts: int) -> int:
    """Buckets that count n-grams; fewer than those of words, as each of these sends a row to each."""
    return max(1, parts // 8)


KINDS = {"lexicon": 0, "counts": 1, "asked": 2, "grams": 3, "ids": 4}


def lexicon(asked: DataFrame, path: str | None, parts: int) -> DataFrame:
    """What each bucket knows, by kind: its distinct words (lexicon), which of them a chunk asked for (asked), its n-grams by the bucket ``to``
    that counts them (grams), and how often an id starts a word and stands elsewhere in one (ids)."""

    def bucket(no, chunks, blobs):
        cs, hs, ws = [], [], []
        for blob in blobs:
            c, data = unpacked(blob, np.int64, np.uint8)
            starts, ends, _ = spans(data, np.array([0, len(data)]))
            cs.append(c)
            hs.append(hash_spans(data, starts, ends))
            ws.append((data, starts, ends))
        words, first, back = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        total = np.bincount(back, np.concatenate(cs), len(words)).astype(np.int64)
        edge = np.cumsum([0, *map(len, hs)])
        at = np.searchsorted(edge, first, "right") - 1
        text = [ws[b][0][ws[b][1][i] : ws[b][2][i]].tobytes() for b, i in zip(at.tolist(), (first - edge[at]).tolist())]
        sizes = np.array([len(t) for t in text])
        stop = np.cumsum(sizes + 1) - 1
        flat = np.frombuffer(b" ".join(text), np.uint8)
        ids, off = word_tokens(path, None).encode(flat, np.r_[0, stop[:-1] + 1, len(flat)])
        own = Words(ids, off)
        yield KINDS["lexicon"], no, None, None, packed(total, ids.astype(np.uint16), off.astype(np.int64)), int(total.sum()), int((total > 0).sum())
        for chunk, a, z in zip(chunks, edge, edge[1:]):
            yield KINDS["asked"], no, chunk, None, packed(back[a:z].astype(np.int32)), None, None
        one, at = np.unique(np.r_[own.three, own.two], return_inverse=True)
        n = np.bincount(at, np.r_[total[own.of], total[own.of]], len(one)).astype(np.int64)
        to = (mix((one >> 16).astype(np.uint64)) % np.uint64(gram_buckets(parts))).astype(np.int64)
        order = np.argsort(to, kind="stable")
        upto = np.searchsorted(to[order], np.arange(gram_buckets(parts) + 1))
        for t in np.flatnonzero(np.diff(upto)).tolist():
            mine = order[upto[t] : upto[t + 1]]
            yield KINDS["grams"], no, None, t, packed(one[mine], n[mine]), None, None
        begin, later = np.bincount(own.starts, total, IDS), np.bincount(own.ids[own.rest], total[own.of], IDS)
        some = np.flatnonzero(begin + later)
        yield KINDS["ids"], no, None, None, packed(some, begin[some].astype(np.int64), later[some].astype(np.int64)), None, None

    def run(batches):
        for no, rows in by_number(batches, 0):
            rows = list(bucket(no, [r[1] for r in rows], [r[2] for r in rows]))
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096]), TYPES)], NAMES)
        release_tools()  # the process goes on to other stages

    return asked.where("bucket >= 0").select("bucket", "chunk", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, "kind int, bucket int, chunk long, to int, blob binary, a long, b long")


NAMES = ["kind", "bucket", "chunk", "to", "blob", "a", "b"]
TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())


def by_number(batches, column: int):
    """(number, rows) of runs of rows that share the value of ``column``; they are sorted by it."""
    number, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[column] != number and rows:
                yield number, rows
                rows = []
            number = row[column]
            rows.append(row)
    if rows:
        yield number, rows


def gram_counts(known: DataFrame, parts: int) -> DataFrame:
    """bucket, blob: for the n-grams of each bucket their counts and those of their contexts. An n-gram is counted where its context is."""

    def run(batches):
        for _, rows in by_number(batches, 0):
            asked = [unpacked(r[2], np.int64, np.int64) for r in rows]
            keys, back = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in asked]), len(keys)).astype(np.int64)
            _, of = np.unique(keys >> 16, return_inverse=True)
            total = np.bincount(of, n).astype(np.int64)[of]
            edge = np.cumsum([0, *(len(k) for k, _ in asked)])
            blobs = [packed(keys[back[a:z]], n[back[a:z]], total[back[a:z]]) for a, z in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return known.where(F.col("kind") == KINDS["grams"]).select("to", "bucket", "blob").repartition(gram_buckets(parts), "to").sortWithinPartitions("to").mapInArrow(run, "bucket int, blob binary")


def id_counts(known: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each id starts a training word, and stands elsewhere in one; added up in few tasks first, so that the driver gets some numbers an id."""

    def run(batches):
        begin, later = np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                at, x, y = unpacked(blob, np.int64, np.int64, np.int64)
                begin[at] += x
                later[at] += y
        some = np.flatnonzero(begin + later)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(begin[some]), pa.array(later[some])], ["id", "a", "b"])

    rows = known.where(F.col("kind") == KINDS["ids"]).select("blob").repartition(max(1, int(parts**0.5))).mapInArrow(run, "id long, a long, b long")
    begin, later = np.zeros(IDS), np.zeros(IDS)
    for r in rows.groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():  # at most the ids
        begin[r["id"]], later[r["id"]] = r["a"], r["b"]
    return begin, later


class Spelling:
    """Chances of the ids of a word after its first: trigrams within words, interpolated with bigrams, and those with single ids."""

    def __init__(self, later: np.ndarray):
        self.single = (later + 0.5) / (later.sum() + 0.5 * len(later))

    def prob(self, ids: np.ndarray, two: tuple[np.ndarray, np.ndarray], three: tuple[np.ndarray, np.ndarray], less: np.ndarray | float = 0.0) -> np.ndarray:
        """Of ids, from (counts, counts of the context) of their bigrams and trigrams; ``less`` is taken off all of them."""
        p = self.single[ids]
        for n, total in (two, three):
            off = np.minimum(less, n)
            p = (n - off + SMOOTH * p) / (total - off + SMOOTH)
        return p

    def of_words(self, words: Words, keys: np.ndarray, n: np.ndarray, total: np.ndarray, less: np.ndarray | float = 0.0) -> np.ndarray:
        """Log chance of each word's ids after its first; ``less``: occurrences of each word to leave out."""
        order = np.argsort(keys)
        found = [order[np.searchsorted(keys[order], k)] for k in (words.two, words.three)]
        part = less[words.of] if isinstance(less, np.ndarray) else less
        p = self.prob(words.ids[words.rest], *((n[i], total[i]) for i in found), part)
        return np.bincount(words.of, np.log(p), len(words.off) - 1)


def answers(known: DataFrame, grams: DataFrame, vocab: Vocabulary, spelling: Spelling, parts: int) -> DataFrame:
    """bucket, chunk, blob: for the words a chunk asked for, in their order, training count, model token, log chance of their other ids, and that chance
    without one occurrence of the word itself."""
    held = known.sparkSession.sparkContext.broadcast((vocab, spelling))  # some numbers an id
    rows = known.where(F.col("kind").isin(KINDS["lexicon"], KINDS["asked"])).select("bucket", "kind", "chunk", "blob")
    rows = rows.unionByName(grams.select("bucket", F.lit(KINDS["counts"]).alias("kind"), F.lit(None).cast("long").alias("chunk"), "blob"))

    def run(batches):
        vocab, spelling = held.value
        for no, rows in by_number(batches, 0):
            total, ids, off = unpacked(next(r[3] for r in rows if r[1] == KINDS["lexicon"]), np.int64, np.uint16, np.int64)
            words = Words(ids, off)
            counted = [unpacked(r[3], np.int64, np.int64, np.int64) for r in rows if r[1] == KINDS["counts"]]
            keys, n, context = (np.concatenate([c[i] for c in counted]) if counted else np.zeros(0, np.int64) for i in range(3))
            rare = vocab.log_rare[words.starts]
            rest = [spelling.of_words(words, keys, n, context, less) + rare for less in (0.0, np.minimum(total, 1).astype(float))]
            token = vocab.of[words.starts].astype(np.uint16)
            out = []
            for r in rows:
                if r[1] == KINDS["asked"]:
                    (at,) = unpacked(r[3], np.int32)
                    out.append((no, r[2], packed(total[at], token[at], *(x[at].astype(np.float32) for x in rest))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "chunk", "blob"])

    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(run, "bucket int, chunk long, blob binary")


def assembled(asked: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """chunk, docs, blob: each chunk as one row, its documents with what the buckets answered in the order of its words."""

    def run(batches):
        for chunk, rows in by_number(batches, 0):
            ids, sizes, at = unpacked(rows[0][2], np.int64, np.int64, np.int32)  # bucket -1
            answered = [unpacked(r[2], np.int64, np.uint16, np.float32, np.float32) for r in rows[1:]]
            cols = [np.concatenate([*(a[i] for a in answered), np.zeros(0, t)]) for i, t in enumerate((np.int64, np.uint16, np.float32, np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([packed(ids, sizes, at, *cols)], pa.binary())], ["chunk", "docs", "blob"])

    rows = asked.where("bucket = -1").select("chunk", "bucket", "blob").unionByName(told)
    return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, "chunk long, docs long, blob binary")


class Chunk:
    """A chunk's documents and words. The last word is the end of a text."""

    def __init__(self, blob: bytes, ends: int, end_token: int):
        self.ids, self.sizes, self.at, *cols = unpacked(blob, np.int64, np.int64, np.int32, np.int64, np.uint16, np.float32, np.float32)
        self.count, self.token, self.rest, self.rest_less = (np.append(c, c.dtype.type(last)) for c, last in zip(cols, (ends, end_token, 0.0, 0.0)))

    def texts(self, n: int, pick: np.ndarray, less: int = 0) -> Texts:
        """The documents in ``pick``; ``less`` occurrences of each word are left out, of ``n`` in all."""
        off = np.r_[0, np.cumsum(self.sizes)]
        sizes = self.sizes[pick]
        word = np.insert(self.at[ragged(off[pick], sizes)].astype(np.int64), np.cumsum(sizes), len(self.count) - 1)
        count = np.maximum(self.count[word] - less, 0)
        return Texts(self.token[word].astype(np.int32), word.astype(np.int32), (count / max(n - less, 1)).astype(np.float32), (self.rest_less if less else self.rest)[word].astype(np.float32), np.r_[0, np.cumsum(sizes + 1)])


def chunks(batches, ends: int, end_token: int):
    """The chunks of batches (blob)."""
    for b in batches:
        for blob in b.column(0):
            yield Chunk(blob.as_py(), ends, end_token)


def portions(sizes: np.ndarray, most: int = 1 << 17) -> list[np.ndarray]:
    """Runs of documents with about ``most`` words each, so that what is held for each word stays small."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes + 1) // most)) + 1)


def training_docs(chunk: Chunk) -> np.ndarray:
    return np.array([i for i, d in enumerate(chunk.ids.tolist()) if not held_out(d)], np.int64)


# ---- learning and scoring --------------------------------------------------------------------------


def first_docs(rows: DataFrame, vocab: Vocabulary, n: int, ends: int, most: int = FIRST_DOCS) -> np.ndarray:
    """Token counts of at most ``most`` training documents, from chunks in the order of their hashes."""
    size, take = 0, []
    for r in rows.select("chunk", "docs").orderBy(F.xxhash64("chunk")).limit(most).collect():  # each has a document at least
        if size < most:
            take.append(r["chunk"])
            size += r["docs"]
    end, width = int(vocab.of[END]), vocab.size

    def run(batches):
        for chunk in chunks(batches, ends, end):
            t = chunk.texts(n, training_docs(chunk)[:most])
            counts = [np.bincount(t.token[a:z], minlength=width).astype(np.int32).tobytes() for a, z in zip(t.off, t.off[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary())], ["c"])

    got = rows.where(F.col("chunk").isin(take)).select("blob").mapInArrow(run, "c binary").limit(most).collect() if take else []
    return np.array([np.frombuffer(r[0], np.int32) for r in got], np.float64).reshape(len(got), width)


def learn(rows: DataFrame, vocab: Vocabulary, n: int, ends: int, share: int = SHARE, least: int = LEAST_STEPS) -> Attention:
    """The average, by steps, of models trained side by side from one start, one for each ``share`` words of all training documents."""
    start = Attention(vocab, first_docs(rows, vocab, n, ends))
    trainers = max(1, -(-n // share))
    held, end = rows.sparkSession.sparkContext.broadcast(start.params()), int(vocab.of[END])
    names = list(Attention.NAMES)
    row = lambda steps, params: pa.RecordBatch.from_arrays([pa.array([steps], pa.int64()), *(pa.array([params[k].tobytes()], pa.binary()) for k in names)], ["n", *names])

    def run(batches):
        one_thread()

        def stream():
            kept, steps = [], 0
            for chunk in chunks(batches, ends, end):
                for batch in chunk.texts(n, training_docs(chunk), 1).training():
                    steps += 1
                    if steps < least * GROUP:
                        kept.append(batch)
                    else:
                        kept.clear()
                    yield batch
            for i in range(least * GROUP - steps if kept else 0):
                yield kept[i % len(kept)]

        with no_subnormals():
            model = Attention(**{k: v.copy() for k, v in held.value.items()}).train(stream())
        if model.losses:
            yield row(len(model.losses), model.params())

    def merge(batches):
        steps, total = 0, {k: 0.0 for k in names}
        for b in batches:
            for r in b.to_pylist():
                steps += r["n"]
                total = {k: total[k] + np.frombuffer(r[k], np.float32) * np.float32(r["n"]) for k in names}
        if steps:
            yield row(steps, {k: (v / np.float32(steps)).astype(np.float32) for k, v in total.items()})

    schema = "n long, " + ", ".join(f"{k} binary" for k in names)
    trained = cut(rows.select("blob").coalesce(trainers).mapInArrow(run, schema), "lm-trained")
    got = trained.repartition(max(1, int(trainers**0.5))).mapInArrow(merge, schema).collect()  # one row for many trainers
    steps = sum(r["n"] for r in got)
    if not steps:
        return start
    return Attention(**{k: sum(np.frombuffer(r[k], np.float32) * np.float32(r["n"] / steps) for r in got).astype(np.float32).reshape(v.shape) for k, v in start.params().items()})


def lm_score(docs: DataFrame, path: str | None = None, share: int = SHARE, least: int = LEAST_STEPS) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, named = docs.sparkSession, norm_docs(docs)
    parts = shuffle_parts(spark)
    asked = cut(ask(named, parts), "lm-asked")
    known = cut(lexicon(asked, path, parts), "lm-words")
    ends = named.where(F.crc32(F.when(F.col("doc_id") == NO_ID, "").otherwise(F.col("doc_id").cast("string"))) % 5 != 1).select("doc_id").count()
    sums = known.where(F.col("kind") == KINDS["lexicon"]).agg(F.sum("a"), F.sum("b")).first()
    n, v = ends + (sums[0] or 0), int(ends > 0) + (sums[1] or 0)
    begin, later = id_counts(known, parts)
    begin[END] += ends
    vocab, spelling = Vocabulary(begin), Spelling(later)
    rows = cut(assembled(asked, answers(known, gram_counts(known, parts), vocab, spelling, parts), parts), "lm-chunks")
    release(asked, known)
    model = learn(rows, vocab, n, ends, share, least)
    held, end = spark.sparkContext.broadcast(model.params()), int(vocab.of[END])  # bounded by TOP
    log = lambda k: np.log10((k + 0.5) / (n + 0.5 * (v + 1)))

    def run(batches):
        one_thread()
        model = Attention(**held.value).ready()
        for chunk in chunks(batches, ends, end):
            for some in portions(chunk.sizes):
                ids, m = chunk.ids[some], len(some)
                t = chunk.texts(n, some)
                of = np.repeat(np.arange(m), np.diff(t.off))
                count = chunk.count[t.word]
                with no_subnormals():
                    logs = t.log_probs(model)
                sums = lambda x: np.bincount(of, x, m)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([held_out(i) for i in ids.tolist()], pa.bool_()), pa.array(np.diff(t.off)), pa.array(sums(count > 0).astype(np.int64)), pa.array(np.full(m, n, np.int64)), pa.array(sums(log(count))), pa.array(sums(logs) / np.log(10))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    scored = rows.select("blob").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", real_id())
