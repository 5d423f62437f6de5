"""Periodic runs of words, by block convolution, and their removal.

A run is a maximal stretch of words with smallest period q, at least ``LEAST`` words and three periods long. Two thirds of it
repeat q words later, so at the scale s (a power of two, 8 or q / 2 < s <= q) a block of s words that starts at a multiple
of s lies in the run together with its copy q words on. At each scale the blocks are convolved with the 3 s - 1 words that
begin with them: the sum of squared differences of word numbers, for every distance below 2 s at once, by a number-theoretic
transform in whole numbers modulo a prime. Sums of zero are the distances at which the block occurs again; each seeds an
extension to both sides, which compares words and so settles the (rare) sum that is only a multiple of the prime.

Two tests save transforms, neither of which loses a run: a block with a word that does not return within 2 s words occurs
nowhere in its window; and what lies within a known run of a period of at most s has no other smallest period.

Null text has no words. A document without id is never planted. Rows are worked on one by one, so a repeated row is returned
as often as it is there; other columns are not read. Words are told apart by 128 bits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import NO_ID, buffers, hash_spans, mix, norm_docs, pieces, ragged, real_id, spans

LEAST, SMALL = 24, 8
#: A prime with roots of unity of order 2**27, and its generator: windows of up to 2**27 words.
PRIME, GENERATOR = 15 * 2**27 + 1, 31
P = np.uint64(PRIME)
CELLS = 1 << 18
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def roots(n: int, back: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order n."""
    if (n, back) not in _ROOTS:
        w = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        w = pow(w, -1, PRIME) if back else w
        out = np.ones(1, np.uint64)
        while len(out) < n // 2:
            out = np.concatenate([out, out * np.uint64(pow(w, len(out), PRIME)) % P])
        if n > 1 << 16:
            return out
        _ROOTS[n, back] = out
    return _ROOTS[n, back]


def forward(a: np.ndarray) -> np.ndarray:
    """Transform of each row (a power of two long, values below the prime); places are in bit-reversed order."""
    rows, n = a.shape
    size = n
    while size > 1:
        v = a.reshape(rows, n // size, 2, size // 2)
        x, y = v[:, :, 0], v[:, :, 1]
        total, rest = x + y, (x + (P - y)) * roots(size, False) % P
        a = np.stack([np.minimum(total, total - P), rest], 2)  # below zero wraps round, so the lesser is the remainder
        size //= 2
    return a.reshape(rows, n)


def backward(a: np.ndarray) -> np.ndarray:
    """The inverse of ``forward``."""
    rows, n = a.shape
    size = 2
    while size <= n:
        v = a.reshape(rows, n // size, 2, size // 2)
        x, y = v[:, :, 0], v[:, :, 1] * roots(size, True) % P
        total, rest = x + y, x + (P - y)
        a = np.stack([np.minimum(total, total - P), np.minimum(rest, rest - P)], 2)
        size *= 2
    return a.reshape(rows, n) * np.uint64(pow(n, -1, PRIME)) % P


def mismatches(ids: np.ndarray, at: np.ndarray, s: int) -> np.ndarray:
    """For each block ids[a : a + s] and distance below 2 s: the sum of squared differences to the words that far on, modulo the
    prime. Words beyond the end count as zero."""
    place = at[:, None] + np.arange(4 * s)
    window = np.where((place < len(ids)) & (np.arange(4 * s) < 3 * s - 1), ids[np.minimum(place, len(ids) - 1)], 0).astype(np.uint64) % P
    block = np.zeros_like(window)
    block[:, :s] = window[:, s - 1 :: -1] if s == 1 else window[:, :s][:, ::-1]
    cross = backward(forward(window) * forward(block) % P)[:, s - 1 : 3 * s - 1]
    square = np.zeros((len(at), 4 * s + 1), np.uint64)
    np.cumsum(window * window % P, axis=1, out=square[:, 1:])
    moving = square[:, s : 3 * s] - square[:, : 2 * s]
    return (moving + square[:, s : s + 1] + np.uint64(2) * (P - cross)) % P


class Known:
    """Runs found so far; asks whether spans lie inside one."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        runs = sorted(runs)
        self.starts = np.array([r[0] for r in runs], np.int64)
        self.ends = np.maximum.accumulate(np.array([r[1] for r in runs], np.int64)) if runs else np.zeros(0, np.int64)

    def hold(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(a), bool)
        i = np.searchsorted(self.starts, a, "right") - 1
        return (i >= 0) & (self.ends[np.maximum(i, 0)] >= z)


def agree(ids: np.ndarray, at: int, d: int, step: int) -> int:
    """How many words from ``at`` on, in the direction of ``step``, equal those d words later."""
    n, size = 0, 64
    most = len(ids) - d - at if step > 0 else at + 1
    while n < most:
        k = min(size, most - n)
        lo = at + n if step > 0 else at - n - k + 1
        same = ids[lo : lo + k] == ids[lo + d : lo + d + k]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return n + int(same.argmin())
        n, size = n + k, min(size * 2, 1 << 20)
    return n


def primes_of(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def next_distance(ids: np.ndarray) -> np.ndarray:
    """How far on each word stands again; far beyond the end if it does not."""
    by = np.argsort(ids, kind="stable")
    out = np.full(len(ids), 1 << 60)
    same = ids[by[1:]] == ids[by[:-1]]
    out[by[:-1][same]] = (by[1:] - by[:-1])[same]
    return out


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of word numbers, by start and period."""
    n = len(ids)
    gap = next_distance(ids)
    runs: list[tuple[int, int, int]] = []
    s = SMALL
    while s * 2 <= n and (s == SMALL or 3 * s <= n):
        known = Known(runs)
        blocks = n // s
        near = gap[: blocks * s].reshape(blocks, s).max(1) < 2 * s
        at = np.flatnonzero(near) * s
        at = at[~known.hold(at, np.minimum(at + 3 * s - 1, n))]
        low = 1 if s == SMALL else s
        found = []
        step = max(1, CELLS // (4 * s))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            b, d = np.nonzero(mismatches(ids, part, s) == 0)
            a = part[b]
            fine = (d >= low) & (a + d + s <= n)
            found.append(np.c_[d[fine], a[fine]])
        seeds = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        seeds = seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))]
        for d in np.unique(seeds[:, 0]).tolist():
            mine = seeds[seeds[:, 0] == d, 1]
            if s == SMALL:
                known = Known([r for r in runs if r[2] <= s])  # runs of this scale's smaller distances as well
            mine = mine[~known.hold(mine, mine + d + s)]
            upto = -1
            for a in mine.tolist():
                if a + d + s <= upto:
                    continue
                ahead = agree(ids, a, d, 1)
                if ahead < s:  # a sum that is a multiple of the prime
                    continue
                lo = a - agree(ids, a - 1, d, -1)
                upto = hi = a + ahead + d
                if hi - lo >= max(least, 3 * d) and not any((ids[lo : lo + d] == ids[lo + d // p : lo + d // p + d]).all() for p in primes_of(d)):
                    runs.append((lo, hi, d))
        s *= 2
    return sorted({(a, z, q) for a, z, q in runs}, key=lambda r: (r[0], r[2]))


def planted_from(doc_id: int, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on, a planted document repeats p words. A fixed rule of the query's."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n or doc_id == NO_ID:
        return None
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


def worth(number: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Texts that may have a run: those with eight words in a row, from a multiple of eight on, that all stand again within a third of
    the text. ``number``: the words of all texts, told apart between texts as well."""
    size = np.diff(upto)
    again = next_distance(number) <= np.repeat(size // 3, size)
    blocks = size // SMALL
    first = ragged(upto[:-1], blocks * SMALL)
    full = again[first].reshape(-1, SMALL).all(1)
    return np.bincount(np.repeat(np.arange(len(size)), blocks)[full], minlength=len(size)) > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
NAMES = ["doc_id", "n_words", "runs", "collapsed"]
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _one(raw: bytes, one: np.ndarray, two: np.ndarray, source: np.ndarray | None, may: bool, least: int) -> tuple[list, bytes]:
    """Runs, and the text that is left, of a document: its words' two hashes and, if words were moved, where they come from."""
    runs = runs_of(np.unique(one, return_inverse=True)[1], least) if may else []
    if any(not np.array_equal(two[a : z - q], two[a + q : z]) for a, z, q in runs):  # two words have one hash
        pair = np.empty(len(one), [("a", np.uint64), ("b", np.uint64)])
        pair["a"], pair["b"] = one, two
        runs = runs_of(np.unique(pair, return_inverse=True)[1], least)
    words = raw.split()  # at the six blanks of ASCII
    if source is not None:
        words = [words[i] for i in source.tolist()]
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for a, z, q in runs:
            edge[a + q] += 1
            edge[z] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return [{"start": a, "length": z - a, "period": q} for a, z, q in runs], b" ".join(words)


def find_runs(docs: DataFrame, planted: bool = False, least: int = LEAST) -> DataFrame:
    """Per document row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words that no run
    repeats, joined by single blanks). ``planted``: documents are first made periodic by ``planted_from``."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, "text"):
                data, offsets = buffers(b.column(1))
                raw = data.tobytes()
                starts, ends, upto = spans(data, offsets)
                one, two = (hash_spans(data, starts, ends, which) for which in (0, 1))
                moved: dict[int, np.ndarray] = {}
                if planted:
                    for i, (doc, n) in enumerate(zip(b.column(0).to_pylist(), np.diff(upto).tolist())):
                        if rule := planted_from(doc, n):
                            a, p = rule
                            moved[i] = np.r_[np.arange(a), a + np.arange(n - a) % p]
                            one[upto[i] : upto[i + 1]], two[upto[i] : upto[i + 1]] = one[upto[i] + moved[i]], two[upto[i] + moved[i]]
                may = worth(mix(one + np.repeat(np.arange(1, len(upto), dtype=np.uint64), np.diff(upto)) * np.uint64(0x9E3779B97F4A7C15)), upto)
                found = [_one(raw[offsets[i] : offsets[i + 1]], one[upto[i] : upto[i + 1]], two[upto[i] : upto[i + 1]], moved.get(i), bool(may[i]), least) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(upto)), pa.array([f[0] for f in found], pa.list_(RUN)), pa.array([f[1].decode() for f in found], pa.string())], NAMES)

    return norm_docs(docs).mapInArrow(run, SCHEMA).select(real_id(), *NAMES[1:])


def periodic_runs(docs: DataFrame, planted: bool = False, least: int = LEAST) -> DataFrame:
    """Per document row: doc_id, n_runs; start, length, period and exponent_milli of the run with most periods (ties: the first; none:
    nulls); digests of all runs and of the text left; n_words."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), more)
    got = find_runs(docs, planted, least).withColumn("best", best)
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
