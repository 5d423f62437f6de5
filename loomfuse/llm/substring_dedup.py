"""Substring dedup by super-k-mer partitioning.

A window is 50 consecutive words of one document. Its minimiser is the smallest hash among its runs of
``M`` words; consecutive windows with the same minimiser travel together, as one packed string of words,
to the minimiser's bucket, so equal windows always meet. There all windows are sorted by hash, equal
hashes are confirmed on the bytes, and each window finds the smallest doc_id that holds it. A word is removed
if a window over it also starts in a document with a smaller doc_id.

A task passes on each distinct string once, for its smallest document; its other documents are decided on
the spot. So a passage that every third document holds costs its bucket one row a task.

Null or empty texts have no words; texts under 50 words lose none. A row that repeats a document changes nothing.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import buffers, hash_spans, hash_windows, mix, norm_docs, pieces, ragged, real_id, shuffle_parts, spans

WINDOW, M = 50, 8
#: Bytes of distinct strings that a task combines before it passes them on; only how well it combines depends on it.
COMBINE = 40 << 20
#: Buckets a shuffle partition, so that a task holds one small bucket at a time.
SPLIT = 8


def sliding_min(v: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while 2 * have <= size:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (size - have)], v[size - have :]) if size > have else v


def canonical(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one blank apart, with their new starts and ends."""
    sizes = ends - starts
    out = np.append(data, np.uint8(32))[ragged(starts, sizes + 1)]
    at = np.cumsum(sizes + 1)
    out[at - 1] = 32
    return out, at - 1 - sizes, at - 1


def super_kmers(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, m: int = M):
    """(document, first word in it, windows, mixed minimiser, packed string) of each super-k-mer of the texts."""
    starts, ends, upto = spans(data, offsets)
    n = len(starts)
    if n < window:
        return
    least = sliding_min(hash_windows(hash_spans(data, starts, ends), m), window - m + 1)  # at word i: of the window from i
    doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    good = np.zeros(n, bool)
    good[: n - window + 1] = doc[: n - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(good)
    if not len(at):
        return
    value = least[at]
    new = np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])]
    first = at[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(at)])
    text, cs, ce = canonical(data, starts, ends)
    raw = text.tobytes()
    for d, i, k, v, a, z in zip(doc[first].tolist(), (first - upto[doc[first]]).tolist(), count.tolist(), (mix(value[new]) >> np.uint64(1)).tolist(), cs[first].tolist(), ce[first + count + window - 2].tolist()):
        yield d, i, k, v, raw[a:z]


def pack(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    """(doc, text hash, first word, string) rows as one compressed blob; an empty string repeats the one before."""
    nums = np.array([r[:3] for r in rows], np.int64).T
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", len(rows)) + nums.tobytes() + sizes.tobytes() + b"".join(r[3] + b" " for r in rows if r[3]))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    return np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n), np.frombuffer(raw, np.int64, n, 8 + 24 * n), raw[8 + 32 * n :]


SENT = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("doc", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def decided(buckets: list[int], ranges: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*ranges)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.nulls(len(ranges), pa.binary()), *(pa.array(c, pa.int64()) for c in cols)], schema=SENT)


def partition(docs: DataFrame, buckets: int, window: int, m: int) -> DataFrame:
    """bucket, blob of distinct strings; or, with no blob, doc, th, first, last of word ranges that the task could decide."""

    def run(batches):
        held: dict[bytes, list] = {}  # string -> bucket, smallest doc, its (text hash, first word) places, words
        size, lost = 0, []

        def flush():
            by: dict[int, list] = {}
            for text, (bucket, doc, places, _) in held.items():
                by.setdefault(bucket, []).extend((doc, th, i, b"" if j else text) for j, (th, i) in enumerate(places))
            for bucket, rows in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((bucket, pack(rows), None, None, None, None), SENT.types)], schema=SENT)
            if lost:
                yield decided([hash(x[:3]) % buckets for x in lost], lost)
            held.clear()
            lost.clear()

        for b in batches:
            for part in pieces(b, "text"):
                ids, ths = part.column(0).to_pylist(), part.column(2).to_pylist()
                for d, i, k, v, text in super_kmers(*buffers(part.column(1)), window, m):
                    doc, words = ids[d], k + window - 1
                    old = held.get(text)
                    if old is None:
                        held[text] = [v % buckets, doc, [(ths[d], i)], words]
                        size += len(text) + 250
                    elif doc > old[1]:
                        lost.append((doc, ths[d], i, i + words))
                    elif doc < old[1]:
                        lost.extend((old[1], th, at, at + words) for th, at in old[2])
                        old[1:3] = doc, [(ths[d], i)]
                    else:
                        old[2].append((ths[d], i))
                if size > COMBINE or len(lost) > 200_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, "bucket int, blob binary, doc long, th long, first long, last long")


def repeats(blobs: list[bytes], window: int) -> list[tuple[int, int, int, int]]:
    """doc, th, first, last: word ranges of a bucket's strings whose windows a smaller document has too."""
    nums, sizes, texts = zip(*map(unpack, blobs))
    nums, sizes, text = np.concatenate(nums, 1), np.concatenate(sizes), b"".join(texts)
    data = np.frombuffer(text, np.uint8)
    whole = np.flatnonzero(sizes)  # rows that bring a string; those after it without one share it
    ends_at = np.cumsum(sizes[whole] + 1)
    starts, ends, upto = spans(data, np.r_[0, ends_at])
    hashes = hash_windows(hash_spans(data, starts, ends), window)
    n_words = np.diff(upto)
    at = ragged(upto[:-1], n_words - window + 1)  # first words of windows
    owner = np.repeat(np.arange(len(whole)), n_words - window + 1)
    h, doc = hashes[at], nums[0][whole][owner]
    order = np.lexsort((doc, h))
    hs = h[order]
    head = np.maximum.accumulate(np.where(np.r_[True, hs[1:] != hs[:-1]], np.arange(len(hs)), 0))
    one, other = order, order[head]  # each window, and the window of the smallest document with its hash
    pick = doc[one] > doc[other]
    one, other = one[pick], other[pick]
    turn = np.argsort(one, kind="stable")
    one, other = one[turn], other[turn]
    flagged = np.zeros(len(at), bool)
    if len(one):
        # confirm on the bytes, whole chains of windows at a time
        new = np.r_[True, (np.diff(one) != 1) | (np.diff(other) != 1) | (np.diff(owner[one]) != 0) | (np.diff(owner[other]) != 0)]
        begin = np.flatnonzero(new)
        stop = np.r_[begin[1:], len(one)] - 1
        a, z = starts[at[one[begin]]], ends[at[one[stop]] + window - 1]
        b, y = starts[at[other[begin]]], ends[at[other[stop]] + window - 1]
        odd = set()
        for i, j, p, q, f, g in zip(a.tolist(), z.tolist(), b.tolist(), y.tolist(), begin.tolist(), stop.tolist()):
            if text[i:j] == text[p:q]:
                flagged[one[f : g + 1]] = True
            else:
                odd.update(h[one[f : g + 1]].tolist())
        for value in odd:  # different windows with one hash: settle them by their bytes
            least: dict[bytes, int] = {}
            same = np.flatnonzero(h == np.uint64(value))
            say = lambda w: text[starts[at[w]] : ends[at[w] + window - 1]]
            for w in same:
                least[say(w)] = min(least.get(say(w), int(doc[w])), int(doc[w]))
            for w in same:
                flagged[w] = least[say(w)] < doc[w]
    hit = np.flatnonzero(flagged)
    if not len(hit):
        return []
    new = np.r_[True, (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)]
    begin = np.flatnonzero(new)
    stop = np.r_[begin[1:], len(hit)] - 1
    out = []
    until = np.r_[whole[1:], len(sizes)]
    for s, f, g in zip(owner[hit[begin]].tolist(), (at[hit[begin]] - upto[owner[hit[begin]]]).tolist(), (at[hit[stop]] - upto[owner[hit[stop]]] + window).tolist()):
        out.extend((int(nums[0, r]), int(nums[1, r]), int(nums[2, r]) + f, int(nums[2, r]) + g) for r in range(whole[s], until[s]))
    return out


def removed_ranges(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """doc, th, first, last: ranges of words to remove; they may overlap."""
    parts = shuffle_parts(docs.sparkSession)
    sent = partition(docs, SPLIT * parts, window, m).repartition(parts, "bucket").sortWithinPartitions("bucket")

    def run(batches):
        number, blobs = None, []
        for b in batches:
            alone = b.filter(pa.compute.is_null(b.column(1)))
            if alone.num_rows:
                yield alone.select(["doc", "th", "first", "last"])
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if blob.is_valid:
                    if bucket != number and blobs:
                        yield decided([number] * len(r := repeats(blobs, window)), r).select(["doc", "th", "first", "last"])
                        blobs = []
                    number = bucket
                    blobs.append(blob.as_py())
        if blobs:
            yield decided([number] * len(r := repeats(blobs, window)), r).select(["doc", "th", "first", "last"])

    return sent.mapInArrow(run, "doc long, th long, first long, last long")


def substring_dedup(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept (the words left, one blank apart)."""
    named = norm_docs(docs).withColumn("th", F.xxhash64("text"))
    gone = removed_ranges(named, window, m).groupBy(F.col("doc").alias("doc_id"), "th").agg(F.collect_list(F.struct("first", "last")).alias("gone"))

    def run(batches):
        for b in batches:
            out = [[], [], []]
            for text, ranges in zip(b.column(1), b.column(2)):
                words = text.as_py().encode().split()
                n = len(words)
                if ranges.is_valid:
                    keep = np.ones(n, bool)
                    for r in ranges.as_py():
                        keep[r["first"] : r["last"]] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                for col, x in zip(out, (n, n - len(words), b" ".join(words).decode())):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    both = named.join(gone, ["doc_id", "th"], "left").select("doc_id", "text", "gone")
    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string").select(real_id(), "n_words", "n_removed", "kept")
