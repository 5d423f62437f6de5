"""Lexical retrieval packing into sequences of at most 4096 tokens.

Documents are sorted by content, by two of the terms that tell most of them (``telling_terms``), and each ``shard_rows`` in that order are a
shard, so that documents of one subject and copies meet whatever their number. A shard holds a BM25 inverted index
of its documents; idf and mean length are those of all documents. A document fills whole windows by itself
first. What is left seeds windows, the longest first: the index returns its unused neighbours by BM25 score,
those that fit are taken in that order, and the best of the others is cut to fill the window; its rest stays
unused. Cuts lie on a grid of ``GRID`` tokens, so that a piece's checksum follows from those of prefixes and no
token ids are shuffled. Each shard leaves one sequence that may be short.

Null text is empty: a document of the end id alone. Each row is packed, repeated ones too; rows of one id are dealt like others. An
empty table gives no rows. Tokenizers of more than 65,536 ids are refused.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import buffers, cut, give_back, mix, norm_docs, pieces, ragged, real_id, shuffle_parts
from loomfuse.llm.tokens import release_tools, word_tokens

WINDOW, GRID, END, SHARD_ROWS = 4096, 32, 2, 2048
K1, B = 1.2, 0.75
#: A term in more than this part of a shard's documents has a row in its index; only the speed depends on it.
DENSE = 32
#: Bytes of text, and rows of digests, that a worker takes at once; only its memory depends on them.
TEXT, ROWS = 1 << 20, 1024
#: Shards whose pieces share an output file. A shard alone would leave a file of some 60 KB.
FILE_SHARDS = 16


# ---- checksums of pieces from checksums of prefixes ------------------------------------------


def _zero_operators(most: int = 40) -> np.ndarray:
    """Column b of row k: the CRC register with bit b set, after 2**k zero bytes."""
    step = np.zeros(32, np.uint64)  # one zero bit
    step[0] = 0xEDB88320
    step[1:] = [1 << i for i in range(31)]
    out, op = [], step
    for k in range(most + 3):
        if k >= 3:
            out.append(op)
        op = _apply(op, op)
    return np.array(out)


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for b in range(32):
        out ^= np.where((x >> np.uint64(b)) & np.uint64(1), op[b], np.uint64(0))
    return out


ZEROS = _zero_operators()


def crc_of_rest(whole: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the last ``size`` bytes, from those of the whole and of what comes before."""
    x = head.astype(np.uint64)
    for k in range(int(size.max()).bit_length() if len(size) else 0):
        on = (size >> k) & 1 == 1
        x[on] = _apply(ZEROS[k], x[on])
    return whole.astype(np.uint64) ^ x


# ---- digests -----------------------------------------------------------------------------------


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n (ids), crcs (uint32 of the prefixes at each grid point and at the end), terms (uint16), tf (uint32) of each row."""

    def run(batches):
        tool = word_tokens(path, END)
        if tool.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("packing takes tokenizers of at most 65,536 ids")
        for b in batches:
            for i, part in enumerate(pieces(b, "text", TEXT)):
                if i % 4 == 0:  # a cache of words and freed memory side by side are most of a worker
                    give_back()
                ids, off = tool.encode(*buffers(part.column(1)))
                raw, crcs, n = ids.astype("<u4").tobytes(), [], np.diff(off)
                for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                    crc, out = 0, []
                    for i in range(a, z, GRID):
                        crc = zlib.crc32(raw[4 * i : 4 * min(i + GRID, z)], crc)
                        out.append(crc)
                    crcs.append(np.array(out, np.uint32).tobytes())
                # the terms of all documents at once: sorted by document, then id
                key = np.repeat(np.arange(len(n), dtype=np.int64), n) << 16 | ids
                key.sort()
                head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                edge = np.searchsorted(key[head], np.arange(len(n) + 1, dtype=np.int64) << 16)
                terms, tfs = (key[head] & 0xFFFF).astype("<u2").tobytes(), np.diff(np.r_[head, len(key)]).astype("<u4").tobytes()
                edge = edge.tolist()
                split = lambda raw, size: pa.array([raw[size * a : size * z] for a, z in zip(edge, edge[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(crcs, pa.binary()), split(terms, 2), split(tfs, 4)], ["doc_id", "n", "crcs", "terms", "tfs"])
            give_back()

    return docs.mapInArrow(run, "doc_id long, n long, crcs binary, terms binary, tfs binary")


def by_rows(batches, rows: int = ROWS):
    """Slices of the batches with ``rows`` rows each or fewer; the tokenizer, which rows of digests no longer need, is dropped first."""
    release_tools()
    give_back()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def document_frequencies(made: DataFrame) -> np.ndarray:
    """For each of the 2**16 term ids the number of documents with it; the vocabulary bounds what reaches the driver."""

    def run(batches):
        df = np.zeros(1 << 16, np.int64)
        for b in by_rows(batches):
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint16), minlength=1 << 16)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["term", "df"])

    out = np.zeros(1 << 16)
    for r in made.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r[0]] = r[1]
    return out


def telling_terms(terms: np.ndarray, tfs: np.ndarray, of: np.ndarray, n: int, df: np.ndarray, n_docs: int) -> np.ndarray:
    """(n, 2): of each document two terms, drawn by weight among those that another document has too; 65535 for none.

    The weight is a term's BM25 score, and the draw the same for all documents (the least of exponential numbers over weights), so that
    two documents draw the same term about as often as their weighted terms are the same. ``of``: the document of each term, rising; each has
    a term."""
    tf = tfs.astype(np.float64)
    weight = np.where(df[terms] > 1, tf / (tf + K1) * np.log1p((n_docs - df[terms] + 0.5) / (df[terms] + 0.5)), 0.0)
    out, first = np.full((n, 2), 65535), np.searchsorted(of, np.arange(n))
    for k in (0, 1):
        chance = (mix(np.arange(1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(k + 1)) >> np.uint64(11)).astype(np.float64) / 2**53
        score = weight / -np.log(np.maximum(chance, 1e-12))[terms]
        best = np.maximum.reduceat(score, first)
        at = np.flatnonzero((score == best[of]) & (score > 0))
        docs, one = np.unique(of[at], return_index=True)  # the smallest term of equal ones
        out[docs, k] = terms[at[one]]
    return out


def with_terms(batches, df: np.ndarray, n_docs: int):
    """Batches of digests with the telling terms of their rows."""
    for b in by_rows(batches):
        terms, tfs = (b.column(i).to_pylist() for i in (3, 4))
        sizes = [len(t) // 2 for t in terms]
        t = telling_terms(np.frombuffer(b"".join(terms), np.uint16), np.frombuffer(b"".join(tfs), np.uint32), np.repeat(np.arange(len(sizes)), sizes), len(sizes), df, n_docs)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t[:, 0], pa.int32()), pa.array(t[:, 1], pa.int32())], ["doc_id", "n", "crcs", "terms", "tfs", "t1", "t2"])


def by_content(made: DataFrame, df: np.ndarray, n_docs: int) -> DataFrame:
    """``made`` with t1 and t2, the telling terms."""
    held = made.sparkSession.sparkContext.broadcast(df)  # 2**16 numbers
    return made.select("doc_id", "n", "crcs", "terms", "tfs").mapInArrow(lambda batches: with_terms(batches, held.value, n_docs), "doc_id long, n long, crcs binary, terms binary, tfs binary, t1 int, t2 int")


# ---- one shard ----------------------------------------------------------------------------------


class Index:
    """BM25 over a shard's documents: for each term its documents and what it adds to their scores. Terms that many documents hold have a row
    with a score for each document instead."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], lengths: np.ndarray, df: np.ndarray, n_docs: int, mean: float):
        self.terms, self.n = terms, len(terms)
        flat, tf = np.concatenate(terms).astype(np.int64), np.concatenate(tfs).astype(np.float64)
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        score = (idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))).astype(np.float32)
        often = np.bincount(flat, minlength=1 << 16) > max(self.n // DENSE, 1)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        full = often[flat]
        self.rows = np.zeros((int(often.sum()), self.n), np.float32)
        self.rows[self.row[flat[full]], doc[full]] = score[full]
        flat, doc, score = flat[~full], doc[~full], score[~full]
        order = np.argsort(flat, kind="stable")
        self.doc, self.score = doc[order], score[order].astype(np.float64)
        self.first = np.searchsorted(flat[order], np.arange((1 << 16) + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Scores of all documents of the shard for the terms of ``seed``."""
        t = self.terms[seed].astype(np.int64)
        row = self.row[t]
        t = t[row < 0]
        at = ragged(self.first[t], self.first[t + 1] - self.first[t])
        return np.bincount(self.doc[at], self.score[at], self.n) + self.rows[row[row >= 0]].sum(0)


def pack_shard(lengths: np.ndarray, neighbours, window: int = WINDOW, grid: int = GRID) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    out, seq = [], 0
    start, left = np.zeros(len(lengths), np.int64), lengths.astype(np.int64).copy()
    for d in np.flatnonzero(left >= window).tolist():
        while left[d] >= window:
            out.append((d, int(start[d]), window, seq, 0))
            start[d], left[d], seq = start[d] + window, left[d] - window, seq + 1
    for seed in np.argsort(-left, kind="stable").tolist():
        if not left[seed]:
            continue
        out.append((seed, int(start[seed]), int(left[seed]), seq, 0))
        at = int(left[seed])
        left[seed] = 0
        free = np.flatnonzero(left)
        if len(free) and at < window:
            score = neighbours(seed)[free]
            ranked = free[np.lexsort((free, -score))]
            need, most = left[ranked], window - at
            # whole neighbours in the order of their scores, as long as any fits
            p = 0
            while most and p < len(ranked):
                fits = np.flatnonzero(need[p:] <= most)
                if not len(fits):
                    break
                p += int(fits[0])
                d = int(ranked[p])
                out.append((d, int(start[d]), int(need[p]), seq, at))
                at, most, left[d] = at + int(need[p]), most - int(need[p]), 0
                p += 1
            part = most // grid * grid
            rest = ranked[left[ranked] > part] if part else ranked[:0]
            if len(rest):
                d = int(rest[0])
                out.append((d, int(start[d]), part, seq, at))
                start[d], left[d] = start[d] + part, left[d] - part
        seq += 1
    return out


def pack(docs: DataFrame, path: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    made = cut(digests(norm_docs(docs), path), "packing-digests")
    n_docs, total = made.agg(F.count("*"), F.sum("n")).first()
    df = document_frequencies(made)
    held = spark.sparkContext.broadcast(df)  # 2**16 numbers
    mean = (total or 1) / max(n_docs, 1)
    order = ["t1", "t2", "n", "doc_id", "crcs"]
    parts = max(1, min(-(-n_docs // shard_rows), 4 * shuffle_parts(spark)))
    dealt = by_content(made, df, n_docs).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(number, ids, n, crcs, terms, tfs):
        n = np.array(n, np.int64)
        index = Index([np.frombuffer(t, np.uint16) for t in terms], [np.frombuffer(t, np.uint32) for t in tfs], n, held.value, n_docs, mean)
        d, s, size, seq, off = np.array(pack_shard(n, index.neighbours), np.int64).T
        flat = np.frombuffer(b"".join(crcs), np.uint32)
        first = np.r_[0, np.cumsum([len(c) // 4 for c in crcs])[:-1]]
        whole = flat[first[d] + -(-(s + size) // GRID) - 1]
        head = np.where(s > 0, flat[first[d] + np.maximum(s // GRID - 1, 0)], 0)
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[d]), pa.array(s), pa.array(size), pa.array(crc_of_rest(whole, head, 4 * size).astype(np.int64)), pa.array(n[d]), pa.array(number + seq), pa.array(off)], names)

    def run(batches):
        # sequences count on from shard to shard; a partition has fewer than 2**40
        number, rows = TaskContext.get().partitionId() << 40, [[] for _ in range(5)]

        def shards(last: bool):
            nonlocal number, rows
            # of the rows that are left at the end, half a shard or less joins the shard before
            while len(rows[0]) >= 2 * shard_rows or (last and rows[0]):
                take = shard_rows if len(rows[0]) > 1.5 * shard_rows else len(rows[0])
                out = packed(number, *(r[:take] for r in rows))
                number, rows = int(np.max(out.column(5).to_numpy())) + 1, [r[take:] for r in rows]
                yield out

        for b in by_rows(batches):
            for r, c in zip(rows, b.columns):
                r.extend(c.to_pylist())
            yield from shards(False)
        yield from shards(True)

    out = dealt.select("doc_id", "n", "crcs", "terms", "tfs").mapInArrow(run, ", ".join(f"{x} long" for x in names))
    # a sequence's pieces stay together, in files of many shards
    return out.withColumn("doc_id", real_id()).repartition(max(1, -(-n_docs // (FILE_SHARDS * shard_rows))), "sequence_id")
