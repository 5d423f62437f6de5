"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items scans every text once.

Normalised: A-Z lower-cased, words are runs of digits, letters a-z and anything beyond ASCII. The
patterns are all windows of ten consecutive words of an item (an item of fewer words is one pattern).
A document word inside any occurrence of a pattern is hit.

Null or wordless texts and items: no words, no hits. An empty benchmark leaves every document clean.
Items that repeat, or share windows, are each reported. Each document row gives one row, however large the benchmark is.
Items with a null id are patterns as well: together they count as one item, null in ``items`` and absent from its checksum.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import cut, norm_docs, real_id, without

WINDOW = 10
#: Bytes of benchmark texts that one automaton may hold; more items go to further automata, each with a pass of its own.
MOST_BYTES = 2 << 20
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, hits array<struct<first:long,last:long>>, spans array<struct<start:long,stop:long>>, items array<string>, row long"
_BUILT: dict = {}


def fold(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def patterns(items: list[tuple[str | None, str]], window: int = WINDOW) -> dict[str, tuple[int, set[str]]]:
    """Pattern text (each word with a blank on both sides) -> words in it, ids of the items that hold it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = fold((text or "").encode())
        for at in range(max(1, len(words) - window + 1)) if words else ():
            part = words[at : at + window]
            found.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), set()))[1].add(item)
    return found


def automaton(items: list[tuple[str, str]], window: int = WINDOW) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key, (n, ids) in patterns(items, window).items():
        found.add_word(key, (len(key), n, tuple(ids)))
    found.make_automaton()
    return found


def scan(machine, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words in the text, hit runs of words [first, last), items that occur."""
    raw = text.encode()
    words = fold(raw)
    if not words or not len(machine):
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    marks, ids, gaps = [], set(), None
    for end, (size, n, items) in machine.iter(line.decode("latin-1")):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        first = int(np.searchsorted(gaps, end - size + 1))
        marks.append((first, first + n))
        ids.update(items)
    runs: list[tuple[int, int]] = []
    for first, last in sorted(marks):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
        else:
            runs.append((first, last))
    return len(words), runs, ids


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the original text for runs of words."""
    if not runs:
        return []
    # A-Z count as word characters of the original: they become letters a-z when folded.
    at = [m.span() for m in re.finditer("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def groups(benchmark: DataFrame, most: int = MOST_BYTES) -> list[list[tuple[str, str]]]:
    """Items by groups of bounded size, fetched one item at a time: the driver holds one group in memory at once."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    group, size = [], 0
    for item, text in rows.toLocalIterator():
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append((item, text))
        size += len(text)
    yield group


def hits(docs: DataFrame, items: list[tuple[str, str]], window: int = WINDOW) -> DataFrame:
    """By rows of ``docs`` (doc_id, text, row): what the items' automaton finds."""
    held = docs.sparkSession.sparkContext.broadcast(items)  # at most MOST_BYTES of text
    key = hashlib.md5(repr((window, items)).encode()).hexdigest()

    def run(batches):
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = automaton(held.value, window)
        machine = _BUILT[key]
        for b in batches:
            rows = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                n, runs, ids = scan(machine, text)
                for col, x in zip(rows, (doc, n, [{"first": a, "last": z} for a, z in runs], [{"start": a, "stop": z} for a, z in original_spans(text, runs)], sorted(ids, key=lambda x: (x is None, x or "")))):
                    col.append(x)
            pair = lambda a, z: pa.list_(pa.struct([(a, pa.int64()), (z, pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pair("first", "last")), pa.array(rows[3], pair("start", "stop")), pa.array(rows[4], pa.list_(pa.string())), b.column(2)], ["doc_id", "n_words", "hits", "spans", "items", "row"])

    return docs.mapInArrow(run, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (character ranges of
    the original text), items. A benchmark beyond ``most`` bytes takes one pass over the texts for each group."""
    row = F.monotonically_increasing_id().alias("row")
    each = groups(benchmark, most)
    held = [next(each), *islice(each, 1)]
    if len(held) == 1:
        found = hits(norm_docs(docs, row), held[0], window)
    else:
        named = cut(norm_docs(docs, row), "decontaminate-rows")  # written, so that all passes see the same row numbers
        # one group at a time: its automaton is gone before the next is built
        found = reduce(DataFrame.unionByName, [cut(hits(named, g, window), "decontaminate-hits") for g in chain(held, each)])
        # hit runs of a row are merged again below; the size of a group is bounded by the row's words
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def merged(col: str, a: str, z: str):
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
        step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x[z] - F.greatest(x[a], s["to"]))).alias("n"), F.greatest(s["to"], x[z]).alias("to"))
        return F.aggregate(F.array_sort(col), start, step, lambda s: s["n"])

    items = F.array_sort(F.array_distinct("items"))
    n = merged("hits", "first", "last")
    return found.select(
        real_id(), "n_words", n.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n > 0).alias("contaminated"), F.array_sort(F.array_distinct("spans")).alias("spans"), items.alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, without contaminated documents."""
    return without(docs, decontaminate(docs, benchmark, window).where("contaminated").select("doc_id"))
