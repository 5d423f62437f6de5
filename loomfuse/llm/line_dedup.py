"""Line dedup: sharded cuckoo filters over exact reference counts; insertions and deletions can be undone.

A line's key is the line stripped of blanks, A-Z lower-cased. Keys of at least ``min_chars`` code
points held by two documents or more keep their lines only in the document with the smallest id.

State (``LineIndex``), logs in Parquet in the shared folder, of which a generation only adds rows:
  docs     doc_id, keys, gen              forward table: the keys of each indexed document, none twice
  gone     doc_id, gen                    documents deleted at a generation
  refs     shard, key, n, owner, gen, set exact reference counts and smallest holder: what a generation adds, or (set) sets anew
  filters  shard, blob                    cuckoo filters, with one cell for each key of the exact table

``insert`` asks a shard's filters first, without the exact table: a key that they deny is new. Only the others are looked up; a key that
the filters mistook for another gets a cell of its own, so that the deletion of one never makes the filter deny the other. ``delete``
sets anew the counts of the deleted documents' keys, takes keys without references out of the filters, and finds a new owner where the
old one left. Deleting what was inserted restores the counts. Logs of more than ``GENERATIONS`` are merged.

Null or empty text is one empty line. Short lines are never keys. Repeated rows are one document.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import NO_ID, cut, doc_key, free_name, norm_docs, real_id, shuffle_parts

MIN_CHARS = 10
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
REFS = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("n", pa.int64()), ("owner", pa.int64())])


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit key of a line, or None if it is too short to be one."""
    line = line.strip(BLANKS)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode()) < min_chars):
        return None
    return hashlib.blake2b(line.translate(LOWER), digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints, with two candidate buckets for each key."""

    def __init__(self, slots: int = 1 << 10, keys=()):
        keys = list(keys)
        n = 1 << max(4, (max(slots, int(len(keys) * 1.2)) // 4 - 1).bit_length())
        while not self._build(n, keys):
            n *= 2

    def _build(self, n: int, keys) -> bool:
        self.n, self.cells = n, array("H", bytes(8 * n))
        return all(self.insert(k) for k in keys)

    def _at(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[:8], "little") & (self.n - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def __contains__(self, key: bytes) -> bool:
        mark, one, two = self._at(key)
        return mark in self.cells[4 * one : 4 * one + 4] or mark in self.cells[4 * two : 4 * two + 4]

    def insert(self, key: bytes) -> bool:
        mark, one, two = self._at(key)
        for bucket in (one, two):
            for i in range(4 * bucket, 4 * bucket + 4):
                if not self.cells[i]:
                    self.cells[i] = mark
                    return True
        bucket, moved = one, []
        for turn in range(200):
            i = 4 * bucket + turn % 4
            moved.append((i, self.cells[i]))
            mark, self.cells[i] = self.cells[i], mark
            bucket = self._other(bucket, mark)
            for i in range(4 * bucket, 4 * bucket + 4):
                if not self.cells[i]:
                    self.cells[i] = mark
                    return True
        for i, old in reversed(moved):  # no place: as before
            self.cells[i] = old
        return False

    def delete(self, key: bytes) -> bool:
        mark, one, two = self._at(key)
        for i in (*range(4 * one, 4 * one + 4), *range(4 * two, 4 * two + 4)):
            if self.cells[i] == mark:
                self.cells[i] = 0
                return True
        return False

    def tobytes(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def frombytes(cls, blob: bytes) -> CuckooFilter:
        self = cls.__new__(cls)
        self.cells = array("H")
        self.cells.frombytes(blob)
        self.n = len(self.cells) // 4
        return self


class ShardFilter:
    """The cuckoo filters of a shard: when one is full, another of twice its size takes the next keys."""

    def __init__(self, blobs=()):
        self.filters = [CuckooFilter.frombytes(b) for b in blobs] or [CuckooFilter()]

    def __contains__(self, key: bytes) -> bool:
        return any(key in f for f in self.filters)

    def insert(self, key: bytes) -> None:
        if not self.filters[-1].insert(key):
            self.filters.append(CuckooFilter(slots=8 * self.filters[-1].n, keys=[key]))

    def delete(self, key: bytes) -> None:
        """Take a key's cell out. Where several filters have a like one its own is not known: it stays, and costs a look-up at most."""
        like = [f for f in self.filters if key in f]
        if len(like) == 1:
            like[0].delete(key)

    def blobs(self) -> list[bytes]:
        return [f.tobytes() for f in self.filters]


def forward(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, keys: the distinct keys of each row's lines."""

    def run(batches):
        for b in batches:
            keys = [list(dict.fromkeys(k for x in t.as_py().encode().split(b"\n") if (k := line_key(x, min_chars)))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.binary()))], ["doc_id", "keys"])

    return norm_docs(docs).mapInArrow(run, "doc_id long, keys array<binary>")


#: Keys that a task combines before it passes them on; only how well it combines depends on it.
COMBINE = 500_000


def combined(fwd: DataFrame, shards: int) -> DataFrame:
    """shard, key, n, owner: counts of each task's documents, so that a line of every third document is a row a task."""

    def run(batches):
        seen: dict[bytes, list[int]] = {}

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(k[10:14], "little") % shards for k in keys], pa.int32()), pa.array(keys, pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], schema=REFS)

        for b in batches:
            for doc, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in keys or ():
                    if found := seen.get(k):
                        found[0] += 1
                        found[1] = min(found[1], doc)
                    else:
                        seen[k] = [1, doc]
            if len(seen) >= COMBINE:
                yield out()
                seen.clear()
        yield out()

    return fwd.mapInArrow(run, "shard int, key binary, n long, owner long")


STATE = "shard int, key binary, n long, owner long, known boolean, blob binary"
DOC, GONE, REF, FILTER = "doc_id long, keys array<binary>, gen int", "doc_id long, gen int", "shard int, key binary, n long, owner long, gen int, set boolean", "shard int, blob binary"
#: Generations of a log before they are merged.
GENERATIONS = 16


def one_row_a_document(fwd: DataFrame) -> DataFrame:
    """``fwd`` (doc_id, keys) with no key twice for a document: rows of one id, if there are more, become a row a key."""
    repeated = fwd.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    more = fwd.join(repeated, "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key")).distinct()
    return fwd.join(repeated, "doc_id", "left_anti").select("doc_id", "keys").unionByName(more.select("doc_id", F.array("key").alias("keys")))


class LineIndex:
    def __init__(self, spark: SparkSession, shards: int, min_chars: int = MIN_CHARS, gen: int = 0, **logs: DataFrame):
        self.spark, self.shards, self.min_chars, self.gen = spark, shards, min_chars, gen
        self.logs = {name: logs.get(name) if logs.get(name) is not None else spark.createDataFrame([], kind) for name, kind in (("docs", DOC), ("gone", GONE), ("log", REF), ("filters", FILTER))}
        self.empty = not gen
        #: The keys that the last insertion had to look up in the exact table.
        self.looked_up = logs.get("looked_up")

    @classmethod
    def create(cls, spark: SparkSession, rows: int, min_chars: int = MIN_CHARS, rows_per_shard: int = 20_000) -> LineIndex:
        """An empty index. A task holds the filters of one shard, a few bytes a key."""
        return cls(spark, max(8, -(-rows // rows_per_shard)), min_chars)

    @property
    def docs(self) -> DataFrame:
        """doc_id, keys of the documents that the index holds."""
        gone = self.logs["gone"].groupBy("doc_id").agg(F.max("gen").alias("left"))
        return self.logs["docs"].join(gone, "doc_id", "left").where("left is null or gen > left").select("doc_id", "keys")

    @property
    def refs(self) -> DataFrame:
        """shard, key, n, owner of the keys that a document holds."""
        return self._state(self.logs["log"])

    @staticmethod
    def _state(log: DataFrame) -> DataFrame:
        # the last row that sets a key anew, and what was added since: a key has a row a generation at most
        rows = F.array_sort(F.collect_list(F.struct("gen", "set", "n", "owner")))
        add = lambda a, x: F.when(x["set"], F.struct(x["n"].alias("n"), x["owner"].alias("owner"))).otherwise(F.struct((a["n"] + x["n"]).alias("n"), F.least(a["owner"], x["owner"]).alias("owner")))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("owner"))
        state = log.groupBy("shard", "key").agg(rows.alias("rows")).select("shard", "key", F.aggregate("rows", none, add).alias("s"))
        return state.select("shard", "key", "s.n", "s.owner").where("n > 0")

    def _probe(self, change: DataFrame, how: str) -> DataFrame:
        """``change`` (shard, key, n, owner: one row a key) with known, what the filters said of each key, and rows of the filters (blob). "ask":
        keys that the filters deny get a cell; "add": all do; "drop": each loses its cell. The exact table is not read."""
        # a shard's filters first, then the keys
        held = self.logs["filters"].select("shard", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("owner"), "blob", F.lit(0).alias("turn"))
        both = held.unionByName(change.select("shard", "key", "n", "owner", F.lit(None).cast("binary").alias("blob"), F.lit(1).alias("turn")))
        both = both.repartition(min(self.shards, 8 * shuffle_parts(self.spark)), "shard").sortWithinPartitions("shard", "turn")

        def run(batches):
            names = ["shard", "key", "n", "owner", "known", "blob"]

            def done(number, held):
                blobs = held.blobs()
                none = pa.nulls(len(blobs))
                return pa.RecordBatch.from_arrays([pa.array([number] * len(blobs), pa.int32()), none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.bool_()), pa.array(blobs, pa.binary())], names)

            number, blobs, held = None, [], None
            for b in batches:
                known = []
                for no, key, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()):
                    if no != number:
                        if number is not None:
                            yield done(number, held or ShardFilter(blobs))
                        number, blobs, held = no, [], None
                    if key is None:
                        blobs.append(bits)
                        known.append(None)
                        continue
                    held = held or ShardFilter(blobs)
                    known.append(key in held)
                    if how == "drop":
                        held.delete(key)
                    elif how == "add" or not known[-1]:
                        held.insert(key)
                out = pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(known, pa.bool_()), pa.nulls(b.num_rows, pa.binary())], names)
                yield out.filter(pa.compute.is_valid(b.column(1)))
            if number is not None:
                yield done(number, held or ShardFilter(blobs))

        return cut(both.select("shard", "key", "n", "owner", "blob", "turn").mapInArrow(run, STATE), "line-probed")

    def _next(self, **logs: DataFrame) -> LineIndex:
        out = LineIndex(self.spark, self.shards, self.min_chars, self.gen + 1, **(self.logs | logs))
        return out.merged() if out.gen % GENERATIONS == 0 else out

    def merged(self) -> LineIndex:
        """The same index with logs of one generation."""
        docs, log = self.docs.withColumn("gen", F.lit(self.gen)), self.refs.withColumns({"gen": F.lit(self.gen), "set": F.lit(True)})
        return LineIndex(self.spark, self.shards, self.min_chars, self.gen, docs=cut(docs, "line-docs"), log=cut(log, "line-refs"), filters=self.logs["filters"], looked_up=self.looked_up)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with ``docs`` added; documents whose id it holds already are left as they are."""
        return self.insert_forward(cut(one_row_a_document(forward(docs, self.min_chars)), "line-docs"))

    def insert_forward(self, fwd: DataFrame) -> LineIndex:
        """``insert`` of (doc_id, keys) with no key twice for a document."""
        gen = F.lit(self.gen + 1).alias("gen")
        if not self.empty:
            fwd = fwd.join(self.docs.select("doc_id").distinct(), "doc_id", "left_anti")
        change = combined(fwd, self.shards).groupBy("shard", "key").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))
        probed = self._probe(change, "ask")
        filters, asked = probed.where("blob is not null").select("shard", "blob"), probed.where("known")
        # keys that the filters know but the exact table does not were taken for others
        mistaken = asked if self.empty else asked.join(self._state(self.logs["log"].join(asked.select("key"), "key", "left_semi")), "key", "left_anti")
        again = LineIndex(self.spark, self.shards, filters=filters)._probe(mistaken, "add")
        log = probed.where("key is not null").select("shard", "key", "n", "owner", gen, F.lit(False).alias("set"))
        looked_up = asked.select("key").limit(0) if self.empty else asked.select("key")
        return self._next(docs=self.logs["docs"].unionByName(fwd.select("doc_id", "keys", gen)), log=self.logs["log"].unionByName(log), filters=again.where("blob is not null").select("shard", "blob"), looked_up=looked_up)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose doc_id is in ``ids``."""
        ids = cut(ids.select(doc_key().alias("doc_id")).distinct(), "line-gone")
        gen = F.lit(self.gen + 1).alias("gen")
        less = combined(self.docs.join(ids, "doc_id", "left_semi"), self.shards).groupBy("key").agg(F.sum("n").alias("less"))
        now = self._state(self.logs["log"].join(less.select("key"), "key", "left_semi")).join(less, "key")
        now = cut(now.select("shard", "key", (F.col("n") - F.col("less")).alias("n"), "owner"), "line-refs")
        # where the owner left, the next document that holds the key follows
        lost = now.where("n > 0").join(ids.withColumnRenamed("doc_id", "owner"), "owner", "left_semi").select("key")
        left = self.docs.join(ids, "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key"))
        heirs = left.join(lost, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("heir"))
        log = cut(now.join(heirs, "key", "left").select("shard", "key", "n", F.when(F.col("n") > 0, F.coalesce("heir", "owner")).alias("owner"), gen, F.lit(True).alias("set")), "line-refs")
        filters = self._probe(now.where("n <= 0"), "drop").where("blob is not null").select("shard", "blob")
        return self._next(gone=self.logs["gone"].unionByName(ids.select("doc_id", gen)), log=self.logs["log"].unionByName(log), filters=filters)

    def drops(self) -> DataFrame:
        """doc_id, keys: the keys whose lines each document loses."""
        shared = self.refs.where("n > 1").select("key", "owner")
        each = self.docs.select("doc_id", F.explode("keys").alias("key"))
        return each.join(shared, "key").where("doc_id > owner").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """Per row of ``docs``: doc_id, n_lines, n_dropped, kept (text)."""
        min_chars = self.min_chars

        def run(batches):
            for b in batches:
                out = [[], [], []]
                for text, keys in zip(b.column(1), b.column(2)):
                    lines = text.as_py().encode().split(b"\n")
                    gone = set(keys.as_py() or ())
                    kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                    for col, x in zip(out, (len(lines), len(lines) - len(kept), b"\n".join(kept).decode())):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

        return norm_docs(docs).join(self.drops(), "doc_id", "left").select("doc_id", "text", "keys").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


#: The registered query takes documents into the index in so many batches by id.
BATCHES = 2


def indexed(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> LineIndex:
    """An index of ``docs``, taken in by ranges of ids, one after the other."""
    fwd = cut(one_row_a_document(forward(docs, min_chars)), "line-docs")
    ends = fwd.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.05) if batches > 1 else []
    index, last = LineIndex.create(docs.sparkSession, fwd.count(), min_chars), None
    for end in [*(int(e) for e in ends), None]:
        part = fwd if last is None else fwd.where(F.col("doc_id") > last)
        index, last = index.insert_forward(part if end is None else part.where(F.col("doc_id") <= end)), end
    return index


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Line dedup of a table: doc_id, n_lines, n_dropped, kept (text)."""
    index = indexed(docs, min_chars)
    return index.apply(docs).select(real_id(), "n_lines", "n_dropped", "kept")


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, with the lines left in ``text`` and their number of characters in ``n_chars``, if there is one.

    Null texts stay null; other columns may have any names."""
    index = indexed(docs, min_chars)
    schema, names = docs.schema, {c.lower(): i for i, c in enumerate(docs.columns)}
    here, there = free_name(docs, "keys"), free_name(docs, "id")
    drops = index.drops().select(F.col("doc_id").alias(there), F.col("keys").alias(here))
    every = docs.join(drops, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == drops[there], "left").drop(there)

    def run(batches):
        at = names["text"]
        for b in batches:
            keys, out = b.column(len(schema)), []
            for text, gone in zip(b.column(at), keys):
                gone = set(gone.as_py() or ())
                out.append(b"\n".join(x for x in text.as_py().encode().split(b"\n") if line_key(x, min_chars) not in gone).decode() if gone and text.is_valid else text.as_py())
            cols = list(b.columns[: len(schema)])
            cols[at] = pa.array(out, pa.string())
            if "n_chars" in names:
                i = names["n_chars"]
                cols[i] = pa.array([len(t) if k.is_valid and t is not None else n for t, k, n in zip(out, keys, b.column(i).to_pylist())], b.column(i).type)
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return every.mapInArrow(run, schema)
