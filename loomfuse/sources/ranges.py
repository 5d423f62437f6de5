"""Records of exports larger than a task: found by byte ranges in parallel, then parsed by Spark's own functions.

Spark's text source cuts a file into ranges at a separator byte: line ends for delimited files, closing braces for JSON
(which may hold no line end at all). Where records start in a range depends on all that comes before, but only through a small state:

  delimited  whether a quoted field is open                      (a line end in it is data)
  JSON       whether a string is open, and the depth of nesting  (a brace in it is data)

1. Each range tells what it does to that state, whatever it is at its start: one short row a range.
2. Windows over these rows, by file, give every range its state at the start (and find files that end inside a value).
3. The ranges are read again, each from its own state: records inside a range come out whole, those over its ends in parts. Parts (at most
   two a range) are put together by file; all other rows go on without a shuffle.

States and the like are broadcast: a row of fixed size for each range, that is, for each ``spark.sql.files.maxPartitionBytes`` of input.
A record of more than ``MOST`` bytes, as an unclosed quote makes it, is a fault and is not put together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST, ROOT_MOST = 64 << 20, 1 << 20
WHOLE, TAIL, HEAD, MIDDLE, EVENT, ROOT = range(6)
NAMES = ["file", "block", "n", "kind", "key", "text"]
ROWS = "file string, block long, n long, kind int, key string, text binary"


def pieces(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    """file, block (where the range starts), value: what lies between separators, in the order of each range; size of the file."""
    return spark.read.option("lineSep", sep).text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_size").alias("size"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches cut so that each lies in one range; whether it is the first of its range."""
    last = None
    for b in batches:
        file, block = b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                part = b.slice(a, z - a)
                here = (part.column(0)[0].as_py(), int(block[a]))
                yield part, here != last
                last = here


class Out:
    """Rows of one range."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.rows, self.n = file, block, [], 0

    def add(self, kind: int, key: str | None, text: bytes) -> None:
        self.rows.append((self.n, kind, key, text))
        self.n += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        m = len(rows)
        n, kind, key, text = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array([self.file] * m, pa.string()), pa.array([self.block] * m, pa.int64()), pa.array(n, pa.int64()), pa.array(kind, pa.int32()), pa.array(key, pa.string()), pa.array(text, pa.binary())], names=NAMES)


def _emit(scanner: Callable, kinds: tuple[int, ...]) -> Callable:
    """The function of a pass over pieces with the states at the ranges' starts: rows of some kinds."""

    def run(batches):
        at = None
        pick = lambda b: b.filter(pa.array(np.isin(b.column(3).to_numpy(), kinds)))
        for b, first in _ranges(batches):
            if first:
                if at is not None:
                    at.close()
                    yield pick(at.out.batch())
                at = scanner(b)
            at.feed(b.column(2))
            yield pick(at.out.batch())
        if at is not None:
            at.close()
            yield pick(at.out.batch())

    return run


def put_together(parts: DataFrame) -> DataFrame:
    """Records over the ends of ranges: file, block and n of where they start, key, text (null beyond ``MOST`` bytes)."""
    order = W.partitionBy("file").orderBy("block", "n")
    numbered = parts.withColumn("one", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order))
    one = numbered.groupBy("file", "one").agg(F.min(F.struct("block", "n", "kind", "key")).alias("head"), F.sum(F.length("text")).alias("bytes"), F.array_sort(F.collect_list(F.when(F.length("text") <= MOST, F.struct("block", "n", "text")))).alias("parts"))
    text = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["text"]))
    return one.where(F.col("head.kind") == TAIL).select("file", "head.block", "head.n", "head.key", F.when(F.col("bytes") <= MOST, text).alias("text"))


def _valid(text: str) -> Column:
    return F.try_validate_utf8(F.col(text).cast("string"))


# ---- delimited -------------------------------------------------------------------------------------------

#: A line that starts outside and ends inside a quoted field; the end of a quoted field that is open.
_OPENS = re.compile(rb'(?:(?:"[^"]*(?:""[^"]*)*+"[^,]*|(?!")[^,]*),)*+"[^"]*(?:""[^"]*)*+')
_CLOSES = re.compile(rb'[^"]*(?:""[^"]*)*+"(?!")[^,]*(,|$)')


def quote_open(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after a line."""
    if b'"' not in line:
        return inside
    if inside:
        m = _CLOSES.match(line)
        return True if not m else m[1] == b"," and quote_open(line[m.end() :], False)
    return _OPENS.fullmatch(line) is not None


def _quotes(batches):
    """outside, inside: whether a quoted field is open after the range if none (one) is at its start."""
    names = ["file", "block", "outside", "inside"]
    row = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*where, *state)], names=names)
    where, state = None, (False, True)
    for b, first in _ranges(batches):
        if first:
            if where:
                yield row()
            where, state = (b.column(0)[0].as_py(), b.column(1)[0].as_py()), (False, True)
        for line in b.column(2).to_pylist():
            if b'"' in line:
                state = tuple(quote_open(line, s) for s in state)
    if where:
        yield row()


def quote_states(lines: DataFrame) -> DataFrame:
    """file, block, inside: whether a quoted field is open at the start of each range."""
    table = lines.mapInArrow(_quotes, "file string, block long, outside boolean, inside boolean")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # a range may keep the state, swap it, or end in one state in any case: the last of these counts, and the swaps after it
    swaps = F.sum(F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0))
    table = table.withColumn("swaps", F.coalesce(swaps.over(before), F.lit(0)))
    fixed = F.last(F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("to"), F.col("swaps"))), ignorenulls=True).over(before)
    table = table.withColumn("fixed", fixed)
    since = F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0)) + F.coalesce("fixed.to", F.lit(0))
    return table.select("file", "block", (since % 2 == 1).alias("inside"))


class LineScanner:
    def __init__(self, b: pa.RecordBatch):
        self.out = Out(b.column(0)[0].as_py(), b.column(1)[0].as_py())
        self.open = b.column(3)[0].as_py()
        self.began = not self.open
        self.lines: list[bytes] = []
        self.size = 0

    def feed(self, values: pa.Array) -> None:
        for line in values.to_pylist():
            if not self.lines and not self.open and not line.strip():
                continue
            if self.size <= MOST:
                self.lines.append(line)
            self.size += len(line) + 1
            self.open = quote_open(line, self.open)
            if not self.open:
                text = b"\n".join(self.lines).removesuffix(b"\r")
                if self.began and not self.out.block and not self.out.n:
                    self.out.rows.append((0, EVENT, None, text))  # the header
                self.out.add(WHOLE if self.began else HEAD, None, text)
                self.lines, self.size, self.began = [], 0, True

    def close(self) -> None:
        if self.lines:
            self.out.add(TAIL if self.began else MIDDLE, None, b"\n".join(self.lines) + b"\n")


def delimited_records(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(file, pos (order in the file), text of all records; file, text of the headers). A text is null if it is not UTF-8 or too long."""
    lines = pieces(spark, paths, "\n")
    states = F.broadcast(quote_states(lines))
    known = lines.join(states, ["file", "block"]).select("file", "block", "value", "inside")
    whole = known.mapInArrow(_emit(LineScanner, (WHOLE,)), ROWS).select("file", "block", "n", "text")
    edges = known.mapInArrow(_emit(LineScanner, (TAIL, HEAD, MIDDLE, EVENT)), ROWS)
    over = put_together(edges.where(F.col("kind") != EVENT)).select("file", "block", "n", "text")
    first = edges.where(F.col("kind") == EVENT).select("file", "block", "n", "text").unionByName(over).where("block = 0 and n = 0").select("file", _valid("text").alias("text"))
    rows = whole.unionByName(over).where("block > 0 or n > 0")
    return rows.select("file", (F.col("block") + F.col("n")).alias("pos"), _valid("text").alias("text")), first


# ---- JSON ------------------------------------------------------------------------------------------------


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotes that are not escaped, opening and closing brackets (those in strings too)."""
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != 0x5C, at, -1))
    before = np.r_[-1, plain[:-1]]
    quote = (data == 0x22) & ((at - 1 - before) % 2 == 0)
    return quote, (data == 0x7B) | (data == 0x5B), (data == 0x7D) | (data == 0x5D)


def _bytes_of(values: pa.Array) -> bytes:
    return b"}".join([*values.to_pylist(), b""])


def _nesting(batches):
    """For each range: whether it leaves strings as they are or not, and what it adds to the depth if none (one) is open at its start."""
    names = ["file", "block", "size", "odd", "outside", "inside", "bytes", "first"]
    row = lambda: pa.RecordBatch.from_arrays([pa.array([where[0]]), *(pa.array([x], pa.int64()) for x in (*where[1:], odd, *adds, total)), pa.array([root], pa.string())], names=names)
    where, odd, adds, root, total = None, 0, [0, 0], None, 0
    for b, first in _ranges(batches):
        if first:
            if where:
                yield row()
            where, odd, adds, root, total = tuple(b.column(i)[0].as_py() for i in (0, 1, 3)), 0, [0, 0], None, 0
        raw = _bytes_of(b.column(2))
        total += len(raw)
        if root is None:
            root = raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1") or None
        data = np.frombuffer(raw, np.uint8)
        quote, opens, closes = _marks(data)
        inside = ((np.cumsum(quote) - quote) % 2).astype(bool)
        step = opens.astype(np.int64) - closes
        here = [int(step[~inside].sum()), int(step[inside].sum())]
        adds = [adds[0] + here[odd], adds[1] + here[1 - odd]]
        odd ^= int(quote.sum()) % 2
    if where:
        yield row()


def nesting_states(parts: DataFrame) -> DataFrame:
    """file, block, inside, depth (at the range's start), root (the file's first sign), complete (whether the file ends outside all values)."""
    table = parts.mapInArrow(_nesting, "file string, block long, size long, odd long, outside long, inside long, bytes long, first string")
    every = W.partitionBy("file").orderBy("block")
    before, all_ = every.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("file")
    table = table.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    table = table.withColumn("adds", F.when(F.col("open") == 0, F.col("outside")).otherwise(F.col("inside")))
    # the brace that is put back after the last piece is one too many, unless the file ends with it; a byte order mark of three bytes is not read
    extra = (F.sum("bytes").over(all_) - F.first("size").over(all_)).isin(1, -2).cast("long")
    complete = (F.sum("adds").over(all_) + extra == 0) & (F.sum("odd").over(all_) % 2 == 0)
    return table.select("file", "block", (F.col("open") == 1).alias("inside"), F.coalesce(F.sum("adds").over(before), F.lit(0)).alias("depth"), F.first("first").over(every).alias("root"), complete.alias("complete"))


_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


class BraceScanner:
    """Objects of the root array, or of arrays in the root object; EVENT rows tell where such arrays (and objects) begin."""

    def __init__(self, b: pa.RecordBatch):
        self.out = Out(b.column(0)[0].as_py(), b.column(1)[0].as_py())
        self.inside, self.depth, root = (b.column(i)[0].as_py() for i in (3, 4, 5))
        self.level = 1 if root == "[" else 2
        #: the beginning of the file, for a root object that is a record itself
        self.root: list[bytes] | None = [] if root == "{" and not self.out.block else None
        self.key = "" if root == "[" else None
        #: whether a record is open, and whether it began in this range
        self.open, self.began = self.depth > self.level, False
        self.text: list[bytes] = []
        self.size = 0

    def _take(self, part: bytes) -> None:
        if self.size <= MOST:
            self.text.append(part)
        self.size += len(part)

    def feed(self, values: pa.Array) -> None:
        raw = _bytes_of(values)
        data = np.frombuffer(raw, np.uint8)
        quote, opens, closes = _marks(data)
        inside = ((int(self.inside) + np.cumsum(quote) - quote) % 2).astype(bool)
        step = (opens & ~inside).astype(np.int64) - (closes & ~inside)
        after = self.depth + np.cumsum(step)
        start = (step == 1) & (after == self.level + 1) & (data == 0x7B)
        end = (step == -1) & (after == self.level) & (data == 0x7D)
        array = (step == 1) & (after == 2) & (self.level == 2)
        if self.root is not None:
            done = np.flatnonzero((step == -1) & (after == 0))
            self.root.append(raw[: int(done[0]) + 1] if len(done) else raw)
            if len(done) or sum(map(len, self.root)) > ROOT_MOST:
                if len(done) and sum(map(len, self.root)) <= ROOT_MOST:
                    self.out.add(ROOT, None, b"".join(self.root))
                self.root = None
        at = 0
        for i in np.flatnonzero(start | end | array).tolist():
            if array[i]:
                m = _KEY.search(raw[max(0, i - 4096) : i])
                self.key = m[1].decode("utf-8", "replace") if m else ""
                self.out.add(EVENT, self.key, raw[i : i + 1])
            elif start[i]:
                self.open, self.began, self.text, self.size, at = True, True, [], 0, i
            elif self.open:
                self._take(raw[at : i + 1])
                self.out.add(WHOLE if self.began else HEAD, self.key if self.began else None, b"".join(self.text))
                self.open, self.text, self.size = False, [], 0
        if self.open:
            self._take(raw[at:])
        self.inside = bool((int(self.inside) + int(quote.sum())) % 2)
        self.depth = int(after[-1]) if len(after) else self.depth

    def close(self) -> None:
        if self.open and self.text:
            self.out.add(TAIL if self.began else MIDDLE, self.key if self.began else None, b"".join(self.text))


def json_records(spark: SparkSession, paths: str | list[str], wraps: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(file, pos, text: the objects in the root array, or in that array of the root object which comes first in ``wraps``, or a root
    object without one, of up to ``ROOT_MOST`` bytes in one range; file, error of each file: null if it is whole)."""
    parts = pieces(spark, paths, "}")
    states = nesting_states(parts)
    known = parts.join(F.broadcast(states), ["file", "block"]).select("file", "block", "value", "inside", "depth", "root")
    edges = known.mapInArrow(_emit(BraceScanner, (TAIL, HEAD, MIDDLE, EVENT, ROOT)), ROWS)
    whole = known.mapInArrow(_emit(BraceScanner, (WHOLE,)), ROWS).select("file", "block", "n", "key", "text")
    events = edges.where(F.col("kind") == EVENT)
    rank = F.when(F.col("text") == F.lit(b"["), F.array_position(F.array(*map(F.lit, wraps)), F.col("key")))
    best = events.withColumn("rank", F.nullif(rank, F.lit(0))).groupBy("file").agg(F.min("rank").alias("rank"))
    files = states.groupBy("file").agg(F.first("root").alias("root"), F.first("complete").alias("complete")).join(best, "file", "left")
    error = F.when(~F.col("complete"), "ends inside a value").when(~F.coalesce(F.col("root"), F.lit("")).isin("[", "{"), "is not a list or an object")
    files = files.select("file", error.alias("error"), F.when(F.col("root") == "[", "").otherwise(F.get(F.array(*map(F.lit, wraps)), (F.col("rank") - 1).cast("int"))).alias("wrap"))
    # the key that is open where a range starts: the last one before it
    last = states.select("file", "block").join(events.groupBy("file", "block").agg(F.max_by("key", "n").alias("key")), ["file", "block"], "left")
    carried = last.select("file", "block", F.last("key", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    rows = whole.unionByName(put_together(edges.where(F.col("kind").isin(TAIL, HEAD, MIDDLE))).select("file", "block", "n", "key", "text"))
    rows = rows.join(F.broadcast(carried), ["file", "block"]).withColumn("key", F.coalesce("key", "carried"))
    good = files.where("error is null")
    found = rows.join(F.broadcast(good.where("wrap is not null").select("file", "wrap")), "file").where(F.col("key") == F.col("wrap")).select("file", (F.col("block") + F.col("n")).alias("pos"), "text")
    single = edges.where(F.col("kind") == ROOT).join(F.broadcast(good.where("wrap is null").select("file")), "file").select("file", F.lit(0).cast("long").alias("pos"), "text")
    return found.unionByName(single).select("file", "pos", _valid("text").alias("text")), files.select("file", "error")
