"""Shared helpers: working folders, document normalisation, byte-level text kit in numpy.

Conventions that every operator here follows:

* only the named input columns are read, so extra columns and clashing names do no harm;
* null text is the empty text; a null ``doc_id`` is one document with an id below all others
  (it is carried as the smallest long and returned as null);
* a repeated row is the same document again: it gets the same result, and adds no document.
"""

from __future__ import annotations

import ctypes
import glob
import os
import platform
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.plans.components import shared_dir

NO_ID = -(2**63)
WORD_SEP = "[\\x20\\x09-\\x0D]+"


def workdir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``; where that is unset one in the warehouse, or on a single machine a temporary one."""
    return shared_dir(spark)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it reread: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{workdir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*written: DataFrame) -> None:
    """Delete what ``cut`` wrote for tables that nothing reads any more."""
    for df in written:
        path = getattr(df, "cut_path", None)
        if path and hasattr(df.sparkSession, "_jvm"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is not in ``gone`` (doc_id, null for the document without id).

    The ids go by names that no column of ``docs`` has."""
    name = free_name(docs, "gone")
    ids = gone.select(doc_key().alias(name)).distinct()
    return docs.join(ids, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == ids[name], "left_anti")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name in taken:
        name += "_"
    return name


def norm_docs(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(doc_key().alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def real_id(col: str = "doc_id") -> Column:
    return F.nullif(F.col(col), F.lit(NO_ID)).alias(col)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- bytes of an Arrow string column -------------------------------------------------------


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, the offsets counted from its own start."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Slices of a batch with about ``most`` bytes of text each (one row at least), to bound numpy's working memory."""
    _, off = buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in each text, and word counts summed up to each text (len(offsets))."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~sep[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
LONG_WORD = 1 << 16
#: Bytes, or values, hashed at once; the hashes do not depend on it.
HASHED = 1 << 17


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if which not in _POW or len(_POW[which][0]) < n:
        size = max(n, 1 << 16)
        base = _BASE[which]
        p, q = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 2**64)))
        p[0] = q[0] = 1
        _POW[which] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POW[which][0][:n], _POW[which][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans (ascending, apart), from prefix sums of a polynomial over random byte values."""
    out = np.zeros(len(starts), np.uint64)
    table = _BYTE[which][_LOWER] if lower else _BYTE[which]
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, lo + HASHED, "right")))
        n = int(ends[end - 1]) - lo
        p, q = powers(which, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[lo : lo + n]] * p[:n], out=total[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))
        at = end
    return out


def hash_windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of each run of ``size`` consecutive values of ``h``."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, HASHED):
        m = min(HASHED, n - at)
        p, q = powers(which, m + size)
        total = np.zeros(m + size, np.uint64)
        np.cumsum(h[at : at + m + size - 1] * p[: m + size - 1], out=total[1:])
        out[at : at + m] = mix((total[size:] - total[:m]) * q[:m])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, … of each of many runs, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    out = np.repeat(np.asarray(starts, np.int64) - np.r_[0, np.cumsum(lengths)[:-1]], lengths) if total else np.zeros(0, np.int64)
    return out + np.arange(total)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def one_thread() -> None:
    """Numpy's linear algebra on one thread, where its library lets it be said: a task has one core, on which threads of small products only wait."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


@contextmanager
def no_subnormals():
    """Count results below the least normal number as zero, where the processor lets it be said: arithmetic on them takes many times as long.
    At the end all is as before, as the process goes on to other tasks."""
    state, library = (ctypes.c_uint32 * 64)(), None
    if platform.machine() == "x86_64" and platform.libc_ver()[0] == "glibc":
        library = ctypes.CDLL("libm.so.6")
        library.fegetenv(state)
        before = state[7]  # MXCSR, whose bits 15 and 6 flush results and operands
        state[7] |= 0x8040
        library.fesetenv(state)
    try:
        yield
    finally:
        if library:
            library.fegetenv(state)
            state[7] = state[7] & ~0x8040 | before & 0x8040
            library.fesetenv(state)
