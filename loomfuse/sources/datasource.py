"""Delimited exports through Spark's data source API: ``spark.read.format("person_export").load(path)`` gives RAW rows.

An input partition is a byte range of a file with what is known of its start: whether a quoted field is open there. ``prepare`` finds that
for all ranges by a Spark job (``quote_states``) and leaves a small table, whose folder is the option ``states``; without it
a file is one partition. A partition reads on behind its end to finish its last record, and leaves out the rest of a record that began
before it, so that records need no putting together.

Options: ``states``; ``columns``, the RAW columns to make (others are neither built nor passed on). Files are opened by Arrow's file systems.
Rows and faults are those of the function reader, but that a file that is not UTF-8 ends the query here.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from loomfuse.functions import rules as R
from loomfuse.functions.text import SPACE
from loomfuse.sources.ranges import pieces, quote_open, quote_states
from loomfuse.sources.schemas import RAW

ROWS = 5000
_BLANKS = re.compile(rf"^{SPACE}+|{SPACE}+$")


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return (pa.fs.LocalFileSystem(), local) if local.startswith("/") else pa.fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[str]:
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return [at]
    found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Range(InputPartition):
    file: str
    number: int
    start: int
    end: int | None
    inside: bool


def lines_from(f, start: int, end: int | None) -> Iterator[tuple[bool, bytes]]:
    """(whether it begins in the range, line) from the first line that begins at or behind ``start``, to the end of the file."""
    f.seek(max(0, start - 1))
    reader = io.BufferedReader(f, 1 << 20)
    at = max(0, start - 1)
    if start:
        at += len(reader.readline())
    for line in reader:
        yield end is None or at < end, line.removesuffix(b"\n")
        at += len(line)


def records_in(part: Range, f) -> Iterator[bytes]:
    """Records that begin in the range, blank lines left out."""
    inside, held, began = part.inside, [], not part.inside
    for here, line in lines_from(f, part.start, part.end):
        if not here and (not held or not began):
            return  # what follows begins behind the range
        if not held and not inside and not line.strip():
            continue
        held.append(line)
        inside = quote_open(line, inside)
        if not inside:
            if began:
                yield b"\n".join(held).removesuffix(b"\r")
            held, began = [], True
    if held and began:
        yield b"\n".join(held) + b"\n"


def clean(x: str) -> str | None:
    return _BLANKS.sub("", x) or None


def raw_row(cells: dict[str, str | None]) -> dict | None:
    """A RAW row of the cells by key, or None without a name, an e-mail and a phone."""
    if not (cells.get("name") or cells.get("email") or cells.get("phone")):
        return None
    one = lambda k: [cells[k]] if cells.get(k) else []
    company, title = cells.get("company"), cells.get("title")
    job = [{"company": company, "title": title, "start": None, "end": "present", "summary": None}] if company or title else []
    return {"source": "recruiter_csv", "full_name": cells.get("name"), "emails": one("email"), "phones": one("phone"), "location_text": cells.get("location"), "headline": title, "experience": job}


class ExportReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.states = schema, options["path"], options.get("states")

    def partitions(self) -> list[Range]:
        files = files_of(self.path)
        if not self.states:
            return [Range(f, i, 0, None, False) for i, f in enumerate(files)]
        fs, at = opened(self.states)
        rows = pa.parquet.read_table(at, filesystem=fs).sort_by([("file", "ascending"), ("block", "ascending")]).to_pylist()
        number = {f: i for i, f in enumerate(files)}
        out = []
        for r, after in zip(rows, [*rows[1:], None]):
            file = opened(r["file"])[1]
            out.append(Range(file, number[file], r["block"], after["block"] if after and after["file"] == r["file"] else None, r["inside"]))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, at = opened(part.file)
        parse = lambda record: next(csv.reader(io.StringIO(record.decode("utf-8"), newline="")), [])
        with fs.open_input_file(at) as f:
            head = next(records_in(Range(part.file, 0, 0, None, False), f), b"")
        keys = [R.CSV_HEADERS.get(x.removeprefix("﻿").strip().lower()) for x in parse(head)]
        names, kind, rows = set(self.schema.names), to_arrow_schema(self.schema), []
        lists = {c.name: [] for c in RAW if isinstance(c.dataType, T.ArrayType)}
        with fs.open_input_file(at) as f:
            for n, record in enumerate(records_in(part, f)):
                if not part.start and not n:
                    continue
                cells: dict[str, str | None] = {}
                for key, x in zip(keys, parse(record)):
                    if key and not cells.get(key):
                        cells[key] = clean(x)
                if row := raw_row(cells):
                    rows.append({k: v for k, v in (lists | row | {"spec_idx": 0, "pos": (part.number << 42) + part.start + n}).items() if k in names})
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


class PersonExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "person_export"

    def schema(self) -> T.StructType:
        wanted = [c.strip() for c in (self.options.get("columns") or "").split(",") if c.strip()]
        return T.StructType([f for f in RAW if not wanted or f.name in wanted])

    def reader(self, schema: T.StructType) -> ExportReader:
        return ExportReader(schema, dict(self.options))


def prepare(spark: SparkSession, path: str, states: str) -> None:
    """Leave what is known of the ranges of ``path`` in the folder ``states``: a row a range."""
    quote_states(pieces(spark, path, "\n")).select("file", "block", "inside").repartition(1).write.parquet(states)


def read_export(spark: SparkSession, path: str, states: str, columns: list[str] | None = None) -> DataFrame:
    """RAW rows (or some columns) of the delimited files of ``path``, by byte ranges, through the data source."""
    spark.dataSource.register(PersonExport)
    prepare(spark, path, states)
    reader = spark.read.format("person_export").option("states", states)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)
