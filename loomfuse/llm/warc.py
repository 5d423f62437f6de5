"""WARC records and a Merkle audit of their fixity between two replicas.

Records of a file lie one after the other. A leaf hashes a record's digest (SHA-256), offset and length; a node hashes the ordered offset
ranges and hashes of at most 16 neighbours, first within files, then over files. Replicas are compared at the roots; only children of
nodes that differ are read, down to the records. There records are told apart by id and digest: changed, missing (only in the
first replica), extra (only in the second) or moved: intact, but not where the record before it ends, unlike in the other replica. A
record that only lies elsewhere because one before it is gone is intact and not reported.

Null html or url is empty. Equal records of an id are one leaf with a number of copies, so that a record repeated in every third row is one row
a task; records without id are dealt to ``VOLUMES`` files by their digest. A row that repeats an id is a further record of it. Ids may be any long.
Two equal or two empty replicas give no rows.
"""

from __future__ import annotations

import gzip
import io

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfuse.llm.common import NO_ID, cut, real_id

#: A node's children are those whose number agrees but for the last ``BITS`` bits: 16 at most.
BITS, FILE_IDS, VOLUMES = 4, 1000, 4096
CRLF = "\r\n"


# ---- files ----------------------------------------------------------------------------------------


def write_warc(records: list[tuple[str, str, bytes]]) -> bytes:
    """A compressed WARC file of (record id, target, payload) records, each a gzip member of its own."""
    out = io.BytesIO()
    for name, url, body in records:
        head = f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <{name}>{CRLF}WARC-Target-URI: {url}{CRLF}Content-Length: {len(body)}{CRLF}{CRLF}"
        out.write(gzip.compress(head.encode() + body + CRLF.encode() * 2, mtime=0))
    return out.getvalue()


def read_warc(raw: bytes) -> list[dict]:
    """offset and length (of the member), headers and payload of each record of a WARC file, compressed by records or plain."""
    import zlib

    out, at = [], 0
    while at < len(raw):
        if raw[at : at + 2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            plain = d.decompress(raw[at:]) + d.flush()
            size = len(raw) - at - len(d.unused_data)
        else:
            plain, size = raw[at:], None
        head, _, rest = plain.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:] if ": " in line)
        n = int(fields["Content-Length"])
        out.append({"offset": at, "length": size or len(head) + 4 + n + 4, "headers": fields, "payload": rest[:n]})
        at += out[-1]["length"]
    return out


# ---- trees ----------------------------------------------------------------------------------------

KEY = ["volume", "file", "idx"]


def to_records(pages: DataFrame, per_file: int = FILE_IDS) -> DataFrame:
    """volume, file, page_id, copies, ord, offset, length, digest of the records of pages; a file holds ``per_file`` neighbouring ids.
    Copies of a record follow each other from ``offset`` on."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID))
    head = F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), page.cast("string"), F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(F.col("url").cast("string"), F.lit("")), F.lit(f"{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    record = F.concat(head, html, F.lit(CRLF * 2))
    base = pages.select(page.alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    base = base.groupBy("page_id", "digest").agg(F.count("*").alias("copies"), F.first("length").alias("length"))
    volume = F.when(F.col("page_id") == NO_ID, F.pmod(F.xxhash64("digest"), F.lit(VOLUMES))).otherwise(0).cast("long")
    base = base.select(volume.alias("volume"), F.expr(f"page_id div {per_file} - if(page_id % {per_file} < 0, 1, 0)").alias("file"), "page_id", "copies", "length", "digest")
    order = Window.partitionBy("volume", "file").orderBy("page_id", "digest")
    size = F.col("copies") * F.col("length")
    return base.select("volume", "file", "page_id", "copies", (F.row_number().over(order) - 1).cast("long").alias("ord"), (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("offset"), "length", "digest")


def leaves(records: DataFrame) -> DataFrame:
    """The records with idx, start, stop (their range of offsets), hash and gap (from the end of the record before)."""
    order = Window.partitionBy("volume", "file").orderBy("ord")
    stop = F.col("offset") + F.col("copies") * F.col("length")
    mark = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("copies").cast("string"), "page_id", "digest")
    return records.select("*", F.col("ord").alias("idx"), F.col("offset").alias("start"), stop.alias("stop"), F.sha2(mark, 256).alias("hash"), (F.col("offset") - F.coalesce(F.lag(stop).over(order), F.lit(0))).alias("gap"))


def above(step: str) -> list:
    """Key columns of the node above."""
    return [F.shiftright(c, BITS).cast("long").alias(c) if c == step else F.col(c) for c in KEY]


def level_up(nodes: DataFrame, step: str) -> DataFrame:
    """The nodes above: the ranges and hashes of their children, in order, are hashed together."""
    children = F.array_sort(F.collect_list(F.struct(F.col("child"), "start", "stop", "hash")))
    text = F.transform(children, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"), F.lit(":"), x["hash"]))
    return nodes.select(*above(step), F.struct(*KEY).alias("child"), "start", "stop", "hash").groupBy(*KEY).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(F.concat_ws(",", text), 256).alias("hash"))


def steps_of(floors: list[DataFrame]) -> list[str]:
    """By which column each level joins its children: records within files, then files, then volumes."""
    every = floors[0].select(*KEY).union(floors[1].select(*KEY)).agg(F.max("idx"), F.min("file"), F.max("file"), F.max("volume")).first()
    if every[0] is None:
        return []
    count = lambda low, high: next(k for k in range(17) if low >> BITS * k == high >> BITS * k or k == 16)
    return ["idx"] * count(0, every[0]) + ["file"] * count(every[1], every[2]) + ["volume"] * count(0, every[3])


def tree(floor: DataFrame, steps: list[str]) -> list[DataFrame]:
    """Nodes by level, from the records up; each level is written, and is a fraction of the one below."""
    out = [floor.select(*KEY, "start", "stop", "hash")]
    for step in steps:
        out.append(cut(level_up(out[-1], step), "warc-nodes"))
    return out


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Per damaged record: file, page_id, copy, offset and length (in the first replica, else the second), expected, found, status."""
    floors = [cut(leaves(r), "warc-leaves") for r in (one, two)]
    steps = steps_of(floors)
    a, b = (tree(f, steps) for f in floors)
    wrong = None
    for k in range(len(steps), -1, -1):
        x, y = (t[k].select(*KEY, F.col("hash").alias(n)) for t, n in ((a, "x"), (b, "y")))
        if wrong is not None:
            # children of nodes that differ
            up = wrong.select(*(F.col(c).alias(f"up_{c}") for c in KEY))
            on = [F.shiftright(c, BITS).cast("long") == F.col(f"up_{c}") if c == steps[k] else F.col(c) == F.col(f"up_{c}") for c in KEY]
            x, y = x.join(up, on, "left_semi"), y.join(up, on, "left_semi")
        wrong = cut(x.join(y, KEY, "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(*KEY), "warc-wrong")
    cols = ["file", "page_id", "digest"]
    x, y = (cut(f.join(wrong, KEY, "left_semi").select(*cols, "copies", "offset", "length", "gap"), "warc-suspects") for f in floors)
    named = lambda d, n: d.select(*cols, *(F.col(c).alias(f"{c}_{n}") for c in ("copies", "offset", "length", "gap")))
    # equal records of an id are intact wherever they lie; copies of those left over are paired in order
    same = cut(named(x, "x").join(named(y, "y"), cols, "full"), "warc-same")
    less = F.coalesce("copies_x", F.lit(0)) - F.coalesce("copies_y", F.lit(0))
    turn = Window.partitionBy("file", "page_id").orderBy("digest")

    def left(more, n: str) -> DataFrame:
        first = F.sum("more").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("more")
        some = same.withColumn("more", more).where("more > 0").withColumn("first", first)
        return some.select("file", "page_id", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("more"))).alias("copy"), F.col(f"offset_{n}").alias(f"o{n}"), F.col(f"length_{n}").alias(f"l{n}"), F.col("digest").alias(n))

    both = left(less, "x").join(left(-less, "y"), ["file", "page_id", "copy"], "full")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed")
    found = both.select("file", "page_id", "copy", F.coalesce("ox", "oy").alias("offset"), F.coalesce("lx", "ly").alias("length"), F.col("x").alias("expected"), F.col("y").alias("found"), status.alias("status"))
    moved = same.where("gap_x <> gap_y").select("file", "page_id", F.lit(1).cast("long").alias("copy"), F.col("offset_x").alias("offset"), F.col("length_x").alias("length"), F.col("digest").alias("expected"), F.col("digest").alias("found"), F.lit("moved").alias("status"))
    return found.unionByName(moved).withColumn("page_id", real_id("page_id"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` in which a fixed rule changes, drops and adds records (for the query and tests)."""
    mark = F.col("page_id") % 100
    kept = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).where(F.coalesce(mark != 7, F.lit(True)))
    changed = kept.withColumn("html", F.when(mark == 3, F.concat(F.substring("html", 1, 20), F.lit("?"), F.expr("substring(html, 22)"))).otherwise(F.col("html")))
    return changed.unionByName(kept.where(mark == 11).withColumn("html", F.concat("html", F.lit("<!-- again -->"))))
