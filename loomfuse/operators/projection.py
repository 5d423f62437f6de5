"""The projection language, compiled to columns over a profile's schema.

A path is names joined by dots, each with ``[i]`` (one element) or ``[]`` (the rest of the path over all elements, nulls
left out). What does not exist is null."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfuse.functions.normalize import KINDS
from loomfuse.plans.config import FieldSpec, OutputConfig

#: Fixed value: the grammar of one step of a path.
TOKEN = re.compile(r"^([A-Za-z_]\w*)?(\[(\d*)\])?$")
Typed = tuple[Column, T.DataType]


def _nothing() -> Typed:
    return F.lit(None), T.NullType()


def resolve(root: Typed, path: str) -> Typed:
    """Column and type of ``path`` below ``root``."""
    tokens = [t for t in path.split(".") if t]
    return _walk(root, tokens)


def _walk(at: Typed, tokens: list[str]) -> Typed:
    if not tokens:
        return at
    m = TOKEN.match(tokens[0])
    if not m:
        return _nothing()
    col, kind = at
    if m[1]:
        if not isinstance(kind, T.StructType) or m[1] not in kind.names:
            return _nothing()
        col, kind = col[m[1]], kind[m[1]].dataType
    if m[2]:
        if not isinstance(kind, T.ArrayType):
            return _nothing()
        if m[3]:
            return _walk((F.get(col, F.lit(int(m[3]))), kind.elementType), tokens[1:])
        rest = _walk((F.lit(None), kind.elementType), tokens[1:])[1]
        return F.filter(F.transform(col, lambda x: _walk((x, kind.elementType), tokens[1:])[0]), lambda x: x.isNotNull()), T.ArrayType(rest)
    return _walk((col, kind), tokens[1:])


def normalized(at: Typed, spec: FieldSpec, region: str) -> Typed:
    """Value after the field's normalizer; elements that cannot be read become null in place."""
    one = KINDS.get((spec.normalize or "").lower())
    col, kind = at
    if one is None or isinstance(kind, (T.NullType, T.StructType)):
        return at
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: one(x.cast("string"), region)), T.ArrayType(T.StringType())
    return one(col.cast("string"), region), T.StringType()


def is_missing(at: Typed) -> Column:
    col, kind = at
    if isinstance(kind, T.ArrayType):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull() | (col == "") if isinstance(kind, T.StringType) else col.isNull()


def fields_of(df: DataFrame, config: OutputConfig) -> list[tuple[FieldSpec, Typed]]:
    root = (F.struct(*df.columns), df.schema)
    tops = {f.name: (F.col(f.name), f.dataType) for f in df.schema}

    def read(spec: FieldSpec) -> Typed:
        first, _, rest = spec.reads.lstrip(".").partition(".")
        name = re.match(r"\w+", first)
        if name and name[0] in tops:
            at = (F.struct(F.col(name[0])), T.StructType([T.StructField(name[0], tops[name[0]][1])]))
            return resolve(at, spec.reads)
        return resolve(root, spec.reads)

    return [(s, normalized(read(s), s, config.default_region)) for s in config.fields]


def nest(values: list[tuple[str, Column]]) -> Column:
    """A struct tree of dotted paths; a later value for a path replaces the one before."""
    tree: dict = {}
    for path, value in values:
        at = tree
        *up, last = [p for p in path.split(".") if p] or [path]
        for p in up:
            at = at.setdefault(p, {})
        at[last] = value
    def build(t: dict) -> Column:
        return F.struct(*((build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()))
    return build(tree)


def without_confidence(at: Typed) -> Typed:
    """The value without keys that tell confidences, at any depth."""
    col, kind = at
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: without_confidence((x, kind.elementType))[0]), T.ArrayType(without_confidence((F.lit(None), kind.elementType))[1])
    if isinstance(kind, T.StructType):
        kept = [(f.name, without_confidence((col[f.name], f.dataType))) for f in kind if f.name not in ("confidence", "overall_confidence")]
        if not kept:
            return F.lit(None), T.NullType()
        return F.when(col.isNotNull(), F.struct(*(c.alias(n) for n, (c, _) in kept))), T.StructType([T.StructField(n, k) for n, (_, k) in kept])
    return at


def project(profiles: DataFrame, config: OutputConfig) -> DataFrame:
    """cluster, output (struct), present (paths of the output that are kept; others are omitted when rendered), errors."""
    found = fields_of(profiles.drop("cluster"), config)
    values, present, errors, heads = [], [], [], []
    for spec, at in found:
        policy = spec.on_missing or config.on_missing
        gone = is_missing(at)
        hidden = not config.include_confidence and spec.path.split(".")[-1] in ("confidence", "overall_confidence")
        col, kind = without_confidence(at) if not config.include_confidence else at
        if policy == "error":
            errors.append(F.when(gone, F.lit(f"required value for {spec.path!r} is missing")))
        if not hidden:
            values.append((spec.path, F.when(~gone, col).otherwise(F.lit(None)) if not isinstance(kind, T.NullType) else F.lit(None).cast("string")))
            present.append(F.when(~gone, F.lit(spec.path)) if policy == "omit" else F.lit(spec.path))
        heads.append(F.when(~gone | F.lit(policy != "omit"), F.lit(re.split(r"[.\[:]", spec.reads)[0])))
    if config.include_confidence and not any(p == "overall_confidence" for p, _ in values):
        values.append(("overall_confidence", F.col("overall_confidence")))
        present.append(F.lit("overall_confidence"))
    if config.include_provenance:
        prov = F.col("provenance")
        if config.fields:
            prov = F.filter(prov, lambda p: F.array_contains(F.array_compact(F.array(*heads)), F.get(F.split(p["field"], r"[.\[:]"), F.lit(0))))
        values.append(("provenance", prov))
        present.append(F.lit("provenance"))
    return profiles.select("cluster", (nest(values) if values else F.struct(F.lit(None).cast("string").alias("_"))).alias("output"), F.array_compact(F.array(*present)).cast("array<string>").alias("present"), F.array_compact(F.array(*errors, F.lit(None).cast("string"))).alias("errors"))


def render(df: DataFrame, paths: list[str]) -> Column:
    """JSON text of ``output`` with nulls kept and those of ``paths`` that are not ``present`` left out."""
    inside = lambda full: any(p.startswith(full + ".") for p in paths)

    def build(kind: T.StructType, col: Column, path: str) -> Column:
        parts = []
        for f in kind:
            full = f"{path}{f.name}"
            if inside(full):
                value, kept = build(f.dataType, col[f.name], f"{full}."), F.exists("present", lambda p: p.startswith(full + "."))
            else:
                value, kept = _json(col[f.name]), F.array_contains("present", full)
            parts.append(F.when(kept, F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), value)))
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))

    return build(df.schema["output"].dataType, F.col("output"), "")


def _json(col: Column) -> Column:
    """JSON of any value: an array of one is written and unwrapped."""
    text = F.to_json(F.array(col), {"ignoreNullFields": "false"})
    return text.substr(F.lit(2), F.length(text) - 2)
