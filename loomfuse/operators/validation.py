"""Checks of output rows. Types are known from the schema, so that only nulls and shapes are tested row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfuse.operators.projection import resolve
from loomfuse.plans.config import OutputConfig

_NUMBERS = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType)
#: Default output fields; ``?`` marks those that may be null.
DEFAULT_SCHEMA = {"candidate_id": "string", "full_name": "string?", "emails": "string[]", "phones": "string[]", "location": "object", "links": "object", "headline": "string?", "years_experience": "number?", "skills": "object[]", "experience": "object[]", "education": "object[]", "provenance": "object[]", "overall_confidence": "number"}


def fits(kind: T.DataType, wanted: str) -> bool:
    """Whether values of a Spark type can have the named one."""
    if wanted == "any" or isinstance(kind, T.NullType):
        return wanted == "any"
    if wanted.endswith("[]"):
        return isinstance(kind, T.ArrayType) and (isinstance(kind.elementType, T.NullType) or fits(kind.elementType, wanted[:-2]))
    return isinstance(kind, {"string": T.StringType, "number": _NUMBERS, "integer": (T.IntegerType, T.LongType, T.ShortType), "boolean": T.BooleanType, "object": (T.StructType, T.MapType)}[wanted])


def type_error(col: Column, kind: T.DataType, wanted: str) -> Column:
    """True where a value that is not null does not have the type."""
    if not fits(kind, wanted):
        return col.isNotNull()
    return F.coalesce(F.exists(col, lambda x: x.isNull()), F.lit(False)) if isinstance(kind, T.ArrayType) and wanted != "any" else F.lit(False)


def default_errors(df: DataFrame) -> Column:
    """Messages on the default schema; phones must be E.164."""
    out = []
    for name, wanted in DEFAULT_SCHEMA.items():
        if name not in df.columns:
            out.append(F.lit(f"default schema: missing field '{name}'"))
            continue
        kind = df.schema[name].dataType
        if not wanted.endswith("?"):
            out.append(F.when(F.col(name).isNull(), F.lit(f"default schema: field '{name}' must not be null")))
        out.append(F.when(type_error(F.col(name), kind, wanted.rstrip("?")), F.lit(f"default schema: field '{name}' expected {wanted.rstrip('?')}")))
    bad = F.transform(F.filter("phones", lambda p: ~p.startswith("+")), lambda p: F.concat(F.lit("default schema: phone '"), p, F.lit("' is not E.164 (+...)")))
    return F.array_compact(F.concat(F.array(*out), bad)) if "phones" in df.columns else F.array_compact(F.array(*out))


def config_errors(df: DataFrame, config: OutputConfig) -> Column:
    """Messages on the fields of a configuration, from ``output`` and ``present``."""
    out, root = [], (F.col("output"), df.schema["output"].dataType)
    for f in config.fields:
        if not config.include_confidence and f.path.split(".")[-1] in ("confidence", "overall_confidence"):
            continue
        col, kind = resolve(root, f.path)
        there = F.array_contains("present", f.path) & col.isNotNull()
        if f.required:
            out.append(F.when(~there, F.lit(f"required field '{f.path}' is missing or null")))
        out.append(F.when(there & type_error(col, kind, f.type), F.lit(f"field '{f.path}' expected {f.type}")))
    return F.array_compact(F.array(*out, F.lit(None).cast("string")))
