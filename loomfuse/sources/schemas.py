"""Row types of the stages."""

from __future__ import annotations

from pyspark.sql import types as T

EXPERIENCE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("company", "title", "start", "end", "summary")]))
EDUCATION = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("institution", "degree", "field", "end_year")]))
_STRINGS = T.ArrayType(T.StringType())
#: One record as a source gives it. Records are ordered by (spec_idx, pos); years_experience is a number or a text.
RAW = T.StructType(
    [
        T.StructField("spec_idx", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("source", T.StringType()), T.StructField("full_name", T.StringType()), T.StructField("emails", _STRINGS), T.StructField("phones", _STRINGS),
        T.StructField("location_text", T.StringType()), T.StructField("city", T.StringType()), T.StructField("region", T.StringType()), T.StructField("country_text", T.StringType()), T.StructField("linkedin", T.StringType()), T.StructField("github", T.StringType()),
        T.StructField("portfolio", T.StringType()), T.StructField("other_links", _STRINGS), T.StructField("headline", T.StringType()), T.StructField("years_num", T.DoubleType()), T.StructField("years_txt", T.StringType()), T.StructField("skills", _STRINGS),
        T.StructField("experience", EXPERIENCE), T.StructField("education", EDUCATION),
    ]
)


def as_raw(df, keep: tuple[str, ...] = (), **columns):
    """Select the RAW columns: those given as expressions, the others of ``df`` by name, or null (empty arrays); then those of ``df`` to keep."""
    from pyspark.sql import functions as F

    out = []
    for f in RAW:
        c = columns.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None))
        c = F.coalesce(c.cast(f.dataType), F.array().cast(f.dataType)) if isinstance(f.dataType, T.ArrayType) else c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out, *keep)
