"""RAW rows to normalized records: one narrow select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfuse.functions import normalize as N
from loomfuse.functions.text import blank_to_null, clean, distinct_present, let, strip


def normalize_records(raw: DataFrame, default_region: str = "US") -> DataFrame:
    """rec (struct spec_idx, pos: the order of records), source, and normalized fields."""
    region = F.coalesce(N.country("country_text"), F.lit(default_region))
    structured = F.coalesce(*(blank_to_null(c) for c in ("city", "region", "country_text"))).isNotNull()
    place = N.location("location_text")
    df = raw.withColumn("_region", region).withColumn("_structured", structured).withColumn("_place", F.when(~F.col("_structured"), place))
    urls = F.filter(F.transform("other_links", N.url), lambda u: u.isNotNull())
    df = df.withColumn("_urls", urls).withColumn("_in", N.url("linkedin")).withColumn("_hub", N.url("github"))
    kinds = lambda kind: F.filter("_urls", lambda u: N.link_kind(u) == kind)
    takes = lambda own, kind: F.when(F.col(own).isNull(), F.get(kinds(kind), F.lit(0)))
    place_of = lambda given, part: F.when(F.col("_structured"), given).otherwise(F.col("_place")[part])

    def others() -> Column:
        """Links but the one that filled an empty field."""
        used = lambda own, kind: F.when(F.col(own).isNull(), F.array_position(F.transform("_urls", N.link_kind), kind)).otherwise(F.lit(0))
        return F.filter("_urls", lambda u, i: (i + 1 != F.coalesce(used("_in", "linkedin"), F.lit(0))) & (i + 1 != F.coalesce(used("_hub", "github"), F.lit(0))))

    # inside a lambda an expression that is named twice is computed twice
    skills = F.filter(F.transform("skills", N.skill), lambda s: s.isNotNull())
    of_case = lambda found: let(F.transform(found, F.lower), lambda low: F.filter(found, lambda s, i: F.array_position(low, F.lower(s)) == i + 1))
    first_of_case = let(skills, of_case)
    neat = lambda c: let(strip(c), blank_to_null)
    job = lambda e: F.struct(neat(e["company"]).alias("company"), neat(e["title"]).alias("title"), N.month(e["start"]).alias("start"), N.month(e["end"]).alias("end"), neat(e["summary"]).alias("summary"))
    course = lambda e: F.struct(neat(e["institution"]).alias("institution"), neat(e["degree"]).alias("degree"), neat(e["field"]).alias("field"), N.year(e["end_year"]).alias("end_year"))
    return df.select(
        F.struct("spec_idx", "pos").alias("rec"), "source", N.name("full_name").alias("full_name"), distinct_present(F.transform("emails", N.email)).alias("emails"), distinct_present(F.transform("phones", lambda p: N.phone(p, F.col("_region")))).alias("phones"),
        place_of(clean("city"), "city").alias("city"), place_of(clean("region"), "region").alias("region"), place_of(N.country("country_text"), "country").alias("country"),
        F.coalesce("_in", takes("_in", "linkedin")).alias("linkedin"), F.coalesce("_hub", takes("_hub", "github")).alias("github"), N.url("portfolio").alias("portfolio"), others().alias("other_links"),
        clean("headline").alias("headline"), N.years_experience("years_num", "years_txt").alias("years_experience"), first_of_case.alias("skills"),
        F.filter(F.transform("experience", job), lambda e: e["company"].isNotNull() | e["title"].isNotNull()).alias("experience"),
        F.filter(F.transform("education", course), lambda e: e["institution"].isNotNull() | e["degree"].isNotNull() | e["field"].isNotNull()).alias("education"),
    )
