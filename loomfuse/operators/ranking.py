"""Keyword relevance and the order of profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomfuse.functions import rules as R
from loomfuse.functions.text import blank_to_null, find_terms, let, no_strings, round4, squash
from loomfuse.plans.components import _cut


def parse_keywords(text: str | None) -> list[str]:
    """Terms between commas, semicolons and line ends; the first spelling of each is kept."""
    seen: dict[str, str] = {}
    for part in re.split(r"[,\n;]+", text or ""):
        term = re.sub(r"\s+", " ", part).strip()
        if term:
            seen.setdefault(term.lower(), term)
    return list(seen.values())


def profile_text() -> Column:
    """All that a keyword may match, lower-cased."""
    parts = F.concat(
        F.transform("skills", lambda s: s["name"]), F.array("headline"), F.flatten(F.transform("experience", lambda e: F.array(e["title"], e["company"], e["summary"]))),
        F.flatten(F.transform("education", lambda e: F.array(e["degree"], e["field"], e["institution"]))), F.array("location.city", "location.region", "location.country"),
    )
    return F.lower(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " \n "))


def keyword_hits(keywords: list[str], text: Column, skills: Column) -> Column:
    """Those of ``keywords`` that stand in the text (lower case) by themselves, all found in one pass, or name a skill in ``skills`` (lower case)."""
    low = {k: re.sub(r"\s+", " ", k).strip().lower() for k in keywords}
    skill = {k: R.SKILL_OF[key].lower() for k, t in low.items() if (key := t.strip(" .,;:|/")) in R.SKILL_OF}
    hit = lambda found, k: F.array_contains(found, low[k]) | (F.array_contains(skills, skill[k]) if k in skill else F.lit(False))
    none = F.lit(None).cast("string")
    return let(find_terms(text, list(low.values())), lambda found: F.array_compact(F.array(*(F.when(hit(found, k), F.lit(k)) for k in keywords if low[k]), none)))


def keyword_match(profiles: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds matched (array) and match_fraction."""
    df = profiles.withColumn("_text", profile_text()).withColumn("_skills", F.transform("skills", lambda s: F.lower(s["name"])))
    hits = keyword_hits(keywords, F.col("_text"), F.coalesce("_skills", no_strings()))
    return df.withColumn("matched", hits).withColumn("match_fraction", F.size("matched") / F.lit(float(max(len(keywords), 1)))).drop("_text", "_skills")


def blend(base: Column, fraction: Column) -> Column:
    """Relevance and confidence as one number; null where there is no confidence."""
    return F.when(base.isNotNull(), round4(F.lit(R.KEYWORD_WEIGHT) * fraction + F.lit(1.0 - R.KEYWORD_WEIGHT) * base))


def band(score: Column) -> Column:
    return F.when(score.isNull(), "grey").when(score >= 0.8, "green").when(score >= 0.5, "amber").otherwise("red")


def rank(profiles: DataFrame, keywords: str | list[str] | None = None) -> DataFrame:
    """Profiles with matched, match_fraction, score and band: by relevance if there are keywords, else by confidence; ties by id."""
    terms = parse_keywords(keywords) if not isinstance(keywords, list) else keywords
    df = keyword_match(profiles, terms)
    score = blend(F.col("overall_confidence"), F.col("match_fraction")) if terms else F.col("overall_confidence")
    return df.withColumn("score", score).withColumn("band", band(score)).orderBy(*order_of(terms))


def order_of(keywords: list[str] | None = None) -> list[Column]:
    """The order of profiles: by matched share, then confidence, if there are keywords; else by confidence, those without one last; then by id."""
    ties = [F.col("candidate_id"), F.col("cluster")]
    if keywords:
        return [F.desc("match_fraction"), F.coalesce("overall_confidence", F.lit(0.0)).desc(), *ties]
    return [F.desc_nulls_last("overall_confidence"), *ties]


def with_rank(ranked: DataFrame, keywords: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """Adds rank (1, 2, …) by ``order_of``: rows are dealt by ranges of the order, numbered in each, and the counts of the ranges
    before are added, so that no task sorts all rows."""
    order = order_of(keywords)
    dealt = _cut(ranked.repartitionByRange(buckets, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part")))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def card(profiles: DataFrame) -> DataFrame:
    """Flat view for display: name, title (name, else e-mail, phone, GitHub, id), initials of the name's first two words ("?" without a name), place
    and links that are there, band of the confidence, skills with theirs."""
    first = lambda c: F.get(c, F.lit(0))
    name = blank_to_null(squash(F.coalesce("full_name", F.lit(""))))
    title = F.coalesce(name, *(blank_to_null(c) for c in (first("emails"), first("phones"), F.col("links.github"))), F.col("candidate_id"))
    initials = F.upper(F.array_join(F.transform(F.slice(F.split(name, " "), 1, 2), lambda w: F.substring(w, 1, 1)), ""))
    place = blank_to_null(F.concat_ws(", ", *(blank_to_null(f"location.{x}") for x in ("city", "region", "country"))))
    links = F.array_compact(F.array(*(blank_to_null(f"links.{x}") for x in ("linkedin", "github", "portfolio"))))
    skills = F.transform("skills", lambda s: F.struct(s["name"].alias("name"), s["confidence"].alias("confidence")))
    return profiles.select(
        "cluster", "candidate_id", name.alias("name"), title.alias("title"), F.coalesce(initials, F.lit("?")).alias("initials"), place.alias("place"), "headline", links.alias("links"), band(F.col("overall_confidence")).alias("band"), skills.alias("skills"),
    )
