"""Which records describe one entity: components over shared contact and name keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfuse.functions import normalize as N
from loomfuse.functions.text import blank_to_null, col
from loomfuse.plans.components import connected_components


def blocking_keys(emails: Column | str, phones: Column | str, name: Column | str) -> Column:
    """Keys that two records of one entity share. (A weaker key of name and employer or country would add no link: it contains the name's.)"""
    tag = lambda t: lambda x: F.concat(F.lit(f"{t}:"), x)
    key = N.name_key(name)
    return F.array_distinct(F.concat(F.transform(col(emails), tag("email")), F.transform(col(phones), tag("phone")), F.when(key.isNotNull(), F.array(F.concat(F.lit("name:"), key))).otherwise(F.array().cast("array<string>"))))


def weak_key(name: Column | str, experience: Column | str, country: Column | str) -> Column:
    """Name key and first employer, else country."""
    job = blank_to_null(F.lower(F.get(col(experience), F.lit(0))["company"]))
    return F.concat(N.name_key(name), F.lit("|"), F.coalesce(job, F.lower(col(country))))


def star_edges(keys: DataFrame, key: str, node: str) -> DataFrame:
    """u, v: each node of a key with the smallest one. One aggregation, combined on the map side, and a join that AQE may split: linear in any group."""
    least = keys.groupBy(key).agg(F.min(node).alias("v"), F.count("*").alias("_n")).where("_n > 1").select(key, "v")
    return keys.join(least, key).select(F.col(node).alias("u"), "v").where("u <> v")


def clusters(records: DataFrame) -> DataFrame:
    """``records`` with ``cluster``, the smallest ``rec`` of each component."""
    keys = records.select("rec", F.explode(blocking_keys("emails", "phones", "full_name")).alias("key"))
    labels = connected_components(star_edges(keys, "key", "rec"))
    return records.join(labels.withColumnRenamed("u", "rec"), "rec", "left").withColumn("cluster", F.coalesce("label", "rec")).drop("label")


def candidate_id(emails: Column, name: Column, phones: Column) -> Column:
    """``cand_`` and ten hex digits of the SHA-1 of the best key."""
    key = F.coalesce(F.array_min(emails), N.name_key(name), F.lower(name), F.array_min(phones), F.lit("unknown"))
    return F.concat(F.lit("cand_"), F.substring(F.sha1(key), 1, 10))
