"""Evidence aggregation: the records of a cluster to one profile with confidences and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfuse.functions import rules as R
from loomfuse.functions.confidence import field_weight, mean_times, method, priority
from loomfuse.functions.text import literal_map, lookup, round4
from loomfuse.operators.identity import candidate_id

#: Output path -> (trust field, tag). Scalars keep the best value, lists keep all. The order is that of provenance.
SCALARS = {
    "full_name": ("full_name", None), "headline": ("headline", None), "years_experience": ("years_experience", None), "location.city": ("location", None), "location.region": ("location", None), "location.country": ("location", "ISO3166"),
    "links.linkedin": ("links", None), "links.github": ("links", None), "links.portfolio": ("links", None),
}
LISTS = {"emails": ("emails", "lowercased"), "phones": ("phones", "E164"), "links.other": ("links", None), "skills": ("skills", "canonical")}
_FIELDS = {p: t for p, (t, _) in (SCALARS | LISTS).items()} | {"experience": "experience", "education": "education"}
ORDER = ("full_name", "headline", "years_experience", "emails", "phones", "location.city", "location.region", "location.country", "links.linkedin", "links.github", "links.portfolio", "links.other", "skills")
#: Repeats of one source that still change four decimals are far fewer.
MOST_REPEATS = 2000


def weight_of(source: Column, path: Column | str, trust: dict[str, str] | None = None) -> Column:
    """Trust weight of a source for the field behind an output path."""
    trust = trust or _FIELDS
    path = F.lit(path) if isinstance(path, str) else path
    pairs = {f"{s}|{p}": R.WEIGHTS[s, t] for p, t in trust.items() for s in R.SOURCE_TRUST}
    return F.coalesce(F.try_element_at(literal_map(pairs), F.concat(source, F.lit("|"), path)), F.lit(R.DEFAULT_TRUST))


def known_weight(source: str, path: Column | str) -> Column:
    """``weight_of`` for a source that is known when the query is made."""
    if isinstance(path, str):
        return F.lit(R.WEIGHTS[source, _FIELDS[path]] if path in _FIELDS else R.DEFAULT_TRUST)
    return F.coalesce(lookup({p: R.WEIGHTS[source, t] for p, t in _FIELDS.items()}, path), F.lit(R.DEFAULT_TRUST))


def counts() -> list[Column]:
    """How many contributions each source made; weights differ by source alone, so that these are all noisy-OR needs."""
    known = [F.count_if(F.col("source") == s).alias(f"n_{s}") for s in R.SOURCE_TRUST]
    return [*known, F.count_if(~F.col("source").isin(*R.SOURCE_TRUST)).alias("n_other"), F.collect_set(F.struct(priority("source").alias("prio"), "source")).alias("from")]


def confidence(path: Column | str) -> Column:
    """The noisy-OR of ``counts``, source by source in a fixed order: one factor as often as its source speaks."""
    left = F.lit(1.0)
    for n, w in [*((f"n_{s}", known_weight(s, path)) for s in R.SOURCE_TRUST), ("n_other", F.lit(R.DEFAULT_TRUST))]:
        rest = F.lit(1.0) - F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))
        left = F.aggregate(F.array_repeat(rest, F.least(F.col(n), F.lit(MOST_REPEATS)).cast("int")), left, lambda a, x: a * x)
    return round4(F.lit(1.0) - left)


def claims(records: DataFrame) -> DataFrame:
    """cluster, path, value (text), source: what each record says."""
    said = {**{p: F.array(F.col(p.split(".")[-1]).cast("string")) for p in SCALARS}, "emails": F.col("emails"), "phones": F.col("phones"), "links.other": F.col("other_links"), "skills": F.col("skills")}
    # two plain generators and no lambda, so that all of it is compiled
    each = records.select("cluster", "source", F.inline(F.array(*(F.struct(F.lit(p).alias("path"), v.alias("values")) for p, v in said.items()))))
    return each.select("cluster", "path", F.explode("values").alias("value"), "source").where("value is not null and value <> ''")


def evidence(said: DataFrame) -> DataFrame:
    """cluster, path, value, conf, sources (by priority), source (of the greatest weight), prio (its).

    Only numbers are aggregated over all claims: which of the known sources there are follows from their counts, and the names of other
    sources, if any, are gathered apart."""
    keys = ("cluster", "path", "value")
    told = lambda s, w: F.struct(priority(s).alias("prio"), s.alias("source"), w.alias("w"))
    *numbers, _ = counts()
    found = said.groupBy(*keys).agg(*numbers)
    others = said.where(~F.coalesce(F.col("source").isin(*R.SOURCE_TRUST), F.lit(False))).groupBy(*keys).agg(F.array_sort(F.collect_set(told(F.col("source"), F.lit(R.DEFAULT_TRUST)))).alias("others"))
    same = lambda k: F.col(f"f.{k}").eqNullSafe(F.col(f"o.{k}"))
    found = found.alias("f").join(others.alias("o"), same("cluster") & same("path") & same("value"), "left").select("f.*", "o.others")
    known = sorted(R.SOURCE_TRUST, key=lambda s: (R.SOURCE_PRIORITY[s], s))
    own = F.filter(F.array(*(F.when(F.col(f"n_{s}") > 0, told(F.lit(s), known_weight(s, F.col("path")))) for s in known)), lambda x: x.isNotNull())
    df = found.select(*keys, confidence(F.col("path")).alias("conf"), F.when(F.col("others").isNull(), own).otherwise(F.concat(own, "others")).alias("by"))
    best = F.array_min(F.transform("by", lambda x: F.struct((-x["w"]).alias("w"), x["prio"].alias("prio"), x["source"].alias("source"))))
    df = df.select(*keys, "conf", F.col("by.source").alias("sources"), best.alias("best"))
    return df.select(*keys, "conf", "sources", F.col("best.source").alias("source"), F.col("best.prio").alias("prio"))


def merged_items(records: DataFrame, kind: str, key: tuple[str, str], fields: tuple[str, ...], order: Column) -> DataFrame:
    """cluster, x (struct of order, first, item: the fields, source, conf): entries with one key are merged, each field from its best source."""
    each = records.select("cluster", "source", "rec", priority("source").alias("prio"), F.posexplode(kind).alias("at", "it"))
    each = each.select("*", "it.*", field_weight("source", kind).alias("w"), F.lower(F.coalesce(f"it.{key[0]}", F.lit(""))).alias("k1"), F.lower(F.coalesce(f"it.{key[1]}", F.lit(""))).alias("k2"))
    pick = lambda f: F.min(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.struct(-F.col("w"), "prio", F.col(f).cast("string").alias("text"), f)))[f].alias(f)
    winner = F.min(F.struct(-F.col("w"), "prio", "source"))["source"].alias("winner")
    *numbers, _ = counts()
    merged = each.groupBy("cluster", "k1", "k2").agg(*map(pick, fields), winner, F.min(F.struct("prio", "source", "rec", "at")).alias("first"), *numbers)
    return merged.select("cluster", F.struct(order.alias("order"), "first", F.struct(*fields).alias("item"), F.col("winner").alias("source"), confidence(kind).alias("conf")).alias("x"))


def _later_first(found: Column) -> Column:
    down = lambda a, b: F.when(a["order"] > b["order"], -1).when(a["order"] < b["order"], 1).when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0)
    return F.array_sort(found, down)


def items(records: DataFrame, kind: str, key: tuple[str, str], fields: tuple[str, ...], order: Column) -> DataFrame:
    """cluster, items of ``merged_items``, later first."""
    return merged_items(records, kind, key, fields, order).groupBy("cluster").agg(_later_first(F.collect_list("x")).alias(kind))


def merge_clusters(records: DataFrame) -> DataFrame:
    """One profile a cluster: cluster, candidate_id and the default output fields."""
    found = evidence(claims(records)).select("cluster", F.struct("path", "value", "conf", "prio", "source", "sources").alias("ev"))
    jobs = merged_items(records, "experience", ("company", "title"), ("company", "title", "start", "end", "summary"), F.coalesce("start", F.lit("0000-00"))).withColumnRenamed("x", "experience")
    courses = merged_items(records, "education", ("institution", "degree"), ("institution", "degree", "field", "end_year"), F.coalesce("end_year", F.lit(0))).withColumnRenamed("x", "education")
    df = records.select("cluster").distinct()
    for part, c in ((found, "ev"), (jobs, "experience"), (courses, "education")):
        df = df.join(part.groupBy("cluster").agg(F.collect_list(c).alias(c)), "cluster", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    df = df.select("cluster", none("ev").alias("ev"), *(_later_first(none(c)).alias(c) for c in ("experience", "education")))
    of = lambda p: F.filter("ev", lambda e: e["path"] == p)
    compare = lambda *ks: lambda a, b: _compare(a, b, ks)
    best = lambda p: F.slice(F.array_sort(of(p), compare("conf", "prio", "value")), 1, 1)
    every = lambda p: F.array_sort(of(p), compare("conf", "value"))
    df = df.select("cluster", "experience", "education", *((best(p) if p in SCALARS else every(p)).alias(p.replace(".", "_") + "_ev") for p in ORDER))
    ev = {p: F.col(p.replace(".", "_") + "_ev") for p in ORDER}
    value = lambda p: F.get(ev[p], F.lit(0))["value"]
    values = lambda p: F.transform(ev[p], lambda e: e["value"])
    entry = lambda field, source, how: F.struct(field.alias("field"), source.alias("source"), how.alias("method"))

    def entries(p: str) -> Column:
        if p in SCALARS:
            return F.transform(ev[p], lambda e: entry(F.lit(p), e["source"], method(e["source"], SCALARS[p][1])))
        name = (lambda e: F.concat(F.lit("skills:"), e["value"])) if p == "skills" else (lambda e: F.lit(p))
        return F.flatten(F.transform(ev[p], lambda e: F.transform(e["sources"], lambda s: entry(name(e), s, method(s, LISTS[p][1])))))

    def numbered(kind: str) -> Column:
        return F.transform(kind, lambda x, i: entry(F.concat(F.lit(f"{kind}["), i.cast("string"), F.lit("]")), x["source"], method(x["source"])))

    prov = [*map(entries, ORDER), numbered("experience"), numbered("education")]
    confs = F.concat(*(F.transform(ev[p], lambda e: e["conf"]) for p in ORDER), *(F.transform(k, lambda x: x["conf"]) for k in ("experience", "education")))
    has = lambda *ps: F.when(F.greatest(*(F.size(ev[p]) if p in ev else F.size(p) for p in ps), F.lit(0)) > 0, 1).otherwise(0)
    cover = sum((has(*ps) for ps in (("full_name",), ("emails",), ("phones",), ("location.city", "location.region", "location.country"), ("skills",), ("experience",))), F.lit(0)) / F.lit(6)
    return df.select(
        "cluster", candidate_id(values("emails"), value("full_name"), values("phones")).alias("candidate_id"), value("full_name").alias("full_name"), values("emails").alias("emails"), values("phones").alias("phones"),
        F.struct(*(value(f"location.{x}").alias(x) for x in ("city", "region", "country"))).alias("location"), F.struct(*(value(f"links.{x}").alias(x) for x in ("linkedin", "github", "portfolio")), values("links.other").alias("other")).alias("links"),
        value("headline").alias("headline"), value("years_experience").cast("double").alias("years_experience"), F.transform(ev["skills"], lambda e: F.struct(e["value"].alias("name"), e["conf"].alias("confidence"), e["sources"].alias("sources"))).alias("skills"),
        F.transform("experience", lambda x: x["item"]).alias("experience"), F.transform("education", lambda x: x["item"]).alias("education"), F.concat(*prov).alias("provenance"), mean_times(confs, cover).alias("overall_confidence"),
    )


def _compare(a: Column, b: Column, keys: tuple[str, ...]) -> Column:
    """Comparator: confidence falling, the other keys rising."""
    out = F.lit(0)
    for k in reversed(keys):
        up, down = (1, -1) if k == "conf" else (-1, 1)
        out = F.when(a[k] < b[k], up).when(a[k] > b[k], down).otherwise(out)
    return out
