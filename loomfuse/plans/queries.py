"""Registered queries of the engine's operators over the driver's tables, and their SQL.

The tables hold no person records, so each query builds an operator's input from columns that are there."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomfuse.functions import normalize as N
from loomfuse.functions import rules as R
from loomfuse.functions.confidence import field_weight, mean_times, method
from loomfuse.functions.text import distinct_present, round4
from loomfuse.operators import identity, profiles, ranking
from loomfuse.operators.projection import project, render
from loomfuse.operators.records import normalize_records
from loomfuse.operators.validation import config_errors
from loomfuse.plans.components import _cut, connected_components, shared_dir
from loomfuse.plans.config import OutputConfig
from loomfuse.plans.pipeline import Source, build_profiles, extract_all, shape, write_outputs
from loomfuse.sources import readers
from loomfuse.sources.datasource import read_export
from loomfuse.sources.schemas import as_raw
from loomfuse.streaming.incremental import ProfileStore


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_NORM_EMAIL = "regexp_replace(replace(lower(trim(e)), 'mailto:', ''), '^[<>]+|[<>]+$', '', 'g')"


@query(f"""SELECT doc_id, e AS email, {_NORM_EMAIL} AS email_norm FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}'))) AS e FROM documents)""")
def email_extract_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "documents").select("doc_id", F.explode(readers.scan_emails(F.col("text"))).alias("email"))
    return df.select("doc_id", "email", N.email("email").alias("email_norm"))


@query()
def phone_digit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones of all whole texts. DuckDB's expressions have no look-around, so there is no SQL; a brute-force scan is the test."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(readers.scan_phones(F.col("text"))).alias("phone"))


@query("""SELECT page_id, rtrim(CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url ELSE 'https://' || url END, '/') AS url_norm,
  CASE WHEN contains(lower(url), 'linkedin.com') THEN 'linkedin' WHEN contains(lower(url), 'github.com') OR contains(lower(url), 'github.io') THEN 'github' ELSE 'other' END AS kind FROM pages""")
def url_normalize_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", N.url("url").alias("url_norm"), N.link_kind("url").alias("kind"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace(trim(p_name), '\\s+', ' ', 'g'), ' '), lambda t: CASE WHEN t = lower(t) OR t = upper(t) THEN upper(t[1]) || lower(t[2:]) ELSE t END), ' ') AS name,
  nullif(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), '') AS name_key FROM part""")
def name_case_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", N.name("p_name").alias("name"), N.name_key("p_name").alias("name_key"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month_iso, strftime(o_orderdate, '%Y-%m') AS month_name, strftime(o_orderdate, '%Y-%m') AS month_slash, strftime(o_orderdate, '%Y') || '-01' AS month_year, CAST(year(o_orderdate) AS INTEGER) AS year_found, CAST(NULL AS VARCHAR) AS month_now FROM orders""")
def month_year_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", N.month(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).alias("month_iso"), N.month(F.date_format(d, "MMMM yyyy")).alias("month_name"), N.month(F.date_format(d, "M/yyyy")).alias("month_slash"),
        N.month(F.date_format(d, "yyyy")).alias("month_year"), N.year(F.concat(F.lit("class of "), F.date_format(d, "yyyy"))).alias("year_found"), N.month(F.lit(" Present ")).alias("month_now"),
    )


_LANDS = ("India", "U.S.", "DEU", "es", "Canada", "CA", "Atlantis")


@query("""SELECT c_custkey, c_name AS city, CASE WHEN k IN (5, 6) THEN ['India', 'U.S.', 'DEU', 'es', 'Canada', 'CA', 'Atlantis'][k + 1] ELSE CAST(NULL AS VARCHAR) END AS region, ['IN', 'US', 'DE', 'ES', 'CA', NULL, NULL][k + 1] AS country FROM (SELECT c_custkey, c_name, c_nationkey % 7 AS k FROM customer)""")
def location_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = F.get(F.array(*map(F.lit, _LANDS)), F.col("c_nationkey") % len(_LANDS))
    df = _t(spark, sf_dir, "customer").select("c_custkey", N.location(F.concat(F.col("c_name"), F.lit(", "), land)).alias("at"))
    return df.select("c_custkey", "at.city", "at.region", "at.country")


_PHONES = (("+1 (415) 555-01", "US"), ("98765432", "IN"), ("+34 612 345 6", "US"), ("12", "US"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+1415555' || '01' || d WHEN 1 THEN '+9198765432' || d WHEN 2 THEN '+346123456' || d ELSE CAST(NULL AS VARCHAR) END AS e164 FROM (SELECT c_custkey, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS d FROM customer)""")
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get(F.array(*(F.lit(p[i]) for p in _PHONES)), (F.col("c_custkey") % 4).cast("int"))
    tail = F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")
    return _t(spark, sf_dir, "customer").select("c_custkey", N.phone(F.concat(at(0), F.when(F.col("c_custkey") % 4 == 3, "").otherwise(tail)), at(1)).alias("e164"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Kubernetes' WHEN 1 THEN 'Node.js' WHEN 2 THEN 'C++' WHEN 3 THEN 'XY' WHEN 4 THEN 'Deep Thought' ELSE 'Python' END AS skill, p_size % 6 NOT IN (3, 4) AS known FROM part""")
def skill_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.get(F.array(*map(F.lit, (" K8S.", "node.js", "c++", "xy", "deep  thought", "PY;"))), F.col("p_size") % 6)
    return _t(spark, sf_dir, "part").select("p_partkey", N.skill(given).alias("skill"), N.is_known_skill(given).alias("known"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS other FROM events""")
def json_alias_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return _t(spark, sf_dir, "events").select("event_id", readers.json_text(v, "absent", "k").alias("k"), readers.json_text(v, "absent").alias("other"))


@query("""SELECT doc_id, n, trim(line) AS line, CASE lower(trim(line)) WHEN 'skills' THEN 'skills' ELSE CAST(NULL AS VARCHAR) END AS section FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents) WHERE len(trim(line)) BETWEEN 1 AND 30""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return df.where(F.length(F.trim("line")).between(1, 30)).select("doc_id", F.col("n").cast("long").alias("n"), F.trim("line").alias("line"), readers.heading(F.col("line")).alias("section"))


@query("""SELECT conv_id, turn, count(*) AS blocks, CAST(sum(len(b)) AS BIGINT) AS chars FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '\\n\\s*\\n')) AS b FROM conversations) WHERE trim(b, chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY conv_id, turn""")
def notes_block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(readers.split_notes(F.col("text"))).alias("b"))
    return df.groupBy("conv_id", "turn").agg(F.count("*").alias("blocks"), F.sum(F.length("b")).cast("long").alias("chars"))


@query("""SELECT c_custkey, 'cand_' || substr(sha1(lower(c_name) || '@example.com'), 1, 10) AS by_email, 'cand_' || substr(sha1(trim(regexp_replace(lower(c_name), '[^a-z0-9 ]', '', 'g'))), 1, 10) AS by_name FROM customer""")
def candidate_id_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    mail = F.array(F.concat(F.lower("c_name"), F.lit("@example.com")))
    return _t(spark, sf_dir, "customer").select("c_custkey", identity.candidate_id(mail, F.col("c_name"), none).alias("by_email"), identity.candidate_id(none, F.col("c_name"), none).alias("by_name"))


@query("""WITH RECURSIVE k AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS key FROM supplier UNION ALL SELECT s_suppkey, 'a' || CAST(floor(s_acctbal / 50) AS BIGINT) FROM supplier),
m AS (SELECT key, min(id) AS lead FROM k GROUP BY key), e AS (SELECT id AS u, lead AS v FROM k JOIN m USING (key) UNION SELECT lead, id FROM k JOIN m USING (key)),
r AS (SELECT u AS x, u AS y FROM e UNION SELECT r.x, e.v FROM r JOIN e ON r.y = e.u)
SELECT x AS s_suppkey, min(y) AS component FROM r GROUP BY x""")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share a nation or a balance band, over chains of such links."""
    s = _t(spark, sf_dir, "supplier")
    keys = s.select("s_suppkey", F.explode(F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("a"), F.floor(F.col("s_acctbal") / 50).cast("string")))).alias("key"))
    labels = connected_components(identity.star_edges(keys, "key", "s_suppkey"))
    return s.select("s_suppkey").join(labels.withColumnRenamed("u", "s_suppkey"), "s_suppkey", "left").select("s_suppkey", F.coalesce("label", "s_suppkey").alias("component"))


_SOURCES = "['recruiter_csv', 'ats_json', 'resume', 'recruiter_notes']"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of sources about customers: an order's priority class, said by one of the four sources."""
    source = F.get(F.array(*map(F.lit, R.SOURCE_TRUST)), (F.col("o_orderkey") % 4).cast("int"))
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster"), F.lit("headline").alias("path"), F.col("o_orderpriority").alias("value"), source.alias("source"))


_EVIDENCE = f"""c AS (SELECT o_custkey AS cluster, o_orderpriority AS value, {_SOURCES}[o_orderkey % 4 + 1] AS source, o_orderkey % 4 AS prio, [0.63, 0.8075, 0.72, 0.25][o_orderkey % 4 + 1]::DOUBLE AS w FROM orders),
g AS (SELECT cluster, value, list(w ORDER BY prio) AS ws, min(prio) AS first, list(DISTINCT prio) AS ps FROM c GROUP BY cluster, value),
ev AS (SELECT cluster, value, CAST(printf('%.4f', 1.0 - list_reduce(list_prepend(1.0::DOUBLE, ws), lambda a, x: a * (1.0 - x))) AS DOUBLE) AS conf,
  CASE WHEN list_contains(ps, 1) THEN 1 WHEN list_contains(ps, 2) THEN 2 WHEN list_contains(ps, 0) THEN 0 ELSE 3 END AS best, array_to_string(list_transform(list_sort(ps), lambda p: {_SOURCES}[p + 1]), ',') AS sources FROM g)"""


@query(f"WITH {_EVIDENCE} SELECT cluster, value, conf, {_SOURCES}[best + 1] AS source, sources FROM ev")
def noisy_or_multi_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.evidence(_claims(spark, sf_dir)).select("cluster", "value", "conf", "source", F.concat_ws(",", "sources").alias("sources"))


@query(f"WITH {_EVIDENCE} SELECT 's' || cluster || '@example.com' AS email, value AS headline, {_SOURCES}[best + 1] AS source FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY conf DESC, best, value) AS rn FROM ev) WHERE rn = 1")
def scalar_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline that profiles choose among those of four sources, and whose it is."""
    source = F.get(F.array(*map(F.lit, R.SOURCE_TRUST)), (F.col("o_orderkey") % 4).cast("int"))
    raw = _t(spark, sf_dir, "orders").select(F.lit(0).alias("spec_idx"), F.col("o_orderkey").alias("pos"), source.alias("source"), F.array(F.concat(F.lit("s"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).alias("emails"), F.col("o_orderpriority").alias("headline"))
    told = F.get(F.filter("provenance", lambda p: p["field"] == "headline"), F.lit(0))["source"]
    return build_profiles(as_raw(raw)).select(F.get("emails", F.lit(0)).alias("email"), "headline", told.alias("source"))


_FIELDS = ("full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education")
_WEIGHTS = ((0.9, 0.85, 0.76, 0.4), (0.9, 0.85, 0.76, 0.35), (0.9, 0.85, 0.76, 0.35), (0.855, 0.8075, 0.72, 0.25), (0.45, 0.85, 0.8, 0.2), (0.63, 0.8075, 0.72, 0.25), (0.36, 0.8075, 0.72, 0.3), (0.45, 0.765, 0.8, 0.35), (0.54, 0.765, 0.8, 0.15), (0.18, 0.765, 0.8, 0.15))


@query(f"""SELECT c_custkey, {list(_FIELDS)}[c_custkey % 10 + 1] AS field, CASE WHEN s = 5 THEN 0.5::DOUBLE ELSE (CAST({[list(w) for w in _WEIGHTS]} AS DOUBLE[][]))[c_custkey % 10 + 1][s] END AS w,
  ['direct+x', 'remapped+x', 'extracted+x', 'extracted+x', 'extracted+x'][s] AS m FROM (SELECT c_custkey, c_nationkey % 5 + 1 AS s FROM customer)""")
def trust_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and method of claims on every field by every source, one of them unknown."""
    source = F.get(F.array(*map(F.lit, (*R.SOURCE_TRUST, "elsewhere"))), F.col("c_nationkey") % 5)
    k = (F.col("c_custkey") % 10).cast("int")
    w = F.get(F.array(*(field_weight(source, f) for f in _FIELDS)), k)
    return _t(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*map(F.lit, _FIELDS)), k).alias("field"), w.alias("w"), method(source, "x").alias("m"))


@query("""WITH l AS (SELECT l_orderkey, CAST(printf('%.4f', l_discount * 10) AS DOUBLE) AS c, l_linenumber FROM lineitem), g AS (SELECT l_orderkey, list(c ORDER BY l_linenumber, c) AS cs FROM l GROUP BY l_orderkey)
SELECT l_orderkey, CAST(printf('%.4f', list_reduce(list_prepend(0.0::DOUBLE, cs), lambda a, b: a + b) / len(cs) * 0.5) AS DOUBLE) AS overall FROM g""")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", round4(F.col("l_discount") * 10).alias("c"))))
    df = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("xs"))
    return df.select("l_orderkey", mean_times(F.transform("xs", lambda x: x["c"]), F.lit(0.5)).alias("overall"))


@query("""WITH i AS (SELECT l_orderkey, lower(l_shipinstruct) AS k FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipinstruct FROM lineitem)), g AS (SELECT l_orderkey, k, count(*) AS n FROM i GROUP BY l_orderkey, k)
SELECT l_orderkey, k AS company, CAST(printf('%.4f', 1.0 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(n), lambda x: 0.765::DOUBLE)), lambda a, w: a * (1.0 - w))) AS DOUBLE) AS conf FROM g""")
def list_item_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employments of an order: lines with one return flag and status are one entry, said once a line."""
    line = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lower(F.concat("l_returnflag", "l_linestatus")).alias("company"), *(F.lit(None).cast("string").alias(n) for n in ("title", "start", "end", "summary")))).alias("experience"))
    df = line.select(F.col("l_orderkey").alias("cluster"), F.lit("ats_json").alias("source"), F.struct(F.lit(0).alias("spec_idx"), F.col("l_orderkey").alias("pos")).alias("rec"), "experience")
    got = profiles.items(df, "experience", ("company", "title"), ("company", "title", "start", "end", "summary"), F.coalesce("start", F.lit("0000-00")))
    return got.select(F.col("cluster").alias("l_orderkey"), F.explode("experience").alias("x")).select("l_orderkey", F.col("x.item.company").alias("company"), F.col("x.conf").alias("conf"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW rows of customers (delimited) and suppliers (JSON): those of one nation and number share an e-mail."""
    mail = lambda n, k: F.array(F.concat(F.lit("P"), n.cast("string"), F.lit("."), k.cast("string"), F.lit("@Example.com")))
    c = _t(spark, sf_dir, "customer").select(F.lit(0).alias("spec_idx"), F.col("c_custkey").alias("pos"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("full_name"), mail(F.col("c_nationkey"), F.col("c_custkey") % 40).alias("emails"), F.lit("recruiter_csv").alias("source"), F.col("c_mktsegment").alias("headline"), F.lit("Bengaluru, India").alias("location_text"))
    s = _t(spark, sf_dir, "supplier").select(F.lit(1).alias("spec_idx"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("SUPPLIER "), F.col("s_suppkey").cast("string")).alias("full_name"), mail(F.col("s_nationkey"), F.col("s_suppkey") % 40).alias("emails"), F.lit("ats_json").alias("source"), F.lit("supplies").alias("headline"), F.lit("Madrid, Spain").alias("location_text"))
    return as_raw(c).unionByName(as_raw(s))


_PEOPLE = """p AS (SELECT 0 AS spec, c_custkey AS pos, 'Customer ' || c_custkey AS name, 'p' || c_nationkey || '.' || c_custkey % 40 || '@example.com' AS mail, 0.9::DOUBLE AS w FROM customer UNION ALL SELECT 1, s_suppkey, 'Supplier ' || s_suppkey, 'p' || s_nationkey || '.' || s_suppkey % 40 || '@example.com', 0.85::DOUBLE FROM supplier)"""


_LAND = "CASE WHEN c > 0 AND CAST(printf('%.4f', 1.0 - pow(0.145, c)) AS DOUBLE) >= CAST(printf('%.4f', 1.0 - pow(0.1925, s)) AS DOUBLE) THEN 'IN' ELSE 'ES' END"


@query(f"""WITH {_PEOPLE}, g AS (SELECT mail, count(*) FILTER (spec = 0) AS c, count(*) FILTER (spec = 1) AS s, min(name) FILTER (spec = 0) AS cn, min(name) FILTER (spec = 1) AS sn FROM p GROUP BY mail)
SELECT mail AS email, 'cand_' || substr(sha1(mail), 1, 10) AS candidate_id, coalesce(cn, sn) AS full_name, {_LAND} AS country, CASE WHEN {_LAND} = 'IN' THEN 'Bengaluru' ELSE 'Madrid' END AS city FROM g""")
def profile_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine over records of two sources: normalize, resolve, merge."""
    return build_profiles(_people(spark, sf_dir)).select(F.get("emails", F.lit(0)).alias("email"), "candidate_id", "full_name", F.col("location.country").alias("country"), F.col("location.city").alias("city"))


_CONFIG = {"fields": [{"path": "who.mail", "from": "emails[0]", "type": "string", "required": True}, {"path": "country", "from": "location.country", "normalize": "iso3166", "type": "string"}, {"path": "sites", "from": "links.other", "on_missing": "omit"}, {"path": "first_skill", "from": "skills[0].name"}], "include_confidence": False, "include_provenance": False}


@query(f"""WITH {_PEOPLE} SELECT DISTINCT '{{"who": {{"mail": "' || mail || '"}}, "country": "' || CASE WHEN c > 0 AND pow(0.145, c) <= pow(0.1925, s) THEN 'IN' ELSE 'ES' END || '", "first_skill": null}}' AS json, CAST(0 AS INTEGER) AS n_errors FROM (SELECT mail, count(*) FILTER (spec = 0) AS c, count(*) FILTER (spec = 1) AS s FROM p GROUP BY mail)""")
def project_config_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, renamed, normalized, omitted and null fields of profiles, with their checks."""
    config = OutputConfig.from_dict(_CONFIG)
    df = project(build_profiles(_people(spark, sf_dir).where(F.col("spec_idx").isNotNull())), config)
    return df.select(render(df, [f.path for f in config.fields]).alias("json"), F.size(F.concat("errors", config_errors(df, config))).alias("n_errors"))


@query("""SELECT doc_id, CAST(hits AS BIGINT) AS hits, CAST(printf('%.4f', 0.6 * (hits / 3.0::DOUBLE) + 0.4 * 0.5) AS DOUBLE) AS score FROM (SELECT doc_id, CAST(regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])') AS INTEGER) + CAST(regexp_matches(lower(text), '(^|[^a-z0-9])mit license($|[^a-z0-9])') AS INTEGER) + CAST(regexp_matches(lower(text), '(^|[^a-z0-9])der($|[^a-z0-9])') AS INTEGER) AS hits FROM documents)""")
def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ranking.parse_keywords("The, MIT  License;der\nthe")
    text = F.lower("text")
    hits = F.size(ranking.keyword_hits(words, text, F.array(F.lit("no skill"))))
    df = _t(spark, sf_dir, "documents").select("doc_id", hits.cast("long").alias("hits"))
    return df.select("doc_id", "hits", ranking.blend(F.lit(0.5), F.col("hits") / F.lit(3.0)).alias("score"))


@query("""SELECT o_orderkey, CAST(printf('%.4f', o_totalprice / 7000.0) AS DOUBLE) AS rounded, CASE WHEN o_totalprice / 400000.0 >= 0.8 THEN 'green' WHEN o_totalprice / 400000.0 >= 0.5 THEN 'amber' ELSE 'red' END AS band FROM orders""")
def round_and_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", round4(F.col("o_totalprice") / 7000.0).alias("rounded"), ranking.band(F.col("o_totalprice") / 400000.0).alias("band"))


@query("""SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, count(*) AS n FROM events WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY user_id""")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_type")).alias("ks"), F.count("event_type").alias("n"))
    return df.select("user_id", F.concat_ws(",", distinct_present("ks")).alias("kinds"), "n")


# ---- readers and what follows them ----------------------------------------------------------------------


def _letters(key: str) -> Column:
    """A word of letters for a number, as names have no digits."""
    return F.translate(F.col(key).cast("string"), "0123456789", "abcdefghij")


_L = "translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"


_SHEET = """SELECT CAST(c_custkey AS BIGINT) AS k, 'Customer ' || c_custkey AS full_name, 'c' || c_custkey || '@example.com' AS email, '+1 415 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Firm, ' || c_nationkey END AS company, c_mktsegment AS title, 'recruiter_csv' AS source FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_custkey, NULL, 'c' || c_custkey || '@example.com', NULL, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Firm, ' || c_nationkey END, c_mktsegment, 'recruiter_csv' FROM customer WHERE c_custkey % 5 = 0"""


def _sheet(spark: SparkSession, sf_dir: str) -> str:
    """Folder of a delimited export of the customers, in two files."""
    k = F.col("c_custkey")
    named = k % 5 != 0
    sheet = _t(spark, sf_dir, "customer").select(
        F.when(named, F.concat(F.lit("Customer "), k.cast("string"))).alias("Candidate Name"), F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com")).alias("E-Mail"), F.when(named, F.concat(F.lit("+1 415 555 "), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise("  ").alias("Mobile"),
        F.when(k % 3 != 0, F.concat(F.lit("Firm, "), F.col("c_nationkey").cast("string"))).alias("Employer"), F.col("c_mktsegment").alias("Role"), F.concat(F.lit('says "x",\nand, on a line of its own,\n"'), k.cast("string"), F.lit('" \n')).alias("Unknown column"),
    )
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}.csv"
    sheet.coalesce(2).write.option("header", True).option("escape", '"').csv(folder)
    return folder


def _sheet_told(got: DataFrame) -> DataFrame:
    job = F.get("experience", F.lit(0))
    number = F.regexp_extract(F.get("emails", F.lit(0)), r"\d+", 0).cast("long")
    return got.select(number.alias("k"), "full_name", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"), job["company"].alias("company"), job["title"].alias("title"), "source")


@query(_SHEET)
def delimited_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as two delimited files with other header spellings, blank cells and line ends in quotes, and read back by byte ranges."""
    return _sheet_told(readers.READERS[readers.detect_type("export.CSV")](spark, _sheet(spark, sf_dir)))


@query(_SHEET)
def data_source_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same export through the data source, with the columns that are asked for."""
    columns = ["source", "full_name", "emails", "phones", "experience"]
    return _sheet_told(read_export(spark, _sheet(spark, sf_dir), f"{shared_dir(spark)}/states-{uuid.uuid4().hex}", columns))


_APPLICANTS = f"""SELECT CAST(c_custkey AS BIGINT) AS k, 'Customer ' || c_custkey AS full_name, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey || '@x.com,b' || c_custkey || '@x.com' ELSE 'a' || c_custkey || '@x.com' END AS emails, c_mktsegment AS city, CASE WHEN c_custkey % 3 = 0 THEN 'https://github.com/u' || c_custkey ELSE 'http://github.com/u' || c_custkey END AS github,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 30 AS DOUBLE) END AS years_num, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 30) || ' years' END AS years_txt, CASE WHEN c_custkey % 7 = 0 THEN 'Python' ELSE 'Python,k8s' END AS skills, 'Firm ' || c_nationkey || '/Engineer/2019-0' || (c_custkey % 9 + 1) AS job, 'School ' || c_nationkey || '/B.Sc/20' || lpad(CAST(c_custkey % 20 AS VARCHAR), 2, '0') AS course FROM customer"""


def _applicant() -> Column:
    """A customer as an applicant of a JSON export."""
    k, text = F.col("c_custkey"), lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    n = k.cast("string")
    contact = F.struct(F.when(k % 2 == 0, text("a", n, "@x.com")).alias("primaryEmail"), F.when(k % 2 == 1, text("a", n, "@x.com")).alias("email"), F.when(k % 2 == 0, text("b", n, "@x.com")).alias("altEmail"))
    social = F.struct(F.when(k % 3 == 0, text("u", n)).alias("githubHandle"), F.when(k % 3 != 0, text("http://github.com/u", n)).alias("githubUrl"))
    job = F.struct(text("Firm ", F.col("c_nationkey").cast("string")).alias("employer"), F.lit("Engineer").alias("designation"), text("2019-0", (k % 9 + 1).cast("string")).alias("from"))
    course = F.struct(text("School ", F.col("c_nationkey").cast("string")).alias("school"), F.lit("B.Sc").alias("qualification"), (F.lit(2000) + k % 20).alias("yearOfPassing"))
    return F.struct(
        text("Customer ", n).alias("applicant_name"), contact.alias("contact"), F.struct(F.col("c_mktsegment").alias("town")).alias("addr"), social.alias("social"), F.when(k % 4 == 0, k % 30).alias("yearsOfExperience"), F.when(k % 4 != 0, text((k % 30).cast("string"), " years")).alias("experienceYears"),
        F.when(k % 7 == 0, F.lit("Python")).alias("skills"), F.when(k % 7 != 0, F.array(F.lit("Python"), F.lit("k8s"))).alias("skillSet"), F.array(job).alias("employmentHistory"), course.alias("academics"), k.alias("number"),
    )


def _told(got: DataFrame) -> DataFrame:
    """What the readers found of ``_applicant``."""
    job, course = F.get("experience", F.lit(0)), F.get("education", F.lit(0))
    return got.select(
        F.regexp_extract("full_name", r"\d+", 0).cast("long").alias("k"), "full_name", F.array_join("emails", ",").alias("emails"), "city", "github", "years_num", "years_txt", F.array_join("skills", ",").alias("skills"),
        F.concat_ws("/", job["company"], job["title"], job["start"]).alias("job"), F.concat_ws("/", course["institution"], course["degree"], course["end_year"]).alias("course"),
    )


@query(_APPLICANTS)
def json_export_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of nested JSON, one a nation, that wrap applicants under other names and spell keys, lists and links in other ways."""
    files = _t(spark, sf_dir, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 64).alias("part")).agg(F.collect_list(_applicant()).alias("people"))
    files = files.select(F.col("c_nationkey").alias("spec_idx"), F.lit("export.json").alias("path"), F.when(F.col("part") % 2 == 0, F.to_json(F.struct(F.col("people").alias("applicants")))).otherwise(F.to_json("people")).alias("text"))
    return _told(readers.read_json(files))


@query(_APPLICANTS)
def json_ranges_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applicants in two JSON documents, written by two tasks and read by as many as there are byte ranges."""
    rows = _t(spark, sf_dir, "customer").select(F.to_json(_applicant()).alias("value")).repartition(2)

    def document(batches):
        yield pa.RecordBatch.from_arrays([pa.array(['{"version": {"of": "[{"}, "applicants": ['])], names=["value"])
        comma = ""
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([(comma if not i else ",") + x for i, x in enumerate(b.column(0).to_pylist())], pa.string())], names=["value"])
            comma = "," if comma or b.num_rows else ""
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["value"])

    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    rows.mapInArrow(document, "value string").write.text(folder)
    return _told(readers.READERS["ats_json"](spark, folder))


@query(f"""SELECT 'Mx ' || {_L.format('c_custkey')} AS full_name, 'p' || c_custkey || '@example.com' AS email, '+1 415 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, CAST(c_custkey % 20 + 1 AS VARCHAR) AS years_txt, CASE WHEN c_custkey % 2 = 0 THEN 'k8s,python' ELSE 'golang' END AS skills FROM customer""")
def notes_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of free text, one file a nation and number, with a block for each customer."""
    k = F.col("c_custkey")
    block = F.concat(
        F.lit("Candidate: Mx "), _letters("c_custkey"), F.lit(" <p"), k.cast("string"), F.lit("@example.com>\nabout "), (k % 20 + 1).cast("string"), F.lit("+ yrs, call +1 415 555 "), F.lpad((k % 10000).cast("string"), 4, "0"), F.when(k % 2 == 0, F.lit(". Knows Python and k8s well.")).otherwise(F.lit(". Golang, not Javanese.")),
    )
    files = _t(spark, sf_dir, "customer").groupBy("c_nationkey", (k % 64).alias("part")).agg(F.array_join(F.collect_list(block), "\n\n").alias("text"))
    got = readers.read_notes(files.select(F.col("c_nationkey").alias("spec_idx"), F.lit("notes.txt").alias("path"), "text"))
    one = lambda c: F.get(c, F.lit(0))
    return got.select("full_name", one("emails").alias("email"), one("phones").alias("phone"), "years_txt", F.array_join(F.array_sort("skills"), ",").alias("skills"))


@query(f"""SELECT 'Kim ' || upper(substr(w, 1, 1)) || substr(w, 2) AS full_name, 'Chief of ' || w AS headline, 'k' || s_suppkey || '@example.com' AS email, 'github.com/k' || s_suppkey AS github, 'Engineer at Firm ' || w || ' (' || 'Mar 2019 to present) Built things. Ran them.' AS job, 'B.S.|Physics|' || 'Upper ' || w || ' University|' || (2000 + s_suppkey % 20) AS course, 'Python;Go;' || w AS skills FROM (SELECT s_suppkey, {_L.format('s_suppkey')} AS w FROM supplier)""")
def resume_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A résumé for each supplier: header, experience with bullets, education, skills."""
    k, w = F.col("s_suppkey").cast("string"), _letters("s_suppkey")
    part = lambda *xs: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in xs))
    text = part(
        "Kim ", F.initcap(w), "\nChief of ", w, "\nk", k, "@example.com | github.com/k", k, "\n\nEXPERIENCE\nEngineer at Firm ", w, ", Mar 2019 - Present\n- Built things.\n• Ran them.\n\nEducation:\nB.S. in Physics, Upper ", w, " University, ", (F.lit(2000) + F.col("s_suppkey") % 20).cast("string"), "\nTechnical Skills\nPython, Go | ", w, "\n",
    )
    got = readers.read_resumes(_t(spark, sf_dir, "supplier").select(F.lit(0).alias("spec_idx"), F.lit("cv.txt").alias("path"), text.alias("text")))
    job, course = F.get("experience", F.lit(0)), F.get("education", F.lit(0))
    return got.select(
        "full_name", "headline", F.get("emails", F.lit(0)).alias("email"), "github", F.concat(job["title"], F.lit(" at "), job["company"], F.lit(" ("), job["start"], F.lit(" to "), F.lower(job["end"]), F.lit(") "), job["summary"]).alias("job"),
        F.concat_ws("|", course["degree"], course["field"], course["institution"], course["end_year"]).alias("course"), F.array_join("skills", ";").alias("skills"),
    )


@query(r"""SELECT page_id, n - 1 AS n, links[n] AS link FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS n FROM (SELECT page_id, regexp_extract_all(html || ' ' || url || ' see www.site' || page_id || '.org/a|b github.com/x', '((?:https?://)?(?:www\.)?[A-Za-z0-9.\-]+\.[A-Za-z]{2,}/[^\s|]+)', 1) AS links FROM pages))""")
def url_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in all pages, with some more behind them, in order."""
    text = F.concat("html", F.lit(" "), "url", F.lit(" see www.site"), F.col("page_id").cast("string"), F.lit(".org/a|b github.com/x"))
    return _t(spark, sf_dir, "pages").select("page_id", F.posexplode(readers.scan_links(text)).alias("n", "link")).select("page_id", F.col("n").cast("long").alias("n"), "link")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5 WHEN 2 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS years FROM part""")
def years_of_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number, a text with one, a negative number, a text that starts otherwise."""
    n, size = F.col("p_size") % 4, F.col("p_size")
    num = F.when(n == 0, size.cast("double")).when(n == 2, -size.cast("double"))
    txt = F.when(n == 1, F.concat(size.cast("string"), F.lit(".5 years"))).when(n == 3, F.concat(F.lit("around "), size.cast("string"), F.lit("+ yrs")))
    return _t(spark, sf_dir, "part").select("p_partkey", N.years_experience(num, txt).alias("years"))


#: Region, calling code, trunk prefix and the first digits and length of numbers there.
_PLACES = (("US", "1", "1", "415555", 10), ("GB", "44", "0", "20794", 10), ("IN", "91", "0", "98765", 10), ("DE", "49", "0", "30", 9), ("FR", "33", "0", "1", 9), ("ES", "34", "", "612", 9), ("AU", "61", "0", "4", 9), ("BR", "55", "0", "119", 11), ("JP", "81", "0", "3", 9), ("SG", "65", "", "9", 8), ("ZA", "27", "0", "82", 9), ("NL", "31", "0", "20", 9))
_SHAPES = ("+{c} {n}", "+{c}-{a}-{z}", "(+{c}) {n}", "{t}{n}", "({t}) {a} {z}", "{n}", "tel: +{c} {n}", "+{c} {n} ext. 12", "+{c} {a}.{z}x7", "+{c} {n};ext=5", "{a}.{z}", "{n} #44", "{short}", "{n}{n}", "+{c} {a}-CALL", "no number", "{t}-{a}-CALL ext 9", "+999{n}", "+{c} {a} {z}, extension 3")


def _shape(put, part) -> list:
    """The shapes, each as a list of parts: ``put`` of a literal, ``part`` of a name."""
    return [[part(x[1:-1]) if x[:1] == "{" else put(x) for x in re.split(r"(\{\w+\})", shape) if x] for shape in _SHAPES]


_SQL_PLACES = ", ".join(f"({i}, '{c}', '{t}', '{head}', {size})" for i, (_, c, t, head, size) in enumerate(_PLACES))


@query(f"""SELECT c_custkey, CASE WHEN shape IN (12, 13, 15, 17) THEN CAST(NULL AS VARCHAR) WHEN shape IN (14, 16) THEN '+' || c || substr(n, 1, length(n) - 4) || '2255' ELSE '+' || c || n END AS e164
FROM (SELECT c_custkey, c, head || lpad(CAST(c_custkey % 97 AS VARCHAR), CAST(size - length(head) AS INTEGER), '0') AS n, (c_custkey // {len(_PLACES)}) % {len(_SHAPES)} AS shape FROM customer JOIN (VALUES {_SQL_PLACES}) p(i, c, t, head, size) ON c_custkey % {len(_PLACES)} = i)""")
def phone_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of twelve regions in nineteen shapes: with and without plus sign and trunk prefix, extensions, letters, and what is none."""
    k = F.col("c_custkey")
    at = lambda i: F.get(F.array(*(F.lit(p[i]) for p in _PLACES)), (k % len(_PLACES)).cast("int"))
    n = F.concat(at(3), F.lpad((k % 97).cast("string"), at(4) - F.length(at(3)), F.lit("0")))
    df = _t(spark, sf_dir, "customer").select("c_custkey", at(0).alias("region"), at(1).alias("c"), at(2).alias("t"), n.alias("n"))
    df = df.withColumns({"a": F.substring("n", F.lit(1), F.length("n") - 4), "z": F.right("n", F.lit(4)), "short": F.left("n", F.lit(4))})
    shapes = F.array(*(F.concat(*parts) for parts in _shape(F.lit, F.col)))
    return df.select("c_custkey", N.phone(F.get(shapes, (F.floor(k / len(_PLACES)) % len(_SHAPES)).cast("int")), F.col("region")).alias("e164"))


_NATIONS = {"ALGERIA": "DZ", "ARGENTINA": "AR", "BRAZIL": "BR", "CANADA": "CA", "CHINA": "CN", "EGYPT": "EG", "ETHIOPIA": "ET", "FRANCE": "FR", "GERMANY": "DE", "INDIA": "IN", "INDONESIA": "ID", "IRAN": "IR", "IRAQ": "IQ", "JAPAN": "JP", "JORDAN": "JO", "KENYA": "KE", "MOROCCO": "MA", "MOZAMBIQUE": "MZ", "PERU": "PE", "ROMANIA": "RO", "RUSSIA": "RU", "SAUDI ARABIA": "SA", "UNITED KINGDOM": "GB", "UNITED STATES": "US", "VIETNAM": "VN"}


@query(f"""SELECT n_nationkey, CASE upper(n_name) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _NATIONS.items())} END AS iso FROM nation""")
def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select("n_nationkey", N.country("n_name").alias("iso"))


_CODES = {"DZ": ("dza", 12), "AR": ("arg", 32), "BR": ("bra", 76), "CA": ("can", 124), "CN": ("chn", 156), "EG": ("egy", 818), "ET": ("eth", 231), "FR": ("fra", 250), "DE": ("deu", 276), "IN": ("ind", 356), "ID": ("idn", 360), "IR": ("irn", 364), "IQ": ("irq", 368), "JP": ("jpn", 392), "JO": ("jor", 400), "KE": ("ken", 404), "MA": ("mar", 504), "MZ": ("moz", 508), "PE": ("per", 604), "RO": ("rou", 642), "RU": ("rus", 643), "SA": ("sau", 682), "GB": ("gbr", 826), "US": ("usa", 840), "VN": ("vnm", 704)}


@query(f"""SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 8 THEN CAST(NULL AS VARCHAR) ELSE CASE upper(n_name) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _NATIONS.items())} END END AS iso FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def country_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' countries by name in either case, long forms, codes of two and three letters and of digits, and by what is no country."""
    own = F.create_map(*(F.lit(x) for name, two in _NATIONS.items() for x in (name, two)))[F.upper("n_name")]
    of = lambda i: F.create_map(*(F.lit(x) for two, codes in _CODES.items() for x in (two, codes[i])))[own]
    forms = F.array(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")), F.upper("n_name"), F.concat(F.lit("the Islamic Republic of "), F.initcap("n_name")), F.concat(F.initcap("n_name"), F.lit(", Kingdom of")), own, F.concat(F.upper(of(0)), F.lit(".")), F.lpad(of(1).cast("string"), 3, "0"), F.lower(own), F.concat(F.lit("New "), "n_name"))
    df = _t(spark, sf_dir, "supplier").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
    return df.select("s_suppkey", N.country(F.get(forms, (F.col("s_suppkey") % 9).cast("int"))).alias("iso"))


@query("""SELECT c_custkey, 'customer' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'firm' ELSE lower('IN') END AS weak FROM customer""")
def weak_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name with first employer, else country."""
    job = F.array(F.struct(F.when(F.col("c_custkey") % 2 == 0, "Firm").otherwise(" ").alias("company")))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    df = _t(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), job.alias("jobs"), F.lit("IN").alias("land"))
    return df.select("c_custkey", identity.weak_key("name", F.when(F.col("c_custkey") % 2 == 0, F.col("jobs")).otherwise(F.array(F.struct(F.lit("").alias("company")))), "land").alias("weak"))


def _staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW rows of orders (JSON or résumé) and customers (delimited): those of one customer share an e-mail."""
    nothing = F.lit(None).cast("string")
    job = lambda c, t, a, z, s: F.struct(c.alias("company"), t.alias("title"), a.alias("start"), z.alias("end"), s.alias("summary"))
    k = F.col("o_orderkey")
    mail = lambda n: F.array(F.concat(F.lit("s"), n.cast("string"), F.lit("@example.com")))
    course = F.struct(F.lit("Upper College").alias("institution"), F.concat(F.lit("Degree "), (k % 2).cast("string")).alias("degree"), F.when(k % 4 == 0, "Physics").alias("field"), F.concat(F.lit("in 20"), F.lpad((k % 2).cast("string"), 2, "0")).alias("end_year"))
    o = _t(spark, sf_dir, "orders").select(
        F.lit(0).alias("spec_idx"), k.alias("pos"), F.when(k % 2 == 0, "ats_json").otherwise("resume").alias("source"), mail(F.col("o_custkey")).alias("emails"), F.when(k % 2 == 0, F.array(F.lit("py"), F.lit("K8S"))).otherwise(F.array(F.lit("Python"), F.lit("weird  skill"))).alias("skills"),
        F.array(job(F.concat(F.lit("Firm "), (k % 3).cast("string")), F.lit("Engineer"), F.concat(F.lit("201"), (k % 3).cast("string"), F.lit("-05")), F.lit("present"), nothing)).alias("experience"), F.array(course).alias("education"),
    )
    c = _t(spark, sf_dir, "customer").select(F.lit(1).alias("spec_idx"), F.col("c_custkey").alias("pos"), F.lit("recruiter_csv").alias("source"), F.concat(F.lit("Cust "), _letters("c_custkey")).alias("full_name"), mail(F.col("c_custkey")).alias("emails"))
    return as_raw(o).unionByName(as_raw(c))


_STAFF = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 2 AS r FROM orders),
g AS (SELECT c, count(*) FILTER (r = 0) AS a, count(*) FILTER (r = 1) AS z FROM o GROUP BY c)"""
_OR = "CAST(printf('%.4f', 1.0 - list_reduce(list_prepend(1.0::DOUBLE, list_concat(list_transform(range({0}), lambda x: {1}::DOUBLE), list_transform(range({2}), lambda x: {3}::DOUBLE))), lambda p, w: p * (1.0 - w))) AS DOUBLE)"


@query(f"""WITH {_STAFF}, s AS (SELECT c, unnest([{{'n': 'Python', 'a': a, 'z': z}}, {{'n': 'Kubernetes', 'a': a, 'z': 0}}, {{'n': 'Weird Skill', 'a': 0, 'z': z}}]) AS s FROM g)
SELECT 's' || c || '@example.com' AS email, s.n AS skill, {_OR.format('s.a', '0.765', 's.z', '0.8')} AS conf, CASE WHEN s.a > 0 AND s.z > 0 THEN 'ats_json,resume' WHEN s.a > 0 THEN 'ats_json' ELSE 'resume' END AS sources FROM s WHERE s.a + s.z > 0""")
def profile_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of profiles with confidence and sources."""
    got = build_profiles(_staff(spark, sf_dir))
    return got.select(F.get("emails", F.lit(0)).alias("email"), F.explode("skills").alias("s")).select("email", F.col("s.name").alias("skill"), F.col("s.confidence").alias("conf"), F.array_join("s.sources", ",").alias("sources"))


@query(f"""WITH {_STAFF}, j AS (SELECT DISTINCT c, k % 3 AS f FROM o)
SELECT 's' || c || '@example.com' AS email, 'Firm ' || f AS company, 'Engineer' AS title, '201' || f || '-05' AS start, CAST(NULL AS VARCHAR) AS "end", row_number() OVER (PARTITION BY c ORDER BY f DESC) - 1 AS place FROM j""")
def profile_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employments of profiles, merged by company and title, the latest first."""
    got = build_profiles(_staff(spark, sf_dir))
    job = got.select(F.get("emails", F.lit(0)).alias("email"), F.posexplode("experience").alias("place", "x"))
    return job.select("email", "x.company", "x.title", "x.start", "x.end", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_STAFF}, e AS (SELECT c, k % 2 AS d, max(CASE WHEN k % 4 = 0 THEN 'Physics' END) AS field FROM o GROUP BY c, k % 2)
SELECT 's' || c || '@example.com' AS email, 'Upper College' AS institution, 'Degree ' || d AS degree, field, CAST(2000 + d AS INTEGER) AS end_year, row_number() OVER (PARTITION BY c ORDER BY d DESC) - 1 AS place FROM e""")
def profile_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses of profiles, merged by institution and degree, the latest first; a field that only some records tell is kept."""
    got = build_profiles(_staff(spark, sf_dir))
    course = got.select(F.get("emails", F.lit(0)).alias("email"), F.posexplode("education").alias("place", "x"))
    return course.select("email", "x.institution", "x.degree", "x.field", "x.end_year", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_STAFF}, who AS (SELECT c_custkey AS c, coalesce(a, 0) AS a, coalesce(z, 0) AS z FROM customer LEFT JOIN g ON c = c_custkey), m AS (SELECT 's' || c || '@example.com' AS email, * FROM who)
SELECT email, 'full_name' AS field, 'recruiter_csv' AS source, 'direct' AS method, 1 AS n FROM m
UNION ALL SELECT email, 'emails', 'recruiter_csv', 'direct+lowercased', 1 FROM m UNION ALL SELECT email, 'emails', 'ats_json', 'remapped+lowercased', 1 FROM m WHERE a > 0 UNION ALL SELECT email, 'emails', 'resume', 'extracted+lowercased', 1 FROM m WHERE z > 0
UNION ALL SELECT email, 'skills:Python', 'ats_json', 'remapped+canonical', 1 FROM m WHERE a > 0 UNION ALL SELECT email, 'skills:Python', 'resume', 'extracted+canonical', 1 FROM m WHERE z > 0""")
def profile_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source says what, and how it was read, of names, e-mails and one skill."""
    got = build_profiles(_staff(spark, sf_dir)).select(F.get("emails", F.lit(0)).alias("email"), F.explode("provenance").alias("p"))
    return got.select("email", "p.*").where(F.col("field").isin("full_name", "emails", "skills:Python")).groupBy("email", "field", "source", "method").agg(F.count("*").cast("int").alias("n"))


_VIEW = {"fields": [{"path": "name", "from": "full_name"}, {"path": "skills", "from": "skills[].name", "type": "string[]"}, {"path": "firms", "from": "experience[].company", "on_missing": "omit"}, {"path": "sure", "from": "skills[0].confidence"}], "include_confidence": False, "include_provenance": False}


@query(f"""WITH {_STAFF}, w AS (SELECT c_custkey AS c, a, z, {_L.format('c_custkey')} AS l FROM customer LEFT JOIN g ON c = c_custkey),
f AS (SELECT c, string_agg('"Firm ' || f || '"', ',' ORDER BY f DESC) AS firms FROM (SELECT DISTINCT c, k % 3 AS f FROM o) GROUP BY c),
s AS (SELECT c, string_agg('"' || n || '"', ',' ORDER BY conf DESC, n) AS skills, first(conf ORDER BY conf DESC, n) AS sure FROM (SELECT c, s.n, {_OR.format('s.a', '0.765', 's.z', '0.8')} AS conf FROM (SELECT c, unnest([{{'n': 'Python', 'a': a, 'z': z}}, {{'n': 'Kubernetes', 'a': a, 'z': 0}}, {{'n': 'Weird Skill', 'a': 0, 'z': z}}]) AS s FROM g) WHERE s.a + s.z > 0) GROUP BY c)
SELECT '{{"name": "Cust ' || upper(l[1]) || substr(l, 2) || '", "skills": ' || CASE WHEN skills IS NULL THEN 'null' ELSE '[' || skills || ']' END || CASE WHEN firms IS NULL THEN '' ELSE ', "firms": [' || firms || ']' END || ', "sure": ' || coalesce(CAST(sure AS VARCHAR), 'null') || '}}' AS json FROM w LEFT JOIN f USING (c) LEFT JOIN s USING (c)""")
def wildcard_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists over all elements, one element, and a list that is left out where it is missing."""
    config = OutputConfig.from_dict(_VIEW)
    df = project(build_profiles(_staff(spark, sf_dir)), config)
    return df.select(render(df, [f.path for f in config.fields]).alias("json"))


@query(f"""WITH {_STAFF} SELECT 's' || c_custkey || '@example.com' AS email, CASE WHEN z > 0 THEN 'python,weird skill' WHEN a > 0 THEN 'python' ELSE '' END AS matched, CAST((CASE WHEN a + z > 0 THEN 1 ELSE 0 END + CASE WHEN z > 0 THEN 1 ELSE 0 END) AS DOUBLE) / 3.0 AS match_fraction FROM customer LEFT JOIN g ON c = c_custkey""")
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords found in skills and texts of profiles."""
    got = ranking.keyword_match(build_profiles(_staff(spark, sf_dir)), ["python", "weird skill", "haskell"])
    return got.select(F.get("emails", F.lit(0)).alias("email"), F.array_join("matched", ",").alias("matched"), "match_fraction")


@query(f"""WITH {_STAFF} SELECT 's' || c_custkey || '@example.com' AS email, 'Cust ' || upper(l[1]) || substr(l, 2) AS title, 'C' || upper(l[1]) AS initials, CAST(NULL AS VARCHAR) AS place, 0 AS n_links FROM (SELECT *, {_L.format('c_custkey')} AS l FROM customer)""")
def profile_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat view of profiles."""
    got = build_profiles(_staff(spark, sf_dir))
    return got.select("cluster", F.get("emails", F.lit(0)).alias("email")).join(ranking.card(got), "cluster").select("email", "title", "initials", "place", F.size("links").alias("n_links"))


@query("""SELECT 'cand_' || substr(sha1('s' || c_custkey || '@example.com'), 1, 10) AS candidate_id, 's' || c_custkey || '@example.com' AS email, 13 AS n_fields FROM customer""")
def default_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles in the default form, checked, written as JSON lines and read back."""
    good, bad = shape(build_profiles(_staff(spark, sf_dir)))
    folder = f"{shared_dir(spark)}/outputs-{uuid.uuid4().hex}"
    write_outputs(good, folder)
    back = spark.read.text(folder).select(F.try_parse_json("value").alias("v"))
    keys = F.array_size(F.json_object_keys(F.to_json("v")))
    return back.select(F.try_variant_get("v", "$.candidate_id", "string").alias("candidate_id"), F.try_variant_get("v", "$.emails[0]", "string").alias("email"), keys.cast("int").alias("n_fields"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS n FROM customer), f AS (SELECT n, n % 5 AS kind, max(c_custkey) AS top FROM c GROUP BY n)
SELECT 'k' || c_custkey || '@example.com' AS told, CAST(n AS VARCHAR) AS source FROM c JOIN f USING (n) WHERE kind IN (0, 2)
UNION ALL SELECT CASE kind WHEN 1 THEN 'ends inside a value' WHEN 3 THEN 'is not UTF-8 text' ELSE 'holds a record that is not JSON' END, CAST(n AS VARCHAR) FROM f WHERE kind NOT IN (0, 2)""")
def source_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of the customers of each nation, JSON or delimited, of which some are cut off, not UTF-8 or hold a broken record: all are read in
    one plan, the good ones' records come through, and each bad one gives a warning."""
    mail = F.concat(F.lit("k"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    n = F.col("c_nationkey")
    kind = n % 5
    broken = F.when((kind == 4) & (F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) == 1), F.lit(', "x": nowhere')).otherwise("")
    one = F.concat(F.lit('{"name": "A", "email": "'), mail, F.lit('"'), broken, F.lit("}"))
    rows = _t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", mail.alias("mail"), one.alias("one"), kind.alias("kind"))
    parts = rows.groupBy("c_nationkey", "kind").agg(F.collect_list("one").alias("ones"), F.collect_list("mail").alias("mails"))
    json = F.concat(F.lit("["), F.array_join("ones", ",\n"), F.when(F.col("kind") == 1, "").otherwise("]"))
    sheet = F.concat(F.lit("email\n"), F.array_join("mails", "\n"))
    text = F.when(F.col("kind").isin(2, 3), sheet).otherwise(json).cast("binary")
    content = F.when(F.col("kind") == 3, F.concat(text, F.lit(b"\n\xff\xfe@example.com"))).otherwise(text)
    folder = f"{shared_dir(spark)}/faults-{uuid.uuid4().hex}"
    # a file a nation: Spark names the folders, and the text of a file goes out as it is
    parts.select(content.cast("string").alias("value"), "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").text(folder)
    keys = [r[0] for r in parts.select("c_nationkey", "kind").collect()]  # nations
    sources = [Source(f"{folder}/c_nationkey={k}", "recruiter_csv" if k % 5 in (2, 3) else "ats_json") for k in keys]
    raw, warnings = extract_all(spark, sources)
    number = F.element_at(F.array(*(F.lit(str(k)) for k in keys)), F.col("spec_idx") + 1)
    told = F.regexp_extract("message", r"part-[^ ]* (.*)\)$", 1)
    return raw.select(F.get("emails", F.lit(0)).alias("told"), number.alias("source")).unionByName(warnings.select(told.alias("told"), F.regexp_extract("source", r"=(\d+)$", 1).alias("source")))


# ---- batches, confidence and order ------------------------------------------------------------------------


@query(f"""WITH g AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS r FROM customer),
k AS (SELECT r, count(o_orderkey) FILTER (o_orderkey % 2 = 0) AS a, count(o_orderkey) FILTER (o_orderkey % 2 = 1) AS z FROM g LEFT JOIN orders ON o_custkey = c GROUP BY r),
m AS (SELECT a, z, CASE WHEN r % 10 = 0 THEN 2 ELSE 1 END AS n_emails, 'cand_' || substr(sha1(CASE WHEN r % 10 = 0 THEN least('s' || r || '@example.com', 's' || (r + 1) || '@example.com') ELSE 's' || r || '@example.com' END), 1, 10) AS candidate_id FROM k),
s AS (SELECT candidate_id, n_emails, unnest([{{'n': 'Python', 'a': a, 'z': z}}, {{'n': 'Kubernetes', 'a': a, 'z': 0}}, {{'n': 'Weird Skill', 'a': 0, 'z': z}}, {{'n': '-', 'a': 0, 'z': 0}}]) AS s FROM m)
SELECT candidate_id, CAST(n_emails AS INTEGER) AS n_emails, s.n AS skill, {_OR.format('s.a', '0.765', 's.z', '0.8')} AS conf FROM s WHERE s.a + s.z > 0 OR s.n = '-'""")
def incremental_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers that come in three batches; every tenth customer also has the next one's e-mail and so joins two old clusters. The
    profiles are kept up by reading and writing touched clusters only, and equal those of all records."""
    raw = _staff(spark, sf_dir)
    both = (F.col("spec_idx") == 1) & (F.col("pos") % 10 == 0)
    next_ = F.array(F.concat(F.lit("s"), (F.col("pos") + 1).cast("string"), F.lit("@example.com")))
    raw = raw.withColumn("emails", F.when(both, F.concat("emails", next_)).otherwise(F.col("emails")))
    store = ProfileStore(spark, f"{shared_dir(spark)}/profiles-{uuid.uuid4().hex}")
    for k in range(3):
        store.add(raw.where(F.col("pos") % 3 == k), k)
    none = F.array(F.struct(F.lit("-").alias("name"), F.lit(0.0).alias("confidence")))
    skill = F.explode(F.concat(none, F.transform("skills", lambda s: F.struct(s["name"].alias("name"), s["confidence"].alias("confidence")))))
    return store.profiles().select("candidate_id", F.size("emails").alias("n_emails"), skill.alias("s")).select("candidate_id", "n_emails", F.col("s.name").alias("skill"), F.col("s.confidence").alias("conf"))


#: Overall confidence of ``_staff``: the mean of all values' confidences, in the order of the profile, times the share of fields that are there.
_OVERALL = f"""{_STAFF}, h AS (SELECT c_custkey AS c, coalesce(a, 0) AS a, coalesce(z, 0) AS z FROM customer LEFT JOIN g ON c = c_custkey),
sk AS (SELECT c, list(conf ORDER BY conf DESC, n) AS l FROM (SELECT c, s.n, {_OR.format('s.a', '0.765', 's.z', '0.8')} AS conf FROM (SELECT c, unnest([{{'n': 'Python', 'a': a, 'z': z}}, {{'n': 'Kubernetes', 'a': a, 'z': 0}}, {{'n': 'Weird Skill', 'a': 0, 'z': z}}]) AS s FROM h) WHERE s.a + s.z > 0) GROUP BY c),
jo AS (SELECT c, list(conf ORDER BY f DESC) AS l FROM (SELECT c, f, {_OR.format('a', '0.765', 'z', '0.8')} AS conf FROM (SELECT c, k % 3 AS f, count(*) FILTER (r = 0) AS a, count(*) FILTER (r = 1) AS z FROM o GROUP BY c, k % 3)) GROUP BY c),
ov AS (SELECT c, a, z, 'cand_' || substr(sha1('s' || c || '@example.com'), 1, 10) AS candidate_id, list_concat([0.9::DOUBLE, CAST(printf('%.4f', 1.0 - list_reduce(list_concat([1.0::DOUBLE, 0.9::DOUBLE], list_transform(range(a), lambda x: 0.85::DOUBLE), list_transform(range(z), lambda x: 0.76::DOUBLE)), lambda p, w: p * (1.0 - w))) AS DOUBLE)], coalesce(sk.l, []), coalesce(jo.l, []),
  CASE WHEN z > 0 THEN [{_OR.format('0', '0.765', 'z', '0.8')}] ELSE [] END, CASE WHEN a > 0 THEN [{_OR.format('a', '0.765', '0', '0.8')}] ELSE [] END) AS cs, CASE WHEN a + z > 0 THEN 4 ELSE 2 END / 6.0::DOUBLE AS cover FROM h LEFT JOIN sk USING (c) LEFT JOIN jo USING (c)),
al AS (SELECT *, CAST(printf('%.4f', list_reduce(list_prepend(0.0::DOUBLE, cs), lambda p, x: p + x) / len(cs) * cover) AS DOUBLE) AS overall FROM ov)"""

_TOLD = {"fields": [{"path": "name", "from": "full_name"}, {"path": "skills", "on_missing": "omit"}, {"path": "gone", "from": "phones", "on_missing": "omit"}]}


@query(f"""WITH {_OVERALL} SELECT candidate_id, overall, 1 + CASE WHEN a > 0 THEN 2 ELSE 0 END + CASE WHEN z > 0 THEN 2 ELSE 0 END AS n_provenance, a + z > 0 AS has_skills, CASE WHEN a + z > 0 THEN 'full_name,skills' ELSE 'full_name' END AS heads FROM al""")
def project_confidence_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with confidence and with the provenance of the fields that they show."""
    config = OutputConfig.from_dict(_TOLD)
    made = _cut(build_profiles(_staff(spark, sf_dir)))
    df = project(made, config)
    v = F.try_parse_json(render(df, [f.path for f in config.fields]))
    fields = F.transform(F.try_variant_get(v, "$.provenance", "array<struct<field:string,source:string,method:string>>"), lambda p: F.get(F.split(p["field"], r"[.\[:]"), F.lit(0)))
    df = df.select("cluster", F.try_variant_get(v, "$.overall_confidence", "double").alias("overall"), F.size(fields).alias("n_provenance"), F.try_variant_get(v, "$.skills[0].confidence", "double").isNotNull().alias("has_skills"), F.array_join(F.array_sort(F.array_distinct(fields)), ",").alias("heads"))
    return df.join(made.select("cluster", "candidate_id"), "cluster").drop("cluster")


@query(f"""WITH {_OVERALL}, f AS (SELECT candidate_id, overall, (CASE WHEN a + z > 0 THEN 1 ELSE 0 END + CASE WHEN z > 0 THEN 1 ELSE 0 END) / 3.0::DOUBLE AS part FROM al)
SELECT candidate_id, row_number() OVER (ORDER BY part DESC, overall DESC, candidate_id) AS by_keywords, row_number() OVER (ORDER BY overall DESC, candidate_id) AS by_confidence FROM f""")
def profile_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of profiles by keywords and by confidence, ties by id."""
    words = ["python", "weird skill", "haskell"]
    made = _cut(build_profiles(_staff(spark, sf_dir)))
    one = ranking.with_rank(ranking.keyword_match(made, words).select("cluster", "candidate_id", "match_fraction", "overall_confidence"), words)
    two = ranking.with_rank(made.select("cluster", "candidate_id", "overall_confidence"))
    return one.select("cluster", "candidate_id", F.col("rank").alias("by_keywords")).join(two.select("cluster", F.col("rank").alias("by_confidence")), "cluster").drop("cluster")
