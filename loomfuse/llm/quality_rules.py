"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (blanks stripped and joined, lower-cased) and hashed. A line found in more
distinct documents of one host than ``max(min_docs, max_share * documents of the host)`` is
boilerplate and counts as removed; a document that keeps less than ``min_left`` of its characters is
depleted and rejected, and so is one that fails the base rules.

Null or empty text: no words, base rules fail. A null host is a host of its own. Repeated rows are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import WORD_SEP, norm_docs, real_id

MIN_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.02, 0.5
SYMBOLS = "#*$%&|<>"


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(text, WORD_SEP), lambda w: w != "")


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside a three-word window that the same text holds twice or more.

    Windows are hashed to 64 bits and sorted with their positions, so that equal ones are neighbours: n log n for
    a text of any length. The columns in between are separate projections which Catalyst does not merge, since
    each is read more than once above."""
    at = lambda a, i: F.get(F.col(a), i)
    grams = F.when(F.size(words) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(at(words, i), at(words, i + 1), at(words, i + 2)).alias("h"), i.alias("p"))))).otherwise(F.expr("cast(array() as array<struct<h:bigint,p:int>>)"))
    df = df.withColumn("_grams", grams)
    twice = F.filter("_grams", lambda x, i: F.coalesce((i > 0) & (x["h"] == at("_grams", i - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == at("_grams", i + 1)["h"], F.lit(False)))
    df = df.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["p"])))
    gap = F.zip_with("_twice", F.slice("_twice", 2, F.greatest(F.size("_twice"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return df.withColumn(out, F.aggregate(gap, F.lit(0).cast("long"), lambda s, x: s + x)).drop("_grams", "_twice")


def base_stats(docs: DataFrame) -> DataFrame:
    """doc_id, _th (hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\u000b\f\r", "")) > 0)
    df = docs.select("doc_id", "text", words_of("text").alias("_words"), lines.alias("_lines"))
    df = df.select(
        "doc_id", F.xxhash64("text").alias("_th"), "_words", F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    df = repeated_words(df, "_words", "n_repeat_words").drop("_words")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_counts(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: doc_id, _th, host, pos, line (hash of the normalised line), chars."""
    blank = lambda x: F.length(F.translate(x, " \t\n\u000b\f\r", "")) > 0
    norm = F.transform(F.filter(F.split("text", "\n"), blank), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(F.lower(F.trim(F.regexp_replace(x, WORD_SEP, " ")))).alias("line"), F.length(x).cast("long").alias("chars")))
    return docs.select("doc_id", F.xxhash64("text").alias("_th"), "host", F.inline(norm))


def frequent_lines(each: DataFrame, docs: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """host, line of the lines above the limit. Counts are exact; distinct (host, line, document) first, so no line is one task's."""
    hosts = docs.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    found = each.select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    return found.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line")


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_chars, kept."""
    named = norm_docs(docs, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    each = line_counts(named)
    often = frequent_lines(each, named, min_docs, max_share)
    # a set of (position, length) a document, so that a repeated row counts once; its size is that of the document
    gone = each.join(often, ["host", "line"]).groupBy("doc_id", "_th").agg(F.collect_set(F.struct("pos", "chars")).alias("_gone"))
    gone = gone.select("doc_id", "_th", F.aggregate("_gone", F.lit(0).cast("long"), lambda s, x: s + x["chars"]).alias("removed"))
    all_docs = base_stats(named)
    out = all_docs.join(gone, ["doc_id", "_th"], "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("removed"), F.lit(0)) <= (1 - min_left) * (F.col("word_chars") + F.col("n_words")))
    return out.select(real_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("removed", F.lit(0).cast("long")).alias("removed_chars"), kept.alias("kept"))
