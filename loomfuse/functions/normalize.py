"""Normalizers of single values, as Column expressions. What cannot be read becomes null."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomfuse.functions import rules as R
from loomfuse.functions.text import blank_to_null, clean, col, first_match, let, lookup, squash, strip


def email(c: Column | str) -> Column:
    x = strip(F.regexp_replace(F.replace(F.lower(strip(c)), F.lit("mailto:"), F.lit("")), "^[<>]+|[<>]+$", ""))
    return let(x, lambda e: F.when(e.rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"), e))


def phone(c: Column | str, region: Column | str) -> Column:
    """E.164 by the numbering plan of ``region``, or of the calling code after a plus sign.

    What stands before the first digit or plus sign is left out, so is an extension. Three letters or more, behind three digits, are
    those of the keypad; fewer are left out."""
    text, region = strip(c), col(region)
    text = F.regexp_replace(F.regexp_replace(text, R.PHONE_EXTENSION, ""), r"^[^+\d]+", "")
    viable = text.rlike(R.PHONE_VIABLE)
    keyed = F.when(text.rlike("(?:[^A-Za-z]*[A-Za-z]){3}"), F.translate(F.upper(text), *R.KEYPAD)).otherwise(text)
    digits = F.regexp_replace(keyed, r"\D", "")
    codes: dict[str, list[str]] = {}
    for code, _, national in R.PHONE_PLANS.values():
        codes.setdefault(code, []).append(national)
    known = "|".join(f"{code}(?:{'|'.join(sorted(set(n)))})" for code, n in sorted(codes.items()))
    code, trunk, national = (lookup({k: v[i] for k, v in R.PHONE_PLANS.items()}, region) for i in range(3))
    number = F.concat(F.lit("(?:"), national, F.lit(")$"))
    whole = F.concat(F.lit("^"), number)

    def found(d: Column) -> Column:
        plus = F.when(d.rlike(f"^(?:{known})$"), F.concat(F.lit("+"), d))
        without = lambda prefix: F.regexp_replace(d, F.concat(F.lit("^"), prefix, F.lit("(?="), number, F.lit(")")), F.lit(""))
        local = F.concat(F.lit("+"), code, F.when(F.rlike(without(trunk), whole), without(trunk)).when(F.rlike(without(code), whole), without(code)))
        return F.when(viable & (F.length(d) >= 5), F.when(text.startswith("+"), plus).otherwise(local))

    return let(digits, found)


def month(c: Column | str) -> Column:
    """``YYYY-MM``; null for words that mean now. The cleaned text is computed once, and each shape has one pattern."""
    iso = r"^\d{4}-\d{2}-\d{2}(?:.\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:z|[+-]\d{2}(?::?\d{2})?)?)?$"
    joined = lambda y, m: let(F.lpad(m, 2, "0"), lambda x: F.when(x.between("01", "12"), F.concat(y, F.lit("-"), x)))

    def shapes(s: Column) -> Column:
        named = let(lookup({k: f"{v:02d}" for k, v in R.MONTHS.items()}, F.regexp_extract(s, "^[a-z]+", 0)), lambda x: F.concat(F.right(s, F.lit(4)), F.lit("-"), x))
        return (
            F.when(s.isin(*R.PRESENT, ""), None).when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01"))).when(s.rlike(r"^\d{4}[-/.]\d{1,2}$"), joined(F.left(s, F.lit(4)), F.substring(s, 6, 2)))
            .when(s.rlike(r"^\d{1,2}[-/]\d{4}$"), joined(F.right(s, F.lit(4)), F.substring_index(F.substring_index(s, "/", 1), "-", 1))).when(s.rlike(r"^[a-z]+\.?\s+\d{4}$"), named)
            .when(s.rlike(iso) & F.try_to_timestamp(F.left(s, F.lit(10)), F.lit("yyyy-MM-dd")).isNotNull(), F.left(s, F.lit(7)))
        )

    return let(F.lower(strip(col(c).cast("string"))), shapes)


def year(c: Column | str) -> Column:
    return first_match(col(c).cast("string"), r"(?:19|20)\d{2}").cast("int")


#: Letters with marks and the plain ones that their decomposition begins with.
_MARKED = {ch: base for ch in map(chr, range(0xC0, 0x250)) if (base := unicodedata.normalize("NFD", ch)[0]) != ch and base.isascii()}


def fold(c: Column | str) -> Column:
    """Lower case, letters without marks, blanks squashed, typewriter apostrophes."""
    return F.lower(squash(F.translate(col(c), "".join(_MARKED) + "\u2019", "".join(_MARKED.values()) + "'")))


@functools.cache
def countries() -> dict[str, str]:
    """Country code of two letters by codes of letters and of three digits, and by folded English names, from the tables of the
    Unicode library that comes with Spark."""
    icu = SparkSession.getActiveSession()._jvm.com.ibm.icu
    plain = lambda t: "".join(_MARKED.get(ch, ch) for ch in t).replace("\u2019", "'").lower()
    names = icu.text.LocaleDisplayNames.getInstance(icu.util.ULocale.ENGLISH)
    found: dict[str, str] = {}
    for two in icu.util.ULocale.getISOCountries():
        number = icu.util.Region.getInstance(two).getNumericCode()
        if not 0 < number <= 894:  # a code that the standard leaves to its users or does not have
            continue
        name = plain(names.regionDisplayName(two))
        for key in (two.lower(), icu.util.ULocale("", two).getISO3Country().lower(), f"{number:03d}", name, re.sub(r" \(.*\)$", "", name), name.replace("&", "and"), name.replace("st. ", "saint ")):
            found.setdefault(key, two)
    return found | R.COUNTRY_NAMES


def country(c: Column | str) -> Column:
    """ISO 3166 code of two letters, from an alias, a code of letters or digits, an English name, or that name in its long form, such as Republic of X."""
    base = F.lower(strip(c))
    bare = F.regexp_replace(base, r"\.+$", "")
    table = countries()
    codes = {k: v for k, v in table.items() if len(k) <= 3}
    # Korea, Republic of: Republic of Korea
    turned = lambda x: F.regexp_replace(x, "^(.*), (.* of)$", "$2 $1")
    bare_name = lambda x: F.regexp_replace(turned(x), R.STATE_FORM, "")
    by_name = lambda x: F.coalesce(lookup(table, x), let(bare_name(x), lambda y: F.coalesce(lookup(table, y), lookup(R.COUNTRY_ALIASES, y))))
    return F.when(base != "", F.coalesce(lookup(R.COUNTRY_ALIASES, base), lookup(R.COUNTRY_ALIASES, bare), lookup(codes, bare), let(fold(c), by_name)))


def location(c: Column | str) -> Column:
    """struct<city, region, country> of "city, region, country" text."""
    parts = F.filter(F.transform(F.split(col(c), ","), strip), lambda x: x != "")
    n, last = F.size(parts), F.get(parts, F.size(parts) - 1)
    land = F.when((n >= 2) & ~F.upper(last).isin(*R.US_STATES), country(last))
    left = n - F.when(land.isNotNull(), 1).otherwise(0)
    return F.struct(F.when(left >= 1, F.get(parts, F.lit(0))).alias("city"), F.when(left >= 2, F.get(parts, F.lit(1))).alias("region"), land.alias("country"))


def name(c: Column | str) -> Column:
    """Tokens in one case only are capitalized; mixed ones stay."""
    cap = lambda t: F.when((t == F.lower(t)) | (t == F.upper(t)), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))).otherwise(t)
    return blank_to_null(F.array_join(F.transform(F.split(squash(c), " "), cap), " "))


def name_key(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits, for matching."""
    return blank_to_null(F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]", ""), " +", " ")))


def years_experience(num: Column | str, txt: Column | str) -> Column:
    """A number if it is not negative, else the first decimal number of the text."""
    n = col(num)
    return F.coalesce(F.when(n >= 0, n.cast("double")), F.when(n.isNull(), first_match(txt, r"\d+(?:\.\d+)?").cast("double")))


def url(c: Column | str) -> Column:
    s = strip(c)
    return F.when(s != "", F.regexp_replace(F.when(s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s)), "/+$", ""))


def link_kind(c: Column | str) -> Column:
    low = F.lower(col(c))
    return F.when(low != "", F.when(low.contains("linkedin.com"), "linkedin").when(low.contains("github.com") | low.contains("github.io"), "github").otherwise("other"))


def skill_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(squash(c)), r"^[ .,;:|/]+|[ .,;:|/]+$", "")


def skill(c: Column | str) -> Column:
    """The skill's own name; unknown ones of up to three letters in capitals, longer ones capitalized."""
    own = lambda key: F.when(key != "", F.coalesce(lookup(R.SKILL_OF, key), F.when(F.length(key) <= 3, F.upper(key)).otherwise(F.initcap(key))))
    return let(skill_key(c), own)


def is_known_skill(c: Column | str) -> Column:
    return F.coalesce(lookup(R.SKILL_OF, skill_key(c)).isNotNull(), F.lit(False))


#: Normalizers that an output configuration may name, of (value, region).
KINDS = {
    "e164": lambda c, region: phone(c, F.lit(region)), "canonical": lambda c, _: skill(c), "iso3166": lambda c, _: country(c), "iso-3166": lambda c, _: country(c),
    "yyyy-mm": lambda c, _: month(c), "yyyymm": lambda c, _: month(c), "month": lambda c, _: month(c), "lowercase": lambda c, _: F.lower(c), "uppercase": lambda c, _: F.upper(c),
}
