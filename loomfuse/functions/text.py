"""Text and number helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: The characters that SPACE stands for under (?U).
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space, of any script, at both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def squash(c: Column | str) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.regexp_replace(strip(c), rf"(?U){SPACE}+", " ")


def blank_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(c != "", c)


def clean(c: Column | str) -> Column:
    """Stripped, or null if nothing is left."""
    return blank_to_null(strip(c))


def first_match(c: Column | str, pattern: str, group: int = 0) -> Column:
    return blank_to_null(F.regexp_extract(col(c), pattern, group))


def distinct_present(items: Column | str) -> Column:
    """Array without nulls, blanks and repeats; first places are kept."""
    return F.array_distinct(F.filter(col(items), lambda x: x.isNotNull() & (x != "")))


def round4(c: Column | str) -> Column:
    """Half-even rounding of the exact double to four places (``round`` works on its shortest decimal form instead)."""
    return F.regexp_replace(F.format_number(col(c), 4), ",", "").cast("double")


_KINDS = {str: "string", int: "int", float: "double"}


def literal_map(pairs: dict) -> Column:
    """A constant table. One of texts, or of texts to numbers, is one literal that is folded when the query is planned: a tree of
    thousands of literals would have to be built and analysed at each use."""
    kinds = {type(v) for v in pairs.values()}
    if pairs and all(isinstance(k, str) for k in pairs) and len(kinds) == 1 and (kind := _KINDS.get(next(iter(kinds)))):
        made = F.call_function("str_to_map", F.lit("\x01".join(f"{k}\x02{v!r}" if kind == "double" else f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))
        return made if kind == "string" else made.cast(f"map<string,{kind}>")
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lookup(pairs: dict, key: Column) -> Column:
    """Value of a constant table, null if the key is not in it."""
    return F.try_element_at(literal_map(pairs), key)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_terms(text: Column, terms: list[str]) -> Column:
    """Those of ``terms`` that stand in ``text`` by themselves (no a-z, A-Z, 0-9 beside them), in the order of ``terms``.

    One pass, whatever the number of terms: at each place the longest term is found by one pattern without taking any text, so that the
    next place is looked at too; the shorter ones that begin at the same place are known beforehand from the longest."""
    terms = list(dict.fromkeys(t for t in terms if t))
    if not terms:
        return no_strings()
    part = lambda c: c.isascii() and c.isalnum()
    inside = {t: [u for u in terms if t.startswith(u) and (t == u or not part(t[len(u)]))] for t in terms}
    quoted = lambda t: "".join(ch if ch.isalnum() else f"\\x{{{ord(ch):x}}}" for ch in t)
    by_first: dict[str, list[str]] = {}
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        by_first.setdefault(t[0], []).append(quoted(t[1:]))
    tree = "|".join(f"{quoted(c)}(?:{'|'.join(rest)})(?![A-Za-z0-9])" for c, rest in by_first.items())
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9])(?=({tree}))"), F.lit(1)))
    more = {t: F.array(*map(F.lit, found)) for t, found in inside.items() if len(found) > 1}
    if more:
        pairs = F.create_map(*(x for t, found in more.items() for x in (F.lit(t), found)))
        hits = F.flatten(F.transform(hits, lambda h: F.coalesce(F.try_element_at(pairs, h), F.array(h))))
    return let(hits, lambda found: F.when(F.size(found) > 0, F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(found, t))).otherwise(no_strings()))
