"""Case tables of the scalar normalizers, one frame for each."""

import pytest
from pyspark.sql import functions as F

from loomfuse.functions import normalize as N
from loomfuse.functions.confidence import mean_times, noisy_or
from loomfuse.functions.text import round4, squash, strip

TABLES = {
    "email": (N.email, [("  ANN.LEE@Mail.org ", "ann.lee@mail.org"), ("mailto:p@q.net", "p@q.net"), ("<c@d.io>", "c@d.io"), ("nobody", None), ("@host.com", None), ("a b@c.de", None), ("", None), (None, None)]),
    "phone_us": (lambda c: N.phone(c, F.lit("US")), [("(212) 555-0123", "+12125550123"), ("1 212 555 0123", "+12125550123"), ("+91 98765 43210", "+919876543210"), ("+34 612 345 678", "+34612345678"), ("123", None), ("call me", None), ("", None), (None, None)]),
    "phone_in": (lambda c: N.phone(c, F.lit("IN")), [("9876543210", "+919876543210"), ("098765 43210", "+919876543210"), ("12345", None)]),
    "phone_gb": (lambda c: N.phone(c, F.lit("GB")), [("020 7946 0958", "+442079460958"), ("+44 20 7946 0958", "+442079460958")]),
    "month": (N.month, [("Apr 2019", "2019-04"), ("april 2019", "2019-04"), ("Sept. 2019", "2019-09"), ("2019-04", "2019-04"), ("2019/4", "2019-04"), ("04/2019", "2019-04"), ("2019", "2019-01"), ("2019-04-15T10:30:00", "2019-04"), ("2019-04-15T10:30:00Z", "2019-04"), ("2019-02-31", None), ("Now", None), ("till date", None), ("soon", None), ("2019-13", None), (None, None)]),
    "year": (N.year, [("Class of 2018", 2018), ("in 1999", 1999), ("12018", 2018), ("none", None), (None, None)]),
    "country": (N.country, [("USA", "US"), ("u.s.", "US"), ("us.", "US"), ("India", "IN"), ("canada", "CA"), ("UK", "GB"), ("Germany", "DE"), ("de", "DE"), ("DEU", "DE"), ("Korea", "KR"), ("Atlantis", None), ("", None), (None, None)]),
    "name": (N.name, [("ann  LEE", "Ann Lee"), ("McDonald o'neil", "McDonald O'neil"), ("  ", None), ("李 明", "李 明"), (None, None)]),
    "name_key": (N.name_key, [("Ann O'Lee", "ann olee"), ("José", "jos"), ("李明", None), (None, None)]),
    "url": (N.url, [("github.com/x/", "https://github.com/x"), ("HTTP://A.b//", "HTTP://A.b"), (" ", None), (None, None)]),
    "link": (N.link_kind, [("https://www.linkedin.com/in/x", "linkedin"), ("https://x.github.io", "github"), ("https://a.b", "other"), ("", None)]),
    "skill": (N.skill, [("golang", "Go"), (" K8s,", "Kubernetes"), ("c++", "C++"), ("xyz", "XYZ"), ("rust  lang", "Rust Lang"), ("  ", None), (None, None)]),
    "strip": (strip, [("  a b \n", "a b"), ("\x1ca", "a")]),
    "squash": (squash, [(" a\t\nb ", "a b")]),
}


@pytest.mark.parametrize("name", TABLES)
def test_table(spark, name):
    make, cases = TABLES[name]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = [r[0] for r in df.select("i", make("x").alias("y")).orderBy("i").select("y").collect()]
    assert got == [y for _, y in cases]


@pytest.mark.parametrize("text, want", [("Lyon, France", ("Lyon", None, "FR")), ("Austin, TX, USA", ("Austin", "TX", "US")), ("Austin, TX", ("Austin", "TX", None)), ("Mumbai, IN", ("Mumbai", "IN", None)), ("Paris", ("Paris", None, None)), (" , ", (None, None, None)), ("A, B, C, D", ("A", "B", None))])
def test_location(spark, text, want):
    assert tuple(spark.range(1).select(N.location(F.lit(text)).alias("l")).first()[0]) == want


@pytest.mark.parametrize("num, txt, want", [(7.0, None, 7.0), (-1.0, None, None), (None, "about 5.5 years", 5.5), (None, "-3", 3.0), (None, None, None), (0.0, None, 0.0)])
def test_years(spark, num, txt, want):
    assert spark.range(1).select(N.years_experience(F.lit(num).cast("double"), F.lit(txt).cast("string"))).first()[0] == want


def test_noisy_or_and_rounding(spark):
    import itertools

    weights = [0.9, 0.85, 0.76, 0.5, 0.35, 0.25, 0.2, 0.15, 1.5, -1.0]
    sets = [list(c) for n in range(4) for c in itertools.combinations_with_replacement(weights, n)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, ws array<double>")
    got = {r[0]: r[1] for r in df.select("i", noisy_or("ws")).collect()}
    for i, s in enumerate(sets):
        p = 1.0
        for w in s:
            p *= 1 - min(max(w, 0.0), 1.0)
        assert got[i] == round(1 - p, 4)
    assert spark.range(1).select(mean_times(F.array(*map(F.lit, [0.35, 0.35, 0.4, 0.35])), F.lit(0.5))).first()[0] == 0.1813
    assert spark.range(1).select(round4(F.lit(123456.78905))).first()[0] == round(123456.78905, 4)


def values(spark, column, given, kind="string"):
    rows = spark.createDataFrame([(i, *(g if isinstance(g, tuple) else (g,))) for i, g in enumerate(given)], "i int, a string" + (", b string" if isinstance(given[0], tuple) else ""))
    return [r[0] for r in rows.orderBy("i").select(column.cast(kind)).collect()]


def test_phone_extensions_letters_and_ranges(spark):
    given = [("+1 (415) 555-2671 ext. 12", "US"), ("1-800-FLOWERS", "US"), ("415a5552671", "US"), ("tel: 415.555.2671x77", "US"), ("911 555 1234", "US"), ("415-411-1234", "US"), ("+1 374 555 2671", "US"), ("(0)20 7946 0018", "GB"), ("+44 20 7946 0018;ext=9", "US"), ("+91-98765-43210 #3", "US"), ("call FLOWERS", "US"), ("4155552671", "ZZ"), (None, "US"), ("+1 415 555 2671 extension 4", "IN"), ("", "US")]
    assert values(spark, N.phone("a", "b"), given) == ["+14155552671", "+18003569377", "+14155552671", "+14155552671", None, None, None, "+442079460018", "+442079460018", "+919876543210", None, None, None, "+14155552671", None]


def test_country_codes_names_and_long_forms(spark):
    given = ["India", "356", " republic of india ", "the Federal Republic of Germany", "Côte d\u2019Ivoire", "cote d'ivoire", "DEU.", "Türkiye", "Turkey", "Korea, Republic of", "Iran, Islamic Republic of", "XK", "983", "Czech Republic", "840", "Atlantis", "", None, "Republic of Atlantis"]
    assert values(spark, N.country("a"), given) == ["IN", "IN", "IN", "DE", "CI", "CI", "DE", "TR", "TR", "KR", "IR", None, None, "CZ", "US", None, None, None, None]
    table = N.countries()
    assert len({v for k, v in table.items() if len(k) == 2}) == 249 and all(sum(len(k) == 3 and k.isdigit() and v == c for k, v in table.items()) == 1 for c in set(table.values()))


def test_names_keep_their_tails(spark):
    assert values(spark, N.name("a"), ["x" * 30_000 + " LEE", "McDonald o'neil"]) == ["X" + "x" * 29_999 + " Lee", "McDonald O'neil"]
