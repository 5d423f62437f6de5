"""Trust weights and their combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfuse.functions import rules as R
from loomfuse.functions.text import col, lookup, round4


def priority(source: Column | str) -> Column:
    return F.coalesce(lookup(R.SOURCE_PRIORITY, col(source)), F.lit(R.LAST_PRIORITY))


def field_weight(source: Column | str, field: str) -> Column:
    known = {s: R.WEIGHTS[s, field] for s in R.SOURCE_TRUST} if field in R.FIELD_TRUST else R.SOURCE_TRUST
    return F.coalesce(lookup(known, col(source)), F.lit(R.DEFAULT_TRUST))


def method(source: Column | str, tag: str | None = None) -> Column:
    base = F.coalesce(lookup(R.METHODS, col(source)), F.lit("extracted"))
    return F.concat(base, F.lit(f"+{tag}")) if tag else base


def noisy_or(weights: Column | str) -> Column:
    """1 - product of (1 - w), left to right over the array, to four places; 0.0 of none."""
    clamp = lambda w: F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))
    return round4(F.lit(1.0) - F.aggregate(col(weights), F.lit(1.0), lambda a, w: a * (F.lit(1.0) - clamp(w))))


def mean_times(values: Column | str, factor: Column) -> Column:
    """Mean, summed left to right, times a factor, to four places; 0.0 of none."""
    values = col(values)
    return F.coalesce(round4(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0)) * factor), F.lit(0.0))
