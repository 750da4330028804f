"""Numbers: clipping, ratios, costs, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_score(c: Column) -> Column:
    """A score clipped to [0, 1]; null and NaN are 0."""
    x = F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a, b).cast("double")


def token_cost(inputs: Column, outputs: Column, in_rate: Column, out_rate: Column) -> Column:
    """Cost of a call at rates per million tokens."""
    return (inputs * in_rate + outputs * out_rate) / F.lit(1_000_000.0)


def spend_flag(spent: Column, cap: Column, warn: Column) -> Column:
    return F.when(spent > cap, "OVER").when(spent >= warn, "WARN").otherwise("OK")


def request_flag(n: Column, cap: Column) -> Column:
    return F.when(n > cap, "OVER").when(n >= F.floor(cap * 0.8), "WARN").otherwise("OK")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(a: Column) -> Column:
    """A vector divided by its length; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
