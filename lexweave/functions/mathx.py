"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = -10000.0


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)); the smaller is dropped where it cannot count, and the floor stands for log 0."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when((low <= FLOOR) | (high - low > 20), high).otherwise(high + F.log1p(F.exp(low - high)))


def n_log_n(n: Column) -> Column:
    """n times log2 n; 0 at 0."""
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def witten_bell(count: Column, total: Column, kinds: Column, below: Column) -> Column:
    """Probability of an event seen ``count`` of ``total`` times among ``kinds``, smoothed with ``below``."""
    weight = total / (total + kinds)
    return F.when(total > 0, weight * count / total + (1 - weight) * below).otherwise(below)


def round_scaled(x: Column, digits: int) -> Column:
    """A double rounded to ``digits``, halves of its scaled binary value away from zero, as SQL engines round that scale, round and scale back.

    ``F.round`` rounds the shortest decimal text instead: 2084.1775 is 2084.178 there, but 2084.177 here, as
    2084.1775 * 1000 is below 2084177.5. Null, NaN, infinite values and those that overflow when scaled stay.
    """
    scaled = x * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < F.lit(float("inf")), F.round(scaled) / F.lit(10.0**digits)).otherwise(x)


def bernoulli(outcome: Column, p: Column) -> Column:
    """Probability of an outcome that is true with ``p``."""
    return F.when(outcome, p).otherwise(1 - p)


def pmi(joint: Column, a: Column, b: Column, total: Column) -> Column:
    return F.log2(joint * total / (a * b))


#: Ways to put scores together; -1 stands for a score that is not specified.
def combine(scores: Column, how: str, top: Column | None = None) -> Column:
    """Combined score of an array: ``max`` (0 at least), ``min`` (1 at most), ``mult``, ``mult-including-top``, ``avg``.

    Scores of -1 are left out; -1 if none is left. A top score of its own overrides all ways but ``mult-including-top``,
    which multiplies it too.
    """
    known = F.filter(scores, lambda s: s.isNotNull() & (s != -1))
    none = F.size(known) == 0
    product = F.aggregate(known, F.lit(1.0), lambda a, s: a * s)
    out = {
        "max": F.greatest(F.lit(0.0), F.array_max(known)),
        "min": F.least(F.lit(1.0), F.array_min(known)),
        "mult": product,
        "mult-including-top": product,
        "avg": F.aggregate(known, F.lit(0.0), lambda a, s: a + s) / F.size(known),
    }[how]
    out = F.when(none, F.lit(-1.0)).otherwise(out)
    if top is None:
        return out
    has_top = top.isNotNull() & (top != -1)
    if how == "mult-including-top":
        return F.when(has_top & none, top).when(has_top, out * top).otherwise(out)
    return F.when(has_top, top).otherwise(out)
