"""Statistics as column expressions: guarded correlation, archetypes, histogram bins, divergences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Rounded to 6 places, as every floating result is."""
    return F.round(col(c), 6)


def guarded_r(x: Column | str, y: Column | str, least: int) -> Column:
    """Pearson's r as an aggregate; null below ``least`` pairs or where either side does not vary.

    Sums over pairs with both present; the division stands behind the guard, so ANSI mode cannot raise.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((n >= least) & (spread > 1e-9), F.try_divide(F.avg(a * b) - F.avg(a) * F.avg(b), spread))


def archetype(power: Column | str, moral: Column | str, band: float = 0.25) -> Column:
    """Quadrant of a reading: neutral near the origin, else hero, villain, victim or nuisance."""
    p, m = col(power), col(moral)
    return (
        F.when(p.isNull() | m.isNull(), None)
        .when((F.abs(p) < band) & (F.abs(m) < band), "neutral")
        .when((p >= 0) & (m >= 0), "hero")
        .when(p >= 0, "villain")
        .when(m >= 0, "victim")
        .otherwise("nuisance")
    )


def score_bin(score: Column | str, bins: int = 8) -> Column:
    """1-based bin of a score clipped to [-2, 2]; the last bin is closed."""
    clipped = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), col(score)))
    return F.least(F.lit(bins), F.floor((clipped + 2) * (bins / 4)).cast("int") + 1)


def divergence_term(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    v, w = col(value), col(weight)
    return F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))


def significance(common: Column | str, full: int = 50) -> Column:
    """Weight of a correlation by its number of common items."""
    return F.least(F.lit(1.0), col(common).cast("double") / full)
