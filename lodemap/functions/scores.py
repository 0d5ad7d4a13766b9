"""Association scores as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _cell(k: Column, row: Column, col: Column, total: Column) -> Column:
    return F.when(k > 0, k * F.log(k * total / (row * col))).otherwise(F.lit(0.0))


def g2(n: Column, na: Column, nb: Column, total: Column) -> Column:
    """Log-likelihood ratio of the 2x2 table with joint count n and margins na, nb."""
    n, na, nb, total = (c.cast("double") for c in (n, na, nb, total))
    return 2 * (
        _cell(n, na, nb, total)
        + _cell(na - n, na, total - nb, total)
        + _cell(nb - n, total - na, nb, total)
        + _cell(total - na - nb + n, total - na, total - nb, total)
    )


def pmi(n: Column, na: Column, nb: Column, total: Column) -> Column:
    """Pointwise mutual information, natural log."""
    n, na, nb, total = (c.cast("double") for c in (n, na, nb, total))
    return F.log(n * total / (na * nb))


def npmi(n: Column, na: Column, nb: Column, total: Column) -> Column:
    """PMI scaled into [-1, 1]; null where the pair is in every unit."""
    n_, t_ = n.cast("double"), total.cast("double")
    return F.when(n_ < t_, pmi(n, na, nb, total) / -F.log(n_ / t_))


def lift(n: Column, na: Column, nb: Column, total: Column) -> Column:
    n, na, nb, total = (c.cast("double") for c in (n, na, nb, total))
    return n * total / (na * nb)


def jaccard(n: Column, na: Column, nb: Column) -> Column:
    return n.cast("double") / (na + nb - n)


def dice(n: Column, na: Column, nb: Column) -> Column:
    return 2 * n.cast("double") / (na + nb)


def tfidf(tf: Column, df: Column, n_units: Column) -> Column:
    """tf * ln((N + 1) / (df + 1))."""
    return tf * F.log((n_units.cast("double") + 1) / (df + 1))
