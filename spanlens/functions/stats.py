"""Statistics as column expressions over counts and estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the normal distribution as published.
Z95 = 1.959964


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa of a 2 x 2 table, null where the expected agreement is 1."""
    n = (n11 + n10 + n01 + n00).cast("double")
    agree = (n11 + n00) / n
    expected = ((n11 + n10) / n) * ((n11 + n01) / n) + ((n01 + n00) / n) * ((n10 + n00) / n)
    return F.when((n > 0) & (expected < 1), (agree - expected) / (1 - expected))


def mcc(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Matthews correlation, 0 where a margin is empty."""
    under = (n11 + n10).cast("double") * (n11 + n01) * (n00 + n10) * (n00 + n01)
    return F.when(under > 0, (n11.cast("double") * n00 - n10.cast("double") * n01) / F.sqrt(under)).otherwise(F.lit(0.0))


def mutual_information(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """In nats."""
    n = (n11 + n10 + n01 + n00).cast("double")

    def cell(c: Column, row: Column, col: Column) -> Column:
        return F.when(c > 0, c / n * F.log(c * n / (row.cast("double") * col))).otherwise(F.lit(0.0))

    return cell(n11, n11 + n10, n11 + n01) + cell(n10, n11 + n10, n10 + n00) + cell(n01, n01 + n00, n11 + n01) + cell(n00, n01 + n00, n10 + n00)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a binomial share."""
    n = n.cast("double")
    share, zz = k / n, z * z
    centre = (share + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(share * (1 - share) / n + zz / (4 * n * n)) / (1 + zz / n)
    return centre - half, centre + half


def hanley_mcneil(auc: Column, pos: Column, neg: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Standard error and interval of an AUC (not clipped)."""
    q1, q2, sq = auc / (2 - auc), 2 * auc * auc / (1 + auc), auc * auc
    var = (auc * (1 - auc) + (pos - 1) * (q1 - sq) + (neg - 1) * (q2 - sq)) / (pos.cast("double") * neg)
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return se, auc - z * se, auc + z * se


def robust_gap(auc_z: Column, auc_y: Column) -> Column:
    """Difference of the distances from one half: blind to the score's orientation."""
    return F.abs(auc_z - 0.5) - F.abs(auc_y - 0.5)


def cohens_d(m1: Column, v1: Column, n1: Column, m0: Column, v0: Column, n0: Column) -> Column:
    """Standardised mean difference with the pooled sample deviation; null under two rows a class or without spread."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))
    return F.when((n1 >= 2) & (n0 >= 2) & (pooled > 0), (m1 - m0) / pooled)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 from a rational approximation of the error function (absolute error below 2e-7)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # Coefficients of the published approximation (Abramowitz and Stegun 7.1.26).
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-x * x)
