"""Statistical scores as column expressions; they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def decay(days: Column, half_life: float = 30.0, base: float = 1.0) -> Column:
    """base * 2^(-days / half_life); the future isn't decayed."""
    return F.when(days < 0, F.lit(base)).otherwise(base * F.exp(-(F.ln(F.lit(2.0)) / half_life) * days))


def normal_tail(z: Column) -> Column:
    """The probability that a standard normal number is further from 0 than z, without subtraction from 1."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def normal_cdf(z: Column) -> Column:
    half = 0.5 * normal_tail(z)
    return F.when(z < 0, half).otherwise(1.0 - half)


def chi_p_value(chi: Column) -> Column:
    return normal_tail(F.sqrt(chi))


def expected_cooccurrence(n_a: Column, n_b: Column, gap_days: Column | float, range_days: Column | float) -> Column:
    gap, span = (x if isinstance(x, Column) else F.lit(float(x)) for x in (gap_days, range_days))
    return F.when(span <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.1), n_a * F.least(F.lit(1.0), n_b * gap / span)))


def chi_square(obs: Column, exp: Column, n_a: Column) -> Column:
    rest = F.when(n_a > exp, F.pow((n_a - obs) - (n_a - exp), F.lit(2.0)) / F.greatest(F.lit(0.1), n_a - exp)).otherwise(0.0)
    return F.when(exp <= 0, F.lit(0.0)).otherwise(F.pow(obs - exp, F.lit(2.0)) / exp + rest)


def fisher_cells(obs: Column, n_a: Column, n_b: Column) -> tuple[Column, Column, Column, Column]:
    b, c = F.greatest(F.lit(0), n_b - obs), F.greatest(F.lit(0), n_a - obs)
    return obs, b, c, F.greatest(F.lit(1), n_a + n_b - obs - b - c)


def odds_ratio(obs: Column, n_a: Column, n_b: Column) -> Column:
    a, b, c, d = fisher_cells(obs, n_a, n_b)
    return F.when(b * c > 0, F.least(F.lit(100.0), a * d / (b * c))).otherwise(F.when(a > 0, F.lit(100.0)).otherwise(1.0))


def fisher_chi(obs: Column, n_a: Column, n_b: Column) -> Column:
    a, b, c, d = fisher_cells(obs, n_a, n_b)
    e = (a + b) * (a + c) / (a + b + c + d)
    return F.when(e > 0, F.pow(a - e, F.lit(2.0)) / e).otherwise(0.0)


def cramers_v(chi: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(chi / n)).otherwise(0.0)


def band(x: Column, bounds: tuple[float, float, float]) -> Column:
    return F.when(x < bounds[0], "negligible").when(x < bounds[1], "small").when(x < bounds[2], "medium").otherwise("large")


def consistency(avg: Column, std: Column) -> Column:
    """1 less the coefficient of variation, at least 0; 1 where the mean is 0."""
    return F.when(avg == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(std / avg, F.lit(1.0))))
