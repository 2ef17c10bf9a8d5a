"""Rating formulas as column expressions, and their parameters.

The one-race update is algorithm 4 (Plackett-Luce) of Weng and Lin, "A
Bayesian approximation method for online ranking", JMLR 12 (2011).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RatingParams:
    mu: float = 25.0
    sigma: float = 25.0 / 3.0
    beta: float = 25.0 / 120.0
    kappa: float = 1e-4
    tau: float = 25.0 / 300.0
    target: float = 1000.0
    scale: float = 200.0

    @property
    def alpha(self) -> float:
        return self.scale / self.sigma


DEFAULT = RatingParams()


def ordinal(mu: Column, sigma: Column, params: RatingParams = DEFAULT) -> Column:
    """Displayed rating; a new player has exactly `target`."""
    return (mu - 3.0 * sigma) * F.lit(params.alpha) + F.lit(params.target)


def normal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / sigma
    return F.exp(-0.5 * z * z) / (sigma * F.sqrt(2.0 * F.pi()))


# Coefficients of Hart's rational approximation of the normal
# distribution function (double precision).
_HART_NUM = [
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
_HART_DEN = [
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]


def _horner(x: Column, coefficients: list[float]) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, without leaving the JVM."""
    a = F.abs(x)
    body = F.exp(-0.5 * a * a)
    near = body * _horner(a, _HART_NUM) / _horner(a, _HART_DEN)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    far = body / (tail * 2.506628274631)
    upper = F.when(a > 37.0, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - upper).otherwise(upper)


def win_probability(
    mu_a: Column, var_a: Column, mu_b: Column, var_b: Column, players: Column,
    params: RatingParams = DEFAULT,
) -> Column:
    """Chance that team A beats team B, from summed means and variances."""
    spread = F.sqrt(players * F.lit(params.beta**2) + var_a + var_b)
    return normal_cdf((mu_a - mu_b) / spread)
