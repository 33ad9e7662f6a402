"""Special functions as SQL expressions that Spark and other engines evaluate alike, and closed-form option formulas."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hart's rational approximation of the normal distribution, numerator and denominator, highest power first.
_HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(z: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        out = f"({out} * {z} + {c!r})"
    return out


def normal_cdf_sql(x: str) -> str:
    """SQL of the standard normal distribution function of the SQL expression ``x`` (a double); error below 1e-14 within 7."""
    z = f"abs({x})"
    top = _horner(z, _HART_TOP)
    inner = f"exp(-({x}) * ({x}) / 2) * ({top}) / ({_horner(z, _HART_BOTTOM)})"
    far = f"exp(-({x}) * ({x}) / 2) / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / 2.506628274631"
    tail = f"case when {z} > 37 then 0.0 when {z} < 7.07106781186547 then {inner} else {far} end"
    return _as_double(f"(case when {x} > 0 then 1 - ({tail}) else {tail} end)")


def _as_double(sql: str) -> str:
    """Decimal literals as doubles: some engines take them for decimals."""
    return re.sub(r"(?<![\w.])(\d+\.\d+(?:e[+-]?\d+)?|\d+e[+-]?\d+)(?![\w.])", r"cast('\1' as double)", sql)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function. ``x`` is bound by a one-element transform, so it is evaluated once."""
    return F.transform(F.array(x), lambda z: _cdf_column(z))[0]


def _cdf_column(x: Column) -> Column:
    z = F.abs(x)
    top, bottom = F.lit(_HART_TOP[0]), F.lit(_HART_BOTTOM[0])
    for c in _HART_TOP[1:]:
        top = top * z + F.lit(c)
    for c in _HART_BOTTOM[1:]:
        bottom = bottom * z + F.lit(c)
    bell = F.exp(-x * x / 2)
    far = bell / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, bell * top / bottom).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def black_price(forward: Column, strike: Column, tau: Column, sigma: Column, call: Column, rate: Column | None = None) -> Column:
    """Price of an option on a forward; intrinsic value where sigma or tau isn't above zero."""
    discount = F.lit(1.0) if rate is None else F.exp(-rate * tau)
    total = sigma * F.sqrt(tau)
    d1 = F.log(forward / strike) / total + total / 2
    as_call = forward * normal_cdf(d1) - strike * normal_cdf(d1 - total)
    as_put = strike * normal_cdf(total - d1) - forward * normal_cdf(-d1)
    intrinsic = F.when(call, F.greatest(forward - strike, F.lit(0.0))).otherwise(F.greatest(strike - forward, F.lit(0.0)))
    good = (forward > 0) & (strike > 0) & (total > 0)
    return discount * F.when(good, F.when(call, as_call).otherwise(as_put)).otherwise(intrinsic)


def ssvi_phi(theta: Column, eta: Column, gamma: Column) -> Column:
    """eta / (theta^gamma (1 + theta)^(1 - gamma)), theta at least 1e-8."""
    t = F.greatest(theta, F.lit(1e-8))
    return eta / (F.pow(t, gamma) * F.pow(1 + t, 1 - gamma))


def ssvi_variance(k: Column, theta: Column, rho: Column, phi: Column) -> Column:
    """Total variance of the surface at log-moneyness k."""
    a = phi * k + rho
    return theta / 2 * (1 + rho * phi * k + F.sqrt(a * a + 1 - rho * rho))


def butterfly_slack(theta: Column, rho: Column, phi: Column) -> Column:
    """4 less the greater of theta phi (1 + |rho|) and theta phi^2 (1 + |rho|); free of butterflies where not below zero."""
    r = 1 + F.abs(rho)
    return 4 - F.greatest(theta * phi * r, theta * phi * phi * r)


def calendar_slack(rho: Column, gamma: Column) -> Column:
    """(1 + sqrt(1 - rho^2)) - rho^2 (1 - gamma)."""
    return 1 + F.sqrt(1 - rho * rho) - rho * rho * (1 - gamma)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pareto_density(x: Column, shape: Column, scale: Column) -> Column:
    """Generalised Pareto density of an excess; exponential as the shape goes to 0; 0 outside the support."""
    z = x / scale
    base = 1 + shape * z
    power = F.when(F.abs(shape) < 1e-9, F.exp(-z)).otherwise(F.pow(F.greatest(base, F.lit(1e-300)), -1 / shape - 1))
    return F.when((x < 0) | (base <= 0), F.lit(0.0)).otherwise(power / scale)
