"""Numeric helpers as pure column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.settings import BASE_TEMP_C


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, NULL when y is 0."""
    return F.try_divide(x, y)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate sum(v*w)/sum(w)."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def degree_hours(temp: Column, base: float = BASE_TEMP_C) -> tuple[Column, Column]:
    """(heating, cooling); a missing temperature gives 0 because `greatest` skips NULL."""
    return F.greatest(F.lit(0.0), F.lit(base) - temp), F.greatest(F.lit(0.0), temp - F.lit(base))


def price_components(lbmp: str, mlc: str, mcc: str) -> dict[str, Column]:
    """Published price, loss and congestion fields -> additive components (congestion is published with opposite sign)."""
    return {"total": F.col(lbmp), "energy": F.col(lbmp) - F.col(mlc) + F.col(mcc), "loss": F.col(mlc),
            "congestion": -F.col(mcc)}


def tidy_value(x: Column, digits: int = 2) -> Column:
    """NaN -> NULL, then rounded."""
    return F.round(F.when(~F.isnan(x), x), digits)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def stabilise(x: Column, med: Column, mad: Column) -> Column:
    return F.asinh((x - med) / mad)


def destabilise(z: Column, med: Column, mad: Column) -> Column:
    return F.sinh(z) * mad + med


def _poly(x: Column, coefs: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefs[1:], F.lit(coefs[0]))


# fixed values: rational approximation of the normal distribution function (Hart 1968, double precision)
_CDF_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
            220.206867912376]
_CDF_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
            793.826512519948, 440.413735824752]
# fixed values: rational approximation of the normal quantile (Acklam), refined by one Halley step
_PPF_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01,
          2.506628277459239e00]
_PPF_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00,
          2.938163982698783e00]
_PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
_PPF_EDGE = 0.02425


def bind(x: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `x` once and use it many times in `body`: keeps deep formulas from copying their argument."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    def body(v: Column) -> Column:
        def upper(a: Column) -> Column:
            dens = F.exp(-a * a / F.lit(2.0))
            near = dens * _poly(a, _CDF_NUM) / _poly(a, _CDF_DEN)
            tail = reduce(lambda acc, k: a + F.lit(float(k)) / acc, (4, 3, 2, 1), a + F.lit(0.65))
            return F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(dens / tail / F.lit(2.506628274631))

        above = bind(F.abs(v), upper)
        return F.when(v > 0, F.lit(1.0) - above).otherwise(above)

    return bind(x.cast("double"), body)


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile for 0 < p < 1 (NULL outside)."""
    def rough(low: Column) -> Column:
        tail = bind(F.sqrt(F.lit(-2.0) * F.ln(low)), lambda q: _poly(q, _PPF_C) / _poly(q, _PPF_D))
        centre = bind(low - F.lit(0.5), lambda d: bind(d * d, lambda r: _poly(r, _PPF_A) * d / _poly(r, _PPF_B)))
        return F.when(low < _PPF_EDGE, tail).otherwise(centre)

    def lower_half(low: Column) -> Column:
        def refine(x: Column) -> Column:
            err = (norm_cdf(x) - low) * F.sqrt(F.lit(2.0) * F.pi()) * F.exp(x * x / F.lit(2.0))
            return bind(err, lambda e: x - e / (F.lit(1.0) + x * e / F.lit(2.0)))

        return bind(rough(low), refine)

    def body(v: Column) -> Column:
        x = bind(F.least(v, F.lit(1.0) - v), lower_half)
        return F.when(v > 0.5, -x).otherwise(x)

    return bind(F.when((p > 0) & (p < 1), p.cast("double")), body)


def normal_scores(u: Column) -> Column:
    return norm_ppf(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), u)))


def chi2_1_sf(x: Column) -> Column:
    """Survival function of chi-square with one degree of freedom."""
    return F.lit(2.0) * norm_cdf(-F.sqrt(F.greatest(x, F.lit(0.0))))


def gpd_quantile(p: Column, xi: Column, sigma: Column) -> Column:
    """Generalised Pareto quantile; the exponential limit at xi = 0."""
    return F.when(F.abs(xi) < 1e-9, -sigma * F.ln(F.lit(1.0) - p)).otherwise(
        sigma / xi * (F.pow(F.lit(1.0) - p, -xi) - F.lit(1.0)))


def hash_uniform(*parts: Column, seed: int = 0) -> Column:
    """Uniform on (0, 1) from the values of `parts`: the same row gets the same draw on any partitioning or retry."""
    bits = F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
