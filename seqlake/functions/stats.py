"""Numbers: distributions and quantiles that Spark has not built in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def poisson_pmf(k: Column, mu: Column) -> Column:
    """exp(-mu + k ln mu - ln k!), with ln k! as a sum, so k is not limited to 20."""
    fact = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(k < 0, 0.0).otherwise(F.exp(-mu + k * F.log(mu) - fact))


def pnorm(x: Column) -> Column:
    """Normal distribution by the five-term rational approximation of Abramowitz and Stegun, 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def qnorm(p: Column) -> Column:
    """Normal quantile by Acklam's rational approximation, relative error below 1.2e-9."""
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)

    def poly(x, k):
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    tail = lambda q: poly(q, c) / poly(q, d)
    q = p - 0.5
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(q * poly(q * q, a) / poly(q * q, b))


def quantile_p_interp(values: Column, p: float) -> Column:
    """A quantile of a sorted array that interpolates with p itself instead of the position's fraction."""
    at = F.floor((F.size(values) - 1) * F.lit(p)).cast("int")
    low, high = F.get(values, at), F.coalesce(F.get(values, at + 1), F.get(values, at))
    return low + p * (high - low)


def clip_length(count: Column, sampled: Column, length: Column, least: int = 1, scale: float = 2.2) -> Column:
    """Bases of an adapter that must match, from how often it was seen; from scale 100 on the whole adapter."""
    if scale >= 100:
        return length
    by_rate = F.floor(-F.log(count / sampled) / F.log(F.lit(scale))).cast("int")
    return F.least(length, F.greatest(F.lit(least), by_rate))
