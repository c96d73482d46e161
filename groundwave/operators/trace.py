"""Operators on one trace: column expressions over arrays of samples, no shuffle and no Python.

A sample axis is (t0, dt, ns); positions are 1-based where a rule counts samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def dc_removal(amp: Column, dt: float, start: float, end: float, ns: int) -> Column:
    """Minus the mean of the samples with start <= t <= end; the end is clamped to the trace."""
    first, last = math.ceil(start / dt - 1e-9), min(math.floor(end / dt + 1e-9), ns - 1)
    level = mean(F.slice(amp, first + 1, last - first + 1))
    return F.zip_with(amp, F.array_repeat(level, F.size(amp)), lambda x, m: x - m)


def gain_curve(points_db: list[float], ns: int) -> list[float]:
    """Factors of dB points that are spread evenly over the samples and joined by lines."""
    out = []
    for i in range(ns):
        at = i * (len(points_db) - 1) / max(1, ns - 1)
        k = min(int(at), len(points_db) - 2)
        out.append(10 ** ((points_db[k] + (points_db[k + 1] - points_db[k]) * (at - k)) / 20))
    return out


def gain(amp: Column, factors: list[float]) -> Column:
    return F.zip_with(amp, F.array(*map(F.lit, factors)), lambda x, g: x * g)


def order_statistic(values: Column, p: float) -> Column:
    """sorted[floor(n p + 1)], the largest for p of 0 or 1."""
    n = F.size(values)
    at = F.floor(n * p + 1).cast("int") if 0 < p < 1 else n
    return F.try_element_at(F.array_sort(values), F.least(at, n))


def normalize(amp: Column, clip: float = 0.98) -> Column:
    """Divided by the order statistic of absolute samples, of those that are there; 0 where that is 0 and for missing samples."""
    scale = order_statistic(F.transform(F.filter(amp, lambda x: x.isNotNull() & ~F.isnan(x)), F.abs), clip)
    return F.zip_with(amp, F.array_repeat(scale, F.size(amp)), lambda x, s: F.coalesce(F.nanvl(F.try_divide(x, s), F.lit(0.0)), F.lit(0.0)))


def cut_time(amp: Column, dt: float, tmax: float) -> Column:
    """Samples with t <= tmax."""
    return F.slice(amp, 1, int(math.floor(tmax / dt + 1e-9)) + 1)


def t0_shift(amp: Column, dt: float, t0: float) -> Column:
    """The first round(t0/dt)-1 samples go; as many zeros follow."""
    n = max(0, math.floor(t0 / dt + 0.5) - 1)
    return F.concat(F.slice(amp, n + 1, F.greatest(F.size(amp) - n, F.lit(0))), F.array_repeat(F.lit(0.0), n))


def decimate(amp: Column, n: int) -> Column:
    return F.filter(amp, lambda _, i: i % n == 0)


def spherical_divergence(amp: Column, dt: float) -> Column:
    return F.transform(amp, lambda x, i: x * (i * dt))


def attenuation(amp: Column, dt: float, sigma: float, eps: float) -> Column:
    """Times exp(sigma/2 sqrt(mu0/(eps eps0)) z), z being the depth of t at the speed that eps gives."""
    mu0, eps0, c = 4e-7 * math.pi, 8.8541878128e-12, 0.299792458
    rate = sigma / 2 * math.sqrt(mu0 / (eps * eps0)) * c / math.sqrt(eps) / 2 * dt
    return F.transform(amp, lambda x, i: x * F.exp(i * rate))


def t0_threshold(amp: Column, threshold: float) -> Column:
    """Without what lies before the first sample over (or, if negative, under) the threshold, zeros at the end; unchanged if no sample does, or only the last."""
    hit = F.filter(F.sequence(F.lit(1), F.size(amp)), lambda i: (i < F.size(amp)) & (F.element_at(amp, i) >= threshold if threshold >= 0 else F.element_at(amp, i) <= threshold))
    first = F.coalesce(F.get(hit, F.lit(0)), F.lit(1))
    return F.concat(F.slice(amp, first, F.size(amp) - first + 1), F.array_repeat(F.lit(0.0), first - 1))


def median_filter(amp: Column, m: int) -> Column:
    """Centred median of m samples (m odd), edges repeated."""
    h = m // 2
    padded = F.concat(F.array_repeat(F.element_at(amp, 1), h), amp, F.array_repeat(F.element_at(amp, -1), h))
    return F.transform(F.sequence(F.lit(1), F.size(amp)), lambda i: F.element_at(F.array_sort(F.slice(padded, i, m)), h + 1))


def resample(amp: Column, dt: float, new_dt: float, ns: int) -> Column:
    """Linear interpolation on a new step; null beyond the last sample."""

    def at(j: Column) -> Column:
        p = j * (new_dt / dt)
        k = F.floor(p).cast("int")
        a, b = F.get(amp, k), F.get(amp, k + 1)
        return F.when(p == k, a).otherwise(a + (b - a) * (p - k))

    return F.transform(F.sequence(F.lit(0), F.lit(ns - 1)), at)


def stack(arrays: Column) -> Column:
    """The mean trace of an array of traces of one length."""
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(arrays, 1))), lambda k: mean(F.transform(arrays, lambda a: F.element_at(a, k))))


def blend(a: Column, b: Column, share: Column) -> Column:
    """a + (b - a) share, sample by sample."""
    return F.zip_with(F.arrays_zip(a.alias("a"), b.alias("b")), F.array_repeat(share, F.size(a)), lambda x, s: x["a"] + (x["b"] - x["a"]) * s)


def padded(amp: Column, ns: int) -> Column:
    """ns samples: longer traces are cut, shorter ones end in zeros."""
    return F.concat(F.slice(amp, 1, ns), F.array_repeat(F.lit(0.0), F.greatest(ns - F.size(amp), F.lit(0))))


def wiggle(amp: Column) -> Column:
    """Divided by the largest sample; 0 where that is 0."""
    return F.zip_with(amp, F.array_repeat(F.array_max(amp), F.size(amp)), lambda x, m: F.coalesce(F.try_divide(x, m), F.lit(0.0)))
