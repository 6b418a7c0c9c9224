"""Day-of-year arithmetic on a circle of 365.25 days, and circular statistics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

YEAR = 365.25


def radians_of_day(doy: Column) -> Column:
    return F.lit(2 * math.pi / YEAR) * doy


def wrap_radians(x: Column) -> Column:
    return F.atan2(F.sin(x), F.cos(x))


def signed_offset_days(doy: Column, centre: Column) -> Column:
    """Shortest way round the year from ``centre`` to ``doy``, in days."""
    return wrap_radians(radians_of_day(doy - centre)) * (YEAR / (2 * math.pi))


def wrap_days(doy: Column) -> Column:
    """Into (0, 365.25]."""
    w = F.pmod(doy.cast("double"), F.lit(YEAR))
    return F.when(w <= 0, w + YEAR).otherwise(w)


def day_of_year(given: Column, date: Column, year: Column, month: Column, day: Column) -> Column:
    """The given day, else that of the date text, else that of the parts."""
    parts = F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")
    return F.coalesce(given, F.dayofyear(F.substring(date, 1, 10).try_cast("date")), F.dayofyear(F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), parts)))


def mean_day(doy: Column) -> Column:
    """Aggregate: circular mean of days 1 to 366; the median where the days cancel out."""
    ok = F.when(doy.between(1, 366), doy)
    s, c = F.avg(F.sin(radians_of_day(ok))), F.avg(F.cos(radians_of_day(ok)))
    angle = F.atan2(s, c)
    turned = F.when(angle <= 0, angle + 2 * math.pi).otherwise(angle)
    return F.when(F.sqrt(s * s + c * c) < 1e-8, F.median(ok)).otherwise(turned * (YEAR / (2 * math.pi)))


def resultant(doy: Column, weight: Column | None = None) -> Column:
    """Aggregate: mean resultant length, weighted if wanted."""
    t = radians_of_day(doy)
    if weight is None:
        return F.sqrt(F.pow(F.avg(F.sin(t)), 2) + F.pow(F.avg(F.cos(t)), 2))
    total = F.sum(F.when(doy.isNotNull(), weight))
    return F.sqrt(F.pow(F.sum(weight * F.sin(t)) / total, 2) + F.pow(F.sum(weight * F.cos(t)) / total, 2))


def circular_sd_days(r: Column) -> Column:
    """√(−2 ln R) in days; a resultant of 1 has none."""
    return F.when((r > 0) & (r < 1), F.sqrt(-2 * F.ln(r)) * (YEAR / (2 * math.pi))).when(r >= 1, 0.0)


def rayleigh_p(r: Column, n: Column) -> Column:
    """p of uniformity by the usual approximation in Z = nR²."""
    z = n * r * r
    p = F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * F.pow(z, 3) - 9 * F.pow(z, 4)) / (288 * n * n))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def von_mises_kappa(r: Column, n: Column) -> Column:
    """Concentration by the piecewise approximation, corrected for fewer than 16 values."""
    k = F.when(r < 0.53, 2 * r + F.pow(r, 3) + 5 * F.pow(r, 5) / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(1 / F.nullif(F.pow(r, 3) - 4 * r * r + 3 * r, F.lit(0.0)))
    small = F.when(k < 2, F.greatest(k - 2 / (n * k), F.lit(0.0))).otherwise(F.pow(n - 1, 3) * k / (n * (n * n + 1)))
    return F.when(n < 16, small).otherwise(k)
