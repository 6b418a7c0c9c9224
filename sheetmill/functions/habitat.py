"""Soil, terrain and climate expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def rooting_zone_mean(a: Column, b: Column) -> Column:
    """0–15 cm from the 0–5 and 5–15 cm layers, by thickness; one layer alone stands for both."""
    return F.when(a.isNotNull() & b.isNotNull(), (5 * a + 10 * b) / 15).otherwise(F.coalesce(a, b))


def texture_log_ratios(sand: Column, clay: Column, silt: Column, floor: float = 0.5) -> Column:
    """struct(silt, ilr1, ilr2) of sand, silt and clay in percent, closed to 100: sand against the other two, and silt
    against clay. Each part is at least ``floor`` percent, silt is what is left where it is unknown or negative; nulls
    where sand or clay is unknown or negative."""
    s, c = F.greatest(F.lit(floor), sand), F.greatest(F.lit(floor), clay)
    t = F.greatest(F.lit(floor), F.when(silt >= 0, silt).otherwise(100 - s - c))
    known = lambda x: F.when((sand >= 0) & (clay >= 0), x)
    first, second = math.sqrt(2 / 3) * F.ln(s / F.sqrt(t * c)), math.sqrt(0.5) * F.ln(t / c)
    return F.struct(known(F.round(100 * t / (s + c + t), 2)).alias("silt"), known(F.round(first, 4)).alias("ilr1"), known(F.round(second, 4)).alias("ilr2"))


def heat_load(lat: Column, slope: Column, aspect: Column) -> Column:
    """Relative heat load of a slope by the published equation (all in degrees), the aspect folded so that south-west
    faces are warmest. Latitudes count as 15 to 60, slopes as 0 to 85; a flat cell or one without aspect has no aspect
    term; the result lies within 0.05 and 1.5; null without latitude or slope."""
    la = F.radians(F.least(F.lit(60.0), F.greatest(F.lit(15.0), F.abs(lat))))
    sl = F.radians(F.least(F.lit(85.0), F.greatest(F.lit(0.0), slope)))
    folded = F.radians(F.abs(180 - F.abs(F.pmod(aspect, F.lit(360.0)) - 225)))
    sloping = -1.467 + 1.582 * F.cos(la) * F.cos(sl) - 1.5 * F.cos(folded) * F.sin(sl) * F.sin(la) - 0.262 * F.sin(la) * F.sin(sl) + 0.607 * F.sin(folded) * F.sin(sl)
    flat = aspect.isNull() | (slope < 1e-4)
    load = F.exp(F.when(flat, -1.467 + 1.582 * F.cos(la)).otherwise(sloping))
    return F.when(lat.isNotNull() & slope.isNotNull(), F.least(F.lit(1.5), F.greatest(F.lit(0.05), load)))


#: Slope in percent that the words of a map unit stand for, the first that fits.
SLOPE_WORDS = (
    (35.0, "very steep"), (18.0, "hilly|steep"), (12.0, "dissected|rolling"), (4.0, "undulating|gently sloping"),
    (1.0, "nearly level|level|muck|flooded|lake plain"), (6.0, "rock outcrop|flatrock|glade"),
)


def slope_midpoint(text: Column) -> Column:
    """The slope of a map unit in percent: the middle of 'x to y percent slopes', else what its words stand for."""
    span = r"([0-9]+)\s*to\s*([0-9]+)\s*percent\s*slope"
    low = F.lower(text)
    out = F.when(low.rlike(span), (F.regexp_extract(low, span, 1).cast("double") + F.regexp_extract(low, span, 2).cast("double")) / 2)
    for slope, words in SLOPE_WORDS:
        out = out.when(low.rlike(words), slope)
    return out


def keyword_class(text: Column, classes: list[tuple[str, str]], default: str | None = None) -> Column:
    """The first class whose pattern the text has."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in classes:
        out = out.when(F.lower(text).rlike(pattern), name)
    return out.otherwise(F.lit(default))


def depth_weighted(value: Column, top: Column, bottom: Column, upper: float, lower: float) -> tuple[Column, Column]:
    """(numerator, weight) aggregates of a layer's overlap with a depth interval: divide their sums."""
    overlap = F.greatest(F.lit(0.0), F.least(bottom, F.lit(lower)) - F.greatest(top, F.lit(upper)))
    ok = value.isNotNull() & (overlap > 0)
    return F.sum(F.when(ok, value * overlap)), F.sum(F.when(ok, overlap))
