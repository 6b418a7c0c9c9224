"""Coordinate hygiene, range status and residency: row gates that need a neighbour table or group counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .proximity import haversine_m


def near_reference(points: DataFrame, references: DataFrame, point_id: str, lat: str, lon: str, ref_lat: str, ref_lon: str, name: str, metres: float) -> DataFrame:
    """(``point_id``, name, metres): the nearest reference point within ``metres`` (the smaller name of equals).
    References are filed in every cell they reach, so the points are joined once by cell and not listed again."""
    step = max(metres / 111_000 * 1.01, 1e-6)
    ry, rx = F.floor(F.col(ref_lat) / step), F.floor(F.col(ref_lon) / step)
    wide = F.ceil(1 / F.greatest(F.cos(F.radians(F.least(F.abs(F.col(ref_lat)) + step, F.lit(89.9)))), F.lit(1e-3)))
    refs = references.filter(F.col(ref_lat).isNotNull() & F.col(ref_lon).isNotNull()).select(F.col(ref_lat).alias("__rl"), F.col(ref_lon).alias("__ro"), F.col(name).alias("__name"), F.explode(F.sequence(ry - 1, ry + 1)).alias("__y"), F.sequence(rx - wide, rx + wide).alias("__xs"))
    refs = refs.withColumn("__x", F.explode("__xs")).drop("__xs")
    spots = points.select(F.col(point_id), F.col(lat).alias("__l"), F.col(lon).alias("__o"), F.floor(F.col(lat) / step).alias("__y"), F.floor(F.col(lon) / step).alias("__x"))
    d = haversine_m(F.col("__l"), F.col("__o"), F.col("__rl"), F.col("__ro"))
    met = spots.join(refs, ["__y", "__x"]).withColumn("__d", d).filter(F.col("__d") <= metres)
    return met.groupBy(point_id).agg(F.min(F.struct("__d", "__name")).alias("b")).select(point_id, F.col("b.__name").alias(name), F.col("b.__d").alias("metres"))


def rounded_to(c: Column, decimals: int) -> Column:
    """Whether a coordinate is written with at most so many decimals."""
    s = c * 10.0**decimals
    return F.abs(s - F.round(s)) < 1e-6


def only_words(text: Column, *allowed: Column) -> Column:
    """Whether every alphabetic word of ``text`` is among the words of the other columns; false for a text without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    known = F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(F.lower(a), F.lit("([a-z]+)"), F.lit(1)), F.array().cast("array<string>")) for a in allowed]))
    return F.coalesce((F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(known, w)), F.lit(False))


def range_status(rows: DataFrame, ranges: DataFrame, neighbours: DataFrame, taxon: str, state: str, county: str) -> DataFrame:
    """``rows`` with ``range_status``, first that holds: 'unknown' without a place or a taxon with ranges, 'state_only'
    where the state is documented without counties, 'in_range' in a documented county, 'adjacent' next to one,
    'state' in a state with other counties, else 'out'.

    ``ranges``: taxon, state, county ('' for the state alone); ``neighbours``: state, county, other_state, other_county.
    """
    documented = ranges.select(F.col("taxon").alias(taxon), F.col("state").alias(state), F.col("county").alias(county)).filter(F.col(county) != "").distinct()
    near = documented.join(neighbours.select(F.col("state").alias(state), F.col("county").alias(county), "other_state", "other_county"), [state, county]).select(taxon, F.col("other_state").alias(state), F.col("other_county").alias(county)).distinct()
    per_state = ranges.groupBy(F.col("taxon").alias(taxon), F.col("state").alias(state)).agg(F.max((F.col("county") != "").cast("int")).alias("__counties"))
    known = ranges.select(F.col("taxon").alias(taxon)).distinct().withColumn("__known", F.lit(True))
    out = rows.join(documented.withColumn("__in", F.lit(True)), [taxon, state, county], "left").join(near.withColumn("__near", F.lit(True)), [taxon, state, county], "left")
    out = out.join(per_state, [taxon, state], "left").join(known, taxon, "left")
    status = (
        F.when(F.col(state).isNull() | F.col("__known").isNull(), "unknown").when(F.col("__counties") == 0, "state_only").when(F.col("__in"), "in_range").when(F.col("__near"), "adjacent")
        .when(F.col("__counties").isNotNull(), "state").otherwise("out")
    )
    return out.withColumn("range_status", status).drop("__in", "__near", "__counties", "__known")


def resident_taxa(rows: DataFrame, taxon: str, inside: Column, least: int = 10, share: float = 0.05, small: int = 50) -> DataFrame:
    """taxon, n, n_inside of taxa with enough rows inside: at least ``least`` (in groups below ``small`` rows only the
    smaller of 3 and n) and at least ``share`` of all."""
    g = rows.filter(F.col(taxon).isNotNull()).groupBy(taxon).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))
    need = F.when(F.col("n") < small, F.least(F.lit(3), F.col("n"))).otherwise(least)
    return g.filter((F.col("n_inside") >= need) & (F.col("n_inside") >= share * F.col("n")))


def adjacent_regions(rings: DataFrame, state: str, county: str, lat: str, lon: str) -> DataFrame:
    """state, county, other_state, other_county of regions that share an outline vertex (five decimals)."""
    corner = rings.select(F.col(state).alias("state"), F.col(county).alias("county"), F.explode(F.arrays_zip(F.col(lat).alias("y"), F.col(lon).alias("x"))).alias("p"))
    corner = corner.select("state", "county", F.round("p.y", 5).alias("y"), F.round("p.x", 5).alias("x")).distinct()
    a, b = corner.alias("a"), corner.alias("b")
    same = (F.col("a.state") == F.col("b.state")) & (F.col("a.county") == F.col("b.county"))
    met = a.join(b, (F.col("a.y") == F.col("b.y")) & (F.col("a.x") == F.col("b.x")) & ~same)
    return met.select(F.col("a.state").alias("state"), F.col("a.county").alias("county"), F.col("b.state").alias("other_state"), F.col("b.county").alias("other_county")).distinct()
