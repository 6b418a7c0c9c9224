"""Duplicate groups over sheets: fingerprint, proximity and alias passes, then one primary and the conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S
from .components import connected_components
from .inference import planar_clusters
from .proximity import near_pairs


def group_sheets(sheets: DataFrame, metres: float = 50.0) -> DataFrame:
    """``sheets`` with ``dup_group``: the fingerprint where the sheet has a number and a date; else sheets of one known
    day, at most ``metres`` apart and of compatible collectors, chained, under their smallest catalogue number.

    ``sheets``: catalogNumber (unique), collector, number, day (as scalar.first_collector, record_number and event_day
    give them), lat, lon. 'unknown' collectors fit any, so chains close what pairs alone leave open.
    """
    numbered = (F.col("number") != "") & (F.col("collector") != "unknown") & ~F.col("day").endswith("-00") & (F.col("day") != "unknown_date")
    rows = sheets.withColumn("__key", F.when(numbered, F.concat_ws("_", "collector", "number", "day")))
    open_rows = rows.filter(F.col("__key").isNull() & (F.col("number") == "") & (F.col("day") != "unknown_date") & ~F.col("day").endswith("-00"))
    pairs = near_pairs(open_rows, "catalogNumber", "lat", "lon", metres, ("collector", "day"))
    fits = (F.col("collector_a") == F.col("collector_b")) | (F.col("collector_a") == "unknown") | (F.col("collector_b") == "unknown")
    chains = connected_components(pairs.filter((F.col("day_a") == F.col("day_b")) & fits), "catalogNumber_a", "catalogNumber_b")
    out = rows.join(chains.select(F.col("node").alias("catalogNumber"), "component"), "catalogNumber", "left")
    return out.withColumn("dup_group", F.coalesce("__key", F.concat(F.lit("near "), "component"), F.concat(F.lit("one "), "catalogNumber"))).drop("__key", "component")


def merge_aliases(edges: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """``groups`` with ``group`` replaced by the smallest of the groups that ``edges`` (a, b) chain to it."""
    merged = connected_components(edges, "a", "b").select(F.col("node").alias(group), "component")
    return groups.join(merged, group, "left").withColumn(group, F.coalesce("component", group)).drop("component")


def primary_and_conflicts(rows: DataFrame, group: str, rank: list[Column], taxon: str, gold: Column, extralimital: Column, unique: str) -> DataFrame:
    """unique, group, duplicate_count, is_primary, conflict, gold_taxon.

    The primary has the largest ``rank`` (compared in order, then the larger ``unique``). Where a group names two or
    more taxa: with one gold taxon, the sheets that disagree with it conflict; with one in-range taxon, the
    extralimital sheets that disagree; else all. Single sheets are primary and never conflict. Three aggregates of
    bounded states: no group is gathered.
    """
    r = rows.select(F.col(unique).alias("u"), F.col(group).alias("g"), F.struct(*rank, F.col(unique)).alias("r"), F.nullif(F.col(taxon), F.lit("")).alias("t"), F.coalesce(gold, F.lit(False)).alias("gold"), F.coalesce(extralimital, F.lit(False)).alias("x"))
    near, far = F.when(~F.col("x"), F.col("t")), F.when(F.col("gold"), F.col("t"))
    near_gold = F.when(F.col("gold") & ~F.col("x"), F.col("t"))
    per = r.groupBy("g").agg(
        F.count("*").alias("n"), F.max("r").alias("top"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min(near).alias("i0"), F.max(near).alias("i1"),
        F.min(far).alias("g0"), F.max(far).alias("g1"), F.min(near_gold).alias("h0"), F.max(near_gold).alias("h1"),
    )
    lo, hi = F.coalesce("h0", "g0"), F.when(F.col("h0").isNotNull(), F.col("h1")).otherwise(F.col("g1"))
    j = r.join(per.withColumn("gold_taxon", F.when(lo == hi, lo)), "g")
    split = F.coalesce(F.col("t0") != F.col("t1"), F.lit(False)) & (F.col("n") > 1)
    conflict = F.when(~split, False).when(F.col("gold_taxon").isNotNull(), F.coalesce(F.col("t") != F.col("gold_taxon"), F.lit(False))).when(F.col("i0") == F.col("i1"), F.col("x") & F.coalesce(F.col("t") != F.col("i0"), F.lit(False))).otherwise(True)
    return j.select(F.col("u").alias(unique), F.col("g").alias(group), F.col("n").alias("duplicate_count"), (F.col("r") == F.col("top")).cast("int").alias("is_primary"), conflict.cast("int").alias("conflict"), "gold_taxon")


def sheet_fingerprints(vouchers: DataFrame) -> DataFrame:
    """What group_sheets needs, from raw vouchers: one row a catalogue number, the latest delivery."""
    latest = vouchers.filter("catalogNumber IS NOT NULL").groupBy("catalogNumber").agg(F.max_by(F.struct("recordedBy", "recordNumber", "eventDate", "year", "month", "day", "decimalLatitude", "decimalLongitude", "species_raw", "type_status", "determiner_tier", "institutionCode", "image_path"), F.struct("updated_at", "voucher_id")).alias("v"))
    v = latest.select("catalogNumber", "v.*")
    return v.select("catalogNumber", S.first_collector(F.col("recordedBy")).alias("collector"), S.record_number(F.col("recordNumber")).alias("number"), S.event_day(F.col("eventDate"), F.col("year"), F.col("month"), F.col("day")).alias("day"), F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lon"), "species_raw", "type_status", "determiner_tier", "institutionCode", "image_path")


def merge_split_plants(plants: DataFrame, leaves: DataFrame, sheet: str, plant: str, leaf: str, x: str, y: str, measures: tuple[str, ...], reach: Column) -> DataFrame:
    """``leaves`` with ``merged_plant`` and ``merged_leaf``: plants of a sheet whose crowns chain within ``reach`` are one
    falsely split plant, whose leaves move to the one with most leaves (the smaller of equals) and are numbered on
    behind its own, so that no number occurs twice.

    Stubs, plants without leaves and without any of ``measures`` on a sheet where another plant has leaves, join
    nothing. Plants without coordinates stay alone; leaves of unknown plants keep theirs; leaves without a sheet or
    plant stay without. Repeated plants count once."""
    key, counts = [sheet, plant], leaves.dropna(subset=[sheet, plant]).groupBy(sheet, plant).agg(F.count("*").alias("__n"))
    empty = F.lit(True)
    for m in measures:
        empty = empty & F.col(m).isNull()
    known = plants.dropna(subset=key).join(counts, key, "left")
    stubs = known.filter(F.col("__n").isNull() & empty).select(*key).join(counts.select(sheet), sheet, "left_semi")
    kept = plants.dropna(subset=key).join(stubs, key, "left_anti")
    groups = planar_clusters(kept, sheet, plant, x, y, reach).select(sheet, plant, "cluster").distinct().join(counts, key, "left")
    best = Window.partitionBy(sheet, "cluster").orderBy(F.coalesce("__n", F.lit(0)).desc(), plant)
    hubs = groups.select(sheet, plant, F.first(plant).over(best).alias("__hub"))
    moved = leaves.join(hubs, key, "left").withColumn("merged_plant", F.coalesce("__hub", plant))
    order = Window.partitionBy(sheet, "merged_plant").orderBy((F.col("merged_plant") != F.col(plant)).cast("int"), plant, leaf, *[c for c in leaves.columns if c not in (sheet, plant, leaf)])
    number = F.when(F.col(sheet).isNotNull() & F.col(plant).isNotNull(), F.row_number().over(order))
    return moved.select(*leaves.columns, "merged_plant", number.alias("merged_leaf"))
