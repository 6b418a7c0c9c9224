"""The wide analytical read: a cohort with its entity, parts, best sample and counts, built lazily.

Only the requested columns are projected; left joins to sides with one row a key that no requested column comes from
are not added, so a narrow request stays a narrow plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import ranked_pick

COLUMNS = {
    "voucher": ("species_raw", "stateProvince", "county", "decimalLatitude", "decimalLongitude", "determiner_tier", "type_status"),
    "individual": ("plant_height_mm", "petiole_to_blade_ratio", "is_bent_stem"),
    "leaves": ("n_leaves", "median_solidity", "median_area_px"),
    "genotype": ("genetic_sample_id", "geno_predicted_taxon", "geno_posterior_prob", "n_samples_linked"),
}


def best_sample_order() -> list[Column]:
    """Ranking of a sheet's genotypes: passing quality, most reads, highest posterior, smallest id; nulls last."""
    return [
        (F.coalesce("missing_genotype_rate", F.lit(1.0)) <= 0.3).desc(), F.coalesce("mapped_reads", F.lit(0)).desc(), F.coalesce("geno_posterior_prob", F.lit(-1.0)).desc(),
        F.col("genetic_sample_id").asc(), F.col("assignment_id").asc(),
    ]


def master_view(cohort: DataFrame, vouchers: DataFrame, individuals: DataFrame, leaves: DataFrame, samples: DataFrame, assignments: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a cohort row (catalogNumber, plant_individual_id), whatever the other tables hold.

    Of repeated deliveries of a sheet the latest counts; individuals fall back to part 0 where a part has no row; the
    genotype is the best one linked to the sheet, with how many are linked.
    """
    wanted = set(columns if columns is not None else [c for group in COLUMNS.values() for c in group])
    out = cohort.select("catalogNumber", "plant_individual_id").distinct()
    use = {k: [c for c in v if c in wanted] for k, v in COLUMNS.items()}
    if use["voucher"]:
        latest = vouchers.filter("catalogNumber IS NOT NULL").groupBy("catalogNumber").agg(F.max_by(F.struct(*use["voucher"]), F.struct("updated_at", "voucher_id")).alias("v"))
        out = out.join(latest.select("catalogNumber", "v.*"), "catalogNumber", "left")
    if use["individual"]:
        fields = F.struct(*use["individual"])
        exact = individuals.select("catalogNumber", "plant_individual_id", fields.alias("i"))
        sheet = individuals.filter("plant_individual_id = 0").select("catalogNumber", fields.alias("i0"))
        out = out.join(exact, ["catalogNumber", "plant_individual_id"], "left").join(sheet, "catalogNumber", "left")
        out = out.withColumn("i", F.when(F.col("i").isNotNull(), F.col("i")).otherwise(F.col("i0"))).select(*[c for c in out.columns if c not in ("i", "i0")], *[F.col(f"i.{c}").alias(c) for c in use["individual"]])
    if use["leaves"]:
        per = leaves.dropDuplicates(["catalogNumber", "plant_individual_id", "leaf_id"]).groupBy("catalogNumber", "plant_individual_id").agg(F.count("*").alias("n_leaves"), F.median("solidity").alias("median_solidity"), F.median("area_px").alias("median_area_px"))
        out = out.join(per.select("catalogNumber", "plant_individual_id", *use["leaves"]), ["catalogNumber", "plant_individual_id"], "left")
    if use["genotype"]:
        linked = assignments.join(samples.filter("catalogNumber IS NOT NULL").dropDuplicates(["genetic_sample_id"]).select("genetic_sample_id", "catalogNumber", "mapped_reads", "missing_genotype_rate"), "genetic_sample_id")
        best = ranked_pick(linked, ["catalogNumber"], best_sample_order(), "n_samples_linked")
        out = out.join(best.select("catalogNumber", *use["genotype"]), "catalogNumber", "left")
    return out
