"""Cohorts: weights, caps, groups and indices of sets of sheets and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def pool_cap(rows: DataFrame, by: str, weight: str, trusted: Column, second: Column, promoted: Column, share: float = 0.4, least: int = 5) -> DataFrame:
    """``rows`` with ``capped_weight`` and ``capped``. In a group with ``least`` trusted rows or more, the rows of second
    trust together weigh at most share / (1 − share) of the trusted ones; where that scales them down, promoted rows
    weigh at most 0.85 of the smallest of them. Null weights count as nothing and stay null; rows without a group stay
    as they are. One window over partial sums a group."""
    w, here = F.col(weight), Window.partitionBy(by)
    is_ = lambda c: F.coalesce(c, F.lit(False))
    second_only = is_(second) & ~is_(trusted)
    sums = rows.groupBy(by).agg(
        F.count_if(is_(trusted)).alias("__n"), F.sum(F.when(is_(trusted), w)).alias("__t"), F.sum(F.when(second_only, w)).alias("__s"), F.min(F.when(second_only, w)).alias("__m")
    ).filter(F.col(by).isNotNull())
    most = share / (1 - share) * F.col("__t")
    over = (F.col("__n") >= least) & (most > 0) & (F.col("__s") > most + 1e-12)
    joined = rows.join(sums.withColumns({"__f": F.when(over, most / F.col("__s"))}), by, "left")
    scaled = F.when(F.col("__f").isNotNull() & second_only, w * F.col("__f")).otherwise(w)
    low = 0.85 * F.col("__m") * F.col("__f")
    capped = F.col("__f").isNotNull() & (second_only | is_(promoted))
    out = F.when(F.col("__f").isNotNull() & is_(promoted), F.least(scaled, low)).otherwise(scaled)
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], out.alias("capped_weight"), capped.cast("int").alias("capped"))


def habitat_indices(rows: DataFrame, depth: str, buffer_depth: str, outcrop_pct: str, outcrop: str, warm: str, dry_month: str, dry_quarter: str, seasonality: str, coldest: str, diurnal: str, least: int = 3) -> DataFrame:
    """``rows`` with lithic_index, moisture_deficit and maritime_index (four places); an index is null in all rows unless
    ``least`` rows have one and they differ. Missing columns of a formula make it null, or use what it has:

    lithic: shallowness ((150 − depth) / 135, within 0 and 1, to the power 1.35; the smaller of point and buffer depth)
    against outcrop (percent / 35); deficit: warm-season demand over dry-month supply; maritime: mild winters over
    seasonality and diurnal range (seasonality in hundredths where its median is above 50)."""
    c = F.col
    unit = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    depth_ = F.least(c(depth), c(buffer_depth))
    shallow = F.coalesce(F.pow(unit((150.0 - depth_) / 135.0), F.lit(1.35)), F.lit(0.0))
    rock = F.coalesce(unit(c(outcrop_pct) / 35.0), F.lit(0.0))
    flag = F.coalesce(c(outcrop).cast("int"), F.lit(0)).cast("double")
    lithic = F.when(depth_.isNotNull() | c(outcrop_pct).isNotNull(), F.least(F.lit(1.0), F.greatest(shallow, 0.75 * rock + 0.25 * shallow, 0.65 * flag + 0.35 * shallow)))
    dry = F.coalesce(c(dry_quarter) / 3.0, c(dry_month))
    deficit = F.greatest(F.lit(4.0), 2.5 * F.greatest(F.lit(0.0), c(warm))) / F.greatest(dry + 10.0, F.lit(5.0))
    deficit = F.when(c(warm).isNotNull() & dry.isNotNull(), deficit)
    both = c(seasonality).isNotNull() & c(coldest).isNotNull()
    scale = rows.agg(F.median(F.when(both, F.abs(c(seasonality)))).alias("__season"))
    season = F.when(c("__season") > 50, c(seasonality) / 100.0).otherwise(c(seasonality))
    range_ = F.when(c(diurnal).isNotNull(), F.greatest(F.lit(4.0), c(diurnal)) / 12.0).otherwise(1.0)
    maritime = F.when(both, (c(coldest) + 20.0) / F.greatest(season * range_, F.lit(1.0)))
    names = {"lithic_index": lithic, "moisture_deficit": deficit, "maritime_index": maritime}
    made = rows.crossJoin(F.broadcast(scale)).withColumns({n: F.round(x, 4) for n, x in names.items()}).drop("__season")  # one row
    spread = made.agg(*[((F.count(n) >= least) & (F.stddev(n) > 1e-6)).alias(f"__{n}") for n in names])
    guarded = made.crossJoin(F.broadcast(spread))  # one row
    return guarded.withColumns({n: F.when(c(f"__{n}"), c(n)) for n in names}).drop(*[f"__{n}" for n in names])


def joint_affinity(pairs: DataFrame, shape: str, ground: str, season: str, weights: tuple[float, float, float] = (0.75, 1.0, 1.0)) -> DataFrame:
    """a, b, affinity of pairs of groups: the weighted mean of shape, ground and season affinities, the latter two
    weighing in proportion to the root of the shape's, so that groups unlike in shape are not joined by their ground.
    A missing one doesn't count; six places."""
    unit = lambda n: F.when(F.col(n).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(n))))
    gate, (w1, w2, w3) = F.sqrt(unit(shape)), weights
    part = lambda n, w: F.coalesce(gate * w * unit(n), F.lit(0.0))
    size = lambda n, w: F.when(F.col(n).isNotNull(), gate * w).otherwise(0.0)
    joint = (w1 * unit(shape) + part(ground, w2) + part(season, w3)) / (w1 + size(ground, w2) + size(season, w3))
    return pairs.select("a", "b", F.round(joint, 6).alias("affinity"))


def nearest_groups(pairs: DataFrame, k: int = 2) -> DataFrame:
    """group, rank, neighbour, affinity: the ``k`` most alike other groups of each; the smaller of equals."""
    both = pairs.select(F.col("a").alias("group"), F.col("b").alias("neighbour"), "affinity").unionByName(pairs.select(F.col("b").alias("group"), F.col("a").alias("neighbour"), "affinity"))
    order = Window.partitionBy("group").orderBy(F.desc("affinity"), "neighbour")
    return both.filter("affinity IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("group", "rank", "neighbour", "affinity")


def supported_labels(rows: DataFrame, parts: list[str], least: int = 5, out: str = "label") -> DataFrame:
    """``rows`` whose combination of ``parts`` (joined by ' | ') has ``least`` rows or more, with it as ``out``. The counts
    are aggregated before the join."""
    label = F.concat_ws(" | ", *[F.col(p).cast("string") for p in parts])
    named = rows.withColumn(out, label).dropna(subset=parts)
    counts = named.groupBy(out).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).drop("__n")
    return named.join(counts, out, "left_semi")


def clade_discordance(samples: DataFrame, sample: str, clade: str, taxon: str) -> DataFrame:
    """``sample``, ``clade``, ``taxon``, majority, discordant: 1 where the clade's most frequent taxon (the smaller of
    equals) is another and more frequent there than the sample's own."""
    known = samples.filter(F.col(clade).isNotNull() & F.col(taxon).isNotNull())
    counts = known.groupBy(clade, taxon).agg(F.count("*").alias("__n"))
    top = counts.groupBy(clade).agg(F.min(F.struct((-F.col("__n")).alias("m"), F.col(taxon).alias("t"))).alias("__b"))
    joined = samples.select(sample, clade, taxon).join(counts, [clade, taxon], "left").join(top, clade, "left")
    other = (F.col("__b.t") != F.col(taxon)) & (F.col("__n") < -F.col("__b.m"))
    return joined.select(sample, clade, taxon, F.col("__b.t").alias("majority"), F.coalesce(other, F.lit(False)).cast("int").alias("discordant"))


def locus_names(locus: Column) -> Column:
    """The names a locus may be listed under, as written first: without what follows ':' or '.', or '_pos…'."""
    text = F.trim(locus)
    shorter = [F.split_part(text, F.lit(":"), F.lit(1)), F.split_part(text, F.lit("."), F.lit(1)), F.regexp_replace(text, r"(?i)_pos(?:[\d_:-].*)?$", ""), F.regexp_replace(text, r"(?i)(?::|_pos|\.).*$", "")]
    return F.filter(F.array_distinct(F.array(text, *shorter)), lambda x: x != "")


def locus_lookup(loci: DataFrame, locus: str, catalogue: DataFrame, name: str, values: list[str]) -> DataFrame:
    """``locus`` and the catalogue's ``values`` of the first of its names that is listed, as written or in lower case."""
    tried = loci.select(locus).distinct().select(locus, F.posexplode(locus_names(F.col(locus))).alias("at", "__n"))
    tried = tried.select(locus, (F.col("at") * 2).alias("at"), "__n").unionByName(tried.select(locus, (F.col("at") * 2 + 1).alias("at"), F.lower("__n").alias("__n")))
    listed = catalogue.groupBy(F.col(name).alias("__n")).agg(*[F.min(v).alias(v) for v in values])
    best = tried.join(listed, "__n").groupBy(locus).agg(F.min_by(F.struct(*values), "at").alias("b"))
    return loci.select(locus).distinct().join(best, locus, "left").select(locus, F.col("b").isNotNull().cast("int").alias("listed"), *[F.col(f"b.{v}").alias(v) for v in values])


def covered_view(view: DataFrame, cohort: DataFrame, key: str, least: float = 0.95) -> tuple[DataFrame, float, bool]:
    """(the view's rows of the cohort, the share of the cohort it covers, whether that is enough). Null keys and repeated
    keys of the cohort count for nothing and once; an empty cohort is not covered."""
    wanted = cohort.select(key).filter(F.col(key).isNotNull()).distinct()
    found, size = wanted.join(view.select(key), key, "left_semi").count(), wanted.count()
    share = found / size if size else 0.0
    return view.join(wanted, key, "left_semi"), share, bool(size) and share >= least
