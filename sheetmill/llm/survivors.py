"""Best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Tiers from most to least trusted; anything else counts as blank.
TIERS = ("gold", "silver", "bronze")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def tier_rank(tier: Column) -> Column:
    """0 gold, 1 silver, 2 bronze, 3 blank or unknown, however the tier is spelled."""
    text = F.lower(tier)
    out = F.when(F.lit(False), 0)
    for i, name in enumerate(TIERS):
        out = out.when(text.contains(name), i)
    return out.otherwise(3)


def gathering_key(key: Column) -> Column:
    """collector_number_date in one spelling: trimmed lower case without accents, '_' between the parts, date
    as YYYY-MM-DD, number without leading zeros, '#' or 'no.'. Null for a blank key."""
    text = F.regexp_replace(F.lower(F.trim(key)), r"\s*[|;_]\s*", "_")
    text = F.translate(text, "áàâäãåéèêëíìîïóòôöõøúùûüñçý", "aaaaaaeeeeiiiioooooouuuuncy")
    # one pattern after the other, each run once a row: pad the date's parts, take padding that was too much off again
    text = F.regexp_replace(text, r"_(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "_$1-0$2-0$3")
    text = F.regexp_replace(text, r"_(\d{4})-0?(\d{2})-0?(\d{2})$", "_$1-$2-$3")
    text = F.regexp_replace(text, r"_(?:#|no\.? ?|nr\.? ?)?0*(\d+[a-z]?)_(?=\d{4}-)", "_$1_")
    # most keys are written so already, which one pattern tells; the others' patterns stand here once, so they run once
    done = key.rlike(r"^[a-z]+_[1-9][0-9]*[a-z]?_[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(done, key).when(F.trim(key) != "", text)


def surviving_records(
    rows: DataFrame, group: Column, record: str, trust: Column, completeness: tuple[str, ...], recency: str, out_first: str, out_survivor: str
) -> DataFrame:
    """One row for each group with at least two different ``record`` values: the smallest of them (``out_first``) and
    that of the group's best row (``out_survivor``).

    Rows rank by ``trust`` (smaller first), then the number of filled columns among ``completeness`` (a column is
    filled unless null or only spaces), then the latest ``recency`` (null last), then the smallest ``record``
    (null last). Rows with a null group belong to none; repeated rows change nothing; an empty table gives none.

    The window keeps the first row a group, which Spark applies within each partition before the shuffle, and the
    census of a group is a partial aggregate: a group holding a third of all rows leaves one row a partition.
    """
    filled = sum((F.when(~blank(F.col(c)), 1).otherwise(0) for c in completeness), F.lit(0))
    ranked = rows.select(group.alias("__group"), F.col(record).alias("__record"), trust.alias("__trust"), filled.alias("__filled"), F.col(recency).alias("__recency")).filter(F.col("__group").isNotNull())
    order = [F.col("__trust").asc_nulls_last(), F.col("__filled").desc(), F.col("__recency").desc_nulls_last(), F.col("__record").asc_nulls_last()]
    best = ranked.withColumn("__rn", F.row_number().over(Window.partitionBy("__group").orderBy(*order))).filter(F.col("__rn") == 1)
    census = ranked.groupBy("__group").agg(F.min("__record").alias(out_first), F.max("__record").alias("__last")).filter(F.col(out_first) != F.col("__last"))
    return census.join(best.select("__group", F.col("__record").alias(out_survivor)), "__group").select(out_first, out_survivor)
