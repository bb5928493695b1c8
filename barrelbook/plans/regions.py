"""Regional mean rating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..operators.joins import any_left_join
from ..operators.levels import level_masks, mask_count, mask_sum


#: Ratings are given in quarters of a point.
RATING_STEP = 0.25


def region_rating(
    reviews: DataFrame, venues: DataFrame, drop_unmatched: bool = False, step: float = RATING_STEP
) -> DataFrame:
    """Mean of the distinct (beer, venue, rating) triples per region, by region id.

    The ratings of a (beer, venue) are bits of a mask, in steps of ``step``, merged by OR in the map
    tasks; other values are kept as they are. The region depends on the venue alone, so masks are
    counted and summed per venue before the venue table is joined: the join sees one row per
    venue. Check-ins without a known venue form a row with a NULL region.
    """
    masks = level_masks(reviews, ["beer_id", "venue_id"], "rating_score", step)
    by_venue = masks.groupBy("venue_id").agg(F.sum(mask_sum(step)).alias("_total"), F.sum(mask_count()).alias("_count"))
    placed = any_left_join(by_venue, venues.select("venue_id", "region_id", "region_name"), "venue_id")
    if drop_unmatched:
        placed = placed.filter(F.col("region_id").isNotNull())
    totals = placed.groupBy("region_id", "region_name").agg(
        F.sum("_total").alias("_total"), F.sum("_count").alias("_count")
    )
    return totals.select(
        "region_id", "region_name", ratio(F.col("_total"), F.col("_count")).alias("beer_pure_avg")
    ).orderBy("region_id")
