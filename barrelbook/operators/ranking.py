"""Ranks that stay distributed, and how ranks moved between two windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from .joins import lookup_exactly_one

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def top_k_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per group with their rank 1..k.

    The rank filter turns into a partial group limit, so a map task forwards at most
    ``k`` rows per group whatever the size of the group.
    """
    window = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window))
    return ranked.filter(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))


def global_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Position 1..n of every row under a total ``order``, without a single-task sort.

    Rows are range-partitioned and sorted, the result is checkpointed so that partition
    contents are fixed, and each partition adds the sizes of the ones before it. The
    offset table holds one row per partition, which bounds its broadcast.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    tagged = placed.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", _ROW_BITS).alias("_part")
    sizes = tagged.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    local = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local + 1)
        .select(*df.columns, name)
    )


def rank_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """Unique rank 1..n in every group, for groups of any size.

    Rows are range-partitioned and sorted by (group, order) and checkpointed. Ranks are counted
    inside each partition's part of a group, so no task sees more of a group than a partition
    holds. What earlier partitions hold of a group is added: in a range-partitioned table only
    the first group of a partition has begun before it, which bounds the broadcast to one row
    per partition. ``order`` must be total within the group.
    """
    if not by:
        return global_position(df, order, name)
    total = [*[F.col(c).asc() for c in by], *order]
    placed = checkpointed(df.repartitionByRange(*total).sortWithinPartitions(*total))
    tagged = placed.withColumn("_id", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    sizes = tagged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    begun = sizes.select(
        F.col("_part").alias("_in"),
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
        F.sum("_size").over(earlier).alias("_earlier"),
    ).filter("_earlier > 0")
    same = F.col("_part") == F.col("_in")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    here = tagged.withColumn("_nth", F.row_number().over(W.partitionBy("_part", *by).orderBy("_id")))
    rank = F.col("_nth") + F.coalesce("_earlier", F.lit(0).cast("bigint"))
    return here.join(F.broadcast(begun), same, "left").withColumn(name, rank).select(*df.columns, name)


def with_previous_rank(now: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the current window with the rank their key had in the window before.

    A key with no row before, or with several, has no previous rank.
    """
    ranks = before.select(*keys, F.col("rank").alias("previous_rank"))
    return lookup_exactly_one(now, ranks, keys, ["previous_rank"])


def rank_change(previous: Column, current: Column) -> Column:
    """``↑ +2``, ``↓ -2`` or ``–`` (no move, or no previous rank)."""
    moved = previous - current
    return (
        F.when(moved > 0, F.concat(F.lit("↑ +"), moved.cast("string")))
        .when(moved < 0, F.concat(F.lit("↓ "), moved.cast("string")))
        .otherwise(F.lit("–"))
    )


def trophy(rank: Column) -> Column:
    """Rank as text, with a trophy on the first three."""
    text = rank.cast("string")
    return F.when(rank <= 3, F.concat(F.lit("🏆 "), text)).otherwise(text)


def number_rows_after(
    stored: DataFrame, batch: DataFrame, order: Sequence[Column], column: str = "row_idx"
) -> DataFrame:
    """Give the rows of ``batch`` the ids that follow the highest stored one."""
    last = stored.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint"))
    numbered = global_position(batch, order, "_position")
    return numbered.withColumn(column, last.scalar() + F.col("_position")).select(column, *batch.columns)
