"""Sets of rating levels as bit masks: distinct values merged by OR and counted by bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels in one mask; a signed 64-bit integer keeps its sign bit clear.
WIDTH = 63
#: Levels beyond this are kept as values of their own.
HIGHEST = 1 << 30


def level_masks(facts: DataFrame, keys: Sequence[str], value: str, step: float) -> DataFrame:
    """``keys, _word, _value, _mask``: the distinct values per key, ``WIDTH`` levels a mask.

    A value that is a multiple of ``step`` is a bit; any other makes a row of its own, so the sets
    are exact for every value. A map task sends one row per key and word at most, whatever
    the number of facts and levels. NULL values leave an empty mask.
    """
    level = F.col(value) / step
    on_grid = (level >= 0) & (level < HIGHEST) & (F.floor(level) == level)
    whole = F.when(on_grid, level.cast("bigint"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(whole, F.lit(WIDTH)).cast("int"))
    marked = facts.select(
        *keys,
        F.floor(whole / WIDTH).alias("_word"),
        F.when(whole.isNull(), F.col(value)).alias("_value"),
        F.coalesce(bit, F.lit(0).cast("bigint")).alias("_mask"),
    )
    return marked.groupBy(*keys, "_word", "_value").agg(F.bit_or("_mask").alias("_mask"))


def mask_count() -> Column:
    """Number of distinct values in a row of ``level_masks``."""
    return F.bit_count("_mask").cast("bigint") + F.col("_value").isNotNull().cast("bigint")


def mask_sum(step: float) -> Column:
    """Sum of the distinct values in a row of ``level_masks``; NULL without any.

    The sum of the places of the set bits is taken digit by digit: the count of bits at places whose
    ``j``-th binary digit is 1, times two to the ``j``.
    """
    places = F.lit(0).cast("bigint")
    for digit in range(WIDTH.bit_length()):
        chosen = sum(1 << place for place in range(WIDTH) if place >> digit & 1)
        places += F.bit_count(F.col("_mask").bitwiseAND(F.lit(chosen).cast("bigint"))) * (1 << digit)
    levels = F.col("_word") * WIDTH * F.bit_count("_mask") + places
    return F.when(F.col("_value").isNotNull(), F.col("_value")).when(F.col("_mask") != 0, levels * F.lit(float(step)))
