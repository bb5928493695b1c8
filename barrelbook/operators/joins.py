"""Lookups and membership joins.

No side is broadcast by hint: Spark's own size estimate and the adaptive runtime statistics
decide, so a dimension that grows past the threshold turns into a shuffled join with skew
splitting.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import keep_first


def any_left_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    order_by: Sequence[str | Column] = (),
    defaults: Mapping[str, object] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Left join that keeps at most one right row per key, so the left row count holds.

    ``order_by`` picks the right row (then its remaining columns do). ``unique=True``
    skips the reduction when the key is known to be unique. Unmatched right columns
    are NULL unless ``defaults`` names a value.
    """
    keys = [on] if isinstance(on, str) else list(on)
    single = right if unique else keep_first(right, keys, order_by)
    joined = left.join(single, keys, "left")
    return _with_defaults(joined, defaults)


def dict_lookup(
    df: DataFrame,
    dictionary: DataFrame,
    key: str | Sequence[str],
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Attach the attributes of a key/value dictionary, with defaults for absent keys."""
    return any_left_join(df, dictionary, key, defaults=defaults, unique=True)


def lookup_exactly_one(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    values: Sequence[str],
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Attach ``values`` where the key has exactly one right row; zero or several
    matches give the default."""
    keys = [on] if isinstance(on, str) else list(on)
    single = (
        right.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_matches"), *[F.first(v).alias(v) for v in values])
        .filter(F.col("_matches") == 1)
        .drop("_matches")
    )
    return _with_defaults(left.join(single, keys, "left"), defaults)


def semi_join(df: DataFrame, members: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is among ``members``; NULL keys never match.

    The members are made distinct first: a member repeated many times shrinks before the
    shuffle, and the join reuses the partitioning of that aggregation.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(members.select(*keys).distinct(), keys, "left_semi")


def new_rows(
    batch: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column] = (),
) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet, each key once.

    Both sides are reduced to single keys before they meet, so no key is hot in the join;
    only the key columns of ``stored`` are read. NULL is a key like any other.
    """
    return anti_join(keep_first(batch, list(keys), order_by), stored, keys)


def anti_join(df: DataFrame, members: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not among ``members``; NULL keys match NULL keys."""
    keys = [on] if isinstance(on, str) else list(on)
    known = members.select(*[F.col(k).alias(f"_known_{i}") for i, k in enumerate(keys)]).distinct()
    same = [df[k].eqNullSafe(known[f"_known_{i}"]) for i, k in enumerate(keys)]
    return df.join(known, functools.reduce(lambda a, b: a & b, same), "left_anti")


def alias_names(df: DataFrame, column: str, aliases: Mapping[str, str]) -> DataFrame:
    """Replace alternative spellings by their common name; other values stay."""
    return df.replace(dict(aliases), subset=[column]) if aliases else df


def _with_defaults(df: DataFrame, defaults: Mapping[str, object] | None) -> DataFrame:
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return df
