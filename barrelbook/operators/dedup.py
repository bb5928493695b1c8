"""Row selection per key. Hot keys never travel whole: each map task forwards at
most one row (``row_number() <= 1`` becomes a partial group limit) or one partial
aggregate per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _orderable(kind: T.DataType) -> bool:
    """Whether values of a type can be sorted: maps cannot, nor what contains them."""
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column] = ()) -> DataFrame:
    """One row per key: the first under ``order_by``, then under the other columns.

    A distributed table has no file order, so the order is always explicit. The
    remaining columns, maps apart, break ties, which makes the choice independent of
    partitioning.
    """
    known = {*keys, *[c for c in order_by if isinstance(c, str)]}
    rest = [F.col(f.name) for f in df.schema.fields if f.name not in known and _orderable(f.dataType)]
    order = [F.col(c) if isinstance(c, str) else c for c in order_by] + rest
    if not order:
        return df.dropDuplicates(list(keys))
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter(F.col("_nth") == 1).drop("_nth")


def latest_by_key(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key: the highest version (what a replacing table would keep)."""
    return keep_first(df, keys, [F.col(version).desc_nulls_last()])


def drop_repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose key occurs once; every row of a repeated key goes.

    An aggregation instead of a window: a key repeated many times shrinks to one
    partial row per map task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.first(F.struct(*rest) if rest else F.lit(None)).alias("_row"),
    )
    once = grouped.filter(F.col("_rows") == 1)
    return once.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])
