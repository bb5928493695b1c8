"""Sinks and stored results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a Parquet table."""
    df.write.mode("append").parquet(path)


#: Values are written as they are: quotes doubled as the readers expect, blanks kept.
CSV = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def overwrite_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Replace a CSV folder. Blanks, quotes, empty texts and NULL come back as they were; line
    breaks do with ``read_csv(multiline=True)``."""
    df.write.mode("overwrite").options(header=header, **CSV).csv(path)


def export_table(spark: SparkSession, table: str, path: str, reader: Callable[..., DataFrame]) -> DataFrame:
    """Write a whole table as CSV with the columns it has now; returns what was written."""
    current = reader(spark, table)
    overwrite_csv(current.select(*current.columns), path)
    return current


def overwrite_by(df: DataFrame, path: str, columns: Sequence[str], format: str = "parquet") -> None:
    """Replace a table stored in one folder per value of ``columns``.

    Rebalancing packs small values into few files and splits a value that dominates, so
    no task writes a hot value alone.
    """
    writer = df.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns)
    if format == "csv":
        writer = writer.options(header=True, **CSV)
    writer.format(format).save(path)


def ensure_table(spark: SparkSession, name: str, ddl: str, location: str | None = None) -> None:
    """Create a Parquet table unless it exists."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{place}")


def stored_or_computed(
    requested: Mapping[str, object],
    stored_for: Mapping[str, object],
    stored: Callable[[], DataFrame],
    compute: Callable[..., DataFrame],
) -> DataFrame:
    """The stored result if it was made with the requested parameters, else a fresh one."""
    return stored() if dict(requested) == dict(stored_for) else compute(**requested)
