"""Results that readers see as one whole version, and results found again by what they were made from.

Each version is a folder of its own. A row of the log, written last, makes it the current one, so a
reader finds the version before or the new one, never a mixture, also when a refresh fails half-way.
The log is a small Parquet table: it works in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .readers import read_table

LOG_SCHEMA = "version bigint, folder string, names array<string>, kept boolean, facts string"
RESULT_SCHEMA = "made timestamp, parameters string, inputs string, folder string"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _append(spark: SparkSession, path: str, schema: str, *values) -> None:
    spark.createDataFrame([values], schema).coalesce(1).write.mode("append").parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The versions that are kept: version, folder, names, facts. One row per publication."""
    log = _rows(spark, f"{root}/log", LOG_SCHEMA)
    gone = log.filter(~F.col("kept")).select("version")
    return log.filter("kept").join(gone, "version", "left_anti").drop("kept")


def current_version(spark: SparkSession, root: str) -> Row | None:
    """The newest version, or None."""
    return versions(spark, root).orderBy(F.col("version").desc(), F.col("folder").desc()).first()


def publish(
    spark: SparkSession,
    root: str,
    results: Mapping[str, DataFrame | Callable[[str], None]],
    facts: Mapping[str, object] | None = None,
    keep: int = 2,
) -> dict[str, str]:
    """Write all results, then make them the current version; returns their paths by name.

    A result is a frame, or a function that writes to the path it is given. ``facts`` are stored
    with the version. Of older versions the newest ``keep - 1`` stay, so a reader that has just looked
    up its version can finish; what a failed refresh left is never seen. One publisher at a time.
    """
    stored = sorted(versions(spark, root).collect(), key=lambda v: v.version)
    number = stored[-1].version + 1 if stored else 1
    folder = f"version={number}-{uuid.uuid4().hex}"
    paths = {name: f"{root}/{folder}/{name}" for name in results}
    for name, result in results.items():
        if callable(result):
            result(paths[name])
        else:
            result.write.parquet(paths[name])
    known = json.dumps(dict(facts or {}), sort_keys=True, default=str)
    _append(spark, f"{root}/log", LOG_SCHEMA, number, folder, list(results), True, known)
    for old in stored[: max(0, len(stored) + 1 - keep)]:
        _append(spark, f"{root}/log", LOG_SCHEMA, old.version, old.folder, old.names, False, old.facts)
        remove_folder(spark, f"{root}/{old.folder}")
    return paths


def read_published(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """A result of the current version."""
    version = current_version(spark, root)
    if version is None or name not in version.names:
        raise LookupError(f"no published {name} in {root}")
    return read_table(spark, f"{root}/{version.folder}/{name}", schema)


# Results by what they were made from ----------------------------------------------------------


def input_version(*tables: DataFrame) -> str:
    """A digest of the files that the tables read: names, sizes and times of change.

    The tables must be plain scans. Only file metadata is read; the digest is summed in the tasks.
    """
    parts = []
    for table in tables:
        name, size, changed = (F.col(f"_metadata.{x}") for x in ("file_path", "file_size", "file_modification_time"))
        files = table.select(F.xxhash64(name, size, F.unix_micros(changed)).alias("file")).distinct()
        count, total = files.agg(F.count("*"), F.sum(F.col("file").cast("decimal(38,0)"))).first()
        parts.append(f"{count}:{total}")
    return ";".join(parts)


def result_for(
    spark: SparkSession,
    root: str,
    parameters: Mapping[str, object],
    inputs: str,
    compute: Callable[..., DataFrame],
) -> tuple[DataFrame, str]:
    """The result of ``compute(**parameters)``, read back if it was stored for these inputs.

    Returns the frame and ``hit``, ``stale`` (stored, but the inputs have changed) or ``miss``. What was
    not a hit is computed and stored; the newest result of a parameter set counts.
    """
    asked = json.dumps(dict(parameters), sort_keys=True, default=str)
    catalogue = _rows(spark, f"{root}/catalogue", RESULT_SCHEMA).filter(F.col("parameters") == asked)
    newest = catalogue.orderBy(F.col("made").desc(), F.col("folder").desc()).first()
    if newest is not None and newest.inputs == inputs:
        return read_table(spark, f"{root}/{newest.folder}"), "hit"
    folder = f"result-{uuid.uuid4().hex}"
    compute(**parameters).write.parquet(f"{root}/{folder}")
    made = spark.range(1).select(
        F.current_timestamp().alias("made"), F.lit(asked).alias("parameters"), F.lit(inputs).alias("inputs"), F.lit(folder).alias("folder")
    )
    made.coalesce(1).write.mode("append").parquet(f"{root}/catalogue")
    return read_table(spark, f"{root}/{folder}"), "miss" if newest is None else "stale"
