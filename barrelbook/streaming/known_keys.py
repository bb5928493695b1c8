"""The keys that a target holds, in buckets: a batch reads the buckets of its own keys only.

A key is one text over its columns. Its hash picks a slot, and the table of known keys is bucketed by
slot: a filter on the slots of a batch prunes the other buckets' files, and the join with a batch
shuffles the batch alone. Keys may be forgotten by event time; the table then has a constant size,
and rows older than what it remembers are checked against the target itself.

Versions of the table are published (see ``sources.published``), so that compaction never disturbs a
reader. Batches append to the current version under their feed and number; a repeated batch does
not see its own keys.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.published import current_version, publish

FEED, BATCH = "feed", "batch_id"
SCHEMA = f"slot int, key string, moment timestamp_ntz, {FEED} string, {BATCH} bigint"


def key_text(keys: Sequence[str]) -> Column:
    """One text per key, different for different keys; NULL is a value like any other."""
    parts = []
    for name in keys:
        value = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


class KnownKeys:
    """Known keys below ``path``, in ``buckets`` buckets. One writer at a time.

    ``moment`` names the event time by which keys can be forgotten.
    """

    def __init__(self, path: str, keys: Sequence[str], buckets: int = 256, moment: str | None = None):
        self.path, self.keys, self.buckets, self.moment = path, list(keys), buckets, moment

    def _table(self, spark: SparkSession) -> tuple[str, dict]:
        """Name of the current version's table, and what was forgotten in it."""
        version = current_version(spark, self.path)
        if version is None:
            publish(spark, self.path, {"keys": lambda path: self._write(spark, spark.createDataFrame([], SCHEMA), path)})
            version = current_version(spark, self.path)
        return self._declared(spark, f"{self.path}/{version.folder}/keys"), json.loads(version.facts)

    def _declared(self, spark: SparkSession, path: str) -> str:
        """An entry of the session's catalog for a folder; dropping it leaves the files."""
        name = "known_keys_" + hashlib.sha256(path.encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (slot) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        return name

    def _write(self, spark: SparkSession, rows: DataFrame, path: str) -> None:
        name = self._declared(spark, path)
        rows.select("slot", "key", "moment", FEED, BATCH).repartition(self.buckets, "slot").write.insertInto(name)

    def _slotted(self, rows: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        return rows.withColumn("key", key_text(self.keys)).withColumn("slot", slot)

    def table(self, spark: SparkSession) -> DataFrame:
        """All remembered keys."""
        return spark.table(self._table(spark)[0])

    def forgotten(self, spark: SparkSession) -> datetime | None:
        """The moment before which keys have been forgotten."""
        before = self._table(spark)[1].get("before")
        return None if before is None else datetime.fromisoformat(before)

    def unknown(self, rows: DataFrame, feed: str, batch_id: int) -> DataFrame:
        """The rows whose key was not known before this batch. ``rows`` has each key once.

        The slots of the batch are listed, at most one per bucket. Joining by slot and key on a
        table bucketed by slot asks Spark to accept a part of the join's columns as partitioning.
        """
        spark = rows.sparkSession
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        names = {"key": "__key", "slot": "__slot"}
        ours = self._slotted(rows.select(*[F.col(c) for c in self.keys])).distinct()
        slots = [row.slot for row in ours.select("slot").distinct().collect()]
        known = self.table(spark).filter(F.col("slot").isin(slots))
        known = known.filter(~F.col(FEED).eqNullSafe(F.lit(feed)) | (F.col(BATCH) < batch_id))
        known = known.select(*[F.col(c).alias(n) for c, n in names.items()])
        slot = F.pmod(F.xxhash64("__key"), F.lit(self.buckets)).cast("int")
        asked = rows.withColumn("__key", key_text(self.keys)).withColumn("__slot", slot)
        return asked.join(known, list(names.values()), "left_anti").drop(*names.values())

    def add(self, rows: DataFrame, feed: str | None, batch_id: int) -> None:
        """Remember the keys of a batch. Remembering them twice changes nothing."""
        spark = rows.sparkSession
        moment = F.col(self.moment).cast("timestamp_ntz") if self.moment else F.lit(None).cast("timestamp_ntz")
        own = rows.select(*self.keys, moment.alias("moment"))
        own = self._slotted(own).select("slot", "key", "moment", F.lit(feed).alias(FEED), F.lit(batch_id).cast("long").alias(BATCH))
        name = self._table(spark)[0]
        own.repartition(self.buckets, "slot").write.insertInto(name)

    def compact(self, spark: SparkSession, before: datetime | None = None) -> None:
        """A new version with each key once, without those whose last moment lies before ``before``.

        Keys without a moment stay. Folders of older versions are removed after the next compaction.
        """
        name, facts = self._table(spark)
        known = spark.table(name).groupBy("slot", "key").agg(
            F.max("moment").alias("moment"), F.min(F.struct(F.col(FEED).alias("f"), F.col(BATCH).alias("b"))).alias("first")
        )
        known = known.select("slot", "key", "moment", F.col("first.f").alias(FEED), F.col("first.b").alias(BATCH))
        since = [datetime.fromisoformat(facts["before"])] if facts.get("before") else []
        since = max([*since, before] if before else since, default=None)
        if since is not None:
            known = known.filter(F.col("moment").isNull() | (F.col("moment") >= F.lit(since).cast("timestamp_ntz")))
        kept = {"before": since.isoformat()} if since is not None else {}
        publish(spark, self.path, {"keys": lambda path: self._write(spark, known, path)}, kept)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
