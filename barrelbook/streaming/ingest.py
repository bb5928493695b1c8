"""Feeds that store every key once.

Ways to remember what is known, by how large that is:

- ``store_new_rows``: the target table itself is the memory, read key columns only.
  Works for any batch history; each batch reads all stored keys. With ``known`` it reads
  the buckets of its own keys instead (see ``known_keys``).
- ``store_recent_rows``: the same, but a batch reads only the stored keys around its own
  moments. Rows may arrive in any order and as late as they like; none is lost.
- ``store_bounded_rows``: the keys of the last while, forgotten by event time, so that what is
  remembered keeps its size; later rows are checked against the target around their moments.
- ``remember_keys``: the keys live in the state store, spread over the executors by key,
  so a batch costs what the batch holds. For targets too large to re-read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import keep_first
from ..operators.joins import anti_join, new_rows
from .known_keys import BATCH, FEED, KnownKeys

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_feed(spark: SparkSession, path: str, schema: str, format: str = "json", **options: str) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def known_rows(
    spark: SparkSession, target: str, schema: str, feed: str | None = None, before: int | None = None
) -> DataFrame:
    """What the target holds; of ``feed`` optionally only batches before ``before``. A target
    that does not exist yet is empty; any other error is raised."""
    whole = f"{schema}, {FEED} string, {BATCH} bigint"
    try:
        stored = spark.read.schema(whole).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], whole)
    if feed is not None:
        stored = stored.filter((F.col(FEED) != feed) | (F.col(BATCH) < before))
    return stored.drop(FEED)


def _feed_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave this checkpoint; another checkpoint has another one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def store_new_rows(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    order_by: Sequence[str | Column] = (),
    transform: Callable[[DataFrame], DataFrame] | None = None,
    schema: str | None = None,
    known: KnownKeys | None = None,
    compact_every: int = 64,
) -> StreamingQuery:
    """Append the rows whose key the target lacks; run until the feed is read up.

    Each batch of each feed has a folder of its own and compares with all others but the later
    ones of its feed. So a batch that is repeated after a failure overwrites itself with the same
    rows, and a new checkpoint or another feed overwrites nothing. One writer at a time.

    ``known`` must hold the keys of the target; both are empty at first, or ``known`` was filled with
    ``add``. Its files are merged every ``compact_every`` batches.
    """
    if known is not None:

        def fresh(rows: DataFrame, feed: str, batch_id: int) -> DataFrame:
            if batch_id and batch_id % compact_every == 0:
                known.compact(rows.sparkSession)
            return known.unknown(rows, feed, batch_id)

        return _store_with(stream, target, checkpoint, order_by, transform, fresh, known)
    return _store(stream, target, checkpoint, keys, order_by, transform, schema, lambda rows, known: known)


def store_recent_rows(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    moment: str,
    delay: str,
    order_by: Sequence[str | Column] = (),
    transform: Callable[[DataFrame], DataFrame] | None = None,
    schema: str | None = None,
) -> StreamingQuery:
    """Like ``store_new_rows`` for keys that repeat within ``delay`` of ``moment``.

    A batch compares with the stored rows between its first moment less the delay and its last
    moment plus the delay, which Parquet statistics prune. A row that arrives late is compared
    with the rows around it, and stored.
    """

    def around(rows: DataFrame, known: DataFrame) -> DataFrame:
        first, last = rows.agg(F.min(moment), F.max(moment)).first()
        span, at = F.expr(f"INTERVAL {delay}"), F.col(moment)
        near = at.isNull()
        if first is not None:
            near = near | at.between(F.lit(first) - span, F.lit(last) + span)
        return known.filter(near)

    return _store(stream, target, checkpoint, keys, order_by, transform, schema, around)


def store_bounded_rows(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    known: KnownKeys,
    delay: timedelta,
    order_by: Sequence[str | Column] = (),
    transform: Callable[[DataFrame], DataFrame] | None = None,
    schema: str | None = None,
    compact_every: int = 8,
) -> StreamingQuery:
    """Like ``store_recent_rows`` for keys that repeat within ``delay``, with a memory that ends.

    ``known`` remembers keys by their moment. Every ``compact_every`` batches those two delays older
    than the newest are forgotten, so the memory holds what arrives within that time. A row whose
    moment lies a delay after what was forgotten is checked against the memory alone; an older one,
    however late, against the stored rows a delay around the moments of such rows, which Parquet
    statistics prune. Rows without a moment are remembered for good.
    """
    keys, moment = known.keys, F.col(known.moment)
    ddl = schema or _ddl(stream)

    def fresh(rows: DataFrame, feed: str, batch_id: int) -> DataFrame:
        session = rows.sparkSession
        if batch_id and batch_id % compact_every == 0:
            newest = known.table(session).agg(F.max("moment")).first()[0]
            known.compact(session, None if newest is None else newest - 2 * delay)
        forgotten = known.forgotten(session)
        if forgotten is None:
            return known.unknown(rows, feed, batch_id)
        oldest = F.lit(forgotten + delay).cast("timestamp_ntz")
        late = rows.filter(moment < oldest)
        in_time = rows.filter(moment.isNull() | (moment >= oldest))
        first, last = late.agg(F.min(moment), F.max(moment)).first()
        if first is not None:
            near = moment.between(F.lit(first - delay), F.lit(last + delay))
            stored = known_rows(session, target, ddl, feed, batch_id).filter(near)
            late = anti_join(late, stored, keys)
        return known.unknown(in_time, feed, batch_id).unionByName(late)

    return _store_with(stream, target, checkpoint, order_by, transform, fresh, known)


def _ddl(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)


def _store_with(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    order_by: Sequence[str | Column],
    transform: Callable[[DataFrame], DataFrame] | None,
    fresh: Callable[[DataFrame, str, int], DataFrame],
    known: KnownKeys,
) -> StreamingQuery:
    """``fresh`` gets each key of a batch once. Rows are stored first, then their keys: a batch that
    fails between is repeated and sees neither."""

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        feed = _feed_id(session, checkpoint)
        place = f"{target}/{FEED}={feed}/{BATCH}={batch_id}"
        rows = keep_first(transform(batch) if transform else batch, known.keys, order_by).persist()
        fresh(rows, feed, batch_id).write.mode("overwrite").parquet(place)
        rows.unpersist()
        known.add(session.read.parquet(place), feed, batch_id)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _store(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    transform: Callable[[DataFrame], DataFrame] | None,
    schema: str | None,
    relevant: Callable[[DataFrame, DataFrame], DataFrame],
) -> StreamingQuery:
    ddl = schema or _ddl(stream)

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        feed = _feed_id(session, checkpoint)
        rows = transform(batch) if transform else batch
        known = relevant(rows, known_rows(session, target, ddl, feed, batch_id))
        fresh = new_rows(rows, known, keys, order_by)
        fresh.write.mode("overwrite").parquet(f"{target}/{FEED}={feed}/{BATCH}={batch_id}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def remember_keys(stream: DataFrame, keys: Sequence[str], salts: int = 16) -> DataFrame:
    """Each key once, with all keys seen kept in the state store.

    A first check per (key, salt) spreads the rows of a hot key over ``salts`` tasks; the
    final check per key sees at most one row of each. With one salt there is only the
    final check, and half the state.
    """
    keys = list(keys)
    if salts > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(salts))
        stream = stream.withColumn("_salt", salt).dropDuplicates([*keys, "_salt"]).drop("_salt")
    return stream.dropDuplicates(keys)


def append_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files, each row exactly once; run until the feed is read up."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state on local disk with changelog checkpoints in the shared folder,
    instead of on the heap; recommended for large key sets."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
