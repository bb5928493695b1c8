"""Known keys in buckets, and memories that end."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barrelbook.session import scratch_path
from barrelbook.streaming import ingest
from barrelbook.streaming.known_keys import KnownKeys, key_text

DDL = "id bigint, kind string, at timestamp_ntz"
START = datetime(2021, 1, 18)


def rows(spark, data):
    return spark.createDataFrame(data, DDL)


def ids(frame):
    return sorted(map(str, (tuple(r) for r in frame.select("id", "kind").collect())))


def known(spark, buckets=16, moment=None):
    return KnownKeys(scratch_path(spark, "known"), ["id", "kind"], buckets, moment)


def test_key_texts_differ_where_keys_do(spark):
    keys = [("a", "b"), ("a:", "b"), ("a1:", ""), ("a", "1:b"), (None, "b"), ("-", "b"), ("b", None), (None, None), ("", "")]
    frame = spark.createDataFrame(keys, "x string, y string")
    assert frame.select(key_text(["x", "y"])).distinct().count() == len(keys)


def test_a_batch_sees_other_batches_but_not_itself(spark):
    store = known(spark)
    store.add(rows(spark, [(1, "a", None), (None, "b", None)]), "feed", 0)
    batch = rows(spark, [(1, "a", None), (1, "b", None), (None, "b", None), (None, None, None)])
    assert ids(store.unknown(batch, "feed", 1)) == ["(1, 'b')", "(None, None)"]
    assert ids(store.unknown(batch, "other", 0)) == ["(1, 'b')", "(None, None)"]
    assert len(ids(store.unknown(batch, "feed", 0))) == 4  # the same batch again
    store.add(rows(spark, [(1, "b", None)]), "feed", 1)
    store.add(rows(spark, [(1, "b", None)]), "feed", 1)
    store.compact(spark)
    assert ids(store.unknown(batch, "feed", 2)) == ["(None, None)"]
    assert ids(store.unknown(batch, "feed", 1)) == ["(1, 'b')", "(None, None)"]
    assert store.table(spark).count() == 3


def test_a_batch_reads_its_own_buckets_and_shuffles_itself_alone(spark):
    store = known(spark, 64)
    store.add(rows(spark, [(i, "x", None) for i in range(5000)]), "feed", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.unknown(rows(spark, [(7, "x", None), (9000, "x", None)]), "feed", 1)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ids(found) == ["(9000, 'x')"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    selected = re.search(r"SelectedBucketsCount: (\d+) out of 64", plan)
    assert selected and int(selected[1]) <= 2
    assert plan.count("Exchange") == 1  # of the batch


def events(spark, folder, order):
    """10,000 events over 20 files, one batch each."""
    for part in order:
        data = [(i, "x", START + timedelta(minutes=i)) for i in range(500 * part, 500 * part + 500)]
        rows(spark, data).union(rows(spark, data[:100])).coalesce(1).write.mode("append").parquet(folder)
    return ingest.read_feed(spark, folder, DDL, "parquet", maxFilesPerTrigger="1")


def test_nothing_is_lost_newest_first(spark):
    source, target, checkpoint = (scratch_path(spark, x) for x in ("source", "target", "checkpoint"))
    feed, store = events(spark, source, reversed(range(20))), known(spark, 4, "at")
    ingest.store_bounded_rows(feed, target, checkpoint, store, timedelta(hours=2), compact_every=4).awaitTermination()
    stored = ingest.known_rows(spark, target, DDL)
    assert stored.count() == 10_000 and stored.select("id").distinct().count() == 10_000


def test_the_memory_keeps_its_size(spark):
    source, target, checkpoint = (scratch_path(spark, x) for x in ("source", "target", "checkpoint"))
    store, sizes = known(spark, 4, "at"), []
    add = store.add

    def counted(*args):
        add(*args)
        sizes.append(store.table(spark).count())

    store.add = counted
    feed = events(spark, source, range(20))
    ingest.store_bounded_rows(feed, target, checkpoint, store, timedelta(hours=2), compact_every=2).awaitTermination()
    assert ingest.known_rows(spark, target, DDL).count() == 10_000
    assert len(sizes) == 20 and max(sizes) == max(sizes[:6]) and sizes[-4:-2] == sizes[-2:]


def test_late_repeats_are_dropped_and_late_rows_stored(spark):
    source, target, checkpoint = (scratch_path(spark, x) for x in ("source", "target", "checkpoint"))
    at = lambda hours: START + timedelta(hours=hours)
    batches = [
        [(1, "a", at(0)), (None, "a", at(0)), (9, "n", None)],
        [(2, "a", at(50))],
        [(1, "a", at(0.5)), (3, "a", at(0)), (None, "a", at(0)), (4, "a", at(50)), (9, "n", None)],
        [(3, "a", at(0.1)), (2, "a", at(49.8)), (5, None, at(100))],
        [(5, None, at(99.5)), (6, None, at(1))],
    ]
    for batch in batches:
        rows(spark, batch).coalesce(1).write.mode("append").parquet(source)
    feed = ingest.read_feed(spark, source, DDL, "parquet", maxFilesPerTrigger="1")
    store = known(spark, 4, "at")
    ingest.store_bounded_rows(feed, target, checkpoint, store, timedelta(hours=1), compact_every=1).awaitTermination()
    stored = ids(ingest.known_rows(spark, target, DDL))
    assert stored == sorted(map(str, [(1, "a"), (None, "a"), (9, "n"), (2, "a"), (3, "a"), (4, "a"), (5, None), (6, None)]))


def test_a_failed_batch_is_repeated(spark):
    """The keys of a batch are added after its rows; a failure between loses and doubles nothing."""
    source, target, checkpoint = (scratch_path(spark, x) for x in ("source", "target", "checkpoint"))
    for part in ([(1, "a", None), (2, "a", None)], [(2, "a", None), (3, "a", None)]):
        rows(spark, part).coalesce(1).write.mode("append").parquet(source)
    store = known(spark, 4)
    add, failed = store.add, []

    def failing(*args):
        if len(failed) == 1:
            failed.append(1)
            raise RuntimeError("lost")
        failed.append(1)
        add(*args)

    store.add = failing
    read = lambda: ingest.read_feed(spark, source, DDL, "parquet", maxFilesPerTrigger="1")
    try:
        ingest.store_new_rows(read(), target, checkpoint, store.keys, known=store).awaitTermination()
        raise AssertionError("the second batch should have failed")
    except Exception as error:  # noqa: BLE001
        assert "lost" in str(error)
    ingest.store_new_rows(read(), target, checkpoint, store.keys, known=store).awaitTermination()
    assert ids(ingest.known_rows(spark, target, DDL)) == ["(1, 'a')", "(2, 'a')", "(3, 'a')"]
    assert store.table(spark).filter(F.col("key") == "1:31:a").count() == 1
