"""Ingestion: every key once, replays add nothing, batches equal one batch."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from barrelbook.operators import new_rows
from barrelbook.session import scratch_path
from barrelbook.streaming import ingest

DDL = "id bigint, query string, at timestamp_ntz, note string"


def write_feed(folder, files):
    """Files in the order of their names: streams take the oldest first."""
    folder.mkdir(exist_ok=True)
    for name, records in files.items():
        (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))
        age = 1_600_000_000 + 60 * int(name.split(".")[0])
        os.utime(folder / name, (age, age))


def record(i, query="q", minute=0, note="x"):
    return {"id": i, "query": query, "at": f"2021-01-18T10:{minute:02d}:00", "note": note}


FILES = {
    "1.json": [record(1), record(2), record(1, note="a")],
    "2.json": [record(2), record(3), record(1, query="other")],
    "3.json": [record(i, minute=1) for i in range(1, 6)],
}
KEYS = ["id", "query"]


def feed(spark, folder):
    return ingest.read_feed(spark, str(folder), DDL, maxFilesPerTrigger="1")


def store(spark, folder, target, checkpoint):
    ingest.store_new_rows(feed(spark, folder), target, checkpoint, KEYS, ["at"]).awaitTermination()
    return ingest.known_rows(spark, target, DDL)


def test_batches_equal_one_batch(spark, tmp_path):
    target, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "checkpoint")
    write_feed(tmp_path / "in", FILES)
    stored = store(spark, tmp_path / "in", target, checkpoint)
    batch = spark.read.schema(DDL).json(str(tmp_path / "in"))
    once = new_rows(batch, batch.limit(0), KEYS, ["at"])
    key = lambda df: sorted(tuple(r) for r in df.select(*KEYS).collect())
    assert key(stored) == key(once) == sorted([(i, "q") for i in range(1, 6)] + [(1, "other")])
    assert stored.select("batch_id").distinct().count() == 3


def test_resumed_and_replayed_feeds_add_nothing(spark, tmp_path):
    target = scratch_path(spark, "target")
    first, second = scratch_path(spark, "checkpoint"), scratch_path(spark, "checkpoint")
    write_feed(tmp_path / "in", FILES)
    before = sorted(map(tuple, store(spark, tmp_path / "in", target, first).collect()))
    assert sorted(map(tuple, store(spark, tmp_path / "in", target, first).collect())) == before
    # A lost checkpoint replays every batch under its old number: same rows again.
    assert sorted(map(tuple, store(spark, tmp_path / "in", target, second).collect())) == before


def test_new_files_are_picked_up(spark, tmp_path):
    target, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "checkpoint")
    write_feed(tmp_path / "in", {"1.json": FILES["1.json"]})
    assert store(spark, tmp_path / "in", target, checkpoint).count() == 2
    write_feed(tmp_path / "in", FILES)
    assert store(spark, tmp_path / "in", target, checkpoint).count() == 6


def test_transform_before_storing(spark, tmp_path):
    target, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "checkpoint")
    write_feed(tmp_path / "in", FILES)
    keep = lambda df: df.filter("id <> 2").select("id", "query", F.upper("note").alias("note"))
    run = ingest.store_new_rows(
        feed(spark, tmp_path / "in"), target, checkpoint, KEYS, ["note"], keep, "id bigint, query string, note string"
    )
    run.awaitTermination()
    got = ingest.known_rows(spark, target, "id bigint, query string, note string").drop("batch_id")
    assert sorted(map(tuple, got.collect())) == [(1, "other", "X"), (1, "q", "A"), (3, "q", "X"), (4, "q", "X"), (5, "q", "X")]


@pytest.mark.parametrize("salts", [1, 3])
def test_remembered_keys(spark, tmp_path, salts):
    target, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "checkpoint")
    write_feed(tmp_path / "in", FILES)

    def run():
        keyed = ingest.remember_keys(feed(spark, tmp_path / "in").select(*KEYS), KEYS, salts)
        ingest.append_stream(keyed, target, checkpoint).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(target).collect()))

    expected = sorted([(i, "q") for i in range(1, 6)] + [(1, "other")])
    assert run() == expected
    write_feed(tmp_path / "in", {"4.json": [record(2), record(6), record(6)]})
    assert run() == sorted([*expected, (6, "q")])


def test_late_rows_are_stored(spark, tmp_path):
    """Within the delay a repeat is dropped; a row that arrives late is compared and stored."""
    target, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "checkpoint")
    write_feed(
        tmp_path / "in",
        {
            "1.json": [record(1), record(1, minute=3)],
            "2.json": [record(2, minute=50)],
            "3.json": [record(2, minute=51), record(2, minute=59)],
            "4.json": [record(9, minute=1), record(1, minute=2)],
        },
    )
    recent = feed(spark, tmp_path / "in")
    ingest.store_recent_rows(recent, target, checkpoint, ["id"], "at", "10 minutes").awaitTermination()
    assert sorted(r.id for r in ingest.known_rows(spark, target, DDL).collect()) == [1, 2, 9]


def test_two_feeds_into_one_target(spark, tmp_path):
    """Another feed with a checkpoint of its own adds to the target and overwrites nothing."""
    target = scratch_path(spark, "target")
    write_feed(tmp_path / "one", {"1.json": [record(1), record(2)]})
    write_feed(tmp_path / "two", {"1.json": [record(2), record(3)]})
    store(spark, tmp_path / "one", target, scratch_path(spark, "checkpoint"))
    stored = store(spark, tmp_path / "two", target, scratch_path(spark, "checkpoint"))
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3]


def test_null_keys_are_stored_once(spark):
    stored = spark.createDataFrame([(None, "q")], "id bigint, query string")
    batch = spark.createDataFrame([(None, "q"), (None, "r"), (1, "q")], "id bigint, query string")
    assert sorted(map(str, new_rows(batch, stored, KEYS).collect())) == ["Row(id=1, query='q')", "Row(id=None, query='r')"]


def test_read_errors_are_raised(spark, tmp_path):
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="parquet|Parquet|PARQUET"):
        ingest.known_rows(spark, str(tmp_path / "target"), DDL).collect()
    with pytest.raises(Exception):  # noqa: B017
        ingest.known_rows(spark, str(tmp_path / "absent"), "id wrong type")
