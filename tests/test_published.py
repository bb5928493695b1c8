"""Versions that readers see whole, and results found by what they were made from."""

from __future__ import annotations

import os

import pytest

from barrelbook.session import scratch_path
from barrelbook.sources import published


def numbers(spark, n):
    return spark.range(n).toDF("x")


def test_readers_see_one_whole_version(spark):
    root = scratch_path(spark, "results")
    with pytest.raises(LookupError):
        published.read_published(spark, root, "a")
    published.publish(spark, root, {"a": numbers(spark, 1), "b": numbers(spark, 1)}, {"day": "2021-01-18"})
    seen = []

    def while_writing(path):
        """The other result is written by now; readers still find the version before."""
        seen.extend(published.read_published(spark, root, name).count() for name in ("a", "b"))
        numbers(spark, 2).write.parquet(path)

    published.publish(spark, root, {"a": numbers(spark, 2), "b": while_writing})
    assert seen == [1, 1]
    assert [published.read_published(spark, root, name).count() for name in ("a", "b")] == [2, 2]


def test_a_refresh_that_fails_changes_nothing(spark):
    root = scratch_path(spark, "results")
    published.publish(spark, root, {"a": numbers(spark, 1), "b": numbers(spark, 1)})

    def fail(path):
        raise RuntimeError("half-way")

    with pytest.raises(RuntimeError):
        published.publish(spark, root, {"a": numbers(spark, 2), "b": fail})
    assert [published.read_published(spark, root, name).count() for name in ("a", "b")] == [1, 1]
    published.publish(spark, root, {"a": numbers(spark, 3), "b": numbers(spark, 3)})
    assert [published.read_published(spark, root, name).count() for name in ("a", "b")] == [3, 3]


def test_older_versions_go_and_readers_of_the_last_can_finish(spark):
    root = scratch_path(spark, "results")
    for n in range(1, 5):
        opened = published.read_published(spark, root, "a") if n > 1 else None
        published.publish(spark, root, {"a": numbers(spark, n)}, keep=2)
        if opened is not None:
            assert opened.count() == n - 1
    kept = sorted(r.version for r in published.versions(spark, root).collect())
    assert kept == [3, 4]
    assert sum(name.startswith("version=") for name in os.listdir(root.removeprefix("file:"))) == 2


def test_hit_miss_and_stale(spark):
    root, source = scratch_path(spark, "results"), scratch_path(spark, "input")
    numbers(spark, 5).write.parquet(source)
    calls = []

    def compute(least):
        calls.append(least)
        return spark.read.parquet(source).filter(f"x >= {least}")

    def ask(least):
        found, status = published.result_for(
            spark, root, {"least": least}, published.input_version(spark.read.parquet(source)), compute
        )
        return found.count(), status

    assert [ask(2), ask(2), ask(3), ask(2)] == [(3, "miss"), (3, "hit"), (2, "miss"), (3, "hit")]
    numbers(spark, 10).write.mode("append").parquet(source)
    assert [ask(2), ask(2), ask(3)] == [(11, "stale"), (11, "hit"), (9, "stale")]
    assert calls == [2, 3, 2, 3]
