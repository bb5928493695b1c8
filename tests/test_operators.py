"""Contracts of the reusable steps."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barrelbook import operators as ops


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, v string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, 20, "late"), (1, 10, "early"), (2, 5, "only"), (None, 1, "null")], "k int, at int, w string")


def test_any_left_join_keeps_the_left_rows(left, right):
    joined = ops.any_left_join(left, right, "k", ["at"], {"w": ""})
    assert rows(joined.select("v", "w")) == [("a", "early"), ("b", "early"), ("c", "only"), ("d", ""), ("e", "")]


def test_any_left_join_order_is_the_callers(left, right):
    joined = ops.any_left_join(left, right, "k", [F.col("at").desc()])
    assert rows(joined.select("v", "w").filter("k = 1")) == [("a", "late"), ("b", "late")]


def test_lookup_exactly_one(left, right):
    found = ops.lookup_exactly_one(left, right, "k", ["w"], {"w": "–"})
    assert rows(found.select("v", "w")) == [("a", "–"), ("b", "–"), ("c", "only"), ("d", "–"), ("e", "–")]


def test_semi_join_does_not_multiply(left, right):
    assert rows(ops.semi_join(left, right, "k")) == [(1, "a"), (1, "b"), (2, "c")]


def test_new_rows(left, right):
    assert rows(ops.new_rows(left, right, ["k"], ["v"])) == [(3, "d")]  # NULL is stored
    assert rows(ops.new_rows(left, right.limit(0), ["k"], [F.col("v").desc()]))[0] == (1, "b")


def test_alias_names(left):
    assert rows(ops.alias_names(left, "v", {"a": "x"}).select("v"))[-1] == ("x",)


def test_keep_first_breaks_ties_by_the_other_columns(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 6, "0")], "k int, n int, s string")
    assert rows(ops.keep_first(df, ["k"], ["n"])) == [(1, 5, "a")]


def test_keep_first_of_rows_with_maps(spark):
    df = spark.createDataFrame([(1, 2, {"a": 1}), (1, 1, {"b": 1})], "k int, n int, m map<string,int>")
    nested = df.withColumn("s", F.struct("m", "n"))
    assert [r["n"] for r in ops.keep_first(nested, ["k"]).collect()] == [1]


def test_latest_by_key(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, None, "x")], "k int, version int, s string")
    assert rows(ops.latest_by_key(df, ["k"], "version")) == [(1, 2, "new"), (2, None, "x")]


def test_drop_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, s string")
    assert rows(ops.drop_repeated_keys(df, ["k"])) == [(2, "c"), (None, "d")]


def test_movement_labels(spark):
    pairs = [(3, 1), (1, 3), (2, 2), (None, 4)]
    df = spark.createDataFrame(pairs, "was int, now int")
    labels = df.select("now", ops.rank_change(F.col("was"), F.col("now")).alias("m"))
    assert dict(tuple(r) for r in labels.collect()) == {1: "↑ +2", 3: "↓ -2", 2: "–", 4: "–"}


def test_trophies(spark):
    assert [r[0] for r in spark.range(1, 5).select(ops.trophy(F.col("id"))).collect()] == ["🏆 1", "🏆 2", "🏆 3", "4"]


def test_global_position_matches_a_sort(spark):
    rng = random.Random(7)
    values = [(i, rng.choice([None, 1.0, 1.0, 2.5, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(values, "id int, x double").repartition(7)
    placed = ops.global_position(df, [F.col("x").desc_nulls_last(), F.col("id").asc()])
    expected = sorted(values, key=lambda v: (v[1] is None, -(v[1] or 0), v[0]))
    assert [tuple(r) for r in placed.orderBy("position").select("id", "x").collect()] == expected
    assert [r[0] for r in placed.orderBy("position").select("position").collect()] == list(range(1, 501))


def test_rank_within_a_dominant_group(spark):
    """One group holds most rows; its ranks still have no gaps."""
    values = [("hot" if i % 10 else None, i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(values, "g string, x int, id int").repartition(5)
    ranked = ops.rank_within(df, ["g"], [F.col("x").desc(), F.col("id").asc()])
    for group in ("hot", None):
        got = [(r["rank"], r["x"], r["id"]) for r in ranked.collect() if r["g"] == group]
        expected = sorted(((x, i) for g, x, i in values if g == group), key=lambda v: (-v[0], v[1]))
        assert sorted(got) == [(n, *v) for n, v in enumerate(expected, 1)]


def test_top_k_within(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 9)], "g string, x int")
    assert rows(ops.top_k_within(df, ["g"], [F.col("x").desc()], 2)) == [("a", 2, 2), ("a", 3, 1), ("b", 9, 1)]


def test_number_rows_after(spark):
    stored = spark.createDataFrame([(41,)], "row_idx bigint")
    batch = spark.createDataFrame([("b",), ("a",)], "s string")
    assert rows(ops.number_rows_after(stored, batch, [F.col("s").asc()])) == [(42, "a"), (43, "b")]
    assert rows(ops.number_rows_after(stored.limit(0), batch, [F.col("s").asc()])) == [(1, "a"), (2, "b")]


def test_windows_share_their_bound(spark):
    stamps = ["2021-01-01 00:00:00", "2021-01-01 00:00:01", "2021-03-01 23:59:59", "2021-03-02 00:00:00",
              "2021-01-30 00:00:00", "2021-01-29 23:59:59", "2020-12-31 00:00:00", "2020-12-30 23:59:59"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").withColumn("at", F.col("s").cast("timestamp_ntz"))
    now = ops.in_trailing_window(F.col("at"), "2021-03-01", 30)
    before = ops.in_previous_window(F.col("at"), "2021-03-01", 30, 30)
    got = {r[0]: (r[1], r[2]) for r in df.select("s", now, before).collect()}
    assert got["2021-01-30 00:00:00"] == (True, True)  # the shared instant
    assert got["2021-01-29 23:59:59"] == (False, True)
    assert got["2020-12-31 00:00:00"] == (False, True)
    assert got["2020-12-30 23:59:59"] == (False, False)
    assert got["2021-03-01 23:59:59"] == (True, False)
    assert got["2021-03-02 00:00:00"] == (False, False)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.sampled_from("abc"), st.integers(2001, 2005)), min_size=1))
def test_densify_fills_the_domain(spark, present):
    df = spark.createDataFrame([(k, y, 1.0) for k, y in present], "k string, year int, x double")
    full = ops.densify(df, ["k"], "year", 2001, 2005, {"x": 0.0})
    keys = {k for k, _ in present}
    assert full.count() == len(keys) * 5
    assert full.agg(F.sum("x")).first()[0] == len(present)
    gaps = ops.missing_keys(df, ["k"], "year", 2001, 2005)
    assert {tuple(r) for r in gaps.collect()} == {(k, y) for k in keys for y in range(2001, 2006)} - present


def test_densify_of_rows_outside_ties_and_nulls(spark):
    values = [("a", 1999, 1.0, "old"), ("a", 2002, 2.0, None), ("a", 2002, 3.0, "new"), ("b", 2009, 4.0, "late"), (None, None, 5.0, "none")]
    df = spark.createDataFrame(values, "k string, year int, x double, c string")
    full = ops.densify(df, ["k"], "year", 2001, 2003, {"x": 0.0}, carry=["c"])
    assert full.columns == df.columns
    assert rows(full.filter("k = 'a'").select("year", "x", "c")) == [
        (2001, 0.0, "old"), (2002, 2.0, "old"), (2002, 3.0, "new"), (2003, 0.0, "old"),
    ]
    assert rows(full.filter("k = 'b'").select("year", "x", "c")) == [(y, 0.0, "late") for y in (2001, 2002, 2003)]
    assert rows(full.filter("k IS NULL").select("year", "x", "c")) == [(y, 0.0, "none") for y in (2001, 2002, 2003)]
    assert ops.densify(df.limit(0), ["k"], "year", 2001, 2003, {"x": 0.0}, carry=["c"]).count() == 0


def test_rank_within_many_small_groups(spark):
    values = [(i % 97, i % 2, i) for i in range(1000)]
    df = spark.createDataFrame(values, "g int, h int, id int").repartition(6)
    got = {r["id"]: r["rank"] for r in ops.rank_within(df, ["g", "h"], [F.col("id").desc()]).collect()}
    assert got == {i: sum(v[:2] == (g, h) and v[2] >= i for v in values) for g, h, i in values}
    assert ops.rank_within(df.limit(0), ["g"], [F.col("id").asc()]).count() == 0


def test_attach_years(spark):
    panel = spark.createDataFrame([("a", 2001), ("b", 2002), ("c", 2001)], "name string, year int")
    wide = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, None)], "name string, `2001` double, `2002` double")
    joined = ops.attach_years(panel, wide, "name", [2001, 2002], "year", "x")
    assert rows(joined) == [("a", 2001, 1.0), ("b", 2002, None), ("c", 2001, None)]
