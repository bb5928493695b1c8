from __future__ import annotations

from workload import queries
from workload.roles import Roles


def test_rows_are_dealt_out_by_the_size_of_the_table(spark):
    """Also in sessions that do not name a number of partitions, which the given files would leave with one task."""
    t, named = Roles(spark, "/root/testdata/sf0.01"), spark.conf.get("spark.barrelbook.partitions")
    spark.conf.unset("spark.barrelbook.partitions")
    try:
        rows = t.table("orders").count()
        assert t.parts("orders", 100) == -(-rows // 100) > 8
        least = spark.sparkContext.defaultParallelism
        assert t.texts("orders").rdd.getNumPartitions() == least
        assert t.feed().rdd.getNumPartitions() == least
    finally:
        spark.conf.set("spark.barrelbook.partitions", named)


def test_a_feed_has_more_files_for_more_rows():
    class Table:
        def __init__(self, rows):
            self.count = lambda: rows

    files = [queries._feed_files(type("T", (), {"table": lambda self, name, n=n: Table(n)})()) for n in (0, 150_000, 9_000_000, 54_000_000)]
    assert files == [4, 4, 180, 1_080]
