"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrelbook.session import checkpointed


def _fixed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges, written to the shared folder, and a digest that tells them apart."""
    edges = checkpointed(edges.distinct())
    seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return edges, tuple(seen)


#: Parts that the links of one node are dealt to.
SALTS = 16


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS))


def _with_least(edges: DataFrame, moved) -> DataFrame:
    """The links that ``moved`` names, with the smallest node around ``a``.

    Minima are combined before the shuffle. They meet the links by node and salt, each minimum once per
    salt that its node has, so a node with very many links is dealt to ``SALTS`` parts.
    """
    salted = edges.withColumn("salt", _salt("b"))
    least = salted.groupBy("a").agg(
        F.min("b").alias("least"), F.collect_set(F.when(moved, F.col("salt"))).alias("salts")
    )
    least = least.select("a", "least", F.explode("salts").alias("salt"))
    return salted.filter(moved).join(least, ["a", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _with_least(both, F.col("b") > F.col("a"))
    return met.select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("b"))
    met = _with_least(down, F.lit(True)).filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return met.union(least)


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, root)``: each linked node with the smallest node it reaches.

    The number of rounds is logarithmic in the longest chain. A node with very many links is dealt
    to several tasks (see ``_with_least``).
    Self-links and repeated links are ignored; without links the result is empty.
    """
    edges, seen = _fixed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        edges, now = _fixed(_small_star(_large_star(edges)))
        if now == seen:
            break
        seen = now
    node = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return node.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
