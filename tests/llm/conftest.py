from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def documents(spark):
    """Documents from ``(doc_id, text)`` pairs, over several partitions."""

    def make(rows, partitions: int = 3):
        data = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(data, DOCUMENT).repartition(partitions)

    return make


#: Names that operators use inside; as extra columns they must not get in the way.
CLASHING = ("fp", "key", "score", "rank", "part", "start", "length", "a", "b", "node", "root", "least", "near")


@pytest.fixture
def clashing():
    def add(frame):
        from pyspark.sql import functions as F

        return frame.withColumns({name: F.lit("x") for name in CLASHING if name not in frame.columns})

    return add
