"""Rows of long texts go to Python in batches of bounded size, whichever operator asks for it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barrelbook.llm import latent, packing, quality, simhash, suffixes
from barrelbook.session import BATCH_BYTES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
LETTERS = 100_000
LABELS = "doc_id long, quality int, toxic int"


def _letters():
    return lambda text: np.zeros(1, dtype="<u4")


OPERATORS = {
    "train": lambda docs: quality.train(docs.limit(1), docs.sparkSession.createDataFrame([], LABELS)),
    "with_score": lambda docs: quality.with_score(docs, quality.Model(np.zeros(quality.ALL_SLOTS + 1), 1.0, 0.0), "score"),
    "with_fingerprint": lambda docs: simhash.with_fingerprint(docs, "text", "fp"),
    "repeated_spans": lambda docs: suffixes.repeated_spans(docs.limit(1)),
    "leaks": lambda docs: latent.leaks(docs.limit(1), docs.sparkSession.createDataFrame([], "item_id long, text string")),
    "pack": lambda docs: packing.pack(docs, _letters),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_batches_of_texts_are_bounded(spark, name):
    session = spark.newSession()
    size = F.when(F.col("id") == 7, 2 * BATCH_BYTES).otherwise(LETTERS).cast("int")
    docs = session.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), size).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    OPERATORS[name](docs)
    found = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 200  # a text of more than a batch is there too
    assert max(r.bytes for r in found) < 3 * BATCH_BYTES + 2 * LETTERS
    assert sorted(r.bytes for r in found)[-2] < BATCH_BYTES + 2 * LETTERS


def test_a_setting_of_the_session_stays(spark):
    session = spark.newSession()
    session.conf.set(KEY, "1048576")
    simhash.with_fingerprint(session.createDataFrame([(1, "a")], "doc_id long, text string"), "text", "fp")
    assert session.conf.get(KEY) == "1048576"
