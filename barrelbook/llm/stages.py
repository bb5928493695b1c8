"""The operators as stages of the corpus pipeline.

Each takes ``(spark, docs, sf_dir)``. All but the last give documents with the columns they came
with. A document is told by its id, NULL or not, and a hash of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrelbook.llm import latent, packing, quality, simhash, suffixes
from barrelbook.llm.queries import piece_digests
from barrelbook.sources.readers import read_table

_KEY = ["__id", "__no_id", "__text"]


def _keyed(rows: DataFrame, text_hash) -> DataFrame:
    """Plain columns to join on, so that a later step can use the same partitioning."""
    return rows.withColumns(
        {
            "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            "__no_id": F.col("doc_id").isNull(),
            "__text": text_hash,
        }
    )


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects. Labels only teach; they do not decide.

    A NULL text is scored as empty, equal texts alike; without documents or labels of both classes
    none or all stay. Other columns pass through.
    """
    model = quality.train(docs, read_table(spark, f"{sf_dir}/labels.parquet"))
    scored = quality.with_score(docs, model, "__score")
    return scored.filter(F.col("__score") >= quality.THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: that with the smallest id.

    Of rows under that id the one with the smallest text hash stays, and of equal rows one. A
    document without id stays only if its component has no ids.
    """
    found = simhash.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    kept = found.groupBy("component").agg(first.alias("kept")).select("kept.doc_id", "kept.th")
    kept = _keyed(kept, F.col("th")).select(*_KEY)
    met = _keyed(docs, F.xxhash64("text")).join(kept, _KEY)
    return met.dropDuplicates(_KEY).select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte out of the texts that a repeated string of 200 bytes covers.

    Every document stays, with ``n_chars`` of what is left of its text; a NULL text stays NULL, and a
    character that a span covers in part stays whole. Repeated rows repeat each other, so both lose what
    they share. Without documents the result is empty; other columns pass through.
    """
    marked = suffixes.with_repeated_spans(docs, "__cut", kept=("__kept", suffixes.kept_text, lambda text: text))
    cut = marked.withColumn("text", F.col("__kept"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a benchmark item.

    A NULL or empty text holds none and stays; repeated rows go or stay together; ties of items do not
    matter. Without items all documents stay. Other columns pass through.
    """
    found = latent.leaks(docs, read_table(spark, f"{sf_dir}/benchmark.parquet"))
    found = _keyed(found, F.col("th")).select(*_KEY)
    return _keyed(docs, F.xxhash64("text")).join(found, _KEY, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the tokens of every document lie in sequences.

    A NULL or empty text is one end token; repeated rows and NULL ids are documents of their own. Without
    documents there are no pieces. The documents' other columns are left out.
    """
    return piece_digests(docs)
