"""Scans. Every schema is explicit; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A warehouse table by name, or a Parquet folder by path. A given schema spares the
    job that reads footers to find it."""
    if "/" not in name:
        return spark.table(name)
    return (spark.read.schema(schema) if schema else spark.read).parquet(name)


#: Only empty fields are NULL (what is read as NULL must be a value that no field has); quotes are doubled.
_CSV = {"escape": '"', "nullValue": "\x00"}


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True, multiline: bool = False
) -> DataFrame:
    """CSV with doubled quotes as escapes. Without a header the schema names the columns.

    Only empty fields are NULL, so a code such as ``NA`` stays text, and a quoted empty field is
    an empty text. ``multiline`` allows line breaks in quoted fields (see ``read_csv_records``).
    """
    if multiline:
        return read_csv_records(spark, path, schema, header)
    return spark.read.schema(schema).options(header=header, **_CSV).csv(path)


def read_csv_records(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """CSV whose quoted fields may hold line breaks, each file in as many tasks as it has blocks.

    A line begins inside a quoted field if the quotes before it in the file are odd in number. A first
    pass counts, per block, its quotes and the records that begin in it, for either state at its
    start; a pass over one row per block gives every block its state and the number of its first
    record. Then the lines are read again: records of one line are parsed where they are, and only
    the lines of longer ones are brought together, by file and record. What is broadcast has one
    row per block. A quote must stand in quoted fields only, doubled, as ``overwrite_csv`` and other
    writers have it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    counts = lines.mapInArrow(_block_counts, "file string, block bigint, quotes bigint, even bigint, odd bigint")
    per_block = counts.groupBy("file", "block").agg(*[F.sum(c).alias(c) for c in ("quotes", "even", "odd")])
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    states = per_block.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))
    states = states.withColumn("first", F.coalesce(F.sum(begun).over(before), F.lit(0)))
    known = lines.join(F.broadcast(states.select("file", "block", "inside", "first")), ["file", "block"])
    parts = known.mapInArrow(_records, "file string, record bigint, line bigint, single boolean, value string")
    if header:
        parts = parts.filter(F.col("record") > 1)
    one = parts.filter("single").select("value")
    several = parts.filter("NOT single").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines")
    )
    joined = several.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))
    text = F.regexp_replace("value", r"\r\z", "")
    records = one.unionByName(joined).filter(text != "")
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv(text, ddl, {**_CSV, "multiLine": "true"}).alias("_row")).select("_row.*")


def _runs(batch):
    """Rows of an Arrow batch by file block: ``(file, block, first row, end)``."""
    import numpy as np

    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
    if not len(files):
        return
    same = np.fromiter((a == b for a, b in zip(files[1:], files, strict=False)), bool, len(files) - 1)
    cuts = np.flatnonzero(~same | (blocks[1:] != blocks[:-1])) + 1
    for start, end in zip([0, *cuts], [*cuts, len(files)], strict=True):
        yield files[start], int(blocks[start]), int(start), int(end)


def _quotes(batch):
    import pyarrow.compute as pc

    return pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)


def _block_counts(batches):
    """Quotes of some lines of a block, and the records that begin in them, by the state at the block's start."""
    import pyarrow as pa

    seen: dict = {}
    for batch in batches:
        quotes = _quotes(batch)
        for file, block, start, end in _runs(batch):
            total, even, odd = seen.get((file, block), (0, 0, 0))
            inside = (quotes[start:end].cumsum() - quotes[start:end] + total) % 2
            seen[file, block] = total + int(quotes[start:end].sum()), even + int((inside == 0).sum()), odd + int(inside.sum())
    rows = [(*key, *value) for key, value in seen.items()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.string(), *[pa.int64()] * 4)
    names = ["file", "block", "quotes", "even", "odd"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _records(batches):
    """Every line with the number of its record in the file, from 1, and whether it is all of it."""
    import numpy as np
    import pyarrow as pa

    at: dict = {}
    for batch in batches:
        quotes, number = _quotes(batch), np.zeros(batch.num_rows, np.int64)
        line, single = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
        inside_first, first = batch.column("inside").to_pylist(), batch.column("first").to_pylist()
        for file, block, start, end in _runs(batch):
            own = quotes[start:end]
            state, done, nth = at.get((file, block), (int(inside_first[start]), first[start], 0))
            inside = (own.cumsum() - own + state) % 2
            number[start:end] = done + (inside == 0).cumsum()
            line[start:end] = block + nth + np.arange(end - start)  # a block has fewer lines than bytes
            single[start:end] = (inside == 0) & (own % 2 == 0)
            at[file, block] = int(own.sum() + state) % 2, int(number[end - 1]), nth + end - start
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), pa.array(number), pa.array(line), pa.array(single), batch.column("value")],
            names=["file", "record", "line", "single", "value"],
        )


def read_csv_after_preamble(
    spark: SparkSession, path: str, schema: str, skip_lines: int, header: bool = True
) -> DataFrame:
    """CSV whose first ``skip_lines`` lines, and then the header, are no data.

    The preamble can only lie in the first block of a file, so lines are numbered there,
    one block per file; all other blocks are parsed as they are read.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    first_lines = W.partitionBy("_file").orderBy("_line")
    head = (
        lines.filter(F.col("_block") == 0)
        .withColumn("_nth", F.row_number().over(first_lines))
        .filter(F.col("_nth") > skip_lines + (1 if header else 0))
    )
    rest = lines.filter(F.col("_block") > 0)
    body = head.select("value").unionByName(rest.select("value")).filter(F.trim("value") != "")
    parsed = F.from_csv("value", schema, {"escape": '"'})
    return body.select(parsed.alias("_row")).select("_row.*")


def parse_records(df: DataFrame, column: str | Column, schema: str | T.StructType, keep: list[str] = ()) -> DataFrame:
    """JSON text to one struct column ``record``; malformed text gives NULL fields."""
    body = F.col(column) if isinstance(column, str) else column
    return df.select(*keep, F.from_json(body, schema).alias("record"))


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines as one struct column ``record``."""
    return spark.read.schema(schema).json(path).select(F.struct("*").alias("record"))
