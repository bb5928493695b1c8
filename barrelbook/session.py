"""Session helpers: recommended settings, the shared folder, reliable checkpoints, batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of texts; a text that is longer makes a batch of its own.
BATCH_BYTES = 4 << 20


def local_session(cores: int | str = "*", app: str = "barrelbook", **conf: str) -> SparkSession:
    """A session for tests and the benchmark. Clusters bring their own session."""
    parallelism = 8 if cores == "*" else int(cores)
    settings = {
        "spark.sql.shuffle.partitions": str(parallelism),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.barrelbook.partitions": str(parallelism),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call sites per expression
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master gets a folder of its own when the setting is absent; on a
    cluster a missing setting is an error, because a machine-local folder would be
    lost together with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="barrelbook-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably: later steps neither recompute nor reorder it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about ``BATCH_BYTES``; a setting of the session's own stays.

    By default 10,000 rows or 64 MB make a batch. Each task holds it in buffers that double as they grow, as rows
    that wait for their result, and once more in its Python worker, where texts become strings.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
