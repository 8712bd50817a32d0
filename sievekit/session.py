"""Session-level settings the plans rely on, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings, applied only where the user has not chosen a value.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Split a hot key in a join even when an aggregate on the same key follows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows may hold long texts; a Python task has one batch of them in memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}

_DONE = "sievekit.tuned"

# A shuffle partition should hold about this much of the input, which is compressed and by column.
_TARGET_PARTITION_BYTES = 8 << 20


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the defaults; shuffle width follows the cores, and is raised to what the input size needs."""
    width = "spark.sql.shuffle.partitions"
    if not spark.conf.get(_DONE, None):  # later choices of the user stay
        spark.conf.set(_DONE, "true")
        chosen = spark.sparkContext.getConf()
        for key, value in _RUNTIME.items():
            if not chosen.contains(key):
                spark.conf.set(key, value)
        if not chosen.contains(width) and spark.conf.get(width) == "200":
            spark.conf.set(width, str(2 * spark.sparkContext.defaultParallelism))
    # What a task sorts or groups must not grow with the input; too many partitions are joined again.
    wanted = -(-(input_bytes or 0) // _TARGET_PARTITION_BYTES)
    if wanted > int(spark.conf.get(width)):
        spark.conf.set(width, str(wanted))
    return spark


def bytes_of(spark: SparkSession, path: str) -> int:
    """The size of a file or folder in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder; readers take the columns that they need."""
    place = scratch_path(df.sparkSession, label)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only in local mode, when the session names none."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sievekit-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sievekit/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_end_with_actions(spark: SparkSession) -> Iterator[None]:
    """What is planned inside deletes its shuffle files when its action ends, not when the driver next collects garbage.

    For chains of eager steps, each of which leaves its rows in the shared folder.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise reliably: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
