"""The log questions asked of a growing log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.session import scratch_path
from sievekit.sources.follow import FollowLog
from sievekit.sources.logs import parse_events


def tail_logs(spark: SparkSession, directory: str, max_files: int | None = None) -> DataFrame:
    """Events of closed log files as they appear; ``well_formed`` tells bad lines.

    The file source takes whole files, so it follows rotated members; ``follow_logs`` also follows the open one.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_events(reader.text(f"{directory}/app.log*"))


def follow_logs(spark: SparkSession, directory: str, chunk_bytes: int = 64 << 20) -> DataFrame:
    """Events of a log while it is written, the open file included; see ``sources.follow.FollowLog``.

    ``member`` and ``byte`` say where a line stands. The folder must be mounted by driver and executors.
    """
    spark.dataSource.register(FollowLog)
    lines = spark.readStream.format("follow_log").option("chunk", str(chunk_bytes)).load(directory)
    return parse_events(lines, keep=("member", "byte"))


def split_malformed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good events, malformed lines)."""
    return events.where("well_formed").drop("value"), events.where("NOT well_formed").select("value")


def stream_rate(stream: DataFrame, delay: str = "2 minutes", width: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Started requests per window; rows later than ``delay`` are dropped."""
    started = stream.where(F.col("event") == "request_started").withWatermark(ts, delay)
    return started.groupBy(F.window(ts, width)).agg(F.count("*").alias("requests")).select(
        F.col("window.start").alias("minute"), "requests"
    )


def stream_dedupe(stream: DataFrame, keys: Sequence[str], delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The first event per key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_pairing(
    starts: DataFrame, ends: DataFrame, bound: timedelta = timedelta(minutes=10), delay: str = "2 minutes", key: str = "request_id"
) -> DataFrame:
    """Each start with the ends that follow within ``bound``; a start without one gets nulls.

    Both streams have ``key`` and ``ts``, ``ends`` also ``event`` and ``duration_ms``. A pair comes out
    with the batch that brings the later of the two; a start without an end comes out once the
    watermark shows that none can follow. Rows later than ``delay`` are dropped. What is open when
    a run ends is in its state: ``open_starts``.

    Both sides are joined per key and stretch of time as long as ``bound``; an end goes to the
    stretch it is in and to the one before. A request that owns a third of the log is thus as many
    groups as it has stretches. The state of a start is dropped once the watermark has passed its
    bound, that of an end once it has passed the end. The watermark is that of the slower side.
    Rows without a time are left out; starts with a null key have no end.
    """
    stretch = F.floor(F.unix_micros("ts") / F.lit(bound // timedelta(microseconds=1))).cast("bigint")
    lefts = starts.where("ts IS NOT NULL").select(F.col(key).alias("name"), F.col("ts").alias("started_at"), stretch.alias("stretch"))
    rights = ends.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("e_name"), F.col("ts").alias("finished_at"), F.coalesce("event", F.lit("")).alias("end_event"),
        F.col("duration_ms"), F.array(stretch, stretch - 1).alias("e_stretch"),
    )
    lefts, rights = lefts.withWatermark("started_at", delay), rights.withWatermark("finished_at", delay)
    rights = rights.withColumn("e_stretch", F.explode("e_stretch"))
    within = (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.lit(bound))
    both = lefts.join(rights, (F.col("name") == F.col("e_name")) & (F.col("stretch") == F.col("e_stretch")) & within, "left")
    return both.select(F.col("name").alias(key), "started_at", "finished_at", "end_event", "duration_ms")


def open_starts(spark: SparkSession, state: str, key: str = "request_id", duration: str = "bigint") -> DataFrame:
    """The starts that wait for an end in the state of a ``stream_pairing`` run, as rows of its output."""
    found = spark.read.format("statestore").option("path", state).option("storeName", "left-keyWithIndexToValue").load()
    nothing = {"finished_at": "timestamp", "end_event": "string", "duration_ms": duration}
    return found.where("NOT value.matched").select(
        F.col("value.name").alias(key), "value.started_at", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()]
    )


def open_windows(spark: SparkSession, state: str) -> DataFrame:
    """The windows that a ``stream_rate`` run has not put out yet, from its state."""
    found = spark.read.format("statestore").option("path", state).load()
    return found.select(F.col("key.window.start").alias("minute"), F.col("value.count").alias("requests"))


def run_available(
    stream: DataFrame, label: str, mode: str = "append", still_open: Callable[[SparkSession, str], DataFrame] | None = None
) -> DataFrame:
    """Process everything that is there now into a table in the shared folder, and read it.

    ``still_open`` reads from the state of the ended run what it holds back for later rows, and
    closes it: those rows follow behind the table's. The input is not read again.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    out = spark.read.schema(stream.schema).parquet(f"{root}/out")
    return out if still_open is None else out.unionByName(still_open(spark, f"{root}/state"))
