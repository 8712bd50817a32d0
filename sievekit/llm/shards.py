"""Records dealt into shards by jump consistent hashing of their key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.session import scratch_path

_STEP = np.uint64(2862933555777941757)
_SPAN = float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards``: the last of its jumps that stays below their number.

    Each key has its own pseudorandom series; from shard b it jumps to j > b with the chance that a
    key must move when b + 1 shards become j + 1. Another shard at the end therefore adds at most
    one jump, into that shard. A key needs about ln(shards) jumps and no table of the shards.
    """
    state = keys.astype(np.uint64)
    found, to = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    on = np.arange(len(state))
    while len(on):
        found[on] = to[on]
        state[on] = state[on] * _STEP + np.uint64(1)
        draw = (state[on] >> np.uint64(33)).astype(np.float64) + 1.0
        to[on] = np.floor((found[on] + 1) * (_SPAN / draw)).astype(np.int64)
        on = on[to[on] < shards]
    return found


def shard_records(records: DataFrame, key: str = "request_id", text: str = "error_message", shards: int = 16) -> DataFrame:
    """Deal log records into ``shards`` files of a training set by their key alone.

    ``records`` has ``key`` (a ``request_id``, ``job_id`` or number; of any type that sorts and has a
    string form) and ``text``. Returns one row per record: ``key, size, text_crc32, shard, slot, grown_shard``.
    ``size`` is the text's UTF-8 bytes and one more, ``text_crc32`` its unsigned checksum.
    ``shard`` (0 to ``shards`` - 1) is the jump consistent hash of the first 64 bits of the MD5 of
    the key's string form, and ``grown_shard`` the same with one shard more: it differs for about one key
    in ``shards`` + 1 and then is the new shard. ``slot`` counts the records of a shard from 0 without gaps, in the order
    of key, size and checksum.

    Key and number of shards decide the shard, so copies of one text stand where their keys put
    them, and records of one key stay together whatever their share of the table. The slots of a
    shard are counted by many tasks: rows are ranged by (shard, key, size, checksum, place in the
    input), each range counts its rows per shard, and ranges start where the ones before end. Texts
    are not shuffled. The numbered rows are written to the shared folder once.

    A null text is empty: size 1, checksum 0. Null keys share the shard of the empty
    string and come first in it.
    Repeated rows are rows of their own. Only two columns are read, so other names cannot clash.
    An empty table gives an empty result. ``shards`` below 1 is an error.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")

    @F.pandas_udf("struct<shard:int,grown_shard:int>")
    def place(hashes: pd.Series) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(hashes), ">u8")
        with np.errstate(over="ignore"):
            return pd.DataFrame({"shard": jump(keys, shards).astype(np.int32), "grown_shard": jump(keys, shards + 1).astype(np.int32)})

    spark = records.sparkSession
    text_ = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    name = F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")
    rows = records.select(
        F.col(key).alias("key"), (F.octet_length(text_) + F.lit(1)).cast("long").alias("size"), F.crc32(text_).alias("text_crc32"),
        place(F.unhex(F.substring(F.md5(name), 1, 16))).alias("at"), F.monotonically_increasing_id().alias("tie"),
    ).select("key", "size", "text_crc32", "at.shard", "at.grown_shard", "tie")
    order = ["shard", "key", "size", "text_crc32", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    folder = scratch_path(spark, "shards")
    ranged.select("*", F.monotonically_increasing_id().alias("no")).write.parquet(folder)
    rows = spark.read.schema(ranged.select("*", F.lit(0).cast("long").alias("no")).schema).parquet(folder)
    rows = rows.withColumn("range", F.shiftright("no", 33))

    # One row for each range and shard in it: no more than ranges and shards together.
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("no").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    slot = (F.col("no") + F.col("shift")).alias("slot")
    return rows.join(starts, ["shard", "range"]).select(F.col("key").alias(key), "size", "text_crc32", "shard", slot, "grown_shard")
