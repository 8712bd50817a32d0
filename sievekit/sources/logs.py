"""Structured log files: reading, strict JSON extraction, parse audit, writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions.rules import Col, c, event_time
from sievekit.operators.scaling import row_numbers
from sievekit.schemas import LOG_FIELDS


def read_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of ``app.log*`` with their place: rotation number, file, block and line.

    A folder without such files gives no lines.
    """
    try:
        lines = spark.read.text(f"{directory}/app.log*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.read.text(directory, pathGlobFilter="app.log*")
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, r"/(app\.log[^/]*)(?:/[^/]*)?$", 1)
    suffix = F.regexp_extract(name, r"\.(\d+)$", 1)
    return lines.select(
        "value",
        path.alias("file"),
        F.when(suffix == "", 0).otherwise(suffix.try_cast("int")).alias("file_seq"),
        F.struct(
            F.when(suffix == "", 0).otherwise(suffix.try_cast("int")).alias("file_seq"),
            path.alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("place"),
    )


def extract_json(df: DataFrame, schema: str, value: Col = "value", name: str = "t") -> DataFrame:
    """Add the JSON object that fills the text from its first brace to the end, else null.

    The text is parsed once, as the only element of an array: anything after the object breaks
    the array or adds an element. The result comes out of a generator, so filters on it do not
    parse again.
    """
    text = F.trim(c(value))
    at = F.locate("{", text)
    df = df.withColumn("_tail", F.when(at > 0, F.substr(text, at)))
    listed = F.from_json(F.concat(F.lit("["), "_tail", F.lit("]")), f"array<struct<{schema}>>")
    # A bracket in the text could close the array early; a second wrapper settles that.
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), "_tail", F.lit("}")))
    sealed = F.when(F.contains("_tail", F.lit("]")), boxed.isNotNull()).otherwise(True)
    df = df.withColumn("_list", listed)
    return df.withColumn(name, F.explode_outer(F.when((F.size("_list") == 1) & sealed, F.col("_list")))).drop("_list")


def parse_events(lines: DataFrame, value: Col = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Typed events and ``well_formed``; the whole record is in the VARIANT ``raw``.

    The hot columns come out of the text as strings and are cast leniently. ``raw`` is parsed
    only where it is selected.
    """
    kinds = {"timestamp": "string", "event": "string", **dict.fromkeys(LOG_FIELDS, "string"), "duration_ms": "variant"}
    schema = ",".join(f"{name}:{kind}" for name, kind in kinds.items())
    out = extract_json(lines.select(*keep, c(value).alias("value")), schema)
    duration, kind = F.col("t.duration_ms"), F.schema_of_variant("t.duration_ms")
    casts = {name: F.col(f"t.{name}").try_cast(target) for name, target in LOG_FIELDS.items()}
    casts["duration_ms"] = F.try_variant_get(duration, "$", "bigint")
    return out.select(
        *keep,
        "value",
        F.col("t").isNotNull().alias("well_formed"),
        F.when(F.col("t").isNotNull(), F.try_parse_json("_tail")).alias("raw"),
        F.coalesce("t.timestamp", F.lit("")).alias("timestamp"),
        event_time("t.timestamp").alias("ts"),
        F.coalesce("t.event", F.lit("")).alias("event"),
        *[cast.alias(name) for name, cast in casts.items()],
        # Stage timing wants whole numbers only; a boolean counts as 0 or 1.
        F.when(kind == "BIGINT", F.try_variant_get(duration, "$", "bigint"))
        .when(kind == "BOOLEAN", F.try_variant_get(duration, "$", "boolean").cast("bigint"))
        .alias("duration_int"),
    )


def scan_logs(spark: SparkSession, directory: str, max_records: int | None = None) -> DataFrame:
    """Good records of a rotated log, optionally the first ``max_records`` in file order.

    ``seq`` orders the records as they were read: file number, file, block and line. It is what
    the log operators take.
    """
    events = parse_events(read_lines(spark, directory), keep=("file", "file_seq", "place")).where("well_formed")
    events = events.withColumn("seq", F.col("place"))
    if max_records is None:
        return events
    file = [F.col("place.file_seq"), F.col("place.file")]
    ranked = row_numbers(events, [], [F.col("place")], file, "_rank", fine=[F.col("place.block")])
    return ranked.where(F.col("_rank") <= max_records).drop("_rank")


def parse_audit(parsed: DataFrame, max_errors: int | None = None) -> DataFrame:
    """Counters of one parse; ``parsed`` comes from parse_events over all lines.

    ``max_errors`` is where ``parse_errors`` stops counting, for reports that want it to.
    """
    bad = F.count_if(~F.col("well_formed"))
    return parsed.agg(
        F.count_distinct("file").alias("files_read"),
        F.count("*").alias("lines_read"),
        F.count_if("well_formed").alias("records_loaded"),
        bad.alias("malformed_lines"),
        (bad if max_errors is None else F.least(bad, F.lit(max_errors))).cast("long").alias("parse_errors"),
    )


def event_lines(events: DataFrame, ts: Col = "ts") -> DataFrame:
    """One JSON text per event: UTC time with milliseconds, null fields left out."""
    fields = [x for x in events.columns if x not in ("ts", "seq")]
    stamp = F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events.select(F.to_json(F.struct(stamp.alias("timestamp"), *fields)).alias("value"))


def emit_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("append").text(path)
