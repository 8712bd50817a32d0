"""Documents per sample, exports and archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.rules import display_length
from sievekit.operators.scaling import row_numbers

# Grains nested in one document row; a larger sample continues in further parts.
PART_SIZE = 10_000

GRAIN_FIELDS = (
    "grain_id", "x", "y", "w", "h", "confidence", "status", "effective_length", "length_ratio",
    "breadth_px", "lb_ratio", "area", "quality",
)


def assemble_document(
    instances: DataFrame,
    foreign: DataFrame,
    summary: DataFrame,
    by: Sequence[str] = ("sample_id",),
    fields: Sequence[str] = GRAIN_FIELDS,
    part_size: int = PART_SIZE,
) -> DataFrame:
    """Nest grains, foreign objects and the summary into documents.

    ``grain_id`` and ``foreign_id`` number the rows of a sample from 1. A sample of up to
    ``part_size`` rows is one document; a larger one is split by id range into parts, so no
    row ever nests an unbounded group and nothing is cut off.
    """
    by = list(by)

    def nested(rows: DataFrame, key: str, cols: Sequence[str], name: str) -> DataFrame:
        part = F.floor((F.col(key) - 1) / part_size).cast("int").alias("part")
        return rows.groupBy(*by, part).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    grains = nested(instances, "grain_id", fields, "grains")
    others = nested(foreign, "foreign_id", [k for k in foreign.columns if k not in by], "foreign_matter")
    first = summary.select(*by, F.struct(*[k for k in summary.columns if k not in by]).alias("summary"))
    parts = grains.join(others, [*by, "part"], "full").join(
        first.withColumn("part", F.lit(0)), [*by, "part"], "full"
    )
    return parts.withColumns(
        {
            "grains": F.coalesce("grains", F.array().cast(grains.schema["grains"].dataType)),
            "foreign_matter": F.coalesce("foreign_matter", F.array().cast(others.schema["foreign_matter"].dataType)),
        }
    )


def flatten_document(documents: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Documents back to one row per grain; a sample without grains keeps one empty row."""
    first = F.coalesce(F.col("part") == 0, F.lit(True))
    rows = documents.where(first | (F.size("grains") > 0))
    return rows.select(*by, F.explode_outer("grains").alias("g")).select(*by, "g.*")


def _limited(mm_first: bool = True) -> list[Column]:
    return [
        F.col("grain_id"),
        F.col("confidence"),
        F.col("confidence_label"),
        display_length("length_mm", "length_px").alias("length"),
        display_length("breadth_mm", "breadth_px").alias("breadth"),
        F.col("lb_ratio"),
    ]


def instances_json(
    instances: DataFrame, summary: DataFrame, by: Sequence[str] = ("sample_id",), part_size: int = PART_SIZE
) -> DataFrame:
    """(by, part, value): the limited per-sample document as JSON text.

    ``summary`` has total_rice_grains, measurement_unit and calibration_mode per sample.
    """
    by = list(by)
    part = F.floor((F.col("grain_id") - 1) / part_size).cast("int").alias("part")
    grains = instances.groupBy(*by, part).agg(F.array_sort(F.collect_list(F.struct(*_limited()))).alias("grains"))
    heads = ("total_rice_grains", "measurement_unit", "calibration_mode")
    rows = summary.select(*by, *heads).join(grains, by, "left").withColumns(
        {"part": F.coalesce("part", F.lit(0)), "grains": F.coalesce("grains", F.array())}
    )
    return rows.select(*by, "part", F.to_json(F.struct(*heads, "grains")).alias("value"))


def write_instances_json(instances: DataFrame, summary: DataFrame, path: str, by: Sequence[str] = ("sample_id",)) -> None:
    instances_json(instances, summary, by).select("value").write.mode("append").text(path)


def write_instances_csv(
    instances: DataFrame, summary: DataFrame, path: str, by: Sequence[str] = ("sample_id",)
) -> None:
    """Grain rows under ``grains/`` and the three summary lines per sample under ``summary/``."""
    limited = instances.select(*by, *_limited()).drop("confidence_label").withColumnRenamed("lb_ratio", "L_over_B")
    limited.write.mode("append").csv(f"{path}/grains", header=True)
    lines = summary.select(
        *by,
        F.stack(
            F.lit(3),
            F.lit("Total Rice Grains"), F.col("total_rice_grains").cast("string"), F.lit("count"),
            F.lit("Measurement Unit"), F.col("measurement_unit"), F.lit(""),
            F.lit("Calibration Mode"), F.col("calibration_mode"), F.lit(""),
        ).alias("Parameter", "Value", "Unit / Notes"),
    )
    lines.write.mode("append").csv(f"{path}/summary", header=True)


def archive_runs(runs: DataFrame, path: str, blob: str = "annotated_image") -> None:
    """Append run records by day, without the image."""
    runs.drop(blob).withColumn("run_date", F.to_date("run_at")).write.mode("append").partitionBy("run_date").parquet(path)


def next_run_numbers(
    runs: DataFrame, existing: DataFrame, order: Sequence[Column], bucket: Sequence[Column], fine: Sequence[Column] = ()
) -> DataFrame:
    """Number new runs after the highest existing one: ``NNN_dd_MM_yy``.

    ``bucket`` and ``fine`` follow ``order``, as for ``row_numbers``: days, and what splits one.
    """
    number = F.regexp_extract("run_id", r"^(\d+)_", 1).try_cast("bigint")
    top = existing.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    rows = row_numbers(runs, [], order, bucket, "_n", fine).join(F.broadcast(top))
    n = (F.col("_top") + F.col("_n")).cast("string")
    # Three digits at least; longer numbers are kept whole.
    padded = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    stamp = F.date_format("run_at", "dd_MM_yy")
    return rows.withColumn("run_id", F.concat(padded, F.lit("_"), stamp)).drop("_top", "_n")
