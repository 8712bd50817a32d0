"""Small reference documents: profiles, limits, class maps, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.fixed import THRESHOLDS
from sievekit.operators.reference import profile_verdict
from sievekit.schemas import ASSESSMENT, LIMIT, PROFILE


def load_profiles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Profile documents with defaults per field; the verdict is kept beside them."""
    raw = spark.read.schema(PROFILE).json(path, multiLine=multi_line)
    file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    filled = raw.withColumns(
        {
            "profile_name": F.coalesce("profile_name", stem),
            "reference_unit": F.coalesce("reference_unit", F.lit("pixels")),
            "whole_kernel_length": F.coalesce("whole_kernel_length", F.lit(0.0)),
            "source": F.coalesce("source", F.concat(F.lit("file:"), file)),
            "reference_count": F.coalesce("reference_count", F.lit(1)),
            "data_status": F.coalesce("data_status", F.lit("Proxy")),
            "production_eligible": F.coalesce("production_eligible", F.lit(False)),
        }
    )
    return filled.withColumn("verdict", profile_verdict())


def flatten_limits(
    docs: DataFrame, text: str = "value", grades: tuple[str, ...] = ("grade_a", "common"), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Limits documents (one JSON text per row) to one row per grade, parameter and sub-limit."""
    parts = None
    for grade in grades:
        body = F.from_json(F.get_json_object(text, f"$.{grade}"), f"map<string,{LIMIT}>")
        rows = docs.select(
            *keep,
            F.lit(grade).alias("grade"),
            F.from_json(F.get_json_object(text, "$.image_assessment_mapping"), "map<string,string>").alias("m"),
            F.explode(body).alias("parameter", "l"),
        )
        parts = rows if parts is None else parts.unionAll(rows)
    # The mapping also holds plain text entries, so its values are parsed one at a time.
    known = F.from_json(F.try_element_at("m", F.col("parameter")), ASSESSMENT)
    main = parts.select(
        *keep,
        "grade",
        "parameter",
        F.lit(None).cast("string").alias("sub_parameter"),
        "l.max_percent",
        F.coalesce("l.basis", F.lit("weight")).alias("basis"),
        F.coalesce(known["image_assessable"], F.lit("false")).alias("image_assessable"),
        F.coalesce(known["image_basis"], F.lit("count")).alias("image_basis"),
        F.coalesce(known["limitation"], F.lit("")).alias("limitation"),
    )
    sub = parts.select(
        *keep,
        "grade",
        "parameter",
        F.explode("l.sub_limits").alias("sub_parameter", "s"),
        known.alias("k"),
    ).select(
        *keep,
        "grade",
        "parameter",
        "sub_parameter",
        "s.max_percent",
        F.coalesce("s.basis", F.lit("weight")).alias("basis"),
        F.coalesce("k.image_assessable", F.lit("false")).alias("image_assessable"),
        F.coalesce("k.image_basis", F.lit("count")).alias("image_basis"),
        F.coalesce("k.limitation", F.lit("")).alias("limitation"),
    )
    return main.unionAll(sub)


def load_class_map(docs: DataFrame, text: str = "value", model: str = "model") -> DataFrame:
    """(model, class_id, class_name, is_target) from id-to-name documents; digit ids only."""
    rows = docs.select(model, F.explode(F.from_json(text, "map<string,string>")).alias("id", "class_name"))
    lower = F.lower("class_name")
    return rows.where(F.col("id").rlike("^[0-9]+$")).select(
        model,
        F.col("id").cast("int").alias("class_id"),
        "class_name",
        (F.contains(lower, F.lit("rice")) & ~F.contains(lower, F.lit("foreign"))).alias("is_target"),
    )


def threshold_table(spark: SparkSession, overrides: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(category, key, value): the fixed defaults with given values merged over them."""
    rows = []
    for category in sorted({*THRESHOLDS, *(overrides or {})}):
        merged = {**THRESHOLDS.get(category, {}), **(overrides or {}).get(category, {})}
        rows += [(category, key, float(value)) for key, value in sorted(merged.items())]
    return spark.createDataFrame(rows, "category string, key string, value double")


def with_threshold(df: DataFrame, table: DataFrame, category: Column, key: Column, default: Column, name: str) -> DataFrame:
    """Look up a two-level threshold per row, with a default where the table has none."""
    keyed = df.withColumns({"_cat": category, "_key": key})
    found = table.select(F.col("category").alias("_cat"), F.col("key").alias("_key"), F.col("value").alias("_v"))
    return (
        keyed.join(found, ["_cat", "_key"], "left")
        .withColumn(name, F.coalesce("_v", default))
        .drop("_cat", "_key", "_v")
    )
