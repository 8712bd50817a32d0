"""Screening of sample summaries against published limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.fixed import CANNOT_GRADE, SCREENED
from sievekit.functions.rules import rnd


def screen_limits(
    summary: DataFrame, limits: DataFrame, grade: str = "grade_a", by: Sequence[str] = ("sample_id",), minimum: int = 30
) -> DataFrame:
    """One row per sample and screened parameter.

    ``summary`` has total_count, quality_level and, per parameter stem, ``*_percent``,
    ``*_count`` and ``*_analyzed_count`` (missing ones count as unmeasured). ``limits`` is the
    long table of one standard: eight rows per grade.
    """
    have = set(summary.columns)

    def get(name: str, kind: str, other):
        return (F.col(name) if name in have else F.lit(other)).cast(kind)

    entries = [
        F.struct(
            F.lit(parameter).alias("parameter"),
            get(f"{stem}_percent", "double", None).alias("observed"),
            F.coalesce(get(f"{stem}_count", "bigint", 0), F.lit(0)).alias("detected"),
            (
                F.coalesce(F.col(f"{stem}_analyzed_count").cast("bigint"), F.lit(0))
                if f"{stem}_analyzed_count" in have
                else F.col("total_count").cast("bigint")
            ).alias("analyzed"),
        )
        for parameter, stem in SCREENED
    ]
    tall = summary.select(*by, "total_count", "quality_level", F.explode(F.array(*entries)).alias("p")).select(
        *by, "total_count", "quality_level", "p.*"
    )
    known = limits.agg(F.coalesce(F.max(F.col("grade") == grade), F.lit(False)).alias("_known"))
    asked = F.when(F.col("_known"), grade).otherwise("grade_a")  # an unknown grade is screened as the first one
    rules = limits.join(F.broadcast(known)).where((F.col("grade") == asked) & F.col("sub_parameter").isNull()).select(
        "parameter", "max_percent", "basis", "image_assessable", "image_basis", "limitation"
    )
    rows = tall.join(rules, "parameter", "left")
    small = F.col("total_count") < minimum
    bad_image = F.col("quality_level").isin("POOR", "UNRELIABLE")
    seen, cap = F.col("observed"), F.col("max_percent")
    status = (
        F.when(F.coalesce("image_assessable", F.lit("false")) != "true", "NOT ASSESSABLE")
        .when(cap.isNull(), "NOT APPLICABLE")
        .when(small | bad_image, "NOT DETERMINABLE")
        .when(seen.isNull(), "NOT ASSESSABLE")
        .when(seen <= cap, "WITHIN REFERENCE LIMIT")
        .otherwise("EXCEEDS REFERENCE LIMIT")
    )
    few = F.format_string(
        f"Only %d grains were analyzed; the project screening threshold is {minimum} grains "
        "(engineering threshold, not an official Government requirement).",
        F.col("total_count"),
    )
    blurred = F.concat(
        F.lit("Image quality is "), F.col("quality_level"), F.lit("; reliable compliance screening is suppressed.")
    )
    rows = rows.withColumn("status", status)
    judged = F.col("status").isin("WITHIN REFERENCE LIMIT", "EXCEEDS REFERENCE LIMIT")
    counts = F.format_string("%d / %d ", F.col("detected"), F.col("analyzed"))
    return rows.select(
        *by,
        "parameter",
        "total_count",
        "quality_level",
        rnd("observed").alias("observed_percent"),
        F.col("detected").alias("detected_count"),
        F.col("analyzed").alias("analyzed_count"),
        rnd(F.try_divide(F.col("detected").cast("double"), F.col("analyzed")), 4).alias("observed_fraction"),
        F.when(
            seen.isNotNull() & (F.col("analyzed") > 0), F.concat(counts, F.format_string("(%.2f%%)", rnd(seen)))
        ).otherwise(F.concat(counts, F.lit("(not measurable)"))).alias("observed_value"),
        cap.alias("reference_limit_percent"),
        F.coalesce("basis", F.lit("weight")).alias("official_basis"),
        F.coalesce("image_basis", F.lit("count")).alias("image_basis"),
        "status",
        F.when(judged, rnd(F.abs(seen - cap))).alias("difference"),
        F.when(F.col("status") != "NOT DETERMINABLE", F.coalesce("limitation", F.lit("")))
        .when(bad_image, blurred)
        .otherwise(few)
        .alias("limitation"),
    )


def screening_verdict(
    screening: DataFrame, calibration_mode=None, by: Sequence[str] = ("sample_id",), minimum: int = 30
) -> DataFrame:
    """One verdict per sample (eight screening rows each); never a formal grade.

    ``calibration_mode`` is an optional table with the same key.
    """
    by = list(by)
    rows = screening if calibration_mode is None else screening.join(calibration_mode, by, "left")
    mode = F.lit("none") if calibration_mode is None else F.coalesce("calibration_mode", F.lit("none"))
    out = rows.withColumn("_mode", mode).groupBy(*by).agg(
        F.max("total_count").alias("total_count"),
        F.max("quality_level").alias("quality_level"),
        F.max("_mode").alias("_mode"),
        F.collect_set(F.when(F.col("status") == "EXCEEDS REFERENCE LIMIT", F.col("parameter"))).alias("_over"),
        F.count_if(F.col("status").isin("WITHIN REFERENCE LIMIT", "EXCEEDS REFERENCE LIMIT")).alias("_judged"),
    )
    # In the order of screening.
    screened = F.array(*[F.lit(parameter) for parameter, _ in SCREENED])
    out = out.withColumn("exceeding_parameters", F.filter(screened, lambda p: F.array_contains("_over", p))).drop("_over")
    small = F.col("total_count") < minimum
    bad_image = F.coalesce(F.col("quality_level").isin("POOR", "UNRELIABLE"), F.lit(False))
    many = F.size("exceeding_parameters") > 0
    verdict = (
        F.when(small | bad_image, "Not determinable from this sample")
        .when(many, "Exceeds one or more image-assessable reference limits")
        .when(F.col("_judged") > 0, "Meets image-assessable reference limits")
        .otherwise("Insufficient data for screening")
    )
    reasons = F.array_compact(
        F.array(
            *[F.lit(text) for text in CANNOT_GRADE],
            F.when(
                small,
                F.format_string(
                    f"Small sample size (%d grains); project screening threshold: {minimum} grains "
                    "(engineering threshold, not an official Government requirement).",
                    F.col("total_count"),
                ),
            ),
            F.when(
                bad_image,
                F.concat(
                    F.lit("Image quality is "),
                    F.col("quality_level"),
                    F.lit("; reliable official compliance conclusions are suppressed."),
                ),
            ),
            F.when(
                F.col("_mode") == "none",
                F.lit("No metric calibration — length/breadth measurements are in pixels."),
            ),
        )
    )
    return out.select(
        *by,
        "exceeding_parameters",
        verdict.alias("image_screening_verdict"),
        F.when(small | bad_image, "Not determinable from this sample")
        .otherwise("Formal grade not determined")
        .alias("status"),
        F.lit(False).alias("formal_grade_determined"),
        reasons.alias("reasons"),
    )
