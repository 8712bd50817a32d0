"""Detected against expected counts, and scenarios side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_truth(summary: DataFrame, truth: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Keep every expected sample; a sample without a result is an ERROR."""
    diff = F.col("detected") - F.col("expected_total")
    verdict = (
        F.when(diff.isNull(), "ERROR")
        .when(diff == 0, "MATCH")
        .when(diff < 0, "UNDER-DETECTED")
        .otherwise("OVER-DETECTED")
    )
    return truth.join(summary, list(by), "left").withColumns(
        {"count_difference": diff.cast("long"), "verdict": verdict}
    )


def scenario_pivot(results: DataFrame, modes: Sequence[str], value: str, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """One row per sample, one column per mode; naming the modes avoids a discovery job."""
    return results.groupBy(*by).pivot("mode", list(modes)).agg(F.max(value))
