"""The reference hierarchy and the fragment rule on literal length lists."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievekit.functions import rules as R
from sievekit.operators import reference as ref

WHOLE = [98, 101, 99, 102, 100, 97, 103, 101, 99, 100]
SHORT = [45 + (i * 27) / 99 for i in range(100)]
CASES = {
    # lengths, pixel profile, whole, broken, undetermined, source, status
    "A": ([98], 100, 1, 0, 0, "profile", "limited"),
    "B": ([60], 100, 0, 1, 0, "profile", "limited"),
    "C": ([95, 102], 100, 2, 0, 0, "profile", "limited"),
    "D": (WHOLE, None, 10, 0, 0, "sample_derived", "reliable"),
    "E": ([*WHOLE, 62], None, 10, 1, 0, "sample_derived", "reliable"),
    "F": ([*WHOLE, 55, 68], None, 10, 2, 0, "sample_derived", "reliable"),
    "G": ([*WHOLE, 52, 58, 64, 69, 71], None, 10, 5, 0, "sample_derived", "reliable"),
    "H": (SHORT, 100, 0, 100, 0, "profile", "limited"),
    "I": ([*[45 + i / 2 for i in range(50)], 102], 100, 1, 50, 0, "profile", "limited"),
    "J": ([50, 52, 55, 57, 58, 60, 54, 53, 56, 58], None, 0, 0, 10, "unavailable", "undetermined"),
    "K": ([65], None, 0, 0, 1, "unavailable", "undetermined"),
    "edge": ([74.9999, 75, 75.0001], 100, 2, 1, 0, "profile", "limited"),
    "never": ([50, 55, 52, 48, 53], None, 0, 0, 5, "unavailable", "undetermined"),
    "off_scale": ([10, 11, 10], 100, 0, 0, 3, "unavailable", "undetermined"),
}
PROFILE = (
    "sample_id string, profile_name string, reference_unit string, whole_kernel_length double, "
    "whole_kernel_breadth double, whole_kernel_lb_ratio double, data_status string, "
    "production_eligible boolean, reference_count int"
)
CALIBRATION = "sample_id string, validity string, validity_reason string"


def answer(spark, lengths, profiles, calibrations, unit="pixels", limit=None):
    rows = spark.createDataFrame(
        [(k, float(v)) for k, vs in lengths.items() for v in vs], "sample_id string, length_px double"
    )
    derived = ref.sample_reference(rows, limit=limit).withColumn("measurement_unit", F.lit(unit))
    found = ref.resolve_reference(
        derived,
        spark.createDataFrame(profiles, PROFILE),
        spark.createDataFrame(calibrations, CALIBRATION),
    )
    labelled = ref.classify_fragment(rows.join(found, "sample_id"))
    out = labelled.groupBy("sample_id", "reference_source", "reference_status", "reference_length").agg(
        *[F.count_if(F.col("broken_label") == w).alias(w) for w in ("whole", "broken", "undetermined")]
    )
    return {r["sample_id"]: r for r in out.collect()}


@pytest.mark.parametrize("limit", [None, 2])
def test_length_cases(spark, limit):
    """Both the one-shuffle form and the form for huge samples give the expected labels."""
    profiles = [
        (k, "px", "pixels", float(p), 30.0, 3.33, "Proxy", False, 30) for k, (_, p, *_) in CASES.items() if p
    ]
    got = answer(spark, {k: v[0] for k, v in CASES.items()}, profiles, [], limit=limit)
    for name, (_, _, whole, broken, undetermined, source, status) in CASES.items():
        row = got[name]
        assert (row["whole"], row["broken"], row["undetermined"]) == (whole, broken, undetermined), name
        assert (row["reference_source"], row["reference_status"]) == (source, status), name
    assert 99 <= got["D"]["reference_length"] <= 101


@pytest.mark.parametrize(
    "validity,expected", [("valid", (1, 3, 0)), ("invalid", (0, 0, 4)), ("unavailable", (0, 0, 4))]
)
def test_mm_profile_needs_valid_calibration(spark, validity, expected):
    profile = [("s", "mm", "mm", 6.8, 2.0, 3.4, "Measured", False, 30)]
    got = answer(spark, {"s": [4.2, 4.8, 5.0, 6.8]}, profile, [("s", validity, "why")], unit="mm")["s"]
    assert (got["whole"], got["broken"], got["undetermined"]) == expected


def test_invalid_profile_is_ignored(spark):
    profile = [("s", "mm", "mm", 6.8, 2.0, 3.4, "Measured", True, 1)]
    got = answer(spark, {"s": WHOLE}, profile, [("s", "valid", "")])["s"]
    assert got["reference_source"] == "sample_derived"


def test_shape_rule_for_uniform_samples(spark):
    rows = [("flat", 100.0, 60.0, 0.95), ("flat", 101.0, 60.0, 0.95), ("flat", 102.0, 60.0, 0.95)]
    rows += [("long", 50.0, 20.0, 0.9), ("long", 51.0, 20.0, 0.9), ("long", 52.0, 20.0, 0.9)]
    df = spark.createDataFrame(rows, "sample_id string, length_px double, b double, solidity double")
    for limit in (None, 1):
        out = ref.sample_reference(df, lb=R.lb_ratio("length_px", "b"), solidity="solidity", limit=limit)
        got = {r["sample_id"]: r["reference_length"] for r in out.collect()}
        assert got == {"flat": None, "long": 51.0}


def test_fragment_confidence_is_capped_by_quality(spark):
    df = spark.createDataFrame(
        [(50.0, "good"), (50.0, "limited"), (50.0, "poor"), (76.0, "good"), (20.0, "good")], "length_px double, q string"
    ).withColumns({"reference_length": F.lit(100.0), "reference_source": F.lit("profile"), "reference_status": F.lit("limited")})
    out = [tuple(r) for r in ref.classify_fragment(df, quality="q").select(
        "broken_label", "label_confidence", "is_small_broken", "label_reason").collect()]
    assert [r[1] for r in out] == [1.0, 0.75, 0.45, 0.65, 1.0]
    assert [r[2] for r in out] == [False, False, False, False, True]
    assert out[0][3] == "Length ratio 0.500 < threshold 0.75 against profile reference (100.0)"


def test_build_profile(spark):
    lengths = [6.7, 6.8, 6.9, 6.6, 7.0, 6.5, 6.9, 7.1, 6.8, 6.7]
    breadths = [2.0, 2.1, 1.9, 2.0, 2.2, 1.8, 2.0, 2.1, 1.9, 2.0]
    rows = [("ok", a, b) for a, b in zip(lengths, breadths)] + [("bad", 6.8, 2.0), ("bad", -1.0, 2.0)]
    rows += [("uneven", 6.8, 2.0), ("uneven", 6.9, None)]
    df = spark.createDataFrame(rows, "p string, length double, breadth double")
    got = {r["p"]: r for r in ref.build_profile(df, ["p"]).collect()}
    assert (got["ok"]["whole_kernel_length"], got["ok"]["reference_count"], got["ok"]["whole_kernel_lb_ratio"]) == (6.8, 10, 3.4)
    assert got["bad"]["message"] == "All length values must be positive finite numbers."
    assert got["uneven"]["message"] == "breadths_mm must have the same count as lengths_mm."


def test_calibration_and_scale(spark):
    rows = [(22.0, 4, "aruco"), (9999.0, 2, "aruco"), (None, 0, "none"), (22.0, 0, "aruco"), (float("nan"), 1, "manual"), (-1.0, 1, "manual")]
    df = spark.createDataFrame(rows, "p double, m int, mode string")
    got = [r[0] for r in df.select(R.calibration_validity("p", "m", "mode")["validity"]).collect()]
    assert got == ["valid", "invalid", "unavailable", "invalid", "invalid", "invalid"]
    one = df.limit(1).select(
        R.marker_scale(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (440.0, 0.0), (440.0, 440.0), (0.0, 440.0))])).alias("m"),
        R.manual_scale(F.lit(110.0), F.lit(5.0)).alias("k"),
    ).first()
    assert (one["m"], one["k"]) == (22.0, 22.0)
