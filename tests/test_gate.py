"""Statuses of the target gate, merged detections, class maps, and where a reference comes from."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.fixed import GATE_MESSAGES
from sievekit.operators import instances as I
from sievekit.operators import reference as ref


def test_gate_statuses(spark):
    found = spark.createDataFrame(
        [("a", True, 0.75), ("a", False, 0.9), ("b", False, 0.3), ("c", True, 0.5), ("d", True, 0.5), (None, True, 0.25)]
        + [("e", i == 0, 0.5) for i in range(30)],
        "sample_id string, is_target boolean, confidence double",
    )
    samples = spark.createDataFrame(
        [("a", True, 3), ("b", True, 0), ("c", True, 0), ("d", False, 5), ("e", None, None), ("none", True, 1), (None, True, 1)],
        "sample_id string, has_target_class boolean, analysable_count int",
    )
    got = {r["sample_id"]: r for r in I.gate_rollup(found, samples=samples).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "a": "RICE", "b": "NOT_RICE", "c": "NO_ANALYSABLE_RICE", "d": "NO_RICE_CLASS", "e": "RICE", "none": "NOT_RICE", None: "RICE",
    }
    assert all(r["message"] == GATE_MESSAGES[r["status"]] and r["analysis_stopped"] == (r["status"] != "RICE") for r in got.values())
    assert (got["none"]["total_detections"], got["none"]["target_fraction"], got["none"]["confidence_max"]) == (0, 0.0, 0.0)
    assert (got["d"]["total_detections"], got["d"]["reason"]) == (0, "no_rice_class_detections")
    assert (got["c"]["reason"], got["e"]["reason"]) == ("rice_detected", "low_object_rice_fraction_warning")
    assert (got["a"]["confidence_mean"], got["a"]["foreign_detections"]) == (0.75, 1)
    plain = {r["sample_id"]: r["status"] for r in I.gate_rollup(found).collect()}
    assert plain == {"a": "RICE", "b": "NOT_RICE", "c": "RICE", "d": "RICE", "e": "RICE", None: "RICE"}
    assert I.gate_rollup(found.limit(0), samples=samples.select("sample_id")).where("status = 'NOT_RICE'").count() == 7


def test_merged_count(spark):
    rows = [("s", "grain", "LOW", True), ("s", "grain", "HIGH", None), ("s", "foreign", "LOW", True), ("s", "grain", "HIGH", True)]
    df = spark.createDataFrame(rows, "sample_id string, route string, confidence_band string, is_touching boolean")
    r = I.detection_counts(df).first()
    assert (r["grain_count"], r["foreign_count"], r["uncertain_count"], r["merged_count"]) == (3, 1, 1, 2)


def test_reference_names_its_source(spark):
    lengths = spark.createDataFrame(
        [(k, float(v)) for k in ("mm", "blocked", "px", "own") for v in (90, 95, 100, 105, 50)], "sample_id string, length_px double"
    )
    derived = ref.sample_reference(lengths).withColumn("measurement_unit", F.lit("pixels"))
    profile = "sample_id string, profile_name string, reference_unit string, whole_kernel_length double, whole_kernel_lb_ratio double, whole_kernel_breadth double, data_status string, production_eligible boolean, reference_count int, source string"
    profiles = [
        ("mm", "p1", "mm", 6.8, 3.4, 2.0, "Measured", True, 30, "lab"), ("blocked", "p2", "mm", 6.8, 3.4, 2.0, "Measured", True, 30, "lab"),
        ("px", "p3", "pixels", 100.0, 3.3, 30.0, "Proxy", False, 5, "demo"),
    ]
    cal = [("mm", "valid", "", "aruco"), ("blocked", "invalid", "why", "manual"), ("px", "unavailable", "", "none")]
    found = ref.resolve_reference(
        derived, spark.createDataFrame(profiles, profile),
        spark.createDataFrame(cal, "sample_id string, validity string, validity_reason string, mode string"),
    )
    names = ("profile_name", "profile_source", "reference_data_status", "calibration_status")
    got = {r["sample_id"]: tuple(r[n] for n in names) for r in found.collect()}
    assert got["mm"] == ("p1", "lab", "Measured", "aruco")
    assert got["blocked"] == ("p2", None, "Measured", "manual")
    assert got["px"] == ("p3", "demo", "Proxy", "unavailable")
    assert got["own"][0] is None and got["own"][3] == "unavailable"
