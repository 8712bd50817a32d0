"""Documents, reference documents and the pieces that hold sample invariants."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sievekit.functions import rules as R
from sievekit.functions import scores as P
from sievekit.operators import instances as I
from sievekit.operators import limits as LM
from sievekit.plans import testbed as T
from sievekit.plans.reference_queries import labelled
from sievekit.sources import reference_data as RD
from sievekit.sources import sinks as SK

SF = "/root/testdata/sf0.001"


def test_labels_add_up(spark):
    out = I.sample_summary(labelled(spark, SF).selectExpr(*T.LABEL_COLS))
    assert out.where("whole_count + broken_count + undetermined_count <> total_count").count() == 0
    assert out.where("(broken_analyzed_count = 0) <> (broken_percent IS NULL)").count() == 0


def test_ids_are_dense(spark):
    rows = T.instances(spark, SF, ids=True)
    bad = rows.groupBy("sample_id").agg(F.count("*").alias("n"), F.max("grain_id").alias("m"), F.count_distinct("grain_id").alias("d"))
    assert bad.where("n <> m OR n <> d").count() == 0


def test_document_round_trip_in_parts(spark):
    grains = spark.createDataFrame([("s", i, float(i)) for i in range(1, 26)], "sample_id string, grain_id long, v double")
    foreign = spark.createDataFrame([("s", 1, 5), ("t", 1, 6)], "sample_id string, foreign_id long, area int")
    summary = spark.createDataFrame([("s", 25), ("t", 0), ("u", 0)], "sample_id string, total int")
    docs = SK.assemble_document(grains, foreign, summary, fields=("grain_id", "v"), part_size=10)
    sizes = {(r["sample_id"], r["part"]): len(r["grains"]) for r in docs.collect()}
    assert sizes == {("s", 0): 10, ("s", 1): 10, ("s", 2): 5, ("t", 0): 0, ("u", 0): 0}
    flat = SK.flatten_document(docs)
    assert sorted(r["grain_id"] for r in flat.where("sample_id = 's'").collect()) == list(range(1, 26))
    assert flat.where("sample_id = 'u'").count() == 1  # kept, without a grain


def test_profiles_and_limits_from_files(spark, tmp_path):
    (tmp_path / "mine.json").write_text(json.dumps({"whole_kernel_length": 154.1, "reference_count": 50}))
    row = RD.load_profiles(spark, str(tmp_path / "mine.json")).first()
    assert (row["profile_name"], row["reference_unit"], row["source"], row["verdict"]["ok"]) == ("mine", "pixels", "file:mine.json", True)
    doc = {
        "_metadata": {"season": "x"},
        "grade_a": {"broken": {"max_percent": 25.0, "basis": "weight", "notes": "n"}, "foreign_matter": {"max_percent": 0.5, "sub_limits": {"mineral_matter": {"max_percent": 0.2, "basis": "weight"}}}},
        "common": {"admixture_of_lower_class": {"max_percent": None, "basis": "weight"}},
        "image_assessment_mapping": {"_description": "t", "broken": {"image_assessable": True, "image_basis": "count", "limitation": "l"}},
    }
    out = RD.flatten_limits(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    got = {(r["grade"], r["parameter"], r["sub_parameter"]): (r["max_percent"], r["image_assessable"]) for r in out.collect()}
    assert got == {
        ("grade_a", "broken", None): (25.0, "true"),
        ("grade_a", "foreign_matter", None): (0.5, "false"),
        ("grade_a", "foreign_matter", "mineral_matter"): (0.2, "false"),
        ("common", "admixture_of_lower_class", None): (None, "false"),
    }


def test_screening_suppression(spark):
    rows = [("ok", 40, "GOOD", 30.0, 12, 40), ("few", 10, "GOOD", 30.0, 3, 10), ("blur", 40, "POOR", 1.0, 1, 40), ("none", 40, "FAIR", None, 0, 0)]
    cols = "sample_id string, total_count long, quality_level string, broken_percent double, broken_count long, broken_analyzed_count long"
    out = LM.screen_limits(spark.createDataFrame(rows, cols), T.limits(spark), grade="common")
    got = {(r["sample_id"], r["parameter"]): r for r in out.collect()}
    assert got["ok", "broken"]["status"] == "EXCEEDS REFERENCE LIMIT" and got["ok", "broken"]["difference"] == 5.0
    assert got["ok", "broken"]["observed_value"] == "12 / 40 (30.00%)"
    assert got["few", "broken"]["status"] == got["blur", "broken"]["status"] == "NOT DETERMINABLE"
    assert got["none", "broken"]["status"] == "NOT ASSESSABLE"
    assert got["ok", "dehusked"]["status"] == "NOT ASSESSABLE"
    assert got["ok", "admixture_of_lower_class"]["status"] == "NOT APPLICABLE"
    verdicts = {r["sample_id"]: r["image_screening_verdict"] for r in LM.screening_verdict(out).collect()}
    assert verdicts["ok"].startswith("Exceeds") and verdicts["few"] == verdicts["blur"] == "Not determinable from this sample"
    assert verdicts["none"] == "Insufficient data for screening"


def test_class_choice(spark):
    df = spark.createDataFrame([([0.3, 0.7],), ([0.65, 0.35],)], "p array<double>")
    names = F.array(F.lit("not sprouted"), F.lit("Weevilled"))
    out = df.select(P.threshold_classify("p", P.class_index(names, "sprouted_weevilled"), P.class_index(names, "normal")).alias("d"))
    assert [tuple(r["d"]) for r in out.collect()] == [(2, 0.7, "moderate"), (1, 0.65, "low")]


def test_event_time_drops_the_offset(spark):
    texts = {
        "2026-10-08T12:00:00+05:30": "2026-10-08 12:00:00", "2026-10-08T12:00:00.5Z": "2026-10-08 12:00:00",
        "2026-10-08T12:00:00": None, "2026-10-08 12:00:00Z": None, "": None, "2026-13-08T12:00:00Z": None,
    }
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", F.date_format(R.event_time("t"), "yyyy-MM-dd HH:mm:ss")).collect()}
    assert got == texts
    assert spark.range(1).select(R.ist_label(F.lit(None).cast("timestamp"))).first()[0] == "N/A"


def test_rounding_is_half_even_and_small_rules(spark):
    one = spark.range(1).select(
        R.rnd(F.lit(3.125)).alias("a"), R.safe_percent(F.lit(1), F.lit(32)).alias("b"), R.safe_percent(F.lit(1), F.lit(0)).alias("c"),
        R.effective_length(F.lit(0.0), F.lit(4.0), F.lit(6.0)).alias("d"), R.ramp(F.lit(5.0), 10.0, 0.0).alias("e"),
        F.size(R.thin_points(F.sequence(F.lit(1), F.lit(95)))).alias("f"),
    ).first()
    assert tuple(one) == (3.12, 3.12, 0.0, 5.0, 0.5, 32)
