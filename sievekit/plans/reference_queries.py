"""Registered queries on the reference hierarchy and the whole/broken decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import rules as R
from sievekit.operators import instances as I
from sievekit.operators import reference as ref
from sievekit.operators import validation as V
from sievekit.plans import testbed as T
from sievekit.plans.registry import query
from sievekit.session import checkpointed


def derived_cte(uniform_ok: str, source: str = "instances", length: str = "length_px") -> str:
    """SQL of the sample-derived reference; ``uniform_ok`` decides uniform samples."""
    return f"""
ref_stats AS (
  SELECT sample_id, count(*) AS n, min({length}) AS lo, max({length}) AS hi, median({length}) AS sample_median,
         median(length_px / breadth_px) AS med_lb, median(solidity) AS med_solidity
  FROM {source} GROUP BY sample_id),
ref_kind AS (
  SELECT *, CASE WHEN n < 3 THEN 'few' WHEN hi - lo < hi * 0.25 AND {uniform_ok} THEN 'uniform'
                 WHEN hi - lo < hi * 0.25 THEN 'undetermined' ELSE 'mixed' END AS kind,
         greatest(lo + (hi - lo) * 0.35, hi * 0.75) AS cutoff
  FROM ref_stats),
ref_pool AS (
  SELECT i.sample_id, i.{length} AS v, k.kind FROM {source} i JOIN ref_kind k ON i.sample_id = k.sample_id
  WHERE k.kind = 'uniform' OR (k.kind = 'mixed' AND i.{length} >= k.cutoff)),
ref_band AS (SELECT sample_id, count(*) AS pool_n, median(v) AS pool_median FROM ref_pool GROUP BY sample_id),
ref_kept AS (
  SELECT p.* FROM ref_pool p JOIN ref_band b ON p.sample_id = b.sample_id
  WHERE p.kind = 'uniform' OR b.pool_n < 3 OR (p.v >= b.pool_median * 0.85 AND p.v <= b.pool_median * 1.20)),
ref_found AS (
  SELECT sample_id, count(*) AS candidate_count, median(v) AS candidate_median, stddev_pop(v) / avg(v) AS cv
  FROM ref_kept GROUP BY sample_id),
derived AS (
  SELECT k.sample_id, k.n, k.sample_median, k.kind, k.hi, f.cv, coalesce(f.candidate_count, 0) AS found,
         CASE WHEN f.candidate_count >= 3 AND f.cv <= 0.15 THEN f.candidate_median END AS reference_length,
         CASE WHEN f.candidate_count >= 10 AND f.cv <= 0.15 THEN 'reliable'
              WHEN f.candidate_count >= 3 AND f.cv <= 0.15 THEN 'limited' ELSE 'undetermined' END AS reference_status,
         CASE WHEN f.candidate_count >= 3 AND f.cv <= 0.15 THEN f.candidate_count END AS candidate_count
  FROM ref_kind k LEFT JOIN ref_found f ON k.sample_id = f.sample_id)"""


LENGTHS_ONLY = derived_cte("hi >= 85")
WITH_SHAPE = derived_cte("med_lb >= 2.2 AND med_solidity >= 0.88")
R4 = "round_even({} * 10000, 0) / 10000"

LABELLED_CTE = """
labelled AS (
  SELECT i.*, d.reference_length, d.reference_status,
         i.length_px / d.reference_length AS ratio,
         CASE WHEN d.reference_length IS NULL THEN 'undetermined'
              WHEN i.length_px / d.reference_length < 0.75 THEN 'broken' ELSE 'whole' END AS broken_label
  FROM instances i JOIN derived d ON i.sample_id = d.sample_id)"""


def labelled(spark, sf_dir, ids: bool = False, shape: bool = False):
    """Instances with a whole/broken label from the sample's own reference."""
    inst = T.instances(spark, sf_dir, ids=ids, once=ids)
    extra = {"lb": R.lb_ratio("length_px", "breadth_px"), "solidity": "solidity"} if shape else {}
    found = ref.sample_reference(inst, **extra).select(
        "sample_id",
        "reference_length",
        "reference_status",
        F.when(F.col("reference_length").isNull(), "unavailable").otherwise("sample_derived").alias("reference_source"),
    )
    quality = R.measurement_quality(R.lb_ratio("length_px", "breadth_px"), "solidity", "area")
    return ref.classify_fragment(inst.join(found, "sample_id").withColumn("quality", quality), quality="quality")


@query(
    "fragment_summary",
    f"""WITH {T.INSTANCES_CTE}, {LENGTHS_ONLY}, {LABELLED_CTE}
SELECT sample_id, count(*) AS total_count,
  count(*) FILTER (WHERE broken_label = 'whole') AS whole_count,
  count(*) FILTER (WHERE broken_label = 'broken') AS broken_count,
  count(*) FILTER (WHERE broken_label = 'undetermined') AS undetermined_count,
  CASE WHEN count(*) FILTER (WHERE broken_label <> 'undetermined') > 0
       THEN round_even(count(*) FILTER (WHERE broken_label = 'broken') * 1.0::DOUBLE / count(*) * 100 * 100, 0) / 100 END AS broken_percent
FROM labelled GROUP BY sample_id""",
)
def fragment_summary(spark, sf_dir):
    return I.broken_summary(labelled(spark, sf_dir))


_DERIVED_OUT = f"""SELECT sample_id, n, {R4.format('sample_median')} AS sample_median,
  {R4.format('reference_length')} AS reference_length, reference_status, candidate_count,
  CASE WHEN reference_length IS NOT NULL THEN {R4.format('cv')} END AS candidate_cv,
  CASE WHEN kind = 'few' THEN 'few' WHEN kind = 'undetermined' THEN 'uniform'
       WHEN reference_length IS NOT NULL THEN NULL WHEN found < 3 THEN 'candidates' ELSE 'variance' END AS why
FROM derived"""


def _derived_view(df):
    why = (
        F.when(F.col("reason").startswith("Sample size"), "few")
        .when(F.col("reason").startswith("Uniform") | F.col("reason").startswith("Sample grains"), "uniform")
        .when(F.col("reason").startswith("Only"), "candidates")
        .when(F.col("reason").startswith("Candidate"), "variance")
    )
    return df.select(
        "sample_id",
        "n",
        R.rnd("sample_median", 4).alias("sample_median"),
        R.rnd("reference_length", 4).alias("reference_length"),
        "reference_status",
        "candidate_count",
        "candidate_cv",
        why.alias("why"),
    )


@query("sample_reference", f"WITH {T.INSTANCES_CTE}, {LENGTHS_ONLY} {_DERIVED_OUT}")
def sample_reference(spark, sf_dir):
    return _derived_view(ref.sample_reference(T.instances(spark, sf_dir)))


@query("sample_reference_shape", f"WITH {T.INSTANCES_CTE}, {WITH_SHAPE} {_DERIVED_OUT}")
def sample_reference_shape(spark, sf_dir):
    inst = T.instances(spark, sf_dir)
    return _derived_view(
        ref.sample_reference(inst, lb=R.lb_ratio("length_px", "breadth_px"), solidity="solidity")
    )


_SMALL = derived_cte("hi >= 85", source="by_order")


@query(
    "sample_reference_few",
    f"""WITH {T.INSTANCES_CTE},
by_order AS (SELECT l_orderkey AS sample_id, length_px, breadth_px, solidity FROM instances), {_SMALL} {_DERIVED_OUT}""",
)
def sample_reference_few(spark, sf_dir):
    """The same operator on tiny groups: one order is one sample."""
    inst = T.instances(spark, sf_dir).drop("sample_id").withColumnRenamed("l_orderkey", "sample_id")
    return _derived_view(ref.sample_reference(inst))


_VALIDITY = """CASE WHEN mode = 'none' OR pixels_per_mm IS NULL THEN 'unavailable'
  WHEN marker_count <= 0 THEN 'invalid'
  WHEN pixels_per_mm < 0.1 OR pixels_per_mm > 500 THEN 'invalid' ELSE 'valid' END"""
_RESOLVED_CTE = f"""
checked AS (SELECT *, {_VALIDITY} AS validity FROM calibrations),
facts AS (
  SELECT d.*, p.reference_unit AS profile_unit, p.whole_kernel_length AS wl, p.production_eligible, p.reference_count,
         p.profile_name, p.data_status, c.mode, c.validity, CASE WHEN c.validity = 'valid' THEN 'mm' ELSE 'pixels' END AS measurement_unit,
         p.whole_kernel_length > 0 AND p.whole_kernel_lb_ratio > 0 AND p.data_status <> 'Guessed'
           AND NOT (p.reference_unit = 'mm' AND p.production_eligible AND p.reference_count < 3) AS usable
  FROM derived d LEFT JOIN profiles p ON d.sample_id = p.sample_id LEFT JOIN checked c ON d.sample_id = c.sample_id),
tiers AS (
  SELECT *, CASE WHEN usable AND profile_unit = 'mm' AND validity = 'valid' THEN 'mm'
    WHEN usable AND profile_unit = 'mm' THEN 'mm_blocked'
    WHEN usable AND profile_unit = 'pixels' AND (measurement_unit <> 'pixels' OR n < 3
      OR (wl / sample_median >= 0.3 AND wl / sample_median <= 3.0)) THEN 'px' ELSE 'derived' END AS tier
  FROM facts),
resolved AS (
  SELECT sample_id, n,
    CASE WHEN tier IN ('mm', 'px') THEN wl WHEN tier = 'derived' THEN reference_length END AS reference_length,
    CASE WHEN tier IN ('mm', 'px') THEN 'profile' WHEN tier = 'derived' AND reference_length IS NOT NULL
      THEN 'sample_derived' ELSE 'unavailable' END AS reference_source,
    CASE WHEN tier = 'mm' THEN 'reliable' WHEN tier = 'px' THEN 'limited'
      WHEN tier = 'derived' AND reference_length IS NOT NULL THEN reference_status ELSE 'undetermined' END AS reference_status,
    CASE WHEN tier = 'derived' THEN measurement_unit ELSE profile_unit END AS reference_unit,
    CASE WHEN tier = 'mm' THEN true WHEN tier IN ('px', 'mm_blocked') THEN production_eligible ELSE false END AS production_eligible,
    CASE WHEN tier IN ('mm', 'px') THEN CAST(reference_count AS BIGINT)
      WHEN tier = 'derived' AND reference_length IS NOT NULL THEN candidate_count END AS reference_count,
    validity AS calibration_validity, CASE WHEN tier <> 'derived' THEN profile_name END AS profile_name,
    CASE WHEN tier IN ('mm', 'px') THEN concat('table of ', profile_name) END AS profile_source,
    CASE WHEN tier <> 'derived' THEN data_status WHEN reference_length IS NOT NULL THEN 'Sample-Derived' END AS reference_data_status,
    CASE WHEN mode <> 'none' THEN mode ELSE 'unavailable' END AS calibration_status
  FROM tiers)"""


def resolved(spark, sf_dir):
    derived = ref.sample_reference(T.instances(spark, sf_dir))
    cal = T.calibrations(spark, sf_dir).withColumn(
        "_v", R.calibration_validity("pixels_per_mm", "marker_count", "mode")
    )
    cal = cal.select("sample_id", F.col("_v.validity").alias("validity"), F.col("_v.reason").alias("validity_reason"), "mode")
    unit = cal.select(
        "sample_id", F.when(F.col("validity") == "valid", "mm").otherwise("pixels").alias("measurement_unit")
    )
    profiles = T.profiles(spark, sf_dir).withColumn("source", F.concat(F.lit("table of "), "profile_name"))
    return ref.resolve_reference(derived.join(unit, "sample_id"), profiles, cal)


_RESOLVED_OUT = f"""SELECT sample_id, {R4.format('reference_length')} AS reference_length, reference_source, reference_status,
  reference_unit, production_eligible, reference_count, calibration_validity, profile_name, profile_source, reference_data_status, calibration_status
FROM resolved"""


@query(
    "resolve_reference",
    f"WITH {T.INSTANCES_CTE}, {T.DIMENSIONS_CTE}, {LENGTHS_ONLY}, {_RESOLVED_CTE} {_RESOLVED_OUT}",
)
def resolve_reference(spark, sf_dir):
    return resolved(spark, sf_dir).select(
        "sample_id",
        R.rnd("reference_length", 4).alias("reference_length"),
        "reference_source",
        "reference_status",
        "reference_unit",
        "production_eligible",
        "reference_count",
        "calibration_validity",
        "profile_name",
        "profile_source",
        "reference_data_status",
        "calibration_status",
    )


@query(
    "classify_fragment",
    f"""WITH {T.INSTANCES_CTE}, {LENGTHS_ONLY}, {LABELLED_CTE},
scored AS (SELECT *, CASE WHEN area < 100 THEN 0.75 ELSE 1.0 END AS cap FROM labelled)
SELECT sample_id, broken_label, count(*) AS n, count(*) FILTER (WHERE ratio < 0.25) AS small_n,
  {R4.format('min(ratio)')} AS min_ratio, {R4.format('max(ratio)')} AS max_ratio,
  max(CASE WHEN ratio IS NULL THEN 0.0 ELSE {R4.format('least(1.0, abs(ratio - 0.75) / 0.20 + 0.60)')} END) AS max_confidence
FROM scored GROUP BY sample_id, broken_label""",
)
def classify_fragment(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rows.groupBy("sample_id", "broken_label").agg(
        F.count("*").alias("n"),
        F.count_if("is_small_broken").alias("small_n"),
        F.min("length_ratio").alias("min_ratio"),
        F.max("length_ratio").alias("max_ratio"),
        F.max("label_confidence").alias("max_confidence"),
    )


@query(
    "calibration_validity",
    f"""WITH {T.DIMENSIONS_CTE}
SELECT sample_id, {_VALIDITY} AS validity,
  CASE WHEN mode = 'none' OR pixels_per_mm IS NULL THEN 'No calibration reference detected in this image.'
    WHEN marker_count <= 0 THEN 'Calibration claimed but no valid markers were detected.'
    WHEN pixels_per_mm > 500 THEN 'Calibration scale 9999.00 px/mm is outside sanity bounds [0.1, 500.0] px/mm.'
    ELSE '' END AS reason
FROM calibrations""",
)
def calibration_validity(spark, sf_dir):
    cal = T.calibrations(spark, sf_dir)
    return cal.withColumn("_v", R.calibration_validity("pixels_per_mm", "marker_count", "mode")).select(
        "sample_id", "_v.validity", "_v.reason"
    )


@query(
    "manual_scale",
    """SELECT p_partkey AS sample_id, CASE WHEN p_size > 3 AND p_size % 6 > 0
  THEN round_even((p_size - 3) * 10.0 / (p_size % 6) * 10000, 0) / 10000 END AS pixels_per_mm FROM part""",
)
def manual_scale(spark, sf_dir):
    part = T.table(spark, sf_dir, "part")
    px, mm = (F.col("p_size") - 3) * 10.0, F.col("p_size") % 6
    return part.select(
        F.col("p_partkey").alias("sample_id"), R.rnd(R.manual_scale(px, mm), 4).alias("pixels_per_mm")
    )


@query(
    "marker_scale",
    """SELECT p_partkey AS sample_id,
  round_even((sqrt((40.0 + p_size) * (40.0 + p_size)) + sqrt(5.0 * 5 + 30 * 30) + sqrt((42.0 + p_size) * (42.0 + p_size) + 9.0 * 9)
    + sqrt(3.0 * 3 + (30.0 + 9) * (30 + 9))) / 4 / 20 * 10000, 0) / 10000 AS pixels_per_mm
FROM part""",
)
def marker_scale(spark, sf_dir):
    side = F.col("p_size") + 40.0
    corners = F.array(
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        F.struct(side.alias("x"), F.lit(0.0).alias("y")),
        F.struct((side + 5.0).alias("x"), F.lit(30.0).alias("y")),
        F.struct(F.lit(3.0).alias("x"), F.lit(39.0).alias("y")),
    )
    return T.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sample_id"), R.rnd(R.marker_scale(corners), 4).alias("pixels_per_mm")
    )


@query(
    "validate_profile",
    f"""WITH {T.DIMENSIONS_CTE}
SELECT sample_id, CASE WHEN whole_kernel_lb_ratio <= 0 THEN 'Invalid whole_kernel_lb_ratio -1.0, must be > 0'
  WHEN data_status = 'Guessed' THEN 'Invalid data_status ''Guessed'''
  WHEN reference_unit = 'mm' AND production_eligible AND reference_count < 3
    THEN concat('Production-eligible measured mm profile requires reference_count >= 3 (got ', CAST(reference_count AS STRING), ').')
  ELSE 'Valid' END AS message
FROM profiles""",
)
def validate_profile(spark, sf_dir):
    return T.profiles(spark, sf_dir).select("sample_id", ref.profile_verdict()["message"].alias("message"))


@query(
    "build_profile",
    """WITH m AS (
  SELECT l_suppkey, 5 + l_quantity * 0.0625 AS len, 1.5 + l_linenumber * 0.125 AS brd FROM lineitem)
SELECT l_suppkey AS profile, count(*) AS reference_count,
  round_even(avg(len) * 1000, 0) / 1000 AS whole_kernel_length, round_even(stddev_pop(len) * 1000, 0) / 1000 AS std_length,
  round_even(stddev_pop(len) / avg(len) * 10000, 0) / 10000 AS cv_length,
  round_even(avg(brd) * 1000, 0) / 1000 AS whole_kernel_breadth,
  round_even(avg(len) / avg(brd) * 1000, 0) / 1000 AS whole_kernel_lb_ratio,
  'mm' AS reference_unit, 'Measured' AS data_status, 'Valid' AS message
FROM m GROUP BY l_suppkey""",
)
def build_profile(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS profile", "5 + l_quantity * 0.0625 AS length", "1.5 + l_linenumber * 0.125 AS breadth"
    )
    return ref.build_profile(rows, ["profile"])


# --- scenarios and truth ----------------------------------------------------

MODES = (
    # mode, profile length, unit, calibration validity
    ("no_profile", None, None, "unavailable"),
    ("with_legacy_profile", 154.125, "pixels", "unavailable"),
    ("physical_profile_valid_calibration", 6.8125, "mm", "valid"),
    ("physical_profile_invalid_calibration", 6.8125, "mm", "invalid"),
    ("physical_profile_unavailable_calibration", 6.8125, "mm", "unavailable"),
)
_MODES_SQL = ", ".join(
    f"('{m}', {'CAST(NULL AS DOUBLE)' if v is None else v}, {'NULL' if u is None else repr(u)}, '{c}')"
    for m, v, u, c in MODES
)
_SCENARIO_CTE = f"""
modes AS (SELECT * FROM (VALUES {_MODES_SQL}) t(mode, wl, unit, validity)),
scen AS (
  SELECT d.sample_id, d.n, m.mode, CASE
    WHEN m.unit = 'mm' AND m.validity = 'valid' THEN m.wl
    WHEN m.unit = 'pixels' AND (d.n < 3 OR (m.wl / d.sample_median >= 0.3 AND m.wl / d.sample_median <= 3.0)) THEN m.wl
    WHEN m.unit = 'mm' THEN NULL ELSE d.reference_length END AS reference_length,
    CASE WHEN m.unit = 'mm' AND m.validity = 'valid' THEN 22.0 ELSE 1.0 END AS scale
  FROM derived d CROSS JOIN modes m),
scen_counts AS (
  SELECT s.sample_id, s.mode, count(*) AS detected_total,
    count(*) FILTER (WHERE i.length_px / s.scale / s.reference_length >= 0.75) AS whole_count,
    count(*) FILTER (WHERE i.length_px / s.scale / s.reference_length < 0.75) AS broken_count,
    count(*) FILTER (WHERE s.reference_length IS NULL) AS undetermined_count
  FROM scen s JOIN instances i ON s.sample_id = i.sample_id GROUP BY s.sample_id, s.mode)"""


def scenario_counts(spark, sf_dir):
    """Counts per sample and mode. The five modes multiply the small per-sample table first."""
    inst = T.instances(spark, sf_dir)
    derived = checkpointed(ref.sample_reference(inst))  # per sample, read once per use below
    grid = ref.run_scenarios(
        derived, MODES, "mode string, whole_kernel_length double, reference_unit string, validity string"
    )
    facts = grid.select(
        "sample_id", "mode", "n", "sample_median", "reference_length", "reference_status", "candidate_count",
        "reason", F.when(F.col("validity") == "valid", "mm").otherwise("pixels").alias("measurement_unit"),
    )
    prof = grid.where("whole_kernel_length IS NOT NULL").select(
        "sample_id", "mode", "whole_kernel_length", "reference_unit",
        F.col("mode").alias("profile_name"), F.lit(2.0).alias("whole_kernel_breadth"),
        F.lit(3.5).alias("whole_kernel_lb_ratio"), F.lit("Measured").alias("data_status"),
        (F.col("reference_unit") == "mm").alias("production_eligible"), F.lit(30).alias("reference_count"),
    )
    cal = grid.select("sample_id", "mode", "validity", F.lit("").alias("validity_reason"))
    found = ref.resolve_reference(facts, prof, cal, by=("sample_id", "mode")).select(
        "sample_id", "mode", "reference_length", "reference_source", "reference_status",
        F.when((F.col("calibration_validity") == "valid"), 22.0).otherwise(1.0).alias("scale"),
    )
    rows = inst.select("sample_id", "length_px").join(found, "sample_id")
    rows = ref.classify_fragment(rows, length=F.col("length_px") / F.col("scale"))
    return rows.groupBy("sample_id", "mode").agg(
        F.count("*").alias("detected_total"),
        F.count_if(F.col("broken_label") == "whole").alias("whole_count"),
        F.count_if(F.col("broken_label") == "broken").alias("broken_count"),
        F.count_if(F.col("broken_label") == "undetermined").alias("undetermined_count"),
    )


@query(
    "run_scenarios",
    f"""WITH {T.INSTANCES_CTE}, {LENGTHS_ONLY}, {_SCENARIO_CTE} SELECT * FROM scen_counts""",
)
def run_scenarios(spark, sf_dir):
    return scenario_counts(spark, sf_dir)


@query(
    "compare_truth",
    f"""WITH {T.INSTANCES_CTE}, {T.DIMENSIONS_CTE},
s AS (SELECT sample_id, count(*) AS detected FROM instances WHERE category_id = 1 GROUP BY sample_id)
SELECT t.sample_id, CAST(t.expected_total AS BIGINT) AS expected_total, s.detected,
  s.detected - t.expected_total AS count_difference,
  CASE WHEN s.detected IS NULL THEN 'ERROR' WHEN s.detected = t.expected_total THEN 'MATCH'
    WHEN s.detected < t.expected_total THEN 'UNDER-DETECTED' ELSE 'OVER-DETECTED' END AS verdict
FROM truth t LEFT JOIN s ON t.sample_id = s.sample_id""",
)
def compare_truth(spark, sf_dir):
    found = T.instances(spark, sf_dir).where("category_id = 1").groupBy("sample_id").agg(F.count("*").alias("detected"))
    return V.compare_truth(found, T.truth(spark, sf_dir)).select(
        "sample_id", F.col("expected_total").cast("long").alias("expected_total"), "detected", "count_difference", "verdict"
    )


_PIVOT = ", ".join(
    f"max(broken_count) FILTER (WHERE mode = '{m[0]}') AS {m[0]}" for m in MODES
)


@query(
    "scenario_pivot",
    f"""WITH {T.INSTANCES_CTE}, {LENGTHS_ONLY}, {_SCENARIO_CTE} SELECT sample_id, {_PIVOT} FROM scen_counts GROUP BY sample_id""",
)
def scenario_pivot(spark, sf_dir):
    return V.scenario_pivot(scenario_counts(spark, sf_dir), [m[0] for m in MODES], "broken_count")
