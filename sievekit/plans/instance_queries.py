"""Registered queries on instances, detections, the gate, limits and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.fixed import DEFECT_LABELS, GATE_FEATURES, GATE_MESSAGES, SCREENED
from sievekit.functions import colour as C
from sievekit.functions import rules as R
from sievekit.functions import scores as P
from sievekit.operators import instances as I
from sievekit.operators import limits as LM
from sievekit.plans import testbed as T
from sievekit.plans.reference_queries import LABELLED_CTE, LENGTHS_ONLY, labelled
from sievekit.plans.registry import query
from sievekit.session import scratch_path
from sievekit.sources import reference_data as RD

INST = f"WITH {T.INSTANCES_CTE}"


def r(expr: str, digits: int = 4) -> str:
    k = 10**digits
    return f"round_even(({expr}) * {k}, 0) / {k}"


# --- scalar rules -----------------------------------------------------------

_QUALITY = """CASE WHEN length_px / bq > 10 OR sq < 0.5 OR aq < 20 THEN 'unreliable'
  WHEN aq < 25 THEN 'poor' WHEN aq < 100 THEN 'limited' ELSE 'good' END"""
_QUALITY_COLS = (
    "*",
    "CASE WHEN l_suppkey % 11 = 0 THEN 4.0 ELSE breadth_px END AS bq",
    "CASE WHEN l_linenumber = 3 THEN 0.375 ELSE solidity END AS sq",
    "CAST(l_quantity * (1 + l_suppkey % 9) AS DOUBLE) AS aq",
)


@query(
    "measurement_quality",
    f"""{INST}, q AS (SELECT {', '.join(_QUALITY_COLS)} FROM instances)
SELECT sample_id, {_QUALITY} AS quality, count(*) AS n, count(*) FILTER (WHERE length_px / bq > 10) AS long_n,
  CAST(sum(CAST(length_px / bq > 10 AS INT) + CAST(sq < 0.5 AS INT) + CAST(aq < 20 AS INT)) AS BIGINT) AS reasons_n
FROM q GROUP BY ALL""",
)
def measurement_quality(spark, sf_dir):
    rows = T.instances(spark, sf_dir).selectExpr(*_QUALITY_COLS).withColumn("lb", R.lb_ratio("length_px", "bq"))
    reasons = R.anomaly_reasons("lb", "sq", "aq")
    rows = rows.select(
        "sample_id",
        R.measurement_quality("lb", "sq", "aq").alias("quality"),
        reasons.alias("reasons"),
    )
    return rows.groupBy("sample_id", "quality").agg(
        F.count("*").alias("n"),
        F.count_if(F.exists("reasons", lambda t: t.startswith("Extreme"))).alias("long_n"),
        F.sum(F.size("reasons")).cast("long").alias("reasons_n"),
    )


@query(
    "anomaly_reasons",
    f"""{INST}, q AS (SELECT {', '.join(_QUALITY_COLS)} FROM instances)
SELECT reason, count(*) AS n FROM (
  SELECT printf('Very low solidity: %.3f', sq) AS reason FROM q WHERE sq < 0.5
  UNION ALL SELECT printf('Very small area: %.0f px', aq) FROM q WHERE aq < 20
  UNION ALL SELECT printf('Extreme L/B ratio: %.2f', length_px / bq) FROM q WHERE length_px / bq > 10)
GROUP BY reason""",
)
def anomaly_reasons(spark, sf_dir):
    rows = T.instances(spark, sf_dir).selectExpr(*_QUALITY_COLS)
    reasons = R.anomaly_reasons(R.lb_ratio("length_px", "bq"), "sq", "aq")
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "metric_lengths",
    f"""{INST}, {T.DIMENSIONS_CTE},
m AS (
  SELECT i.*, CASE WHEN c.mode <> 'none' AND c.marker_count > 0 AND c.pixels_per_mm BETWEEN 0.1 AND 500
      THEN c.pixels_per_mm END AS ppmm FROM instances i JOIN calibrations c ON i.sample_id = c.sample_id)
SELECT sample_id, ppmm IS NOT NULL AS metric, count(*) AS n, {r('max(length_px / ppmm)')} AS max_length_mm,
  {r('max(coalesce(length_px * 0.9375 / ppmm, length_px / ppmm, length_px * 0.9375))')} AS max_decision,
  {r('min(coalesce(breadth_px / ppmm, breadth_px))')} AS min_display, {r('max(length_px / breadth_px)')} AS max_lb
FROM m GROUP BY ALL""",
)
def metric_lengths(spark, sf_dir):
    cal = T.calibrations(spark, sf_dir).select(
        "sample_id",
        "pixels_per_mm",
        R.calibration_validity("pixels_per_mm", "marker_count", "mode")["validity"].alias("validity"),
    )
    rows = T.instances(spark, sf_dir).join(cal, "sample_id")
    eff = F.col("length_px") * 0.9375
    rows = rows.withColumns(
        {
            "length_mm": R.to_metric("length_px", "pixels_per_mm", "validity"),
            "breadth_mm": R.to_metric("breadth_px", "pixels_per_mm", "validity"),
            "eff_mm": R.to_metric(eff, "pixels_per_mm", "validity"),
        }
    )
    return rows.groupBy("sample_id", (F.col("validity") == "valid").alias("metric")).agg(
        F.count("*").alias("n"),
        R.rnd(F.max("length_mm"), 4).alias("max_length_mm"),
        R.rnd(F.max(R.decision_length("eff_mm", "length_mm", eff)), 4).alias("max_decision"),
        R.rnd(F.min(R.display_length("breadth_mm", "breadth_px")), 4).alias("min_display"),
        R.rnd(F.max(R.aspect_ratio("length_px", "breadth_px")), 4).alias("max_lb"),
    )


@query(
    "effective_length",
    f"""{INST}, cand AS (
  SELECT sample_id, l_suppkey, length_px AS a, CASE WHEN l_linenumber = 2 THEN 0 ELSE length_px + breadth_px / 8 END AS b,
    CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE length_px - 6 END AS d FROM instances)
SELECT sample_id, {r("max(list_aggregate(list_filter([a, b, d], lambda v: v > 0), 'median'))")} AS longest,
  {r("sum(list_aggregate(list_filter([a, b, d], lambda v: v > 0), 'median'))")} AS total
FROM cand GROUP BY sample_id""",
)
def effective_length(spark, sf_dir):
    b = F.when(F.col("l_linenumber") == 2, 0.0).otherwise(F.col("length_px") + F.col("breadth_px") / 8)
    d = F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(F.col("length_px") - 6)
    rows = T.instances(spark, sf_dir).select("sample_id", R.effective_length("length_px", b, d).alias("v"))
    return rows.groupBy("sample_id").agg(
        R.rnd(F.max("v"), 4).alias("longest"), R.rnd(F.sum("v"), 4).alias("total")
    )


@query(
    "confidence_band",
    f"""{INST} SELECT CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  CASE WHEN confidence >= 0.8 THEN 'excellent' WHEN confidence >= 0.5 THEN 'good' ELSE 'poor' END AS quality,
  count(*) AS n FROM instances GROUP BY ALL""",
)
def confidence_band(spark, sf_dir):
    band = R.confidence_band("confidence")
    rows = T.instances(spark, sf_dir).select(band.alias("band"), R.band_quality(band).alias("quality"))
    return rows.groupBy("band", "quality").agg(F.count("*").alias("n"))


@query(
    "sanitize_name",
    r"""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.\-]', '_', 'g') AS name,
  trim(split_part(split_part(regexp_replace(url, '[/?]', ' ', 'g'), ' ', 3), '.', 1)) AS sample_key,
  CASE WHEN regexp_replace(regexp_replace(lower(trim(split_part(url, '/', 4))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')
    IN ('no', 'clean', 'normal') THEN 'normal' END AS label FROM pages""",
)
def sanitize_name(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages")
    spaced = F.split_part(F.regexp_replace("url", "[/?]", " "), F.lit(" "), F.lit(3))
    return pages.select(
        "page_id",
        R.sanitize_name("url").alias("name"),
        R.sample_key(spaced).alias("sample_key"),
        R.normalize_label(F.split_part("url", F.lit("/"), F.lit(4))).alias("label"),
    )


@query(
    "normalize_label",
    r"""SELECT label, count(*) AS n FROM (
  SELECT CASE WHEN s IN ('normal', 'no', 'clean', 'not_sprouted', 'not_weevilled') THEN 'normal'
    WHEN s IN ('sprouted_weevilled', 'sprouted', 'weevilled', 'yes', 'positive') THEN 'sprouted_weevilled' END AS label
  FROM (SELECT regexp_replace(regexp_replace(lower(trim(n)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM (
    SELECT CASE l_suppkey % 6 WHEN 0 THEN ' Not-Sprouted! ' WHEN 1 THEN 'YES' WHEN 2 THEN 'Sprouted / Weevilled'
      WHEN 3 THEN l_returnflag WHEN 4 THEN '__clean' ELSE 'positive' END AS n FROM lineitem))) GROUP BY label""",
)
def normalize_label(spark, sf_dir):
    m = F.col("l_suppkey") % 6
    name = (
        F.when(m == 0, " Not-Sprouted! ").when(m == 1, "YES").when(m == 2, "Sprouted / Weevilled")
        .when(m == 3, F.col("l_returnflag")).when(m == 4, "__clean").otherwise("positive")
    )
    rows = T.table(spark, sf_dir, "lineitem").select(R.normalize_label(name).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query(
    "sample_advisory",
    f"""{INST}, s AS (SELECT l_orderkey, count(*) AS n FROM instances GROUP BY l_orderkey
  UNION ALL SELECT -sample_id - 1, count(*) FROM instances GROUP BY sample_id)
SELECT l_orderkey AS group_id, n < 30 AS is_small, CASE WHEN n = 1 THEN 'one' WHEN n < 30 THEN concat('few ', CAST(n AS STRING)) END AS warning,
  CASE WHEN n < 30 THEN 'Observed sample fraction' ELSE 'Sample percentage' END AS label_note FROM s""",
)
def sample_advisory(spark, sf_dir):
    inst = T.instances(spark, sf_dir)
    sizes = inst.groupBy(F.col("l_orderkey").alias("group_id")).agg(F.count("*").alias("n")).unionAll(
        inst.groupBy((-F.col("sample_id") - 1).alias("group_id")).agg(F.count("*").alias("n"))
    )
    text = R.small_sample_warning("n")
    short = F.when(text.startswith("Sample size"), "one").when(
        text.isNotNull(), F.concat(F.lit("few "), F.regexp_extract(text, r"\((\d+) grains", 1))
    )
    return sizes.select(
        "group_id", R.small_sample("n").alias("is_small"), short.alias("warning"), R.label_note("n").alias("label_note")
    )


# --- detections -------------------------------------------------------------

_TARGET = "(category = 1 OR lower(class_name) IN ('rice_grain', 'rice', 'grain'))"
_FOREIGN = "(category >= 2 OR lower(class_name) IN ('foreign_matter', 'stone', 'inorganic', 'organic', 'other_foreign_matter'))"
_UNRES = "(conf < 0.3 OR parts >= 3 OR greatest(w, h) > (least(w, h) + 0.000001) * 5)"
ROUTED_CTE = f"""{T.DETECTIONS_CTE}, routed AS (
  SELECT *, CASE WHEN {_TARGET} AND {_UNRES} THEN 'unresolved' WHEN {_TARGET} THEN 'grain' WHEN {_FOREIGN} THEN 'foreign'
    WHEN conf >= 0.5 THEN 'foreign' ELSE 'unresolved' END AS route FROM detections)"""


def routed(spark, sf_dir, ids: bool = False):
    rows = T.detections(spark, sf_dir, ids)
    return rows.withColumn("route", R.route("conf", "w", "h", "parts", "category", "class_name"))


@query(
    "route_detections",
    f"""{INST}, {ROUTED_CTE} SELECT route, CASE WHEN route = 'unresolved' THEN CASE WHEN {_TARGET}
  THEN 'low_confidence_or_merged_appearance' ELSE 'ambiguous_class_low_confidence' END END AS reason, count(*) AS n
FROM routed GROUP BY ALL""",
)
def route_detections(spark, sf_dir):
    rows = routed(spark, sf_dir).withColumn("reason", R.route_reason("route", "category", "class_name"))
    return rows.groupBy("route", "reason").agg(F.count("*").alias("n"))


@query(
    "detection_counts",
    f"""{INST}, {ROUTED_CTE} SELECT sample_id, count(*) FILTER (WHERE route = 'grain') AS grain_count,
  count(*) FILTER (WHERE route = 'foreign') AS foreign_count, count(*) FILTER (WHERE route = 'unresolved') AS unresolved_count,
  count(*) FILTER (WHERE route = 'grain' AND conf < 0.8) AS uncertain_count, count(*) FILTER (WHERE route = 'grain' AND parts > 1) AS merged_count FROM routed GROUP BY sample_id""",
)
def detection_counts(spark, sf_dir):
    rows = routed(spark, sf_dir).withColumn("confidence_band", R.confidence_band("conf"))
    return I.detection_counts(rows, touching=F.col("parts") > 1)


@query(
    "assign_ids",
    f"""{INST} SELECT sample_id, grain_id, row_number() OVER (PARTITION BY sample_id ORDER BY confidence DESC, y, x, grain_id) AS id FROM instances""",
)
def assign_ids(spark, sf_dir):
    return I.assign_ids(T.instances(spark, sf_dir, ids=True), tie="grain_id").select("sample_id", "grain_id", "id")


@query(
    "assign_ids_by_route",
    f"""{INST}, {ROUTED_CTE} SELECT sample_id, grain_id, route, row_number() OVER (PARTITION BY sample_id, route ORDER BY grain_id) AS route_id FROM routed""",
)
def assign_ids_by_route(spark, sf_dir):
    rows = I.assign_ids_by_route(routed(spark, sf_dir, ids=True), seq="grain_id")
    return rows.select("sample_id", "grain_id", "route", "route_id")


@query(
    "keep_detections",
    f"""{INST}, {T.DETECTIONS_CTE} SELECT sample_id, count(*) AS kept, CAST(sum(area) AS BIGINT) AS area FROM detections
WHERE conf >= 0.5 AND area >= 50 AND NOT (x - 40 + w <= 0 OR y - 20 + h <= 0 OR x - 40 >= 640 OR y - 20 >= 480) GROUP BY sample_id""",
)
def keep_detections(spark, sf_dir):
    rows = T.detections(spark, sf_dir)
    ok = R.keep_detection(
        "conf", "area", F.col("x") - 40, F.col("y") - 20, "w", "h", F.lit(640), F.lit(480)
    )
    return rows.where(ok).groupBy("sample_id").agg(F.count("*").alias("kept"), F.sum("area").alias("area"))


@query(
    "instance_flags",
    f"""{INST}, a AS (SELECT *, CASE WHEN l_suppkey % 23 = 0 THEN area * 3 WHEN l_suppkey % 19 = 0 THEN 40 ELSE area END AS area2 FROM instances),
m AS (SELECT sample_id, coalesce(median(CASE WHEN area2 >= 50 THEN area2 END), 2000) AS typical FROM a GROUP BY sample_id)
SELECT a.sample_id, count(*) FILTER (WHERE area2 / typical > 2.5 OR greatest(w, h) / (least(w, h) + 0.000001) > 4) AS touching,
  count(*) AS n, {r('min(least(1.0, solidity * 0.7 + 0.3))')} AS min_confidence
FROM a JOIN m ON a.sample_id = m.sample_id GROUP BY a.sample_id""",
)
def instance_flags(spark, sf_dir):
    area = F.when(F.col("l_suppkey") % 23 == 0, F.col("area") * 3).when(F.col("l_suppkey") % 19 == 0, 40).otherwise(F.col("area"))
    rows = I.instance_flags(T.instances(spark, sf_dir).withColumn("area", area))
    return rows.groupBy("sample_id").agg(
        F.count_if("is_touching").alias("touching"),
        F.count("*").alias("n"),
        R.rnd(F.min("shape_confidence"), 4).alias("min_confidence"),
    )


@query(
    "foreign_fraction",
    f"""{INST}, f AS (SELECT sample_id - CAST(sample_id % 5 = 4 AS INT) AS sample_id, count(*) AS n, sum(area) AS covered FROM instances WHERE category_id = 2 GROUP BY 1)
SELECT p_partkey AS sample_id, coalesce(n, 0) AS foreign_object_count, {r('coalesce(covered, 0)::DOUBLE / (1000000 + p_size * 4096)', 6)} AS foreign_fraction
FROM part LEFT JOIN f ON p_partkey = f.sample_id""",
)
def foreign_fraction(spark, sf_dir):
    images = T.table(spark, sf_dir, "part").selectExpr("p_partkey AS sample_id", "1000000 + p_size * 4096 AS image_area")
    found = T.instances(spark, sf_dir).where("category_id = 2").withColumn("sample_id", F.expr("sample_id - CAST(sample_id % 5 = 4 AS INT)"))
    return I.foreign_fraction(found, images)  # every fifth sample is left without objects


# --- sample statistics ------------------------------------------------------


@query(
    "dimension_stats",
    f"""{INST} SELECT sample_id, {r('avg(length_px)', 2)} AS average_length, {r('median(length_px)', 2)} AS median_length,
  {r('avg(breadth_px)', 2)} AS average_breadth, {r('median(breadth_px)', 2)} AS median_breadth,
  {r('avg(length_px / breadth_px)', 2)} AS average_lb_ratio, {r('median(length_px / breadth_px)', 2)} AS median_lb_ratio
FROM instances GROUP BY sample_id""",
)
def dimension_stats(spark, sf_dir):
    return I.dimension_stats(T.instances(spark, sf_dir), lb=R.lb_ratio("length_px", "breadth_px"))


@query(
    "population_stats",
    f"""{INST} SELECT sample_id, coalesce(median(CASE WHEN breadth_px - 27 > 0 THEN breadth_px - 27 END), 1.0) AS median_breadth,
  coalesce(median(area), 1.0) AS median_area FROM instances GROUP BY sample_id""",
)
def population_stats(spark, sf_dir):
    return I.population_stats(T.instances(spark, sf_dir), breadth=F.col("breadth_px") - 27)


_IMM = ("*", "CASE WHEN l_suppkey % 8 = 0 THEN breadth_px / 2 ELSE breadth_px END AS b2", "CASE WHEN l_suppkey % 8 < 2 THEN area / 4 ELSE area END AS a2",
        "CASE WHEN l_linenumber = 1 THEN 0.75 ELSE solidity END AS s2")


@query(
    "classify_immature",
    f"""{INST}, q AS (SELECT {', '.join(_IMM)} FROM instances),
m AS (SELECT sample_id, median(b2) AS mb, median(a2) AS ma FROM q GROUP BY sample_id),
s AS (SELECT q.sample_id, CASE WHEN b2 / mb < 0.7 THEN 0.35 ELSE 0.0 END + CASE WHEN a2 / ma < 0.5 THEN 0.35 ELSE 0.0 END
  + CASE WHEN s2 < 0.85 THEN 0.15 ELSE 0.0 END + CASE WHEN length_px / b2 > 5 THEN 0.15 ELSE 0.0 END AS score
  FROM q JOIN m ON q.sample_id = m.sample_id)
SELECT CASE WHEN score > 0.5 THEN 'immature_shrunken' ELSE 'normal' END AS immature_label, CAST({r('score')} AS DOUBLE) AS immature_score, count(*) AS n
FROM s GROUP BY ALL""",
)
def classify_immature(spark, sf_dir):
    rows = T.instances(spark, sf_dir).selectExpr(*_IMM).drop("breadth_px", "area", "solidity")
    rows = rows.withColumnsRenamed({"b2": "breadth_px", "a2": "area", "s2": "solidity"})
    out = I.classify_immature(rows, I.population_stats(rows), lb=R.lb_ratio("length_px", "breadth_px"))
    return out.groupBy("immature_label", "immature_score").agg(F.count("*").alias("n"))


_DEF_SQL = ",\n  ".join(
    f"count(*) FILTER (WHERE {d} IN ({', '.join(map(repr, pos))})) AS {d}_count, "
    f"count(*) FILTER (WHERE {d} IN ({', '.join(map(repr, pos + oth))})) AS {d}_analyzed_count, "
    f"CASE WHEN count(*) FILTER (WHERE {d} IN ({', '.join(map(repr, pos + oth))})) > 0 THEN "
    + r(
        f"CAST(count(*) FILTER (WHERE {d} IN ({', '.join(map(repr, pos))})) AS DOUBLE) / nullif(count(*) FILTER (WHERE {d} IN ({', '.join(map(repr, pos + oth))})), 0) * 100",
        2,
    )
    + f" END AS {d}_percent"
    for d, (pos, oth) in DEFECT_LABELS.items()
)
SUMMARY_CTE = f"""{LENGTHS_ONLY}, {LABELLED_CTE}, labels_t AS (SELECT {', '.join(T.LABEL_COLS)} FROM labelled),
summary AS (
  SELECT sample_id, count(*) AS total_count,
    count(*) FILTER (WHERE broken_label = 'whole') AS whole_count, count(*) FILTER (WHERE broken_label = 'broken') AS broken_count,
    count(*) FILTER (WHERE broken_label = 'undetermined') AS undetermined_count,
    count(*) FILTER (WHERE broken_label <> 'undetermined') AS broken_analyzed_count,
    CASE WHEN count(*) FILTER (WHERE broken_label <> 'undetermined') > 0
      THEN {r("CAST(count(*) FILTER (WHERE broken_label = 'broken') AS DOUBLE) / count(*) * 100", 2)} END AS broken_percent,
    CASE WHEN count(*) FILTER (WHERE broken_label <> 'undetermined') > 0
      THEN {r("CAST(count(*) FILTER (WHERE broken_label = 'whole') AS DOUBLE) / count(*) * 100", 2)} END AS whole_percent,
    {_DEF_SQL}
  FROM labels_t GROUP BY sample_id)"""


def summary(spark, sf_dir):
    return I.sample_summary(labelled(spark, sf_dir).selectExpr(*T.LABEL_COLS))


@query("sample_summary", f"{INST}, {SUMMARY_CTE} SELECT * FROM summary")
def sample_summary(spark, sf_dir):
    return summary(spark, sf_dir)


# --- outliers ---------------------------------------------------------------


def _cholesky_sql(d: int = 5) -> str:
    """CTE chain: factor of the covariance, then forward substitution per instance."""
    steps, prev = [], "cov"
    for j in range(d):
        diag = " - ".join([f"c{j}{j} + 0.000001"] + [f"l{j}{k} * l{j}{k}" for k in range(j)])
        steps.append(f"ch{j}a AS (SELECT *, sqrt({diag}) AS l{j}{j} FROM {prev})")
        cols = [
            f"({' - '.join([f'c{j}{i}'] + [f'l{i}{k} * l{j}{k}' for k in range(j)])}) / l{j}{j} AS l{i}{j}"
            for i in range(j + 1, d)
        ]
        steps.append(f"ch{j} AS (SELECT {', '.join(['*'] + cols)} FROM ch{j}a)")
        prev = f"ch{j}"
    steps.append(f"z_in AS (SELECT f.*, s.* EXCLUDE (sample_id) FROM fit f JOIN {prev} s ON f.sample_id = s.sample_id)")
    prev = "z_in"
    for i in range(d):
        body = " - ".join([f"f{i} - m{i}"] + [f"l{i}{k} * z{k}" for k in range(i)])
        steps.append(f"z{i}_t AS (SELECT *, ({body}) / l{i}{i} AS z{i} FROM {prev})")
        prev = f"z{i}_t"
    return ",\n".join(steps)


_COV = ", ".join(f"covar_samp(f{i}, f{j}) AS c{i}{j}" for i in range(5) for j in range(i, 5))
_MEANS = ", ".join(f"avg(f{i}) AS m{i}" for i in range(5))
_OUT_LABEL = "CASE WHEN l_suppkey % 6 = 0 THEN 'broken' WHEN l_suppkey % 6 = 1 THEN 'undetermined' ELSE 'whole' END"
_OUT_QUALITY = "CASE WHEN l_orderkey % 5 = 0 THEN 'excellent' WHEN l_orderkey % 5 < 3 THEN 'good' ELSE 'limited' END"


_OUTLIER_CTE = f"""{INST}, lab AS (SELECT *, {_OUT_LABEL} AS broken_label, {_OUT_QUALITY} AS segmentation_quality,
  CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN length_px * 2.5 ELSE length_px END AS len FROM instances),
fit AS (SELECT sample_id, l_orderkey, l_linenumber, len AS f0, breadth_px AS f1, len / breadth_px AS f2, CAST(area AS DOUBLE) AS f3, solidity AS f4 FROM lab
  WHERE broken_label <> 'broken' AND segmentation_quality <> 'excellent'),
valid AS (SELECT sample_id, count(*) AS valid_n FROM fit GROUP BY sample_id),
cov AS (SELECT sample_id, {_MEANS}, {_COV} FROM fit GROUP BY sample_id HAVING count(*) >= 10),
{_cholesky_sql()},
far AS (SELECT *, sqrt(z0*z0 + z1*z1 + z2*z2 + z3*z3 + z4*z4) AS d FROM z4_t)"""


def _outlier_input(spark, sf_dir):
    rows = T.instances(spark, sf_dir).withColumns(
        {"broken_label": F.expr(_OUT_LABEL), "segmentation_quality": F.expr(_OUT_QUALITY)}
    )
    stretched = F.when((F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 5 == 0), F.col("length_px") * 2.5)
    rows = rows.withColumn("length_px", F.coalesce(stretched, "length_px"))
    return rows.withColumn("lb_ratio", F.col("length_px") / F.col("breadth_px"))


@query(
    "outlier_instances",
    f"""{_OUTLIER_CTE}
SELECT sample_id, l_orderkey, l_linenumber, {r('f0')} AS length_px, {r('d', 2)} AS outlier_distance FROM far WHERE d > 3""",
)
def outlier_instances(spark, sf_dir):
    return I.outlier_instances(_outlier_input(spark, sf_dir)).select(
        "sample_id", "l_orderkey", "l_linenumber", R.rnd("length_px", 4).alias("length_px"),
        R.rnd("outlier_distance", 2).alias("outlier_distance"),
    )


@query(
    "geometry_outliers",
    f"""{_OUTLIER_CTE},
hits AS (SELECT sample_id, count(*) FILTER (WHERE d > 3) AS outlier_count, avg(d) FILTER (WHERE d > 3) AS mean_far FROM far GROUP BY sample_id),
totals AS (SELECT sample_id, count(*) AS total_grains FROM lab GROUP BY sample_id)
SELECT t.sample_id, total_grains, coalesce(valid_n, 0) AS valid_grains_used, outlier_count,
  CASE WHEN outlier_count IS NULL THEN 'insufficient_data' ELSE 'diagnostic_only' END AS outlier_status,
  {r('outlier_count::DOUBLE / valid_n')} AS outlier_fraction,
  CASE WHEN outlier_count IS NOT NULL THEN {r('least(1.0::DOUBLE, valid_n / 50.0::DOUBLE) * CASE WHEN outlier_count > 0 THEN least(1.0::DOUBLE, mean_far / 3) ELSE 0.5::DOUBLE END')} END AS outlier_score
FROM totals t LEFT JOIN valid v ON t.sample_id = v.sample_id LEFT JOIN hits h ON t.sample_id = h.sample_id""",
)
def geometry_outliers(spark, sf_dir):
    return I.geometry_outliers(_outlier_input(spark, sf_dir)).drop("admixture_status")


# --- quality tier and screening ---------------------------------------------

_TIER_COLS = (
    "p_partkey AS sample_id",
    "CAST(p_size * 4 AS DOUBLE) AS blur",
    "CAST(p_retailprice - 890 AS DOUBLE) AS median_area",
    "CAST(0.25 + (p_partkey % 13) * 0.0625 AS DOUBLE) AS mean_confidence",
    "p_partkey % 17 AS uncertain_count",
    "p_partkey % 19 AS poor_count",
    "CAST(30 AS BIGINT) AS total_count",
    "CAST((p_partkey % 16) / 16.0 AS DOUBLE) AS illumination",
    "CAST((p_partkey % 21) / 64.0 AS DOUBLE) AS clipped_dark",
    "CAST((p_partkey % 3) / 64.0 AS DOUBLE) AS clipped_bright",
)
_TIER_CTE = f"""tier_in AS (SELECT {', '.join(_TIER_COLS)} FROM part),
tier_score AS (
  SELECT *, (CASE WHEN blur >= 100 THEN 1.0 WHEN blur >= 50 THEN 0.7 WHEN blur >= 20 THEN 0.4 ELSE 0.1 END::DOUBLE
    + CASE WHEN median_area >= 400 THEN 1.0 WHEN median_area >= 100 THEN 0.7 WHEN median_area >= 25 THEN 0.4 ELSE 0.1 END::DOUBLE
    + CASE WHEN uncertain_count / 30.0::DOUBLE > 0.2 THEN 0.5 ELSE 1.0 END::DOUBLE
    + CASE WHEN illumination < 0.5 THEN 0.5 ELSE least(1.0, illumination + 0.2::DOUBLE) END
    + CASE WHEN clipped_dark > 0.1 OR clipped_bright > 0.1 THEN 0.6 ELSE 1.0 END::DOUBLE) / 5.0 AS score,
    CAST(blur < 20 AS INT) + CAST(median_area < 25 AS INT) + CAST(mean_confidence < 0.5 AS INT) + CAST(uncertain_count / 30.0 >= 0.5 AS INT)
    + CAST(poor_count / 30.0 >= 0.5 AS INT) + CAST(greatest(clipped_dark, clipped_bright) >= 0.5 AS INT) + CAST(illumination < 0.15 AS INT) AS hard,
    CAST(blur < 100 AS INT) + CAST(median_area < 400 AS INT) + CAST(uncertain_count / 30.0 > 0.2 AS INT) + CAST(illumination < 0.5 AS INT)
    + CAST(clipped_dark > 0.1 OR clipped_bright > 0.1 AS INT) AS soft FROM tier_in),
tiers_t AS (
  SELECT sample_id, CASE WHEN hard > 0 THEN 'UNRELIABLE' WHEN score >= 0.8 THEN 'GOOD' WHEN score >= 0.6 THEN 'FAIR' ELSE 'POOR' END AS quality_level,
    {r('score')} AS quality_score, CAST(hard AS INT) AS hard_n, CAST(hard + soft AS INT) AS reasons_n FROM tier_score)"""


@query("quality_tier", f"WITH {_TIER_CTE} SELECT * FROM tiers_t")
def quality_tier(spark, sf_dir):
    out = I.quality_tier(T.table(spark, sf_dir, "part").selectExpr(*_TIER_COLS))
    return out.select(
        "sample_id", "quality_level", "quality_score",
        F.size("unreliable_reasons").alias("hard_n"), F.size("reasons").alias("reasons_n"),
    )


_PARAMS_SQL = "\n  UNION ALL ".join(
    f"SELECT sample_id, total_count, quality_level, '{p}' AS parameter, "
    + (
        f"{s}_percent AS observed, {s}_count AS detected, {s}_analyzed_count AS analyzed"
        if s in {"broken", *DEFECT_LABELS}
        else "CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), total_count"
    )
    + " FROM screened_in"
    for p, s in SCREENED
)
_LIMITS_SQL = ", ".join(f"('{p}', {cap}, '{ok}')" for p, cap, ok, _ in T.LIMITS)
SCREEN_CTE = f"""{SUMMARY_CTE}, {_TIER_CTE},
screened_in AS (SELECT s.*, t.quality_level FROM summary s JOIN tiers_t t ON s.sample_id = t.sample_id),
params AS ({_PARAMS_SQL}),
limit_t AS (SELECT * FROM (VALUES {_LIMITS_SQL}) v(parameter, cap, ok)),
screen AS (
  SELECT p.*, l.cap, CASE WHEN l.ok <> 'true' THEN 'NOT ASSESSABLE' WHEN l.cap IS NULL THEN 'NOT APPLICABLE'
    WHEN total_count < 30 OR quality_level IN ('POOR', 'UNRELIABLE') THEN 'NOT DETERMINABLE' WHEN observed IS NULL THEN 'NOT ASSESSABLE'
    WHEN observed <= l.cap THEN 'WITHIN REFERENCE LIMIT' ELSE 'EXCEEDS REFERENCE LIMIT' END AS status
  FROM params p JOIN limit_t l ON p.parameter = l.parameter)"""


def screening(spark, sf_dir):
    tiers = I.quality_tier(T.table(spark, sf_dir, "part").selectExpr(*_TIER_COLS)).select("sample_id", "quality_level")
    return LM.screen_limits(summary(spark, sf_dir).join(tiers, "sample_id"), T.limits(spark))


@query(
    "screen_limits",
    f"""{INST}, {SCREEN_CTE} SELECT sample_id, parameter, {r('observed', 2)} AS observed_percent, detected AS detected_count, analyzed AS analyzed_count,
  {r('detected::DOUBLE / nullif(analyzed, 0)')} AS observed_fraction, CAST(cap AS DOUBLE) AS reference_limit_percent, status,
  CASE WHEN status LIKE '%REFERENCE LIMIT' THEN {r('abs(observed - cap)', 2)} END AS difference FROM screen""",
)
def screen_limits(spark, sf_dir):
    return screening(spark, sf_dir).select(
        "sample_id", "parameter", "observed_percent", "detected_count", "analyzed_count", "observed_fraction",
        "reference_limit_percent", "status", "difference",
    )


@query(
    "screening_verdict",
    f"""{INST}, {SCREEN_CTE},
v AS (SELECT sample_id, max(total_count) AS n, max(quality_level) AS q,
  coalesce(string_agg(parameter, ',' ORDER BY list_position({[p for p, _ in LM.SCREENED]!r}, parameter)) FILTER (WHERE status = 'EXCEEDS REFERENCE LIMIT'), '') AS exceeding,
  count(*) FILTER (WHERE status LIKE '%REFERENCE LIMIT') AS judged FROM screen GROUP BY sample_id)
SELECT sample_id, exceeding, CASE WHEN n < 30 OR q IN ('POOR', 'UNRELIABLE') THEN 'Not determinable from this sample'
    WHEN exceeding <> '' THEN 'Exceeds one or more image-assessable reference limits'
    WHEN judged > 0 THEN 'Meets image-assessable reference limits' ELSE 'Insufficient data for screening' END AS verdict,
  CASE WHEN n < 30 OR q IN ('POOR', 'UNRELIABLE') THEN 'Not determinable from this sample' ELSE 'Formal grade not determined' END AS status,
  CAST(3 + CAST(n < 30 AS INT) + CAST(q IN ('POOR', 'UNRELIABLE') AS INT) AS INT) AS reasons_n FROM v""",
)
def screening_verdict(spark, sf_dir):
    out = LM.screening_verdict(screening(spark, sf_dir))
    return out.select(
        "sample_id", F.concat_ws(",", "exceeding_parameters").alias("exceeding"),
        F.col("image_screening_verdict").alias("verdict"), "status", F.size("reasons").alias("reasons_n"),
    )


# --- gate -------------------------------------------------------------------

_LIN = "CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({v} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_RED = "(mean_a_star > 1.5 AND aspect_ratio >= 1.6 AND surface_roughness < 0.3::DOUBLE)"
_CLUSTER = "(area_pixels > 50000 AND surface_roughness < 0.28::DOUBLE AND mean_l_star > 35)"


def _ramp(v: str, zero: float, full: float) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({v} - {zero}::DOUBLE) / {full - zero!r}::DOUBLE))"


GATE_CTE = f"""{T.GATE_CTE},
g1 AS (
  SELECT *, CASE WHEN aspect_ratio < 1.65 AND surface_roughness >= 0.28::DOUBLE AND NOT {_CLUSTER} THEN 'stone_shape_and_texture'
      WHEN aspect_ratio < 1.35 AND NOT {_CLUSTER} THEN 'rounded_non_rice'
      WHEN area_pixels < 300 AND surface_roughness > 0.45::DOUBLE THEN 'small_rough_debris'
      WHEN chroma >= 30 AND mean_b_star > 24 THEN 'wheat_or_yellow_grain' END AS hard_negative,
    CASE WHEN {_CLUSTER} THEN 0.9::DOUBLE ELSE {_ramp('aspect_ratio', 1.3, 2.1)} END AS s_aspect,
    1.0 - {_ramp('surface_roughness', 0.06, 0.36)} AS s_texture,
    CASE WHEN {_RED} THEN 0.9::DOUBLE WHEN chroma <= 18 THEN 1.0 WHEN chroma <= 28 THEN 1.0 - {_ramp('chroma', 18.0, 28.0)} * 0.7::DOUBLE ELSE 0.1::DOUBLE END AS s_chroma,
    CASE WHEN mean_l_star >= 55 THEN 1.0::DOUBLE WHEN {_RED} AND mean_l_star >= 22 THEN 0.9::DOUBLE
      WHEN mean_l_star >= 30 THEN {_ramp('mean_l_star', 30.0, 55.0)} * 0.5 + 0.5 ELSE {_ramp('mean_l_star', 15.0, 30.0)} * 0.5 END AS s_light,
    {_LIN.format(v='background_gray')} AS bg_lin,
    greatest(0.0::DOUBLE, background_gray - mean_gray) / greatest(background_gray, 1.0::DOUBLE) AS gap FROM gate_objects),
g2 AS (
  SELECT *, CASE WHEN floor(least(255, (CASE WHEN bg_lin > 0.008856 THEN pow(bg_lin, 1.0::DOUBLE / 3) * 116 - 16 ELSE bg_lin * 903.3::DOUBLE END) * 2.55::DOUBLE) + 0.5) * 100 / 255 >= 70
    THEN 1.0 - {_ramp('gap', 0.08, 0.30)} ELSE 1.0 END AS contrast FROM g1),
g3 AS (
  SELECT *, CASE hard_negative WHEN 'stone_shape_and_texture' THEN 0.10::DOUBLE WHEN 'rounded_non_rice' THEN 0.08::DOUBLE
    WHEN 'small_rough_debris' THEN 0.05::DOUBLE WHEN 'wheat_or_yellow_grain' THEN 0.15::DOUBLE
    ELSE s_aspect * 0.35::DOUBLE + s_texture * 0.25::DOUBLE + s_chroma * 0.2::DOUBLE + s_light * (contrast * 0.5 + 0.5) * 0.2::DOUBLE END AS target_score FROM g2),
gated AS (
  SELECT *, coalesce((learned + target_score) * 0.5, target_score) AS confidence,
    (coalesce((learned + target_score) * 0.5, target_score) >= 0.52::DOUBLE OR target_score >= 0.52::DOUBLE) AND target_score >= 0.45::DOUBLE AND hard_negative IS NULL AS is_target,
    CASE WHEN r < 80 AND g < 80 AND b < 80 THEN 'stone' WHEN g > r + 30 THEN 'organic' ELSE 'other_foreign_matter' END AS other_class
  FROM g3),
rollup_t AS (
  SELECT sample_id, count(*) AS total_detections, count(*) FILTER (WHERE is_target) AS target_detections,
    coalesce({r('avg(confidence) FILTER (WHERE is_target)')}, 0.0) AS confidence_mean, coalesce({r('max(confidence) FILTER (WHERE is_target)')}, 0.0) AS confidence_max
  FROM gated GROUP BY sample_id)"""


def gated(spark, sf_dir):
    rows = P.target_score(T.gate_objects(spark, sf_dir))
    return rows.withColumns(
        {
            "confidence": P.fused_confidence("target_score", "learned"),
            "is_target": P.accept_target("target_score", "learned", "hard_negative"),
            "other_class": R.non_target_class("r", "g", "b"),
        }
    )


@query(
    "target_score",
    f"""{INST}, {GATE_CTE} SELECT sample_id, hard_negative, count(*) AS n, {r('min(target_score)')} AS lowest, {r('max(target_score)')} AS highest,
  {r('min(contrast)')} AS least_contrast FROM gated GROUP BY ALL""",
)
def target_score(spark, sf_dir):
    rows = gated(spark, sf_dir)
    gap = F.when(F.col("hard_negative").isNull(), F.col("cue_background_contrast"))
    out = rows.withColumn("_g", gap)
    from sievekit.functions.scores import background_gap  # noqa: PLC0415

    bright = C.gray_lightness("background_gray") >= 70
    contrast = F.when(bright, 1.0 - R.ramp(background_gap(), 0.08, 0.30)).otherwise(1.0)
    return out.groupBy("sample_id", "hard_negative").agg(
        F.count("*").alias("n"),
        R.rnd(F.min("target_score"), 4).alias("lowest"),
        R.rnd(F.max("target_score"), 4).alias("highest"),
        R.rnd(F.min(contrast), 4).alias("least_contrast"),
    )


@query(
    "accept_target",
    f"""{INST}, {GATE_CTE} SELECT sample_id, count(*) FILTER (WHERE is_target) AS accepted, count(*) FILTER (WHERE NOT is_target) AS refused,
  count(*) FILTER (WHERE NOT is_target AND other_class = 'stone') AS stones, count(*) FILTER (WHERE NOT is_target AND other_class = 'organic') AS organic
FROM gated GROUP BY sample_id""",
)
def accept_target(spark, sf_dir):
    out = ~F.col("is_target")
    return gated(spark, sf_dir).groupBy("sample_id").agg(
        F.count_if("is_target").alias("accepted"),
        F.count_if(out).alias("refused"),
        F.count_if(out & (F.col("other_class") == "stone")).alias("stones"),
        F.count_if(out & (F.col("other_class") == "organic")).alias("organic"),
    )


@query(
    "gate_rollup",
    f"""{INST}, {GATE_CTE}, s AS (SELECT unnest([p_partkey, -p_partkey]) AS sample_id, p_size % 7 <> 0 AS able, p_size % 3 AS left_n FROM part),
t AS (SELECT s.sample_id, able, left_n, CASE WHEN able THEN coalesce(total_detections, 0) ELSE 0 END AS n, CASE WHEN able THEN coalesce(target_detections, 0) ELSE 0 END AS hits,
  CASE WHEN able THEN coalesce(confidence_mean, 0.0) ELSE 0.0 END AS mean, CASE WHEN able THEN coalesce(confidence_max, 0.0) ELSE 0.0 END AS top FROM s LEFT JOIN rollup_t USING (sample_id)),
u AS (SELECT *, CASE WHEN NOT able THEN 'NO_RICE_CLASS' WHEN hits = 0 THEN 'NOT_RICE' WHEN left_n = 0 THEN 'NO_ANALYSABLE_RICE' ELSE 'RICE' END AS status FROM t)
SELECT sample_id, n AS total_detections, hits AS target_detections, {r('mean', 2)} AS confidence_mean, top AS confidence_max, n - hits AS foreign_detections,
  CASE WHEN n = 0 THEN 0.0 ELSE {r('hits::DOUBLE / n')} END AS target_fraction, CASE WHEN n >= 25 THEN 0.05::DOUBLE END AS min_fraction_required, status,
  CASE WHEN hits > 0 AND n >= 25 AND hits::DOUBLE / n < 0.05 THEN 'low_object_rice_fraction_warning'
    WHEN hits > 0 THEN 'rice_detected' ELSE 'no_rice_class_detections' END AS reason, status <> 'RICE' AS analysis_stopped,
  CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in GATE_MESSAGES.items())} END AS message FROM u""",
)
def gate_rollup(spark, sf_dir):
    """Half of the samples have no detection; some detectors know no target, some samples have nothing left to measure."""
    samples = T.table(spark, sf_dir, "part").select(
        F.explode(F.array(F.col("p_partkey"), -F.col("p_partkey"))).alias("sample_id"),
        (F.col("p_size") % 7 != 0).alias("has_target_class"), (F.col("p_size") % 3).alias("analysable_count"),
    )
    return I.gate_rollup(gated(spark, sf_dir), samples=samples).withColumn("confidence_mean", R.rnd("confidence_mean"))


@query(
    "split_by_gate",
    f"""{INST}, {GATE_CTE}, by_order AS (SELECT l_orderkey, bool_or(is_target) AS pass, count(*) AS n FROM gated GROUP BY l_orderkey)
SELECT pass AS measured, count(*) AS samples, CAST(sum(n) AS BIGINT) AS objects FROM by_order GROUP BY pass""",
)
def split_by_gate(spark, sf_dir):
    """One order is one sample here, so that some samples stop at the gate."""
    objects = gated(spark, sf_dir).drop("sample_id").withColumnRenamed("l_orderkey", "sample_id")
    gate = I.gate_rollup(objects)
    sizes = objects.groupBy("sample_id").agg(F.count("*").alias("n"))
    parts = [
        df.agg(F.lit(flag).alias("measured"), F.count("*").alias("samples"), F.sum("n").alias("objects"))
        for flag, df in zip((True, False), I.split_by_gate(sizes, gate))
    ]
    return parts[0].unionAll(parts[1])


@query(
    "class_id_lookup",
    f"""{INST}, {GATE_CTE} SELECT other_class AS class_name, CAST(CASE other_class WHEN 'stone' THEN 0 WHEN 'organic' THEN 2 WHEN 'other_foreign_matter' THEN -1 END AS INT) AS class_id,
  count(*) AS n FROM gated GROUP BY ALL""",
)
def class_id_lookup(spark, sf_dir):
    classes = spark.createDataFrame([("stone", 0), ("inorganic", 1), ("organic", 2)], "class_name string, class_id int")
    rows = gated(spark, sf_dir).select(F.col("other_class").alias("class_name"))
    return I.class_id_lookup(rows, classes).groupBy("class_name", "class_id").agg(F.count("*").alias("n"))


# --- model scores -----------------------------------------------------------

_MODEL = {
    "means": (50.0, 12.0, 2.5, 0.25, 120.0, 0.25),
    "scales": (20.0, 8.0, 1.0, 0.125, 50.0, 0.25),
    "weights": (0.5, -0.75, 1.25, -1.0, 0.25, -0.5),
    "intercept": 0.125,
}
_Z = " + ".join(
    f"({f} - {m}::DOUBLE) / {s}::DOUBLE * {w}::DOUBLE"
    for f, m, s, w in zip(
        (*GATE_FEATURES[:-1], "(greatest(0.0::DOUBLE, background_gray - mean_gray) / greatest(background_gray, 1.0::DOUBLE))"),
        _MODEL["means"], _MODEL["scales"], _MODEL["weights"],
    )
)


@query(
    "logistic_score",
    f"""{INST}, {T.GATE_CTE}, s AS (SELECT sample_id, 1.0 / (1.0 + exp(-({_MODEL['intercept']} + {_Z}))) AS p FROM gate_objects)
SELECT sample_id, {r('min(p)')} AS lowest, {r('max(p)')} AS highest, {r('avg(p)', 3)} AS mean,
  count(*) FILTER (WHERE p >= 0.5) AS positive, count(*) FILTER (WHERE greatest(p, 1 - p) < 0.7) AS low_confidence FROM s GROUP BY sample_id""",
)
def logistic_score(spark, sf_dir):
    rows = T.gate_objects(spark, sf_dir).withColumn("background_gap_ratio", P.background_gap())
    rows = rows.select("sample_id", P.logistic_score(GATE_FEATURES, **_MODEL).alias("p"))
    # The class list belongs to the model, not to the rows: one row, resolved once.
    names = F.array(F.lit("Normal"), F.lit("positive"))
    model = spark.range(1).select(
        P.class_index(names, "sprouted_weevilled").alias("pos"), P.class_index(names, "normal").alias("neg")
    )
    rows = rows.join(F.broadcast(model)).withColumn(
        "d", P.threshold_classify(F.array(1.0 - F.col("p"), "p"), "pos", "neg")
    )
    return rows.groupBy("sample_id").agg(
        R.rnd(F.min("p"), 4).alias("lowest"),
        R.rnd(F.max("p"), 4).alias("highest"),
        R.rnd(F.avg("p"), 3).alias("mean"),
        F.count_if(F.col("d.index") == 2).alias("positive"),
        F.count_if(F.col("d.level") == "low").alias("low_confidence"),
    )


# --- reference documents ----------------------------------------------------


@query(
    "load_profiles",
    """SELECT concat('profile-', CAST(p_partkey AS STRING)) AS profile_name, CASE WHEN p_size % 3 = 0 THEN 'pixels' ELSE 'mm' END AS reference_unit,
  CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS whole_kernel_length, CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size END AS reference_count,
  'Proxy' AS data_status, false AS production_eligible, p_size % 4 <> 0 AS ok FROM part""",
)
def load_profiles(spark, sf_dir):
    """Profile documents with fields left out, written from part and read back with defaults."""
    path = scratch_path(spark, "profiles")
    doc = F.struct(
        F.concat(F.lit("profile-"), F.col("p_partkey").cast("string")).alias("profile_name"),
        F.when(F.col("p_size") % 3 != 0, "mm").alias("reference_unit"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("double")).alias("whole_kernel_length"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("reference_count"),
    )
    T.table(spark, sf_dir, "part").select(F.to_json(doc).alias("value")).write.text(path)
    out = RD.load_profiles(spark, path, multi_line=False)
    return out.select(
        "profile_name", "reference_unit", "whole_kernel_length", "reference_count", "data_status",
        "production_eligible", F.col("verdict.ok").alias("ok"),
    )


_LIMIT_DOC = """concat('{"grade_a":{"broken":{"max_percent":', CAST(p_size AS STRING), '.5,"basis":"weight"},"foreign_matter":{"max_percent":0.5,"sub_limits":{"mineral":{"max_percent":0.25,"basis":"count"}}}},',
  '"common":{"admixture":{"max_percent":null,"basis":"weight"}},"image_assessment_mapping":{"_description":"text","broken":{"image_assessable":',
  CASE WHEN p_size % 2 = 0 THEN 'true' ELSE '"partial"' END, ',"image_basis":"area","limitation":"l"}}}')"""


@query(
    "flatten_limits",
    """SELECT * FROM (
  SELECT p_partkey AS doc, 'grade_a' AS grade, 'broken' AS parameter, NULL AS sub_parameter, p_size + 0.5::DOUBLE AS max_percent, 'weight' AS basis,
    CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'partial' END AS image_assessable, 'area' AS image_basis, 'l' AS limitation FROM part
  UNION ALL SELECT p_partkey, 'grade_a', 'foreign_matter', NULL, 0.5, 'weight', 'false', 'count', '' FROM part
  UNION ALL SELECT p_partkey, 'grade_a', 'foreign_matter', 'mineral', 0.25, 'count', 'false', 'count', '' FROM part
  UNION ALL SELECT p_partkey, 'common', 'admixture', NULL, NULL, 'weight', 'false', 'count', '' FROM part)""",
)
def flatten_limits(spark, sf_dir):
    docs = T.table(spark, sf_dir, "part").selectExpr("p_partkey AS doc", f"{_LIMIT_DOC} AS value")
    return RD.flatten_limits(docs, keep=("doc",))


@query(
    "load_class_map",
    """WITH n AS (SELECT p_partkey AS model, unnest(range(1 + p_size % 4)) AS i, p_brand, p_type FROM part),
c AS (SELECT model, CAST(i AS INT) AS class_id, CASE i % 4 WHEN 0 THEN p_type WHEN 1 THEN concat('Rice ', p_brand) WHEN 2 THEN concat('FOREIGN rice ', p_brand) ELSE concat('rice ', p_type) END AS class_name FROM n)
SELECT *, contains(lower(class_name), 'rice') AND NOT contains(lower(class_name), 'foreign') AS is_target FROM c""",
)
def load_class_map(spark, sf_dir):
    """A model document per part, of one to four classes, with an entry whose id is no number."""
    i, brand, kind = F.col("i"), F.col("p_brand"), F.col("p_type")
    name = (
        F.when(i % 4 == 0, kind).when(i % 4 == 1, F.concat(F.lit("Rice "), brand))
        .when(i % 4 == 2, F.concat(F.lit("FOREIGN rice "), brand)).otherwise(F.concat(F.lit("rice "), kind))
    )
    entries = T.table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", F.explode(F.sequence(F.lit(0), F.col("p_size") % 4)).alias("i")
    )
    names = F.map_from_entries(F.collect_list(F.struct(i.cast("string"), name)))
    docs = entries.groupBy(F.col("p_partkey").alias("model")).agg(
        F.to_json(F.map_concat(names, F.create_map(F.lit("note"), F.first("p_type")))).alias("value")
    )
    return RD.load_class_map(docs)


@query(
    "threshold_lookup",
    """SELECT l_suppkey % 3 AS k, CAST(CASE l_suppkey % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 50 ELSE 7 END AS DOUBLE) AS value, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def threshold_lookup(spark, sf_dir):
    table = RD.threshold_table(spark, {"segmentation": {"confidence_threshold": 0.6}})
    k = F.col("l_suppkey") % 3
    key = F.when(k == 0, "confidence_threshold").when(k == 1, "min_grain_area_pixels").otherwise("unknown")
    rows = T.table(spark, sf_dir, "lineitem").select(k.alias("k"), key.alias("key"))
    found = RD.with_threshold(rows, table, F.lit("segmentation"), F.col("key"), F.lit(7.0), "value")
    return found.groupBy("k", "value").agg(F.count("*").alias("n"))
