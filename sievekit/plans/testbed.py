"""The working tables (instances, dimensions) derived from the given parquet tables.

The same expression texts are used by Spark (``selectExpr``) and by the DuckDB twins. All
factors are exact binary fractions, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators.scaling import row_numbers
from sievekit.session import bytes_of, stored, tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ID_ORDER = (
    "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus",
)

INSTANCE_COLS = (
    "l_partkey AS sample_id",
    "CASE WHEN p_size > 40 THEN 90 + l_quantity * 0.5 WHEN p_size > 35 THEN 40 + l_quantity * 0.25 ELSE 60 + l_quantity * 2 END AS length_px",
    "CAST(24 + floor(l_discount * 100 + 0.5) AS DOUBLE) AS breadth_px",
    "CAST(0.8125 + floor(l_tax * 100 + 0.5) * 0.0234375 AS DOUBLE) AS solidity",
    "CAST(0.375 + floor(l_tax * 100 + 0.5) * 0.0703125 AS DOUBLE) AS confidence",
    "CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS category_id",
    "(l_suppkey * 37) % 900 AS x",
    "(l_orderkey * 53) % 900 AS y",
    "l_orderkey",
    "l_linenumber",
    "l_suppkey",
    "l_quantity",
    "l_returnflag",
    "l_linestatus",
    "p_size",
)
SHAPE_COLS = (
    "*",
    "CAST(floor(length_px * 0.75) AS BIGINT) AS w",
    "CAST(floor(breadth_px) AS BIGINT) AS h",
    "CAST(floor(length_px * breadth_px * 0.75) AS BIGINT) AS area",
)

INSTANCES_CTE = f"""
raw_instances AS (
  SELECT row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(ID_ORDER)}) AS grain_id,
         {', '.join(INSTANCE_COLS)}
  FROM lineitem JOIN part ON l_partkey = p_partkey),
instances AS (SELECT {', '.join(SHAPE_COLS)} FROM raw_instances)"""


def instances(spark: SparkSession, sf_dir: str, ids: bool = False, once: bool = False) -> DataFrame:
    """``once``: the rows are built and numbered once, for a query that reads them several times."""
    tune(spark, bytes_of(spark, f"{sf_dir}/lineitem.parquet"))
    lines = table(spark, sf_dir, "lineitem")
    extra: tuple[str, ...] = ()
    if ids:
        lines = row_numbers(
            lines,
            ["l_partkey"],
            [F.col(c) for c in ID_ORDER],
            [F.floor(F.col("l_orderkey") / 65536)],
            "grain_id",
        )
        extra = ("grain_id",)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if once:
        return stored(joined.selectExpr(*extra, *INSTANCE_COLS), "instances").selectExpr(*SHAPE_COLS)
    return joined.selectExpr(*extra, *INSTANCE_COLS).selectExpr(*SHAPE_COLS)


CALIBRATION_COLS = (
    "p_partkey AS sample_id",
    "p_size % 5 AS marker_count",
    "CAST(CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 9999 ELSE 22 END AS DOUBLE) AS pixels_per_mm",
    "CASE WHEN p_size % 7 = 0 THEN 'none' ELSE 'aruco' END AS mode",
)
PROFILE_COLS = (
    "p_partkey AS sample_id",
    "concat('profile-', CAST(p_partkey % 3 AS STRING)) AS profile_name",
    "CASE WHEN p_partkey % 3 = 0 THEN 'pixels' ELSE 'mm' END AS reference_unit",
    "CAST(CASE WHEN p_partkey % 3 = 0 THEN 100 + (p_partkey % 16) * 25 ELSE 6.8125 END AS DOUBLE) AS whole_kernel_length",
    "CAST(2 AS DOUBLE) AS whole_kernel_breadth",
    "CAST(CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE 3.5 END AS DOUBLE) AS whole_kernel_lb_ratio",
    "CASE WHEN p_partkey % 13 = 0 THEN 'Guessed' ELSE 'Measured' END AS data_status",
    "p_partkey % 2 = 0 AS production_eligible",
    "p_partkey % 10 AS reference_count",
)
# Every row is a profile; a third of them is of samples (negative ids) that nothing else has.
PROFILE_SAMPLE = "CASE WHEN p_partkey % 3 < 2 THEN p_partkey ELSE -p_partkey END AS sample_id"
TRUTH_COLS = ("p_partkey AS sample_id", "25 + p_size % 10 AS expected_total", "p_size % 4 AS expected_broken")


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*CALIBRATION_COLS)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(PROFILE_SAMPLE, *PROFILE_COLS[1:])


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*TRUTH_COLS)


DIMENSIONS_CTE = f"""
calibrations AS (SELECT {', '.join(CALIBRATION_COLS)} FROM part),
profiles AS (SELECT {', '.join((PROFILE_SAMPLE, *PROFILE_COLS[1:]))} FROM part),
truth AS (SELECT {', '.join(TRUTH_COLS)} FROM part)"""


# --- log events -------------------------------------------------------------

EVENT_BASE_COLS = (
    "event_id AS seq", "ts", "user_id", "event_type", "value",
    "CAST(replace(replace(props, '{\"k\": ', ''), '}', '') AS INT) AS k",
)
EVENT_COLS = (
    "seq",
    "ts",
    """CASE event_type WHEN 'signup' THEN 'request_started' WHEN 'purchase' THEN 'request_finished'
  WHEN 'error' THEN CASE WHEN value >= 60 THEN 'request_failed' ELSE 'analysis_failed' END
  WHEN 'click' THEN 'analysis_started'
  ELSE CASE WHEN k < 70 THEN 'analysis_completed' WHEN k < 85 THEN 'segmentation_completed'
    ELSE 'geometry_completed' END END AS event""",
    "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level",
    "concat('r-', CAST(user_id AS STRING), '-', CAST(day(ts) % 10 AS STRING)) AS request_id",
    "concat('j-', CAST(user_id AS STRING), '-', CAST(day(ts) % 10 AS STRING), CASE WHEN k % 5 = 0 THEN 'b' ELSE '' END) AS job_id",
    "CASE WHEN k % 2 = 0 THEN 'POST' ELSE 'GET' END AS method",
    "concat('/p', CAST(k % 3 AS STRING)) AS path",
    "CASE k % 4 WHEN 0 THEN '/analyze' WHEN 1 THEN '/health' WHEN 2 THEN '/export' END AS route",
    "CASE WHEN k < 90 THEN 200 ELSE 404 END AS status_code",
    "event_type = 'purchase' AND k <> 50 AS ok",
    "CAST(floor(value * 10) AS BIGINT) AS duration_ms",
    "CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 0 ELSE CAST(floor(value * 7) AS BIGINT) END AS total_processing_ms",
    "CASE WHEN k % 9 = 0 THEN 'partial' ELSE 'success' END AS status",
    "k % 8 <> 0 AS rice_detected",
    "CAST(k AS BIGINT) AS grain_count",
    "CAST(floor(k / 2) AS BIGINT) AS whole_count",
    "CAST(k % 7 AS BIGINT) AS broken_count",
    "CAST(k % 3 AS BIGINT) AS undetermined_count",
    "CASE WHEN k % 2 = 0 THEN 'profile' ELSE 'sample_derived' END AS reference_source",
    "CASE WHEN k % 5 = 1 THEN NULL ELSE 'classical' END AS segmentation_method",
    "concat('img-', CAST(k AS STRING), '.png') AS filename",
    "CASE k % 3 WHEN 0 THEN 'segmentation' WHEN 1 THEN 'geometry' END AS failed_stage",
    "CASE k % 5 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'OSError' WHEN 2 THEN 'KeyError' ELSE NULL END AS error_type",
    "CASE WHEN k % 5 < 3 THEN concat('bad ', CAST(k AS STRING)) END AS error_message",
    "CASE WHEN k % 3 = 0 THEN user_id END AS process_id",
    "CASE WHEN k % 2 = 0 THEN value END AS rss_mb",
)
EVENTS_CTE = f"""
event_base AS (SELECT {', '.join(EVENT_BASE_COLS)} FROM events),
log_events AS (SELECT {', '.join(EVENT_COLS)} FROM event_base),
ordered_events AS (SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, seq) AS ord FROM log_events)"""


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(*EVENT_BASE_COLS).selectExpr(*EVENT_COLS)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


# --- labels, detections and gate objects ------------------------------------

LABEL_COLS = (
    "*",
    "CASE l_suppkey % 5 WHEN 0 THEN 'damaged' WHEN 1 THEN 'slightly_damaged' WHEN 2 THEN 'unavailable' ELSE 'normal' END AS damaged",
    "CASE l_suppkey % 7 WHEN 0 THEN 'discoloured' WHEN 1 THEN 'undetermined' ELSE 'normal' END AS discoloured",
    "CASE WHEN p_size % 2 = 0 THEN 'undetermined' WHEN l_suppkey % 6 = 0 THEN 'chalky' ELSE 'not_chalky' END AS chalky",
    "CASE WHEN l_orderkey % 9 = 0 THEN 'red' ELSE 'not_red' END AS red",
    "CASE l_orderkey % 4 WHEN 0 THEN 'dehusked' WHEN 1 THEN 'unavailable' ELSE 'not_dehusked' END AS dehusked",
    "CASE WHEN l_linenumber = 7 THEN 'immature_shrunken' ELSE 'normal' END AS immature",
    "CASE WHEN l_linenumber = 6 THEN 'sprouted_weevilled' ELSE 'normal' END AS sprouted",
)

DETECTION_COLS = (
    "*",
    "CAST((l_orderkey * 7 + l_suppkey) % 16 AS DOUBLE) / 16 AS conf",
    "CAST(l_suppkey % 4 AS INT) AS parts",
    "CASE WHEN l_orderkey % 6 = 0 THEN 0 WHEN l_orderkey % 6 < 4 THEN 1 ELSE 2 END AS category",
    """CASE l_suppkey % 6 WHEN 0 THEN 'Grain' WHEN 1 THEN 'stone' WHEN 2 THEN 'Organic' ELSE 'thing' END AS class_name""",
)

# Objects in front of the gate, with the features its score reads.
GATE_COLS = (
    "sample_id", "l_orderkey", "l_suppkey", "l_linenumber", "x", "y", "w", "h",
    "CAST(1 + (l_suppkey % 30) * 0.125 AS DOUBLE) AS aspect_ratio",
    "CAST((l_orderkey % 40) * 0.015625 AS DOUBLE) AS surface_roughness",
    "CAST((l_linenumber * 5) % 37 AS DOUBLE) AS chroma",
    "CAST(10 + (l_suppkey * 7) % 80 AS DOUBLE) AS mean_l_star",
    "CAST(l_orderkey % 7 - 3 AS DOUBLE) AS mean_a_star",
    "CAST(l_orderkey % 31 AS DOUBLE) AS mean_b_star",
    "CAST(CASE WHEN l_suppkey % 17 = 0 THEN 60000 ELSE 100 + l_quantity * 50 END AS DOUBLE) AS area_pixels",
    "CAST(50 + l_quantity * 3 AS DOUBLE) AS mean_gray",
    "CAST((l_suppkey * 13) % 256 AS DOUBLE) AS background_gray",
    "CAST(CASE WHEN l_suppkey % 3 = 0 THEN (l_orderkey % 16) / 16.0 END AS DOUBLE) AS learned",
    "CAST(l_orderkey % 200 AS DOUBLE) AS r",
    "CAST(l_suppkey % 180 AS DOUBLE) AS g",
    "CAST(l_linenumber * 20 AS DOUBLE) AS b",
)
LABELS_CTE = f"labels_t AS (SELECT {', '.join(LABEL_COLS)} FROM instances)"
DETECTIONS_CTE = f"detections AS (SELECT {', '.join(DETECTION_COLS)} FROM instances)"
GATE_CTE = f"gate_objects AS (SELECT {', '.join(GATE_COLS)} FROM instances)"


def detections(spark: SparkSession, sf_dir: str, ids: bool = False) -> DataFrame:
    return instances(spark, sf_dir, ids).selectExpr(*DETECTION_COLS)


def gate_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(spark, sf_dir).selectExpr(*GATE_COLS)


LIMITS = (
    # parameter, max percent, assessable, image basis
    ("broken", 25.0, "true", "count"),
    ("foreign_matter", 0.5, "true", "count_and_area"),
    ("damaged_slightly_damaged", 3.0, "true", "count"),
    ("discoloured", 3.0, "true", "count"),
    ("chalky", 5.0, "true", "count"),
    ("red", 3.0, "true", "count"),
    ("admixture_of_lower_class", 6.0, "true", "count"),
    ("dehusked", 13.0, "partial", "visual_proxy"),
)


def limits(spark: SparkSession) -> DataFrame:
    """The long limits table of one standard: grade A, and common without an admixture limit."""
    rows = [
        (grade, p, None, None if grade == "common" and p.startswith("admixture") else cap, "weight", ok, basis, "")
        for grade in ("grade_a", "common")
        for p, cap, ok, basis in LIMITS
    ]
    return spark.createDataFrame(
        rows,
        "grade string, parameter string, sub_parameter string, max_percent double, basis string, "
        "image_assessable string, image_basis string, limitation string",
    )


# --- pixels and contours ----------------------------------------------------

_BYTE = "CAST(greatest(0, least(255, floor((CAST({} AS DOUBLE) + 0.5) * 255))) AS INT)"


def _at(engine: str, shift: int) -> str:
    index = f"(p + {shift}) % 64"
    return _BYTE.format(f"embedding[{index}]" if engine == "spark" else f"embedding[{index} + 1]")


def _pixel_cols(engine: str) -> tuple[str, ...]:
    return (
        "CAST(label AS INT) AS sample_id",
        "vec_id AS instance_id",
        "CAST(p % 8 AS INT) AS x",
        "CAST(floor(p / 8) AS INT) AS y",
        f"{_at(engine, 0)} AS r",
        f"{_at(engine, 20)} AS g",
        f"{_at(engine, 41)} AS b",
    )


PIXELS_CTE = f"""
pixel_base AS (SELECT label, vec_id, embedding, unnest(range(0, 64)) AS p FROM embeddings),
pixel_raw AS (SELECT {', '.join(_pixel_cols('duckdb'))} FROM pixel_base),
pixels AS (SELECT *, r >= 110 AS mask, CAST(floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 0.5) AS INT) AS gray FROM pixel_raw)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 crops, one per vector; the mask is where red is bright enough."""
    rows = table(spark, sf_dir, "embeddings").select(
        "label", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")
    )
    return rows.selectExpr(*_pixel_cols("spark")).withColumn("mask", F.col("r") >= 110)


# Directions of the eight vertices of an outline, in order.
_DIRS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
_DX = "CASE p " + " ".join(f"WHEN {i} THEN {dx}" for i, (dx, _) in enumerate(_DIRS)) + " END"
_DY = "CASE p " + " ".join(f"WHEN {i} THEN {dy}" for i, (_, dy) in enumerate(_DIRS)) + " END"


def _point_cols(engine: str) -> tuple[str, ...]:
    at = "embedding[p]" if engine == "spark" else "embedding[p + 1]"
    radius = f"CASE WHEN vec_id % 37 = 0 THEN 1 ELSE 20 + CAST(floor(40 * abs(CAST({at} AS DOUBLE))) AS INT) END"
    return (
        "CAST(label AS INT) AS sample_id",
        "vec_id AS instance_id",
        "CAST(p AS INT) AS seq",
        f"CAST(100 + {radius} * {_DX} AS INT) AS x",
        f"CAST(100 + {radius} * {_DY} AS INT) AS y",
    )


POINTS_CTE = f"""
point_base AS (SELECT label, vec_id, embedding, unnest(range(0, 8)) AS p FROM embeddings),
points AS (SELECT {', '.join(_point_cols('duckdb'))} FROM point_base)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "label", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("p")
    )
    return rows.selectExpr(*_point_cols("spark"))
