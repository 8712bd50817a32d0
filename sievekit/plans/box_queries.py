"""Registered queries on boxes: overlap, greedy selection, merging, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import boxes as B
from sievekit.plans import testbed as T
from sievekit.plans.instance_queries import INST
from sievekit.plans.registry import query

# Boxes squeezed onto a small canvas, so that many of them overlap.
DENSE_COLS = (
    "sample_id", "grain_id", "confidence", "area", "p_size", "l_suppkey", "category_id",
    "x % 96 AS x", "y % 48 AS y", "w", "h",
)
DENSE_CTE = f"dense AS (SELECT {', '.join(DENSE_COLS)} FROM instances)"


def dense(spark, sf_dir):
    return T.instances(spark, sf_dir, ids=True, once=True).selectExpr(*DENSE_COLS)


def iou_sql(a: str, b: str) -> str:
    ow = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    oh = f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"(({ow} * {oh})::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {ow} * {oh}))"


@query(
    "keep_overlapping",
    f"""{INST}, d AS (SELECT sample_id - CAST(sample_id % 5 = 4 AS INT) AS sample_id, l_suppkey % 4 = 0 AND sample_id % 5 > 0 AS is_target, x % 400 AS x, y, w, h
  FROM instances WHERE category_id = 2),
t AS (SELECT * FROM d WHERE is_target)
SELECT i.sample_id, i.grain_id FROM instances i
WHERE i.sample_id NOT IN (SELECT sample_id FROM d)
   OR EXISTS (SELECT 1 FROM t WHERE t.sample_id = i.sample_id AND least(i.x + i.w, t.x + t.w) > greatest(i.x, t.x)
     AND least(i.y + i.h, t.y + t.h) > greatest(i.y, t.y))""",
)
def keep_overlapping(spark, sf_dir):
    """Every fifth sample has no detections, since its neighbour has them too; another fifth has none of the target kind."""
    inst = T.instances(spark, sf_dir, ids=True, once=True)
    found = inst.where("category_id = 2").selectExpr(
        "sample_id - CAST(sample_id % 5 = 4 AS INT) AS sample_id", "l_suppkey % 4 = 0 AND sample_id % 5 > 0 AS is_target", "x % 400 AS x", "y", "w", "h"
    )
    return B.keep_overlapping(inst, found).select("sample_id", "grain_id")


@query(
    "greedy_nms",
    f"""WITH RECURSIVE {T.INSTANCES_CTE}, {DENSE_CTE},
ranked AS (SELECT sample_id, grain_id, row_number() OVER (PARTITION BY sample_id ORDER BY confidence DESC, grain_id) AS rn,
  {{'grain_id': grain_id, 'x': x, 'y': y, 'w': w, 'h': h}} AS b FROM dense),
step AS (
  SELECT sample_id, CAST(0 AS BIGINT) AS k, list_filter([b], lambda q: false) AS kept FROM ranked WHERE rn = 1
  UNION ALL
  SELECT s.sample_id, s.k + 1, CASE WHEN len(list_filter(s.kept, lambda q: {iou_sql('q', 'r.b')} > 0.5)) > 0 THEN s.kept ELSE list_append(s.kept, r.b) END
  FROM step s JOIN ranked r ON r.sample_id = s.sample_id AND r.rn = s.k + 1),
last_t AS (SELECT sample_id, kept FROM step QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY k DESC) = 1)
SELECT sample_id, q.grain_id AS grain_id FROM (SELECT sample_id, unnest(kept) AS q FROM last_t)""",
)
def greedy_nms(spark, sf_dir):
    return B.greedy_nms(dense(spark, sf_dir), key="grain_id").select("sample_id", "grain_id")


@query(
    "merge_by_iou",
    f"""WITH RECURSIVE {T.INSTANCES_CTE}, {DENSE_CTE},
base AS (SELECT sample_id, grain_id AS seq, x, y, w, h FROM dense WHERE category_id = 2),
extra AS (SELECT sample_id, grain_id AS seq, row_number() OVER (PARTITION BY sample_id ORDER BY grain_id) AS rn,
  {{'seq': grain_id, 'x': x, 'y': y, 'w': w, 'h': h}} AS b FROM dense WHERE category_id = 1),
start AS (SELECT DISTINCT sample_id FROM dense),
based AS (SELECT sample_id, list({{'seq': seq, 'x': x, 'y': y, 'w': w, 'h': h}}) AS kept FROM base GROUP BY sample_id),
step AS (
  SELECT s.sample_id, CAST(0 AS BIGINT) AS k, coalesce(b.kept, []) AS kept, CAST([] AS BIGINT[]) AS added FROM start s LEFT JOIN based b ON s.sample_id = b.sample_id
  UNION ALL
  SELECT s.sample_id, s.k + 1, CASE WHEN len(list_filter(s.kept, lambda q: {iou_sql('q', 'r.b')} >= 0.5)) > 0 THEN s.kept ELSE list_append(s.kept, r.b) END,
    CASE WHEN len(list_filter(s.kept, lambda q: {iou_sql('q', 'r.b')} >= 0.5)) > 0 THEN s.added ELSE list_append(s.added, r.b.seq) END
  FROM step s JOIN extra r ON r.sample_id = s.sample_id AND r.rn = s.k + 1),
last_t AS (SELECT sample_id, added FROM step QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY k DESC) = 1),
merged AS (SELECT sample_id, 'base' AS origin, seq FROM base UNION ALL SELECT sample_id, 'extra', unnest(added) FROM last_t)
SELECT sample_id, origin, seq, row_number() OVER (PARTITION BY sample_id ORDER BY origin, seq) AS foreign_id FROM merged""",
)
def merge_by_iou(spark, sf_dir):
    rows = dense(spark, sf_dir).withColumnRenamed("grain_id", "seq")
    out = B.merge_by_iou(rows.where("category_id = 2"), rows.where("category_id = 1"))
    return out.select("sample_id", "origin", "seq", "foreign_id")


@query(
    "extra_components",
    f"""{INST}, {DENSE_CTE},
base AS (SELECT DISTINCT p_size, x, y, w, h FROM dense WHERE category_id = 2),
probe AS (SELECT * FROM dense WHERE category_id = 1 AND area >= 2000)
SELECT sample_id, grain_id, area FROM probe p WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.p_size = p.p_size AND b.x = p.x AND b.y = p.y AND b.w = p.w AND b.h = p.h)""",
)
def extra_components(spark, sf_dir):
    rows = dense(spark, sf_dir)
    out = B.extra_components(
        rows.where("category_id = 1"), rows.where("category_id = 2"), by=("p_size",), min_area=2000
    )
    return out.select("sample_id", "grain_id", "area")


_IMAGE_COLS = ("p_partkey AS sample_id", "200 + p_size * 61 AS image_w", "100 + (p_partkey * 37) % 2600 AS image_h")


@query(
    "plan_tiles",
    f"""WITH img AS (SELECT {', '.join(_IMAGE_COLS)} FROM part),
ys AS (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((image_h - 640) / 512.0) AS BIGINT)))) * 512 AS tile_y FROM img),
t AS (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((image_w - 640) / 512.0) AS BIGINT)))) * 512 AS tile_x FROM ys)
SELECT sample_id, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y, CAST(least(640, image_w - tile_x) AS INT) AS tile_w,
  CAST(least(640, image_h - tile_y) AS BIGINT) AS tile_h, greatest(image_w, image_h) > 640 AS tiled FROM t""",
)
def plan_tiles(spark, sf_dir):
    images = T.table(spark, sf_dir, "part").selectExpr(*_IMAGE_COLS)
    return B.plan_tiles(images).drop("image_w", "image_h")


@query(
    "tile_to_global",
    f"""{INST}, t AS (SELECT sample_id, x + 512 * (l_suppkey % 3) AS gx, y + 512 * (l_linenumber % 2) AS gy FROM instances)
SELECT sample_id, CAST(min(gx) AS BIGINT) AS min_x, CAST(max(gx) AS BIGINT) AS max_x, CAST(sum(gy) AS BIGINT) AS sum_y FROM t GROUP BY sample_id""",
)
def tile_to_global(spark, sf_dir):
    rows = T.instances(spark, sf_dir).withColumns(
        {"tile_x": F.col("l_suppkey") % 3 * 512, "tile_y": F.col("l_linenumber") % 2 * 512}
    )
    return B.tile_to_global(rows).groupBy("sample_id").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.sum("y").alias("sum_y")
    )
