"""Registered queries on pixels, components and contours."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.fixed import GLCM_OFFSETS
from sievekit.functions import colour as C
from sievekit.functions import rules as R
from sievekit.operators import boxes as B
from sievekit.operators import components as CC
from sievekit.operators import contours as CT
from sievekit.operators import pixels as PX
from sievekit.plans import testbed as T
from sievekit.plans.instance_queries import r
from sievekit.plans.registry import query


def _lin(v: str) -> str:
    return f"CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({v} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


def _root(t: str) -> str:
    return f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3) ELSE {t} * 7.787::DOUBLE + 16.0::DOUBLE / 116 END"


def _byte(e: str) -> str:
    return f"CAST(greatest(0, least(255, floor({e} + 0.5))) AS INT)"


LAB_CTE = f"""
lab_lin AS (SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM pixels),
lab_xyz AS (SELECT *, (lr * 0.412453::DOUBLE + lg * 0.357580::DOUBLE + lb * 0.180423::DOUBLE) / 0.950456::DOUBLE AS cx,
  (lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE) / 1.0 AS cy,
  (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.088754::DOUBLE AS cz FROM lab_lin),
lab_f AS (SELECT *, {_root('cx')} AS fx, {_root('cy')} AS fy, {_root('cz')} AS fz FROM lab_xyz),
lab_t AS (
  SELECT * EXCLUDE (lr, lg, lb, cx, cy, cz, fx, fy, fz),
    {_byte('(CASE WHEN cy > 0.008856 THEN pow(cy, 1.0::DOUBLE / 3) * 116 - 16 ELSE cy * 903.3::DOUBLE END) * 255 / 100')} AS lab_l,
    {_byte('(fx - fy) * 500 + 128')} AS lab_a, {_byte('(fy - fz) * 200 + 128')} AS lab_b FROM lab_f),
hsv_s AS (SELECT *, greatest(r, g, b)::DOUBLE AS top, greatest(r, g, b)::DOUBLE - least(r, g, b) AS span FROM lab_t),
hsv_h AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN top = r THEN (g - b) * 60.0::DOUBLE / span WHEN top = g THEN (b - r) * 60.0::DOUBLE / span + 120
  ELSE (r - g) * 60.0::DOUBLE / span + 240 END AS raw_h FROM hsv_s),
colours AS (
  SELECT * EXCLUDE (top, span, raw_h), {_byte('CASE WHEN raw_h < 0 THEN raw_h + 360 ELSE raw_h END / 2')} AS hue,
    CASE WHEN top > 0 THEN {_byte('span * 255.0 / top')} ELSE 0 END AS sat, CAST(top AS INT) AS val FROM hsv_h)"""
PIX = f"WITH {T.PIXELS_CTE}"
COL = f"WITH {T.PIXELS_CTE}, {LAB_CTE}"


@query(
    "colour_convert",
    f"""{COL} SELECT instance_id, CAST(sum(gray) AS BIGINT) AS gray, CAST(sum(lab_l) AS BIGINT) AS lab_l, CAST(sum(lab_a) AS BIGINT) AS lab_a,
  CAST(sum(lab_b) AS BIGINT) AS lab_b, CAST(sum(hue) AS BIGINT) AS hue, CAST(sum(sat) AS BIGINT) AS sat, CAST(sum(val) AS BIGINT) AS val FROM colours GROUP BY instance_id""",
)
def colour_convert(spark, sf_dir):
    rows = PX.with_hsv(C.with_lab8(PX.with_gray(T.pixels(spark, sf_dir))))
    names = ("gray", "lab_l", "lab_a", "lab_b", "hue", "sat", "val")
    return rows.groupBy("instance_id").agg(*[F.sum(k).cast("long").alias(k) for k in names])


@query(
    "instance_extent",
    f"""{PIX} SELECT sample_id, instance_id, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h,
  {r('avg(x)', 2)} AS cx, {r('avg(y)', 2)} AS cy FROM pixels WHERE mask GROUP BY ALL""",
)
def instance_extent(spark, sf_dir):
    return PX.instance_extent(T.pixels(spark, sf_dir))


@query(
    "red_area",
    f"""{COL}, s AS (
  SELECT sample_id, instance_id, count(*) AS pixels, count(*) FILTER (WHERE (hue <= 10 OR hue BETWEEN 170 AND 180) AND sat >= 50 AND val >= 50) AS red_pixels,
    avg(lab_a - 128) AS a, stddev_pop(lab_a) AS sd FROM colours WHERE mask GROUP BY ALL)
SELECT sample_id, instance_id, CASE WHEN red_pixels::DOUBLE / pixels >= 0.15 AND a > 10 THEN 'red' ELSE 'not_red' END AS red_label,
  {r('red_pixels::DOUBLE / pixels')} AS red_area_fraction,
  {r('greatest(0.0, least(1.0, (a - 5) / 15)) * 0.5 + least(1.0, red_pixels::DOUBLE / pixels / 0.15::DOUBLE) * 0.5')} AS red_confidence,
  {r('a', 2)} AS a_mean, {r('sd', 2)} AS a_std, red_pixels, pixels FROM s""",
)
def red_area(spark, sf_dir):
    return PX.red_area(T.pixels(spark, sf_dir))


@query(
    "bran_coverage",
    f"""{COL}, s AS (SELECT sample_id, instance_id, avg(CASE WHEN hue BETWEEN 10 AND 30 AND sat BETWEEN 40 AND 255 AND val BETWEEN 40 AND 200 THEN 1.0 ELSE 0.0 END) AS share
  FROM colours WHERE mask GROUP BY ALL)
SELECT sample_id, instance_id, CASE WHEN share >= 0.25 THEN 'dehusked' ELSE 'not_dehusked' END AS dehusked_label, {r('share')} AS surface_fraction,
  {r('least(1.0, share / 0.25)')} AS dehusked_confidence FROM s""",
)
def bran_coverage(spark, sf_dir):
    return PX.bran_coverage(T.pixels(spark, sf_dir))


_REF = "ref AS (SELECT sample_id, median(lab_l) AS ref_l, median(lab_a) AS ref_a, median(lab_b) AS ref_b FROM colours WHERE mask GROUP BY sample_id)"


@query("reference_colour", f"{COL}, {_REF} SELECT * FROM ref")
def reference_colour(spark, sf_dir):
    return PX.reference_colour(T.pixels(spark, sf_dir))


@query(
    "discoloured",
    f"""{COL}, {_REF},
s AS (SELECT c.sample_id, c.instance_id, avg(CASE WHEN sqrt((lab_l - ref_l) * (lab_l - ref_l) + (lab_a - ref_a) * (lab_a - ref_a) + (lab_b - ref_b) * (lab_b - ref_b)) > 60 THEN 1.0 ELSE 0.0 END) AS share,
  avg(lab_l - ref_l) AS ml, avg(lab_a - ref_a) AS ma, avg(lab_b - ref_b) AS mb FROM colours c JOIN ref f ON c.sample_id = f.sample_id WHERE mask GROUP BY ALL)
SELECT sample_id, instance_id, CASE WHEN share >= 0.2::DOUBLE THEN 'discoloured' ELSE 'normal' END AS discoloured_label, {r('sqrt(ml * ml + ma * ma + mb * mb)', 2)} AS colour_distance,
  {r('share')} AS discoloured_fraction, {r('least(1.0, share / 0.2::DOUBLE)')} AS discoloured_confidence FROM s""",
)
def discoloured(spark, sf_dir):
    px = T.pixels(spark, sf_dir)
    return PX.discoloured(px, PX.reference_colour(px), delta=60.0)


@query(
    "clipping",
    f"""{PIX}, c AS (SELECT *, CASE WHEN x = 0 THEN 2 WHEN x = 7 THEN 252 ELSE gray END AS g2 FROM pixels WHERE mask)
SELECT sample_id, {r('avg(CASE WHEN g2 < 5 THEN 1.0 ELSE 0.0 END)')} AS clipped_dark, {r('avg(CASE WHEN g2 > 250 THEN 1.0 ELSE 0.0 END)')} AS clipped_bright FROM c GROUP BY sample_id""",
)
def clipping(spark, sf_dir):
    px = T.pixels(spark, sf_dir)
    v = F.when(F.col("x") == 0, 2).when(F.col("x") == 7, 252)
    return PX.clipping(px.withColumns({k: F.coalesce(v, k) for k in ("r", "g", "b")}))


@query(
    "illumination_uniformity",
    f"""{PIX}, m AS (SELECT instance_id, floor(x / 2) AS bx, floor(y / 2) AS yb, avg(gray) AS m FROM pixels WHERE mask GROUP BY ALL)
SELECT instance_id, {r('1 - least(1.0, stddev_pop(m) / 50)')} AS illumination,
  {r('coalesce(1 - least(1.0, stddev_pop(m) FILTER (WHERE bx < 3 AND yb < 3) / 50), 0.5)')} AS inner_illumination FROM m GROUP BY instance_id""",
)
def illumination_uniformity(spark, sf_dir):
    images = T.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS instance_id", "8 AS image_w", "8 AS image_h")
    pixels, by = T.pixels(spark, sf_dir), ("instance_id",)
    inner = PX.illumination_uniformity(pixels, images, by, min_block=2, far_edge=False)
    every = PX.illumination_uniformity(pixels, images, by, min_block=2)
    return every.join(inner.withColumnRenamed("illumination", "inner_illumination"), "instance_id")


def _lap_sql(value: str) -> str:
    """Reflected four-neighbour Laplacian on the 8x8 crops."""

    def at(dx: int, dy: int) -> str:
        def mirror(c: str, d: int) -> str:
            return c if d == 0 else (f"(CASE WHEN q.{c} = 7 THEN 6 ELSE q.{c} + 1 END)" if d > 0 else f"(CASE WHEN q.{c} = 0 THEN 1 ELSE q.{c} - 1 END)")

        ex = mirror("x", dx) if dx else "q.x"
        ey = mirror("y", dy) if dy else "q.y"
        return f"list_extract(vs, CAST({ey} * 8 + {ex} + 1 AS INT))"

    lap = " + ".join(at(*o) for o in PX.CROSS)
    return f"""grid AS (SELECT sample_id, instance_id, list({value} ORDER BY y, x) AS vs FROM pixels GROUP BY ALL),
lapped AS (SELECT q.sample_id, q.instance_id, q.x, q.y, q.mask, q.gray, {lap} - 4 * list_extract(vs, CAST(q.y * 8 + q.x + 1 AS INT)) AS lap
  FROM pixels q JOIN grid USING (sample_id, instance_id))"""


@query(
    "laplacian_variance",
    f"{PIX}, {_lap_sql('CASE WHEN mask THEN gray ELSE 0 END')} SELECT sample_id, instance_id, {r('var_pop(lap)')} AS blur FROM lapped WHERE mask GROUP BY ALL",
)
def laplacian_variance(spark, sf_dir):
    out = PX.laplacian_variance(T.pixels(spark, sf_dir))
    return out.select("sample_id", "instance_id", R.rnd("lap_var", 4).alias("blur"))


@query(
    "texture_features",
    f"""{COL} SELECT sample_id, instance_id, {r('avg(lab_l)')} AS mean_l, {r('stddev_pop(lab_l)')} AS std_l, {r('avg(lab_a - 128)')} AS mean_a, {r('avg(lab_b - 128)')} AS mean_b,
  {r('avg(CASE WHEN lab_l > 85 THEN 1.0 ELSE 0.0 END)')} AS bright_fraction, {r('avg(CASE WHEN sat < 40 AND val > 180 THEN 1.0 ELSE 0.0 END)')} AS chalky_fraction
FROM colours WHERE mask GROUP BY ALL""",
)
def texture_features(spark, sf_dir):
    return PX.texture_features(T.pixels(spark, sf_dir))


@query(
    "damaged_score",
    f"""{COL}, s AS (SELECT sample_id, instance_id, avg(lab_l) AS m, stddev_pop(lab_l) AS s, stddev_pop(lab_a) + stddev_pop(lab_b) AS ab FROM colours WHERE mask GROUP BY ALL),
d AS (SELECT c.sample_id, c.instance_id, any_value(s.s) AS s, any_value(s.ab) AS ab, avg(CASE WHEN lab_l < greatest(50.0, m - s.s * 2) THEN 1.0 ELSE 0.0 END) AS dark
  FROM colours c JOIN s ON c.sample_id = s.sample_id AND c.instance_id = s.instance_id WHERE mask GROUP BY ALL),
t AS (SELECT d.*, least(1.0, s / 30) * 0.3::DOUBLE + dark * 0.4::DOUBLE + least(1.0, ab / 20) * 0.3::DOUBLE AS score FROM d)
SELECT sample_id, instance_id, CASE WHEN score > 0.5 THEN 'damaged' ELSE 'normal' END AS damaged_label,
  {r('score')} AS damaged_score FROM t""",
)
def damaged_score(spark, sf_dir):
    return PX.damaged_score(T.pixels(spark, sf_dir))


@query(
    "hole_score",
    f"""{PIX}, {_lap_sql('CASE WHEN mask THEN gray ELSE 128 END')},
v AS (SELECT sample_id, instance_id, var_pop(lap) AS lv, avg(gray) AS m FROM lapped WHERE mask GROUP BY ALL),
d AS (SELECT p.sample_id, p.instance_id, any_value(lv) AS lv, avg(CASE WHEN gray < m * 0.5 THEN 1.0 ELSE 0.0 END) AS dark FROM pixels p JOIN v USING (sample_id, instance_id) WHERE mask GROUP BY ALL),
t AS (SELECT d.*, least(1.0, dark * 5) * 0.5 + least(1.0, lv / 5000) * 0.5 AS score FROM d)
SELECT sample_id, instance_id, CASE WHEN score > 0.5 THEN 'sprouted_weevilled' ELSE 'normal' END AS sprouted_label,
  {r('score')} AS sprouted_score FROM t""",
)
def hole_score(spark, sf_dir):
    return PX.hole_score(T.pixels(spark, sf_dir))


def _corner(dx: int, dy: int) -> str:
    ex = "(CASE WHEN q.x = 7 THEN 6 ELSE q.x + 1 END)" if dx > 0 else "(CASE WHEN q.x = 0 THEN 1 ELSE q.x - 1 END)"
    ey = "(CASE WHEN q.y = 7 THEN 6 ELSE q.y + 1 END)" if dy > 0 else "(CASE WHEN q.y = 0 THEN 1 ELSE q.y - 1 END)"
    return f"list_extract(vs, CAST({ey} * 8 + {ex} + 1 AS INT))"


_INNER = " AND ".join(
    f"(q.x + {dx} NOT BETWEEN 0 AND 7 OR q.y + {dy} NOT BETWEEN 0 AND 7 OR list_extract(ms, CAST((q.y + {dy}) * 8 + q.x + {dx} + 1 AS INT)))"
    for dx, dy in (*PX.CORNERS, *PX.CROSS)
)


@query(
    "instance_colour_features",
    f"""{COL}, grid AS (SELECT sample_id, instance_id, list(gray ORDER BY y, x) AS vs, list(mask ORDER BY y, x) AS ms FROM colours GROUP BY ALL),
near AS (SELECT q.*, abs(2 * ({' + '.join(_corner(*o) for o in PX.CORNERS)}) - 8 * q.gray) AS lap, {_INNER} AS inner_px FROM colours q JOIN grid USING (sample_id, instance_id) WHERE q.mask),
s AS (SELECT sample_id, instance_id, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(gray) AS gray, avg(sat) AS sat, avg(lab_l) AS l, avg(lab_a - 128) AS a, avg(lab_b - 128) AS bb,
  CASE WHEN count(*) FILTER (WHERE inner_px) >= 10 THEN avg(lap) FILTER (WHERE inner_px) ELSE avg(lap) END AS lap FROM near GROUP BY ALL)
SELECT sample_id, instance_id, n AS area_pixels, {r('r', 2)} AS mean_r, {r('g', 2)} AS mean_g, {r('b', 2)} AS mean_b, {r('gray', 2)} AS mean_gray,
  {r('l * 100.0 / 255.0', 2)} AS mean_l_star, {r('a', 2)} AS mean_a_star, {r('bb', 2)} AS mean_b_star, {r('sqrt(a * a + bb * bb)', 2)} AS chroma, {r('sat', 2)} AS saturation,
  {r('lap / (gray + 1)', 5)} AS surface_roughness, {r('greatest(0.0, 200.0 + sample_id - gray) / (200.0 + sample_id)')} AS background_gap_ratio FROM s""",
)
def instance_colour_features(spark, sf_dir):
    px = T.pixels(spark, sf_dir)
    background = px.select("sample_id").distinct().withColumn("background_gray", F.col("sample_id") + 200.0)
    return PX.instance_colour_features(px, background)


_OFF = ", ".join(f"({dx}, {dy})" for dx, dy in GLCM_OFFSETS)
GLCM_CTE = f"""
span AS (SELECT sample_id, instance_id, min(gray) AS lo, max(gray) AS hi FROM pixels WHERE mask GROUP BY ALL),
quant AS (SELECT p.sample_id, p.instance_id, x, y, CASE WHEN hi > lo THEN CAST(floor((gray - lo)::DOUBLE / (hi - lo) * 63) AS INT) ELSE 0 END AS q FROM pixels p JOIN span USING (sample_id, instance_id) WHERE mask),
glcm AS (
  SELECT a.sample_id, a.instance_id, a.q AS i, b.q AS j, count(*) AS n FROM quant a CROSS JOIN (VALUES {_OFF}) o(dx, dy)
  JOIN quant b ON b.sample_id = a.sample_id AND b.instance_id = a.instance_id AND b.x = a.x + o.dx AND b.y = a.y + o.dy GROUP BY ALL)"""


@query("cooccurrence", f"{PIX}, {GLCM_CTE} SELECT * FROM glcm")
def cooccurrence(spark, sf_dir):
    return PX.cooccurrence(T.pixels(spark, sf_dir))


@query(
    "cooccurrence_features",
    f"""{PIX}, {GLCM_CTE},
t AS (SELECT sample_id, instance_id, sum(n)::DOUBLE AS t FROM glcm GROUP BY ALL),
m AS (SELECT sample_id, instance_id, sum(i * n) / sum(n)::DOUBLE AS mi, sum(j * n) / sum(n)::DOUBLE AS mj FROM glcm GROUP BY ALL),
s AS (SELECT g.sample_id, g.instance_id, sum(n * (i - j) * (i - j)) / any_value(t) AS con, sum(n / (1.0 + abs(i - j))::DOUBLE) / any_value(t) AS hom, sum(n * n) / (any_value(t) * any_value(t)) AS en,
  sqrt(sum(n * (i - mi) * (i - mi)) / any_value(t)) AS si, sqrt(sum(n * (j - mj) * (j - mj)) / any_value(t)) AS sj, sum(n * (i - mi) * (j - mj)) / any_value(t) AS cv
  FROM glcm g JOIN t USING (sample_id, instance_id) JOIN m USING (sample_id, instance_id) GROUP BY ALL)
SELECT sample_id, instance_id, {r('con', 4)} AS contrast, {r('hom', 4)} AS homogeneity, {r('en', 6)} AS energy,
  CASE WHEN si > 0 AND sj > 0 THEN {r('cv / (si * sj)', 4)} ELSE 0.0 END AS correlation FROM s""",
)
def cooccurrence_features(spark, sf_dir):
    return PX.cooccurrence_features(PX.cooccurrence(T.pixels(spark, sf_dir)))


OTSU_CTE = """
bins AS (SELECT instance_id, gray, count(*) AS n FROM pixels GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER u AS w0, sum(n * gray) OVER u AS s0, sum(n) OVER a AS w, sum(n * gray) OVER a AS s FROM bins
  WINDOW u AS (PARTITION BY instance_id ORDER BY gray), a AS (PARTITION BY instance_id)),
between_t AS (SELECT *, CASE WHEN w0 < w THEN (s::DOUBLE * w0 - s0::DOUBLE * w) * (s::DOUBLE * w0 - s0::DOUBLE * w) / (w0::DOUBLE * (w - w0)) ELSE 0.0 END AS v FROM cum),
otsu_t AS (SELECT instance_id, gray AS otsu FROM between_t QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY v DESC, gray) = 1)"""


@query("otsu_threshold", f"{PIX}, {OTSU_CTE} SELECT * FROM otsu_t")
def otsu_threshold(spark, sf_dir):
    return PX.otsu_threshold(PX.with_gray(T.pixels(spark, sf_dir)), ("instance_id",))


_FACTS = f"""{OTSU_CTE},
sided AS (SELECT p.*, otsu, CAST(y < 3 AS INT) + CAST(y >= 5 AS INT) + CAST(x < 3 AS INT) + CAST(x >= 5 AS INT) AS sides FROM pixels p JOIN otsu_t USING (instance_id)),
border AS (SELECT instance_id, median(gray) AS bg FROM (SELECT instance_id, gray, unnest(range(0, sides)) FROM sided) GROUP BY instance_id),
facts AS (SELECT instance_id, any_value(otsu) AS otsu, sum(CASE WHEN gray < otsu THEN sides ELSE 0 END)::DOUBLE / sum(sides) AS db, avg(CASE WHEN gray > otsu THEN 1.0 ELSE 0.0 END) AS bright FROM sided GROUP BY instance_id),
polar AS (SELECT *, CASE WHEN db >= 0.5 THEN NOT (bright > 0.7::DOUBLE AND 1 - bright < 0.3::DOUBLE) ELSE 1 - bright > 0.7::DOUBLE AND bright < 0.3::DOUBLE END AS dark FROM facts)"""


@query(
    "foreground_mask",
    f"""{PIX}, {_FACTS}
SELECT p.instance_id, p.otsu, p.dark AS is_dark_bg, {r('db', 3)} AS dark_border_fraction, {r('bg', 2)} AS background_gray,
  {r('CASE WHEN dark THEN bright ELSE 1 - bright END')} AS fg_ratio, count(*) FILTER (WHERE (s.gray > s.otsu) = p.dark) AS fg_pixels
FROM polar p JOIN border USING (instance_id) JOIN sided s ON s.instance_id = p.instance_id GROUP BY ALL""",
)
def foreground_mask(spark, sf_dir):
    images = T.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS instance_id", "8 AS image_w", "8 AS image_h")
    marked, facts = PX.foreground_mask(T.pixels(spark, sf_dir), images, ("instance_id",))
    counts = marked.groupBy("instance_id").agg(F.count_if("fg").alias("fg_pixels"))
    return facts.drop("is_blank").join(counts, "instance_id")


_CANVAS = "x + 7 * CAST(instance_id % 10 AS INT) AS gx, y + 7 * CAST(floor(instance_id / 10) % 10 AS INT) AS gy"


@query(
    "flag_touching",
    f"""{PIX}, c AS (SELECT instance_id % 97 AS canvas, instance_id, {_CANVAS} FROM pixels WHERE mask),
t AS (SELECT DISTINCT a.canvas, a.instance_id FROM c a JOIN c b ON a.canvas = b.canvas AND a.instance_id <> b.instance_id AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1)
SELECT DISTINCT c.canvas, c.instance_id, t.instance_id IS NOT NULL AS is_touching FROM c LEFT JOIN t ON c.canvas = t.canvas AND c.instance_id = t.instance_id""",
)
def flag_touching(spark, sf_dir):
    rows = T.pixels(spark, sf_dir).selectExpr(
        "instance_id % 97 AS canvas", "instance_id", "mask", *_CANVAS.split(", ")
    )
    rows = rows.withColumnsRenamed({"gx": "x", "gy": "y"})
    return PX.flag_touching(rows, by=("canvas",))


@query(
    "greedy_mask_nms",
    f"""WITH RECURSIVE {T.PIXELS_CTE},
c AS (SELECT instance_id % 97 AS canvas, instance_id, instance_id % 8 AS conf, y * 16 + x + instance_id % 3 AS place FROM pixels WHERE mask),
sets AS (SELECT canvas, instance_id, any_value(conf) AS conf, list(place) AS ps FROM c GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY canvas ORDER BY conf DESC, instance_id) AS rn FROM sets),
pairs AS (SELECT a.canvas, a.instance_id AS better, b.instance_id AS worse FROM ranked a JOIN ranked b ON a.canvas = b.canvas AND a.rn < b.rn
  AND len(list_intersect(a.ps, b.ps))::DOUBLE / (len(a.ps) + len(b.ps) - len(list_intersect(a.ps, b.ps))) > 0.5),
blocks AS (SELECT canvas, worse AS instance_id, list(better) AS bs FROM pairs GROUP BY ALL),
step AS (
  SELECT canvas, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM ranked WHERE rn = 1
  UNION ALL
  SELECT s.canvas, s.k + 1, CASE WHEN len(list_intersect(coalesce(b.bs, []), s.kept)) > 0 THEN s.kept ELSE list_append(s.kept, q.instance_id) END
  FROM step s JOIN ranked q ON q.canvas = s.canvas AND q.rn = s.k + 1 LEFT JOIN blocks b ON b.canvas = q.canvas AND b.instance_id = q.instance_id),
last_t AS (SELECT canvas, kept FROM step QUALIFY row_number() OVER (PARTITION BY canvas ORDER BY k DESC) = 1)
SELECT canvas, unnest(kept) AS instance_id FROM last_t""",
)
def greedy_mask_nms(spark, sf_dir):
    """All mask pixels; masks of a canvas are shifted by up to two columns, so that they differ."""
    rows = T.pixels(spark, sf_dir).where("mask").selectExpr(
        "instance_id % 97 AS canvas", "instance_id", "instance_id % 8 AS confidence", "x + instance_id % 3 AS x", "y"
    )
    return B.greedy_mask_nms(rows, by=("canvas",))


# --- components -------------------------------------------------------------

COMPONENT_CTE = f"""{T.PIXELS_CTE},
fg AS (SELECT instance_id, x, y, y * 8 + x AS id FROM pixels WHERE r >= 140),
nb AS (SELECT a.instance_id, a.id AS a, b.id AS b FROM fg a JOIN fg b ON a.instance_id = b.instance_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT instance_id, id, id AS root FROM fg UNION SELECT n.instance_id, n.b, q.root FROM reach q JOIN nb n ON n.instance_id = q.instance_id AND n.a = q.id),
comp AS (SELECT instance_id, id, min(root) AS root FROM reach GROUP BY ALL),
stats AS (SELECT c.instance_id, c.root, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h
  FROM comp c JOIN fg USING (instance_id, id) GROUP BY ALL)"""


def _components(spark, sf_dir):
    rows = T.pixels(spark, sf_dir).select("instance_id", "x", "y", (F.col("r") >= 140).alias("fg"))
    return CC.component_stats(CC.label_components(rows, ("instance_id",)), ("instance_id",), min_area=6)


@query(
    "label_components",
    f"""WITH RECURSIVE {COMPONENT_CTE} SELECT instance_id, CAST(area AS BIGINT) AS area, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h,
  area >= 6 AS accepted FROM stats""",
)
def label_components(spark, sf_dir):
    return _components(spark, sf_dir).drop("label")


@query(
    "component_stats",
    f"""WITH RECURSIVE {COMPONENT_CTE} SELECT instance_id, count(*) FILTER (WHERE area >= 6) AS accepted, count(*) FILTER (WHERE area < 6) AS rejected,
  coalesce({r('median(CASE WHEN area >= 6 THEN area END)', 2)}, 2000.0) AS median_area FROM stats GROUP BY instance_id""",
)
def component_stats(spark, sf_dir):
    return CC.component_summary(_components(spark, sf_dir), ("instance_id",))


# --- contours ---------------------------------------------------------------

MOMENT_CTE = f"""{T.POINTS_CTE},
edges AS (SELECT a.sample_id, a.instance_id, a.x::DOUBLE AS x, a.y::DOUBLE AS y, b.x::DOUBLE AS u, b.y::DOUBLE AS v FROM points a
  JOIN points b ON a.instance_id = b.instance_id AND b.seq = (a.seq + 1) % 8),
sums AS (SELECT sample_id, instance_id, sum(x * v - u * y) / 2 AS a, sum(sqrt((u - x) * (u - x) + (v - y) * (v - y))) AS perimeter,
  sum((x * v - u * y) * (x + u)) / 6 AS sx, sum((x * v - u * y) * (y + v)) / 6 AS sy, sum((x * v - u * y) * (x * x + x * u + u * u)) / 12 AS sxx,
  sum((x * v - u * y) * (y * y + y * v + v * v)) / 12 AS syy, sum((x * v - u * y) * (x * (2 * y + v) + u * (2 * v + y))) / 24 AS sxy FROM edges GROUP BY ALL),
moments AS (SELECT sample_id, instance_id, abs(a) AS area, perimeter, sx / a AS cx, sy / a AS cy, sign(a) * sxx - abs(a) * (sx / a) * (sx / a) AS mu20,
  sign(a) * syy - abs(a) * (sy / a) * (sy / a) AS mu02, sign(a) * sxy - abs(a) * (sx / a) * (sy / a) AS mu11 FROM sums)"""


@query(
    "polygon_measures",
    f"""WITH {MOMENT_CTE} SELECT sample_id, instance_id, {r('area')} AS area, {r('perimeter')} AS perimeter, {r('cx')} AS cx, {r('cy')} AS cy,
  CASE WHEN area < 5 THEN 'Contour area < 5 pixels' END AS refused FROM moments""",
)
def polygon_measures(spark, sf_dir):
    return CT.polygon_measures(CT.polygon_moments(T.points(spark, sf_dir)))


@query(
    "principal_spans",
    f"""WITH {MOMENT_CTE},
axis AS (SELECT *, cos(0.5 * atan2(2 * mu11, mu20 - mu02)) AS c, sin(0.5 * atan2(2 * mu11, mu20 - mu02)) AS s FROM moments),
proj AS (SELECT p.sample_id, p.instance_id, (x - cx) * c + (y - cy) * s AS u, (y - cy) * c - (x - cx) * s AS v FROM points p JOIN axis a ON p.instance_id = a.instance_id)
SELECT sample_id, instance_id, {r('max(u) - min(u)')} AS principal_span, {r('max(v) - min(v)')} AS transverse_span,
  {r('greatest(max(u) - min(u), max(v) - min(v))')} AS caliper_length FROM proj GROUP BY ALL""",
)
def principal_spans(spark, sf_dir):
    """Symmetric outlines (every 37th) have no principal axis and are left out."""
    pts = T.points(spark, sf_dir)
    return CT.principal_spans(pts, CT.polygon_moments(pts))


@query(
    "thin_points",
    f"""WITH {T.POINTS_CTE} SELECT instance_id, string_agg(concat(CAST(x AS STRING), ':', CAST(y AS STRING)), ' ' ORDER BY seq) AS outline
FROM points WHERE seq % 2 = 0 GROUP BY instance_id""",
)
def thin_points(spark, sf_dir):
    """The eight vertices of an outline, thinned to about three."""
    pts = T.points(spark, sf_dir).groupBy("instance_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")
    )
    text = F.transform(R.thin_points("p", 3), lambda q: F.concat(q["x"].cast("string"), F.lit(":"), q["y"].cast("string")))
    return pts.select("instance_id", F.concat_ws(" ", text).alias("outline"))
