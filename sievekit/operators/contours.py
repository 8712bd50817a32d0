"""Polygon measures from contour points ``(by, seq, x, y)``, seq 0..n-1 along the outline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.rules import rnd

OUTLINE = ("sample_id", "instance_id")


def _edge_terms(x: Column, y: Column, u: Column, v: Column) -> dict[str, Column]:
    """Green's formula per edge (x, y) -> (u, v)."""
    cross = x * v - u * y
    return {
        "length": F.sqrt((u - x) * (u - x) + (v - y) * (v - y)),
        "a": cross,
        "sx": cross * (x + u),
        "sy": cross * (y + v),
        "sxx": cross * (x * x + x * u + u * u),
        "syy": cross * (y * y + y * v + v * v),
        "sxy": cross * (x * (y * 2 + v) + u * (v * 2 + y)),
    }


def polygon_moments(points: DataFrame, by: Sequence[str] = OUTLINE) -> DataFrame:
    """Area, perimeter, centroid and central second moments of each closed outline.

    Each point is sent to its own place and to the edge before it, so edges form by one
    grouping on (outline, seq); the closing edge joins the last point to the first.
    """
    by = list(by)
    xy = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sent = points.select(*by, "seq", xy.alias("p"), F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
    here = F.col("back") == 0
    edge = sent.groupBy(*by, (F.col("seq") - F.col("back")).alias("seq")).agg(
        F.max(F.when(here, F.col("p"))).alias("p"), F.max(F.when(~here, F.col("p"))).alias("q")
    )
    terms = _edge_terms(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y"))
    sums = edge.groupBy(*by).agg(
        *[F.coalesce(F.sum(t), F.lit(0.0)).alias(k) for k, t in terms.items()],
        F.count("p").alias("points"),
        F.min_by("p", F.when(F.col("p").isNotNull(), F.col("seq"))).alias("first"),
        F.max_by("p", F.when(F.col("p").isNotNull(), F.col("seq"))).alias("last"),
    )
    closing = _edge_terms(F.col("last.x"), F.col("last.y"), F.col("first.x"), F.col("first.y"))
    sums = sums.select(*by, "points", *[(F.col(k) + t).alias(k) for k, t in closing.items()])
    sign = F.when(F.col("a") < 0, -1.0).otherwise(1.0)
    m00 = F.abs(F.col("a")) / 2.0
    ok = m00 > 0
    cx = F.when(ok, F.try_divide(sign * F.col("sx") / 6.0, m00))
    cy = F.when(ok, F.try_divide(sign * F.col("sy") / 6.0, m00))
    out = sums.withColumns({"area": m00, "cx": cx, "cy": cy, "sign": sign})
    return out.select(
        *by,
        "points",
        "area",
        F.col("length").alias("perimeter"),
        "cx",
        "cy",
        (F.col("sign") * F.col("sxx") / 12.0 - F.col("area") * F.col("cx") * F.col("cx")).alias("mu20"),
        (F.col("sign") * F.col("syy") / 12.0 - F.col("area") * F.col("cy") * F.col("cy")).alias("mu02"),
        (F.col("sign") * F.col("sxy") / 24.0 - F.col("area") * F.col("cx") * F.col("cy")).alias("mu11"),
    )


def polygon_measures(moments: DataFrame, by: Sequence[str] = OUTLINE) -> DataFrame:
    """Rounded area, perimeter and centroid, with the reason a contour is refused."""
    refused = F.when(F.col("area") < 5, "Contour area < 5 pixels").when(F.col("cx").isNull(), "Zero moment contour")
    return moments.select(
        *by, rnd("area", 4).alias("area"), rnd("perimeter", 4).alias("perimeter"), rnd("cx", 4).alias("cx"),
        rnd("cy", 4).alias("cy"), refused.alias("refused"),
    )


def principal_spans(points: DataFrame, moments: DataFrame, by: Sequence[str] = OUTLINE) -> DataFrame:
    """Extent of the outline along and across its principal axis; caliper is the larger."""
    by = list(by)
    theta = F.atan2(F.col("mu11") * 2.0, F.col("mu20") - F.col("mu02")) * 0.5
    axis = moments.where("cx IS NOT NULL").select(*by, "cx", "cy", F.cos(theta).alias("c"), F.sin(theta).alias("s"))
    rows = points.join(axis, by)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    along, across = dx * F.col("c") + dy * F.col("s"), dy * F.col("c") - dx * F.col("s")
    out = rows.groupBy(*by).agg(
        (F.max(along) - F.min(along)).alias("principal"), (F.max(across) - F.min(across)).alias("transverse")
    )
    return out.select(
        *by,
        rnd("principal", 4).alias("principal_span"),
        rnd("transverse", 4).alias("transverse_span"),
        rnd(F.greatest("principal", "transverse"), 4).alias("caliper_length"),
    )
