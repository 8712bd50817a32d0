"""Colour, texture and sharpness of instances from their pixels.

A pixel table has one row per pixel of an instance's rectangular crop: key columns, ``x``,
``y``, ``r``, ``g``, ``b`` and ``mask``. Pixels outside the table lie outside the frame.
Neighbourhoods are read inside of tiles that have a rim of their neighbours' pixels: one shuffle
keyed by the tile, of little more than the pixels, so a huge image is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sievekit.fixed import BROWN_BAND, GLCM_OFFSETS, RED_BANDS
from sievekit.functions import colour as C
from sievekit.functions.rules import rnd
from sievekit.operators.scaling import keyed_join

INSTANCE = ("sample_id", "instance_id")
CROSS = ((1, 0), (-1, 0), (0, 1), (0, -1))
CORNERS = ((1, 1), (-1, 1), (1, -1), (-1, -1))
#: Along a row, a column and the two diagonals.
_STEPS = ((1, 0), (0, 1), (1, 1), (1, -1))
#: Side of a tile; the rim of 1 or 3 pixels adds 6 or 20 percent.
TILE = 64


def tiled(pixels: DataFrame, by: Sequence[str], reach: int) -> DataFrame:
    """Pixels dealt by tile (``tx``, ``ty``), with a rim of copies from next to it; ``home`` tells the tile's own."""

    def tile(at: Column) -> Column:
        return F.floor((at + TILE // 2) / TILE)  # crops begin at 0, which is not an edge

    def tiles(at: str) -> Column:
        return F.explode(F.sequence(tile(F.col(at) - reach), tile(F.col(at) + reach)))

    sent = pixels.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))
    home = (F.col("tx") == tile(F.col("x"))) & (F.col("ty") == tile(F.col("y")))
    return sent.withColumn("home", home).repartition(*by, "tx", "ty")


def along(by: Sequence[str], dx: int, dy: int, low: int, high: int) -> WindowSpec:
    """The pixels of a tile from ``low`` to ``high`` steps of (dx, dy) from each one; a step is to one of the eight around it."""
    line = dict(zip(_STEPS, (F.col("y"), F.col("x"), F.col("x") - F.col("y"), F.col("x") + F.col("y"))))[dx, dy]
    return Window.partitionBy(*by, "tx", "ty", line).orderBy("x" if dx else "y").rangeBetween(low, high)


def gather(
    pixels: DataFrame, by: Sequence[str], offsets: Sequence[tuple[int, int]], value: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """Every pixel with ``n0..``: the value at each offset from it, null where there is none.

    Offsets lie in a row, a column or a diagonal. Each of these is a window inside of a tile, in
    which the neighbour is the row at that distance; all share the shuffle of the tiles.
    """
    sent = tiled(pixels.select(*by, "x", "y", *keep, value.alias("v")), by, max(max(abs(dx), abs(dy)) for dx, dy in offsets))
    found = {}
    for i, (dx, dy) in enumerate(offsets):
        far = max(abs(dx), abs(dy))
        if (dx // far, dy // far) not in _STEPS:
            far = -far
        step = (dx // far, dy // far)
        found[f"n{i}"] = F.max("v").over(along(by, *step, far, far))
    return sent.withColumns(found).where("home").drop("tx", "ty", "home")


def with_gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", C.gray("r", "g", "b"))


def with_hsv(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns(
        {"hue": C.hue8("r", "g", "b"), "sat": C.saturation8("r", "g", "b"), "val": C.value8("r", "g", "b")}
    )


def _share(hit: Column) -> Column:
    return F.avg(F.when(hit, 1.0).otherwise(0.0))


# --- shape and colour -------------------------------------------------------


def instance_extent(pixels: DataFrame, by: Sequence[str] = INSTANCE) -> DataFrame:
    return pixels.where("mask").groupBy(*by).agg(
        F.count("*").alias("area"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        rnd(F.avg("x")).alias("cx"),
        rnd(F.avg("y")).alias("cy"),
    )


def red_area(pixels: DataFrame, by: Sequence[str] = INSTANCE, min_share: float = 0.15, min_a: float = 10.0) -> DataFrame:
    rows = with_hsv(C.with_lab8(pixels.where("mask")))
    red = F.lit(False)
    for band in RED_BANDS:
        red = red | C.in_band("hue", "sat", "val", band, cap_sv=False)
    out = rows.groupBy(*by).agg(
        _share(red).alias("share"), F.avg(F.col("lab_a") - 128).alias("a"), F.stddev_pop("lab_a").alias("sd"),
        F.count_if(red).alias("red_pixels"), F.count("*").alias("pixels"),
    )
    a_part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("a") - 5) / 15))
    return out.select(
        *by,
        F.when((F.col("share") >= min_share) & (F.col("a") > min_a), "red").otherwise("not_red").alias("red_label"),
        rnd("share", 4).alias("red_area_fraction"),
        rnd(a_part * 0.5 + F.least(F.lit(1.0), F.col("share") / min_share) * 0.5, 4).alias("red_confidence"),
        rnd("a").alias("a_mean"),
        rnd("sd").alias("a_std"),
        "red_pixels",
        "pixels",
    )


def bran_coverage(pixels: DataFrame, by: Sequence[str] = INSTANCE, min_share: float = 0.25) -> DataFrame:
    brown = C.in_band("hue", "sat", "val", BROWN_BAND)
    out = with_hsv(pixels.where("mask")).groupBy(*by).agg(_share(brown).alias("share"))
    return out.select(
        *by,
        F.when(F.col("share") >= min_share, "dehusked").otherwise("not_dehusked").alias("dehusked_label"),
        rnd("share", 4).alias("surface_fraction"),
        rnd(F.least(F.lit(1.0), F.col("share") / min_share), 4).alias("dehusked_confidence"),
    )


def reference_colour(pixels: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Median L*a*b* byte per sample; a byte has 256 values, so the exact state is bounded."""
    rows = C.with_lab8(pixels.where("mask"))
    return rows.groupBy(*by).agg(
        *[F.percentile(f"lab_{k}", F.lit(0.5)).alias(f"ref_{k}") for k in ("l", "a", "b")]
    )


def discoloured(
    pixels: DataFrame,
    reference: DataFrame,
    by: Sequence[str] = INSTANCE,
    sample: Sequence[str] = ("sample_id",),
    delta: float = 15.0,
    min_share: float = 0.20,
) -> DataFrame:
    """Share of pixels far from the sample's colour; undetermined without a reference."""
    rows = C.with_lab8(pixels.where("mask")).join(reference, list(sample), "left")
    gap = {k: F.col(f"lab_{k}") - F.col(f"ref_{k}") for k in ("l", "a", "b")}
    far = F.sqrt(gap["l"] * gap["l"] + gap["a"] * gap["a"] + gap["b"] * gap["b"])
    out = rows.groupBy(*by).agg(
        _share(far > delta).alias("share"),
        *[F.avg(gap[k]).alias(f"m{k}") for k in gap],
    )
    mean_far = F.sqrt(F.col("ml") * F.col("ml") + F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb"))
    known = F.col("ml").isNotNull()
    return out.select(
        *by,
        F.when(~known, "undetermined")
        .when(F.col("share") >= min_share, "discoloured")
        .otherwise("normal")
        .alias("discoloured_label"),
        rnd(mean_far).alias("colour_distance"),
        F.when(known, rnd("share", 4)).alias("discoloured_fraction"),
        F.when(known, rnd(F.least(F.lit(1.0), F.col("share") / min_share), 4)).otherwise(0.0).alias("discoloured_confidence"),
    )


def clipping(pixels: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    return with_gray(pixels.where("mask")).groupBy(*by).agg(
        rnd(_share(F.col("gray") < 5), 4).alias("clipped_dark"), rnd(_share(F.col("gray") > 250), 4).alias("clipped_bright")
    )


def illumination_uniformity(
    pixels: DataFrame, images: DataFrame, by: Sequence[str] = ("sample_id",), min_block: int = 32,
    far_edge: bool = True,
) -> DataFrame:
    """1 minus the spread of block means; ``far_edge`` decides on blocks at the right and lower edge."""
    side = F.greatest(F.lit(min_block), F.floor(F.least("image_w", "image_h") / 8)).cast("int")
    frames = images.select(*by, "image_w", "image_h", side.alias("block"))
    rows = with_gray(pixels.where("mask")).join(frames, list(by))
    rows = rows.withColumns({"bx": F.floor(F.col("x") / F.col("block")), "by_": F.floor(F.col("y") / F.col("block"))})
    inside = (F.col("bx") * F.col("block") < F.col("image_w") - F.col("block")) & (
        F.col("by_") * F.col("block") < F.col("image_h") - F.col("block")
    )
    means = (rows if far_edge else rows.where(inside)).groupBy(*by, "bx", "by_").agg(F.avg("gray").alias("m"))
    spread = means.groupBy(*by).agg(F.stddev_pop("m").alias("s"))
    score = 1.0 - F.least(F.lit(1.0), F.col("s") / 50.0)
    return images.select(*by).join(spread, list(by), "left").select(
        *by, rnd(F.coalesce(score, F.lit(0.5)), 4).alias("illumination")
    )


# --- sharpness and texture --------------------------------------------------


def _reflected(slots: dict[tuple[int, int], str], dx: int, dy: int) -> Column:
    """Neighbour value with the frame mirrored at its edge pixel."""
    order = [(dx, dy), (-dx, dy), (dx, -dy), (-dx, -dy)]
    names = list(dict.fromkeys(slots[o] for o in order if o in slots))
    return F.coalesce(*names, F.col("v"))


def laplacian(pixels: DataFrame, by: Sequence[str], value: Column, keep: Sequence[str] = ("mask",)) -> DataFrame:
    """Add ``lap``: the four neighbours minus four times the value."""
    met = gather(pixels, by, CROSS, value.cast("double"), keep)
    slots = {o: f"n{i}" for i, o in enumerate(CROSS)}
    total = F.lit(0.0)
    for dx, dy in CROSS:
        total = total + _reflected(slots, dx, dy)
    return met.withColumn("lap", total - F.col("v") * 4)


def laplacian_variance(pixels: DataFrame, by: Sequence[str] = INSTANCE, fill: int = 0) -> DataFrame:
    """Variance of the Laplacian over the mask, with ``fill`` painted outside the mask."""
    rows = with_gray(pixels)
    lap = laplacian(rows, by, F.when(F.col("mask"), F.col("gray")).otherwise(fill))
    return lap.where("mask").groupBy(*by).agg(F.var_pop("lap").alias("lap_var"))


def texture_features(pixels: DataFrame, by: Sequence[str] = INSTANCE) -> DataFrame:
    rows = with_hsv(C.with_lab8(pixels.where("mask")))
    return rows.groupBy(*by).agg(
        rnd(F.avg("lab_l"), 4).alias("mean_l"),
        rnd(F.stddev_pop("lab_l"), 4).alias("std_l"),
        rnd(F.avg(F.col("lab_a") - 128), 4).alias("mean_a"),
        rnd(F.avg(F.col("lab_b") - 128), 4).alias("mean_b"),
        rnd(_share(F.col("lab_l") > 85), 4).alias("bright_fraction"),
        rnd(_share((F.col("sat") < 40) & (F.col("val") > 180)), 4).alias("chalky_fraction"),
    )


def damaged_score(pixels: DataFrame, by: Sequence[str] = INSTANCE) -> DataFrame:
    """Colour spread and dark share of every instance, in samples of any size."""
    rows = C.with_lab8(pixels.where("mask"))
    stats = rows.groupBy(*by).agg(
        F.avg("lab_l").alias("m"), F.stddev_pop("lab_l").alias("s"),
        (F.stddev_pop("lab_a") + F.stddev_pop("lab_b")).alias("ab"),
    )
    near = keyed_join(rows.select(*by, "lab_l"), stats.select(*by, "m", "s"), list(by))
    dark = near.groupBy(*by).agg(
        _share(F.col("lab_l") < F.greatest(F.lit(50.0), F.col("m") - F.col("s") * 2)).alias("dark")
    )
    score = (
        F.least(F.lit(1.0), F.col("s") / 30.0) * 0.3
        + F.col("dark") * 0.4
        + F.least(F.lit(1.0), F.col("ab") / 20.0) * 0.3
    )
    return stats.join(dark, list(by)).select(
        *by, F.when(score > 0.5, "damaged").otherwise("normal").alias("damaged_label"), rnd(score, 4).alias("damaged_score")
    )


def hole_score(pixels: DataFrame, by: Sequence[str] = INSTANCE) -> DataFrame:
    """Dark share and roughness of every instance, in samples of any size."""
    rough = laplacian_variance(pixels, by, fill=128)
    rows = with_gray(pixels.where("mask")).select(*by, "gray")
    means = rows.groupBy(*by).agg(F.avg("gray").alias("m"))
    dark = keyed_join(rows, means, list(by)).groupBy(*by).agg(
        _share(F.col("gray") < F.col("m") * 0.5).alias("dark")
    )
    score = (
        F.least(F.lit(1.0), F.col("dark") * 5) * 0.5 + F.least(F.lit(1.0), F.col("lap_var") / 5000) * 0.5
    )
    return dark.join(rough, list(by)).select(
        *by,
        F.when(score > 0.5, "sprouted_weevilled").otherwise("normal").alias("sprouted_label"),
        rnd(score, 4).alias("sprouted_score"),
    )


def instance_colour_features(pixels: DataFrame, background: DataFrame | None = None, by: Sequence[str] = INSTANCE, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Mean colours, chroma, saturation and surface roughness of each instance.

    Roughness reads the unmasked grey through the 3x3 corner kernel and averages over pixels
    whose neighbours in the frame are all in the mask (over the mask if fewer than ten).
    ``background`` has one ``background_gray`` per sample.
    """
    rows = with_hsv(C.with_lab8(with_gray(pixels)))
    around = (*CORNERS, *CROSS)
    coded = F.col("gray") * 2 + F.col("mask").cast("int")
    met = gather(rows, by, around, coded, ("mask", "r", "g", "b", "gray", "sat", "lab_l", "lab_a", "lab_b"))
    slots = {o: f"n{i}" for i, o in enumerate(around)}
    lap = F.col("gray") * -8.0
    for dx, dy in CORNERS:
        lap = lap + F.floor(_reflected({o: slots[o] for o in CORNERS}, dx, dy) / 2) * 2.0
    inner = F.col("mask")
    for name in slots.values():
        inner = inner & (F.coalesce(F.col(name) % 2, F.lit(1)) == 1)
    met = met.withColumns({"lap": F.abs(lap), "inner": inner}).where("mask")
    out = met.groupBy(*by).agg(
        F.count("*").alias("area"),
        *[F.avg(k).alias(f"m_{k}") for k in ("r", "g", "b", "gray", "sat", "lab_l")],
        F.avg(F.col("lab_a") - 128).alias("star_a"),
        F.avg(F.col("lab_b") - 128).alias("star_b"),
        F.count_if("inner").alias("inner_n"),
        F.avg(F.when(F.col("inner"), F.col("lap"))).alias("lap_in"),
        F.avg("lap").alias("lap_all"),
    )
    rough = F.when(F.col("inner_n") >= 10, F.col("lap_in")).otherwise(F.col("lap_all")) / (F.col("m_gray") + 1.0)
    gap = []
    if background is not None:
        out = out.join(background, list(sample))
        drop = F.greatest(F.lit(0.0), F.col("background_gray") - F.col("m_gray"))
        gap = [rnd(drop / F.greatest("background_gray", F.lit(1.0)), 4).alias("background_gap_ratio")]
    return out.select(
        *by,
        F.col("area").alias("area_pixels"),
        *[rnd(f"m_{k}").alias(f"mean_{k}") for k in ("r", "g", "b", "gray")],
        rnd(F.col("m_lab_l") * 100.0 / 255.0).alias("mean_l_star"),
        rnd("star_a").alias("mean_a_star"),
        rnd("star_b").alias("mean_b_star"),
        rnd(F.hypot("star_a", "star_b")).alias("chroma"),
        rnd("m_sat").alias("saturation"),
        rnd(rough, 5).alias("surface_roughness"),
        *gap,
    )


# --- co-occurrence ----------------------------------------------------------


def cooccurrence(pixels: DataFrame, by: Sequence[str] = INSTANCE, levels: int = 64) -> DataFrame:
    """(by, i, j, n): how often grey level j lies at one of the fixed offsets from level i.

    Grey is spread over the levels by the instance's own range; both pixels are in the mask.
    """
    by = list(by)
    rows = with_gray(pixels.where("mask")).select(*by, "x", "y", "gray")
    span = rows.groupBy(*by).agg(F.min("gray").alias("lo"), F.max("gray").alias("hi"))
    level = F.when(
        F.col("hi") > F.col("lo"),
        F.floor(F.try_divide(F.col("gray") - F.col("lo"), F.col("hi") - F.col("lo")) * (levels - 1)),
    ).otherwise(0)
    ready = keyed_join(rows, span, by).select(*by, "x", "y", level.cast("int").alias("q"))
    met = gather(ready, by, GLCM_OFFSETS, F.col("q"))
    others = F.array_compact(F.array(*[f"n{i}" for i in range(len(GLCM_OFFSETS))]))
    pairs = met.select(*by, F.col("v").alias("i"), F.explode(others).alias("j"))
    return pairs.groupBy(*by, "i", "j").agg(F.count("*").alias("n"))


def cooccurrence_features(counts: DataFrame, by: Sequence[str] = INSTANCE) -> DataFrame:
    """Contrast, homogeneity, energy and correlation; all sums are whole numbers."""
    i, j, n = F.col("i").cast("long"), F.col("j").cast("long"), F.col("n")
    s = counts.groupBy(*by).agg(
        F.sum(n).alias("t"),
        F.sum(n * (i - j) * (i - j)).alias("con"),
        F.sum(n / (F.abs(i - j) + 1.0)).alias("hom"),
        F.sum(n * n).alias("sq"),
        F.sum(n * i).alias("si"),
        F.sum(n * j).alias("sj"),
        F.sum(n * i * i).alias("sii"),
        F.sum(n * j * j).alias("sjj"),
        F.sum(n * i * j).alias("sij"),
    )
    t = F.col("t").cast("double")
    vi = F.col("t") * F.col("sii") - F.col("si") * F.col("si")
    vj = F.col("t") * F.col("sjj") - F.col("sj") * F.col("sj")
    cov = F.col("t") * F.col("sij") - F.col("si") * F.col("sj")
    corr = F.when((vi > 0) & (vj > 0), F.try_divide(cov.cast("double"), F.sqrt(vi.cast("double")) * F.sqrt(vj.cast("double"))))
    return s.select(
        *by,
        rnd(F.col("con") / t, 4).alias("contrast"),
        rnd(F.col("hom") / t, 4).alias("homogeneity"),
        rnd(F.col("sq") / (t * t), 6).alias("energy"),
        rnd(F.coalesce(corr, F.lit(0.0)), 4).alias("correlation"),
    )


# --- thresholds and masks ---------------------------------------------------


def otsu_threshold(pixels: DataFrame, by: Sequence[str] = ("sample_id",), value: str = "gray") -> DataFrame:
    """Grey level with the largest between-class variance, from at most 256 counts per key."""
    bins = pixels.groupBy(*by, F.col(value).alias("level")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    mass = F.col("n") * F.col("level")
    rows = bins.withColumns(
        {
            "w0": F.sum("n").over(upto).cast("double"),
            "s0": F.sum(mass).over(upto).cast("double"),
            "w": F.sum("n").over(whole).cast("double"),
            "s": F.sum(mass).over(whole).cast("double"),
        }
    )
    gap = F.col("s") * F.col("w0") - F.col("s0") * F.col("w")
    between = F.coalesce(F.try_divide(gap * gap, F.col("w0") * (F.col("w") - F.col("w0"))), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.max_by("level", F.struct(between, -F.col("level"))).cast("int").alias("otsu")
    )


def foreground_mask(
    pixels: DataFrame, images: DataFrame, by: Sequence[str] = ("sample_id",)
) -> tuple[DataFrame, DataFrame]:
    """(pixels with ``fg``, one row of threshold facts per sample) from the grey level.

    The border decides whether the background is dark; corner pixels lie on two sides and
    count twice. Flat images have no foreground.
    """
    by = list(by)
    rows = with_gray(pixels)
    margin = F.greatest(F.lit(3), F.floor(F.least("image_w", "image_h") / 50)).cast("int")
    frames = images.select(*by, "image_w", "image_h", margin.alias("m"))
    cuts = otsu_threshold(rows, by).join(frames, by)
    seen = rows.join(cuts, by)
    sides = (
        (F.col("y") < F.col("m")).cast("int")
        + (F.col("y") >= F.col("image_h") - F.col("m")).cast("int")
        + (F.col("x") < F.col("m")).cast("int")
        + (F.col("x") >= F.col("image_w") - F.col("m")).cast("int")
    )
    seen = seen.withColumn("sides", sides)
    facts = seen.groupBy(*by).agg(
        F.max("otsu").alias("otsu"),
        (F.max("gray") == F.min("gray")).alias("flat"),
        F.stddev_pop("gray").alias("sd"),
        F.try_divide(
            F.sum(F.when(F.col("gray") < F.col("otsu"), F.col("sides")).otherwise(0)).cast("double"), F.sum("sides")
        ).alias("dark_border"),
        _share(F.col("gray") > F.col("otsu")).alias("bright"),
        F.percentile("gray", F.lit(0.5), F.col("sides")).alias("border_gray"),
        F.percentile("gray", F.lit(0.5)).alias("all_gray"),
    )
    blank = F.col("flat") | (F.col("sd") < 1.0)
    dark_share = 1.0 - F.col("bright")
    dark_bg = F.when(
        F.col("dark_border") >= 0.5, ~((F.col("bright") > 0.70) & (dark_share < 0.30))
    ).otherwise((dark_share > 0.70) & (F.col("bright") < 0.30))
    facts = facts.withColumns({"is_blank": blank, "is_dark_bg": blank | dark_bg})
    facts = facts.select(
        *by,
        "otsu",
        "is_blank",
        "is_dark_bg",
        rnd("dark_border", 3).alias("dark_border_fraction"),
        rnd(F.when(F.col("is_blank"), F.col("all_gray")).otherwise(F.col("border_gray"))).alias("background_gray"),
        rnd(
            F.when(F.col("is_blank"), 0.0).when(F.col("is_dark_bg"), F.col("bright")).otherwise(1.0 - F.col("bright")), 4
        ).alias("fg_ratio"),
    )
    fg = ~F.col("is_blank") & ((F.col("gray") > F.col("otsu")) == F.col("is_dark_bg"))
    marked = rows.join(facts.select(*by, "otsu", "is_blank", "is_dark_bg"), by).withColumn("fg", fg)
    return marked.drop("otsu", "is_blank", "is_dark_bg"), facts


def flag_touching(
    pixels: DataFrame, by: Sequence[str] = ("sample_id",), key: str = "instance_id"
) -> DataFrame:
    """(by, key, is_touching): does a mask, grown by one pixel, meet another mask?

    It does exactly if the pixels around one of its own, or upon it, hold another id. So the smallest
    and largest id there settle the question, and no pairs of instances are formed.
    """
    by = list(by)
    masks = pixels.where("mask").select(*by, key, "x", "y")
    steps = [along(by, *step, -1, 1) for step in _STEPS]
    least, most = F.least(*[F.min(key).over(w) for w in steps]), F.greatest(*[F.max(key).over(w) for w in steps])
    met = tiled(masks, by, 1).withColumns({"lo": least, "hi": most})
    return met.where("home").groupBy(*by, key).agg(F.bool_or(F.col("lo") < F.col("hi")).alias("is_touching"))
