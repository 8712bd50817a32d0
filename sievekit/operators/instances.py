"""Instance and sample level: flags, routes, ids, summaries, gate, outliers, quality tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.fixed import DEFECT_LABELS, GATE_MESSAGES, QUALITY_NOTES, THRESHOLDS
from sievekit.functions.rules import Col, c, rnd, safe_percent
from sievekit.operators.scaling import exact_medians, keyed_join, row_numbers


def broken_summary(labels: DataFrame, by: Sequence[str] = ("sample_id",), label: Col = "broken_label") -> DataFrame:
    """Whole/broken/undetermined counts; the percentage divides by all grains."""
    out = labels.groupBy(*by).agg(
        F.count("*").alias("total_count"),
        *[F.count_if(c(label) == word).alias(f"{word}_count") for word in ("whole", "broken", "undetermined")],
    )
    analysed = F.col("whole_count") + F.col("broken_count")
    return out.withColumn(
        "broken_percent", F.when(analysed > 0, safe_percent("broken_count", "total_count"))
    )


def sample_summary(labels: DataFrame, by: Sequence[str] = ("sample_id",), broken: str = "broken_label") -> DataFrame:
    """Counts and percentages of all labels per sample, in one pass.

    ``labels`` has the broken label and one label column per defect. The broken and whole
    percentages divide by all grains, each defect percentage by the grains with a known
    label; nothing known means null.
    """
    aggs = [F.count("*").alias("total_count")]
    aggs += [F.count_if(F.col(broken) == w).alias(f"{w}_count") for w in ("whole", "broken", "undetermined")]
    for defect, (positive, other) in DEFECT_LABELS.items():
        aggs.append(F.count_if(F.col(defect).isin(*positive)).alias(f"{defect}_count"))
        aggs.append(F.count_if(F.col(defect).isin(*positive, *other)).alias(f"{defect}_analyzed_count"))
    out = labels.groupBy(*by).agg(*aggs)
    known = F.col("whole_count") + F.col("broken_count")
    more = {"broken_analyzed_count": known}
    for word in ("broken", "whole"):
        more[f"{word}_percent"] = F.when(known > 0, safe_percent(f"{word}_count", "total_count"))
    for defect in DEFECT_LABELS:
        seen = f"{defect}_analyzed_count"
        more[f"{defect}_percent"] = F.when(F.col(seen) > 0, safe_percent(f"{defect}_count", seen))
    return out.withColumns(more)


def dimension_stats(
    instances: DataFrame, by: Sequence[str] = ("sample_id",), length: Col = "length_px", breadth: Col = "breadth_px",
    lb: Col = "lb_ratio",
) -> DataFrame:
    by, cols = list(by), {"length": length, "breadth": breadth, "lb_ratio": lb}
    means = instances.groupBy(*by).agg(*[F.avg(c(col)).alias(f"average_{n}") for n, col in cols.items()])
    middles = exact_medians(instances, by, {f"median_{n}": col for n, col in cols.items()})
    both = keyed_join(means, middles, by)
    names = [f"{stat}_{n}" for n in cols for stat in ("average", "median")]
    return both.select(*by, *[F.coalesce(rnd(n), F.lit(0.0)).alias(n) for n in names])


def population_stats(
    instances: DataFrame, by: Sequence[str] = ("sample_id",), breadth: Col = "breadth_px", area: Col = "area"
) -> DataFrame:
    positive = F.when(c(breadth) > 0, c(breadth))
    found = exact_medians(instances, by, {"median_breadth": positive, "median_area": area})
    return found.select(*by, *[F.coalesce(n, F.lit(1.0)).alias(n) for n in ("median_breadth", "median_area")])


def instance_flags(instances: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Touching and uncertain flags from the sample's median area and the box shape."""
    seg = THRESHOLDS["segmentation"]
    kept = F.when(F.col("area") >= seg["min_grain_area_pixels"], F.col("area"))
    medians = exact_medians(instances, by, {"_typical": kept})
    rows = keyed_join(instances, medians, list(by)).withColumn("_typical", F.coalesce("_typical", F.lit(2000.0)))
    big = F.coalesce(F.try_divide(F.col("area"), F.col("_typical")), F.lit(1.0)) > seg["merge_detection_area_ratio"]
    long = F.greatest("w", "h") > (F.least("w", "h") + 1e-6) * seg["merge_detection_aspect_ratio"]
    return rows.withColumns(
        {
            "is_touching": big | long,
            "segmentation_quality": F.when(big | long, "uncertain").otherwise("good"),
            "shape_confidence": F.least(F.lit(1.0), F.col("solidity") * 0.7 + 0.3),
        }
    ).drop("_typical")


def classify_immature(
    instances: DataFrame, stats: DataFrame, by: Sequence[str] = ("sample_id",), lb: Col = "lb_ratio"
) -> DataFrame:
    """Four geometry cues against the sample's medians; a score above one half is positive."""
    rows = keyed_join(instances, stats, list(by))
    b_ratio = F.when(F.col("median_breadth") > 0, F.col("breadth_px") / F.col("median_breadth")).otherwise(1.0)
    a_ratio = F.when(F.col("median_area") > 0, F.col("area") / F.col("median_area")).otherwise(1.0)
    cues = (
        (b_ratio < 0.7, 0.35, F.format_string("Low breadth ratio: %.2f", rnd(b_ratio, 2))),
        (a_ratio < 0.5, 0.35, F.format_string("Low area ratio: %.2f", rnd(a_ratio, 2))),
        (F.col("solidity") < 0.85, 0.15, F.format_string("Low solidity: %.3f", rnd(F.col("solidity"), 3))),
        (c(lb) > 5.0, 0.15, F.format_string("Abnormal L/B: %.2f", rnd(c(lb), 2))),
    )
    score = F.lit(0.0)
    for hit, weight, _ in cues:
        score = score + F.when(hit, weight).otherwise(0.0)
    return rows.withColumns(
        {
            "immature_score": rnd(score, 4),
            "immature_label": F.when(score > 0.5, "immature_shrunken").otherwise("normal"),
            "immature_reasons": F.array_compact(F.array(*[F.when(hit, text) for hit, _, text in cues])),
        }
    )


# --- detections -------------------------------------------------------------


def assign_ids(
    detections: DataFrame, by: Sequence[str] = ("sample_id",), name: str = "id", tie: str | None = None
) -> DataFrame:
    """1..n per key by confidence (highest first, null last), then y, then x.

    Keys are split by slices of confidence, and those by equal confidence and rows of the
    image, so that a constant score spreads, too.
    """
    order = [F.col("confidence").desc(), F.col("y"), F.col("x"), *([F.col(tie)] if tie else [])]
    sure = F.col("confidence").cast("double")
    edge = F.lit(2**62)
    steep = F.floor(F.greatest(F.lit(-(2.0**60)), F.least(F.lit(2.0**60), sure * -4096)))
    part = F.when(sure.isNull(), edge).when(F.isnan(sure), -edge).otherwise(steep)
    return row_numbers(detections, list(by), order, [part], name, fine=[-sure, F.floor(F.col("y") / 64)])


def assign_ids_by_route(routed: DataFrame, by: Sequence[str] = ("sample_id",), seq: str = "seq") -> DataFrame:
    """Separate counters per route, in detection order."""
    return row_numbers(routed, [*by, "route"], [F.col(seq)], [F.floor(F.col(seq) / 65536)], "route_id")


def detection_counts(
    routed: DataFrame, by: Sequence[str] = ("sample_id",), touching: Col = "is_touching"
) -> DataFrame:
    """Detections per sample and route, uncertain ones, and those that may be several merged ones (touching)."""
    grain = F.col("route") == "grain"
    return routed.groupBy(*by).agg(
        F.count_if(grain).alias("grain_count"),
        F.count_if(F.col("route") == "foreign").alias("foreign_count"),
        F.count_if(F.col("route") == "unresolved").alias("unresolved_count"),
        F.count_if(grain & F.col("confidence_band").isin("LOW", "MEDIUM")).alias("uncertain_count"),
        F.count_if(grain & c(touching)).alias("merged_count"),
    )


def foreign_fraction(objects: DataFrame, images: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Object count and covered share of the image; an image without objects has 0."""
    found = objects.groupBy(*by).agg(F.count("*").alias("n"), F.sum("area").alias("covered"))
    share = F.try_divide(F.coalesce("covered", F.lit(0)).cast("double"), F.col("image_area").cast("double"))
    return images.join(found, list(by), "left").select(
        *by,
        F.coalesce("n", F.lit(0)).alias("foreign_object_count"),
        rnd(F.coalesce(share, F.lit(0.0)), 6).alias("foreign_fraction"),
    )


def class_id_lookup(df: DataFrame, class_map: DataFrame, name: str = "class_name") -> DataFrame:
    """Class id by name, -1 when unknown. The map is a model's class list; Spark sizes the join."""
    return df.join(class_map.select(F.col("class_name").alias(name), "class_id"), name, "left").withColumn(
        "class_id", F.coalesce("class_id", F.lit(-1))
    )


def gate_rollup(
    detections: DataFrame, by: Sequence[str] = ("sample_id",), samples: DataFrame | None = None
) -> DataFrame:
    """Is there anything of the target kind in each sample? Sparse crowds only warn.

    ``samples`` names all samples, so that those without a detection have a row, too. It may have
    ``has_target_class`` (false: the detector knows no target class, so its detections say
    nothing) and ``analysable_count`` (0: nothing was left to measure behind the gate). Nulls
    there, and samples that are only in ``detections`` without a ``samples`` table, count as usual.
    """
    by, gate = list(by), THRESHOLDS["rice_gate"]
    hit = F.when(F.col("is_target"), F.col("confidence"))
    found = detections.groupBy(*by).agg(
        F.count("*").alias("_total"), F.count_if("is_target").alias("_target"), F.avg(hit).alias("_mean"), F.max(hit).alias("_max")
    )
    optional = {"has_target_class": F.lit(True), "analysable_count": F.lit(None).cast("long")}
    if samples is None:
        out = found.withColumns(optional)
    else:
        known = [F.col(n).alias(n) if n in samples.columns else default.alias(n) for n, default in optional.items()]
        out = keyed_join(samples.select(*by, *known), found, by, "left")
    able = F.coalesce("has_target_class", F.lit(True))

    def counted(name: str, zero: Column) -> Column:
        return F.coalesce(F.when(able, F.col(name)), zero)

    total, target = counted("_total", F.lit(0)), counted("_target", F.lit(0))
    share = F.coalesce(F.try_divide(target.cast("double"), total), F.lit(0.0))
    crowded = total >= gate["min_objects_for_fraction_rule"]
    sparse = (target > 0) & crowded & (share < gate["min_rice_fraction_of_detections"])
    status = (
        F.when(~able, "NO_RICE_CLASS")
        .when(target == 0, "NOT_RICE")
        .when(F.col("analysable_count") == 0, "NO_ANALYSABLE_RICE")
        .otherwise("RICE")
    )
    texts = F.create_map(*[F.lit(x) for pair in GATE_MESSAGES.items() for x in pair])
    return out.select(
        *by,
        total.alias("total_detections"),
        target.alias("target_detections"),
        counted("_mean", F.lit(0.0)).alias("confidence_mean"),
        counted("_max", F.lit(0.0)).alias("confidence_max"),
        (total - target).alias("foreign_detections"),
        rnd(share, 4).alias("target_fraction"),
        F.when(crowded, gate["min_rice_fraction_of_detections"]).alias("min_fraction_required"),
        status.alias("status"),
        F.when(sparse, "low_object_rice_fraction_warning")
        .when(target > 0, "rice_detected")
        .otherwise("no_rice_class_detections")
        .alias("reason"),
    ).withColumns(
        {
            "confidence_mean": rnd("confidence_mean", 4),
            "confidence_max": rnd("confidence_max", 4),
            "analysis_stopped": F.col("status") != "RICE",
            "message": texts[F.col("status")],
        }
    )


def split_by_gate(samples: DataFrame, gate: DataFrame, by: Sequence[str] = ("sample_id",)) -> tuple[DataFrame, DataFrame]:
    """(samples to measure, samples that stop at the gate)."""
    passed = gate.where(F.col("status") == "RICE").select(*by)
    return samples.join(passed, list(by), "left_semi"), samples.join(passed, list(by), "left_anti")


# --- geometry outliers ------------------------------------------------------


FEATURES = ("length_px", "breadth_px", "lb_ratio", "area", "solidity")


def _factor(stats: DataFrame, size: int) -> DataFrame:
    """Add ``_l..``, the lower triangular factor of the regularised covariances ``_c..``.

    A matrix that has none (a pivot that is not above 0) gives nulls.
    """
    for j in range(size):
        pivot = F.col(f"_c{j}{j}") + 1e-6
        for k in range(j):
            pivot = pivot - F.col(f"_l{j}{k}") * F.col(f"_l{j}{k}")
        stats = stats.withColumn(f"_l{j}{j}", F.when((pivot > 0) & ~F.isnan(pivot), F.sqrt(pivot)))
        below = {}
        for i in range(j + 1, size):
            rest = F.col(f"_c{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            below[f"_l{i}{j}"] = rest / F.col(f"_l{j}{j}")
        stats = stats.withColumns(below) if below else stats
    return stats


def geometry_distances(
    instances: DataFrame,
    by: Sequence[str] = ("sample_id",),
    features: Sequence[Col] = FEATURES,
    accepted: Sequence[str] = ("good", "limited"),
    min_n: int = 10,
) -> DataFrame:
    """Accepted, unbroken instances with ``valid_n``, their number, and ``outlier_distance``.

    The Mahalanobis distance from the sample's mean; null in a sample of fewer than ``min_n``
    of them or without a usable covariance. Means and covariances are algebraic aggregates;
    the matrix is factored and the distance found by substitution, all of it in columns.
    """
    by, size = list(by), len(features)
    fit = F.col("broken_label").isin("whole", "undetermined") & F.col("segmentation_quality").isin(*accepted)
    f = [f"_f{i}" for i in range(size)]
    rows = instances.where(fit).withColumns({n: F.coalesce(c(x).cast("double"), F.lit(0.0)) for x, n in zip(features, f)})
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("valid_n"),
        *[F.avg(n).alias(f"_m{i}") for i, n in enumerate(f)],
        *[
            F.when(F.count("*") >= min_n, F.covar_samp(f[i], f[j])).alias(f"_c{i}{j}")
            for i in range(size)
            for j in range(i, size)
        ],
    )
    scored = keyed_join(rows, _factor(stats, size), by)
    square = F.lit(0.0)
    for i in range(size):
        rest = F.col(f[i]) - F.col(f"_m{i}")
        for k in range(i):
            rest = rest - F.col(f"_l{i}{k}") * F.col(f"_z{k}")
        scored = scored.withColumn(f"_z{i}", rest / F.col(f"_l{i}{i}"))
        square = square + F.col(f"_z{i}") * F.col(f"_z{i}")
    return scored.select(*instances.columns, "valid_n", F.sqrt(square).alias("outlier_distance"))


def outlier_instances(
    instances: DataFrame, by: Sequence[str] = ("sample_id",), threshold: float = 3.0, **how
) -> DataFrame:
    """The instances that ``geometry_outliers`` counts, with their ``outlier_distance``."""
    found = geometry_distances(instances, by, **how)
    # A filter would be moved below the steps and spell all of them out; it stays above a generator.
    once = found.select(*instances.columns, F.explode(F.array("outlier_distance")).alias("outlier_distance"))
    return once.where(F.col("outlier_distance") > threshold)


def geometry_outliers(
    instances: DataFrame, by: Sequence[str] = ("sample_id",), threshold: float = 3.0, **how
) -> DataFrame:
    """Mahalanobis outliers per sample; a diagnostic, never a class.

    ``how``: features, accepted and min_n of ``geometry_distances``.
    """
    by, far = list(by), F.col("outlier_distance")
    hits = geometry_distances(instances, by, **how).groupBy(*by).agg(
        F.count("*").alias("valid_n"),
        F.when(F.count(far) > 0, F.count_if(far > threshold)).alias("outlier_count"),
        F.avg(F.when(far > threshold, far)).alias("_far"),
    )
    totals = instances.groupBy(*by).agg(F.count("*").alias("total_grains"))
    out = keyed_join(totals, hits, by, "left")
    valid = F.coalesce("valid_n", F.lit(0))
    reach = F.when(F.col("outlier_count") > 0, F.least(F.lit(1.0), F.col("_far") / threshold)).otherwise(0.5)
    return out.select(
        *by,
        "total_grains",
        valid.alias("valid_grains_used"),
        F.when(F.col("outlier_count").isNull(), "insufficient_data").otherwise("diagnostic_only").alias("outlier_status"),
        "outlier_count",
        rnd(F.try_divide(F.col("outlier_count").cast("double"), valid), 4).alias("outlier_fraction"),
        F.when(F.col("outlier_count").isNotNull(), rnd(F.least(F.lit(1.0), valid / 50.0) * reach, 4)).alias("outlier_score"),
        F.lit("unsupported").alias("admixture_status"),
    )


# --- image quality ----------------------------------------------------------


def quality_tier(stats: DataFrame) -> DataFrame:
    """Tier of a sample from blur, median_area, mean_confidence, uncertain_count, poor_count,
    total_count, illumination, clipped_dark and clipped_bright."""
    q, note = THRESHOLDS["image_quality"], QUALITY_NOTES
    blur, size, n = F.col("blur"), F.col("median_area"), F.col("total_count")
    doubtful = F.coalesce(F.try_divide(F.col("uncertain_count").cast("double"), n), F.lit(0.0))
    poor = F.coalesce(F.try_divide(F.col("poor_count").cast("double"), n), F.lit(0.0))
    light = F.col("illumination")
    clipped = (F.col("clipped_dark") > 0.1) | (F.col("clipped_bright") > 0.1)

    def ladder(value: Column, stem: str, notes: str) -> tuple[Column, Column]:
        good, fair, bad = (q[f"{stem}_{k}"] for k in ("good", "fair", "poor"))
        points = F.when(value >= good, 1.0).when(value >= fair, 0.7).when(value >= bad, 0.4).otherwise(0.1)
        text = (
            F.when(value >= good, None)
            .when(value >= fair, note[f"{notes}_fair"])
            .when(value >= bad, note[f"{notes}_poor"])
            .otherwise(note[f"{notes}_bad"])
        )
        return points, text

    blur_score, blur_note = ladder(blur, "blur_threshold", "blur")
    size_score, size_note = ladder(size, "min_grain_pixels", "size")
    merged = doubtful > q["uncertain_grain_fraction_warning"]
    score = (
        blur_score
        + size_score
        + F.when(merged, 0.5).otherwise(1.0)
        + F.when(light < 0.5, 0.5).otherwise(F.least(F.lit(1.0), light + 0.2))
        + F.when(clipped, 0.6).otherwise(1.0)
    ) / 5.0
    notes = (
        blur_note,
        size_note,
        F.when(merged, F.format_string("Several grains appear merged (%d uncertain).", F.col("uncertain_count"))),
        F.when(light < 0.5, note["uneven"]),
        F.when(clipped, note["clipped"]),
    )
    hard = (
        F.when(blur < q["blur_threshold_poor"], note["hard_blur"]),
        F.when(size < q["min_grain_pixels_poor"], note["hard_size"]),
        F.when(
            (n > 0) & (F.col("mean_confidence") < THRESHOLDS["segmentation"]["confidence_threshold"]),
            note["hard_confidence"],
        ),
        F.when(doubtful >= q["unreliable_uncertain_grain_fraction"], note["hard_uncertain"]),
        F.when(poor >= q["unreliable_low_quality_segmentation_fraction"], note["hard_quality"]),
        F.when(
            F.greatest("clipped_dark", "clipped_bright") >= q["unreliable_clipped_pixel_fraction"], note["hard_clipped"]
        ),
        F.when(light < q["unreliable_illumination_uniformity_below"], note["hard_uneven"]),
    )
    out = stats.withColumns(
        {
            "quality_score": score,
            "reasons": F.array_compact(F.array(*notes, *hard)),
            "unreliable_reasons": F.array_compact(F.array(*hard)),
        }
    )
    tier = (
        F.when(F.size("unreliable_reasons") > 0, "UNRELIABLE")
        .when(F.col("quality_score") >= 0.8, "GOOD")
        .when(F.col("quality_score") >= 0.6, "FAIR")
        .otherwise("POOR")
    )
    return out.withColumns({"quality_level": tier, "quality_score": rnd("quality_score", 4)})
