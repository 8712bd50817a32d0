"""Object likeness, two-class decisions and linear model scoring as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievekit.fixed import (
    GATE_ASPECT,
    GATE_CHROMA,
    GATE_LIGHTNESS,
    GATE_TEXTURE,
    GATE_WEIGHTS,
    HARD_NEGATIVE_CUES,
    HARD_NEGATIVES,
    THRESHOLDS,
)
from sievekit.functions.colour import gray_lightness
from sievekit.functions.rules import Col, c, normalize_label, ramp, rnd


def _red_variety() -> Column:
    return (F.col("mean_a_star") > 1.5) & (F.col("aspect_ratio") >= 1.6) & (F.col("surface_roughness") < 0.30)


def _is_cluster() -> Column:
    return (
        (F.col("area_pixels") > 50000)
        & (F.col("surface_roughness") < 0.28)
        & (F.col("mean_l_star") > 35.0)
    )


def hard_negative() -> Column:
    """Name of the early exit an object takes, or null."""
    rough, lone = F.col("surface_roughness"), ~_is_cluster()
    return (
        F.when((F.col("aspect_ratio") < 1.65) & (rough >= 0.28) & lone, "stone_shape_and_texture")
        .when((F.col("aspect_ratio") < 1.35) & lone, "rounded_non_rice")
        .when((F.col("area_pixels") < 300) & (rough > 0.45), "small_rough_debris")
        .when((F.col("chroma") >= 30.0) & (F.col("mean_b_star") > 24.0), "wheat_or_yellow_grain")
    )


def background_gap(mean_gray: Col = "mean_gray", background: Col = "background_gray") -> Column:
    drop = F.greatest(F.lit(0.0), c(background) - c(mean_gray))
    return drop / F.greatest(c(background), F.lit(1.0))


def target_score(df):
    """Add hard_negative, target_score and the five cue columns to an objects table."""
    aspect = F.when(_is_cluster(), 0.90).otherwise(
        ramp("aspect_ratio", GATE_ASPECT["zero_credit"], GATE_ASPECT["full_credit"])
    )
    texture = 1.0 - ramp(
        "surface_roughness", GATE_TEXTURE["full_credit_roughness"], GATE_TEXTURE["zero_credit_roughness"]
    )
    c_full, c_zero = GATE_CHROMA["full_credit_c_star"], GATE_CHROMA["zero_credit_c_star"]
    chroma = (
        F.when(_red_variety(), 0.90)
        .when(F.col("chroma") <= c_full, 1.0)
        .when(F.col("chroma") <= c_zero, 1.0 - ramp("chroma", c_full, c_zero) * 0.7)
        .otherwise(0.10)
    )
    l_full, l_zero = GATE_LIGHTNESS["full_credit_l_star"], GATE_LIGHTNESS["zero_credit_l_star"]
    light = (
        F.when(F.col("mean_l_star") >= l_full, 1.0)
        .when(_red_variety() & (F.col("mean_l_star") >= 22.0), 0.90)
        .when(F.col("mean_l_star") >= l_zero, ramp("mean_l_star", l_zero, l_full) * 0.5 + 0.5)
        .otherwise(ramp("mean_l_star", 15.0, l_zero) * 0.5)
    )
    bright = gray_lightness(F.rint("background_gray")) >= GATE_LIGHTNESS["bright_background_l_star"]
    contrast = F.when(
        bright,
        1.0
        - ramp(
            background_gap(),
            GATE_LIGHTNESS["full_credit_background_gap_fraction"],
            GATE_LIGHTNESS["zero_credit_background_gap_fraction"],
        ),
    ).otherwise(1.0)
    staged = df.withColumns(
        {
            "hard_negative": hard_negative(),
            "_aspect": aspect,
            "_texture": texture,
            "_chroma": chroma,
            "_light": light,
            "_contrast": contrast,
        }
    )
    staged = staged.withColumn("_light", F.col("_light") * (F.col("_contrast") * 0.5 + 0.5))
    score = (
        F.col("_aspect") * GATE_WEIGHTS["aspect_ratio"]
        + F.col("_texture") * GATE_WEIGHTS["surface_texture"]
        + F.col("_chroma") * GATE_WEIGHTS["chroma"]
        + F.col("_light") * GATE_WEIGHTS["lightness"]
    )
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    measured = {
        "lightness": "_light",
        "background_contrast": "_contrast",
        "chroma": "_chroma",
        "aspect_ratio": "_aspect",
        "surface_texture": "_texture",
    }
    cues = {}
    for cue, source in measured.items():
        value = rnd(source, 4)
        for name, fixed in HARD_NEGATIVE_CUES.items():
            value = F.when(F.col("hard_negative") == name, fixed[cue]).otherwise(value)
        cues[f"cue_{cue}"] = value
    for name, fixed_score in HARD_NEGATIVES.items():
        score = F.when(F.col("hard_negative") == name, fixed_score).otherwise(score)
    return staged.withColumns({"target_score": score, **cues}).drop(*measured.values())


def fused_confidence(heuristic: Col, learned: Col) -> Column:
    return F.coalesce((c(learned) + c(heuristic)) * 0.5, c(heuristic))


def accept_target(
    heuristic: Col,
    learned: Col,
    negative: Col,
    threshold: float = THRESHOLDS["rice_gate"]["rice_confidence_threshold"],
) -> Column:
    fused = fused_confidence(heuristic, learned)
    return ((fused >= threshold) | (c(heuristic) >= threshold)) & (c(heuristic) >= 0.45) & c(negative).isNull()


# --- two-class decisions ----------------------------------------------------


def class_index(class_names: Col, wanted: str) -> Column:
    """1-based index of the only class that normalises to ``wanted``; raises otherwise."""
    marks = F.transform(c(class_names), lambda name: F.coalesce(normalize_label(name) == wanted, F.lit(False)))
    found = F.size(F.filter(marks, lambda m: m))
    return F.when(found == 1, F.array_position(marks, True)).otherwise(
        F.raise_error(F.lit("Class mapping must identify exactly one positive and one normal class"))
    )


def threshold_classify(probs: Col, positive: Col, negative: Col, threshold: Col | float = 0.5) -> Column:
    """struct(index, confidence, level); positive and negative are 1-based positions."""
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else c(threshold)
    chosen = F.when(F.element_at(c(probs), c(positive).cast("int")) >= limit, c(positive)).otherwise(c(negative))
    conf = F.element_at(c(probs), chosen.cast("int"))
    return F.struct(
        chosen.cast("int").alias("index"),
        conf.alias("confidence"),
        F.when(conf < 0.7, "low").otherwise("moderate").alias("level"),
    )


def logistic_score(features, means, scales, weights, intercept: float) -> Column:
    """Standard-scale the ordered features, then the logistic probability in [0, 1]."""
    z = F.lit(float(intercept))
    for value, mean, scale, weight in zip(features, means, scales, weights, strict=True):
        z = z + (c(value) - float(mean)) / float(scale) * float(weight)
    return F.lit(1.0) / (F.exp(-z) + 1.0)
