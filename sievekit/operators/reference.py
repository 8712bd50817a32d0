"""Whole-length reference per sample, and the whole/broken decision against it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.fixed import INVALID_CALIBRATION_NOTE, NO_REFERENCE, THRESHOLDS, UNIFORM_NOTE
from sievekit.functions.rules import Col, c, rnd
from sievekit.operators.scaling import by_group_size, exact_medians, keyed_join, percentiles_of_counts, value_counts
from sievekit.session import checkpointed


def sample_reference(
    instances: DataFrame,
    by: Sequence[str] = ("sample_id",),
    length: Col = "length_px",
    lb: Col | None = None,
    solidity: Col | None = None,
    unit: Col | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Reference length derived from the sample's own intact population.

    Output: by, n, sample_median, reference_length, reference_status, candidate_count,
    candidate_cv, reason. Samples within the group limit are answered from one sorted array
    per sample after a single shuffle; larger ones from (sample, length, count) rows.
    """
    by = list(by)
    shaped = lb is not None and solidity is not None
    rows = instances.select(
        *by,
        c(length).cast("double").alias("v"),
        *([F.coalesce(c(lb), F.lit(1.0)).alias("lb"), c(solidity).alias("solidity")] if shaped else []),
        *([c(unit).alias("unit")] if unit is not None else []),
    ).where("v IS NOT NULL")

    def add_kind(stats: DataFrame) -> DataFrame:
        uniform = F.col("hi") - F.col("lo") < F.col("hi") * 0.25
        intact = (
            (F.col("med_lb") >= 2.2) & (F.col("med_solidity") >= 0.88) if shaped else F.col("hi") >= 85.0
        )
        if unit is not None and not shaped:
            intact = intact | ((F.col("unit") == "mm") & (F.col("hi") >= 6.0))
        return stats.withColumns(
            {
                "kind": F.when(F.col("n") < 3, "few")
                .when(uniform & intact, "uniform")
                .when(uniform, "undetermined")
                .otherwise("mixed"),
                "cutoff": F.greatest(F.col("lo") + (F.col("hi") - F.col("lo")) * 0.35, F.col("hi") * 0.75),
            }
        )

    units = [F.max("unit").alias("unit")] if unit is not None else []

    def from_arrays(part: DataFrame) -> DataFrame:
        shape = (
            [F.percentile("lb", F.lit(0.5)).alias("med_lb"), F.percentile("solidity", F.lit(0.5)).alias("med_solidity")]
            if shaped
            else []
        )
        stats = part.groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("a"), *shape, *units)
        stats = stats.withColumns(
            {"n": F.size("a"), "lo": F.element_at("a", 1), "hi": F.element_at("a", -1), "sample_median": _middle("a")}
        )
        stats = add_kind(stats).withColumn(
            "pool",
            F.when(F.col("kind") == "uniform", F.col("a"))
            .when(F.col("kind") == "mixed", F.filter("a", lambda v: v >= F.col("cutoff")))
            .otherwise(F.slice("a", 1, 0)),
        )
        stats = stats.withColumn("pool_median", _middle("pool"))
        in_band = F.filter(
            "pool", lambda v: (v >= F.col("pool_median") * 0.85) & (v <= F.col("pool_median") * 1.20)
        )
        stats = stats.withColumn(
            "kept", F.when((F.col("kind") == "mixed") & (F.size("pool") >= 3), in_band).otherwise(F.col("pool"))
        )
        count = F.size("kept")
        stats = stats.withColumns(
            {
                "candidate_count": count,
                "candidate_median": _middle("kept"),
                "mean": F.try_divide(F.aggregate("kept", F.lit(0.0), lambda s, v: s + v), count),
            }
        )
        ss = F.aggregate("kept", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean")))
        return stats.withColumn("ss", ss)

    def from_counts(part: DataFrame) -> DataFrame:
        hist = checkpointed(value_counts(part, by, "v"))
        stats = hist.groupBy(*by).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        stats = stats.join(percentiles_of_counts(hist, by, {"sample_median": 0.5}), by)
        if shaped:
            stats = stats.join(
                exact_medians(part, by, {"med_lb": "lb", "med_solidity": "solidity"}), by
            )
        if units:
            stats = stats.join(part.groupBy(*by).agg(*units), by)
        stats = checkpointed(add_kind(stats))
        pool = checkpointed(
            hist.join(stats.select(*by, "kind", "cutoff"), by)
            .where((F.col("kind") == "uniform") | ((F.col("kind") == "mixed") & (F.col("v") >= F.col("cutoff"))))
            .select(*by, "kind", "v", "c")
        )
        band = pool.groupBy(*by).agg(F.sum("c").alias("pool_n")).join(
            percentiles_of_counts(pool, by, {"pool_median": 0.5}), by
        )
        kept = checkpointed(
            pool.join(band, by)
            .where(
                (F.col("kind") == "uniform")
                | (F.col("pool_n") < 3)
                | ((F.col("v") >= F.col("pool_median") * 0.85) & (F.col("v") <= F.col("pool_median") * 1.20))
            )
            .select(*by, "v", "c")
        )
        means = kept.groupBy(*by).agg(
            F.sum("c").alias("candidate_count"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")
        )
        off = F.col("v") - F.col("mean")
        spread = kept.join(means, by).groupBy(*by).agg(F.sum(off * off * F.col("c")).alias("ss"))
        found = means.join(spread, by).join(percentiles_of_counts(kept, by, {"candidate_median": 0.5}), by)
        return stats.join(found, by, "left")

    def finish(stats: DataFrame) -> DataFrame:
        count = F.coalesce("candidate_count", F.lit(0))
        cv = F.when(F.col("mean") > 0, F.try_divide(F.sqrt(F.col("ss") / count), F.col("mean"))).otherwise(1.0)
        stats = stats.withColumn("cv", F.when(count > 0, cv))
        ok = (count >= 3) & (F.col("cv") <= 0.15)
        uniform_reason = (
            F.lit(UNIFORM_NOTE)
            if shaped
            else F.format_string(
                "Sample grains are uniformly short (%.1f < 85 px) without trusted profile; reference unavailable.",
                rnd("hi", 1),
            )
        )
        reason = (
            F.when(
                F.col("kind") == "few",
                F.format_string("Sample size (%d) <= 2 without trusted profile.", F.col("n")),
            )
            .when(F.col("kind") == "undetermined", uniform_reason)
            .when(count < 3, F.format_string("Only %d candidate whole grains found; minimum 3 required.", count))
            .when(
                F.col("cv") > 0.15,
                F.format_string(
                    "Candidate whole-grain population has high length variance (CV=%.2f > 0.15).", rnd("cv")
                ),
            )
        )
        return stats.select(
            *by,
            F.col("n").cast("long").alias("n"),
            "sample_median",
            F.when(ok, F.col("candidate_median")).alias("reference_length"),
            F.when(ok & (count >= 10), "reliable").when(ok, "limited").otherwise("undetermined").alias("reference_status"),
            F.when(ok, count).cast("long").alias("candidate_count"),
            F.when(ok, rnd("cv", 4)).alias("candidate_cv"),
            reason.alias("reason"),
        )

    return by_group_size(
        rows, by, lambda part: finish(from_arrays(part)), lambda part: finish(from_counts(part)), limit
    )


def _middle(sorted_array: str) -> Column:
    """Median of an already sorted array column, null when empty."""
    n = F.size(sorted_array)
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(sorted_array, half)).when(
        n > 0, (F.get(sorted_array, half - 1) + F.get(sorted_array, half)) / 2.0
    )


def profile_verdict(
    name: Col = "profile_name",
    unit: Col = "reference_unit",
    length: Col = "whole_kernel_length",
    breadth: Col = "whole_kernel_breadth",
    lb: Col = "whole_kernel_lb_ratio",
    status: Col = "data_status",
    eligible: Col = "production_eligible",
    count: Col = "reference_count",
) -> Column:
    """struct(ok, message) of a reference profile; the first failed check is reported."""

    def no(message: Column) -> Column:
        return F.struct(F.lit(False).alias("ok"), message.alias("message"))

    def text(template: str, value: Col) -> Column:
        head, tail = template.split("{}")
        return F.concat(F.lit(head), F.coalesce(c(value).cast("string"), F.lit("None")), F.lit(tail))

    return (
        F.when(F.coalesce(c(name), F.lit("")) == "", no(F.lit("Profile name is empty")))
        .when(
            ~F.coalesce(c(unit).isin("pixels", "mm"), F.lit(False)),
            no(text("Invalid reference unit '{}', must be 'pixels' or 'mm'", unit)),
        )
        .when(
            F.coalesce(c(length), F.lit(0.0)) <= 0,
            no(text("Invalid whole_kernel_length {}, must be > 0", length)),
        )
        .when(c(breadth) <= 0, no(text("Invalid whole_kernel_breadth {}, must be > 0", breadth)))
        .when(c(lb) <= 0, no(text("Invalid whole_kernel_lb_ratio {}, must be > 0", lb)))
        .when(
            ~F.coalesce(c(status).isin("Measured", "Proxy", "Sample-Derived"), F.lit(False)),
            no(text("Invalid data_status '{}'", status)),
        )
        .when(
            (c(unit) == "mm") & (c(status) == "Measured") & c(eligible) & (c(count) < 3),
            no(
                text(
                    "Production-eligible measured mm profile requires reference_count >= 3 (got {}).", count
                )
            ),
        )
        .otherwise(F.struct(F.lit(True).alias("ok"), F.lit("Valid").alias("message")))
    )


def resolve_reference(
    derived: DataFrame, profiles: DataFrame, calibrations: DataFrame, by: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Profile first, then the sample's own reference, then unavailable.

    ``derived`` comes from :func:`sample_reference` plus ``measurement_unit``; ``profiles``
    and ``calibrations`` hold at most one row per key. Where the answer comes from is told by
    ``profile_name``, ``profile_source`` (of the profiles' ``source``, if they have one),
    ``reference_data_status`` and ``calibration_status`` (the ``mode`` of the calibration, if
    there is one).
    """
    by = list(by)
    if "source" not in profiles.columns:
        profiles = profiles.withColumn("source", F.lit(None).cast("string"))
    profiles = profiles.withColumnRenamed("source", "profile_source")
    if "mode" in by or "mode" not in calibrations.columns:
        calibrations = calibrations.withColumn("_mode", F.lit(None).cast("string"))
    else:
        calibrations = calibrations.withColumnRenamed("mode", "_mode")
    facts = derived.join(profiles, by, "left").join(calibrations, by, "left")
    verdict = profile_verdict()
    usable = F.col("whole_kernel_length").isNotNull() & verdict["ok"]
    validity = F.coalesce("validity", F.lit("unavailable"))
    ratio = F.when(
        F.col("sample_median") > 0, F.try_divide(F.col("whole_kernel_length"), F.col("sample_median"))
    ).otherwise(0.0)
    guarded = (F.col("measurement_unit") == "pixels") & (F.col("n") >= 3)
    is_mm = usable & (F.col("reference_unit") == "mm")
    is_px = usable & (F.col("reference_unit") == "pixels")
    in_scale = (ratio >= 0.3) & (ratio <= 3.0)
    tier = (
        F.when(is_mm & (validity == "valid"), "mm")
        .when(is_mm, "mm_blocked")
        .when(is_px & (~guarded | in_scale), "px")
        .otherwise("derived")
    )
    facts = facts.withColumns({"tier": tier, "scale_ratio": F.when(is_px & guarded & in_scale, rnd(ratio, 3))})
    from_profile = F.col("tier").isin("mm", "px")
    derived_ok = (F.col("tier") == "derived") & F.col("reference_length").isNotNull()
    blocked = (
        F.when(
            F.coalesce("validity_reason", F.lit("")) != "",
            F.concat(
                F.lit("Physical profile supplied but calibration is not valid ("),
                validity,
                F.lit(": "),
                F.col("validity_reason"),
                F.lit(")."),
            ),
        ).otherwise(F.lit(INVALID_CALIBRATION_NOTE))
    )
    return facts.select(
        *by,
        F.when(from_profile, F.col("whole_kernel_length"))
        .when(derived_ok, F.col("reference_length"))
        .alias("reference_length"),
        F.when(from_profile, "profile").when(derived_ok, "sample_derived").otherwise("unavailable").alias("reference_source"),
        F.when(F.col("tier") == "mm", "reliable")
        .when(F.col("tier") == "px", "limited")
        .when(derived_ok, F.col("reference_status"))
        .otherwise("undetermined")
        .alias("reference_status"),
        F.when(F.col("tier") != "derived", F.col("reference_unit"))
        .otherwise(F.col("measurement_unit"))
        .alias("reference_unit"),
        F.when(F.col("tier") == "mm", True)
        .when(F.col("tier").isin("px", "mm_blocked"), F.coalesce("production_eligible", F.lit(False)))
        .otherwise(False)
        .alias("production_eligible"),
        is_mm.alias("calibration_required"),
        validity.alias("calibration_validity"),
        F.when(from_profile, F.col("reference_count"))
        .when(derived_ok, F.col("candidate_count"))
        .cast("long")
        .alias("reference_count"),
        F.when(F.col("tier") != "derived", F.col("profile_name")).alias("profile_name"),
        F.when(from_profile, F.col("profile_source")).alias("profile_source"),
        F.when(F.col("tier") != "derived", F.coalesce(F.nullif("data_status", F.lit("")), F.lit("Proxy")))
        .when(derived_ok, "Sample-Derived")
        .alias("reference_data_status"),
        F.coalesce(F.when(F.col("_mode") != "none", F.col("_mode")), F.lit("unavailable")).alias("calibration_status"),
        "scale_ratio",
        F.when(F.col("tier") == "mm_blocked", blocked)
        .when((F.col("tier") == "derived") & ~derived_ok, F.col("reason"))
        .alias("reason"),
    )


def classify_fragment(
    df: DataFrame,
    length: Col = "length_px",
    reference: Col = "reference_length",
    source: Col = "reference_source",
    status: Col = "reference_status",
    quality: Col | None = None,
    broken: float = THRESHOLDS["broken"]["whole_kernel_fraction"],
    small: float = THRESHOLDS["broken"]["small_broken_max_fraction"],
) -> DataFrame:
    """Add broken_label, length_ratio, is_small_broken, label_confidence and label_reason."""
    known = (
        c(reference).isNotNull()
        & (c(reference) > 0)
        & (c(status) != "undetermined")
        & (c(source) != "unavailable")
    )
    df = df.withColumn("_ratio", F.when(known, F.try_divide(c(length), c(reference))))
    ratio = F.col("_ratio")
    conf = F.least(F.lit(1.0), F.abs(ratio - broken) / 0.20 + 0.60)
    if quality is not None:
        conf = (
            F.when(c(quality).isin("poor", "unreliable"), F.least(conf, F.lit(0.45)))
            .when(c(quality) == "limited", F.least(conf, F.lit(0.75)))
            .otherwise(conf)
        )
    reason = F.format_string(
        f"Length ratio %.3f %s threshold {broken:.2f} against %s reference (%.1f)",
        rnd(ratio, 3),
        F.when(ratio < broken, "<").otherwise(">="),
        c(source),
        rnd(reference, 1),
    )
    return df.withColumns(
        {
            "broken_label": F.when(ratio.isNull(), "undetermined").when(ratio < broken, "broken").otherwise("whole"),
            "length_ratio": rnd(ratio, 4),
            "is_small_broken": ratio < small,
            "label_confidence": F.when(ratio.isNull(), 0.0).otherwise(rnd(conf, 4)),
            "label_reason": F.when(ratio.isNull(), NO_REFERENCE).otherwise(reason),
        }
    ).drop("_ratio")


def build_profile(measurements: DataFrame, by: Sequence[str], length: Col = "length", breadth: Col = "breadth") -> DataFrame:
    """One measured mm profile per key from hand measurements, with its verdict.

    Two passes (mean, then squared deviations), so both aggregates combine map-side. Missing
    breadths everywhere mean no breadth was taken; missing somewhere is a count mismatch.
    """
    by = list(by)
    rows = measurements.select(*by, c(length).cast("double").alias("l"), c(breadth).cast("double").alias("b"))

    def bad(v: str) -> Column:
        col = F.col(v)
        return F.count_if((col <= 0) | F.isnan(col) | (F.abs(col) == float("inf")))

    means = rows.groupBy(*by).agg(
        F.count("l").alias("n"),
        F.count("b").alias("nb"),
        bad("l").alias("bad_l"),
        bad("b").alias("bad_b"),
        F.avg("l").alias("mean_l"),
        F.avg("b").alias("mean_b"),
    )
    spread = keyed_join(rows, means.select(*by, "mean_l"), by).groupBy(*by).agg(
        F.sum((F.col("l") - F.col("mean_l")) * (F.col("l") - F.col("mean_l"))).alias("ss")
    )
    full = means.join(spread, by)
    std = F.sqrt(F.try_divide(F.col("ss"), F.col("n")))
    message = (
        F.when(F.col("n") == 0, "At least one length measurement is required.")
        .when(F.col("bad_l") > 0, "All length values must be positive finite numbers.")
        .when((F.col("nb") > 0) & (F.col("nb") != F.col("n")), "breadths_mm must have the same count as lengths_mm.")
        .when(F.col("bad_b") > 0, "All breadth values must be positive finite numbers.")
        .otherwise("Valid")
    )
    return full.select(
        *by,
        F.col("n").cast("long").alias("reference_count"),
        rnd("mean_l", 3).alias("whole_kernel_length"),
        rnd(std, 3).alias("std_length"),
        rnd(F.when(F.col("mean_l") != 0, F.try_divide(std, F.col("mean_l"))).otherwise(0.0), 4).alias("cv_length"),
        rnd("mean_b", 3).alias("whole_kernel_breadth"),
        rnd(F.when(F.col("mean_b") > 0, F.try_divide(F.col("mean_l"), F.col("mean_b"))), 3).alias("whole_kernel_lb_ratio"),
        F.lit("mm").alias("reference_unit"),
        F.lit("Measured").alias("data_status"),
        message.alias("message"),
    )


def run_scenarios(samples: DataFrame, modes: Sequence[Sequence], schema: str) -> DataFrame:
    """Every sample under every mode. The modes are literal rows, unfolded in place."""
    fields = [part.split() for part in schema.split(",")]
    rows = [
        F.struct(*[F.lit(value).cast(kind).alias(name) for value, (name, kind) in zip(mode, fields, strict=True)])
        for mode in modes
    ]
    return samples.select("*", F.inline(F.array(*rows)))
