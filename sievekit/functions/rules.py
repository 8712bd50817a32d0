"""Column -> Column rules. Everything here stays inside generated code on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievekit.fixed import (
    NO_CALIBRATION,
    NO_MARKERS,
    NORMAL_LABELS,
    POSITIVE_LABELS,
    QUALITY_WORDS,
    SMALL_SAMPLE_FEW,
    SMALL_SAMPLE_ONE,
    TARGET_NAMES,
    FOREIGN_NAMES,
    THRESHOLDS,
)

Col = Column | str


def c(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rnd(value: Col, digits: int = 2) -> Column:
    """Decimal rounding, ties to even, by arithmetic (the same in every SQL engine)."""
    scale = float(10**digits)
    return F.rint(c(value) * scale) / F.lit(scale)


def fixed(value: Col, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", rnd(c(value).cast("double"), digits))


# --- text and time ----------------------------------------------------------

_ISO = (
    r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?)"
    r"(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2}(?:\.\d{1,6})?)?)$"
)


def event_time(text: Col) -> Column:
    """ISO text to a timestamp. The offset must be there and is dropped, not applied."""
    stem = F.regexp_extract(F.coalesce(c(text), F.lit("")), _ISO, 1)
    return F.when(stem != "", F.concat(stem, F.lit("Z")).try_cast("timestamp"))


def ist_label(ts: Col) -> Column:
    shifted = c(ts) + F.expr("INTERVAL '5:30' HOUR TO MINUTE")
    return F.coalesce(F.date_format(shifted, "yyyy-MM-dd HH:mm:ss 'IST'"), F.lit("N/A"))


def sanitize_name(name: Col) -> Column:
    return F.regexp_replace(c(name), r"[^A-Za-z0-9_.\-]", "_")


def sample_key(name: Col) -> Column:
    first = F.split_part(c(name), F.lit(" "), F.lit(1))
    return F.trim(F.split_part(first, F.lit("."), F.lit(1)))


def normalize_label(name: Col) -> Column:
    slug = F.regexp_replace(F.lower(F.trim(c(name))), "[^a-z0-9]+", "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    return F.when(slug.isin(*NORMAL_LABELS), "normal").when(
        slug.isin(*POSITIVE_LABELS), "sprouted_weevilled"
    )


# --- confidence -------------------------------------------------------------


def confidence_band(conf: Col) -> Column:
    return F.when(c(conf) >= 0.80, "HIGH").when(c(conf) >= 0.50, "MEDIUM").otherwise("LOW")


def band_quality(band: Col) -> Column:
    out = F.lit("segmented")
    for name, word in QUALITY_WORDS.items():
        out = F.when(c(band) == name, word).otherwise(out)
    return out


def ramp(value: Col, zero: float, full: float) -> Column:
    """0 at ``zero``, 1 at ``full``, linear between, in either direction."""
    if zero == full:
        return F.when(c(value) >= full, 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c(value) - zero) / (full - zero)))


# --- lengths and shapes -----------------------------------------------------


def to_metric(px: Col, px_per_mm: Col, validity: Col) -> Column:
    ok = (c(validity) == "valid") & (c(px_per_mm) > 0)
    return F.when(ok, F.try_divide(c(px), c(px_per_mm)))


def decision_length(eff_mm: Col, len_mm: Col, eff_px: Col) -> Column:
    return F.coalesce(c(eff_mm), c(len_mm), c(eff_px))


def display_length(mm: Col, px: Col) -> Column:
    return F.coalesce(c(mm), c(px))


def lb_ratio(length: Col, breadth: Col) -> Column:
    return F.when(c(breadth) > 0, F.try_divide(c(length), c(breadth)))


def aspect_ratio(length: Col, breadth: Col) -> Column:
    return F.coalesce(lb_ratio(length, breadth), F.lit(0.0))


def safe_percent(part: Col, whole: Col) -> Column:
    share = F.try_divide(c(part).cast("double"), c(whole).cast("double"))
    return F.when(c(whole) > 0, rnd(share * 100.0, 2)).otherwise(0.0)


def anomaly_reasons(lb: Col, solidity: Col, area: Col) -> Column:
    return F.array_compact(
        F.array(
            F.when(c(lb) > 10, F.concat(F.lit("Extreme L/B ratio: "), fixed(lb, 2))),
            F.when(c(solidity) < 0.5, F.concat(F.lit("Very low solidity: "), fixed(solidity, 3))),
            F.when(c(area) < 20, F.concat(F.lit("Very small area: "), fixed(area, 0), F.lit(" px"))),
        )
    )


def is_anomalous(lb: Col, solidity: Col, area: Col) -> Column:
    return F.coalesce(c(lb) > 10, F.lit(False)) | (c(solidity) < 0.5) | (c(area) < 20)


def measurement_quality(lb: Col, solidity: Col, area: Col) -> Column:
    return (
        F.when(is_anomalous(lb, solidity, area), "unreliable")
        .when(c(area) < 25, "poor")
        .when(c(area) < 100, "limited")
        .otherwise("good")
    )


def effective_length(*candidates: Col) -> Column:
    """Median of the positive candidates; the last one when none is positive."""
    ok = F.array_sort(F.filter(F.array(*[c(x).cast("double") for x in candidates]), lambda x: x > 0))
    n = F.size(ok)
    mid = (n / 2).cast("int")
    return (
        F.when(n == 0, c(candidates[-1]).cast("double"))
        .when(n % 2 == 1, F.get(ok, mid))
        .otherwise((F.get(ok, mid - 1) + F.get(ok, mid)) / 2.0)
    )


# --- detections -------------------------------------------------------------


def is_unresolved(conf: Col, w: Col, h: Col, parts: Col) -> Column:
    long_side = F.greatest(c(w), c(h)).cast("double")
    short_side = F.least(c(w), c(h)) + 1e-6
    return (c(conf) < 0.30) | (c(parts) >= 3) | (long_side > short_side * 5.0)


def is_target_class(category: Col, name: Col) -> Column:
    return (c(category) == 1) | F.lower(F.coalesce(c(name), F.lit(""))).isin(*TARGET_NAMES)


def is_foreign_class(category: Col, name: Col) -> Column:
    return (c(category) >= 2) | F.lower(F.coalesce(c(name), F.lit(""))).isin(*FOREIGN_NAMES)


def route(conf: Col, w: Col, h: Col, parts: Col, category: Col, name: Col) -> Column:
    """grain / foreign / unresolved, first match wins."""
    target = is_target_class(category, name)
    foreign = is_foreign_class(category, name)
    return (
        F.when(target & is_unresolved(conf, w, h, parts), "unresolved")
        .when(target, "grain")
        .when(foreign, "foreign")
        .when(c(conf) >= 0.50, "foreign")
        .otherwise("unresolved")
    )


def route_reason(routed: Col, category: Col, name: Col) -> Column:
    return F.when(
        c(routed) == "unresolved",
        F.when(is_target_class(category, name), "low_confidence_or_merged_appearance").otherwise(
            "ambiguous_class_low_confidence"
        ),
    )


def non_target_class(r: Col, g: Col, b: Col) -> Column:
    return (
        F.when((c(r) < 80) & (c(g) < 80) & (c(b) < 80), "stone")
        .when(c(g) > c(r) + 30, "organic")
        .otherwise("other_foreign_matter")
    )


def keep_detection(conf: Col, area: Col, x: Col, y: Col, w: Col, h: Col, img_w: Col, img_h: Col) -> Column:
    seg = THRESHOLDS["segmentation"]
    outside = (c(x) + c(w) <= 0) | (c(y) + c(h) <= 0) | (c(x) >= c(img_w)) | (c(y) >= c(img_h))
    return (
        (c(conf) >= seg["confidence_threshold"])
        & (c(area) >= seg["min_grain_area_pixels"])
        & ~outside
    )


def box_iou(ax: Col, ay: Col, aw: Col, ah: Col, bx: Col, by: Col, bw: Col, bh: Col) -> Column:
    ox = F.least(c(ax) + c(aw), c(bx) + c(bw)) - F.greatest(c(ax), c(bx))
    oy = F.least(c(ay) + c(ah), c(by) + c(bh)) - F.greatest(c(ay), c(by))
    inter = (F.greatest(ox, F.lit(0)) * F.greatest(oy, F.lit(0))).cast("double")
    union = c(aw) * c(ah) + c(bw) * c(bh) - inter
    return F.when(inter > 0, F.try_divide(inter, union)).otherwise(0.0)


# --- calibration ------------------------------------------------------------


def manual_scale(px: Col, mm: Col) -> Column:
    return F.when((c(px) > 0) & (c(mm) > 0), F.try_divide(c(px), c(mm)))


def marker_scale(corners: Col, size_mm: float = THRESHOLDS["calibration"]["marker_size_mm"]) -> Column:
    """Mean side of the first marker (array of four x/y structs) over its true size."""
    pts = c(corners)
    turned = F.concat(F.slice(pts, 2, 3), F.slice(pts, 1, 1))
    sides = F.zip_with(
        pts,
        turned,
        lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])),
    )
    return F.aggregate(sides, F.lit(0.0), lambda acc, s: acc + s) / 4.0 / size_mm


def calibration_validity(ppmm: Col, markers: Col, mode: Col) -> Column:
    """struct(validity, reason); the first rule that applies decides."""
    lo, hi = THRESHOLDS["calibration"]["ppmm_min"], THRESHOLDS["calibration"]["ppmm_max"]
    v = c(ppmm)
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))

    def verdict(word: str, reason: Column) -> Column:
        return F.struct(F.lit(word).alias("validity"), reason.alias("reason"))

    return (
        F.when((c(mode) == "none") | v.isNull(), verdict("unavailable", F.lit(NO_CALIBRATION)))
        .when(c(markers) <= 0, verdict("invalid", F.lit(NO_MARKERS)))
        .when(
            ~finite | (v <= 0),
            verdict(
                "invalid",
                F.concat(
                    F.lit("Calibration scale is not a positive finite number ("),
                    v.cast("string"),
                    F.lit(")."),
                ),
            ),
        )
        .when(
            (v < lo) | (v > hi),
            verdict(
                "invalid",
                F.format_string(
                    f"Calibration scale %.2f px/mm is outside sanity bounds [{lo}, {hi}] px/mm.", rnd(v)
                ),
            ),
        )
        .otherwise(verdict("valid", F.lit("")))
    )


# --- dashboard states -------------------------------------------------------


def health_state(last_ts: Col, errors: Col, requests: Col, parsed: Col, now: Col) -> Column:
    age = c(now).cast("double") - c(last_ts).cast("double")
    rate = F.try_divide(c(errors).cast("double"), F.greatest(c(requests), F.lit(1)).cast("double"))
    return (
        F.when(c(parsed) == 0, "RED")
        .when(c(last_ts).isNull(), "RED")
        .when(age > 300, "RED")
        .when((c(requests) > 0) & (rate > 0.1), "YELLOW")
        .otherwise("GREEN")
    )


def freshness(last_ts: Col, now: Col) -> Column:
    age = c(now).cast("double") - c(last_ts).cast("double")
    return (
        F.when(c(last_ts).isNull(), "none")
        .when(age < 60, "fresh")
        .when(age < 300, "slightly stale")
        .otherwise("stale")
    )


# --- samples and messages ---------------------------------------------------


def small_sample(n: Col, limit: int = 30) -> Column:
    return c(n) < limit


def small_sample_warning(n: Col, limit: int = 30) -> Column:
    return F.when(
        c(n) < limit,
        F.when(c(n) == 1, SMALL_SAMPLE_ONE).otherwise(F.format_string(SMALL_SAMPLE_FEW, c(n))),
    )


def label_note(n: Col, limit: int = 30) -> Column:
    return F.when(c(n) < limit, "Observed sample fraction").otherwise("Sample percentage")


def dedupe_messages(messages: Col) -> Column:
    return F.array_distinct(c(messages))


def thin_points(points: Col, wanted: int = 30) -> Column:
    step = F.greatest(F.lit(1), F.floor(F.size(c(points)) / wanted).cast("int"))
    return F.filter(c(points), lambda p, i: i % step == 0)
