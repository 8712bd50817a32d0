"""8-bit colour conversions by formula: grey, hue/saturation/value and L*a*b* bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievekit.functions.rules import Col, c

# Linear sRGB to XYZ, white point D65, and the L* knee.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.950456, 1.0, 1.088754)
_KNEE = 0.008856


def byte(value: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(value + 0.5))).cast("int")


def gray(r: Col, g: Col, b: Col) -> Column:
    return byte(c(r) * 0.299 + c(g) * 0.587 + c(b) * 0.114)


def _linear(v: Column) -> Column:
    s = v / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def _root(t: Column) -> Column:
    return F.when(t > _KNEE, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * 7.787 + 16.0 / 116.0)


def lightness8(y: Column) -> Column:
    star = F.when(y > _KNEE, F.pow(y, F.lit(1.0 / 3.0)) * 116.0 - 16.0).otherwise(y * 903.3)
    return byte(star * 255.0 / 100.0)


def gray_lightness(g: Col) -> Column:
    """L* (0-100) of a neutral grey byte, through the same byte rounding."""
    return lightness8(_linear(c(g))) * 100.0 / 255.0


def with_lab8(df, r: str = "r", g: str = "g", b: str = "b", out=("lab_l", "lab_a", "lab_b")):
    """Add the three L*a*b* bytes; shared parts are computed once, in stages."""
    lin = [_linear(c(x)) for x in (r, g, b)]
    staged = df.withColumns({f"_lin{i}": lin[i] for i in range(3)})
    xyz = {
        f"_{axis}": (F.col("_lin0") * k[0] + F.col("_lin1") * k[1] + F.col("_lin2") * k[2]) / w
        for axis, k, w in zip("xyz", _XYZ, _WHITE)
    }
    staged = staged.withColumns(xyz)
    staged = staged.withColumns({f"_f{a}": _root(F.col(f"_{a}")) for a in "xyz"})
    lab = staged.withColumns(
        {
            out[0]: lightness8(F.col("_y")),
            out[1]: byte((F.col("_fx") - F.col("_fy")) * 500.0 + 128.0),
            out[2]: byte((F.col("_fy") - F.col("_fz")) * 200.0 + 128.0),
        }
    )
    return lab.drop("_lin0", "_lin1", "_lin2", "_x", "_y", "_z", "_fx", "_fy", "_fz")


def value8(r: Col, g: Col, b: Col) -> Column:
    return F.greatest(c(r), c(g), c(b)).cast("int")


def saturation8(r: Col, g: Col, b: Col) -> Column:
    top = F.greatest(c(r), c(g), c(b)).cast("double")
    span = top - F.least(c(r), c(g), c(b))
    return F.when(top > 0, byte(F.try_divide(span * 255.0, top))).otherwise(0)


def hue8(r: Col, g: Col, b: Col) -> Column:
    """Hue in half degrees, 0-180."""
    top = F.greatest(c(r), c(g), c(b)).cast("double")
    span = top - F.least(c(r), c(g), c(b))
    raw = (
        F.when(span == 0, 0.0)
        .when(top == c(r), F.try_divide((c(g) - c(b)) * 60.0, span))
        .when(top == c(g), F.try_divide((c(b) - c(r)) * 60.0, span) + 120.0)
        .otherwise(F.try_divide((c(r) - c(g)) * 60.0, span) + 240.0)
    )
    return byte(F.when(raw < 0, raw + 360.0).otherwise(raw) / 2.0)


def in_band(h: Col, s: Col, v: Col, band, cap_sv: bool = True) -> Column:
    (h0, s0, v0), (h1, s1, v1) = band
    hit = (c(h) >= h0) & (c(h) <= h1) & (c(s) >= s0) & (c(v) >= v0)
    if cap_sv:
        hit = hit & (c(s) <= s1) & (c(v) <= v1)
    return hit
