"""Colour arithmetic as Column expressions: hex, sRGB, OKLab, OKLCh, hue steps and ramps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# The published OKLab matrices.
LINEAR_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
LAB_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_TO_LINEAR = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
# Where ramps drift at their ends (degrees), how far, and the chroma they keep there.
SHADOW_HUE, HIGHLIGHT_HUE, MOST_DRIFT = 264.0, 85.0, 18.0
SHADOW_CHROMA, HIGHLIGHT_CHROMA, SHOULDER = 0.55, 0.30, 0.65
# Fixed value: below this chroma a colour counts as grey.
NEUTRAL_CHROMA = 0.028


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def clamp(v: Column, lo, hi) -> Column:
    return F.greatest(_c(lo), F.least(v, _c(hi)))


def half_up(v: Column) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(v + 0.5)


def hex_byte(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(v.cast("long")), 2, "0"))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb, from channels that are rounded and clamped."""
    return F.concat(F.lit("#"), *[hex_byte(clamp(half_up(v), 0, 255)) for v in (r, g, b)])


def hex_digits(text: Column) -> Column:
    """The six hex digits of a colour, or null. Three digits are doubled; # and outer blanks are optional."""
    h = F.regexp_replace(F.trim(text), "^#", "")
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.when(h.rlike("^[0-9a-fA-F]{6}$"), h)


def from_hex(text: Column) -> Column:
    """struct(r, g, b) of a colour, or null."""
    h = hex_digits(text)
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return F.when(h.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def normal_hex(text: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(hex_digits(text)))


def linear(v: Column) -> Column:
    """The linear light of an sRGB level from 0 to 255."""
    c = clamp(v.cast("double"), 0.0, 255.0) / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def level(c: Column) -> Column:
    """The sRGB level, 0 to 255, of linear light."""
    v = F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
    return clamp(v * 255.0, 0.0, 255.0)


def _times(matrix, v: list[Column]) -> list[Column]:
    return [v[0] * a + v[1] * b + v[2] * c for a, b, c in matrix]


def _triple(values: list[Column], names: str) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])


def oklab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) in OKLab."""
    light = _triple([linear(r), linear(g), linear(b)], "rgb")
    cones = lambda v: _triple([F.cbrt(x) for x in _times(LINEAR_TO_LMS, [v[n] for n in "rgb"])], "lms")
    return let(let(light, cones), lambda v: _triple(_times(LMS_TO_LAB, [v[n] for n in "lms"]), "lab"))


def from_oklab(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """struct(r, g, b) of levels; each channel is clamped by itself."""
    cones = _triple(_times(LAB_TO_LMS, [l, a, b]), "lms")
    light = let(cones, lambda v: _triple(_times(LMS_TO_LINEAR, [v[n] * v[n] * v[n] for n in "lms"]), "rgb"))
    return let(light, lambda v: _triple([level(v[n]) for n in "rgb"], "rgb"))


def hue(lab: Column) -> Column:
    return let(F.degrees(F.atan2(lab["b"], lab["a"])), lambda h: F.when(h < 0, h + 360.0).otherwise(h))


def chroma(lab: Column) -> Column:
    return F.sqrt(lab["a"] * lab["a"] + lab["b"] * lab["b"])


def oklch(text: Column) -> Column:
    """struct(l, c, h) of a hex colour; what isn't a colour counts as black."""
    rgb = F.coalesce(from_hex(text), F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b")))
    lab = let(rgb, lambda v: oklab(v["r"], v["g"], v["b"]))
    return let(lab, lambda v: F.struct(v["l"].alias("l"), chroma(v).alias("c"), hue(v).alias("h")))


def lightness(text: Column) -> Column:
    rgb = from_hex(text)
    return F.coalesce(oklab(rgb["r"], rgb["g"], rgb["b"])["l"], F.lit(0.0))


def hue_step(start: Column, end: Column) -> Column:
    """The shortest signed way round the wheel, in degrees."""
    return let((end - start) % 360, lambda d: F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d))


def _at(l: Column, c: Column, h: Column) -> Column:  # noqa: E741
    return from_oklab(l, F.cos(F.radians(h)) * c, F.sin(F.radians(h)) * c)


def _inside(rgb: Column) -> Column:
    ok = F.lit(True)
    for n in "rgb":
        ok = ok & (rgb[n] > 0.001) & (rgb[n] < 254.999)
    return ok


#: Linear light of the levels between which a channel counts as inside, 0.001 and 254.999.
_LIGHT = (0.001 / 255 / 12.92, ((254.999 / 255 + 0.055) / 1.055) ** 2.4)


def _light(l: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:  # noqa: E741
    """The linear light of rows of OKLab colours."""
    cones = [v * v * v for v in _times(LAB_TO_LMS, [l, a, b])]
    return _times(LMS_TO_LINEAR, cones)


def _fitted(l: np.ndarray, c: np.ndarray, h: np.ndarray) -> list[np.ndarray]:  # noqa: E741
    """fit_to_gamut of rows; only those that sRGB doesn't hold are halved."""
    cos, sin = np.cos(np.radians(h)), np.sin(np.radians(h))
    inside = lambda light: np.all([(v > _LIGHT[0]) & (v < _LIGHT[1]) for v in light], axis=0)
    light = _light(l, cos * c, sin * c)
    far = np.flatnonzero(~inside(light))
    l, cos, sin, lo, hi = l[far], cos[far], sin[far], np.zeros(len(far)), c[far]  # noqa: E741
    for _ in range(16):
        mid = (lo + hi) / 2
        ok = inside(_light(l, cos * mid, sin * mid))
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
    for v, w in zip(light, _light(l, cos * lo, sin * lo), strict=True):
        v[far] = w
    return [np.clip(np.where(v <= 0.0031308, v * 12.92, np.power(np.fmax(v, 0.0), 1 / 2.4) * 1.055 - 0.055) * 255.0, 0.0, 255.0) for v in light]


@F.arrow_udf(returnType=StructType([StructField(n, DoubleType()) for n in "rgb"]))
def _fit(l: pa.Array, c: pa.Array, h: pa.Array) -> pa.Array:  # noqa: E741
    columns = [x.to_numpy(zero_copy_only=False).astype(float) for x in (l, c, h)]
    return pa.StructArray.from_arrays([pa.array(v) for v in _fitted(*columns)], names=list("rgb"))


def fit_to_gamut(l: Column, c: Column, h: Column) -> Column:  # noqa: E741
    """struct(r, g, b) at this lightness and hue, with the chroma halved in on, sixteen times, until sRGB holds it.

    Arrow batches are worked out at once: as an expression it would be interpreted for each row and each halving. So it
    has no place in the lambda of a higher-order function.
    """
    return _fit(l.cast("double"), c.cast("double"), h.cast("double"))


def ramp_color(i: Column, steps: Column, base_hue: Column, peak: Column, lo: Column, hi: Column, shift: Column | float) -> Column:
    """Colour i of a ramp: chroma peaks in the middle; the hue cools toward shadows and warms toward highlights."""

    t = F.when(steps == 1, 0.5).otherwise(i / (steps - 1))
    floor = F.lit(SHADOW_CHROMA) + (HIGHLIGHT_CHROMA - SHADOW_CHROMA) * t
    c = peak * (floor + (1 - floor) * F.pow(F.greatest(F.sin(t * math.pi), F.lit(0.0)), F.lit(SHOULDER)))
    drift = (t - 0.5) * 2
    to = F.when(drift < 0, SHADOW_HUE).otherwise(HIGHLIGHT_HUE)
    h = base_hue + hue_step(base_hue, to) * F.abs(drift) * (MOST_DRIFT / 180) * shift
    v = fit_to_gamut(lo + (hi - lo) * t, c, h)
    return to_hex(v["r"], v["g"], v["b"])


def count_label(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))
