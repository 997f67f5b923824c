"""The whole raster pipeline: resample, denoise, adjust and map, clean up, outline, upscale; and palette extraction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import extract, palettes, raster, regions
from .cache import denoised

#: The longest edge of previews and of the image that colours are extracted from.
PREVIEW = 1200


@dataclass(frozen=True)
class Options:
    """Settings of a run; areas are in pixels of the full work size."""

    metric: str = "oklab"
    dither: str = "none"
    dither_amount: float = 1.0
    pixel: int = 1
    smooth: bool = True
    tone: raster.Tone = field(default_factory=raster.Tone)
    alpha_cut: int = raster.ALPHA_CUT
    denoise: int = 0
    speck: int = 0
    tolerance: float = 0.5
    smooth_stipple: bool = False
    merge_colors: float = 0
    outline: bool = False
    outline_color: str = "#000000"
    outline_width: int = 1
    outline_min: int = 0
    export_scale: int = 1
    export_full: bool = True

    def settings(self) -> dict[str, str]:
        """The options as a preset stores them: texts by setting, shares in percent."""
        t = self.tone
        values = {
            "pm-metric": self.metric, "pm-dither": self.dither, "pm-dither-amt": self.dither_amount * 100, "pm-pixel": self.pixel, "pm-smooth": self.smooth, "pm-alpha-cut": self.alpha_cut,
            "pm-black-point": t.black, "pm-white-point": t.white, "pm-brightness": t.brightness, "pm-contrast": t.contrast, "pm-saturation": t.saturation, "pm-gamma": t.gamma * 100,
            "pm-denoise": self.denoise, "pm-speck": self.speck, "pm-tolerance": self.tolerance * 100, "pm-smooth-stipple": self.smooth_stipple,
            "pm-merge-colors": self.merge_colors, "pm-outline": self.outline, "pm-outline-color": self.outline_color, "pm-outline-width": self.outline_width, "pm-outline-min": self.outline_min,
            "pm-export-scale": self.export_scale, "pm-export-full": self.export_full,
        }
        return {k: str(v).lower() if isinstance(v, bool) else f"{round(v, 6):g}" if isinstance(v, int | float) else v for k, v in values.items()}

    @classmethod
    def of(cls, settings: dict[str, str]) -> Options:
        """Options from settings, those that are missing by default."""
        s = cls().settings() | {k: v for k, v in settings.items() if v is not None}
        number, whole = (lambda k: float(s[f"pm-{k}"])), (lambda k: int(float(s[f"pm-{k}"])))
        chosen = lambda k: s[f"pm-{k}"].lower() not in ("", "false", "0")
        tone = raster.Tone(whole("black-point"), whole("white-point"), number("brightness"), number("contrast"), number("saturation"), number("gamma") / 100)
        return cls(
            s["pm-metric"], s["pm-dither"], number("dither-amt") / 100, whole("pixel"), chosen("smooth"), tone, whole("alpha-cut"), whole("denoise"), whole("speck"), number("tolerance") / 100, chosen("smooth-stipple"),
            number("merge-colors"), chosen("outline"), s["pm-outline-color"], whole("outline-width"), whole("outline-min"), whole("export-scale"), chosen("export-full"),
        )


def map_pixels(pixels: DataFrame, colors: list[str] | str, o: Options) -> DataFrame:
    """image_id, y, x, idx: hard alpha, tone, dither, nearest colour."""
    rows = raster.adjust(raster.opaque(pixels, o.alpha_cut), o.tone)
    if o.dither == "fs" and o.dither_amount > 0:
        return raster.diffused(rows, colors, o.metric, o.dither_amount)
    if o.dither in ("bayer4", "bayer8"):
        rows = raster.ordered_dither(rows, int(o.dither[-1]), o.dither_amount, colors)
    return raster.match(rows, colors, o.metric).select(*raster.POS, "idx")


def area_scales(images: DataFrame, pixel: int, preview: int | None) -> DataFrame:
    """image_id and scale: the share of its full work size that each image has in the preview."""
    w, h = F.col("width"), F.col("height")
    full, small = raster.work_size(w, h, pixel), raster.work_size(w, h, pixel, preview)
    sizes = images.select("image_id", full.alias("f"), small.alias("p"))
    return sizes.select("image_id", (F.col("p.w") * F.col("p.h") / (F.col("f.w") * F.col("f.h"))).alias("scale"))


def scaled_area(v: int, scale: Column) -> int | Column:
    """An area of v pixels at the scale, 1 at least; 0 stays 0."""
    return F.greatest(F.lit(1), F.floor(v * scale + 0.5)).cast("int") if v > 0 else 0


def render(pixels: DataFrame, images: DataFrame, colors: list[str] | str, o: Options, preview: int | None = None, cache: str | None = None) -> DataFrame:
    """Finished pixels. preview: the longest edge; areas are scaled by each image's own share.

    cache: a folder where denoised pixels are kept for renders of the same images at the same size.
    """
    if cache and o.denoise:
        rows = denoised(pixels, images, o.pixel, o.smooth, preview, o.denoise, cache)
    else:
        rows = raster.downscale(pixels, images, o.pixel, o.smooth, preview) if o.pixel != 1 or preview else pixels
        rows = raster.denoise(rows, o.denoise)
    scales = area_scales(images, o.pixel, preview) if preview else None

    def area(v: int, labels: DataFrame) -> tuple[int | Column, DataFrame]:
        return (v, labels) if scales is None or v <= 0 else (scaled_area(v, F.col("scale")), labels.join(scales, "image_id"))

    mapped = map_pixels(rows, colors, o)
    near = o.tolerance * regions.MOST_DISTANCE
    if o.smooth_stipple:
        mapped = regions.smooth_stipple(mapped, colors, near)
    if o.merge_colors > 0:
        mapped = regions.merge_colors(mapped, colors, o.merge_colors / 100 * regions.MOST_DISTANCE)
    if o.speck > 0 or o.outline:
        mapped = regions.label_regions(mapped)
        if o.speck > 0:
            most, mapped = area(o.speck, mapped)
            mapped = regions.absorb_small(mapped, colors, most, near)
    out = raster.paint(mapped, colors)
    if o.outline:
        least, mapped = area(o.outline_min, mapped)
        out = regions.paint_edges(out, regions.outlines(mapped, o.outline_width, least), o.outline_color)
    return raster.upscale(out, o.export_scale)


def export(pixels: DataFrame, images: DataFrame, colors: list[str] | str, o: Options, cache: str | None = None) -> DataFrame:
    """Pixels to save: rendered at full size if the options say so, else as in the preview; then upscaled."""
    return render(pixels, images, colors, o, None if o.export_full else PREVIEW, cache)


def extract_colors(pixels: DataFrame, images: DataFrame, count: int, scheme: str | None = None, shift: float = 1.0, onto: DataFrame | None = None) -> DataFrame:
    """palette_id (the image), idx, hex: colours from a smoothed image of at most PREVIEW pixels an edge.

    scheme: builds ramps by a harmony instead of clustering. onto: palettes that the colours are appended to; without
    it they replace what was there. Either way repeats go and the palette is capped.
    """
    size = raster.work_size(F.col("width"), F.col("height"), 1, PREVIEW)
    small = images.select("image_id", size.alias("s")).select("image_id", F.col("s.w").alias("width"), F.col("s.h").alias("height"))
    samples = raster.sample(raster.downscale(pixels, images, 1, True, PREVIEW), small)
    found = extract.theory_palette(samples, count, scheme, shift) if scheme else extract.extract_palette(samples, count)
    return palettes.append_colors(onto, found) if onto is not None else palettes.distinct_colors(found)
