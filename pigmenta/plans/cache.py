"""Denoised pixels, kept for later renders: the median depends on the source, the size and the radius alone.

They lie in a folder under a fingerprint of the source's pixels, of what the size depends on, and of the code that made
them. The source is read for its fingerprint every time, so a changed source is never served an old result; palettes,
metrics, dithers and clean-up settings don't enter it, and previews and full renders use the same folder.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster, tiles
from ..sources import store


def fingerprint(table: DataFrame) -> str:
    """Tells tables with different rows apart, whatever their order: their number, and two sums of hashes."""
    row = [F.xxhash64(F.lit(seed), *table.columns) for seed in (1, 2)]
    found = table.agg(F.count("*"), *[F.sum(h.cast("decimal(20, 0)")) for h in row], *[F.bit_xor(h) for h in row]).first()
    return hashlib.sha256(repr((table.dtypes, *found)).encode()).hexdigest()


def denoised(pixels: DataFrame, images: DataFrame, pixel: int, smooth: bool, longest: int | None, radius: int, folder: str) -> DataFrame:
    """The pixels at their work size and denoised; worked out once and then read from the folder."""
    code = "".join(inspect.getsource(m) for m in (raster, tiles))
    said = (fingerprint(pixels.select("image_id", "y", "x", *"rgba")), fingerprint(images.select("image_id", "width", "height")), pixel, smooth, longest, radius, code)
    name = f"denoised-{hashlib.sha256(repr(said).encode()).hexdigest()}"
    if (known := store.kept(pixels.sparkSession, folder, name)) is None:
        rows = raster.downscale(pixels, images, pixel, smooth, longest) if pixel != 1 or longest else pixels
        store.keep(raster.denoise(rows, radius), folder, name)
        known = store.kept(pixels.sparkSession, folder, name)
    return known
