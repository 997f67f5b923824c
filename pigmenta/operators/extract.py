"""Palettes from samples(image_id, ord, r, g, b): median cut with k-means in OKLab, and constructed ramps.

A sample has at most 40,000 pixels an image, so an image's sample is one group; hue histograms and lightness ranges are
plain aggregations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, tables
from .raster import _oklab_table

BINS = 72
LLOYD_ROUNDS = 8


def median_cut(rgb: np.ndarray, count: int) -> np.ndarray:
    """The mean colours of boxes, the widest of which is halved at its median until there are count."""
    boxes = [rgb] if len(rgb) else []
    while len(boxes) < count:
        span = [np.ptp(b, axis=0) if len(b) > 1 else np.full(3, -1) for b in boxes]
        widest = int(np.argmax([s.max() for s in span])) if boxes else 0
        if not boxes or span[widest].max() <= 0:
            break
        box = boxes[widest]
        box = box[np.argsort(box[:, int(np.argmax(span[widest]))], kind="stable")]
        boxes[widest : widest + 1] = [box[: len(box) // 2], box[len(box) // 2 :]]
    return np.array([b.mean(axis=0) for b in boxes]).reshape(-1, 3)


def _to_levels(lab: np.ndarray) -> np.ndarray:
    lms = lab @ np.array(color.LAB_TO_LMS).T
    c = (lms**3) @ np.array(color.LMS_TO_LINEAR).T
    v = np.where(c <= 0.0031308, c * 12.92, 1.055 * np.maximum(c, 0) ** (1 / 2.4) - 0.055)
    return np.clip(v * 255, 0, 255)


def cluster(rgb: np.ndarray, count: int) -> list[str]:
    """Median cut, eight rounds of k-means in OKLab, colours by lightness without repeats."""
    centers = median_cut(rgb, count)
    if not len(centers):
        return []
    lab = _oklab_table(rgb).astype(np.float32).astype(float)
    at = _oklab_table(centers).astype(np.float32).astype(float)
    for _ in range(LLOYD_ROUNDS):
        own = np.concatenate([np.argmin(((part[:, None] - at[None]) ** 2).sum(axis=2), axis=1) for part in np.array_split(lab, max(1, len(lab) * len(at) // 2_000_000))])
        n = np.bincount(own, minlength=len(at))
        sums = np.stack([np.bincount(own, weights=lab[:, c], minlength=len(at)) for c in range(3)], axis=1)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at).astype(np.float32).astype(float)
    levels = np.floor(_to_levels(at[np.argsort(at[:, 0], kind="stable")]) + 0.5).astype(int)
    return list(dict.fromkeys("#{:02x}{:02x}{:02x}".format(*v) for v in levels.tolist()))


def extract_palette(samples: DataFrame, count: int) -> DataFrame:
    """palette_id (the image), idx, hex of each image's palette."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = cluster(pdf.sort_values("ord")[["r", "g", "b"]].to_numpy(dtype=float), count)
        return pd.DataFrame({"palette_id": pd.Series([pdf["image_id"].iloc[0]] * len(found), dtype="int64"), "idx": pd.Series(range(len(found)), dtype="int32"), "hex": pd.Series(found, dtype=object)})

    return samples.groupBy("image_id").applyInPandas(run, "palette_id long, idx int, hex string")


def hue_histogram(samples: DataFrame) -> DataFrame:
    """image_id, bin, weight: chroma by hue, of colours that aren't grey."""
    rows = samples.withColumn("_lab", color.oklab(F.col("r"), F.col("g"), F.col("b"))).withColumn("_c", color.chroma(F.col("_lab"))).where(F.col("_c") >= color.NEUTRAL_CHROMA)
    return rows.groupBy("image_id", (F.floor(color.hue(F.col("_lab")) / 360 * BINS) % BINS).cast("int").alias("bin")).agg(F.sum("_c").alias("weight"), F.count("*").alias("n"))


def smooth_histogram(histogram: DataFrame) -> DataFrame:
    """image_id, bin, weight after a quarter, half, quarter filter round the wheel."""
    taps = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25))]))
    return histogram.select("image_id", "bin", "weight", taps.alias("t")).groupBy("image_id", ((F.col("bin") + F.col("t.d") + BINS) % BINS).alias("bin")).agg(F.sum(F.col("weight") * F.col("t.w")).alias("weight"))


def dominant_hues(samples: DataFrame, want: int) -> DataFrame:
    """image_id, hues (at most want) and peak chroma. Each image is 72 numbers by now."""
    near = int(BINS * 22 / 360 + 0.5)
    hist = hue_histogram(samples)
    peak = hist.groupBy("image_id").agg((F.sum("weight") / F.sum("n") * 1.9).alias("peak"))
    bins = smooth_histogram(hist).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0.0)))

    def take(s, _):
        return color.let(F.array_position(s["v"], F.array_max(s["v"])).cast("int") - 1, lambda top: _take(s, top))

    def _take(s, top):
        i = [((top + d + BINS) % BINS).cast("int") for d in range(-2, 3)]
        w = [F.element_at(s["v"], k + 1) for k in i]
        ang = [(k + 0.5) / BINS * 360 for k in i]
        h = F.degrees(F.atan2(sum((F.sin(F.radians(a)) * x for a, x in zip(ang, w, strict=True)), F.lit(0.0)), sum((F.cos(F.radians(a)) * x for a, x in zip(ang, w, strict=True)), F.lit(0.0))))
        left = F.transform(s["v"], lambda x, k: F.when(F.least((k - top + BINS) % BINS, (top - k + BINS) % BINS) <= near, 0.0).otherwise(x))
        some = F.array_max(s["v"]) > 0
        return F.struct(F.when(some, left).otherwise(s["v"]).alias("v"), F.when(some, F.concat(s["hues"], F.array(F.when(h < 0, h + 360).otherwise(h)))).otherwise(s["hues"]).alias("hues"))

    found = bins.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(want)), F.struct(full.alias("v"), F.array().cast("array<double>").alias("hues")), take))
    out = samples.select("image_id").distinct().join(found.select("image_id", F.col("_s.hues").alias("hues")), "image_id", "left").join(peak, "image_id", "left")
    return out.select("image_id", F.coalesce("hues", F.array().cast("array<double>")).alias("hues"), color.clamp(F.coalesce("peak", F.lit(0.11)), 0.06, 0.22).alias("peak"))


def theory_palette(samples: DataFrame, count: int, scheme: str = "auto", shift: float = 1.0) -> DataFrame:
    """palette_id, idx, hex: a neutral ramp and one ramp for each hue of the scheme, across the image's lightness.

    Ramps that come out equal shorten the palette; it isn't topped up.
    """
    wanted = min(max(int(count / 6 + 0.5), 2), 9)
    angles = tables.HARMONIES[scheme]
    light = samples.select("image_id", color.oklab(F.col("r"), F.col("g"), F.col("b"))["l"].alias("l")).groupBy("image_id").agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    flat = F.col("hi") - F.col("lo") < 0.25
    light = light.select("image_id", F.when(flat, F.greatest(F.lit(0.0), F.col("lo") - 0.15)).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.least(F.lit(1.0), F.col("hi") + 0.15)).otherwise(F.col("hi")).alias("hi"))
    hues = dominant_hues(samples, 1 if angles else max(1, wanted - 1)).join(light, "image_id")
    first = F.coalesce(F.get("hues", F.lit(0)), F.lit(0.0))
    if angles:
        plan = F.array(*[(first + angles[i % len(angles)] + i // len(angles) * (0 if scheme == "monochrome" else 12)) % 360 for i in range(max(1, wanted - 1))])
    else:
        plan = F.when(F.size("hues") > 0, F.col("hues")).otherwise(F.array(F.lit(0.0)))
    rows = hues.withColumn("_plan", plan)
    fresh = F.filter("_plan", lambda h, k: ~F.exists(F.slice("_plan", 1, k), lambda p: F.abs(color.hue_step(p, h)) < 5))
    rows = rows.withColumn("_plan", fresh).withColumn("_ramps", F.size("_plan") + 1).withColumn("_steps", F.greatest(F.lit(3), F.floor(F.lit(count) / F.col("_ramps"))))
    rows = rows.select("*", F.posexplode(F.concat(F.array(F.lit(0.0)), F.col("_plan"))).alias("_r", "_hue"))
    rows = rows.withColumn("_n", F.col("_steps") + F.when(F.col("_r") < F.lit(count) - F.col("_steps") * F.col("_ramps"), 1).otherwise(0)).select("*", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("_i"))
    grey = F.col("_r") == 0
    one = color.ramp_color(F.col("_i"), F.col("_n"), F.col("_hue"), F.when(grey, 0.0).otherwise(F.col("peak")), F.col("lo"), F.col("hi"), F.when(grey, 0.0).otherwise(F.lit(float(shift))))
    rows = rows.select(F.col("image_id").alias("palette_id"), "_r", "_i", one.alias("hex"))
    firsts = rows.groupBy("palette_id", "hex").agg(F.min(F.struct("_r", "_i")).alias("_at"))
    return firsts.withColumn("idx", F.row_number().over(Window.partitionBy("palette_id").orderBy("_at")) - 1).where(F.col("idx") < count).select("palette_id", "idx", "hex")
