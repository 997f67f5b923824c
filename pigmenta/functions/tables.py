"""Built-in palettes, presets and dither tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import color

MOST_COLORS = 256
# Palettes of common machines and themes.
PALETTES = {
    "Game Boy (DMG)": ["#0f380f", "#306230", "#8bac0f", "#9bbc0f"],
    "1-bit Mono": ["#000000", "#ffffff"],
    "PICO-8": [
        "#000000", "#1d2b53", "#7e2553", "#008751", "#ab5236", "#5f574f", "#c2c3c7", "#fff1e8",
        "#ff004d", "#ffa300", "#ffec27", "#00e436", "#29adff", "#83769c", "#ff77a8", "#ffccaa",
    ],
    "Sweetie 16": [
        "#1a1c2c", "#5d275d", "#b13e53", "#ef7d57", "#ffcd75", "#a7f070", "#38b764", "#257179",
        "#29366f", "#3b5dc9", "#41a6f6", "#73eff7", "#f4f4f4", "#94b0c2", "#566c86", "#333c57",
    ],
    "CGA 16": [
        "#000000", "#0000aa", "#00aa00", "#00aaaa", "#aa0000", "#aa00aa", "#aa5500", "#aaaaaa",
        "#555555", "#5555ff", "#55ff55", "#55ffff", "#ff5555", "#ff55ff", "#ffff55", "#ffffff",
    ],
    "Solarized": [
        "#002b36", "#073642", "#586e75", "#657b83", "#839496", "#93a1a1", "#eee8d5", "#fdf6e3",
        "#b58900", "#cb4b16", "#dc322f", "#d33682", "#6c71c4", "#268bd2", "#2aa198", "#859900",
    ],
}
# Built-in presets; each has only the settings that it changes.
PRESETS = {
    ("b-cel", "Clean cel art"): {"pm-metric": "oklab", "pm-dither": "none", "pm-denoise": "1", "pm-speck": "12", "pm-tolerance": "60", "pm-smooth-stipple": "true"},
    ("b-flat", "Flat poster"): {"pm-dither": "none", "pm-merge-colors": "30", "pm-speck": "24", "pm-tolerance": "70", "pm-denoise": "1"},
    ("b-ink", "Ink lines"): {"pm-dither": "none", "pm-merge-colors": "25", "pm-speck": "16", "pm-tolerance": "65", "pm-outline": "true", "pm-outline-width": "2", "pm-outline-min": "24"},
    ("b-pixel", "Pixel art 8×"): {"pm-pixel": "8", "pm-dither": "none", "pm-smooth": "true", "pm-speck": "2", "pm-tolerance": "50", "pm-export-scale": "8"},
    ("b-photo", "Photo dither"): {"pm-dither": "fs", "pm-dither-amt": "100", "pm-pixel": "1", "pm-denoise": "0", "pm-speck": "0"},
}
# Hue angles of the harmony schemes; auto takes the hues of the image.
HARMONIES = {"auto": None, "complementary": (0, 180), "split": (0, 150, 210), "triadic": (0, 120, 240), "tetradic": (0, 90, 180, 270), "analogous": (0, 30, 330), "monochrome": (0,)}


def bayer(n: int) -> list[int]:
    """The n * n ordered-dither matrix, row by row, by the usual doubling rule."""
    m = [[0]]
    while len(m) < n:
        top = [[4 * v for v in row] + [4 * v + 2 for v in row] for row in m]
        m = top + [[4 * v + 3 for v in row] + [4 * v + 1 for v in row] for row in m]
    return [v for row in m for v in row]


def greyscale(spark: SparkSession, n: int) -> DataFrame:
    """idx, hex of n even steps from black to white."""
    v = color.half_up(F.col("idx") * 255 / (n - 1))
    return spark.range(n).select(F.col("id").cast("int").alias("idx")).select("idx", color.to_hex(v, v, v).alias("hex"))


def web_safe(spark: SparkSession) -> DataFrame:
    """idx, hex of the 6 * 6 * 6 cube, red first."""
    i = F.col("id").cast("int")
    return spark.range(216).select(i.alias("idx"), color.to_hex(F.floor(i / 36) * 51, F.floor(i / 6) % 6 * 51, i % 6 * 51).alias("hex"))


def palette(spark: SparkSession, colors: list[str] | str) -> DataFrame:
    """idx, hex, r, g, b of a list of colours, or of a built-in palette by name."""
    if isinstance(colors, str):
        if colors.startswith("Grayscale "):
            rows = greyscale(spark, int(colors.split()[1]))
        elif colors == "Web Safe 216":
            rows = web_safe(spark)
        else:
            return palette(spark, PALETTES[colors])
    else:
        rows = spark.createDataFrame(list(enumerate(colors)), "idx int, hex string")
    rgb = color.from_hex(F.col("hex"))
    return rows.select("idx", color.normal_hex(F.col("hex")).alias("hex"), *[F.coalesce(rgb[n], F.lit(0)).alias(n) for n in "rgb"])


def rgb_list(colors: list[str] | str) -> list[tuple[int, int, int]]:
    """The palette as numbers on the driver; there are at most 256. What isn't a colour is black."""
    if isinstance(colors, str):
        if colors.startswith("Grayscale "):
            n = int(colors.split()[1])
            return [(v, v, v) for v in (int(i * 255 / (n - 1) + 0.5) for i in range(n))]
        if colors == "Web Safe 216":
            return [(i // 36 * 51, i // 6 % 6 * 51, i % 6 * 51) for i in range(216)]
        colors = PALETTES[colors]
    out = []
    for c in colors:
        h = c.strip().removeprefix("#")
        h = "".join(x * 2 for x in h) if len(h) == 3 else h
        ok = len(h) == 6 and all(x in "0123456789abcdefABCDEF" for x in h)
        out.append(tuple(int(h[i : i + 2], 16) for i in (0, 2, 4)) if ok else (0, 0, 0))
    return out


def presets(spark: SparkSession) -> DataFrame:
    rows = [(i, n, s) for (i, n), s in PRESETS.items()]
    return spark.createDataFrame(rows, "id string, name string, settings map<string,string>")
