"""Operators on pixels(image_id, y, x, r, g, b, a): tone, dither, matching, denoising, resampling.

Tone, dither and resampling are Column expressions; denoising works in tiles with a margin. Matching needs no shuffle:
Arrow batches are searched with the palette, which has at most 256 colours. It is an operator of its own in the plan and
not an expression, so that no later filter makes Spark search twice. Error diffusion is a stream of sorted rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import color, tables
from .tiles import TILE, Tile, map_tiles

ALPHA_CUT = 8
SAMPLES = 20_000
POS = ["image_id", "y", "x"]


@dataclass(frozen=True)
class Tone:
    """Levels, gamma, brightness, contrast and saturation; the defaults change nothing."""

    black: int = 0
    white: int = 255
    brightness: float = 0
    contrast: float = 0
    saturation: float = 0
    gamma: float = 1.0

    def neutral(self) -> bool:
        return self.black == 0 and self.white == 255 and not self.brightness and not self.contrast and not self.saturation and abs(self.gamma - 1) <= 0.001

    def table(self) -> list[float]:
        """What becomes of each level: levels, gamma, brightness, contrast; not clamped at the end."""
        lo = min(max(self.black, 0), 254)
        hi = min(max(self.white, lo + 1), 255)
        v = np.arange(256, dtype=float)
        if (lo, hi) != (0, 255):
            v = np.clip((v - lo) * (255 / (hi - lo)), 0, 255)
        c = self.contrast * 2.55
        v = 255 * (v / 255) ** (1 / self.gamma) + self.brightness * 1.275
        v = 259 * (c + 255) / (255 * (259 - c)) * (v - 128) + 128
        return v.astype(np.float32).astype(float).tolist()


def opaque(pixels: DataFrame, cut: int = ALPHA_CUT) -> DataFrame:
    """Hard alpha: 0 with black, or 255."""
    shown = F.col("a") >= cut
    return pixels.withColumns({**{c: F.when(shown, F.col(c)).otherwise(0) for c in "rgb"}, "a": F.when(shown, 255).otherwise(0)})


def adjust(pixels: DataFrame, tone: Tone) -> DataFrame:
    """Tone and saturation; r, g and b become doubles that may leave 0 to 255."""
    if tone.neutral():
        return pixels
    table = F.array(*[F.lit(v) for v in tone.table()])
    v = {c: F.element_at(table, F.col(c).cast("int") + 1) for c in "rgb"}
    out = pixels.withColumns(v)
    if tone.saturation:
        luma = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
        out = out.withColumn("_l", luma).withColumns({c: F.col("_l") + (F.col(c) - F.col("_l")) * (1 + tone.saturation / 100) for c in "rgb"}).drop("_l")
    return out


def mean_spacing(colors: list[str] | str) -> float:
    """The mean distance of a palette's colours to their nearest other, in sRGB; 0 for one colour."""
    p = np.array(tables.rgb_list(colors), dtype=float)
    if len(p) < 2:
        return 0.0
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return float(np.sqrt(d.min(axis=1)).mean())


def ordered_dither(pixels: DataFrame, size: int, amount: float, colors: list[str] | str) -> DataFrame:
    """Adds a Bayer threshold, scaled to the spacing of the palette, to all channels."""
    if amount <= 0:
        return pixels
    spread = (mean_spacing(colors) or 32) * amount * 0.6
    matrix = F.array(*[F.lit((v / size**2 - 0.5) * spread) for v in tables.bayer(size)])
    t = F.element_at(matrix, ((F.col("y") % size) * size + F.col("x") % size + 1).cast("int"))
    return pixels.withColumns({c: F.col(c) + t for c in "rgb"})


def _channel(c: str) -> Column:
    return color.clamp(F.col(c), 0, 255).cast("int")


def nearest(colors: list[str] | str, metric: str = "srgb", r: Column | None = None, g: Column | None = None, b: Column | None = None) -> Column:
    """The number of the nearest palette colour; of equals, the first. metric: oklab, redmean, or sRGB."""
    rgb = tables.rgb_list(colors)
    r, g, b = (_channel(c) if v is None else v for c, v in zip("rgb", (r, g, b), strict=True))
    if metric == "oklab":
        lab = color.oklab(r, g, b)
        entries = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(n) for v, n in zip(c, "lab", strict=True)]) for i, c in enumerate(_oklab_table(np.array(rgb, dtype=float)))])
        best = F.transform(F.array(lab), lambda p: F.array_min(F.transform(entries, lambda e: F.struct(sum(((p[n] - e[n]) * (p[n] - e[n]) for n in "ab"), (p["l"] - e["l"]) * (p["l"] - e["l"])).alias("d"), e["i"].alias("i")))))
        return best[0]["i"]
    entries = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(n) for v, n in zip(c, "rgb", strict=True)]) for i, c in enumerate(rgb)])

    def key(e: Column) -> Column:
        dr, dg, db = r - e["r"], g - e["g"], b - e["b"]
        if metric == "redmean":  # times 512, so that it is whole
            s = r + e["r"]
            d = (1024 + s) * dr * dr + 2048 * dg * dg + (1024 + 510 - s) * db * db
        else:
            d = dr * dr + dg * dg + db * db
        return d.cast("long") * 256 + e["i"]

    return (F.array_min(F.transform(entries, key)) % 256).cast("int")


def nearest_levels(levels: np.ndarray, colors: list[str] | str, metric: str = "srgb") -> np.ndarray:
    """nearest() for rows of whole levels r, g, b; one pass over the rows for each colour."""
    rgb = np.array(tables.rgb_list(colors), dtype=np.int64)
    at, table = (_oklab_table(levels.astype(float)), _oklab_table(rgb.astype(float))) if metric == "oklab" else (levels, rgb)
    out, least = np.zeros(len(levels), dtype=np.int32), np.full(len(levels), np.inf)
    for i, entry in enumerate(table):
        d0, d1, d2 = (at[:, k] - entry[k] for k in range(3))
        if metric == "redmean":
            s = levels[:, 0] + entry[0]
            d = (1024 + s) * d0 * d0 + 2048 * d1 * d1 + (1534 - s) * d2 * d2
        else:
            d = d0 * d0 + d1 * d1 + d2 * d2
        near = d < least
        out[near], least[near] = i, d[near]
    return out


#: Levels of a channel that a cell of the colour cube spans, and cells of an edge.
CELL, CELLS = 8, 32


class Search:
    """Nearest colours of a palette, by cells of the colour cube.

    A cell keeps the colours that can be nearest to anything in it: those whose least distance to the cell is not above
    the smallest of all greatest distances. Cells are worked out when they are first met, so a search among 256 colours
    looks at a few. Candidates stay in order and a later one must be nearer, so of equals the first is found.
    """

    def __init__(self, rgb: tuple[tuple[int, int, int], ...], metric: str):
        self.metric, self.rgb = metric, np.array(rgb, dtype=np.int64)
        self.table = _oklab_table(self.rgb.astype(float)) if metric == "oklab" else self.rgb
        self.known = np.zeros(CELLS**3, dtype=bool)
        self.count = np.zeros(CELLS**3, dtype=np.int64)
        self.found = np.zeros((CELLS**3, min(8, len(self.rgb))), dtype=np.int16)
        self.one: dict[int, int] = {}

    def _bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For boxes of levels: the least and the greatest distance to each colour, or beyond."""
        if self.metric == "oklab":  # cone responses grow with every level; what is linear in them has bounds by sign
            ends = [np.cbrt(_linear(v.astype(float)) @ np.array(color.LINEAR_TO_LMS).T) for v in (low, high)]
            m = np.array(color.LMS_TO_LAB)
            up, down = np.maximum(m, 0), np.minimum(m, 0)
            low, high = ends[0] @ up.T + ends[1] @ down.T, ends[1] @ up.T + ends[0] @ down.T
        low, high, at = low[:, None, :], high[:, None, :], self.table[None]
        least = np.maximum(np.maximum(low - at, at - high), 0) ** 2
        most = np.maximum(np.abs(low - at), np.abs(high - at)) ** 2
        if self.metric == "redmean":
            s0, s1 = low[..., 0] + at[..., 0], high[..., 0] + at[..., 0]
            weigh = lambda d, s, t: (1024 + s) * d[..., 0] + 2048 * d[..., 1] + (1534 - t) * d[..., 2]
            return weigh(least, s0, s1), weigh(most, s1, s0)
        return least.sum(axis=2), most.sum(axis=2)

    def _learn(self, cells: np.ndarray) -> None:
        cells = cells[~self.known[cells]]
        for part in np.array_split(cells, max(1, len(cells) * len(self.rgb) // 500_000)):
            low = np.stack([part // CELLS**2, part // CELLS % CELLS, part % CELLS], axis=1) * CELL
            least, most = self._bounds(low, low + CELL - 1)
            near = least <= most.min(axis=1, keepdims=True) + (1e-9 if self.metric == "oklab" else 0)
            count = near.sum(axis=1)
            if len(count) and count.max() > self.found.shape[1]:
                self.found = np.pad(self.found, ((0, 0), (0, int(count.max()) - self.found.shape[1])))
            box, of = np.nonzero(near)
            self.found[part[box], np.arange(len(box)) - np.repeat(np.cumsum(count) - count, count)] = of
            self.count[part], self.known[part] = count, True

    def find(self, levels: np.ndarray) -> np.ndarray:
        """The number of the nearest colour for rows of whole levels r, g, b."""
        code, back = np.unique((levels[:, 0] << 16) | (levels[:, 1] << 8) | levels[:, 2], return_inverse=True)
        levels = np.stack([code >> 16, code >> 8 & 255, code & 255], axis=1)
        cell = (levels[:, 0] // CELL * CELLS + levels[:, 1] // CELL) * CELLS + levels[:, 2] // CELL
        self._learn(np.unique(cell))
        at = _oklab_table(levels.astype(float)) if self.metric == "oklab" else levels
        out, least = np.zeros(len(code), dtype=np.int32), np.full(len(code), np.inf)
        rows, k = np.arange(len(code)), 0
        while len(rows := rows[self.count[cell[rows]] > k]):
            of = self.found[cell[rows], k]
            d0, d1, d2 = (at[rows, c] - self.table[of, c] for c in range(3))
            if self.metric == "redmean":
                s = levels[rows, 0] + self.rgb[of, 0]
                d = (1024 + s) * d0 * d0 + 2048 * d1 * d1 + (1534 - s) * d2 * d2
            else:
                d = d0 * d0 + d1 * d1 + d2 * d2
            near = d < least[rows]
            out[rows[near]], least[rows[near]] = of[near], d[near]
            k += 1
        return out[back.reshape(-1)]

    def find_one(self, r: int, g: int, b: int) -> int:
        """find() for one colour, with a bounded memory."""
        code = r << 16 | g << 8 | b
        if (known := self.one.get(code)) is None:
            if len(self.one) >= 1 << 18:
                self.one.clear()
            known = self.one[code] = int(self.find(np.array([[r, g, b]]))[0])
        return known


@lru_cache(8)
def _search(rgb: tuple[tuple[int, int, int], ...], metric: str) -> Search:
    return Search(rgb, metric)


def search(colors: list[str] | str, metric: str) -> Search:
    """The search of a palette, kept by the process, with the cells it knows."""
    return _search(tuple(tables.rgb_list(colors)), metric)


def _matcher(colors: list[str] | str, metric: str, r: int, g: int, b: int, a: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = search(colors, metric)
        for batch in batches:
            alpha = batch.column(a).fill_null(0).to_numpy(zero_copy_only=False)
            shown = alpha > 0
            levels = np.stack([np.clip(batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)[shown], 0, 255).astype(np.int64) for c in (r, g, b)], axis=1)
            idx = np.zeros(len(batch), dtype=np.int32)
            idx[shown] = known.find(levels)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(idx, mask=~shown)], names=[*batch.schema.names, "idx"])

    return run


def _matched(pixels: DataFrame, colors: list[str] | str, metric: str) -> DataFrame:
    at = [pixels.columns.index(c) for c in "rgba"]
    return pixels.mapInArrow(_matcher(colors, metric, *at), StructType([*pixels.schema.fields, StructField("idx", IntegerType())]))


def match(pixels: DataFrame, colors: list[str] | str, metric: str = "srgb", mode: str = "exact") -> DataFrame:
    """pixels with idx, null where transparent.

    mode 'cell' gives all colours of a cell of 2 levels a channel what the first pixel of the cell in its image gets.
    """
    if mode == "cell":
        levels = [_channel(c) for c in "rgb"]
        cell = (F.shiftright(levels[0], 1) * 16384 + F.shiftright(levels[1], 1) * 128 + F.shiftright(levels[2], 1)).alias("_cell")
        shown = pixels.where("a > 0").select("*", cell)
        first = shown.groupBy("image_id", "_cell").agg(F.min_by(F.struct(*[v.alias(c) for v, c in zip(levels, "rgb", strict=True)]), F.struct("y", "x")).alias("f"))
        first = _matched(first.select("image_id", "_cell", "f.*", F.lit(255).alias("a")), colors, metric).select("image_id", "_cell", "idx")
        return pixels.withColumn("_cell", F.when(F.col("a") > 0, cell)).join(first, ["image_id", "_cell"], "left").drop("_cell")
    return _matched(pixels, colors, metric)


def paint(mapped: DataFrame, colors: list[str] | str) -> DataFrame:
    """image_id, y, x, r, g, b, a from mapped(image_id, y, x, idx): each pixel its palette colour."""
    entries = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "rgb", strict=True)]) for c in tables.rgb_list(colors)])
    at = F.get(entries, F.coalesce("idx", F.lit(0)))
    return mapped.select(*POS, *[F.when(F.col("idx").isNull(), 0).otherwise(at[n]).alias(n) for n in "rgb"], F.when(F.col("idx").isNull(), 0).otherwise(255).alias("a"))


def _linear(rgb: np.ndarray) -> np.ndarray:
    c = np.clip(rgb, 0, 255) / 255.0
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


def _oklab_table(rgb: np.ndarray) -> np.ndarray:
    return np.cbrt(_linear(rgb) @ np.array(color.LINEAR_TO_LMS).T) @ np.array(color.LMS_TO_LAB).T


class Diffusion:
    """Floyd-Steinberg error diffusion of one image, a row at a time, every other row backwards.

    It keeps one row of errors in single precision. Transparent pixels give no error on and lose what they got; errors
    end at a row that isn't there.
    """

    def __init__(self, colors: list[str] | str, metric: str, amount: float):
        self.find, self.amount = search(colors, metric).find_one, amount
        self.rgb = [tuple(map(float, c)) for c in tables.rgb_list(colors)]
        self.y, self.carry = None, array("f")

    def row(self, y: int, xs: list[int], levels: list[list[float]], shown: list[bool]) -> list[int]:
        """Palette numbers of a row's pixels, which come in order of x; 0 where not shown."""
        width = 3 * (xs[-1] + 3)
        carry = self.carry if self.y == y - 1 else array("f")
        carry.extend([0.0] * (width - len(carry)))
        below, out = array("f", bytes(4 * len(carry))), [0] * len(xs)
        step = -3 if y % 2 else 3
        for i in range(len(xs))[:: -1 if y % 2 else 1]:
            if not shown[i]:
                continue
            at = 3 * (xs[i] + 1)
            v = [levels[c][i] + carry[at + c] for c in range(3)]
            k = out[i] = self.find(*(0 if u < 0 else 255 if u > 255 else int(u) for u in v))
            for c, u, w in zip(range(at, at + 3), v, self.rgb[k], strict=True):
                e = (u - w) * self.amount
                carry[c + step] += e * 0.4375
                below[c - step] += e * 0.1875
                below[c] += e * 0.3125
                below[c + step] += e * 0.0625
        self.y, self.carry = y, below
        return out


#: Pixels of the grid in which images are diffused together, and of an image that is a stream of rows of its own.
TOGETHER, ALONE = 1 << 20, 1 << 17


def _diffuse_together(image: np.ndarray, y: np.ndarray, x: np.ndarray, levels: np.ndarray, shown: np.ndarray, known: Search, memo: np.ndarray, amount: float) -> np.ndarray:
    """Diffusion of many whole images, a pixel of each at a time, with the same arithmetic.

    image: the number of each pixel's image, from 0 on; levels: one row a channel. memo: colours that are known, -1 else.
    Places that an image doesn't have count as transparent ones.
    """
    n = int(image[-1]) + 1
    first = np.flatnonzero(np.concatenate([[True], image[1:] != image[:-1]]))
    row = y - (np.minimum.reduceat(y, first) // 2 * 2)[image]  # odd rows stay odd
    col = x - np.minimum.reduceat(x, first)[image]
    h, w = int(row.max()) + 1, int(col.max()) + 1
    v, on = np.zeros((h, w, 3, n)), np.zeros((h, w, n), dtype=bool)
    v[row, col, :, image], on[row, col, image] = levels.T, shown
    some = on.any(axis=2)
    rgb, out = known.rgb.T.astype(float), np.zeros((h, w, n), dtype=np.int32)
    below = np.zeros((w + 2, 3, n), dtype=np.float32)
    for r in range(h):
        carry, below = below, np.zeros_like(below)
        d = -1 if r % 2 else 1
        for c in np.flatnonzero(some[r])[::d].tolist():
            u = v[r, c] + carry[c + 1]
            q = np.clip(u, 0, 255).astype(np.int64)
            code = q[0] << 16 | q[1] << 8 | q[2]
            k = memo[code]
            if (new := np.flatnonzero(k < 0)).size:
                k[new] = memo[code[new]] = known.find(q[:, new].T)
            e = (u - rgb[:, k]) * amount * on[r, c]
            out[r, c] = k
            carry[c + 1 + d] += e * 0.4375
            below[c + 1 - d] += e * 0.1875
            below[c + 1] += e * 0.3125
            below[c + 1 + d] += e * 0.0625
    return out[row, col, image]


def _levels_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    levels = np.stack([table[c].fill_null(0).cast(pa.float64()).to_numpy() for c in "rgb"])
    return levels, table["a"].fill_null(0).to_numpy() > 0


def _mapped_rows(table: pa.Table, idx: np.ndarray, shown: np.ndarray, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([table["image_id"], table["y"], table["x"], pa.array(idx, mask=~shown, type=pa.int32())], schema=schema)


class _Stream:
    """Diffusion of one image whose sorted pixels come in parts; what is held is a row."""

    def __init__(self, at: Diffusion, schema: pa.Schema):
        self.at, self.schema, self.held = at, schema, []

    def finish(self) -> list[pa.Table]:
        """The row that is complete, whatever parts it came in."""
        if not self.held:
            return []
        one = pa.concat_tables(self.held).combine_chunks()
        self.held = []
        x = one["x"].to_numpy()
        one = one.filter(pa.array(np.concatenate([[True], x[1:] != x[:-1]])))  # a pixel that is there twice counts once
        levels, shown = _levels_of(one)
        idx = self.at.row(one["y"][0].as_py(), one["x"].to_pylist(), levels.tolist(), shown.tolist())
        return [_mapped_rows(one, np.array(idx), shown, self.schema)]

    def push(self, part: pa.Table) -> list[pa.Table]:
        out, ys = [], part["y"].to_numpy()
        edges = [0, *(np.flatnonzero(ys[1:] != ys[:-1]) + 1).tolist(), len(ys)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if self.held and self.held[0]["y"][0].as_py() != ys[lo]:
                out += self.finish()
            self.held.append(part.slice(lo, hi - lo))
        return out


def _diffuser(colors: list[str] | str, metric: str, amount: float, schema: pa.Schema, emit: int = 1 << 16, together: int = TOGETHER, alone: int = ALONE):
    """Images of up to `alone` places wait until there are `together` pixels of them; a larger one goes row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = search(colors, metric), np.full(1 << 24, -1, dtype=np.int16)
        waiting, size = [], 0  # whole small images
        own, box, stream, image, done = [], [], None, None, []  # the present image, while it is small

        def small() -> Iterator[pa.RecordBatch]:
            """Small images, in grids of at most `together` places, or of one image."""
            part = pa.concat_tables(waiting).combine_chunks()
            place = np.stack([part[c].to_numpy() for c in ("image_id", "y", "x")])
            fresh = np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(axis=0)])  # a pixel that is there twice counts once
            part, (ids, y, x) = part.filter(pa.array(fresh)), place[:, fresh]
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ends = np.append(starts[1:], len(ids))
            high, wide = ((np.maximum.reduceat(v, starts) - np.minimum.reduceat(v, starts) + 2).tolist() for v in (y, x))
            lo = 0
            while lo < len(starts):
                hi, h, w = lo + 1, high[lo], wide[lo]
                while hi < len(starts) and max(h, high[hi]) * max(w, wide[hi]) * (hi + 1 - lo) <= together:
                    hi, h, w = hi + 1, max(h, high[hi]), max(w, wide[hi])
                at = slice(int(starts[lo]), int(ends[hi - 1]))
                one = part.slice(at.start, at.stop - at.start)
                levels, shown = _levels_of(one)
                number = np.repeat(np.arange(hi - lo), ends[lo:hi] - starts[lo:hi])
                idx = _diffuse_together(number, y[at], x[at], levels, shown, known, memo, amount)
                yield from _mapped_rows(one, idx, shown, schema).to_batches()
                lo = hi

        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids, y, x = (table[c].to_numpy() for c in ("image_id", "y", "x"))
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if image != ids[lo]:
                    done += stream.finish() if stream else []
                    waiting += own
                    size += sum(map(len, own))
                    own, box, stream, image = [], [], None, ids[lo]
                    if size >= together:
                        yield from small()
                        waiting, size = [], 0
                part = table.slice(lo, hi - lo)
                if stream is None:
                    own.append(part)
                    ends = [int(v) for c in (y[lo:hi], x[lo:hi]) for v in (c.min(), c.max())]
                    box = [f(a, b) for f, a, b in zip((min, max, min, max), box or ends, ends, strict=True)]
                    if (box[1] - box[0] + 2) * (box[3] - box[2] + 2) <= alone and sum(map(len, own)) <= alone:
                        continue
                    stream, parts, own = _Stream(Diffusion(colors, metric, amount), schema), own, []
                else:
                    parts = [part]
                for part in parts:
                    done += stream.push(part)
                if sum(map(len, done)) >= emit:
                    yield from pa.concat_tables(done).to_batches()
                    done = []
        done += stream.finish() if stream else []
        if done:
            yield from pa.concat_tables(done).to_batches()
        waiting += own
        if waiting:
            yield from small()

    return run


def diffused(pixels: DataFrame, colors: list[str] | str, metric: str = "srgb", amount: float = 1.0) -> DataFrame:
    """image_id, y, x, idx with error diffusion.

    It is sequential within an image: an image's pixels are sorted into one task. Small images are worked out beside each
    other, a pixel of each at a time; larger ones are streamed, and a row is held.
    """
    schema = pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("idx", pa.int32())])
    rows = pixels.select(F.col("image_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), *"rgba")
    rows = rows.repartition("image_id").sortWithinPartitions(*POS)
    return rows.mapInArrow(_diffuser(colors, metric, amount, schema), "image_id long, y int, x int, idx int")


def window_median(v: np.ndarray, shown: np.ndarray, radius: int, rows: range) -> np.ndarray:
    """The upper median of shown values over square windows, for some rows; 0 where none is shown.

    Columns keep histograms of the rows in reach, which gain one value and lose one as the window moves down; a window's
    histogram is a difference of their sums from the left. The work doesn't grow with the radius.
    """
    h, w = v.shape
    low = int(v[shown].min()) if shown.any() else 0
    bins = int(v[shown].max()) - low + 1 if shown.any() else 1
    columns, at = np.zeros((w, bins), dtype=np.int32), np.arange(w)
    left, right = np.maximum(at - radius, 0), np.minimum(at + radius + 1, w)
    out = np.zeros((len(rows), w), dtype=v.dtype)
    sums = np.zeros((w + 1, bins), dtype=np.int32)
    last = rows.start - radius  # rows before this are in the histograms
    last = max(last, 0)
    for k, y in enumerate(rows):
        while last < min(y + radius + 1, h):
            columns[at[shown[last]], v[last, shown[last]] - low] += 1
            last += 1
        gone = y - radius - 1
        if gone >= max(rows.start - radius, 0):
            columns[at[shown[gone]], v[gone, shown[gone]] - low] -= 1
        np.cumsum(columns, axis=0, out=sums[1:])
        upto = np.cumsum(sums[right] - sums[left], axis=1)
        out[k] = np.argmax(upto > (upto[:, -1:] // 2), axis=1) + low
        out[k, upto[:, -1] == 0] = 0
    return out


_PIXELS = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("y", "x", "r", "g", "b", "a"))])


def denoise(pixels: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """The upper median of each channel over the opaque pixels of a square window; alpha stays."""
    if not radius:
        return pixels

    def run(t: Tile) -> pa.Table:
        alpha = t.grid("a", 0)
        shown = t.here & (alpha > 0)
        own = np.flatnonzero(t.own.any(axis=1))
        grids = {"a": alpha}
        for c in "rgb":
            v = t.grid(c, 0)
            if len(own):
                v[own[0] : own[-1] + 1] = window_median(v.copy(), shown, radius, range(int(own[0]), int(own[-1]) + 1))
            grids[c] = np.where(shown, v, 0)
        return t.rows(_PIXELS, **grids)

    rows = pixels.select("image_id", *[F.col(c).cast("int") for c in ("y", "x", "r", "g", "b", "a")])
    return map_tiles(rows, ["r", "g", "b", "a"], run, "image_id long, y int, x int, r int, g int, b int, a int", tile, radius)


def work_size(width: Column, height: Column, pixel: int, longest: int | None = None) -> Column:
    """struct(w, h) for a pixel size of the original, capped at a longest edge for previews."""
    w, h = (F.greatest(F.lit(1), color.half_up(v / pixel)) for v in (width, height))
    if longest:
        k = F.when(F.greatest(w, h) > longest, longest / F.greatest(w, h)).otherwise(1.0)
        w, h = (F.greatest(F.lit(1), color.half_up(v * k)) for v in (w, h))
    return F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))


def _overlaps(at: str, size: Column, to: Column) -> Column:
    """The places of the new size that a pixel's edge overlaps, and by how much, in parts of 1 / (size * to)."""
    low, high = F.col(at) * to, (F.col(at) + 1) * to
    span = F.sequence(F.floor(low / size).cast("int"), F.floor((high - 1) / size).cast("int"))
    return F.transform(span, lambda o: F.struct(o.alias("o"), (F.least(high, (o + 1) * size) - F.greatest(low, o * size)).cast("long").alias("w")))


def downscale(pixels: DataFrame, images: DataFrame, pixel: int, smooth: bool = True, longest: int | None = None) -> DataFrame:
    """Pixels at the work size. smooth: means weighted by alpha and by the share of each pixel in a block; else its middle.

    Edges of blocks cut pixels where the sizes don't divide: such a pixel gives to every block it overlaps, by area, in
    whole numbers, so that blocks sum up to the image.
    """
    size = images.select("image_id", "width", "height", work_size(F.col("width"), F.col("height"), pixel, longest).alias("to"))
    placed = pixels.join(size, "image_id")
    if not smooth:
        placed = placed.withColumns({"oy": F.floor((F.col("y") + 0.5) * F.col("to.h") / F.col("height")).cast("int"), "ox": F.floor((F.col("x") + 0.5) * F.col("to.w") / F.col("width")).cast("int")})
        cy, cx = F.floor((F.col("oy") + 0.5) * F.col("height") / F.col("to.h")), F.floor((F.col("ox") + 0.5) * F.col("width") / F.col("to.w"))
        return placed.where((F.col("y") == cy) & (F.col("x") == cx)).select("image_id", F.col("oy").alias("y"), F.col("ox").alias("x"), "r", "g", "b", "a")
    placed = placed.withColumn("_y", F.explode(_overlaps("y", F.col("height"), F.col("to.h")))).withColumn("_x", F.explode(_overlaps("x", F.col("width"), F.col("to.w"))))
    share = F.col("_y.w") * F.col("_x.w")
    total = F.sum(share * F.col("a"))
    means = [F.coalesce(color.half_up(F.sum(F.col(c) * share * F.col("a")) / F.nullif(total, F.lit(0))), F.lit(0)).cast("int").alias(c) for c in "rgb"]
    return placed.groupBy("image_id", F.col("_y.o").alias("y"), F.col("_x.o").alias("x")).agg(*means, color.half_up(total / F.sum(share)).cast("int").alias("a"))


def upscale(pixels: DataFrame, factor: int) -> DataFrame:
    """Every pixel as factor * factor pixels."""
    if factor <= 1:
        return pixels
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = pixels.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return out.withColumns({"y": (F.col("y") * factor + F.col("_i")).cast("int"), "x": (F.col("x") * factor + F.col("_j")).cast("int")}).drop("_i", "_j")


def sample(pixels: DataFrame, images: DataFrame, most: int = SAMPLES) -> DataFrame:
    """image_id, ord, r, g, b: every n-th pixel in row order, opaque ones alone, about `most` to twice that an image."""
    stride = F.greatest(F.lit(1), F.floor(F.col("width") * F.col("height") / most))
    pos = (F.col("y") * F.col("width") + F.col("x")).cast("long")
    return pixels.join(images.select("image_id", "width", "height"), "image_id").withColumn("ord", pos).where((pos % stride == 0) & (F.col("a") >= ALPHA_CUT)).select("image_id", "ord", "r", "g", "b")


def pick(pixels: DataFrame, image_id: int, y: int, x: int) -> DataFrame:
    """The colour of one pixel; no row if it is transparent or outside. palettes.pick_into puts it in a palette."""
    return pixels.where((F.col("image_id") == image_id) & (F.col("y") == y) & (F.col("x") == x) & (F.col("a") > 0)).select(color.to_hex(*[F.col(c) for c in "rgb"]).alias("hex"))
