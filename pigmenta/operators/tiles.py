"""Images in tiles, so that no task holds an image: pixels are dealt to squares, with a margin of the pixels around.

What is worked out in a tile needs nothing beyond its margin. A pixel that a table has twice counts once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of an edge: a task works on some 65,000 pixels at a time.
TILE = 256


class Tile:
    """The part of an image that a tile sees: grids by name, `here` where there is a pixel, `own` where it is the tile's."""

    def __init__(self, key: tuple, table: pa.Table, tile: int):
        self.image_id, row, column = (k.as_py() for k in key)
        y, x = (table[c].to_numpy().astype(np.int64) for c in ("y", "x"))
        self.top, self.left = int(y.min()), int(x.min())
        self.at = y - self.top, x - self.left
        self.shape = int(y.max()) - self.top + 1, int(x.max()) - self.left + 1
        self.table, self.here = table, np.zeros(self.shape, dtype=bool)
        self.here[self.at] = True
        rows, columns = np.arange(self.shape[0]) + self.top, np.arange(self.shape[1]) + self.left
        self.own = self.here & (rows // tile == row)[:, None] & (columns // tile == column)

    def grid(self, name: str, fill: float = -1, kind: type = np.int64) -> np.ndarray:
        """A column by place; fill where it is null or there is no pixel."""
        out = np.full(self.shape, fill, dtype=kind)
        column = self.table[name]
        out[self.at] = column.fill_null(fill).to_numpy() if column.null_count else column.to_numpy()
        return out

    def rows(self, schema: pa.Schema, where: np.ndarray | None = None, **grids: np.ndarray | np.ma.MaskedArray) -> pa.Table:
        """Own pixels as rows: image_id, y, x and grids; masked entries are null."""
        y, x = np.nonzero(self.own if where is None else self.own & where)
        held = {"image_id": np.full(len(y), self.image_id), "y": y + self.top, "x": x + self.left}
        arrays = []
        for f in schema:
            v = held[f.name] if f.name in held else grids[f.name][y, x]
            arrays.append(pa.array(np.ma.getdata(v), mask=np.ma.getmaskarray(v)).cast(f.type) if isinstance(v, np.ma.MaskedArray) else pa.array(v).cast(f.type))
        return pa.Table.from_arrays(arrays, schema=schema)


def beside(grid: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    """For each place what stands dy rows down and dx columns right of it."""
    out = np.full_like(grid, fill)
    h, w = grid.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = grid[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


def _touched(c: str, tile: int, margin: int) -> Column:
    """Numbers of the tiles whose margin reaches a row or column."""
    return F.sequence(F.greatest(F.floor((F.col(c) - margin) / tile), F.lit(0)).cast("int"), F.floor((F.col(c) + margin) / tile).cast("int"))


def map_tiles(pixels: DataFrame, columns: list[str], run: Callable[[Tile], pa.Table], schema: str, tile: int = TILE, margin: int = 0) -> DataFrame:
    """run over each tile of pixels(image_id, y, x, *columns), with a margin; its tables are put together."""
    rows = pixels.select("image_id", "y", "x", *columns)
    if margin:
        rows = rows.withColumn("_ty", F.explode(_touched("y", tile, margin))).withColumn("_tx", F.explode(_touched("x", tile, margin)))
    else:
        rows = rows.withColumns({"_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int")})

    return rows.groupBy("image_id", "_ty", "_tx").applyInArrow(lambda key, table: run(Tile(key, table, tile)), schema)
