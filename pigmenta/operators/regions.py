"""Operators on mapped(image_id, y, x, idx): stipple, merging of colours, regions, absorption, outlines.

idx is null where a pixel is transparent. Regions are numbered per image in the order of their first pixel. Whatever
looks at neighbours works in tiles with a margin; what tiles don't see is settled by joins on what they leave over:
regions by the links across the seams of tiles, absorption by the contacts of small regions with each other.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, tables
from ..staging import staged
from . import links
from .raster import POS, _oklab_table
from .tiles import TILE, Tile, beside, map_tiles

MOST_DISTANCE = 0.4


def distances(colors: list[str] | str) -> np.ndarray:
    """OKLab distances between the colours of a palette, single precision as stored keys are."""
    lab = _oklab_table(np.array(tables.rgb_list(colors), dtype=float)).astype(np.float32).astype(float)
    return np.sqrt(((lab[:, None] - lab[None]) ** 2).sum(axis=2))


_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
_SIDES = [(0, -1), (0, 1), (-1, 0), (1, 0)]
_MAPPED = pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("idx", pa.int32())])


def smooth_stipple(mapped: DataFrame, colors: list[str] | str, tolerance: float, tile: int = TILE) -> DataFrame:
    """image_id, y, x, idx: where five or more of the eight neighbours agree on another, near colour, the pixel takes it.

    One pass: all pixels look at what was there before.
    """
    near = distances(colors) <= tolerance

    def run(t: Tile) -> pa.Table:
        idx = t.grid("idx")
        around = np.sort(np.stack([beside(idx, *d, -1) for d in _AROUND]), axis=0)
        best = around[3]  # five of eight that agree hold the middle
        better = ((around == best).sum(axis=0) >= 5) & (best >= 0) & (idx >= 0)
        better &= near[np.maximum(idx, 0), np.maximum(best, 0)]
        idx = np.where(better, best, idx)
        return t.rows(_MAPPED, idx=np.ma.masked_less(idx, 0))

    return map_tiles(mapped, ["idx"], run, "image_id long, y int, x int, idx int", tile, 1)


def merge_map(colors: list[str] | str, threshold: float) -> list[int]:
    """For each colour of a palette, the first colour it is linked to by steps of at most threshold."""
    near = distances(colors) <= threshold
    root = list(range(len(near)))
    for i in range(len(near)):  # numbers only fall, and a component's first colour reaches all of it
        if root[i] == i:
            todo = [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if root[j] == j and j > i:
                        root[j] = i
                        todo.append(j)
    return root


def merge_colors(mapped: DataFrame, colors: list[str] | str, threshold: float) -> DataFrame:
    """Palette colours within threshold of each other, in steps, become the first of them."""
    to = merge_map(colors, threshold)
    if to == list(range(len(to))):
        return mapped
    return mapped.withColumn("idx", F.when(F.col("idx").isNotNull(), F.get(F.array(*[F.lit(v) for v in to]), F.coalesce("idx", F.lit(0)))))


def _place(y: Column, x: Column) -> Column:
    return F.shiftleft(y.cast("long"), 32) + x


_LABELLED = pa.schema([*_MAPPED, ("part", pa.int64())])


def _parts(t: Tile) -> pa.Table:
    """Own pixels with part, the place of the first pixel that they hang together with inside the tile."""
    idx = t.grid("idx")
    shown = idx >= 0
    starts = shown & (beside(idx, 0, -1, -1) != idx)
    run = np.cumsum(starts).reshape(t.shape) - 1
    down = shown[1:] & (idx[1:] == idx[:-1])
    top = links.connected(int(starts.sum()), run[1:][down], run[:-1][down])
    y, x = np.nonzero(starts)
    first = (y + t.top << 32) + x + t.left
    part = np.where(shown, first[top][run] if len(first) else 0, -1)
    return t.rows(_LABELLED, idx=np.ma.masked_less(idx, 0), part=np.ma.masked_less(part, 0))


def label_regions(mapped: DataFrame, tile: int = TILE, one_task: int = links.ONE_TASK) -> DataFrame:
    """image_id, y, x, idx, label: 4-connected regions in the order of their first pixels; null where transparent.

    Tiles find what hangs together in them; pairs of pixels on both sides of a seam link these parts; the links, a
    thousandth of the pixels, are contracted. Regions are numbered from counts a line: lines are summed up within an
    image, and within a line its regions are numbered.
    """
    rows = staged(map_tiles(mapped, ["idx"], _parts, "image_id long, y int, x int, idx int, part long", tile))
    shown = rows.where("part is not null")
    parts = shown.where(F.col("part") == _place(F.col("y"), F.col("x"))).select("image_id", "part")
    if rows.where((F.col("y") >= tile) | (F.col("x") >= tile)).isEmpty():  # a look at the statistics of the files
        top = None
    else:
        seams = []
        for c, other in (("x", "y"), ("y", "x")):
            before = shown.where(F.col(c) % tile == tile - 1).select("image_id", other, (F.col(c) + 1).alias(c), "idx", F.col("part").alias("b"))
            after = shown.where((F.col(c) % tile == 0) & (F.col(c) > 0)).select("image_id", "y", "x", "idx", F.col("part").alias("a"))
            seams.append(after.join(before, [*POS, "idx"]).select("image_id", "a", "b"))
        top = links.tops(seams[0].unionByName(seams[1]), one_task).withColumnRenamed("node", "part")
    parts = parts.withColumn("top", F.col("part")) if top is None else parts.join(top, ["image_id", "part"], "left")
    parts = parts.withColumn("top", F.coalesce("top", "part"))
    heads = parts.where("part = top").select("image_id", "top", F.shiftright("top", 32).alias("line"))
    lines = heads.groupBy("image_id", "line").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("image_id", "line", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    in_line = F.row_number().over(Window.partitionBy("image_id", "line").orderBy("top"))
    heads = heads.withColumn("k", in_line).join(lines, ["image_id", "line"]).select("image_id", "top", (F.col("before") + F.col("k") - 1).cast("int").alias("label"))
    named = parts.join(heads, ["image_id", "top"]).select("image_id", "part", "label")
    return rows.join(named, ["image_id", "part"], "left").select(*POS, "idx", "label")


def region_table(labels: DataFrame) -> DataFrame:
    """image_id, label, idx and area of each region."""
    return labels.where("label is not null").groupBy("image_id", "label").agg(F.first("idx").alias("idx"), F.count("*").alias("area"))


SALTS = 16
#: Small regions that one task takes in their order, and of a cluster of them that is taken in one go.
CLUSTER = 20_000


def _of_regions(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows with the columns of of(image_id, label, ...), null where it has none; the rows of a large region are dealt."""
    salted = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("y", "x"), F.lit(SALTS)).cast("int")).join(salted, ["image_id", "label", "_salt"], "left").drop("_salt")


_CONTACTS = pa.schema([("image_id", pa.int64()), ("label", pa.int32()), ("near", pa.int32()), ("n", pa.int64()), ("last", pa.int64())])


def _contacts(t: Tile) -> pa.Table:
    """Of regions that meet: on how many sides of own pixels, and the place of the last one, by rows and then sides."""
    label = t.grid("label")
    y, x = np.nonzero(t.own & (label >= 0))
    mine, place = label[y, x], ((y + t.top << 32) + x + t.left) * 4
    pairs, places = [], []
    for k, d in enumerate(_SIDES):
        other = beside(label, *d, -1)[y, x]
        met = (other >= 0) & (other != mine)
        pairs.append((mine[met] << 32) | other[met])
        places.append(place[met] + k)
    pair, of, n = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    last = np.zeros(len(pair), dtype=np.int64)
    np.maximum.at(last, of, np.concatenate(places))
    held = {"image_id": np.full(len(pair), t.image_id), "label": pair >> 32, "near": pair & 0xFFFFFFFF, "n": n, "last": last}
    return pa.Table.from_arrays([pa.array(held[f.name]).cast(f.type) for f in _CONTACTS], schema=_CONTACTS)


def _taken_in_order(regions: list[dict], dist: np.ndarray, tolerance: float) -> dict[int, tuple[int, int]]:
    """label to the region it becomes part of and its colour, for small regions of an image that only meet each other.

    They are taken by area, then label. Areas grow as regions are joined, and one that has grown beyond most stays; the
    longest border counts, of equal ones the one that is complete first.
    """
    area, color_of, joined = {}, {}, {}
    for r in regions:
        area[r["label"]], color_of[r["label"]] = r["area"], r["idx"]
        color_of.update((m["near"], m["near_idx"]) for m in r["met"])

    def now(label: int) -> int:
        while label in joined:
            label = joined[label]
        return label

    for r in sorted(regions, key=lambda r: (r["area"], r["label"])):
        own = r["label"]
        if area[own] > r["most"]:
            continue
        borders: dict[int, tuple[int, int]] = {}
        for m in r["met"]:
            if (to := now(m["near"])) != own:
                n, last = borders.get(to, (0, 0))
                borders[to] = n - m["n"], max(last, m["last"])
        if borders:
            best = min(borders, key=borders.__getitem__)
            if dist[color_of[own], color_of[best]] <= tolerance:
                joined[own] = best
                area[best] = area.get(best, 0) + area[own]
    return {label: (now(label), color_of[now(label)]) for label in joined}


_CHANGES = pa.schema([("image_id", pa.int64()), ("label", pa.int32()), ("to", pa.int32()), ("color", pa.int32())])
_TO = "image_id long, label int, to int, color int"
_REGION = ["image_id", "label"]


def _joined(met: DataFrame, near: Column) -> DataFrame:
    """image_id, label, to, color of regions whose longest border is with a near colour.

    met(image_id, label, idx, to, to_idx, n, last): borders of regions whose turn it is, with what they are part of now.
    """
    borders = met.where("to <> label").groupBy(*_REGION, "idx", "to", "to_idx").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    best = borders.groupBy(*_REGION, "idx").agg(F.max_by(F.struct("to", "to_idx"), F.struct("n", -F.col("last"))).alias("b"))
    return best.where(near).select(*_REGION, F.col("b.to").alias("to"), F.col("b.to_idx").alias("color"))


def _in_rounds(met: DataFrame, near: Column) -> DataFrame:
    """What _taken_in_order gives, for clusters of any size: each round settles all regions whose turn can be known.

    A turn is an area and a label. What a neighbour is part of at that turn is known once the neighbour, and what it has
    joined, have had theirs or come later. A region's own area is known once no earlier one that waits meets it; one that
    has grown beyond most stays without waiting. An earlier turn never depends on a later one, so each round has some.
    """
    turn = F.shiftleft(F.col("area").cast("long"), 32) + F.col("label")
    small = staged(met.select(*_REGION, turn.alias("turn"), "area").distinct())
    turns = small.select("image_id", F.col("label").alias("to"), F.col("turn").alias("to_turn"))
    waiting = met.select(*_REGION, "idx", "most", turn.alias("turn"), F.col("near").alias("to"), F.col("near_idx").alias("to_idx"), "n", "last")
    waiting = staged(waiting.join(turns, ["image_id", "to"], "left"))  # to_turn: null where the neighbour stays for good
    sizes, had = small.select(*_REGION, F.col("area").alias("now")), None
    while not waiting.isEmpty():
        rows = waiting.join(sizes, _REGION)
        large = rows.where("now > most").select(*_REGION).distinct()
        uncertain = waiting.where("to_turn < turn").select(*_REGION)
        awaited = waiting.where("turn < to_turn").select("image_id", F.col("to").alias("label"))
        free = rows.where("now <= most").join(uncertain.unionByName(awaited).distinct(), _REGION, "left_anti")
        joins = _joined(free, near)
        turned = large.unionByName(free.select(*_REGION).distinct())
        done = staged(turned.join(joins, _REGION, "left"))
        had = done if had is None else had.unionByName(done)
        grown = done.where("to is not null").join(sizes, _REGION).groupBy("image_id", F.col("to").alias("label")).agg(F.sum("now").alias("_more"))
        sizes = staged(sizes.join(grown, _REGION, "left").select(*_REGION, (F.col("now") + F.coalesce("_more", F.lit(0))).alias("now")))
        waiting = waiting.join(done.select(*_REGION), _REGION, "left_anti")
        past = had.select("image_id", F.col("label").alias("to"), F.col("to").alias("_to"), F.col("color").alias("_idx"), F.lit(True).alias("_had"))
        for _ in range(2):  # what a neighbour has joined may have stayed for good before
            waiting = waiting.join(past, ["image_id", "to"], "left").withColumn("_passed", F.coalesce(F.col("_had") & (F.col("to_turn") < F.col("turn")), F.lit(False)))
            moved = F.col("_passed") & F.col("_to").isNotNull()
            waiting = waiting.withColumns({"to_idx": F.when(moved, F.col("_idx")).otherwise(F.col("to_idx")), "_new": F.when(moved, F.col("_to")).otherwise(F.col("to"))})
            after = turns.withColumnsRenamed({"to": "_new", "to_turn": "_new_turn"})
            waiting = waiting.join(after, ["image_id", "_new"], "left").withColumn("to_turn", F.when(moved, F.col("_new_turn")).when(~F.col("_passed"), F.col("to_turn")))
            waiting = waiting.drop("to").withColumnRenamed("_new", "to").drop("_to", "_idx", "_had", "_passed", "_new_turn")
        waiting = staged(waiting)
    joins = staged(had.where("to is not null")) if had is not None else None
    while joins is not None:  # what was joined may have joined another later
        on = joins.select("image_id", F.col("label").alias("to"), F.col("to").alias("_to"), F.col("color").alias("_idx"))
        further = staged(joins.join(on, ["image_id", "to"], "left"))
        if further.where("_to is not null").isEmpty():
            break
        joins = further.select(*_REGION, F.coalesce("_to", "to").alias("to"), F.coalesce("_idx", "color").alias("color"))
    return joins


def absorb_small(labels: DataFrame, colors: list[str] | str, most: int | Column, tolerance: float, tile: int = TILE, cluster: int = CLUSTER, one_task: int = links.ONE_TASK) -> DataFrame:
    """image_id, y, x, idx, label: small regions join the neighbour of the longest common border if its colour is near.

    most: the largest area that is absorbed; a column if images differ in it. Small regions are taken by area, then
    label, and see what earlier ones have become. Only small regions that meet each other, directly or through others,
    can tell: those without a small neighbour are settled at once, clusters of up to `cluster` regions are followed in
    tasks, larger ones in rounds. Contacts are counted in tiles.
    """
    dist = distances(colors)
    rows = labels.select(*POS, "idx", "label", (most if isinstance(most, Column) else F.lit(most)).cast("long").alias("most"))
    areas = rows.where("label is not null").groupBy(*_REGION).agg(F.first("idx").alias("idx"), F.first("most").alias("most"), F.count("*").alias("area"))
    areas = staged(areas)
    small = areas.where("area <= most")
    if small.isEmpty():
        return rows.select(*POS, "idx", "label")
    contacts = map_tiles(rows, ["label"], _contacts, "image_id long, label int, near int, n long, last long", tile, 1)
    contacts = contacts.groupBy(*_REGION, "near").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    theirs = areas.select("image_id", F.col("label").alias("near"), F.col("idx").alias("near_idx"), (F.col("area") <= F.col("most")).alias("near_small"))
    met = staged(contacts.join(small, _REGION).join(theirs, ["image_id", "near"]))
    top = links.tops(met.where("near_small and label < near").select("image_id", F.col("label").alias("a"), F.col("near").alias("b")), one_task)
    top = staged(top.select("image_id", F.col("node").cast("int").alias("label"), "top"))
    sizes = top.groupBy("image_id", "top").agg(F.count("*").alias("members"))
    near = F.get(F.get(F.from_json(F.lit(json.dumps((dist <= tolerance).tolist())), "array<array<boolean>>"), F.col("idx")), F.col("b.to_idx"))
    alone = _joined(met.join(top, _REGION, "left_anti").withColumnsRenamed({"near": "to", "near_idx": "to_idx"}), near)

    def follow(table: pa.Table) -> pa.Table:
        found = _taken_in_order(table.to_pylist(), dist, tolerance)
        held = [[table["image_id"][0].as_py()] * len(found), list(found), [to for to, _ in found.values()], [c for _, c in found.values()]]
        return pa.Table.from_arrays([pa.array(v).cast(f.type) if len(found) else pa.array([], f.type) for v, f in zip(held, _CHANGES, strict=True)], schema=_CHANGES)

    bins = sizes.where(F.col("members") <= cluster)
    totals = bins.groupBy("image_id").agg(F.ceil(F.sum("members") / cluster).cast("long").alias("bins"))
    bins = bins.join(totals, "image_id").select("image_id", "top", F.pmod(F.xxhash64("top"), F.col("bins")).alias("bin"))
    bounded = met.join(top.join(bins, ["image_id", "top"]), _REGION).groupBy("image_id", "bin", "label", "idx", "area", "most").agg(F.collect_list(F.struct("near", "near_idx", "n", "last")).alias("met"))
    changes = alone.unionByName(bounded.groupBy("image_id", "bin").applyInArrow(follow, _TO))
    large = top.join(sizes.where(F.col("members") > cluster), ["image_id", "top"])
    if not large.isEmpty() and (more := _in_rounds(met.join(large.select(*_REGION), _REGION, "left_semi"), near)) is not None:
        changes = changes.unionByName(more)
    out = _of_regions(rows, changes)
    return out.select(*POS, F.coalesce("color", "idx").alias("idx"), F.coalesce("to", "label").alias("label"))


_EDGED = pa.schema([*_MAPPED, ("label", pa.int32()), ("edge", pa.bool_())])


def outlines(labels: DataFrame, width: int = 1, least_area: int | Column = 0, tile: int = TILE) -> DataFrame:
    """image_id, y, x, idx, label, edge: each border between regions marks its upper or left pixel, or the opaque one.

    A border counts if both regions have least_area or are transparent; marks then grow width - 1 times over opaque
    pixels.
    """
    rows = labels.select(*POS, "idx", "label", (least_area if isinstance(least_area, Column) else F.lit(least_area)).alias("_least"))
    if isinstance(least_area, Column) or least_area:
        rows = _of_regions(rows, region_table(labels).select(*_REGION, "area")).withColumn("big", F.coalesce(F.col("area") >= F.col("_least"), F.lit(True)))
    else:
        rows = rows.withColumn("big", F.lit(True))

    def run(t: Tile) -> pa.Table:
        label, big = t.grid("label"), t.grid("big", 0, bool)
        edge = np.zeros(t.shape, dtype=bool)
        for d in _SIDES:
            other, counts = beside(label, *d, -1), beside(big, *d, False) & big & (label >= 0)
            border = counts & (other != label)
            # of two opaque pixels the upper or left one is marked
            edge |= border if d in ((0, 1), (1, 0)) else border & (other < 0)
        for _ in range(1, width):
            near = np.any([beside(edge, *d, False) for d in _SIDES], axis=0)
            edge = edge | (near & (label >= 0))
        return t.rows(_EDGED, idx=np.ma.masked_less(t.grid("idx"), 0), label=np.ma.masked_less(label, 0), edge=edge)

    return map_tiles(rows, ["idx", "label", "big"], run, "image_id long, y int, x int, idx int, label int, edge boolean", tile, width)


def paint_edges(painted: DataFrame, edges: DataFrame, hex_color: str) -> DataFrame:
    """painted pixels with the edge pixels in one colour."""
    rgb = color.from_hex(F.lit(hex_color))
    both = painted.join(edges.where("edge").select(*POS, F.lit(True).alias("_e")), POS, "left")
    new = {c: F.when(F.col("_e"), F.coalesce(rgb[c], F.lit(0))).otherwise(F.col(c)) for c in "rgb"}
    return both.withColumns(new | {"a": F.when(F.col("_e"), 255).otherwise(F.col("a"))}).drop("_e")
