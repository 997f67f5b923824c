"""What is worked out in tiles equals what one pass over the whole image gives, for tiles of any size."""

import random

import numpy as np
import pytest
from test_plain import absorbed, flood

from pigmenta.functions import tables
from pigmenta.operators import links, regions

COLORS = tables.PALETTES["Game Boy (DMG)"] + ["#ff0000"]


def mapped(spark, images):
    return spark.createDataFrame([(k, y, x, v) for k, image in enumerate(images) for y, row in enumerate(image) for x, v in enumerate(row)], "image_id long, y int, x int, idx int")


def noise(seed, height, width, values=(0, 0, 1, 2, None)):
    rng = random.Random(seed)
    return [[rng.choice(values) for _ in range(width)] for _ in range(height)]


def winding(n):
    """One colour that winds through an n * n image, walls of another between its lanes."""
    return [[1 if y % 2 == 0 or x == (n - 1 if y % 4 == 1 else 0) else 0 for x in range(n)] for y in range(n)]


IMAGES = [noise(1, 9, 13), noise(2, 17, 5, (0, 1)), winding(15), [[None] * 4] * 3, [[2]]]


def labels_of(df):
    return {(r.image_id, r.y, r.x): (r.idx, r.label) for r in df.collect()}


def wanted(images):
    return {(k, y, x): (v, label) for k, image in enumerate(images) for y, (row, marks) in enumerate(zip(image, flood(image), strict=True)) for x, (v, label) in enumerate(zip(row, marks, strict=True))}


@pytest.mark.parametrize(("tile", "one_task"), [(256, 10), (4, 10**6), (4, 0), (1, 0), (7, 0)])
def test_labels_are_the_same_for_tiles_of_any_size(spark, tile, one_task):
    assert labels_of(regions.label_regions(mapped(spark, IMAGES), tile, one_task)) == wanted(IMAGES)


def test_links_in_one_task_and_by_joins(spark):
    rng = random.Random(3)
    pairs = [(i, rng.randrange(60), rng.randrange(60)) for i in range(2) for _ in range(45)] + [(9, k, k + 1) for k in range(40)]
    rows = spark.createDataFrame(pairs, "image_id long, a long, b long")
    got = [{(r.image_id, r.node): r.top for r in links.tops(rows, most).collect()} for most in (10**6, 0)]
    assert got[0] == got[1] and all(got[0][9, k] == 0 for k in range(41))
    assert all(got[0][i, a] == got[0][i, b] for i, a, b in pairs if a != b)


@pytest.mark.parametrize(("tile", "cluster", "most", "tolerance"), [(4, 10**6, 3, 9.0), (5, 2, 4, 9.0), (256, 1, 6, 0.3), (3, 0, 40, 0.25)])
def test_absorption_in_tasks_and_in_rounds(spark, tile, cluster, most, tolerance):
    images = [noise(most, 6, 8, (0, 0, 1, 2, 3, 4, None)), noise(7, 4, 4, (0, 1))]
    got = labels_of(regions.absorb_small(regions.label_regions(mapped(spark, images), tile), COLORS, most, tolerance, tile, cluster))
    dist = regions.distances(COLORS)
    assert got == {(k, y, x): v for k, image in enumerate(images) for y, row in enumerate(absorbed(image, most, tolerance, dist)) for x, v in enumerate(row)}


@pytest.mark.parametrize("tile", [2, 5, 256])
def test_stipple_and_outlines(spark, tile):
    image = noise(5, 12, 14, (0, 0, 0, 1, None))
    near = regions.distances(COLORS) <= 0.3
    got = {(r.y, r.x): r.idx for r in regions.smooth_stipple(mapped(spark, [image]), COLORS, 0.3, tile).collect()}
    for y, row in enumerate(image):
        for x, v in enumerate(row):
            votes = [image[j][i] for j in range(max(y - 1, 0), min(y + 2, 12)) for i in range(max(x - 1, 0), min(x + 2, 14)) if (j, i) != (y, x)]
            best = [c for c in {*votes} - {None, v} if votes.count(c) >= 5]
            assert got[y, x] == (best[0] if v is not None and best and near[v][best[0]] else v)
    labels = np.array([[-1 if v is None else v for v in row] for row in flood(image)])
    area = {v: int((labels == v).sum()) for v in np.unique(labels)} | {-1: 10**9}
    edge = np.zeros(labels.shape, dtype=bool)
    for y, x in np.ndindex(*labels.shape):
        for j, i in ((y, x + 1), (y + 1, x)):
            if j < 12 and i < 14 and labels[y, x] != labels[j, i] and min(area[labels[y, x]], area[labels[j, i]]) >= 2:
                edge[(y, x) if labels[y, x] >= 0 else (j, i)] = True
    for _ in range(2):
        grown = edge.copy()
        for y, x in np.argwhere(edge):
            for j, i in ((y, x + 1), (y + 1, x), (y, x - 1), (y - 1, x)):
                if 0 <= j < 12 and 0 <= i < 14 and labels[j, i] >= 0:
                    grown[j, i] = True
        edge = grown
    rows = regions.outlines(regions.label_regions(mapped(spark, [image]), tile), 3, 2, tile).collect()
    assert {(r.y, r.x) for r in rows if r.edge} == {tuple(p) for p in np.argwhere(edge).tolist()} and len(rows) == 12 * 14
