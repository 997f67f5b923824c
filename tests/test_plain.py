"""Queries without SQL against plain Python on small rasters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pigmenta.functions import color, tables
from pigmenta.operators import extract, palettes, raster, regions
from pigmenta.plans import pipeline

PX = "image_id long, y int, x int, r int, g int, b int, a int"


def frame(spark, images):
    return spark.createDataFrame([(k, y, x, *v) for k, image in enumerate(images) for y, row in enumerate(image) for x, v in enumerate(row)], PX)


def flood(idx):
    """Labels of 4-connected regions, numbered by their first pixels."""
    h, w = len(idx), len(idx[0])
    label = [[None] * w for _ in range(h)]
    n = 0
    for y in range(h):
        for x in range(w):
            if idx[y][x] is None or label[y][x] is not None:
                continue
            label[y][x], todo = n, [(y, x)]
            while todo:
                cy, cx = todo.pop()
                for ny, nx in ((cy - 1, cx), (cy + 1, cx), (cy, cx - 1), (cy, cx + 1)):
                    if 0 <= ny < h and 0 <= nx < w and label[ny][nx] is None and idx[ny][nx] == idx[y][x]:
                        label[ny][nx] = n
                        todo.append((ny, nx))
            n += 1
    return label


def absorbed(idx, most, tolerance, dist):
    """Regions as sets of pixels; each small one looks at its own first pixels only."""
    label = flood(idx)
    h, w = len(idx), len(idx[0])
    own, shade = {}, {}
    for y in range(h):
        for x in range(w):
            if label[y][x] is not None:
                own.setdefault(label[y][x], []).append((y, x))
                shade[label[y][x]] = idx[y][x]
    part_of = {k: {k} for k in own}
    head = {k: k for k in own}
    size = {k: len(v) for k, v in own.items()}
    for k in sorted((k for k in own if size[k] <= most), key=lambda k: (len(own[k]), k)):
        if head[k] != k or size[k] > most:
            continue
        seen, best, longest = {}, None, 0
        for y, x in own[k]:
            for ny, nx in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
                if 0 <= ny < h and 0 <= nx < w and label[ny][nx] is not None and head[label[ny][nx]] != k:
                    to = head[label[ny][nx]]
                    seen[to] = seen.get(to, 0) + 1
                    if seen[to] > longest:
                        best, longest = to, seen[to]
        if best is not None and dist[shade[k]][shade[best]] <= tolerance:
            for j in part_of[k]:
                head[j] = best
            part_of[best] |= part_of[k]
            size[best] += size[k]
    return [[(None, None) if v is None else (shade[head[v]], head[v]) for v in row] for row in label]


@pytest.mark.parametrize(("most", "tolerance"), [(1, 9.0), (3, 9.0), (6, 0.3), (40, 0.25)])
def test_absorption(spark, most, tolerance):
    colors = tables.PALETTES["Game Boy (DMG)"] + ["#ff0000"]
    rng = random.Random(most)
    images = [[[rng.choice([0, 0, 1, 2, 3, 4, None]) for _ in range(12)] for _ in range(9)] for _ in range(4)]
    rows = spark.createDataFrame([(k, y, x, v) for k, image in enumerate(images) for y, row in enumerate(image) for x, v in enumerate(row)], "image_id long, y int, x int, idx int")
    got = {(r.image_id, r.y, r.x): (r.idx, r.label) for r in regions.absorb_small(regions.label_regions(rows), colors, most, tolerance).collect()}
    dist = regions.distances(colors)
    assert got == {(k, y, x): v for k, image in enumerate(images) for y, row in enumerate(absorbed(image, most, tolerance, dist)) for x, v in enumerate(row)}


def lab_of(rgb):
    """OKLab by the published formulas, one colour at a time."""
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    lms = [math.cbrt(sum(m * v for m, v in zip(row, lin, strict=True))) for row in color.LINEAR_TO_LMS]
    return [sum(m * v for m, v in zip(row, lms, strict=True)) for row in color.LMS_TO_LAB]


def level_of(lab):
    lms = [sum(m * v for m, v in zip(row, lab, strict=True)) ** 3 for row in color.LAB_TO_LMS]
    lin = [sum(m * v for m, v in zip(row, lms, strict=True)) for row in color.LMS_TO_LINEAR]
    return [min(255.0, max(0.0, 255 * (c * 12.92 if c <= 0.0031308 else 1.055 * max(c, 0) ** (1 / 2.4) - 0.055))) for c in lin]


def hex_of(levels):
    return "#" + "".join(f"{int(math.floor(v + 0.5)):02x}" for v in levels)


def clustered(rgb, count):
    """Boxes cut at the median of their widest channel, then eight rounds of means in OKLab."""
    boxes = [rgb]
    while len(boxes) < count:
        spans = [[max(p[c] for p in b) - min(p[c] for p in b) for c in range(3)] if len(b) > 1 else [-1] * 3 for b in boxes]
        k = max(range(len(boxes)), key=lambda i: (max(spans[i]), -i))
        if max(spans[k]) <= 0:
            break
        c = spans[k].index(max(spans[k]))
        box = sorted(boxes[k], key=lambda p: p[c])
        boxes[k : k + 1] = [box[: len(box) // 2], box[len(box) // 2 :]]
    single = lambda v: [float(np.float32(x)) for x in v]
    points = [single(lab_of(p)) for p in rgb]
    at = [single(lab_of([sum(p[c] for p in b) / len(b) for c in range(3)])) for b in boxes]
    for _ in range(8):
        groups = [[] for _ in at]
        for p in points:
            groups[min(range(len(at)), key=lambda k: (sum((x - y) ** 2 for x, y in zip(p, at[k], strict=True)), k))].append(p)
        at = [single([sum(p[c] for p in g) / len(g) for c in range(3)]) if g else a for g, a in zip(groups, at, strict=True)]
    return list(dict.fromkeys(hex_of(level_of(a)) for a in sorted(at, key=lambda a: a[0])))


def test_clustered_palettes(spark):
    rng = random.Random(8)
    images = [[[(*(rng.choice([10, 60, 200, 240]) + rng.randint(-8, 8) for _ in range(3)), 255) for _ in range(12)] for _ in range(8)] for _ in range(3)]
    size = spark.createDataFrame([(k, 12, 8) for k in range(3)], "image_id long, width int, height int")
    rows = extract.extract_palette(raster.sample(frame(spark, images), size), 6).collect()
    for k, image in enumerate(images):
        assert [r.hex for r in sorted(rows, key=lambda r: r.idx) if r.palette_id == k] == clustered([list(p[:3]) for row in image for p in row], 6)


def test_ramps_span_the_image_and_keep_their_hues(spark):
    image = [[(200, 40, 40, 255)] * 6 + [(30, 30, 120, 255)] * 2 + [(250, 250, 250, 255)] * 2] * 4
    size = spark.createDataFrame([(0, 10, 4)], "image_id long, width int, height int")
    rows = extract.theory_palette(raster.sample(frame(spark, [image]), size), 18, "complementary", 0.0).orderBy("idx").collect()
    labs = [lab_of([int(r.hex[i : i + 2], 16) for i in (1, 3, 5)]) for r in rows]
    lo, hi = (f(lab_of(p)[0] for p in ((200, 40, 40), (30, 30, 120), (250, 250, 250))) for f in (min, max))
    assert all(lo - 0.02 <= v[0] <= hi + 0.02 for v in labs)
    tinted = [math.degrees(math.atan2(v[2], v[1])) % 360 for v in labs if math.hypot(v[1], v[2]) > 0.05]
    red = math.degrees(math.atan2(*reversed(lab_of((200, 40, 40))[1:]))) % 360
    turn = lambda a, b: abs((a - b + 180) % 360 - 180)
    assert tinted and all(min(turn(h, red), turn(h, red + 180)) < 12 for h in tinted)
    assert any(turn(h, red) < 12 for h in tinted) and any(turn(h, red + 180) < 12 for h in tinted)


def test_rendering_is_its_steps_one_after_the_other(spark):
    """Nearest colours, absorption and outlines by hand; no dither, tone or denoising."""
    colors = tables.PALETTES["Game Boy (DMG)"]
    rgb = tables.rgb_list(colors)
    rng = random.Random(3)
    image = [[(*(rng.choice([(20, 60, 20), (40, 90, 50), (140, 170, 20), (155, 185, 30)])[c] for c in range(3)), rng.choice([255, 255, 255, 0])) for _ in range(10)] for _ in range(7)]
    idx = [[None if p[3] < 8 else min(range(4), key=lambda i: (sum((p[c] - rgb[i][c]) ** 2 for c in range(3)), i)) for p in row] for row in image]
    after = absorbed(idx, 3, 0.5 * regions.MOST_DISTANCE, regions.distances(colors))
    want = {}
    for y, row in enumerate(after):
        for x, (k, label) in enumerate(row):
            want[y, x] = (0, 0, 0, 0) if k is None else (*rgb[k], 255)
            for ny, nx in ((y, x + 1), (y + 1, x), (y, x - 1), (y - 1, x)):
                if label is not None and 0 <= ny < 7 and 0 <= nx < 10:
                    other = after[ny][nx][1]
                    if other != label and ((ny, nx) > (y, x) or other is None):
                        want[y, x] = (255, 0, 0, 255)
    size = spark.createDataFrame([(0, 10, 7)], "image_id long, width int, height int")
    o = pipeline.Options(metric="srgb", speck=3, tolerance=0.5, outline=True, outline_color="#ff0000", export_scale=2)
    got = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in pipeline.render(frame(spark, [image]), size, colors, o).collect()}
    assert got == {(2 * y + i, 2 * x + j): v for (y, x), v in want.items() for i in (0, 1) for j in (0, 1)}


def test_ramps_are_permutations_and_distinct_colours_keep_order(spark):
    rows = spark.createDataFrame([("p", i, h) for i, h in enumerate(tables.PALETTES["CGA 16"] * 2)], "palette_id string, idx int, hex string")
    assert [r.hex for r in palettes.distinct_colors(rows).orderBy("idx").collect()] == tables.PALETTES["CGA 16"]
    assert sorted(r.place for r in palettes.sort_into_ramps(rows).collect()) == list(range(32)) and rows.select(F.countDistinct("hex")).first()[0] == 16


def chroma_hue(lab):
    return math.hypot(lab[1], lab[2]), math.degrees(math.atan2(lab[2], lab[1])) % 360


def hues_of(labs, want):
    """The strongest hues by a smoothed wheel of 72 bins, and the chroma of ramps."""
    wheel, n = [0.0] * 72, 0
    for lab in labs:
        c, h = chroma_hue(lab)
        if c >= color.NEUTRAL_CHROMA:
            wheel[int(h / 360 * 72) % 72] += c
            n += 1
    if not n:
        return [], 0.11
    peak = min(0.22, max(0.06, sum(wheel) / n * 1.9))
    wheel = [wheel[i - 1] / 4 + wheel[i] / 2 + wheel[(i + 1) % 72] / 4 for i in range(72)]
    out = []
    while len(out) < want and max(wheel) > 0:
        top = wheel.index(max(wheel))
        near = [(top + d) % 72 for d in range(-2, 3)]
        x, y = (sum(f(math.radians((k + 0.5) * 5)) * wheel[k] for k in near) for f in (math.cos, math.sin))
        out.append(math.degrees(math.atan2(y, x)) % 360)
        for k in range(72):
            if min((k - top) % 72, (top - k) % 72) <= 4:
                wheel[k] = 0.0
    return out, peak


def step_of(a, b):
    d = math.fmod(b - a, 360)
    return d - 360 if d > 180 else d + 360 if d < -180 else d


def fitted(light, c, h):
    """The colour at this lightness and hue with as much of the chroma as sRGB holds."""
    raw = lambda c: [255 * (v * 12.92 if v <= 0.0031308 else 1.055 * max(v, 0) ** (1 / 2.4) - 0.055) for v in [sum(m * v for m, v in zip(row, [sum(m * v for m, v in zip(r, [light, math.cos(math.radians(h)) * c, math.sin(math.radians(h)) * c], strict=True)) ** 3 for r in color.LAB_TO_LMS], strict=True)) for row in color.LMS_TO_LINEAR]]
    inside = lambda v: all(0.001 < x < 254.999 for x in v)
    if not inside(raw(c)):
        lo, hi = 0.0, c
        for _ in range(16):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if inside(raw(mid)) else (lo, mid)
        c = lo
    return hex_of([min(255.0, max(0.0, v)) for v in raw(c)])


def ramps(rgb, count, scheme, shift):
    labs = [lab_of(p) for p in rgb]
    lo, hi = min(v[0] for v in labs), max(v[0] for v in labs)
    if hi - lo < 0.25:
        lo, hi = max(0, lo - 0.15), min(1, hi + 0.15)
    wanted = min(9, max(2, int(count / 6 + 0.5)))
    angles = tables.HARMONIES[scheme]
    found, peak = hues_of(labs, 1 if angles else max(1, wanted - 1))
    if angles:
        plan = [((found or [0])[0] + angles[i % len(angles)] + i // len(angles) * (0 if scheme == "monochrome" else 12)) % 360 for i in range(max(1, wanted - 1))]
    else:
        plan = found or [0.0]
    plan = [h for i, h in enumerate(plan) if not any(abs(step_of(p, h)) < 5 for p in plan[:i])]
    steps = max(3, count // (len(plan) + 1))
    rest = count - steps * (len(plan) + 1)
    out = []
    for k, hue in enumerate([0.0, *plan]):
        n = steps + (k < rest)
        for i in range(n):
            t = 0.5 if n == 1 else i / (n - 1)
            floor = color.SHADOW_CHROMA + (color.HIGHLIGHT_CHROMA - color.SHADOW_CHROMA) * t
            c = (0 if k == 0 else peak) * (floor + (1 - floor) * max(math.sin(t * math.pi), 0) ** color.SHOULDER)
            drift = (t - 0.5) * 2
            h = hue + step_of(hue, color.SHADOW_HUE if drift < 0 else color.HIGHLIGHT_HUE) * abs(drift) * color.MOST_DRIFT / 180 * (0 if k == 0 else shift)
            out.append(fitted(lo + (hi - lo) * t, c, h))
    return list(dict.fromkeys(out))[:count]


@pytest.mark.parametrize(("scheme", "count", "shift"), [("auto", 30, 1.0), ("triadic", 24, 1.0), ("monochrome", 16, 0.5), ("analogous", 40, 0.0)])
def test_ramps_by_theory(spark, scheme, count, shift):
    rng = random.Random(count)
    images = [[[(*(rng.choice([20, 90, 160, 230]) + rng.randint(-9, 9) for _ in range(3)), 255) for _ in range(9)] for _ in range(6)], [[(90, 90, 90, 255)] * 9] * 6]
    size = spark.createDataFrame([(k, 9, 6) for k in range(2)], "image_id long, width int, height int")
    rows = extract.theory_palette(raster.sample(frame(spark, images), size), count, scheme, shift).collect()
    for k, image in enumerate(images):
        assert [r.hex for r in sorted(rows, key=lambda r: r.idx) if r.palette_id == k] == ramps([p[:3] for row in image for p in row], count, scheme, shift)


def test_colours_are_fitted_by_the_batch(spark):
    rng = np.random.default_rng(8)
    l, c, h = rng.random(400), rng.random(400) * 0.4, rng.random(400) * 360
    rows = spark.createDataFrame([(*map(float, v),) for v in zip(l, c, h, strict=True)], "l double, c double, h double")
    fitted = rows.select("l", "c", "h", color.fit_to_gamut(F.col("l"), F.col("c"), F.col("h")).alias("v"))
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan  # no loop that is interpreted for each row

    def at(l, c, h):  # noqa: E741
        lab = l, math.cos(math.radians(h)) * c, math.sin(math.radians(h)) * c
        cones = [sum(x * y for x, y in zip(m, lab, strict=True)) ** 3 for m in color.LAB_TO_LMS]
        light = [sum(x * y for x, y in zip(m, cones, strict=True)) for m in color.LMS_TO_LINEAR]
        return [min(255, max(0, 255 * (v * 12.92 if v <= 0.0031308 else max(v, 0) ** (1 / 2.4) * 1.055 - 0.055))) for v in light]

    def inside(v):
        return all(0.001 < x < 254.999 for x in v)

    for r in fitted.collect():
        want, lo, hi = at(r.l, r.c, r.h), 0.0, r.c
        if not inside(want):
            for _ in range(16):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if inside(at(r.l, mid, r.h)) else (lo, mid)
            want = at(r.l, lo, r.h)
        assert np.allclose(tuple(r.v), want, atol=1e-9, rtol=0)
    assert [tuple(r.v) for r in spark.createDataFrame([(None, 0.1, 2.0)], "l double, c double, h double").select(color.fit_to_gamut(F.col("l"), F.col("c"), F.col("h")).alias("v")).collect()] == [(0.0, 0.0, 0.0)]


def test_ramps_are_fitted_by_the_batch_and_once_a_colour(spark):
    rows = spark.createDataFrame([(float(h), 0.05 + h / 2000) for h in range(0, 360, 9)], "h double, c double")
    ramp = rows.select(color.ramp_color(F.lit(1), F.lit(4), F.col("h"), F.col("c"), F.lit(0.2), F.lit(0.9), 1.0).alias("hex"))
    plan = ramp._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan and plan.split("ArrowEvalPython [")[1].split("\n")[0].count("_fit(") == 1
    assert ramp.where("hex rlike '^#[0-9a-f]{6}$'").count() == 40


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_near_colours_in_parts(at_once):
    lab, size = np.random.default_rng(9).random((60, 3)), np.array([1, 20, 2, 37])
    a, b = palettes._near_links(lab, size, 0.4, at_once)
    of = np.repeat(np.arange(4), size)
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if of[i] == of[j] and math.dist(lab[i], lab[j]) <= 0.4]
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_merge_maps_follow_links_within_palettes(spark):
    rng = random.Random(4)
    rows = [(f"p{k}", i, f"#{rng.randrange(60, 110):02x}{rng.randrange(60, 110):02x}64") for k in range(30) for i in rng.sample(range(40), k % 9 + 1)]
    rows += [("p8", 3, "#000001"), ("p8", 3, "#ffffff"), ("long", 0, "#000000")] + [("long", i, f"#{i % 256:02x}{i // 256 * 90:02x}00") for i in range(1, 600)] + [(None, 0, "#101010"), (None, 1, "#111111"), ("none", None, "#101010")]
    frame = spark.createDataFrame(rows, "palette_id string, idx int, hex string")
    got = sorted(map(tuple, palettes.merge_maps(frame, 0.03).collect()), key=str)

    lab = {h: raster._oklab_table(np.array([[int(h[i : i + 2], 16) for i in (1, 3, 5)]], dtype=float))[0].tolist() for _, _, h in rows}
    want = []
    for name in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == name]
        links = {r[1]: {r[1]} for r in own}
        if name is not None and name != "none":
            for x in own:
                for y in own:
                    if x[1] < y[1] and math.dist(lab[x[2]], lab[y[2]]) <= 0.03:
                        links[x[1]].add(y[1])
                        links[y[1]].add(x[1])
        for _, i, _ in own:
            seen, todo = set(), [i]
            while todo:
                if (k := todo.pop()) not in seen:
                    seen.add(k)
                    todo += links[k]
            want.append((name, i, min(seen, key=lambda v: -1 if v is None else v)))
    assert got == sorted(want, key=str)


def test_merge_maps_make_no_rows_of_pairs(spark):
    frame = spark.createDataFrame([("p", 0, "#000000"), ("p", 1, "#010101")], "palette_id string, idx int, hex string")
    plan = palettes.merge_maps(frame, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
