import dataclasses
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pigmenta.functions import color, tables
from pigmenta.operators import extract, palettes, presets, raster, regions
from pigmenta.plans import pipeline
from pigmenta.sources import images, store
from pigmenta.sources import palettes as files

PX = "image_id long, y int, x int, r int, g int, b int, a int"


def pixels(spark, image):
    return spark.createDataFrame([(0, y, x, *v) for y, row in enumerate(image) for x, v in enumerate(row)], PX)


def mapped(spark, rows):
    return spark.createDataFrame([(0, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, y int, x int, idx int")


def as_grid(df, column, shape):
    out = [[None] * shape[1] for _ in range(shape[0])]
    for r in df.collect():
        out[r.y][r.x] = r[column]
    return out


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_hex(spark):
    rows = {"#0f0": "#00ff00", " 0F0 ": "#00ff00", "#12345": None, "ABCDEF": "#abcdef", "": None, "#ggg": None}
    got = spark.createDataFrame([(k,) for k in rows], "h string").select("h", color.normal_hex(F.col("h")).alias("n")).collect()
    assert {r.h: r.n for r in got} == rows
    assert one(spark, color.to_hex(F.lit(254.5), F.lit(-3.0), F.lit(300.0))) == "#ff00ff"


def test_oklab_of_known_colours_and_back(spark):
    white = one(spark, color.oklab(F.lit(255), F.lit(255), F.lit(255)))
    assert white.l == pytest.approx(1, abs=1e-6) and abs(white.a) < 1e-6 and abs(white.b) < 1e-6
    red = one(spark, color.oklab(F.lit(255), F.lit(0), F.lit(0)))
    assert (red.l, red.a, red.b) == pytest.approx((0.627955, 0.224863, 0.125846), abs=1e-4)
    back = one(spark, color.let(color.oklab(F.lit(12), F.lit(200), F.lit(90)), lambda v: color.from_oklab(v["l"], v["a"], v["b"])))
    assert (back.r, back.g, back.b) == pytest.approx((12, 200, 90), abs=1e-3)


def test_hue_step(spark):
    assert one(spark, color.hue_step(F.lit(350.0), F.lit(10.0))) == 20
    assert one(spark, color.hue_step(F.lit(10.0), F.lit(350.0))) == -20


def test_tone_points_cannot_cross():
    assert raster.Tone(black=300, white=0).table()[255] == pytest.approx(255)
    assert raster.Tone().neutral()
    assert raster.Tone(gamma=1.0).table() == pytest.approx(list(range(256)), abs=1e-4)


def test_transparent_pixels_have_no_colour(spark):
    image = [[(255, 0, 0, 7), (250, 5, 5, 8)]]
    rows = raster.match(raster.opaque(pixels(spark, image)), ["#000000", "#ff0000"])
    assert as_grid(rows, "idx", (1, 2)) == [[None, 1]]
    out = {r.x: (r.r, r.g, r.b, r.a) for r in raster.paint(rows, ["#000000", "#ff0000"]).collect()}
    assert out == {0: (0, 0, 0, 0), 1: (255, 0, 0, 255)}


def test_ties_take_the_first_colour(spark):
    rows = raster.match(pixels(spark, [[(5, 5, 5, 255)]]), ["#0a0a0a", "#000000", "#0a0a0a"])
    assert rows.first().idx == 0


@pytest.mark.parametrize("metric", ["srgb", "redmean", "oklab"])
def test_matching_agrees_with_the_sequential_form(spark, metric):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (6, 7, 3))
    df = pixels(spark, [[(*map(int, v), 255) for v in row] for row in image])
    got = as_grid(raster.match(df, "Sweetie 16", metric), "idx", (6, 7))
    assert got == [[scanned(v, tables.rgb_list("Sweetie 16"), metric) for v in row.tolist()] for row in image]


def scanned(v, rgb, metric):
    """The first of the nearest colours, one distance at a time."""
    lab = lambda c: raster._oklab_table(np.array([c], dtype=float))[0]

    def far(c):
        if metric == "oklab":
            return float(((lab(v) - lab(c)) ** 2).sum())
        d, s = [x - y for x, y in zip(v, c, strict=True)], v[0] + c[0]
        return (1024 + s) * d[0] ** 2 + 2048 * d[1] ** 2 + (1534 - s) * d[2] ** 2 if metric == "redmean" else sum(x * x for x in d)

    return min(range(len(rgb)), key=lambda i: (far(rgb[i]), i))


def test_cells_follow_their_first_pixel(spark):
    rows = raster.match(pixels(spark, [[(10, 10, 10, 255), (11, 11, 11, 255)]]), ["#0a0a0a", "#0b0b0b"], mode="cell")
    assert as_grid(rows, "idx", (1, 2)) == [[0, 0]]


def test_denoise_takes_the_upper_median_and_skips_transparency(spark):
    image = [[(10, 0, 0, 255), (20, 0, 0, 255)], [(30, 0, 0, 255), (40, 0, 0, 255)]]
    assert {r.r for r in raster.denoise(pixels(spark, image), 1).collect()} == {30}
    image[0][0] = (9, 9, 9, 0)
    got = {(r.y, r.x): (r.r, r.a) for r in raster.denoise(pixels(spark, image), 1).collect()}
    assert got[0, 0] == (0, 0) and got[1, 1] == (30, 255)


def reference_diffusion(v, shown, rgb, amount):
    h, w, _ = v.shape
    err = np.zeros((h + 1, w + 2, 3))
    out = np.full((h, w), -1)
    for y in range(h):
        d = -1 if y % 2 else 1
        for x in range(w) if d > 0 else reversed(range(w)):
            if not shown[y, x]:
                continue
            c = v[y, x] + err[y, x + 1]
            q = np.trunc(np.clip(c, 0, 255))
            k = int(np.argmin(((rgb - q) ** 2).sum(axis=1)))
            out[y, x] = k
            e = (c - rgb[k]) * amount
            for dy, dx, f in ((0, d, 7), (1, -d, 3), (1, 0, 5), (1, d, 1)):
                err[y + dy, x + 1 + dx] += e * f / 16
    return out


def test_diffusion_is_serpentine(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 256, (5, 8, 3)).astype(float)
    shown = rng.random((5, 8)) > 0.2
    rgb = np.array(tables.rgb_list("Game Boy (DMG)"), dtype=float)
    want = reference_diffusion(v, shown, rgb, 0.8)
    df = pixels(spark, [[(*map(int, v[y, x]), 255 if shown[y, x] else 0) for x in range(8)] for y in range(5)])
    got = as_grid(raster.diffused(df, "Game Boy (DMG)", amount=0.8), "idx", (5, 8))
    assert [[-1 if g is None else g for g in row] for row in got] == want.tolist()


def test_stipple_needs_five_neighbours_and_a_near_colour(spark):
    rows = mapped(spark, [[1, 1, 1], [1, 0, 1], [1, 1, 1]])
    near, far = ["#ff8000", "#ff8202"], ["#000000", "#ff8202"]
    assert as_grid(regions.smooth_stipple(rows, near, 0.1), "idx", (3, 3))[1][1] == 1
    assert as_grid(regions.smooth_stipple(rows, far, 0.1), "idx", (3, 3))[1][1] == 0


def test_labels_are_4_connected_in_raster_order(spark):
    rows = mapped(spark, [[0, 1, None], [1, 0, 0], [1, 1, 0]])
    assert as_grid(regions.label_regions(rows), "label", (3, 3)) == [[0, 1, None], [2, 3, 3], [2, 2, 3]]
    empty = mapped(spark, [[None, None]])
    assert as_grid(regions.label_regions(empty), "label", (1, 2)) == [[None, None]]


def test_specks_of_a_near_colour_are_absorbed_and_others_stay(spark):
    rows = regions.label_regions(mapped(spark, [[0] * 5, [0, 1, 0, 2, 0], [0] * 5]))
    colors = ["#ff8000", "#ff8404", "#000000"]
    got = as_grid(regions.absorb_small(rows, colors, 2, 0.1), "idx", (3, 5))
    assert got[1] == [0, 0, 0, 2, 0]
    none = as_grid(regions.absorb_small(rows, colors, 2, 0.0), "idx", (3, 5))
    assert none[1] == [0, 1, 0, 2, 0]


def test_each_border_paints_one_opaque_pixel(spark):
    rows = regions.label_regions(mapped(spark, [[0, 0, 1], [None, 0, 1]]))
    edge = as_grid(regions.outlines(rows), "edge", (2, 3))
    assert edge == [[True, True, False], [False, True, False]]
    assert not any(map(any, as_grid(regions.outlines(regions.label_regions(mapped(spark, [[0, 0]]))), "edge", (1, 2))))


def test_merging_keeps_the_first_colour():
    assert regions.merge_map(["#101010", "#ffffff", "#121212", "#141414"], 0.02) == [0, 1, 0, 0]


def test_sorting_is_a_permutation_and_separates_greys_from_vivid(spark):
    colors = tables.PALETTES["Sweetie 16"]
    rows = spark.createDataFrame([("s", i, c) for i, c in enumerate(colors)], "palette_id string, idx int, hex string")
    got = [r.hex for r in palettes.sort_into_ramps(rows).orderBy("place").collect()]
    assert sorted(got) == sorted(colors)
    muted, vivid = [got.index(c) for c in ("#333c57", "#566c86", "#94b0c2")], [got.index(c) for c in ("#3b5dc9", "#41a6f6")]
    assert max(muted) < min(vivid) or min(muted) > max(vivid)


def test_palette_edits(spark):
    rows = spark.createDataFrame([("p", 0, "#a"), ("p", 1, "#b"), ("p", 2, "#a"), ("p", 3, "")], "palette_id string, idx int, hex string")
    assert [(r.idx, r.hex) for r in palettes.distinct_colors(rows).orderBy("idx").collect()] == [(0, "#a"), (1, "#b")]
    assert [r.hex for r in palettes.move_color(rows.limit(3), 2, 0).orderBy("idx").collect()] == ["#a", "#a", "#b"]


@pytest.mark.parametrize(
    ("text", "colors"),
    [
        ("GIMP Palette\nName: My\nColumns: 4\n#\n255 0 0 red\n  0 255 0\n", ["#ff0000", "#00ff00"]),
        ("﻿JASC-PAL\n0100\n2\n1 2 3\n4 5 6\n", ["#010203", "#040506"]),
        ('["#f00", "00ff00", "worse"]', ["#ff0000", "#00ff00"]),
        ('{"name": "n", "colors": [[1, 2, 3], {"r": 4, "g": 5, "b": 6}]}', ["#010203", "#040506"]),
        ("{ broken #aabbcc", ["#aabbcc"]),
        ("a { color: #AABBCC } b { color: #112233 } #aabbcc #abc #11223344", ["#aabbcc", "#112233"]),
        ("1, 2, 3\n300 4 5\nx", ["#010203", "#ff0405"]),
        ("", []),
    ],
)
def test_palette_texts(spark, text, colors):
    got = spark.createDataFrame([(text,)], "t string").select(files.parse_text(F.col("t"), F.lit("a.b.txt")).alias("p")).first().p
    assert got.colors == colors
    assert got.name == {"G": "My", "{": "n" if "name" in text else "a.b"}.get(text[:1], "a.b")


def test_act_tables(spark):
    body = bytes(range(9)) + bytes(759)
    rows = spark.createDataFrame([(bytearray(body),), (bytearray(body + struct.pack(">HH", 2, 0)),)], "c binary").select(files.parse_act(F.col("c")).alias("v")).collect()
    assert rows[0].v == ["#000102", "#030405", "#060708", "#000000"] and rows[1].v == ["#000102", "#030405"]


def test_importing_a_backup_again_adds_nothing(spark):
    raw = spark.createDataFrame([(0, " One ", {"pm-speck": "3", "nope": "1"}), (1, "", {"pm-speck": "3"}), (2, "Two", {"nope": "1"})], "ord int, name string, settings map<string,string>")
    clean = presets.clean_presets(raw)
    assert [(r.name, r.settings) for r in clean.collect()] == [("One", {"pm-speck": "3"})]
    none = spark.createDataFrame([], "ord int, id string, name string, settings map<string,string>")
    first = presets.merge_by_name(none, clean.withColumn("settings", F.col("settings")), ["settings"])
    again = presets.merge_by_name(first.drop("status"), clean, ["settings"])
    assert [r.status for r in first.collect()] == ["added"] and [r.status for r in again.collect()] == ["updated"]


def test_extraction(spark):
    image = [[(255, 0, 0, 255)] * 4 + [(0, 0, 255, 255)] * 4] * 4
    size = spark.createDataFrame([(0, 8, 4)], "image_id long, width int, height int")
    samples = raster.sample(pixels(spark, image), size)
    got = {r.hex for r in extract.extract_palette(samples, 2).collect()}
    assert got == {"#ff0000", "#0000ff"}
    ramp = [r.hex for r in extract.theory_palette(samples, 12, "complementary").orderBy("idx").collect()]
    assert 6 <= len(ramp) <= 12 and len(set(ramp)) == len(ramp)


def test_png_round_trip(spark, tmp_path):
    image = [[(1, 2, 3, 255), (4, 5, 6, 0)], [(7, 8, 9, 255), (10, 11, 12, 255)]]
    data = images.to_png(pixels(spark, image)).first().png
    (tmp_path / "a.png").write_bytes(data)
    read = images.read_images(spark, str(tmp_path))
    back = {(p.y, p.x): (p.r, p.g, p.b, p.a) for p in images.to_pixels(read).collect()}
    assert back == {(y, x): v for y, row in enumerate(image) for x, v in enumerate(row)}


def test_rendered_pixels_are_palette_colours_with_hard_alpha(spark):
    rng = np.random.default_rng(3)
    image = [[(*map(int, v), int(a)) for v, a in zip(row, alpha, strict=True)] for row, alpha in zip(rng.integers(0, 256, (8, 8, 3)), rng.integers(0, 256, (8, 8)), strict=True)]
    size = spark.createDataFrame([(0, 8, 8)], "image_id long, width int, height int")
    o = pipeline.Options(dither="bayer4", denoise=1, speck=2, smooth_stipple=True, merge_colors=5, export_scale=2)
    rows = pipeline.render(pixels(spark, image), size, "PICO-8", o).collect()
    allowed = set(tables.rgb_list("PICO-8"))
    assert len(rows) == 256 and all(p.a in (0, 255) and (p.a == 0 or (p.r, p.g, p.b) in allowed) for p in rows)


def test_bayer_and_spacing():
    assert tables.bayer(4)[:4] == [0, 8, 2, 10] and sorted(tables.bayer(8)) == list(range(64))
    assert raster.mean_spacing(["#000000", "#ffffff"]) == pytest.approx(math.sqrt(3) * 255)


def test_a_backup_read_back_is_what_was_saved(spark):
    colors = "ord int, id string, name string, settings map<string,string>, palette struct<name:string,colors:array<string>>, outline_touched boolean"
    saved = spark.createDataFrame([(0, "s1", "One", {"pm-speck": "3"}, ("p", ["#010203"]), True), (1, "b-x", "Built in", {"pm-speck": "1"}, None, False)], colors)
    library = spark.createDataFrame([(0, "p1", "Mine", ["#aabbcc", "#112233"])], "ord int, id string, name string, colors array<string>")
    now = F.lit("2024-05-06 07:08:09").cast("timestamp")
    text = presets.backup(saved, library, "marked", now)
    body = json.loads(text.first().json)
    assert body["format"] == "marked" and body["exported"] == "2024-05-06T07:08:09.000Z" and [p["id"] for p in body["presets"]] == ["s1"]
    assert text.select(files.is_backup(F.col("json"), "marked").alias("a"), files.is_backup(F.col("json"), "other").alias("b")).first() == (True, False)
    one, two = presets.import_backup(saved.limit(0), library.limit(0), text, now)
    assert [(r.name, r.settings, r.palette.asDict(), r.outline_touched, r.status) for r in one.collect()] == [("One", {"pm-speck": "3"}, {"name": "p", "colors": ["#010203"]}, True, "added")]
    assert [(r.name, r.colors) for r in two.collect()] == [("Mine", ["#aabbcc", "#112233"])]
    assert presets.backup(saved.where("false"), library.where("false"), "marked", now).count() == 0
    assert spark.range(1).select(presets.backup_name("x", now)).first()[0] == "x-2024-05-06.json"


def test_imported_rows_are_cleaned(spark):
    items = [{"name": "  Good  ", "settings": {"pm-speck": 3, "pm-smooth": True, "pm-metric": "oklab", "pm-gamma": None, "pm-pixel": [1], "else": "1"}, "palette": {"name": "", "colors": ["0f0", "no", 7]}, "outlineColorTouched": 1}, {"name": 5, "settings": {"pm-speck": "1"}}, {"name": "none", "settings": {}}, "text", None, {"name": "Plain", "settings": {"pm-speck": "9"}, "palette": {"colors": []}}]
    texts = spark.createDataFrame([(json.dumps(items),), ("no json",), ('{"other": 1}',), (None,)], "json string")
    raw, more = presets.read_backup(texts)
    assert raw.count() == 6 and more.count() == 0
    got = {r.name: r for r in presets.clean_presets(raw).collect()}
    assert got.keys() == {"Good", "Plain"}
    assert got["Good"].settings == {"pm-speck": "3", "pm-smooth": "true", "pm-metric": "oklab"} and got["Good"].outline_touched and not got["Plain"].outline_touched
    assert got["Good"].palette.asDict() == {"name": "Untitled", "colors": ["#00ff00"]} and got["Plain"].palette is None


def test_saving_and_applying_presets(spark):
    shape = "ord int, id string, name string, settings map<string,string>, palette struct<name:string,colors:array<string>>, outline_touched boolean"
    rows = spark.createDataFrame([(0, "a", "One", {"pm-speck": "3"}, None, False)], shape)
    change = spark.createDataFrame([("ONE", {"pm-speck": "4"}, None, True)], shape.removeprefix("ord int, id string, "))
    after = presets.save(rows, change, presets.PRESET_VALUES)
    assert [(r.id, r.name, r.settings) for r in after.collect()] == [("a", "One", {"pm-speck": "4"})]
    more = presets.save(after, change.withColumn("name", F.lit("Two")), presets.PRESET_VALUES).orderBy("ord").collect()
    assert [r.name for r in more] == ["Two", "One"] and more[0].id.startswith("s")
    defaults = pipeline.Options().settings()
    row = presets.applied(after, "a", defaults).first()
    o = pipeline.Options.of(row.settings)
    assert o.speck == 4 and o.dither == "none" and row.outline_touched and pipeline.Options.of(o.settings()) == o
    assert set(defaults) == set(presets.SETTINGS)
    told = lambda active, current: presets.note(after, active, current, defaults).first().note
    assert told(None, defaults) == "Defaults" and told(None, o.settings()) == "Custom"
    assert told("a", o.settings()) == "One" and told("a", defaults) == "One · modified"
    assert presets.delete_by_id(after, "a").count() == 0


def test_library_edits(spark):
    shape = "ord int, id string, name string, colors array<string>"
    library = spark.createDataFrame([(0, "p1", "Mine", ["#010101"]), (1, "p2", "Other", ["#020202"])], shape)
    one = spark.createDataFrame([(" New name ", ["#030303"])], "name string, colors array<string>")
    over = {r.id: (r.name, r.colors) for r in presets.save_palette(library, one, "p2").collect()}
    assert over == {"p1": ("Mine", ["#010101"]), "p2": ("New name", ["#030303"])}
    put = presets.save_palette(library, presets.duplicate(one), None).orderBy("ord").collect()
    assert [r.name for r in put] == ["New name  copy", "Mine", "Other"] and put[0].ord == -1
    rows = spark.createDataFrame([("p", 0, "#010101"), ("p", 1, "#020202"), ("p", 2, "#030303")], "palette_id string, idx int, hex string")
    hexes = lambda df: [r.hex for r in df.orderBy("idx").collect()]
    assert hexes(palettes.edit_color(rows, 1, "FFF")) == ["#010101", "#ffffff", "#030303"] and hexes(palettes.edit_color(rows, 1, "no")) == hexes(rows)
    assert hexes(palettes.delete_color(rows, 0)) == ["#020202", "#030303"] and hexes(palettes.add_color(rows)) == [*hexes(rows), "#030303"]
    assert palettes.clear_colors(rows, "p").count() == 0
    full = spark.createDataFrame([("f", i, f"#0000{i:02x}") for i in range(256)], "palette_id string, idx int, hex string")
    picked = spark.createDataFrame([("#020202",)], "hex string")
    assert palettes.add_color(full).count() == 256 and palettes.pick_into(full, picked).count() == 256
    assert palettes.pick_into(rows, picked).count() == 3 and palettes.pick_into(rows, spark.createDataFrame([("#0a0a0a",)], "hex string")).orderBy("idx").collect()[-1].idx == 3
    assert palettes.in_palette(rows, rows.where("idx = 1")).count() == 1 and palettes.in_palette(rows, rows.where("idx = 1"), inside=False).count() == 2
    assert {r.outline for r in palettes.set_palette(rows).collect()} == {"#010101"} and {r.outline for r in palettes.set_palette(rows, F.lit(True)).collect()} == {None}


def test_kinds_of_input(spark):
    rows = spark.createDataFrame([("a.PNG", ""), ("b.act", ""), ("c.json", '{"format": "m", "presets": []}'), (None, "#112233 #445566"), ("x.txt", "#112233")], "path string, text string")
    assert [r.k for r in rows.select(files.kind_of(F.col("path"), F.col("text")).alias("k")).collect()] == ["image", "act", "backup", "text", "text"]
    assert [r.colors for r in files.pasted(rows.where("text like '#%'")).collect()] == [["#112233", "#445566"]]


def test_kept_tables_and_picture_files(spark, tmp_path):
    rows = spark.createDataFrame([("p", ["#010101"])], "name string, colors array<string>")
    assert store.kept(spark, str(tmp_path), store.CURRENT) is None
    store.keep(rows, str(tmp_path), store.CURRENT)
    assert store.kept(spark, str(tmp_path), store.CURRENT).collect() == rows.collect()
    for bad in (lambda: store.keep(rows, "nothing://here", store.CURRENT), lambda: store.kept(spark, "nothing://here", store.CURRENT)):
        with pytest.raises(Exception, match="nothing"):
            bad()
    image = [[(1, 2, 3, 255), (4, 5, 6, 0)]]
    names = spark.createDataFrame([(0, "My Photo", "PICO-8")], "image_id long, source string, palette string")
    store.write_pngs(pixels(spark, image), names, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["my-photo_pico-8.png"]
    assert images.to_pixels(images.read_images(spark, str(tmp_path / "out"))).where("a = 255").first().r == 1


def test_previews_scale_areas_by_image(spark):
    size = spark.createDataFrame([(0, 100, 100), (1, 4000, 4000)], "image_id long, width int, height int")
    assert {r.image_id: round(r.scale, 2) for r in pipeline.area_scales(size, 1, 1200).collect()} == {0: 1.0, 1: 0.09}
    image = [[(0, 0, 0, 255)] * 6 for _ in range(6)]
    image[2][2] = image[2][3] = (255, 255, 255, 255)
    both = pixels(spark, image).unionByName(pixels(spark, image).withColumn("image_id", F.lit(1).cast("long")))
    sizes = spark.createDataFrame([(0, 6, 6), (1, 6, 6)], "image_id long, width int, height int")
    o = pipeline.Options(metric="srgb", speck=2, tolerance=100.0, outline=True, outline_min=30)
    full = pipeline.export(both, sizes, ["#000000", "#ffffff"], o)
    small = pipeline.export(both, sizes, ["#000000", "#ffffff"], dataclasses.replace(o, export_full=False))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, small.collect())) and full.where("r > 0").count() == 0
    found = pipeline.extract_colors(both, sizes, 2)
    assert sorted((r.palette_id, r.hex) for r in found.collect()) == [(k, h) for k in (0, 1) for h in ("#000000", "#ffffff")]
    onto = spark.createDataFrame([(0, 0, "#00ff00")], "palette_id long, idx int, hex string")
    assert [r.hex for r in pipeline.extract_colors(both, sizes, 2, onto=onto).where("palette_id = 0").orderBy("idx").collect()][0] == "#00ff00"


def test_a_filter_does_not_search_twice(spark):
    rows = raster.match(raster.opaque(pixels(spark, [[(1, 2, 3, 255)]])), "PICO-8").where("idx is not null").groupBy("idx").count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "transform(" not in plan
