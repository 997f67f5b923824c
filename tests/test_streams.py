"""Images as streams and in bands, files that appear whole or not at all, the colour grid, medians, resampling, the cache."""

import hashlib
import io
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_raster import pixels, reference_diffusion

from pigmenta.functions import tables
from pigmenta.operators import raster
from pigmenta.plans import pipeline
from pigmenta.sources import images, png, store


def picture(h, w, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (h, w, 4), dtype=np.uint8)


def filtered(rgba, kinds):
    """A PNG whose rows have filters by turns, written out by the book."""
    h, w, _ = rgba.shape
    flat, lines = rgba.reshape(h, w * 4).astype(int), bytearray()
    for y in range(h):
        kind = kinds[y % len(kinds)]
        lines.append(kind)
        for i in range(w * 4):
            a, b = flat[y, i - 4] if i >= 4 else 0, flat[y - 1, i] if y else 0
            c = flat[y - 1, i - 4] if y and i >= 4 else 0
            paeth = min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))  # noqa: B023
            lines.append((flat[y, i] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    return png.head(w, h) + png.chunk(b"IDAT", zlib.compress(bytes(lines))) + png.chunk(b"IEND", b"")


def read(content):
    return np.stack(list(png.Reader(content).rows()))


def test_all_filters_are_undone():
    rgba = picture(11, 7)
    for kinds in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)):
        assert (read(filtered(rgba, kinds)) == rgba).all()


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_greys_palettes_and_deep_samples(depth):
    v = np.arange(2 * 8).reshape(2, 8) % (1 << depth)
    bits = ((v[..., None] >> np.arange(depth)[::-1]) & 1).reshape(2, -1).astype(np.uint8)
    lines = b"".join(b"\0" + np.packbits(row).tobytes() for row in bits)

    def file(kind, *more):
        header = png.struct.pack(">IIBBBBB", 8, 2, depth, kind, 0, 0, 0)
        return png.SIGNATURE + png.chunk(b"IHDR", header) + b"".join(png.chunk(*m) for m in more) + png.chunk(b"IDAT", zlib.compress(lines)) + png.chunk(b"IEND", b"")

    grey = read(file(0))
    assert (grey[..., 0] == (v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1))).all() and (grey[..., 3] == 255).all()
    if depth <= 8:
        colors = np.arange(3 * 256, dtype=np.uint8).reshape(256, 3)
        got = read(file(3, (b"PLTE", colors[: 1 << depth].tobytes()), (b"tRNS", b"\x07\x80")))
        assert (got[..., :3] == colors[v]).all() and (got[..., 3] == np.where(v == 0, 7, np.where(v == 1, 128, 255))).all()


def test_bands_make_one_file():
    rgba = picture(150, 9)
    for rows in (1, 64, 150, 999):
        content = png.encoded(rgba, rows)
        assert (read(content) == rgba).all()
        raw = zlib.decompress(b"".join(bytes(d) for k, d in png._chunks(content) if k == b"IDAT"))  # checks the sum, too
        assert len(raw) == 150 * 37
    with pytest.raises(png.Unreadable):
        read(content[:-60])


def test_a_tall_image_is_read_within_bounds(spark):
    rgba = np.repeat(picture(200, 300), 100, axis=0)
    content = png.encoded(rgba)
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([content], pa.binary())], names=["image_id", "content"])
    tracemalloc.start()
    rows = sum(len(b) for b in images._pixel_batches(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 20_000 * 300 and peak < 100 << 20


def test_folders_with_all_kinds_of_files(spark, tmp_path):
    rgba = picture(5, 6)
    (tmp_path / "a.png").write_bytes(png.encoded(rgba))
    (tmp_path / "b.png").write_bytes(png.encoded(rgba)[:-70])
    (tmp_path / "c.webp").write_bytes(b"RIFF\x10\0\0\0WEBPVP8 ")
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8\xff nothing")
    (tmp_path / "e.bmp").write_bytes(b"BM" + png.struct.pack("<IHHIIiiHHIIiiII", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0")
    (tmp_path / "f.txt").write_bytes(b"text")
    names = {r.image_id: r.name for r in images.read_files(spark, str(tmp_path)).collect()}
    got = {}
    for r in images.read_pixels(spark, str(tmp_path)).collect():
        got.setdefault(names[r.image_id], {})[r.y, r.x] = (r.r, r.g, r.b, r.a)
    assert got["a"] == {(y, x): tuple(rgba[y, x].tolist()) for y in range(5) for x in range(6)} and got["e"] == {(0, 0): (3, 2, 1, 255)}
    why = {r.name: r.reason for r in images.unreadable(spark, str(tmp_path)).collect()}
    assert set(why) == {"b", "c", "d", "f"} and why["c"] == "no decoder for webp" and why["f"] == "no decoder for unknown"


def test_files_are_written_by_bands_and_once(spark, tmp_path):
    rgba = {k: picture(70, 5, k) for k in range(3)}
    rows = spark.createDataFrame([(k, y, x, *map(int, v[y, x])) for k, v in rgba.items() for y in range(70) for x in range(5)], images.PIXELS).repartition(3)
    names = spark.createDataFrame([(0, "a", "p"), (1, "b", "p"), (2, "a", "p")], "image_id long, source string, palette string")
    out = tmp_path / "out"
    store.write_pngs(rows, names, str(out), 16)
    assert sorted(p.name for p in out.iterdir() if not p.name.endswith(".crc")) == ["a_p.png", "b_p.png"]
    assert (read((out / "a_p.png").read_bytes()) == rgba[2]).all() and (read((out / "b_p.png").read_bytes()) == rgba[1]).all()


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(store.Pictures)
    out = tmp_path / "out"
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), "id").alias("file"), F.when(F.col("id") == 39, F.raise_error(F.lit("on purpose")).cast("binary")).otherwise(F.encode(F.lit("x"), "UTF-8")).alias("data"))
    with pytest.raises(Exception, match="on purpose"):
        rows.write.format("pictures").mode("append").save(str(out))
    assert not out.exists() or not list(out.iterdir())


def test_tables_survive_a_failed_write_and_can_be_made_from_themselves(spark, tmp_path):
    folder = str(tmp_path)
    store.keep(spark.range(3), folder, "t")
    store.keep(store.kept(spark, folder, "t").select((F.col("id") + 1).alias("id")), folder, "t")
    with pytest.raises(Exception, match="on purpose"):
        store.keep(spark.range(3).select(F.raise_error(F.lit("on purpose")).alias("id")), folder, "t")
    assert sorted(r.id for r in store.kept(spark, folder, "t").collect()) == [1, 2, 3]


@pytest.mark.parametrize("metric", ["srgb", "redmean", "oklab"])
@pytest.mark.parametrize("count", [1, 2, 16, 256])
def test_the_grid_finds_what_a_scan_finds(metric, count):
    rng = np.random.default_rng(count)
    rgb = rng.integers(0, 256, (count, 3))
    rgb[count // 2 :] = np.where(rng.random((count - count // 2, 1)) < 0.2, rgb[: count - count // 2], rgb[count // 2 :])  # ties
    levels = np.concatenate([rng.integers(0, 256, (3000, 3)), rgb, np.array([[0, 0, 0], [255, 255, 255], [7, 8, 255]])])
    known = raster.Search(tuple(map(tuple, rgb.tolist())), metric)
    got = known.find(levels)
    at, table = (raster._oklab_table(levels.astype(float)), raster._oklab_table(rgb.astype(float))) if metric == "oklab" else (levels, rgb)
    d = at[:, None] - table[None]
    s = levels[:, None, 0] + rgb[None, :, 0]
    far = (1024 + s) * d[..., 0] ** 2 + 2048 * d[..., 1] ** 2 + (1534 - s) * d[..., 2] ** 2 if metric == "redmean" else (d**2).sum(axis=2)
    if metric == "oklab":  # sums in another order may differ in the last bit
        assert np.allclose(far[np.arange(len(levels)), got], far.min(axis=1), atol=1e-15)
    else:
        assert (got == far.argmin(axis=1)).all()
    assert [known.find_one(*v) for v in levels[:50].tolist()] == got[:50].tolist()


def test_a_wide_palette_takes_little_longer_than_a_small_one():
    rng = np.random.default_rng(1)
    levels = np.clip(rng.normal(120, 30, (400_000, 3)), 0, 255).astype(np.int64)
    took = {}
    for count in (16, 256):
        known = raster.Search(tuple(map(tuple, rng.integers(0, 256, (count, 3)).tolist())), "srgb")
        known.find(levels)
        times = []
        for _ in range(3):
            began = time.perf_counter()
            known.find(levels)
            times.append(time.perf_counter() - began)
        took[count] = min(times)
    assert took[256] < 2 * took[16]


def median(image, radius):
    h, w, _ = image.shape
    out = np.zeros((h, w, 3), dtype=int)
    for y, x in np.ndindex(h, w):
        near = image[max(y - radius, 0) : y + radius + 1, max(x - radius, 0) : x + radius + 1].reshape(-1, 4)
        near = near[near[:, 3] > 0]
        if image[y, x, 3]:
            out[y, x] = np.sort(near[:, :3], axis=0)[len(near) // 2]
    return out


@pytest.mark.parametrize(("radius", "tile"), [(1, 256), (3, 5), (2, 4), (6, 7)])
def test_medians_in_tiles(spark, radius, tile):
    image = picture(13, 17, radius).astype(int)
    image[..., 3] = np.where(image[..., 3] < 60, 0, 255)
    rows = raster.denoise(pixels(spark, image.tolist()), radius, tile).collect()
    want = median(image, radius)
    assert {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in rows} == {(y, x): (*want[y, x].tolist(), int(image[y, x, 3])) for y, x in np.ndindex(13, 17)}


def test_a_wide_window_takes_little_longer_than_a_small_one():
    v, took = np.random.default_rng(3).integers(0, 256, (200, 256)), {}
    for radius in (1, 5):
        took[radius] = []
        for _ in range(3):
            began = time.perf_counter()
            raster.window_median(v, np.ones(v.shape, dtype=bool), radius, range(5, 195))
            took[radius].append(time.perf_counter() - began)
    assert min(took[5]) < 2 * min(took[1])


@pytest.mark.parametrize("pixel", [2, 3, 4, 7])
def test_resampling_keeps_the_mean(spark, pixel):
    rng = np.random.default_rng(pixel)
    image = [[(*rng.integers(0, 256, 3).tolist(), 255) for _ in range(23)] for _ in range(17)]
    size = spark.createDataFrame([(0, 23, 17)], "image_id long, width int, height int")
    got = raster.downscale(pixels(spark, image), size, pixel).agg(*[F.avg(c).alias(c) for c in "rgba"]).first()
    assert all(abs(got[c] - np.mean([v[k] for row in image for v in row])) < 0.5 for k, c in enumerate("rgb")) and got.a == 255


@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
def test_diffusion_of_rows_that_end_within_batches(spark, batch):
    rng = np.random.default_rng(5)
    want, batches = [], []
    rgb = np.array(tables.rgb_list("Game Boy (DMG)"), dtype=float)
    for k in range(3):
        v, shown = rng.integers(0, 256, (6, 9, 3)), rng.random((6, 9)) > 0.2
        idx = reference_diffusion(v.astype(float), shown, rgb, 0.8)
        want += [None if i < 0 else int(i) for i in idx.reshape(-1)]
        y, x = np.divmod(np.arange(54), 9)
        batches.append(pa.Table.from_pydict({"image_id": np.full(54, k), "y": y.astype(np.int32), "x": x.astype(np.int32)} | {c: v[..., i].reshape(-1) for i, c in enumerate("rgb")} | {"a": np.where(shown, 255, 0).reshape(-1)}))
    schema = pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("idx", pa.int32())])
    cut = pa.concat_tables(batches).combine_chunks().to_batches(batch)
    got = pa.Table.from_batches(raster._diffuser("Game Boy (DMG)", "srgb", 0.8, schema, 20)(iter(cut)), schema)
    assert got["idx"].to_pylist() == want and got["image_id"].to_pylist() == [k for k in range(3) for _ in range(54)]


@pytest.mark.parametrize("together,alone", [(1 << 20, 1 << 17), (150, 80), (150, 0), (1, 60)])
def test_diffusion_of_images_beside_each_other(together, alone):
    """Images of several sizes and first rows, with pixels that aren't there or are there twice, together or row by row."""
    rng = np.random.default_rng(6)
    want, parts = {}, []
    rgb = np.array(tables.rgb_list("Sweetie 16"), dtype=float)
    for k, (h, w, top) in enumerate([(6, 9, 0), (3, 4, 1), (7, 5, 2), (1, 1, 0), (9, 9, 3), (2, 12, 0)]):
        v, shown, there = rng.integers(0, 256, (h + top, w, 3)), rng.random((h + top, w)) > 0.2, rng.random((h + top, w)) > 0.1
        there[:top], there[top, 0] = False, True
        idx = reference_diffusion(v.astype(float), shown & there, rgb, 0.9)
        y, x = np.nonzero(there)
        want |= {(k, a, b): None if idx[a, b] < 0 else int(idx[a, b]) for a, b in zip(y.tolist(), x.tolist(), strict=True)}
        again = np.sort(np.concatenate([np.arange(len(y)), [0, len(y) // 2]]))
        y, x = y[again], x[again]
        parts.append(pa.Table.from_pydict({"image_id": np.full(len(y), k), "y": y.astype(np.int32), "x": x.astype(np.int32)} | {c: v[y, x, i] for i, c in enumerate("rgb")} | {"a": np.where(shown[y, x], 255, 0)}))
    schema = pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("idx", pa.int32())])
    for batch in (7, 1000):
        cut = pa.concat_tables(parts).combine_chunks().to_batches(batch)
        got = pa.Table.from_batches(raster._diffuser("Sweetie 16", "srgb", 0.9, schema, 20, together, alone)(iter(cut)), schema).to_pylist()
        assert len(got) == len(want) and {(r["image_id"], r["y"], r["x"]): r["idx"] for r in got} == want


def test_diffusion_of_many_images_takes_little_longer_than_of_few():
    schema = pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("idx", pa.int32())])
    took = []
    for n in (20, 200):
        k, place = np.divmod(np.arange(n * 600), 600)
        rows = {"image_id": k, "y": (place // 30).astype(np.int32), "x": (place % 30).astype(np.int32)} | {c: k * 7 % 50 + place % 30 * 6 for c in "rgb"} | {"a": np.full(len(k), 255)}
        batches = pa.Table.from_pydict(rows).to_batches(10_000)
        best = []
        for _ in range(3):
            began = time.perf_counter()
            assert sum(map(len, raster._diffuser("Sweetie 16", "srgb", 1.0, schema)(iter(batches)))) == n * 600
            best.append(time.perf_counter() - began)
        took.append(min(best))
    assert took[1] < 5 * took[0]


def test_a_second_palette_needs_no_second_median(spark, tmp_path):
    rng = random.Random(2)
    image = [[(*(rng.randrange(256) for _ in range(3)), 255) for _ in range(9)] for _ in range(7)]
    size = spark.createDataFrame([(0, 9, 7)], "image_id long, width int, height int")
    o, folder = pipeline.Options(denoise=1), str(tmp_path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = pixels(spark, image)
    plain = [pipeline.render(rows, size, p, o).collect() for p in ("PICO-8", "Sweetie 16")]
    kept = [pipeline.render(rows, size, p, o, cache=folder) for p in ("PICO-8", "Sweetie 16")]
    assert [sorted(x) for x in plain] == [sorted(x.collect()) for x in kept]
    assert "FlatMapGroupsInArrow" in plan(pipeline.render(rows, size, "PICO-8", o)) and all("FlatMapGroupsInArrow" not in plan(x) for x in kept)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("denoised-")]) == 1
    image[3][3] = (0, 0, 0, 0)
    pipeline.render(pixels(spark, image), size, "PICO-8", o, cache=folder)
    pipeline.render(rows, size, "PICO-8", o, 4, folder)
    pipeline.render(rows, size, "PICO-8", pipeline.Options(denoise=2), cache=folder)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("denoised-")]) == 4


def test_png_of_spark_rows(spark):
    rgba = picture(130, 4)
    rows = pixels(spark, [[tuple(map(int, v)) for v in row] for row in rgba])
    content = bytes(images.to_png(rows).first().png)
    assert (read(content) == rgba).all() and hashlib.sha256(io.BytesIO(content).getvalue()).digest()
    assert images.png_parts(rows, 50).groupBy("image_id").count().first()["count"] == 5
