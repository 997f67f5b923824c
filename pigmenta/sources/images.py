"""Image files as pixels, and pixels as PNG, as streams: no task holds the pixels of an image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from . import png
from .png import encoded as encoded

PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"
#: Pixels of an Arrow batch.
BATCH = 1 << 16
#: What files of each format begin with, in hexadecimal, with any digit for a dot.
BEGINS = {"png": "89504e470d0a1a0a", "jpeg": "ffd8ff", "gif": "47494638", "bmp": "424d", "tiff": "(49492a00|4d4d002a)", "webp": "52494646........57454250", "avif": "........66747970(61766966|61766973)"}
#: Formats that Spark's image source reads.
WHOLE = ["jpeg", "gif", "bmp", "tiff"]


def _id(path: Column) -> Column:
    """The number of a file; two sources of Spark write the scheme of local files in two ways."""
    return F.xxhash64(F.regexp_replace(path, "^file:/+", "file:/"))


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def _kind(content: Column) -> Column:
    start, out = F.lower(F.hex(F.substring(content, 1, 12))), F.lit("unknown")
    for kind, begin in reversed(BEGINS.items()):
        out = F.when(start.rlike(f"^{begin}"), kind).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """image_id, name, path, kind and content of all files of a folder; kind is told from the first bytes."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(_id(F.col("path")).alias("image_id"), _name(F.col("path")).alias("name"), "path", _kind(F.col("content")).alias("kind"), "content")


def _opened(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, png.Reader | str]]:
    """The reader of each file, or why there is none."""
    for batch in rows:
        for image, content in zip(batch.column("image_id").to_pylist(), batch.column("content"), strict=True):
            try:
                yield image, png.Reader(content.as_py() or b"")
            except png.Unreadable as e:
                yield image, str(e)


_ARROW = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("y", "x", "r", "g", "b", "a"))])


def _pixel_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for image, reader in _opened(rows):
        if isinstance(reader, str):
            continue
        most, held, top = max(1, BATCH // reader.width), [], 0

        def made(image: int = image, width: int = reader.width) -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(held).astype(np.int32)
            for lo in range(0, len(flat), BATCH):
                part = flat[lo : lo + BATCH]
                y, x = np.divmod(np.arange(lo, lo + len(part)), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), image)), pa.array((y + top).astype(np.int32)), pa.array(x.astype(np.int32)), *[pa.array(part[:, c]) for c in range(4)]], schema=_ARROW)

        try:
            for row in reader.rows():
                held.append(row)
                if len(held) == most:
                    yield from made()
                    top, held = top + len(held), []
        except png.Unreadable:
            pass  # unreadable() says so; the rows before the fault stay
        if held:
            yield from made()


def png_pixels(files: DataFrame) -> DataFrame:
    """The pixels of PNG files(image_id, content), row by row; files that aren't readable give none from the fault on."""
    return files.select(F.col("image_id").cast("long"), "content").mapInArrow(_pixel_batches, PIXELS)


def _faults(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    images, whys = [], []
    for image, reader in _opened(rows):
        try:
            if isinstance(reader, str):
                raise png.Unreadable(reader)
            for _ in reader.rows():
                pass
        except png.Unreadable as e:
            images.append(image)
            whys.append(str(e))
    yield pa.RecordBatch.from_arrays([pa.array(images, pa.int64()), pa.array(whys, pa.string())], names=["image_id", "reason"])


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """image_id, name, kind and reason of the files of a folder that give no, or not all, pixels."""
    files = read_files(spark, path)
    faults = files.where("kind = 'png'").select("image_id", "content").mapInArrow(_faults, "image_id long, reason string")
    pngs = files.where("kind = 'png'").select("image_id", "name", "kind").join(faults, "image_id").where("not (kind = 'png' and reason = 'interlaced')")
    read = spark.read.format("image").option("dropInvalid", True).load(path).select(_id(F.col("image.origin")).alias("image_id"))
    others = files.where(F.col("kind") != "png").select("image_id", "name", "kind").join(read, "image_id", "left_anti")
    reason = F.when(F.col("kind").isin(WHOLE), F.concat("kind", F.lit(" that doesn't decode"))).otherwise(F.concat(F.lit("no decoder for "), "kind"))
    return pngs.unionByName(others.withColumn("reason", reason))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, name, width, height, channels and data of the images of a folder; unreadable() names the other files."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return rows.select(_id(F.col("origin")).alias("image_id"), _name(F.col("origin")).alias("name"), "width", "height", F.col("nChannels").alias("channels"), "data")


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            data = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
            bgr = np.repeat(data, 3, axis=2) if row.channels == 1 else data[..., :3]
            alpha = data[..., 3] if row.channels == 4 else np.full(data.shape[:2], 255)
            rows = max(1, 200_000 // row.width)
            for top in range(0, row.height, rows):
                part = bgr[top : top + rows].reshape(-1, 3)
                y, x = np.divmod(np.arange(len(part)), row.width)
                yield pd.DataFrame({"image_id": row.image_id, "y": (y + top).astype("int32"), "x": x.astype("int32"), "r": part[:, 2].astype("int32"), "g": part[:, 1].astype("int32"), "b": part[:, 0].astype("int32"), "a": alpha[top : top + rows].reshape(-1).astype("int32")})


def to_pixels(images: DataFrame) -> DataFrame:
    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(_unpack, PIXELS)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of all images of a folder: PNG as a stream, other formats and interlaced PNG as Spark reads them."""
    files = read_files(spark, path)
    streamed = png_pixels(files.where("kind = 'png'"))
    laced = (F.col("kind") == "png") & (F.hex(F.substring("content", 29, 1)) == "01")
    whole = files.where(F.col("kind").isin(WHOLE) | laced).select("image_id")
    return streamed.unionByName(to_pixels(read_images(spark, path).join(whole, "image_id", "left_semi")))


PARTS = "image_id long, part int, adler long, length long, data binary"
_PARTS = pa.schema([("image_id", pa.int64()), ("part", pa.int32()), ("adler", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])


def _banded(key: tuple, table: pa.Table, rows: int) -> pa.Table:
    image, number = (k.as_py() for k in key)
    width, height = table["width"][0].as_py(), table["height"][0].as_py()
    top = number * rows
    rgba = np.zeros((min(rows, height - top), width, 4), dtype=np.uint8)
    at = table["y"].to_numpy() - top, table["x"].to_numpy()
    for c, name in enumerate("rgba"):
        rgba[(*at, c)] = table[name].fill_null(0).to_numpy()
    data, adler, n = png.band(rgba, number == 0)
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((image, number + 1, adler, n, data), _PARTS, strict=True)], schema=_PARTS)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands before and after the bands of each image."""
    for batch in batches:
        for image in batch.to_pylist():
            ends = [png.head(image["width"], image["height"]), png.tail([(s["adler"], s["length"]) for s in image["sums"]])]
            yield pa.RecordBatch.from_arrays([pa.array([image["image_id"]] * 2), pa.array([0, len(image["sums"]) + 1], pa.int32()), pa.array(ends, pa.binary())], names=["image_id", "part", "data"])


def png_parts(pixels: DataFrame, rows: int = 64, sizes: DataFrame | None = None) -> DataFrame:
    """image_id, part and data: the bytes of each image's PNG file, in order of part. A part is a band of so many rows.

    Places without a pixel are transparent; bands without any are there as well. sizes: image_id, width and height;
    without them the pixels are staged, and an image ends at its last pixels.
    """
    if sizes is None:
        pixels = staged(pixels)
        sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    # a corner pixel for each band, so that none is missing
    corners = sizes.select("image_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / rows).cast("int"))).alias("_band"))
    corners = corners.select("image_id", (F.col("_band") * rows).alias("y"), F.lit(0).alias("x"), *[F.lit(0).alias(c) for c in "rgba"], F.lit(False).alias("_there"))
    given = pixels.select("image_id", "y", "x", *[F.col(c).cast("int").alias(c) for c in "rgba"], F.lit(True).alias("_there"))
    both = given.unionByName(corners).join(sizes, "image_id").withColumn("_band", F.floor(F.col("y") / rows).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["_there"].to_numpy(zero_copy_only=False), kind="stable")  # real pixels replace corners
        return _banded(key, table.take(pa.array(order)), rows)

    bands = both.groupBy(F.col("image_id").cast("long").alias("image_id"), "_band").applyInArrow(run, PARTS)
    sums = bands.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("part", "adler", "length"))).alias("sums"))
    ends = sums.join(sizes, "image_id").mapInArrow(_ends, "image_id long, part int, data binary")
    return bands.select("image_id", "part", "data").unionByName(ends)


def to_png(pixels: DataFrame) -> DataFrame:
    """image_id and png of each image, for images that fit in a row; write_pngs streams larger ones."""
    parts = png_parts(pixels).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("_p"))
    whole = F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["data"])), ""))
    return parts.select("image_id", whole.alias("png"))
