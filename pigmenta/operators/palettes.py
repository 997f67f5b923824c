"""Operators on palette(palette_id, idx, hex): order, distinct colours, spacing, formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions import color, tables
from . import links

# A wider step of hue starts a family, a wider step of chroma a ramp.
HUE_GAP, CHROMA_GAP = 22.0, 0.045


def sort_into_ramps(palette: DataFrame) -> DataFrame:
    """palette with place: greys by lightness, then hue families by mean hue, each in ramps from muted to vivid.

    The wheel is cut at its widest gap. A palette has at most 256 colours, so its windows are small.
    """
    lch = color.oklch(F.col("hex"))
    rows = palette.withColumn("_c", lch).withColumn("_grey", F.col("_c.c") < color.NEUTRAL_CHROMA)
    grey = rows.where("_grey").select("palette_id", "idx", "hex", F.lit(0).alias("_k"), F.lit(0.0).alias("_mean"), F.lit(0).alias("_ramp"), F.col("_c.l").alias("_l"))
    by = Window.partitionBy("palette_id")
    wheel = by.orderBy("_h", "idx")
    hued = rows.where("not _grey").withColumn("_h", F.col("_c.h"))
    after = F.coalesce(F.lead("_h").over(wheel), F.min("_h").over(by) + 360.0)
    hued = hued.withColumn("_n", F.row_number().over(wheel)).withColumn("_gap", after - F.col("_h"))
    cut = F.max_by("_n", F.struct("_gap", (-F.col("_n")).alias("n"))).over(by)
    hued = hued.withColumn("_turn", F.when(F.col("_n") > cut, F.col("_n")).otherwise(F.col("_n") + 512))
    turned = by.orderBy("_turn")
    hued = hued.withColumn("_family", F.sum(F.when(F.lag("_gap").over(turned) > HUE_GAP, 1).otherwise(0)).over(turned))
    family = Window.partitionBy("palette_id", "_family")
    rad = F.radians("_h")
    mean = F.degrees(F.atan2(F.sum(F.sin(rad)).over(family), F.sum(F.cos(rad)).over(family)))
    hued = hued.withColumn("_mean", F.when(mean < 0, mean + 360.0).otherwise(mean))
    muted = family.orderBy("_c.c", "_turn")
    step = F.col("_c.c") - F.lag("_c.c").over(muted)
    hued = hued.withColumn("_step", F.when((F.count("*").over(family) >= 3) & (step > CHROMA_GAP), 1).otherwise(0)).withColumn("_ramp", F.sum("_step").over(muted).cast("int"))
    out = grey.unionByName(hued.select("palette_id", "idx", "hex", F.lit(1).alias("_k"), "_mean", "_ramp", F.col("_c.l").alias("_l")))
    place = F.row_number().over(by.orderBy("_k", "_mean", "_ramp", "_l", "idx")) - 1
    return out.withColumn("place", place).select("palette_id", "idx", "hex", "place")


def distinct_colors(palette: DataFrame, most: int = tables.MOST_COLORS) -> DataFrame:
    """The first of equal colours, renumbered; empty ones go; the first `most` stay."""
    first = palette.where("hex is not null and hex <> ''").groupBy("palette_id", "hex").agg(F.min("idx").alias("_i"))
    return first.withColumn("idx", F.row_number().over(Window.partitionBy("palette_id").orderBy("_i")) - 1).where(F.col("idx") < most).select("palette_id", "idx", "hex")


def append_colors(palette: DataFrame, more: DataFrame) -> DataFrame:
    """palette, then what is new in more, capped."""
    parts = [p.select("palette_id", F.struct(F.lit(k).alias("part"), F.col("idx").alias("i")).alias("idx"), "hex") for k, p in enumerate((palette, more))]
    return distinct_colors(parts[0].unionByName(parts[1]))


def set_palette(palette: DataFrame, touched: Column | None = None) -> DataFrame:
    """distinct_colors of a palette, with the outline colour it brings: its darkest, or null where one was chosen."""
    rows = distinct_colors(palette)
    outline = darkest(rows).withColumnRenamed("hex", "outline")
    out = rows.join(outline, "palette_id")
    return out if touched is None else out.withColumn("outline", F.when(~touched, F.col("outline")))


def edit_color(palette: DataFrame, place: int, hex_color: str) -> DataFrame:
    """The colour at a place changed; what isn't a colour changes nothing."""
    new = color.normal_hex(F.lit(hex_color))
    return palette.withColumn("hex", F.when((F.col("idx") == place) & new.isNotNull(), new).otherwise(F.col("hex")))


def delete_color(palette: DataFrame, place: int) -> DataFrame:
    """The colour at a place taken out, and later ones moved up."""
    return palette.where(F.col("idx") != place).withColumn("idx", F.when(F.col("idx") > place, F.col("idx") - 1).otherwise(F.col("idx")))


def add_color(palette: DataFrame, first: str = "#888888") -> DataFrame:
    """The last colour once more at the end, or first into an empty palette; a full palette stays. Repeats are meant."""
    ids = palette.groupBy("palette_id").agg(F.max(F.struct("idx", "hex")).alias("l"), F.count("hex").alias("n")).where(F.col("n") < tables.MOST_COLORS)
    more = ids.select("palette_id", (F.coalesce("l.idx", F.lit(-1)) + 1).cast("int").alias("idx"), F.coalesce("l.hex", F.lit(first)).alias("hex"))
    return palette.where("hex is not null").select("palette_id", "idx", "hex").unionByName(more)


def clear_colors(palette: DataFrame, palette_id: str) -> DataFrame:
    """palette without the colours of one."""
    return palette.where(F.col("palette_id") != palette_id)


def pick_into(palette: DataFrame, picked: DataFrame) -> DataFrame:
    """palette with the colours of picked(hex) at the end of each palette that lacks them and isn't full."""
    sizes = palette.groupBy("palette_id").agg(F.max("idx").alias("last"), F.count("*").alias("n")).where(F.col("n") < tables.MOST_COLORS)
    more = sizes.join(F.broadcast(picked.select("hex").distinct()))
    more = more.join(palette.select("palette_id", "hex"), ["palette_id", "hex"], "left_anti")
    place = F.row_number().over(Window.partitionBy("palette_id").orderBy("hex"))
    more = more.withColumn("k", place).where(F.col("n") + F.col("k") <= tables.MOST_COLORS)
    return palette.select("palette_id", "idx", "hex").unionByName(more.select("palette_id", (F.col("last") + F.col("k")).cast("int").alias("idx"), "hex"))


def in_palette(rows: DataFrame, palette: DataFrame, inside: bool = True) -> DataFrame:
    """The rows(palette_id, hex, ...) whose colour is in their palette, or isn't."""
    own = palette.select("palette_id", color.normal_hex(F.col("hex")).alias("_h"), F.col("palette_id").alias("_p"))
    same = (rows["palette_id"] == F.col("_p")) & (color.normal_hex(rows["hex"]) == F.col("_h"))
    return rows.join(own.select("_p", "_h"), same, "left_semi" if inside else "left_anti")


def strips(library: DataFrame, most: int = 8) -> DataFrame:
    """palette_id and the first colours of each, for a list."""
    return as_arrays(library.where(F.col("idx") < most))


def move_color(palette: DataFrame, start: int, end: int) -> DataFrame:
    """The colour at place start taken out and put in at place end."""
    i = F.col("idx")
    between = i.between(min(start, end), max(start, end))
    return palette.withColumn("idx", F.when(i == start, end).when(between, i + (1 if end < start else -1)).otherwise(i))


def mean_spacing(palette: DataFrame) -> DataFrame:
    """palette_id and mean_spacing: the mean distance of colours to their nearest other, in sRGB; 0 for one."""
    a = palette.select("palette_id", "idx", color.from_hex(F.col("hex")).alias("p"))
    b = a.select(F.col("palette_id").alias("of"), F.col("idx").alias("other"), F.col("p").alias("q"))
    d = sum(((F.col(f"p.{c}") - F.col(f"q.{c}")) * (F.col(f"p.{c}") - F.col(f"q.{c}")) for c in "gb"), (F.col("p.r") - F.col("q.r")) * (F.col("p.r") - F.col("q.r")))
    pairs = a.join(b, (F.col("palette_id") == F.col("of")) & (F.col("idx") != F.col("other")), "left").groupBy("palette_id", "idx").agg(F.min(d).alias("d"))
    return pairs.groupBy("palette_id").agg(F.coalesce(F.avg(F.sqrt("d")), F.lit(0.0)).alias("mean_spacing"))


def pairwise(palette: DataFrame) -> DataFrame:
    """palette_id, i, j, distance in OKLab of all pairs i < j of a palette."""
    rgb = color.from_hex(F.col("hex"))
    a = palette.select("palette_id", F.col("idx").alias("i"), color.oklab(rgb["r"], rgb["g"], rgb["b"]).alias("p"))
    b = a.select(F.col("palette_id").alias("of"), F.col("i").alias("j"), F.col("p").alias("q"))
    d = F.sqrt(sum(((F.col(f"p.{c}") - F.col(f"q.{c}")) * (F.col(f"p.{c}") - F.col(f"q.{c}")) for c in "ab"), (F.col("p.l") - F.col("q.l")) * (F.col("p.l") - F.col("q.l"))))
    return a.join(b, (F.col("palette_id") == F.col("of")) & (F.col("i") < F.col("j"))).select("palette_id", "i", "j", d.alias("distance"))


def darkest(palette: DataFrame) -> DataFrame:
    """palette_id and the first of its darkest colours."""
    return palette.groupBy("palette_id").agg(F.min_by("hex", F.struct(color.lightness(F.col("hex")), "idx")).alias("hex"))


def as_arrays(palette: DataFrame) -> DataFrame:
    """palette_id and its colours in order."""
    items = F.array_sort(F.collect_list(F.struct("idx", "hex")))
    return palette.groupBy("palette_id").agg(F.transform(items, lambda p: p["hex"]).alias("colors"))


def to_hex_file(colors: Column) -> Column:
    """One colour a line, upper case, without #."""
    return F.concat(F.array_join(F.transform(colors, lambda c: F.upper(F.regexp_replace(c, "#", ""))), "\n"), F.lit("\n"))


def to_gimp_file(name: Column, colors: Column) -> Column:
    """A GIMP palette; what isn't a colour is left out."""

    def line(c: Column) -> Column:
        rgb = color.from_hex(c)
        return F.concat(F.concat_ws(" ", *[F.lpad(rgb[n].cast("string"), 3, " ") for n in "rgb"]), F.lit("\t"), F.upper(c))

    head = F.array(F.lit("GIMP Palette"), F.concat(F.lit("Name: "), F.coalesce(F.nullif(name, F.lit("")), F.lit("Untitled"))), F.lit("Columns: 0"), F.lit("#"))
    good = F.filter(colors, lambda c: color.from_hex(c).isNotNull())
    return F.concat(F.array_join(F.concat(head, F.transform(good, line)), "\n"), F.lit("\n"))


def file_name(source: Column, palette: Column, extension: str) -> Column:
    """A safe name: lower case, other than letters and digits as single dashes."""

    def part(c: Column, other: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit(other))

    return F.concat(part(source, "image"), F.lit("_"), part(palette, "palette"), F.lit(f".{extension}"))


def _near_links(lab: np.ndarray, size: np.ndarray, threshold: float, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links a < b of colours whose distance is up to the threshold, within runs of size[k] rows of lab, one run a palette.

    at_once: about how many distances are worked out at a time.
    """
    first = np.repeat(np.cumsum(size) - size, size)  # of each row, where its palette begins
    later = np.repeat(np.cumsum(size), size) - np.arange(len(first)) - 1  # and how many follow it there
    out = [(np.zeros(0, dtype=np.int64),) * 2]
    lo, upto = 0, np.cumsum(later)
    while lo < len(later):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + at_once, side="right")))
        a = np.repeat(np.arange(lo, hi), later[lo:hi])
        b = np.arange(len(a)) - np.repeat(np.cumsum(later[lo:hi]) - later[lo:hi], later[lo:hi]) + a + 1
        dl, da, db = ((lab[a, k] - lab[b, k]) ** 2 for k in range(3))
        near = np.sqrt(dl + da + db) <= threshold
        out.append((a[near], b[near]))
        lo = hi
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b


def _merger(threshold: float, schema: pa.Schema):
    """Of rows sorted by palette and idx, what each colour becomes; the palettes of a batch are worked out at once."""

    def merged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        names = rows["palette_id"].combine_chunks().dictionary_encode() if rows.num_rows else None
        of = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        idx = rows["idx"].to_numpy().astype(np.int64)
        lab = np.stack([rows[c].to_numpy().astype(float) for c in ("l", "a", "b")], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        a, b = _near_links(lab, np.diff(np.append(starts, len(of))), threshold)
        apart = idx[a] != idx[b]
        # rows of one idx are one colour of their palette
        same = np.flatnonzero((of[1:] == of[:-1]) & (idx[1:] == idx[:-1]))
        top = links.connected(len(of), np.concatenate([a[apart], same]), np.concatenate([b[apart], same + 1]))
        yield from pa.Table.from_arrays([rows["palette_id"], rows["idx"], pa.array(idx[top], schema.field("becomes").type)], schema=schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the palette that isn't known to be whole
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            last = table["palette_id"][-1].as_py()
            if table["palette_id"][0].as_py() == last:
                if held and held[0]["palette_id"][0].as_py() != last:
                    yield from merged(pa.concat_tables(held))
                    held = []
                held.append(table)
                continue
            names = table["palette_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(names != names[-1])[-1]) + 1
            yield from merged(pa.concat_tables([*held, table.slice(0, cut)]))
            held = [table.slice(cut)]
        if held:
            yield from merged(pa.concat_tables(held))

    return run


def merge_maps(palettes: DataFrame, threshold: float) -> DataFrame:
    """palette_id, idx, becomes: for each colour the first one of its palette that it is linked to by near colours.

    A palette's colours, at most 256, are sorted into one task and compared in batches of whole palettes: no pair of
    colours is a row. Longer ones are compared in parts. Rows without a palette or a place are linked with nothing.
    """
    whole = F.col("palette_id").isNotNull() & F.col("idx").isNotNull()
    linked = palettes.where(whole).select("palette_id", "idx", "hex").repartition("palette_id")  # dealt out before the colours are worked out
    lab = color.let(color.from_hex(F.col("hex")), lambda v: color.oklab(v["r"], v["g"], v["b"]))
    linked = linked.select("palette_id", "idx", lab.alias("_v")).select("palette_id", "idx", *[F.col(f"_v.{c}").alias(c) for c in "lab"])
    linked = linked.sortWithinPartitions("palette_id", "idx")
    fields = [palettes.schema["palette_id"], palettes.schema["idx"], StructField("becomes", palettes.schema["idx"].dataType)]
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    out = linked.mapInArrow(_merger(threshold, to_arrow_schema(schema)), schema)
    return out.unionByName(palettes.where(~whole).select("palette_id", "idx", F.col("idx").alias("becomes")))
