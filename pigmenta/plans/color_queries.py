"""Registered queries of colours, ramps, palettes, presets, files and whole renders, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import staging
from ..functions import color, tables
from ..operators import extract, palettes, presets
from ..sources import images as image_files
from ..sources import palettes as palette_files
from ..sources import store
from . import pipeline
from .registry import ORACLES as ORACLES
from .registry import QUERIES as QUERIES
from .registry import _LABELS, _NEAR, _RGB_OF_PART, SWEETIE, _absorbed, _lab, _library, _library_sql, _pal, _px, _register, _samples, raster_images, raster_pixels

_PARTS = f"parts AS (SELECT *, sqrt(la * la + lb * lb) AS c, CASE WHEN degrees(atan2(lb, la)) < 0 THEN degrees(atan2(lb, la)) + 360 ELSE degrees(atan2(lb, la)) END AS h FROM {_lab('(SELECT p_partkey, p_size, ' + ', '.join(f'({e})::INT AS {n}' for e, n in zip(_RGB_OF_PART, 'rgb', strict=True)) + ' FROM part)')})"


def _level(c: str) -> str:
    return f"least(255.0::DOUBLE, greatest(0.0::DOUBLE, 255.0::DOUBLE * (CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92::DOUBLE ELSE pow(greatest({c}, 0.0::DOUBLE), 1 / 2.4::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END)))"


def _levels(source: str, l: str, a: str, b: str) -> str:  # noqa: E741
    """SQL that adds the levels vr, vg and vb of OKLab colours to the columns of source."""
    cones = ", ".join(f"pow({l} * {m[0]!r}::DOUBLE + {a} * {m[1]!r}::DOUBLE + {b} * {m[2]!r}::DOUBLE, 3) AS _{n}" for m, n in zip(color.LAB_TO_LMS, "xyz", strict=True))
    light = ", ".join(f"_x * {m[0]!r}::DOUBLE + _y * {m[1]!r}::DOUBLE + _z * {m[2]!r}::DOUBLE AS _l{n}" for m, n in zip(color.LMS_TO_LINEAR, "rgb", strict=True))
    return f"(SELECT * EXCLUDE (_x, _y, _z, _lr, _lg, _lb), {', '.join(f'{_level(f"_l{n}")} AS v{n}' for n in 'rgb')} FROM (SELECT *, {light} FROM (SELECT *, {cones} FROM {source})))"


_INSIDE = " AND ".join(f"v{n} > 0.001 AND v{n} < 254.999" for n in "rgb")
_HEX = "'#' || lower(" + " || ".join(f"lpad(to_hex(least(255, greatest(0, floor(v{n} + 0.5)))::INT), 2, '0')" for n in "rgb") + ")"


def _fitted(source: str) -> str:
    """CTEs that fit the colours of source(id, l, c, h): fitted(id, hex), with the chroma halved in on sixteen times."""
    at = lambda rows, c: _levels(rows, "l", f"cos(radians(h)) * {c}", f"sin(radians(h)) * {c}")
    return f"""halves(id, l, c, h, k, lo, hi) AS (
        SELECT id, l, c, h, 0, 0.0::DOUBLE, c FROM {source}
        UNION ALL SELECT id, l, c, h, k + 1, CASE WHEN {_INSIDE} THEN mid ELSE lo END, CASE WHEN {_INSIDE} THEN hi ELSE mid END FROM {at("(SELECT *, (lo + hi) / 2 AS mid FROM halves WHERE k < 16)", "mid")}),
      whole AS (SELECT id, {_INSIDE} AS fits, {_HEX} AS hex FROM {at(source, "c")}),
      narrow AS (SELECT id, {_HEX} AS hex FROM {at("(SELECT * FROM halves WHERE k = 16)", "lo")}),
      fitted AS (SELECT w.id, CASE WHEN fits THEN w.hex ELSE n.hex END AS hex, fits FROM whole w JOIN narrow n ON n.id = w.id)"""


def _part_colors(spark, sf_dir: str) -> DataFrame:
    r, g, b = (F.expr(e).cast("int") for e in _RGB_OF_PART)
    lab = color.oklab(r, g, b)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_name", "p_brand", "p_type")
    parts = parts.repartition(spark.sparkContext.defaultParallelism, "p_partkey")  # one small file: deal its rows out
    return parts.select("*", color.to_hex(r, g, b).alias("hex"), lab.alias("lab")).withColumns({"c": color.chroma(F.col("lab")), "h": color.hue(F.col("lab"))})


@_register(f"WITH RECURSIVE {_PARTS}, asked AS (SELECT p_partkey AS id, ll AS l, c * 1.4::DOUBLE AS c, h FROM parts), {_fitted('asked')} SELECT f.id AS p_partkey, f.hex, fits, round(CASE WHEN fmod(264 - h, 360) > 180 THEN fmod(264 - h, 360) - 360 WHEN fmod(264 - h, 360) < -180 THEN fmod(264 - h, 360) + 360 ELSE fmod(264 - h, 360) END, 6) AS step FROM fitted f JOIN asked a ON a.id = f.id")
def fitted_colors(spark, sf_dir):
    """More vivid colours of parts, brought back to what sRGB holds, and the way of their hues to blue."""
    rows = _part_colors(spark, sf_dir)
    fit = color.fit_to_gamut(F.col("lab.l"), F.col("c") * 1.4, F.col("h"))
    whole = color._at(F.col("lab.l"), F.col("c") * 1.4, F.col("h"))
    rows = rows.select("p_partkey", fit.alias("v"), color._inside(whole).alias("fits"), F.round(color.hue_step(F.col("h"), F.lit(264.0)), 6).alias("step"))
    return rows.select("p_partkey", color.to_hex(*[F.col(f"v.{n}") for n in "rgb"]).alias("hex"), "fits", "step")


def _ramp_at(t: str, hue: str, peak: str, lo: str, hi: str, shift: float) -> str:
    """SQL: l, c and h of a ramp at t."""
    floor = f"({color.SHADOW_CHROMA}::DOUBLE + ({color.HIGHLIGHT_CHROMA - color.SHADOW_CHROMA!r}::DOUBLE) * {t})"
    to = f"(CASE WHEN {t} < 0.5 THEN {color.SHADOW_HUE}::DOUBLE ELSE {color.HIGHLIGHT_HUE}::DOUBLE END)"
    d = f"fmod({to} - {hue}, 360)"
    step = f"(CASE WHEN {d} > 180 THEN {d} - 360 WHEN {d} < -180 THEN {d} + 360 ELSE {d} END)"
    return f"{lo} + ({hi} - {lo}) * {t} AS l, {peak} * ({floor} + (1 - {floor}) * pow(greatest(sin({t} * pi()), 0.0::DOUBLE), {color.SHOULDER}::DOUBLE)) AS c, {hue} + {step} * abs(({t} - 0.5) * 2) * {color.MOST_DRIFT / 180 * shift!r}::DOUBLE AS h"


@_register(f"WITH RECURSIVE {_PARTS}, steps AS (SELECT p_partkey, h AS hue, c AS peak, 1 + p_size % 9 AS n, unnest(range(1 + p_size % 9)) AS i FROM parts), placed AS (SELECT p_partkey * 16 + i AS id, hue, peak, CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE i / (n - 1)::DOUBLE END AS t FROM steps), asked AS (SELECT id, {_ramp_at('t', 'hue', 'peak', '0.2::DOUBLE', '0.9::DOUBLE', 1.0)} FROM placed), {_fitted('asked')} SELECT id // 16 AS p_partkey, (id % 16)::INT AS i, hex FROM fitted")
def ramp_colors(spark, sf_dir):
    """A ramp of one to nine colours for each part."""
    rows = _part_colors(spark, sf_dir).withColumn("n", F.expr("cast(1 + p_size % 9 as int)")).withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    return rows.select("p_partkey", "i", color.ramp_color(F.col("i"), F.col("n"), F.col("h"), F.col("c"), F.lit(0.2), F.lit(0.9), 1.0).alias("hex"))


_HUES = f"""shades AS (SELECT image_id, ll, sqrt(la * la + lb * lb) AS c, degrees(atan2(lb, la)) AS t FROM {_lab('px')} WHERE a >= 8),
      hued AS (SELECT image_id, c, (floor((CASE WHEN t < 0 THEN t + 360 ELSE t END) / 360 * 72) % 72)::INT AS bin FROM shades WHERE c >= {color.NEUTRAL_CHROMA}),
      bins AS (SELECT image_id, bin, sum(c) AS weight FROM hued GROUP BY image_id, bin),
      smooth AS (SELECT image_id, (bin + d + 72) % 72 AS bin, sum(weight * w) AS weight FROM bins CROSS JOIN (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)) taps(d, w) GROUP BY ALL),
      peaks AS (SELECT image_id, least(0.22::DOUBLE, greatest(0.06::DOUBLE, sum(c) / count(*) * 1.9)) AS peak FROM hued GROUP BY image_id),
      wheel AS (SELECT i.image_id, list(coalesce(weight, 0.0::DOUBLE) ORDER BY b) AS v FROM (SELECT DISTINCT image_id FROM smooth) i CROSS JOIN range(72) r(b) LEFT JOIN smooth s ON s.image_id = i.image_id AND s.bin = b GROUP BY i.image_id),
      found(image_id, k, v, hue) AS (
        SELECT image_id, 0, v, NULL::DOUBLE FROM wheel
        UNION ALL
        SELECT image_id, k + 1, list_transform(v, lambda x, i: CASE WHEN least((i - 1 - top + 72) % 72, (top - i + 1 + 72) % 72) <= 4 THEN 0.0::DOUBLE ELSE x END), CASE WHEN turn < 0 THEN turn + 360 ELSE turn END FROM (
          SELECT *, degrees(atan2(list_sum(list_transform(range(-2, 3), lambda d: sin(radians(((top + d + 72) % 72 + 0.5::DOUBLE) / 72 * 360)) * v[(top + d + 72) % 72 + 1])), list_sum(list_transform(range(-2, 3), lambda d: cos(radians(((top + d + 72) % 72 + 0.5::DOUBLE) / 72 * 360)) * v[(top + d + 72) % 72 + 1])))) AS turn
          FROM (SELECT *, list_position(v, list_max(v)) - 1 AS top FROM found WHERE k < 5 AND list_max(v) > 0)))"""


@_register(f"WITH RECURSIVE {_px()}, {_HUES} SELECT image_id, k AS place, round(hue, 6) AS hue FROM found WHERE k > 0")
def dominant_hues(spark, sf_dir):
    """The five strongest hues of each image."""
    rows = extract.dominant_hues(_samples(spark, sf_dir), 5).select("image_id", F.posexplode("hues").alias("k", "hue"))
    return rows.select("image_id", (F.col("k") + 1).alias("place"), F.round("hue", 6).alias("hue"))


#: Of the query theory_palette: ramps by the triadic scheme.
ORACLES["theory_palette"] = f"""WITH RECURSIVE {_px()}, {_HUES},
      ends AS (SELECT image_id, min(ll) AS lo, max(ll) AS hi FROM shades GROUP BY image_id),
      light AS (SELECT image_id, CASE WHEN hi - lo < 0.25 THEN greatest(0.0::DOUBLE, lo - 0.15) ELSE lo END AS lo, CASE WHEN hi - lo < 0.25 THEN least(1.0::DOUBLE, hi + 0.15) ELSE hi END AS hi FROM ends),
      ramps AS (SELECT image_id, 0 AS r, 0.0::DOUBLE AS hue, 0.0::DOUBLE AS peak FROM light
        UNION ALL SELECT l.image_id, t.k, fmod(coalesce(f.hue, 0.0::DOUBLE) + turn, 360), coalesce(peak, 0.11::DOUBLE) FROM light l CROSS JOIN (VALUES (1, 0), (2, 120), (3, 240)) t(k, turn) LEFT JOIN found f ON f.image_id = l.image_id AND f.k = 1 LEFT JOIN peaks p ON p.image_id = l.image_id),
      steps AS (SELECT r.image_id, r, i, hue, peak, lo, hi, i / 5.0::DOUBLE AS t FROM ramps r JOIN light l ON l.image_id = r.image_id CROSS JOIN range(6) s(i)),
      tinted AS (SELECT image_id * 64 + r * 8 + i AS id, {_ramp_at('t', 'hue', 'peak', 'lo', 'hi', 1.0)} FROM steps WHERE r > 0),
      plain AS (SELECT image_id * 64 + r * 8 + i AS id, {_ramp_at('t', 'hue', 'peak', 'lo', 'hi', 0.0)} FROM steps WHERE r = 0),
      asked AS (SELECT * FROM tinted UNION ALL SELECT * FROM plain), {_fitted('asked')},
      firsts AS (SELECT id // 64 AS palette_id, hex, min(id) AS id FROM fitted GROUP BY ALL)
      SELECT palette_id, (row_number() OVER (PARTITION BY palette_id ORDER BY id) - 1)::INT AS idx, hex FROM firsts"""


def _edited(rows: DataFrame) -> DataFrame:
    return palettes.add_color(palettes.edit_color(palettes.delete_color(palettes.move_color(rows, 2, 5), 0), 3, "#ABC"))


@_register(f"""WITH {_library_sql()}, moved AS (SELECT palette_id, CASE WHEN idx = 2 THEN 5 WHEN idx BETWEEN 3 AND 5 THEN idx - 1 ELSE idx END AS idx, hex FROM lib),
      cut AS (SELECT palette_id, idx - 1 AS idx, CASE WHEN idx - 1 = 3 THEN '#aabbcc' ELSE hex END AS hex FROM moved WHERE idx <> 0),
      last AS (SELECT palette_id, max(idx) + 1 AS idx, arg_max(hex, idx) AS hex FROM cut GROUP BY palette_id)
      SELECT palette_id, idx, hex FROM cut UNION ALL SELECT * FROM last""")
def edited_palettes(spark, sf_dir):
    """A colour moved, the first one taken out, one changed, the last one repeated, in palettes of six colours or more."""
    return _edited(_library(spark, sf_dir)).select("palette_id", "idx", "hex")


_LONG = "sizes AS (SELECT palette_id, count(*) AS n FROM lib GROUP BY palette_id)"


@_register(f"WITH {_library_sql()}, pooled AS (SELECT palette_id, 0 AS part, idx, hex FROM lib UNION ALL SELECT b.palette_id, 1, l.idx, l.hex FROM (SELECT DISTINCT palette_id FROM lib) b CROSS JOIN lib l WHERE l.palette_id = 'Sweetie 16'), firsts AS (SELECT palette_id, hex, min({{'part': part, 'idx': idx}}) AS place FROM pooled GROUP BY palette_id, hex) SELECT palette_id, (row_number() OVER (PARTITION BY palette_id ORDER BY place) - 1)::INT AS idx, hex FROM firsts QUALIFY idx < 256")
def appended_palettes(spark, sf_dir):
    """Every palette with the colours of one that it lacks."""
    rows = _library(spark, sf_dir)
    colors = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(h).alias("hex")) for i, h in enumerate(tables.PALETTES[SWEETIE])])
    return palettes.append_colors(rows, rows.select("palette_id").distinct().select("palette_id", F.inline(colors)))


@_register(f"WITH {_library_sql()}, doubled AS (SELECT palette_id, idx AS k, hex FROM lib UNION ALL SELECT palette_id, idx + 300, hex FROM lib UNION ALL SELECT palette_id, -1, '' FROM lib WHERE idx = 0), firsts AS (SELECT palette_id, hex, min(k) AS k FROM doubled WHERE hex <> '' GROUP BY ALL), kept AS (SELECT palette_id, (row_number() OVER (PARTITION BY palette_id ORDER BY k) - 1)::INT AS idx, hex FROM firsts), shown AS (SELECT palette_id, arg_min(hex, {{'l': ll, 'i': idx}}) AS outline FROM {_lab('rgb')} GROUP BY palette_id) SELECT k.palette_id, idx, hex, outline FROM kept k JOIN shown s ON s.palette_id = k.palette_id")
def set_palettes(spark, sf_dir):
    """Palettes put in place of what was there: repeats and empty colours go, the darkest is the outline."""
    rows = _library(spark, sf_dir)
    rows = rows.unionByName(rows.withColumn("idx", F.col("idx") + 300)).unionByName(rows.where("idx = 0").select("palette_id", F.lit(-1).alias("idx"), F.lit("").alias("hex")))
    return palettes.set_palette(rows).select("palette_id", "idx", "hex", "outline")


@_register(f"WITH {_library_sql()} SELECT palette_id, string_agg(hex, ',' ORDER BY idx) AS colors FROM lib WHERE palette_id LIKE 'part %' AND idx < 9 GROUP BY palette_id")
def table_files(spark, sf_dir):
    """Adobe colour tables that declare up to nine colours, read back."""
    rows = palettes.as_arrays(_library(spark, sf_dir).where("palette_id like 'part %'"))
    digits = F.rpad(F.array_join(F.transform("colors", lambda c: F.substring(c, 2, 6)), ""), 256 * 6, "0")
    return rows.select("palette_id", F.array_join(palette_files.parse_act(F.unhex(F.concat(digits, F.lpad(F.hex(F.least(F.size("colors"), F.lit(9))), 4, "0"), F.lit("0000")))), ",").alias("colors"))


_NINE = "(SELECT palette_id, string_agg(hex, ',' ORDER BY idx) AS colors FROM lib WHERE palette_id LIKE 'part %' GROUP BY palette_id)"


@_register(f"WITH {_library_sql()} SELECT palette_id, colors FROM {_NINE}")
def parse_more_palettes(spark, sf_dir):
    """JSON as strings, triples and objects, and lines of numbers with a byte order mark, by turns."""
    rows = palettes.as_arrays(_library(spark, sf_dir).where("palette_id like 'part %'")).withColumn("k", F.expr("cast(substring(palette_id, 6) as int) % 5"))
    rgb = F.transform("colors", color.from_hex)
    as_json = F.when(F.col("k") == 0, F.to_json("colors")).when(F.col("k") == 1, F.to_json(F.transform(rgb, lambda v: F.array(v["r"], v["g"], v["b"])))).when(F.col("k") == 2, F.to_json(F.struct(rgb.alias("palette"))))
    lines = F.array_join(F.transform(rgb, lambda v: F.concat_ws(", ", v["r"], v["g"], v["b"])), "\n")
    text = F.coalesce(as_json, F.when(F.col("k") == 3, F.to_json(F.struct("colors"))), F.concat(F.lit("﻿"), lines))
    return rows.select("palette_id", F.array_join(palette_files.parse_text(text, F.lit("x.txt"))["colors"], ",").alias("colors"))


@_register("SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1) THEN 'image' WHEN p_partkey % 6 = 2 THEN 'act' WHEN p_partkey % 6 = 3 THEN 'backup' ELSE 'text' END AS kind FROM part")
def file_kinds(spark, sf_dir):
    """How files named after parts are read."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (".PNG", ".jpeg", ".Act", ".json", ".json", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 6 == 3, '{"format": "saved", "presets": []}').otherwise('["#112233"]')
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", palette_files.kind_of(F.concat("p_name", ends), text).alias("kind"))


@_register(f"WITH {_library_sql()}, said AS (SELECT p_partkey, p_size, p_name, '#' || lower({' || '.join(f'''lpad(to_hex(({e})::INT), 2, '0')''' for e in _RGB_OF_PART)}) AS hex FROM part) SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Untitled' ELSE substr(p_name, 1, 40) END AS name, CASE WHEN p_size % 3 = 0 THEN hex || ',' || hex ELSE hex END AS colors FROM said WHERE p_size % 5 <> 0")
def cleaned_palettes(spark, sf_dir):
    """Palettes of a backup: names trimmed, colours in one form, repeats kept, those without colours gone."""
    rows = _part_colors(spark, sf_dir)
    colors = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("blue"))).when(F.col("p_size") % 3 == 0, F.array(F.upper("hex"), F.lit("x"), F.col("hex"))).otherwise(F.array(F.substring("hex", 2, 6)))
    raw = rows.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"), colors.alias("colors"))
    return presets.clean_palettes(raw).select(F.col("ord").alias("p_partkey"), "name", F.array_join("colors", ",").alias("colors"))


@_register("WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, n || CASE WHEN n = 1 THEN ' part' ELSE ' parts' END AS label FROM n")
def count_labels(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.count("*").alias("n"))
    return rows.select("p_brand", color.count_label(F.col("n"), "part", "parts").alias("label"))


def _saved(spark, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    settings = F.create_map(F.lit("pm-speck"), F.col("s_nationkey").cast("string"), F.lit("pm-dither"), F.when(F.col("s_acctbal") < 0, "none").otherwise("fs"))
    return s.select(F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), settings.alias("settings"))


@_register("SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT 'b-' || s_suppkey, s_name FROM supplier WHERE s_suppkey < 5")
def deleted_presets(spark, sf_dir):
    """A saved preset deleted; built-in ones stay."""
    rows = _saved(spark, sf_dir).select("id", "name")
    rows = rows.unionByName(rows.where("cast(id as int) < 5").select(F.concat(F.lit("b-"), "id").alias("id"), "name"))
    return presets.delete_by_id(presets.delete_by_id(rows, "3"), "b-1")


@_register("SELECT s_name AS name, CASE WHEN s_suppkey = 2 THEN '99' ELSE s_nationkey::VARCHAR END AS speck FROM supplier UNION ALL SELECT 'A new one', '7'")
def saved_presets(spark, sf_dir):
    """One preset saved over the one of its name in other letters, and one saved as new."""
    rows = _saved(spark, sf_dir)
    one = rows.where("ord = 2").select(F.upper("name").alias("name"), F.create_map(F.lit("pm-speck"), F.lit("99")).alias("settings"))
    rows = presets.save(rows, one, ["settings"])
    new = rows.limit(1).select(F.lit("A new one").alias("name"), F.create_map(F.lit("pm-speck"), F.lit("7")).alias("settings"))
    names = _saved(spark, sf_dir).select(F.lower("name").alias("_n"), F.col("name").alias("_name"))
    rows = presets.save(rows, new, ["settings"]).join(names, F.lower("name") == F.col("_n"), "left")
    return rows.select(F.coalesce("_name", "name").alias("name"), F.element_at("settings", "pm-speck").alias("speck"))


@_register("SELECT count(*) FILTER (s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0) AS added, count(*) FILTER (s_suppkey % 6 = 0) AS updated, (count(*) FILTER (s_suppkey % 7 = 0))::INT AS skipped FROM supplier")
def import_counts(spark, sf_dir):
    rows = _saved(spark, sf_dir)
    merged = presets.merge_by_name(rows.where("ord % 2 = 0"), rows.where("ord % 3 = 0").drop("id"), ["settings"])
    given = rows.where("ord % 3 = 0").count()
    return presets.tally(merged, given + rows.where("ord % 7 = 0").count(), given)


@_register("SELECT s_name AS name, s_nationkey::VARCHAR AS speck, CASE WHEN s_acctbal < 0 THEN 'none' ELSE 'fs' END AS dither FROM supplier")
def backup_round_trip(spark, sf_dir):
    """Saved presets written as a backup and read again."""
    rows = _saved(spark, sf_dir).withColumns({"palette": F.lit(None).cast("struct<name:string,colors:array<string>>"), "outline_touched": F.lit(False)})
    none = spark.createDataFrame([], "ord long, id string, name string, colors array<string>")
    text = presets.backup(rows, none, "saved", F.current_timestamp())
    back = presets.clean_presets(presets.read_backup(text)[0])
    return back.select("name", F.element_at("settings", "pm-speck").alias("speck"), F.element_at("settings", "pm-dither").alias("dither"))


@_register(f"WITH {_library_sql()} SELECT palette_id, idx, hex FROM lib")
def kept_palettes(spark, sf_dir):
    """The library kept in a folder, replaced by one made from itself, and read again."""
    folder = staging.folder(spark)
    store.keep(_library(spark, sf_dir).where("idx < 4"), folder, store.LIBRARY)
    before = store.kept(spark, folder, store.LIBRARY)
    store.keep(before.unionByName(_library(spark, sf_dir).where("idx >= 4")), folder, store.LIBRARY)
    return store.kept(spark, folder, store.LIBRARY)


@_register(f"WITH {_px()} SELECT 'image-' || image_id || '_sweetie-16' AS name, count(*) AS n, {', '.join(f'sum({c} * (y * 50 + x))::BIGINT AS {c}' for c in 'rgba')} FROM px GROUP BY image_id")
def picture_files(spark, sf_dir):
    """Images written as files of a folder, and read from there."""
    folder = staging.folder(spark)
    pixels = raster_pixels(spark, sf_dir)
    names = pixels.select("image_id").distinct().select("image_id", F.concat(F.lit("Image "), "image_id").alias("source"), F.lit(SWEETIE).alias("palette"))
    store.write_pngs(pixels, names, folder, 16)
    names = image_files.read_files(spark, folder).select("image_id", "name")
    rows = image_files.read_pixels(spark, folder).groupBy("image_id").agg(F.count("*").alias("n"), *[F.sum((F.col(c) * (F.col("y") * 50 + F.col("x"))).cast("long")).alias(c) for c in "rgba"])
    return rows.join(names, "image_id").drop("image_id")


def _denoised(radius: int) -> str:
    return f"SELECT p.image_id, p.y, p.x, p.a, {', '.join(f'CASE WHEN p.a = 0 THEN 0 ELSE list_sort(list(q.{c}) FILTER (WHERE q.a > 0))[count(*) FILTER (WHERE q.a > 0) // 2 + 1] END AS {c}' for c in 'rgb')} FROM px p JOIN px q ON p.image_id = q.image_id AND q.y BETWEEN p.y - {radius} AND p.y + {radius} AND q.x BETWEEN p.x - {radius} AND p.x + {radius} GROUP BY p.image_id, p.y, p.x, p.a"


#: CTEs from px to smoothed: medians, nearest colours in OKLab, stipple.
_SMOOTHED = f"""{_px()}, calm AS ({_denoised(1)}), {_pal(SWEETIE)}, {_NEAR},
      raw AS (SELECT p.image_id, p.y, p.x, arg_min(c.idx, {{'d': (p.ll - c.ll) * (p.ll - c.ll) + (p.la - c.la) * (p.la - c.la) + (p.lb - c.lb) * (p.lb - c.lb), 'i': c.idx}}) AS idx FROM {_lab('calm')} p CROSS JOIN {_lab('pal')} c WHERE p.a >= 8 GROUP BY p.image_id, p.y, p.x),
      votes AS (SELECT p.image_id, p.y, p.x, q.idx AS v FROM raw p JOIN raw q ON p.image_id = q.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND (q.y <> p.y OR q.x <> p.x) GROUP BY ALL HAVING count(*) >= 5),
      smoothed AS (SELECT m.image_id, m.y, m.x, CASE WHEN v.v <> m.idx AND n.d <= 0.24 THEN v.v ELSE m.idx END AS idx FROM raw m LEFT JOIN votes v USING (image_id, y, x) LEFT JOIN near n ON n.i = m.idx AND n.j = v.v)"""

ORACLES["render_images"] = f"""WITH RECURSIVE {_SMOOTHED},
      same(i, j) AS (SELECT idx, idx FROM pal UNION SELECT r.i, n.j FROM same r JOIN near n ON n.i = r.j WHERE n.d <= 0.04), merged AS (SELECT i, min(j) AS j FROM same GROUP BY i),
      mapped AS (SELECT image_id, y, x, j AS idx FROM smoothed JOIN merged ON i = idx){_LABELS}{_absorbed(4, 0.24)},
      grown AS (SELECT p.image_id, p.y, p.x, coalesce(b.root, -1) AS l, b.idx[b.root + 1] AS idx FROM px p LEFT JOIN labels l USING (image_id, y, x) LEFT JOIN became b ON b.image_id = l.image_id AND b.label = l.label),
      edges AS (SELECT DISTINCT p.image_id, CASE WHEN p.l < 0 THEN q.y ELSE p.y END AS y, CASE WHEN p.l < 0 THEN q.x ELSE p.x END AS x FROM grown p JOIN grown q ON q.image_id = p.image_id AND ((q.y = p.y AND q.x = p.x + 1) OR (q.x = p.x AND q.y = p.y + 1)) WHERE p.l <> q.l)
      SELECT g.image_id, g.y::INT AS y, g.x::INT AS x, {', '.join(f'CASE WHEN e.y IS NOT NULL OR g.l < 0 THEN 0 ELSE c.{c} END AS {c}' for c in 'rgb')}, CASE WHEN g.l < 0 THEN 0 ELSE 255 END AS a
      FROM grown g LEFT JOIN edges e ON e.image_id = g.image_id AND e.y = g.y AND e.x = g.x LEFT JOIN pal c ON c.idx = g.idx"""


@_register(f"""WITH RECURSIVE {_SMOOTHED}, mapped AS (SELECT * FROM smoothed){_LABELS}{_absorbed(4, 0.24)},
      painted AS (SELECT l.image_id, b.idx[b.root + 1] AS idx FROM labels l JOIN became b ON b.image_id = l.image_id AND b.label = l.label)
      SELECT image_id, r, g, b, 255 AS a, count(*) AS n FROM painted JOIN pal USING (idx) GROUP BY ALL
      UNION ALL SELECT image_id, 0, 0, 0, 0, count(*) FROM px WHERE a < 8 GROUP BY image_id""")
def count_colors_of_render(spark, sf_dir):
    """A whole render with a kept median, twice: as often as each colour is there."""
    o = pipeline.Options(metric="oklab", denoise=1, speck=4, tolerance=0.6, smooth_stipple=True)
    rows = pipeline.render(raster_pixels(spark, sf_dir), raster_images(spark, sf_dir), SWEETIE, o, cache=staging.folder(spark))
    return rows.groupBy("image_id", "r", "g", "b", "a").agg(F.count("*").alias("n"))


def _median_cut(count: int) -> str:
    """CTEs from samples(image_id, ord, r, g, b) to boxes(image_id, box, ...): the widest box halved until there are count."""
    spans = ", ".join(f"max({c}) OVER w - min({c}) OVER w AS s{c}" for c in "rgb")
    return f"""cuts(image_id, step, box, pos, ord, r, g, b) AS (
        SELECT image_id, 1, 0, row_number() OVER (PARTITION BY image_id ORDER BY ord), ord, r, g, b FROM samples
        UNION ALL
        SELECT image_id, step + 1, CASE WHEN box > target OR (box = target AND place > n // 2) THEN box + 1 ELSE box END, place, ord, r, g, b FROM (
          SELECT *, CASE WHEN box = target THEN row_number() OVER (PARTITION BY image_id, box ORDER BY CASE axis WHEN 0 THEN r WHEN 1 THEN g ELSE b END, pos) ELSE pos END AS place FROM (
            SELECT *, min(CASE WHEN span = widest THEN box END) OVER (PARTITION BY image_id) AS target FROM (
              SELECT *, max(span) OVER (PARTITION BY image_id) AS widest FROM (
                SELECT *, CASE WHEN n < 2 THEN -1 ELSE greatest(sr, sg, sb) END AS span, CASE WHEN sr >= sg AND sr >= sb THEN 0 WHEN sg >= sb THEN 1 ELSE 2 END AS axis FROM (
                  SELECT *, count(*) OVER w AS n, {spans} FROM cuts WHERE step < {count} WINDOW w AS (PARTITION BY image_id, box)) a) b) c) d WHERE widest > 0) e),
      boxes AS (SELECT * FROM cuts QUALIFY step = max(step) OVER (PARTITION BY image_id))"""


def _rounds(count: int) -> str:
    """CTEs c0 to c<count> of centres in OKLab: the means of what is nearest to each before, single precision."""
    out = [f"points AS MATERIALIZED (SELECT image_id, ord, ll::FLOAT::DOUBLE AS l, la::FLOAT::DOUBLE AS a, lb::FLOAT::DOUBLE AS b FROM {_lab('samples')})",
           f"c0 AS MATERIALIZED (SELECT image_id, box AS k, ll::FLOAT::DOUBLE AS l, la::FLOAT::DOUBLE AS a, lb::FLOAT::DOUBLE AS b FROM {_lab('(SELECT image_id, box, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM boxes GROUP BY image_id, box)')})"]
    for i in range(count):
        d = "(p.l - c.l) * (p.l - c.l) + (p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b)"
        out.append(f"""c{i + 1} AS MATERIALIZED (
        SELECT c.image_id, c.k, coalesce(m.l, c.l) AS l, coalesce(m.a, c.a) AS a, coalesce(m.b, c.b) AS b FROM c{i} c LEFT JOIN (
          SELECT image_id, k, avg(l)::FLOAT::DOUBLE AS l, avg(a)::FLOAT::DOUBLE AS a, avg(b)::FLOAT::DOUBLE AS b FROM (
            SELECT p.image_id, p.ord, any_value(p.l) AS l, any_value(p.a) AS a, any_value(p.b) AS b, arg_min(c.k, {{'d': {d}, 'k': c.k}}) AS k FROM points p JOIN c{i} c ON c.image_id = p.image_id GROUP BY p.image_id, p.ord) n
          GROUP BY image_id, k) m ON m.image_id = c.image_id AND m.k = c.k)""")
    return ",\n      ".join(out)


ORACLES["extract_palette"] = f"""WITH RECURSIVE {_px()}, samples AS (SELECT image_id, y * 50 + x AS ord, r, g, b FROM px WHERE a >= 8), {_median_cut(16)},
      {_rounds(extract.LLOYD_ROUNDS)},
      shades AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY l, k) AS n, {_HEX} AS hex FROM {_levels(f"c{extract.LLOYD_ROUNDS}", "l", "a", "b")}),
      firsts AS (SELECT image_id, hex, min(n) AS n FROM shades GROUP BY image_id, hex)
      SELECT image_id AS palette_id, (row_number() OVER (PARTITION BY image_id ORDER BY n) - 1)::INT AS idx, hex FROM firsts"""


def _diffused(amount: float = 1.0) -> str:
    """CTEs from px, of images of 50 columns, to mapped: each pixel takes its row's errors and hands its own on."""
    colors = "[" + ", ".join(f"{{'r': {r}, 'g': {g}, 'b': {b}}}" for r, g, b in tables.rgb_list(SWEETIE)) + "]"
    level = lambda c: f"trunc(least(255.0::DOUBLE, greatest(0.0::DOUBLE, v{c})))::BIGINT"
    far = " + ".join(f"({level(c)} - e.{c}) * ({level(c)} - e.{c})" for c in "rgb")
    added = lambda places: "CASE i " + " ".join(f"WHEN spot + {3 * step} * dir + {k} THEN (x + e{c} * {share}::DOUBLE)::FLOAT" for step, share in places for k, c in enumerate("rgb")) + " ELSE x END"
    return f"""ordered AS MATERIALIZED (SELECT image_id, y * 50 + CASE WHEN y % 2 = 1 THEN 49 - x ELSE x END AS k, y, x, r, g, b, a FROM px),
      walk(image_id, k, y, x, idx, cur, below) AS (
        SELECT DISTINCT image_id, -1::BIGINT, -1::BIGINT, -1::BIGINT, NULL::BIGINT, list_transform(range(156), lambda i: 0::FLOAT), list_transform(range(156), lambda i: 0::FLOAT) FROM px
        UNION ALL
        SELECT image_id, k, y, x, CASE WHEN a >= 8 THEN best END,
          CASE WHEN a >= 8 THEN list_transform(cur, lambda x, i: {added([(1, 0.4375)])}) ELSE cur END,
          CASE WHEN a >= 8 THEN list_transform(below, lambda x, i: {added([(-1, 0.1875), (0, 0.3125), (1, 0.0625)])}) ELSE below END
        FROM (
          SELECT *, {", ".join(f"(v{c} - ({colors})[best + 1].{c}) * {amount}::DOUBLE AS e{c}" for c in "rgb")} FROM (
            SELECT *, list_min(list_transform({colors}, lambda e, j: ({far}) * 256 + j - 1)) % 256 AS best FROM (
              SELECT *, {", ".join(f"{c} + cur[spot + {k}] AS v{c}" for k, c in enumerate("rgb"))} FROM (
                SELECT o.image_id, o.k, o.y, o.x, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b, a, 3 * (o.x + 1) + 1 AS spot, CASE WHEN o.y % 2 = 1 THEN -1 ELSE 1 END AS dir,
                  CASE WHEN o.y > w.y THEN below ELSE cur END AS cur, CASE WHEN o.y > w.y THEN list_transform(below, lambda x: 0::FLOAT) ELSE below END AS below
                FROM walk w JOIN ordered o ON o.image_id = w.image_id AND o.k = w.k + 1) p) q) s) t),
      mapped AS (SELECT image_id, y, x, idx FROM walk WHERE k >= 0)"""


ORACLES["dither_diffusion"] = f"WITH RECURSIVE {_px()}, {_diffused()} SELECT image_id, idx, count(*) AS n, sum(y * 50 + x)::BIGINT AS places FROM mapped WHERE idx IS NOT NULL GROUP BY image_id, idx"
