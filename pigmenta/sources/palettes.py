"""Palette files: text formats told apart by content, Adobe colour tables, backups.

The patterns of lines and headers are fixed by the file formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, tables

def _triple(m: Column, groups: tuple[int, int, int], pattern: str) -> Column:
    return color.to_hex(*[F.regexp_extract(m, pattern, g).cast("int") for g in groups])


# Three numbers that begin a line, and three that are all of it.
_INTS = r"^\s*(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})"
_LINE = r"^\s*(\d{1,3})[\s,]+(\d{1,3})[\s,]+(\d{1,3})\s*$"


def _from_lines(lines: Column, pattern: str) -> Column:
    return F.transform(F.filter(lines, lambda s: s.rlike(pattern)), lambda s: _triple(s, (1, 2, 3), pattern))


def _from_json(text: Column) -> Column:
    """Colours of a JSON array, or of the member colors or palette: strings, triples, or objects with r, g and b."""
    body = F.when(text.startswith("["), text).otherwise(F.coalesce(F.get_json_object(text, "$.colors"), F.get_json_object(text, "$.palette")))
    items = F.from_json(body, "array<string>")

    def one(v: Column) -> Column:
        n = F.from_json(v, "array<double>")
        o = [F.get_json_object(v, f"$.{c}").try_cast("double") for c in "rgb"]
        triple = F.when(F.size(n) >= 3, color.to_hex(F.get(n, 0), F.get(n, 1), F.get(n, 2)))
        return F.coalesce(color.normal_hex(v), F.when(v.startswith("["), triple), F.when(v.startswith("{"), color.to_hex(*o)))

    return F.filter(F.transform(items, one), lambda c: c.isNotNull())


def parse_text(text: Column, name: Column) -> Column:
    """struct(name, colors): GIMP, JASC, JSON, else hex codes anywhere in the text, else lines of three numbers.

    A JSON text without colours is searched like any other. Colours are distinct and at most 256.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"^\s+|\s+$", ""))
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]+$", "")
    lines = F.split(body, "\r?\n")
    gimp = F.filter(lines, lambda s: ~s.rlike(r"^[#\s]*$") & ~s.rlike("(?i)^(Columns|Name):"))
    titles = F.filter(F.transform(F.filter(lines, lambda s: s.rlike("(?i)^Name:")), lambda s: F.trim(F.regexp_replace(s, r"(?i)^Name:\s*", ""))), lambda s: s != "")
    none = F.array().cast("array<string>")
    is_gimp, is_jasc, is_json = body.rlike("(?i)^GIMP Palette"), body.rlike("(?i)^JASC-PAL"), body.rlike(r"^[\[{]")
    named = F.when(is_gimp, _from_lines(gimp, _INTS)).when(is_jasc, _from_lines(F.slice(lines, 4, 1_000_000), _INTS)).when(is_json, F.coalesce(_from_json(body), none)).otherwise(none)
    scraped = F.transform(F.regexp_extract_all(body, F.lit(r"#?\b[0-9a-fA-F]{6}\b"), 0), color.normal_hex)
    colors = F.when(F.size(named) > 0, named).when(F.size(scraped) > 0, scraped).otherwise(_from_lines(lines, _LINE))
    title = F.when(is_gimp, F.coalesce(F.element_at(F.when(F.size(titles) > 0, titles), -1), stem)).when(is_json & body.startswith("{"), F.coalesce(F.nullif(F.get_json_object(body, "$.name"), F.lit("")), stem)).otherwise(stem)
    return F.struct(title.alias("name"), F.slice(F.array_distinct(F.filter(colors, lambda c: c.isNotNull())), 1, tables.MOST_COLORS).alias("colors"))


def parse_act(content: Column) -> Column:
    """The distinct colours of an Adobe colour table: 256 triples, or as many as its last bytes declare."""
    declared = F.conv(F.hex(F.substring(content, 769, 2)), 16, 10).cast("int")
    n = F.when((F.octet_length(content) >= 772) & declared.between(1, 256), declared).otherwise(256)
    n = F.least(n, F.floor(F.octet_length(content) / 3).cast("int"))
    one = lambda i: F.concat(F.lit("#"), F.lower(F.hex(F.substr(content, i * 3 + 1, F.lit(3)))))
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), one))).otherwise(F.array().cast("array<string>"))


def is_backup(text: Column, marker: str | None = None) -> Column:
    """Whether a JSON text has a list of presets or of palettes, and the format that marker names, if one is given."""
    both = F.coalesce(F.get_json_object(text, "$.presets"), F.get_json_object(text, "$.palettes"))
    marked = F.get_json_object(text, "$.format") == marker if marker else F.get_json_object(text, "$.format").isNotNull()
    return F.coalesce(marked & both.startswith("["), F.lit(False))


def kind_of(path: Column, text: Column | None = None, marker: str | None = None) -> Column:
    """How a file is read: image, act, backup or text. A text that was pasted has no path and is text."""
    low = F.lower(F.coalesce(path, F.lit("")))
    kind = F.when(low.rlike(r"\.(png|jpe?g|gif|bmp|webp)$"), "image").when(low.endswith(".act"), "act")
    return (kind if text is None else kind.when(is_backup(text, marker), "backup")).otherwise("text")


def pasted(texts: DataFrame) -> DataFrame:
    """name and colors of the pasted texts(text) in which there are two colours at least."""
    parsed = parse_text(F.col("text"), F.lit("Pasted"))
    return texts.select(parsed.alias("p")).select("p.*").where(F.size("colors") >= 2)


def read_palettes(spark: SparkSession, path: str, marker: str | None = None) -> DataFrame:
    """path, kind (act, backup or text), name, colors and, of backups, the text of the palette files of a folder.

    operators.presets.read_backup makes presets and palettes of a backup's text. Images are left out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    act, text = F.lower("path").endswith(".act"), F.decode("content", "UTF-8")
    name = F.regexp_extract("path", "[^/]*$", 0)
    parsed = parse_text(text, name)
    kind = kind_of(F.col("path"), text, marker)
    out = files.where(kind != "image").select("path", kind.alias("kind"), F.when(kind == "backup", text).alias("text"), F.when(act, F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(parsed["name"]).alias("name"), F.when(act, parse_act(F.col("content"))).otherwise(parsed["colors"]).alias("colors"))
    return out.withColumn("colors", F.when(F.col("kind") == "backup", F.array().cast("array<string>")).otherwise(F.col("colors")))
