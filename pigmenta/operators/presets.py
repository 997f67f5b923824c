"""Presets and palette libraries: cleaning of imported rows, merging by name, saving, applying, backups.

Rows are in the order of ord, which is any number; new rows go before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, tables

# The settings that a preset may have.
SETTINGS = [
    "pm-metric", "pm-dither", "pm-dither-amt", "pm-pixel", "pm-smooth", "pm-alpha-cut",
    "pm-black-point", "pm-white-point", "pm-brightness", "pm-contrast", "pm-saturation", "pm-gamma",
    "pm-denoise", "pm-speck", "pm-tolerance", "pm-smooth-stipple",
    "pm-merge-colors", "pm-outline", "pm-outline-color", "pm-outline-width", "pm-outline-min",
    "pm-export-scale", "pm-export-full",
]
NAME_LENGTH = 40
#: What merging by name replaces in presets and in palettes.
PRESET_VALUES, PALETTE_VALUES = ["settings", "palette", "outline_touched"], ["colors"]


def clean_colors(colors: Column) -> Column:
    """Normal hex of what is a colour, the first 256; repeats stay."""
    return F.slice(F.filter(F.transform(colors, color.normal_hex), lambda c: c.isNotNull()), 1, tables.MOST_COLORS)


def clean_name(name: Column, other: str | None = None) -> Column:
    short = F.nullif(F.substring(F.trim(name), 1, NAME_LENGTH), F.lit(""))
    return F.coalesce(short, F.lit(other)) if other else short


def clean_palettes(raw: DataFrame) -> DataFrame:
    """ord, name and colors of the rows of raw(ord, name, colors) that have any colour."""
    return raw.select("ord", clean_name(F.col("name"), "Untitled").alias("name"), clean_colors(F.col("colors")).alias("colors")).where(F.size("colors") > 0)


def clean_presets(raw: DataFrame) -> DataFrame:
    """Rows of raw(ord, name, settings map, and palette and outline_touched if there) with a name and a known setting.

    palette is null, or a name and at least one colour.
    """
    known = F.map_filter("settings", lambda k, v: k.isin(SETTINGS) & v.isNotNull())
    more = []
    if "palette" in raw.columns:
        colors = clean_colors(F.col("palette.colors"))
        name = F.substring(F.coalesce(F.nullif(F.col("palette.name"), F.lit("")), F.lit("Untitled")), 1, NAME_LENGTH)
        more.append(F.when(F.size(colors) > 0, F.struct(name.alias("name"), colors.alias("colors"))).alias("palette"))
    if "outline_touched" in raw.columns:
        more.append(F.coalesce("outline_touched", F.lit(False)).alias("outline_touched"))
    return raw.select("ord", clean_name(F.col("name")).alias("name"), known.alias("settings"), *more).where(F.col("name").isNotNull() & (F.size("settings") > 0))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _truthy(v: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, 0 or ''."""
    number = F.try_variant_get(v, "$", "double")
    kind = _kind(v)
    given = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind == "STRING", F.try_variant_get(v, "$", "string") != "").when(kind == "VOID", False).when(number.isNotNull(), number != 0)
    return F.when(v.isNull(), False).otherwise(F.coalesce(given, F.lit(True)))


def _strings(v: Column, path: str) -> Column:
    """The texts in a JSON array, others left out; an empty array if it is none."""
    items = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(F.filter(F.transform(items, _string), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def _setting(v: Column) -> Column:
    """The text of a boolean, number or text; null for any other value."""
    plain = _kind(v).rlike("^(STRING|BOOLEAN|BIGINT|INT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(plain, F.try_variant_get(v, "$", "string"))


def read_backup(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw presets and raw palettes in texts(json) of backups, with ord, ready to be cleaned.

    A bare array is a list of presets. A text that isn't JSON, or has neither list, gives no rows.
    """
    parsed = texts.select(F.try_parse_json("json").alias("v")).where("v is not null")
    lists = parsed.select(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.presets", "array<variant>")).alias("presets"), F.try_variant_get("v", "$.palettes", "array<variant>").alias("palettes"))
    one = lists.select(F.posexplode("presets").alias("ord", "v"))
    settings = F.try_variant_get("v", "$.settings", "map<string,variant>")
    palette = F.when(_kind(F.try_variant_get("v", "$.palette", "variant")).startswith("OBJECT"), F.struct(F.try_variant_get("v", "$.palette.name", "string").alias("name"), _strings(F.col("v"), "$.palette.colors").alias("colors")))
    presets = one.select("ord", _string(F.try_variant_get("v", "$.name", "variant")).alias("name"), F.transform_values(settings, lambda _, x: _setting(x)).alias("settings"), palette.alias("palette"), _truthy(F.try_variant_get("v", "$.outlineColorTouched", "variant")).alias("outline_touched"))
    two = lists.select(F.posexplode("palettes").alias("ord", "v"))
    return presets, two.select("ord", _string(F.try_variant_get("v", "$.name", "variant")).alias("name"), _strings(F.col("v"), "$.colors").alias("colors"))


def new_id(prefix: str, now: Column, sequence: Column) -> Column:
    """prefix, the time in milliseconds and a sequence number, both in base 36."""
    return F.concat(F.lit(prefix), F.lower(F.conv(F.unix_millis(now).cast("string"), 10, 36)), F.lit("-"), F.lower(F.conv(sequence.cast("string"), 10, 36)))


def merge_by_name(existing: DataFrame, incoming: DataFrame, values: list[str], prefix: str = "s", now: Column | None = None) -> DataFrame:
    """existing(ord, id, name, values...) with incoming(ord, name, values...): updated by name, else put first.

    Names are equal in any case. Of incoming rows with one name the last updates; rows that are new are all added, even
    with equal names, under ids made of prefix, the time (now, the epoch if not given) and their place. status says
    added, updated or kept.
    """
    low = F.lower("name")
    old = existing.withColumn("_n", low).withColumn("_first", F.row_number().over(Window.partitionBy("_n").orderBy("ord")) == 1)
    new = incoming.withColumn("_n", low)
    last = new.groupBy("_n").agg(F.max_by(F.struct(*values), "ord").alias("_new"))
    hit = F.col("_first") & F.col("_new").isNotNull()
    kept = old.join(last, "_n", "left").select("ord", "id", "name", *[F.when(hit, F.col(f"_new.{v}")).otherwise(F.col(v)).alias(v) for v in values], F.when(hit, "updated").otherwise("kept").alias("status"))
    ends = existing.agg(F.coalesce(F.min("ord"), F.lit(0)).alias("_before")).join(incoming.agg(F.max("ord").alias("_last")))  # a row each
    fresh = new.join(old.select("_n").distinct(), "_n", "left_anti").join(F.broadcast(ends))
    ident = new_id(prefix, now if now is not None else F.timestamp_millis(F.lit(0)), F.col("ord"))
    fresh = fresh.select((F.col("_before") - 1 - F.col("_last") + F.col("ord")).alias("ord"), ident.alias("id"), "name", *values, F.lit("added").alias("status"))
    return fresh.unionByName(kept)


def tally(merged: DataFrame, incoming_rows: int, clean_rows: int) -> DataFrame:
    """added, updated and skipped counts of an import."""
    return merged.agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "updated").alias("updated")).withColumn("skipped", F.lit(incoming_rows - clean_rows))


def import_backup(presets: DataFrame, palettes: DataFrame, texts: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The saved presets and palettes after an import of texts(json); status says what became of each row."""
    raw_presets, raw_palettes = read_backup(texts)
    return merge_by_name(presets, clean_presets(raw_presets), PRESET_VALUES, "s", now), merge_by_name(palettes, clean_palettes(raw_palettes), PALETTE_VALUES, "p", now)


def save(rows: DataFrame, one: DataFrame, values: list[str], prefix: str = "s", now: Column | None = None) -> DataFrame:
    """rows with one(name, values...) saved: over the row of that name, or as a new first row."""
    return merge_by_name(rows, one.withColumn("ord", F.lit(0)), values, prefix, now).drop("status")


def save_palette(library: DataFrame, one: DataFrame, active: str | None, now: Column | None = None) -> DataFrame:
    """library(ord, id, name, colors) with one(name, colors): over the row with the active id, or as a new first row."""
    clean = one.select(clean_name(F.col("name"), "Untitled").alias("name"), "colors").where(F.size("colors") > 0)
    found = library.where(F.col("id") == F.lit(active)).select("id")
    update = clean.join(F.broadcast(found.limit(1)))
    over = library.join(F.broadcast(update.select("id", F.struct("name", "colors").alias("_new"))), "id", "left")
    kept = over.select("ord", "id", F.coalesce("_new.name", "name").alias("name"), F.coalesce("_new.colors", "colors").alias("colors"))
    fresh = clean.join(F.broadcast(found), how="left").where("id is null").drop("id").join(F.broadcast(library.agg((F.coalesce(F.min("ord"), F.lit(0)) - 1).alias("ord"))))
    return kept.unionByName(fresh.select("ord", new_id("p", now if now is not None else F.timestamp_millis(F.lit(0)), F.lit(0)).alias("id"), "name", "colors"))


def duplicate(one: DataFrame) -> DataFrame:
    """one(name, colors), ready to be saved as a new row under another name."""
    return one.select(F.concat(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Untitled")), F.lit(" copy")).alias("name"), "colors")


def by_id(rows: DataFrame, one: str) -> DataFrame:
    """The row with an id; none if there is none."""
    return rows.where(F.col("id") == one)


def layered(defaults: Column, settings: Column) -> Column:
    """Settings over defaults, key by key."""
    return F.map_zip_with(defaults, settings, lambda _, a, b: F.coalesce(b, a))


def applied(presets: DataFrame, one: str, defaults: dict[str, str], with_palette: bool = True) -> DataFrame:
    """settings (over the defaults), palette and outline_touched of a preset; no row if there is none of that id.

    plans.pipeline.Options.of makes options of the settings.
    """
    base = F.create_map(*[F.lit(v) for k, x in defaults.items() for v in (k, x)])
    palette = F.col("palette") if with_palette and "palette" in presets.columns else F.lit(None)
    touched = F.coalesce("outline_touched", F.lit(False)) if "outline_touched" in presets.columns else F.lit(False)
    return by_id(presets, one).select(layered(base, F.col("settings")).alias("settings"), palette.alias("palette"), touched.alias("outline_touched"))


def same_settings(a: Column, b: Column, color_chosen: Column) -> Column:
    """Whether all settings agree as text; the outline colour counts only if it was chosen."""
    same = F.lit(True)
    for k in SETTINGS:
        eq = F.element_at(a, k).eqNullSafe(F.element_at(b, k))
        same = same & ((~color_chosen | eq) if k == "pm-outline-color" else eq)
    return same


def note(presets: DataFrame, active: str | None, current: dict[str, str], defaults: dict[str, str], color_chosen: bool = False) -> DataFrame:
    """note: the active preset's name, marked where settings differ from it; without one, Defaults or Custom."""
    as_map = lambda d: F.create_map(*[F.lit(v) for k, x in d.items() for v in (k, x)])
    same = lambda other: same_settings(as_map(current), other, F.lit(color_chosen))
    own = presets.where(F.col("id") == F.lit(active)).select("name", same(layered(as_map(defaults), F.col("settings"))).alias("same"))
    row = own.agg(F.first("name").alias("name"), F.first("same").alias("same"))
    other = F.when(same(as_map(defaults)), "Defaults").otherwise("Custom")
    return row.select(F.when(F.col("name").isNull(), other).otherwise(F.concat("name", F.when(F.col("same"), "").otherwise(" · modified"))).alias("note"))


def delete_by_id(rows: DataFrame, one: str) -> DataFrame:
    """rows without one id; built-in ids (b-...) can't be deleted."""
    return rows.where((F.col("id") != one) | F.col("id").startswith("b-"))


def backup(presets: DataFrame, palettes: DataFrame, marker: str, now: Column) -> DataFrame:
    """One row, json: the saved presets and palettes, marked and stamped with the time; no row if there are none."""
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def listed(rows: DataFrame, columns: list[Column | str], name: str) -> DataFrame:
        in_order = lambda x, y: F.when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0)
        return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("v"))), in_order), lambda p: p["v"]).alias(name))

    own = presets.where("not startswith(id, 'b-')")
    more = [c for c in ("palette",) if c in own.columns] + [F.col("outline_touched").alias("outlineColorTouched") for c in ("outline_touched",) if c in own.columns]
    a, b = listed(own, ["id", "name", "settings", *more], "presets"), listed(palettes, ["id", "name", "colors"], "palettes")
    body = F.struct(F.lit(marker).alias("format"), F.lit(1).alias("version"), stamp.alias("exported"), "presets", "palettes")
    return a.join(F.broadcast(b)).where((F.size("presets") > 0) | (F.size("palettes") > 0)).select(F.to_json(body).alias("json"))


def backup_name(stem: str, now: Column) -> Column:
    """The dated name of a backup file."""
    return F.concat(F.lit(f"{stem}-"), F.date_format(now, "yyyy-MM-dd"), F.lit(".json"))
