"""The registered queries of the raster operators, and their DuckDB SQL.

The driver's tables have no images, so rasters are made from orders with whole numbers: 50 * 30 pixels for every 1500
orders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..functions import color, tables
from ..operators import extract, palettes, presets, raster, regions
from ..sources import images as image_files
from ..sources import palettes as palette_files
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SWEETIE, GAME_BOY = "Sweetie 16", "Game Boy (DMG)"


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: (ship(spark), f(spark, sf_dir))[1]
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def raster_pixels(spark: SparkSession, sf_dir: str, flat: bool = False) -> DataFrame:
    """pixels from orders. flat: blue in bands, which gives large regions."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (k % 50).cast("int"), F.expr("cast((o_orderkey % 1500) div 50 as int)")
    r, g = color.clamp(x * 5 + c % 17 - 8, 0, 255), color.clamp(y * 8 + c % 13 - 6, 0, 255)
    b = F.expr("cast((o_orderkey % 50) div 10 as int)") * 50 if flat else c % 256
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    orders = orders.repartition(spark.sparkContext.defaultParallelism, F.expr("o_orderkey div 1500"))  # one small file: deal its images out
    return orders.select(F.expr("o_orderkey div 1500").alias("image_id"), y.alias("y"), x.alias("x"), *[v.cast("int").alias(n) for v, n in ((r, "r"), (g, "g"), (b, "b"))], F.when(c % 23 == 0, 0).otherwise(255).alias("a"))


def raster_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey div 1500").alias("image_id")).distinct().withColumns({"width": F.lit(50), "height": F.lit(30)})


def _px(flat: bool = False) -> str:
    b = "((o_orderkey % 50) // 10) * 50" if flat else "o_custkey % 256"
    return f"""px AS (SELECT o_orderkey // 1500 AS image_id, (o_orderkey % 1500) // 50 AS y, o_orderkey % 50 AS x,
      least(255, greatest(0, (o_orderkey % 50) * 5 + (o_custkey % 17) - 8)) AS r,
      least(255, greatest(0, ((o_orderkey % 1500) // 50) * 8 + (o_custkey % 13) - 6)) AS g, {b} AS b,
      CASE WHEN o_custkey % 23 = 0 THEN 0 ELSE 255 END AS a FROM orders)"""


#: 252 colours, 7 levels of red, 6 of green and 6 of blue.
WIDE = [f"#{r * 42:02x}{g * 51:02x}{b * 51:02x}" for r in range(7) for g in range(6) for b in range(6)]


def _pal(name: str | list[str]) -> str:
    return "pal(idx, r, g, b) AS (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(tables.rgb_list(name))) + ")"


def _lin(v: str) -> str:
    return f"(CASE WHEN ({v}) / 255.0::DOUBLE <= 0.04045 THEN ({v}) / 255.0::DOUBLE / 12.92 ELSE pow((({v}) / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


def _lab(source: str) -> str:
    """SQL that adds la, lb and ll to the columns of source."""
    lms = [f"cbrt({_lin('r')} * {m[0]} + {_lin('g')} * {m[1]} + {_lin('b')} * {m[2]})" for m in color.LINEAR_TO_LMS]
    lab = [f"_l * {m[0]} + _m * {m[1]} + _s * {m[2]}" for m in color.LMS_TO_LAB]
    return f"(SELECT *, {lab[0]} AS ll, {lab[1]} AS la, {lab[2]} AS lb FROM (SELECT *, {lms[0]} AS _l, {lms[1]} AS _m, {lms[2]} AS _s FROM {source}))"


_SRGB = "((p.r - c.r) * (p.r - c.r) + (p.g - c.g) * (p.g - c.g) + (p.b - c.b) * (p.b - c.b))"
_REDMEAN = "((1024 + p.r + c.r) * (p.r - c.r) * (p.r - c.r) + 2048 * (p.g - c.g) * (p.g - c.g) + (1534 - p.r - c.r) * (p.b - c.b) * (p.b - c.b))"


def _mapped(palette: str | list[str], distance: str = _SRGB, flat: bool = False) -> str:
    return f"WITH {_px(flat)}, {_pal(palette)}, mapped AS (SELECT p.image_id, p.y, p.x, CASE WHEN p.a >= 8 THEN min({distance} * 256 + c.idx) % 256 END AS idx FROM px p CROSS JOIN pal c GROUP BY p.image_id, p.y, p.x, p.a)"


_USAGE = " SELECT image_id, idx, count(*) AS n, sum(y * 50 + x)::BIGINT AS places FROM mapped WHERE idx IS NOT NULL GROUP BY image_id, idx"


def _usage(mapped: DataFrame) -> DataFrame:
    return mapped.where("idx is not null").groupBy("image_id", "idx").agg(F.count("*").alias("n"), F.sum((F.col("y") * 50 + F.col("x")).cast("long")).alias("places"))


@_register(_mapped(GAME_BOY) + _USAGE)
def min_palette_usage(spark, sf_dir):
    """Per image, how many opaque pixels map to each colour of a palette."""
    return _usage(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), GAME_BOY))


@_register(_mapped(SWEETIE) + _USAGE)
def match_srgb(spark, sf_dir):
    return _usage(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), SWEETIE))


@_register(_mapped(SWEETIE, _REDMEAN) + _USAGE)
def match_redmean(spark, sf_dir):
    return _usage(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), SWEETIE, "redmean"))


@_register(_mapped(WIDE) + _USAGE)
def match_wide(spark, sf_dir):
    """A palette of 252 colours."""
    return _usage(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), WIDE))


@_register(f"WITH {_px()}, {_pal(SWEETIE)}, mapped AS (SELECT p.image_id, p.y, p.x, arg_min(c.idx, {{'d': (p.ll - c.ll) * (p.ll - c.ll) + (p.la - c.la) * (p.la - c.la) + (p.lb - c.lb) * (p.lb - c.lb), 'i': c.idx}}) AS idx FROM {_lab('px')} p CROSS JOIN {_lab('pal')} c WHERE p.a >= 8 GROUP BY p.image_id, p.y, p.x)" + _USAGE)
def match_oklab(spark, sf_dir):
    return _usage(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), SWEETIE, "oklab"))


@_register(f"WITH {_px()}, {_pal(SWEETIE)}, keyed AS (SELECT *, (r // 2) * 16384 + (g // 2) * 128 + b // 2 AS cell FROM px WHERE a >= 8), firsts AS (SELECT image_id, cell, arg_min(r, y * 50 + x) AS r, arg_min(g, y * 50 + x) AS g, arg_min(b, y * 50 + x) AS b FROM keyed GROUP BY image_id, cell), found AS (SELECT p.image_id, p.cell, min({_SRGB} * 256 + c.idx) % 256 AS idx FROM firsts p CROSS JOIN pal c GROUP BY p.image_id, p.cell), mapped AS (SELECT k.image_id, k.y, k.x, f.idx FROM keyed k JOIN found f USING (image_id, cell))" + _USAGE)
def match_by_cell(spark, sf_dir):
    return _usage(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), SWEETIE, mode="cell"))


@_register(_mapped(SWEETIE) + " SELECT m.image_id, sum(coalesce(c.r, 0))::BIGINT AS r, sum(coalesce(c.g, 0))::BIGINT AS g, sum(coalesce(c.b, 0))::BIGINT AS b, sum(CASE WHEN m.idx IS NULL THEN 0 ELSE 255 END)::BIGINT AS a FROM mapped m LEFT JOIN pal c ON c.idx = m.idx GROUP BY m.image_id")
def paint_palette(spark, sf_dir):
    rows = raster.paint(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), SWEETIE), SWEETIE)
    return rows.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in "rgba"])


_TONE = raster.Tone(black=20, white=230, brightness=10, contrast=20, saturation=30)


def _toned(v: str) -> str:
    c = _TONE.contrast * 2.55
    return f"(({259 * (c + 255) / (255 * (259 - c))!r} * (255 * (least(255.0, greatest(0.0, ({v} - 20) * (255 / 210.0::DOUBLE))) / 255.0::DOUBLE) + {10 * 1.275!r} - 128) + 128)::FLOAT)::DOUBLE"


@_register(f"WITH {_px()}, toned AS (SELECT image_id, {', '.join(f'{_toned(c)} AS {c}' for c in 'rgb')} FROM px WHERE a >= 8), lit AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM toned) SELECT image_id, {', '.join(f'sum(floor(l + ({c} - l) * 1.3::DOUBLE + 0.5)::BIGINT)::BIGINT AS {c}' for c in 'rgb')} FROM lit GROUP BY image_id")
def adjust_tone(spark, sf_dir):
    rows = raster.adjust(raster.opaque(raster_pixels(spark, sf_dir)).where("a > 0"), _TONE)
    return rows.groupBy("image_id").agg(*[F.sum(color.half_up(F.col(c)).cast("long")).alias(c) for c in "rgb"])


def _dither_sql(n: int) -> str:
    spread = raster.mean_spacing(SWEETIE) * 0.6
    bay = ", ".join(f"({i}, {(v / n**2 - 0.5) * spread!r}::DOUBLE)" for i, v in enumerate(tables.bayer(n)))
    moved = ", ".join(f"trunc(least(255, greatest(0, {c} + t)))::BIGINT AS {c}" for c in "rgb")
    return f"WITH {_px()}, {_pal(SWEETIE)}, bay(i, t) AS (VALUES {bay}), d AS (SELECT image_id, y, x, {moved} FROM px JOIN bay ON bay.i = (y % {n}) * {n} + x % {n} WHERE a >= 8), mapped AS (SELECT p.image_id, p.y, p.x, min({_SRGB} * 256 + c.idx) % 256 AS idx FROM d p CROSS JOIN pal c GROUP BY p.image_id, p.y, p.x)" + _USAGE


@_register(_dither_sql(4))
def dither_bayer4(spark, sf_dir):
    return _usage(raster.match(raster.ordered_dither(raster.opaque(raster_pixels(spark, sf_dir)), 4, 1.0, SWEETIE), SWEETIE))


@_register(_dither_sql(8))
def dither_bayer8(spark, sf_dir):
    return _usage(raster.match(raster.ordered_dither(raster.opaque(raster_pixels(spark, sf_dir)), 8, 1.0, SWEETIE), SWEETIE))


@_register(f"WITH {_px()} SELECT p.image_id, p.y, p.x, p.a, {', '.join(f'CASE WHEN p.a = 0 THEN 0 ELSE list_sort(list(q.{c}) FILTER (WHERE q.a > 0))[count(*) FILTER (WHERE q.a > 0) // 2 + 1] END AS {c}' for c in 'rgb')} FROM px p JOIN px q ON p.image_id = q.image_id AND q.y BETWEEN p.y - 2 AND p.y + 2 AND q.x BETWEEN p.x - 2 AND p.x + 2 GROUP BY p.image_id, p.y, p.x, p.a")
def denoise_median(spark, sf_dir):
    return raster.denoise(raster_pixels(spark, sf_dir), 2).select("image_id", "y", "x", "a", "r", "g", "b")


_NEAR = f"near AS (SELECT a.idx AS i, b.idx AS j, sqrt(pow(a.ll - b.ll, 2) + pow(a.la - b.la, 2) + pow(a.lb - b.lb, 2)) AS d FROM {_lab('pal')} a CROSS JOIN {_lab('pal')} b)"


@_register(_mapped(SWEETIE) + f", {_NEAR}, votes AS (SELECT p.image_id, p.y, p.x, q.idx AS v, count(*) AS n FROM mapped p JOIN mapped q ON p.image_id = q.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND (q.y <> p.y OR q.x <> p.x) WHERE q.idx IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), best AS (SELECT m.image_id, m.y, m.x, m.idx AS own, v.v FROM mapped m LEFT JOIN votes v USING (image_id, y, x)), after AS (SELECT b.image_id, b.y, b.x, CASE WHEN b.v <> b.own AND n.d <= 0.24 THEN b.v ELSE b.own END AS idx FROM best b LEFT JOIN near n ON n.i = b.own AND n.j = b.v) SELECT image_id, idx, count(*) AS n, sum(y * 50 + x)::BIGINT AS places FROM after WHERE idx IS NOT NULL GROUP BY image_id, idx")
def smooth_stipple(spark, sf_dir):
    return _usage(regions.smooth_stipple(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), SWEETIE), SWEETIE, 0.24))


#: CTEs from mapped to labels.
_LABELS = """, step(image_id, p, q) AS (SELECT a.image_id, a.y * 50 + a.x, b.y * 50 + b.x FROM mapped a JOIN mapped b ON a.image_id = b.image_id AND a.idx = b.idx AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1))),
      heads AS (SELECT image_id, y * 50 + x AS p FROM mapped m WHERE idx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM step s WHERE s.image_id = m.image_id AND s.p = m.y * 50 + m.x AND s.q < s.p)),
      reach(image_id, head, p) AS (SELECT image_id, p, p FROM heads UNION SELECT r.image_id, r.head, s.q FROM reach r JOIN step s ON s.image_id = r.image_id AND s.p = r.p),
      least_of AS (SELECT image_id, p, min(head) AS head FROM reach GROUP BY image_id, p),
      labels AS (SELECT m.image_id, m.y, m.x, m.idx, CASE WHEN l.head IS NOT NULL THEN dense_rank() OVER (PARTITION BY m.image_id ORDER BY l.head NULLS LAST) - 1 END AS label FROM mapped m LEFT JOIN least_of l ON l.image_id = m.image_id AND l.p = m.y * 50 + m.x)"""


def _labels_sql() -> str:
    return _mapped(SWEETIE, flat=True).replace("WITH ", "WITH RECURSIVE ", 1) + _LABELS


def _absorbed(most: int, near: float) -> str:
    """CTEs from labels to became: image_id, label, the region that it is part of, and the colours of all regions."""
    return f""", near_rows AS (SELECT i, list(d <= {near!r} ORDER BY j) AS ok FROM near GROUP BY i), close AS (SELECT list(ok ORDER BY i) AS ok FROM near_rows),
      areas AS (SELECT image_id, label, min(idx) AS idx, count(*) AS area FROM labels WHERE label IS NOT NULL GROUP BY image_id, label),
      sides AS (SELECT a.image_id, a.label, b.label AS other, (a.y * 50 + a.x) * 4 + CASE WHEN b.x < a.x THEN 0 WHEN b.x > a.x THEN 1 WHEN b.y < a.y THEN 2 ELSE 3 END AS place
        FROM labels a JOIN labels b ON a.image_id = b.image_id AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1)) WHERE a.label <> b.label),
      contacts AS (SELECT image_id, label, other, count(*) AS n, max(place) AS last FROM sides GROUP BY image_id, label, other),
      met AS (SELECT image_id, label, list({{'other': other, 'n': n, 'last': last}}) AS met FROM contacts GROUP BY image_id, label),
      turns AS MATERIALIZED (SELECT a.image_id, a.label, coalesce(met, []) AS met, row_number() OVER (PARTITION BY a.image_id ORDER BY area, a.label) AS k FROM areas a LEFT JOIN met USING (image_id, label) WHERE area <= {most}),
      at_turn(image_id, k, root, area, idx) AS (
        SELECT image_id, 0::BIGINT, list(label::BIGINT ORDER BY label), list(area::BIGINT ORDER BY label), list(idx ORDER BY label) FROM areas GROUP BY image_id
        UNION ALL
        SELECT image_id, k, CASE WHEN joins THEN list_transform(root, lambda x: CASE WHEN x = label THEN best ELSE x END) ELSE root END,
          CASE WHEN joins THEN list_transform(area, lambda v, i: CASE WHEN i = best + 1 THEN v + area[label + 1] ELSE v END) ELSE area END, idx
        FROM (
          SELECT *, coalesce(area[label + 1] <= {most} AND ok[idx[label + 1] + 1][idx[best + 1] + 1], false) AS joins FROM (
            SELECT image_id, k, root, area, idx, label, ok, list_sort(list_transform(ends, lambda e: {{'n': -list_sum(list_transform(list_filter(met, lambda m: root[m.other + 1] = e), lambda m: m.n)), 'last': list_max(list_transform(list_filter(met, lambda m: root[m.other + 1] = e), lambda m: m.last)), 'e': e}}))[1].e AS best FROM (
              SELECT s.image_id, t.k, root, area, idx, t.label, met, ok, list_filter(list_distinct(list_transform(met, lambda m: root[m.other + 1])), lambda e: e <> t.label) AS ends
              FROM at_turn s JOIN turns t ON t.image_id = s.image_id AND t.k = s.k + 1 CROSS JOIN close) a) b) c),
      ended AS (SELECT image_id, root, idx FROM at_turn QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k DESC) = 1),
      became AS (SELECT image_id, unnest(range(len(root))) AS label, unnest(root) AS root, idx FROM ended)"""


def _labels(spark, sf_dir) -> DataFrame:
    return regions.label_regions(raster.match(raster.opaque(raster_pixels(spark, sf_dir, flat=True)), SWEETIE))


@_register(_labels_sql() + " SELECT image_id, label, min(idx) AS idx, count(*) AS area FROM labels WHERE label IS NOT NULL GROUP BY image_id, label")
def region_areas(spark, sf_dir):
    return regions.region_table(_labels(spark, sf_dir))


@_register(_labels_sql() + """, sized AS (SELECT *, coalesce(label, -1) AS l, CASE WHEN label IS NULL THEN 999999 ELSE count(*) OVER (PARTITION BY image_id, label) END AS area FROM labels),
      pairs AS (SELECT a.image_id, a.y AS ay, a.x AS ax, a.l AS al, b.y AS by_, b.x AS bx, b.l AS bl FROM sized a JOIN sized b ON a.image_id = b.image_id AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1)) WHERE a.l <> b.l AND a.area >= 4 AND b.area >= 4),
      marks AS (SELECT DISTINCT image_id, CASE WHEN al < 0 THEN by_ ELSE ay END AS y, CASE WHEN al < 0 THEN bx ELSE ax END AS x FROM pairs),
      wide AS (SELECT image_id, y, x FROM marks UNION SELECT s.image_id, s.y, s.x FROM sized s JOIN marks m ON m.image_id = s.image_id AND abs(m.y - s.y) + abs(m.x - s.x) = 1 WHERE s.label IS NOT NULL)
      SELECT image_id, count(*) AS n, sum(y * 50 + x)::BIGINT AS places FROM wide GROUP BY image_id""")
def outline_pixels(spark, sf_dir):
    rows = regions.outlines(_labels(spark, sf_dir), width=2, least_area=4).where("edge")
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), F.sum((F.col("y") * 50 + F.col("x")).cast("long")).alias("places"))


@_register(_labels_sql() + f", {_NEAR}" + _absorbed(8, 0.2) + " SELECT l.image_id, b.root AS label, any_value(b.idx[b.root + 1]) AS idx, count(*) AS area FROM labels l JOIN became b ON b.image_id = l.image_id AND b.label = l.label GROUP BY l.image_id, b.root")
def absorb_regions(spark, sf_dir):
    rows = regions.absorb_small(_labels(spark, sf_dir), SWEETIE, 8, 0.2)
    return rows.where("label is not null").groupBy("image_id", "label").agg(F.first("idx").alias("idx"), F.count("*").alias("area"))


@_register()
def dither_diffusion(spark, sf_dir):
    return _usage(raster.diffused(raster.opaque(raster_pixels(spark, sf_dir)), SWEETIE))


@_register(f"WITH {_px()} SELECT image_id, y // 5 AS y, x // 5 AS x, {', '.join(f'coalesce(floor(sum({c} * a) / nullif(sum(a), 0)::DOUBLE + 0.5), 0)::INT AS {c}' for c in 'rgb')}, floor(avg(a) + 0.5)::INT AS a FROM px GROUP BY image_id, y // 5, x // 5")
def downscale_mean(spark, sf_dir):
    return raster.downscale(raster_pixels(spark, sf_dir), raster_images(spark, sf_dir), 5)


def _shared(at: str, size: int, to: int) -> str:
    """SQL: places of the new size that each of `size` pixels overlaps, and by how much."""
    return f"(SELECT a.i AS {at}, b.i AS o{at}, least((a.i + 1) * {to}, (b.i + 1) * {size}) - greatest(a.i * {to}, b.i * {size}) AS w{at} FROM range({size}) a(i) JOIN range({to}) b(i) ON a.i * {to} < (b.i + 1) * {size} AND b.i * {size} < (a.i + 1) * {to})"


@_register(f"WITH {_px()}, placed AS (SELECT * FROM px JOIN {_shared('y', 30, 8)} USING (y) JOIN {_shared('x', 50, 13)} USING (x)) SELECT image_id, oy AS y, ox AS x, {', '.join(f'coalesce(floor(sum({c} * wy * wx * a) / nullif(sum(wy * wx * a), 0)::DOUBLE + 0.5), 0)::INT AS {c}' for c in 'rgb')}, floor(sum(wy * wx * a) / sum(wy * wx)::DOUBLE + 0.5)::INT AS a FROM placed GROUP BY image_id, oy, ox")
def downscale_shared(spark, sf_dir):
    """Sizes that don't divide: 50 * 30 to 13 * 8."""
    return raster.downscale(raster_pixels(spark, sf_dir), raster_images(spark, sf_dir), 4)


@_register(f"WITH {_px()} SELECT image_id, count(*) * 9 AS n, sum(9 * r)::BIGINT AS r, sum((9 * y + 3) * 3)::BIGINT AS y, sum((9 * x + 3) * 3)::BIGINT AS x FROM px GROUP BY image_id")
def upscale_nearest(spark, sf_dir):
    return raster.upscale(raster_pixels(spark, sf_dir), 3).groupBy("image_id").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in "ryx"])


@_register(f"WITH {_px()} SELECT image_id, y * 50 + x AS ord, r, g, b FROM px WHERE (y * 50 + x) % 15 = 0 AND a >= 8")
def sample_pixels(spark, sf_dir):
    return raster.sample(raster_pixels(spark, sf_dir), raster_images(spark, sf_dir), 100)


@_register(f"WITH {_px()} SELECT '#' || lower(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0')) AS hex FROM px WHERE image_id = 0 AND y = 3 AND x = 4 AND a > 0")
def pick_color(spark, sf_dir):
    return raster.pick(raster_pixels(spark, sf_dir), 0, 3, 4)


def _samples(spark, sf_dir) -> DataFrame:
    return raster.sample(raster_pixels(spark, sf_dir), raster_images(spark, sf_dir))


@_register(f"WITH {_px()}, h AS (SELECT image_id, sqrt(la * la + lb * lb) AS c, degrees(atan2(lb, la)) AS h FROM {_lab('px')} WHERE a >= 8) SELECT image_id, (floor((CASE WHEN h < 0 THEN h + 360 ELSE h END) / 360 * 72) % 72)::INT AS bin, round(sum(c), 6) AS weight, count(*) AS n FROM h WHERE c >= 0.028 GROUP BY ALL")
def hue_histogram(spark, sf_dir):
    return extract.hue_histogram(_samples(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@_register()
def extract_palette(spark, sf_dir):
    return extract.extract_palette(_samples(spark, sf_dir), 16)


@_register()
def theory_palette(spark, sf_dir):
    return extract.theory_palette(_samples(spark, sf_dir), 24, "triadic")


_RGB_OF_PART = ("(p_partkey * 7) % 256", "(p_partkey * 13) % 256", "(p_size * 5) % 256")


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in palettes, and palettes of sixteen colours made from parts."""
    rows = [(name, i, h) for name, colors in tables.PALETTES.items() for i, h in enumerate(colors)]
    own = F.concat(F.lit("part "), F.expr("p_partkey div 16")).alias("palette_id")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(own, F.expr("cast(p_partkey % 16 as int)").alias("idx"), color.to_hex(*[F.expr(e).cast("int") for e in _RGB_OF_PART]).alias("hex"))
    return spark.createDataFrame(rows, "palette_id string, idx int, hex string").unionByName(parts)


def _library_sql() -> str:
    rows = ", ".join(f"('{n}', {i}, '{h}')" for n, c in tables.PALETTES.items() for i, h in enumerate(c))
    part = lambda k: f"(instr('0123456789abcdef', hex[{k}]) - 1) * 16 + instr('0123456789abcdef', hex[{k + 1}]) - 1"
    of_part = " || ".join(f"lpad(to_hex(({e})::INT), 2, '0')" for e in _RGB_OF_PART)
    return f"given(palette_id, idx, hex) AS (VALUES {rows}), lib AS (SELECT * FROM given UNION ALL SELECT 'part ' || p_partkey // 16, (p_partkey % 16)::INT, '#' || lower({of_part}) FROM part), rgb AS (SELECT *, {part(2)} AS r, {part(4)} AS g, {part(6)} AS b FROM lib)"


@_register(f"""WITH {_library_sql()}, lch AS (SELECT palette_id, idx, hex, ll AS l, sqrt(la * la + lb * lb) AS c, degrees(atan2(lb, la)) AS t FROM {_lab('rgb')}),
      hued AS (SELECT *, CASE WHEN t < 0 THEN t + 360 ELSE t END AS h FROM lch WHERE c >= {color.NEUTRAL_CHROMA}),
      gaps AS (SELECT *, row_number() OVER w AS n, coalesce(lead(h) OVER w, min(h) OVER (PARTITION BY palette_id) + 360) - h AS gap FROM hued WINDOW w AS (PARTITION BY palette_id ORDER BY h, idx)),
      cut AS (SELECT palette_id, arg_max(n, {{'g': gap, 'n': -n}}) AS cut FROM gaps GROUP BY palette_id),
      turned AS (SELECT g.*, CASE WHEN n > cut THEN n ELSE n + 512 END AS turn FROM gaps g JOIN cut USING (palette_id)),
      opened AS (SELECT *, CASE WHEN lag(gap) OVER (PARTITION BY palette_id ORDER BY turn) > {palettes.HUE_GAP} THEN 1 ELSE 0 END AS opens FROM turned),
      families AS (SELECT *, sum(opens) OVER (PARTITION BY palette_id ORDER BY turn) AS family FROM opened),
      means AS (SELECT palette_id, family, count(*) AS size, degrees(atan2(sum(sin(radians(h))), sum(cos(radians(h))))) AS m FROM families GROUP BY ALL),
      steps AS (SELECT f.*, CASE WHEN m < 0 THEN m + 360 ELSE m END AS mean, CASE WHEN size >= 3 AND c - lag(c) OVER (PARTITION BY palette_id, family ORDER BY c, turn) > {palettes.CHROMA_GAP} THEN 1 ELSE 0 END AS step FROM families f JOIN means USING (palette_id, family)),
      ramps AS (SELECT palette_id, idx, hex, 1 AS k, mean, sum(step) OVER (PARTITION BY palette_id, family ORDER BY c, turn) AS ramp, l FROM steps UNION ALL SELECT palette_id, idx, hex, 0, 0, 0, l FROM lch WHERE c < {color.NEUTRAL_CHROMA})
      SELECT palette_id, idx, hex, row_number() OVER (PARTITION BY palette_id ORDER BY k, mean, ramp, l, idx) - 1 AS place FROM ramps""")
def sort_ramps(spark, sf_dir):
    return palettes.sort_into_ramps(_library(spark, sf_dir))


@_register(f"WITH {_library_sql()}, d AS (SELECT p.palette_id, p.idx, min({_SRGB}) AS d FROM rgb p JOIN rgb c ON p.palette_id = c.palette_id AND p.idx <> c.idx GROUP BY ALL) SELECT palette_id, round(avg(sqrt(d)), 9) AS mean_spacing FROM d GROUP BY palette_id")
def palette_spacing(spark, sf_dir):
    return palettes.mean_spacing(_library(spark, sf_dir)).withColumn("mean_spacing", F.round("mean_spacing", 9))


@_register(f"WITH {_library_sql()}, lab AS (SELECT * FROM {_lab('rgb')}) SELECT p.palette_id, p.idx AS i, c.idx AS j, round(sqrt(pow(p.la - c.la, 2) + pow(p.lb - c.lb, 2) + pow(p.ll - c.ll, 2)), 9) AS distance FROM lab p JOIN lab c ON p.palette_id = c.palette_id AND p.idx < c.idx")
def palette_distances(spark, sf_dir):
    return palettes.pairwise(_library(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@_register(f"WITH {_library_sql()} SELECT palette_id, arg_min(hex, {{'l': ll, 'i': idx}}) AS hex FROM {_lab('rgb')} GROUP BY palette_id")
def darkest_color(spark, sf_dir):
    return palettes.darkest(_library(spark, sf_dir))


@_register(f"WITH RECURSIVE {_library_sql()}, near AS (SELECT a.palette_id, a.idx AS i, b.idx AS j FROM {_lab('rgb')} a JOIN {_lab('rgb')} b ON a.palette_id = b.palette_id WHERE sqrt(pow(a.ll - b.ll, 2) + pow(a.la - b.la, 2) + pow(a.lb - b.lb, 2)) <= 0.1), reach(palette_id, i, j) AS (SELECT palette_id, idx, idx FROM lib UNION SELECT r.palette_id, r.i, n.j FROM reach r JOIN near n ON n.palette_id = r.palette_id AND n.i = r.j) SELECT palette_id, i AS idx, min(j) AS becomes FROM reach GROUP BY palette_id, i")
def merge_map(spark, sf_dir):
    """For each colour of each palette the first one that it is linked to by near colours."""
    return palettes.merge_maps(_library(spark, sf_dir), 0.1)


@_register(f"WITH {_library_sql()} SELECT palette_id, string_agg(upper(hex[2:]), chr(10) ORDER BY idx) || chr(10) AS text FROM lib GROUP BY palette_id")
def hex_files(spark, sf_dir):
    return palettes.as_arrays(_library(spark, sf_dir)).select("palette_id", palettes.to_hex_file(F.col("colors")).alias("text"))


@_register(f"WITH {_library_sql()} SELECT palette_id, 'GIMP Palette' || chr(10) || 'Name: ' || palette_id || chr(10) || 'Columns: 0' || chr(10) || '#' || chr(10) || string_agg(lpad(r::VARCHAR, 3, ' ') || ' ' || lpad(g::VARCHAR, 3, ' ') || ' ' || lpad(b::VARCHAR, 3, ' ') || chr(9) || upper(hex), chr(10) ORDER BY idx) || chr(10) AS text FROM rgb GROUP BY palette_id")
def gimp_files(spark, sf_dir):
    return palettes.as_arrays(_library(spark, sf_dir)).select("palette_id", palettes.to_gimp_file(F.col("palette_id"), F.col("colors")).alias("text"))


def _ramp_usage(pal: str) -> str:
    """SQL: usage of the colours of a palette that is made by a rule."""
    return f"WITH {_px()}, pal AS ({pal}), mapped AS (SELECT p.image_id, p.y, p.x, CASE WHEN p.a >= 8 THEN min({_SRGB} * 256 + c.idx) % 256 END AS idx FROM px p CROSS JOIN pal c GROUP BY p.image_id, p.y, p.x, p.a) SELECT m.image_id, m.idx, '#' || lower(lpad(to_hex(c.r), 2, '0') || lpad(to_hex(c.g), 2, '0') || lpad(to_hex(c.b), 2, '0')) AS hex, count(*) AS n FROM mapped m JOIN pal c ON c.idx = m.idx GROUP BY ALL"


@_register(_ramp_usage("SELECT i AS idx, floor(i * 255 / 15.0 + 0.5)::INT AS r, floor(i * 255 / 15.0 + 0.5)::INT AS g, floor(i * 255 / 15.0 + 0.5)::INT AS b FROM range(16) t(i)"))
def greyscale_ramp(spark, sf_dir):
    """Images in sixteen greys."""
    rows = _usage(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), "Grayscale 16"))
    return rows.join(tables.greyscale(spark, 16), "idx").select("image_id", "idx", "hex", "n")


@_register(_ramp_usage("SELECT i AS idx, (i // 36 * 51)::INT AS r, (i // 6 % 6 * 51)::INT AS g, (i % 6 * 51)::INT AS b FROM range(216) t(i)"))
def web_safe_cube(spark, sf_dir):
    """Images in the colours of the cube."""
    rows = _usage(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), "Web Safe 216"))
    return rows.join(tables.web_safe(spark), "idx").select("image_id", "idx", "hex", "n")


@_register(f"WITH one AS (SELECT p_partkey // 8 AS palette_id, p_partkey, '#' || lower({' || '.join(f'''lpad(to_hex(({e})::INT), 2, '0')''' for e in _RGB_OF_PART)}) AS hex FROM part), firsts AS (SELECT palette_id, hex, min(p_partkey) AS k FROM one GROUP BY ALL) SELECT palette_id, string_agg(hex, ',' ORDER BY k) AS colors FROM firsts GROUP BY palette_id")
def parse_palettes(spark, sf_dir):
    """Texts in three formats, by turns, parsed back to colours."""
    r, g, b = (F.expr(e).cast("int") for e in _RGB_OF_PART)
    line = F.concat_ws(" ", r, g, b)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.expr("p_partkey div 8").alias("palette_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"), color.to_hex(r, g, b).alias("hex")))), lambda p: F.struct(p["line"].alias("line"), p["hex"].alias("hex"))).alias("p"))
    lines, hexes = F.array_join("p.line", "\n"), F.array_join("p.hex", " and ")
    text = F.when(F.col("palette_id") % 3 == 0, F.concat(F.lit("GIMP Palette\nName: x\n#\n"), lines)).when(F.col("palette_id") % 3 == 1, F.concat(F.lit("JASC-PAL\n0100\n8\n"), lines)).otherwise(F.concat(F.lit("colours "), hexes))
    return rows.select("palette_id", F.array_join(palette_files.parse_text(text, F.lit("x.txt"))["colors"], ",").alias("colors"))


@_register("WITH old AS (SELECT s_suppkey AS ord, s_name AS name, s_nationkey AS v FROM supplier WHERE s_suppkey % 2 = 0), new AS (SELECT s_suppkey AS ord, upper(s_name) AS name, s_nationkey + 100 AS v FROM supplier WHERE s_suppkey % 3 = 0) SELECT o.name, coalesce(n.v, o.v) AS v, CASE WHEN n.v IS NULL THEN 'kept' ELSE 'updated' END AS status FROM old o LEFT JOIN new n ON lower(n.name) = lower(o.name) UNION ALL SELECT name, v, 'added' FROM new WHERE lower(name) NOT IN (SELECT lower(name) FROM old)")
def merge_presets(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    old = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("v"))
    new = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("ord"), F.upper("s_name").alias("name"), (F.col("s_nationkey") + 100).alias("v"))
    return presets.merge_by_name(old, new, ["v"]).select("name", "v", "status")


@_register("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'image') || '_' || coalesce(nullif(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'palette') || '.png' AS file FROM part")
def export_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", palettes.file_name(F.col("p_name"), F.col("p_brand"), "png").alias("file"))


_DEFAULTS = ", ".join(f"('{k}', '{v}')" for k, v in pipeline.Options().settings().items())
_PRESETS = ", ".join(f"('{i}', '{k}', '{v}')" for (i, _), s in tables.PRESETS.items() for k, v in s.items())


_ASKED = [i for i, _ in tables.PRESETS] + ["1", "2", "3"]


@_register(f"WITH base(setting, value) AS (VALUES {_DEFAULTS}), built(id, setting, value) AS (VALUES {_PRESETS}), own AS (SELECT * FROM built UNION ALL SELECT s_suppkey::VARCHAR, 'pm-speck', s_nationkey::VARCHAR FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 'pm-dither', CASE WHEN s_acctbal < 0 THEN 'none' ELSE 'fs' END FROM supplier) SELECT p.id, b.setting, coalesce(o.value, b.value) AS value FROM (SELECT DISTINCT id FROM own WHERE id IN ({', '.join(f"'{i}'" for i in _ASKED)})) p CROSS JOIN base b LEFT JOIN own o ON o.id = p.id AND o.setting = b.setting")
def layered_presets(spark, sf_dir):
    """Settings of the built-in presets and of some that suppliers have saved, over the defaults."""
    own = F.create_map(F.lit("pm-speck"), F.col("s_nationkey").cast("string"), F.lit("pm-dither"), F.when(F.col("s_acctbal") < 0, "none").otherwise("fs"))
    saved = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), own.alias("settings"))
    known = tables.presets(spark).unionByName(saved)
    rows = [presets.applied(known, i, pipeline.Options().settings()).select(F.lit(i).alias("id"), F.explode("settings").alias("setting", "value")) for i in _ASKED]
    return reduce(DataFrame.unionByName, rows)


@_register(_mapped(SWEETIE).replace("WITH ", "WITH RECURSIVE ", 1) + f", {_NEAR}, reach(i, j) AS (SELECT idx, idx FROM pal UNION SELECT r.i, n.j FROM reach r JOIN near n ON n.i = r.j WHERE n.d <= 0.15), becomes AS (SELECT i, min(j) AS j FROM reach GROUP BY i) SELECT image_id, j AS idx, count(*) AS n, sum(y * 50 + x)::BIGINT AS places FROM mapped JOIN becomes ON i = idx GROUP BY image_id, j")
def merge_colors(spark, sf_dir):
    return _usage(regions.merge_colors(raster.match(raster.opaque(raster_pixels(spark, sf_dir)), SWEETIE), SWEETIE, 0.15))


_SIZES = "w0 AS (SELECT p_partkey AS image_id, 100 + p_partkey % 4000 AS width, 1 + p_size * 60 AS height FROM part), f AS (SELECT image_id, greatest(1, floor(width / 2::DOUBLE + 0.5)) AS fw, greatest(1, floor(height / 2::DOUBLE + 0.5)) AS fh FROM w0), k AS (SELECT *, CASE WHEN greatest(fw, fh) > 1200 THEN 1200 / greatest(fw, fh) ELSE 1.0::DOUBLE END AS k FROM f), s AS (SELECT image_id, greatest(1, floor(fw * k + 0.5)) * greatest(1, floor(fh * k + 0.5)) / (fw * fh) AS scale FROM k)"


@_register(f"WITH {_SIZES} SELECT image_id, round(scale, 9) AS scale, greatest(1, floor(24 * scale + 0.5))::INT AS area FROM s")
def preview_areas(spark, sf_dir):
    """Of images of all sizes, the share of the full work size in a preview, and an area of 24 pixels in it."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("image_id"), (F.lit(100) + F.col("p_partkey") % 4000).alias("width"), (F.lit(1) + F.col("p_size") * 60).alias("height"))
    scales = pipeline.area_scales(sizes, 2, pipeline.PREVIEW)
    return scales.select("image_id", F.round("scale", 9).alias("scale"), pipeline.scaled_area(24, F.col("scale")).alias("area"))


_BACKUP_SQL = """WITH old AS (SELECT s_suppkey AS ord, s_name AS name, s_nationkey::VARCHAR AS v FROM supplier WHERE s_suppkey % 2 = 0),
  given AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 15 = 0 THEN '  ' ELSE upper(s_name) END AS name, (s_nationkey + 100)::VARCHAR AS v FROM supplier WHERE s_suppkey % 3 = 0),
  new AS (SELECT * FROM given WHERE trim(name) <> '')
  SELECT o.name, coalesce(n.v, o.v) AS speck, CASE WHEN n.v IS NULL THEN 'kept' ELSE 'updated' END AS status FROM old o LEFT JOIN new n ON lower(n.name) = lower(o.name)
  UNION ALL SELECT name, v, 'added' FROM new WHERE lower(name) NOT IN (SELECT lower(name) FROM old)"""


@_register(_BACKUP_SQL)
def import_backup(spark, sf_dir):
    """Presets saved under suppliers' names, after the import of a backup that has other values for some."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    old = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.create_map(F.lit("pm-speck"), F.col("s_nationkey").cast("string")).alias("settings"), F.lit(None).cast("struct<name:string,colors:array<string>>").alias("palette"), F.lit(False).alias("outline_touched"))
    item = F.struct(F.when(F.col("s_suppkey") % 15 == 0, "  ").otherwise(F.upper("s_name")).alias("name"), F.struct((F.col("s_nationkey") + 100).alias("pm-speck"), F.lit("x").alias("unknown")).alias("settings"))
    text = s.where("s_suppkey % 3 = 0").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("v")))).alias("all")).select(F.to_json(F.struct(F.transform("all", lambda x: x["v"]).alias("presets"))).alias("json"))
    none = spark.createDataFrame([], "ord long, id string, name string, colors array<string>")
    merged, _ = presets.import_backup(old, none, text)
    return merged.select("name", F.element_at("settings", "pm-speck").alias("speck"), "status")


@_register(f"WITH {_library_sql()} SELECT palette_id, string_agg(hex, ',' ORDER BY idx) AS colors FROM lib WHERE idx < 8 GROUP BY palette_id")
def palette_strips(spark, sf_dir):
    return palettes.strips(_library(spark, sf_dir)).select("palette_id", F.array_join("colors", ",").alias("colors"))


@_register(f"WITH {_library_sql()}, {_px()}, one AS (SELECT '#' || lower(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0')) AS hex FROM px WHERE image_id = 0 AND y = 3 AND x = 4 AND a > 0), ends AS (SELECT palette_id, max(idx) AS last FROM lib GROUP BY palette_id) SELECT palette_id, idx, hex FROM lib UNION ALL SELECT e.palette_id, last + 1, o.hex FROM ends e CROSS JOIN one o WHERE NOT EXISTS (SELECT 1 FROM lib l WHERE l.palette_id = e.palette_id AND l.hex = o.hex)")
def pick_into_palettes(spark, sf_dir):
    return palettes.pick_into(_library(spark, sf_dir), raster.pick(raster_pixels(spark, sf_dir), 0, 3, 4))


@_register(f"WITH {_library_sql()}, asked AS (SELECT 'CGA 16' AS palette_id, hex FROM lib WHERE palette_id <> 'CGA 16') SELECT palette_id, hex, count(*) AS n FROM asked a WHERE EXISTS (SELECT 1 FROM lib l WHERE l.palette_id = a.palette_id AND l.hex = a.hex) GROUP BY ALL")
def palette_members(spark, sf_dir):
    """Colours of other palettes that one palette has too."""
    asked = _library(spark, sf_dir).where("palette_id <> 'CGA 16'").select(F.lit("CGA 16").alias("palette_id"), F.upper("hex").alias("hex"))
    return palettes.in_palette(asked, _library(spark, sf_dir)).groupBy("palette_id", F.lower("hex").alias("hex")).agg(F.count("*").alias("n"))


@_register()
def render_images(spark, sf_dir):
    o = pipeline.Options(metric="oklab", denoise=1, speck=4, tolerance=0.6, smooth_stipple=True, merge_colors=10, outline=True)
    return pipeline.render(raster_pixels(spark, sf_dir), raster_images(spark, sf_dir), SWEETIE, o)


@_register(f"WITH {_px()} SELECT image_id, count(*) AS n, {', '.join(f'sum({c} * (y * 50 + x))::BIGINT AS {c}' for c in 'rgba')} FROM px GROUP BY image_id")
def png_images(spark, sf_dir):
    """Images written as PNG and read back, with the sum of each channel by place."""
    written = image_files.to_png(raster_pixels(spark, sf_dir)).select("image_id", F.col("png").alias("content"))
    return image_files.png_pixels(written).groupBy("image_id").agg(F.count("*").alias("n"), *[F.sum((F.col(c) * (F.col("y") * 50 + F.col("x"))).cast("long")).alias(c) for c in "rgba"])
