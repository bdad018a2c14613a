"""Queries on boxes, polygons and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import polygon as pg
from tallyscope.functions.boxes import Box, bbox_cover, bbox_iou, hexagon
from tallyscope.functions.projection import project_epsg5179
from tallyscope.operators import pixels as px
from tallyscope.operators import shapes as sh
from tallyscope.plans.base import query
from tallyscope.sources.model import Model

KEY = ["detection_id", "candidate_no"]


def outlined(m: Model) -> DataFrame:
    return m.candidate.withColumn("polygon", hexagon(Box.of()))


@query(
    "bbox_iou",
    """SELECT detection_id, candidate_no, CASE WHEN ix * iy <= 0 THEN 0 ELSE ix * iy / (w * h + 900 - ix * iy) END AS iou, ix * iy / greatest(w * h, 1) AS cover FROM (
SELECT detection_id, candidate_no, bbox_w AS w, bbox_h AS h, greatest(0, least(bbox_x + bbox_w, 50) - greatest(bbox_x, 20)) AS ix, greatest(0, least(bbox_y + bbox_h, 50) - greatest(bbox_y, 20)) AS iy FROM {candidate}) q""",
)
def _(m: Model) -> DataFrame:
    a, b = Box.of(), Box(F.lit(20), F.lit(20), F.lit(30), F.lit(30))
    return m.candidate.select(*KEY, bbox_iou(a, b).alias("iou"), bbox_cover(a, b).alias("cover"))


@query(
    "polygon_area",
    """SELECT detection_id, candidate_no, bbox_w * bbox_h * 3 / 4.0::DOUBLE AS area, round(4 * sqrt(bbox_w / 4.0::DOUBLE * (bbox_w / 4.0::DOUBLE) + bbox_h / 2.0::DOUBLE * (bbox_h / 2.0::DOUBLE)) + bbox_w, 9) AS perimeter, bbox_x AS x, bbox_y AS y, bbox_w AS w, bbox_h AS h FROM {candidate}""",
)
def _(m: Model) -> DataFrame:
    p = F.col("polygon")
    rows = outlined(m).select(*KEY, pg.polygon_area(p).alias("area"), F.round(pg.polygon_perimeter(p), 9).alias("perimeter"), pg.polygon_bbox(p).alias("_b"))
    return rows.select(*KEY, "area", "perimeter", "_b.*")


AXES = """axes AS (SELECT detection_id, candidate_no, bbox_x, bbox_y, bbox_w AS w, bbox_h AS h, 5 * bbox_w * bbox_w / 96.0::DOUBLE AS mx, 5 * bbox_h * bbox_h / 72.0::DOUBLE AS my FROM {candidate})"""


@query(
    "fit_ellipse",
    """SELECT detection_id, candidate_no, round(bbox_x + w / 2.0::DOUBLE, 6) AS cx, round(bbox_y + h / 2.0::DOUBLE, 6) AS cy, round(2 * sqrt(greatest(mx, my)), 6) AS a, round(2 * sqrt(least(mx, my)), 6) AS b, round(sqrt(greatest(mx, my) / least(mx, my)), 6) AS ratio FROM axes""",
    AXES,
)
def _(m: Model) -> DataFrame:
    s = sh.basic_measures(outlined(m).select(*KEY, "polygon"), "polygon")
    return s.select(*KEY, *[F.round(f"_m.{c}", 6).alias(c) for c in ("cx", "cy")], *[F.round(f"_e.{c}", 6).alias(c) for c in ("a", "b", "ratio")])


CROP = """SELECT detection_id, candidate_no, CAST(ow + 2 * mg AS INT) AS out_w, CAST(oh + 2 * mg AS INT) AS out_h FROM (SELECT *, greatest(3, CAST(round_even(0.08 * greatest(ow, oh), 0) AS INT)) AS mg FROM (
SELECT *, CASE WHEN mx > my AND sqrt(mx / my) >= 1.15 THEN h ELSE w END AS ow, CASE WHEN mx > my AND sqrt(mx / my) >= 1.15 THEN w ELSE h END AS oh FROM axes) q) r"""


@query("crop_geometry", CROP, AXES)
def _(m: Model) -> DataFrame:
    return sh.crop_geometry(outlined(m).select(*KEY, "polygon"), "polygon").select(*KEY, "out_w", "out_h")


@query(
    "scalebar",
    """SELECT detection_id, candidate_no, bar AS um, round(100 * bar / full_um, 6) AS pct, nice FROM (SELECT *, CASE WHEN m >= 5 THEN 5 WHEN m >= 2 THEN 2 ELSE 1 END * e AS bar, CASE WHEN m < 1.5 THEN 1 WHEN m < 3.5 THEN 2 WHEN m < 7.5 THEN 5 ELSE 10 END * e AS nice FROM (
SELECT *, goal / e AS m FROM (SELECT detection_id, candidate_no, full_um, full_um * 0.4::DOUBLE AS goal, pow(10, floor(log10(full_um * 0.4::DOUBLE))) AS e FROM (SELECT detection_id, candidate_no, bbox_w * 0.1126::DOUBLE AS full_um FROM {candidate}) a) b) c) d""",
)
def _(m: Model) -> DataFrame:
    um = F.lit(0.1126)
    bar = m.candidate.select(*KEY, pg.scalebar(F.col("bbox_w"), um).alias("s"), pg.nice_length(F.col("bbox_w") * um * 0.4).alias("nice"))
    return bar.select(*KEY, F.col("s.um").alias("um"), F.round("s.pct", 6).alias("pct"), "nice")


@query("measure_polygons")
def _(m: Model) -> DataFrame:
    return sh.measure_polygons(outlined(m).select(*KEY, "polygon"), "polygon", F.lit(0.1126)).drop("polygon")


@query(
    "measure_polygons_closed_form",
    """SELECT detection_id, candidate_no, CAST(round_even(w * h * 3 / 4.0::DOUBLE, 0) AS BIGINT) AS area_px, round(0.75::DOUBLE, 4) AS fill_ratio, CAST(1 AS DOUBLE) AS solidity, CAST(1 AS DOUBLE) AS convexity,
 round(sqrt(greatest(mx, my) / least(mx, my)), 4) AS elongation, round(4 * sqrt(greatest(mx, my)) * 0.1126::DOUBLE, 3) AS major_um, round(greatest(w, h) * 0.1126::DOUBLE, 3) AS long_side_um FROM axes""",
    AXES,
)
def _(m: Model) -> DataFrame:
    q = sh.measure_polygons(outlined(m).select(*KEY, "polygon"), "polygon", F.lit(0.1126))
    return q.select(*KEY, "area_px", "fill_ratio", "solidity", "convexity", "elongation", "major_um", "long_side_um")


def loose(m: Model) -> DataFrame:
    """Candidates whose stored box is up to two pixels wider than their outline."""
    body = Box(F.col("bbox_x"), F.col("bbox_y"), F.col("bbox_w") - (F.col("candidate_no") % 3).cast("int"), F.col("bbox_h"))
    return m.candidate.withColumn("polygon", hexagon(body))


TIGHT = """tight AS (SELECT detection_id, candidate_no, mask_key, bbox_w, bbox_h, area_px, bbox_w - CAST(candidate_no % 3 AS INT) AS w, bbox_h AS h, concat(bbox_x, '_', bbox_y, '_', bbox_w - CAST(candidate_no % 3 AS INT), '_', bbox_h) AS new_key FROM {candidate})"""


@query(
    "tighten_boxes",
    """SELECT detection_id, mask_key, new_key, new_key <> mask_key AS changed, round(greatest(w, h) * 0.1126::DOUBLE, 2) AS long_side_um, round(least(w, h) * 0.1126::DOUBLE, 2) AS short_side_um, round(area_px / greatest(w * h, 1), 3) AS fill_ratio, w * h / (bbox_w * bbox_h) AS shrink FROM tight""",
    TIGHT,
)
def _(m: Model) -> DataFrame:
    return sh.tighten_boxes(loose(m), F.lit(0.1126))


@query("tighten_remapped_keys", "SELECT r.image_id, r.mask_key, coalesce(min(t.new_key), r.mask_key) AS new_key FROM (SELECT row_number() OVER (ORDER BY image_id, mask_key) AS rn, * FROM {correction}) r LEFT JOIN tight t ON t.detection_id = r.image_id AND t.mask_key = r.mask_key GROUP BY rn, r.image_id, r.mask_key", TIGHT)
def _(m: Model) -> DataFrame:
    return sh.remap_keys(m.correction, sh.tighten_boxes(loose(m), F.lit(0.1126)))


@query("project_epsg5179")
def _(m: Model) -> DataFrame:
    # Slides spread over the peninsula, by their number.
    lat, lon = F.col("slide_id") % 50 / 10.0 + 34, F.col("slide_id") % 40 / 10.0 + 126
    x, y = project_epsg5179(lat, lon)
    return m.slide.select("slide_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# Pixels: each vector of the given table is a slice, eight slices make a stack, its places are the pixels.
def stack_pixels(m: Model) -> DataFrame:
    e = m.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.select(F.floor(F.col("vec_id") / 8.0).alias("group"), "pos", (F.col("vec_id") % 8).cast("int").alias("slice"), F.abs(F.col("v").cast("double")).alias("score"), F.col("v").cast("double").alias("value"))


FOCUS = [
    """pix AS (SELECT CAST(floor(vec_id / 8.0) AS BIGINT) AS grp, CAST(u.p - 1 AS INT) AS pos, CAST(vec_id % 8 AS INT) AS slice, abs(CAST(u.v AS DOUBLE)) AS score, CAST(u.v AS DOUBLE) AS value FROM embeddings, UNNEST(embedding) WITH ORDINALITY AS u(v, p))""",
    """sharp AS (SELECT grp, pos, first(slice ORDER BY score DESC, slice) AS best, first(value ORDER BY score DESC, slice) AS fused, max(score) AS conf, max(slice) + 1 AS n FROM pix GROUP BY 1, 2)""",
    """gate AS (SELECT s.grp, g.half, quantile_cont(conf, 0.5) AS floor FROM sharp s JOIN (SELECT grp, quantile_cont(conf, 0.5) AS half FROM sharp GROUP BY 1) g ON g.grp = s.grp WHERE s.conf <= g.half GROUP BY 1, 2)""",
    """focus AS (SELECT s.grp AS "group", s.pos, s.best, s.fused, s.conf, CASE WHEN best = 0 OR best = n - 1 THEN best ELSE mid + greatest(-1, least(1, CASE WHEN abs(a.score - 2 * b.score + c.score) > 1e-6 THEN 0.5 * (a.score - c.score) / (a.score - 2 * b.score + c.score + 1e-12::DOUBLE) ELSE 0 END)) END AS depth, conf > half AND conf > 3 * floor AS trusted
 FROM (SELECT *, greatest(1, least(best, n - 2)) AS mid FROM sharp) s JOIN gate g ON g.grp = s.grp
 LEFT JOIN pix a ON a.grp = s.grp AND a.pos = s.pos AND a.slice = mid - 1 LEFT JOIN pix b ON b.grp = s.grp AND b.pos = s.pos AND b.slice = mid LEFT JOIN pix c ON c.grp = s.grp AND c.pos = s.pos AND c.slice = mid + 1)""",
]


@query("depth_from_focus", 'SELECT "group", pos, best, fused, conf, round(depth, 9) AS depth, trusted FROM focus', *FOCUS)
def _(m: Model) -> DataFrame:
    return px.depth_from_focus(stack_pixels(m)).withColumn("depth", F.round("depth", 9))


@query(
    "fusion_gain",
    """SELECT f."group", count(*) AS n_pixels, round(avg(f.conf), 9) AS fused, round(max(s.best_single), 9) AS best_single, round(avg(f.conf) / greatest(max(s.best_single), 1e-6), 6) AS gain FROM focus f
JOIN (SELECT grp, max(m) AS best_single FROM (SELECT p.grp, p.slice, avg(p.score) AS m FROM pix p JOIN focus t ON t."group" = p.grp AND t.pos = p.pos AND t.trusted GROUP BY 1, 2) q GROUP BY 1) s ON s.grp = f."group" WHERE f.trusted GROUP BY 1""",
    *FOCUS,
)
def _(m: Model) -> DataFrame:
    p = stack_pixels(m)
    g = px.fusion_gain(p, px.depth_from_focus(p))
    return g.select("group", "n_pixels", F.round("fused", 9).alias("fused"), F.round("best_single", 9).alias("best_single"), F.round("gain", 6).alias("gain"))


def pictures(m: Model) -> DataFrame:
    """A square picture out of each vector: the products of its places."""
    e = F.col("embedding")
    grey = F.flatten(F.transform(e, lambda a: F.transform(e, lambda b: a * b * 400 + 128)))
    return m.embeddings.select("vec_id", grey.alias("gray"), F.transform(grey, lambda v: v > 100).alias("mask"), F.size(e).alias("width"))


@query("texture_score")
def _(m: Model) -> DataFrame:
    return px.texture_score(pictures(m).withColumn("um_per_px", F.lit(0.1126)), ["vec_id"])


@query("image_sharpness")
def _(m: Model) -> DataFrame:
    return px.image_sharpness(pictures(m), ["vec_id"])


OUTLINES = [
    """drawn AS (SELECT r.image_id, coalesce(r.batch_id, 0) AS batch, r.mask_key, d.um_per_pixel AS um, list_transform(string_split(replace(replace(r.polygon, '[', ''), ']', ''), ','), lambda v: CAST(v AS DOUBLE)) AS p, row_number() OVER () AS k
 FROM {correction} r JOIN {detection} d ON d.detection_id = r.image_id WHERE r.geom_edited OR r.batch_id IS NULL)""",
    """sides AS (SELECT k, p[2 * i + 1] AS x0, p[2 * i + 2] AS y0, p[(2 * i + 2) % len(p) + 1] AS x1, p[(2 * i + 3) % len(p) + 1] AS y1 FROM (SELECT k, p, unnest(range(len(p) // 2)) AS i FROM drawn) q)""",
    """sums AS (SELECT k, sum(c) AS a2, sum((x0 + x1) * c) AS sx, sum((y0 + y1) * c) AS sy, sum(c * (x0 * x0 + x0 * x1 + x1 * x1)) AS xx, sum(c * (y0 * y0 + y0 * y1 + y1 * y1)) AS yy, sum(c * (2 * x0 * y0 + x0 * y1 + x1 * y0 + 2 * x1 * y1)) AS xy
 FROM (SELECT *, x0 * y1 - x1 * y0 AS c FROM sides) q GROUP BY k)""",
    """moments AS (SELECT k, abs(a2) / 2 AS area, xx / (6 * a2) - (sx / (3 * a2)) * (sx / (3 * a2)) AS m20, yy / (6 * a2) - (sy / (3 * a2)) * (sy / (3 * a2)) AS m02, xy / (12 * a2) - (sx / (3 * a2)) * (sy / (3 * a2)) AS m11 FROM sums)""",
    """axes2 AS (SELECT *, 2 * sqrt((m20 + m02 + sqrt((m20 - m02) * (m20 - m02) + 4 * m11 * m11)) / 2) AS a, 2 * sqrt((m20 + m02 - sqrt((m20 - m02) * (m20 - m02) + 4 * m11 * m11)) / 2) AS b, atan2(2 * m11, m20 - m02) / 2 AS t FROM moments)""",
    """turned AS (SELECT s.k, max(x0 * cos(t) + y0 * sin(t)) - min(x0 * cos(t) + y0 * sin(t)) AS w, max(y0 * cos(t) - x0 * sin(t)) - min(y0 * cos(t) - x0 * sin(t)) AS h FROM sides s JOIN axes2 x ON x.k = s.k GROUP BY s.k)""",
]


@query(
    "outline_measures",
    """SELECT image_id, batch, mask_key, CAST(round_even(area, 0) AS BIGINT) AS area_px, round(a / b, 4) AS elongation, round(2 * a * um, 3) AS major_um, round(2 * b * um, 3) AS minor_um,
 round(greatest(w, h) * um, 3) AS long_side_um, round(least(w, h) * um, 3) AS short_side_um, round(area * um * um, 3) AS area_um2 FROM drawn d JOIN axes2 x ON x.k = d.k JOIN turned t ON t.k = d.k""",
    *OUTLINES,
)
def _(m: Model) -> DataFrame:
    """Every outline of a person, edited or drawn, measured at the scale of its image."""
    r = m.correction.filter("geom_edited OR batch_id IS NULL").join(m.detection.select(F.col("detection_id").alias("image_id"), "um_per_pixel"), "image_id")
    r = r.select("image_id", F.coalesce("batch_id", F.lit(0)).alias("batch"), "mask_key", "um_per_pixel", F.from_json("polygon", "array<double>").alias("outline"))
    return sh.outline_measures(r, "outline", F.col("um_per_pixel")).drop("outline", "um_per_pixel")


@query(
    "polygon_axis",
    """SELECT image_id, batch, mask_key, round(a, 6) AS a, round(b, 6) AS b, round(degrees(t), 5) AS deg, round(a / b, 6) AS ratio FROM drawn d JOIN axes2 x ON x.k = d.k""",
    *OUTLINES[:-1],
)
def _(m: Model) -> DataFrame:
    """Axes and angle of the ellipse of each outline of a person; degrees from the x axis towards y."""
    r = m.correction.filter("geom_edited OR batch_id IS NULL").select("image_id", F.coalesce("batch_id", F.lit(0)).alias("batch"), "mask_key", F.from_json("polygon", "array<double>").alias("outline"))
    s = sh.basic_measures(r, "outline")
    return s.select("image_id", "batch", "mask_key", *(F.round(f"_e.{c}", n).alias(c) for c, n in (("a", 6), ("b", 6), ("deg", 5), ("ratio", 6))))
