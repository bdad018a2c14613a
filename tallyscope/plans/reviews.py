"""Queries on corrections, objects and the images they stand on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.boxes import mask_key, Box
from tallyscope.functions.projection import project_epsg3031
from tallyscope.operators import review as rv
from tallyscope.operators.overlay import overlaid, ranked, representative_detection, review_overlay, reviewing
from tallyscope.operators.verdict import collapse_boxes
from tallyscope.plans.base import OVERLAY, STORED, matching, query
from tallyscope.plans.verdicts import SIDE, SUMMARY
from tallyscope.session import keep
from tallyscope.sources.model import Model


def overlay(m: Model) -> DataFrame:
    return review_overlay(m.stored, reviewing(m.detection, m.batch), m.correction, m.object)


def shown_overlay(m: Model, state: str) -> DataFrame:
    """The rows of one state on the shown images. What is shown is decided per detection, before anything is laid over."""
    about = reviewing(m.detection, m.batch).select("detection_id", "batch_id", "viewpoint_id", "image_id", "image_kind", "um_per_pixel", "slide_id")
    shown = keep(rv.shown_images(overlaid(m.stored, about, m.correction)).select(*about.columns))
    return review_overlay(m.stored, shown, m.correction, m.object, gone_only=state == "gone").filter(F.col("state") == state)


@query(
    "review_overlay",
    """SELECT detection_id, mask_key, state, orphan, revived, cls, cls_auto, cls_user, area_px, bbox_x, bbox_y, bbox_w, bbox_h,
 CASE WHEN state = 'kept' THEN row_number() OVER (PARTITION BY detection_id, state ORDER BY area_px DESC, mask_key) - 1 END AS rank FROM overlay""",
    *OVERLAY,
)
def _(m: Model) -> DataFrame:
    cols = ["detection_id", "mask_key", "state", "orphan", "revived", "cls", "cls_auto", "cls_user", "area_px", *["bbox_" + s for s in "xywh"]]
    # Laid over once; what is kept is counted and numbered from the stored rows.
    o = keep(overlay(m).select(*cols))
    kept = ranked(o).select(*cols, "rank")
    return kept.unionByName(o.filter("state <> 'kept'").select(*cols, F.lit(None).cast("bigint").alias("rank")))


@query(
    "overlay_class_counts",
    """SELECT detection_id, count(*) FILTER (WHERE state = 'kept') AS n_kept, count(*) FILTER (WHERE passed) AS n_auto,
 count(*) FILTER (WHERE state = 'kept' AND cls = 'round') AS n_round, count(*) FILTER (WHERE state = 'kept' AND cls = 'rod') AS n_rod,
 count(*) FILTER (WHERE state = 'kept' AND revived) AS n_manual, count(*) FILTER (WHERE state = 'kept' AND cls_user) AS n_labeled
 FROM overlay GROUP BY detection_id""",
    *OVERLAY,
)
def _(m: Model) -> DataFrame:
    kept = F.col("state") == "kept"
    return (
        overlay(m)
        .groupBy("detection_id")
        .agg(
            F.count_if(kept).alias("n_kept"),
            F.count_if("passed").alias("n_auto"),
            *[F.count_if(kept & (F.col("cls") == c)).alias("n_" + c) for c in ("round", "rod")],
            F.count_if(kept & F.col("revived")).alias("n_manual"),
            F.count_if(kept & F.col("cls_user")).alias("n_labeled"),
        )
    )


SHOWN = """shown AS (SELECT o.* FROM overlay o JOIN (SELECT viewpoint_id, bool_or(image_kind = 'stack') AS fused FROM overlay GROUP BY 1) f
 ON f.viewpoint_id = o.viewpoint_id WHERE NOT f.fused OR o.image_kind = 'stack')"""


@query("candidate_rows", "SELECT slide_id, viewpoint_id, image_id, mask_key, cls, area_px FROM shown WHERE state = 'kept'", *OVERLAY, SHOWN)
def _(m: Model) -> DataFrame:
    return shown_overlay(m, "kept").select("slide_id", "viewpoint_id", "image_id", "mask_key", "cls", "area_px")


@query("candidate_rows_gone", "SELECT slide_id, viewpoint_id, image_id, mask_key, cls, area_px FROM shown WHERE state = 'gone'", *OVERLAY, SHOWN)
def _(m: Model) -> DataFrame:
    return shown_overlay(m, "gone").select("slide_id", "viewpoint_id", "image_id", "mask_key", "cls", "area_px")


@query(
    "kept_masks",
    """SELECT r.viewpoint_id, c.mask_key, c.area_px, row_number() OVER (PARTITION BY r.viewpoint_id ORDER BY c.area_px DESC, c.mask_key, c.candidate_no) - 1 AS pos,
 count(*) OVER (PARTITION BY r.viewpoint_id) AS n_kept,
 CASE WHEN o.label <> '' THEN o.label WHEN NOT c.passed THEN 'manual' WHEN c.cls <> '' THEN c.cls ELSE 'none' END AS mask_cls
 FROM stored c JOIN rep r ON r.detection_id = c.detection_id
 LEFT JOIN {correction} x ON x.image_id = r.image_id AND x.mask_key = c.mask_key AND x.batch_id IS NOT DISTINCT FROM r.batch_id
 LEFT JOIN {object} o ON o.object_id = x.object_id
 WHERE NOT coalesce(x.removed, FALSE) AND (c.passed OR coalesce(x.accepted, FALSE))""",
    STORED,
    SUMMARY,
)
def _(m: Model) -> DataFrame:
    from tallyscope.operators.overlay import kept_rule
    from tallyscope.operators.sequence import Blocks

    rep = representative_detection(reviewing(m.detection, m.batch)).select("detection_id", "viewpoint_id", "image_id", "batch_id")
    r = m.correction.join(m.object.select("object_id", "label"), "object_id", "left").select(
        "image_id", "batch_id", "mask_key", "removed", "accepted", "label"
    )
    c = m.stored.select("detection_id", "candidate_no", "mask_key", "area_px", "passed", "cls").join(rep, "detection_id")
    on = [c.image_id == r.image_id, c.mask_key == r.mask_key, c.batch_id.eqNullSafe(r.batch_id)]
    kept = c.join(r, on, "left").filter(kept_rule(c.passed, r.removed, r.accepted)).select(
        "viewpoint_id", "candidate_no", c.mask_key, "area_px", rv.mask_class(r.label, c.passed, c.cls).alias("mask_cls")
    )
    order = [(F.col("area_px"), False), (F.col("mask_key"), True), (F.col("candidate_no"), True)]
    placed = Blocks(["viewpoint_id"], [(F.col("area_px"), False)], order).row_number(kept, "pos")
    counts = kept.groupBy("viewpoint_id").agg(F.count("*").alias("n_kept"))
    return placed.join(counts, "viewpoint_id").select("viewpoint_id", "mask_key", "area_px", (F.col("pos") - 1).alias("pos"), "n_kept", "mask_cls")


# New detections for the re-binding: the boxes of the given rows, some of them moved by one pixel.
MOVED = """moved AS (SELECT DISTINCT ON (image_id, mask_key) image_id, batch_id, mask_key, bbox_x, bbox_y, bbox_w, bbox_h, area_px FROM (
 SELECT c.detection_id AS image_id, d.batch_id, bbox_x + CAST(c.candidate_no % 2 AS INT) AS bbox_x, bbox_y, bbox_w, bbox_h, c.candidate_no, area_px,
   concat(CAST(bbox_x + CAST(c.candidate_no % 2 AS INT) AS STRING), '_', bbox_y, '_', bbox_w, '_', bbox_h) AS mask_key
 FROM {candidate} c JOIN {detection} d ON d.detection_id = c.detection_id) s ORDER BY area_px DESC, candidate_no)"""
REBIND = [
    MOVED,
    """mine AS (SELECT *, dense_rank() OVER (ORDER BY image_id, batch_id, mask_key) AS rno FROM {correction} WHERE bind <> 'manual' AND batch_id IS NOT NULL)""",
    """fit AS (SELECT m.rno, c.mask_key FROM mine m JOIN moved c ON c.image_id = m.image_id AND c.batch_id = m.batch_id AND c.mask_key = m.mask_key)""",
    """free AS (SELECT c.*, row_number() OVER (ORDER BY image_id, batch_id, mask_key) AS cno FROM moved c
      WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.image_id = c.image_id AND m.batch_id = c.batch_id AND m.mask_key = c.mask_key))""",
    """near AS (SELECT * FROM (SELECT m.image_id AS grp, rno, cno, m.mask_key AS rk, c.mask_key AS ck, c.batch_id, ix * iy / (m.bbox_w * m.bbox_h + c.bbox_w * c.bbox_h - ix * iy) AS iou
 FROM mine m JOIN free c ON c.image_id = m.image_id AND c.batch_id = m.batch_id,
 LATERAL (SELECT greatest(0, least(m.bbox_x + m.bbox_w, c.bbox_x + c.bbox_w) - greatest(m.bbox_x, c.bbox_x)) AS ix,
                 greatest(0, least(m.bbox_y + m.bbox_h, c.bbox_y + c.bbox_h) - greatest(m.bbox_y, c.bbox_y)) AS iy) o
 WHERE m.rno NOT IN (SELECT rno FROM fit)) q WHERE iou >= 0.5)""",
    *matching("near", "grp", "rno", "cno", "iou DESC, rk, ck"),
]


@query(
    "rebind_reviews",
    """SELECT m.image_id, m.batch_id, m.mask_key AS review_key, coalesce(f.mask_key, t.ck) AS candidate_key,
 CASE WHEN f.mask_key IS NOT NULL THEN 'exact' WHEN t.ck IS NOT NULL THEN 'iou' ELSE 'orphan' END AS method,
 CASE WHEN f.mask_key IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE t.iou END AS score
 FROM mine m LEFT JOIN fit f ON f.rno = m.rno LEFT JOIN taken t ON t.rno = m.rno
 UNION ALL SELECT image_id, batch_id, mask_key, NULL, 'manual', NULL FROM {correction} WHERE NOT (bind <> 'manual' AND batch_id IS NOT NULL)""",
    *REBIND,
)
def _(m: Model) -> DataFrame:
    c = m.candidate.withColumn("bbox_x", F.col("bbox_x") + (F.col("candidate_no") % 2).cast("int"))
    c = collapse_boxes(c.withColumn("mask_key", mask_key(Box.of())))
    c = c.join(m.detection.select("detection_id", "batch_id"), "detection_id").withColumnRenamed("detection_id", "image_id")
    return rv.rebind_reviews(m.correction, c, max_side=SIDE)


@query(
    "neighbor_box_links",
    """SELECT a.image_id, a.box_no, count(*) FILTER (WHERE abs(bcx - acx) <= 0.75 * a.bbox_w AND abs(bcy - acy) <= 0.75 * a.bbox_h) AS n_near,
 count(*) FILTER (WHERE abs(bcx - acx) <= a.bbox_w AND abs(bcy - acy) <= a.bbox_h) AS n_wide,
 coalesce(max(iou), CAST(0 AS DOUBLE)) AS best_iou, CASE WHEN max(iou) > 0 THEN max(iou) - coalesce(max(iou, 2)[2], 0) END AS margin
FROM (SELECT * FROM bx WHERE nxt IS NOT NULL) a LEFT JOIN LATERAL (SELECT b.bbox_x + b.bbox_w / 2.0 AS bcx, b.bbox_y + b.bbox_h / 2.0 AS bcy, a.bbox_x + a.bbox_w / 2.0 AS acx, a.bbox_y + a.bbox_h / 2.0 AS acy,
   ix * iy / (a.bbox_w * a.bbox_h + b.bbox_w * b.bbox_h - ix * iy) AS iou
   FROM (SELECT *, greatest(0, least(a.bbox_x + a.bbox_w, b0.bbox_x + b0.bbox_w) - greatest(a.bbox_x, b0.bbox_x)) AS ix,
                 greatest(0, least(a.bbox_y + a.bbox_h, b0.bbox_y + b0.bbox_h) - greatest(a.bbox_y, b0.bbox_y)) AS iy FROM bx b0 WHERE b0.image_id = a.nxt) b) p ON TRUE
GROUP BY a.image_id, a.box_no""",
    STORED,
    """imgs AS (SELECT viewpoint_id, image_id, lead(image_id) OVER (PARTITION BY viewpoint_id ORDER BY image_id) AS nxt FROM
 (SELECT DISTINCT d.viewpoint_id, d.image_id FROM {detection} d JOIN stored s ON s.detection_id = d.detection_id WHERE d.is_current AND s.passed) q)""",
    """bx AS (SELECT i.viewpoint_id, i.image_id, i.nxt, s.candidate_no AS box_no, bbox_x, bbox_y, bbox_w, bbox_h FROM stored s JOIN imgs i ON i.image_id = s.detection_id WHERE s.passed)""",
)
def _(m: Model) -> DataFrame:
    d = m.detection.filter("is_current").select("detection_id", "viewpoint_id", "image_id")
    boxes = m.stored.filter("passed").join(d, "detection_id").select(
        "viewpoint_id", "image_id", F.col("image_id").alias("place"), F.col("candidate_no").alias("box_no"), *["bbox_" + s for s in "xywh"]
    )
    return rv.neighbor_box_links(boxes, "place", SIDE)


@query(
    "coverage_gap",
    """SELECT v.viewpoint_id, v.slide_id, coalesce(string_agg(DISTINCT b.label, ',' ORDER BY b.label), '') AS elsewhere
FROM {viewpoint} v LEFT JOIN {detection} d ON d.viewpoint_id = v.viewpoint_id AND d.is_current LEFT JOIN {batch} b ON b.batch_id = d.batch_id AND NOT b.for_review
WHERE v.viewpoint_id NOT IN (SELECT viewpoint_id FROM {detection} WHERE is_current AND batch_id = 1) GROUP BY 1, 2""",
)
def _(m: Model) -> DataFrame:
    return rv.coverage_gap(m.viewpoint, m.detection, m.batch)


@query(
    "link_mains",
    """SELECT object_id, count(*) AS n_members, first(image_id ORDER BY bbox_w * bbox_h DESC, image_id, mask_key DESC) AS main_image,
 first(mask_key ORDER BY bbox_w * bbox_h DESC, image_id, mask_key DESC) AS main_key, CAST(max(bbox_w * bbox_h) AS BIGINT) AS box_area
FROM {correction} GROUP BY object_id HAVING count(*) >= 2""",
)
def _(m: Model) -> DataFrame:
    return rv.link_mains(m.correction)


@query(
    "linked_siblings",
    """SELECT * FROM (SELECT r.object_id, image_id, mask_key, n_all - count(*) OVER (PARTITION BY r.object_id, image_id) AS n_elsewhere, n_images FROM {correction} r
JOIN (SELECT object_id, count(*) AS n_all, count(DISTINCT image_id) AS n_images FROM {correction} GROUP BY 1) t ON t.object_id = r.object_id) WHERE n_images > 1""",
)
def _(m: Model) -> DataFrame:
    return rv.linked_siblings(m.correction)


@query(
    "spread_drawn",
    """SELECT viewpoint_id, image_id, mask_key, object_id, is_home, CASE WHEN fused IS NOT NULL THEN image_id = fused ELSE is_home END AS is_rep FROM (
 SELECT viewpoint_id, image_id, mask_key, object_id, TRUE AS is_home FROM {correction} WHERE source = 'manual'
 UNION ALL SELECT r.viewpoint_id, d.image_id, r.mask_key, r.object_id, FALSE FROM {correction} r JOIN {detection} d ON d.viewpoint_id = r.viewpoint_id AND d.image_id <> r.image_id
 WHERE r.source = 'manual' AND d.is_current) s
 LEFT JOIN (SELECT viewpoint_id AS fv, min(image_id) AS fused FROM {detection} WHERE is_current AND image_kind = 'stack' GROUP BY 1) f ON fv = viewpoint_id""",
)
def _(m: Model) -> DataFrame:
    return rv.spread_drawn(m.correction.filter("source = 'manual'"), m.detection)


@query(
    "sibling_sample",
    """SELECT s.slide_id, coalesce(s.sample_id, d.sample_id) AS sample_id, CASE WHEN s.sample_id IS NULL THEN d.slide_id END AS taken_from
FROM {slide} s LEFT JOIN (SELECT DISTINCT ON (base_name) base_name, sample_id, slide_id FROM {slide} WHERE sample_id IS NOT NULL ORDER BY base_name, obs_no, slide_id) d ON d.base_name = s.base_name""",
)
def _(m: Model) -> DataFrame:
    return rv.sibling_sample(m.slide)


@query(
    "resolve_stem",
    """SELECT stem, CASE WHEN n = 1 THEN v END AS viewpoint_id, n AS n_found, CASE n WHEN 1 THEN '' WHEN 0 THEN 'unknown' ELSE 'ambiguous' END AS refused FROM (
SELECT s.stem, count(DISTINCT h.viewpoint_id) AS n, min(h.viewpoint_id) AS v FROM
 (SELECT DISTINCT concat('g', o_custkey * 2, '_focused') AS stem FROM orders UNION SELECT name FROM {frame}) s
 LEFT JOIN (SELECT concat(tag, '_focused') AS stem, viewpoint_id FROM {viewpoint} UNION ALL SELECT name, slide_id FROM {frame} UNION ALL SELECT name, slide_id + 1 FROM {frame} WHERE seq % 5 = 0) h ON h.stem = s.stem GROUP BY s.stem) q""",
)
def _(m: Model) -> DataFrame:
    stems = m.orders.select(F.concat(F.lit("g"), (F.col("o_custkey") * 2).cast("string"), F.lit("_focused")).alias("stem")).distinct()
    stems = stems.union(m.frame.select("name")).distinct()
    frames = m.frame.select("name", F.col("slide_id").alias("viewpoint_id")).union(m.frame.filter("seq % 5 = 0").select("name", F.col("slide_id") + 1))
    return rv.resolve_stem(stems, m.viewpoint, frames)


@query(
    "review_blocked",
    """SELECT slide_id, slug, state, CASE state WHEN 'pending' THEN 'waiting for detection' WHEN 'processing' THEN 'detection is running' ELSE 'detection failed' END AS why
FROM {slide} WHERE state <> 'done'""",
)
def _(m: Model) -> DataFrame:
    return rv.review_blocked(m.slide)


HISTORY = """hist AS (SELECT detection_id, CAST(floor(detection_id / CAST(4 AS DOUBLE)) AS BIGINT) AS image_id, CAST(run_id % 3 AS INT) AS batch_id, detection_id % 3 = 0 AS is_current, created_at, viewpoint_id FROM {detection})"""


def history(m: Model) -> DataFrame:
    """Several detections per image and batch, as repeated runs leave them."""
    return m.detection.select(
        "detection_id",
        F.floor(F.col("detection_id") / 4.0).alias("image_id"),
        (F.col("run_id") % 3).cast("int").alias("batch_id"),
        (F.col("detection_id") % 3 == 0).alias("is_current"),
        "created_at",
        "viewpoint_id",
    )


@query(
    "batch_raw_view",
    """SELECT h.batch_id, h.image_id, h.detection_id, count(*) FILTER (WHERE s.passed) AS n_passed, count(s.detection_id) AS n_masks FROM
 (SELECT DISTINCT ON (batch_id, image_id) * FROM hist ORDER BY batch_id, image_id, created_at DESC, detection_id DESC) h LEFT JOIN stored s ON s.detection_id = h.detection_id GROUP BY 1, 2, 3""",
    STORED,
    HISTORY,
)
def _(m: Model) -> DataFrame:
    latest = rv.latest_per_image(history(m), ["batch_id", "image_id"]).select("batch_id", "image_id", "detection_id")
    n = m.stored.groupBy("detection_id").agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_masks"))
    return latest.join(n, "detection_id", "left").fillna(0, ["n_passed", "n_masks"])


@query(
    "carry_scale",
    """SELECT slide_id, count(*) AS n_frames, first(um_per_pixel ORDER BY seq) / 0.5::DOUBLE AS um_per_pixel,
 greatest(abs(max(um_per_pixel) - first(um_per_pixel ORDER BY seq)), abs(min(um_per_pixel) - first(um_per_pixel ORDER BY seq))) > first(um_per_pixel ORDER BY seq) * 0.001::DOUBLE AS mixed
FROM {frame} GROUP BY slide_id""",
)
def _(m: Model) -> DataFrame:
    return rv.carry_scale(m.frame, ["slide_id"], 0.5)


# Approximate coordinates by site code without digits, for sites that have none of their own.
APPROX = [("ST", -70.0, 165.0)]


@query(
    "map_points",
    """SELECT s.site_id, s.code, CAST(sum(n) AS BIGINT) AS n_slides, avg(l.lat) IS NOT NULL AS exact, string_agg(DISTINCT l.code, ',' ORDER BY l.code) AS cores
FROM {site} s JOIN {locality} l ON l.site_id = s.site_id JOIN (SELECT locality_id, count(*) AS n FROM {slide} WHERE NOT hide_in_list GROUP BY 1) q ON q.locality_id = l.locality_id
GROUP BY 1, 2""",
)
def _(m: Model) -> DataFrame:
    approx = m.spark.createDataFrame(APPROX, "code string, lat double, lon double")
    return rv.map_points(m.site, m.locality, m.slide, approx, project_epsg3031).select("site_id", "code", "n_slides", "exact", "cores")


@query(
    "project_epsg3031",
    """SELECT locality_id, round(rho * sin(radians(lon)), 3) AS x, round(-rho * cos(radians(lon)), 3) AS y FROM (
SELECT *, 6378.137 * cos(radians(71)) / sqrt(1 - e * e * sin(radians(71)) * sin(radians(71))) * t / tc AS rho FROM (
SELECT *, tan(pi() / 4 + radians(lat) / 2) / pow((1 + e * sin(radians(lat))) / (1 - e * sin(radians(lat))), e / 2) AS t,
 tan(pi() / 4 - radians(71) / 2) / pow((1 - e * sin(radians(71))) / (1 + e * sin(radians(71))), e / 2) AS tc
FROM (SELECT *, sqrt(2 / 298.257223563::DOUBLE - 1 / (298.257223563::DOUBLE * 298.257223563::DOUBLE)) AS e FROM {locality} WHERE lat IS NOT NULL) a) b) c""",
)
def _(m: Model) -> DataFrame:
    x, y = project_epsg3031(F.col("lat"), F.col("lon"))
    return m.locality.filter(F.col("lat").isNotNull()).select("locality_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))
