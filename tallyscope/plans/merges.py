"""Queries on batch edits, reconciliation and back-filling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import linking as li
from tallyscope.operators import merge as mg
from tallyscope.operators import reconcile as rc
from tallyscope.operators import saving as sv
from tallyscope.operators.review import spread_drawn
from tallyscope.operators.rollup import done_viewpoints
from tallyscope.operators.verdict import Thresholds, classify
from tallyscope.plans.base import OVERLAY, STORED, query
from tallyscope.plans.reviews import HISTORY, history, overlay
from tallyscope.plans.rollups import DONE, slide_areas
from tallyscope.session import keep, use_shared_checkpoints
from tallyscope.sources.model import Model
from tallyscope.streaming.detections import DetectionStore, run_detections


@query(
    "export_diff",
    """SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'gone' WHEN a.content <> b.content THEN 'changed' ELSE 'same' END AS status FROM
 (SELECT image_path AS path, concat(batch_id, ':', slide_id) AS content FROM {detection}) a FULL JOIN
 (SELECT CASE WHEN detection_id % 13 = 0 THEN concat('old/', image_path) ELSE image_path END AS path, concat(batch_id, ':', CASE WHEN detection_id % 7 = 0 THEN 0 ELSE slide_id END) AS content FROM {detection}) b ON b.path = a.path""",
)
def _(m: Model) -> DataFrame:
    new = m.detection.select(F.col("image_path").alias("path"), F.expr("concat(batch_id, ':', slide_id)").alias("content"))
    stored = m.detection.selectExpr(
        "CASE WHEN detection_id % 13 = 0 THEN concat('old/', image_path) ELSE image_path END AS path", "concat(batch_id, ':', CASE WHEN detection_id % 7 = 0 THEN 0 ELSE slide_id END) AS content"
    )
    return mg.export_diff(new, stored)


SUMS = ["area_px", "major_um", "elongation", "ellipse_iou", "solidity", "texture"]


def metrics_sql(source: str) -> str:
    parts = [f"SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM {source}", f"SELECT 'passed', count(*) FILTER (WHERE passed)::DOUBLE FROM {source}"]
    parts += [f"SELECT 'sum_{c}', round(CAST(sum(CAST({c} AS DECIMAL(20,6))) AS DOUBLE), 3) FROM {source}" for c in SUMS]
    parts.append(f"SELECT concat('class:', cls), count(*)::DOUBLE FROM {source} GROUP BY cls")
    return " UNION ALL ".join(parts)


@query(
    "reconcile_sources",
    "SELECT coalesce(a.metric, b.metric) AS metric, a.value AS value_a, b.value AS value_b, a.value IS NOT DISTINCT FROM b.value AS same FROM ma a FULL JOIN mb b ON b.metric = a.metric",
    STORED,
    STORED.replace("stored AS", "other AS").replace("texture < 1000", "texture < 1100"),
    f"ma AS ({metrics_sql('stored')})",
    f"mb AS ({metrics_sql('other')})",
)
def _(m: Model) -> DataFrame:
    # The second copy was judged under another texture limit.
    other = classify(m.candidate, Thresholds(texture_min=1100.0))
    return mg.reconcile_sources(mg.source_metrics(m.stored, SUMS), mg.source_metrics(other, SUMS))


# The second copy of the reviews: some rows gone, some new, some changed.
COPY = [
    """firstcopy AS (SELECT r.image_id, r.batch_id, r.mask_key, r.removed, r.accepted, r.bind, r.polygon AS outline, o.label, o.note FROM {correction} r JOIN {object} o ON o.object_id = r.object_id)""",
    """secondcopy AS (SELECT CASE WHEN image_id % 61 = 0 THEN image_id + 1000000 ELSE image_id END AS image_id, batch_id, mask_key, removed, CASE WHEN image_id % 53 = 0 THEN NOT accepted ELSE accepted END AS accepted, bind,
  CASE WHEN image_id % 47 = 0 THEN NULL ELSE outline END AS outline, CASE WHEN image_id % 43 = 0 THEN 'other' ELSE label END AS label, note FROM firstcopy WHERE image_id % 59 <> 0)""",
]
ROW_KEYS, ROW_COLUMNS = ["image_id", "batch_id", "mask_key"], ["removed", "accepted", "bind", "outline", "label", "note"]


def review_copies(m: Model) -> tuple[DataFrame, DataFrame]:
    # Both copies come from these rows, and each is read twice.
    a = keep(m.correction.join(m.object.select("object_id", "label", "note"), "object_id").select(*ROW_KEYS, "removed", "accepted", "bind", F.col("polygon").alias("outline"), "label", "note"))
    b = a.filter("image_id % 59 <> 0").selectExpr(
        "CASE WHEN image_id % 61 = 0 THEN image_id + 1000000 ELSE image_id END AS image_id", "batch_id", "mask_key", "removed", "CASE WHEN image_id % 53 = 0 THEN NOT accepted ELSE accepted END AS accepted", "bind",
        "CASE WHEN image_id % 47 = 0 THEN NULL ELSE outline END AS outline", "CASE WHEN image_id % 43 = 0 THEN 'other' ELSE label END AS label", "note")
    return a, b


@query(
    "reconcile_rows",
    """SELECT * FROM (SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.batch_id, b.batch_id) AS batch_id, coalesce(a.mask_key, b.mask_key) AS mask_key,
 CASE WHEN b.image_id IS NULL THEN 'only_a' WHEN a.image_id IS NULL THEN 'only_b' WHEN a.n <> b.n THEN 'repeated' WHEN a.removed IS DISTINCT FROM b.removed OR a.accepted IS DISTINCT FROM b.accepted OR a.bind IS DISTINCT FROM b.bind OR a.outline IS DISTINCT FROM b.outline OR a.label IS DISTINCT FROM b.label OR a.note IS DISTINCT FROM b.note THEN 'changed' END AS status,
 CASE WHEN a.image_id IS NULL OR b.image_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.removed IS DISTINCT FROM b.removed THEN 'removed' END, CASE WHEN a.accepted IS DISTINCT FROM b.accepted THEN 'accepted' END, CASE WHEN a.bind IS DISTINCT FROM b.bind THEN 'bind' END,
  CASE WHEN a.outline IS DISTINCT FROM b.outline THEN 'outline' END, CASE WHEN a.label IS DISTINCT FROM b.label THEN 'label' END, CASE WHEN a.note IS DISTINCT FROM b.note THEN 'note' END) END AS columns
FROM (SELECT *, 1 AS n FROM firstcopy QUALIFY row_number() OVER (PARTITION BY image_id, batch_id, mask_key) = 1) a
FULL JOIN (SELECT *, 1 AS n FROM secondcopy QUALIFY row_number() OVER (PARTITION BY image_id, batch_id, mask_key) = 1) b ON b.image_id = a.image_id AND b.batch_id IS NOT DISTINCT FROM a.batch_id AND b.mask_key = a.mask_key) q WHERE status IS NOT NULL""",
    *COPY,
)
def _(m: Model) -> DataFrame:
    a, b = review_copies(m)
    return rc.differing_rows(a, b, ROW_KEYS, ROW_COLUMNS, once=True)


def review_metrics_sql(source: str, states: str) -> str:
    parts = [f"SELECT 'rows' AS metric, count(*) AS value FROM {source}", f"SELECT 'keys', count(*) FROM (SELECT DISTINCT image_id, mask_key FROM {source}) q"]
    parts += [f"SELECT '{n}', count(*) FILTER (WHERE {w}) FROM {source}" for n, w in (("removed", "removed"), ("accepted", "accepted"), ("notes", "note <> ''"), ("no_outline", "coalesce(outline, '') = ''"))]
    parts += [f"SELECT concat('{c}:', {c}), count(*) FROM {source} WHERE {c} <> '' GROUP BY {c}" for c in ("label", "bind")]
    return " UNION ALL ".join([*parts, f"SELECT concat('state:', state), count(*) FROM {states} GROUP BY state"])


@query(
    "reconcile_reviews",
    "SELECT coalesce(a.metric, b.metric) AS metric, a.value AS value_a, b.value AS value_b, a.value IS NOT DISTINCT FROM b.value AS same FROM ma a FULL JOIN mb b ON b.metric = a.metric",
    *OVERLAY,
    *COPY,
    "fewer AS (SELECT * FROM overlay WHERE image_id % 59 <> 0)",
    f"ma AS ({review_metrics_sql('firstcopy', 'overlay')})",
    f"mb AS ({review_metrics_sql('secondcopy', 'fewer')})",
)
def _(m: Model) -> DataFrame:
    a, b = review_copies(m)
    states = overlay(m).select("image_id", "state")
    return mg.reconcile_sources(rc.review_metrics(a, states), rc.review_metrics(b, states.filter("image_id % 59 <> 0")))


@query(
    "survey_drop_batch",
    """SELECT b.batch_id, b.label, coalesce(nd, 0) AS n_detections, coalesce(nr, 0) AS n_runs, CASE WHEN for_review THEN coalesce(nc, 0) ELSE 0 END AS n_reviewed, coalesce(nk, 0) AS n_candidates, coalesce(nx, 0) AS n_bound,
 CASE WHEN for_review AND nc > 0 THEN 'under review' WHEN nx > 0 THEN 'has corrections' ELSE '' END AS refused FROM {batch} b
LEFT JOIN (SELECT batch_id AS a, count(DISTINCT d.detection_id) AS nd, count(DISTINCT run_id) AS nr, count(DISTINCT d.detection_id) FILTER (WHERE is_current) AS nc, count(c.detection_id) AS nk FROM {detection} d LEFT JOIN {candidate} c ON c.detection_id = d.detection_id GROUP BY 1) d ON a = b.batch_id
LEFT JOIN (SELECT r.batch_id AS e, count(*) AS nx FROM {correction} r WHERE r.batch_id IS NOT NULL AND bind NOT IN ('orphan', 'manual')
  AND EXISTS (SELECT 1 FROM {detection} d JOIN {candidate} c ON c.detection_id = d.detection_id WHERE d.image_id = r.image_id AND d.batch_id = r.batch_id AND c.mask_key = r.mask_key) GROUP BY 1) r ON e = b.batch_id""",
)
def _(m: Model) -> DataFrame:
    return mg.survey_drop_batch(m.batch, m.detection, m.candidate, m.correction)


@query(
    "deletable",
    """SELECT s.sample_id, coalesce(n, 0) AS n_slides, CASE WHEN n > 0 THEN concat(n, ' slides') ELSE '' END AS why FROM {sample} s LEFT JOIN (SELECT sample_id, count(*) AS n FROM {slide} WHERE slide_id % 3 <> 0 GROUP BY 1) q ON q.sample_id = s.sample_id""",
)
def _(m: Model) -> DataFrame:
    return mg.deletable(m.sample, "sample_id", {"slides": m.slide.filter("slide_id % 3 <> 0")})


@query(
    "deletable_localities",
    """SELECT l.locality_id, coalesce(n, 0) AS n_samples, coalesce(p, 0) AS n_points, concat_ws(', ', CASE WHEN n > 0 THEN concat(n, ' samples') END, CASE WHEN p > 0 THEN concat(p, ' points') END) AS why
FROM {locality} l LEFT JOIN (SELECT locality_id, count(*) AS n FROM {sample} GROUP BY 1) s ON s.locality_id = l.locality_id LEFT JOIN (SELECT locality_id, count(*) AS p FROM {core_point} GROUP BY 1) c ON c.locality_id = l.locality_id""",
)
def _(m: Model) -> DataFrame:
    return mg.deletable(m.locality, "locality_id", {"samples": m.sample, "points": m.core_point})


@query(
    "reset_done",
    """SELECT w.viewpoint_id, w.batch_id, w.note, w.done AND NOT (w.batch_id IS NOT NULL AND h.viewpoint_id IS NOT NULL) AS done, w.done AND w.batch_id IS NOT NULL AND h.viewpoint_id IS NOT NULL AS changed FROM {viewpoint_review} w
LEFT JOIN (SELECT v.viewpoint_id FROM {viewpoint} v JOIN {slide} s ON s.slide_id = v.slide_id JOIN {locality} l ON l.locality_id = s.locality_id JOIN {site} t ON t.site_id = l.site_id WHERE t.area = 'polar' AND s.sample_id IS NOT NULL) h ON h.viewpoint_id = w.viewpoint_id""",
)
def _(m: Model) -> DataFrame:
    polar = m.viewpoint.join(slide_areas(m).filter("area = 'polar'"), "slide_id", "left_semi")
    return mg.reset_done(m.viewpoint_review, polar)


@query(
    "mark_all_done",
    """SELECT v.viewpoint_id, 1 AS batch_id, TRUE AS done, CASE WHEN w.done IS NULL THEN 'inserted' WHEN NOT w.done THEN 'flipped' ELSE 'same' END AS what FROM {viewpoint} v JOIN {slide} s ON s.slide_id = v.slide_id
LEFT JOIN {viewpoint_review} w ON w.viewpoint_id = v.viewpoint_id AND w.batch_id = 1 WHERE s.state = 'done'""",
)
def _(m: Model) -> DataFrame:
    finished = m.viewpoint.join(m.slide.filter("state = 'done'"), "slide_id", "left_semi")
    return mg.mark_all_done(m.viewpoint_review, finished, 1)


@query(
    "confirm_kept",
    """SELECT image_id, mask_key, NOT has_review AS is_new FROM overlay WHERE state = 'kept' AND NOT coalesce(auto_confirmed, FALSE) AND viewpoint_id IN (SELECT viewpoint_id FROM doneview)""",
    *OVERLAY,
    DONE,
)
def _(m: Model) -> DataFrame:
    return mg.confirm_kept(overlay(m), done_viewpoints(m.viewpoint_review, m.batch))


# Two batches: every third image also has rows of the other one, of objects nobody annotated.
SAVES = [
    STORED,
    """existing AS (SELECT image_id, viewpoint_id, batch_id, mask_key, object_id, removed, accepted, auto_confirmed, geom_edited, polygon AS outline, bind FROM {correction}
 UNION ALL SELECT image_id, viewpoint_id, 3 - batch_id, mask_key, object_id * 1000003 + 7, accepted, removed, FALSE, bbox_w % 2 = 0, polygon, 'exact' FROM {correction} WHERE source = 'engine' AND image_id % 3 = 0)""",
    """saves AS (SELECT detection_id AS image_id, CASE WHEN viewpoint_id % 5 = 0 THEN 2 ELSE 1 END AS batch_id, viewpoint_id, detection_id % 4 = 0 AS knows_edits, detection_id % 6 = 0 AS done FROM {detection} WHERE detection_id % 2 = 0)""",
    """payload AS (SELECT c.detection_id AS image_id, s.batch_id, mask_key, bool_or(bbox_x % 3 = 0) AS removed, bool_or(bbox_y % 4 = 0) AS accepted, max(CASE WHEN bbox_w % 5 = 0 THEN 'rod' END) AS label,
  max(CASE WHEN bbox_h % 7 = 0 THEN concat('[', bbox_x, ',', bbox_y, ',9,9,0,9]') WHEN bbox_h % 11 = 0 THEN '' END) AS outline
 FROM {candidate} c JOIN saves s ON s.image_id = c.detection_id WHERE bbox_x % 3 = 0 OR bbox_y % 4 = 0 OR bbox_w % 5 = 0 OR bbox_h % 7 = 0 OR bbox_h % 11 = 0 GROUP BY ALL
 UNION ALL SELECT o_orderkey, CASE WHEN floor(o_orderkey / 2) % 5 = 0 THEN 2 ELSE 1 END, '0_0_1_1', TRUE, FALSE, NULL, NULL FROM orders WHERE o_orderkey % 50 = 0)""",
    """detected AS (SELECT c.detection_id AS image_id, CASE WHEN d.viewpoint_id % 5 = 0 THEN 2 ELSE 1 END AS batch_id, d.viewpoint_id, c.mask_key, bool_or(passed) AS passed,
  max(concat('[', bbox_x, ',', bbox_y, ',', bbox_w, ',', bbox_h, ',0,0]')) AS outline FROM stored c JOIN {detection} d ON d.detection_id = c.detection_id GROUP BY ALL)""",
    """refused AS (SELECT image_id, batch_id, max(why) AS why FROM (
 SELECT p.image_id, p.batch_id, 'unknown key' AS why FROM payload p JOIN saves USING (image_id, batch_id) WHERE NOT EXISTS (SELECT 1 FROM detected c WHERE c.image_id = p.image_id AND c.batch_id = p.batch_id AND c.mask_key = p.mask_key)
   AND NOT EXISTS (SELECT 1 FROM existing c WHERE c.image_id = p.image_id AND c.batch_id = p.batch_id AND c.mask_key = p.mask_key)
 UNION ALL SELECT p.image_id, p.batch_id, 'no outline to go back to' FROM payload p JOIN saves USING (image_id, batch_id) WHERE p.outline = '' AND NOT EXISTS (SELECT 1 FROM detected c WHERE c.image_id = p.image_id AND c.batch_id = p.batch_id AND c.mask_key = p.mask_key)) q GROUP BY 1, 2)""",
    """open AS (SELECT s.*, why FROM saves s LEFT JOIN refused r ON r.image_id = s.image_id AND r.batch_id = s.batch_id)""",
    """sizes AS (SELECT object_id, count(*) AS n FROM existing GROUP BY 1)""",
    """olds AS (SELECT e.*, coalesce(b.label, '') AS label, coalesce(concat(b.species, b.grade, b.pose, b.note) <> '', FALSE) AS annotated, n >= 2 AS linked FROM existing e JOIN sizes z ON z.object_id = e.object_id LEFT JOIN {object} b ON b.object_id = e.object_id WHERE e.batch_id IS NOT NULL)""",
    """met AS (SELECT coalesce(o.image_id, p.image_id, c.image_id) AS image_id, coalesce(o.batch_id, p.batch_id, c.batch_id) AS batch_id, coalesce(o.mask_key, p.mask_key, c.mask_key) AS mask_key,
  o.image_id IS NOT NULL AS was, c.image_id IS NOT NULL AS seen, coalesce(o.viewpoint_id, c.viewpoint_id) AS viewpoint_id, o.object_id, o.annotated, o.linked, o.removed AS o_removed, o.accepted AS o_accepted, o.label AS o_label, coalesce(o.outline, '') AS o_outline, o.geom_edited AS o_edited, o.auto_confirmed AS o_confirmed, o.bind AS o_bind,
  p.removed AS p_removed, p.accepted AS p_accepted, p.label AS p_label, p.outline AS p_outline, c.passed, coalesce(c.outline, '') AS c_outline
 FROM olds o FULL JOIN payload p ON p.image_id = o.image_id AND p.batch_id = o.batch_id AND p.mask_key = o.mask_key
 FULL JOIN detected c ON c.image_id = coalesce(o.image_id, p.image_id) AND c.batch_id = coalesce(o.batch_id, p.batch_id) AND c.mask_key = coalesce(o.mask_key, p.mask_key))""",
    """ruled AS (SELECT m.*, s.image_id IS NOT NULL AS own, s.why, s.knows_edits, s.image_id IS NOT NULL AND s.why IS NULL AS spoken,
  q.viewpoint_id IS NOT NULL AS signs
 FROM met m LEFT JOIN open s ON s.image_id = m.image_id AND s.batch_id = m.batch_id
 LEFT JOIN (SELECT DISTINCT viewpoint_id, batch_id FROM open WHERE done AND why IS NULL) q ON q.viewpoint_id = coalesce(m.viewpoint_id, s.viewpoint_id) AND q.batch_id = m.batch_id)""",
    """after AS (SELECT *, CASE WHEN spoken THEN coalesce(p_removed, FALSE) OR coalesce(p_accepted, FALSE) OR p_label IS NOT NULL OR p_outline IS NOT NULL OR coalesce((o_edited AND NOT knows_edits) OR annotated OR o_confirmed OR linked, FALSE) ELSE was END AS stands,
  CASE WHEN spoken THEN coalesce(p_removed, FALSE) ELSE coalesce(o_removed, FALSE) END AS removed, CASE WHEN spoken THEN coalesce(p_accepted, FALSE) ELSE coalesce(o_accepted, FALSE) END AS accepted,
  CASE WHEN spoken THEN coalesce(p_label, '') ELSE coalesce(o_label, '') END AS label,
  CASE WHEN spoken AND p_outline <> '' THEN p_outline WHEN spoken AND (p_outline = '' OR o_outline = '') THEN c_outline ELSE o_outline END AS outline,
  CASE WHEN spoken AND p_outline IS NOT NULL THEN p_outline <> '' ELSE coalesce(o_edited, FALSE) END AS geom_edited, CASE WHEN spoken AND seen THEN 'exact' ELSE coalesce(o_bind, 'orphan') END AS bind FROM ruled WHERE own OR signs)""",
    """signed AS (SELECT *, signs AND seen AND ((passed AND NOT (stands AND removed)) OR (NOT passed AND stands AND accepted)) AND NOT (stands AND coalesce(o_confirmed, FALSE)) AS confirm FROM after)""",
    """changes AS (SELECT image_id, batch_id, mask_key, was, stands OR confirm AS stands, why, object_id, o_removed, o_accepted, o_label, o_outline, o_edited, o_confirmed, o_bind,
  NOT (confirm AND NOT stands) AND removed AS removed, NOT (confirm AND NOT stands) AND accepted AS accepted, CASE WHEN confirm AND NOT stands THEN '' ELSE label END AS label, CASE WHEN confirm AND NOT stands THEN c_outline ELSE outline END AS outline,
  NOT (confirm AND NOT stands) AND geom_edited AS geom_edited, coalesce(o_confirmed, FALSE) OR confirm AS auto_confirmed, CASE WHEN confirm AND NOT stands THEN 'exact' ELSE bind END AS bind FROM signed)""",
    """saved AS (SELECT image_id, batch_id, mask_key, CASE WHEN why IS NOT NULL THEN 'refused' WHEN NOT was THEN 'insert' WHEN NOT stands THEN 'delete'
  WHEN removed = o_removed AND accepted = o_accepted AND label = o_label AND outline = o_outline AND geom_edited = o_edited AND auto_confirmed = o_confirmed AND bind = o_bind THEN 'same' ELSE 'update' END AS what, why,
  removed, accepted, label, outline, geom_edited, auto_confirmed, bind, object_id FROM changes WHERE was OR stands)""",
]


def review_tables(m: Model) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """existing, saves, payload and candidates of :func:`saving.save_review`."""
    c = m.correction
    cols = ["image_id", "viewpoint_id", "batch_id", "mask_key", "object_id", "removed", "accepted", "auto_confirmed", "geom_edited", "polygon AS outline", "bind"]
    beside = c.filter("source = 'engine' AND image_id % 3 = 0").selectExpr(
        "image_id", "viewpoint_id", "3 - batch_id AS batch_id", "mask_key", "object_id * 1000003 + 7 AS object_id", "accepted AS removed", "removed AS accepted", "false AS auto_confirmed", "bbox_w % 2 = 0 AS geom_edited", "polygon AS outline", "'exact' AS bind")
    existing = c.selectExpr(*cols).unionByName(beside)
    batch = F.expr("CASE WHEN viewpoint_id % 5 = 0 THEN 2 ELSE 1 END").alias("batch_id")
    saves = m.detection.filter("detection_id % 2 = 0").select(
        F.col("detection_id").alias("image_id"), batch, "viewpoint_id", F.expr("detection_id % 4 = 0 AS knows_edits"), F.expr("detection_id % 6 = 0 AS done"))
    said = m.candidate.filter("bbox_x % 3 = 0 OR bbox_y % 4 = 0 OR bbox_w % 5 = 0 OR bbox_h % 7 = 0 OR bbox_h % 11 = 0").selectExpr(
        "detection_id AS image_id", "mask_key", "bbox_x % 3 = 0 AS removed", "bbox_y % 4 = 0 AS accepted", "CASE WHEN bbox_w % 5 = 0 THEN 'rod' END AS label",
        "CASE WHEN bbox_h % 7 = 0 THEN concat('[', bbox_x, ',', bbox_y, ',9,9,0,9]') WHEN bbox_h % 11 = 0 THEN '' END AS outline")
    wrong = m.orders.filter("o_orderkey % 50 = 0").selectExpr(
        "o_orderkey AS image_id", "'0_0_1_1' AS mask_key", "true AS removed", "false AS accepted", "CAST(NULL AS STRING) AS label", "CAST(NULL AS STRING) AS outline")
    # The batch of a row follows from its image; what is sent for other images than those saved is left out by the save.
    payload = said.unionByName(wrong).filter("image_id % 2 = 0").withColumn("batch_id", F.expr("CASE WHEN floor(image_id / 2) % 5 = 0 THEN 2 ELSE 1 END"))
    # Boxes are met with the images; keys and outlines are written after.
    seen = m.stored.select("detection_id", "passed", *["bbox_" + c for c in "xywh"]).join(m.detection.select("detection_id", "viewpoint_id"), "detection_id")
    detected = seen.select(
        F.col("detection_id").alias("image_id"), batch, "viewpoint_id", F.expr("concat(bbox_x, '_', bbox_y, '_', bbox_w, '_', bbox_h) AS mask_key"), "passed", F.expr("concat('[', bbox_x, ',', bbox_y, ',', bbox_w, ',', bbox_h, ',0,0]') AS outline"))
    return existing, saves, payload, detected


@query("save_review", "SELECT * FROM saved", *SAVES)
def _(m: Model) -> DataFrame:
    return sv.save_review(*review_tables(m), m.object)


@query(
    "save_review_labels",
    """SELECT object_id, label FROM (SELECT s.object_id, last(s.label ORDER BY s.image_id, s.batch_id, s.mask_key) AS label, max(coalesce(b.label, '')) AS was FROM saved s LEFT JOIN {object} b ON b.object_id = s.object_id WHERE what IN ('update', 'insert') AND s.object_id IS NOT NULL GROUP BY 1) q WHERE label <> was""",
    *SAVES,
)
def _(m: Model) -> DataFrame:
    return sv.relabelled(sv.save_review(*review_tables(m), m.object), m.object)


DRAWN = [
    """olddrawn AS (SELECT r.image_id, r.mask_key, r.polygon AS outline, b.label, r.object_id FROM {correction} r LEFT JOIN {object} b ON b.object_id = r.object_id WHERE r.batch_id IS NULL AND r.image_id % 3 <> 0)""",
    """newdrawn AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 31 = 0 THEN '1_2_3_4' ELSE concat('m', lpad(lower(hex(o_orderkey + o_orderkey % 2)), 8, '0')) END AS mask_key, CASE WHEN o_orderkey % 4 = 0 THEN 'rod' ELSE '' END AS label, concat('[1,1,', o_orderkey % 9, ',9,1,9]') AS outline
 FROM orders WHERE o_orderkey % 23 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0)""",
    """baddrawn AS (SELECT DISTINCT image_id FROM newdrawn WHERE NOT regexp_full_match(mask_key, 'm[0-9a-f]{{8}}'))""",
]


@query(
    "save_drawn",
    """SELECT coalesce(o.image_id, p.image_id) AS image_id, coalesce(o.mask_key, p.mask_key) AS mask_key,
 CASE WHEN b.image_id IS NOT NULL THEN 'refused' WHEN o.image_id IS NULL THEN 'insert' WHEN p.image_id IS NULL THEN 'delete' WHEN o.outline = p.outline AND coalesce(o.label, '') = p.label THEN 'same' ELSE 'update' END AS what,
 CASE WHEN b.image_id IS NOT NULL THEN 'not the key of a drawing' END AS why, coalesce(CASE WHEN b.image_id IS NULL AND p.image_id IS NOT NULL THEN p.label ELSE o.label END, '') AS label,
 CASE WHEN b.image_id IS NULL AND p.image_id IS NOT NULL THEN p.outline ELSE o.outline END AS outline, o.object_id
FROM olddrawn o FULL JOIN newdrawn p ON p.image_id = o.image_id AND p.mask_key = o.mask_key LEFT JOIN baddrawn b ON b.image_id = coalesce(o.image_id, p.image_id)
WHERE b.image_id IS NULL OR o.image_id IS NOT NULL""",
    *DRAWN,
)
def _(m: Model) -> DataFrame:
    existing = m.correction.join(m.object.select("object_id", "label"), "object_id", "left").select("image_id", "batch_id", "mask_key", F.col("polygon").alias("outline"), "label", "object_id")
    drawn = m.orders.filter("o_orderkey % 23 = 0 AND o_orderkey % 5 <> 0").selectExpr(
        "o_orderkey AS image_id", "CASE WHEN o_orderkey % 31 = 0 THEN '1_2_3_4' ELSE concat('m', lpad(lower(hex(o_orderkey + o_orderkey % 2)), 8, '0')) END AS mask_key",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'rod' ELSE '' END AS label", "concat('[1,1,', o_orderkey % 9, ',9,1,9]') AS outline")
    images = m.orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("image_id"))
    return sv.save_drawn(existing, drawn, images)


EDITS = """edits AS (SELECT object_id, object_id % 12 = 0 AS remove, CASE WHEN object_id % 2 = 0 THEN 'Edited name' END AS species, CASE WHEN object_id % 3 = 0 THEN '' END AS grade, CASE WHEN object_id % 5 = 0 THEN 'other' END AS pose, CASE WHEN object_id % 4 <> 0 THEN '' END AS note FROM {object} WHERE object_id % 11 < 5)"""


@query(
    "catalog_edit",
    """SELECT object_id, species, grade, pose, note, CASE WHEN remove AND n > 1 THEN 'refused: linked' WHEN remove THEN 'removed' WHEN species = '' AND grade = '' AND pose = '' AND note = '' THEN 'pruned' ELSE 'saved' END AS what FROM (
SELECT o.object_id, e.remove, coalesce(e.species, o.species) AS species, coalesce(e.grade, o.grade) AS grade, coalesce(e.pose, o.pose) AS pose, coalesce(e.note, o.note) AS note, (SELECT count(*) FROM {correction} r WHERE r.object_id = o.object_id) AS n FROM {object} o JOIN edits e ON e.object_id = o.object_id) q""",
    EDITS,
)
def _(m: Model) -> DataFrame:
    edits = m.object.filter("object_id % 11 < 5").selectExpr(
        "object_id", "object_id % 12 = 0 AS remove", "CASE WHEN object_id % 2 = 0 THEN 'Edited name' END AS species", "CASE WHEN object_id % 3 = 0 THEN '' END AS grade",
        "CASE WHEN object_id % 5 = 0 THEN 'other' END AS pose", "CASE WHEN object_id % 4 <> 0 THEN '' END AS note",
    )
    return mg.catalog_edit(m.object, edits, m.correction)


REQUESTS = [
    """requests AS (SELECT r.viewpoint_id * 6 + r.bbox_h % 6 AS link_id, r.image_id, r.mask_key, r.viewpoint_id, r.bbox_x % 2 = 0 AS is_rep, r.removed, o.label, o.species, o.note, r.object_id FROM {correction} r JOIN {object} o ON o.object_id = r.object_id)""",
    "linked AS (SELECT object_id FROM {correction} GROUP BY 1 HAVING count(*) > 2)",
]


@query(
    "link_objects",
    """SELECT link_id, count(*) AS n_members, coalesce(max(nullif(label, '')), '') AS label, coalesce(max(nullif(species, '')), '') AS species, coalesce(string_agg(DISTINCT nullif(note, ''), ' / ' ORDER BY nullif(note, '')), '') AS note,
 CASE WHEN count(*) < 2 THEN 'too few members' WHEN count(DISTINCT viewpoint_id) > 1 THEN 'several viewpoints' WHEN count(DISTINCT image_id) < count(*) THEN 'one image twice' WHEN count(*) FILTER (WHERE is_rep) <> 1 THEN 'not one representative'
 WHEN bool_or(removed) THEN 'removed member' WHEN bool_or(object_id IN (SELECT object_id FROM linked)) THEN 'already linked' WHEN count(DISTINCT nullif(label, '')) > 1 OR count(DISTINCT nullif(species, '')) > 1 THEN 'conflict' ELSE '' END AS why
FROM requests GROUP BY link_id""",
    *REQUESTS,
)
def _(m: Model) -> DataFrame:
    r = m.correction.join(m.object.select("object_id", "label", "species", "note"), "object_id").selectExpr(
        "viewpoint_id * 6 + bbox_h % 6 AS link_id", "image_id", "mask_key", "viewpoint_id", "bbox_x % 2 = 0 AS is_rep", "removed", "label", "species", "note", "object_id"
    )
    linked = m.correction.groupBy("object_id").agg(F.count("*").alias("n")).filter("n > 2")
    return mg.link_objects(r, linked)


# Two requests a viewpoint and shape, of which every fifth mask is in both; most rows have an object of their own.
SETTLED = [
    STORED,
    """judged AS (SELECT image_id, mask_key, r.viewpoint_id, r.batch_id, CASE WHEN r.bbox_w % 6 = 0 THEN r.object_id ELSE r.image_id * 100000 + bbox_x * 1000 + bbox_y * 10 + bbox_w % 10 END AS object_id, r.removed, r.accepted,
  CASE WHEN bbox_h % 4 = 0 THEN o.label ELSE '' END AS label, CASE WHEN bbox_h % 6 = 0 THEN o.species ELSE '' END AS species FROM {correction} r JOIN {object} o ON o.object_id = r.object_id)""",
    """asked AS (SELECT r.viewpoint_id * 8 + (n + bbox_h) % 4 AS link_id, r.viewpoint_id, CASE WHEN r.viewpoint_id % 3 = 0 THEN min(CASE WHEN r.bbox_w % 6 = 0 THEN r.object_id END) OVER (PARTITION BY r.viewpoint_id * 8 + (n + bbox_h) % 4) END AS target_id,
  r.image_id, r.mask_key, row_number() OVER (PARTITION BY r.viewpoint_id * 8 + (n + bbox_h) % 4 ORDER BY r.image_id, r.mask_key) = 1 AS is_rep, CASE WHEN r.viewpoint_id % 2 = 0 THEN 'rod' END AS label, CASE WHEN r.viewpoint_id % 4 = 0 THEN '' END AS species
 FROM {correction} r JOIN (SELECT unnest([0, 1]) AS n) z ON n = 0 OR bbox_w % 5 = 0 WHERE r.mask_key IN (SELECT min(mask_key) FROM {correction} q GROUP BY q.image_id, q.bbox_h % 4) AND NOT r.removed)""",
    """sides AS (SELECT DISTINCT a.link_id AS x, b.link_id AS y FROM asked a JOIN asked b ON a.image_id = b.image_id AND a.mask_key = b.mask_key)""",
    """rec_reach AS (SELECT x, y FROM sides UNION SELECT r.x, s.y FROM rec_reach r JOIN sides s ON s.x = r.y)""",
    """roots AS (SELECT x AS link_id, min(y) AS group_id FROM rec_reach GROUP BY 1)""",
    """named AS (SELECT a.*, group_id FROM asked a JOIN roots r ON r.link_id = a.link_id)""",
    """masks AS (SELECT group_id, image_id, mask_key, bool_or(is_rep AND link_id = group_id) AS is_rep, min(viewpoint_id) AS v0, max(viewpoint_id) AS v1 FROM named GROUP BY 1, 2, 3)""",
    """chosen AS (SELECT group_id, min(target_id) FILTER (WHERE link_id = group_id) AS target_id, arg_min(label, link_id) AS label, arg_min(species, link_id) AS species FROM named GROUP BY 1)""",
    """olds AS (SELECT image_id, mask_key, max(object_id) AS object_id, bool_or(removed) AS removed, bool_or(accepted) AS accepted, max(label) AS label, max(species) AS species, max(viewpoint_id) AS rv, bool_or(batch_id IS NULL) AS drawn FROM judged GROUP BY 1, 2)""",
    """seen AS (SELECT c.detection_id AS image_id, c.mask_key, max(d.viewpoint_id) AS cv, bool_or(passed) AS passed FROM stored c JOIN {detection} d ON d.detection_id = c.detection_id GROUP BY 1, 2)""",
    """sizes AS (SELECT object_id, count(*) AS n FROM judged GROUP BY 1)""",
    """m AS (SELECT k.*, o.object_id, o.removed, o.accepted, o.label, o.species, o.rv, coalesce(o.drawn, FALSE) AS drawn, s.cv, s.passed, c.target_id, c.label AS clabel, c.species AS cspecies, z.n AS size FROM masks k LEFT JOIN olds o ON o.image_id = k.image_id AND o.mask_key = k.mask_key
  LEFT JOIN seen s ON s.image_id = k.image_id AND s.mask_key = k.mask_key JOIN chosen c ON c.group_id = k.group_id LEFT JOIN sizes z ON z.object_id = o.object_id)""",
    """g AS (SELECT group_id, CASE WHEN count(*) < 2 THEN 'too few members' WHEN count(*) FILTER (WHERE is_rep) <> 1 THEN 'not one representative' WHEN count(DISTINCT image_id) < count(*) THEN 'one image twice'
  WHEN bool_or(cv IS NULL AND NOT drawn) THEN 'unknown mask' WHEN bool_or(v0 IS DISTINCT FROM v1 OR coalesce(cv, rv) IS DISTINCT FROM v0) THEN 'several viewpoints' WHEN bool_or(coalesce(removed, FALSE)) THEN 'removed member'
  WHEN bool_or(coalesce(size > 1, FALSE) AND object_id IS DISTINCT FROM target_id) THEN 'already linked'
  WHEN (count(DISTINCT nullif(label, '')) > 1 AND max(clabel) IS NULL) OR (count(DISTINCT nullif(species, '')) > 1 AND max(cspecies) IS NULL) THEN 'conflict' ELSE '' END AS why,
  coalesce(max(target_id), max(object_id) FILTER (WHERE is_rep), min(object_id)) AS home, coalesce(max(clabel), max(nullif(label, '')), '') AS nlabel, coalesce(max(cspecies), max(nullif(species, '')), '') AS nspecies FROM m GROUP BY 1)""",
    """settled AS (SELECT m.group_id AS link_id, image_id, mask_key, CASE WHEN why <> '' THEN 'refused' WHEN object_id IS NULL THEN 'created' WHEN object_id = home THEN 'stays' ELSE 'moved' END AS what, why, CASE WHEN why = '' THEN home ELSE object_id END AS object_id, is_rep,
  coalesce(accepted, FALSE) OR coalesce(why = '' AND cv IS NOT NULL AND NOT passed, FALSE) AS accepted, CASE WHEN why = '' THEN nlabel ELSE coalesce(label, '') END AS label, CASE WHEN why = '' THEN nspecies ELSE coalesce(species, '') END AS species FROM m JOIN g ON g.group_id = m.group_id
 UNION ALL SELECT g.group_id, j.image_id, j.mask_key, 'split', '', NULL, TRUE, coalesce(j.accepted, FALSE), coalesce(j.label, ''), coalesce(j.species, '') FROM judged j JOIN g ON g.home = j.object_id AND why = ''
  WHERE NOT EXISTS (SELECT 1 FROM masks k WHERE k.group_id = g.group_id AND k.image_id = j.image_id AND k.mask_key = j.mask_key))""",
]


@query("settle_links", "SELECT * FROM settled", *SETTLED)
def _(m: Model) -> DataFrame:
    c = m.correction
    judged = c.join(m.object.select("object_id", "label", "species"), "object_id").selectExpr(
        "image_id", "mask_key", "viewpoint_id", "batch_id", "CASE WHEN bbox_w % 6 = 0 THEN object_id ELSE image_id * 100000 + bbox_x * 1000 + bbox_y * 10 + bbox_w % 10 END AS object_id", "removed", "accepted",
        "CASE WHEN bbox_h % 4 = 0 THEN label ELSE '' END AS label", "CASE WHEN bbox_h % 6 = 0 THEN species ELSE '' END AS species")
    firsts = c.groupBy("image_id", F.col("bbox_h") % 4).agg(F.min("mask_key").alias("mask_key")).select("mask_key").distinct()
    n = F.explode(F.when(F.col("bbox_w") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n")
    rows = c.filter("not removed").join(firsts, "mask_key", "left_semi").select("*", n).withColumn("link_id", F.expr("viewpoint_id * 8 + (n + bbox_h) % 4"))
    heads = rows.groupBy("link_id").agg(F.min(F.when(F.col("bbox_w") % 6 == 0, F.col("object_id"))).alias("_t"), F.min(F.struct("image_id", "mask_key")).alias("_h"))
    asked = rows.join(heads, "link_id").select(
        "link_id", "viewpoint_id", F.when(F.col("viewpoint_id") % 3 == 0, F.col("_t")).alias("target_id"), "image_id", "mask_key", (F.struct("image_id", "mask_key") == F.col("_h")).alias("is_rep"),
        F.when(F.col("viewpoint_id") % 2 == 0, "rod").alias("label"), F.when(F.col("viewpoint_id") % 4 == 0, "").alias("species"))
    seen = m.stored.join(m.detection.select("detection_id", "viewpoint_id"), "detection_id").select(F.col("detection_id").alias("image_id"), "mask_key", "viewpoint_id", "passed")
    return li.settle_links(asked, judged, seen)


@query(
    "unlink_objects",
    """SELECT r.image_id, r.mask_key, concat(r.object_id, ':', r.image_id, ':', r.mask_key) AS new_object, o.label, o.species, o.grade, o.pose, o.note, TRUE AS is_rep FROM {correction} r JOIN {object} o ON o.object_id = r.object_id WHERE r.object_id IN (SELECT object_id FROM linked)""",
    REQUESTS[1],
)
def _(m: Model) -> DataFrame:
    linked = m.correction.groupBy("object_id").agg(F.count("*").alias("n")).filter("n > 2")
    return mg.unlink_objects(m.correction, m.object, linked)


@query("prune_objects", "SELECT object_id FROM {object} WHERE object_id NOT IN (SELECT object_id FROM {correction} WHERE NOT removed)")
def _(m: Model) -> DataFrame:
    # Objects whose members were all removed have nothing left to stand for.
    return mg.prune_objects(m.object, m.correction.filter("NOT removed"))


@query("reelect_reps", "SELECT object_id, image_id, mask_key FROM (SELECT *, bool_or(is_rep) OVER (PARTITION BY object_id) AS has, row_number() OVER (PARTITION BY object_id ORDER BY image_id, mask_key) AS rn FROM {correction}) q WHERE NOT has AND rn = 1")
def _(m: Model) -> DataFrame:
    return mg.reelect_reps(m.correction)


@query(
    "fix_drawn_reps",
    """SELECT object_id, mask_key, to_image, from_image FROM (SELECT r.object_id, r.mask_key, min(d.image_id) FILTER (WHERE d.image_kind = 'stack') AS to_image, min(d.image_id) FILTER (WHERE d.image_id = r.image_id) AS from_image
 FROM {correction} r JOIN {detection} d ON d.viewpoint_id = r.viewpoint_id AND (d.is_current OR d.image_id = r.image_id) WHERE r.source = 'manual' GROUP BY 1, 2) q WHERE to_image IS NOT NULL AND to_image IS DISTINCT FROM from_image""",
)
def _(m: Model) -> DataFrame:
    # Older placements, where the image a mask was drawn on still represents it.
    placed = spread_drawn(m.correction.filter("source = 'manual'"), m.detection).withColumn("is_rep", F.col("is_home"))
    return mg.fix_drawn_reps(placed.join(m.detection.select("image_id", "image_kind"), "image_id"))


@query(
    "backfill_objects",
    """SELECT object_id, coalesce(max(label) FILTER (WHERE is_rep), CASE WHEN count(DISTINCT label) = 1 THEN max(label) END, '') AS label, coalesce(max(note) FILTER (WHERE is_rep), CASE WHEN count(DISTINCT note) = 1 THEN max(note) END, '') AS note,
 concat_ws(',', CASE WHEN count(DISTINCT label) > 1 THEN 'label' END, CASE WHEN count(DISTINCT note) > 1 THEN 'note' END) AS conflict
FROM (SELECT object_id, is_rep, CASE bbox_x % 6 WHEN 0 THEN 'rod' WHEN 1 THEN 'round' END AS label, CASE WHEN bbox_y % 7 = 0 THEN concat('n', bbox_y) END AS note FROM {correction}) q GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    j = m.correction.selectExpr(
        "object_id", "is_rep", "CASE bbox_x % 6 WHEN 0 THEN 'rod' WHEN 1 THEN 'round' ELSE '' END AS label", "CASE WHEN bbox_y % 7 = 0 THEN concat('n', bbox_y) ELSE '' END AS note"
    )
    return mg.backfill_objects(j, ["label", "note"])


@query(
    "backfill_batch_of_reviews",
    """SELECT r.image_id, r.mask_key, CASE WHEN n = 1 THEN b END AS batch_id, CASE WHEN n IS NULL THEN 'no current detection' WHEN n > 1 THEN 'several batches' ELSE '' END AS why
FROM (SELECT DISTINCT CAST(floor(image_id / CAST(4 AS DOUBLE)) AS BIGINT) AS image_id, mask_key FROM {correction}) r LEFT JOIN (SELECT image_id, count(DISTINCT batch_id) AS n, min(batch_id) AS b FROM hist WHERE is_current GROUP BY 1) h ON h.image_id = r.image_id""",
    HISTORY,
)
def _(m: Model) -> DataFrame:
    r = m.correction.select(F.floor(F.col("image_id") / 4.0).alias("image_id"), "mask_key").distinct()
    return mg.backfill_batch_of_reviews(r, history(m))


@query("majority_batch", "SELECT DISTINCT ON (slide_id) slide_id, batch_id FROM (SELECT v.slide_id, r.batch_id, count(*) AS n FROM {correction} r JOIN {viewpoint} v ON v.viewpoint_id = r.viewpoint_id WHERE r.batch_id IS NOT NULL GROUP BY 1, 2) q ORDER BY slide_id, n DESC, batch_id")
def _(m: Model) -> DataFrame:
    return mg.majority_batch(m.correction.join(m.viewpoint.select("viewpoint_id", "slide_id"), "viewpoint_id"), "slide_id")


@query("backfill_layers", "SELECT locality_id, CASE WHEN depth_cm IS NULL THEN 'none' ELSE concat(depth_cm, 'cm') END AS code, count(*) AS n_slides, min(slide_id) AS first_slide FROM {slide} GROUP BY 1, 2")
def _(m: Model) -> DataFrame:
    return mg.backfill_layers(m.slide, F.coalesce(F.concat(F.col("depth_cm").cast("string"), F.lit("cm")), F.lit("none")))


WIDTHS = """stacks AS (SELECT user_id AS viewpoint_id, CASE WHEN user_id % 3 = 0 THEN 1376 ELSE 2752 END AS stack_width FROM (SELECT DISTINCT user_id FROM events) e)"""


@query(
    "backfill_scale",
    """SELECT s.viewpoint_id, stack_width / 2752 AS resize, um * 2752 / stack_width AS um_per_pixel, hi - lo > um * 0.001::DOUBLE AS mixed FROM stacks s
JOIN (SELECT slide_id, first(um_per_pixel ORDER BY seq) AS um, min(um_per_pixel) AS lo, max(um_per_pixel) AS hi FROM {frame} GROUP BY 1) f ON f.slide_id = s.viewpoint_id""",
    WIDTHS,
)
def _(m: Model) -> DataFrame:
    stacks = m.events.select(F.col("user_id").alias("viewpoint_id")).distinct().withColumn("stack_width", F.when(F.col("viewpoint_id") % 3 == 0, 1376).otherwise(2752))
    return mg.backfill_scale(stacks, m.frame.select(F.col("slide_id").alias("viewpoint_id"), F.lit(2752).alias("width"), "um_per_pixel", "seq"))


@query("missing_backend", "SELECT run_id, batch_id, 'mask' AS backend FROM {run} WHERE batch_id IS NOT NULL AND backend IS NULL")
def _(m: Model) -> DataFrame:
    return mg.missing_backend(m.run, "mask")


@query(
    "close_stale_runs",
    """SELECT run_id, kind, CASE WHEN closed THEN 'failed' ELSE status END AS status, CASE WHEN closed THEN concat(note, ' | left unfinished') ELSE note END AS note, closed FROM (
SELECT *, kind = 'detect' AND status = 'running' AND started_at < TIMESTAMP '1999-06-01 00:00:00' - INTERVAL 5 MINUTE AS closed FROM {run}) q""",
)
def _(m: Model) -> DataFrame:
    return mg.close_stale_runs(m.run, "detect", "1999-06-01 00:00:00")


@query(
    "merge_lookup_batches",
    """SELECT name, state, text, seq, n - 1 AS n_lost, states > 1 AS conflict FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank DESC, length(text) DESC, seq DESC) AS rn, count(*) OVER (PARTITION BY name) AS n FROM lookups) q
JOIN (SELECT name AS nm, count(DISTINCT state) AS states FROM lookups GROUP BY 1) s ON nm = name WHERE rn = 1""",
    """lookups AS (SELECT user_id AS name, event_type AS state, props AS text, event_id AS seq, coalesce(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'error' THEN 1 END, 0) AS rank FROM events)""",
)
def _(m: Model) -> DataFrame:
    e = m.events.select(F.col("user_id").alias("name"), F.col("event_type").alias("state"), F.col("props").alias("text"), F.col("event_id").alias("seq"))
    return mg.merge_lookup_batches(e, {"purchase": 5, "signup": 4, "click": 3, "view": 2, "error": 1})


@query("check_numbering", "SELECT s.s_suppkey + 1 AS number, s.s_name AS name, c.c_name AS expected FROM supplier s LEFT JOIN customer c ON c.c_custkey = s.s_suppkey + 1 WHERE s.s_name IS DISTINCT FROM c.c_name")
def _(m: Model) -> DataFrame:
    records = m.supplier.select((F.col("s_suppkey") + 1).alias("number"), F.col("s_name").alias("name"))
    return mg.check_numbering(records, m.customer.select(F.col("c_custkey").alias("number"), F.col("c_name").alias("name")))


def review_flag_sql(batch_id: int, refused: bool) -> str:
    flag = "for_review" if refused else f"b.batch_id = {batch_id}"
    return f"""SELECT b.batch_id, b.label, coalesce(n, 0) AS n_views, {flag} AS for_review, {str(refused).upper()} AS refused FROM {{batch}} b LEFT JOIN (SELECT batch_id, count(DISTINCT viewpoint_id) AS n FROM {{detection}} WHERE is_current GROUP BY 1) d ON d.batch_id = b.batch_id"""


@query("set_review_batch", review_flag_sql(2, False))
def _(m: Model) -> DataFrame:
    return mg.set_review_batch(m.batch, m.detection, 2)


@query("set_review_batch_refused", review_flag_sql(4, True))
def _(m: Model) -> DataFrame:
    return mg.set_review_batch(m.batch, m.detection, 4)


@query(
    "move_members",
    """SELECT sample_id, CASE WHEN why = '' THEN t ELSE locality_id END AS locality_id, n_children, why FROM (SELECT e.sample_id, t, s.locality_id, coalesce(n, 0) AS n_children,
 CASE WHEN s.locality_id = t THEN 'same place' WHEN t > 24 THEN 'unknown place' WHEN EXISTS (SELECT 1 FROM {sample} o WHERE o.locality_id = t AND o.code = s.code) THEN 'code exists there' ELSE '' END AS why
 FROM (SELECT sample_id, CAST(sample_id % 27 AS INT) AS t FROM {sample}) e JOIN {sample} s ON s.sample_id = e.sample_id LEFT JOIN (SELECT sample_id, count(*) AS n FROM {slide} GROUP BY 1) c ON c.sample_id = e.sample_id) q""",
)
def _(m: Model) -> DataFrame:
    edits = m.sample.select("sample_id", (F.col("sample_id") % 27).cast("int").alias("new_parent"))
    return mg.move_members(edits, m.sample, m.locality, "sample_id", "locality_id", "code", m.slide)


RECIPES = """recipes AS (SELECT batch_id, concat('conf=', params ->> '$.conf', ' imgsz=', params ->> '$.imgsz', ' weights_path=', params ->> '$.weights_path') AS recipe, coalesce(backend, 'mask') AS backend, backend IS NULL AS guessed, started_at, params ->> '$.weights_path' AS w
 FROM (SELECT DISTINCT ON (batch_id) * FROM {run} WHERE batch_id IS NOT NULL ORDER BY batch_id, started_at DESC, run_id DESC) q)"""


@query("backfill_recipes", "SELECT batch_id, recipe, backend, guessed FROM recipes", RECIPES)
def _(m: Model) -> DataFrame:
    return mg.backfill_recipes(m.run)


@query(
    "fill_plan",
    """SELECT r.batch_id, b.label, r.recipe, b.for_review, why = '' AS ready, why FROM (SELECT *, CASE WHEN backend <> 'box' THEN '' WHEN w NOT IN ('w0', 'w1') THEN 'weights are missing' ELSE '' END AS why FROM recipes) r JOIN {batch} b ON b.batch_id = r.batch_id""",
    RECIPES,
)
def _(m: Model) -> DataFrame:
    latest = m.run.filter("batch_id IS NOT NULL").groupBy("batch_id").agg(F.max("started_at").alias("started_at"))
    weights = m.orders.select(F.concat(F.lit("w"), (F.col("o_custkey") % 2).cast("string")).alias("path")).distinct()
    return mg.fill_plan(mg.backfill_recipes(m.run), m.batch, latest, weights)


@query("backfill_values", "SELECT b.batch_id, b.label, CASE WHEN b.code <> '' THEN b.code ELSE coalesce(s.seed, '') END AS code FROM {batch} b LEFT JOIN (SELECT 'second' AS label, min(o_orderstatus) AS seed FROM orders) s ON s.label = b.label")
def _(m: Model) -> DataFrame:
    seeds = m.orders.agg(F.min("o_orderstatus").alias("code")).withColumn("label", F.lit("second"))
    return mg.seed_codes(m.batch, seeds)


@query("swap_prefix", "SELECT image_id, regexp_replace(image_path, '^photos/', 'archive/photos/') AS image_path FROM {detection}")
def _(m: Model) -> DataFrame:
    return mg.swap_prefix(m.detection.select("image_id", "image_path"), "image_path", "photos/", "archive/photos/")


@query("get_or_create_batch", "SELECT w.kind, w.label, b.batch_id, b.batch_id IS NULL AS created FROM (SELECT DISTINCT kind, CASE WHEN minutes % 3 = 0 THEN 'first' WHEN minutes % 3 = 1 THEN 'second' ELSE 'fourth' END AS label FROM {run}) w LEFT JOIN {batch} b ON b.kind = w.kind AND b.label = w.label")
def _(m: Model) -> DataFrame:
    wanted = m.run.selectExpr("kind", "CASE WHEN minutes % 3 = 0 THEN 'first' WHEN minutes % 3 = 1 THEN 'second' ELSE 'fourth' END AS label")
    return mg.get_or_create_batch(m.batch, wanted)


@query(
    "save_detection_batch",
    """SELECT detection_id, batch_id, image_id, row_number() OVER (PARTITION BY batch_id, image_id ORDER BY created_at DESC, detection_id DESC) = 1 AS is_current FROM hist""",
    HISTORY,
)
def _(m: Model) -> DataFrame:
    h = history(m).select("detection_id", "batch_id", "image_id", "is_current", "created_at")
    old, new = h.filter("created_at < TIMESTAMP '2000-01-01'"), h.filter("created_at >= TIMESTAMP '2000-01-01'")
    return mg.supersede(new, old).select("detection_id", "batch_id", "image_id", "is_current")


@query(
    "save_detection_batch_stream",
    """SELECT h.detection_id, h.batch_id, h.image_id, lead(h.detection_id) OVER w IS NULL AS is_current, lead(h.detection_id) OVER w AS superseded_by, coalesce(c.n, 0) AS n_candidates FROM hist h
 LEFT JOIN (SELECT detection_id, count(DISTINCT mask_key) AS n FROM {candidate} GROUP BY 1) c ON c.detection_id = h.detection_id WINDOW w AS (PARTITION BY h.batch_id, h.image_id ORDER BY h.created_at, h.detection_id)""",
    HISTORY,
)
def _(m: Model) -> DataFrame:
    """The detections as they arrive, two years in a part; a part is one micro-batch however many files it has, with the corrections bound as they come."""
    use_shared_checkpoints(m.spark)
    base = f"{m.spark.sparkContext.getCheckpointDir()}/arrivals-{uuid.uuid4().hex}"
    box = [f"bbox_{s}" for s in "xywh"]
    years = F.least(F.floor((F.year("created_at") - 1992) / 2), F.lit(3)).alias("part")
    h = history(m).select("detection_id", "image_id", "batch_id", "created_at", F.lit(False).alias("keep_aside"), years)
    rows = h.join(m.candidate.select("detection_id", "mask_key", *box), "detection_id", "left").withColumn("polygon", F.lit(None).cast("string"))
    rows.write.partitionBy("part").parquet(f"{base}/parts")
    m.correction.filter("batch_id is not null").write.parquet(f"{base}/corrections")
    store = DetectionStore(m.spark, f"{base}/store")
    schema = rows.drop("part").schema
    for n in [r["part"] for r in m.spark.read.parquet(f"{base}/parts").select("part").distinct().orderBy("part").collect()]:  # four at most
        m.spark.read.schema(schema).parquet(f"{base}/parts/part={n}").write.mode("append").parquet(f"{base}/in")
        stream = m.spark.readStream.schema(schema).parquet(f"{base}/in")
        run_detections(stream, store, lambda: m.spark.read.parquet(f"{base}/corrections"), f"{base}/checkpoint")
    n = store.candidates().groupBy("detection_id").agg(F.count("*").alias("n_candidates"))
    return store.detections().join(n, "detection_id", "left").select(
        "detection_id", "batch_id", "image_id", "is_current", "superseded_by", F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"))
