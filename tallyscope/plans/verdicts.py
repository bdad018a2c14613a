"""Queries on verdicts and on overlaps inside a detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import verdict as v
from tallyscope.operators.overlay import slide_class_summary
from tallyscope.plans.base import COLLAPSED, JUDGED, STORED, query
from tallyscope.sources.model import Model

# Boxes of the given tables end before this pixel; it bounds the coarsest grid cell, not the result.
SIDE = 128
KEY = ["detection_id", "candidate_no"]


def judged(m: Model, thresholds: v.Thresholds = v.Thresholds()) -> DataFrame:
    return v.judge(m.collapsed, thresholds, SIDE)


@query("classify_candidates", "SELECT detection_id, candidate_no, passed, cls, reject FROM stored", STORED)
def _(m: Model) -> DataFrame:
    return m.stored.select(*KEY, "passed", "cls", "reject")


@query(
    "size_background_filter",
    """SELECT c.detection_id, c.candidate_no, c.area_px FROM {candidate} c JOIN {detection} d ON d.detection_id = c.detection_id
WHERE coalesce(major_um, greatest(bbox_w, bbox_h) * um_per_pixel) BETWEEN 10 AND 150 AND area_px <= 0.5 * 6000""",
)
def _(m: Model) -> DataFrame:
    c = m.candidate.join(m.detection.select("detection_id", "um_per_pixel"), "detection_id")
    return v.size_background_filter(c, F.lit(6000)).select(*KEY, "area_px")


@query("collapse_boxes", "SELECT detection_id, candidate_no, mask_key, area_px FROM cls0", STORED, COLLAPSED)
def _(m: Model) -> DataFrame:
    return v.collapse_boxes(m.candidate.select(*KEY, "mask_key", "area_px", *["bbox_" + s for s in "xywh"])).select(
        *KEY, "mask_key", "area_px"
    )


@query(
    "drop_aggregates",
    "SELECT detection_id, candidate_no, n_inside, CAST(area_inside AS BIGINT) AS area_inside FROM agg",
    *JUDGED,
)
def _(m: Model) -> DataFrame:
    passing = v.classify(v.collapse_boxes(m.candidate)).filter("passed")
    return v.aggregate_masks(v.covered_pairs(passing, SIDE))


@query("suppress_duplicates", "SELECT detection_id, candidate_no FROM dup", *JUDGED)
def _(m: Model) -> DataFrame:
    pairs = v.covered_pairs(v.classify(v.collapse_boxes(m.candidate)).filter("passed"), SIDE)
    return v.duplicate_masks(pairs, v.aggregate_masks(pairs).select(*KEY))


@query("judge", "SELECT detection_id, candidate_no, passed, cls, reject FROM judged", *JUDGED)
def _(m: Model) -> DataFrame:
    return judged(m).select(*KEY, "passed", "cls", "reject")


SUMMARY = """
rep AS (SELECT d.*, v.slide_id AS vs FROM {detection} d JOIN {batch} b ON b.batch_id = d.batch_id JOIN {viewpoint} v ON v.viewpoint_id = d.viewpoint_id
        WHERE d.is_current AND b.for_review
        QUALIFY row_number() OVER (PARTITION BY d.viewpoint_id ORDER BY CASE image_kind WHEN 'stack' THEN 0 ELSE 1 END, d.detection_id) = 1)"""


def summary_sql(source: str, list_rule: bool) -> str:
    kept = (
        "((c.passed AND NOT coalesce(r.removed, FALSE)) OR (NOT c.passed AND coalesce(r.accepted, FALSE)))"
        if list_rule
        else "(NOT coalesce(r.removed, FALSE) AND (c.passed OR coalesce(r.accepted, FALSE)))"
    )
    drawn = "" if list_rule else "AND NOT r.removed"
    return f"""
SELECT slide_id, eff_cls, CAST(sum(k) AS BIGINT) AS n_kept, CAST(sum(a) AS BIGINT) AS n_auto, CAST(sum(l) AS BIGINT) AS n_labeled FROM (
SELECT rep.vs AS slide_id,
       CASE WHEN o.label <> '' THEN o.label
            WHEN NOT c.passed THEN CASE WHEN c.elongation < 1.4 THEN 'round' WHEN c.elongation BETWEEN 2 AND 20 THEN 'rod' ELSE '' END
            ELSE c.cls END AS eff_cls,
       CASE WHEN {kept} THEN 1 ELSE 0 END AS k, CASE WHEN c.passed THEN 1 ELSE 0 END AS a,
       CASE WHEN {kept} AND o.label <> '' THEN 1 ELSE 0 END AS l
FROM {source} c JOIN rep ON rep.detection_id = c.detection_id
LEFT JOIN {{correction}} r ON r.image_id = rep.image_id AND r.mask_key = c.mask_key AND r.batch_id IS NOT DISTINCT FROM rep.batch_id
LEFT JOIN {{object}} o ON o.object_id = r.object_id
UNION ALL
SELECT rep.vs, coalesce(o.label, ''), 1, 0, CASE WHEN o.label <> '' THEN 1 ELSE 0 END
FROM {{correction}} r JOIN {{object}} o ON o.object_id = r.object_id JOIN rep ON rep.image_id = r.image_id
WHERE r.batch_id IS NULL AND r.source = 'manual' {drawn}) s GROUP BY slide_id, eff_cls"""


@query("slide_class_summary", summary_sql("judged", False), SUMMARY, *JUDGED)
def flagship(m: Model) -> DataFrame:
    return slide_class_summary(judged(m), m.detection, m.viewpoint, m.correction, m.object, m.batch)


@query("slide_class_summary_stored", summary_sql("stored", False), SUMMARY, STORED)
def _(m: Model) -> DataFrame:
    return slide_class_summary(m.stored, m.detection, m.viewpoint, m.correction, m.object, m.batch)


@query("slide_class_summary_list_rule", summary_sql("stored", True), SUMMARY, STORED)
def _(m: Model) -> DataFrame:
    return slide_class_summary(m.stored, m.detection, m.viewpoint, m.correction, m.object, m.batch, list_rule=True)
