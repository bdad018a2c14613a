"""Queries on counts by slide, locality, batch and class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import rollup as ro
from tallyscope.operators.overlay import reviewing, slide_class_summary
from tallyscope.plans.base import JUDGED, OVERLAY, STORED, query
from tallyscope.plans.reviews import HISTORY, history, overlay
from tallyscope.plans.verdicts import SUMMARY, judged, summary_sql
from tallyscope.sources.model import Model


def class_rows(m: Model) -> DataFrame:
    return slide_class_summary(m.stored, m.detection, m.viewpoint, m.correction, m.object, m.batch)


def summary(m: Model) -> DataFrame:
    return ro.slide_summary(m.viewpoint, m.detection, m.batch, m.correction, m.object, m.viewpoint_review, class_rows(m), m.class_def)


def listed(m: Model) -> DataFrame:
    return ro.datasets(m.slide, m.locality, m.site, ro.scales_by_slide(m.frame), summary(m))


SUMMED = [
    STORED,
    SUMMARY,
    f"perclass AS ({summary_sql('stored', False)})",
    """summed AS (
SELECT b.*, coalesce(dg, 0) AS detected_groups, coalesce(nd, 0) AS n_detected, coalesce(na, 0) AS n_auto, coalesce(nl, 0) AS n_labeled, coalesce(nc, 0) AS n_counted,
 coalesce(n_removed, 0) AS n_removed, coalesce(n_accepted, 0) AS n_accepted, coalesce(n_noted, 0) AS n_noted, coalesce(n_group_notes, 0) AS n_group_notes, coalesce(reviewed_groups, 0) AS reviewed_groups,
 round(n_images / n_groups, 1) AS mean_size, round(coalesce(nd, 0) / dg, 1) AS mean_detected, round(coalesce(nc, 0) / dg, 1) AS mean_counted
FROM (SELECT slide_id, count(*) AS n_groups, CAST(sum(n_frames) AS BIGINT) AS n_images, count(*) FILTER (WHERE n_frames = 1) AS singletons, max(n_frames) AS max_size FROM {viewpoint} GROUP BY 1) b
LEFT JOIN (SELECT v.slide_id AS s1, count(DISTINCT v.viewpoint_id) AS dg FROM {viewpoint} v JOIN {detection} d ON d.viewpoint_id = v.viewpoint_id WHERE d.is_current AND d.batch_id = 1 GROUP BY 1) d ON s1 = b.slide_id
LEFT JOIN (SELECT p.slide_id AS s2, CAST(sum(n_kept) AS BIGINT) AS nd, CAST(sum(n_auto) AS BIGINT) AS na, CAST(sum(n_labeled) AS BIGINT) AS nl, CAST(coalesce(sum(n_kept) FILTER (WHERE c.counted), 0) AS BIGINT) AS nc
   FROM perclass p LEFT JOIN {class_def} c ON c.class_key = p.eff_cls GROUP BY 1) p ON s2 = b.slide_id
LEFT JOIN (SELECT v.slide_id AS s3, count(*) FILTER (WHERE removed) AS n_removed, count(*) FILTER (WHERE accepted) AS n_accepted FROM {correction} r JOIN {viewpoint} v ON v.viewpoint_id = r.viewpoint_id GROUP BY 1) r ON s3 = b.slide_id
LEFT JOIN (SELECT v.slide_id AS s4, count(*) AS n_noted FROM {object} o JOIN {viewpoint} v ON v.viewpoint_id = o.viewpoint_id WHERE note <> '' GROUP BY 1) o ON s4 = b.slide_id
LEFT JOIN (SELECT v.slide_id AS s5, count(*) FILTER (WHERE note <> '') AS n_group_notes, count(*) FILTER (WHERE done AND batch_id = 1) AS reviewed_groups FROM {viewpoint_review} w JOIN {viewpoint} v ON v.viewpoint_id = w.viewpoint_id GROUP BY 1) w ON s5 = b.slide_id)""",
]
SCALES = """scales AS (SELECT DISTINCT ON (slide_id) slide_id, um AS um_per_pixel, n FROM (SELECT slide_id, round(um_per_pixel, 9) AS um, count(*) AS n FROM {frame} GROUP BY 1, 2) q ORDER BY slide_id, n DESC, um)"""
LISTED = [
    *SUMMED,
    SCALES,
    """listed AS (SELECT s.slide_id, s.slug, t.code AS site, l.code AS locality, t.area, s.depth_cm, s.obs_no, s.hide_in_list, s.exclude_from_totals, k.um_per_pixel,
 coalesce(n_images, 0) AS n_images, coalesce(n_groups, 0) AS n_groups, coalesce(n_detected, 0) AS n_detected, coalesce(n_counted, 0) AS n_counted, coalesce(reviewed_groups, 0) AS reviewed_groups
 FROM {slide} s LEFT JOIN {locality} l ON l.locality_id = s.locality_id AND s.sample_id IS NOT NULL LEFT JOIN {site} t ON t.site_id = l.site_id
 LEFT JOIN scales k ON k.slide_id = s.slide_id LEFT JOIN summed u ON u.slide_id = s.slide_id)""",
]
TOTALS = ", ".join(f"CAST(sum(CASE WHEN exclude_from_totals THEN 0 ELSE {c} END) AS BIGINT) AS {c}" for c in ro.TOTALS) + (
    ", count(*) FILTER (WHERE exclude_from_totals) AS n_excluded, count(*) FILTER (WHERE NOT exclude_from_totals AND hide_in_list) AS n_hidden_in"
)


@query("slide_summary", "SELECT * FROM summed", *SUMMED)
def _(m: Model) -> DataFrame:
    return summary(m)


@query("datasets", "SELECT * FROM listed", *LISTED)
def _(m: Model) -> DataFrame:
    return listed(m).orderBy(*ro.list_order())


@query("datasets_total", f"SELECT {TOTALS} FROM listed", *LISTED)
def _(m: Model) -> DataFrame:
    return ro.datasets_total(listed(m))


@query(
    "datasets_by_locality",
    f"""SELECT site, locality, CAST(grouping_id(site, locality) AS BIGINT) AS level, {TOTALS}, count(*) FILTER (WHERE NOT hide_in_list) AS n_shown, count(*) FILTER (WHERE hide_in_list) AS n_hidden
FROM (SELECT * REPLACE (coalesce(site, '') AS site, coalesce(locality, '') AS locality) FROM listed) q GROUP BY ROLLUP (site, locality)""",
    *LISTED,
)
def _(m: Model) -> DataFrame:
    return ro.datasets_by_locality(listed(m))


@query(
    "area_tabs",
    """SELECT area, CAST(grouping_id(area) AS BIGINT) AS level, count(*) AS n_slides FROM (SELECT coalesce(t.area, '') AS area
FROM {slide} s LEFT JOIN {locality} l ON l.locality_id = s.locality_id AND s.sample_id IS NOT NULL LEFT JOIN {site} t ON t.site_id = l.site_id) q GROUP BY ROLLUP (area)""",
)
def _(m: Model) -> DataFrame:
    return ro.area_tabs(slide_areas(m))


def slide_areas(m: Model) -> DataFrame:
    place = m.locality.select("locality_id", "site_id").join(m.site.select("site_id", "area"), "site_id").select("locality_id", "area")
    s = m.slide.select("slide_id", F.when(F.col("sample_id").isNotNull(), F.col("locality_id")).alias("locality_id"))
    return s.join(place, "locality_id", "left").select("slide_id", "area")


@query(
    "review_progress",
    """SELECT area, slide_id, CAST(grouping_id(area, slide_id) AS BIGINT) AS level, count(*) AS n_viewpoints, CAST(sum(nd) AS BIGINT) AS n_done, CAST(sum(nw) AS BIGINT) AS n_drawn, CAST(sum(ne) AS BIGINT) AS n_edited FROM (
SELECT coalesce(t.area, '?') AS area, v.slide_id, coalesce(nd, 0) AS nd, coalesce(nw, 0) AS nw, coalesce(ne, 0) AS ne FROM {viewpoint} v
LEFT JOIN {slide} s ON s.slide_id = v.slide_id LEFT JOIN {locality} l ON l.locality_id = s.locality_id AND s.sample_id IS NOT NULL LEFT JOIN {site} t ON t.site_id = l.site_id
LEFT JOIN (SELECT viewpoint_id AS v1, count(*) AS nd FROM {viewpoint_review} WHERE done AND batch_id = 1 GROUP BY 1) a ON v1 = v.viewpoint_id
LEFT JOIN (SELECT viewpoint_id AS v2, count(*) FILTER (WHERE batch_id IS NULL) AS nw, count(*) FILTER (WHERE geom_edited) AS ne FROM {correction} GROUP BY 1) b ON v2 = v.viewpoint_id) q
GROUP BY ROLLUP (area, slide_id)""",
)
def _(m: Model) -> DataFrame:
    return ro.review_progress(slide_areas(m), m.viewpoint, m.viewpoint_review, m.correction, m.batch)


@query("scales_by_slide", "SELECT slide_id, um_per_pixel, n FROM scales", SCALES)
def _(m: Model) -> DataFrame:
    return ro.scales_by_slide(m.frame)


@query("current_thresholds", "SELECT threshold_set_id, count(*) AS n FROM {detection} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def _(m: Model) -> DataFrame:
    return ro.current_thresholds(m.detection)


@query("threshold_spread", "SELECT slide_id, count(DISTINCT threshold_set_id) AS n_sets FROM {detection} GROUP BY 1")
def _(m: Model) -> DataFrame:
    return ro.threshold_spread(m.detection, "slide_id")


@query(
    "batch_choices",
    """SELECT b.batch_id, b.label, b.for_review, count(DISTINCT d.viewpoint_id) AS n_views, (SELECT count(*) FROM {viewpoint}) - count(DISTINCT d.viewpoint_id) AS n_blank,
 count(*) AS n_images, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_objects FROM {batch} b JOIN {detection} d ON d.batch_id = b.batch_id AND d.is_current
LEFT JOIN (SELECT detection_id, count(*) AS n FROM stored WHERE passed GROUP BY 1) s ON s.detection_id = d.detection_id GROUP BY 1, 2, 3""",
    STORED,
)
def _(m: Model) -> DataFrame:
    return ro.batch_choices(m.batch, m.detection, m.stored, m.viewpoint)


PER_BATCH = """perbatch AS (SELECT viewpoint_id, h.batch_id, count(*) AS n_images, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_objects, max(h.detection_id) AS last_detection,
 CASE WHEN h.batch_id = 0 THEN 'box' ELSE 'mask' END AS backend, h.batch_id = 1 AS for_review
 FROM (SELECT DISTINCT ON (batch_id, image_id) * FROM hist ORDER BY batch_id, image_id, created_at DESC, detection_id DESC) h
 LEFT JOIN (SELECT detection_id, count(*) FILTER (WHERE passed) AS n FROM stored GROUP BY 1) s ON s.detection_id = h.detection_id GROUP BY 1, 2)"""


def per_batch(m: Model) -> DataFrame:
    # Three batches of two engines, as a small dimension.
    names = m.spark.sql("SELECT * FROM VALUES (0, 'box', false), (1, 'mask', true), (2, 'mask', false) AS t(batch_id, backend, for_review)")
    return ro.batches_for_viewpoint(history(m), m.stored, names)


@query("batches_for_viewpoint", "SELECT * FROM perbatch", STORED, HISTORY, PER_BATCH)
def _(m: Model) -> DataFrame:
    return per_batch(m)


@query(
    "engines",
    """SELECT viewpoint_id, backend, first(batch_id ORDER BY for_review DESC, last_detection DESC) AS batch_id, first(n_objects ORDER BY for_review DESC, last_detection DESC) AS n_objects, count(*) AS n_batches
FROM perbatch GROUP BY 1, 2""",
    STORED,
    HISTORY,
    PER_BATCH,
)
def _(m: Model) -> DataFrame:
    return ro.engines(per_batch(m))


def done_slides(m: Model) -> DataFrame:
    return ro.done_viewpoints(m.viewpoint_review, m.batch).join(m.viewpoint.select("viewpoint_id", "slide_id"), "viewpoint_id")


DONE = """doneview AS (SELECT DISTINCT w.viewpoint_id, v.slide_id FROM {viewpoint_review} w JOIN {viewpoint} v ON v.viewpoint_id = w.viewpoint_id WHERE w.done AND w.batch_id = 1)"""


@query(
    "training_overview",
    """SELECT slide_id, count(*) AS n_viewpoints, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_objects, round(count(*) / (SELECT count(*) FROM doneview) * 100, 2) AS share FROM doneview d
LEFT JOIN (SELECT viewpoint_id, count(*) AS n FROM overlay WHERE state = 'kept' GROUP BY 1) o ON o.viewpoint_id = d.viewpoint_id GROUP BY 1""",
    *OVERLAY,
    DONE,
)
def _(m: Model) -> DataFrame:
    return ro.training_overview(done_slides(m), overlay(m).filter("state = 'kept'"))


@query(
    "training_overview_classes",
    """SELECT cls, count(*) FILTER (WHERE state = 'kept') AS n_kept, count(*) FILTER (WHERE state = 'gone') AS n_removed FROM overlay o
WHERE viewpoint_id IN (SELECT viewpoint_id FROM doneview) AND state <> 'rejected' GROUP BY 1""",
    *OVERLAY,
    DONE,
)
def _(m: Model) -> DataFrame:
    o = overlay(m).filter("state <> 'rejected'").join(done_slides(m), "viewpoint_id", "left_semi")
    return o.groupBy("cls").agg(F.count_if(F.expr("state = 'kept'")).alias("n_kept"), F.count_if(F.expr("state = 'gone'")).alias("n_removed"))


@query(
    "layer_overview",
    """SELECT t.site_id, t.code, t.area, count(DISTINCT l.locality_id) AS n_localities, count(DISTINCT s.sample_id) AS n_samples, count(DISTINCT x.slide_id) AS n_slides
FROM {site} t LEFT JOIN {locality} l ON l.site_id = t.site_id LEFT JOIN {sample} s ON s.locality_id = l.locality_id LEFT JOIN {slide} x ON x.sample_id = s.sample_id GROUP BY 1, 2, 3""",
)
def _(m: Model) -> DataFrame:
    return ro.layer_overview(m.site, m.locality, m.sample, m.slide)


@query(
    "detection_size_stats",
    """SELECT slide_id, count(*) AS n, min(size) AS smallest, CAST(list_sort(list(size))[count(*) // 2 + 1] AS DOUBLE) AS median, max(size) AS largest, round(avg(size), 1) AS mean
FROM (SELECT slide_id, greatest(bbox_w, bbox_h) AS size FROM overlay WHERE state = 'kept') q GROUP BY 1""",
    *OVERLAY,
)
def _(m: Model) -> DataFrame:
    kept = overlay(m).filter("state = 'kept'").select("slide_id", F.greatest("bbox_w", "bbox_h").alias("size"))
    return ro.detection_size_stats(kept, "slide_id", "size")


@query(
    "derived_depth_series",
    """SELECT depth_mm, series, value FROM (
SELECT CAST(depth_cm * 10 AS INT) AS depth_mm, 'counted' AS series, CAST(sum(n_counted) AS DOUBLE) AS value FROM listed WHERE depth_cm IS NOT NULL AND NOT exclude_from_totals GROUP BY 1
UNION ALL SELECT CAST(depth_cm * 10 AS INT), 'per_view', CASE WHEN sum(n_groups) > 0 THEN round(sum(n_counted) / sum(n_groups), 3) END FROM listed WHERE depth_cm IS NOT NULL AND NOT exclude_from_totals GROUP BY 1
UNION ALL SELECT CAST(depth_cm * 10 AS INT), eff_cls, CAST(sum(n_kept) AS DOUBLE) FROM listed l JOIN perclass p ON p.slide_id = l.slide_id JOIN {class_def} c ON c.class_key = p.eff_cls AND c.counted
 WHERE depth_cm IS NOT NULL AND NOT exclude_from_totals GROUP BY 1, 2) q WHERE value IS NOT NULL""",
    *LISTED,
)
def _(m: Model) -> DataFrame:
    counted = m.class_def.filter("counted").select(F.col("class_key").alias("eff_cls"))
    return ro.derived_depth_series(listed(m), class_rows(m).join(F.broadcast(counted), "eff_cls"))


@query("core_series_stats", "SELECT locality_id, series_key, count(*) AS n, min(depth_mm) AS min_mm, max(depth_mm) AS max_mm FROM {core_point} GROUP BY 1, 2")
def _(m: Model) -> DataFrame:
    return m.core_point.groupBy("locality_id", "series_key").agg(F.count("*").alias("n"), F.min("depth_mm").alias("min_mm"), F.max("depth_mm").alias("max_mm"))


@query("class_counts", "SELECT cls, count(*) AS n FROM judged WHERE passed GROUP BY 1", *JUDGED)
def _(m: Model) -> DataFrame:
    return judged(m).filter("passed").groupBy("cls").agg(F.count("*").alias("n"))


@query("reject_reasons", "SELECT reject, count(*) AS n FROM judged WHERE NOT passed GROUP BY 1", *JUDGED)
def _(m: Model) -> DataFrame:
    return judged(m).filter("NOT passed").groupBy("reject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reject")


@query(
    "run_groups",
    """SELECT kind, backend, day, count(*) AS n_runs, count(*) FILTER (WHERE cur) AS n_current, min(run_id) AS first_run, max(run_id) AS last_run,
 concat(CASE WHEN backend = '-' THEN kind ELSE backend END, '-', day) AS label FROM (
SELECT r.run_id, r.kind, coalesce(r.backend, '-') AS backend, strftime(r.started_at, '%Y-%m-%d') AS day, d.is_current AND d.batch_id = 1 AS cur
FROM {run} r JOIN {detection} d ON d.run_id = r.run_id WHERE r.batch_id IS NULL) q GROUP BY 1, 2, 3""",
)
def _(m: Model) -> DataFrame:
    return ro.run_groups(m.run, m.detection, m.batch)


@query(
    "run_ranges",
    """SELECT DISTINCT o_orderkey AS spec_id, unnest(list_concat(range(o_orderkey, o_orderkey + o_custkey % 4 + 1), [o_orderkey * 2])) AS run_id FROM orders""",
)
def _(m: Model) -> DataFrame:
    spec = m.orders.select(
        F.col("o_orderkey").alias("spec_id"), F.expr("concat(o_orderkey, '-', o_orderkey + o_custkey % 4, ', ', o_orderkey * 2)").alias("spec")
    )
    return ro.run_ranges(spec, "spec", ["spec_id"])


@query("species_seen", "SELECT DISTINCT species FROM {object} WHERE species <> ''")
def _(m: Model) -> DataFrame:
    return ro.species_seen(m.object)


@query("done_viewpoints", "SELECT DISTINCT viewpoint_id FROM {viewpoint_review} WHERE done AND batch_id = 1")
def _(m: Model) -> DataFrame:
    return ro.done_viewpoints(m.viewpoint_review, m.batch)


@query(
    "review_state",
    """SELECT viewpoint_id, coalesce(bool_or(done) FILTER (WHERE batch_id = 1), FALSE) AS done, coalesce(max(note) FILTER (WHERE batch_id IS NULL), '') AS comment
FROM {viewpoint_review} GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    return ro.review_state(m.viewpoint_review, m.batch)


@query("pipeline_recent_runs", "SELECT run_id, kind, status, minutes FROM {run} ORDER BY started_at DESC, run_id DESC LIMIT 12")
def _(m: Model) -> DataFrame:
    return ro.recent_runs(m.run).select("run_id", "kind", "status", "minutes")


@query(
    "pipeline_status",
    """SELECT s.slide_id, s.slug, s.state, coalesce(nf, 0) AS n_frames, coalesce(nv, 0) AS n_viewpoints, coalesce(ns, 0) AS n_fused, coalesce(nd, 0) AS n_detected_views,
 (SELECT count(*) FROM {run} WHERE status = 'running') = 0 AS stalled FROM {slide} s
LEFT JOIN (SELECT slide_id AS a, count(*) AS nf FROM {frame} GROUP BY 1) f ON a = s.slide_id
LEFT JOIN (SELECT v.slide_id AS b, count(DISTINCT v.viewpoint_id) AS nv, count(DISTINCT v.viewpoint_id) FILTER (WHERE d.image_kind = 'stack') AS ns, count(DISTINCT d.viewpoint_id) AS nd
 FROM {viewpoint} v LEFT JOIN {detection} d ON d.viewpoint_id = v.viewpoint_id AND d.is_current GROUP BY 1) v ON b = s.slide_id WHERE s.state <> 'done'""",
)
def _(m: Model) -> DataFrame:
    return ro.busy_slides(m.slide, m.frame, m.viewpoint, m.detection, m.run)


@query(
    "health_counts",
    """SELECT *, CASE WHEN table_name = 'slide' AND n = 0 THEN 'unhealthy' WHEN age_h IS NULL OR age_h > 24 THEN 'degraded' ELSE 'ok' END AS status FROM (
SELECT t.*, (SELECT round((epoch(TIMESTAMP '2001-08-02 12:00:00') - epoch(max(stamp))) / 3600.0, 1) FROM {snapshot}) AS age_h FROM (
SELECT 'slide' AS table_name, count(*) AS n FROM {slide} UNION ALL SELECT 'viewpoint', count(*) FROM {viewpoint} UNION ALL SELECT 'detection', count(*) FROM {detection} UNION ALL SELECT 'candidate', count(*) FROM {candidate}) t) q""",
)
def _(m: Model) -> DataFrame:
    tables = {k: getattr(m, k) for k in ("slide", "viewpoint", "detection", "candidate")}
    return ro.health_counts(tables, m.snapshot, "2001-08-02 12:00:00", 24)


@query("reviewing", "SELECT detection_id, viewpoint_id FROM {detection} WHERE is_current AND batch_id = (SELECT batch_id FROM {batch} WHERE for_review)")
def _(m: Model) -> DataFrame:
    return reviewing(m.detection, m.batch).select("detection_id", "viewpoint_id")


