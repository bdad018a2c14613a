"""Queries on the catalogue, entry validation, thresholds and top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import naming as nm
from tallyscope.functions.boxes import Box, hexagon, key_to_bbox
from tallyscope.operators import catalogue as ct
from tallyscope.operators import review as rv
from tallyscope.operators import thresholds as th
from tallyscope.operators.verdict import Thresholds, judge_each
from tallyscope.plans.base import JUDGED, OVERLAY, STORED, judged as judged_sql, query
from tallyscope.plans.reviews import SHOWN, overlay, shown_overlay
from tallyscope.plans.verdicts import SIDE
from tallyscope.session import keep
from tallyscope.sources.model import Model


def rows(m: Model, state: str = "kept") -> DataFrame:
    shown = shown_overlay(m, state)
    layers = ct.slide_layers(m.slide, m.sample, m.locality, m.site)
    return ct.catalog_rows(shown, layers, m.viewpoint, m.batch, m.detection, m.correction)


CATALOG = [
    *OVERLAY,
    SHOWN,
    """mains AS (SELECT object_id, count(*) AS n, first(image_id ORDER BY bbox_w * bbox_h DESC, image_id, mask_key DESC) AS img FROM {correction} GROUP BY 1 HAVING count(*) >= 2)""",
    """numbered AS (SELECT x.*, coalesce(n, 0) AS linked_n, CASE WHEN img <> x.image_id THEN img END AS view_image, t.code AS sc, l.code AS lc, p.code AS pc, s.obs_no, v.idx, b.code AS bc, d.frame_no,
 regexp_full_match(mask_key, '[0-9]+_[0-9]+_[0-9]+_[0-9]+|m[0-9a-f]{{8}}') AS good, coalesce(x.source = 'manual', FALSE) AS drawn
 FROM shown x JOIN {slide} s ON s.slide_id = x.slide_id LEFT JOIN {sample} p ON p.sample_id = s.sample_id LEFT JOIN {locality} l ON l.locality_id = p.locality_id LEFT JOIN {site} t ON t.site_id = l.site_id
 JOIN {viewpoint} v ON v.viewpoint_id = x.viewpoint_id JOIN {detection} d ON d.detection_id = x.detection_id JOIN {batch} b ON b.batch_id = d.batch_id LEFT JOIN mains ON mains.object_id = x.object_id)""",
    """whys AS (SELECT *, CASE WHEN sc IS NULL THEN 'site' WHEN lc IS NULL THEN 'locality' WHEN pc IS NULL THEN 'sample' WHEN NOT good THEN 'position' WHEN NOT drawn AND bc = '' THEN 'batch' ELSE '' END AS why FROM numbered)""",
    """cat AS (SELECT slide_id, viewpoint_id, image_id, mask_key, state, cls, area_px, bbox_x, bbox_y, bbox_w, bbox_h, cls_user, revived, orphan, CASE WHEN why = '' THEN concat(sc, '-', lc, '-', pc,
   CASE WHEN obs_no <> 0 THEN concat('-', obs_no) ELSE '' END, '-g', CASE WHEN idx < 10 THEN '0' ELSE '' END, idx,
   CASE WHEN image_kind <> 'stack' THEN concat('-f', CASE WHEN frame_no < 10 THEN '0' ELSE '' END, frame_no) ELSE '' END, '-', mask_key, '-', CASE WHEN drawn THEN 'M' ELSE bc END) END AS catalog_no,
   why AS catalog_why, coalesce(species, '') AS species, coalesce(grade, '') AS grade, coalesce(pose, '') AS pose, coalesce(note, '') AS note, linked_n, view_image FROM whys)""",
]


@query("catalog_rows", "SELECT * EXCLUDE (state) FROM cat WHERE state = 'kept'", *CATALOG)
def _(m: Model) -> DataFrame:
    return rows(m).orderBy(*ct.CATALOG_ORDER)


@query("catalog_rows_gone", "SELECT * EXCLUDE (state) FROM cat WHERE state = 'gone'", *CATALOG)
def _(m: Model) -> DataFrame:
    return rows(m, "gone").orderBy(*ct.CATALOG_ORDER)


@query(
    "catalog_filter",
    """SELECT slide_id, image_id, mask_key, cls, species, catalog_no FROM cat WHERE state = 'kept' AND cls <> 'fragment' AND species <> ''
 AND (contains(lower(coalesce(catalog_no, '')), 'st') OR contains(lower(species), 'st') OR contains(lower(note), 'st'))""",
    *CATALOG,
)
def _(m: Model) -> DataFrame:
    return ct.catalog_filter(rows(m), m.class_def, only="named", text="st").select("slide_id", "image_id", "mask_key", "cls", "species", "catalog_no")


@query(
    "catalog_progress",
    """SELECT slide_id, count(*) AS n_objects, count(*) FILTER (WHERE species <> '' AND grade <> '' AND pose <> '') AS n_done FROM cat WHERE state = 'kept' AND cls <> 'fragment' GROUP BY 1""",
    *CATALOG,
)
def _(m: Model) -> DataFrame:
    r = ct.catalog_filter(rows(m), m.class_def)
    return r.groupBy("slide_id").agg(F.count("*").alias("n_objects"), F.count_if(ct.catalog_done(r)).alias("n_done"))


@query("crops_filter", "SELECT slide_id, image_id, mask_key, cls, bbox_w, bbox_h FROM cat WHERE state = 'kept' AND note <> ''", *CATALOG)
def _(m: Model) -> DataFrame:
    return ct.crops_filter(rows(m), only="noted").select("slide_id", "image_id", "mask_key", "cls", "bbox_w", "bbox_h")


@query(
    "paged_detections",
    """SELECT slide_id, image_id, mask_key, size, n_total FROM (SELECT slide_id, image_id, mask_key, greatest(bbox_w, bbox_h) AS size, count(*) OVER () AS n_total FROM cat WHERE state = 'kept')
ORDER BY size DESC, slide_id, image_id, mask_key LIMIT 50 OFFSET 100""",
    *CATALOG,
)
def _(m: Model) -> DataFrame:
    # The third page of 50, the longest first: paging is the feature here.
    # Numbers and links add columns to a row and no row, so a page of keys does without; page and total read stored rows.
    listed = shown_overlay(m, "kept").join(ct.catalogued(m.detection, m.viewpoint, m.batch), "detection_id", "left_semi")
    r = keep(listed.select("slide_id", "image_id", "mask_key", F.greatest("bbox_w", "bbox_h").alias("size")))
    page = r.orderBy(F.desc("size"), "slide_id", "image_id", "mask_key").offset(100).limit(50)
    return page.withColumn("n_total", r.agg(F.count("*")).scalar())


@query(
    "catalog_no",
    """SELECT image_id, mask_key, catalog_no, catalog_why FROM cat""",
    *CATALOG[:-1],
    CATALOG[-1].replace("FROM whys", "FROM whys WHERE state = 'kept'"),
)
def _(m: Model) -> DataFrame:
    return rows(m).select("image_id", "mask_key", "catalog_no", "catalog_why")


NUMBER = r"^([A-Z0-9]+)-([A-Z0-9]+)-([A-Z0-9]+)(?:-([0-9]+))?-g([0-9]+)(?:-f([0-9]+))?-([0-9]+_[0-9]+_[0-9]+_[0-9]+|m[0-9a-f]{{8}})-([A-Z0-9]+)$"
PARTS = ", ".join(f"regexp_extract(catalog_no, '{NUMBER}', {i}) AS g{i}" for i in range(1, 9))


@query(
    "parse_catalog_no",
    f"""SELECT catalog_no, g1 AS site, g2 AS locality, g3 AS sample, CAST(CASE WHEN g4 = '' THEN '0' ELSE g4 END AS INT) AS obs_no, CAST(g5 AS BIGINT) AS viewpoint,
 CAST(nullif(g6, '') AS BIGINT) AS frame_seq, g7 AS mask_key, g8 AS batch_code FROM (SELECT catalog_no, {PARTS} FROM cat WHERE state = 'kept' AND regexp_matches(catalog_no, '{NUMBER}')) q""",
    *CATALOG,
)
def _(m: Model) -> DataFrame:
    r = rows(m).select("catalog_no").filter(F.col("catalog_no").isNotNull())
    return r.withColumn("_p", nm.parse_catalog_no(F.col("catalog_no"))).filter(F.col("_p").isNotNull()).select("catalog_no", "_p.*")


@query(
    "mask_key",
    """SELECT image_id, mask_key, CASE WHEN mask_key LIKE 'm%' THEN NULL ELSE CAST(split_part(mask_key, '_', 1) AS INT) END AS x, CASE WHEN mask_key LIKE 'm%' THEN NULL ELSE CAST(split_part(mask_key, '_', 4) AS INT) END AS h FROM {correction}""",
)
def _(m: Model) -> DataFrame:
    box = key_to_bbox(F.col("mask_key"))
    return m.correction.select("image_id", "mask_key", box[0].alias("x"), box[3].alias("h"))


@query("manual_key_valid", "SELECT image_id, mask_key, regexp_full_match(mask_key, 'm[0-9a-f]{{8}}') AS valid FROM {correction}")
def _(m: Model) -> DataFrame:
    return m.correction.select("image_id", "mask_key", ct.manual_key_valid(F.col("mask_key")).alias("valid"))


@query("polygon_valid", "SELECT detection_id, candidate_no, CASE WHEN bbox_x + bbox_w > 90 OR bbox_y + bbox_h > 90 THEN 'outside' ELSE '' END AS problem FROM {candidate}")
def _(m: Model) -> DataFrame:
    return m.candidate.select("detection_id", "candidate_no", ct.polygon_problem(hexagon(Box.of()), F.lit(90), F.lit(90)).alias("problem"))


@query(
    "grade_pose_rules",
    """SELECT object_id, label, grade, pose, 'not for this class' AS why FROM {object} o JOIN {class_def} c ON c.class_key = o.label WHERE NOT c.counted AND (grade <> '' OR pose <> '')""",
)
def _(m: Model) -> DataFrame:
    return ct.grade_pose_rules(m.object, m.class_def)


@query(
    "parse_folder",
    """SELECT slide_id, regexp_extract(folder, '^([A-Za-z0-9]+)-', 1) AS site_code, regexp_extract(folder, '-([A-Za-z0-9]+)', 1) AS loc_code, 'core' AS loc_kind,
 concat(regexp_extract(folder, '([0-9]+)cm', 1), 'cm') AS sample_code, CAST(regexp_extract(folder, '([0-9]+)cm', 1) AS DOUBLE) AS depth_cm, CAST(NULL AS INT) AS sample_no,
 CASE WHEN contains(folder, '(') THEN CAST(regexp_extract(folder, '\\(([0-9]+)\\)', 1) AS INT) ELSE 0 END AS obs_no FROM {slide}
UNION ALL SELECT -slide_id, 'BP', concat('BP', lpad(CAST(slide_id % 90 + 10 AS STRING), 2, '0')), 'outcrop', concat(slide_id % 90 + 10, lpad(CAST(slide_id % 20 AS STRING), 2, '0')), NULL, CAST(slide_id % 20 AS INT), 0 FROM {slide}""",
)
def _(m: Model) -> DataFrame:
    outcrops = m.slide.select(
        (-F.col("slide_id")).alias("slide_id"),
        F.expr("concat('BP', slide_id % 90 + 10, '-', slide_id % 90 + 10, lpad(slide_id % 20, 2, '0'))").alias("folder"),
    )
    names = m.slide.select("slide_id", "folder").unionByName(outcrops)
    return names.withColumn("_p", nm.parse_folder(F.col("folder"))).select("slide_id", "_p.*")


@query("slide_slug", "SELECT slide_id, trim(regexp_replace(regexp_replace(lower(concat('2024 ', folder)), '[^a-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM {slide}")
def _(m: Model) -> DataFrame:
    return m.slide.select("slide_id", nm.slide_slug(F.concat(F.lit("2024 "), "folder")).alias("slug"))


@query("pending_slides", "SELECT slide_id, state FROM {slide} WHERE state IN ('pending', 'processing')")
def _(m: Model) -> DataFrame:
    return m.slide.filter(F.col("state").isin("pending", "processing")).select("slide_id", "state").orderBy("slide_id")


PROPOSED = """proposed AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size * 4 - 8 AS DOUBLE) END AS min_um, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice / 9 END AS max_um,
 CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS rod_min_elong FROM part)"""


@query(
    "clean_thresholds",
    """SELECT p_partkey, min_um, max_um, rod_min_elong, CASE WHEN min_um < 0 OR min_um > 1e6 THEN 'min_um out of range' WHEN max_um < 0 OR max_um > 1e6 THEN 'max_um out of range'
 WHEN rod_min_elong < 0 OR rod_min_elong > 1e6 THEN 'rod_min_elong out of range' WHEN min_um > max_um THEN 'min_um above max_um' WHEN rod_min_elong > 20 THEN 'rod_min_elong above rod_max_elong' ELSE '' END AS why
FROM (SELECT p_partkey, coalesce(min_um, 10::DOUBLE) AS min_um, coalesce(max_um, 150::DOUBLE) AS max_um, coalesce(rod_min_elong, 2::DOUBLE) AS rod_min_elong FROM proposed) q""",
    PROPOSED,
)
def _(m: Model) -> DataFrame:
    p = m.part.selectExpr(
        "p_partkey", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size * 4 - 8 AS DOUBLE) END AS min_um", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice / 9 END AS max_um",
        "CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS rod_min_elong",
    )
    return th.clean_thresholds(p).select("p_partkey", "min_um", "max_um", "rod_min_elong", "why")


@query(
    "threshold_set_id",
    """SELECT sha256(concat('10.0|150.0|', CAST(texture_min AS VARCHAR), '|1.4|0.85|0.92|1500.0|2.0|20.0|0.72|0.85')) AS set_hash, count(*) AS n_runs, texture_min, texture_min <> 1000 AS is_new FROM {run} GROUP BY texture_min""",
)
def _(m: Model) -> DataFrame:
    limits = Thresholds().columns()
    runs = m.run.select("run_id", "texture_min").withColumns({k: c for k, c in limits.items() if k != "texture_min"})
    # The stored sets: those the detections already use, which is the default one.
    known = m.detection.select("threshold_set_id").distinct().filter("threshold_set_id = 1").withColumns(limits).select(th.threshold_hash().alias("set_hash"))
    return th.threshold_set_id(runs, known)


# The tried limits differ from the current ones in one place.
TRIED = Thresholds(texture_min=1600.0)
CHANGE = [
    *JUDGED,
    STORED.replace("stored AS", "stored2 AS").replace("texture < 1000 ", "texture < 1600 "),
    """cls2 AS (SELECT * FROM stored2 QUALIFY row_number() OVER (PARTITION BY detection_id, bbox_x, bbox_y, bbox_w, bbox_h ORDER BY area_px DESC, candidate_no) = 1)""",
    *judged_sql(name="judged2", stored="cls2", prefix="t_"),
    """change AS (SELECT b.detection_id, b.candidate_no, b.mask_key, b.passed, b.cls, b.reject, a.passed AS was_passed, a.cls AS was_cls, a.reject AS was_reject
 FROM judged a JOIN judged2 b ON b.detection_id = a.detection_id AND b.candidate_no = a.candidate_no)""",
]


def change(m: Model) -> DataFrame:
    both = judge_each(m.collapsed, {"was_": Thresholds(), "": TRIED}, SIDE)
    return both.select("detection_id", "candidate_no", "mask_key", *(p + c for p in ("", "was_") for c in ("passed", "cls", "reject")))


@query(
    "threshold_preview",
    """SELECT count(*) FILTER (WHERE was_passed) AS n_before, count(*) FILTER (WHERE passed) AS n_after, count(*) FILTER (WHERE passed AND NOT was_passed) AS n_added,
 count(*) FILTER (WHERE was_passed AND NOT passed) AS n_removed, count(DISTINCT detection_id) FILTER (WHERE was_passed <> passed) AS n_touched FROM change""",
    *CHANGE,
)
def _(m: Model) -> DataFrame:
    return th.preview_totals(change(m))


@query("threshold_preview_keys", "SELECT detection_id, mask_key, CASE WHEN passed THEN 'added' ELSE 'removed' END AS what, cls, reject FROM change WHERE passed <> was_passed", *CHANGE)
def _(m: Model) -> DataFrame:
    return th.preview_keys(change(m))


@query(
    "threshold_apply",
    "SELECT detection_id, candidate_no, passed, cls, reject FROM change WHERE passed <> was_passed OR cls <> was_cls OR reject <> was_reject",
    *CHANGE,
)
def _(m: Model) -> DataFrame:
    return th.changed_rows(change(m))


AFFECTED = """flips AS (SELECT c.detection_id, d.slide_id, count(*) FILTER (WHERE was_passed) AS n_before, count(*) FILTER (WHERE passed) AS n_after, count(*) FILTER (WHERE passed AND NOT was_passed) AS n_added,
 count(*) FILTER (WHERE was_passed AND NOT passed) AS n_removed, count(*) FILTER (WHERE was_passed <> passed) AS flips FROM change c JOIN {detection} d ON d.detection_id = c.detection_id GROUP BY 1, 2)"""


def flips(m: Model) -> DataFrame:
    return th.preview_by_detection(change(m)).join(m.detection.select("detection_id", "slide_id"), "detection_id")


@query("most_affected", "SELECT * FROM flips WHERE flips > 0 ORDER BY flips DESC, slide_id, detection_id LIMIT 24", *CHANGE, AFFECTED)
def _(m: Model) -> DataFrame:
    return th.most_affected(flips(m))


@query(
    "most_affected_mixed",
    """SELECT * FROM head UNION ALL (SELECT * FROM flips WHERE detection_id NOT IN (SELECT detection_id FROM head) ORDER BY slide_id, detection_id LIMIT 12)""",
    *CHANGE,
    AFFECTED,
    "head AS (SELECT * FROM flips WHERE flips > 0 ORDER BY flips DESC, slide_id, detection_id LIMIT 12)",
)
def _(m: Model) -> DataFrame:
    return th.most_affected(flips(m), only_touched=False)


@query(
    "threshold_history",
    """SELECT run_id, CASE WHEN texture_min = 1000 THEN '' ELSE concat('texture_min=', texture_min) END AS changed FROM {run} WHERE status = 'done' ORDER BY started_at DESC, run_id DESC LIMIT 50""",
)
def _(m: Model) -> DataFrame:
    # The last 50 finished runs is the feature.
    limits = F.create_map(F.lit("texture_min"), F.col("texture_min"), F.lit("min_um"), F.lit(10.0), F.lit("max_um"), F.lit(150.0))
    return th.threshold_history(m.run.withColumn("limits", limits))
