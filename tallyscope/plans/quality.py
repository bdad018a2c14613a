"""Queries of the quality suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import quality as qa
from tallyscope.plans.base import JUDGED, query
from tallyscope.plans.names import ENTRIES, entries, placements
from tallyscope.plans.reviews import HISTORY, history
from tallyscope.plans.verdicts import judged
from tallyscope.operators.verdict import collapse_boxes
from tallyscope.plans.base import STORED
from tallyscope.sources.model import Model


def rule(name: str, bad: str, total: str) -> str:
    """One finding in SQL: ``bad`` selects a column ``l``."""
    return f"""SELECT '{name}' AS check_name, (SELECT count(*) FROM ({bad}) b) AS bad, (SELECT count(*) FROM ({total}) t) AS total,
 coalesce((SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT CAST(l AS VARCHAR) AS l FROM ({bad}) c ORDER BY 1 LIMIT 5) d), '') AS examples"""


def suite(*rules: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(rule(*r) for r in rules)


@query(
    "check_verdicts",
    suite(("verdict", "SELECT concat(a.detection_id, '/', a.candidate_no) AS l FROM cls0 a JOIN judged b ON b.detection_id = a.detection_id AND b.candidate_no = a.candidate_no WHERE a.passed <> b.passed OR a.cls <> b.cls OR a.reject <> b.reject", "SELECT 1 FROM cls0")),
    *JUDGED,
)
def _(m: Model) -> DataFrame:
    # The stored verdicts know nothing of overlaps, so those differ.
    return qa.check_verdicts(collapse_boxes(m.stored), judged(m))


@query(
    "check_current",
    suite(
        ("one current detection per image", "SELECT image_id AS l FROM hist WHERE is_current AND batch_id = 1 GROUP BY 1 HAVING count(*) > 1", "SELECT DISTINCT image_id FROM hist"),
        ("one batch under review", "SELECT n AS l FROM (SELECT count(*) FILTER (WHERE for_review) AS n FROM {batch}) q WHERE n <> 1", "SELECT 1 FROM {batch}"),
        ("no done flag on comment rows", "SELECT viewpoint_id AS l FROM {viewpoint_review} WHERE batch_id IS NULL AND done", "SELECT 1 FROM {viewpoint_review} WHERE batch_id IS NULL"),
        ("no comment on done rows", "SELECT viewpoint_id AS l FROM {viewpoint_review} WHERE batch_id IS NOT NULL AND note <> ''", "SELECT 1 FROM {viewpoint_review} WHERE batch_id IS NOT NULL"),
        ("viewpoint has a detection", "SELECT viewpoint_id AS l FROM {viewpoint} WHERE viewpoint_id NOT IN (SELECT viewpoint_id FROM {detection} WHERE is_current AND batch_id = 1)", "SELECT 1 FROM {viewpoint}"),
    ),
    HISTORY,
)
def _(m: Model) -> DataFrame:
    return qa.check_current(history(m), m.batch, m.viewpoint_review, m.viewpoint, m.detection)


MINE = "SELECT * FROM {correction} WHERE source <> 'manual' AND batch_id = 1"


@query(
    "check_reviews",
    suite(
        ("correction is bound", f"SELECT concat(image_id, '/', mask_key) AS l FROM ({MINE}) m WHERE bind = 'orphan'", MINE),
        ("correction''s mask exists", f"SELECT concat(image_id, '/', mask_key) AS l FROM ({MINE}) m WHERE bind <> 'orphan' AND NOT EXISTS (SELECT 1 FROM {{detection}} d JOIN {{candidate}} c ON c.detection_id = d.detection_id WHERE d.is_current AND d.batch_id = 1 AND d.image_id = m.image_id AND c.mask_key = m.mask_key)", MINE),
        ("correction has geometry", "SELECT concat(image_id, '/', mask_key) AS l FROM {correction} WHERE bbox_x IS NULL OR bbox_w IS NULL", "SELECT 1 FROM {correction}"),
        ("only drawn ones lack a batch", "SELECT concat(image_id, '/', mask_key) AS l FROM {correction} WHERE (source = 'manual') <> (batch_id IS NULL)", "SELECT 1 FROM {correction}"),
    ),
)
def _(m: Model) -> DataFrame:
    return qa.check_reviews(m.correction, m.detection, m.candidate, m.batch)


@query("review_bind_distribution", "SELECT bind, count(*) AS n FROM {correction} GROUP BY 1")
def _(m: Model) -> DataFrame:
    return qa.bind_distribution(m.correction)


@query(
    "check_classes",
    suite(
        ("class is defined", "SELECT k AS l FROM used WHERE k NOT IN (SELECT class_key FROM {class_def})", "SELECT 1 FROM used"),
        ("active class has a hot key", "SELECT class_key AS l FROM {class_def} WHERE active AND hotkey = ''", "SELECT 1 FROM {class_def} WHERE active"),
    ),
    STORED,
    "used AS (SELECT DISTINCT k FROM (SELECT CASE WHEN label = 'fragment' THEN 'debris' ELSE label END AS k FROM {object} UNION ALL SELECT cls FROM stored) q WHERE k <> '')",
)
def _(m: Model) -> DataFrame:
    # One label as it was called before the vocabulary changed.
    old = m.object.withColumn("label", F.when(F.col("label") == "fragment", "debris").otherwise(F.col("label")))
    return qa.check_classes(old, m.stored, m.class_def)


@query(
    "check_scales",
    suite(
        ("detection has a scale", "SELECT detection_id AS l FROM {detection} WHERE um_per_pixel IS NULL", "SELECT 1 FROM {detection}"),
        ("one scale per slide", "SELECT slide_id AS l FROM {frame} GROUP BY 1 HAVING count(DISTINCT round(um_per_pixel, 9)) > 1", "SELECT DISTINCT slide_id FROM {frame}"),
        ("image file exists", "SELECT image_path AS l FROM {detection} WHERE run_id % 17 = 0", "SELECT 1 FROM {detection}"),
    ),
)
def _(m: Model) -> DataFrame:
    listing = m.run.filter("run_id % 17 <> 0").join(m.detection.select("run_id", "image_path"), "run_id").select(F.col("image_path").alias("path"))
    return qa.check_scales(m.detection, m.frame, listing)


@query("check_thresholds", suite(("one threshold set per slide", "SELECT slide_id AS l FROM {detection} GROUP BY 1 HAVING count(DISTINCT threshold_set_id) > 1", "SELECT DISTINCT slide_id FROM {detection}")))
def _(m: Model) -> DataFrame:
    return qa.check_thresholds(m.detection)


@query(
    "check_layers",
    suite(
        ("slide has a sample", "SELECT slide_id AS l FROM {slide} WHERE sample_id IS NULL", "SELECT 1 FROM {slide}"),
        ("position fits the kind", "SELECT sample_id AS l FROM {sample} s JOIN {locality} c ON c.locality_id = s.locality_id WHERE c.kind = 'outcrop' AND s.depth_cm IS NOT NULL", "SELECT 1 FROM {sample}"),
        ("sample has a position", "SELECT sample_id AS l FROM {sample} WHERE depth_cm IS NULL", "SELECT 1 FROM {sample}"),
        ("locality is not empty", "SELECT locality_id AS l FROM {locality} WHERE locality_id NOT IN (SELECT locality_id FROM {sample}) AND locality_id NOT IN (SELECT locality_id FROM {core_point})", "SELECT 1 FROM {locality}"),
    ),
)
def _(m: Model) -> DataFrame:
    return qa.check_layers(m.slide, m.sample, m.locality, m.core_point)


@query(
    "check_links",
    suite(
        ("one representative per link", "SELECT object_id AS l FROM links WHERE reps <> 1", "SELECT 1 FROM links"),
        ("object has members", "SELECT object_id AS l FROM {object} WHERE object_id NOT IN (SELECT object_id FROM {correction} WHERE accepted)", "SELECT 1 FROM {object}"),
        ("no removed member in a link", "SELECT object_id AS l FROM links WHERE gone > 0", "SELECT 1 FROM links"),
        ("members stay in the viewpoint", "SELECT concat(r.image_id, '/', r.mask_key) AS l FROM acc r JOIN {object} o ON o.object_id = r.object_id WHERE r.viewpoint_id <> o.viewpoint_id", "SELECT 1 FROM acc"),
        ("linked mask exists", "SELECT concat(image_id, '/', mask_key) AS l FROM acc r WHERE source = 'engine' AND object_id IN (SELECT object_id FROM links) AND NOT EXISTS (SELECT 1 FROM {detection} d JOIN {candidate} c ON c.detection_id = d.detection_id WHERE d.is_current AND d.image_id = r.image_id AND c.mask_key = r.mask_key)", "SELECT 1 FROM acc WHERE source = 'engine' AND object_id IN (SELECT object_id FROM links)"),
    ),
    "acc AS (SELECT * FROM {correction} WHERE accepted)",
    "links AS (SELECT object_id, count(*) FILTER (WHERE is_rep) AS reps, count(*) FILTER (WHERE removed) AS gone FROM acc GROUP BY 1 HAVING count(*) > 1)",
)
def _(m: Model) -> DataFrame:
    # Links are read from the accepted corrections only, so some objects have lost their members.
    return qa.check_links(m.correction.filter("accepted"), m.object, m.detection, m.candidate)


@query(
    "check_catalog",
    suite(
        ("batch has a code", "SELECT label AS l FROM {batch} WHERE code = '' AND batch_id IN (SELECT batch_id FROM {detection} WHERE is_current)", "SELECT 1 FROM {batch} WHERE batch_id IN (SELECT batch_id FROM {detection} WHERE is_current)"),
        ("no batch is called M", "SELECT label AS l FROM {batch} WHERE upper(code) = 'M'", "SELECT 1 FROM {batch}"),
        ("localities stay apart", "SELECT concat(s, '/', c) AS l FROM parts WHERE n > 1", "SELECT 1 FROM parts"),
        ("slide can be numbered", "SELECT slug AS l FROM {slide} WHERE sample_id IS NULL", "SELECT 1 FROM {slide}"),
        ("named object has a batch", "SELECT concat(image_id, '/', mask_key) AS l FROM named WHERE batch_id IS NULL AND source <> 'manual'", "SELECT 1 FROM named"),
        ("named object''s batch has a code", "SELECT concat(image_id, '/', mask_key) AS l FROM named WHERE batch_id IN (SELECT batch_id FROM {batch} WHERE code = '')", "SELECT 1 FROM named"),
    ),
    "parts AS (SELECT t.code AS s, upper(regexp_replace(l.code, '[^A-Za-z0-9]', '', 'g')) AS c, count(*) AS n FROM {locality} l JOIN {site} t ON t.site_id = l.site_id GROUP BY 1, 2)",
    "named AS (SELECT * FROM {correction} WHERE object_id IN (SELECT object_id FROM {object} WHERE species <> ''))",
)
def _(m: Model) -> DataFrame:
    return qa.check_catalog(m.batch, m.detection, m.locality, m.site, m.slide, m.correction, m.object)


@query(
    "check_grade_pose",
    suite(
        ("no grade or pose on fragments", "SELECT object_id AS l FROM {object} WHERE (grade <> '' OR pose <> '') AND label IN (SELECT class_key FROM {class_def} WHERE NOT counted)", "SELECT 1 FROM {object} WHERE grade <> '' OR pose <> ''"),
        ("no grade or pose on removed objects", "SELECT object_id AS l FROM {object} WHERE (grade <> '' OR pose <> '') AND object_id NOT IN (SELECT object_id FROM {correction} WHERE NOT removed)", "SELECT 1 FROM {object} WHERE grade <> '' OR pose <> ''"),
        ("grade A has a species", "SELECT object_id AS l FROM {object} WHERE grade = 'A' AND species = ''", "SELECT 1 FROM {object} WHERE grade = 'A'"),
    ),
)
def _(m: Model) -> DataFrame:
    return qa.check_grade_pose(m.object, m.class_def, m.correction)


@query(
    "check_atlas",
    suite(
        ("entry has a placement", "SELECT concat(atlas_key, '/', binomial) AS l FROM entries WHERE (atlas_key, binomial) NOT IN (SELECT (atlas_key, binomial) FROM places WHERE doc_id % 5 <> 0)", "SELECT 1 FROM entries"),
        ("placement has a page", "SELECT concat(atlas_key, '/', binomial) AS l FROM places WHERE doc_id % 5 <> 0 AND page IS NULL", "SELECT 1 FROM places WHERE doc_id % 5 <> 0"),
        ("taxon class is in an index", "SELECT class_key AS l FROM {class_def} WHERE is_taxon AND class_key NOT IN (SELECT genus FROM entries)", "SELECT 1 FROM {class_def} WHERE is_taxon"),
        ("species is in an index", "SELECT DISTINCT species AS l FROM {object} WHERE species <> '' AND species NOT IN (SELECT binomial FROM entries)", "SELECT DISTINCT species FROM {object} WHERE species <> ''"),
    ),
    *ENTRIES,
)
def _(m: Model) -> DataFrame:
    # The places of some texts are withheld, so that entries without any exist.
    return qa.check_atlas(entries(m), placements(m).filter("doc_id % 5 <> 0"), m.class_def, m.object)


@query(
    "check_image_links",
    suite(
        ("detection has an image", "SELECT detection_id AS l FROM {detection} d WHERE image_id NOT IN (SELECT image_id FROM images)", "SELECT 1 FROM {detection}"),
        ("paths agree", "SELECT detection_id AS l FROM {detection} d JOIN images i ON i.image_id = d.image_id WHERE i.path <> d.image_path", "SELECT 1 FROM {detection}"),
        ("correction has an image", "SELECT concat(image_id, '/', mask_key) AS l FROM {correction} WHERE image_id NOT IN (SELECT image_id FROM images)", "SELECT 1 FROM {correction}"),
        ("correction''s viewpoint is its image''s", "SELECT concat(r.image_id, '/', r.mask_key) AS l FROM {correction} r JOIN images i ON i.image_id = r.image_id WHERE i.viewpoint_id <> r.viewpoint_id", "SELECT 1 FROM {correction}"),
        ("correction key is unique", "SELECT concat(image_id, '/', mask_key) AS l FROM {correction} GROUP BY image_id, batch_id, mask_key HAVING count(*) > 1", "SELECT 1 FROM {correction}"),
    ),
    "images AS (SELECT o_orderkey AS image_id, CAST(floor(o_orderkey / CAST(2 AS DOUBLE)) AS BIGINT) + CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS viewpoint_id, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'stacks/' ELSE 'photos/' END, 'img', o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN '.JPG' ELSE '.jpg' END) AS path FROM orders WHERE o_orderkey % 29 <> 0)",
)
def _(m: Model) -> DataFrame:
    # An image table with gaps and slips of the kind the check looks for.
    images = m.detection.filter("image_id % 29 <> 0").selectExpr(
        "image_id", "viewpoint_id + CASE WHEN image_id % 37 = 0 THEN 1 ELSE 0 END AS viewpoint_id", "CASE WHEN image_id % 41 = 0 THEN replace(image_path, '.jpg', '.JPG') ELSE image_path END AS path"
    )
    return qa.check_image_links(images, m.detection, m.correction)
