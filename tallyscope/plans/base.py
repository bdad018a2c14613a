"""Where the plan modules register their queries: name -> (DataFrame builder, reference SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyscope.sources.model import Model, oracle

QUERIES: dict[str, Callable[[Model], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a builder. ``ctes`` are ``name AS (...)`` clauses that go in front of ``sql``."""

    def keep(build: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = oracle(sql, *ctes)
        return build

    return keep


# The verdict cascade under the default limits, written once more for the checks.
STORED = """stored AS (
SELECT *, why IS NULL AS passed, CASE WHEN why IS NULL THEN (CASE WHEN elongation < 1.4 THEN 'round' ELSE 'rod' END) ELSE '' END AS cls,
       coalesce(why, '') AS reject
FROM (SELECT *, CASE
        WHEN NOT shape_ok THEN 'shape_unmeasurable'
        WHEN major_um < 10 OR major_um > 150 THEN 'major_out_of_range'
        WHEN texture < 1000 THEN 'texture_low'
        WHEN elongation < 1.4 AND texture < 1500 THEN 'round_areolae_low'
        WHEN elongation < 1.4 THEN CASE WHEN ellipse_iou >= 0.85 AND solidity >= 0.92 THEN NULL ELSE 'round_criteria' END
        WHEN elongation >= 2 AND elongation <= 20 THEN CASE WHEN ellipse_iou >= 0.72 AND solidity >= 0.85 THEN NULL ELSE 'rod_criteria' END
        ELSE 'elongation_gap' END AS why
      FROM {candidate}) s)"""


def judged(source: str = "collapsed", name: str = "judged", stored: str = "cls0", prefix: str = "") -> list[str]:
    """Clauses of the whole judgement over ``stored`` verdicts: aggregates, then greedy duplicates by recursion."""
    p = prefix
    return [
        f"""{p}pairs AS (
SELECT detection_id, ano, bno, aarea, barea, atex, btex, inter / greatest(aw * ah, 1) AS aib, inter / greatest(bw * bh, 1) AS bia FROM (
SELECT a.detection_id, a.candidate_no AS ano, b.candidate_no AS bno, a.area_px AS aarea, b.area_px AS barea,
       coalesce(a.texture, 0) AS atex, coalesce(b.texture, 0) AS btex, a.bbox_w AS aw, a.bbox_h AS ah, b.bbox_w AS bw, b.bbox_h AS bh,
       greatest(0, least(a.bbox_x + a.bbox_w, b.bbox_x + b.bbox_w) - greatest(a.bbox_x, b.bbox_x)) *
       greatest(0, least(a.bbox_y + a.bbox_h, b.bbox_y + b.bbox_h) - greatest(a.bbox_y, b.bbox_y)) AS inter
FROM {stored} a JOIN {stored} b ON a.detection_id = b.detection_id AND a.candidate_no <> b.candidate_no WHERE a.passed AND b.passed) q)""",
        f"""{p}agg AS (SELECT detection_id, bno AS candidate_no, count(*) AS n_inside, sum(aarea) AS area_inside FROM {p}pairs
 WHERE aib > 0.85 AND aarea < barea GROUP BY detection_id, bno HAVING count(*) >= 2 AND sum(aarea) > 0.5 * max(barea))""",
        f"""{p}steps AS (SELECT e.detection_id, loser, list(winner) AS before, row_number() OVER (PARTITION BY e.detection_id ORDER BY min(ltex) DESC, loser) AS rn
 FROM (SELECT detection_id, bno AS winner, ano AS loser, atex AS ltex FROM {p}pairs
       WHERE aib > 0.8 AND bia > 0.8 AND (btex > atex OR (btex = atex AND bno < ano))) e
 WHERE NOT EXISTS (SELECT 1 FROM {p}agg g WHERE g.detection_id = e.detection_id AND g.candidate_no IN (e.winner, e.loser))
 GROUP BY e.detection_id, loser)""",
        f"""rec_{p}walk AS (SELECT detection_id, 0::BIGINT AS rn, []::BIGINT[] AS gone FROM (SELECT DISTINCT detection_id FROM {p}steps)
 UNION ALL SELECT s.detection_id, s.rn, CASE WHEN NOT list_has_all(w.gone, s.before)
   THEN list_append(w.gone, s.loser) ELSE w.gone END
 FROM rec_{p}walk w JOIN {p}steps s ON s.detection_id = w.detection_id AND s.rn = w.rn + 1)""",
        f"""{p}dup AS (SELECT DISTINCT detection_id, unnest(gone) AS candidate_no FROM rec_{p}walk)""",
        f"""{name} AS (SELECT s.* REPLACE (s.passed AND d.candidate_no IS NULL AS passed, CASE WHEN d.candidate_no IS NOT NULL THEN 'overlap' ELSE s.reject END AS reject)
 FROM {stored} s LEFT JOIN (SELECT detection_id, candidate_no FROM {p}agg UNION ALL SELECT detection_id, candidate_no FROM {p}dup) d
   ON d.detection_id = s.detection_id AND d.candidate_no = s.candidate_no)""",
    ]


COLLAPSED = """cls0 AS (SELECT * FROM stored QUALIFY row_number() OVER
 (PARTITION BY detection_id, bbox_x, bbox_y, bbox_w, bbox_h ORDER BY area_px DESC, candidate_no) = 1)"""

JUDGED = [STORED, COLLAPSED, *judged()]

OVERLAY = [
    STORED,
    """rdet AS (SELECT d.* FROM {detection} d JOIN {batch} b ON b.batch_id = d.batch_id WHERE d.is_current AND b.for_review)""",
    """rev AS (SELECT r.*, d.detection_id, o.label, o.species, o.grade, o.pose, o.note FROM {correction} r
 JOIN rdet d ON d.image_id = r.image_id AND (r.batch_id IS NULL OR r.batch_id = d.batch_id) LEFT JOIN {object} o ON o.object_id = r.object_id)""",
    """overlay AS (
SELECT d.detection_id, d.viewpoint_id, d.image_id, d.image_kind, d.um_per_pixel, d.slide_id, x.* EXCLUDE (detection_id, base, lab),
       lab <> '' AND state <> 'rejected' AS cls_user, CASE WHEN lab <> '' AND state <> 'rejected' THEN lab ELSE base END AS cls,
       CASE WHEN lab <> '' AND state <> 'rejected' AND lab <> base THEN base ELSE '' END AS cls_auto
FROM (SELECT coalesce(c.detection_id, r.detection_id) AS detection_id, coalesce(c.mask_key, r.mask_key) AS mask_key, c.candidate_no,
        c.passed, c.elongation, c.texture, r.source, r.removed, r.accepted, r.label, r.species, r.grade, r.pose, r.note, r.object_id, r.is_rep,
        r.auto_confirmed, c.candidate_no IS NULL AS orphan, coalesce(r.label, '') AS lab, r.image_id IS NOT NULL AS has_review,
        CASE WHEN coalesce(r.removed, FALSE) THEN 'gone' WHEN c.candidate_no IS NULL OR c.passed OR coalesce(r.accepted, FALSE) THEN 'kept' ELSE 'rejected' END AS state,
        c.candidate_no IS NOT NULL AND NOT c.passed AND coalesce(r.accepted, FALSE) AND NOT coalesce(r.removed, FALSE) AS revived,
        CASE WHEN c.candidate_no IS NULL THEN ''
             WHEN NOT c.passed AND coalesce(r.accepted, FALSE) AND NOT coalesce(r.removed, FALSE)
               THEN CASE WHEN c.elongation < 1.4 THEN 'round' WHEN c.elongation BETWEEN 2 AND 20 THEN 'rod' ELSE '' END
             ELSE c.cls END AS base,
        CASE WHEN c.candidate_no IS NULL OR coalesce(r.geom_edited, FALSE) THEN CAST(round_even(r.bbox_w * r.bbox_h - (r.bbox_w // 3) * (r.bbox_h // 4) / 2.0, 0) AS BIGINT) ELSE c.area_px END AS area_px,
        CASE WHEN c.candidate_no IS NULL OR coalesce(r.geom_edited, FALSE) THEN r.bbox_x ELSE c.bbox_x END AS bbox_x,
        CASE WHEN c.candidate_no IS NULL OR coalesce(r.geom_edited, FALSE) THEN r.bbox_y ELSE c.bbox_y END AS bbox_y,
        CASE WHEN c.candidate_no IS NULL OR coalesce(r.geom_edited, FALSE) THEN r.bbox_w ELSE c.bbox_w END AS bbox_w,
        CASE WHEN c.candidate_no IS NULL OR coalesce(r.geom_edited, FALSE) THEN r.bbox_h ELSE c.bbox_h END AS bbox_h
      FROM (SELECT s.* FROM stored s JOIN rdet ON rdet.detection_id = s.detection_id) c
      FULL JOIN rev r ON r.detection_id = c.detection_id AND r.mask_key = c.mask_key) x
JOIN rdet d ON d.detection_id = x.detection_id)""",
]


def matching(edges: str, group: str, left: str, right: str, order: str, name: str = "taken") -> list[str]:
    """Clauses that walk the rows of ``edges`` in ``order`` inside each ``group`` and take those with both ends free."""
    return [
        f"""{name}_steps AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {edges})""",
        f"""rec_{name} AS (SELECT {group}, 0::BIGINT AS rn, NULL::BIGINT AS l, NULL::BIGINT AS r, FALSE AS took, []::BIGINT[] AS ls, []::BIGINT[] AS rs
 FROM (SELECT DISTINCT {group} FROM {edges})
 UNION ALL SELECT s.{group}, s.rn, s.{left}, s.{right}, NOT list_contains(w.ls, s.{left}) AND NOT list_contains(w.rs, s.{right}),
  CASE WHEN list_contains(w.ls, s.{left}) OR list_contains(w.rs, s.{right}) THEN w.ls ELSE list_append(w.ls, s.{left}) END,
  CASE WHEN list_contains(w.ls, s.{left}) OR list_contains(w.rs, s.{right}) THEN w.rs ELSE list_append(w.rs, s.{right}) END
 FROM rec_{name} w JOIN {name}_steps s ON s.{group} = w.{group} AND s.rn = w.rn + 1)""",
        f"""{name} AS (SELECT s.* FROM rec_{name} w JOIN {name}_steps s ON s.{group} = w.{group} AND s.rn = w.rn WHERE w.took)""",
    ]
