"""Queries on ordered data and on detector evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.boxes import Box, hexagon
from tallyscope.functions.labels import bbox_label, read_labels, seg_label
from tallyscope.operators import evaluate as ev
from tallyscope.operators import series as se
from tallyscope.operators.overlay import representative_detection, reviewing
from tallyscope.operators.rollup import done_viewpoints
from tallyscope.plans.base import matching, query
from tallyscope.plans.reviews import HISTORY, history
from tallyscope.plans.rollups import LISTED, listed  # noqa: F401
from tallyscope.plans.verdicts import SIDE
from tallyscope.sources.model import Model

MARKED = """marked AS (SELECT *, CAST(sum(CASE WHEN is_break THEN 1 ELSE 0 END) OVER (PARTITION BY slide_id ORDER BY seq) AS BIGINT) AS group_id FROM (
 SELECT *, lag(seq) OVER w IS NOT NULL AS has_prev, lag(seq) OVER w IS NOT NULL AND (corr_prev < 0.55 OR epoch_us(acquired_at) - epoch_us(lag(acquired_at) OVER w) > 43200000000) AS is_break
 FROM {frame} WINDOW w AS (PARTITION BY slide_id ORDER BY seq)) q)"""
MAX_GAP = 43200.0


def marked(m: Model) -> DataFrame:
    return se.mark_groups(m.frame, max_gap_sec=MAX_GAP)


@query(
    "group_series",
    """SELECT slide_id, group_id, count(*) AS n, first(name ORDER BY sharpness DESC, seq) AS sharpest, (epoch_us(last(acquired_at ORDER BY seq)) - epoch_us(first(acquired_at ORDER BY seq))) / 1e6::DOUBLE AS span_sec,
 concat('g', CASE WHEN group_id < 1000 THEN lpad(CAST(group_id AS VARCHAR), 3, '0') ELSE CAST(group_id AS VARCHAR) END, '_', first(name ORDER BY seq), '-', last(name ORDER BY seq)) AS tag FROM marked GROUP BY 1, 2""",
    MARKED,
)
def _(m: Model) -> DataFrame:
    return se.describe_groups(marked(m))


@query(
    "neighbor_correlation",
    """SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS corr FROM (
 SELECT vec_id, [x - list_avg(v) FOR x IN v] AS a, [x - list_avg(p) FOR x IN p] AS b FROM (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(lag(embedding) OVER (ORDER BY vec_id) AS DOUBLE[]) AS p FROM embeddings) q) r""",
)
def _(m: Model) -> DataFrame:
    return se.neighbor_correlation(m.embeddings, [], "vec_id", "embedding").select("vec_id", F.round("corr", 6).alias("corr"))


@query(
    "separability",
    """SELECT *, CASE WHEN overlap > 0 THEN 'overlap' WHEN margin < 0 THEN 'threshold inside a group' WHEN within_n < 10 AND within_n > 0 THEN 'too few pairs' ELSE '' END AS why FROM (
SELECT slide_id, within_n, between_n, CASE WHEN ok THEN round(lo, 4) END AS within_min, CASE WHEN ok THEN round(hi, 4) END AS between_max, CASE WHEN ok THEN round(lo - hi, 4) END AS gap,
 CASE WHEN ok THEN (SELECT count(*) FROM marked m WHERE m.slide_id = e.slide_id AND m.has_prev AND ((NOT is_break AND corr_prev < e.hi) OR (is_break AND corr_prev > e.lo))) END AS overlap,
 CASE WHEN ok THEN round(least(0.55::DOUBLE - hi, lo - 0.55::DOUBLE), 4) END AS margin FROM (
SELECT slide_id, count(*) FILTER (WHERE NOT is_break) AS within_n, count(*) FILTER (WHERE is_break) AS between_n, min(corr_prev) FILTER (WHERE NOT is_break) AS lo, max(corr_prev) FILTER (WHERE is_break) AS hi,
 count(*) FILTER (WHERE is_break) > 0 AND count(*) FILTER (WHERE NOT is_break) > 0 AS ok FROM marked WHERE has_prev GROUP BY 1) e) f""",
    MARKED,
)
def _(m: Model) -> DataFrame:
    return se.separability(marked(m))


@query(
    "split_groups",
    """SELECT slide_id, new_id, was, count(*) AS n, first(name ORDER BY sharpness DESC, seq) AS sharpest, (epoch_us(last(acquired_at ORDER BY seq)) - epoch_us(first(acquired_at ORDER BY seq))) / 1e6::DOUBLE AS span_sec, bool_or(is_new) AS is_new,
 concat('g', lpad(CAST(CASE WHEN bool_or(is_new) THEN new_id ELSE was END AS VARCHAR), 3, '0'), '_', first(name ORDER BY seq), '-', last(name ORDER BY seq)) AS tag FROM (
SELECT *, group_id AS was, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY slide_id ORDER BY seq) AS BIGINT) AS new_id, bool_or(fresh) OVER (PARTITION BY slide_id, group_id) AS is_new FROM (
SELECT *, lag(seq) OVER w IS NOT NULL AND (group_id <> lag(group_id) OVER w OR lag(frame_id) OVER w % 13 = 0) AS starts,
 coalesce(group_id = lag(group_id) OVER w AND lag(frame_id) OVER w % 13 = 0, FALSE) AS fresh FROM marked WINDOW w AS (PARTITION BY slide_id ORDER BY seq)) q) r GROUP BY 1, 2, 3""",
    MARKED,
)
def _(m: Model) -> DataFrame:
    # The photos to cut after: what a person would pick, here by a rule on their number.
    cuts = m.frame.filter("frame_id % 13 = 0").select("slide_id", "frame_id")
    return se.split_groups(marked(m), cuts)


@query(
    "representative_detection",
    """SELECT DISTINCT ON (viewpoint_id) viewpoint_id, detection_id, image_kind FROM {detection} WHERE is_current AND batch_id = 1 ORDER BY viewpoint_id, CASE image_kind WHEN 'stack' THEN 0 ELSE 1 END, detection_id""",
)
def _(m: Model) -> DataFrame:
    return representative_detection(reviewing(m.detection, m.batch)).select("viewpoint_id", "detection_id", "image_kind")


@query(
    "normalize_current",
    """SELECT detection_id, rn = 1 AS is_current FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, image_id ORDER BY is_current DESC, detection_id DESC) AS rn FROM hist) q WHERE (rn = 1) <> is_current""",
    HISTORY,
)
def _(m: Model) -> DataFrame:
    return se.normalize_current(history(m), ["batch_id", "image_id"])


@query(
    "prune_superseded",
    """SELECT detection_id, batch_id, image_id, CASE WHEN cur > 1 THEN 'conflict' ELSE 'drop' END AS what FROM (
SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE is_current) OVER w AS cur, row_number() OVER (PARTITION BY batch_id, image_id ORDER BY is_current DESC, detection_id DESC) AS rn FROM hist WINDOW w AS (PARTITION BY batch_id, image_id)) q
WHERE n > 1 AND (cur > 1 OR rn > 1)""",
    HISTORY,
)
def _(m: Model) -> DataFrame:
    return se.prune_superseded(history(m), ["batch_id", "image_id"])


@query(
    "tiered_retention",
    """SELECT snapshot_id, tier, tier IN ('day', 'unreadable') OR (tier = 'week' AND wrn = 1 AND NOT w_taken) OR (tier = 'month' AND mrn = 1 AND NOT m_taken) AS keep FROM (
SELECT t.*, row_number() OVER (PARTITION BY tier, wk ORDER BY stamp DESC, snapshot_id DESC) AS wrn, row_number() OVER (PARTITION BY tier, mo ORDER BY stamp DESC, snapshot_id DESC) AS mrn,
 coalesce(wk IN (SELECT wk FROM tier WHERE tier = 'day'), FALSE) AS w_taken,
 coalesce(mo IN (SELECT mo FROM tier WHERE tier = 'day' UNION ALL SELECT mo FROM (SELECT *, row_number() OVER (PARTITION BY wk ORDER BY stamp DESC, snapshot_id DESC) AS r FROM tier WHERE tier = 'week') u WHERE r = 1 AND wk NOT IN (SELECT wk FROM tier WHERE tier = 'day')), FALSE) AS m_taken FROM tier t) q""",
    """tier AS (SELECT snapshot_id, stamp, isoyear(stamp) * 100 + weekofyear(stamp) AS wk, year(stamp) * 100 + month(stamp) AS mo,
 CASE WHEN age <= 7 THEN 'day' WHEN age <= 30 THEN 'week' WHEN age IS NULL THEN 'unreadable' ELSE 'month' END AS tier FROM (SELECT *, floor((epoch(TIMESTAMP '2001-08-05 09:00:00') - epoch(stamp)) / 86400.0) AS age FROM {snapshot}) a)""",
)
def _(m: Model) -> DataFrame:
    return se.tiered_retention(m.snapshot, "2001-08-05 09:00:00")


# A display of 100 points, so that the given series are long enough to be thinned.
CAP = 100
THINNED = """thinned AS (SELECT locality_id, series_key, depth_mm, value FROM {core_point} WHERE (locality_id, series_key) IN (SELECT (locality_id, series_key) FROM {core_point} GROUP BY locality_id, series_key HAVING count(*) <= 100)
 UNION SELECT locality_id, series_key, unnest(d) AS depth_mm, unnest(v) AS value FROM (
 SELECT locality_id, series_key, b, [first(depth_mm ORDER BY value, depth_mm), first(depth_mm ORDER BY value DESC, depth_mm)] AS d, [first(value ORDER BY value, depth_mm), first(value ORDER BY value DESC, depth_mm)] AS v FROM (
 SELECT *, ceil(row_number() OVER (PARTITION BY locality_id, series_key ORDER BY depth_mm) / (count(*) OVER (PARTITION BY locality_id, series_key) / 50::DOUBLE)) - 1 AS b, count(*) OVER (PARTITION BY locality_id, series_key) AS n FROM {core_point}) q WHERE n > 100 GROUP BY 1, 2, 3) r)"""


def segments_sql(source: str) -> str:
    return f"""SELECT locality_id, series_key, depth_mm, value, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 100, 3) AS x,
 CAST(coalesce(sum(CASE WHEN gap > mid * 4 THEN 1 ELSE 0 END) OVER (PARTITION BY locality_id, series_key ORDER BY depth_mm), 0) AS BIGINT) AS segment FROM (
SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL) OVER w)[(count(gap) OVER w) // 2 + 1] AS mid FROM (
SELECT *, depth_mm - lag(depth_mm) OVER (PARTITION BY locality_id, series_key ORDER BY depth_mm) AS gap FROM {source}) q WINDOW w AS (PARTITION BY locality_id, series_key)) r"""


@query("profile_thin", "SELECT * FROM thinned", THINNED)
def _(m: Model) -> DataFrame:
    return se.profile_thin(m.core_point, CAP)


@query("profile_segments", segments_sql("{core_point}"))
def _(m: Model) -> DataFrame:
    return se.profile_segments(m.core_point)


@query(
    "core_profiles",
    f"""SELECT s.*, c.sort_order FROM ({segments_sql("(SELECT * FROM thinned WHERE series_key IN ('click', 'error'))")}) s JOIN chosen c ON c.locality_id = s.locality_id AND c.series_key = s.series_key""",
    THINNED,
    "chosen AS (SELECT DISTINCT locality_id, series_key, CASE series_key WHEN 'click' THEN 1 ELSE 2 END AS sort_order FROM {core_point} WHERE series_key IN ('click', 'error'))",
)
def _(m: Model) -> DataFrame:
    chosen = m.core_point.filter(F.col("series_key").isin("click", "error")).select("locality_id", "series_key").distinct()
    chosen = chosen.withColumn("sort_order", F.when(F.col("series_key") == "click", 1).otherwise(2))
    return se.core_profiles(m.core_point, chosen, CAP)


AXIS = """axis AS (SELECT locality_id, step, CAST((deep // step + 1) * step AS INT) AS bottom FROM (SELECT *, coalesce((SELECT min(s) FROM (SELECT unnest([1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000, 2500]) AS s) l WHERE s >= deep / 8.0), 5000) AS step
 FROM (SELECT locality_id, max(depth_cm) AS deep FROM {slide} WHERE depth_cm IS NOT NULL GROUP BY 1) q) r)"""


@query("depth_axis", "SELECT locality_id, step, bottom, CAST(d AS INT) AS depth_cm, round(d / bottom * 100, 3) AS pct FROM (SELECT *, unnest(range(0, bottom + 1, step)) AS d FROM axis) q", AXIS)
def _(m: Model) -> DataFrame:
    return se.depth_axis(m.slide.select("locality_id", "slide_id", "depth_cm"))[0]


@query(
    "depth_axis_marks",
    """SELECT s.locality_id, s.slide_id, s.depth_cm, round(s.depth_cm / a.bottom * 100, 3) AS pct, row_number() OVER (PARTITION BY s.locality_id, s.depth_cm ORDER BY s.slide_id) - 1 AS place,
 count(*) OVER (PARTITION BY s.locality_id, s.depth_cm) AS n_at_depth FROM {slide} s JOIN axis a ON a.locality_id = s.locality_id WHERE s.depth_cm IS NOT NULL""",
    AXIS,
)
def _(m: Model) -> DataFrame:
    return se.depth_axis(m.slide.select("locality_id", "slide_id", "depth_cm"))[1]


@query("sharpness_share", "SELECT frame_id, slide_id, CAST(CASE WHEN top > 0 THEN round_even(sharpness * 100 / top, 0) ELSE 0 END AS BIGINT) AS share FROM (SELECT *, max(sharpness) OVER (PARTITION BY slide_id) AS top FROM {frame}) q")
def _(m: Model) -> DataFrame:
    return se.sharpness_share(m.frame, ["slide_id"])


@query(
    "next_unreviewed",
    """SELECT viewpoint_id, slide_id, idx, coalesce(min(todo) OVER (PARTITION BY slide_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), CASE WHEN min(todo) OVER (PARTITION BY slide_id) <> idx THEN min(todo) OVER (PARTITION BY slide_id) END) AS next_idx
FROM (SELECT v.*, CASE WHEN r.viewpoint_id IS NULL THEN idx END AS todo FROM {viewpoint} v LEFT JOIN (SELECT DISTINCT viewpoint_id FROM {viewpoint_review} WHERE done AND batch_id = 1) r ON r.viewpoint_id = v.viewpoint_id) q""",
)
def _(m: Model) -> DataFrame:
    return se.next_unreviewed(m.viewpoint, done_viewpoints(m.viewpoint_review, m.batch))


LINES = """lines AS (SELECT doc_id, u.no - 1 AS line_no, u.line FROM documents, UNNEST(string_split(text, chr(10))) WITH ORDINALITY AS u(line, no))"""


def lines(m: Model) -> DataFrame:
    return m.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    "heading_carry",
    """SELECT doc_id, line_no, length(line) AS n_chars, last(CASE WHEN length(line) BETWEEN 1 AND 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading FROM lines""",
    LINES,
)
def _(m: Model) -> DataFrame:
    # Short lines of the given texts stand for headings.
    head = F.when(F.length("line").between(1, 60), F.col("line"))
    return se.heading_carry(lines(m), ["doc_id"], "line_no", head).select("doc_id", "line_no", F.length("line").cast("bigint").alias("n_chars"), "heading")


SECTIONS = """sections AS (SELECT CAST(floor(o_orderkey / 300.0) AS BIGINT) AS band, o_orderkey AS seq, o_custkey % 3 = 0 AS is_cont, o_orderkey % 300 * 2 AS page,
 o_orderkey % 300 + CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 0 END - CASE WHEN o_orderkey % 300 > 150 THEN 1 ELSE 0 END AS plate FROM orders)"""


def sections(m: Model) -> DataFrame:
    return m.orders.selectExpr(
        "CAST(floor(o_orderkey / CAST(300 AS DOUBLE)) AS BIGINT) AS band", "o_orderkey AS seq", "o_custkey % 3 = 0 AS is_cont", "o_orderkey % 300 * 2 AS page",
        "o_orderkey % 300 + CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 0 END - CASE WHEN o_orderkey % 300 > 150 THEN 1 ELSE 0 END AS plate",
    )


PAGES = [
    SECTIONS,
    """secrun AS (SELECT *, sum(CASE WHEN is_cont THEN 0 ELSE 1 END) OVER (PARTITION BY band ORDER BY seq) AS run FROM sections)""",
    """pageruns AS (SELECT *, lead(plate) OVER w AS nxt, lead(n) OVER w AS nxt_n, lead(plate, 2) OVER w AS nxt2, row_number() OVER w AS rn FROM (
 SELECT band, run, max(plate) FILTER (WHERE NOT is_cont) AS plate, count(*) AS n, max(page) FILTER (WHERE NOT is_cont) AS page FROM secrun WHERE run > 0 GROUP BY 1, 2) q WINDOW w AS (PARTITION BY band ORDER BY run))""",
    """rec_pages AS (SELECT band, 0::BIGINT AS rn, NULL::BIGINT AS prev, NULL::BIGINT AS p, NULL::BIGINT AS need FROM (SELECT DISTINCT band FROM pageruns)
 UNION ALL SELECT band, rn, p AS prev, CASE WHEN n = 1 THEN plate WHEN need = n THEN p + n WHEN need = 1 THEN p + 1 WHEN nxt IS NOT NULL THEN nxt - 1 ELSE p END, need FROM (
  SELECT r.band, r.rn, w.prev AS before, w.p, r.n, r.plate, r.nxt, CASE WHEN r.nxt_n > 1 AND r.nxt2 IS NOT NULL AND w.p IS NOT NULL AND r.nxt2 - r.nxt_n - 1 >= w.p THEN r.nxt2 - r.nxt_n ELSE r.nxt END - w.p - 1 AS need
  FROM rec_pages w JOIN pageruns r ON r.band = w.band AND r.rn = w.rn + 1) s)""",
    """counted AS (SELECT r.band, r.plate, r.page, r.n, w.prev, r.nxt, w.need, w.need = r.n AS per_page, CASE WHEN w.need = r.n OR w.need = 1 THEN w.prev + 1 END AS true_first
 FROM rec_pages w JOIN pageruns r ON r.band = w.band AND r.rn = w.rn WHERE r.n > 1)""",
]


@query("page_numbering", "SELECT * FROM counted", *PAGES)
def _(m: Model) -> DataFrame:
    return se.page_numbering(sections(m))


@query(
    "page_numbering_fixes",
    """SELECT c.band, c.page, c.plate, r.true_first + CASE WHEN per_page THEN k ELSE 0 END AS true_plate FROM (SELECT *, unnest(range(0, n)) AS k FROM counted WHERE true_first IS NOT NULL) r
JOIN (SELECT band, page, plate FROM sections) c ON c.band = r.band AND c.page = r.page + 2 * k WHERE c.plate <> r.true_first + CASE WHEN per_page THEN k ELSE 0 END""",
    *PAGES,
)
def _(m: Model) -> DataFrame:
    s = sections(m)
    return se.wrong_citations(s.select("band", "page", "plate"), se.page_numbering(s)).select("band", "page", "plate", "true_plate")


MATCHED = [
    """hits AS (SELECT p.image_id, p.pred_no, p.conf, t.truth_no, ix * iy / (p_w * p_h + t_w * t_h - ix * iy) AS iou FROM {prediction} p JOIN {truth} t ON t.image_id = p.image_id,
 LATERAL (SELECT greatest(0, least(p_x + p_w, t_x + t_w) - greatest(p_x, t_x)) AS ix, greatest(0, least(p_y + p_h, t_y + t_h) - greatest(p_y, t_y)) AS iy) o)""",
    "goodhits AS (SELECT * FROM hits WHERE iou >= 0.5)",
    *matching("goodhits", "image_id", "pred_no", "truth_no", "conf DESC, pred_no, iou DESC, truth_no DESC", "hit"),
    "matched AS (SELECT p.image_id, p.pred_no, p.conf, h.truth_no FROM {prediction} p LEFT JOIN hit h ON h.image_id = p.image_id AND h.pred_no = p.pred_no)",
]


def matched(m: Model) -> DataFrame:
    return ev.match_predictions(m.prediction, m.truth, SIDE)


@query("match_predictions", "SELECT * FROM matched", *MATCHED)
def _(m: Model) -> DataFrame:
    return matched(m)


SCORED = """SELECT conf, n_pred, tp, n_pred - tp AS fp, tp / n_pred AS precision, tp / nt AS recall, 2 * (tp / n_pred) * (tp / nt) / (tp / n_pred + tp / nt + 1e-9::DOUBLE) AS f1, n_pred / nt AS count_ratio"""


@query(
    "pr_sweep",
    f"""SELECT conf, n_pred, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(count_ratio, 9) AS count_ratio FROM ({SCORED} FROM (
SELECT t.conf, count(*) AS n_pred, count(truth_no) AS tp, (SELECT count(*) FROM {{truth}}) AS nt FROM (SELECT unnest([0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02, 0.01]::DOUBLE[]) AS conf) t JOIN matched m ON m.conf >= t.conf GROUP BY 1) q) r""",
    *MATCHED,
)
def _(m: Model) -> DataFrame:
    s = ev.pr_sweep(matched(m), m.truth)
    return s.select("conf", "n_pred", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "count_ratio")])


@query(
    "pr_best_f1",
    f"""SELECT conf, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(count_ratio, 9) AS count_ratio, round((SELECT count(truth_no) / (SELECT count(*) FROM {{truth}}) FROM matched), 9) AS recall_ceiling FROM ({SCORED} FROM (
SELECT conf, CAST(sum(count(*)) OVER (ORDER BY conf DESC) AS BIGINT) AS n_pred, CAST(sum(count(truth_no)) OVER (ORDER BY conf DESC) AS BIGINT) AS tp, (SELECT count(*) FROM {{truth}}) AS nt FROM matched GROUP BY conf) q) r ORDER BY f1 DESC, conf DESC LIMIT 1""",
    *MATCHED,
)
def _(m: Model) -> DataFrame:
    s = ev.best_f1(matched(m), m.truth)
    return s.select("conf", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "count_ratio", "recall_ceiling")])


@query(
    "bbox_label",
    """SELECT detection_id, candidate_no, CASE WHEN x1 - bbox_x > 1 AND y1 - bbox_y > 1 THEN printf('%d %.6f %.6f %.6f %.6f', 1, (bbox_x + (x1 - bbox_x) / 2.0) / 80, (bbox_y + (y1 - bbox_y) / 2.0) / 80, (x1 - bbox_x) / 80.0::DOUBLE, (y1 - bbox_y) / 80.0::DOUBLE) END AS label
FROM (SELECT *, least(80, bbox_x + bbox_w) AS x1, least(80, bbox_y + bbox_h) AS y1 FROM {candidate}) q""",
)
def _(m: Model) -> DataFrame:
    return m.candidate.select("detection_id", "candidate_no", bbox_label(Box.of(), F.lit(80), F.lit(80), F.lit(1)).alias("label"))


@query(
    "seg_label",
    """SELECT detection_id, candidate_no, printf('1 %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', x / 128, (y + h / 2) / 128, (x + w / 4) / 128, y / 128, (x + w * 3 / 4) / 128, y / 128, (x + w) / 128, (y + h / 2) / 128, (x + w * 3 / 4) / 128, (y + h) / 128, (x + w / 4) / 128, (y + h) / 128) AS label
FROM (SELECT detection_id, candidate_no, bbox_x::DOUBLE AS x, bbox_y::DOUBLE AS y, bbox_w::DOUBLE AS w, bbox_h::DOUBLE AS h FROM {candidate}) q""",
)
def _(m: Model) -> DataFrame:
    return m.candidate.select("detection_id", "candidate_no", seg_label(hexagon(Box.of()), F.lit(128), F.lit(128), F.lit(1)).alias("label"))


@query("read_boxes_txt", "SELECT detection_id, candidate_no, bbox_x::DOUBLE AS x1, bbox_y::DOUBLE AS y1, (bbox_x + bbox_w)::DOUBLE AS x2, (bbox_y + bbox_h)::DOUBLE AS y2 FROM {candidate}")
def _(m: Model) -> DataFrame:
    # Written as a label line, box or polygon, and read back: an image of 128 pixels loses less than half a thousandth.
    size = F.lit(128)
    line = F.when(F.col("candidate_no") % 2 == 0, bbox_label(Box.of(), size, size, F.lit(1))).otherwise(seg_label(hexagon(Box.of()), size, size, F.lit(1)))
    back = read_labels(m.candidate.select("detection_id", "candidate_no", line.alias("line")), "line", size, size)
    return back.select("detection_id", "candidate_no", *[F.round(c, 2).alias(c) for c in ("x1", "y1", "x2", "y2")])
