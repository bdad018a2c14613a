"""Queries on loading: documents are made of the given tables by Spark, then read back by the loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.names import genus
from tallyscope.operators.verdict import judge
from tallyscope.plans.base import STORED, query
from tallyscope.plans.base import judged as judged_sql
from tallyscope.plans.names import HITS, hits
from tallyscope.plans.verdicts import SIDE
from tallyscope.sources import indexes as ix
from tallyscope.sources import loaders as ld
from tallyscope.session import keep
from tallyscope.sources.model import Model

KEYS = ["locality_id", "key"]


def stored_points(m: Model) -> DataFrame:
    return m.core_point.select("locality_id", F.col("series_key").alias("key"), "depth_mm", "value").withColumn("source", F.when(F.col("depth_mm") % 3 == 0, "manual").otherwise("import"))


def new_points(m: Model) -> DataFrame:
    return m.core_point.filter("depth_mm % 2 = 0").select("locality_id", F.col("series_key").alias("key"), (F.col("depth_mm") + 1).alias("depth_mm"), (F.col("value") * 2).alias("value"))


POINTS = [
    "stored_p AS (SELECT locality_id, series_key AS key, depth_mm, value, CASE WHEN depth_mm % 3 = 0 THEN 'manual' ELSE 'import' END AS source FROM {core_point})",
    "new_p AS (SELECT locality_id, series_key AS key, depth_mm + 1 AS depth_mm, value * 2 AS value FROM {core_point} WHERE depth_mm % 2 = 0)",
]


@query(
    "load_core_series",
    """SELECT locality_id, key, depth_mm, value, source FROM stored_p WHERE source = 'manual' UNION ALL SELECT locality_id, key, depth_mm, value, 'import' FROM new_p WHERE key <> 'error'""",
    *POINTS,
)
def _(m: Model) -> DataFrame:
    # The series file does not know the key 'error'.
    series = m.core_point.filter("series_key <> 'error'").select("locality_id", F.col("series_key").alias("key")).distinct()
    return ld.load_core_series(series, new_points(m), stored_points(m))[0]


@query("load_core_series_refused", "SELECT locality_id, key, depth_mm FROM new_p WHERE key = 'error'", *POINTS)
def _(m: Model) -> DataFrame:
    series = m.core_point.filter("series_key <> 'error'").select("locality_id", F.col("series_key").alias("key")).distinct()
    return ld.load_core_series(series, new_points(m), stored_points(m))[1].select("locality_id", "key", "depth_mm")


SHEET = """sheet AS (SELECT l_partkey % 10 AS locality, l_orderkey % 900 / 10::DOUBLE AS depth, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS c3, l_tax AS c5 FROM lineitem)"""
LONG = """longp AS (SELECT locality, CAST(round_even(depth * 10, 0) AS INT) AS depth_mm, 'ms' AS key, c3 AS value FROM sheet UNION ALL SELECT locality, CAST(round_even(depth * 10, 0) AS INT), 'wc', c5 FROM sheet)"""


def sheet(m: Model) -> DataFrame:
    return m.lineitem.select(
        (F.col("l_partkey") % 10).alias("locality"), (F.col("l_orderkey") % 900 / 10.0).alias("depth"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("c3"), F.col("l_tax").alias("c5")
    )


def blocks(m: Model) -> DataFrame:
    return ld.extract_core_blocks(sheet(m), ["locality"], "depth", "cm", {"c3": "ms", "c5": "wc"})


@query(
    "extract_core_blocks",
    """SELECT locality, key, depth_mm, min(value) AS value, count(*) - count(DISTINCT value) AS n_same, count(DISTINCT value) > 1 AS clash FROM longp WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
    SHEET,
    LONG,
)
def _(m: Model) -> DataFrame:
    return blocks(m)


@query(
    "core_block_plausible",
    """SELECT locality, key, max(depth_mm) / 10.0::DOUBLE AS deepest_cm, max(depth_mm) / 10.0::DOUBLE BETWEEN 60 AND 240 AS plausible FROM longp WHERE value IS NOT NULL GROUP BY 1, 2""",
    SHEET,
    LONG,
)
def _(m: Model) -> DataFrame:
    return ld.plausible_depth(blocks(m), ["locality"], F.lit(120.0))


# Pasted text: two lines per event, with separators, comments and slips of all kinds.
PASTED = """pasted AS (SELECT user_id, event_id % 7 AS block, event_id, event_id % 300 / 10::DOUBLE AS cm, value, event_id % 11 AS slip FROM events)"""
PARSED = """parsed AS (SELECT event_id, CAST(1 AS INT) AS line_no, CASE WHEN why = '' THEN CAST(round_even(cm * 10, 0) AS INT) END AS depth_mm, CASE WHEN why = '' THEN value END AS value, why FROM (
 SELECT *, CASE slip WHEN 1 THEN 'two fields needed' WHEN 2 THEN 'not a number' WHEN 3 THEN 'negative depth' ELSE '' END AS why FROM pasted) q
 UNION ALL SELECT event_id, 2, CAST(round_even(cm * 10, 0) AS INT), CASE WHEN slip = 4 THEN value + 1 ELSE value END, '' FROM pasted WHERE slip IN (4, 5))"""


def pasted(m: Model) -> DataFrame:
    cm, v = "CAST(event_id % 300 / CAST(10 AS DOUBLE) AS STRING)", "CAST(value AS STRING)"
    first = f"CASE event_id % 11 WHEN 1 THEN {cm} WHEN 2 THEN concat('x', '\\t', {v}) WHEN 3 THEN concat('-1 ', {v}) ELSE concat({cm}, ' ;\\t', {v}) END"
    second = f"CASE event_id % 11 WHEN 4 THEN concat({cm}, ',', CAST(value + 1 AS STRING)) WHEN 5 THEN concat('  ', {cm}, ' ', {v}) ELSE '' END"
    return m.events.select("event_id", F.expr(f"concat('# depth value\\n', {first}, '\\n', {second}, '\\n')").alias("text"))


@query("parse_pasted_points", "SELECT * FROM parsed", PASTED, PARSED)
def _(m: Model) -> DataFrame:
    return ld.parse_pasted_points(pasted(m), ["event_id"])


@query(
    "settle_points",
    """SELECT p.event_id, p.depth_mm, f.value, count(*) FILTER (WHERE p.value <> f.value) AS n_clash FROM parsed p JOIN (SELECT DISTINCT ON (event_id, depth_mm) event_id, depth_mm, value FROM parsed WHERE why = '' ORDER BY event_id, depth_mm, line_no) f
 ON f.event_id = p.event_id AND f.depth_mm = p.depth_mm WHERE p.why = '' GROUP BY 1, 2, 3""",
    PASTED,
    PARSED,
)
def _(m: Model) -> DataFrame:
    return ld.settle_points(ld.parse_pasted_points(pasted(m), ["event_id"]), ["event_id"])


@query(
    "preview_points",
    """SELECT coalesce(a.locality_id, b.locality_id) AS locality_id, coalesce(a.key, b.key) AS key, count(*) FILTER (WHERE a.key IS NULL) AS n_new, count(*) FILTER (WHERE a.key IS NOT NULL AND b.key IS NOT NULL) AS n_overwritten, count(*) FILTER (WHERE b.key IS NULL) AS n_removed
FROM stored_p a FULL JOIN new_p b ON b.locality_id = a.locality_id AND b.key = a.key AND b.depth_mm = a.depth_mm GROUP BY 1, 2""",
    *POINTS,
)
def _(m: Model) -> DataFrame:
    return ld.preview_points(stored_points(m), new_points(m), KEYS)


@query(
    "upsert_points",
    "SELECT locality_id, key, depth_mm, value FROM new_p UNION ALL SELECT locality_id, key, depth_mm, value FROM stored_p WHERE (locality_id, key, depth_mm) NOT IN (SELECT (locality_id, key, depth_mm) FROM new_p)",
    *POINTS,
)
def _(m: Model) -> DataFrame:
    return ld.upsert_points(stored_points(m), new_points(m), KEYS)


GUARDED = [
    *POINTS,
    """pasted AS (SELECT * FROM new_p UNION ALL SELECT locality_id, key, depth_mm, value + 1 FROM new_p WHERE locality_id = 2 AND depth_mm % 5 = 1)""",
    """kinds AS (SELECT DISTINCT locality_id, key, CASE WHEN length(key) % 3 = 0 THEN 'import' ELSE 'manual' END AS origin FROM stored_p WHERE locality_id <> 3)""",
    """rules AS (SELECT q.locality_id, q.key, CASE WHEN origin IS NULL THEN 'unknown series' WHEN origin <> 'manual' THEN 'imported series' WHEN clash THEN 'two values for one depth' ELSE '' END AS why
 FROM (SELECT locality_id, key, bool_or(c) AS clash FROM (SELECT locality_id, key, depth_mm, min(value) < max(value) AS c FROM pasted GROUP BY ALL) z GROUP BY ALL) q LEFT JOIN kinds k ON k.locality_id = q.locality_id AND k.key = q.key)""",
    """sent AS (SELECT locality_id, key, depth_mm, min(value) AS value FROM pasted GROUP BY ALL)""",
]


@query(
    "save_points",
    """SELECT s.locality_id, s.key, s.depth_mm, CASE WHEN n.depth_mm IS NOT NULL AND why = '' THEN n.value ELSE s.value END AS value, CASE WHEN n.depth_mm IS NOT NULL AND why = '' THEN 'overwritten' WHEN why = '' THEN 'removed' ELSE 'kept' END AS what, '' AS why
 FROM stored_p s LEFT JOIN rules r ON r.locality_id = s.locality_id AND r.key = s.key LEFT JOIN sent n ON n.locality_id = s.locality_id AND n.key = s.key AND n.depth_mm = s.depth_mm
UNION ALL SELECT n.locality_id, n.key, n.depth_mm, n.value, CASE WHEN why = '' THEN 'inserted' ELSE 'refused' END, why FROM sent n JOIN rules r ON r.locality_id = n.locality_id AND r.key = n.key
 WHERE why <> '' OR NOT EXISTS (SELECT 1 FROM stored_p s WHERE s.locality_id = n.locality_id AND s.key = n.key AND s.depth_mm = n.depth_mm)""",
    *GUARDED,
)
def _(m: Model) -> DataFrame:
    new = new_points(m)
    pasted = new.unionByName(new.filter("locality_id = 2 AND depth_mm % 5 = 1").withColumn("value", F.col("value") + 1))
    kinds = stored_points(m).filter("locality_id <> 3").select(*KEYS, F.when(F.length("key") % 3 == 0, "import").otherwise("manual").alias("origin")).distinct()
    return ld.save_points(stored_points(m), pasted, kinds, KEYS, replace=True)


def detection_docs(m: Model) -> DataFrame:
    """One document per detection with all its masks, larger ones first, and a field that no schema names."""
    c = F.struct(
        F.col("candidate_no").alias("id"), F.array(*[F.col("bbox_" + s).cast("double") for s in "xywh"]).alias("bbox_xywh"), F.array(F.col("bbox_x") + F.col("bbox_w") / 2, F.col("bbox_y") + F.col("bbox_h") / 2).alias("center_xy"),
        "area_px", "shape_ok", F.array(*[F.col(c).cast("double") for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_y", "bbox_w", "bbox_h")]).alias("polygon"), "major_um", "texture", "elongation", "ellipse_iou", "solidity", "cls", "reject",
        F.concat(F.lit("s"), F.col("candidate_no") % 10).alias("session"))
    order = F.struct((-F.col("area_px")).alias("a"), "candidate_no", c.alias("c"))
    pools = m.stored.groupBy("detection_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("passed") == p, order))).alias(n) for n, p in (("candidates", True), ("rejected", False))))
    pools = pools.join(m.detection.select("detection_id", "um_per_pixel", "image_path"), "detection_id")
    doc = F.struct(F.col("image_path").alias("image"), F.array(F.lit(1920), F.lit(1440)).alias("size"), "um_per_pixel", F.create_map(F.lit("texture_min"), F.lit(1000.0)).alias("thresholds"),
                   *(F.transform(n, lambda x: x["c"]).alias(n) for n in ("candidates", "rejected")))
    return pools.select(F.col("detection_id").alias("image_id"), F.to_json(doc).alias("text"))


LOADED = """cls0 AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY detection_id, mask_key ORDER BY passed DESC, area_px DESC, candidate_no) = 1)"""


def told(flat: DataFrame) -> DataFrame:
    points = F.array_join(F.transform("polygon", lambda v: v.cast("int").cast("string")), ",")
    return flat.select(
        F.col("image_id").alias("detection_id"), "mask_key", "passed", "raw_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "center_x", "center_y", "area_px", "shape_ok", "major_um", "texture", "elongation", "ellipse_iou", "solidity",
        "cls", "reject", points.alias("points"), F.get(F.map_values("extra"), F.lit(0)).alias("session"), F.col("doc.um_per_pixel").alias("um_per_pixel"), F.get("doc.size", F.lit(0)).alias("width"))


LOADED_SQL = """SELECT c.detection_id, mask_key, passed, candidate_no AS raw_id, bbox_x, bbox_y, bbox_w, bbox_h, bbox_x + bbox_w / 2 AS center_x, bbox_y + bbox_h / 2 AS center_y, area_px, shape_ok, major_um, texture, elongation, ellipse_iou, solidity, cls, reject,
 concat_ws(',', bbox_x, bbox_y, bbox_w, bbox_y, bbox_w, bbox_h) AS points, concat('s', candidate_no % 10) AS session, d.um_per_pixel, 1920 AS width FROM cls0 c JOIN {detection} d ON d.detection_id = c.detection_id"""


@query("load_detections_json", LOADED_SQL, STORED, LOADED)
def _(m: Model) -> DataFrame:
    return told(ld.flatten_detections(detection_docs(m)))


@query("load_detections_again", LOADED_SQL, STORED, LOADED)
def _(m: Model) -> DataFrame:
    """Loaded, written as documents and loaded once more."""
    once = ld.flatten_detections(detection_docs(m))
    return told(ld.flatten_detections(ld.detection_documents(once)))


@query("load_detections_judged", "SELECT detection_id, candidate_no, passed, cls, reject FROM judged", STORED, LOADED, *judged_sql())
def _(m: Model) -> DataFrame:
    """Loaded candidates are complete: judging them gives what judging the table gives."""
    rows = ld.flatten_detections(detection_docs(m), unnamed=False).drop("mask_key", "doc", "polygon").withColumnsRenamed({"image_id": "detection_id", "raw_id": "candidate_no"})
    # Judging reads its rows three times; the documents are parsed once.
    return judge(keep(rows), max_side=SIDE).select("detection_id", "candidate_no", "passed", "cls", "reject")


@query(
    "load_groups_json",
    """SELECT slide, CAST(g AS INT) AS group_no, concat('f', o_orderkey, '_', g, '_', p) AS name, CAST(p AS INT) AS place, CAST(CASE WHEN g = 0 THEN p ELSE o_custkey % 4 + 1 + p END AS INT) AS seq, p = 0 AS is_sharpest FROM (
SELECT *, concat('s', o_orderkey) AS slide, unnest(range(0, CASE g WHEN 0 THEN o_custkey % 4 + 1 ELSE o_custkey % 3 + 1 END)) AS p FROM (SELECT *, unnest([0, 1]) AS g FROM orders) q) r""",
)
def _(m: Model) -> DataFrame:
    def group(no: int, n) -> object:
        names = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(f"_{no}_"), i.cast("string")))
        return F.struct(F.lit(no).alias("id"), names.alias("images"), n.cast("int").alias("n"), names[0].alias("sharpest"))

    groups = F.array(group(0, F.col("o_custkey") % 4 + 1), group(1, F.col("o_custkey") % 3 + 1))
    docs = m.orders.select(F.to_json(F.struct(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("dir"), groups.alias("groups"))).alias("text"))
    return ld.flatten_groups(docs)


@query(
    "load_stacks_report",
    """SELECT s.tag, CAST(n AS INT) AS n, gain, v.viewpoint_id FROM (SELECT concat('g', o_orderkey) AS tag, o_custkey % 9 AS n, o_custkey / 4::DOUBLE AS gain FROM orders) s LEFT JOIN {viewpoint} v ON v.tag = s.tag""",
)
def _(m: Model) -> DataFrame:
    row = F.struct(F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("tag"), (F.col("o_custkey") % 9).alias("n"), (F.col("o_custkey") / 4.0).alias("gain"))
    docs = m.orders.select(F.to_json(F.array(row)).alias("text"))
    return ld.load_stacks(docs, m.viewpoint).select("tag", "n", "gain", "viewpoint_id")


@query(
    "load_reviews_json",
    """SELECT r.viewpoint_id AS gid, r.image_id, CASE WHEN r.batch_id IS NOT NULL THEN concat('b', r.batch_id) END AS batch, r.mask_key, r.removed, r.accepted, r.geom_edited, r.auto_confirmed, r.is_rep, o.label, o.note, o.species, o.grade, o.pose, r.source,
 CASE WHEN r.bbox_w % 2 = 0 THEN r.object_id END AS link, regexp_replace(r.polygon, '[\\[\\]]', '', 'g') AS points, concat('u', r.object_id % 7) AS who, r.viewpoint_id % 4 <> 0 AS done,
 CASE WHEN r.source = 'manual' THEN 'manual' WHEN c.k IS NULL THEN 'orphan' ELSE 'exact' END AS bind, CASE WHEN c.k IS NOT NULL AND r.source <> 'manual' THEN 1.0::DOUBLE END AS bind_score FROM {correction} r JOIN {object} o ON o.object_id = r.object_id
LEFT JOIN (SELECT DISTINCT detection_id, mask_key AS k FROM {candidate} WHERE bbox_w % 3 <> 0) c ON c.detection_id = r.image_id AND c.k = r.mask_key
QUALIFY row_number() OVER (PARTITION BY r.viewpoint_id, r.image_id, r.batch_id, r.mask_key ORDER BY r.object_id DESC, r.bbox_w DESC) = 1""",
)
def _(m: Model) -> DataFrame:
    r = m.correction.join(m.object.select("object_id", "label", "species", "grade", "pose", "note"), "object_id")
    only = lambda c: F.when(F.col(c), True).alias(c)
    text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    points = F.from_json("polygon", "array<double>").alias("polygon")
    entry = F.struct(
        F.col("mask_key").alias("key"), *(only(c) for c in ("removed", "accepted", "geom_edited", "auto_confirmed", "is_rep")), *(text(c) for c in ("label", "note", "species", "grade", "pose")), "source", points,
        F.when(F.col("bbox_w") % 2 == 0, F.col("object_id")).alias("link"), F.concat(F.lit("u"), F.col("object_id") % 7).alias("who"))
    # One document per viewpoint, with its images and batches and all their objects.
    images = r.groupBy("viewpoint_id", "image_id", "batch_id").agg(F.sort_array(F.collect_list(F.struct("object_id", "bbox_w", entry.alias("e")))).alias("o"))
    image = F.struct(F.col("image_id").cast("string").alias("image"), F.when(F.col("batch_id").isNotNull(), F.concat(F.lit("b"), "batch_id")).alias("batch"), F.transform("o", lambda x: x["e"]).alias("objects"))
    docs = images.groupBy("viewpoint_id").agg(F.collect_list(image).alias("images")).select(F.to_json(F.struct(F.col("viewpoint_id").alias("gid"), (F.col("viewpoint_id") % 4 != 0).alias("done"), "images")).alias("text"))
    flat = ld.flatten_reviews(docs, m.candidate.filter("bbox_w % 3 <> 0").select(F.col("detection_id").alias("image_id"), "mask_key"))
    return flat.select(
        "gid", "image_id", "batch", "mask_key", "removed", "accepted", "geom_edited", "auto_confirmed", "is_rep", "label", "note", "species", "grade", "pose", "source", "link",
        F.array_join(F.transform("polygon", lambda v: v.cast("int").cast("string")), ",").alias("points"), F.get(F.map_values("extra"), F.lit(0)).alias("who"), "done", "bind", "bind_score")


def atlas_docs(m: Model) -> DataFrame:
    h = hits(m)
    places = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct((F.col("doc_id") % 100).alias("plate"), (i + F.col("doc_id")).alias("pdf_page")))
    e = F.struct(
        F.length("binomial").alias("seq"), F.col("binomial").alias("name"), genus(F.col("binomial")).alias("genus"), F.col("binomial"), F.when(F.col("doc_id") % 6 != 0, places).alias("placements")
    )
    return h.select(F.to_json(F.struct(F.struct(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("key")).alias("atlas"), F.array(e).alias("entries"))).alias("text"))


@query(
    "load_atlas_json",
    """SELECT concat(source, '-', doc_id) AS atlas_key, CAST(length(binomial) AS INT) AS seq, binomial AS name, split_part(binomial, ' ', 1) AS genus, CAST(i - 1 AS INT) AS place, CASE WHEN i IS NOT NULL THEN doc_id % 100 END AS plate, i + doc_id AS pdf_page
FROM (SELECT *, unnest(CASE WHEN doc_id % 6 <> 0 THEN range(1, n + 1) ELSE [NULL] END) AS i FROM hits) q""",
    HITS,
)
def _(m: Model) -> DataFrame:
    return ld.flatten_atlas(atlas_docs(m)).select("atlas_key", "seq", "name", "genus", "place", "plate", "pdf_page")


@query(
    "check_atlas_load",
    """SELECT concat(source, '-', doc_id) AS atlas_key, count(DISTINCT length(binomial)) AS s_entries, count(DISTINCT split_part(binomial, ' ', 1)) AS s_genera, count(DISTINCT binomial) AS s_names,
 nullif(count(DISTINCT length(binomial)) FILTER (WHERE n < 3), 0) AS l_entries, nullif(count(DISTINCT split_part(binomial, ' ', 1)) FILTER (WHERE n < 3), 0) AS l_genera, nullif(count(DISTINCT binomial) FILTER (WHERE n < 3), 0) AS l_names,
 count(*) FILTER (WHERE n >= 3) = 0 AS ok FROM hits GROUP BY 1""",
    HITS,
)
def _(m: Model) -> DataFrame:
    # What was loaded lacks the most frequent names.
    h = hits(m).select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("atlas_key"), F.length("binomial").alias("seq"), genus(F.col("binomial")).alias("genus"), F.col("binomial").alias("name"), "n")
    out = ld.check_atlas_load(h.filter("n < 3"), h)
    # Equal counts can hide a swap of same-sized entries, so names decide as well.
    return out.withColumn("ok", F.col("s_names").eqNullSafe(F.col("l_names")))


def index_lines(m: Model, fmt: str) -> DataFrame:
    """Index lines in one of the three formats out of the names of the given texts."""
    h = hits(m).select("doc_id", "source", "binomial", "n")
    name, page = F.col("binomial"), F.col("doc_id") % 97
    plate = (F.length("binomial") + F.col("doc_id")).cast("string")
    if fmt == "numbered":
        text = [F.concat(F.lit("**"), plate, F.lit(". *"), name, F.lit("***")), F.concat(F.lit("<sub>pl. "), plate, F.lit(" · 책 p.3 · PDF p."), page.cast("string"), F.lit("</sub>"))]
    elif fmt == "one_line":
        place = F.concat(F.lit("Tafel "), plate, F.lit(" fig.3 (Band1 PDF p."), page.cast("string"), F.lit("/"), (page + 1).cast("string"), F.lit(")"))
        text = [F.concat(F.lit("- ***"), name, F.lit("*** — "), F.when(F.col("n") > 1, F.concat_ws("; ", place, place)).otherwise(place))]
    else:
        text = [F.concat(F.lit("***"), name, F.lit("***")), F.concat(F.lit("<sub>pl. "), plate, F.lit(" fig. 2 · PDF p."), page.cast("string"), F.lit("/9</sub>")), F.lit("- 11. sec.3, 20 cm")]
    # One document per text; the entries of a text are put in order by their name.
    head = F.array(F.when(F.lit(fmt) == "numbered", F.concat(F.lit("### "), "source")).otherwise(F.concat(F.lit("## "), "source")))
    at = F.row_number().over(_window())
    rows = h.withColumn("_i", at).withColumn("_t", F.when(F.col("_i") == 1, F.concat(head, F.array(*text))).otherwise(F.array(*text)))
    out = rows.select(F.col("doc_id").alias("doc"), "_i", F.posexplode("_t").alias("_k", "line"))
    return out.select("doc", (F.col("_i") * 10 + F.col("_k")).cast("bigint").alias("line_no"), "line")


def _window():
    from pyspark.sql import Window

    # The names of one text, which is one row of the given table.
    return Window.partitionBy("doc_id").orderBy("binomial")


ENTRY = """entry AS (SELECT doc_id AS doc, source AS section, binomial AS name, CAST(length(binomial) + doc_id AS INT) AS plate, CAST(doc_id % 97 AS INT) AS page, n FROM hits)"""


@query("parse_index_entries", "SELECT doc, section, name, plate, page FROM entry UNION ALL SELECT doc, section, name, plate, page FROM entry WHERE n > 1", HITS, ENTRY)
def _(m: Model) -> DataFrame:
    return ld.parse_index_entries(index_lines(m, "one_line"), "one_line").select("doc", "section", "name", "plate", "page")


@query("parse_index_entries_numbered", "SELECT doc, section, name, plate, page FROM entry", HITS, ENTRY)
def _(m: Model) -> DataFrame:
    return ld.parse_index_entries(index_lines(m, "numbered"), "numbered").select("doc", "section", "name", "plate", "page")


@query("parse_index_entries_starred", "SELECT doc, section, name, plate, page FROM entry", HITS, ENTRY)
def _(m: Model) -> DataFrame:
    return ld.parse_index_entries(index_lines(m, "starred"), "starred").select("doc", "section", "name", "plate", "page")


@query(
    "check_index_counts",
    """SELECT doc, count(*) AS raw_entries, count(*) + count(*) FILTER (WHERE n > 1) AS raw_places, count(*) AS entries, count(*) + count(*) FILTER (WHERE n > 1) AS places, count(*) + CASE WHEN doc % 8 = 0 THEN 1 ELSE 0 END AS stated_entries, doc % 8 <> 0 AS ok FROM entry GROUP BY doc""",
    HITS,
    ENTRY,
)
def _(m: Model) -> DataFrame:
    lines = index_lines(m, "one_line")
    stated = hits(m).groupBy(F.col("doc_id").alias("doc")).agg(F.count("*").alias("entries")).withColumn("entries", F.col("entries") + F.when(F.col("doc") % 8 == 0, 1).otherwise(0))
    return ld.check_index_counts(lines, ld.parse_index_entries(lines, "one_line"), "one_line", stated)


def full_index(m: Model, fmt: str) -> DataFrame:
    """Index lines with figures, volumes, notes, samples and tokens that no rule knows."""
    h = hits(m).select("doc_id", "source", "binomial", "n")
    d, size = F.col("doc_id"), F.length("binomial")
    if fmt == "one_line":
        first = F.concat(F.lit("Tafel "), size, F.lit(" fig.. "), d % 9, F.lit(", 12. (Band"), d % 5, F.lit(" PDF p."), d % 97, F.lit("/"), d % 97 + 1, F.lit(")"))
        second = F.concat(F.when(d % 3 == 0, "〔Tafel 아님 · 색인〕 ").otherwise(""), F.lit("Tafel "), size + 1, F.lit(" (Band7 PDF p."), F.col("n"), F.lit("/8)"))
        text = [F.concat(F.lit("- ***"), F.col("binomial"), F.lit("***"), F.when(d % 4 == 0, " *(속명 추정)*").otherwise(""), F.lit(" — "), F.concat_ws("; ", first, second, F.when(d % 6 == 0, "Taf 3")))]
    else:
        text = [
            F.concat(F.lit("***"), F.col("binomial"), F.lit("***"), F.when(d % 5 == 0, " sp. 2").when(d % 5 == 1, " (Ehr.) Kütz").otherwise("")),
            F.concat(F.lit("<sub>pl. "), size, F.lit(" fig. 2, 3 · PDF p."), d % 97, F.lit("/9 · "), F.when(d % 2 == 0, "SEM fig. 1").otherwise("q.v."), F.lit("</sub>")),
            F.lit("- 원문 표기: as printed"), F.concat(F.lit("- pl."), size, F.lit(" — 1. sec.3-4, "), d % 50, F.lit(".5 cm ×1,800, bar · 2. no depth · loose")), F.lit("- crop exists")]
    at = F.row_number().over(_window())
    rows = h.withColumn("_i", at).withColumn("_t", F.when(F.col("_i") == 1, F.concat(F.array(F.concat(F.lit("## "), "source")), F.array(*text))).otherwise(F.array(*text)))
    out = rows.select(F.col("doc_id").alias("doc"), "_i", F.posexplode("_t").alias("_k", "line"))
    return out.select("doc", (F.col("_i") * 10 + F.col("_k")).cast("bigint").alias("line_no"), "line")


@query(
    "parse_index",
    """SELECT doc_id AS doc, source AS section, binomial AS name, split_part(binomial, ' ', 1) AS genus, 'species' AS rank, doc_id % 4 = 0 AS genus_guess, CAST(i AS INT) AS place, CAST(CASE i WHEN 0 THEN length(binomial) ELSE length(binomial) + 1 END AS INT) AS plate,
 CASE i WHEN 0 THEN concat(doc_id % 9, ', 12') END AS figures, CASE i WHEN 0 THEN concat('Band', doc_id % 5) ELSE 'Band7' END AS volume, CAST(CASE i WHEN 0 THEN doc_id % 97 ELSE n END AS INT) AS pdf_page, CAST(CASE i WHEN 0 THEN doc_id % 97 + 1 ELSE 8 END AS INT) AS pdf_plate_page,
 CASE WHEN i = 1 AND doc_id % 3 = 0 THEN 'Tafel 아님 · 색인' END AS note, CASE WHEN doc_id % 6 = 0 THEN 'Taf 3' ELSE '' END AS unparsed FROM hits, (SELECT unnest([0, 1]) AS i) z""",
    HITS,
)
def _(m: Model) -> DataFrame:
    e = ix.parse_index(full_index(m, "one_line"), "one_line")
    e = e.select("doc", "section", "name", "genus", "rank", "genus_guess", F.array_join("unparsed", "|").alias("unparsed"), F.posexplode("placements").alias("place", "p"))
    return e.select("doc", "section", "name", "genus", "rank", "genus_guess", "place", "p.plate", "p.figures", "p.volume", "p.pdf_page", "p.pdf_plate_page", "p.note", "unparsed")


@query(
    "parse_index_samples",
    """SELECT doc_id AS doc, concat(binomial, CASE WHEN doc_id % 5 = 0 THEN ' sp. 2' ELSE '' END) AS name, CASE WHEN doc_id % 5 = 0 THEN 'genus_only' ELSE 'species' END AS rank, CASE WHEN doc_id % 5 = 1 THEN '(Ehr.) Kütz' END AS authority,
 concat(length(binomial), ':2, 3:', doc_id % 97, '/9', CASE WHEN doc_id % 2 = 0 THEN '|SEM:1:/' ELSE '' END) AS places, 'original_note=as printed|hand=crop exists' AS remarks, concat(CASE WHEN doc_id % 2 = 1 THEN 'q.v.|' ELSE '' END, 'loose') AS unparsed,
 CAST(length(binomial) AS INT) AS plate, CAST(k AS INT) AS figure, CASE k WHEN 1 THEN '3-4' END AS section, CASE k WHEN 1 THEN doc_id % 50 + 0.5::DOUBLE END AS depth_cm, CASE k WHEN 1 THEN '1,800' END AS magnification FROM hits, (SELECT unnest([1, 2]) AS k) z""",
    HITS,
)
def _(m: Model) -> DataFrame:
    e = ix.parse_index(full_index(m, "starred"), "starred")
    shown = F.array_join(F.transform("placements", lambda p: F.concat(F.coalesce(p["plate"].cast("string"), p["plate_label"]), F.lit(":"), p["figures"], F.lit(":"), F.coalesce(p["pdf_page"].cast("string"), F.lit("")), F.lit("/"), F.coalesce(p["pdf_plate_page"].cast("string"), F.lit("")))), "|")
    kind = lambda r: F.when(r["kind"] == "원문 표기", "original_note").otherwise(r["kind"])
    e = e.select("doc", "name", "rank", "authority", shown.alias("places"), F.array_join(F.transform("remarks", lambda r: F.concat(kind(r), F.lit("="), r["text"])), "|").alias("remarks"), F.array_join("unparsed", "|").alias("unparsed"), F.explode("samples").alias("x"))
    return e.select("doc", "name", "rank", "authority", "places", "remarks", "unparsed", "x.plate", "x.figure", "x.section", "x.depth_cm", "x.magnification")


def metadata(m: Model) -> DataFrame:
    """Metadata texts as a microscope writes them, one per page of the given table, around its own text."""
    p = F.col("page_id")
    xml = F.concat(
        F.lit("<Meta><AcquisitionDateAndTime>2024-03-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:"), F.lpad((p % 60).cast("string"), 2, "0"),
        F.lit("Z</AcquisitionDateAndTime><NominalMagnification>"), F.when(p % 4 == 0, "20").otherwise("40"),
        F.lit("</NominalMagnification><OptovarMagnification>1.25</OptovarMagnification><CameraAdapterMagnification>0.5</CameraAdapterMagnification><CameraPixelDistance>4.5,4.5</CameraPixelDistance>"),
        F.lit('<Scaling><Items><Distance Id="X"><Value>'), F.when(p % 5 == 0, "7").otherwise(F.concat((p % 9 + 1).cast("string"), F.lit("e-7"))), F.lit("</Value></Distance></Items></Scaling><Note>"), F.length("html").cast("string"), F.lit("</Note></Meta>"),
    )
    return m.pages.select("page_id", F.when(p % 7 != 0, xml).alias("xml"), F.when(p % 3 == 0, F.lit(0.25)).alias("sidecar_um"))


@query(
    "parse_scale_metadata",
    """SELECT page_id, CASE WHEN p7 AND other THEN 0.18::DOUBLE WHEN p7 AND page_id % 5 <> 0 THEN CAST(concat(page_id % 9 + 1, 'e-7') AS DOUBLE) * 1e6 WHEN page_id % 3 = 0 THEN 0.25::DOUBLE ELSE 0.1126::DOUBLE END AS um_per_pixel,
 CASE WHEN p7 AND (other OR page_id % 5 <> 0) THEN 'xml' WHEN page_id % 3 = 0 THEN 'sidecar' ELSE 'default' END AS source, CASE WHEN p7 THEN CASE WHEN other THEN 20::DOUBLE ELSE 40::DOUBLE END END AS objective
FROM (SELECT page_id, page_id % 7 <> 0 AS p7, page_id % 4 = 0 AS other FROM pages) q""",
)
def _(m: Model) -> DataFrame:
    return ld.scale_metadata(metadata(m), ["page_id"])


@query("parse_capture_time", "SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN epoch_us(make_timestamp(2024, 3, page_id % 28 + 1, 10, 0, page_id % 60)) END AS taken_us FROM pages")
def _(m: Model) -> DataFrame:
    return metadata(m).select("page_id", F.unix_micros(ld.capture_time(F.col("xml"))).alias("taken_us"))


@query("scale_drift", "SELECT slide_id, seq, um_per_pixel, first_um FROM (SELECT *, first(um_per_pixel) OVER (PARTITION BY slide_id ORDER BY seq) AS first_um FROM {frame}) q WHERE abs(um_per_pixel - first_um) > first_um * 0.001::DOUBLE")
def _(m: Model) -> DataFrame:
    return ld.scale_drift(m.frame, ["slide_id"])


@query(
    "register_images",
    """SELECT path, min(kind) AS kind, min(viewpoint_id) AS viewpoint_id FROM (SELECT image_path AS path, 'frame' AS kind, viewpoint_id FROM {detection} WHERE image_kind = 'frame' UNION ALL SELECT image_path, 'stack', viewpoint_id FROM {detection} WHERE image_kind = 'stack'
UNION ALL SELECT replace(image_path, '.jpg', '_depth.jpg'), 'depth', viewpoint_id FROM {detection} WHERE image_kind = 'stack') q WHERE path NOT IN (SELECT image_path FROM {detection} WHERE slide_id % 3 = 0) GROUP BY path""",
)
def _(m: Model) -> DataFrame:
    d = m.detection.select(F.col("image_path").alias("path"), "viewpoint_id", "image_kind", "slide_id")
    stacks = d.filter("image_kind = 'stack'")
    depth = stacks.withColumn("path", F.regexp_replace("path", r"\.jpg$", "_depth.jpg"))
    return ld.register_images(d.filter("slide_id % 3 = 0"), (d.filter("image_kind = 'frame'"), "frame"), (stacks, "stack"), (depth, "depth"))


@query(
    "link_detections_to_images",
    """SELECT d.detection_id, CASE WHEN d.detection_id % 2 = 0 THEN d.image_id WHEN d.slide_id % 3 <> 0 THEN d.image_id END AS image_id, d.detection_id % 2 = 1 AND d.slide_id % 3 = 0 AS missing FROM {detection} d""",
)
def _(m: Model) -> DataFrame:
    images = m.detection.filter("slide_id % 3 <> 0").select(F.col("image_path").alias("path"), "image_id")
    old = m.detection.withColumn("image_id", F.when(F.col("detection_id") % 2 == 0, F.col("image_id")))
    return ld.link_detections_to_images(old, images)


@query(
    "page_spread",
    """SELECT vol, page, CASE WHEN lft IN (SELECT page FROM book b WHERE b.vol = q.vol) THEN lft END AS left_page, CASE WHEN lft + 1 IN (SELECT page FROM book b WHERE b.vol = q.vol) THEN lft + 1 END AS right_page,
 CASE WHEN (CASE WHEN lft IN (SELECT page FROM book b WHERE b.vol = q.vol) THEN lft ELSE lft + 1 END) - 1 >= lo THEN (CASE WHEN lft IN (SELECT page FROM book b WHERE b.vol = q.vol) THEN lft ELSE lft + 1 END) - 1 END AS prev_page,
 CASE WHEN (CASE WHEN lft + 1 IN (SELECT page FROM book b WHERE b.vol = q.vol) THEN lft + 1 ELSE lft END) + 1 <= hi THEN (CASE WHEN lft + 1 IN (SELECT page FROM book b WHERE b.vol = q.vol) THEN lft + 1 ELSE lft END) + 1 END AS next_page
FROM (SELECT *, CASE WHEN page % 2 = 1 THEN page ELSE page - 1 END AS lft, min(page) OVER (PARTITION BY vol) AS lo, max(page) OVER (PARTITION BY vol) AS hi FROM book) q""",
    "book AS (SELECT DISTINCT page_id % 5 AS vol, page_id * 3 % 400 AS page FROM pages)",
)
def _(m: Model) -> DataFrame:
    book = m.pages.select((F.col("page_id") % 5).alias("vol"), (F.col("page_id") * 3 % 400).alias("page")).distinct()
    return ld.page_spread(book, ["vol"], even_left=False)
