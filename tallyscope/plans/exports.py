"""Queries on exports and on watched folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import exports as ex
from tallyscope.plans.base import OVERLAY, query
from tallyscope.plans.reviews import overlay
from tallyscope.plans.rollups import DONE, done_slides
from tallyscope.sources.model import Model
from tallyscope.streaming import folders as fo


@query(
    "export_reviews",
    """SELECT viewpoint_id, image_id, 'objects' AS what, CAST(0 AS BIGINT) AS part, concat('{{"format":4,"image":', image_id, ',"kind":"', image_kind, '","batch":', b, ',"n_objects":', count(*), ',"objects":[', string_agg(entry, ',' ORDER BY mask_key), ']}}') AS doc FROM (
SELECT r.viewpoint_id, r.image_id, d.image_kind, coalesce(r.batch_id, 0) AS b, r.mask_key, concat('{{"key":"', r.mask_key, '"', CASE WHEN removed THEN ',"removed":true' ELSE '' END, CASE WHEN accepted THEN ',"accepted":true' ELSE '' END, CASE WHEN label <> '' THEN concat(',"label":"', label, '"') ELSE '' END,
 CASE WHEN note <> '' THEN concat(',"note":"', note, '"') ELSE '' END, ',"bind":"', bind, '"', CASE WHEN species <> '' THEN concat(',"species":"', species, '"') ELSE '' END, CASE WHEN grade <> '' THEN concat(',"grade":"', grade, '"') ELSE '' END, CASE WHEN pose <> '' THEN concat(',"pose":"', pose, '"') ELSE '' END,
 ',"bbox":[', bbox_x, ',', bbox_y, ',', bbox_w, ',', bbox_h, ']}}') AS entry FROM {correction} r JOIN {object} o ON o.object_id = r.object_id JOIN {detection} d ON d.image_id = r.image_id) q GROUP BY viewpoint_id, image_id, image_kind, b
UNION ALL SELECT viewpoint_id, NULL, 'links', 0, concat('{{"format":4,"viewpoint_id":', viewpoint_id, ',"n_members":', count(*), ',"members":[', string_agg(concat('{{"object_id":', object_id, ',"image":', image_id, ',"key":"', mask_key, '","rep":', is_rep, '}}'), ',' ORDER BY object_id, image_id, mask_key), ']}}') FROM {correction}
 WHERE object_id IN (SELECT object_id FROM {correction} GROUP BY 1 HAVING count(*) > 1) GROUP BY viewpoint_id""",
)
def _(m: Model) -> DataFrame:
    return ex.export_reviews(m.correction, m.object, m.detection)


SPLIT = """splits AS (SELECT viewpoint_id, slide_id, CASE WHEN slide_id = 5 THEN 'val_slide' WHEN k <= round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM (
SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY sha256(concat('7:', viewpoint_id))) AS k, count(*) OVER (PARTITION BY slide_id) AS n FROM doneview) q)"""


def splits(m: Model) -> DataFrame:
    v = done_slides(m).withColumn("slug", F.concat(F.lit("slide-"), F.col("slide_id").cast("string")))
    return ex.split_train_val(v, 0.2, 7, holdout="slide-5")


@query("split_train_val", "SELECT * FROM splits", DONE, SPLIT)
def _(m: Model) -> DataFrame:
    return splits(m)


LABELS = """labelled AS (SELECT s.split, s.viewpoint_id, o.image_id, o.cls, CASE WHEN no IS NOT NULL AND x1 - bbox_x > 1 AND y1 - bbox_y > 1 THEN printf('%d %.6f %.6f %.6f %.6f', no, (bbox_x + (x1 - bbox_x) / 2.0) / 100, (bbox_y + (y1 - bbox_y) / 2.0) / 100, (x1 - bbox_x) / 100.0::DOUBLE, (y1 - bbox_y) / 100.0::DOUBLE) ELSE '' END AS line
 FROM splits s LEFT JOIN (SELECT o.*, c.sort_order - 1 AS no, least(100, bbox_x + bbox_w) AS x1, least(100, bbox_y + bbox_h) AS y1 FROM overlay o LEFT JOIN {class_def} c ON c.class_key = o.cls WHERE state = 'kept') o ON o.viewpoint_id = s.viewpoint_id)"""


def label_lines(m: Model) -> DataFrame:
    kept = overlay(m).filter("state = 'kept'").select("viewpoint_id", "image_id", "cls", *["bbox_" + s for s in "xywh"])
    return ex.export_labels(kept, splits(m).select("viewpoint_id", "split"), m.class_def, 100, 100)


@query("export_labels", "SELECT *, cls IS NOT NULL AND line = '' AS dropped FROM labelled", *OVERLAY, DONE, SPLIT, LABELS)
def _(m: Model) -> DataFrame:
    return label_lines(m)


@query(
    "export_label_manifest",
    """SELECT split, cls, CAST(grouping_id(split, cls) AS BIGINT) AS level, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE known AND line = '') AS n_dropped, count(DISTINCT viewpoint_id) AS n_viewpoints
FROM (SELECT split, viewpoint_id, cls IS NOT NULL AS known, coalesce(cls, '') AS cls, line FROM labelled) q GROUP BY ROLLUP (split, cls)""",
    *OVERLAY,
    DONE,
    SPLIT,
    LABELS,
)
def _(m: Model) -> DataFrame:
    return ex.label_manifest(label_lines(m))


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(m: Model) -> DataFrame:
    return ex.content_hashes(m.documents, ["doc_id"], "text")


FOLDERS = [
    """obs AS (SELECT *, concat(n_files, ':', n_sidecars, ':', n_bytes) AS sig, lag(concat(n_files, ':', n_sidecars, ':', n_bytes)) OVER (PARTITION BY folder_id ORDER BY seen_at, event_id) AS before FROM {folder_scan})""",
    """folders AS (SELECT folder_id, last(sig ORDER BY seen_at, event_id) AS signature, max(seen_at) FILTER (WHERE before IS NULL OR before <> sig) AS since, max(seen_at) AS last_seen, last(n_files ORDER BY seen_at, event_id) AS n_files FROM obs GROUP BY 1)""",
    """states AS (SELECT folder_id, signature, epoch_us(since) AS since_us, epoch_us(last_seen) AS last_us, n_files, CASE WHEN n_files = 0 THEN 'empty' WHEN folder_id % 10 = 0 THEN 'known' WHEN epoch_us(last_seen) - epoch_us(since) < 300000000 THEN 'copying' ELSE 'new' END AS state FROM folders)""",
]


def with_state(f: DataFrame) -> DataFrame:
    s = f.withColumn("state", fo.folder_state(F.col("folder_id") % 10 == 0))
    return s.select("folder_id", "signature", F.unix_micros("since").alias("since_us"), F.unix_micros("last_seen").alias("last_us"), "n_files", "state")


@query("folder_arrivals", "SELECT * FROM states", *FOLDERS)
def _(m: Model) -> DataFrame:
    return with_state(fo.settled(m.folder_scan))


def observation_stream(m: Model) -> DataFrame:
    events = m.spark.readStream.schema(m.events.schema).option("pathGlobFilter", "events.parquet").parquet(m.folder)
    return events.selectExpr(
        "user_id AS folder_id", "CAST(ts AS TIMESTAMP) AS seen_at", "event_id", "CAST(floor(value / 100) AS INT) AS n_files", "CAST(floor(value / 120) AS INT) AS n_sidecars",
        "CAST(floor(value / 100) AS BIGINT) * 4096 + CASE WHEN user_id % 16 = 9 AND event_id % 2 = 0 THEN 512 ELSE 0 END AS n_bytes"
    )


@query("folder_arrivals_stream", "SELECT * FROM states", *FOLDERS)
def _(m: Model) -> DataFrame:
    written = fo.run_to_end(fo.watch(observation_stream(m), forget=False), m.spark)
    return with_state(fo.latest(written))


@query(
    "folder_alarms",
    """SELECT folder_id, count(*) AS n_settled, max(since_us) AS last_us FROM (SELECT folder_id, epoch_us(min(seen_at)) AS since_us, arg_max(n_files, (seen_at, event_id)) AS n_files,
 lead(epoch_us(min(seen_at))) OVER (PARTITION BY folder_id ORDER BY min(seen_at), min(event_id)) AS gone_us
 FROM (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM sig THEN 0 ELSE 1 END) OVER (PARTITION BY folder_id ORDER BY seen_at, event_id) AS spell FROM obs) q GROUP BY folder_id, spell) r
 WHERE n_files > 0 AND (gone_us IS NULL OR gone_us >= since_us + 300000000) GROUP BY 1""",
    *FOLDERS[:1],
)
def _(m: Model) -> DataFrame:
    """Every spell of five minutes without change rings once, whether or not its folder was looked at again."""
    return fo.spells(m.folder_scan).groupBy("folder_id").agg(F.count("*").alias("n_settled"), F.max(F.unix_micros("since")).alias("last_us"))


@query("missing_sidecars", "SELECT folder_id, event_id, n_files, n_sidecars FROM {folder_scan} WHERE n_sidecars < n_files")
def _(m: Model) -> DataFrame:
    return fo.missing_sidecars(m.folder_scan).select("folder_id", "event_id", "n_files", "n_sidecars")


@query("missing_sidecars_stream", "SELECT folder_id, event_id, n_files, n_sidecars FROM {folder_scan} WHERE n_sidecars < n_files")
def _(m: Model) -> DataFrame:
    found = fo.missing_sidecars(observation_stream(m)).select("folder_id", "event_id", "n_files", "n_sidecars")
    return fo.run_to_end(found, m.spark, "append").drop("batch")


@query("ingest_new", "SELECT folder_id, 'pending' AS state FROM states WHERE state = 'new' AND folder_id NOT IN (SELECT slide_id FROM {slide} WHERE slide_id % 3 = 0)", *FOLDERS)
def _(m: Model) -> DataFrame:
    have = m.slide.filter("slide_id % 3 = 0").select(F.col("slide_id").alias("folder_id"))
    return fo.ingest_new(with_state(fo.settled(m.folder_scan)), have)


@query(
    "slide_state",
    """SELECT s.slide_id, s.state AS was, CASE WHEN s.state = 'failed' OR n IS NULL THEN s.state WHEN miss > 0 THEN 'processing' ELSE 'done' END AS state, coalesce(miss, 0) AS n_missing FROM {slide} s
LEFT JOIN (SELECT slide_id, count(*) AS n, count(*) FILTER (WHERE viewpoint_id NOT IN (SELECT viewpoint_id FROM {detection} WHERE is_current)) AS miss FROM {viewpoint} GROUP BY 1) v ON v.slide_id = s.slide_id""",
)
def _(m: Model) -> DataFrame:
    return fo.slide_state(m.slide, m.viewpoint, m.detection)
