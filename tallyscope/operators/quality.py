"""Data-quality checks. Each yields one row per rule: check_name, bad, total, examples (the first five offenders)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.naming import DRAWN_BATCH_CODE, code_part
from tallyscope.operators.overlay import has_text, reviewing

EXAMPLES = 5


def finding(name: str, bad: DataFrame, total: DataFrame, label: Column) -> DataFrame:
    """Count the offenders against the total and show the first few by label; only those few meet in one task."""
    few = bad.select(label.cast("string").alias("_l")).orderBy("_l").limit(EXAMPLES)
    shown = few.agg(F.array_join(F.array_sort(F.collect_list("_l")), ",")).scalar()
    return bad.agg(F.count("*").alias("bad")).select(
        F.lit(name).alias("check_name"), "bad", total.agg(F.count("*")).scalar().alias("total"), shown.alias("examples")
    )


def report(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def pair(*cols: str) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in cols])


def check_verdicts(stored: DataFrame, computed: DataFrame) -> DataFrame:
    cols = ["passed", "cls", "reject"]
    now = computed.select("detection_id", "candidate_no", *[F.col(c).alias("now_" + c) for c in cols])
    j = stored.join(now, ["detection_id", "candidate_no"])
    differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col("now_" + c)) for c in cols])
    return report(finding("verdict", j.filter(differs), stored, pair("detection_id", "candidate_no")))


def check_current(history: DataFrame, batches: DataFrame, viewpoint_reviews: DataFrame, viewpoints: DataFrame, detections: DataFrame) -> DataFrame:
    several = reviewing(history, batches).groupBy("image_id").agg(F.count("*").alias("n")).filter("n > 1")
    flags = batches.agg(F.count_if("for_review").alias("n")).filter("n <> 1")
    comments, done_rows = viewpoint_reviews.filter("batch_id IS NULL"), viewpoint_reviews.filter("batch_id IS NOT NULL")
    bare = viewpoints.join(reviewing(detections, batches).select("viewpoint_id"), "viewpoint_id", "left_anti")
    return report(
        finding("one current detection per image", several, history.select("image_id").distinct(), F.col("image_id")),
        finding("one batch under review", flags, batches, F.col("n")),
        finding("no done flag on comment rows", comments.filter("done"), comments, F.col("viewpoint_id")),
        finding("no comment on done rows", done_rows.filter("note <> ''"), done_rows, F.col("viewpoint_id")),
        finding("viewpoint has a detection", bare, viewpoints, F.col("viewpoint_id")),
    )


def check_reviews(corrections: DataFrame, detections: DataFrame, candidates: DataFrame, batches: DataFrame) -> DataFrame:
    shown = reviewing(detections, batches).select("detection_id", "image_id")
    mine = corrections.filter("source <> 'manual'").join(F.broadcast(batches.filter("for_review").select("batch_id")), "batch_id", "left_semi")
    keys = candidates.select("detection_id", "mask_key").join(shown, "detection_id").select("image_id", "mask_key")
    label = pair("image_id", "mask_key")
    return report(
        finding("correction is bound", mine.filter("bind = 'orphan'"), mine, label),
        finding("correction's mask exists", mine.filter("bind <> 'orphan'").join(keys, ["image_id", "mask_key"], "left_anti"), mine, label),
        finding("correction has geometry", corrections.filter("bbox_x IS NULL OR bbox_w IS NULL"), corrections, label),
        finding("only drawn ones lack a batch", corrections.filter("(source = 'manual') <> (batch_id IS NULL)"), corrections, label),
    )


def bind_distribution(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("bind").agg(F.count("*").alias("n"))


def check_classes(objects: DataFrame, candidates: DataFrame, classes: DataFrame) -> DataFrame:
    used = objects.select(F.col("label").alias("class_key")).unionByName(candidates.select(F.col("cls").alias("class_key"))).filter("class_key <> ''").distinct()
    active = classes.filter("active")
    return report(
        finding("class is defined", used.join(classes, "class_key", "left_anti"), used, F.col("class_key")),
        finding("active class has a hot key", active.filter("hotkey = ''"), active, F.col("class_key")),
    )


def check_scales(detections: DataFrame, frames: DataFrame, files: DataFrame) -> DataFrame:
    n = frames.groupBy("slide_id").agg(F.count_distinct(F.round("um_per_pixel", 9)).alias("n"))
    return report(
        finding("detection has a scale", detections.filter("um_per_pixel IS NULL"), detections, F.col("detection_id")),
        finding("one scale per slide", n.filter("n > 1"), n, F.col("slide_id")),
        finding("image file exists", detections.join(files.select(F.col("path").alias("image_path")), "image_path", "left_anti"), detections, F.col("image_path")),
    )


def check_thresholds(detections: DataFrame) -> DataFrame:
    n = detections.groupBy("slide_id").agg(F.count_distinct("threshold_set_id").alias("n"))
    return report(finding("one threshold set per slide", n.filter("n > 1"), n, F.col("slide_id")))


def check_layers(slides: DataFrame, samples: DataFrame, localities: DataFrame, core_points: DataFrame) -> DataFrame:
    placed = samples.join(localities.select("locality_id", "kind"), "locality_id")
    filled = samples.select("locality_id").unionByName(core_points.select("locality_id")).distinct()
    return report(
        finding("slide has a sample", slides.filter("sample_id IS NULL"), slides, F.col("slide_id")),
        finding("position fits the kind", placed.filter("kind = 'outcrop' AND depth_cm IS NOT NULL"), samples, F.col("sample_id")),
        finding("sample has a position", samples.filter("depth_cm IS NULL"), samples, F.col("sample_id")),
        finding("locality is not empty", localities.join(filled, "locality_id", "left_anti"), localities, F.col("locality_id")),
    )


def check_links(corrections: DataFrame, objects: DataFrame, detections: DataFrame, candidates: DataFrame) -> DataFrame:
    g = corrections.groupBy("object_id").agg(F.count("*").alias("n"), F.count_if("is_rep").alias("reps"), F.count_if("removed").alias("gone"))
    links = g.filter("n > 1")
    home = objects.select("object_id", F.col("viewpoint_id").alias("_home"))
    away = corrections.join(home, "object_id").filter("viewpoint_id <> _home")
    keys = candidates.select("detection_id", "mask_key").join(detections.filter("is_current").select("detection_id", "image_id"), "detection_id").select("image_id", "mask_key")
    members = corrections.filter("source = 'engine'").join(links.select("object_id"), "object_id", "left_semi")
    return report(
        finding("one representative per link", links.filter("reps <> 1"), links, F.col("object_id")),
        finding("object has members", objects.join(corrections.select("object_id"), "object_id", "left_anti"), objects, F.col("object_id")),
        finding("no removed member in a link", links.filter("gone > 0"), links, F.col("object_id")),
        finding("members stay in the viewpoint", away, corrections, pair("image_id", "mask_key")),
        finding("linked mask exists", members.join(keys, ["image_id", "mask_key"], "left_anti"), members, pair("image_id", "mask_key")),
    )


def check_catalog(batches: DataFrame, detections: DataFrame, localities: DataFrame, sites: DataFrame, slides: DataFrame, corrections: DataFrame, objects: DataFrame) -> DataFrame:
    used = batches.join(detections.filter("is_current").select("batch_id").distinct(), "batch_id", "left_semi")
    parts = localities.select("locality_id", "site_id", "code").join(sites.select("site_id", F.col("code").alias("_site")), "site_id")
    parts = parts.groupBy(code_part(F.col("_site")).alias("_s"), code_part(F.col("code")).alias("_c")).agg(F.count("*").alias("n"))
    named = corrections.join(objects.filter(has_text(F.col("species"))).select("object_id"), "object_id", "left_semi")
    blank = F.broadcast(batches.filter("code = ''").select("batch_id"))
    label = pair("image_id", "mask_key")
    return report(
        finding("batch has a code", used.filter("code = ''"), used, F.col("label")),
        finding("no batch is called M", batches.filter(F.upper("code") == DRAWN_BATCH_CODE), batches, F.col("label")),
        finding("localities stay apart", parts.filter("n > 1"), parts, pair("_s", "_c")),
        finding("slide can be numbered", slides.filter("sample_id IS NULL"), slides, F.col("slug")),
        finding("named object has a batch", named.filter("batch_id IS NULL AND source <> 'manual'"), named, label),
        finding("named object's batch has a code", named.join(blank, "batch_id", "left_semi"), named, label),
    )


def check_grade_pose(objects: DataFrame, classes: DataFrame, corrections: DataFrame) -> DataFrame:
    given = objects.filter(has_text(F.col("grade")) | has_text(F.col("pose")))
    loose = F.broadcast(classes.filter("NOT counted").select(F.col("class_key").alias("label")))
    alive = corrections.filter("NOT removed").select("object_id")
    best = objects.filter("grade = 'A'")
    return report(
        finding("no grade or pose on fragments", given.join(loose, "label", "left_semi"), given, F.col("object_id")),
        finding("no grade or pose on removed objects", given.join(alive, "object_id", "left_anti"), given, F.col("object_id")),
        finding("grade A has a species", best.filter("species = ''"), best, F.col("object_id")),
    )


def check_atlas(entries: DataFrame, placements: DataFrame, classes: DataFrame, objects: DataFrame) -> DataFrame:
    taxa = classes.filter("is_taxon")
    said = objects.filter("species <> ''").select("species").distinct()
    keys = ["atlas_key", "binomial"]
    return report(
        finding("entry has a placement", entries.join(placements.select(*keys), keys, "left_anti"), entries, pair(*keys)),
        finding("placement has a page", placements.filter("page IS NULL"), placements, pair(*keys)),
        finding("taxon class is in an index", taxa.join(entries.select(F.col("genus").alias("class_key")), "class_key", "left_anti"), taxa, F.col("class_key")),
        finding("species is in an index", said.join(entries.select(F.col("binomial").alias("species")), "species", "left_anti"), said, F.col("species")),
    )


def check_image_links(images: DataFrame, detections: DataFrame, corrections: DataFrame) -> DataFrame:
    i = images.select("image_id", F.col("path").alias("_path"), F.col("viewpoint_id").alias("_home"))
    d = detections.join(i, "image_id", "left")
    r = corrections.join(i, "image_id", "left")
    twice = corrections.groupBy("image_id", "batch_id", "mask_key").agg(F.count("*").alias("n")).filter("n > 1")
    return report(
        finding("detection has an image", d.filter("_path IS NULL"), detections, F.col("detection_id")),
        finding("paths agree", d.filter("_path <> image_path"), detections, F.col("detection_id")),
        finding("correction has an image", r.filter("_path IS NULL"), corrections, pair("image_id", "mask_key")),
        finding("correction's viewpoint is its image's", r.filter("_home <> viewpoint_id"), corrections, pair("image_id", "mask_key")),
        finding("correction key is unique", twice, corrections, pair("image_id", "mask_key")),
    )
