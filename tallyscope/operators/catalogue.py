"""The object catalogue: numbers, filters, validation of what people enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.naming import DRAWN_KEY, catalog_no
from tallyscope.functions.polygon import polygon_bbox
from tallyscope.operators.overlay import has_text
from tallyscope.operators.review import link_mains

# Accepted grades and poses, and the limits of a drawn polygon.
GRADES, POSES = ["A", "B", "C"], ["valve", "girdle", "other"]
MIN_POINTS, MAX_POINTS = 3, 400


def slide_layers(slides: DataFrame, samples: DataFrame, localities: DataFrame, sites: DataFrame) -> DataFrame:
    """Site, locality and sample codes of every slide; null codes where a slide has no sample."""
    place = localities.select("locality_id", "site_id", F.col("code").alias("locality_code")).join(
        sites.select("site_id", F.col("code").alias("site_code")), "site_id"
    )
    s = samples.select("sample_id", F.col("code").alias("sample_code"), "locality_id").join(place.drop("site_id"), "locality_id").drop("locality_id")
    return slides.select("slide_id", "sample_id", "obs_no").join(s, "sample_id", "left").drop("sample_id")


def catalogued(detections: DataFrame, viewpoints: DataFrame, batches: DataFrame) -> DataFrame:
    """The detections whose objects the catalogue lists, with what numbers need of batch and viewpoint."""
    batch = F.broadcast(batches.select("batch_id", F.col("code").alias("batch_code")))
    return detections.select("detection_id", "batch_id", "frame_no", "viewpoint_id", "slide_id").join(batch, "batch_id").join(viewpoints.select("viewpoint_id", "idx"), "viewpoint_id").drop("viewpoint_id", "batch_id")


def catalog_rows(shown: DataFrame, layers: DataFrame, viewpoints: DataFrame, batches: DataFrame, detections: DataFrame, members: DataFrame) -> DataFrame:
    """Kept objects with their catalogue number, identification, and the largest linked view where they are linked.

    ``shown`` holds rows of the overlay; detections carry ``frame_no``, the number of the frame in its viewpoint, and the
    viewpoint and slide that the overlay took from them; ``members`` all judgements with object_id, image_id, mask_key, bbox.
    """
    # Everything that follows from the detection meets there; the rows are shuffled once to fetch it.
    place = catalogued(detections, viewpoints, batches).join(layers, "slide_id", "left").drop("slide_id")
    drawn = F.col("source") == "manual"
    numbered = (
        shown.join(place, "detection_id")
        .withColumn(
            "_no",
            catalog_no(
                F.col("site_code"), F.col("locality_code"), F.col("sample_code"), F.col("idx"), F.col("mask_key"), F.col("obs_no"),
                F.when(F.col("image_kind") != "stack", F.col("frame_no")), F.col("batch_code"), F.coalesce(drawn, F.lit(False)),
            ),
        )
    )
    mains = link_mains(members).select("object_id", "n_members", "main_image")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("species", "grade", "pose", "note")]
    return numbered.join(mains, "object_id", "left").select(
        "slide_id", "viewpoint_id", "image_id", "mask_key", "cls", "area_px", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "cls_user", "revived", "orphan",
        F.col("_no.number").alias("catalog_no"), F.col("_no.why").alias("catalog_why"), *text,
        F.coalesce("n_members", F.lit(0)).cast("bigint").alias("linked_n"),
        F.when(F.col("main_image") != F.col("image_id"), F.col("main_image")).alias("view_image"),
    )


CATALOG_ORDER = ["slide_id", "viewpoint_id", "bbox_y", "bbox_x", "mask_key"]


def is_fragment(classes: DataFrame) -> DataFrame:
    """Class keys that are not counted."""
    return classes.filter("NOT counted").select(F.col("class_key").alias("cls"))


def catalog_filter(rows: DataFrame, classes: DataFrame, only: str = "", text: str = "", fragments: bool = False) -> DataFrame:
    """Rows by kind (a class key, or manual, labelled, noted, named, unnamed) and free text; fragments hidden unless asked."""
    kinds = {
        "manual": F.col("revived"),
        "labelled": F.col("cls_user"),
        "noted": has_text(F.col("note")),
        "named": has_text(F.col("species")),
        "unnamed": ~has_text(F.col("species")),
    }
    out = rows if fragments else rows.join(F.broadcast(is_fragment(classes)), "cls", "left_anti")
    if only:
        out = out.filter(kinds.get(only, F.col("cls") == only))
    if text:
        hay = F.lower(F.concat_ws("\n", F.coalesce("catalog_no", F.lit("")), "species", "note"))
        out = out.filter(hay.contains(text.lower()))
    return out


def catalog_done(rows: DataFrame) -> Column:
    """Identified completely: species, grade and pose are all given."""
    return has_text(F.col("species")) & has_text(F.col("grade")) & has_text(F.col("pose"))


def crops_filter(rows: DataFrame, only: str = "") -> DataFrame:
    kinds = {"manual": F.col("revived"), "labelled": F.col("cls_user"), "noted": has_text(F.col("note"))}
    out = rows.filter(kinds.get(only, F.col("cls") == only)) if only else rows
    return out.orderBy(F.greatest("bbox_w", "bbox_h").desc(), "slide_id", "image_id", "mask_key")


def manual_key_valid(key: Column) -> Column:
    return F.coalesce(key.rlike(DRAWN_KEY), F.lit(False))


def polygon_problem(poly: Column, width: Column, height: Column) -> Column:
    """'' for a polygon that may be stored, else what is wrong with it."""
    points = F.floor(F.coalesce(F.size(poly), F.lit(0)) / 2)
    box = polygon_bbox(poly)
    outside = (box["x"] < 0) | (box["y"] < 0) | (box["x"] + box["w"] > width) | (box["y"] + box["h"] > height)
    return (
        F.when(~points.between(MIN_POINTS, MAX_POINTS), "points")
        .when(~F.forall(poly, lambda v: v.isNotNull() & ~F.isnan(v)), "number")
        .when(outside, "outside")
        .otherwise("")
    )


def grade_pose_rules(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """Objects whose grade or pose is not a known one, or may not be given to their class."""
    known = classes.select(F.col("class_key").alias("label"), "counted")
    given = has_text(F.col("grade")) | has_text(F.col("pose"))
    why = (
        F.when(has_text(F.col("grade")) & ~F.col("grade").isin(GRADES), "unknown grade")
        .when(has_text(F.col("pose")) & ~F.col("pose").isin(POSES), "unknown pose")
        .when(given & has_text(F.col("label")) & F.col("counted").isNull(), "unknown class")
        .when(given & ~F.coalesce("counted", F.lit(True)), "not for this class")
    )
    return (
        objects.join(F.broadcast(known), "label", "left").withColumn("why", why).filter(F.col("why").isNotNull()).select("object_id", "label", "grade", "pose", "why")
    )
