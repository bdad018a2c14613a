"""Human corrections laid over machine verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.polygon import polygon_area
from tallyscope.operators.sequence import Blocks
from tallyscope.operators.verdict import guessed_class
from tallyscope.session import cut

# Tuning: rows of one detection that a task numbers by itself.
LARGE = 1_000_000


def reviewing(detections: DataFrame, batches: DataFrame) -> DataFrame:
    """Current detections of the batch under review. ``batches`` is a small dimension."""
    under = batches.filter("for_review").select("batch_id")
    return detections.filter("is_current").join(under, "batch_id", "left_semi")


def representative_detection(detections: DataFrame) -> DataFrame:
    """One detection per viewpoint: the fused image first, then the lowest id."""
    rank = F.struct((F.col("image_kind") != "stack").alias("k"), F.col("detection_id").alias("d"))
    cols = [c for c in detections.columns if c != "viewpoint_id"]
    picked = detections.groupBy("viewpoint_id").agg(F.min_by(F.struct(*cols), rank).alias("_r"))
    return picked.select("viewpoint_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def has_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def kept_rule(passed: Column, removed: Column, accepted: Column, list_rule: bool = False) -> Column:
    """Whether a candidate stays. Removal wins; ``list_rule`` lets acceptance of a reject win, as the list query does."""
    gone, back = F.coalesce(removed, F.lit(False)), F.coalesce(accepted, F.lit(False))
    if list_rule:
        return (passed & ~gone) | (~passed & back)
    return ~gone & (passed | back)


def overlaid(candidates: DataFrame, detections: DataFrame, corrections: DataFrame) -> DataFrame:
    """The detections that :func:`review_overlay` has rows for, found by their keys alone."""
    said = corrections.select("image_id", F.col("batch_id").alias("_said")).distinct()
    spoken = said.join(detections.select("detection_id", "image_id", "batch_id"), "image_id").filter(F.col("_said").isNull() | (F.col("_said") == F.col("batch_id")))
    seen = candidates.select("detection_id").distinct().unionByName(spoken.select("detection_id"))
    return detections.join(seen, "detection_id", "left_semi")


def review_overlay(
    candidates: DataFrame, detections: DataFrame, corrections: DataFrame, objects: DataFrame, gone_only: bool = False
) -> DataFrame:
    """One row per candidate or orphan correction of the given detections.

    ``state`` is kept, gone or rejected; ``cls`` is the class to show, ``cls_auto`` the machine's where a person changed
    it; ``rank`` numbers the kept ones of a detection by falling area. With ``gone_only`` the rows of that state alone:
    they follow from the removing corrections.
    """
    if gone_only:
        corrections = corrections.filter("removed")
    # Both sides bring the columns of their detection: what the full join makes is not shuffled again to fetch them.
    about = ["viewpoint_id", "image_id", "image_kind", "um_per_pixel", "slide_id"]
    det = detections.select("detection_id", *[F.col(n).alias("_d_" + n) for n in about])
    spoken = detections.select("detection_id", F.col("batch_id").alias("_batch"), *[F.col(n).alias("_r_" + n) for n in about])
    of_batch = F.col("batch_id").isNull() | (F.col("batch_id") == F.col("_batch"))
    # A person's outline is a flat list of coordinates as JSON text; only its area goes through the joins.
    # It is read once, in a step of its own: the area names it at every corner.
    drawn = corrections.withColumn("_corners", F.from_json("polygon", "array<double>")).drop("polygon")
    drawn = drawn.withColumn("_drawn_area", F.rint(polygon_area(F.col("_corners"))).cast("bigint")).drop("_corners")
    r = drawn.join(spoken, drawn["image_id"] == spoken["_r_image_id"]).filter(of_batch)
    r = r.join(objects.select("object_id", "label", "species", "grade", "pose", "note"), "object_id", "left").select(
        "detection_id",
        "mask_key",
        *["_r_" + n for n in about],
        F.lit(True).alias("has_review"),
        *["removed", "accepted", "source", "label", "species", "grade", "pose", "note", "object_id", "is_rep"],
        *["auto_confirmed", "geom_edited", "_drawn_area"],
        *[F.col("bbox_" + c).alias("r_" + c) for c in "xywh"],
    )
    c = candidates.select(
        "detection_id",
        "mask_key",
        "candidate_no",
        *["passed", "elongation", "area_px", "texture"],
        *["bbox_" + s for s in "xywh"],
        F.col("cls").alias("machine_cls"),
    ).join(det, "detection_id")
    both = c.join(r, ["detection_id", "mask_key"], "right" if gone_only else "full_outer")
    both = both.withColumns({n: F.coalesce("_d_" + n, "_r_" + n) for n in about}).drop(*[p + n for n in about for p in ("_d_", "_r_")])
    orphan = F.col("candidate_no").isNull()
    gone, back = F.coalesce("removed", F.lit(False)), F.coalesce("accepted", F.lit(False))
    from_person = orphan | (F.coalesce("geom_edited", F.lit(False)) & F.col("has_review"))
    # Without an outline the machine's area stands.
    drawn_area = F.coalesce("_drawn_area", "area_px")
    revived = ~orphan & ~F.col("passed") & back & ~gone
    base_cls = (
        F.when(orphan, "").when(revived, guessed_class(F.col("elongation"))).otherwise(F.coalesce("machine_cls", F.lit("")))
    )
    out = (
        both.withColumn(
            "state", F.when(gone, "gone").when(orphan | F.col("passed") | back, "kept").otherwise("rejected")
        )
        .withColumn("orphan", orphan)
        .withColumn("revived", F.coalesce(revived, F.lit(False)))
        .withColumn("area_px", F.when(from_person, drawn_area).otherwise(F.col("area_px")))
        .withColumns({"bbox_" + s: F.when(from_person, F.col("r_" + s)).otherwise(F.col("bbox_" + s)) for s in "xywh"})
        .withColumn("_base", base_cls)
        .withColumn("cls_user", has_text(F.col("label")) & (F.col("state") != "rejected"))
        .withColumn("cls", F.when(F.col("cls_user"), F.col("label")).otherwise(F.col("_base")))
        .withColumn("cls_auto", F.when(F.col("cls_user") & (F.col("_base") != F.col("label")), F.col("_base")).otherwise(""))
        .withColumn("area_px", F.coalesce("area_px", F.lit(0)))
    )
    return out.drop("_base", "machine_cls", "_drawn_area", *["r_" + s for s in "xywh"])


def ranked(overlay: DataFrame, out: str = "rank", large: int = LARGE) -> DataFrame:
    """Number the kept rows of each detection by falling area (0-based), ties by key.

    ``overlay`` is read twice, for the detections of more than ``large`` kept rows first: these alone are cut in blocks.
    """
    order = [(F.col("area_px"), False), (F.col("mask_key"), True)]
    by_area = Blocks(["detection_id"], [(F.col("area_px"), False)], order)
    kept = overlay.filter("state = 'kept'")
    hot = cut(kept.groupBy("detection_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > large).select("detection_id"))
    inside = Window.partitionBy("detection_id").orderBy(F.desc_nulls_last("area_px"), F.asc_nulls_last("mask_key"))
    if hot.isEmpty():
        return kept.withColumn(out, (F.row_number().over(inside) - 1).cast("bigint"))
    # There are fewer of these than rows by the factor of ``large``.
    few = F.broadcast(hot)
    rest = kept.join(few, "detection_id", "left_anti").withColumn(out, F.row_number().over(inside).cast("bigint"))
    return rest.unionByName(by_area.row_number(kept.join(few, "detection_id", "left_semi"), out)).withColumn(out, F.col(out) - 1)


def slide_class_summary(
    candidates: DataFrame,
    detections: DataFrame,
    viewpoints: DataFrame,
    corrections: DataFrame,
    objects: DataFrame,
    batches: DataFrame,
    list_rule: bool = False,
) -> DataFrame:
    """Kept, automatic and labelled objects per slide and effective class, over one image per viewpoint.

    Removal wins everywhere unless ``list_rule`` asks for the list query's reading: a reject both removed and accepted
    counts as kept, and drawn objects count even when removed.
    """
    rep = representative_detection(reviewing(detections, batches)).select(
        "detection_id", "image_id", "batch_id", "viewpoint_id"
    )
    rep = rep.join(viewpoints.select("viewpoint_id", "slide_id"), "viewpoint_id")
    r = (
        corrections.join(objects.select("object_id", "label"), "object_id", "left")
        .select("image_id", "batch_id", "mask_key", "source", "removed", "accepted", "label")
    )
    c = candidates.select("detection_id", "mask_key", "passed", "cls", "elongation").join(rep, "detection_id")
    on = [
        c["image_id"] == r["image_id"],
        c["mask_key"] == r["mask_key"],
        c["batch_id"].eqNullSafe(r["batch_id"]),
    ]
    j = c.join(r, on, "left").select(c["slide_id"], c["passed"], c["cls"], c["elongation"], "removed", "accepted", "label")
    kept = kept_rule(F.col("passed"), F.col("removed"), F.col("accepted"), list_rule)
    labelled = has_text(F.col("label"))
    eff = (
        F.when(labelled, F.col("label")).when(~F.col("passed"), guessed_class(F.col("elongation"))).otherwise(F.col("cls"))
    )
    engine = j.groupBy("slide_id", eff.alias("eff_cls")).agg(
        F.count_if(kept).alias("n_kept"),
        F.count_if("passed").alias("n_auto"),
        F.count_if(kept & labelled).alias("n_labeled"),
    )
    drawn_rows = r.filter(F.col("batch_id").isNull() & (F.col("source") == "manual"))
    if not list_rule:
        drawn_rows = drawn_rows.filter(~F.col("removed"))
    drawn = (
        drawn_rows.drop("batch_id").join(rep.select("image_id", "slide_id"), "image_id")
        .groupBy("slide_id", F.coalesce("label", F.lit("")).alias("eff_cls"))
        .agg(F.count("*").alias("n_kept"), F.lit(0).cast("bigint").alias("n_auto"), F.count_if(labelled).alias("n_labeled"))
    )
    return (
        engine.unionByName(drawn)
        .groupBy("slide_id", "eff_cls")
        .agg(*[F.sum(n).alias(n) for n in ("n_kept", "n_auto", "n_labeled")])
    )
