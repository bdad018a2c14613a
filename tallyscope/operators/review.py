"""Joins between detections, corrections and the objects people made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.boxes import Box, bbox_iou, key_to_bbox
from tallyscope.operators.greedy import greedy_matching
from tallyscope.operators.overlay import has_text, reviewing
from tallyscope.operators.spatial import DEFAULT_MAX_SIDE, centre_in_box, touching

# Fixed value: two boxes are the same thing from this overlap on.
SAME_IOU = 0.5


def shown_images(overlay: DataFrame) -> DataFrame:
    """Rows of the fused image where the viewpoint has a detection on it, else of every frame. The detections that have
    rows may stand for the rows: what is laid over the ones that stay is shown."""
    fused = overlay.groupBy("viewpoint_id").agg(F.max(F.col("image_kind") == "stack").alias("_fused"))
    return overlay.join(fused, "viewpoint_id").filter((F.col("image_kind") == "stack") | ~F.col("_fused")).drop("_fused")


def mask_class(label: Column, passed: Column, cls: Column) -> Column:
    """Class used to colour a mask: a person's, else ``manual`` for a revived one, else the machine's or ``none``."""
    return F.when(has_text(label), label).when(~passed, "manual").otherwise(F.when(has_text(cls), cls).otherwise("none"))


def rebind_reviews(
    corrections: DataFrame, candidates: DataFrame, iou_min: float = SAME_IOU, max_side: int = DEFAULT_MAX_SIDE
) -> DataFrame:
    """Attach corrections to the candidates of a new detection of the same image and batch.

    Both sides carry image_id, batch_id, mask_key and bbox; corrections also ``bind`` and may lack a box (it is then read
    from the key). Hand-bound corrections and those without a batch stay as they are; equal keys bind first; the rest
    pair up one to one by falling IoU; what is left is an orphan without a score.
    """
    ids = ["image_id", "batch_id"]
    from_key = key_to_bbox(F.col("mask_key"))
    r = corrections.withColumns(
        {"r_" + s: F.coalesce(F.col("bbox_" + s), from_key[i]) for i, s in enumerate("xywh")}
    ).withColumnRenamed("mask_key", "review_key")
    c = candidates.select(*ids, F.col("mask_key").alias("candidate_key"), *[F.col("bbox_" + s).alias("c_" + s) for s in "xywh"])
    mine = r.filter((F.col("bind") != "manual") & F.col("batch_id").isNotNull())
    kept = r.join(mine.select(*ids, "review_key"), [*ids, "review_key"], "left_anti").select(
        *ids, "review_key", F.lit(None).cast("string").alias("candidate_key"), F.lit("manual").alias("method"), F.lit(None).cast("double").alias("score")
    )
    exact = mine.join(c, (mine.image_id == c.image_id) & (mine.batch_id == c.batch_id) & (mine.review_key == c.candidate_key))
    exact = exact.select(mine.image_id, mine.batch_id, "review_key", "candidate_key", F.lit("exact").alias("method"), F.lit(1.0).alias("score"))
    open_r = mine.join(c.select(*ids, F.col("candidate_key").alias("review_key")), [*ids, "review_key"], "left_anti")
    free_c = c.join(mine.select(*ids, F.col("review_key").alias("candidate_key")), [*ids, "candidate_key"], "left_anti")
    a, b = Box.of("r_"), Box.of("c_")
    # From half the union on, the centre of one box lies in the other and sides differ by two at most; below that only
    # the touch of the boxes is sure.
    search = centre_in_box if iou_min >= 0.5 else touching
    near = search(open_r.select(*ids, "review_key", *a), free_c, ids, a, b, max_side)
    edges = near.withColumn("order", -bbox_iou(a, b)).filter(F.col("order") <= -iou_min)
    taken = greedy_matching(edges, ids, "review_key", "candidate_key", ["order"]).select(
        *ids, "review_key", "candidate_key", F.lit("iou").alias("method"), (-F.col("order")).alias("score")
    )
    orphans = open_r.join(taken, [*ids, "review_key"], "left_anti").select(
        *ids, "review_key", F.lit(None).cast("string").alias("candidate_key"), F.lit("orphan").alias("method"), F.lit(None).cast("double").alias("score")
    )
    return exact.unionByName(taken).unionByName(orphans).unionByName(kept)


def neighbor_box_links(
    boxes: DataFrame, order: str, max_side: int = DEFAULT_MAX_SIDE, windows: tuple[float, float] = (1.5, 2.0)
) -> DataFrame:
    """Each box against those of the next image of its viewpoint.

    ``boxes``: viewpoint_id, image_id, ``order`` (place of the image), box_no, bbox_*. Counts the boxes whose centre lies
    in the window around this one, enlarged 1.5 and 2 times, and gives the best overlap and its lead over the second.
    """
    images = boxes.groupBy("viewpoint_id", "image_id").agg(F.min(order).alias("_o"))
    # One row per image: the next image of the viewpoint, by a join on rank rather than on all pairs.
    from tallyscope.operators.sequence import Blocks, ranges

    nxt = Blocks(["viewpoint_id"], [ranges("_o")], ["_o", "image_id"]).following(images, {"image_id": "next_image"})
    nxt = nxt.filter(F.col("next_image").isNotNull()).select("viewpoint_id", "image_id", "next_image")
    a = boxes.join(nxt, ["viewpoint_id", "image_id"]).select(
        "viewpoint_id", "image_id", "next_image", "box_no", *[F.col("bbox_" + s).alias("a_" + s) for s in "xywh"]
    )
    b = boxes.select(F.col("image_id").alias("next_image"), F.col("box_no").alias("b_no"), *[F.col("bbox_" + s).alias("b_" + s) for s in "xywh"])
    ab, bb = Box.of("a_"), Box.of("b_")
    cx, cy = bb.centre

    def inside(k: float) -> Column:
        w = ab.grown(k)
        return (cx >= w.x) & (cx <= w.x + w.w) & (cy >= w.y) & (cy <= w.y + w.h)

    near = touching(a, b, ["next_image"], ab.grown(max(windows)), bb, max_side)
    iou = bbox_iou(ab, bb)
    # The two best overlaps come from mergeable aggregates: the maximum, and the maximum among the others.
    best = near.groupBy("image_id", "box_no").agg(
        F.count_if(inside(windows[0])).alias("n_near"),
        F.count_if(inside(windows[1])).alias("n_wide"),
        F.max(F.struct(iou.alias("iou"), F.col("b_no"))).alias("_best"),
    )
    second = (
        near.select("image_id", "box_no", "b_no", iou.alias("_iou"))
        .join(best.select("image_id", "box_no", F.col("_best.b_no").alias("_first")), ["image_id", "box_no"])
        .filter(F.col("b_no") != F.col("_first"))
        .groupBy("image_id", "box_no")
        .agg(F.max("_iou").alias("_second"))
    )
    zero = F.lit(0.0)
    return (
        a.select("image_id", "box_no")
        .join(best, ["image_id", "box_no"], "left")
        .join(second, ["image_id", "box_no"], "left")
        .select(
            "image_id",
            "box_no",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.coalesce("n_wide", F.lit(0)).cast("bigint").alias("n_wide"),
            F.coalesce("_best.iou", zero).alias("best_iou"),
            F.when(F.col("_best.iou") > 0, F.col("_best.iou") - F.coalesce("_second", zero)).alias("margin"),
        )
    )


def coverage_gap(viewpoints: DataFrame, detections: DataFrame, batches: DataFrame) -> DataFrame:
    """Viewpoints without a detection of the batch under review, and the labels of batches that do cover them."""
    covered = reviewing(detections, batches).select("viewpoint_id")
    missing = viewpoints.join(covered, "viewpoint_id", "left_anti").select("viewpoint_id", "slide_id")
    others = (
        detections.filter("is_current")
        .select("viewpoint_id", "batch_id")
        .join(batches.filter("NOT for_review").select("batch_id", "label"), "batch_id")
        .groupBy("viewpoint_id")
        .agg(F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("elsewhere"))
    )
    return missing.join(others, "viewpoint_id", "left").withColumn("elsewhere", F.coalesce("elsewhere", F.lit("")))


def link_mains(members: DataFrame) -> DataFrame:
    """Objects with two members or more: the member with the largest box, and how many there are."""
    area = F.col("bbox_w") * F.col("bbox_h")
    rank = F.struct(area.alias("a"), F.negative("image_id").alias("i"), F.col("mask_key"))
    return (
        members.groupBy("object_id")
        .agg(
            F.count("*").alias("n_members"),
            F.max_by(F.struct("image_id", "mask_key"), rank).alias("_m"),
            F.max(area).cast("bigint").alias("box_area"),
        )
        .filter("n_members >= 2")
        .select("object_id", "n_members", F.col("_m.image_id").alias("main_image"), F.col("_m.mask_key").alias("main_key"), "box_area")
    )


def linked_siblings(members: DataFrame) -> DataFrame:
    """Members of objects that stand on several images, with how many members the other images hold.

    The siblings of a row are the other rows of its object, so they are given once each and not once per pair.
    """
    per_image = members.groupBy("object_id", "image_id").agg(F.count("*").alias("_here"))
    total = per_image.groupBy("object_id").agg(F.sum("_here").alias("_all"), F.count("*").alias("n_images")).filter("n_images > 1")
    return (
        members.select("object_id", "image_id", "mask_key")
        .join(per_image, ["object_id", "image_id"])
        .join(total, "object_id")
        .select("object_id", "image_id", "mask_key", (F.col("_all") - F.col("_here")).alias("n_elsewhere"), "n_images")
    )


def spread_drawn(drawn: DataFrame, detections: DataFrame) -> DataFrame:
    """Place every drawn mask on each other image of its viewpoint that has a current detection.

    ``is_rep`` tells which placement (or the original) represents the object: the fused image if there is one, else the
    image it was drawn on.
    """
    images = detections.filter("is_current").select("viewpoint_id", "image_id", "image_kind").distinct()
    home = drawn.select("viewpoint_id", F.col("image_id").alias("_home"), "mask_key", "object_id")
    at_home = home.select("viewpoint_id", F.col("_home").alias("image_id"), "mask_key", "object_id").withColumn("is_home", F.lit(True))
    away = home.join(images, "viewpoint_id").filter(F.col("image_id") != F.col("_home"))
    away = away.select("viewpoint_id", "image_id", "mask_key", "object_id", F.lit(False).alias("is_home"))
    kinds = detections.groupBy("image_id").agg(F.min("image_kind").alias("image_kind"))
    both = at_home.unionByName(away).join(kinds, "image_id")
    fused = images.groupBy("viewpoint_id").agg(F.min(F.when(F.col("image_kind") == "stack", F.col("image_id"))).alias("_fused"))
    return both.join(fused, "viewpoint_id", "left").select(
        "viewpoint_id",
        "image_id",
        "mask_key",
        "object_id",
        "is_home",
        F.when(F.col("_fused").isNotNull(), F.col("image_id") == F.col("_fused")).otherwise(F.col("is_home")).alias("is_rep"),
    )


def sibling_sample(slides: DataFrame) -> DataFrame:
    """Slides without a sample take that of the lowest-numbered sibling with the same base name."""
    rank = F.struct("obs_no", "slide_id")
    donors = (
        slides.filter(F.col("sample_id").isNotNull())
        .groupBy("base_name")
        .agg(F.min_by("sample_id", rank).alias("_sample"), F.min_by("slide_id", rank).alias("_from"))
    )
    inherits = F.col("sample_id").isNull()
    return slides.join(donors, "base_name", "left").select(
        "slide_id",
        F.coalesce("sample_id", "_sample").alias("sample_id"),
        F.when(inherits, F.col("_from")).alias("taken_from"),
    )


def resolve_stem(stems: DataFrame, viewpoints: DataFrame, frames: DataFrame) -> DataFrame:
    """Image name to viewpoint: ``..._focused`` goes by tag, others by frame name; none or several means no answer."""
    by_tag = viewpoints.select(F.concat("tag", F.lit("_focused")).alias("stem"), "viewpoint_id")
    by_frame = frames.select(F.col("name").alias("stem"), "viewpoint_id")
    hits = by_tag.unionByName(by_frame).groupBy("stem").agg(F.count_distinct("viewpoint_id").alias("n"), F.min("viewpoint_id").alias("_v"))
    n = F.coalesce("n", F.lit(0))
    return stems.join(hits, "stem", "left").select(
        "stem",
        F.when(n == 1, F.col("_v")).alias("viewpoint_id"),
        n.cast("bigint").alias("n_found"),
        F.when(n == 1, "").when(n == 0, "unknown").otherwise("ambiguous").alias("refused"),
    )


def review_blocked(slides: DataFrame) -> DataFrame:
    why = (
        F.when(F.col("state") == "pending", "waiting for detection")
        .when(F.col("state") == "processing", "detection is running")
        .when(F.col("state") == "failed", "detection failed")
    )
    return slides.withColumn("why", why).filter(F.col("why").isNotNull()).select("slide_id", "slug", "state", "why")


def latest_per_image(detections: DataFrame, keys: list[str]) -> DataFrame:
    """The newest detection of every key (batch and image, say), without a window."""
    cols = [c for c in detections.columns if c not in keys]
    rank = F.struct("created_at", "detection_id")
    return detections.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("_d")).select(*keys, *[F.col(f"_d.{c}").alias(c) for c in cols])


def carry_scale(frames: DataFrame, group: list[str], resize: float, tolerance: float = 0.001) -> DataFrame:
    """Scale of a fused image: the first frame's over the resize factor; flagged when members differ too much."""
    g = frames.groupBy(*group).agg(
        F.min_by("um_per_pixel", "seq").alias("_first"),
        F.max("um_per_pixel").alias("_hi"),
        F.min("um_per_pixel").alias("_lo"),
        F.count("*").alias("n_frames"),
    )
    off = F.greatest(F.abs(F.col("_hi") - F.col("_first")), F.abs(F.col("_lo") - F.col("_first")))
    return g.select(*group, "n_frames", (F.col("_first") / resize).alias("um_per_pixel"), (off > F.col("_first") * tolerance).alias("mixed"))


def map_points(sites: DataFrame, localities: DataFrame, slides: DataFrame, approx: DataFrame, project) -> DataFrame:
    """Sites that have visible slides: own coordinates, else approximate ones by the code without its digits."""
    shown = slides.filter("NOT hide_in_list").groupBy("locality_id").agg(F.count("*").alias("_n"))
    per_site = (
        localities.join(shown, "locality_id")
        .groupBy("site_id")
        .agg(
            F.sum("_n").alias("n_slides"),
            F.avg("lat").alias("_lat"),
            F.avg("lon").alias("_lon"),
            F.concat_ws(",", F.array_sort(F.collect_set("code"))).alias("cores"),
        )
    )
    rough = approx.select(F.col("code").alias("_base"), F.col("lat").alias("_alat"), F.col("lon").alias("_alon"))
    base = F.upper(F.regexp_replace("code", r"[0-9]+$", ""))
    out = sites.join(per_site, "site_id").withColumn("_base", base).join(F.broadcast(rough), "_base", "left")
    exact = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    out = out.withColumn("lat", F.when(exact, F.col("_lat")).otherwise(F.col("_alat"))).withColumn(
        "lon", F.when(exact, F.col("_lon")).otherwise(F.col("_alon"))
    )
    x, y = project(F.col("lat"), F.col("lon"))
    return out.filter(F.col("lat").isNotNull()).select("site_id", "code", x.alias("x"), y.alias("y"), exact.alias("exact"), "n_slides", "cores")
