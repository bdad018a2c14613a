"""Counts and summaries by slide, locality, batch and class. All aggregates combine map-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.overlay import has_text, reviewing
from tallyscope.operators.review import latest_per_image



def upper_median(value: str):
    """``sorted[n // 2]`` of a column with a bounded set of values (pixels, millimetres).

    Counted from the top, the middle row is the upper of the two when their number is even.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def _left(base: DataFrame, parts: list[DataFrame], key: str, fill: dict | None = None) -> DataFrame:
    out = reduce(lambda a, b: a.join(b, key, "left"), parts, base)
    return out.fillna(0 if fill is None else fill)


def slide_summary(
    viewpoints: DataFrame,
    detections: DataFrame,
    batches: DataFrame,
    corrections: DataFrame,
    objects: DataFrame,
    viewpoint_reviews: DataFrame,
    class_counts: DataFrame,
    classes: DataFrame,
) -> DataFrame:
    """Everything the slide list shows. ``class_counts`` is the result of ``slide_class_summary``."""
    of_slide = viewpoints.select("viewpoint_id", "slide_id")
    base = viewpoints.groupBy("slide_id").agg(
        F.count("*").alias("n_groups"),
        F.sum("n_frames").alias("n_images"),
        F.count_if(F.col("n_frames") == 1).alias("singletons"),
        F.max("n_frames").alias("max_size"),
    )
    detected = (
        reviewing(detections, batches).select("viewpoint_id").join(of_slide, "viewpoint_id")
        .groupBy("slide_id").agg(F.count_distinct("viewpoint_id").alias("detected_groups"))
    )
    counted = F.coalesce("counted", F.lit(False))
    found = (
        class_counts.join(F.broadcast(classes.select(F.col("class_key").alias("eff_cls"), "counted")), "eff_cls", "left")
        .groupBy("slide_id")
        .agg(
            F.sum("n_kept").alias("n_detected"),
            F.sum("n_auto").alias("n_auto"),
            F.sum("n_labeled").alias("n_labeled"),
            F.sum(F.when(counted, F.col("n_kept")).otherwise(0)).alias("n_counted"),
        )
    )
    marks = corrections.select("viewpoint_id", "removed", "accepted").join(of_slide, "viewpoint_id").groupBy("slide_id").agg(
        F.count_if("removed").alias("n_removed"), F.count_if("accepted").alias("n_accepted")
    )
    noted = objects.filter("note <> ''").select("viewpoint_id").join(of_slide, "viewpoint_id").groupBy("slide_id").agg(F.count("*").alias("n_noted"))
    under = batches.filter("for_review").select("batch_id", "for_review")
    reviews = (
        viewpoint_reviews.join(F.broadcast(under), "batch_id", "left")
        .join(of_slide, "viewpoint_id")
        .groupBy("slide_id")
        .agg(
            F.count_if(F.expr("note <> ''")).alias("n_group_notes"),
            F.count_if(F.col("done") & F.coalesce("for_review", F.lit(False))).alias("reviewed_groups"),
        )
    )
    out = _left(base, [detected, found, marks, noted, reviews], "slide_id")
    per_view = F.when(F.col("detected_groups") > 0, F.col("detected_groups"))
    return (
        out.withColumn("mean_size", F.round(F.col("n_images") / F.col("n_groups"), 1))
        .withColumn("mean_detected", F.round(F.col("n_detected") / per_view, 1))
        .withColumn("mean_counted", F.round(F.col("n_counted") / per_view, 1))
    )


def scales_by_slide(frames: DataFrame) -> DataFrame:
    """Most frequent scale of each slide, to 9 decimals; the smaller wins a tie."""
    n = frames.groupBy("slide_id", F.round("um_per_pixel", 9).alias("um_per_pixel")).agg(F.count("*").alias("n"))
    return n.groupBy("slide_id").agg(
        F.max_by("um_per_pixel", F.struct("n", (-F.col("um_per_pixel")).alias("s"))).alias("um_per_pixel"), F.max("n").alias("n")
    )


def datasets(slides: DataFrame, localities: DataFrame, sites: DataFrame, scales: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per slide with its place, scale and counts, in the order of the list."""
    place = localities.select("locality_id", "site_id", F.col("code").alias("locality")).join(
        sites.select("site_id", F.col("code").alias("site"), "area"), "site_id"
    )
    placed = slides.withColumn("locality_id", F.when(F.col("sample_id").isNotNull(), F.col("locality_id"))).join(place, "locality_id", "left")
    return (
        placed.join(scales.select("slide_id", "um_per_pixel"), "slide_id", "left")
        .join(summary, "slide_id", "left")
        .select(
            "slide_id", "slug", "site", "locality", "area", "depth_cm", "obs_no", "hide_in_list", "exclude_from_totals", "um_per_pixel",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_images", "n_groups", "n_detected", "n_counted", "reviewed_groups")],
        )
    )


LIST_ORDER = ["site", "locality", "depth_cm", "obs_no", "slug"]


def list_order():
    return [F.col(c).asc_nulls_last() for c in LIST_ORDER]


TOTALS = ["n_images", "n_groups", "n_detected", "n_counted", "reviewed_groups"]


def _totals() -> list:
    used = ~F.col("exclude_from_totals")
    return [
        *[F.sum(F.when(used, F.col(c)).otherwise(0)).alias(c) for c in TOTALS],
        F.count_if(~used).alias("n_excluded"),
        F.count_if(used & F.col("hide_in_list")).alias("n_hidden_in"),
    ]


def datasets_total(rows: DataFrame) -> DataFrame:
    return rows.agg(*_totals())


def datasets_by_locality(rows: DataFrame) -> DataFrame:
    """Subtotals by (site, locality), by site, and overall; ``level`` is 0, 1, 3. Hidden slides stay in the sums."""
    place = rows.withColumn("site", F.coalesce("site", F.lit(""))).withColumn("locality", F.coalesce("locality", F.lit("")))
    return place.rollup("site", "locality").agg(
        F.grouping_id().cast("bigint").alias("level"), *_totals(), F.count_if(~F.col("hide_in_list")).alias("n_shown"), F.count_if("hide_in_list").alias("n_hidden")
    )


def area_tabs(rows: DataFrame) -> DataFrame:
    """Slides per area, with '' for those without a site, and over all (``level`` 1). ``rows`` carries ``area``."""
    return rows.select(F.coalesce("area", F.lit("")).alias("area")).rollup("area").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n_slides"))


def review_progress(slide_areas: DataFrame, viewpoints: DataFrame, viewpoint_reviews: DataFrame, corrections: DataFrame, batches: DataFrame) -> DataFrame:
    """Viewpoints, done ones, drawn objects and edited masks by area and slide, with totals (``level`` 0, 1, 3)."""
    done = viewpoint_reviews.filter("done").join(F.broadcast(batches.filter("for_review").select("batch_id")), "batch_id", "left_semi")
    done = done.groupBy("viewpoint_id").agg(F.count("*").alias("n_done"))
    edits = corrections.groupBy("viewpoint_id").agg(
        F.count_if(F.col("batch_id").isNull()).alias("n_drawn"), F.count_if("geom_edited").alias("n_edited")
    )
    v = _left(viewpoints.select("viewpoint_id", "slide_id"), [done, edits], "viewpoint_id")
    v = v.join(slide_areas, "slide_id", "left").withColumn("area", F.coalesce("area", F.lit("?")))
    return v.rollup("area", "slide_id").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count("*").alias("n_viewpoints"),
        *[F.sum(c).alias(c) for c in ("n_done", "n_drawn", "n_edited")],
    )


def current_thresholds(detections: DataFrame) -> DataFrame:
    """The threshold set most detections use; the lower id wins a tie."""
    n = detections.groupBy("threshold_set_id").agg(F.count("*").alias("n"))
    return n.agg(F.max_by("threshold_set_id", F.struct("n", (-F.col("threshold_set_id")).alias("i"))).alias("threshold_set_id"), F.max("n").alias("n"))


def threshold_spread(detections: DataFrame, key: str) -> DataFrame:
    return detections.groupBy(key).agg(F.count_distinct("threshold_set_id").alias("n_sets"))


def batch_choices(batches: DataFrame, detections: DataFrame, candidates: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """What each batch covers and leaves blank; batches without detections are left out."""
    current = detections.filter("is_current")
    cover = current.groupBy("batch_id").agg(F.count_distinct("viewpoint_id").alias("n_views"), F.count("*").alias("n_images"))
    passing = candidates.filter("passed").groupBy("detection_id").agg(F.count("*").alias("_n"))
    objects = current.select("detection_id", "batch_id").join(passing, "detection_id").groupBy("batch_id").agg(F.sum("_n").alias("n_objects"))
    total = viewpoints.agg(F.count("*")).scalar()
    out = batches.join(cover, "batch_id").join(objects, "batch_id", "left").fillna(0, ["n_objects"])
    return out.select("batch_id", "label", "for_review", "n_views", (total - F.col("n_views")).alias("n_blank"), "n_images", "n_objects")


def batches_for_viewpoint(detections: DataFrame, candidates: DataFrame, backends: DataFrame) -> DataFrame:
    """Per viewpoint and batch: the newest detection of each image, how many, and their passing objects."""
    latest = latest_per_image(detections.select("batch_id", "image_id", "detection_id", "viewpoint_id", "created_at"), ["batch_id", "image_id"])
    passing = candidates.groupBy("detection_id").agg(F.count_if("passed").alias("_n"))
    return (
        latest.join(passing, "detection_id", "left")
        .groupBy("viewpoint_id", "batch_id")
        .agg(F.count("*").alias("n_images"), F.sum(F.coalesce("_n", F.lit(0))).alias("n_objects"), F.max("detection_id").alias("last_detection"))
        .join(F.broadcast(backends), "batch_id")
    )


def engines(per_batch: DataFrame) -> DataFrame:
    """One row per viewpoint and engine: the batch under review, else the latest, stands for it."""
    rank = F.struct("for_review", "last_detection")
    return per_batch.groupBy("viewpoint_id", "backend").agg(
        F.max_by("batch_id", rank).alias("batch_id"), F.max_by("n_objects", rank).alias("n_objects"), F.count("*").alias("n_batches")
    )


def training_overview(done: DataFrame, kept: DataFrame) -> DataFrame:
    """Done viewpoints and kept objects per slide, with the share of the viewpoints in percent.

    ``done``: viewpoint_id, slide_id; ``kept``: one row per kept object with viewpoint_id.
    """
    n_obj = kept.groupBy("viewpoint_id").agg(F.count("*").alias("_n"))
    total = done.agg(F.count("*")).scalar()
    per = done.join(n_obj, "viewpoint_id", "left").groupBy("slide_id").agg(F.count("*").alias("n_viewpoints"), F.sum(F.coalesce("_n", F.lit(0))).alias("n_objects"))
    return per.withColumn("share", F.round(F.col("n_viewpoints") / total * 100, 2))


def layer_overview(sites: DataFrame, localities: DataFrame, samples: DataFrame, slides: DataFrame) -> DataFrame:
    """Localities, samples and slides of every site."""
    n_slides = slides.filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.count("*").alias("_sl"))
    per_loc = samples.join(n_slides, "sample_id", "left").groupBy("locality_id").agg(F.count("*").alias("_sm"), F.sum(F.coalesce("_sl", F.lit(0))).alias("_sl"))
    per_site = localities.join(per_loc, "locality_id", "left").groupBy("site_id").agg(
        F.count("*").alias("n_localities"), F.sum(F.coalesce("_sm", F.lit(0))).alias("n_samples"), F.sum(F.coalesce("_sl", F.lit(0))).alias("n_slides")
    )
    return _left(sites.select("site_id", "code", "area"), [per_site], "site_id")


def detection_size_stats(objects: DataFrame, key: str, size: str) -> DataFrame:
    return objects.groupBy(key).agg(
        F.count("*").alias("n"),
        F.min(size).alias("smallest"),
        upper_median(size).alias("median"),
        F.max(size).alias("largest"),
        F.round(F.avg(size), 1).alias("mean"),
    )


def derived_depth_series(rows: DataFrame, per_class: DataFrame) -> DataFrame:
    """Counts by depth in millimetres: all counted objects, per viewpoint, and per counted class (long form)."""
    used = rows.filter(F.col("depth_cm").isNotNull() & ~F.col("exclude_from_totals")).withColumn("depth_mm", F.round(F.col("depth_cm") * 10).cast("int"))
    per = used.groupBy("depth_mm").agg(F.sum("n_counted").alias("_c"), F.sum("n_groups").alias("_g"))
    long = per.select(
        "depth_mm",
        F.expr("stack(2, 'counted', CAST(_c AS DOUBLE), 'per_view', CASE WHEN _g > 0 THEN round(_c / _g, 3) END) AS (series, value)"),
    ).filter("value IS NOT NULL")
    by_class = per_class.join(used.select("slide_id", "depth_mm"), "slide_id").groupBy("depth_mm", F.col("eff_cls").alias("series")).agg(
        F.sum("n_kept").cast("double").alias("value")
    )
    return long.unionByName(by_class)


def run_groups(runs: DataFrame, detections: DataFrame, batches: DataFrame) -> DataFrame:
    """Loose runs that left detections, grouped by kind, engine and day, with a label for the batch they would make."""
    backend = F.coalesce("backend", F.lit("-"))
    day = F.date_format("started_at", "yyyy-MM-dd")
    has = detections.select("run_id").distinct()
    shown = reviewing(detections, batches).select("run_id").distinct().withColumn("_cur", F.lit(True))
    loose = runs.filter(F.col("batch_id").isNull()).join(has, "run_id", "left_semi").join(shown, "run_id", "left")
    return (
        loose.groupBy("kind", backend.alias("backend"), day.alias("day"))
        .agg(F.count("*").alias("n_runs"), F.count_if(F.col("_cur").isNotNull()).alias("n_current"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))
        .withColumn("label", F.concat_ws("-", F.when(F.col("backend") == "-", F.col("kind")).otherwise(F.col("backend")), "day"))
    )


def run_ranges(specs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``58-64,70`` to run numbers, each once per row of ``specs``."""
    part = F.trim(F.col("_p"))
    lo = F.split_part(part, F.lit("-"), F.lit(1)).cast("bigint")
    hi = F.when(part.contains("-"), F.split_part(part, F.lit("-"), F.lit(2)).cast("bigint")).otherwise(lo)
    return (
        specs.withColumn("_p", F.explode(F.split(text, ",")))
        .filter(part != "")
        .withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .filter("_lo <= _hi")
        .select(*keep, F.explode(F.sequence("_lo", "_hi")).alias("run_id"))
        .distinct()
    )


def done_viewpoints(viewpoint_reviews: DataFrame, batches: DataFrame) -> DataFrame:
    under = batches.filter("for_review").select("batch_id")
    return viewpoint_reviews.filter("done").join(F.broadcast(under), "batch_id", "left_semi").select("viewpoint_id").distinct()


def review_state(viewpoint_reviews: DataFrame, batches: DataFrame) -> DataFrame:
    """(done, comment) of each viewpoint: the done flag of the batch under review, the comment of the row without one."""
    under = batches.filter("for_review").select("batch_id", F.lit(True).alias("_u"))
    return (
        viewpoint_reviews.join(F.broadcast(under), "batch_id", "left")
        .groupBy("viewpoint_id")
        .agg(
            F.coalesce(F.max(F.when(F.col("_u"), F.col("done"))), F.lit(False)).alias("done"),
            F.coalesce(F.max(F.when(F.col("batch_id").isNull(), F.col("note"))), F.lit("")).alias("comment"),
        )
    )


def recent_runs(runs: DataFrame, n: int = 12) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n)


def busy_slides(slides: DataFrame, frames: DataFrame, viewpoints: DataFrame, detections: DataFrame, runs: DataFrame) -> DataFrame:
    """Slides that are not done, how far they are, and whether they look stalled (nothing is running)."""
    n_frames = frames.groupBy("slide_id").agg(F.count("*").alias("n_frames"))
    current = detections.filter("is_current").groupBy("viewpoint_id").agg(F.max(F.col("image_kind") == "stack").alias("_s"))
    views = viewpoints.join(current, "viewpoint_id", "left").groupBy("slide_id").agg(
        F.count("*").alias("n_viewpoints"), F.count_if(F.coalesce("_s", F.lit(False))).alias("n_fused"), F.count_if(F.col("_s").isNotNull()).alias("n_detected_views")
    )
    running = runs.filter("status = 'running'").agg(F.count("*")).scalar()
    out = _left(slides.filter("state <> 'done'").select("slide_id", "slug", "state"), [n_frames, views], "slide_id")
    return out.withColumn("stalled", running == 0)


def health_counts(tables: dict[str, DataFrame], newest: DataFrame, now: str, max_age_h: float) -> DataFrame:
    """Row counts of the main tables, hours since the newest snapshot, and the verdict on both."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in tables.items()])
    age = newest.agg((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("stamp"))) / 3600.0).scalar()
    bad = F.col("age_h").isNull() | (F.col("age_h") > max_age_h)
    return counts.withColumn("age_h", F.round(age, 1)).withColumn(
        "status", F.when((F.col("table_name") == "slide") & (F.col("n") == 0), "unhealthy").when(bad, "degraded").otherwise("ok")
    )


def species_seen(objects: DataFrame) -> DataFrame:
    return objects.filter(has_text(F.col("species"))).select("species").distinct().orderBy("species")
