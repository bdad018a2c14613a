"""Batch edits: each operator returns the new table content, or the rows a change would touch and why it is refused.

Updates are joins on the key: rows of the target without a change stay, changed ones are rebuilt, new ones are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.overlay import has_text
from tallyscope.operators.review import latest_per_image

# The parameters of a run that make the recipe of its batch, under their older and newer names.
RECIPE_KEYS = ["backend", "scale", "points_per_side", "min_um", "max_um", "all_images", "weights", "weights_path", "yolo_conf", "conf", "yolo_imgsz", "imgsz"]


def export_diff(new: DataFrame, stored: DataFrame) -> DataFrame:
    """added, changed, gone or same for each path; contents are compared by their hash."""
    a = new.select("path", F.sha2("content", 256).alias("_new"))
    b = stored.select("path", F.sha2("content", 256).alias("_old"))
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def source_metrics(candidates: DataFrame, sums: list[str]) -> DataFrame:
    """Row count, exact sums and counts per class as (metric, value); one pass, then long form."""
    exact = [F.sum(F.col(c).cast("decimal(20,6)")).cast("double").alias("sum_" + c) for c in sums]
    wide = candidates.agg(F.count("*").cast("double").alias("rows"), F.count_if("passed").cast("double").alias("passed"), *exact)
    names = ["rows", "passed", *["sum_" + c for c in sums]]
    pairs = ", ".join(f"'{n}', round({n}, 3)" for n in names)
    long = wide.select(F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))
    per_class = candidates.groupBy(F.concat(F.lit("class:"), "cls").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return long.unionByName(per_class)


def reconcile_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two metric tables side by side."""
    j = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), "metric", "full_outer")
    return j.withColumn("same", F.col("value_a").eqNullSafe(F.col("value_b")))


def survey_drop_batch(batches: DataFrame, detections: DataFrame, candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """What deleting each batch would touch, and the reason if it is refused: people look at it now (its current
    detections are those under review), or corrections are bound to its candidates."""
    n_cand = candidates.groupBy("detection_id").agg(F.count("*").alias("_c"))
    shown = batches.select("batch_id", "for_review")
    d = detections.join(shown, "batch_id").join(n_cand, "detection_id", "left").groupBy("batch_id").agg(
        F.count("*").alias("n_detections"), F.count_distinct("run_id").alias("n_runs"), F.count_if(F.col("is_current") & F.col("for_review")).alias("n_reviewed"), F.sum(F.coalesce("_c", F.lit(0))).alias("n_candidates")
    )
    # A correction without a candidate (orphan, drawn) loses nothing.
    bound = corrections.filter(F.col("batch_id").isNotNull() & ~F.col("bind").isin("orphan", "manual")).select("image_id", "batch_id", "mask_key")
    masks = candidates.select("detection_id", "mask_key").join(detections.select("detection_id", "image_id", "batch_id"), "detection_id").select("image_id", "batch_id", "mask_key")
    r = bound.join(masks, ["image_id", "batch_id", "mask_key"], "left_semi").groupBy("batch_id").agg(F.count("*").alias("n_bound"))
    out = batches.select("batch_id", "label").join(d, "batch_id", "left").join(r, "batch_id", "left").fillna(0)
    why = F.when(F.col("n_reviewed") > 0, "under review").when(F.col("n_bound") > 0, "has corrections").otherwise("")
    return out.withColumn("refused", why)


def deletable(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Child counts of every row of a layer and the reasons against deleting it."""
    out = parents.select(key)
    for name, df in children.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias("n_" + name)), key, "left")
    out = out.fillna(0)
    reasons = [F.when(F.col("n_" + n) > 0, F.concat(F.col("n_" + n).cast("string"), F.lit(f" {n}"))) for n in children]
    return out.withColumn("why", F.concat_ws(", ", *reasons))


def reset_done(viewpoint_reviews: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """The review table with the done marks of the given viewpoints taken back; ``changed`` marks the rows."""
    hit = viewpoints.select("viewpoint_id").withColumn("_hit", F.lit(True))
    j = viewpoint_reviews.join(hit, "viewpoint_id", "left")
    changed = F.col("_hit").isNotNull() & F.col("done") & F.col("batch_id").isNotNull()
    return j.withColumn("changed", changed).withColumn("done", F.col("done") & ~F.col("changed")).drop("_hit")


def mark_all_done(viewpoint_reviews: DataFrame, viewpoints: DataFrame, batch_id: int) -> DataFrame:
    """The done rows of a batch for the given viewpoints: missing ones inserted, others flipped."""
    have = viewpoint_reviews.filter(F.col("batch_id") == batch_id).select("viewpoint_id", F.col("done").alias("_was"))
    what = F.when(F.col("_was").isNull(), "inserted").when(~F.col("_was"), "flipped").otherwise("same")
    return viewpoints.select("viewpoint_id").join(have, "viewpoint_id", "left").select("viewpoint_id", F.lit(batch_id).alias("batch_id"), F.lit(True).alias("done"), what.alias("what"))


def confirm_kept(overlay: DataFrame, done: DataFrame) -> DataFrame:
    """Kept objects of done viewpoints that nobody confirmed yet; ``is_new`` tells whether the row must be created."""
    open_ = overlay.filter((F.col("state") == "kept") & ~F.coalesce("auto_confirmed", F.lit(False)))
    return open_.join(done.select("viewpoint_id"), "viewpoint_id", "left_semi").select("image_id", "mask_key", F.col("has_review").isNull().alias("is_new"))


def catalog_edit(objects: DataFrame, edits: DataFrame, members: DataFrame) -> DataFrame:
    """Edits of species, grade, pose and note by object; null leaves a field, '' clears it.

    ``edits`` also carries ``remove``; removal of an object with several members is refused. Objects left without any
    annotation are pruned.
    """
    fields = ["species", "grade", "pose", "note"]
    n = members.groupBy("object_id").agg(F.count("*").alias("_n"))
    j = objects.select("object_id", *fields).join(edits.select("object_id", "remove", *[F.col(f).alias("e_" + f) for f in fields]), "object_id").join(n, "object_id", "left")
    j = j.withColumns({f: F.coalesce("e_" + f, f) for f in fields})
    empty = ~(has_text(F.col("species")) | has_text(F.col("grade")) | has_text(F.col("pose")) | has_text(F.col("note")))
    what = F.when(F.col("remove") & (F.coalesce("_n", F.lit(0)) > 1), "refused: linked").when(F.col("remove"), "removed").when(empty, "pruned").otherwise("saved")
    return j.select("object_id", *fields, what.alias("what"))


def link_objects(requests: DataFrame, linked: DataFrame) -> DataFrame:
    """Check and merge link requests. One row per link with the merged values, or the reason it is refused.

    ``requests``: link_id, image_id, mask_key, viewpoint_id, is_rep, removed, label, species, note, object_id;
    ``linked``: object_ids that are already links.
    """
    taken = linked.select("object_id").distinct().withColumn("_taken", F.lit(True))
    text = lambda c: F.when(has_text(F.col(c)), F.col(c))
    g = requests.join(taken, "object_id", "left").groupBy("link_id").agg(
        F.count("*").alias("n_members"),
        F.count_if("is_rep").alias("_reps"),
        F.count_distinct("image_id").alias("_images"),
        F.count_distinct("viewpoint_id").alias("_views"),
        F.count_if("removed").alias("_removed"),
        F.count_if(F.col("_taken").isNotNull()).alias("_taken"),
        F.count_distinct(text("label")).alias("_labels"),
        F.count_distinct(text("species")).alias("_species"),
        F.coalesce(F.max(text("label")), F.lit("")).alias("label"),
        F.coalesce(F.max(text("species")), F.lit("")).alias("species"),
        F.concat_ws(" / ", F.array_sort(F.collect_set(text("note")))).alias("note"),
    )
    why = (
        F.when(F.col("n_members") < 2, "too few members")
        .when(F.col("_views") > 1, "several viewpoints")
        .when(F.col("_images") < F.col("n_members"), "one image twice")
        .when(F.col("_reps") != 1, "not one representative")
        .when(F.col("_removed") > 0, "removed member")
        .when(F.col("_taken") > 0, "already linked")
        .when((F.col("_labels") > 1) | (F.col("_species") > 1), "conflict")
        .otherwise("")
    )
    return g.select("link_id", "n_members", "label", "species", "note", why.alias("why"))


def unlink_objects(members: DataFrame, objects: DataFrame, ids: DataFrame) -> DataFrame:
    """Give every member of the given objects an object of its own with copied annotations."""
    m = members.join(ids.select("object_id"), "object_id", "left_semi").join(objects.select("object_id", "label", "species", "grade", "pose", "note"), "object_id")
    new = F.concat_ws(":", F.col("object_id").cast("string"), F.col("image_id").cast("string"), "mask_key")
    return m.select("image_id", "mask_key", new.alias("new_object"), "label", "species", "grade", "pose", "note", F.lit(True).alias("is_rep"))


def prune_objects(objects: DataFrame, members: DataFrame) -> DataFrame:
    return objects.join(members.select("object_id"), "object_id", "left_anti").select("object_id")


def reelect_reps(members: DataFrame) -> DataFrame:
    """Objects without a representative: the member on the lowest image gets it."""
    pick = F.struct("image_id", "mask_key")
    g = members.groupBy("object_id").agg(F.count_if("is_rep").alias("_reps"), F.min(pick).alias("_m"))
    return g.filter("_reps = 0").select("object_id", "_m.*")


def fix_drawn_reps(placements: DataFrame) -> DataFrame:
    """Drawn objects whose representative is not the fused image although they stand on it: where it moves to."""
    g = placements.groupBy("object_id", "mask_key").agg(
        F.min(F.when(F.col("image_kind") == "stack", F.col("image_id"))).alias("to_image"), F.min(F.when(F.col("is_rep"), F.col("image_id"))).alias("from_image")
    )
    return g.filter(F.col("to_image").isNotNull() & ~F.col("to_image").eqNullSafe(F.col("from_image")))


def backfill_objects(judgements: DataFrame, fields: list[str]) -> DataFrame:
    """One object per group of judgements: the representative's value, else the only distinct one, else ''."""
    aggs: list[Column] = []
    for f in fields:
        text = F.when(has_text(F.col(f)), F.col(f))
        aggs += [F.max(F.when(F.col("is_rep"), text)).alias("_r" + f), F.count_distinct(text).alias("_n" + f), F.max(text).alias("_m" + f)]
    g = judgements.groupBy("object_id").agg(*aggs)
    value = lambda f: F.coalesce(F.col("_r" + f), F.when(F.col("_n" + f) == 1, F.col("_m" + f)), F.lit(""))
    conflict = F.concat_ws(",", *[F.when(F.col("_n" + f) > 1, F.lit(f)) for f in fields])
    return g.select("object_id", *[value(f).alias(f) for f in fields], conflict.alias("conflict"))


def backfill_batch_of_reviews(corrections: DataFrame, detections: DataFrame) -> DataFrame:
    """Batch of each correction from the current detections of its image; no answer when they are of several batches."""
    b = detections.filter("is_current").groupBy("image_id").agg(F.count_distinct("batch_id").alias("_n"), F.min("batch_id").alias("_b"))
    j = corrections.join(b, "image_id", "left")
    why = F.when(F.col("_n").isNull(), "no current detection").when(F.col("_n") > 1, "several batches").otherwise("")
    return j.select("image_id", "mask_key", F.when(F.col("_n") == 1, F.col("_b")).alias("batch_id"), why.alias("why"))


def majority_batch(corrections: DataFrame, key: str) -> DataFrame:
    """The batch most corrections of a key belong to; the lower number wins a tie."""
    n = corrections.filter(F.col("batch_id").isNotNull()).groupBy(key, "batch_id").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by("batch_id", F.struct("n", (-F.col("batch_id")).alias("b"))).alias("batch_id"))


def backfill_layers(slides: DataFrame, code: Column) -> DataFrame:
    """Sample rows out of flat slides, one per (locality, code)."""
    return slides.select("slide_id", "locality_id", code.alias("code")).groupBy("locality_id", "code").agg(F.count("*").alias("n_slides"), F.min("slide_id").alias("first_slide"))


def backfill_scale(stacks: DataFrame, frames: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Scale of fused images from the width ratio to their frames and the frames' scale; mixed scales are flagged.

    ``stacks``: viewpoint_id, stack_width; ``frames``: viewpoint_id, width, um_per_pixel, seq.
    """
    f = frames.groupBy("viewpoint_id").agg(
        F.min_by("width", "seq").alias("_w"), F.min_by("um_per_pixel", "seq").alias("_um"), F.min("um_per_pixel").alias("_lo"), F.max("um_per_pixel").alias("_hi")
    )
    j = stacks.join(f, "viewpoint_id")
    return j.select(
        "viewpoint_id", (F.col("stack_width") / F.col("_w")).alias("resize"), (F.col("_um") * F.col("_w") / F.col("stack_width")).alias("um_per_pixel"),
        (F.col("_hi") - F.col("_lo") > F.col("_um") * tolerance).alias("mixed"),
    )


def missing_backend(runs: DataFrame, fill: str) -> DataFrame:
    """Batched runs without an engine, and what would be filled in."""
    return runs.filter(F.col("batch_id").isNotNull() & F.col("backend").isNull()).select("run_id", "batch_id", F.lit(fill).alias("backend"))


def close_stale_runs(runs: DataFrame, kind: str, now: str, older_than_min: float = 5.0) -> DataFrame:
    """The run table with left-over running ones of a kind closed as failed."""
    stale = (F.col("kind") == kind) & (F.col("status") == "running") & (F.unix_timestamp("started_at") < F.unix_timestamp(F.lit(now).cast("timestamp")) - older_than_min * 60)
    note = F.concat_ws(" | ", F.when(has_text(F.col("note")), F.col("note")), F.lit("left unfinished"))
    return runs.select(
        "run_id", "kind", F.when(stale, "failed").otherwise(F.col("status")).alias("status"), F.when(stale, note).otherwise(F.col("note")).alias("note"), stale.alias("closed")
    )


def merge_lookup_batches(lookups: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Results of several days merged per name: the higher state wins (``ranks``; others come last), then the longer text,
    then the later row."""
    table = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    rank = F.struct(F.coalesce(F.get(F.array(table[F.col("state")]), F.lit(0)), F.lit(0)).alias("r"), F.length("text").alias("l"), F.col("seq"))
    g = lookups.groupBy("name").agg(
        F.max_by("state", rank).alias("state"), F.max_by("text", rank).alias("text"), F.max_by("seq", rank).alias("seq"), F.count("*").alias("_n"), F.count_distinct("state").alias("n_states")
    )
    return g.select("name", "state", "text", "seq", (F.col("_n") - 1).alias("n_lost"), (F.col("n_states") > 1).alias("conflict"))


def check_numbering(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows whose name differs from the reference row of the same number, or that have none."""
    j = records.join(reference.select("number", F.col("name").alias("expected")), "number", "left")
    return j.filter(~F.col("name").eqNullSafe(F.col("expected"))).select("number", "name", "expected")


def set_review_batch(batches: DataFrame, detections: DataFrame, batch_id: int) -> DataFrame:
    """The batch table with the review flag moved; refused (unchanged) when the batch has no detections."""
    cover = detections.filter("is_current").groupBy("batch_id").agg(F.count_distinct("viewpoint_id").alias("n_views"))
    has = detections.filter(F.col("batch_id") == batch_id).select(F.lit(1)).limit(1).agg(F.count("*")).scalar()
    out = batches.select("batch_id", "label", "for_review").join(cover, "batch_id", "left").fillna(0, ["n_views"])
    ok = has > 0
    return out.select(
        "batch_id", "label", "n_views", F.when(ok, F.col("batch_id") == batch_id).otherwise(F.col("for_review")).alias("for_review"), (~ok).alias("refused")
    )


def move_members(edits: DataFrame, children: DataFrame, parents: DataFrame, child: str, parent: str, code: str, grandchildren: DataFrame) -> DataFrame:
    """Move children to other parents: unknown parents and codes the new parent already has are refused."""
    known = parents.select(F.col(parent).alias("_to"), F.lit(True).alias("_known"))
    codes = children.select(F.col(parent).alias("_to"), F.col(code).alias("_code"), F.lit(True).alias("_dup")).distinct()
    n = grandchildren.groupBy(child).agg(F.count("*").alias("n_children"))
    j = edits.select(child, F.col("new_parent").alias("_to")).join(children.select(child, parent, F.col(code).alias("_code")), child)
    j = j.join(known, "_to", "left").join(codes, ["_to", "_code"], "left").join(n, child, "left").fillna(0, ["n_children"])
    same = F.col(parent) == F.col("_to")
    why = F.when(same, "same place").when(F.col("_known").isNull(), "unknown place").when(F.col("_dup"), "code exists there").otherwise("")
    return j.select(child, F.when(why == "", F.col("_to")).otherwise(F.col(parent)).alias(parent), "n_children", why.alias("why"))


def backfill_recipes(runs: DataFrame, keys: list[str] = RECIPE_KEYS) -> DataFrame:
    """Recipe of each batch: the known keys of its latest run's parameters (a JSON object of texts)."""
    last = runs.filter(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(F.max_by(F.struct("params", "backend"), F.struct("started_at", "run_id")).alias("_r"))
    params = F.from_json("_r.params", "map<string,string>")
    known = F.map_filter(params, lambda k, v: k.isin(keys) & v.isNotNull())
    return last.select(
        "batch_id",
        F.array_join(F.array_sort(F.transform(F.map_entries(known), lambda e: F.concat_ws("=", e["key"], e["value"]))), " ").alias("recipe"),
        F.coalesce("_r.backend", F.lit("mask")).alias("backend"),
        F.col("_r.backend").isNull().alias("guessed"),
    )


def fill_plan(recipes: DataFrame, batches: DataFrame, latest: DataFrame, weights: DataFrame) -> DataFrame:
    """Batches with a recipe in the order to fill them: the one under review first, then the newest; ready or why not.

    ``latest``: batch_id, started_at; ``weights``: the files that exist.
    """
    path = F.regexp_extract("recipe", r"weights_path=(\S+)", 1)
    j = recipes.withColumn("_w", path).join(F.broadcast(batches.select("batch_id", "label", "for_review")), "batch_id").join(latest, "batch_id")
    j = j.join(weights.select(F.col("path").alias("_w"), F.lit(True).alias("_ok")), "_w", "left")
    why = F.when(F.col("backend") != "box", "").when(F.col("_w") == "", "no weights in the recipe").when(F.col("_ok").isNull(), "weights are missing").otherwise("")
    out = j.select("batch_id", "label", "recipe", "for_review", "started_at", (why == "").alias("ready"), why.alias("why"))
    return out.orderBy(F.col("for_review").desc(), F.col("started_at").desc(), "batch_id").drop("started_at")


def seed_codes(batches: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fill empty batch codes only, from a mapping table label -> code."""
    s = seeds.select("label", F.col("code").alias("_seed"))
    return batches.join(F.broadcast(s), "label", "left").select("batch_id", "label", F.when(has_text(F.col("code")), F.col("code")).otherwise(F.coalesce("_seed", F.lit(""))).alias("code"))


def swap_prefix(df: DataFrame, path: str, old: str, new: str) -> DataFrame:
    return df.withColumn(path, F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(F.col(path)))


def get_or_create_batch(batches: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, label) pairs of ``wanted`` with their batch, or none yet (``created``)."""
    w = wanted.select("kind", "label").distinct()
    have = batches.groupBy("kind", "label").agg(F.min("batch_id").alias("batch_id"))
    return w.join(have, ["kind", "label"], "left").withColumn("created", F.col("batch_id").isNull())


def supersede(new: DataFrame, old: DataFrame) -> DataFrame:
    """Append detections and keep only the newest of each (image, batch) current."""
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    last = latest_per_image(both.select("batch_id", "image_id", "detection_id", "created_at"), ["batch_id", "image_id"])
    cur = last.select("batch_id", "image_id", F.col("detection_id").alias("_cur"))
    return both.join(cur, ["batch_id", "image_id"]).withColumn("is_current", F.col("detection_id") == F.col("_cur")).drop("_cur", "_new")
