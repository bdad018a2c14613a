"""Saving a review: what a person sent for one image and batch becomes the new content of that scope and nothing else.

A save speaks for (image, batch). Rows of other scopes, and hand-drawn rows, which have no batch, are never touched. The
sender does not know every column, so a stored row also stays if it is edited by a sender that cannot send edits, carries
an annotation of the catalogue, is confirmed, or shares its object with other rows. What is neither sent nor kept by one
of these goes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.operators.catalogue import manual_key_valid
from tallyscope.operators.overlay import has_text, kept_rule
from tallyscope.session import cut

SCOPE = ["image_id", "batch_id"]
KEY = [*SCOPE, "mask_key"]
VIEW = ["viewpoint_id", "batch_id"]
FIELDS = ["removed", "accepted", "label", "outline", "geom_edited", "auto_confirmed", "bind"]
ANNOTATIONS = ["species", "grade", "pose", "note"]
BUCKETS = 64
# So many saves are sent to every task.
FEW = 20_000


def save_review(existing: DataFrame, saves: DataFrame, payload: DataFrame, candidates: DataFrame, objects: DataFrame, few: int = FEW) -> DataFrame:
    """The rows of every scope that a save speaks for, after it, and what happened to each.

    ``existing``: image_id, viewpoint_id, batch_id (null: drawn by hand), mask_key, object_id, removed, accepted,
    auto_confirmed, geom_edited, outline, bind. ``saves``: image_id, batch_id, viewpoint_id, knows_edits, done; one row
    per scope. ``payload``: image_id, batch_id, mask_key, removed, accepted, label (null: not said), outline (null: not
    edited; '': the detector's again). ``candidates``: image_id, viewpoint_id, batch_id, mask_key, passed, outline, of
    current detections. ``objects``: object_id, label, species, grade, pose, note.

    ``what`` is insert, update, same, delete or refused. A scope is refused, and keeps its rows, if it is sent a key that
    is neither detected nor stored, or takes back an outline where there is none to go back to. A save that is done
    confirms the kept masks of all images of its viewpoint in that batch.

    A viewpoint in a batch is one group: its rows are sorted and gone through by one task, on disk if need be. ``few`` saves
    or less are sent to all tasks and pick their rows before anything is shuffled.
    """
    views = saves.select("viewpoint_id", "batch_id").distinct()
    # Few saves pick their rows where these lie. Of many, all rows travel once, to their viewpoint, and are picked there.
    picked = saves.limit(few + 1).count() <= few
    pick = lambda df: df.join(F.broadcast(views), VIEW, "left_semi") if picked else df.filter("viewpoint_id is not null and batch_id is not null")
    shared = existing.groupBy("object_id").agg(F.count("*").alias("_n")).filter("_n >= 2")
    annotated = reduce(lambda a, b: a | b, (has_text(F.col(c)) for c in ANNOTATIONS))
    old = pick(existing).join(objects.select("object_id", "label", annotated.alias("_annotated")), "object_id", "left").join(shared, "object_id", "left")
    # The sides meet in one aggregate: each says its own columns and leaves the others empty.
    o_row = F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("label", "outline", "bind") else F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FIELDS),
                     "object_id", F.coalesce("_annotated", F.lit(False)).alias("annotated"), F.col("_n").isNotNull().alias("linked"))
    p_row = [F.col(c).alias("p_" + c) for c in ("removed", "accepted", "label", "outline")]
    c_row = [F.col(c).alias("c_" + c) for c in ("passed", "outline")]
    sides = [
        payload.join(saves.select(*SCOPE, "viewpoint_id"), SCOPE).select(*KEY, "viewpoint_id", F.lit(True).alias("p_here"), *p_row),
        old.select(*KEY, "viewpoint_id", o_row.alias("o")),
        pick(candidates).select(*KEY, "viewpoint_id", F.lit(True).alias("c_here"), *c_row),
        saves.select(*SCOPE, "viewpoint_id", F.lit(None).cast("string").alias("mask_key"), F.lit(True).alias("_own"), "knows_edits", "done"),
    ]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides).repartition(*VIEW)
    # An image belongs to one viewpoint, and all that rules a row is said of its scope or its viewpoint: what follows stays
    # where the rows are and keeps their order.
    scope, view = Window.partitionBy(*VIEW, "image_id"), Window.partitionBy(*VIEW)
    met = both.groupBy(*VIEW, "image_id", "mask_key").agg(*(F.max(c).alias(c) for c in both.columns if c not in [*KEY, "viewpoint_id"]))
    unknown = F.col("p_here") & F.col("c_here").isNull() & F.col("o").isNull()
    lost = (F.col("p_outline") == "") & F.col("c_here").isNull()
    met = met.withColumn("why", F.when(unknown, "unknown key").when(lost, "no outline to go back to"))
    met = met.withColumns({c: F.max(c).over(scope) for c in ("_own", "knows_edits", "done", "why")})
    met = met.withColumn("_signs", F.max(F.col("done") & F.col("why").isNull()).over(view)).filter("_own or _signs")

    o, detected = F.col("o"), F.col("c_here").isNotNull()
    p = {c: F.col("p_" + c) for c in ("removed", "accepted", "label", "outline")}
    no, nothing = F.lit(False), F.lit("")
    was, spoken = o.isNotNull(), F.coalesce("_own", no) & F.col("why").isNull()
    said = F.coalesce(p["removed"], no) | F.coalesce(p["accepted"], no) | p["label"].isNotNull() | p["outline"].isNotNull()
    kept_old = (o["geom_edited"] & ~F.coalesce("knows_edits", no)) | o["annotated"] | o["auto_confirmed"] | o["linked"]
    # A row stands after the save.
    stands = F.when(spoken, said | F.coalesce(kept_old, no)).otherwise(was)
    engine = F.coalesce("c_outline", nothing)
    outline = (
        F.when(spoken & (p["outline"] != ""), p["outline"]).when(spoken & (p["outline"] == ""), engine)
        .when(spoken & ~has_text(o["outline"]), engine).otherwise(F.coalesce(o["outline"], nothing))
    )
    edited = F.when(spoken & p["outline"].isNotNull(), p["outline"] != "").otherwise(F.coalesce(o["geom_edited"], no))
    after: dict[str, Column] = {
        "removed": F.when(spoken, F.coalesce(p["removed"], no)).otherwise(F.coalesce(o["removed"], no)),
        "accepted": F.when(spoken, F.coalesce(p["accepted"], no)).otherwise(F.coalesce(o["accepted"], no)),
        "label": F.when(spoken, F.coalesce(p["label"], nothing)).otherwise(F.coalesce(o["label"], nothing)),
        "outline": outline,
        "geom_edited": edited,
        "auto_confirmed": F.coalesce(o["auto_confirmed"], no),
        "bind": F.when(spoken & detected, "exact").otherwise(F.coalesce(o["bind"], F.lit("orphan"))),
    }
    rows = met.select(*KEY, "o", "c_outline", "c_passed", detected.alias("_detected"), "why", was.alias("_was"), stands.alias("_stands"), "_signs", *(v.alias(k) for k, v in after.items()))
    # Confirming comes last. A row that the save dropped counts as never said.
    gone, back = F.col("_stands") & F.col("removed"), F.col("_stands") & F.col("accepted")
    confirm = F.coalesce("_signs", no) & F.col("_detected") & kept_rule(F.col("c_passed"), gone, back, list_rule=True) & ~(F.col("_stands") & F.col("auto_confirmed"))
    rows = rows.withColumn("_confirm", confirm)
    made = F.col("_confirm") & ~F.col("_stands")
    fresh = {"removed": no, "accepted": no, "label": nothing, "outline": engine, "geom_edited": no, "bind": F.lit("exact")}
    values = {k: F.when(made, v).otherwise(F.col(k)) for k, v in fresh.items()} | {"auto_confirmed": F.col("auto_confirmed") | F.col("_confirm")}
    rows = rows.select(*KEY, "o", "why", "_was", (F.col("_stands") | F.col("_confirm")).alias("_stands"), *(values[k].alias(k) for k in FIELDS))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(o[k]) for k in FIELDS))
    what = (
        F.when(F.col("why").isNotNull(), "refused").when(~F.col("_was"), "insert").when(~F.col("_stands"), "delete").when(same, "same").otherwise("update")
    )
    return rows.filter("_was or _stands").select(*KEY, what.alias("what"), "why", *FIELDS, F.col("o.object_id").alias("object_id"))


def relabelled(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects whose class a save changed; all rows of such an object show the new one. Several images of one object are
    saved one after the other; here the last image wins."""
    said = changes.filter("what in ('update', 'insert') and object_id is not null").groupBy("object_id").agg(F.max_by("label", F.struct("image_id", "batch_id", "mask_key")).alias("label"))
    old = objects.select("object_id", F.col("label").alias("was"))
    return said.join(old, "object_id", "left").filter(F.col("label") != F.coalesce("was", F.lit(""))).select("object_id", "label")


def save_drawn(existing: DataFrame, drawn: DataFrame, images: DataFrame) -> DataFrame:
    """Hand-drawn rows of ``images`` (those whose sender knows drawing) become exactly ``drawn``: image_id, mask_key,
    label, outline. They have no batch, so no save of a batch reaches them. An image with a key that is not one of a
    drawing is refused as a whole."""
    sent = drawn.groupBy("image_id", "mask_key").agg(F.max("label").alias("label"), F.max("outline").alias("outline")).join(images.select("image_id"), "image_id", "left_semi")
    bad = sent.filter(~manual_key_valid(F.col("mask_key"))).select("image_id").distinct().withColumn("why", F.lit("not the key of a drawing"))
    old = existing.filter("batch_id is null").join(images.select("image_id").distinct(), "image_id", "left_semi")
    sides = old.select("image_id", "mask_key", F.struct("outline", "label", "object_id").alias("o")).unionByName(
        sent.select("image_id", "mask_key", F.struct("outline", "label").alias("p")), allowMissingColumns=True)
    met = sides.groupBy("image_id", "mask_key").agg(F.max("o").alias("o"), F.max("p").alias("p")).join(bad, "image_id", "left")
    o, p = F.col("o"), F.col("p")
    same = o["outline"].eqNullSafe(p["outline"]) & F.coalesce(o["label"], F.lit("")).eqNullSafe(F.coalesce(p["label"], F.lit("")))
    what = F.when(F.col("why").isNotNull(), "refused").when(o.isNull(), "insert").when(p.isNull(), "delete").when(same, "same").otherwise("update")
    take = lambda k: F.when(F.col("why").isNull() & p.isNotNull(), p[k]).otherwise(o[k])
    out = met.select("image_id", "mask_key", what.alias("what"), "why", F.coalesce(take("label"), F.lit("")).alias("label"), take("outline").alias("outline"), o["object_id"].alias("object_id"))
    return out.filter("what <> 'refused' or object_id is not null or outline is not null")


def store(changes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Bring the table of reviews below ``path`` to ``changes`` of :func:`save_review`.

    The table is partitioned by batch and a bucket of images; only partitions with a change are read and written
    (dynamic overwrite). A partition that loses all its rows keeps them marked ``gone``, which readers leave out, since
    an empty partition would not replace the old one. Saving the same again changes nothing.
    """
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int")
    new = changes.filter("what in ('insert', 'update', 'delete')").withColumn("gone", F.col("what") == "delete").withColumn("bucket", bucket).drop("what", "why")
    new = cut(new)
    held = table_or_none(changes, path)
    if held is not None:
        # The partitions with a change, as they are now; cut before they are written over.
        held = held.join(new.select("batch_id", "bucket").distinct(), ["batch_id", "bucket"], "left_semi").filter("not gone")
        new = cut(held.join(new, KEY, "left_anti").select(*new.columns).unionByName(new))
    parts = new.groupBy("batch_id", "bucket").agg(F.bool_and("gone").alias("_empty"))
    rows = new.join(parts, ["batch_id", "bucket"]).filter("not gone or _empty").select(*new.columns).hint("rebalance", "batch_id", "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(path)


def table_or_none(like: DataFrame, path: str) -> DataFrame | None:
    try:
        return like.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored(like: DataFrame, path: str) -> DataFrame:
    """The table of reviews, without rows that are gone."""
    return like.sparkSession.read.parquet(path).filter("not gone").drop("gone", "bucket")
