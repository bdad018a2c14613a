"""Link requests put into effect: masks of one viewpoint that a person says are one object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.graph import groups
from tallyscope.operators.overlay import has_text
from tallyscope.session import keep

MASK = ["image_id", "mask_key"]


def request_groups(requests: DataFrame) -> DataFrame:
    """link_id and the least link_id of all requests that share masks with it, directly or through others."""
    first = requests.groupBy(*MASK).agg(F.min("link_id").alias("_first"))
    return groups(requests.join(first, MASK).select("link_id", "_first").distinct(), "link_id", "_first").select(F.col("node").alias("link_id"), F.col("root").alias("group_id"))


def settle_links(requests: DataFrame, rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """What every mask named by a request becomes, and what happens to old members that no request names any more.

    ``requests``: link_id, viewpoint_id, target_id (object to change, or null), image_id, mask_key, is_rep, label, species
    (null: not chosen). ``rows``: judgements with viewpoint_id, batch_id (null: drawn), object_id, removed, accepted,
    label and species of their object. ``candidates``: detected masks of the batch under review, with viewpoint_id and
    passed.

    Requests that share masks are one: all their masks, the target and the representative of the least request. A group
    is refused as a whole, with the reason. Its masks move to the target, or to the object of the representative, or to a
    new object (null). Rejected masks are revived. Rows that the object had and the group does not name are split off.
    ``what`` is moved, stays, created, split or refused.
    """
    # What is read several times below is made once: requests, judgements, masks and groups.
    requests, rows = keep(requests), keep(rows)
    named = keep(requests.join(request_groups(requests), "link_id"))
    lead = F.col("link_id") == F.col("group_id")
    masks = named.groupBy("group_id", *MASK).agg(F.max(F.col("is_rep") & lead).alias("is_rep"), F.min("viewpoint_id").alias("_v0"), F.max("viewpoint_id").alias("_v1"))
    chosen = named.groupBy("group_id").agg(
        F.min(F.when(lead, F.col("target_id"))).alias("target_id"), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("link_id"))).alias("_" + c) for c in ("label", "species")))
    judged = rows.groupBy(*MASK).agg(*(F.max(c).alias(c) for c in ("object_id", "removed", "accepted", "label", "species")), F.max("viewpoint_id").alias("_rv"), F.bool_or(F.col("batch_id").isNull()).alias("_drawn"))
    seen = candidates.groupBy(*MASK).agg(F.max("viewpoint_id").alias("_cv"), F.max("passed").alias("passed"))
    members = rows.groupBy("object_id").agg(F.count("*").alias("_size"))
    m = keep(masks.join(judged, MASK, "left").join(seen, MASK, "left").join(members, "object_id", "left").join(chosen, "group_id"))

    text = lambda c: F.when(has_text(F.col(c)), F.col(c))
    known = F.col("_cv").isNotNull() | F.coalesce("_drawn", F.lit(False))
    elsewhere = ~(F.col("_v0").eqNullSafe(F.col("_v1")) & F.coalesce("_cv", "_rv").eqNullSafe(F.col("_v0")))
    g = m.groupBy("group_id").agg(
        F.count("*").alias("_n"), F.count_if("is_rep").alias("_reps"), F.count_distinct("image_id").alias("_images"), F.count_if(elsewhere & known).alias("_elsewhere"), F.count_if(~known).alias("_unknown"),
        F.count_if(F.coalesce("removed", F.lit(False))).alias("_removed"), F.count_if((F.col("_size") > 1) & ~F.col("object_id").eqNullSafe(F.col("target_id"))).alias("_taken"),
        *(F.min(text(c)).alias("_least_" + c) for c in ("label", "species")), F.max(text("label")).alias("_l"), F.max(text("species")).alias("_s"),
        F.max("target_id").alias("_target"), F.max(F.when(F.col("is_rep"), F.col("object_id"))).alias("_rep_object"), F.min("object_id").alias("_any_object"),
        F.max("_label").alias("_label"), F.max("_species").alias("_species"))
    why = (
        F.when(F.col("_n") < 2, "too few members").when(F.col("_reps") != 1, "not one representative").when(F.col("_images") < F.col("_n"), "one image twice")
        .when(F.col("_unknown") > 0, "unknown mask").when(F.col("_elsewhere") > 0, "several viewpoints").when(F.col("_removed") > 0, "removed member").when(F.col("_taken") > 0, "already linked")
        .when((F.col("_least_label") < F.col("_l")) & F.col("_label").isNull() | (F.col("_least_species") < F.col("_s")) & F.col("_species").isNull(), "conflict").otherwise("")
    )
    g = keep(g.select("group_id", why.alias("why"), F.coalesce("_target", "_rep_object", "_any_object").alias("_home"), F.coalesce("_label", "_l", F.lit("")).alias("_label"), F.coalesce("_species", "_s", F.lit("")).alias("_species")))
    out = m.drop("_label", "_species").join(g, "group_id")
    open_ = F.col("why") == ""
    revive = open_ & F.col("_cv").isNotNull() & ~F.col("passed")
    what = F.when(~open_, "refused").when(F.col("object_id").isNull(), "created").when(F.col("object_id").eqNullSafe(F.col("_home")), "stays").otherwise("moved")
    after = out.select(
        F.col("group_id").alias("link_id"), *MASK, what.alias("what"), "why", F.when(open_, F.col("_home")).otherwise(F.col("object_id")).alias("object_id"), "is_rep",
        (F.coalesce("accepted", F.lit(False)) | revive).alias("accepted"), F.when(open_, F.col("_label")).otherwise(F.coalesce("label", F.lit(""))).alias("label"),
        F.when(open_, F.col("_species")).otherwise(F.coalesce("species", F.lit(""))).alias("species"))
    homes = g.filter("why = '' and _home is not null").select(F.col("_home").alias("object_id"), F.col("group_id").alias("link_id"))
    left = rows.join(homes, "object_id").join(m.select(F.col("group_id").alias("link_id"), *MASK), ["link_id", *MASK], "left_anti")
    split = left.select("link_id", *MASK, F.lit("split").alias("what"), F.lit("").alias("why"), F.lit(None).cast("bigint").alias("object_id"), F.lit(True).alias("is_rep"),
                        F.coalesce("accepted", F.lit(False)).alias("accepted"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("species", F.lit("")).alias("species"))
    return after.unionByName(split)
