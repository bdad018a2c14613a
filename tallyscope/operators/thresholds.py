"""Threshold sets: checking, sharing, trying out and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.verdict import THRESHOLD_NAMES, Thresholds
from tallyscope.session import keep

# The accepted range of any limit.
LOWEST, HIGHEST = 0.0, 1e6
RANGES = [("min_um", "max_um"), ("rod_min_elong", "rod_max_elong")]


def clean_thresholds(proposals: DataFrame, base: Thresholds = Thresholds()) -> DataFrame:
    """Proposed limits over the current ones; ``why`` is '' for a set that may be used."""
    given = [c for c in THRESHOLD_NAMES if c in proposals.columns]
    now = base.columns()
    full = proposals.withColumns({c: F.coalesce(F.col(c), now[c]) if c in given else now[c] for c in THRESHOLD_NAMES})
    bad = F.lit("")
    for lo, hi in reversed(RANGES):
        bad = F.when(F.col(lo) > F.col(hi), f"{lo} above {hi}").otherwise(bad)
    for c in reversed(THRESHOLD_NAMES):
        bad = F.when(~F.col(c).between(LOWEST, HIGHEST), f"{c} out of range").otherwise(bad)
    return full.withColumn("why", bad)


def threshold_hash() -> Column:
    """Content address of the 11 limits."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in THRESHOLD_NAMES]), 256)


def threshold_set_id(runs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per distinct set of limits, the number of runs using it, and whether it must be created.

    ``known``: set_hash of the stored sets.
    """
    used = runs.withColumn("set_hash", threshold_hash()).groupBy("set_hash").agg(F.count("*").alias("n_runs"), F.min("texture_min").alias("texture_min"))
    return used.join(known.select("set_hash", F.lit(False).alias("_new")), "set_hash", "left").withColumn("is_new", F.coalesce("_new", F.lit(True))).drop("_new")


def verdict_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both judgements side by side: detection_id, candidate_no, mask_key, was/now passed, class and reason."""
    cols = ["passed", "cls", "reject"]
    a = before.select("detection_id", "candidate_no", *[F.col(c).alias("was_" + c) for c in cols])
    return after.select("detection_id", "candidate_no", "mask_key", *cols).join(a, ["detection_id", "candidate_no"])


def preview_totals(change: DataFrame) -> DataFrame:
    added, removed = F.col("passed") & ~F.col("was_passed"), ~F.col("passed") & F.col("was_passed")
    return change.agg(
        F.count_if("was_passed").alias("n_before"),
        F.count_if("passed").alias("n_after"),
        F.count_if(added).alias("n_added"),
        F.count_if(removed).alias("n_removed"),
        F.count_distinct(F.when(added | removed, F.col("detection_id"))).alias("n_touched"),
    )


def preview_by_detection(change: DataFrame) -> DataFrame:
    added, removed = F.col("passed") & ~F.col("was_passed"), ~F.col("passed") & F.col("was_passed")
    return change.groupBy("detection_id").agg(
        F.count_if("was_passed").alias("n_before"),
        F.count_if("passed").alias("n_after"),
        F.count_if(added).alias("n_added"),
        F.count_if(removed).alias("n_removed"),
        F.count_if(added | removed).alias("flips"),
    )


def preview_keys(change: DataFrame) -> DataFrame:
    """The masks whose verdict flips, one row each."""
    return change.filter(F.col("passed") != F.col("was_passed")).select(
        "detection_id", "mask_key", F.when(F.col("passed"), "added").otherwise("removed").alias("what"), F.col("cls"), F.col("reject")
    )


def changed_rows(change: DataFrame) -> DataFrame:
    """What applying the new limits would rewrite."""
    differs = (F.col("passed") != F.col("was_passed")) | (F.col("cls") != F.col("was_cls")) | (F.col("reject") != F.col("was_reject"))
    return change.filter(differs).select("detection_id", "candidate_no", "passed", "cls", "reject")


def most_affected(per_detection: DataFrame, limit: int = 24, only_touched: bool = True) -> DataFrame:
    """Detections by number of flips; or half of them so and the rest in order, touched or not."""
    ranked = [F.col("flips").desc(), F.col("slide_id"), F.col("detection_id")]
    if only_touched:
        return per_detection.filter("flips > 0").orderBy(*ranked).limit(limit)
    # The head, the rest and the number taken each read the counts.
    per_detection = keep(per_detection)
    head = per_detection.filter("flips > 0").orderBy(*ranked).limit(max(1, limit // 2))
    rest = per_detection.join(head.select("detection_id"), "detection_id", "left_anti").orderBy("slide_id", "detection_id")
    taken = head.agg(F.count("*")).scalar()
    # The head is at most half of the page, so the page is filled from a bounded number of further rows.
    numbered = rest.limit(limit).withColumn("_n", F.expr("row_number() OVER (ORDER BY slide_id, detection_id)"))
    return head.unionByName(numbered.filter(F.col("_n") + taken <= limit).drop("_n"))


def threshold_history(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The last finished runs and, of their limits (a map ``limits``), those that differ from the defaults, as text."""
    usual = F.create_map(*[x for k, c in Thresholds().columns().items() for x in (F.lit(k), c)])
    changed = F.map_filter("limits", lambda k, v: F.abs(v - F.coalesce(F.try_element_at(usual, k), v)) > 1e-9)
    text = F.array_join(F.array_sort(F.transform(F.map_entries(changed), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), " ")
    last = runs.filter("status = 'done'").orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)
    return last.select("run_id", text.alias("changed"))
