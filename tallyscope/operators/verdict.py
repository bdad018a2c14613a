"""Threshold verdicts over candidate masks, and the removal of overlapping ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.boxes import Box, bbox_cover
from tallyscope.operators.greedy import dropped_by_earlier
from tallyscope.operators.spatial import DEFAULT_MAX_SIDE, centre_in_box
from tallyscope.session import cut, keep


@dataclass(frozen=True)
class Thresholds:
    """The default threshold set."""

    min_um: float = 10.0
    max_um: float = 150.0
    texture_min: float = 1000.0
    round_max_elong: float = 1.4
    round_min_iou: float = 0.85
    round_min_solidity: float = 0.92
    round_texture_min: float = 1500.0
    rod_min_elong: float = 2.0
    rod_max_elong: float = 20.0
    rod_min_iou: float = 0.72
    rod_min_solidity: float = 0.85

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(float(v)) for k, v in asdict(self).items()}


THRESHOLD_NAMES = [f.name for f in fields(Thresholds)]
# The elongation limits used to guess the class of a revived reject.
GUESS_ROUND_BELOW, GUESS_ROD_FROM, GUESS_ROD_TO = 1.4, 2.0, 20.0
# Tuning: rows of a few numbers that every task may be sent (below 10 MB).
SENT_ROWS = 100_000
# Overlap rules.
CHILD_COVER, CHILDREN_NEEDED, CHILDREN_SHARE, SAME_COVER = 0.85, 2, 0.5, 0.8


def reject_code(t: dict[str, Column]) -> Column:
    """The first gate a candidate fails, or null when it passes. ``t`` holds the 11 limits as columns."""
    c = F.col
    known_texture = c("texture").isNotNull()
    is_round = c("elongation") < t["round_max_elong"]
    is_rod = c("elongation").between(t["rod_min_elong"], t["rod_max_elong"])
    areolae_gate = F.coalesce(t["round_texture_min"], F.lit(0.0)) != 0
    round_shape = (c("ellipse_iou") >= t["round_min_iou"]) & (c("solidity") >= t["round_min_solidity"])
    rod_shape = (c("ellipse_iou") >= t["rod_min_iou"]) & (c("solidity") >= t["rod_min_solidity"])
    return (
        F.when(~F.coalesce(c("shape_ok"), F.lit(False)), "shape_unmeasurable")
        .when(c("major_um").isNotNull() & ~c("major_um").between(t["min_um"], t["max_um"]), "major_out_of_range")
        .when(known_texture & (c("texture") < t["texture_min"]), "texture_low")
        .when(is_round & areolae_gate & known_texture & (c("texture") < t["round_texture_min"]), "round_areolae_low")
        .when(is_round & ~round_shape, "round_criteria")
        .when(is_rod & ~is_round & ~rod_shape, "rod_criteria")
        .when(~is_round & ~is_rod, "elongation_gap")
    )


def classify(df: DataFrame, thresholds: Thresholds | dict[str, Column] = Thresholds(), prefix: str = "") -> DataFrame:
    """Add ``passed``, ``cls`` ('' when rejected) and ``reject`` ('' when passed), their names behind ``prefix``."""
    t = thresholds.columns() if isinstance(thresholds, Thresholds) else thresholds
    shape = F.when(F.col("elongation") < t["round_max_elong"], "round").otherwise("rod")
    return (
        df.withColumn("_why", reject_code(t))
        .withColumn(prefix + "passed", F.col("_why").isNull())
        .withColumn(prefix + "cls", F.when(F.col("_why").isNull(), shape).otherwise(""))
        .withColumn(prefix + "reject", F.coalesce("_why", F.lit("")))
        .drop("_why")
    )


def guessed_class(elongation: Column) -> Column:
    return (
        F.when(elongation < GUESS_ROUND_BELOW, "round")
        .when(elongation.between(GUESS_ROD_FROM, GUESS_ROD_TO), "rod")
        .otherwise("")
    )


def size_background_filter(
    df: DataFrame, image_area: Column, min_um: float = 10.0, max_um: float = 150.0, background_share: float = 0.5
) -> DataFrame:
    """Masks of a plausible size (fitted major axis, else the longer side) that do not fill the image."""
    size = F.coalesce("major_um", F.greatest("bbox_w", "bbox_h") * F.col("um_per_pixel"))
    return df.filter(size.between(min_um, max_um) & (F.col("area_px") <= image_area * background_share))


def collapse_boxes(df: DataFrame) -> DataFrame:
    """One candidate per (detection, box): the larger area, then the lower number.

    Equal boxes are rare. Only the box columns are shuffled, once, to count them; what repeats is kept, and while it is
    small enough to be sent to every task, the wide rows stay where they are.
    """
    keys = ["detection_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h"]
    repeated = cut(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys))
    rows = df.select(*keys, "candidate_no", F.coalesce("area_px", F.lit(0)).alias("area_px")).join(sent_if_small(repeated), keys, "left_semi")
    best = F.max_by("candidate_no", F.struct(F.col("area_px"), -F.col("candidate_no"))).alias("_best")
    losers = cut(rows.join(rows.groupBy(*keys).agg(best), keys).filter(F.col("candidate_no") != F.col("_best")).select("detection_id", "candidate_no"))
    return df.join(sent_if_small(losers), ["detection_id", "candidate_no"], "left_anti").select(*df.columns)


def sent_if_small(kept: DataFrame) -> DataFrame:
    """A stored side with the hint to broadcast it if it was counted to be small; its size is no estimate."""
    return F.broadcast(kept) if kept.count() <= SENT_ROWS else kept


def covered_pairs(passing: DataFrame, max_side: int = DEFAULT_MAX_SIDE, marks: Sequence[str] = ()) -> DataFrame:
    """Pairs (inner, outer) of passing masks of one detection with the inner one more than 80% inside the outer.

    Of the boolean columns ``marks`` the result tells which are true on both sides.
    """

    def side(p: str) -> DataFrame:
        return passing.select(
            "detection_id",
            F.col("candidate_no").alias(p + "no"),
            F.col("area_px").alias(p + "area"),
            F.coalesce("texture", F.lit(0.0)).alias(p + "texture"),
            *[F.col("bbox_" + c).alias(p + c) for c in "xywh"],
            *[F.col(c).alias(p + c) for c in marks],
        )

    a, b = Box.of("a_"), Box.of("b_")
    pairs = centre_in_box(side("a_"), side("b_"), ["detection_id"], a, b, max_side, any_larger=True)
    return pairs.filter(F.col("a_no") != F.col("b_no")).select(
        "detection_id",
        *["a_no", "b_no", "a_area", "b_area", "a_texture", "b_texture"],
        bbox_cover(a, b).alias("a_in_b"),
        bbox_cover(b, a).alias("b_in_a"),
        *[(F.col("a_" + c) & F.col("b_" + c)).alias(c) for c in marks],
    ).filter(F.col("a_in_b") > SAME_COVER)


def aggregate_masks(pairs: DataFrame) -> DataFrame:
    """Masks explained by smaller ones inside them: (detection_id, candidate_no, n_inside, area_inside)."""
    inside = (F.col("a_in_b") > CHILD_COVER) & (F.col("a_area") < F.col("b_area"))
    return (
        pairs.filter(inside)
        .groupBy("detection_id", F.col("b_no").alias("candidate_no"))
        .agg(F.count("*").alias("n_inside"), F.sum("a_area").alias("area_inside"), F.first("b_area").alias("own_area"))
        .filter((F.col("n_inside") >= CHILDREN_NEEDED) & (F.col("area_inside") > F.col("own_area") * CHILDREN_SHARE))
        .drop("own_area")
    )


def duplicate_masks(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """Of masks that cover each other, the ones a stronger-textured survivor replaces: (detection_id, candidate_no)."""
    key = "detection_id"
    mutual = pairs.filter(F.col("b_in_a") > SAME_COVER)
    # The struct order is texture descending, then candidate number.
    order = [F.struct((-F.col(f"{s}_texture")).alias("t"), F.col(f"{s}_no").alias("n")) for s in "ab"]
    edges = (
        mutual.filter(order[1] < order[0])
        .select(key, F.col("b_no").alias("winner"), F.col("a_no").alias("loser"), order[0].alias("loser_rank"))
        .join(gone.select(key, F.col("candidate_no").alias("winner")), [key, "winner"], "left_anti")
        .join(gone.select(key, F.col("candidate_no").alias("loser")), [key, "loser"], "left_anti")
    )
    return dropped_by_earlier(edges, [key]).withColumnRenamed("node", "candidate_no")


def judge(
    df: DataFrame, thresholds: Thresholds | dict[str, Column] = Thresholds(), max_side: int = DEFAULT_MAX_SIDE
) -> DataFrame:
    """Verdict per candidate: the cascade, then removal of aggregates and of duplicates.

    A mask that falls to the overlap rules gets the reason ``overlap`` and keeps its class.
    """
    return judge_each(df, {"": thresholds}, max_side)


def judge_each(
    df: DataFrame, sets: dict[str, Thresholds | dict[str, Column]], max_side: int = DEFAULT_MAX_SIDE
) -> DataFrame:
    """:func:`judge` under several threshold sets side by side: prefix of the verdict columns -> limits.

    The pairs are made once, of the masks that pass under any set; each set takes those whose two masks pass under it.
    """
    key = ["detection_id", "candidate_no"]
    verdicts = df
    for prefix, limits in sets.items():
        verdicts = classify(verdicts, limits, prefix)
    passed = [prefix + "passed" for prefix in sets]
    any_passed = reduce(lambda a, b: a | b, (F.col(c) for c in passed))
    passing = verdicts.filter(any_passed)
    if len(sets) > 1:
        # Both sides of the pairs read these rows; several cascades in one expression are slow to evaluate twice.
        passing = keep(passing.select(*key, "area_px", "texture", *["bbox_" + c for c in "xywh"], *passed))
    pairs = cut(covered_pairs(passing, max_side, passed if len(sets) > 1 else ()))
    drops = []
    for name in passed:
        own = pairs.filter(F.col(name)) if len(sets) > 1 else pairs
        gone = aggregate_masks(own).select(*key)
        drops.append(gone.unionByName(duplicate_masks(own, gone)).withColumn("_drop_" + name, F.lit(True)))
    drop = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), drops)
    if len(sets) > 1:
        drop = drop.groupBy(*key).agg(*(F.max("_drop_" + name).alias("_drop_" + name) for name in passed))
    out = verdicts.join(drop, key, "left")
    for prefix in sets:
        falls = F.col(f"_drop_{prefix}passed").isNotNull()
        out = out.withColumns({prefix + "passed": F.col(prefix + "passed") & ~falls, prefix + "reject": F.when(falls, "overlap").otherwise(F.col(prefix + "reject"))})
    return out.drop(*("_drop_" + name for name in passed))
