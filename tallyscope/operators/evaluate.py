"""Detector evaluation: matching predictions with truths, and the sweep over confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.boxes import Box, bbox_iou
from tallyscope.operators.greedy import greedy_matching
from tallyscope.operators.spatial import DEFAULT_MAX_SIDE, centre_in_box

# Overlap that makes a hit, and the confidences reported.
HIT_IOU = 0.5
CONFIDENCES = [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02, 0.01]


def match_predictions(predictions: DataFrame, truths: DataFrame, max_side: int = DEFAULT_MAX_SIDE) -> DataFrame:
    """Predictions by falling confidence take the best free truth of their image: image_id, pred_no, conf, truth_no (or null).

    Of equal overlaps the truth with the higher number is taken.
    """
    p, t = Box.of("p_"), Box.of("t_")
    near = centre_in_box(predictions.select("image_id", "pred_no", "conf", *p), truths.select("image_id", "truth_no", *t), ["image_id"], p, t, max_side)
    iou = bbox_iou(p, t)
    edges = near.withColumn("_iou", -iou).filter(F.col("_iou") <= -HIT_IOU).withColumn("_conf", -F.col("conf"))
    edges = edges.withColumn("_late", -F.col("truth_no")).withColumn("_pred", F.col("pred_no"))
    taken = greedy_matching(edges, ["image_id"], "pred_no", "truth_no", ["_conf", "_pred", "_iou", "_late"])
    return predictions.select("image_id", "pred_no", "conf").join(taken.select("image_id", "pred_no", "truth_no"), ["image_id", "pred_no"], "left")


def by_confidence(matched: DataFrame, steps: int = 1000) -> DataFrame:
    """Predictions and hits at or above each distinct confidence.

    Counts are summed per distinct confidence before anything is ordered; the running sums go in two levels (ranges of
    confidence, then inside a range), so the ordered part never sees single predictions.
    """
    c = matched.groupBy("conf").agg(F.count("*").alias("_n"), F.count("truth_no").alias("_tp"))
    c = c.withColumn("_r", F.floor(F.col("conf") * steps / 32))
    tops = c.groupBy("_r").agg(F.sum("_n").alias("_rn"), F.sum("_tp").alias("_rtp"))
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_r", F.coalesce(F.sum("_rn").over(above), F.lit(0)).alias("_an"), F.coalesce(F.sum("_rtp").over(above), F.lit(0)).alias("_atp"))
    inside = Window.partitionBy("_r").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    return c.join(tops, "_r").select(
        "conf", (F.sum("_n").over(inside) + F.col("_an")).alias("n_pred"), (F.sum("_tp").over(inside) + F.col("_atp")).alias("tp")
    )


def scores(counts: DataFrame, n_truth) -> DataFrame:
    """Precision, recall, F1 and count ratio of (n_pred, tp) rows."""
    p, r = F.col("tp") / F.col("n_pred"), F.col("tp") / n_truth
    return counts.select(
        "conf", "n_pred", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), p.alias("precision"), r.alias("recall"),
        (p * r * 2 / (p + r + 1e-9)).alias("f1"), (F.col("n_pred") / n_truth).alias("count_ratio"),
    )


def pr_sweep(matched: DataFrame, truths: DataFrame) -> DataFrame:
    """One row per reported confidence that any prediction reaches."""
    n_truth = truths.agg(F.count("*")).scalar()
    at_least = F.filter(F.array(*[F.lit(c) for c in CONFIDENCES]), lambda c: F.col("conf") >= c)
    # Each prediction counts at every reported confidence below its own; the explode is bounded by the ten of them.
    per = matched.groupBy("conf").agg(F.count("*").alias("_n"), F.count("truth_no").alias("_tp"))
    hits = per.withColumn("_t", F.explode(at_least)).groupBy(F.col("_t").alias("conf")).agg(F.sum("_n").alias("n_pred"), F.sum("_tp").alias("tp"))
    return scores(hits, n_truth)


def best_f1(matched: DataFrame, truths: DataFrame) -> DataFrame:
    """The confidence with the highest F1 (the highest of equals), and the recall when every prediction counts."""
    n_truth = truths.agg(F.count("*")).scalar()
    s = scores(by_confidence(matched), n_truth)
    best = F.struct("f1", "conf")
    return s.agg(
        *[F.max_by(c, best).alias(c) for c in ("conf", "precision", "recall", "f1", "count_ratio")], F.max("recall").alias("recall_ceiling")
    )
