"""Detections as they arrive: stored, made current for their image and batch, and the corrections of people bound to them.

Nothing that was written is written again. Each micro-batch has a part of its own in every table and, written last, a row
in the ledger; parts without that row are not there for any reader. A micro-batch that is run again, after a loss or by
a restart, overwrites its own part and reads only what earlier ones left, so the tables come out the same.

Which detection is current, and by which one the others were replaced, follows from the parts when they are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.operators.review import latest_per_image, rebind_reviews
from tallyscope.session import cut

SCOPE = ["image_id", "batch_id"]
DETECTION = ["detection_id", *SCOPE, "created_at", "keep_aside"]
GEOMETRY = ["mask_key", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "polygon"]
PART = "arrived"


class DetectionStore:
    """Tables ``detections``, ``candidates``, ``bindings`` and ``ledger`` below a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def ledger(self, before: int | None = None) -> DataFrame | None:
        """The micro-batches that are complete: arrived, n_detections, n_candidates, n_bound."""
        done = self._read("ledger")
        return done if done is None or before is None else done.filter(F.col(PART) < before)

    def _committed(self, name: str, before: int | None) -> DataFrame | None:
        rows, done = self._read(name), self.ledger(before)
        return None if rows is None or done is None else rows.join(done.select(PART), PART, "left_semi")

    def detections(self, before: int | None = None) -> DataFrame | None:
        """All detections with ``is_current`` and ``superseded_by``: per image and batch the newest one is current, those
        kept aside neither become current nor replace anything."""
        rows = self._committed("detections", before)
        if rows is None:
            return None
        # A detection sent twice counts once, as it came first.
        cols = [c for c in rows.columns if c != "detection_id"]
        rows = rows.groupBy("detection_id").agg(F.min_by(F.struct(*cols), PART).alias("_d")).select("detection_id", "_d.*")
        runs = Window.partitionBy(*SCOPE, "keep_aside").orderBy("created_at", "detection_id")  # the runs over one image: a few
        following = F.lead("detection_id").over(runs)
        return rows.withColumn("superseded_by", F.when(~F.col("keep_aside"), following)).withColumn("is_current", F.col("superseded_by").isNull() & ~F.col("keep_aside"))

    def candidates(self, before: int | None = None) -> DataFrame | None:
        return self._committed("candidates", before)

    def bindings(self, before: int | None = None) -> DataFrame | None:
        """The binding of each correction that the last detection of its image and batch gave."""
        rows = self._committed("bindings", before)
        if rows is None:
            return None
        cols = [c for c in rows.columns if c not in (*SCOPE, "review_key")]
        last = rows.groupBy(*SCOPE, "review_key").agg(F.max_by(F.struct(*cols), PART).alias("_b"))
        return last.select(*SCOPE, "review_key", *[F.col(f"_b.{c}").alias(c) for c in cols])

    def save(self, arrivals: DataFrame, number: int, corrections: DataFrame) -> None:
        """One micro-batch: ``arrivals`` has a row per candidate (columns of DETECTION and GEOMETRY; a detection without
        candidates has one row with a null mask_key). Of equal keys in a detection one stays."""
        arrivals = arrivals.persist()  # read for two tables
        detections = arrivals.groupBy("detection_id").agg(F.min(F.struct(*[c for c in DETECTION if c != "detection_id"])).alias("_d")).select("detection_id", "_d.*")
        rest = [c for c in GEOMETRY if c != "mask_key"]
        candidates = arrivals.filter("mask_key is not null").groupBy("detection_id", *SCOPE, "mask_key").agg(F.min(F.struct(*rest)).alias("_c"))
        candidates = candidates.select("detection_id", *SCOPE, "mask_key", *[F.col(f"_c.{c}").alias(c) for c in rest])
        self._put("detections", number, detections)
        self._put("candidates", number, candidates)
        arrivals.unpersist()
        bound = self._bind(self._part("detections", number), self._part("candidates", number), number, corrections)
        self._put("bindings", number, bound)
        tables = {"detections": "n_detections", "candidates": "n_candidates", "bindings": "n_bound"}
        parts = [self._part(t, number).select(*(F.lit(int(t == other)).alias(n) for other, n in tables.items())) for t in tables]
        self._put("ledger", number, reduce(DataFrame.unionByName, parts).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in tables.values())))

    def _put(self, name: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/{PART}={number}")

    def _part(self, name: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{PART}={number}")

    def _bind(self, detections: DataFrame, candidates: DataFrame, number: int, corrections: DataFrame) -> DataFrame:
        """Corrections of the images whose newest detection came with this micro-batch, bound to its candidates. A
        correction brings the outline it was made on; the bound row carries the one it has now."""
        newest = latest_per_image(detections.filter("not keep_aside").select(*SCOPE, "detection_id", "created_at"), SCOPE)
        held = self.detections(number)
        if held is not None:
            old = latest_per_image(held.filter("not keep_aside").select(*SCOPE, "detection_id", "created_at"), SCOPE).select(*SCOPE, F.struct("created_at", "detection_id").alias("_old"))
            newest = newest.join(old, SCOPE, "left").filter(F.col("_old").isNull() | (F.struct("created_at", "detection_id") > F.col("_old"))).drop("_old")
        # Cut once: binding reads corrections and candidates several times. Candidates of images nobody corrected bind nothing.
        newest = cut(newest)
        r = cut(corrections.join(newest.select(*SCOPE), SCOPE, "left_semi"))
        corrected = newest.join(r.select(*SCOPE).distinct(), SCOPE, "left_semi")
        c = cut(candidates.join(corrected.select("detection_id"), "detection_id", "left_semi"))
        bound = rebind_reviews(r, c.select(*SCOPE, *GEOMETRY)).join(newest.select(*SCOPE, "detection_id"), SCOPE)
        box = F.array(*(f"bbox_{s}" for s in "xywh"))
        theirs = c.select(*SCOPE, F.col("mask_key").alias("candidate_key"), F.struct(box.alias("bbox"), "polygon").alias("_theirs"))
        own = r.select(*SCOPE, F.col("mask_key").alias("review_key"), F.struct(box.alias("bbox"), "polygon").alias("_own"), F.coalesce("geom_edited", F.lit(False)).alias("_edited"))
        full = bound.join(theirs, [*SCOPE, "candidate_key"], "left").join(own, [*SCOPE, "review_key"])
        # An outline drawn or edited by a person stays; one that is missing is taken from the candidate.
        use_own = F.col("_edited") | F.col("_theirs").isNull() | F.col("_own.polygon").isNotNull() & (F.col("method") != "exact")
        shape = F.when(use_own, F.col("_own")).otherwise(F.col("_theirs"))
        return full.select(*SCOPE, "review_key", "candidate_key", "method", "score", "detection_id", shape["bbox"].alias("bbox"), shape["polygon"].alias("polygon"))

    def sink(self, corrections: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``; ``corrections`` gives the corrections as they are when the micro-batch runs."""
        return lambda arrivals, number: self.save(arrivals, number, corrections())


def run_detections(stream: DataFrame, store: DetectionStore, corrections: Callable[[], DataFrame], checkpoint: str) -> None:
    """Everything there is now, in as many micro-batches as the source makes of it."""
    stream.writeStream.foreachBatch(store.sink(corrections)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
