"""What leaves the system: review documents, training labels, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.boxes import Box
from tallyscope.functions.labels import bbox_label
from tallyscope.operators.sequence import Blocks

# Objects in one part of a review document. A larger image is written in several parts, none is cut short.
PART_SIZE = 5000
FORMAT = 4


def _parts(rows: DataFrame, keys: list[str], spread: Column, size: int) -> DataFrame:
    """Add ``part``: rows of a key fall into as many parts as its count needs, by hash."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(float(size))).alias("_parts"))
    return rows.join(n, keys).withColumn("part", F.pmod(F.xxhash64(spread), F.col("_parts"))).drop("_parts")


def export_reviews(corrections: DataFrame, objects: DataFrame, detections: DataFrame, size: int = PART_SIZE) -> DataFrame:
    """Review documents as JSON lines: one per image and batch with its objects sorted by key, one per viewpoint with its links.

    Viewpoints without judgements give none. ``part`` counts up where an image or a viewpoint holds more rows than fit.
    """
    kinds = detections.groupBy("image_id").agg(F.min("image_kind").alias("image_kind"))
    r = corrections.join(objects.select("object_id", "label", "species", "grade", "pose", "note"), "object_id", "left").join(kinds, "image_id")
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    flag = lambda c: F.when(F.col(c), F.lit(True)).alias(c)
    entry = F.struct(
        F.col("mask_key").alias("key"), flag("removed"), flag("accepted"), blank("label"), blank("note"), F.col("bind"), blank("species"), blank("grade"), blank("pose"),
        F.array("bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("bbox"),
    )
    keys = ["viewpoint_id", "image_id", "image_kind", "batch_id"]
    cut = _parts(r.withColumn("batch_id", F.coalesce("batch_id", F.lit(0))), keys, F.col("mask_key"), size)
    images = cut.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(entry)).alias("objects"))
    image_doc = F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.col("image_id").alias("image"), F.col("image_kind").alias("kind"), F.col("batch_id").alias("batch"), F.size("objects").alias("n_objects"), "objects"))
    out = images.select("viewpoint_id", "image_id", F.lit("objects").alias("what"), "part", image_doc.alias("doc"))
    several = corrections.groupBy("object_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    members = _parts(corrections.join(several.select("object_id"), "object_id"), ["viewpoint_id"], F.col("object_id"), size)
    member = F.struct("object_id", F.col("image_id").alias("image"), F.col("mask_key").alias("key"), F.col("is_rep").alias("rep"))
    links = members.groupBy("viewpoint_id", "part").agg(F.array_sort(F.collect_list(member)).alias("members"))
    link_doc = F.to_json(F.struct(F.lit(FORMAT).alias("format"), "viewpoint_id", F.size("members").alias("n_members"), "members"))
    return out.unionByName(links.select("viewpoint_id", F.lit(None).cast("bigint").alias("image_id"), F.lit("links").alias("what"), "part", link_doc.alias("doc")))


def write_reviews(docs: DataFrame, path: str, buckets: int = 256) -> None:
    docs.withColumn("bucket", F.pmod(F.col("viewpoint_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(path)


def split_train_val(viewpoints: DataFrame, val_share: float, seed: int, holdout: str | None = None) -> DataFrame:
    """Per slide, the first ``round(n * share)`` viewpoints in hash order go to val, the others to train; one slide is held out.

    ``viewpoints``: viewpoint_id, slide_id, slug. Hash order replaces a shuffle: it is the same on every cluster.
    """
    held = F.lit(False) if holdout is None else F.col("slug") == holdout
    v = viewpoints.select("viewpoint_id", "slide_id", "slug", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("viewpoint_id").cast("string")), 256).alias("_h"))
    rank = Blocks(["slide_id"], [(F.substring("_h", 1, 2), True)], ["_h"]).row_number(v, "_k")
    n = v.groupBy("slide_id").agg(F.rint(F.count("*") * F.lit(float(val_share))).alias("_val"))
    j = rank.join(n, "slide_id")
    return j.select("viewpoint_id", "slide_id", F.when(held, "val_slide").when(F.col("_k") <= F.col("_val"), "val").otherwise("train").alias("split"))


def export_labels(kept: DataFrame, splits: DataFrame, classes: DataFrame, width: int, height: int) -> DataFrame:
    """Label lines of kept objects in done viewpoints, one row each; a viewpoint without any gives one blank line.

    ``kept``: viewpoint_id, image_id, cls, bbox_*. Class numbers follow the order of the vocabulary; objects of no known
    class or too small for a label are counted as ``dropped``.
    """
    # The vocabulary is a dimension of a few rows, ordered by a total order.
    numbers = classes.select(F.col("class_key").alias("cls"), (F.col("sort_order") - 1).alias("_no"))
    k = kept.join(F.broadcast(numbers), "cls", "left").withColumn("line", F.when(F.col("_no").isNotNull(), bbox_label(Box.of(), F.lit(width), F.lit(height), F.col("_no"))))
    rows = splits.join(k, "viewpoint_id", "left").select("split", "viewpoint_id", "image_id", "cls", F.coalesce("line", F.lit("")).alias("line"), (F.col("cls").isNotNull() & F.col("line").isNull()).alias("dropped"))
    return rows


def label_manifest(lines: DataFrame) -> DataFrame:
    """Counts per split and class, per split, and overall (``level`` 0, 1, 3)."""
    good = F.col("line") != ""
    return lines.withColumn("cls", F.coalesce("cls", F.lit(""))).rollup("split", "cls").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count_if(good).alias("n_lines"), F.count_if("dropped").alias("n_dropped"), F.count_distinct("viewpoint_id").alias("n_viewpoints")
    )


def write_labels(lines: DataFrame, path: str) -> None:
    lines.filter("NOT dropped").select("split", "viewpoint_id", "line").write.mode("overwrite").partitionBy("split").json(path)


def content_hashes(texts: DataFrame, keep: list[str], content: str) -> DataFrame:
    return texts.select(*keep, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return content_hashes(files, ["path", "length"], "content")
