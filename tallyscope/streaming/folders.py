"""Folders that fill up while they are watched: when one has been still long enough, its slide is taken in, once.

The stream keeps one small state per folder and a timer: a folder rings when its signature (files, side files and bytes)
has held for long enough, also if nobody looks at it again. ``settled`` and ``spells`` are the same rules over a finished
table of observations.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyscope.operators.sequence import Blocks
from tallyscope.session import use_shared_checkpoints

# Functions of this module travel to the workers whole, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Minutes without change that make a folder new, minutes its newest file must be old, days until a vanished
# folder is forgotten.
STABLE_MIN, QUIET_MIN, FORGET_DAYS = 5.0, 1.0, 30
STATE = "signature STRING, since TIMESTAMP, last_seen TIMESTAMP, n_files INT, newest TIMESTAMP"
OUT = "folder_id BIGINT, signature STRING, since TIMESTAMP, last_seen TIMESTAMP, n_files INT, rang BOOLEAN"


def signature() -> Column:
    """What must hold still: a growing copy of an unchanged number of files has other bytes."""
    return F.concat_ws(":", *(F.col(c).cast("string") for c in ("n_files", "n_sidecars", "n_bytes")))


def folder_state(known: Column, quiet_min: Column | None = None, stable_min: float = STABLE_MIN) -> Column:
    """empty, known, copying or new, from n_files, since and last_seen."""
    still = (F.unix_micros("last_seen") - F.unix_micros("since")) / 6e7
    fresh = F.lit(False) if quiet_min is None else F.coalesce(quiet_min < QUIET_MIN, F.lit(False))
    return F.when(F.col("n_files") == 0, "empty").when(known, "known").when((still < stable_min) | fresh, "copying").otherwise("new")


def settled(seen: DataFrame) -> DataFrame:
    """Last signature of every folder and since when it holds: folder_id, signature, since, last_seen, n_files.

    ``seen``: folder_id, seen_at, event_id, n_files, n_sidecars, n_bytes. A change is a row whose signature differs from the one
    before; the last change is where the signature began to hold.
    """
    rows = seen.withColumn("signature", signature())
    # A day of observations is one block, so a folder watched for years is not one task.
    order = Blocks(["folder_id"], [(F.to_date("seen_at"), True)], ["seen_at", "event_id"])
    steps = order.previous(rows, {"signature": "_before"})
    changed = ~F.col("signature").eqNullSafe(F.col("_before"))
    last = F.struct("seen_at", "event_id")
    return steps.groupBy("folder_id").agg(
        F.max_by("signature", last).alias("signature"), F.max(F.when(changed, F.col("seen_at"))).alias("since"), F.max("seen_at").alias("last_seen"), F.max_by("n_files", last).alias("n_files")
    )


def spells(seen: DataFrame, stable_min: float = STABLE_MIN) -> DataFrame:
    """Every spell of a folder with files whose signature held for ``stable_min`` minutes: folder_id, signature, since.

    A spell ends with the first other signature; the last one has no end and counts.
    """
    rows = seen.withColumn("signature", signature())
    order = Blocks(["folder_id"], [(F.to_date("seen_at"), True)], ["seen_at", "event_id"])
    starts = order.previous(rows, {"signature": "_before"}).filter(~F.col("signature").eqNullSafe(F.col("_before")))
    ends = order.following(starts, {"seen_at": "_until"})
    held = F.col("_until").isNull() | (F.unix_micros("_until") - F.unix_micros("seen_at") >= stable_min * 6e7)
    return ends.filter(held & (F.col("n_files") > 0)).select("folder_id", "signature", F.col("seen_at").alias("since"))


class FolderWatch(StatefulProcessor):
    """Holds signature and since per folder, and one timer. With ``forget``, a folder not seen for a month is dropped by
    its TTL, and timers go by the clock; else by the watermark of ``seen_at``."""

    def __init__(self, forget: bool, stable_min: float = STABLE_MIN, quiet_min: float = QUIET_MIN):
        self.ttl = FORGET_DAYS * 86_400_000 if forget else None
        self.clock, self.stable, self.quiet = forget, pd.Timedelta(minutes=stable_min), pd.Timedelta(minutes=quiet_min)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("folder", STATE, self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Of each chunk only the columns of the rule are held; a micro-batch has a handful of observations of a folder.
        seen: list[tuple] = []
        for part in rows:
            newest = part["newest"] if "newest" in part else part["seen_at"]
            seen += zip(part["seen_at"], part["event_id"], part["signature"], part["n_files"], newest)
        held = self.state.get() if self.state.exists() else (None, None, None, 0, None)
        sig, since, last, n, newest = held
        for at, _, s, files, touched in sorted(seen, key=lambda r: r[:2]):
            if s != sig:
                sig, since = s, at
            last, n, newest = at, int(files), touched
        self.state.update((sig, since, last, n, newest))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if n > 0:
            due = max(since + self.stable, newest + self.quiet if newest < last else since + self.stable)
            now = timerValues.getCurrentProcessingTimeInMs() if self.clock else timerValues.getCurrentWatermarkInMs()
            self.handle.registerTimer(max(int(pd.Timestamp(due).timestamp() * 1000), now + 1))
        yield self.row(key, sig, since, last, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            sig, since, last, n, _ = self.state.get()
            yield self.row(key, sig, since, last, n, True)

    @staticmethod
    def row(key: tuple, sig: str, since: object, last: object, n: int, rang: bool) -> pd.DataFrame:
        return pd.DataFrame({"folder_id": [key[0]], "signature": [sig], "since": [since], "last_seen": [last], "n_files": [n], "rang": [rang]})

    def close(self) -> None:
        pass


def watch(observations: DataFrame, forget: bool = True, late: str = "0 seconds") -> DataFrame:
    """A stream of observations to a stream of folder states: one row per folder and micro-batch, and one with ``rang``
    when a folder has been still for long enough, whether or not it was looked at again.

    Forgetting needs processing time, and with it a query has work to do at every trigger: a stream that is to end once
    its input is read must not forget; its timers go by ``seen_at``, of which none comes later than ``late``.
    """
    keyed = observations.withColumn("signature", signature())
    if not forget:
        keyed = keyed.withWatermark("seen_at", late)
    return keyed.groupBy("folder_id").transformWithStateInPandas(FolderWatch(forget), OUT, "update", "ProcessingTime" if forget else "EventTime")


def run_to_end(stream: DataFrame, spark: SparkSession, mode: str = "update") -> DataFrame:
    """Run a stream over everything there is now, into a table in the shared checkpoint folder, and read that table."""
    use_shared_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # Each micro-batch overwrites its own part, so a batch that is run again leaves no doubles.
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{base}/checkpoint")
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/table/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{base}/table")


def latest(states: DataFrame) -> DataFrame:
    """The last state of every folder out of the table a stream wrote."""
    cols = ["signature", "since", "last_seen", "n_files"]
    picked = states.groupBy("folder_id").agg(F.max_by(F.struct(*cols), F.struct("last_seen", "batch")).alias("_s"))
    return picked.select("folder_id", *[F.col(f"_s.{c}").alias(c) for c in cols])


def missing_sidecars(seen: DataFrame) -> DataFrame:
    return seen.filter(F.col("n_sidecars") < F.col("n_files"))


def ingest_new(states: DataFrame, slides: DataFrame) -> DataFrame:
    """New folders that are no slides yet, as pending slides. Safe to repeat: a slide that exists is not made again."""
    fresh = states.filter("state = 'new'").select("folder_id").distinct()
    return fresh.join(slides.select("folder_id"), "folder_id", "left_anti").withColumn("state", F.lit("pending"))


def ingest_batch(table: str):
    """``foreachBatch`` sink that appends new folders to a Parquet table of slides, exactly once per folder."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            # What this very batch wrote before a restart does not count as known, so it is written again in full.
            slides = spark.read.parquet(table).filter(F.col("batch") != number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            slides = batch.select("folder_id").limit(0)
        ingest_new(batch, slides).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return sink


def slide_state(slides: DataFrame, viewpoints: DataFrame, detections: DataFrame) -> DataFrame:
    """Slides after processing: done when every viewpoint has a current detection; failed ones and those without viewpoints stay."""
    has = detections.filter("is_current").select("viewpoint_id").distinct().withColumn("_has", F.lit(True))
    v = viewpoints.join(has, "viewpoint_id", "left").groupBy("slide_id").agg(F.count("*").alias("_n"), F.count_if(F.col("_has").isNull()).alias("n_missing"))
    j = slides.select("slide_id", "state").join(v, "slide_id", "left").withColumnRenamed("state", "was")
    new = F.when((F.col("was") == "failed") | F.col("_n").isNull(), F.col("was")).when(F.col("n_missing") > 0, "processing").otherwise("done")
    return j.select("slide_id", "was", new.alias("state"), F.coalesce("n_missing", F.lit(0)).cast("bigint").alias("n_missing"))
