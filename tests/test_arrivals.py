"""Streams: detections in micro-batches, one of them run again; folders that are still being copied."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.streaming.detections import DetectionStore

ROWS = "detection_id bigint, image_id bigint, batch_id int, created_at timestamp, keep_aside boolean, mask_key string, bbox_x int, bbox_y int, bbox_w int, bbox_h int, polygon string"
FIXES = "image_id bigint, batch_id int, mask_key string, bbox_x int, bbox_y int, bbox_w int, bbox_h int, polygon string, geom_edited boolean, bind string"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def arrival(detection, image, minute, boxes, batch=1, aside=False):
    rows = [(detection, image, batch, at(minute), aside, "_".join(map(str, b)), *b, f"outline of {detection}") for b in boxes]
    return rows or [(detection, image, batch, at(minute), aside, None, None, None, None, None, None)]


PARTS = [
    arrival(1, 7, 1, [(0, 0, 20, 20), (50, 50, 20, 20)]) + arrival(2, 8, 1, [(5, 5, 10, 10)]) + arrival(1, 7, 1, [(0, 0, 20, 20)]),
    arrival(3, 7, 2, [(1, 0, 20, 20), (50, 50, 20, 20)]) + arrival(4, 7, 2, [(9, 9, 9, 9)], batch=2) + arrival(5, 8, 2, []),
    arrival(6, 7, 0, [(0, 0, 20, 20)]) + arrival(8, 8, 9, [(5, 5, 10, 10)], aside=True),  # late, and kept aside
]


def fixes(spark):
    return spark.createDataFrame(
        [(7, 1, "0_0_20_20", 0, 0, 20, 20, "mine", False, "exact"), (7, 1, "50_50_20_20", 50, 50, 20, 20, None, False, "exact"), (8, 1, "5_5_10_10", 5, 5, 10, 10, "edited", True, "exact"),
         (7, 2, "300_300_9_9", 300, 300, 9, 9, "lost", False, "exact")], FIXES)


def state(store):
    found = {r["detection_id"]: (r["is_current"], r["superseded_by"]) for r in store.detections().collect()}
    bound = {(r["image_id"], r["batch_id"], r["review_key"]): (r["candidate_key"], r["method"], r["detection_id"], r["polygon"]) for r in store.bindings().collect()}
    ledger = {tuple(r[c] for c in ("arrived", "n_detections", "n_candidates", "n_bound")) for r in store.ledger().collect()}
    return found, bound, ledger


@pytest.fixture(scope="module")
def once(spark, tmp_path_factory):
    store = DetectionStore(spark, str(tmp_path_factory.mktemp("once")))
    for n, part in enumerate(PARTS):
        store.save(spark.createDataFrame(part, ROWS), n, fixes(spark))
    return state(store)


def test_arrivals_one_after_the_other(once):
    found, bound, ledger = once
    assert found == {1: (False, 3), 2: (False, 5), 3: (True, None), 4: (True, None), 5: (True, None), 6: (False, 1), 8: (False, None)}
    assert bound == {
        (7, 1, "0_0_20_20"): ("1_0_20_20", "iou", 3, "mine"), (7, 1, "50_50_20_20"): ("50_50_20_20", "exact", 3, "outline of 3"),
        (8, 1, "5_5_10_10"): (None, "orphan", 5, "edited"), (7, 2, "300_300_9_9"): (None, "orphan", 4, "lost"),
    }
    assert ledger == {(0, 2, 3, 3), (1, 3, 3, 4), (2, 2, 2, 0)}


def test_a_micro_batch_run_again_changes_nothing(spark, once, tmp_path):
    store = DetectionStore(spark, str(tmp_path))
    for n, part in enumerate(PARTS):
        df = spark.createDataFrame(part, ROWS)
        if n == 1:  # lost before its ledger row: invisible, then run again
            store._put("detections", n, df.select("detection_id", "image_id", "batch_id", "created_at", "keep_aside").distinct())
            assert {r["detection_id"] for r in store.detections().collect()} == {1, 2}
            store.save(df, n, fixes(spark))
        store.save(df, n, fixes(spark))
    assert state(store) == once


# folders


def look(folder, minute, files, size, event):
    return (folder, at(minute), event, files, files, size)


SEEN = "folder_id bigint, seen_at timestamp, event_id bigint, n_files int, n_sidecars int, n_bytes bigint"


def watched(spark, tmp_path, parts):
    from tallyscope.streaming import folders as fo

    for n, part in enumerate(parts):
        spark.createDataFrame(part, SEEN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={n}")
    stream = spark.readStream.schema(SEEN + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("part")
    return fo.run_to_end(fo.watch(stream, forget=False), spark).collect()


def test_a_growing_copy_never_rings_and_a_still_folder_rings_without_being_seen_again(spark, tmp_path):
    parts, event = [], 0
    for start in range(0, 30, 5):
        part = []
        for minute in range(start, start + 5):
            part.append(look(1, minute, 3, 1000 + minute, event))  # same number of files, more bytes each minute
            if minute < 2:
                part.append(look(2, minute, 4, 4000, event + 1))  # never seen again
            part.append(look(3, minute, 0, 0, event + 2))  # empty
            event += 3
        parts.append(part)
    rang = [r for r in watched(spark, tmp_path, parts) if r["rang"]]
    assert [(r["folder_id"], r["since"]) for r in rang] == [(2, at(0))]


def test_spells_of_a_finished_table(spark):
    from tallyscope.streaming import folders as fo

    rows = [look(1, 0, 2, 5, 1), look(1, 3, 2, 6, 2), look(1, 8, 2, 6, 3), look(1, 9, 2, 7, 4), look(2, 0, 0, 0, 5), look(2, 9, 0, 0, 6)]
    found = fo.spells(spark.createDataFrame(rows, SEEN)).orderBy("since").collect()
    assert [(r["folder_id"], r["since"]) for r in found] == [(1, at(3)), (1, at(9))]


def test_bytes_belong_to_the_signature(spark):
    from tallyscope.streaming import folders as fo

    rows = [look(1, m, 3, 10 + m, m) for m in range(20)]
    state = fo.settled(spark.createDataFrame(rows, SEEN)).select(fo.folder_state(F.lit(False))).first()[0]
    assert state == "copying"
