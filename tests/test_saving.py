"""Saving a review: scopes, kept rows, refusals, confirmation, drawings, and the stored table."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import saving

EXISTING = "image_id bigint, viewpoint_id bigint, batch_id int, mask_key string, object_id bigint, removed boolean, accepted boolean, auto_confirmed boolean, geom_edited boolean, outline string, bind string"
SAVES = "image_id bigint, batch_id int, viewpoint_id bigint, knows_edits boolean, done boolean"
PAYLOAD = "image_id bigint, batch_id int, mask_key string, removed boolean, accepted boolean, label string, outline string"
CANDIDATES = "image_id bigint, viewpoint_id bigint, batch_id int, mask_key string, passed boolean, outline string"
OBJECTS = "object_id bigint, label string, species string, grade string, pose string, note string"


def row(key, obj, image=1, batch=1, removed=False, accepted=False, confirmed=False, edited=False, outline="e", bind="exact"):
    return (image, 10, batch, key, obj, removed, accepted, confirmed, edited, outline, bind)


@pytest.fixture(scope="module")
def save(spark):
    def run(existing, saves, payload, candidates, objects=()):
        got = saving.save_review(
            spark.createDataFrame(list(existing), EXISTING), spark.createDataFrame(list(saves), SAVES), spark.createDataFrame(list(payload), PAYLOAD),
            spark.createDataFrame(list(candidates), CANDIDATES), spark.createDataFrame(list(objects), OBJECTS))
        return {(r["image_id"], r["batch_id"], r["mask_key"]): r.asDict() for r in got.collect()}

    return run


SEEN = [(1, 10, 1, k, k != "low", f"c-{k}") for k in ("a", "b", "c", "d", "e", "f", "low")]


def test_rows_the_sender_cannot_know_stay(save):
    existing = [
        row("a", 1), row("b", 2, edited=True, outline="mine"), row("c", 3), row("d", 4, confirmed=True), row("e", 5), row("f", 5, image=2), row("gone", 6),
        row("a", 7, batch=2, removed=True), row("m1", 8, batch=None),
    ]
    objects = [(1, "rod", "", "", "", ""), (2, "", "", "", "", ""), (3, "", "", "", "", "a note")]
    got = save(existing, [(1, 1, 10, False, False)], [], SEEN, objects)
    what = {k[2]: v["what"] for k, v in got.items() if k[:2] == (1, 1)}
    # Edited by another screen, annotated, confirmed, and one of two rows of an object.
    assert what == {"a": "delete", "b": "same", "c": "same", "d": "same", "e": "same", "gone": "delete"}
    assert all(k[:2] == (1, 1) for k in got)  # neither the other batch nor the drawing nor the other image


def test_a_sender_of_edits_speaks_for_all_of_them(save):
    existing = [row("a", 1, edited=True, outline="mine"), row("b", 2, edited=True, outline="mine"), row("c", 3, edited=True, outline="mine")]
    sent = [(1, 1, "a", False, False, None, "new"), (1, 1, "b", False, False, None, "")]
    got = save(existing, [(1, 1, 10, True, False)], sent, SEEN)
    assert got[1, 1, "a"]["outline"] == "new" and got[1, 1, "a"]["geom_edited"] and got[1, 1, "a"]["what"] == "update"
    assert got[1, 1, "b"]["outline"] == "c-b" and not got[1, 1, "b"]["geom_edited"]
    assert got[1, 1, "c"]["what"] == "delete"


def test_refused_as_a_whole(save):
    existing = [row("a", 1), row("old", 2, bind="orphan")]
    sent = [(1, 1, "a", True, False, None, None), (1, 1, "never", True, False, None, None)]
    got = save(existing, [(1, 1, 10, True, True)], sent, SEEN)
    assert {k[2]: (v["what"], v["why"], v["removed"], v["auto_confirmed"]) for k, v in got.items()} == {
        "a": ("refused", "unknown key", False, False), "old": ("refused", "unknown key", False, False)}
    # A stored key without a detection is known, but has no outline to go back to.
    got = save(existing, [(1, 1, 10, True, False)], [(1, 1, "old", False, False, None, "")], SEEN)
    assert {v["why"] for v in got.values()} == {"no outline to go back to"}
    assert save(existing, [(1, 1, 10, True, False)], [(1, 1, "old", True, False, None, None)], SEEN)[1, 1, "old"]["what"] == "update"


def test_done_confirms_what_is_kept_in_the_whole_viewpoint(save):
    seen = SEEN + [(2, 10, 1, "x", True, "c-x"), (2, 10, 1, "y", False, "c-y"), (3, 11, 1, "z", True, "c-z"), (2, 10, 2, "x", True, "c-x")]
    sent = [(1, 1, "a", True, False, None, None), (1, 1, "low", False, True, "rod", None)]
    got = save([row("b", 1, image=2, removed=True)], [(1, 1, 10, True, True)], sent, seen)
    signed = {k for k, v in got.items() if v["auto_confirmed"]}
    assert signed == {(1, 1, k) for k in ("b", "c", "d", "e", "f", "low")} | {(2, 1, "x")}
    assert got[1, 1, "low"]["label"] == "rod" and got[1, 1, "b"]["what"] == "insert" and got[1, 1, "b"]["outline"] == "c-b"


def test_null_and_empty_inputs(save):
    assert save([], [], [], []) == {}
    assert save([row("a", None, outline=None)], [(1, 1, 10, None, None)], [(1, 1, "a", None, None, None, None)], SEEN)[1, 1, "a"]["what"] == "delete"


def test_relabelled_objects(spark):
    existing = [row("a", 1), row("b", 2)]
    tables = (spark.createDataFrame(existing, EXISTING), spark.createDataFrame([(1, 1, 10, True, False)], SAVES),
              spark.createDataFrame([(1, 1, "a", True, False, "rod", None), (1, 1, "b", True, False, None, None)], PAYLOAD), spark.createDataFrame(SEEN, CANDIDATES))
    objects = spark.createDataFrame([(1, "", "", "", "", ""), (2, "round", "", "", "", "")], OBJECTS)
    assert {tuple(r) for r in saving.relabelled(saving.save_review(*tables, objects), objects).collect()} == {(1, "rod"), (2, "")}


def test_stored_table_changes_only_where_a_save_spoke(spark, tmp_path):
    path = str(tmp_path / "reviews")

    def put(saves, payload):
        like = spark.createDataFrame([], EXISTING)
        held = saving.table_or_none(like, path)
        existing = like if held is None else saving.stored(like, path).withColumn("viewpoint_id", F.lit(10)).select(*like.columns)
        changes = saving.save_review(existing, spark.createDataFrame(saves, SAVES), spark.createDataFrame(payload, PAYLOAD),
                                     spark.createDataFrame(SEEN + [(1, 10, 2, k, p, o) for _, _, _, k, p, o in SEEN], CANDIDATES), spark.createDataFrame([], OBJECTS))
        saving.store(changes, path)
        return {(r["image_id"], r["batch_id"], r["mask_key"], r["removed"]) for r in saving.stored(like, path).collect()}

    def files(batch):
        return {(f, os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/batch_id={batch}/**/*.parquet", recursive=True)}

    first = put([(1, 1, 10, True, False), (1, 2, 10, True, False)], [(1, 1, "a", True, False, None, None), (1, 2, "b", True, False, None, None)])
    assert first == {(1, 1, "a", True), (1, 2, "b", True)}
    other = files(2)
    assert put([(1, 1, 10, True, False)], [(1, 1, "c", False, True, None, None)]) == {(1, 1, "c", False), (1, 2, "b", True)}
    assert put([(1, 1, 10, True, False)], [(1, 1, "c", False, True, None, None)]) == {(1, 1, "c", False), (1, 2, "b", True)}  # again
    assert put([(1, 1, 10, True, False)], []) == {(1, 2, "b", True)}  # a partition without rows
    assert files(2) == other


def test_few_saves_and_many_say_the_same(spark):
    from tallyscope.plans.merges import review_tables
    from tallyscope.sources.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    tables = review_tables(m)
    few, many = (sorted(map(str, saving.save_review(*tables, m.object, few=n).collect())) for n in (saving.FEW, 0))
    assert few == many and len(few) > 1000


def test_wide_rows_travel_once_to_their_viewpoint(spark):
    from test_shuffled import shuffled

    outline = F.concat(*[F.sha2(F.concat("id", F.lit(str(i))).cast("string"), 512) for i in range(6)])
    seen = spark.range(4000).select((F.col("id") % 200).alias("image_id"), (F.col("id") % 100).alias("viewpoint_id"), F.lit(1).alias("batch_id"),
                                    F.col("id").cast("string").alias("mask_key"), F.lit(True).alias("passed"), outline.alias("outline"))
    saves = spark.range(200).select(F.col("id").alias("image_id"), F.lit(1).alias("batch_id"), (F.col("id") % 100).alias("viewpoint_id"), F.lit(True).alias("knows_edits"), F.lit(True).alias("done"))
    empty = [spark.createDataFrame([], s) for s in (EXISTING, PAYLOAD, OBJECTS)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        size = shuffled(spark, lambda: seen.repartition("viewpoint_id"))
        assert shuffled(spark, lambda: saving.save_review(empty[0], saves, empty[1], seen, empty[2])) < 1.3 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
