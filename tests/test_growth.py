"""What grows with the input and what must not: rounds, scans, repeated work."""

from tallyscope.plans.all import QUERIES
from tallyscope.sources.model import Model
from tallyscope.streaming.detections import DetectionStore

SMALL = "/root/testdata/sf0.001"


def test_micro_batches_follow_the_parts_not_their_files(spark, monkeypatch):
    numbers, save = [], DetectionStore.save

    def counted(self, arrivals, number, corrections):
        numbers.append(number)
        save(self, arrivals, number, corrections)

    monkeypatch.setattr(DetectionStore, "save", counted)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # eight files for each part
    try:
        assert QUERIES["save_detection_batch_stream"](Model(spark, SMALL)).count() == 1500
    finally:
        spark.conf.unset(coalesce)
    assert numbers == [0, 1, 2]  # 1995 to 2001: three parts


def test_index_lines_are_read_twice_and_each_token_once(spark):
    from pyspark.sql import functions as F

    from tallyscope.sources import indexes as ix

    read = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert read(QUERIES["parse_index"](Model(spark, SMALL))).count("Relation [") == 2
    tokens = F.array(F.struct(F.lit("place").alias("kind"), F.lit(None).cast("string").alias("lead"), F.lit("Tafel 1 (Band7 PDF p.2/8)").alias("text")))
    assert str(ix.fold(tokens, "one_line")).count("regexp_extract(") == len(ix.PLACE_GROUPS["one_line"]) + 6


def test_the_overlay_is_not_shuffled_again_for_its_detections(spark):
    from tallyscope.plans.reviews import overlay

    plan = overlay(Model(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join FullOuter" in plan and "Join" not in plan[: plan.index("Join FullOuter")]


def test_corrections_are_made_once_for_all_their_readers(spark):
    m = Model(spark, SMALL)
    assert "Aggregate" not in m.correction._jdf.queryExecution().optimizedPlan().toString()
    assert m.correction.count() == m.correction.distinct().count() > 0


def test_settled_links_come_from_stored_masks_and_groups(spark):
    plan = QUERIES["settle_links"](Model(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    # Masks with their groups, stored judgements with theirs, less the masks: nothing is made anew at the end.
    assert plan.count("Relation [") == 5 and "Aggregate" not in plan and "Expand" not in plan


def test_judged_documents_are_parsed_once(spark):
    from tallyscope.plans.sources import detection_docs
    from tallyscope.sources.loaders import flatten_detections

    m = Model(spark, SMALL)
    read = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plan = read(flatten_detections(detection_docs(m)))
    assert read(flatten_detections(detection_docs(m), unnamed=False)).count("from_json(") * 2 == plan.count("from_json(") > 0
    assert "from_json(" not in read(QUERIES["load_detections_judged"](m))


def test_two_judgements_share_their_pairs(spark, monkeypatch):
    from tallyscope.operators import verdict

    asked, pairs = [], verdict.covered_pairs
    monkeypatch.setattr(verdict, "covered_pairs", lambda *a, **k: asked.append(1) or pairs(*a, **k))
    assert QUERIES["threshold_preview_keys"](Model(spark, SMALL)).count() > 0
    assert len(asked) == 1


def test_the_mixed_page_reads_stored_counts(spark):
    plan = QUERIES["most_affected_mixed"](Model(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_sets_side_by_side_are_the_judgements_alone(spark):
    from tallyscope.operators.verdict import Thresholds, judge, judge_each

    rows, other = Model(spark, SMALL).collapsed, Thresholds(texture_min=1600.0)
    both = judge_each(rows, {"was_": Thresholds(), "": other}, 128)
    key, cols = ["detection_id", "candidate_no"], ["passed", "cls", "reject"]
    for prefix, limits in (("was_", Thresholds()), ("", other)):
        alone = judge(rows, limits, 128).select(*key, *cols)
        assert sorted(map(tuple, both.select(*key, *[prefix + c for c in cols]).collect())) == sorted(map(tuple, alone.collect()))


def test_saved_rows_meet_their_scope_in_one_join(spark):
    lines = QUERIES["save_review"](Model(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(i for i, line in enumerate(lines) if "Join" in line)
    column = lines[top].index("Join")
    left = []
    for line in lines[top + 1 :]:
        if line[column] != ":":
            break
        left.append(line)
    assert left and not any("Join" in line for line in left)
