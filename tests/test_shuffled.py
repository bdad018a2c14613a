"""Bytes a query puts through shuffles, on small tables: what must stay where it is does."""

import random


def shuffled(spark, build) -> int:
    """Bytes written for shuffles while ``build`` makes a DataFrame and all its rows are read."""
    gw, none = spark.sparkContext._gateway, spark._jvm.java.util.ArrayList()

    def total() -> int:
        stages = spark._jsc.sc().statusStore().stageList(none, False, False, gw.new_array(gw.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    build().write.format("noop").mode("overwrite").save()
    return total() - before


def test_words_of_a_text_stay_with_it(spark):
    from tallyscope.operators.names import name_in_context

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(d, " ".join(word() for _ in range(4000)) + " Navicula lata, Grunow") for d in range(4)]
    texts = spark.createDataFrame(rows, "d int, text string")
    claims = spark.createDataFrame([(d, "Navicula lata") for d in range(4)], "d int, name string")
    assert {r.place for r in name_in_context(claims, texts, ["d"]).collect()} == {"named"}
    size = sum(len(t) for _, t in rows)
    assert shuffled(spark, lambda: name_in_context(claims, texts, ["d"])) < 1.1 * size


def test_wide_rows_stay_when_equal_boxes_are_rare(spark):
    from pyspark.sql import functions as F

    from tallyscope.operators.verdict import collapse_boxes

    box = [F.col("id").alias("bbox_x"), F.lit(1).alias("bbox_y"), F.lit(2).alias("bbox_w"), F.lit(3).alias("bbox_h")]
    key = F.concat(*[F.sha2(F.concat("id", F.lit(str(i))).cast("string"), 512) for i in range(4)]).alias("mask_key")
    rows = spark.range(5000).select((F.col("id") % 50).alias("detection_id"), F.col("id").alias("candidate_no"), *box, F.lit(9).alias("area_px"), key)
    rows = rows.unionByName(rows.filter("candidate_no < 3").withColumn("candidate_no", F.col("candidate_no") + 9000).withColumn("area_px", F.col("candidate_no").cast("int") % 2 * 5 + 7))
    got = {r.candidate_no for r in collapse_boxes(rows).filter("bbox_x < 3").collect()}
    assert collapse_boxes(rows).count() == 5000 and got == {0, 9001, 2}
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table were large
    try:
        assert shuffled(spark, lambda: collapse_boxes(rows)) < 5000 * 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_corrections_are_made_distinct_by_their_boxes(spark):
    from tallyscope.sources.model import VIEWS, Model

    m = Model(spark, "/root/testdata/sf0.001")
    plain = spark.sql(VIEWS["correction"], candidate=m.candidate, orders=m.orders)
    assert m.correction.schema == plain.schema
    assert m.correction.exceptAll(plain).isEmpty() and plain.exceptAll(m.correction).isEmpty()
    assert shuffled(spark, lambda: Model(spark, m.folder).correction) < shuffled(spark, lambda: plain) / 2
