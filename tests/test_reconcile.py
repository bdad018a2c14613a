"""Copies of a table: checksums that no order changes, and rows only where they differ."""

from pyspark.sql import functions as F

from tallyscope.operators.reconcile import checksums, differing_buckets, differing_rows


def test_rows_that_differ(spark):
    kind = "k int, x string, y double"
    a = [(i, f"v{i}", float(i)) for i in range(200)] + [(None, None, 1.0), (500, "twice", 0.0), (500, "twice", 0.0), (600, "a", 1.0), (600, "b", 2.0)]
    b = [(i, f"v{i}", float(i)) for i in range(1, 200) if i != 7] + [(7, None, 7.0), (900, "new", 0.0), (None, None, 2.0), (500, "twice", 0.0), (600, "a", 2.0), (600, "b", 1.0)]
    left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    for buckets in (1, 16, 4096):
        found = {r["k"]: (r["status"], r["columns"]) for r in differing_rows(left, right, ["k"], ["x", "y"], buckets).collect()}
        assert {k: v for k, v in found.items() if k != 600} == {0: ("only_a", ""), 7: ("changed", "x"), 900: ("only_b", ""), None: ("changed", "y"), 500: ("repeated", "")}
        assert found[600][0] == "changed"
    assert differing_rows(left, left.orderBy(F.rand(1)).repartition(5), ["k"], ["x", "y"]).collect() == []
    assert differing_rows(left.limit(0), right.limit(0), ["k"], ["x", "y"]).collect() == []


def test_only_the_buckets_of_a_change_are_looked_into(spark):
    a = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    b = a.withColumn("x", F.when(F.col("k") == 77, -1).otherwise(F.col("x")))
    assert differing_buckets(a, b, ["k"], ["x"], 256).count() == 1
    assert checksums(a, ["k"], ["x"], 256).count() == 256


def test_nulls_do_not_hide(spark):
    a = spark.createDataFrame([(1, None, "z")], "k int, x string, y string")
    b = spark.createDataFrame([(1, "z", None)], "k int, x string, y string")
    assert [(r["status"], r["columns"]) for r in differing_rows(a, b, ["k"], ["x", "y"]).collect()] == [("changed", "x,y")]
