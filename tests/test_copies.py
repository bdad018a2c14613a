"""Two copies of a table meet in one shuffle."""

from tallyscope.plans.all import QUERIES
from tallyscope.sources.model import Model

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_two_copies_are_shuffled_once(spark):
    text = plan(QUERIES["reconcile_rows"](Model(spark, SMALL)))
    assert "l_orderkey" not in text and "Join FullOuter" not in text.split("Union")[0]


def test_keys_that_repeat_count_once(spark):
    from tallyscope.operators.reconcile import differing_rows

    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "n"), (4, "only")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x"), (2, "now"), (None, "n"), (5, "new"), (5, "new")], "k int, v string")
    got = {(r.k, r.status, r.columns) for r in differing_rows(a, b, ["k"], ["v"], 8, once=True).collect()}
    assert got == {(2, "changed", "v"), (4, "only_a", ""), (5, "only_b", "")}
