"""What is shown is decided per detection, and a page reads stored rows."""

from tallyscope.operators import review as rv
from tallyscope.operators.overlay import overlaid, review_overlay, reviewing
from tallyscope.plans.all import QUERIES
from tallyscope.sources.model import Model

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def same(a, b) -> bool:
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_the_catalogue_lays_over_once(spark):
    m = Model(spark, SMALL)
    gone, kept = plan(QUERIES["catalog_rows_gone"](m)), plan(QUERIES["catalog_rows"](m))
    assert gone.count("FullOuter") == 0 and kept.count("FullOuter") == 1


def test_gone_rows_follow_from_the_removals(spark):
    m = Model(spark, SMALL)
    given = m.stored, reviewing(m.detection, m.batch), m.correction, m.object
    assert same(review_overlay(*given, gone_only=True), review_overlay(*given).filter("state = 'gone'"))


def test_shown_detections_are_those_of_the_shown_rows(spark):
    m = Model(spark, SMALL)
    # Some images without masks, some without corrections, some with neither.
    candidates, said = m.stored.filter("detection_id % 3 <> 0"), m.correction.filter("image_id % 4 <> 0")
    det = reviewing(m.detection, m.batch)
    rows = review_overlay(candidates, det, said, m.object)
    shown = rv.shown_images(overlaid(candidates, det, said))
    assert same(review_overlay(candidates, shown, said, m.object), rv.shown_images(rows).select(*rows.columns))
    assert same(overlaid(candidates, det, said).select("detection_id"), rows.select("detection_id").distinct())


def test_a_page_and_its_total_read_stored_rows(spark):
    text = plan(QUERIES["paged_detections"](Model(spark, SMALL)))
    assert "l_orderkey" not in text and "object_id" not in text


def test_large_detections_are_numbered_alike(spark):
    from tallyscope.operators.overlay import ranked

    m = Model(spark, SMALL)
    rows = review_overlay(m.stored, reviewing(m.detection, m.batch), m.correction, m.object).select("detection_id", "mask_key", "state", "area_px")
    plain = ranked(rows)
    assert plain.filter("rank > 0").count() and all(same(plain, ranked(rows, large=n)) for n in (0, 2))


def test_the_overlay_is_laid_once_for_its_ranks(spark):
    text = plan(QUERIES["review_overlay"](Model(spark, SMALL)))
    assert "l_orderkey" not in text and "Join" not in text


def test_an_outline_is_read_once(spark):
    import time

    from pyspark.sql import functions as F

    m = Model(spark, SMALL)
    # Of 600 corners: read once it is a matter of milliseconds, read at every corner of minutes.
    corners = F.concat(F.lit("["), F.concat_ws(",", F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda i: i.cast("string"))), F.lit("]"))
    said = m.correction.limit(200).withColumn("polygon", corners)
    start = time.time()
    review_overlay(m.stored, reviewing(m.detection, m.batch), said, m.object).agg(F.sum("area_px")).collect()
    assert time.time() - start < 30
