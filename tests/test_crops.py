"""Crops of polygons measured by batches."""

from pyspark.sql import functions as F


def test_crops_of_all_kinds_of_polygons(spark):
    from tallyscope.functions import polygon as pg
    from tallyscope.operators.shapes import crop_geometry

    shapes = [
        [0.0, 0.0, 9.0, 1.0, 30.0, 12.0, 8.0, 7.0], [0.0, 0.0, 4.0, 0.0, 4.0, 44.0, 0.0, 44.0], [1.0, 1.0, 2.0, 2.0, 3.0, 3.0], [5.0, 5.0, 90.0, 8.0, 40.0, 31.0, 77.0],
        [0.0, 0.0, 50.0, None, 3.0, 9.0], [1.0, 2.0, 3.0, 4.0], None, [0.0, 0.0, 20.0, 0.0, 20.0, 20.0, 0.0, 20.0]]
    df = spark.createDataFrame(list(enumerate(shapes)), "id int, p array<double>")
    e = df.withColumn("_edges", F.when(pg.is_polygon(F.col("p")), pg.edges(F.col("p")))).withColumn("_sums", pg.moment_sums(F.col("_edges")))
    e = e.withColumn("rot", pg.upright_angle(pg.fit_ellipse(pg.polygon_moments(F.col("_sums")))))
    e = e.withColumn("c", pg.crop_size(pg.rotated_extent(F.col("p"), F.col("rot"))))
    want = [(r.id, round(r.rot, 9), r.c.out_w, r.c.out_h) for r in e.orderBy("id").collect()]
    assert [(r.id, round(r.rot, 9), r.out_w, r.out_h) for r in crop_geometry(df, "p").orderBy("id").collect()] == want
    assert "ArrowEvalPython" in crop_geometry(df, "p")._jdf.queryExecution().executedPlan().toString()
