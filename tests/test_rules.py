"""Edge cases as small literal tables, and ordered choices against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.functions import labels, naming, polygon
from tallyscope.functions.boxes import Box, bbox_iou, key_to_bbox
from tallyscope.operators import greedy, pixels, series, shapes, verdict
from tallyscope.operators.review import rebind_reviews
from tallyscope.operators.sequence import Blocks, ranges
from tallyscope.operators.spatial import centre_in_box, touching

BASE = dict(shape_ok=True, major_um=50.0, texture=2000.0, elongation=1.1, ellipse_iou=0.9, solidity=0.95)


def verdicts(spark, rows):
    full = [{**BASE, **r, "n": i} for i, r in enumerate(rows)]
    schema = "n int, shape_ok boolean, major_um double, texture double, elongation double, ellipse_iou double, solidity double"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in full], schema)
    return [(r.cls, r.reject) for r in verdict.classify(df).orderBy("n").collect()]


def test_first_failing_gate(spark):
    got = verdicts(
        spark,
        [
            {},
            {"shape_ok": False, "major_um": 1.0},
            {"shape_ok": None},
            {"major_um": 9.9, "texture": 1.0},
            {"major_um": 10.0},
            {"major_um": 150.0},
            {"major_um": None},
            {"texture": 999.0},
            {"texture": 1000.0},
            {"texture": 1500.0},
            {"texture": None},
            {"elongation": 1.4},
            {"elongation": 2.0},
            {"elongation": 20.0},
            {"elongation": 20.1},
            {"elongation": 3.0, "ellipse_iou": 0.71},
            {"solidity": 0.91},
        ],
    )
    assert got == [
        ("round", ""),
        ("", "shape_unmeasurable"),
        ("", "shape_unmeasurable"),
        ("", "major_out_of_range"),
        ("round", ""),
        ("round", ""),
        ("round", ""),
        ("", "texture_low"),
        ("", "round_areolae_low"),
        ("round", ""),
        ("round", ""),
        ("", "elongation_gap"),
        ("rod", ""),
        ("rod", ""),
        ("", "elongation_gap"),
        ("", "rod_criteria"),
        ("", "round_criteria"),
    ]


def test_areolae_gate_off_at_zero(spark):
    df = spark.createDataFrame([(True, 50.0, 1200.0, 1.1, 0.9, 0.95)], "shape_ok boolean, major_um double, texture double, elongation double, ellipse_iou double, solidity double")
    assert verdict.classify(df, verdict.Thresholds(round_texture_min=0.0)).first().cls == "round"


def masks(spark, rows):
    """(no, x, y, w, h, area, texture) in one detection, all good rods."""
    data = [(1, n, x, y, w, h, a, t, True, 50.0, 3.0, 0.9, 0.95) for n, x, y, w, h, a, t in rows]
    return spark.createDataFrame(
        data, "detection_id bigint, candidate_no bigint, bbox_x int, bbox_y int, bbox_w int, bbox_h int, area_px bigint, texture double, shape_ok boolean, major_um double, elongation double, ellipse_iou double, solidity double"
    )


def kept(spark, rows):
    return {r.candidate_no for r in verdict.judge(verdict.collapse_boxes(masks(spark, rows))).filter("passed").collect()}


def test_overlaps(spark):
    # One child does not drop a parent, two small ones do not, two large ones do.
    assert kept(spark, [(1, 0, 0, 100, 100, 9000, 2000.0), (2, 5, 5, 60, 60, 3000, 2000.0)]) == {1, 2}
    assert kept(spark, [(1, 0, 0, 100, 100, 9000, 2000.0), (2, 5, 5, 20, 20, 300, 2000.0), (3, 50, 50, 20, 20, 300, 2000.0)]) == {1, 2, 3}
    assert kept(spark, [(1, 0, 0, 100, 100, 9000, 2000.0), (2, 0, 0, 48, 98, 4000, 2000.0), (3, 50, 0, 48, 98, 4000, 2000.0)]) == {2, 3}
    # Near-equal masks keep the stronger texture; equal boxes the larger area, then the first.
    assert kept(spark, [(1, 0, 0, 50, 50, 2000, 1800.0), (2, 1, 1, 50, 50, 2000, 2500.0)]) == {2}
    assert kept(spark, [(1, 0, 0, 50, 50, 2000, 2000.0), (2, 0, 0, 50, 50, 2100, 1000.0)]) == {2}
    assert kept(spark, [(2, 0, 0, 50, 50, 2000, 2000.0), (1, 0, 0, 50, 50, 2000, 3000.0)]) == {1}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_greedy_drop_matches_a_loop(spark, limit):
    rnd = random.Random(3)
    edges = {(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(150)) if a < b}
    gone = set()
    for n in range(60):
        if any(a not in gone for a, b in edges if b == n):
            gone.add(n)
    df = spark.createDataFrame([(1, a, b, b) for a, b in edges], "g int, winner int, loser int, loser_rank int")
    assert {r.node for r in greedy.dropped_by_earlier(df, ["g"], limit).collect()} == gone


@pytest.mark.parametrize("limit", [0, 10_000])
def test_greedy_matching_matches_a_loop(spark, limit):
    rnd = random.Random(4)
    edges = sorted({(rnd.randrange(20), rnd.randrange(30), rnd.randrange(30)) for _ in range(200)})
    left, right, want = set(), set(), set()
    for o, a, b in edges:
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    df = spark.createDataFrame([(1, *e) for e in edges], "g int, o int, a int, b int")
    assert {(r.a, r.b) for r in greedy.greedy_matching(df, ["g"], "a", "b", ["o"], limit).collect()} == want


def boxes(rnd, n):
    return [(i, rnd.randrange(300), rnd.randrange(300), rnd.choice([1, 5, 17, 40, 130]), rnd.choice([1, 6, 20, 45, 120])) for i in range(n)]


def test_grid_joins_find_exactly_the_pairs(spark):
    rnd = random.Random(5)
    a, b = boxes(rnd, 120), boxes(rnd, 120)
    left = spark.createDataFrame([(1, *r) for r in a], "g int, a_no int, a_x int, a_y int, a_w int, a_h int")
    right = spark.createDataFrame([(1, *r) for r in b], "g int, b_no int, b_x int, b_y int, b_w int, b_h int")
    got = sorted((r.a_no, r.b_no) for r in touching(left, right, ["g"], Box.of("a_"), Box.of("b_"), 64).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if max(p[1], q[1]) <= min(p[1] + p[3], q[1] + q[3]) and max(p[2], q[2]) <= min(p[2] + p[4], q[2] + q[4]))
    assert got == want
    inside = sorted((r.a_no, r.b_no) for r in centre_in_box(left, right, ["g"], Box.of("a_"), Box.of("b_"), 64, any_larger=True).filter("greatest(b_w, b_h) >= greatest(a_w, a_h)").collect())
    centre = lambda p: (p[1] + p[3] / 2, p[2] + p[4] / 2)
    assert inside == sorted(
        (p[0], q[0]) for p in a for q in b
        if max(q[3], q[4]) >= max(p[3], p[4]) and q[1] <= centre(p)[0] <= q[1] + q[3] and q[2] <= centre(p)[1] <= q[2] + q[4]
    )


def test_blocks_do_not_change_results(spark):
    rows = [(k, i, (i * 7 + k) % 5 if (i * 7 + k) % 3 else None) for k in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    b = Blocks(["k"], [ranges("i", 7)], ["i"])
    got = b.carry(b.running_sum(b.row_number(b.previous(df, {"v": "p"}), "rn"), "s", F.col("v")), "c", F.col("v")).toPandas().sort_values(["k", "i"])
    for _, g in got.groupby("k"):
        v = g.v.astype(float)
        assert list(g.rn) == list(range(1, 51))
        assert list(g.s) == list(v.fillna(0).cumsum())
        pd.testing.assert_series_equal(g.c.astype(float), v.ffill(), check_names=False)
        pd.testing.assert_series_equal(g.p.astype(float), v.shift(), check_names=False)


def test_rebinding(spark):
    r = spark.createDataFrame(
        [(1, 1, "0_0_10_10", 0, 0, 10, 10, "exact"), (1, 1, "1_0_10_10", 1, 0, 10, 10, "exact"), (1, 1, "50_50_9_9", 50, 50, 9, 9, "manual"), (1, 1, "90_90_5_5", None, None, None, None, "exact"), (1, 1, "30_0_10_10", 30, 0, 10, 10, "exact")],
        "image_id int, batch_id int, mask_key string, bbox_x int, bbox_y int, bbox_w int, bbox_h int, bind string",
    )
    c = spark.createDataFrame([(1, 1, "2_0_10_10", 2, 0, 10, 10), (1, 1, "30_0_10_20", 30, 0, 10, 20), (1, 1, "90_90_5_5", 90, 90, 5, 5)], "image_id int, batch_id int, mask_key string, bbox_x int, bbox_y int, bbox_w int, bbox_h int")
    got = {x.review_key: (x.method, x.candidate_key, x.score) for x in rebind_reviews(r, c).collect()}
    assert got["1_0_10_10"] == ("iou", "2_0_10_10", 90 / 110)
    assert got["0_0_10_10"] == ("orphan", None, None)
    assert got["50_50_9_9"][0] == "manual"
    assert got["90_90_5_5"] == ("exact", "90_90_5_5", 1.0)
    assert got["30_0_10_10"] == ("iou", "30_0_10_20", 0.5)


def test_folder_names(spark):
    df = spark.createDataFrame([("RS23-GC03 71cm (1)",), ("rs23-gc03 71.5 cm",), ("BP09-0901",), ("BP09-77",), ("holiday",)], "f string")
    rows = [tuple(r.p) for r in df.select(naming.parse_folder(F.col("f")).alias("p")).collect()]
    assert rows == [
        ("RS23", "GC03", "core", "71cm", 71.0, None, 1),
        ("RS23", "GC03", "core", "71.5cm", 71.5, None, 0),
        ("BP", "BP09", "outcrop", "0901", None, 1, 0),
        ("BP", "BP09", "outcrop", "77", None, 77, 0),
        (None, None, None, None, None, None, 0),
    ]


def test_catalogue_numbers(spark):
    df = spark.createDataFrame([("RS23", "GC-03", "71cm", 7, "1_2_3_4", 1, 2, "y1", False), ("RS23", "지점", "71", 7, "1_2_3_4", 0, None, "Y", False), ("A", "B", "9", 123, "m0000beef", 0, None, "", True), ("A", "B", "9", 1, "1_2_3_4", 0, None, "", False)], "s string, l string, c string, v int, k string, o int, f int, b string, d boolean")
    made = df.select(naming.catalog_no(*[F.col(x) for x in "slcvkofbd"]).alias("n")).select("n.*")
    assert [tuple(r) for r in made.collect()] == [("RS23-GC03-071-1-g07-f02-1_2_3_4-Y1", ""), (None, "locality"), ("A-B-009-g123-m0000beef-M", ""), (None, "batch")]
    back = spark.createDataFrame([("rs23-gc03-071-1-g07-f02-1_2_3_4-y1",)], "t string").select(naming.parse_catalog_no(F.col("t")).alias("p")).first().p
    assert (back.site, back.obs_no, back.viewpoint, back.frame_seq, back.mask_key, back.batch_code) == ("RS23", 1, 7, 2, "1_2_3_4", "Y1")


def test_keys_and_labels(spark):
    df = spark.createDataFrame([("1_2_3_4",), ("m0000beef",), ("-1_2_3_4",)], "k string")
    assert [r.b for r in df.select(key_to_bbox(F.col("k")).alias("b")).collect()] == [[1, 2, 3, 4], None, [-1, 2, 3, 4]]
    b = spark.createDataFrame([(-5, 0, 15, 10), (99, 0, 5, 5)], "bbox_x int, bbox_y int, bbox_w int, bbox_h int")
    assert [r.l for r in b.select(labels.bbox_label(Box.of(), F.lit(100), F.lit(100), F.lit(2)).alias("l")).collect()] == ["2 0.050000 0.050000 0.100000 0.100000", None]
    iou = b.select(bbox_iou(Box.of(), Box(F.lit(0), F.lit(0), F.lit(10), F.lit(10))).alias("i")).collect()
    assert [round(r.i, 6) for r in iou] == [round(100 / 150, 6), 0.0]


def test_retention_over_a_week_that_straddles_two_months(spark):
    stamps = ["2024-05-31 10:00:00", "2024-05-30 10:00:00", "2024-05-06 10:00:00", "2024-05-02 10:00:00", "2024-04-30 10:00:00", "2024-04-29 09:00:00", "2024-03-01 00:00:00", None]
    df = spark.createDataFrame(list(enumerate(stamps)), "snapshot_id bigint, s string").withColumn("stamp", F.to_timestamp("s"))
    keep = {r.snapshot_id for r in series.tiered_retention(df, "2024-06-01 00:00:00").filter("keep").collect()}
    # 2 stands for its week; 3 for the week of 30 April too, so April keeps its own newest beyond it only if older than a month.
    assert {0, 1, 2, 3, 6, 7} <= keep and 5 not in keep


def test_separability_needs_both_sides(spark):
    rows = [(1, 0.9, False), (1, 0.8, False), (2, 0.9, False), (2, 0.5, True), (3, 0.6, False), (3, 0.7, True)]
    df = spark.createDataFrame(rows, "slide_id int, corr_prev double, is_break boolean").withColumn("has_prev", F.lit(True))
    got = {r.slide_id: (r.gap, r.overlap, r.margin) for r in series.separability(df).collect()}
    assert got == {1: (None, None, None), 2: (0.4, 0, 0.05), 3: (-0.1, 2, -0.15)}


def test_measures_of_a_square_and_of_nothing(spark):
    df = spark.createDataFrame([([0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0],), ([0.0, 0.0, 1.0, 1.0],), (None,)], "polygon array<double>")
    rows = shapes.measure_polygons(df, "polygon", F.lit(0.5)).collect()
    assert (rows[0].area_px, rows[0].solidity, rows[0].convexity, rows[0].elongation, rows[0].area_um2) == (100, 1.0, 1.0, 1.0, 25.0)
    assert rows[1].area_px is None and rows[2].ellipse_iou is None
    assert df.select(polygon.polygon_area(F.col("polygon")).alias("a")).first().a == 100.0


def clipped(p, corners):
    for a, b in zip(corners, np.roll(corners, -1, axis=0)):
        d = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
        out = []
        for i in range(len(p)):
            if (d[i] >= 0) != (d[i - 1] >= 0):
                out.append(p[i - 1] + d[i - 1] / (d[i - 1] - d[i]) * (p[i] - p[i - 1]))
            if d[i] >= 0:
                out.append(p[i])
        p = np.array(out).reshape(-1, 2)
    x, y = p.T
    return abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2 if len(p) else 0.0


def test_overlap_with_the_ellipse_matches_clipping():
    rng = np.random.default_rng(1)
    t = np.arange(72) * 2 * np.pi / 72
    ring = np.stack([np.cos(t), np.sin(t)], axis=1)
    for _ in range(60):
        n = rng.integers(3, 15)
        ang, r = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.2, 2.5, n)
        p = np.stack([r * np.cos(ang), r * np.sin(ang)], axis=1) + rng.uniform(-0.7, 0.7, 2)
        got = shapes._signed(np.hstack([p, np.roll(p, -1, axis=0)]), np.zeros(n, int), 1)[0]
        assert abs(abs(got) - clipped(p, ring)) < 1e-12


def test_texture_and_sharpness(spark):
    x = np.arange(32)
    stripes = (128 + 100 * np.sin(2 * np.pi * x / 8))[None, :] * np.ones((32, 1))
    noise = np.random.default_rng(0).normal(128, 10, (32, 32))
    rows = [(i, [float(v) for v in img.ravel()], [True] * 1024, 32, 0.1) for i, img in enumerate((stripes, noise))]
    rows.append((2, [1.0] * 64, [True] * 64, 8, 0.1))
    df = spark.createDataFrame(rows, "i int, gray array<double>, mask array<boolean>, width int, um_per_px double")
    score = {r.i: r.texture for r in pixels.texture_score(df, ["i"]).collect()}
    assert score[0] > 1000 > 100 > score[1] > 0 and score[2] == 0
    sharp = {r.i: r.sharpness for r in pixels.image_sharpness(df, ["i"]).collect()}
    p = np.pad(noise, 1, mode="reflect")
    lap = sum(p[1 + a : 33 + a, 1 + b : 33 + b] for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))) - 4 * noise
    assert abs(sharp[1] - lap.var()) < 1e-6 and sharp[2] == 0


def test_name_in_context(spark):
    from tallyscope.operators.names import name_in_context

    text = "Hauptfelder. Navicula lata, Grunow. Auch mit Surirella ovata, und (dort auch, Synedra acuta, Ehr.) gehoert. Eine magna Form; N. minuta, K. Pinnularia nobilis."
    names = ["Navicula lata", "Surirella ovata", "Synedra acuta", "Navicula magna", "Navicula minuta", "Pinnularia nobiliana", "Cymbella nulla"]
    t = spark.createDataFrame([(1, text)], "d int, text string")
    n = spark.createDataFrame([(1, x) for x in names], "d int, name string")
    got = {r.name: r.place for r in name_in_context(n, t, ["d"]).collect()}
    assert got == {
        "Navicula lata": "named", "Surirella ovata": "prose", "Synedra acuta": "parentheses", "Navicula magna": "prose",
        "Navicula minuta": "named", "Pinnularia nobiliana": "spelling", "Cymbella nulla": "absent",
    }


def test_projections_hit_their_origins(spark):
    from tallyscope.functions.projection import project_epsg3031, project_epsg5179

    df = spark.createDataFrame([(38.0, 127.5, -90.0)], "lat double, lon double, pole double")
    x, y = project_epsg5179(F.col("lat"), F.col("lon"))
    px, py = project_epsg3031(F.col("pole"), F.col("lon"))
    r = df.select(x.alias("x"), y.alias("y"), px.alias("px"), py.alias("py")).first()
    assert abs(r.x - 1_000_000) < 1e-6 and abs(r.y + 2_000_000) < 1e-6 and abs(r.px) < 1e-6 and abs(r.py) < 1e-6


def test_files_round_trip(spark, tmp_path):
    import hashlib

    from tallyscope.operators.exports import file_hashes
    from tallyscope.sources import loaders as ld

    (tmp_path / "a.series.csv").write_text("key,label,unit,default_on,sort_order,origin\nms,MS,SI,true,10,x\n")
    (tmp_path / "a.points.csv").write_text("key,depth_mm,value\nms,10,1.5\nwc,20,2\n")
    s, p = ld.read_core_csv(spark, str(tmp_path / "a.series.csv"), str(tmp_path / "a.points.csv"))
    one = lambda d: d.withColumn("locality_id", F.lit(1))
    old = spark.createDataFrame([(1, "ms", 5, 9.0, "manual"), (1, "ms", 6, 9.0, "import")], "locality_id int, key string, depth_mm int, value double, source string")
    new, stray = ld.load_core_series(one(s), one(p), old)
    assert {(r.depth_mm, r.source) for r in new.collect()} == {(5, "manual"), (10, "import")} and [r.key for r in stray.collect()] == ["wc"]
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in file_hashes(spark, str(tmp_path)).collect()}
    assert got["a.points.csv"] == hashlib.sha256((tmp_path / "a.points.csv").read_bytes()).hexdigest()


def test_ingest_is_exactly_once(spark, tmp_path):
    from tallyscope.streaming.folders import ingest_batch

    sink = ingest_batch(str(tmp_path / "slides"))
    states = spark.createDataFrame([(1, "new"), (2, "copying"), (3, "new")], "folder_id bigint, state string")
    sink(states, 0)
    sink(states, 0)
    sink(states.withColumn("state", F.lit("new")), 1)
    rows = spark.read.parquet(str(tmp_path / "slides")).collect()
    assert sorted(r.folder_id for r in rows) == [1, 2, 3]
