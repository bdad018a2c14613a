"""Inputs on which a limit or a value of the test tables once changed the answer."""

from pyspark.sql import functions as F

from tallyscope.operators import merge, names, review, rollup, shapes
from tallyscope.sources import loaders


def test_prefix_of_a_long_path(spark):
    path = "photos/" + "x" * 5000
    df = spark.createDataFrame([(path,), ("other/" + path,)], "path string")
    got = [r["path"] for r in merge.swap_prefix(df, "path", "photos/", "archive/photos/").collect()]
    assert got == ["archive/" + path, "other/" + path]


def test_rebind_below_half(spark):
    box = "bbox_x int, bbox_y int, bbox_w int, bbox_h int"
    old = spark.createDataFrame([(1, 1, "a", "exact", 0, 0, 10, 10)], f"image_id bigint, batch_id int, mask_key string, bind string, {box}")
    new = spark.createDataFrame([(1, 1, "b", 0, 0, 5, 5)], f"image_id bigint, batch_id int, mask_key string, {box}")
    assert [(r["method"], r["score"]) for r in review.rebind_reviews(old, new, iou_min=0.2).collect()] == [("iou", 0.25)]
    assert [r["method"] for r in review.rebind_reviews(old, new).collect()] == ["orphan"]


def test_recipe_keeps_all_keys(spark):
    params = '{"scale":"1.0","points_per_side":"48","min_um":"10","max_um":"150","all_images":"yes","weights":"w","other":"no"}'
    runs = spark.createDataFrame([(1, 7, "box", "2024-01-01", params)], "batch_id int, run_id bigint, backend string, started_at string, params string")
    assert merge.backfill_recipes(runs).first()["recipe"] == "all_images=yes max_um=150 min_um=10 points_per_side=48 scale=1.0 weights=w"


def test_lookup_ranks_are_the_callers(spark):
    rows = [("n", "found", "short", 1), ("n", "missing", "a longer text", 2)]
    df = spark.createDataFrame(rows, "name string, state string, text string, seq bigint")
    assert merge.merge_lookup_batches(df, {"found": 2, "missing": 1}).first()["state"] == "found"
    assert merge.merge_lookup_batches(df, {"missing": 1}).first()["state"] == "missing"


def test_taxa_without_a_class(spark):
    taxa = spark.createDataFrame([(1, "A b", "C", None), (2, "P", None, "P"), (3, "X y", "D", "Q")], "taxon_id int, name string, class string, phylum string")
    profile = spark.createDataFrame([(1, True)], "taxon_id int, is_marine boolean")
    assert sorted(r["taxon_id"] for r in names.load_taxa(taxa, profile, ["C"], ["P"]).collect()) == [1, 2]


def test_any_area(spark):
    got = rollup.area_tabs(spark.createDataFrame([("reef",), ("reef",), (None,)], "area string")).collect()
    assert sorted((r["area"] or "", r["level"], r["n_slides"]) for r in got) == [("", 0, 1), ("", 1, 3), ("reef", 0, 2)]


def test_sides_are_not_rounded(spark):
    row = [(1, "0_0_20_20", 0, 0, 20, 20, 60, [1.7, 2.6, 11.5, 2.6, 11.5, 9.9, 1.7, 9.9])]
    df = spark.createDataFrame(row, "detection_id int, mask_key string, bbox_x int, bbox_y int, bbox_w int, bbox_h int, area_px int, polygon array<double>")
    got = shapes.tighten_boxes(df, F.lit(1.0)).first()
    assert (got["new_key"], got["long_side_um"], got["short_side_um"]) == ("2_3_10_7", 9.8, 7.3)


def test_several_places_in_a_line(spark):
    text = ["## A", "***Name one*** Author", "<sub>pl. 5 fig. 1 · PDF p.11 · pl. 7 fig. 2 · PDF p.12</sub>", "***Name two***", "<sub>no plate</sub>"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc string, line_no int, line string")
    got = [(r["name"], r["plate"], r["page"]) for r in loaders.parse_index_entries(lines, "starred").orderBy("line_no", "plate").collect()]
    assert got == [("Name one", 5, 11), ("Name one", 7, 12), ("Name two", None, None)]


def test_short_epithets_and_far_brackets(spark):
    text = "Here stands Ditylium soluta Grun. in print (and " + "very " * 25 + "late Ditylium brevis Ehr.)"
    texts = spark.createDataFrame([(1, text)], "doc_id int, text string")
    claims = spark.createDataFrame([(1, "Ditylium sol"), (1, "Ditylium brevis"), (1, "Ditylium nothing")], "doc_id int, name string")
    got = {r["name"]: r["place"] for r in names.name_in_context(claims, texts, ["doc_id"]).collect()}
    assert got == {"Ditylium sol": "spelling", "Ditylium brevis": "parentheses", "Ditylium nothing": "absent"}


def test_initials_are_read_as_the_sql_reads_them(spark, tmp_path):
    from harness import problems
    import duckdb

    from tallyscope.plans.all import ORACLES, QUERIES

    # A hyphen or another letter after the epithet, a mark before the initial, two hits side by side, other blanks, none.
    texts = ["A. abcd- x", "A. wohl- x", "A. abcdñ", "A. abcdé́", "éA. abcd", "A. abcd-B. efgh", "A.\xa0abcd", "A.\x0babcd", "A. nicht", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert problems(spark, con, str(tmp_path), QUERIES["initial_abbreviations"], ORACLES["initial_abbreviations"]) == ("", 6)
