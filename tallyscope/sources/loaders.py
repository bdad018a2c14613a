"""Readers for the side files of a review project: each gives a DataFrame of texts or rows, parsed by column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Schemas of the JSON documents, given so that no file is read twice for inference.
CANDIDATE_FIELDS = {
    "id": "bigint", "bbox_xywh": "array<double>", "center_xy": "array<double>", "area_px": "bigint", "shape_ok": "boolean", "polygon": "array<double>", "major_um": "double", "minor_um": "double",
    "texture": "double", "elongation": "double", "ellipse_iou": "double", "solidity": "double", "cls": "string", "reject": "string",
}
CANDIDATE_JSON = "struct<" + ",".join(f"{k}:{v}" for k, v in CANDIDATE_FIELDS.items()) + ">"
DETECTION_FIELDS = {
    "image": "string", "size": "array<int>", "scale": "double", "um_per_pixel": "double", "um_per_pixel_native": "double", "um_per_pixel_source": "string", "um_per_pixel_backfilled": "boolean",
    "n_raw_masks": "bigint", "n_sized": "bigint", "thresholds": "map<string,double>",
}
DETECTION_JSON = "struct<" + ",".join(f"{k}:{v}" for k, v in DETECTION_FIELDS.items()) + f",candidates:array<{CANDIDATE_JSON}>,rejected:array<{CANDIDATE_JSON}>>"
# The same document with every field as text, for the ones not named above.
OPEN_DETECTION_JSON = "struct<candidates:array<map<string,string>>,rejected:array<map<string,string>>>"
GROUPS_JSON = "struct<dir:string,corr_thresh:double,groups:array<struct<id:int,images:array<string>,n:int,sharpest:string,sharpness:map<string,double>,span_sec:double>>>"
STACKS_JSON = "array<struct<tag:string,n:int,um_per_pixel:double,gain:double>>"
OBJECT_FIELDS = {
    "key": "string", "removed": "boolean", "accepted": "boolean", "label": "string", "note": "string", "species": "string", "grade": "string", "pose": "string", "source": "string", "bind": "string", "bind_score": "double",
    "geom_edited": "boolean", "auto_confirmed": "boolean", "bbox": "array<double>", "polygon": "array<double>", "link": "bigint", "is_rep": "boolean",
}
OBJECT_JSON = "struct<" + ",".join(f"{k}:{v}" for k, v in OBJECT_FIELDS.items()) + ">"
REVIEWS_JSON = f"struct<slide:string,gid:bigint,tag:string,done:boolean,comment:string,images:array<struct<image:string,batch:string,objects:array<{OBJECT_JSON}>>>>"
OPEN_REVIEWS_JSON = "struct<images:array<struct<objects:array<map<string,string>>>>>"
PLACEMENT_JSON = "struct<plate:bigint,figures:string,pdf_page:bigint,volume:string,note:string>"
ATLAS_JSON = f"struct<atlas:struct<key:string,title:string>,entries:array<struct<seq:int,name:string,genus:string,binomial:string,placements:array<{PLACEMENT_JSON}>>>>"
# Scale metadata.
DEFAULT_UM_PER_PIXEL, ASSUMED_OBJECTIVE = 0.1126, 40.0
PLAUSIBLE = (0.001, 100.0)
SERIES_SCHEMA = "key STRING, label STRING, unit STRING, default_on BOOLEAN, sort_order INT, origin STRING"
POINTS_SCHEMA = "key STRING, depth_mm INT, value DOUBLE"


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_core_csv(spark: SparkSession, series_path: str, points_path: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.csv(series_path, header=True, schema=SERIES_SCHEMA),
        spark.read.csv(points_path, header=True, schema=POINTS_SCHEMA),
    )


def read_taxon_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep="\t")


def load_core_series(series: DataFrame, points: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new point table, points refused for want of a series).

    Imported rows of the stored table are replaced, manual ones stay; both tables carry locality_id and key.
    """
    ids = ["locality_id", "key"]
    stray = points.join(series.select(*ids), ids, "left_anti")
    fresh = points.join(series.select(*ids), ids, "left_semi").select(*ids, "depth_mm", "value", F.lit("import").alias("source"))
    manual = stored.filter("source = 'manual'").select(*ids, "depth_mm", "value", "source")
    return manual.unionByName(fresh), stray


def extract_core_blocks(sheet: DataFrame, keep: list[str], depth: str, unit: str, columns: dict[str, str]) -> DataFrame:
    """A wide sheet to long (key, depth_mm, value), with how often a point repeats and whether its values clash.

    ``columns`` maps sheet columns to series keys. Cells without a value give no point.
    """
    factor = 10 if unit == "cm" else 1
    pairs = ", ".join(f"'{key}', CAST({col} AS DOUBLE)" for col, key in columns.items())
    long = sheet.select(*keep, F.rint(F.col(depth) * factor).cast("int").alias("depth_mm"), F.expr(f"stack({len(columns)}, {pairs}) AS (key, value)"))
    g = long.filter("depth_mm IS NOT NULL AND value IS NOT NULL").groupBy(*keep, "key", "depth_mm")
    out = g.agg(F.min("value").alias("value"), F.count("*").alias("_n"), F.count_distinct("value").alias("_d"))
    return out.select(*keep, "key", "depth_mm", "value", (F.col("_n") - F.col("_d")).alias("n_same"), (F.col("_d") > 1).alias("clash"))


def plausible_depth(points: DataFrame, keep: list[str], expected_cm: Column) -> DataFrame:
    """Deepest point of each series, and whether it is within half and twice the expected length."""
    deep = points.groupBy(*keep, "key").agg((F.max("depth_mm") / 10.0).alias("deepest_cm"))
    return deep.withColumn("plausible", F.col("deepest_cm").between(expected_cm * 0.5, expected_cm * 2.0))


def parse_pasted_points(texts: DataFrame, keep: list[str]) -> DataFrame:
    """Pasted lines to points: keep, line_no, depth_mm, value, why ('' for a good line).

    Depth is in cm; fields part at tabs, commas, semicolons or blanks; blank and ``#`` lines do not count.
    """
    lines = texts.select(*keep, F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "_l")).withColumn("_l", F.trim("_l"))
    lines = lines.filter((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    f = F.filter(F.split("_l", r"[\t,;\s]+"), lambda t: t != "")
    cm, value = F.get("_f", F.lit(0)).try_cast("double"), F.get("_f", F.lit(1)).try_cast("double")
    why = F.when(F.size("_f") < 2, "two fields needed").when(cm.isNull() | value.isNull(), "not a number").when(cm < 0, "negative depth").otherwise("")
    p = lines.withColumn("_f", f).withColumn("why", why)
    good = F.col("why") == ""
    return p.select(*keep, "line_no", F.when(good, F.rint(cm * 10).cast("int")).alias("depth_mm"), F.when(good, value).alias("value"), "why")


def settle_points(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One point per depth: the first line wins; ``n_clash`` counts later lines with another value."""
    good = parsed.filter("why = ''")
    first = good.groupBy(*keep, "depth_mm").agg(F.min_by("value", "line_no").alias("_v"))
    j = good.join(first, [*keep, "depth_mm"])
    return j.groupBy(*keep, "depth_mm").agg(F.first("_v").alias("value"), F.count_if(F.col("value") != F.col("_v")).alias("n_clash"))


def preview_points(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What a load would do per series: new, overwritten, and (when the whole series is replaced) removed points."""
    a = stored.select(*keys, "depth_mm", F.lit(True).alias("_old"))
    b = new.select(*keys, "depth_mm", F.lit(True).alias("_new"))
    j = a.join(b, [*keys, "depth_mm"], "full_outer")
    old, fresh = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return j.groupBy(*keys).agg(F.count_if(fresh & ~old).alias("n_new"), F.count_if(fresh & old).alias("n_overwritten"), F.count_if(old & ~fresh).alias("n_removed"))


def upsert_points(stored: DataFrame, new: DataFrame, keys: list[str], replace: bool = False) -> DataFrame:
    """The point table after a load: same depths overwritten, or the touched series replaced as a whole."""
    on = keys if replace else [*keys, "depth_mm"]
    kept = stored.join(new.select(*on).distinct(), on, "left_anti")
    return kept.select(*keys, "depth_mm", "value").unionByName(new.select(*keys, "depth_mm", "value"))


def save_points(stored: DataFrame, new: DataFrame, series: DataFrame, keys: list[str], replace: bool = False) -> DataFrame:
    """What pasted points do to the table: keys, depth_mm, value, what (kept, inserted, overwritten, removed or refused)
    and why.

    A series is refused as a whole if it is unknown or imported (``series``: keys, origin), or if two different values are
    given for one depth; its stored points stay, its new ones are listed as refused. ``replace`` removes the points of the
    other depths of a series that takes points.
    """
    one = new.groupBy(*keys, "depth_mm").agg(F.min("value").alias("_new"), (F.min("value") < F.max("value")).alias("_clash"))
    kinds = series.groupBy(*keys).agg(F.max("origin").alias("_origin"))
    rules = one.groupBy(*keys).agg(F.max("_clash").alias("_clash")).join(kinds, keys, "left")
    why = F.when(F.col("_origin").isNull(), "unknown series").when(F.col("_origin") != "manual", "imported series").when(F.col("_clash"), "two values for one depth").otherwise("")
    rules = rules.select(*keys, why.alias("why"))
    sides = stored.select(*keys, "depth_mm", F.col("value").alias("_old"), F.lit(True).alias("_was")).unionByName(one.select(*keys, "depth_mm", "_new", F.lit(True).alias("_sent")), allowMissingColumns=True)
    met = sides.groupBy(*keys, "depth_mm").agg(*(F.max(c).alias(c) for c in ("_old", "_was", "_new", "_sent"))).join(rules, keys, "left")
    sent, was, open_ = F.col("_sent").isNotNull(), F.col("_was").isNotNull(), F.col("why") == ""
    rows = F.array(
        F.struct(F.when(sent & open_, F.col("_new")).otherwise(F.col("_old")).alias("value"), F.when(was & sent & open_, "overwritten").when(sent & open_, "inserted").when(
            was & open_ & F.lit(replace), "removed").when(was, "kept").alias("what"), F.lit("").alias("why")),
        F.struct(F.col("_new").alias("value"), F.when(sent & ~open_, "refused").alias("what"), F.col("why").alias("why")))
    return met.select(*keys, "depth_mm", F.explode(F.filter(rows, lambda r: r["what"].isNotNull())).alias("r")).select(*keys, "depth_mm", "r.*")


def unknown_fields(fields: Column, known: Iterable[str]) -> Column:
    """The entries of a map of all fields that the schema does not name."""
    names = list(known)
    return F.map_filter(fields, lambda k, v: ~k.isin(names) & v.isNotNull())


def flatten_detections(docs: DataFrame, unnamed: bool = True) -> DataFrame:
    """Detection documents (image_id, text) to candidate rows with every field; of equal boxes in an image the first one
    stays: the passing pool comes before the rejected one, each in document order.

    Fields that the schema does not name stay as text in ``extra``. The fields of the document stand in ``doc``. Rows can
    be judged again, compared, or written back by :func:`detection_documents`. Without ``unnamed`` there is no ``extra``,
    and the texts are read once instead of twice.
    """
    open_ = [F.from_json("text", OPEN_DETECTION_JSON).alias("o")] if unnamed else []
    d = docs.select("image_id", F.from_json("text", DETECTION_JSON).alias("d"), *open_)

    def pool(name: str, passed: bool) -> Column:
        every = lambda i: [F.get(F.coalesce(f"o.{name}", F.array()), i).alias("all")] if unnamed else []
        return F.transform(F.coalesce(f"d.{name}", F.array()), lambda c, i: F.struct(F.lit(passed).alias("passed"), i.alias("i"), c.alias("c"), *every(i)))

    rows = d.select("image_id", F.struct(*(f"d.{f}" for f in DETECTION_FIELDS)).alias("doc"), F.explode(F.concat(pool("candidates", True), pool("rejected", False))).alias("r"))
    box = F.transform("r.c.bbox_xywh", lambda v: v.cast("int"))
    rows = rows.select("image_id", F.array_join(F.transform(box, lambda v: v.cast("string")), "_").alias("mask_key"), "doc", "r")
    first = F.min_by(F.struct("doc", "r.*"), F.struct((~F.col("r.passed")).alias("p"), F.col("r.i"))).alias("r")
    kept = rows.groupBy("image_id", "mask_key").agg(first)
    side = lambda i: F.get("r.c.bbox_xywh", i).cast("int")
    return kept.select(
        "image_id", "mask_key", "r.passed", F.col("r.c.id").alias("raw_id"), *(side(i).alias("bbox_" + n) for i, n in enumerate("xywh")),
        *(F.get("r.c.center_xy", i).alias("center_" + n) for i, n in enumerate("xy")), F.coalesce("r.c.area_px", F.lit(0)).alias("area_px"), F.coalesce("r.c.shape_ok", F.lit(False)).alias("shape_ok"),
        *(f"r.c.{f}" for f in ("major_um", "minor_um", "texture", "elongation", "ellipse_iou", "solidity")), F.coalesce("r.c.polygon", F.expr("cast(array() as array<double>)")).alias("polygon"),
        F.coalesce("r.c.cls", F.lit("")).alias("cls"), F.when(F.col("r.passed"), "").otherwise(F.coalesce("r.c.reject", F.lit(""))).alias("reject"),
        *([unknown_fields(F.col("r.all"), CANDIDATE_FIELDS).alias("extra")] if unnamed else []), F.col("r.doc").alias("doc"))


def joined_objects(first: Column, second: Column) -> Column:
    """Two JSON objects as one; either may be empty."""
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.when(F.length(c) > 2, inner(c)) for c in (first, second))), F.lit("}"))


def detection_documents(rows: DataFrame) -> DataFrame:
    """The documents of :func:`flatten_detections` again: image_id, text. A document is one image with its masks; unnamed
    fields go back to their place, as text."""
    c = F.struct(
        F.col("raw_id").alias("id"), F.array(*(F.col("bbox_" + s).cast("double") for s in "xywh")).alias("bbox_xywh"), F.when(F.col("center_x").isNotNull(), F.array("center_x", "center_y")).alias("center_xy"),
        "area_px", "shape_ok", "polygon", "major_um", "minor_um", "texture", "elongation", "ellipse_iou", "solidity", "cls", "reject")
    one = rows.select("image_id", "passed", "doc", F.struct(F.col("raw_id").alias("o"), "mask_key", joined_objects(F.to_json(c), F.coalesce(F.to_json("extra"), F.lit("{}"))).alias("text")).alias("m"))
    pools = one.groupBy("image_id").agg(F.first("doc").alias("doc"), *(F.sort_array(F.collect_list(F.when(F.col("passed") == p, F.col("m")))).alias(n) for n, p in (("candidates", True), ("rejected", False))))
    listed = [F.concat(F.lit(f'"{n}":['), F.array_join(F.transform(n, lambda x: x["text"]), ","), F.lit("]")) for n in ("candidates", "rejected")]
    return pools.select("image_id", joined_objects(F.to_json("doc"), F.concat(F.lit("{"), F.concat_ws(",", *listed), F.lit("}"))).alias("text"))


def flatten_groups(docs: DataFrame) -> DataFrame:
    """Group documents (text) to frames: slide, group_no, name, place in the group, running ``seq`` in the slide."""
    d = docs.select(F.from_json("text", GROUPS_JSON).alias("d")).select("d.dir", F.posexplode("d.groups").alias("_g", "g"), F.transform("d.groups", lambda g: F.size(g["images"])).alias("_n"))
    before = F.aggregate(F.slice("_n", F.lit(1), F.col("_g")), F.lit(0), lambda a, x: a + x)
    return d.select(F.col("dir").alias("slide"), "g.id", "g.sharpest", before.alias("_b"), F.posexplode("g.images").alias("place", "name")).select(
        "slide", F.col("id").alias("group_no"), "name", "place", (F.col("_b") + F.col("place")).alias("seq"), (F.col("name") == F.col("sharpest")).alias("is_sharpest")
    )


def load_stacks(docs: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """Stack reports (text) joined to the viewpoints by tag."""
    s = docs.select(F.explode(F.from_json("text", STACKS_JSON)).alias("s")).select("s.*")
    return s.join(viewpoints.select("tag", "viewpoint_id"), "tag", "left")


def flatten_reviews(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Review documents (text) to judgements with every field, bound to the candidate of the same key, else orphans.

    A key stands once per image and batch (the last mention counts). Fields not named by the schema stay in ``extra``.
    A missing outline is taken from the candidate, if ``candidates`` has a polygon.
    """
    d = docs.select(F.from_json("text", REVIEWS_JSON).alias("d"), F.from_json("text", OPEN_REVIEWS_JSON).alias("o"))
    images = d.select("d.slide", "d.gid", "d.tag", "d.done", "d.comment", "o", F.posexplode("d.images").alias("_i", "i"))
    objects = images.select("slide", "gid", "tag", "done", "comment", F.col("i.image").cast("bigint").alias("image_id"), F.col("i.batch").alias("batch"), F.get("o.images", F.col("_i"))["objects"].alias("_all"), F.posexplode("i.objects").alias("_k", "o"))
    yes = lambda f: F.coalesce(f"o.{f}", F.lit(False)).alias(f)
    text = lambda f: F.coalesce(f"o.{f}", F.lit("")).alias(f)
    rows = objects.select(
        "slide", "gid", "tag", F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("comment", F.lit("")).alias("comment"), "image_id", "batch", F.col("o.key").alias("mask_key"), "_k",
        *(yes(f) for f in ("removed", "accepted", "geom_edited", "auto_confirmed", "is_rep")), *(text(f) for f in ("label", "note", "species", "grade", "pose")),
        F.coalesce("o.source", F.lit("engine")).alias("source"), "o.bbox", "o.polygon", F.col("o.link").alias("link"), F.col("o.bind_score").alias("stated_score"),
        unknown_fields(F.get("_all", F.col("_k")), OBJECT_FIELDS).alias("extra"))
    ids = ["gid", "image_id", "batch", "mask_key"]
    cols = [c for c in rows.columns if c not in (*ids, "_k")]
    last = rows.groupBy(*ids).agg(F.max_by(F.struct(*cols), "_k").alias("_r")).select(*ids, *(F.col(f"_r.{c}").alias(c) for c in cols))
    polygon = F.max("polygon") if "polygon" in candidates.columns else F.lit(None).cast("array<double>")
    c = candidates.groupBy("image_id", "mask_key").agg(polygon.alias("_polygon")).withColumn("_b", F.lit("exact"))
    bound = last.join(c, ["image_id", "mask_key"], "left")
    drawn = F.col("source") == "manual"
    return bound.withColumns({
        "bind": F.when(drawn, "manual").otherwise(F.coalesce("_b", F.lit("orphan"))), "bind_score": F.when(F.col("_b").isNotNull() & ~drawn, 1.0), "polygon": F.coalesce("polygon", "_polygon"),
    }).drop("_b", "_polygon")


def flatten_atlas(docs: DataFrame) -> DataFrame:
    """Index documents (text) to placements, one row each, and one row for an entry without any."""
    d = docs.select(F.from_json("text", ATLAS_JSON).alias("d")).select(F.col("d.atlas.key").alias("atlas_key"), F.explode("d.entries").alias("e"))
    p = d.select("atlas_key", "e.seq", "e.name", "e.genus", "e.binomial", F.posexplode_outer("e.placements").alias("place", "p"))
    return p.select("atlas_key", "seq", "name", "genus", "binomial", "place", "p.plate", "p.figures", "p.pdf_page", "p.volume")


def check_atlas_load(loaded: DataFrame, source: DataFrame) -> DataFrame:
    """Counts of entries, genera and names on both sides of a load, per index."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("atlas_key").agg(F.count_distinct("seq").alias(p + "entries"), F.count_distinct("genus").alias(p + "genera"), F.count_distinct("name").alias(p + "names"))

    j = side(source, "s_").join(side(loaded, "l_"), "atlas_key", "full_outer")
    same = F.lit(True)
    for c in ("entries", "genera", "names"):
        same = same & F.col("s_" + c).eqNullSafe(F.col("l_" + c))
    return j.withColumn("ok", same)


def _tag_text(text: Column, tag: str) -> Column:
    got = F.regexp_extract(text, f"<{tag}>([^<]*)</{tag}>", 1)
    return F.when(got != "", F.trim(got))


def scale_metadata(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Scale out of metadata texts: keep, um_per_pixel, source, objective.

    ``docs`` carries ``xml`` and ``sidecar_um`` (either may be null). A text taken with another objective than 40x is
    recomputed from camera pixel, optovar and adapter; an implausible scale falls back to the side file, then the default.
    """
    lo, hi = PLAUSIBLE
    num = lambda tag: _tag_text(F.col("xml"), tag).try_cast("double")
    staged = docs.withColumns(
        {
            "objective": num("NominalMagnification"),
            "_optovar": num("OptovarMagnification"),
            "_adapter": num("CameraAdapterMagnification"),
            "_cell": F.split_part(_tag_text(F.col("xml"), "CameraPixelDistance"), F.lit(","), F.lit(1)).try_cast("double"),
            "_dist": F.regexp_extract("xml", r'<Distance[^>]*Id="X"[^>]*>\s*<Value>([^<]+)</Value>', 1).try_cast("double") * 1e6,
        }
    )
    other = F.abs(F.col("objective") - ASSUMED_OBJECTIVE) > 1e-6
    total = F.col("_optovar") * F.col("_adapter") * ASSUMED_OBJECTIVE
    from_xml = F.when(other & (total > 0) & F.col("_cell").isNotNull(), F.col("_cell") / total).otherwise(F.col("_dist"))
    staged = staged.withColumn("_um", F.when(from_xml.between(lo, hi), from_xml))
    return staged.select(
        *keep,
        F.coalesce("_um", "sidecar_um", F.lit(DEFAULT_UM_PER_PIXEL)).alias("um_per_pixel"),
        F.when(F.col("_um").isNotNull(), "xml").when(F.col("sidecar_um").isNotNull(), "sidecar").otherwise("default").alias("source"),
        "objective",
    )


def capture_time(xml: Column) -> Column:
    """Acquisition time out of a metadata text, as a UTC timestamp."""
    return F.try_to_timestamp(F.regexp_replace(_tag_text(xml, "AcquisitionDateAndTime"), "Z$", "+00:00"))


def scale_drift(frames: DataFrame, keys: list[str], tolerance: float = 0.001) -> DataFrame:
    """Photos whose scale differs from the first of their key by more than 0.1%."""
    first = frames.groupBy(*keys).agg(F.min_by("um_per_pixel", "seq").alias("first_um"))
    return frames.join(first, keys).filter(F.abs(F.col("um_per_pixel") - F.col("first_um")) > F.col("first_um") * tolerance).select(*keys, "seq", "um_per_pixel", "first_um")


def register_images(known: DataFrame, *sources: tuple[DataFrame, str]) -> DataFrame:
    """Paths of frames, stacks and depth maps that are not registered yet: path, kind, viewpoint_id."""
    every = None
    for df, kind in sources:
        rows = df.select("path", F.lit(kind).alias("kind"), "viewpoint_id")
        every = rows if every is None else every.unionByName(rows)
    best = every.filter("path IS NOT NULL AND path <> ''").groupBy("path").agg(F.min(F.struct("kind", "viewpoint_id")).alias("_r"))
    return best.select("path", "_r.*").join(known.select("path"), "path", "left_anti")


def link_detections_to_images(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Give detections without an image the one with their path; ``missing`` where there is none."""
    i = images.select(F.col("path").alias("image_path"), F.col("image_id").alias("_found"))
    return detections.join(i, "image_path", "left").select(
        "detection_id", F.coalesce("image_id", "_found").alias("image_id"), (F.coalesce("image_id", "_found").isNull()).alias("missing")
    )


# Line patterns of the three index formats.
FORMATS = {
    "numbered": {
        "section": r"^### (.+)$",
        "head": r"^\*\*(\d+)\. \*(.+?)\*\*\*$",
        "place_line": r"^<sub>(.*)</sub>$",
        "plate": r"pl\.\s*(\d+)",
        "page": r"PDF p\.(\d+)",
    },
    "one_line": {
        "section": r"^## (.+)$",
        "head": r"^- \*\*\*(.+?)\*\*\*",
        "place": r"Tafel\s+\d+(?:\s*fig\.[^(;]*)?\s*\(Band\d+\s*PDF\s*p\.\d+/\d+\)",
        "plate": r"Tafel\s+(\d+)",
        "page": r"PDF\s*p\.(\d+)",
    },
    "starred": {
        "section": r"^## (.+)$",
        "head": r"^\*\*\*(.+?)\*\*\*",
        "place_line": r"^<sub>(.*)</sub>$",
        "plate": r"pl\.\s*(\d+)",
        "page": r"PDF p\.(\d+)",
    },
}


def parse_index_entries(lines: DataFrame, fmt: str) -> DataFrame:
    """Lines of an index (doc, line_no, line) to placements: doc, line_no of the entry, section, name, plate, page.

    Headings and, where a place stands on its own line, the entry above are carried down; an entry without a place gives
    one row with null plate.
    """
    from tallyscope.operators.sequence import Blocks, ranges

    f = FORMATS[fmt]
    hit = lambda key, group: F.when(F.regexp_extract("line", f[key], group) != "", F.regexp_extract("line", f[key], group))
    blocks = Blocks(["doc"], [ranges("line_no", 4096)], ["line_no"])
    name = hit("head", 2 if fmt == "numbered" else 1)
    x = lines.withColumn("_name", name).withColumn("_sec", hit("section", 1))
    x = blocks.carry(x, "section", F.col("_sec"))
    first = lambda pattern: F.regexp_extract("_p", pattern, 1).try_cast("int")
    if "place" in f:
        e = x.filter("_name IS NOT NULL").select("doc", "line_no", "section", F.col("_name").alias("name"), F.explode_outer(F.regexp_extract_all("line", F.lit(f["place"]), F.lit(0))).alias("_p"))
    else:
        x = blocks.carry(x, "_head", F.when(F.col("_name").isNotNull(), F.struct(F.col("line_no").alias("at"), F.col("_name").alias("name"))))
        heads = x.filter("_name IS NOT NULL").select("doc", "line_no", "section", F.col("_name").alias("name"))
        places = x.withColumn("_p", hit("place_line", 1)).filter("_p IS NOT NULL AND _head IS NOT NULL").select("doc", F.col("_head.at").alias("line_no"), "_p")
        e = heads.join(places, ["doc", "line_no"], "left")
    # Each plate begins a place, and the page after it belongs to it.
    plate = f["plate"].replace("(", "").replace(")", "")
    parts = F.regexp_extract_all("_p", F.lit(f"{plate}.*?(?={plate}|$)"), F.lit(0))
    e = e.withColumn("_p", F.explode_outer(F.when(F.size(parts) > 0, parts).otherwise(F.array("_p"))))
    return e.select("doc", "line_no", "section", "name", first(f["plate"]).alias("plate"), F.when(first(f["plate"]).isNotNull(), first(f["page"])).alias("page"))


def check_index_counts(lines: DataFrame, parsed: DataFrame, fmt: str, stated: DataFrame | None = None) -> DataFrame:
    """Entries and placements the parser found against those counted from the raw lines, per document.

    ``stated`` (doc, entries) adds the number the document itself gives.
    """
    f = FORMATS[fmt]
    n_plates = F.size(F.regexp_extract_all("line", F.lit(f["plate"]), F.lit(0)))
    raw_places = F.size(F.regexp_extract_all("line", F.lit(f["place"]), F.lit(0))) if "place" in f else F.when(F.col("line").rlike(f["place_line"]), n_plates).otherwise(0)
    raw = lines.groupBy("doc").agg(F.count_if(F.col("line").rlike(f["head"])).alias("raw_entries"), F.sum(raw_places).alias("raw_places"))
    got = parsed.groupBy("doc").agg(F.count_distinct("line_no").alias("entries"), F.count("plate").alias("places"))
    j = raw.join(got, "doc", "full_outer").fillna(0)
    ok = (F.col("raw_entries") == F.col("entries")) & (F.col("raw_places") == F.col("places"))
    if stated is not None:
        j = j.join(stated.select("doc", F.col("entries").alias("stated_entries")), "doc", "left")
        ok = ok & F.coalesce(F.col("stated_entries") == F.col("entries"), F.lit(True))
    return j.withColumn("ok", ok)


def page_spread(pages: DataFrame, keys: list[str], even_left: bool) -> DataFrame:
    """Every page with its opening: left and right page (null where missing), and the pages before and after the opening."""
    have = pages.select(*keys, "page").distinct()
    ends = have.groupBy(*keys).agg(F.min("page").alias("_lo"), F.max("page").alias("_hi"))
    left = F.when((F.col("page") % 2 == 0) == F.lit(even_left), F.col("page")).otherwise(F.col("page") - 1)
    opened = have.withColumn("_left", left)
    sides = opened.groupBy(*keys, "_left").agg(F.min(F.when(F.col("page") == F.col("_left"), F.col("page"))).alias("left_page"), F.max(F.when(F.col("page") != F.col("_left"), F.col("page"))).alias("right_page"))
    j = opened.join(sides, [*keys, "_left"]).join(ends, keys)
    first, last = F.coalesce("left_page", "right_page"), F.coalesce("right_page", "left_page")
    return j.select(
        *keys, "page", "left_page", "right_page",
        F.when(first - 1 >= F.col("_lo"), first - 1).alias("prev_page"), F.when(last + 1 <= F.col("_hi"), last + 1).alias("next_page"),
    )
