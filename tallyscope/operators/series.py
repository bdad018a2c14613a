"""Ordered data: photo series, depth profiles, snapshots, page runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.operators.rollup import upper_median
from tallyscope.operators.sequence import Blocks, ranges
from tallyscope.session import cut

# Correlation that keeps two photos together, steps of a depth axis, points a profile may show, and the
# multiple of the median spacing from which a profile is broken.
CORR_THRESHOLD = 0.55
AXIS_STEPS = [1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000, 2500]
AXIS_LAST_STEP, AXIS_TICKS = 5000, 8
PROFILE_POINTS, PROFILE_GAP = 800, 4
MIN_PAIRS = 10


def _by_seq(keys: list[str], seq: str = "seq") -> Blocks:
    return Blocks(keys, [ranges(seq)], [seq])


def neighbor_correlation(vectors: DataFrame, keys: list[str], seq: str, vector: str) -> DataFrame:
    """Normalised correlation of each fingerprint with the one before it."""
    with_prev = _by_seq(keys, seq).previous(vectors.select(*keys, seq, vector), {vector: "_prev"})

    def centred(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
        return F.transform(v, lambda x: x - mean)

    a, b = centred(F.col(vector).cast("array<double>")), centred(F.col("_prev").cast("array<double>"))

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    pair = with_prev.select(*keys, seq, a.alias("_a"), b.alias("_b"))
    norm = F.sqrt(dot(F.col("_a"), F.col("_a")) * dot(F.col("_b"), F.col("_b")))
    return pair.select(*keys, seq, F.when(norm > 1e-12, dot(F.col("_a"), F.col("_b")) / norm).alias("corr"))


def mark_groups(frames: DataFrame, threshold: float = CORR_THRESHOLD, max_gap_sec: float = 0.0) -> DataFrame:
    """Add ``group_id`` (from 0, per slide) and ``is_break``: a photo that does not belong with the one before.

    ``corr_prev`` is the correlation with the photo before; the first photo of a slide breaks nothing.
    """
    seq = _by_seq(["slide_id"])
    f = seq.previous(frames, {"acquired_at": "_before", "frame_id": "_prev_id"})
    gap = (F.unix_micros("acquired_at") - F.unix_micros("_before")) / 1e6
    apart = F.col("corr_prev") < threshold
    if max_gap_sec > 0:
        apart = apart | (gap > max_gap_sec)
    f = f.withColumn("is_break", F.col("_prev_id").isNotNull() & F.coalesce(apart, F.lit(False))).withColumn("has_prev", F.col("_prev_id").isNotNull())
    return seq.running_sum(f.drop("_before", "_prev_id"), "group_id", F.col("is_break").cast("bigint"))


def _tag(number: Column) -> Column:
    no = number.cast("string")
    return F.concat(F.lit("g"), F.when(F.length(no) < 3, F.lpad(no, 3, "0")).otherwise(no), F.lit("_"), "_first", F.lit("-"), "_last")


def _ends(frames: DataFrame, group: str) -> DataFrame:
    best = F.struct("sharpness", (-F.col("seq")).alias("s"))
    span = F.unix_micros(F.max_by("acquired_at", "seq")) - F.unix_micros(F.min_by("acquired_at", "seq"))
    return frames.groupBy("slide_id", group).agg(
        F.count("*").alias("n"),
        F.max_by("name", best).alias("sharpest"),
        (span / 1e6).alias("span_sec"),
        F.min_by("name", "seq").alias("_first"),
        F.max_by("name", "seq").alias("_last"),
    )


def describe_groups(frames: DataFrame) -> DataFrame:
    """Size, time span, sharpest photo and tag of every group."""
    return _ends(frames, "group_id").withColumn("tag", _tag(F.col("group_id"))).drop("_first", "_last")


def separability(marked: DataFrame, threshold: float = CORR_THRESHOLD, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Whether the threshold parts the correlations inside groups from those at boundaries, per slide."""
    pairs = marked.filter("has_prev").select("slide_id", F.col("corr_prev").alias("c"), "is_break")
    ends = pairs.groupBy("slide_id").agg(
        F.count_if(~F.col("is_break")).alias("within_n"),
        F.count_if("is_break").alias("between_n"),
        F.min(F.when(~F.col("is_break"), F.col("c"))).alias("_lo"),
        F.max(F.when(F.col("is_break"), F.col("c"))).alias("_hi"),
    )
    crossing = (~F.col("is_break") & (F.col("c") < F.col("_hi"))) | (F.col("is_break") & (F.col("c") > F.col("_lo")))
    over = pairs.join(ends.select("slide_id", "_lo", "_hi"), "slide_id").groupBy("slide_id").agg(F.count_if(crossing).alias("_over"))
    both = (F.col("within_n") > 0) & (F.col("between_n") > 0)
    t = F.lit(float(threshold))
    out = ends.join(over, "slide_id").select(
        "slide_id", "within_n", "between_n",
        F.when(both, F.round("_lo", 4)).alias("within_min"),
        F.when(both, F.round("_hi", 4)).alias("between_max"),
        F.when(both, F.round(F.col("_lo") - F.col("_hi"), 4)).alias("gap"),
        F.when(both, F.col("_over")).alias("overlap"),
        F.when(both, F.round(F.least(t - F.col("_hi"), F.col("_lo") - t), 4)).alias("margin"),
    )
    return out.withColumn(
        "why",
        F.when(F.col("overlap") > 0, "overlap").when(F.col("margin") < 0, "threshold inside a group")
        .when((F.col("within_n") < min_pairs) & (F.col("within_n") > 0), "too few pairs").otherwise(""),
    )


def split_groups(marked: DataFrame, cuts: DataFrame) -> DataFrame:
    """Re-cut groups after the given photos and renumber all; equal tags get ``_r2``, ``_r3`` …

    ``marked`` as from ``mark_groups``; ``cuts``: slide_id, frame_id to cut after. A cut after the last photo of a group
    changes nothing. Returns the new groups with ``was`` (the old group) and ``is_new``.
    """
    seq = _by_seq(["slide_id"])
    f = cut(marked).join(cuts.select("slide_id", "frame_id", F.lit(1).alias("_cut")), ["slide_id", "frame_id"], "left")
    f = seq.previous(f, {"_cut": "_cut_before", "group_id": "_group_before"})
    starts = F.col("_group_before").isNotNull() & ((F.col("group_id") != F.col("_group_before")) | F.col("_cut_before").isNotNull())
    fresh = F.col("_cut_before").isNotNull() & (F.col("group_id") == F.col("_group_before"))
    f = f.withColumn("_fresh", fresh.cast("int"))
    f = cut(seq.running_sum(f, "new_id", starts.cast("bigint")))
    touched = f.groupBy("slide_id", "group_id").agg((F.max("_fresh") > 0).alias("is_new"))
    old = f.groupBy("slide_id", "new_id").agg(F.min("group_id").alias("was"))
    g = _ends(f, "new_id").join(old, ["slide_id", "new_id"])
    g = g.join(touched.select("slide_id", F.col("group_id").alias("was"), "is_new"), ["slide_id", "was"])
    # Untouched groups keep their tag, and with it the right to it.
    g = g.withColumn("tag", F.when(F.col("is_new"), _tag(F.col("new_id"))).otherwise(_tag(F.col("was")))).drop("_first", "_last")
    twin = Blocks(["slide_id", "tag"], ["is_new", ranges("new_id")], ["is_new", "new_id"]).row_number(g, "_k")
    return twin.withColumn("tag", F.when(F.col("_k") > 1, F.concat("tag", F.lit("_r"), F.col("_k").cast("string"))).otherwise(F.col("tag"))).drop("_k")


def normalize_current(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Exactly one current detection per key: a current one beats others, then the higher id. Gives the changed rows."""
    keep = detections.groupBy(*keys).agg(F.max_by("detection_id", F.struct("is_current", "detection_id")).alias("_keep"))
    want = F.col("detection_id") == F.col("_keep")
    return detections.join(keep, keys).filter(want != F.col("is_current")).select("detection_id", want.alias("is_current"))


def prune_superseded(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Detections in excess of one per key (``drop``); keys with several current ones are left alone (``conflict``)."""
    g = detections.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count_if("is_current").alias("_cur"), F.max_by("detection_id", F.struct("is_current", "detection_id")).alias("_keep")
    )
    j = detections.join(g.filter("_n > 1"), keys)
    what = F.when(F.col("_cur") > 1, "conflict").when(F.col("detection_id") != F.col("_keep"), "drop")
    return j.withColumn("what", what).filter(F.col("what").isNotNull()).select("detection_id", *keys, "what")


def tiered_retention(snapshots: DataFrame, now: str, daily_days: int = 7, weekly_days: int = 30) -> DataFrame:
    """Which snapshots to keep: all of the last days, then one per ISO week, then one per month; unreadable ones stay.

    The newest of a week or month is kept, unless a younger tier already kept one of that week or month. Three small
    aggregates and two anti joins do it, so no window sees a whole table.
    """
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("stamp")) / 86400.0)
    s = snapshots.select(
        "snapshot_id", "stamp",
        F.when(age <= daily_days, "day").when(age <= weekly_days, "week").when(age.isNotNull(), "month").otherwise("unreadable").alias("tier"),
        F.expr("extract(YEAROFWEEK FROM stamp) * 100 + weekofyear(stamp)").alias("_week"),
        F.expr("year(stamp) * 100 + month(stamp)").alias("_month"),
    )
    newest = F.max_by("snapshot_id", F.struct("stamp", "snapshot_id")).alias("snapshot_id")
    daily = s.filter("tier = 'day'")
    weekly = s.filter("tier = 'week'").join(daily.select("_week").distinct(), "_week", "left_anti").groupBy("_week").agg(newest, F.max("_month").alias("_m"))
    months = daily.select("_month").unionByName(
        s.join(weekly.select("snapshot_id"), "snapshot_id", "left_semi").select("_month")
    ).distinct()
    monthly = s.filter("tier = 'month'").join(months, "_month", "left_anti").groupBy("_month").agg(newest)
    kept = weekly.select("snapshot_id").unionByName(monthly.select("snapshot_id")).withColumn("_keep", F.lit(True))
    return s.join(kept, "snapshot_id", "left").select("snapshot_id", "tier", (F.col("tier").isin("day", "unreadable") | F.col("_keep").isNotNull()).alias("keep"))


SERIES = ["locality_id", "series_key"]


def _profile_blocks() -> Blocks:
    return Blocks(SERIES, [ranges("depth_mm")], ["depth_mm"])


def profile_thin(points: DataFrame, cap: int = PROFILE_POINTS) -> DataFrame:
    """Series above ``cap`` points cut into cap/2 runs, of which the lowest and the highest measured point stay."""
    placed = _profile_blocks().row_number(points, "_r", "_n")
    buckets = max(1, cap // 2)
    width = F.col("_n") / F.lit(float(buckets))
    # In a short series every point is a run of its own.
    placed = placed.withColumn("_b", F.when(F.col("_n") > cap, F.ceil(F.col("_r") / width) - 1).otherwise(F.col("_r")))
    point = F.struct("depth_mm", "value")
    ends = placed.groupBy(*SERIES, "_b").agg(
        F.min_by(point, F.struct("value", "depth_mm")).alias("lo"), F.max_by(point, F.struct(F.col("value"), (-F.col("depth_mm")).alias("d"))).alias("hi")
    )
    return ends.select(*SERIES, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_p")).select(*SERIES, "_p.depth_mm", "_p.value")


def profile_segments(points: DataFrame) -> DataFrame:
    """Number the unbroken stretches of each series and place its values on 0..100."""
    blocks = _profile_blocks()
    p = blocks.previous(points, {"depth_mm": "_before"}).withColumn("_gap", F.col("depth_mm") - F.col("_before"))
    stats = p.groupBy(*SERIES).agg(upper_median("_gap").alias("_mid"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    p = _placed(p.join(stats, SERIES))
    return blocks.running_sum(p, "segment", F.col("_cut")).select(*SERIES, "depth_mm", "value", "x", "segment")


def _placed(p: DataFrame) -> DataFrame:
    """Add ``x``, the value on 0..100, and ``_cut``, whether a stretch begins, from the gap and the stats of the series."""
    broken = F.coalesce(F.col("_gap") > F.col("_mid") * PROFILE_GAP, F.lit(False))
    span = F.col("_hi") - F.col("_lo")
    x = F.round((F.col("value") - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span) * 100, 3)
    return p.withColumn("x", x).withColumn("_cut", broken.cast("bigint"))


def core_profiles(points: DataFrame, chosen: DataFrame, cap: int = PROFILE_POINTS) -> DataFrame:
    """The chosen series, thinned and broken, with their place in the display order.

    A thinned series has ``cap`` points at most, so from there on one window per series serves gaps, stats and stretches.
    """
    thin = profile_thin(points.join(chosen.select(*SERIES), SERIES, "left_semi"), cap)
    along, whole = Window.partitionBy(*SERIES).orderBy("depth_mm"), Window.partitionBy(*SERIES)
    p = thin.withColumn("_gap", F.col("depth_mm") - F.lag("depth_mm").over(along))
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY _gap DESC) OVER (PARTITION BY {', '.join(SERIES)})")
    p = p.withColumns({"_mid": middle, "_lo": F.min("value").over(whole), "_hi": F.max("value").over(whole)})
    p = _placed(p).withColumn("segment", F.sum("_cut").over(along))
    return p.select(*SERIES, "depth_mm", "value", "x", "segment").join(chosen.select(*SERIES, "sort_order"), SERIES)


def nice_step(span: Column) -> Column:
    raw = F.greatest(span / AXIS_TICKS, F.lit(1.0))
    return reduce(lambda acc, s: F.when(raw <= s, s).otherwise(acc), reversed(AXIS_STEPS), F.lit(AXIS_LAST_STEP))


def depth_axis(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticks, marks) of every locality. ``marks``: locality_id, slide_id, depth_cm."""
    placed = marks.filter("depth_cm IS NOT NULL")
    span = placed.groupBy("locality_id").agg(F.max("depth_cm").alias("_deep")).withColumn("step", nice_step(F.col("_deep")))
    axis = span.withColumn("bottom", ((F.floor(F.col("_deep") / F.col("step")) + 1) * F.col("step")).cast("int"))
    ticks = axis.select("locality_id", "step", "bottom", F.explode(F.sequence(F.lit(0), "bottom", "step")).alias("depth_cm"))
    ticks = ticks.withColumn("pct", F.round(F.col("depth_cm") / F.col("bottom") * 100, 3))
    same = Blocks(["locality_id", "depth_cm"], [ranges("slide_id")], ["slide_id"]).row_number(placed, "_k")
    n = placed.groupBy("locality_id", "depth_cm").agg(F.count("*").alias("n_at_depth"))
    out = same.join(n, ["locality_id", "depth_cm"]).join(axis.select("locality_id", "bottom"), "locality_id")
    return ticks, out.select(
        "locality_id", "slide_id", "depth_cm", F.round(F.col("depth_cm") / F.col("bottom") * 100, 3).alias("pct"), (F.col("_k") - 1).alias("place"), "n_at_depth"
    )


def sharpness_share(frames: DataFrame, keys: list[str]) -> DataFrame:
    top = frames.groupBy(*keys).agg(F.max("sharpness").alias("_top"))
    return frames.join(top, keys).select("frame_id", *keys, F.when((F.col("_top") > 0) & F.col("sharpness").isNotNull(), F.rint(F.col("sharpness") * 100 / F.col("_top"))).otherwise(0.0).cast("bigint").alias("share"))


def next_unreviewed(viewpoints: DataFrame, done: DataFrame) -> DataFrame:
    """For each viewpoint the next one of its slide that is not done, else the first such one other than itself."""
    v = viewpoints.select("slide_id", "idx", "viewpoint_id").join(done.select("viewpoint_id", F.lit(True).alias("_done")), "viewpoint_id", "left")
    v = v.withColumn("_todo", F.when(F.col("_done").isNull(), F.col("idx"))).withColumn("_back", -F.col("idx"))
    later = Blocks(["slide_id"], [ranges("_back")], ["_back"]).carry(v, "_after", F.col("_todo"), strict=True)
    first = v.groupBy("slide_id").agg(F.min("_todo").alias("_first"))
    here = F.when(F.col("_first") != F.col("idx"), F.col("_first"))
    return later.join(first, "slide_id").select("viewpoint_id", "slide_id", "idx", F.coalesce("_after", here).alias("next_idx"))


def heading_carry(lines: DataFrame, keys: list[str], line_no: str, heading: Column) -> DataFrame:
    """Give each line the nearest heading at or before it."""
    return Blocks(keys, [ranges(line_no, 4096)], [line_no]).carry(lines, "heading", heading)


def page_numbering(sections: DataFrame) -> DataFrame:
    """True plate numbers of runs of pages whose heading could not be read.

    ``sections``: band, seq, plate, is_cont (a page that repeats the number before it), page. A run is a heading with its
    continuation pages. It is counted from the plate before it to the plate after it: one plate per page, one plate over
    all pages, or undecided. The plate before a run is the result of the run before it, which can only be one of two
    numbers known beforehand; so a run is a function from one bit to one bit, and a chain of runs is settled by the last
    constant function and the parity of the swaps since, without walking the chain.
    """
    seq = _by_seq(["band"])
    s = seq.running_sum(sections, "run", (~F.col("is_cont")).cast("bigint"))
    runs = s.filter("run > 0").groupBy("band", "run").agg(
        F.max(F.when(~F.col("is_cont"), F.col("plate"))).alias("plate"), F.count("*").alias("n"), F.max(F.when(~F.col("is_cont"), F.col("page"))).alias("page")
    )
    order = Blocks(["band"], [ranges("run")], ["run"])
    runs = order.neighbours(cut(runs), before={"plate": "before", "n": "before_n"}, after={"plate": "nxt", "n": "nxt_n"})
    runs = cut(order.following(runs, {"nxt": "nxt2"}))
    # What a run may leave behind: raw = next - 1, or the number counted back through the next run.
    corrected = F.when((F.col("nxt_n") > 1) & F.col("nxt2").isNotNull(), F.col("nxt2") - F.col("nxt_n"))
    # The two values the run before may have left (its own next is this run).
    left_raw = F.col("plate") - 1
    left_corr = F.when((F.col("n") > 1) & F.col("nxt").isNotNull(), F.col("nxt") - F.col("n") - 1)

    def settle(p: Column) -> tuple[Column, Column, Column]:
        """(uses the corrected number, number of plates to fit, resolved) for the plate ``p`` before the run."""
        use = F.coalesce(corrected.isNotNull() & p.isNotNull() & (corrected - 1 >= p), F.lit(False))
        need = F.when(use, corrected).otherwise(F.col("nxt")) - p - 1
        return use, need, F.coalesce((need == F.col("n")) | (need == 1), F.lit(False))

    def bit(p: Column) -> Column:
        use, _, good = settle(p)
        return (use & good).cast("int")

    follows_run = F.coalesce(F.col("before_n") > 1, F.lit(False))
    known = F.col("before")
    b0 = F.when(follows_run, bit(left_raw)).otherwise(bit(known))
    b1 = F.when(follows_run, bit(left_corr)).otherwise(bit(known))
    runs = runs.withColumn("_b0", b0).withColumn("_b1", b1)
    fixed = F.col("_b0") == F.col("_b1")
    runs = order.running_sum(runs, "_swaps", (F.col("_b0") > F.col("_b1")).cast("bigint"))
    runs = order.carry(runs, "_last", F.when(fixed, F.struct(F.col("_b0").alias("v"), F.col("_swaps").alias("s"))))
    runs = cut(runs)
    out_bit = (F.col("_last.v") + F.col("_swaps") - F.col("_last.s")) % 2
    runs = order.previous(runs.withColumn("_bit", out_bit), {"_bit": "_bit_before"})
    prev = F.when(follows_run, F.when(F.col("_bit_before") == 1, left_corr).otherwise(left_raw)).otherwise(known)
    _, need, good = settle(F.col("prev"))
    runs = runs.withColumn("prev", prev)
    return runs.filter("n > 1").select(
        "band", "plate", "page", "n", "prev", "nxt", need.alias("need"), (need == F.col("n")).alias("per_page"), F.when(good, F.col("prev") + 1).alias("true_first")
    )


def wrong_citations(citations: DataFrame, runs: DataFrame) -> DataFrame:
    """Citations (band, page, plate) whose plate number differs from the counted one; pages of a run lie two apart."""
    k = F.posexplode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("_i", "_k")
    pages = runs.filter("true_first IS NOT NULL").select("band", "page", "true_first", "per_page", k)
    true = F.col("true_first") + F.when(F.col("per_page"), F.col("_k")).otherwise(0)
    pages = pages.select("band", (F.col("page") + F.col("_k") * 2).alias("page"), true.alias("true_plate"))
    return citations.join(pages, ["band", "page"]).filter(F.col("plate") != F.col("true_plate"))
