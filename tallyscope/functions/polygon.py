"""Measures of flat polygons ``[x0, y0, x1, y1, ...]`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upright rotation only above this axis ratio; share and minimum of the crop margin.
UPRIGHT_MIN_RATIO, CROP_MARGIN, CROP_MARGIN_MIN = 1.15, 0.08, 3
DEGENERATE_RATIO = 999.0


def axis_values(poly: Column, odd: int) -> Column:
    """All x (0) or all y (1) of a flat polygon."""
    return F.filter(poly, lambda v, i: i % 2 == odd)


def edges(poly: Column) -> Column:
    """Closed edges as structs (x0, y0, x1, y1, cross)."""
    n = F.floor(F.size(poly) / 2).cast("int")

    def edge(i: Column) -> Column:
        j = (i + 1) % n
        x0, y0 = F.get(poly, i * 2), F.get(poly, i * 2 + 1)
        x1, y1 = F.get(poly, j * 2), F.get(poly, j * 2 + 1)
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (x0 * y1 - x1 * y0).alias("c"))

    return F.transform(F.sequence(F.lit(0), n - 1), edge)


def _total(arr: Column, term) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + term(e))


def is_polygon(poly: Column) -> Column:
    return F.coalesce(F.size(poly), F.lit(-1)) >= 6


def polygon_area(poly: Column) -> Column:
    return F.when(is_polygon(poly), F.abs(_total(edges(poly), lambda e: e["c"])) / 2).otherwise(0.0)


def polygon_perimeter(poly: Column) -> Column:
    return F.when(is_polygon(poly), _total(edges(poly), lambda e: F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]))).otherwise(0.0)


def polygon_bbox(poly: Column) -> Column:
    """Struct (x, y, w, h) of whole pixels, at least one wide and high."""
    xs, ys = axis_values(poly, 0), axis_values(poly, 1)
    x0, y0 = F.floor(F.array_min(xs)), F.floor(F.array_min(ys))
    x1, y1 = F.ceil(F.array_max(xs)), F.ceil(F.array_max(ys))
    one = F.lit(1)
    return F.struct(
        x0.cast("int").alias("x"),
        y0.cast("int").alias("y"),
        F.greatest(one, x1 - x0).cast("int").alias("w"),
        F.greatest(one, y1 - y0).cast("int").alias("h"),
    )


def moment_sums(es: Column) -> Column:
    """The six edge sums the moments are made of. Keep them in a column of their own: each is used several times."""
    return F.array(
        _total(es, lambda e: e["c"]),
        _total(es, lambda e: (e["x0"] + e["x1"]) * e["c"]),
        _total(es, lambda e: (e["y0"] + e["y1"]) * e["c"]),
        _total(es, lambda e: e["c"] * (e["x0"] * e["x0"] + e["x0"] * e["x1"] + e["x1"] * e["x1"])),
        _total(es, lambda e: e["c"] * (e["y0"] * e["y0"] + e["y0"] * e["y1"] + e["y1"] * e["y1"])),
        _total(
            es,
            lambda e: e["c"] * (e["x0"] * e["y0"] * 2 + e["x0"] * e["y1"] + e["x1"] * e["y0"] + e["x1"] * e["y1"] * 2),
        ),
    )


def polygon_moments(sums: Column) -> Column:
    """Centre and second central area moments from ``moment_sums``: struct (cx, cy, m20, m02, m11), null when flat."""
    ar = sums[0] / 2
    cx, cy = sums[1] / (ar * 6), sums[2] / (ar * 6)
    return F.when(
        F.abs(ar) >= 1e-9,
        F.struct(
            cx.alias("cx"),
            cy.alias("cy"),
            (sums[3] / (ar * 12) - cx * cx).alias("m20"),
            (sums[4] / (ar * 12) - cy * cy).alias("m02"),
            (sums[5] / (ar * 24) - cx * cy).alias("m11"),
        ),
    )


def fit_ellipse(m: Column) -> Column:
    """Ellipse with the same moments: struct (a, b, deg, ratio) of semi-axes, angle and axis ratio."""
    diff = F.hypot(m["m20"] - m["m02"], m["m11"] * 2)
    big, small = (m["m20"] + m["m02"] + diff) / 2, (m["m20"] + m["m02"] - diff) / 2
    return F.when(
        m.isNotNull() & (big > 1e-9),
        F.struct(
            (F.sqrt(big) * 2).alias("a"),
            (F.sqrt(F.greatest(small, F.lit(0.0))) * 2).alias("b"),
            F.degrees(F.atan2(m["m11"] * 2, m["m20"] - m["m02"]) * 0.5).alias("deg"),
            F.when(small > 1e-9, F.sqrt(big / small)).otherwise(DEGENERATE_RATIO).alias("ratio"),
        ),
    )


def rotated_extent(poly: Column, deg: Column) -> Column:
    """Struct (w, h): unrounded width and height of the polygon turned by ``deg``."""
    es = edges(poly)
    c, s = F.cos(F.radians(deg)), F.sin(F.radians(deg))
    rx = F.transform(es, lambda e: e["x0"] * c - e["y0"] * s)
    ry = F.transform(es, lambda e: e["x0"] * s + e["y0"] * c)
    return F.struct((F.array_max(rx) - F.array_min(rx)).alias("w"), (F.array_max(ry) - F.array_min(ry)).alias("h"))


def upright_angle(ellipse: Column) -> Column:
    """Rotation that sets the long axis upright, folded to -90..90; 0 when the shape is too round."""
    deg = F.lit(90.0) - ellipse["deg"]
    folded = F.when(deg > 90, deg - 180).when(deg < -90, deg + 180).otherwise(deg)
    return F.when(ellipse.isNotNull() & (ellipse["ratio"] >= UPRIGHT_MIN_RATIO), folded).otherwise(0.0)


def crop_size(extent: Column) -> Column:
    """Struct (out_w, out_h): whole-pixel crop with its margin on all sides."""
    w, h = (F.greatest(F.lit(1), F.rint(extent[s]).cast("int")) for s in "wh")
    margin = F.greatest(F.lit(CROP_MARGIN_MIN), F.rint(F.greatest(w, h) * CROP_MARGIN).cast("int"))
    return F.struct((w + margin * 2).alias("out_w"), (h + margin * 2).alias("out_h"))


def nice_length(v: Column) -> Column:
    """Round to the 1-2-5 series."""
    e = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    m = v / e
    return F.when(v <= 0, 0.0).otherwise(
        F.when(m < 1.5, F.lit(1.0)).when(m < 3.5, F.lit(2.0)).when(m < 7.5, F.lit(5.0)).otherwise(F.lit(10.0)) * e
    )


def scalebar(width_px: Column, um_per_px: Column, share: float = 0.4) -> Column:
    """Struct (um, pct): a 1-2-5 bar not longer than ``share`` of the width."""
    full = width_px * um_per_px
    goal = full * share
    e = F.pow(F.lit(10.0), F.floor(F.log10(goal)))
    m = goal / e
    bar = F.when(m >= 5, F.lit(5.0)).when(m >= 2, F.lit(2.0)).otherwise(F.lit(1.0)) * e
    return F.when(goal > 0, F.struct(bar.alias("um"), (bar * 100 / full).alias("pct")))
