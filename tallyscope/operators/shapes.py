"""Polygon measures and tighter boxes."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions import polygon as pg

# Functions of this module travel to the workers whole, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIGURES = "area perimeter hull_area hull_perimeter a b overlap ellipse_area box_w box_h turned_w turned_h".split()
SHAPE = T.StructType([T.StructField(n, T.DoubleType()) for n in FIGURES])
ELLIPSE_CORNERS = 72


def _hull(points: list[tuple[float, float]]) -> tuple[float, float]:
    """(area, perimeter) of the convex hull, found by turning from corner to corner."""
    pts = sorted(set(points))
    ring: list[tuple[float, float]] = []
    at = pts[0]
    while at not in ring and len(pts) > 2:
        ring.append(at)
        ax, ay = at
        bx = by = None
        for x, y in pts:
            if (x, y) == at:
                continue
            if bx is None:
                bx, by = x, y
                continue
            turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if turn < 0 or (turn == 0 and (x - ax) ** 2 + (y - ay) ** 2 > (bx - ax) ** 2 + (by - ay) ** 2):
                bx, by = x, y
        at = (bx, by)
    area = length = 0.0
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        area += x0 * y1 - x1 * y0
        length += ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    return abs(area) / 2, length


def _signed(edges: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Signed area each polygon shares with the regular 72-gon in the unit circle, all edges of a batch at once.

    ``edges``: rows (x0, y0, x1, y1) in the frame where the ellipse is the unit circle; ``owner``: polygon of each edge.
    An edge spans a triangle with the centre. Seen from there it falls into the sectors of the 72-gon, and in each of
    them what lies inside is a triangle, a piece of the sector, or one of each; signed sums over the edges give the area.
    """
    p, q = edges[:, 0:2], edges[:, 2:4]
    sign = np.sign(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1])
    flip = (sign < 0)[:, None]
    p, q = np.where(flip, q, p), np.where(flip, p, q)
    start = np.arctan2(p[:, 1], p[:, 0])
    sweep = np.mod(np.arctan2(q[:, 1], q[:, 0]) - start, 2 * np.pi)
    step = 2 * np.pi / ELLIPSE_CORNERS
    # An edge seen from the centre sweeps less than half a turn, so it meets at most half of the sectors and one more.
    k = np.floor(start / step)[:, None] + np.arange(ELLIPSE_CORNERS // 2 + 1)[None, :]
    lo = np.maximum(k * step, start[:, None])
    hi = np.minimum((k + 1) * step, (start + sweep)[:, None])
    seen = (hi > lo) & (sign != 0)[:, None]
    normal = np.stack([q[:, 1] - p[:, 1], p[:, 0] - q[:, 0]], axis=1)
    dist = (normal * p).sum(axis=1)
    middle, apothem = (k + 0.5) * step, np.cos(step / 2)

    def reach(angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            line = dist[:, None] / (normal[:, :1] * np.cos(angle) + normal[:, 1:] * np.sin(angle))
        return np.where(np.isfinite(line) & (line > 0), line, np.inf), apothem / np.cos(angle - middle)

    def wedge(r0: np.ndarray, r1: np.ndarray, angle: np.ndarray) -> np.ndarray:
        return 0.5 * r0 * r1 * np.sin(angle)

    (l0, c0), (l1, c1) = reach(lo), reach(hi)
    in0, in1 = l0 <= c0, l1 <= c1
    # Where the edge crosses the chord of the sector inside it.
    nx, ny = np.cos(middle), np.sin(middle)
    det = normal[:, :1] * ny - normal[:, 1:] * nx
    with np.errstate(divide="ignore", invalid="ignore"):
        cx = (dist[:, None] * ny - normal[:, 1:] * apothem) / det
        cy = (normal[:, :1] * apothem - dist[:, None] * nx) / det
    mixed = in0 != in1
    rc = np.where(mixed, np.hypot(cx, cy), 0.0)
    at = np.where(mixed, lo + np.mod(np.arctan2(cy, cx) - lo, 2 * np.pi), lo)
    r0, r1 = np.where(in0, l0, c0), np.where(in1, l1, c1)
    piece = np.where(mixed, wedge(r0, rc, at - lo) + wedge(rc, r1, hi - at), wedge(r0, r1, hi - lo))
    total = np.where(seen, piece, 0.0).sum(axis=1) * sign
    return np.bincount(owner, weights=total, minlength=n)


@F.pandas_udf(SHAPE)
def _figures(polygons: pd.Series) -> pd.DataFrame:
    """Measures of a batch of flat polygons; the edges of all of them are handled as one table."""
    polygons, n = polygons.tolist(), len(polygons)
    out = pd.DataFrame(np.nan, index=range(n), columns=FIGURES)
    good = [i for i, f in enumerate(polygons) if f is not None and len(f) >= 6]
    if not good:
        return out
    rings = [np.asarray(polygons[i], dtype=float)[: len(polygons[i]) // 2 * 2].reshape(-1, 2) for i in good]
    size = np.array([len(r) for r in rings])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    who = np.repeat(np.arange(len(rings)), size)
    p = np.concatenate(rings)
    q = np.concatenate([np.roll(r, -1, axis=0) for r in rings])

    def total(v: np.ndarray) -> np.ndarray:
        return np.bincount(who, weights=v, minlength=len(rings))

    (x0, y0), (x1, y1) = p.T, q.T
    c = x0 * y1 - x1 * y0
    area = total(c) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        cx, cy = total((x0 + x1) * c) / (6 * area), total((y0 + y1) * c) / (6 * area)
        m20 = total(c * (x0 * x0 + x0 * x1 + x1 * x1)) / (12 * area) - cx * cx
        m02 = total(c * (y0 * y0 + y0 * y1 + y1 * y1)) / (12 * area) - cy * cy
        m11 = total(c * (2 * x0 * y0 + x0 * y1 + x1 * y0 + 2 * x1 * y1)) / (24 * area) - cx * cy
    spread = np.hypot(m20 - m02, 2 * m11)
    big, small = (m20 + m02 + spread) / 2, (m20 + m02 - spread) / 2
    fits = (np.abs(area) >= 1e-9) & (big > 1e-9)
    with np.errstate(invalid="ignore"):
        a, b = 2 * np.sqrt(big), 2 * np.sqrt(np.maximum(small, 0))
    turn = np.where(fits, 0.5 * np.arctan2(2 * m11, m20 - m02), 0.0)
    # Turned back by the angle of the ellipse: the upright frame of the sides, and of the overlap.
    cos, sin = np.cos(turn)[who], np.sin(turn)[who]
    frame = np.stack([x0 * cos + y0 * sin, y0 * cos - x0 * sin], axis=1)
    turned = np.maximum.reduceat(frame, first) - np.minimum.reduceat(frame, first)
    low, high = np.floor(np.minimum.reduceat(p, first)), np.ceil(np.maximum.reduceat(p, first))
    box = np.maximum(1, high - low)
    round_ = fits & (b > 0)
    centre = np.stack([cx * np.cos(turn) + cy * np.sin(turn), cy * np.cos(turn) - cx * np.sin(turn)], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = (frame - centre[who]) / np.stack([a, b], axis=1)[who]
    ahead = np.arange(len(p)) + 1
    ahead[first + size - 1] = first
    edges = np.hstack([unit, unit[ahead]])[round_[who]]
    share, owner = np.zeros(len(rings)), who[round_[who]]
    # Blocks of edges keep the sector table of one step small.
    for at in range(0, len(edges), 20_000):
        share += _signed(edges[at : at + 20_000], owner[at : at + 20_000], len(rings))
    whole = ELLIPSE_CORNERS / 2 * np.sin(2 * np.pi / ELLIPSE_CORNERS)
    hulls = np.array([_hull([tuple(v) for v in r.tolist()]) for r in rings])
    cols = [np.abs(area), total(np.hypot(x1 - x0, y1 - y0)), hulls[:, 0], hulls[:, 1]]
    cols += [np.where(fits, v, np.nan) for v in (a, b)]
    cols += [np.where(round_, v * a * b, np.nan) for v in (np.abs(share), whole)]
    cols += [box[:, 0], box[:, 1], *[np.where(fits, turned[:, i], np.nan) for i in (0, 1)]]
    out.iloc[good] = np.stack(cols, axis=1)
    return out


def basic_measures(df: DataFrame, polygon: str) -> DataFrame:
    """Add area, perimeter, box and the ellipse of equal moments; all by column expressions."""
    staged = df.withColumn("_edges", F.when(pg.is_polygon(F.col(polygon)), pg.edges(F.col(polygon))))
    staged = staged.withColumn("_sums", pg.moment_sums(F.col("_edges")))
    staged = staged.withColumn("_m", pg.polygon_moments(F.col("_sums"))).withColumn("_e", pg.fit_ellipse(F.col("_m")))
    return staged.withColumn("_a", pg.polygon_area(F.col(polygon))).withColumn("_p", pg.polygon_perimeter(F.col(polygon))).withColumn("_box", pg.polygon_bbox(F.col(polygon)))


def measure_polygons(df: DataFrame, polygon: str, um_per_px: Column) -> DataFrame:
    """Add the measures of a mask drawn or edited by a person; null where a shape cannot be measured.

    Hull and ellipse overlap have no column expression, and walking the corners in one is interpreted row by row; so one
    Arrow batch function gives the raw figures, and the measures are made of them here.
    """
    s = df.withColumn("_f", _figures(F.col(polygon)))
    f = {n: F.nanvl(F.col(f"_f.{n}"), F.lit(None).cast("double")) for n in FIGURES}
    one = F.lit(1.0)
    ok = f["area"] > 0
    union = f["area"] + f["ellipse_area"] - f["overlap"]
    out = {
        "area_px": F.rint(f["area"]).cast("bigint"),
        "fill_ratio": F.round(f["area"] / (f["box_w"] * f["box_h"]), 4),
        "circularity": F.round(F.least(one, f["area"] * (4 * np.pi) / (f["perimeter"] * f["perimeter"])), 4),
        "solidity": F.round(F.least(one, f["area"] / f["hull_area"]), 4),
        "convexity": F.round(F.least(one, f["hull_perimeter"] / f["perimeter"]), 4),
        "elongation": F.when(f["b"] > 1e-9, F.round(f["a"] / f["b"], 4)),
        "ellipse_iou": F.when(union > 0, F.round(f["overlap"] / union, 4)),
        "area_um2": F.round(f["area"] * um_per_px * um_per_px, 3),
        "major_um": F.round(f["a"] * 2 * um_per_px, 3),
        "minor_um": F.round(f["b"] * 2 * um_per_px, 3),
        "long_side_um": F.round(F.greatest(f["turned_w"], f["turned_h"]) * um_per_px, 3),
        "short_side_um": F.round(F.least(f["turned_w"], f["turned_h"]) * um_per_px, 3),
    }
    return s.withColumns({k: F.when(ok, v) for k, v in out.items()}).drop("_f")


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("rot", "w", "h")]))
def _upright(polygons: pa.Array) -> pa.Array:
    """Upright rotation of a batch of flat polygons and their extent when turned by it, all corners as one table. Null for
    a polygon of fewer than three corners, with a null, or with figures that are not finite."""
    size = np.asarray(pc.fill_null(pc.list_value_length(polygons), 0)).astype(np.int64)
    flat = pc.list_flatten(polygons).to_numpy(zero_copy_only=False).astype(float)  # a null becomes NaN
    n = len(size)
    start = np.cumsum(size) - size
    corners = np.where(size >= 6, size // 2, 0)
    who = np.repeat(np.arange(n), corners)
    first = np.cumsum(corners) - corners
    place = np.arange(len(who)) - first[who]
    x0, y0 = (flat[start[who] + 2 * place + odd] for odd in (0, 1))
    after = first[who] + np.where(place + 1 < corners[who], place + 1, 0)
    x1, y1 = x0[after], y0[after]
    total = lambda term: np.bincount(who, weights=term, minlength=n)  # noqa: E731  in the order of the corners
    with np.errstate(all="ignore"):
        c = x0 * y1 - x1 * y0
        area = total(c) / 2
        cx, cy = total((x0 + x1) * c) / (area * 6), total((y0 + y1) * c) / (area * 6)
        m20 = total(c * (x0 * x0 + x0 * x1 + x1 * x1)) / (area * 12) - cx * cx
        m02 = total(c * (y0 * y0 + y0 * y1 + y1 * y1)) / (area * 12) - cy * cy
        m11 = total(c * (x0 * y0 * 2 + x0 * y1 + x1 * y0 + x1 * y1 * 2)) / (area * 24) - cx * cy
        diff = np.hypot(m20 - m02, m11 * 2)
        big, small = (m20 + m02 + diff) / 2, (m20 + m02 - diff) / 2
        ratio = np.where(small > 1e-9, np.sqrt(big / small), pg.DEGENERATE_RATIO)
        deg = 90.0 - np.degrees(np.arctan2(m11 * 2, m20 - m02) * 0.5)
        deg = np.where(deg > 90, deg - 180, np.where(deg < -90, deg + 180, deg))
        rot = np.where((np.abs(area) >= 1e-9) & (big > 1e-9) & (ratio >= pg.UPRIGHT_MIN_RATIO), deg, 0.0)
        turn = np.radians(rot)[who]
        cos, sin = np.cos(turn), np.sin(turn)
        extent = []
        for v in (x0 * cos - y0 * sin, x0 * sin + y0 * cos):
            most, least = np.full(n, -np.inf), np.full(n, np.inf)
            some = corners > 0
            if some.any():
                most[some], least[some] = np.maximum.reduceat(v, first[some]), np.minimum.reduceat(v, first[some])
            extent.append(most - least)
        good = (corners > 0) & np.isfinite(total(c)) & np.isfinite(rot) & np.isfinite(extent[0]) & np.isfinite(extent[1])
        good &= (np.abs(area) < 1e-9) | np.isfinite(diff)
    return pa.StructArray.from_arrays([pa.array(v) for v in (rot, *extent)], names=["rot", "w", "h"], mask=pa.array(~good))


def crop_geometry(df: DataFrame, polygon: str) -> DataFrame:
    """Add ``rot`` (upright rotation) and the crop size ``out_w``, ``out_h`` with its margin.

    Walking the corners in column expressions is interpreted row by row, so an Arrow batch function does it; only what
    it gives back as null, which is no proper polygon, goes through the expressions.
    """
    s = df.withColumn("_u", _upright(F.col(polygon).cast("array<double>")))
    s = s.withColumn("_odd", F.when(F.col("_u").isNull(), F.col(polygon)))
    s = s.withColumn("_edges", F.when(pg.is_polygon(F.col("_odd")), pg.edges(F.col("_odd"))))
    s = s.withColumn("_sums", pg.moment_sums(F.col("_edges")))
    s = s.withColumn("_m", pg.polygon_moments(F.col("_sums"))).withColumn("_e", pg.fit_ellipse(F.col("_m")))
    s = s.withColumn("rot", F.coalesce("_u.rot", pg.upright_angle(F.col("_e"))))
    turned = F.when(F.col("_u").isNotNull(), F.struct("_u.w", "_u.h")).otherwise(pg.rotated_extent(F.col("_odd"), F.col("rot")))
    s = s.withColumn("_x", turned).withColumn("_c", pg.crop_size(F.col("_x")))
    return s.withColumn("out_w", F.col("_c.out_w")).withColumn("out_h", F.col("_c.out_h")).drop("_u", "_odd", "_edges", "_sums", "_m", "_e", "_x", "_c")


def tighten_boxes(candidates: DataFrame, um_per_px: Column) -> DataFrame:
    """Boxes drawn in to the polygon, the sizes that follow, and the old and the new key.

    ``candidates``: detection_id, mask_key, bbox_*, area_px, polygon.
    """
    xs, ys = pg.axis_values(F.col("polygon"), 0), pg.axis_values(F.col("polygon"), 1)
    s = candidates.withColumns(
        {
            "new_x": F.array_min(xs),
            "new_y": F.array_min(ys),
            "new_w": F.array_max(xs) - F.array_min(xs),
            "new_h": F.array_max(ys) - F.array_min(ys),
        }
    )
    # Sides stay as they are; the key alone is rounded, halves to even.
    new_key = F.concat_ws("_", *[F.rint("new_" + c).cast("int").cast("string") for c in "xywh"])
    long, short = F.greatest("new_w", "new_h"), F.least("new_w", "new_h")
    return s.select(
        "detection_id", "mask_key", new_key.alias("new_key"), (new_key != F.col("mask_key")).alias("changed"),
        F.round(long * um_per_px, 2).alias("long_side_um"), F.round(short * um_per_px, 2).alias("short_side_um"),
        F.round(F.col("area_px") / F.greatest(F.col("new_w") * F.col("new_h"), F.lit(1)), 3).alias("fill_ratio"),
        (F.col("new_w") * F.col("new_h") / F.greatest(F.col("bbox_w") * F.col("bbox_h"), F.lit(1))).alias("shrink"),
    )


def remap_keys(corrections: DataFrame, tightened: DataFrame) -> DataFrame:
    """Corrections with the keys of the tightened boxes."""
    k = tightened.groupBy(F.col("detection_id").alias("image_id"), "mask_key").agg(F.min("new_key").alias("_new"))
    return corrections.join(k, ["image_id", "mask_key"], "left").select("image_id", "mask_key", F.coalesce("_new", "mask_key").alias("new_key"))


def outline_measures(df: DataFrame, polygon: str, um_per_px: Column) -> DataFrame:
    """Add what an outline that a person drew or edited says by itself: area, elongation, axes of its ellipse and sides of
    the box turned with it. Column expressions only, so that rows are measured where they are read; null where a shape
    has fewer than three corners or no area."""
    s = basic_measures(df, polygon)
    turned = s.withColumn("_t", pg.rotated_extent(F.col(polygon), -F.col("_e.deg")))
    ok = F.col("_a") > 0
    out = {
        "area_px": F.rint("_a").cast("bigint"),
        "elongation": F.when(F.col("_e.b") > 1e-9, F.round(F.col("_e.a") / F.col("_e.b"), 4)),
        "major_um": F.round(F.col("_e.a") * 2 * um_per_px, 3),
        "minor_um": F.round(F.col("_e.b") * 2 * um_per_px, 3),
        "long_side_um": F.round(F.greatest("_t.w", "_t.h") * um_per_px, 3),
        "short_side_um": F.round(F.least("_t.w", "_t.h") * um_per_px, 3),
        "area_um2": F.round(F.col("_a") * um_per_px * um_per_px, 3),
    }
    return turned.withColumns({k: F.when(ok, v) for k, v in out.items()}).drop("_edges", "_sums", "_m", "_e", "_a", "_p", "_box", "_t")
