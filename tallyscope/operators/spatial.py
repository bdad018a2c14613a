"""Box joins that stay equi-joins: a hierarchical grid keyed by (group, level, cell).

A group (one detection, one image) may hold a large share of all boxes, so pairs are never made by joining on the
group alone. Each box sits on the grid level whose cell is as large as its longer side; it then touches at most three
cells per axis, and a hot group spreads over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.boxes import Box

DEFAULT_MAX_SIDE = 4096


def _level(box: Box, top: int) -> Column:
    side = F.greatest(box.w, box.h, F.lit(1))
    return F.least(F.ceil(F.log2(side)).cast("int"), F.lit(top))


def _cells(lo: Column, hi: Column, cell: Column) -> Column:
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def centre_in_box(
    points: DataFrame,
    boxes: DataFrame,
    keys: list[str],
    point: Box,
    box: Box,
    max_side: int = DEFAULT_MAX_SIDE,
    any_larger: bool = False,
) -> DataFrame:
    """Pairs (point row, box row) of one group where the centre of ``point`` lies in the closed ``box``.

    Sides may differ by a factor of two at most, unless ``any_larger`` lets the box be any larger one. The non-key
    columns of the two sides must have different names. ``max_side`` tunes the coarsest cell; larger boxes still match,
    they only touch more cells.
    """
    top = max(1, (max_side - 1).bit_length())
    cell = F.pow(F.lit(2.0), F.col("_lvl"))
    cx, cy = point.centre
    near = F.greatest(_level(point, top) - 1, F.lit(0))
    far = F.lit(top) if any_larger else F.least(_level(point, top) + 1, F.lit(top))
    left = (
        points.withColumn("_lvl", F.explode(F.sequence(near, far)))
        .withColumn("_cx", F.floor(cx / cell))
        .withColumn("_cy", F.floor(cy / cell))
    )
    right = (
        boxes.withColumn("_lvl", _level(box, top))
        .withColumn("_cx", F.explode(_cells(box.x, box.x + box.w, cell)))
        .withColumn("_cy", F.explode(_cells(box.y, box.y + box.h, cell)))
    )
    return (
        left.join(right, [*keys, "_lvl", "_cx", "_cy"])
        .filter((cx >= box.x) & (cx <= box.x + box.w) & (cy >= box.y) & (cy <= box.y + box.h))
        .drop("_lvl", "_cx", "_cy")
    )


def touching(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    a: Box,
    b: Box,
    max_side: int = DEFAULT_MAX_SIDE,
) -> DataFrame:
    """Pairs of one group whose boxes touch or overlap, each pair once.

    Both sides are laid on every level from their own one upward, and a pair meets on the coarser of its two levels, in
    the cell that holds the upper left corner of the intersection.
    """
    top = max(1, (max_side - 1).bit_length())
    cell = F.pow(F.lit(2.0), F.col("_lvl"))

    def lay(df: DataFrame, box: Box, own: str) -> DataFrame:
        return (
            df.withColumn(own, _level(box, top))
            .withColumn("_lvl", F.explode(F.sequence(F.col(own), F.lit(top))))
            .withColumn("_cx", F.explode(_cells(box.x, box.x + box.w, cell)))
            .withColumn("_cy", F.explode(_cells(box.y, box.y + box.h, cell)))
        )

    x0, y0 = F.greatest(a.x, b.x), F.greatest(a.y, b.y)
    x1, y1 = F.least(a.x + a.w, b.x + b.w), F.least(a.y + a.h, b.y + b.h)
    return (
        lay(left, a, "_la")
        .join(lay(right, b, "_lb"), [*keys, "_lvl", "_cx", "_cy"])
        .filter(F.col("_lvl") == F.greatest("_la", "_lb"))
        .filter((x0 <= x1) & (y0 <= y1))
        .filter((F.floor(x0 / cell) == F.col("_cx")) & (F.floor(y0 / cell) == F.col("_cy")))
        .drop("_lvl", "_cx", "_cy", "_la", "_lb")
    )
