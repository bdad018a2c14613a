"""Column expressions on integer boxes (x, y, w, h)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """The four columns of a box."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "bbox_") -> "Box":
        return cls(*(F.col(prefix + c) for c in "xywh"))

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def centre(self) -> tuple[Column, Column]:
        return self.x + self.w / F.lit(2.0), self.y + self.h / F.lit(2.0)

    def grown(self, k: float) -> "Box":
        """The box enlarged k times about its centre."""
        dx, dy = self.w * F.lit((k - 1) / 2), self.h * F.lit((k - 1) / 2)
        return Box(self.x - dx, self.y - dy, self.w * F.lit(float(k)), self.h * F.lit(float(k)))


def mask_key(box: Box) -> Column:
    return F.concat_ws("_", *(c.cast("string") for c in box))


def key_to_bbox(key: Column) -> Column:
    """``x_y_w_h`` back to four ints; null when the key is not such a text (hand-drawn masks)."""
    parts = F.split(key, "_")
    nums = F.transform(parts, lambda p: p.try_cast("int"))
    good = (F.size(parts) == 4) & ~F.exists(nums, lambda n: n.isNull())
    return F.when(good, nums)


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    ix = F.greatest(zero, F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x))
    iy = F.greatest(zero, F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y))
    return ix * iy


def bbox_iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when((inter <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def bbox_cover(a: Box, b: Box) -> Column:
    """Share of ``a`` that lies in ``b``."""
    return intersection(a, b) / F.greatest(a.area, F.lit(1))


def hexagon(box: Box) -> Column:
    """Flat polygon of the hexagon inscribed in a box."""
    x, y, w, h = box
    pts = [x, y + h / 2, x + w / 4, y, x + w * 3 / 4, y, x + w, y + h / 2, x + w * 3 / 4, y + h, x + w / 4, y + h]
    return F.array(*(p.cast("double") for p in pts))
