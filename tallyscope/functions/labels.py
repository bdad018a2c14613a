"""Training label lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.boxes import Box
from tallyscope.functions.polygon import axis_values, is_polygon


def _six(v: Column) -> Column:
    # Ties go to the even digit, as C and Python print them; Java's formatter would round them up.
    return F.format_string("%.6f", F.bround(v, 6))


def bbox_label(box: Box, width: Column, height: Column, cls: Column) -> Column:
    """``cls cx cy w h``, normalised and clipped to the image; null when a side is one pixel or less."""
    x0, y0 = F.greatest(F.lit(0.0), box.x.cast("double")), F.greatest(F.lit(0.0), box.y.cast("double"))
    x1, y1 = F.least(width.cast("double"), (box.x + box.w).cast("double")), F.least(height.cast("double"), (box.y + box.h).cast("double"))
    w, h = x1 - x0, y1 - y0
    line = F.concat_ws(" ", cls.cast("string"), _six((x0 + w / 2) / width), _six((y0 + h / 2) / height), _six(w / width), _six(h / height))
    return F.when((w > 1) & (h > 1), line)


def seg_label(poly: Column, width: Column, height: Column, cls: Column) -> Column:
    """``cls x1 y1 x2 y2 ...``, normalised and clipped; null for less than three points."""

    def one(v: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, width).otherwise(height)
        return _six(F.least(F.greatest(v, F.lit(0.0)), size) / size)

    return F.when(is_polygon(poly), F.concat_ws(" ", cls.cast("string"), F.array_join(F.transform(poly, one), " ")))


def read_labels(df: DataFrame, line: str, width: Column, height: Column) -> DataFrame:
    """Add x1, y1, x2, y2 in pixels for a label line, box or polygon; null for a short line."""
    numbers = F.transform(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), lambda p: p.try_cast("double"))
    v = F.col("_v")
    is_box = F.size(v) == 4
    centre = [F.get(v, F.lit(i)) for i in (0, 1)]
    half = [F.get(v, F.lit(i)) / 2 for i in (2, 3)]
    poly = [axis_values(v, i) for i in (0, 1)]
    enough = F.size("_parts") >= 5

    def side(box_value: Column, poly_value: Column, scale: Column) -> Column:
        return F.when(enough, F.when(is_box, box_value).otherwise(poly_value) * scale)

    staged = df.withColumn("_parts", F.split(F.trim(line), r"\s+")).withColumn("_v", numbers)
    return staged.withColumns(
        {
            "x1": side(centre[0] - half[0], F.array_min(poly[0]), width),
            "y1": side(centre[1] - half[1], F.array_min(poly[1]), height),
            "x2": side(centre[0] + half[0], F.array_max(poly[0]), width),
            "y2": side(centre[1] + half[1], F.array_max(poly[1]), height),
        }
    ).drop("_parts", "_v")
