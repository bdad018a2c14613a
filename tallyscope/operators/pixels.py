"""Focus and texture over pixel tables: long rows for what joins and aggregates can say, Arrow batches for spectra."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions of this module travel to the workers whole, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The period of the searched structure in micrometres, and the least sizes that carry a spectrum.
PERIOD_UM = (0.4, 1.6)
MIN_SIDE, MIN_PIXELS, MIN_BAND, MIN_PERIOD_PX = 16, 100, 20, 2.5


def depth_from_focus(pixels: DataFrame, confidence_pct: float = 50.0) -> DataFrame:
    """Sharpest slice of every pixel, its value, the depth between slices, and whether the pixel can be trusted.

    ``pixels``: group, pos, slice (from 0), score, value. A parabola through the best slice and its two neighbours refines
    the depth by at most one slice; border slices stay unrefined. A pixel counts when its best score is above the given
    percentile of its group and above three times the noise floor (the median of the lower half).
    """
    key = ["group", "pos"]
    rank = F.struct("score", (-F.col("slice")).alias("s"))
    best = pixels.groupBy(*key).agg(
        F.max_by("slice", rank).alias("best"), F.max("score").alias("conf"), F.max_by("value", rank).alias("fused"), (F.max("slice") + 1).alias("_n")
    )
    mid = F.greatest(F.lit(1), F.least(F.col("best"), F.col("_n") - 2))
    at = best.select(*key, mid.alias("_mid"))
    d = F.col("slice") - F.col("_mid")
    near = pixels.join(at, key).filter(d.between(-1, 1)).groupBy(*key, "_mid").agg(*[F.max(F.when(d == o, F.col("score"))).alias(f"_s{i}") for i, o in enumerate((-1, 0, 1))])
    curve = F.col("_s0") - F.col("_s1") * 2 + F.col("_s2")
    shift = F.when(F.abs(curve) > 1e-6, (F.col("_s0") - F.col("_s2")) * 0.5 / (curve + 1e-12)).otherwise(0.0)
    inner = F.col("_mid") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shift))
    border = (F.col("best") == 0) | (F.col("best") == F.col("_n") - 1)
    # One image has a bounded number of pixels, so its exact percentiles fit an aggregate buffer.
    q = best.groupBy("group").agg(F.percentile("conf", 0.5).alias("_half"), F.percentile("conf", confidence_pct / 100).alias("_gate"))
    floor = best.join(q, "group").filter(F.col("conf") <= F.col("_half")).groupBy("group").agg(F.percentile("conf", 0.5).alias("_floor"))
    out = best.join(near, key, "left").join(q.join(floor, "group"), "group")
    trusted = (F.col("conf") > F.col("_gate")) & (F.col("conf") > F.col("_floor") * 3)
    return out.select(*key, "best", "fused", "conf", F.when(border, F.col("best").cast("double")).otherwise(inner).alias("depth"), trusted.alias("trusted"))


def fusion_gain(pixels: DataFrame, depth: DataFrame) -> DataFrame:
    """Mean sharpness on trusted pixels: best single slice, fused, and their ratio."""
    good = depth.filter("trusted").select("group", "pos", "conf")
    per_slice = pixels.join(good, ["group", "pos"]).groupBy("group", "slice").agg(F.avg("score").alias("_s"))
    single = per_slice.groupBy("group").agg(F.max("_s").alias("best_single"))
    fused = good.groupBy("group").agg(F.avg("conf").alias("fused"), F.count("*").alias("n_pixels"))
    j = fused.join(single, "group")
    return j.withColumn("gain", F.col("fused") / F.greatest(F.col("best_single"), F.lit(1e-6)))


def texture_score(pictures: DataFrame, keep: list[str]) -> DataFrame:
    """Peak over median spectral energy in the band of the structure; 0 when the mask is too small to tell.

    ``pictures``: keep, gray and mask (flat arrays), width, um_per_px.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = []
            for g, m, w, um in zip(b["gray"], b["mask"], b["width"], b["um_per_px"]):
                img = np.asarray(g, dtype=np.float32).reshape(-1, int(w))
                values.append(_score(img, np.asarray(m, dtype=bool).reshape(img.shape), um))
            yield b[keep].assign(texture=values)

    rows = pictures.select(*keep, "gray", "mask", "width", "um_per_px")
    return rows.mapInPandas(score, rows.select(*keep).schema.add("texture", T.DoubleType()))


def _score(img: np.ndarray, inside: np.ndarray, um: float) -> float:
    h, w = img.shape
    shortest, longest = PERIOD_UM[0] / um, PERIOD_UM[1] / um
    if min(h, w) < MIN_SIDE or inside.sum() < MIN_PIXELS or longest < MIN_PERIOD_PX:
        return 0.0
    # The surroundings take the mean of the object, so that its outline leaves no mark in the spectrum.
    flat = np.where(inside, img, img[inside].mean())
    window = np.outer(np.hanning(h), np.hanning(w))
    energy = np.abs(np.fft.fft2((flat - flat.mean()) * window)) ** 2
    # Frequencies of the shifted grid, whose centre lies half a pixel off for odd sides.
    fy = (np.arange(h) - h / 2) / h
    fx = (np.arange(w) - w / 2) / w
    radius = np.hypot(fy[:, None], fx[None, :])
    band = np.fft.fftshift(energy)[(radius >= 1 / longest) & (radius <= 1 / shortest)]
    if band.size < MIN_BAND:
        return 0.0
    middle = float(np.median(band))
    return float(band.max() / middle) if middle > 0 else 0.0


def image_sharpness(pictures: DataFrame, keep: list[str]) -> DataFrame:
    """Variance of the Laplacian; borders mirror the inner pixels. ``pictures``: keep, gray (a flat array), width."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = []
            for g, w in zip(b["gray"], b["width"]):
                p = np.pad(np.asarray(g, dtype=np.float64).reshape(-1, int(w)), 1, mode="reflect")
                lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
                values.append(float(lap.var()))
            yield b[keep].assign(sharpness=values)

    rows = pictures.select(*keep, "gray", "width")
    return rows.mapInPandas(score, rows.select(*keep).schema.add("sharpness", T.DoubleType()))
