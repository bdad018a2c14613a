"""Toxic passages by maximum-scoring segments over token log-odds.

Fit: over the labelled rows, the documents of each class that use a word are counted, and so are those that use one of its
stems (proper prefixes of several lengths); one document counts once, however often it repeats a word. The share of a word's documents
that are toxic gets a Dirichlet prior around the overall share; its score is the lower end of the log-odds against that
share, so that a rare word proves nothing. A word counts as much as the best of itself
and its stems, less a drift that makes the mean score of ordinary text negative.

Scan: the maximal scoring segments of a document are found in one pass (Ruzzo and Tompa). The best sum over ordinary
text follows an extreme-value law whose place grows with the log of the length; place and scale are fitted on clean
rows that the counts did not see, and a logistic curve on the standardised sum gives the score.

Counts live in a hashed table of fixed size, so what is broadcast is bounded. Fit and calibration each use at most
``rows_per_class`` labelled rows of each class, the first by a hash of the id.

Null, empty and wordless texts have no segment and score as the cleanest text of no words. Labels without a document,
null labels and null ids teach nothing; repeated rows are scored each. Without labels of both classes the score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import WORD_BYTES, mapped, octets, pick, slices
from tallyscope.session import cut

SLOTS = 1 << 21
STEMS = (4, 5, 6, 7, 8)
PRIOR = 4.0
SIGMAS = 3.0
DRIFT = 0.3
NOTHING = -0.5  # score of words that prove nothing
TOP = 60.0
ROWS_PER_CLASS = 8192
CACHE_WORDS = 400_000
SCORED = "doc_id bigint, n_words bigint, top double, segments array<struct<start:bigint,stop:bigint,sum:double>>"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@dataclass(frozen=True)
class Model:
    slots: np.ndarray  # lower bound of the log-odds of each slot
    place: float = 0.0
    slope: float = 0.0
    scale: float = 1.0
    base: float = -30.0
    gain: float = 0.0


def slots(word: bytes) -> list[int]:
    """Of the word and of its proper prefixes."""
    return [zlib.crc32(word) % SLOTS] + [zlib.crc32(word[:k] + b"*") % SLOTS for k in STEMS if k < len(word)]


def lower_bounds(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Lower end of the log-odds of slots with these counts against the overall share."""
    a, b = toxic + PRIOR * share, clean + PRIOR * (1 - share)
    odds = np.log(a / b) - math.log(share / (1 - share))
    return (odds - SIGMAS * np.sqrt(1 / a + 1 / b)).astype(np.float32)


def bound_column(share: float) -> Column:
    """``lower_bounds`` of the columns toxic and clean."""
    a, b = F.col("toxic") + PRIOR * share, F.col("clean") + PRIOR * (1 - share)
    return F.log(a / b) - math.log(share / (1 - share)) - SIGMAS * F.sqrt(1 / a + 1 / b)


def counts(labelled: DataFrame) -> DataFrame:
    """Toxic and clean rows that use each slot: (slot, toxic, clean); the sums over all words are in slot -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros((2, SLOTS + 1), np.int32)
        known: dict[bytes, list[int]] = {}
        for batch in slices(batches, "text"):
            if len(known) > CACHE_WORDS // 2:
                known.clear()
            for label, raw in zip(batch.column("label").to_pylist(), octets(batch.column("text"))):
                words = set(raw.translate(WORD_BYTES).split())
                found: set[int] = set()
                for w in words:
                    if w not in known:
                        known[w] = slots(w)
                    found.update(known[w])
                uses[label, list(found)] += 1
                uses[label, SLOTS] += len(words)
        slot = np.flatnonzero(uses.any(0))
        for at in range(0, len(slot), 1 << 16):
            part = slot[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(part == SLOTS, -1, part)), *(pa.array(uses[k, part].astype(np.int64)) for k in (1, 0))], names=["slot", "toxic", "clean"])

    return labelled.mapInArrow(run, "slot bigint, toxic bigint, clean bigint")


def maximal_segments(positions: list[int], gains: list[float], losses: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments. ``gains`` are the positive scores at ``positions``; ``losses[k]`` is the (negative)
    sum between the (k-1)-th and the k-th. A list of candidates, each with the cumulative sums left of it and at its
    end, is kept as in the linear algorithm of Ruzzo and Tompa."""
    found: list[list] = []  # start, stop, left sum, right sum, previous candidate with a smaller left sum
    total = 0.0
    for at, gain, loss in zip(positions, gains, losses):
        total += loss
        now = [at, at + 1, total, total + gain, -1]
        total += gain
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            now[4] = j
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3], -1]
            del found[j:]
    return [(s, e, right - left) for s, e, left, right, _ in found]


SCORES: dict[str, dict[bytes, float]] = {}


def passages(documents: DataFrame, model: Model, key: str) -> DataFrame:
    """Columns id, text -> the segments of each row (in words) and their highest sum. ``key`` names the model."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = SCORES.setdefault(key, {})
        if len(known) > CACHE_WORDS:
            known.clear()
        bounds = shared.value.slots
        sizes, tops, segments = [], [], []
        for raw in octets(batch.column("text")):
            words = raw.translate(WORD_BYTES).split()
            for w in set(words):
                if w not in known:
                    known[w] = float(bounds[slots(w)].max()) - DRIFT
            score = np.array([known[w] for w in words])
            at = np.flatnonzero(score > 0)
            found = []
            if len(at):
                before = np.cumsum(score) - score
                losses = np.diff(np.concatenate(([0.0], before[at]))) - np.concatenate(([0.0], score[at[:-1]]))
                losses[0] = before[at[0]]
                found = maximal_segments(at.tolist(), score[at].tolist(), losses.tolist())
            sizes.append(len(words))
            tops.append(max((s for _, _, s in found), default=0.0))
            segments.append([{"start": a, "stop": b, "sum": s} for a, b, s in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("sum", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tops, pa.float64()), pa.array(segments, kind)],
                                          names=["doc_id", "n_words", "top", "segments"])

    return mapped(documents.select("id", "text"), step, SCORED)


def calibrate(model: Model, rows: list) -> Model:
    """``rows`` are (label, log2 of words, quarter of the highest sum, count)."""
    label, size, top, n = (np.array(c, float) for c in zip(*rows))
    length, top = np.log1p(2**size), top / 4
    clean, toxic = label == 0, label == 1
    if not clean.any() or not toxic.any():
        return model
    w = n[clean]
    mean_l, mean_t = np.average(length[clean], weights=w), np.average(top[clean], weights=w)
    spread = np.average((length[clean] - mean_l) ** 2, weights=w)
    slope = max(0.0, np.average((length[clean] - mean_l) * (top[clean] - mean_t), weights=w) / spread if spread > 0 else 0.0)
    rest = top[clean] - slope * length[clean]
    # Method of moments for the Gumbel law: variance = (pi * scale)^2 / 6, mean = place + gamma * scale.
    scale = max(0.25, math.sqrt(6 * np.average((rest - np.average(rest, weights=w)) ** 2, weights=w)) / math.pi)
    place = float(np.average(rest, weights=w)) - np.euler_gamma * scale
    x = (top - place - slope * length) / scale
    # Logistic curve by Newton steps; both classes weigh the same, and a little ridge keeps separable data finite.
    weight = n * np.where(toxic, 0.5 / n[toxic].sum(), 0.5 / n[clean].sum())
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (toxic - p)) - 1e-4 * beta * [0, 1]
        hess = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([1e-9, 1e-4])
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return Model(model.slots, place, slope, scale, float(beta[0]), float(beta[1]))


def sample(marks: DataFrame, rows_per_class: int) -> DataFrame:
    """At most so many rows of each class of (mark, label): the first by a hash of the id."""
    parts = [marks.where(F.col("label") == c).orderBy(F.xxhash64("mark"), "mark").limit(rows_per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(documents: DataFrame, labels: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        held_out: int = 2, calibrating: int = 3, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Labels of rows in fold ``held_out`` are never read; fold ``calibrating`` serves the calibration alone. Both the
    counts and the calibration use at most ``rows_per_class`` labelled rows of each class, so ids fit a broadcast."""
    docs = pick(documents, id=doc_id, text=text)
    marks = pick(labels, mark=doc_id, label=label).where("label in (0, 1) and mark is not null").where(fold(F.col("mark")) != held_out)
    counted = sample(marks.where(fold(F.col("mark")) != calibrating), rows_per_class)
    rows = counts(docs.join(F.broadcast(counted), F.col("id") == F.col("mark")).select("label", "text"))
    summed = cut(rows.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    total = summed.where("slot < 0").first()
    bounds = np.full(SLOTS, NOTHING, np.float32)
    if total is None or not total.toxic or not total.clean:
        return Model(bounds)
    # Slots that prove something, a row per slot at most, make the table.
    share = total.toxic / (total.toxic + total.clean)
    found = summed.where("slot >= 0").where(bound_column(share) > NOTHING).toArrow()
    slot, toxic, clean = (found[c].to_numpy() for c in ("slot", "toxic", "clean"))
    bounds[slot] = np.maximum(lower_bounds(toxic, clean, share), NOTHING)
    model = Model(bounds)
    chosen = sample(marks.where(fold(F.col("mark")) == calibrating), rows_per_class)
    seen = docs.join(F.broadcast(chosen), F.col("id") == F.col("mark")).select("id", "text")
    tops = passages(seen, model, key).groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.max("top").alias("top"))
    cells = tops.join(F.broadcast(chosen), F.col("doc_id") == F.col("mark")).groupBy(
        "label", F.floor(F.log2(F.col("n_words") + 1)).alias("size"), F.round(F.least(F.col("top"), F.lit(TOP)) * 4).alias("quarter")).count()
    grid = [tuple(r) for r in cells.collect()]
    return calibrate(model, grid) if grid else model


def score(documents: DataFrame, model: Model, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, and the segments of every row."""
    found = passages(pick(documents, id=doc_id, text=text), model, key)
    x = (F.least(F.col("top"), F.lit(TOP)) - model.place - model.slope * F.log1p(F.col("n_words").cast("double"))) / model.scale
    logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.base + model.gain * x))
    return found.withColumn("score", 1 / (1 + F.exp(-logit)))
