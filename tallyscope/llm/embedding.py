"""Supervised subword embeddings for document quality.

Every word of a document has features: the word itself, the character n-grams of its bytes between edge marks, and its
shape; two equal neighbours are a feature as well. Features are hashed to ``SLOTS`` vectors of ``WIDTH`` numbers, a
document is the mean of the vectors of all its features, and a softmax over the two classes sits on top. Vectors and
output are learned by plain stochastic gradient descent, one document at a time, in numpy.

At most ``rows_per_class`` labelled rows of each class are used, the first by a hash of the id; both classes weigh the
same. For two classes the output of a mean is the mean of the outputs, so a document is scored from one number per
feature.

Null and empty texts have no feature and get the score of the bias alone. Labels without a document, null labels and null
ids teach nothing; repeated rows are scored each. Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import mapped, octets, pick

SLOTS, WIDTH = 1 << 17, 16
GRAMS = (3, 4, 5)
ROWS_PER_CLASS = 2000
EPOCHS, STEPS, RATE = 5, 6000, 0.4
CACHE_WORDS = 400_000
SAME = b"\x00same"
UPPER, LOWER, DIGIT, OTHER = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+"), re.compile(rb"[^A-Za-z0-9\x80-\xff]{2,}")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def shape(word: bytes) -> bytes:
    return b"\x00" + OTHER.sub(lambda m: m[0][:2], DIGIT.sub(b"9", LOWER.sub(b"x", UPPER.sub(lambda m: b"XX" if len(m[0]) > 1 else b"X", word))))


def features(word: bytes) -> list[int]:
    """Slots of a word. A very long word adds all its n-grams."""
    edged = b"<" + word + b">"
    grams = [edged[i : i + n] for n in GRAMS for i in range(len(edged) - n + 1)]
    return [zlib.crc32(g) % SLOTS for g in (word, shape(word), *grams)]


def repeats(words: list[bytes]) -> int:
    return sum(map(bytes.__eq__, words, words[1:]))


def document_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a document and their shares."""
    words = raw.split()
    slots: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for f in features(word):
            slots[f] += n
    if same := repeats(words):
        slots[zlib.crc32(SAME) % SLOTS] += same * len(GRAMS) * 4
    at = np.fromiter(slots.keys(), np.int64, len(slots))
    n = np.fromiter(slots.values(), np.float32, len(slots))
    return at, n / max(n.sum(), 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # logit of class 1 against class 0 for each slot
    bias: float


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """``samples`` are (class, slots, shares)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (SLOTS, WIDTH)).astype(np.float32)
    output = np.zeros((2, WIDTH), np.float32)
    output[1] = rng.uniform(-0.1, 0.1, WIDTH)
    bias = np.zeros(2, np.float32)
    sizes = np.bincount([s[0] for s in samples], minlength=2)
    if not sizes.all():
        return Model(np.zeros(SLOTS, np.float32), 0.0)
    balance = len(samples) / (2 * sizes)
    epochs = max(epochs, -(-STEPS // len(samples)))  # few documents are seen more often
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            label, at, share = samples[i]
            lr = rate * (1 - done / steps)
            done += 1
            own = vectors[at]
            hidden = share @ own
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            error *= balance[label]
            back = error @ output
            output -= lr * np.outer(error, hidden)
            bias -= 0.1 * lr * error
            # As in the usual trainers, each feature moves by its count, not by its share.
            vectors[at] = own - lr * np.minimum(share * len(at), 8)[:, None] * back
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        held_out: int = 0, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Labels of rows in fold ``held_out`` are never read."""
    marks = pick(labels, mark=doc_id, label=label).where("mark is not null").where(fold(F.col("mark")) != held_out)
    chosen = None
    for c in (0, 1):
        part = marks.where(F.col("label") == c).orderBy(F.xxhash64("mark"), "mark").limit(rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = pick(documents, id=doc_id, text=text).join(F.broadcast(chosen), F.col("id") == F.col("mark")).select("id", "label", "text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [document_features(raw) for raw in octets(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([s for _, s in found], pa.list_(pa.float32()))],
            names=["id", "label", "slots", "shares"])

    got = mapped(rows, step, "id bigint, label int, slots array<bigint>, shares array<float>").toArrow()
    samples = [
        (c, s.values.to_numpy(), w.values.to_numpy())
        for _, c, s, w in sorted(zip(got["id"].to_pylist(), got["label"].to_pylist(), got["slots"], got["shares"]), key=lambda r: (r[0], r[1]))
        if len(s.values)
    ]
    return train(samples)


KNOWN: dict[str, dict[bytes, tuple[float, int]]] = {}


def score(documents: DataFrame, model: Model, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the probability of class 1 of every row. ``key`` names the model."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    same_weight = len(GRAMS) * 4

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, bias = shared.value.weights, shared.value.bias
        known = KNOWN.setdefault(key, {})
        if len(known) > CACHE_WORDS:
            known.clear()
        same = float(weights[zlib.crc32(SAME) % SLOTS])
        logits = []
        for raw in octets(batch.column("text")):
            words = raw.split()
            total, n = 0.0, 0
            for word, k in Counter(words).items():
                if word not in known:
                    at = features(word)
                    known[word] = float(weights[at].sum()), len(at)
                own, size = known[word]
                total += k * own
                n += k * size
            k = repeats(words) * same_weight
            logits.append(bias + (total + k * same) / max(n + k, 1))
        p = 1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(p)], names=["doc_id", "score"])

    return mapped(pick(documents, id=doc_id, text=text), step, "doc_id bigint, score double")
