"""Phrases whose words stand together more often than their parts explain, found by mergeable Misra-Gries summaries.

First pass: each task hashes the phrases of its texts and counts them buffer by buffer. A buffer leaves one summary for
each range of hashes: sorted hashes as differences, with counts. The summaries of a range meet in one task as a stream,
after the masses of all of them, so that the task knows the capacity it needs: more than the range's mass over the
threshold. Two summaries are merged by adding counts and taking the first count beyond the capacity off all, which keeps
the error of every count below the threshold. So each phrase at the threshold survives, whatever the order of merging.
Memory is the capacity and one buffer; hot phrases are counted within buffers and weigh one entry each.

Second pass: surviving hashes are marked in a table of ``bits`` bits, cut along the ranges, which is what every task gets;
its size does not grow with the data. Phrases that fall on marked bits are counted exactly, by their words; a bit set by
another phrase costs a row, never a result.

Scores use integers of 38 digits. Null text is empty, null ``lang`` is ``und``; repeated rows count as often as they
stand. A table without frequent phrases gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import octets, slices
from tallyscope.session import cut

LONGEST, THRESHOLD, TOP = 5, 100, 2000
BITS = 27
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 15
KEY_BITS = 40
BUFFER = 1 << 20
PENDING = 1 << 19
ENTRIES = 128  # of a row, so that 10,000 rows on their way to Python stay small
BREAK = 255  # no byte of UTF-8
# Bytes -> bytes: A-Z in lower case, marks and line ends to BREAK.
FOLD = bytes(BREAK if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class Vocabulary(dict):
    """Words to numbers in the order of their first use; number 0 is the break between pieces."""

    def __init__(self) -> None:
        super().__init__({bytes([BREAK]): 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return (x ^ (x >> np.uint64(29))) * SPREAD


class Words:
    """Words of one or several batches as numbers, with breaks between pieces and texts."""

    def __init__(self) -> None:
        self.vocabulary, self.parts, self.langs, self.lang_parts, self.size = Vocabulary(), [], {}, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        number = self.vocabulary.__getitem__
        for raw, lang in zip(octets(batch.column("text")), batch.column("lang").to_pylist()):
            words = raw.translate(FOLD).replace(b"\xff", b" \xff ").split()
            words.append(b"\xff")
            self.parts.append(np.fromiter(map(number, words), np.int32, len(words)))
            self.lang_parts.append((self.langs.setdefault(lang, len(self.langs)), len(words)))
            self.size += len(words)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and language numbers, place by place."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        lang, n = (np.array(c) for c in zip(*self.lang_parts)) if self.lang_parts else (np.zeros(0, int), np.zeros(0, int))
        return ids, np.repeat(lang, n).astype(np.int32)

    def hashes(self, ids: np.ndarray, langs: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each number of words: the places where that many stand before a break, and the hash of each phrase."""
        word = mixed(np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary)))
        lang = np.fromiter((xxhash.xxh64_intdigest(x or "", 1) for x in self.langs), np.uint64, len(self.langs))
        place = np.flatnonzero(ids)
        value = mixed(lang[langs[place]] + word[ids[place]])
        yield place, value
        for n in range(1, longest):
            after = place + n
            inside = np.flatnonzero(ids[np.minimum(after, len(ids) - 1)] != 0)
            place = place[inside]
            value = mixed(value[inside] + SPREAD + word[ids[place + n]])
            yield place, value


def planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers by rank, so that the empty upper ones compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def summaries(documents: DataFrame, ranges_log: int, longest: int) -> DataFrame:
    """(part, body, mass, keys, counts): for each buffer and range a row with its mass and some with the summary."""
    schema = pa.schema([("part", pa.int32()), ("body", pa.bool_()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def rows(values: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(values)
        h.sort()
        # Range and KEY_BITS bits of the hash.
        h >>= np.uint64(64 - KEY_BITS - ranges_log)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(first, len(h))).astype(np.uint32)
        h = h[first]
        part = h >> np.uint64(KEY_BITS)
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out: list[tuple] = []
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(h)).tolist()):
            keys = h[a:b] & np.uint64((1 << KEY_BITS) - 1)
            p = int(part[a])
            out.append((p, False, int(count[a:b].sum()), None, None))
            for i in range(0, b - a, ENTRIES):
                part_keys = keys[i : i + ENTRIES].copy()
                part_keys[1:] -= keys[i : i + ENTRIES][:-1]
                out.append((p, True, None, planes(part_keys), planes(count[a + i : min(b, a + i + ENTRIES)])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in slices(batches, "text", 3 << 20):
            words = Words()
            words.add(batch)
            ids, langs = words.arrays()
            for _, value in words.hashes(ids, langs, longest):
                held.append(value)
                size += len(value)
            if size >= BUFFER:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    return documents.mapInArrow(run, "part int, body boolean, mass bigint, keys binary, counts binary")


class Summary:
    """Misra-Gries counts of one range: at most ``capacity`` of them after a merge, each short by ``error`` at most."""

    def __init__(self, mass: int, threshold: int) -> None:
        self.capacity, self.error = mass // threshold + 1, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= PENDING:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            at = len(counts) - self.capacity - 1
            excess = int(np.partition(counts, at)[at])
            self.error += excess
            counts = counts - excess
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts, self.waiting, self.held = keys, counts, [], 0


def survivors(found: DataFrame, ranges_log: int, bits: int, threshold: int) -> DataFrame:
    """(part, marks): the bits of each range at which a phrase may reach the threshold."""
    width = bits - ranges_log

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def marks() -> pa.RecordBatch:
            summary.merge()
            often = summary.keys[summary.counts + summary.error >= threshold]
            table = np.zeros(1 << width, np.bool_)
            table[(often >> np.uint64(KEY_BITS - width)).astype(np.int64)] = True
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["part", "marks"])

        for batch in batches:
            for p, body, m, keys, counts in zip(*(batch.column(i) for i in range(5))):
                if p.as_py() != part:
                    if summary is not None:
                        yield marks()
                    part, mass, summary = p.as_py(), 0, None
                if not body.as_py():
                    mass += m.as_py()
                    continue
                if summary is None:
                    summary = Summary(mass, threshold)
                summary.add(np.cumsum(numbers(keys.as_py(), np.uint64)), numbers(counts.as_py(), np.uint32).astype(np.int64))
        if summary is not None:
            yield marks()

    dealt = found.repartitionById(1 << ranges_log, "part").sortWithinPartitions("part", "body")
    return dealt.mapInArrow(run, "part int, marks binary")


def exact_counts(documents: DataFrame, marked: np.ndarray, bits: int, longest: int, parts_log: int, threshold: int) -> DataFrame:
    """(lang, size, phrase, a) of phrases on marked bits that reach ``threshold``; a row of size 0 counts all words of a
    language.

    A buffer leaves a row for each language and range of hashes, with its phrases and their counts; the rows of a range
    are added up as they pass, so memory is what one range can hold of surviving phrases."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(marked)
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def rows(words: Words) -> Iterator[pa.RecordBatch]:
        ids, langs = words.arrays()
        spelled, names = list(words.vocabulary), list(words.langs)
        every = np.bincount(langs[ids != 0], minlength=len(names))
        found: dict[tuple[int, int], tuple[list, list]] = {(0, i): ([b""], [n]) for i, n in enumerate(every.tolist())}
        for n, (place, value) in enumerate(words.hashes(ids, langs, longest), 1):
            bit = value >> np.uint64(64 - bits)
            hit = np.flatnonzero((shared.value[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            order = hit[np.argsort(value[hit], kind="stable")]
            place, value = place[order], value[order]
            # Equal hashes and equal words, so that phrases of one hash stay apart (in any number of rows).
            new = np.append(True, (value[1:] != value[:-1]) | (langs[place[1:]] != langs[place[:-1]]))
            for j in range(n):
                new[1:] |= ids[place[1:] + j] != ids[place[:-1] + j]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(place)))
            at = place[first]
            columns = [[spelled[i] for i in ids[at + j].tolist()] for j in range(n)]
            phrases = columns[0] if n == 1 else map(b" ".join, zip(*columns))
            part = (value[first] >> np.uint64(64 - parts_log)).astype(np.int64)
            for p, lang, phrase, c in zip(part.tolist(), langs[at].tolist(), phrases, count.tolist()):
                held = found.setdefault((p, lang), ([], []))
                held[0].append(phrase)
                held[1].append(c)
        out = [(p, names[lang], b"\n".join(phrases), np.array(counts, np.int64).tobytes()) for (p, lang), (phrases, counts) in found.items()]
        # Few rows at a time, so that what waits on the way to Python stays small.
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 256]), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, "text", 3 << 20):
            words.add(batch)
            if words.size >= BUFFER // 2:
                yield from rows(words)
                words = Words()
        if words.size:
            yield from rows(words)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter[bytes]] = {}
        for batch in batches:
            for lang, phrases, counts in zip(*(batch.column(c) for c in ("lang", "phrases", "counts"))):
                held = totals.setdefault(lang.as_py(), Counter())
                for phrase, n in zip(phrases.as_py().split(b"\n"), np.frombuffer(counts.as_py(), np.int64).tolist()):
                    held[phrase] += n
        for lang, held in totals.items():
            kept = [(p, n) for p, n in held.items() if n >= threshold or not p]
            for i in range(0, len(kept), 10_000):
                phrase, n = zip(*kept[i : i + 10_000])
                sizes = [p.count(b" ") + 1 if p else 0 for p in phrase]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(phrase)), pa.array(sizes, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "a"])

    found = documents.mapInArrow(run, "part int, lang string, phrases binary, counts binary")
    return found.repartitionById(1 << parts_log, "part").mapInArrow(add, "lang string, size int, phrase string, a bigint")


def frequent(documents: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """(lang, size, phrase, a): phrases of 1 to ``longest`` words that stand at least ``threshold`` times in a language,
    with their exact counts, and one row of size 0 for each language that counts all its words."""
    chosen = documents.select(F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges_log = max(3, min(-(-size // RANGE_BYTES), MOST_RANGES) - 1).bit_length()
    table = np.zeros(1 << (bits - 3), np.uint8)
    width = (1 << (bits - ranges_log)) // 8
    # ``bits`` bits in all, however many rows.
    for row in survivors(summaries(chosen, ranges_log, longest), ranges_log, bits, threshold).collect():
        table[row.part * width : (row.part + 1) * width] = np.frombuffer(row.marks, np.uint8)
    return cut(exact_counts(chosen, table, bits, longest, max(3, ranges_log - 3), threshold))


def score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)) without rounding in between."""
    wide = [x.cast("decimal(20,0)") for x in (a, n, l, r)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1], wide[2] * wide[3]).cast("bigint")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST,
                 top: int = TOP, covered: int = 100, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language.

    A phrase is scored by its weakest cut into two parts. It is left out if a longer one around it stands at least
    ``covered`` hundredths as often; the longer one by a single word decides, since it stands at least as often as any
    longer one yet.
    """
    counts = frequent(documents, text, lang, threshold, longest, bits)
    phrases = counts.where("size > 0").select("lang", "phrase", "size", "a")
    sizes = counts.where("size = 0").select("lang", F.col("a").alias("n"))
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = phrases.where("size > 1").select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - size)").alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(sizes, "lang")
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    inner = phrases.where("size > 2").select("lang", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.expr(f"most is null or 100 * most < {covered} * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # The rank limit is applied before the rows of a language meet.
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
