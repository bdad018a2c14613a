"""Exact removal of long repeated byte strings with suffix arrays built by two-stage sorting.

A suffix array of the whole corpus would pass through one place, so the corpus is cut by content first. Every string of
``size`` bytes has an anchor: the part of ``gram`` bytes with the least hash, the leftmost at a tie. Equal strings have
equal anchors, so only strings of the same anchor need to meet. Neighbouring strings of a document that share an anchor
make one piece. Pieces whose anchor stands nowhere else are dropped; equal pieces are counted and kept once.

The pieces of an anchor are dealt to a task by the anchor, and blocks of them get a suffix array. Suffixes smaller than
their successors are sorted directly, by words of seven symbols; all others are induced by one scan over the buckets of
first symbols, each bucket as one vector operation. Neighbours in the array whose common prefix reaches ``size`` are
repeated strings; so is every string of a piece that stands more than once.

An anchor with more than ``PIECES`` different pieces is not brought together: its strings are hashed and counted one by
one instead, which is exact as well and spreads.

Null text is empty; a text shorter than ``size`` keeps all bytes. Copies, also repeated rows, are occurrences like any
other, so an exact copy of a long text loses all its bytes in every copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import mapped, octets, release, slices, stored

SIZE, GRAM = 400, 128
PIECES = 8192  # one anchor's pieces stay together: up to about 6 MB
BLOCK, PART = 2 << 20, 6 << 20
SEGMENT = 8 << 20
WORD = 7
# Direct sorting goes by words up to SLOW symbols; behind that a rank must lie within SLACK symbols of the known end.
SLOW, SLACK = 42, 18
BASE = 0x9E3779B97F4A7C15 | 1
KINDS = "d bigint, k bigint, pieces array<struct<h:bigint,ph:bigint,len:int,starts:array<int>>>"


class Rolling:
    """Powers of an odd base and of its inverse modulo 2^64, as far as a segment needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, BASE, np.uint64))))
            self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, inverse, np.uint64))))
        return self.up, self.down


ROLLING = Rolling()


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    n = len(raw)
    up, down = ROLLING.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from prefix and suffix minima of blocks."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchored(raw: bytes, size: int = SIZE, gram: int = GRAM) -> list[dict]:
    """The pieces of a text: anchor, hash and length of each different piece, and where it starts."""
    if len(raw) < size:
        return []
    found: dict[tuple[int, int, int], list[int]] = {}
    whole = np.frombuffer(raw, np.uint8)
    for at in range(0, len(raw) - size + 1, SEGMENT):
        part = whole[at : at + SEGMENT + size - 1]
        if len(part) < size:
            break
        hashes = gram_hashes(part, gram)
        # 40 bits of the hash decide, then the place.
        order = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_least(order, size - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place))
        for a, b, h in zip((first + at).tolist(), (last + at + size - 1).tolist(), hashes[place[first]].view(np.int64).tolist()):
            found.setdefault((h, xxhash.xxh64_intdigest(raw[a:b]) - (1 << 63), b - a), []).append(a)
    return [{"h": h, "ph": ph, "len": n, "starts": starts} for (h, ph, n), starts in found.items()]


def symbol_words(text: np.ndarray, depth: int) -> np.ndarray:
    """Seven symbols from each place on in one number; zeros for ``depth`` places behind the end."""
    n = len(text)
    words = np.zeros(n + depth + 2 * WORD, np.uint64)
    padded = np.concatenate((text, np.zeros(WORD, text.dtype))).astype(np.uint16)
    for k in range(WORD):
        words[:n] <<= np.uint64(9)
        words[:n] |= padded[k : k + n]
    return words


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (symbols from 0 up to 256, the last one 0) in order, as far as their first ``depth`` symbols
    tell; two-stage sorting."""
    n = len(text)
    words = symbol_words(text, depth) if words is None else words
    # Types: compare with the successor; equal symbols take the type of the next different one.
    change = np.flatnonzero(text[1:] != text[:-1]).astype(np.int32)
    rises = np.zeros(n, bool)
    if len(change):
        rises[: change[-1] + 1] = np.repeat(text[change] < text[change + 1], np.diff(change, prepend=np.int32(-1)))
    rises[-1] = True  # the end is sorted directly
    del change
    direct = direct_sort(np.flatnonzero(rises).astype(np.int32), words, depth, text)
    by_symbol = np.searchsorted(text[direct], np.arange(258))
    arrived: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        bucket = []
        now = np.concatenate(arrived[c]) if arrived[c] else direct[:0]
        while len(now):
            bucket.append(now)
            before = now[now > 0] - 1
            now = before[text[before] == c]
        bucket.append(direct[by_symbol[c] : by_symbol[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        symbols = text[before]
        before, symbols = before[symbols > c], symbols[symbols > c]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        cuts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1]))) if len(symbols) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(symbols)) if len(symbols) else []):
            arrived[symbols[a]].append(before[a:b])
    return np.concatenate(out)


def direct_sort(at: np.ndarray, words: np.ndarray, depth: int, text: np.ndarray) -> np.ndarray:
    """``at`` in the order of their first ``depth`` symbols; only ties go on.

    Ties are first compared word by word. Once the known part is long, the rank of a suffix near its end, which is sorted
    directly as well, tells about as much again, so the known part nearly doubles with each round.
    """
    n = len(text)
    key = words[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = np.concatenate(([False], key[1:] == key[:-1]))
    del key, order
    known = WORD
    # The last place up to each one whose suffix is smaller than the next by its first symbol: within the common part of
    # tied suffixes such places are the same.
    places = np.zeros(n, np.int32)
    strict = at[text[at] < text[np.minimum(at + 1, n - 1)]]
    places[strict] = strict
    places = np.maximum.accumulate(places)
    del strict
    rank = np.zeros(n, np.int32)
    while known < depth:
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.maximum.accumulate(np.where(same, np.int32(0), np.arange(len(at), dtype=np.int32)))
        if known < SLOW:
            target = known + WORD
            keys = [words[at[where] + known]]
        else:
            target = min(2 * known - SLACK, depth)
            rank[at] = group
            near = places[np.minimum(at[where] + known - 2, n - 1)]
            far = near >= at[where] + (target - known)
            keys = [np.where(far, rank[near], 0).astype(np.uint64)]
            slow = where[~far]
            if len(slow):
                # No such place near the end, as in runs of one symbol: words, as before.
                for deep in range(known, target, WORD):
                    more = np.zeros(len(where), np.uint64)
                    more[~far] = words[at[slow] + deep]
                    keys.append(more)
        order = np.lexsort((*reversed(keys), group[where]))
        at[where] = at[where][order]
        held = group[where]
        again = np.ones(len(where), bool)
        again[0] = False
        again[1:] = held[1:] == held[:-1]
        for k in keys:
            k = k[order]
            again[1:] &= k[1:] == k[:-1]
        same[where] = again
        known = target
    return at


def common_prefixes(order: np.ndarray, words: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of neighbours in ``order``, as far as ``most`` symbols; short ones in whole words."""
    a, b = order[:-1], order[1:]
    length = np.zeros(len(a), np.int32)
    going = np.arange(len(a), dtype=np.int32)
    while len(going):
        deep = length[going[0]]  # the same for all that go on
        going = going[words[a[going] + deep] == words[b[going] + deep]]
        length[going] += WORD
        if deep + WORD >= most:
            break
    last = np.flatnonzero(length > most - WORD)
    a, b, part = a[last], b[last], length[last]
    for _ in range(WORD - 1):
        x, y = np.minimum(a + part, len(text) - 1), np.minimum(b + part, len(text) - 1)
        part += (text[x] == text[y]) & (part < most) & (text[x] > 0)
    length[last] = np.minimum(part, most)
    return length


def repeated_in(pieces: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """For each piece the starts of its strings of ``size`` bytes that also start elsewhere in the pieces."""
    lengths = np.array([len(p) for p in pieces])
    text = np.zeros(int(lengths.sum()) + len(pieces), np.int16)
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    room = np.zeros(len(text), np.int32)
    for s, p in zip(starts.tolist(), pieces):
        text[s : s + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
        room[s : s + len(p)] = np.arange(len(p), 0, -1)
    words = symbol_words(text, size)
    order = suffix_array(text, size, words)
    order = order[room[order] >= size]
    del room
    long = common_prefixes(order, words, text, size) >= size
    found = np.union1d(order[:-1][long], order[1:][long])
    cuts = np.searchsorted(found, np.append(starts, len(text))).tolist()
    return [found[a:b] - s for a, b, s in zip(cuts, cuts[1:], starts.tolist())]


def spans(documents: DataFrame, size: int, gram: int, pieces_limit: int) -> DataFrame:
    """(d, k, cover): repeated strings of each row of (d, k, text) as pieces and the starts inside them."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("ph", pa.int64()), ("len", pa.int32()), ("starts", pa.list_(pa.int32()))]))
        got = [anchored(raw, size, gram) for raw in octets(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("d"), batch.column("k"), pa.array(got, kind)], names=["d", "k", "pieces"])

    found = mapped(documents.where(F.octet_length("text") >= size), find, KINDS)
    every = stored(found.select("d", "k", F.explode("pieces").alias("p")).select("d", "k", "p.*"))
    # Dealt anew, here and below, so that the join deals both its sides itself and may split an anchor of very many rows.
    shared = every.groupBy("h").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("h").hint("rebalance")
    rows = stored(every.join(shared, "h").select("h", "ph", "len", "d", "k", "starts"))
    release(every)
    different = rows.groupBy("h", "ph", "len").agg(
        F.sum(F.size("starts")).alias("n"), F.min(F.struct("d", "k", F.element_at("starts", 1).alias("start"))).alias("at"))
    # An anchor of one piece has nothing to compare; its strings are repeated if the piece is.
    kinds = different.groupBy("h").agg(F.count("*").alias("kinds"))
    different = stored(different.join(kinds, "h").select("h", "ph", "len", "n", "at.*", "kinds"))
    wanted = different.where("kinds > 1").groupBy("d", "k").agg(F.collect_list(F.struct("h", "ph", "len", "n", "start", "kinds")).alias("wanted"))

    def take(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for raw, want in zip(octets(batch.column("text")), batch.column("wanted").to_pylist()):
            out += [(w["h"], w["ph"], w["len"], w["n"], w["kinds"], raw[w["start"] : w["start"] + w["len"]]) for w in want]
        kinds_of = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = ["h", "ph", "len", "n", "kinds", "piece"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds_of)] if out else [pa.array([], t) for t in kinds_of], names=names)

    texts = mapped(documents.join(wanted, ["d", "k"]), take, "h bigint, ph bigint, len int, n bigint, kinds bigint, piece binary")
    texts = stored(texts.dropDuplicates(["h", "ph", "len"]))  # repeated rows give a piece each
    inside = sorted_blocks(texts.where(F.col("kinds") <= pieces_limit), size).unionByName(counted_strings(texts.where(F.col("kinds") > pieces_limit), size))
    marks = different.join(inside, ["h", "ph", "len"], "left").where("n > 1 or repeated is not null").select(
        "h", "ph", "len", F.when(F.col("n") <= 1, F.col("repeated")).alias("repeated"))
    covered = rows.join(marks.hint("rebalance"), ["h", "ph", "len"]).select("d", "k", F.struct("starts", "len", "repeated").alias("c"))
    return covered.groupBy("d", "k").agg(F.collect_list("c").alias("cover"))


def blocks_of(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows of (anchor, hash, length, piece), ordered by anchor, in blocks of whole anchors. Only an anchor that is larger
    by itself makes a block of more than ``BLOCK`` bytes."""
    block: list[tuple] = []
    held = 0
    for _, group in groupby(rows, key=lambda row: row[0]):
        anchor = list(group)
        size = sum(row[2] for row in anchor)
        if block and held + size > BLOCK:
            yield block
            block, held = [], 0
        block += anchor
        held += size
    if block:
        yield block


def sorted_blocks(texts: DataFrame, size: int) -> DataFrame:
    """(h, ph, len, repeated) from suffix arrays over blocks of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)))):
            yield solve(block)

    def solve(block: list[tuple]) -> pa.RecordBatch:
        got = repeated_in([p for *_, p in block], size)
        some = [i for i, g in enumerate(got) if len(g)]
        return pa.RecordBatch.from_arrays(
            [pa.array([block[i][0] for i in some], pa.int64()), pa.array([block[i][1] for i in some], pa.int64()), pa.array([block[i][2] for i in some], pa.int32()),
             pa.array([got[i] for i in some], pa.list_(pa.int32()))], names=["h", "ph", "len", "repeated"])

    # As many parts as the bytes need; adaptive execution would go by compressed sizes.
    parts = texts.agg(F.sum("len")).first()[0] or 0
    dealt = texts.select("h", "ph", "len", "piece").repartition(max(1, -(-parts // PART)), "h").sortWithinPartitions("h", "ph")
    return dealt.mapInArrow(run, "h bigint, ph bigint, len int, repeated array<int>")


def counted_strings(texts: DataFrame, size: int) -> DataFrame:
    """The same for anchors of very many pieces, by counting the hash of each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece", 1 << 18):
            out: list[tuple] = []
            for h, ph, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for i in range(n - size + 1):
                    digest = xxhash.xxh3_128_digest(raw[i : i + size])
                    out.append((h, ph, n, i, digest))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["h", "ph", "len", "i", "digest"])

    strings = texts.select("h", "ph", "len", "piece").mapInArrow(run, "h bigint, ph bigint, len int, i int, digest binary")
    often = strings.groupBy("h", "digest").count().where("count > 1").select("h", "digest")
    return strings.join(often, ["h", "digest"]).groupBy("h", "ph", "len").agg(F.collect_list("i").alias("repeated"))


def removed(n_bytes: int, cover: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not cover:
        return []
    steps = np.zeros(n_bytes + 1, np.int32)
    for c in cover:
        starts = np.array(c["starts"], np.int64)
        if c["repeated"] is None:
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + c["len"], -1)
        else:
            inside = (starts[:, None] + np.array(c["repeated"], np.int64)).ravel()
            np.add.at(steps, inside, 1)
            np.add.at(steps, inside + size, -1)
    hit = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def keep(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def with_cover(documents: DataFrame, doc_id: str, text: str, size: int, gram: int, pieces_limit: int) -> DataFrame:
    """``documents`` as (row, text, cover); rows of the same id and text share their cover, which text alone decides."""
    shown = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != text)).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(-1)).alias("d")).withColumn("k", F.xxhash64("text"))
    return shown.join(spans(shown.select("d", "k", "text"), size, gram, pieces_limit), ["d", "k"], "left").select("row", "text", "cover")


def measure(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, pieces_limit: int = PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left, for every row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for raw, cover in zip(octets(batch.column("text")), batch.column("cover").to_pylist()):
            runs = removed(len(raw), cover, size)
            out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(keep(raw, runs)).hexdigest()))
        n, gone, count, sha = zip(*out)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_cover(documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")), "doc_id", "text", size, gram, pieces_limit)
    return mapped(found.select("row.doc_id", "text", "cover"), step, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, pieces_limit: int = PIECES) -> DataFrame:
    """``documents`` with the repeated bytes taken out of ``text``. A character that loses some of its bytes goes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        left = [keep(raw, removed(len(raw), cover, size)).decode(errors="ignore") for raw, cover in zip(octets(batch.column("text")), batch.column("cover").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(left, pa.string())], names=["row", "text"])

    found = with_cover(documents, doc_id, text, size, gram, pieces_limit)
    out = mapped(found, step, f"row {found.schema['row'].dataType.simpleString()}, text string")
    return out.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in documents.columns))
