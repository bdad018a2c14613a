"""Stretches of words that repeat with a period, by enumeration of maximal pairs.

Two equal strings of a text are a maximal pair if neither the words before them nor the words after them are equal. If
they are at least as long as they are apart, both together are a stretch with their distance as a period, and being
maximal means that the stretch cannot be extended. So the runs of a text are its maximal pairs whose distance is at most
their length; of several distances for one stretch the least is its period.

Maximal pairs come from a bottom-up walk over the tree of longest-common-prefix intervals of the suffix array. A node
holds its suffixes by place, cut into classes of one left word; children are merged small into large, and each place of
the smaller one meets only places within the length of the common prefix and of another left word. The work is bounded by
the pairs found and a logarithmic factor. Suffixes whose first words stand nowhere near again cannot take part and are
left out first.

Words are numbered for each text anew, so texts are indexed many at a time without meeting one another. Every text is
whole in its task, which the periods need; nothing is shuffled.

Null and empty texts have no words and no runs; repeated rows give a row each; an id may be null.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyscope.llm.common import octets, pick, slices

LEAST = 12
BATCH = 6 << 20
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Numbers(dict):
    """Words to numbers in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, no two texts sharing one, and the place where each text starts."""
    places = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in texts], out=places[1:])
    ids = np.empty(places[-1], np.int64)
    base = 0
    for words, a, b in zip(texts, places[:-1].tolist(), places[1:].tolist()):
        numbers = Numbers()
        ids[a:b] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        ids[a:b] += base
        base += len(numbers)
    return ids, places


def ordered(key: np.ndarray) -> np.ndarray:
    """Indices that sort ``key``; key and index share one word where they fit, which sorts faster."""
    bits = max(1, len(key).bit_length())
    if len(key) and int(key.max()) >> (63 - bits) == 0:
        packed = (key << bits) | np.arange(len(key))
        packed.sort()
        return packed & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def suffixes_of_repeats(ids: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``gram`` words stand more than once, in order, and the group of equal first words of each.

    Prefix doubling: the rank of a suffix is the first place of its group, so that groups are sorted on their own and
    suffixes alone in theirs are done.
    """
    n = len(ids)
    rank = np.zeros(n + 1, np.int64)
    active, depth, known, groups = np.arange(n), 0, None, None
    while len(active):
        if depth == 0:
            key, step = ids, 1
        else:
            step = min(depth, gram - depth) if depth < gram else depth
            after = np.minimum(active + step, n)
            key = rank[active] * (n + 2) + np.where(after < n, rank[after] + 1, 0)
        order = ordered(key)
        active, key = active[order], key[order]
        before = rank[active] if depth else np.zeros(n, np.int64)
        at = np.arange(len(active))
        fresh = np.ones(len(active), bool)
        fresh[1:] = key[1:] != key[:-1]
        first_old = np.ones(len(active), bool)
        first_old[1:] = before[1:] != before[:-1]
        start_new = np.maximum.accumulate(np.where(fresh, at, 0))
        start_old = np.maximum.accumulate(np.where(first_old, at, 0))
        rank[active] = before + start_new - start_old
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        depth += step
        active = active[~alone]
        if depth == gram:
            known, groups = active, rank[active].copy()
    if known is None or not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = ordered(rank[known])
    return known[order], groups[order]


def common_prefixes(ids: np.ndarray, sa: np.ndarray, groups: np.ndarray, gram: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``; 0 at the first of a group.

    Where the left words are equal too, the value is that of the place before less one; only the others are compared.
    """
    lcp = np.zeros(len(sa), np.int64)
    second = np.flatnonzero(groups[1:] == groups[:-1]) + 1
    place, other = sa[second], sa[second - 1]
    by_place = ordered(place)
    second, place, other = second[by_place], place[by_place], other[by_place]
    direct = (place == 0) | (other == 0) | (ids[place - 1] != ids[other - 1])
    end = np.append(ids, [-1])  # no word equals it, and a place is compared with a later or earlier one only
    a, b = place[direct], other[direct]
    length = np.full(len(a), gram, np.int64)
    going = np.arange(len(a))
    for _ in range(32):
        going = going[end[a[going] + length[going]] == end[b[going] + length[going]]]
        if not len(going):
            break
        length[going] += 1
    for i in going.tolist():
        p, q, m = int(a[i] + length[i]), int(b[i] + length[i]), 256
        while True:
            x, y = end[p : p + m], end[q : q + m]
            k = min(len(x), len(y))
            differ = np.flatnonzero(x[:k] != y[:k])
            if len(differ):
                length[i] = p + differ[0] - a[i]
                break
            p, q, m = p + k, q + k, 2 * m
    source = np.maximum.accumulate(np.where(direct, np.arange(len(place)), 0))
    values = np.zeros(len(place), np.int64)
    values[direct] = length
    lcp[second] = values[source] - (place - place[source])
    return lcp


def near_again(sa: np.ndarray, groups: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that some other one starts near enough to make a run with, and the common prefixes between these."""
    n = len(sa)
    longest = np.maximum(lcp, np.append(lcp[1:], 0))
    by_place = np.lexsort((sa, groups))
    gap = np.full(n + 1, np.iinfo(np.int64).max)
    g, p = groups[by_place], sa[by_place]
    gap[1:n] = np.where(g[1:] == g[:-1], p[1:] - p[:-1], gap[1:n])
    nearest = np.empty(n, np.int64)
    nearest[by_place] = np.minimum(gap[:-1], gap[1:])
    kept = np.flatnonzero(nearest <= longest)
    if not len(kept):
        return sa[:0], lcp[:0]
    # The least value from behind the suffix kept before to this one.
    return sa[kept], np.minimum.reduceat(lcp[: kept[-1] + 1], np.append(0, kept[:-1] + 1))


def meet(large: tuple[list[int], list[int]], small: tuple[list[int], list[int]], reach: int, left: list[int], out: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Reports the pairs between two children of a node with common prefix ``reach`` and merges them."""
    if len(small[0]) > len(large[0]):
        large, small = small, large
    places, heads = large
    for p in small[0]:
        low, high = bisect_left(places, p - reach), bisect_right(places, p + reach)
        if low == high:
            continue
        own, k = left[p], bisect_right(heads, places[low]) - 1
        while low < high:
            stop = min(high, bisect_left(places, heads[k + 1])) if k + 1 < len(heads) else high
            if left[heads[k]] != own:
                out.extend((p, q, reach) if p < q else (q, p, reach) for q in places[low:stop])
            low, k = stop, k + 1
    if 8 * len(small[0]) < len(places):
        for p in small[0]:
            i = bisect_left(places, p)
            places.insert(i, p)
            # Heads: places whose left word differs from that of the place before.
            if i == 0 or left[places[i - 1]] != left[p]:
                insort(heads, p)
            if i + 1 < len(places):
                q = places[i + 1]
                j = bisect_left(heads, q)
                is_head = j < len(heads) and heads[j] == q
                if (left[q] != left[p]) != is_head:
                    if is_head:
                        del heads[j]
                    else:
                        heads.insert(j, q)
        return large
    places = sorted(places + small[0])
    return places, places[:1] + [q for p, q in zip(places, places[1:]) if left[p] != left[q]]


def maximal_pairs(sa: list[int], lcp: list[int], left: list[int], out: list[tuple[int, int, int]]) -> None:
    """Maximal pairs (place, later place, length) no farther apart than they are long, among suffixes in order."""
    stack: list[tuple[int, tuple[list[int], list[int]]]] = []
    for i, p in enumerate(sa):
        node = ([p], [p])
        reach = lcp[i + 1] if i + 1 < len(sa) else 0
        while stack and stack[-1][0] >= reach:
            depth, before = stack.pop()
            node = meet(before, node, depth, left, out)
        if reach:
            stack.append((reach, node))


def runs_of(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of at least ``least`` words and two periods, by start and period."""
    sa, groups = suffixes_of_repeats(ids, -(-least // 2))
    nothing = np.zeros(0, np.int64)
    if not len(sa):
        return nothing, nothing, nothing
    sa, lcp = near_again(sa, groups, common_prefixes(ids, sa, groups, -(-least // 2)))
    if not len(sa):
        return nothing, nothing, nothing
    lcp = np.where(lcp >= -(-least // 2), lcp, 0)
    lcp[0] = 0
    heads = np.flatnonzero(lcp == 0)
    sizes = np.diff(np.append(heads, len(sa)))
    # Two suffixes make one pair.
    two = heads[sizes == 2]
    p, q = np.minimum(sa[two], sa[two + 1]), np.maximum(sa[two], sa[two + 1])
    fits = (q - p <= lcp[two + 1]) & ((p == 0) | (ids[p - 1] != ids[q - 1]))
    pairs = [np.stack((p[fits], q[fits], lcp[two + 1][fits]))]
    more = np.repeat(sizes > 2, sizes)
    if more.any():
        out: list[tuple[int, int, int]] = []
        left = np.append([-1], ids[:-1]).tolist()
        maximal_pairs(sa[more].tolist(), lcp[more].tolist(), left, out)
        pairs.append(np.array(out, np.int64).reshape(-1, 3).T)
    p, q, length = np.concatenate(pairs, 1)
    start, length, period = p, length + q - p, q - p
    wide = length >= least
    start, length, period = start[wide], length[wide], period[wide]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find(batch: pa.RecordBatch, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None, least: int) -> pa.RecordBatch:
    texts = [raw.split() for raw in octets(batch.column("text"))]
    if rewrite:
        texts = [rewrite(i, words) for i, words in zip(batch.column("doc_id").to_pylist(), texts)]
    ids, places = numbered(texts)
    start, length, period = runs_of(ids, least)
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    keep = np.cumsum(steps[:-1]) == 0
    owner = np.searchsorted(places, start, side="right") - 1
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    some = np.diff(offsets) > 0
    collapsed = [
        b" ".join(compress(words, keep[a:b].tolist())) if hit else b" ".join(words)
        for words, a, b, hit in zip(texts, places[:-1].tolist(), places[1:].tolist(), some.tolist())]
    runs = pa.StructArray.from_arrays([pa.array(start - places[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(np.diff(places)), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
         rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start and period) and the text without the later periods of its runs, for every row.

    ``rewrite`` may change the words of a row, given its id and words, before they are looked at.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            yield find(batch, rewrite, least)

    chosen = pick(documents, doc_id=doc_id, text=text)
    return chosen.select(chosen.doc_id.cast("bigint").alias("doc_id"), chosen.text.cast("string").alias("text")).mapInArrow(step, SCHEMA)
