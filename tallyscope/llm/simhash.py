"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints of 64 bits that differ in at most ``distance`` bits must, for any cut of the bits into m partitions and
any thresholds that add up to distance - m + 1, differ in some partition by at most that partition's threshold. The cut
puts correlated bits together, because a partition of correlated bits tells least and should be probed least; the number
of partitions and their thresholds come from dynamic programming over estimated candidate counts of all fingerprints.

Fingerprints are made distinct first, so exact copies cost one row. A partition of threshold t is probed with the bits
left after leaving out each set of t bits. Rows of one probe key meet in one task if there are at most ``bucket`` of
them, and are compared there; the links found in a batch are thinned to a forest, which keeps all components. Larger
buckets (there is always a way to have them) are not compared pair by pair: two fingerprints at distance 3 have a value
within 1 of the one and within 2 of the other, so all values around the members of the bucket are counted, and members
that share one are linked through the smallest. That is linear in the members and finds every link.

Null, empty and wordless texts have fingerprint 0. A null doc_id is ignored for component ids (a component of null ids
alone has a null id); repeated rows are returned each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import mapped, octets, pick
from tallyscope.llm.components import components, forest
from tallyscope.session import cut

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
BUCKET = 4096
KEY_COST, PAIR_COST = 100.0, 1.0  # a row that is shuffled against a comparison in a task
ONES = (1 << BITS) - 1


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        hashes = xxhash.xxh64_digest(text, SEED)
    else:
        digest, starts, at = xxhash.xxh64_digest, [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        stops = starts[width:] + [at]
        hashes = b"".join([digest(text[a : b - 1], SEED) for a, b in zip(starts, stops)])
    n = len(hashes) // 8
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, k, fp): a hash of the text, and the fingerprint as a signed 64-bit number."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(raw, width) for raw in octets(batch.column("text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("k"), pa.array(prints)], names=["doc_id", "k", "fp"])

    return mapped(pick(documents, id=doc_id, text=text).withColumn("k", F.xxhash64("text")), step, "doc_id bigint, k bigint, fp bigint")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set. A task gives 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "n"])

    rows = prints.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def grouped(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each takes the bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (tie[b, rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: tie[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def candidate_share(agree: np.ndarray, threshold: int) -> float:
    """Probability that two fingerprints differ in at most ``threshold`` of the bits that agree so often."""
    if threshold < 0:
        return 0.0
    at_most = np.zeros(threshold + 1)
    at_most[0] = 1.0
    for a in agree:
        at_most[1:] = at_most[1:] * a + at_most[:-1] * (1 - a)
        at_most[0] *= a
    return float(at_most.sum())


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up that add up to ``total`` at the least cost; ``costs[i][t + 1]`` is partition i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for i, c in enumerate(own):
                key = spent + i - 1
                if key not in now or cost + c < now[key][0]:
                    now[key] = (cost + c, [*chosen, i - 1])
        best = now
    return best.get(total, (math.inf, []))


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[int]:
    """The bits each probe keeps, as masks."""
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[list[int]], list[int]] = (math.inf, [], [])
    for parts in range(1, distance + 2):
        groups = grouped(n, both, parts)
        costs = []
        for g in groups:
            own = [0.0]
            for t in range(distance + 1):
                keys = math.comb(len(g), t)
                own.append(n * keys * KEY_COST + n * n / 2 * candidate_share(agree[g], t) * PAIR_COST)
            costs.append(own)
        cost, chosen = allocate(costs, distance - parts + 1)
        if cost < best[0]:
            best = (cost, groups, chosen)
    masks = []
    for g, t in zip(best[1], best[2]):
        for out in itertools.combinations(g, t) if t >= 0 else ():
            masks.append(sum(1 << b for b in g if b not in out))
    return masks


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def compared(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) among rows (probe, key, fp) of equal probe and key, thinned to a forest in each batch."""

    def links(probe: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        start = np.concatenate(([True], (probe[1:] != probe[:-1]) | (key[1:] != key[:-1])))
        run = np.cumsum(start) - 1
        size = np.bincount(run)[run]
        keep = size > 1
        fp, run, size = fp[keep], run[keep], size[keep]
        found = []
        step = 1
        while len(fp) > step:
            same = run[step:] == run[:-step]
            if not same.any():
                break
            near = same & (np.bitwise_count((fp[step:] ^ fp[:-step]).view(np.uint64)) <= distance)
            found.append((fp[:-step][near], fp[step:][near]))
            step += 1
            if step & 31 == 0:  # leave out runs that have no such neighbours any more
                keep = size > step
                fp, run, size = fp[keep], run[keep], size[keep]
        if not found:
            return None
        node, root = forest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"]) if len(node) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            stop = last[-1] + 1 if len(last) else 0
            if stop:
                out = links(*(h[:stop] for h in held))
                held = [h[stop:] for h in held]
                if out is not None:
                    yield out
        if len(held[0]) and (out := links(*held)) is not None:
            yield out

    dealt = rows.repartition("probe", "key").sortWithinPartitions("probe", "key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def around(fp, bits: int, most: int):
    """All values within ``most`` flips, as an array column."""
    flips = [sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)]
    return F.transform(F.array(*(F.lit(signed(f)) for f in flips)), lambda x: x.bitwiseXOR(fp))


def through_values(rows: DataFrame, distance: int) -> DataFrame:
    """Links of large buckets: members around a common value are linked to the smallest member next to it."""
    low, high = distance // 2, distance - distance // 2
    near = rows.select("probe", "key", "fp", F.explode(around(F.col("fp"), BITS, high)).alias("value"))
    near = near.withColumn("close", F.bit_count(F.col("fp").bitwiseXOR(F.col("value"))) <= low)
    hub = near.where("close").groupBy("probe", "key", "value").agg(F.min("fp").alias("hub"))
    return near.join(hub, ["probe", "key", "value"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def link(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints; together they connect all that ``distance`` connects."""
    n, both = bit_counts(prints)
    masks = plan(n, both, distance) if n else []
    if not masks:
        return prints.sparkSession.createDataFrame([], "a bigint, b bigint")
    probes = F.array(*(F.struct(F.lit(i).alias("probe"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))
    rows = prints.select("fp", F.explode(probes).alias("p")).select("p.probe", "p.key", "fp")
    counted = rows.groupBy("probe", "key").count()
    large = cut(counted.where(F.col("count") > bucket).select("probe", "key"))
    if large.isEmpty():
        return compared(rows, distance)
    small = rows.join(large, ["probe", "key"], "left_anti").select("probe", "key", "fp")
    hot = rows.join(large, ["probe", "key"], "left_semi").select("probe", "key", "fp")
    return compared(small, distance).unionByName(through_values(hot, distance))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, k (hash of the text), fp, root (smallest fingerprint of the component) and component_id of every row."""
    prints = cut(fingerprints(documents, doc_id, text))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(link(distinct, distance, bucket))
    roots = found.select(F.col("node").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root").distinct())
    linked = roots.join(distinct, "fp")
    first = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = distinct.join(roots.join(first, "root").select("fp", "root", "component_id"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    # Dealt anew, so that the join deals both its sides itself and may split a fingerprint of very many copies.
    named = named.hint("rebalance")
    return prints.join(named, "fp").select("doc_id", "k", "fp", "root", "component_id")


def first_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``documents`` with one row of each component: the smallest doc_id, a null one last; of repeated rows one stays."""
    found = near_duplicates(documents, doc_id, text, distance, bucket)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("best"))
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    rows = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    rows = rows.withColumn("best_id", F.coalesce(F.col(names[doc_id]).cast("bigint"), F.lit(-1))).withColumn("best_k", F.xxhash64(names[text]))
    best = best.select(F.coalesce("best.doc_id", F.lit(-1)).alias("best_id"), F.col("best.k").alias("best_k")).distinct()
    kept = rows.join(best, ["best_id", "best_k"], "left_semi").dropDuplicates(["best_id", "best_k"])
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
