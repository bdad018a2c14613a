"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

An item is cut into windows of ``width`` consecutive words (a shorter item is one window). All windows of all items go
into one automaton, and each document is read by it once, as normalised words; matches are mapped back to the text by
word position.

Items reach the driver and the tasks in blocks of at most ``block_bytes``, one block at a time. A set of tests is one
block, read in one pass; a larger one is read in as many passes, each with its own automaton, and the rows wait in the
checkpoint folder between passes.

Null and empty texts have no words. Repeated documents and repeated items keep their rows and ids; items of the same
text are all reported; an item without an id hits like any other but is in no list of ids; an item without words never
occurs; with no items nothing is hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import WORD_BYTES, octets, pick, slices
from tallyscope.session import cut

WIDTH = 10
BLOCK_BYTES = 32 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BUILT: dict[str, list] = {}  # in a worker, by the scan they belong to
HELD = "array<struct<place:bigint,n:bigint,items:array<string>>>"
HITS = "id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>"


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Normalised items in blocks of at most ``block_bytes`` (an item longer than that stands alone)."""
    block: list[tuple[str | None, bytes]] = []
    held = 0
    for row in pick(items, i=item_id, t=text).where("t is not null").toLocalIterator():
        words = row.t.encode().translate(WORD_BYTES).split()
        if words:
            norm = b" ".join(words)
            if block and held + len(norm) > block_bytes:
                yield block
                block, held = [], 0
            block.append((None if row.i is None else str(row.i), norm))
            held += len(norm)
    if block:
        yield block


def automaton(block: list[tuple[str | None, bytes]], width: int) -> ahocorasick.Automaton:
    """Windows as latin-1 text between blanks; the value is (words in the window, ids of its items)."""
    windows: dict[bytes, tuple[int, set[str]]] = {}
    for item, norm in block:
        words = norm.split()
        n = min(width, len(words))
        for i in range(len(words) - n + 1):
            ids = windows.setdefault(b" " + b" ".join(words[i : i + n]) + b" ", (n, set()))[1]
            if item is not None:
                ids.add(item)
    found = ahocorasick.Automaton()
    for key, value in windows.items():
        found.add_word(key.decode("latin-1"), (len(key), *value))
    found.make_automaton()
    return found


def shared_automaton(spark: SparkSession, block: list[tuple[str | None, bytes]], width: int) -> Callable[[], ahocorasick.Automaton]:
    """A function for tasks that gives the automaton of a block, built once in each worker."""
    shared = spark.sparkContext.broadcast(block)
    run_id = uuid.uuid4().hex

    def get() -> ahocorasick.Automaton:
        if run_id not in BUILT:
            BUILT.clear()  # one at a time
            BUILT[run_id] = automaton(shared.value, width)
        return BUILT[run_id]

    return get


def matched(raw: bytes, found: ahocorasick.Automaton) -> tuple[list[bytes], str, list[tuple[int, int, set[str]]]]:
    """Words, normalised text, and the windows found in it as (place, words, items)."""
    words = raw.translate(WORD_BYTES).split()
    norm = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    return words, norm, [(end + 1 - size, n, ids) for end, (size, n, ids) in found.iter(norm)] if norm and len(found) else []


def noted(rows: DataFrame, block: list[tuple[str | None, bytes]], width: int) -> DataFrame:
    """(id, text, held) with the windows of ``block`` added to ``held``."""
    get = shared_automaton(rows.sparkSession, block, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            held = [
                old + [{"place": p, "n": n, "items": sorted(ids)} for p, n, ids in matched(raw, get())[2]]
                for raw, old in zip(octets(batch.column("text")), batch.column("held").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(held, batch.column("held").type)], names=["id", "text", "held"])

    return rows.mapInArrow(run, rows.schema)


def scan(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: number of words, of words inside a window, the items found, and the spans (in characters of
    the original text) that the windows cover."""
    spark = documents.sparkSession
    rows = pick(documents, id=doc_id, text=text).withColumn("held", F.expr(f"cast(array() as {HELD})"))
    block: list[tuple[str | None, bytes]] = []
    for i, following in enumerate(item_blocks(items, item_id, item_text, block_bytes)):
        if i:
            rows = cut(noted(rows, block, width))
        block = following
    get = shared_automaton(spark, block, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, hits, found, spans = [], [], [], []
            for raw, held in zip(octets(batch.column("text")), batch.column("held").to_pylist()):
                words, norm, matches = matched(raw, get())
                matches += [(h["place"], h["n"], set(h["items"])) for h in held]
                counts.append(len(words))
                n_hit, ids, cover = cover_of(raw, norm, len(words), matches)
                hits.append(n_hit)
                found.append(ids)
                spans.append(cover)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["id", "n_words", "n_hit", "items", "spans"])

    return rows.mapInArrow(run, HITS)


def cover_of(raw: bytes, norm: str, n_words: int, matches: list[tuple[int, int, set[str]]]) -> tuple[int, list[str], list[dict]]:
    if not matches:
        return 0, [], []
    blanks = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
    first = np.searchsorted(blanks, [m[0] for m in matches])
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + [m[1] for m in matches], -1)
    inside = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    places = [m.span() for m in WORD.finditer(raw)]
    cover, at, chars = [], 0, 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        start, stop = places[a][0], places[b - 1][1]
        chars += len(raw[at:start].decode())
        length = len(raw[start:stop].decode())
        cover.append({"start": chars, "stop": chars + length})
        at, chars = stop, chars + length
    return int(inside.sum()), sorted(set().union(*(m[2] for m in matches))), cover


def clean(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` without the rows in which a window occurs."""
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    rows = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    for i, block in enumerate(item_blocks(items, item_id, item_text, block_bytes)):
        rows = without(cut(rows) if i else rows, documents.columns.index(text), shared_automaton(rows.sparkSession, block, width))
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()))


def without(rows: DataFrame, place: int, get: Callable[[], ahocorasick.Automaton]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not matched(raw, get())[2] for raw in octets(batch.column(place))], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def digest(hits: DataFrame) -> DataFrame:
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

