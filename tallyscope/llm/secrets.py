"""Secrets in texts: three fixed patterns, and strings near sensitive words that a primed compressor cannot shorten.

Names, words and paths that code repeats cost zstandard little once it has seen such text; a key costs about what it is
long. Each string of key characters behind a sensitive word (its candidates) is measured by the bytes that it adds to the
compressed text around it. The compressor is primed with a dictionary of identifier parts, the most frequent ones of all
documents; parts are cut at case changes, digits and marks, so that a copied key leaves none. A candidate is reported if
it holds a letter and adds at least ``NOVEL`` bytes for each of its characters: random letters, digits or hexadecimals add
0.77 or more, names and words 0.7 or less.

The patterns and the measure see a whole text at once; the dictionary is counted with a map-side combine and has a bound
in bytes. Null text is empty; spans are in code points, the end exclusive; repeated rows give a row each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import mapped, octets, pick, slices
from tallyscope.session import cut

# Kinds, their patterns over text in lower case (assign) or as it is, and the least lengths.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "novel")

# Words that make a string behind them worth a look.
CUES = (b"passw", b"pwd", b"passphrase", b"secret", b"token", b"key", b"auth", b"bearer", b"credential", b"signature", b"login", b"private")
CUE = re.compile(
    rb"(?<![a-z])(?:password|passwd|pwd|passphrase|(?:[a-z]+[_-])*secret|(?:[a-z]+[_-])*token|(?:api|access|private|secret|account|encryption|signing)[_ -]?key"
    rb"|auth(?:orization)?|bearer|credentials?|signature|login)(?![a-z])")
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_=~-])[A-Za-z0-9+/_=~-][A-Za-z0-9+/_.=~-]{14,}[A-Za-z0-9+/_=~-]")
REACH = 48
BEFORE, AFTER = 512, 128
LEVEL = 9
NOVEL = 0.75
DICTIONARY_BYTES = 48 << 10
PART = re.compile(rb"[A-Za-z][a-z]{3,}|[A-Z]{4,}")

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def identifier_parts(documents: DataFrame, text: str = "text", room: int = DICTIONARY_BYTES) -> bytes:
    """The most frequent identifier parts of all documents, at most ``room`` bytes of them, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["part", "n"])
            seen.clear()
            return out

        seen: Counter[bytes] = Counter()
        for batch in slices(batches, "text", 6 << 20):
            for raw in octets(batch.column("text")):
                seen.update(PART.findall(raw))
            if len(seen) > 200_000:
                yield rows()
        if seen:
            yield rows()

    chosen = pick(documents, text=text)
    counted = chosen.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part string, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
    counted = cut(counted.where("n > 1").withColumn("class", F.floor(F.log2("n") * 16).cast("int")))
    # Parts of about the same count go in together, so that the driver gets what fits the room and no more.
    held, least = 0, None
    for row in counted.groupBy("class").agg(F.sum(F.octet_length("part") + 1).alias("size")).orderBy(F.desc("class")).collect():
        held += row["size"]
        if held > room:
            break
        least = row["class"]
    if least is None:
        return b""
    return b" ".join(r.part.encode() for r in counted.where(F.col("class") >= least).orderBy("n", F.desc("part")).select("part").collect())


class Measure:
    """Compressed bytes that a string adds to the text around it."""

    def __init__(self, dictionary: bytes) -> None:
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(dictionary) >= 8:  # shorter ones are none
            options["dict_data"] = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options["dict_data"].precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(**options).compress

    def added(self, raw: bytes, start: int, end: int) -> int:
        before, after = raw[max(0, start - BEFORE) : start], raw[end : end + AFTER]
        return len(self.compress(before + raw[start:end] + after)) - len(self.compress(before + after))

    def novel(self, raw: bytes, start: int, end: int) -> bool:
        own = raw[start:end]
        return own.upper() != own.lower() and self.added(raw, start, end) >= NOVEL * len(own)


def base_spans(raw: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of what the patterns find."""
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    return sorted(found)


def novel_spans(raw: bytes, low: bytes, base: list[tuple[int, int, int]], measure: Measure) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates that no pattern touches and the compressor cannot shorten."""
    if not any(w in low for w in CUES):
        return []
    spots = set()
    for cue in CUE.finditer(low):
        for m in CANDIDATE.finditer(raw, cue.end()):
            if m.start() > cue.end() + REACH:
                break
            spots.add((m.start(), m.end()))
    free = ((a, b) for a, b in spots if all(b <= s or a >= e for s, _, e in base))
    return sorted((a, 3, b) for a, b in free if measure.novel(raw, a, b))


def code_points(raw: bytes, found: list[tuple[int, int, int]]) -> list[dict]:
    places: dict[int, int] = {}
    at = count = 0
    for p in sorted({x for a, _, b in found for x in (a, b)}):
        count += len(raw[at:p].decode())
        at, places[p] = p, count
    return [{"kind": KINDS[k], "start": places[a], "end": places[b]} for a, k, b in found]


def find(documents: DataFrame, dictionary: bytes | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (by start, then kind) of every row; the dictionary is counted from ``documents`` if none is given."""
    primed = identifier_parts(documents, text) if dictionary is None else dictionary
    kept: list[Measure] = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept.append(Measure(primed))
        out = []
        for raw in octets(batch.column("text")):
            low = raw.lower()
            base = base_spans(raw, low)
            out.append(code_points(raw, sorted(base + novel_spans(raw, low, base, kept[0]))))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    chosen = pick(documents, doc_id=doc_id, text=text)
    return mapped(chosen.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), step, f"doc_id bigint, spans {SPANS}")
