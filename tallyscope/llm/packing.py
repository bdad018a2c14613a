"""Hierarchical packing of tokenised documents into windows of several context sizes.

Every document is tokenised whole and closed with an end id. Its full windows of the longest size stand alone; the rest
goes to the tier of the smallest context size that holds it. Tiers are packed from the longest to the shortest: a window
is opened with the longest rest of its tier, and its gap is filled with the longest rest that fits, then with a cut
piece of a shorter tier. What no longer fills a window waits for the next documents of the task; at the end of the task
it is cut at powers of two. So every window has a power of two of ids and needs no padding.

Windows of one tier are dealt into step groups of equal numbers of ids, so that steps of different context sizes cost
the same.

Packing is done where the documents are read: no row moves. A task holds one bounded batch of documents and less than
one open window. Null and empty texts are documents of the end id alone; repeated rows are packed each; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tallyscope.llm.common import octets, pick, slices

LONGEST = 2048
TIERS = (256, 512, 1024, 2048)
STEP_IDS = 16 * LONGEST
END_ID = 1
CACHE_WORDS = 600_000
TAIL = b",.!*#$%&|"
# The word rule of the tokenizer file (a fixed value), used to count words.
WORD_RULE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.IGNORECASE)
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "context int, step_group bigint")


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, for a tokenizer whose words never cross white space.

    Texts are first cut at the special strings of the file, which stand for one id each in exactly their own letters.
    Words are cut at blanks and line feeds and looked up; unseen ones are encoded by the library many at a time and told
    apart by the ids that end a word."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words of lowered text never are special strings
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.cuts = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 128):
            part = [w.decode() for w in words[at : at + 128]]
            ids = self.alone(" ".join(part))
            stops = np.flatnonzero(self.ends[ids]) + 1
            counts = np.cumsum([len(WORD_RULE.findall(w)) for w in part])
            if counts[-1] != len(stops):
                self.known.update((w, self.alone(t).tobytes()) for w, t in zip(words[at : at + 128], part))
                continue
            cuts = np.concatenate(([0], stops))[counts].tolist()
            raw, start = ids.tobytes(), 0
            for word, stop in zip(words[at : at + 128], cuts):
                self.known[word] = raw[4 * start : 4 * stop]
                start = stop

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        if not self.cuts or not any(map(self.cuts.search, texts)):
            return self.encode_plain(texts)
        parts = [self.cuts.split(t) for t in texts]
        plain = iter(self.encode_plain([p for cut in parts for p in cut[::2]]))
        return [b"".join(self.special[p] if i % 2 else next(plain) for i, p in enumerate(cut)) for cut in parts]

    def encode_plain(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        # bytes.lower changes A-Z only, which the tokenizer lowers as well.
        split = [t.lower().replace(b"\n", b" ").split(b" ") for t in texts]
        seen: set[bytes] = set()
        for words in split:
            seen.update(words)
        known = self.known
        # A tail of punctuation is a word of its own after a letter, unless an apostrophe stands before it.
        unseen = {w: w.rstrip(TAIL) for w in seen if w not in known}
        tailed = {w: (core, w[len(core) :]) for w, core in unseen.items() if core and core != w and 97 <= core[-1] <= 122}
        need = {w for w in unseen if w not in tailed}
        for core, tail in tailed.values():
            need.add(core)
            need.add(tail)
        self.learn([w for w in need if w and w not in known])
        known[b""] = b""
        for word, (core, tail) in tailed.items():
            known[word] = known[core] + known[tail]
        return [b"".join([known[w] for w in words]) for words in split]


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


class Packer:
    """Packs the documents of one task; finished pieces gather in ``rows``.

    A rest is (document, start, length); rests wait by length, and a bit mask tells which lengths are there, so that the
    longest rest up to a gap is found at once."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS):
        self.tiers, self.longest, self.step_ids, self.task = tiers, tiers[-1], step_ids, task
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.mask = 0
        self.sequences = 0
        self.made = dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []

    def put(self, doc: tuple, start: int, length: int) -> None:
        self.waiting[length].append((doc, start, length))
        self.mask |= 1 << length

    def take(self, most: int) -> tuple | None:
        length = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if length < 1:
            return None
        rests = self.waiting[length]
        rest = rests.pop()
        if not rests:
            self.mask ^= 1 << length
        return rest

    def shortest(self) -> tuple | None:
        if not self.mask:
            return None
        return self.take((self.mask & -self.mask).bit_length() - 1)

    def close(self, pieces: list[tuple], size: int) -> None:
        number = (self.task << 40) + self.sequences
        self.sequences += 1
        tier = next(t for t in self.tiers if t >= size)
        group = self.made[tier] * tier // self.step_ids
        self.made[tier] += 1
        offset = 0
        for doc, start, length in pieces:
            name, ids, total = doc
            crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
            self.rows.append((name, start, length, crc, total, number, offset, tier, (self.task << 40) + (tier.bit_length() << 34) + group))
            offset += length

    def add(self, name: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        doc = (name, ids, total)
        full = total // self.longest * self.longest
        for start in range(0, full, self.longest):
            self.close([(doc, start, self.longest)], self.longest)
        if total > full:
            self.put(doc, full, total - full)

    def pack(self) -> None:
        """Fill windows from the longest tier down while the waiting rests can fill one."""
        for tier in reversed(self.tiers):
            low = tier // 2 if tier != self.tiers[0] else 0
            while (first := self.take(tier)) is not None:
                if first[2] <= low:
                    self.put(*first)
                    break
                pieces, gap = [first], tier - first[2]
                while gap:
                    rest = self.take(gap)
                    if rest is None:
                        rest = self.shortest()
                        if rest is None:
                            break
                        doc, start, length = rest
                        self.put(doc, start + gap, length - gap)
                        rest = (doc, start, gap)
                    pieces.append(rest)
                    gap -= rest[2]
                if gap:  # nothing is left to fill it with
                    for piece in pieces:
                        self.put(*piece)
                    return
                self.close(pieces, tier)

    def finish(self) -> None:
        """Cut the last rests, less than a window, at powers of two."""
        self.pack()
        pieces, held = [], 0
        while (rest := self.take(self.longest)) is not None:
            pieces.append(rest)
            held += rest[2]
        while held:
            size = min(1 << (held.bit_length() - 1), self.longest)
            window, room = [], size
            while room:
                doc, start, length = pieces.pop(0)
                used = min(room, length)
                window.append((doc, start, used))
                if used < length:
                    pieces.insert(0, (doc, start + used, length - used))
                room -= used
            self.close(window, size)
            held -= size


def pack(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
         tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS) -> DataFrame:
    """One row per piece of a document: where it starts in the document and in its window, and the crc32 of its ids.

    ``tiers`` are powers of two that double; ``context`` names the tier of the window and ``step_group`` its step."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(packer: Packer) -> pa.RecordBatch:
        columns = list(zip(*packer.rows))
        packer.rows = []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_ids)
        for batch in slices(batches, "text", 8 << 20):
            for name, ids in zip(batch.column("id").to_pylist(), words.encode(octets(batch.column("text")))):
                packer.add(name, ids + end)
            packer.pack()
            if packer.rows:
                yield rows(packer)
        packer.finish()
        if packer.rows:
            yield rows(packer)

    return pick(documents, id=doc_id, text=text).mapInArrow(run, PIECES)
