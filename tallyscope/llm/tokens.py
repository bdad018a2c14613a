"""Token counts of fields and sections by offset-mapped attribution.

The fields of a document are joined, the whole text is encoded once, and the byte spans of its tokens are joined with
the spans of the sections (the lines of each field). A token that crosses a boundary goes to the section that holds most
of its bytes, at a tie to the earlier one; the separator between sections belongs to the section before it. So the
counts of a document add up to the length of its encoding.

Every line is a section, an empty one too; a null field is empty. Offsets are code points of the joined text. Repeated
rows are counted each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import octets, slices

SECTIONS = "doc_id bigint, field string, section bigint, start bigint, stop bigint, n_tokens bigint, n_crossing bigint"
ENCODERS: dict[tuple[str, str], tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoder(path: str, rule: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the number of bytes of each id."""
    if (path, rule) not in ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(k) for k in ranks]
        ENCODERS[path, rule] = tiktoken.Encoding("ranks", pat_str=rule, mergeable_ranks=ranks, special_tokens={}), sizes
    return ENCODERS[path, rule]


def share(stops: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary. ``stops`` are where sections end, ``sizes`` the
    bytes of the tokens; both cover the same text."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.searchsorted(stops, starts, side="right")
    last = np.searchsorted(stops, ends, side="left")
    home = first.copy()
    for t in np.flatnonzero(last > first).tolist():
        edges = np.clip(stops[first[t] : last[t] + 1], None, ends[t])
        home[t] = first[t] + int(np.argmax(np.diff(np.concatenate(([starts[t]], edges)))))
    return home, last > first


def attribute(documents: DataFrame, ranks: str, rule: str, doc_id: str = "doc_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row per line of each field: its span in the joined text and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(ranks, rule)
        for batch in slices(batches, "f0"):
            out: list[list] = [[] for _ in range(7)]
            for name, *parts in zip(batch.column("id").to_pylist(), *(octets(batch.column(f"f{i}")) for i in range(len(fields)))):
                raw = b"\n".join(parts)
                text = raw.decode()
                stops = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1, len(raw))
                ids = encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.int64)
                home, crossing = share(stops, sizes[ids])
                n = len(stops)
                # Bytes that start a code point, counted up to each end.
                chars = stops if len(text) == len(raw) else np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[stops - 1] if raw else np.zeros(n, np.int64)
                lines = [p.count(b"\n") + 1 for p in parts]
                out[0] += [name] * n
                out[1] += [f for f, k in zip(fields, lines) for _ in range(k)]
                out[2] += [i for k in lines for i in range(k)]
                out[3].append(np.concatenate(([0], chars[:-1])))
                out[4].append(chars)
                out[5].append(np.bincount(home, minlength=n))
                out[6].append(np.bincount(home[crossing], minlength=n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()),
                 *(pa.array(np.concatenate(c).astype(np.int64)) for c in out[3:])],
                names=[c.split()[0] for c in SECTIONS.split(", ")])

    shown = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), *(F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    return shown.mapInArrow(run, SECTIONS)
