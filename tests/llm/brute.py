"""Plain Python versions of the corpus operators, for small tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

BLANKS = r"\x20\x09-\x0D"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def classes(n, linked):
    """Component of each of n things, as its smallest number."""
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return [top(i) for i in range(n)]


def simhash(text):
    words = re.findall(f"[^{BLANKS}]+", lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows):
    prints = np.array([simhash(t) for _, t in rows], np.uint64)
    group = classes(len(rows), lambda a, b: (int(prints[a]) ^ int(prints[b])).bit_count() <= 3)
    ids = {}
    for g, (i, _) in zip(group, rows):
        ids[g] = min([x for x in (ids.get(g), i) if x is not None], default=None)
    return sorted(((i, format(int(p), "016x"), ids[g]) for (i, _), p, g in zip(rows, prints, group)), key=str)


def rule_base(text):
    text = text or ""
    words = re.findall(f"[^{BLANKS}]+", text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{BLANKS}]", line):
            copies += line in seen
            seen.add(line)
    often = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if often[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(covered), failed


def long_repeats(rows, size=400):
    raws = [(i, (t or "").encode()) for i, t in rows]
    often = Counter(r[k : k + size] for _, r in raws for k in range(len(r) - size + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - size + 1):
            if often[r[k : k + size]] > 1:
                gone[k : k + size] = True
        left = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def benchmark_hits(rows, items, width=10):
    rule = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, text in items:
        words = re.findall(rule, lower(text))
        for k in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + width]), set()).update([] if item is None else [str(item)])
    out = []
    for i, text in rows:
        words = re.findall(rule, lower(text))
        hit, ids = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                found = windows.get(tuple(words[k : k + n]))
                if found is not None:
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def packing_faults(rows, pieces, tokenizer, longest=2048):
    """Rows of pieces against the ids of the library; '' if every id is in one piece and every window is full."""
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    by_doc, by_window = {}, {}
    for p in pieces:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        if len(own) != p["length"] or p["doc_tokens"] != len(ids[p["doc_id"]]):
            return f"length {p}"
        if zlib.crc32(np.array(own, "<u4").tobytes()) != p["ids_crc32"]:
            return f"crc {p}"
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_window.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for name, parts in [*by_doc.items(), *by_window.items()]:
        at = 0
        for start, length in sorted(parts):
            if start != at:
                return f"gap in {name}"
            at += length
    if set(by_doc) != set(ids) or any(sum(n for _, n in by_doc[i]) != len(ids[i]) for i in ids):
        return "missing ids"
    for parts in by_window.values():
        n = sum(n for _, n in parts)
        if n > longest or n & (n - 1):
            return f"window of {n}"
    return ""
