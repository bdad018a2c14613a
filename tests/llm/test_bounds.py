"""What a task of the corpus operators may hold at once."""

import random
import tracemalloc

from tallyscope.llm import suffixes


def test_a_suffix_array_needs_little_beside_its_symbols():
    rng = random.Random(5)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(600)) for _ in range(400)]
    pieces = base + [p[:300] + b"#" + p[301:] for p in base]
    tracemalloc.start()
    try:
        suffixes.repeated_in(pieces)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * sum(map(len, pieces))


def test_blocks_hold_whole_anchors_and_stay_small(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 100)
    rows = [(h, i, 30, b"") for h, n in enumerate([2, 2, 1, 5, 1, 1, 1]) for i in range(n)]
    blocks = list(suffixes.blocks_of(iter(rows)))
    assert [row for block in blocks for row in block] == rows
    anchors = [{row[0] for row in block} for block in blocks]
    assert sum(map(len, anchors)) == 7  # none is cut
    assert all(len(a) == 1 or sum(row[2] for row in block) <= 100 for a, block in zip(anchors, blocks))
    assert list(suffixes.blocks_of(iter([]))) == []
