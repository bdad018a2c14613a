"""Link requests: chains that share masks, refusals, re-pointed, revived and split members."""

import pytest

from tallyscope.operators.graph import groups
from tallyscope.operators.linking import settle_links

ASK = "link_id bigint, viewpoint_id bigint, target_id bigint, image_id bigint, mask_key string, is_rep boolean, label string, species string"
ROWS = "image_id bigint, mask_key string, viewpoint_id bigint, batch_id int, object_id bigint, removed boolean, accepted boolean, label string, species string"
SEEN = "image_id bigint, mask_key string, viewpoint_id bigint, passed boolean"


def ask(link, image, key="a", rep=False, target=None, label=None, species=None, view=1):
    return (link, view, target, image, key, rep, label, species)


def row(image, obj, key="a", batch=1, removed=False, label="", species="", view=1):
    return (image, key, view, batch, obj, removed, False, label, species)


@pytest.fixture(scope="module")
def settle(spark):
    def run(asks, rows, seen):
        out = settle_links(spark.createDataFrame(asks, ASK), spark.createDataFrame(rows, ROWS), spark.createDataFrame(seen, SEEN))
        return {(r["image_id"], r["mask_key"]): r.asDict() for r in out.collect()}

    return run


SEE = [(i, "a", 1, i != 4) for i in range(1, 8)]


def test_a_chain_of_requests_is_one_object(settle):
    asks = [ask(10, 1, rep=True), ask(10, 2), ask(11, 2), ask(11, 3, rep=True), ask(12, 3), ask(12, 4, rep=True), ask(20, 5, rep=True), ask(20, 6)]
    got = settle(asks, [row(1, 100, label="rod"), row(2, 200), row(3, 300)], SEE)
    assert {k[0]: (v["link_id"], v["what"], v["object_id"], v["is_rep"], v["accepted"], v["label"]) for k, v in got.items()} == {
        1: (10, "stays", 100, True, False, "rod"), 2: (10, "moved", 100, False, False, "rod"), 3: (10, "moved", 100, False, False, "rod"), 4: (10, "created", 100, False, True, "rod"),
        5: (20, "created", None, True, False, ""), 6: (20, "created", None, False, False, ""),
    }


def test_a_changed_link_lets_members_go(settle):
    rows = [row(1, 100), row(2, 100), row(3, 100, species="X y"), row(5, 500)]
    got = settle([ask(1, 1, rep=True, target=100), ask(1, 5, target=100)], rows, SEE)
    assert {k[0]: (v["what"], v["object_id"]) for k, v in got.items()} == {1: ("stays", 100), 5: ("moved", 100), 2: ("split", None), 3: ("split", None)}


@pytest.mark.parametrize("asks, rows, why", [
    ([ask(1, 1, rep=True)], [], "too few members"),
    ([ask(1, 1), ask(1, 2)], [], "not one representative"),
    ([ask(1, 1, rep=True), ask(1, 1, key="b")], [], "one image twice"),
    ([ask(1, 1, rep=True), ask(1, 2, key="none")], [], "unknown mask"),
    ([ask(1, 1, rep=True), ask(1, 9)], [(9, "a", 2, None, 7, False, False, "", "")], "several viewpoints"),
    ([ask(1, 1, rep=True), ask(1, 2)], [row(2, 5, removed=True)], "removed member"),
    ([ask(1, 1, rep=True), ask(1, 2)], [row(2, 5), row(3, 5)], "already linked"),
    ([ask(1, 1, rep=True), ask(1, 2)], [row(1, 4, label="rod"), row(2, 5, label="round")], "conflict"),
    ([ask(1, 1, rep=True, label="rod"), ask(1, 2)], [row(1, 4, label="rod"), row(2, 5, label="round")], ""),
])
def test_refusals(settle, asks, rows, why):
    got = settle(asks, rows, SEE)
    assert {v["why"] for k, v in got.items() if v["what"] != "split"} == {why}
    if why:
        stored = {(r[0], r[1]): r[4] for r in rows}
        assert all(v["what"] == "refused" and v["object_id"] == stored.get(k) for k, v in got.items())


def test_groups_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (7, 7), (200, 200), (None, 3)]
    found = dict(groups(spark.createDataFrame(pairs, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 200: 200}
    assert groups(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
