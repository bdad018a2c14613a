"""The corpus operators against plain Python, on the smallest folder and on tables of odd rows."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter
from html import unescape

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyscope.llm import components, contamination, embedding, packing, pages, paragraphs, rules, simhash, suffixes, tokens, toxicity
from tallyscope.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60000))
    plain = " ".join(rng.choice(words) for _ in range(200))
    near = plain.split()
    near[100] = "changed"
    return [
        (1, plain, "en", "a", 1), (2, plain, "en", "a", 1), (2, plain, "en", "a", 1), (3, " ".join(near), None, None, None), (4, None, "en", "a", 0),
        (5, "", "en", "a", 0), (6, " \n\t ", "en", "a", 4), (7, long, "en", "b", 5), (None, "some words without an id", "en", "a", 3), (8, "é  x ß", "de", "a", 7),
        (9, "A! " * 300, "en", "a", 900), (10, "x" * 5000, "en", "a", 5000), (None, plain, "en", "a", 2),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def clashing(spark, odd):
    """The same rows with columns named like those that the operators make."""
    from pyspark.sql import functions as F

    names = ("id", "d", "k", "h", "fp", "row", "words", "cover", "score", "n_words", "component_id", "quality_rules", "verdict", "text_t", "label", "mark")
    return odd.select("*", *(F.lit(n).alias(n) for n in names))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1. near-duplicates


@pytest.mark.parametrize("bucket", [4096, 1])
def test_simhash(spark, odd, clashing, bucket):
    for df in (table(spark, "documents"), odd, clashing):
        found = simhash.near_duplicates(df, bucket=bucket)
        shown = [(r["doc_id"], format(r["fp"] % (1 << 64), "016x"), r["component_id"]) for r in found.collect()]
        assert sorted(shown, key=str) == brute.near_duplicates(pairs(df))
        if bucket == 1:  # every bucket of two goes through common values; that is slow on a whole folder
            break


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (2000, 64))
    bits[:, 32:] = bits[:, :32]  # correlated pairs
    for n in (2000, 10**6, 10**10):
        masks = simhash.plan(n, (bits.T @ bits) * (n / 2000))
        for _ in range(300):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            diff = sum(1 << int(b) for b in flips)
            assert any(diff & m == 0 for m in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    found = dict(components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


# 2. pages


def test_pages_of_the_folder(spark):
    for r in QUERIES["op2_html_extraction"](spark, FOLDER).join(table(spark, "pages").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", p))).strip() for p in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
        assert r["text"] == " ".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


PAGE = (
    "<html><body class='has-sidebar'><header>Site name</header><nav>Home</nav><div class='cookie-notice'>We use cookies</div>{}<div id='comments'>First!</div>"
    "<form>Your name</form><script>if (a < b) track('<p>no</p>')</script><footer>Imprint</footer></body></html>"
)


def test_marked_article():
    html = PAGE.format("<article><header><h1>A &amp; B</h1></header><p>One<b>two</b>\n three<p>four&nbsp;five<aside>Ad</aside></article>")
    assert pages.main_text(html, set()) == "A & B Onetwo three four five"


def test_class_words_inside_an_article():
    kept = '<div class="search-results form-factor tags">Text</div><p class="notice-period">kept?</p>'
    gone = '<div class="cookie-notice-box">Cookies</div><p class="advert">Buy</p><div id="share-buttons">Share</div><div class="post comments">First!</div>'
    assert pages.main_text(PAGE.format(f"<article><p>One</p>{kept}{gone}<p>two</article>"), set()) == "One Text kept? two"


def test_unmarked_pages_by_difference(spark):
    rows = [(i, f"http://h/a/{i}", PAGE.format(f"<p>Shared teaser line</p><p>Own text of {i}</p><p>Call us now</p>")) for i in range(30)]
    rows += [(99, None, None), (98, "http://h/a/1", ""), (97, "http://[bad", "<p>plain")]
    rows += [(96, "http://other/x", PAGE.format("<p>Alone on its host</p>"))] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for ranges in (1, 7):
        found = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract(df, ranges=ranges).collect()}
        want = {i: f"Own text of {i}" for i in range(30)} | {99: "", 98: "", 97: "plain", 96: "Alone on its host"}
        if found[0][0].startswith("Shared"):  # the empty page may be the nearest of one
            raise AssertionError(found[0])
        assert {k: v[0] for k, v in found.items() if k not in (1, 10, 11)} == {k: v for k, v in want.items() if k not in (1, 10, 11)}
    assert pages.extract(df.limit(0)).collect() == []


def test_longest_common_lines():
    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        shared = sorted(pages.shared_lines(a, b))
        it = iter(b)
        assert len(shared) == best[-1][-1] and all(any(a[i] == y for y in it) for i in shared)


# 3. paragraphs


def whole_classes(df):
    """Paragraphs by exact similarity of all pairs."""
    found = [(i, place, tuple(words)) for i, t in pairs(df) for place, words in paragraphs.cut_text((t or "").encode())]
    sets = [set(paragraphs.shingles(list(w)).tolist()) for _, _, w in found]
    group = brute.classes(len(found), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    size = Counter(group)
    return sorted((str(i), place, size[g]) for (i, place, _), g in zip(found, group) if size[g] > 1)


@pytest.mark.parametrize("bucket", [256, 2])
def test_paragraphs(spark, odd, clashing, bucket):
    for df in (table(spark, "documents").where("doc_id < 120"), odd, clashing):
        every = paragraphs.near_duplicates(df, bucket=bucket, recall=0.99999).collect()
        found = [r for r in every if r["kind"] == "paragraph"]
        assert sorted((str(r["doc_id"]), r["place"], r["members"]) for r in found) == whole_classes(df)
        stay = Counter(r["class_id"] for r in every if not r["removed"])
        assert all(n >= 1 for n in stay.values()) and set(stay) == {r["class_id"] for r in every}


def test_passages_inside_paragraphs(spark):
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    shared = text(paragraphs.LEAST_WORDS + paragraphs.REACH + paragraphs.SHINGLE)
    rows = [(i, " ".join([*text(rng.randint(0, 90)), *(shared if i % 3 == 0 else []), *text(rng.randint(0, 90))])) for i in range(30)]
    found = paragraphs.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in found} == set(range(0, 30, 3)) and {r["kind"] for r in found} <= {"passage", "paragraph"}
    assert all(r["members"] >= 2 for r in found) and 0 in {r["doc_id"] for r in found if not r["removed"]}


@pytest.mark.parametrize("around", [paragraphs.AROUND, 1])
def test_whole_passages(spark, around):
    """The maximal runs, word by word, and what is left without the later ones."""
    rng = random.Random(16)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    shared, more = text(51), text(130)
    inside = [shared, [*more, *shared], more[:60], shared, [*text(1), *more[40:]], [*shared, *more[70:]], text(60)]
    rows, want, left = [], [], []
    for i, run in enumerate(inside):
        before, after = text(70 + i), text(80)
        rows.append((i, " ".join([*before, *run, *after])))
    find = lambda i, words: f" {rows[i][1]} ".index(" " + " ".join(words) + " ")
    place = lambda i, words: len(rows[i][1][: find(i, words)].split())
    # Text 1 repeats text 0 and is the first to hold ``more``; its own run is parted where the earlier words begin.
    stay = [(0, shared), (1, more)]
    gone = [(1, shared), (2, more[:60]), (3, shared), (4, more[40:]), (5, [*shared, *more[70:]])]
    want = sorted([(i, place(i, w), len(w), False) for i, w in stay] + [(i, place(i, w), len(w), True) for i, w in gone])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [r for r in paragraphs.near_duplicates(df, around=around).collect() if r["kind"] == "passage"]
    assert sorted((r["doc_id"], r["place"], r["n_words"], r["removed"]) for r in found) == want
    assert len({r["class_id"] for r in found}) == 1 and {r["members"] for r in found} == {7}
    left = dict(tuple(r) for r in paragraphs.strip(df, around=around).collect())
    cut = dict(gone)
    assert left == {i: t.replace(" ".join(cut[i]) + " ", "") if i in cut else t for i, t in rows}


def test_stripped_paragraphs(spark, odd, clashing, empty):
    for df in (odd, clashing):
        left = paragraphs.strip(df)
        assert left.dtypes == df.dtypes and left.count() == df.count()
        texts = {i: t for i, t in pairs(left) if i in (1, 3, 4, 7, 8)}
        before = {i: t for i, t in pairs(df)}
        assert texts == {i: before[i] if i != 3 else "" for i in texts}
    assert paragraphs.strip(empty).collect() == []


def test_short_and_wrapped_paragraphs(spark):
    """Paragraphs cut by a rule of the test's own, not by ``cut_text``."""
    rng = random.Random(26)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    short = [text(n) for n in range(3, 20) for _ in range(2)]
    near = [[*s[:-1], "other"] for s in short]
    rows, places = [], []  # places: (id, line, words)
    for i in range(30):
        lines = [text(40), *(rng.choice(short + near) for _ in range(rng.randint(0, 9)))]
        rows.append((i, "\n".join(" ".join(w) for w in lines)))
        places += [(i, j, w) for j, w in enumerate(lines) if len(w) >= 5]
    story = [text(120), text(9), text(70)]
    for i, width in ((30, 80), (31, 72), (32, 10**6)):
        told = [[*w[:50], f"edit{i}", *w[51:]] if len(w) > 60 else w for w in story]
        wrapped = [textwrap.wrap(" ".join(w), width) for w in told]
        rows.append((i, "\n\n".join("\n".join(p) for p in wrapped)))
        starts = [sum(len(p) + 1 for p in wrapped[:j]) for j in range(3)]
        places += list(zip([i] * 3, starts, told))
    rows.append((33, " ".join(short[10])))
    places.append((33, 0, short[10]))
    sets = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for _, _, w in places]
    group = brute.classes(len(places), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    size = Counter(group)
    want = sorted((i, j, len(w), size[g]) for (i, j, w), g in zip(places, group) if size[g] > 1)
    assert {(30, 0, 120, 3), (31, 0, 120, 3), (32, 0, 120, 3)} <= set(want) and any(i == 33 for i, *_ in want)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [r for r in paragraphs.near_duplicates(df, recall=0.99999).collect() if r["kind"] == "paragraph"]
    assert sorted((r["doc_id"], r["place"], r["n_words"], r["members"]) for r in found) == want


def test_paragraphs_empty(empty):
    assert paragraphs.near_duplicates(empty).collect() == []


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = paragraphs.tuned(threshold, 0.99)
        assert 1 - (1 - threshold**rows) ** bands >= 0.99


# 4. and 9. classifiers


def test_quality_classifier(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op4_quality_classifier"](spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = found.collect()
    assert len(rows) == 1000 and all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([labels[r["doc_id"]] == r["predicted"] for r in rows if r["held_out"] and r["doc_id"] in labels]) > 0.95


def test_toxicity(spark):
    found = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01")
    rows = found.collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_classifiers_on_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (77, 1, 1), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    quality = embedding.fit(odd, labels)
    toxic = toxicity.fit(odd, labels, "odd")
    for df in (odd, clashing):
        assert embedding.score(df, quality, "odd").count() == toxicity.score(df, toxic, "odd").count() == len(odd_rows())
    assert embedding.score(empty, embedding.fit(empty, labels), "none").collect() == []
    assert toxicity.score(empty, toxicity.fit(empty, labels, "none"), "none").collect() == []


def test_few_toxic_rows_keep_their_words(spark):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 < 2][:300]
    rows = [(i, "bad one two" if n < 2 else f"w{n % 50} one two") for n, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, int(n < 2)) for n, i in enumerate(ids)], "doc_id bigint, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, "few")
    assert model.slots[zlib.crc32(b"bad") % toxicity.SLOTS] > 1 and model.slots[zlib.crc32(b"one") % toxicity.SLOTS] < 0


def test_model_learns_held_back_words():
    rng = random.Random(2)
    good, bad = [f"wort{i}" for i in range(50)], [f"junk{i}***" for i in range(50)]
    texts = [(c, " ".join(rng.choice(bad[:40] if c == 0 else good[:40]) for _ in range(30)).encode()) for c in (0, 1) * 60]
    model = embedding.train([(c, *embedding.document_features(t)) for c, t in texts])
    at = [embedding.document_features(" ".join(w).encode()) for w in (bad[40:], good[40:])]
    low, high = (float(model.weights[a] @ s) + model.bias for a, s in at)
    assert low < 0 < high


def test_maximal_segments():
    rng = random.Random(4)

    def slow(scores):  # the definition: all left-to-right minimal/maximal subsequences, by recursion on the best one
        if not any(s > 0 for s in scores):
            return []
        sums = [0.0]
        for s in scores:
            sums.append(sums[-1] + s)
        a, b = max(((i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda p: (sums[p[1]] - sums[p[0]], p[0] - p[1]))
        shift = [(x + b, y + b, s) for x, y, s in slow(scores[b:])]
        return [*slow(scores[:a]), (a, b, sums[b] - sums[a]), *shift]

    for _ in range(200):
        scores = [rng.choice([-1.7, -0.63, 0.91, 1.37, 2.11]) * rng.uniform(0.9, 1.1) for _ in range(rng.randint(1, 14))]
        at = [i for i, s in enumerate(scores) if s > 0]
        before = np.concatenate(([0.0], np.cumsum(scores)))
        losses = [before[i] - (before[at[k - 1] + 1] if k else 0.0) for k, i in enumerate(at)]
        found = toxicity.maximal_segments(at, [scores[i] for i in at], losses)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in slow(scores)]


# 5. and 8. tokens


def test_packing(spark, odd, clashing):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(["It's 'sX, o'clock!!,", "naïve ÀÉ é 1234", "a b　c", None, "", "Don't.'t", "don',", "a <|endoftext|> b", "x<|startoftext|><|endoftext|>y <|ENDOFTEXT|>'t", *(t for _, t in pairs(table(spark, "documents")))])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert brute.packing_faults(rows, [r.asDict() for r in packing.pack(df, path).collect()], tokenizer) == ""
    for few in (odd, clashing):
        assert packing.pack(few.where("doc_id is not null").dropDuplicates(["doc_id"]), path).count() >= 10
        assert packing.pack(few, path).agg({"length": "sum"}).first()[0] == packing.pack(few.repartition(3), path).agg({"length": "sum"}).first()[0]
    assert packing.pack(df.limit(0), path).collect() == []


def test_packing_steps(spark):
    found = packing.pack(table(spark, "documents").coalesce(1), public_tokenizers.path("word_bpe_49k.json")).collect()
    whole = Counter()
    for r in found:
        whole[r["step_group"]] += r["length"]
    assert max(whole.values()) == packing.STEP_IDS


def test_token_counts(spark, odd, clashing, empty):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding, _ = tokens.encoder(ranks, public_tokenizers.PATTERN)
    for df in (table(spark, "documents"), odd):
        found = tokens.attribute(df, ranks, public_tokenizers.PATTERN, fields=("source", "lang", "text")).collect()
        want = Counter()
        for r in df.collect():
            want[r["doc_id"]] += len(encoding.encode_ordinary("\n".join([r["source"] or "", r["lang"] or "", r["text"] or ""])))
        have = Counter()
        for r in found:
            have[r["doc_id"]] += r["n_tokens"]
        assert have == want
    assert tokens.attribute(clashing, ranks, public_tokenizers.PATTERN).count() == tokens.attribute(odd, ranks, public_tokenizers.PATTERN).count()
    assert tokens.attribute(empty, ranks, public_tokenizers.PATTERN).collect() == []


def test_crossing_tokens_go_to_the_larger_part():
    home, crossing = tokens.share(np.array([3, 6, 6, 10]), np.array([2, 3, 1, 2, 2]))
    assert home.tolist() == [0, 1, 1, 3, 3] and crossing.tolist() == [False, True, False, False, False]
    assert tokens.share(np.array([2, 4]), np.array([1, 2, 1]))[0].tolist() == [0, 0, 1]  # a tie goes to the earlier


# 6. rules


def test_rules(spark, odd, clashing):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (table(spark, "documents"), odd, clashing):
        name = "measures_of_rules"
        rows = rules.judge(df, name=name).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert tuple(r[name][n] for n in names) == brute.rule_base(r["text"])
            assert not (r[name]["kept"] and r[name]["base_failed"])


def test_rules_keep_plain_text_and_reject_symbols(spark):
    rows = rules.judge(table(spark, "documents"), name="v").join(table(spark, "labels"), "doc_id").where("not v.base_failed").collect()
    assert all(r["v"]["kept"] == (r["quality"] == 1) for r in rows)


def test_rules_empty(empty):
    assert rules.judge(empty).collect() == [] and rules.estimate([]) is None


PATTERNS = [((1, None, 1), 800), ((0, None, 1), 40), ((0, 0, None), 90), ((None, None, None), 70), ((0, 0, 0), 30), ((1, 1, 0), 25)]


def test_estimate_does_not_depend_on_size():
    small, large = rules.estimate(PATTERNS)[0], rules.estimate([(p, 1000 * n) for p, n in PATTERNS])[0]
    assert all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip([small.good, *small.right, *small.wrong], [large.good, *large.right, *large.wrong]))


def test_likelihood_never_falls_and_settles():
    model, history = rules.estimate(PATTERNS)
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(history, history[1:]))
    assert len(history) < rules.ROUNDS
    again = rules.estimate(PATTERNS, rounds=len(history) + 500)[0]
    assert model == again


def plain_posteriors(patterns, rounds):
    """The two-class model in numpy, one row per document."""
    votes = np.array([[np.nan if v is None else v for v in p] for p, n in patterns for _ in range(n)])
    weight = rules.PRIOR_SHARE * len(votes)
    good = np.array([0.05 if 0 in v else 0.95 if 1 in v else 0.5 for v in votes])
    for _ in range(rounds):
        share = (good.sum() + weight * rules.PRIOR_GOOD) / (len(votes) + weight)
        voted = ~np.isnan(votes)
        one = np.nan_to_num(votes)
        rate = [(c @ one + weight * b) / (c @ voted + weight) for c, b in ((good, rules.PRIOR_RIGHT), (1 - good, rules.PRIOR_WRONG))]
        ways = [np.log(s) + (voted * (one * np.log(r) + (1 - one) * np.log(1 - r))).sum(1) for s, r in zip((share, 1 - share), rate)]
        good = 1 / (1 + np.exp(ways[1] - ways[0]))
    return share, rate


def test_estimate_against_plain_version():
    model, history = rules.estimate(PATTERNS)
    share, (right, wrong) = plain_posteriors(PATTERNS, len(history))
    assert np.allclose([model.good, *model.right, *model.wrong], [share, *right, *wrong], rtol=1e-6)


def test_planted_accuracies_are_found():
    rng = np.random.default_rng(4)
    share, right, wrong, speaks = 0.8, [0.97, 0.9, 0.95, 0.85, 0.99], [0.2, 0.3, 0.1, 0.35, 0.4], 0.8
    good = rng.random(60000) < share
    rate = np.where(good[:, None], right, wrong)
    votes = np.where(rng.random(rate.shape) < speaks, rng.random(rate.shape) < rate, -1)
    patterns = Counter(tuple(None if v < 0 else int(v) for v in row) for row in votes)
    model = rules.estimate(sorted(patterns.items(), key=str))[0]
    assert abs(model.good - share) < 0.02
    assert np.allclose(model.right, right, atol=0.02) and np.allclose(model.wrong, wrong, atol=0.03)
    # One bad vote of a weak rule does not outweigh the others.
    assert model.prior() + model.log_odds(3, 0) + sum(model.log_odds(r, 1) for r in (0, 1, 2, 4)) > 0


def test_kept_follows_the_model(spark):
    rows = [(r["v"], tuple(r[f"r{i}"] for i in range(8))) for r in rules.judge(table(spark, "documents"), name="v").select(
        "v", *(v.alias(f"r{i}") for i, v in enumerate(rules.votes(F.col("v")).values()))).collect()]
    patterns = sorted(Counter(votes for v, votes in rows if not v["base_failed"]).items(), key=str)
    share, (right, wrong) = plain_posteriors(patterns, 300)
    for v, votes in rows:
        odds = math.log(share / (1 - share)) + sum(math.log(right[i] / wrong[i]) if x else math.log((1 - right[i]) / (1 - wrong[i])) for i, x in enumerate(votes) if x is not None)
        assert abs(v["posterior"] - 1 / (1 + math.exp(-max(-60, min(60, odds))))) < 1e-6
        assert v["kept"] == (not v["base_failed"] and v["posterior"] >= 0.5)


# 7. long repeats


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(80):
        letters = rng.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([1, 5, 30, 120])))) for _ in range(rng.randint(1, 6))]
        text = np.array([s for t in texts for s in [*(b + 1 for b in t), 0]], np.int16)
        assert suffixes.suffix_array(text, len(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        for size in (2, 3, 5):
            often = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
            want = [[i for i in range(len(t) - size + 1) if often[t[i : i + size]] > 1] for t in texts]
            assert [g.tolist() for g in suffixes.repeated_in(texts, size)] == want


@pytest.mark.parametrize("limit", [2048, 1])
def test_long_repeats(spark, odd, clashing, limit):
    for df in (table(spark, "documents"), odd, clashing):
        assert got(suffixes.measure(df, pieces_limit=limit)) == brute.long_repeats(pairs(df))


def test_short_repeats_of_few_letters(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(100, "ab" * 60), (101, "a" * 90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for limit in (2048, 2):
        assert got(suffixes.measure(df, size=12, gram=4, pieces_limit=limit)) == brute.long_repeats(rows, 12)


def test_stripped_texts(spark, odd, clashing, empty):
    for df in (odd, clashing):
        left = suffixes.strip(df)
        assert left.columns == df.columns and left.count() == df.count()
        sizes = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in pairs(left) if i in (1, 7, 8)}
        assert sizes == {(r[0], r[4]) for r in brute.long_repeats(pairs(df)) if r[0] in (1, 7, 8)}
    assert suffixes.strip(empty).collect() == [] and suffixes.measure(empty).collect() == []


# 10. benchmark


def test_decontamination(spark, odd, clashing, empty):
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    odd_items = [(1, "some WORDS, without"), (2, None), (3, ""), (4, "...!"), (5, "some words without"), (6, " ".join(odd_rows()[0][1].split()[20:45])), (None, "w1")]
    for df, chosen in ((table(spark, "documents"), items), (odd, odd_items), (clashing, odd_items)):
        bench = spark.createDataFrame(chosen, "item_id bigint, text string")
        for block in (contamination.BLOCK_BYTES, sum(len(t or "") for _, t in chosen) // 3):
            hits = contamination.digest(contamination.scan(df, bench, block_bytes=block))
            assert got(hits) == brute.benchmark_hits(pairs(df), chosen)
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination.scan(odd, nothing).where("n_hit > 0").count() == 0
    assert contamination.scan(empty, bench).collect() == []
    for block in (contamination.BLOCK_BYTES, 60):
        clean = contamination.clean(odd, spark.createDataFrame(odd_items, "item_id bigint, text string"), block_bytes=block)
        want = [r for r in odd_rows() if not brute.benchmark_hits([r[:2]], odd_items)[0][5]]
        assert got(clean) == sorted(want, key=str)


def test_spans_lie_in_the_original(spark):
    text = "Ä, one two-three FOUR five six seven eight nine ten, eleven. End"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id bigint, text string")
    span = contamination.scan(df, bench).first()["spans"][0]
    assert text[span["start"] : span["stop"]] == "two-three FOUR five six seven eight nine ten, eleven"


# the pipeline


def test_pipeline(spark, tmp_path):
    docs = table(spark, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select("doc_id", "text").collect()
    kept = {r["doc_id"] for r in rules.judge(docs, name="v").where("v.kept").collect()}
    assert all((not brute.rule_base(t)[5]) for i, t in rows if i in kept)
    left = [(i, t) for i, t in rows if i in kept]
    first = {c for i, _, c in brute.near_duplicates(left) if i == c}
    left = [(i, t) for i, t in left if i in first]
    texts = {}
    for i, _, _, _, sha in brute.long_repeats(left):
        texts[i] = sha
    stage = docs
    for name, f in corpus_pipeline.STAGES[:3]:
        f(spark, stage, FOLDER).write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        assert stage.columns == docs.columns and stage.schema == docs.schema
    now = pairs(stage)
    assert {i for i, _ in now} == set(texts)
    full = {i: t for i, t in left}
    assert all(hashlib.sha256(t.encode()).hexdigest() == texts[i] for i, t in now if len(t) == len(full[i]))
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    clean = [(i, t) for i, t in now if not {r[0]: r[5] for r in brute.benchmark_hits([(i, t)], items)}[i]]
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, FOLDER).collect()]
    assert brute.packing_faults(clean, pieces, Tokenizer.from_file(path)) == ""


def test_pipeline_stages_on_odd_rows(spark, odd, clashing, empty):
    for df in (odd, clashing, empty):
        stage = df
        for _, f in corpus_pipeline.STAGES[:4]:
            stage = spark.createDataFrame(f(spark, stage, FOLDER).collect(), df.schema)
            assert stage.columns == df.columns
        corpus_pipeline.STAGES[4][1](spark, stage, FOLDER).collect()
    ids = {r["doc_id"] for r in simhash.first_of_each(odd).collect()}
    assert {1, 4, 7} <= ids and not {2, 3, 5, 6} & ids
