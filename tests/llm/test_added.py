"""Periodic runs, secrets and collocations against plain Python, on the smallest folder and on tables of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyscope.llm import collocations, periodic, secrets
from tallyscope.llm.queries import QUERIES, planted

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["on", "and", "off"]) for _ in range(40000))
    rows = [
        (1, "A! " * 300, "en", "a", 900), (1, "A! " * 300, "en", "a", 900), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t\r ", "en", "a", 5),
        (5, long, "en", "a", 1), (None, "one two three " * 9, "de", "a", 2), (6, "é ß " * 20 + "\x1f  x", None, "a", 3),
        (7, 'x Password = "abcdef" token=abc AKIA' + "B" * 16 + " " + "0a" * 12 + " AKIAAA", "en", "a", 4), (30, "w " * 50, "en", "a", 5), (33, "a b " * 9 + "c", "en", "a", 6),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit(n).alias(n) for n in ("runs", "spans", "part", "phrase", "a", "n", "k", "score", "rank", "collapsed", "n_words", "kind")))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11. periodic runs


def plain_runs(words, least=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def query_runs(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_runs_of_random_words():
    rng = random.Random(2)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, kinds = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 8])
            words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        ids, places = periodic.numbered(texts)
        want = [(s + places[t], n, q) for t, w in enumerate(texts) for s, n, q in plain_runs(w)]
        assert list(zip(*(x.tolist() for x in periodic.runs_of(ids)))) == want


@pytest.mark.parametrize("words", [[b"a"] * 30000, [b"%d" % (i % 7) for i in range(30000)], ([b"a"] * 40 + [b"b"]) * 500])
def test_long_runs_take_little_time(words):
    ids, _ = periodic.numbered([words])
    start, length, period = periodic.runs_of(ids)
    assert (0, len(words)) in set(zip(start.tolist(), length.tolist()))


def test_runs_of_the_folder(spark, tmp_path):
    df = table(spark, "documents")
    assert query_runs(spark, df, tmp_path) == sorted((plain_digest(r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_runs_of_odd_rows(spark, odd, clashing, empty, tmp_path):
    short = [r for r in odd.collect() if r["n_chars"] != 1]
    want = sorted((plain_digest(r["doc_id"], r["text"]) for r in short), key=str)
    for i, df in enumerate((odd, clashing)):
        assert query_runs(spark, df.where("n_chars is null or n_chars <> 1"), tmp_path / str(i)) == want
    assert query_runs(spark, empty, tmp_path / "none") == []
    assert periodic.runs(odd).count() == odd.count()


def test_planting_keeps_the_number_of_words():
    for doc_id in range(300):
        for n in (0, 1, 2, 3, 50):
            assert len(planted(doc_id, [b"%d" % i for i in range(n)])) == n


def test_general_output(spark):
    df = spark.createDataFrame([("x", 9, "a b c " * 5 + "d")], "body string, key bigint, text string").drop("text").withColumnRenamed("body", "words")
    df = spark.createDataFrame([(9, "z " + "a b c " * 5 + "d")], "key bigint, body string")
    row = periodic.runs(df, "key", "body").first()
    assert [tuple(r) for r in row["runs"]] == [(1, 15, 3)] and row["collapsed"] == "z a b c d" and row["n_words"] == 17


# 12. secrets


def plain_base(text):
    text, found = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def plain_secrets(doc_id, text):
    found = plain_base(text)
    kinds = Counter(k for _, k, _ in found)
    return doc_id, kinds[0], kinds[1], kinds[2], sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found))


def test_secrets_of_the_folder(spark):
    rows = table(spark, "documents").select("doc_id", "text").collect()
    found = QUERIES["op12_secret_scans"](spark, FOLDER)
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = found.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted((plain_secrets(r["doc_id"], r["text"]) for r in rows), key=str)
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    for r in got:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = [(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in spans if k != "novel"]
        assert base == plain_base(texts[r["doc_id"]])


def test_secrets_of_odd_rows(spark, odd, clashing, empty):
    pieces = ["password", "PASSWORD", "toKen", "api_key", "ApiKey", "secret", "=", ":", " ", '"', "'", "abc", "Abcdef12", "é", "AKIA", "Z9" * 9, "0f" * 13, "\n", "ſecret", "toKen"]
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    for df in (odd, clashing, made):
        want = sorted((plain_secrets(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
        got = []
        for r in secrets.find(df, b"").collect():
            base = [s for s in r["spans"] if s["kind"] != "novel"]
            kinds = Counter(s["kind"] for s in base)
            got.append((r["doc_id"], kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base))))
        assert sorted(got, key=str) == want
    assert secrets.find(empty).collect() == []


def test_novel_strings_near_sensitive_words(spark):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = "the application settings load every configuration value from the environment before the production server starts again "
    rows, want = [], {}
    for i in range(60):
        key = "".join(rng.choice(alphabet) for _ in range(rng.choice([20, 28, 40])))
        lead = ["Authorization é Bearer ", "aws_secret_access_key ", "the login for the server is "][i % 3]
        rows.append((i, prose + lead + key + " and " + prose))
        want[i] = [("novel", len(prose + lead), len(prose + lead + key))]
    plain = ["the token application_settings_configuration is loaded", "see the secret production/server/environment/value", f"an id {rows[0][1].split()[20]}", "login 0000000000000000000000 again"]
    rows += [(100 + i, prose + t + " " + prose) for i, t in enumerate(plain)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.find(df).collect()}
    assert {i: found[i] for i in want} == want
    assert all(not found[100 + i] for i in range(len(plain)))


def test_identifier_parts_are_bounded_and_ordered(spark, odd, empty):
    df = spark.createDataFrame([(1, "camelCaseName snake_name_part NAME name name 9f8a7b")], "doc_id bigint, text string")
    assert secrets.identifier_parts(df).split()[-1] == b"name"
    assert secrets.identifier_parts(df, room=9) == b"name" and secrets.identifier_parts(df, room=3) == b""
    assert secrets.identifier_parts(empty) == b""
    assert len(secrets.identifier_parts(odd, room=100)) <= 100


# 13. collocations


def plain_collocations(rows, threshold=100, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    often = {k: v for k, v in f.items() if v >= threshold and len(k) > 2}
    dropped = set()
    for lang, *w in often:
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inner = (lang, *w[i : i + m])
                if 100 * often[(lang, *w)] >= 100 * often[inner]:
                    dropped.add(inner)
    ranked = {}
    for (lang, *w), a in often.items():
        if (lang, *w) in dropped:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        ranked.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in ranked.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def shown(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def langs(df):
    return [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]


@pytest.mark.parametrize("threshold, bits", [(100, 27), (4, 27), (20, 8)])
def test_collocations_of_the_folder(spark, threshold, bits):
    df = table(spark, "documents")
    found = shown(collocations.collocations(df, threshold=threshold, bits=bits))
    assert found and found == plain_collocations(langs(df), threshold)


def test_collocations_of_odd_rows(spark, odd, clashing, empty):
    for df in (odd, clashing):
        for longest, top in ((5, 2000), (3, 2)):
            assert shown(collocations.collocations(df, threshold=5, longest=longest, top=top)) == plain_collocations(langs(odd), 5, longest, top)
    assert collocations.collocations(empty).collect() == []


def test_small_capacities_lose_no_frequent_key():
    rng = np.random.default_rng(3)
    for trial in range(20):
        keys = np.minimum(rng.zipf(1.3, 40000), 5000).astype(np.uint64)
        threshold = int(rng.integers(20, 400))
        summary = collocations.Summary(len(keys), threshold)
        for part in np.array_split(keys, int(rng.integers(2, 50))):
            summary.add(*(x.astype(t) for x, t in zip(np.unique(part, return_counts=True), (np.uint64, np.int64))))
            summary.merge()
        assert len(summary.keys) <= summary.capacity and summary.error < threshold
        kept = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        for key, n in zip(*np.unique(keys, return_counts=True)):
            if n >= threshold:
                assert kept[int(key)] <= n <= kept[int(key)] + summary.error


def test_scores_beyond_64_bits(spark):
    rng = random.Random(6)
    rows = [tuple(rng.randrange(1, 1 << rng.randint(2, 42)) for _ in range(4)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint")
    from pyspark.sql import functions as F

    for row in df.withColumn("score", collocations.score(*(F.col(c) for c in "anlr"))).collect():
        want = 1000 * row["a"] * row["n"] // (row["l"] * row["r"])
        assert want >= 1 << 63 or row["score"] == want
