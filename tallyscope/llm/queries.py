"""The registered queries of the corpus operators and the reference SQL of those that have one."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import collocations, contamination, embedding, packing, pages, paragraphs, periodic, rules, secrets, simhash, suffixes, tokens, toxicity
from tallyscope.llm.common import pick, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.near_duplicates(table(spark, sf_dir, "documents"))


def predicted() -> Column:
    return (F.col("score") >= 0.3).cast("int").alias("predicted")


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = embedding.fit(documents, table(spark, sf_dir, "labels"))
    return embedding.score(documents, model, uuid.uuid4().hex).select(
        "doc_id", F.coalesce(embedding.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", predicted())


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), drop_text=True)
    return judged.select("doc_id", *(f"quality_rules.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")))


@query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.measure(table(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokens.attribute(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, fields=("source", "lang", "text"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, key = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), key)
    return toxicity.score(documents, model, key).select(
        "doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", predicted(), "segments")


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Texts of one id in ten repeat a stretch of theirs up to the end; a text without an id stays as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + p] * (1 + (n - a) // p))[:n]


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(table(spark, sf_dir, "documents"), rewrite=planted)
    # The longest one; of several the first, then the least period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("*", best.alias("best"), text.alias("lines")).selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "-best.start as start", "best.length as length", "-best.period as period",
        "1000 * best.length div -best.period as exponent_milli", "sha2(lines, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256")


@query
def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind != "novel")
    return found.select("doc_id", *(number(k) for k in ("assign", "access", "hex")), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op10_benchmark_decontamination"] = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
wins AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0) q),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs JOIN sizes ON len(w) >= n) q),
hits AS (SELECT s.doc_id, s.i, s.n, x.item_id FROM spots s JOIN wins x ON x.win = s.win AND x.n = s.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) q GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) q GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id"""

ORACLES["op7_suffix_array_dedup"] = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
starts AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM docs WHERE n >= 400) q),
hit AS (SELECT doc_id, i FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit) q),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans),
heads AS (SELECT g.doc_id, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN docs d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN x ELSE concat(head, substr(x, 2 * last + 1)) END)) AS kept_sha256
FROM docs d LEFT JOIN heads h ON h.doc_id = d.doc_id"""

# Pairs of equal strings of six words in one text, no farther apart than their stretch is long, are the runs.
ORACLES["op11_periodic_runs"] = r"""
WITH table_of AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i) q),
docs AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, c: xor(x >> 8, t[1 + (xor(x, c) & 255)])), 4294967295) AS h FROM documents, table_of),
sized AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM docs),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
turned AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
texts AS (SELECT doc_id, k, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM turned),
grams AS (SELECT k, i, hash(array_to_string(w[i + 1:i + 6], ' ')) AS x FROM (SELECT k, w, unnest(range(n - 5)) AS i FROM texts WHERE n >= 12) q),
pairs AS (SELECT a.k, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON b.k = a.k AND b.x = a.x AND b.i > a.i),
islands AS (SELECT k, q, min(i) AS start, count(*) + 5 AS l FROM (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS s FROM pairs) z GROUP BY k, q, s),
runs AS (SELECT k, start, l + q AS length, min(q) AS period FROM islands WHERE l >= q AND l + q >= 12 GROUP BY k, start, l + q),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT t.k, string_agg(t.v, ' ' ORDER BY t.i) AS txt FROM (SELECT k, unnest(w) AS v, unnest(range(n)) AS i FROM texts) t
  LEFT JOIN gone g ON g.k = t.k AND g.i = t.i WHERE g.i IS NULL GROUP BY t.k),
told AS (SELECT k, count(*) AS n_runs, max(struct_pack(length := length, start := -start, period := -period)) AS best,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.start AS start, best.length AS length, -best.period AS period, 1000 * best.length // -best.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM texts t LEFT JOIN told ON told.k = t.k LEFT JOIN kept ON kept.k = t.k"""

ORACLES["op13_phrase_collocations"] = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS p FROM docs) q),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m) z WHERE len(w) >= m) q),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cuts AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) q),
valued AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n, CAST(1000 * CAST(c.a AS HUGEINT) * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[i:i + j - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM f) q) z),
around AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a)
SELECT * FROM ranked WHERE rank <= 2000"""
