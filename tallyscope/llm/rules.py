"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule looks at a few measures of the text and votes good (1), bad (0) or abstains (null). How far a rule can be
trusted is not given. Documents are taken to be of two classes, good and bad, and the votes of a document to be
independent given its class, abstentions saying nothing; expectation-maximisation over the votes estimates the share of
good documents and, for each rule and class, how often a vote is good. The posterior probability of a good document
replaces an all-must-pass filter; only the two base limits stay absolute, and documents that they reject teach nothing.

The estimation needs the number of documents per pattern of votes and nothing else. There are at most 3 to the number
of rules patterns, so they fit the driver at any size of the corpus, and every document counts.

Null and empty texts have no words and fail the base limits. Repeated rows are judged each. An empty table gives no
rows. A measure never depends on other rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.session import cut

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 0.5
# Symbols in a row count once: they are spread over the text if there are many such groups.
SYMBOL_GROUP = r"[#*$%&|<>]+"
# Rounds stop when one adds less than this share of a document to the log-likelihood.
ROUNDS, STILL = 1000, 1e-12
# Beliefs before any vote is counted, with the weight of this share of all documents: the share of good documents, and
# how often a vote on a good and on a bad document is good. They keep estimates off 0 and 1.
PRIOR_SHARE, PRIOR_GOOD, PRIOR_RIGHT, PRIOR_WRONG = 0.002, 0.5, 0.95, 0.5


def uses(text: Column, letters: str) -> Column:
    """How often ``letters`` (ASCII) stand in ``text``. One search per letter beats a translation of every character."""
    total = F.lit(0)
    for letter in letters:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))
    return total


def measure(documents: DataFrame, text: str, name: str) -> DataFrame:
    """``documents`` with one struct column ``name`` of the measures of ``text``."""
    t, w, l, h, s, d = (f"{name}_{k}" for k in "twlhsd")
    c = F.col
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    sorted_pairs = F.sort_array(F.transform(c(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # Places of windows that stand more than once: equal to a neighbour in hash order.
    places = F.sort_array(F.transform(
        F.filter(c(s), lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])),
        lambda x: x["i"]))
    covered = F.aggregate(
        F.transform(c(d), lambda x, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1), x + 3) - x)), F.lit(0), lambda a, b: a + b)
    nothing = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    return (
        documents.withColumn(t, F.coalesce(c(text).cast("string"), F.lit("")))
        .withColumn(w, F.array_remove(F.split(c(t), BLANK), ""))
        .withColumn(l, F.filter(F.split(c(t), "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != ""))
        .withColumn(h, F.when(F.size(w) >= 3, window).otherwise(F.expr("cast(array() as array<bigint>)")))
        .withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), sorted_pairs).otherwise(nothing))
        .withColumn(d, places)
        .withColumn(name, F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            (F.char_length(t) - uses(c(t), BLANKS)).cast("bigint").alias("word_chars"),
            uses(c(t), SYMBOLS).cast("bigint").alias("n_symbols"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("n_dup_lines"),
            covered.cast("bigint").alias("n_repeat_words"),
            F.size(l).cast("bigint").alias("n_lines"),
            uses(c(t), "AEO").cast("bigint").alias("n_large_vowels"),
            uses(c(t), "aeo").cast("bigint").alias("n_small_vowels"),
            uses(c(t), "!?").cast("bigint").alias("n_marks"),
            F.regexp_count(c(t), F.lit(SYMBOL_GROUP)).cast("bigint").alias("n_symbol_groups"),
        ))
        .drop(t, w, l, h, s, d)
    )


def votes(m: Column) -> dict[str, Column]:
    """The rules over a struct of measures. Each has a sign of a fault, a sign of its absence, and abstains between."""

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    words, chars, vowels = m["n_words"], m["word_chars"], m["n_large_vowels"] + m["n_small_vowels"]
    return {
        "repeats": rule(4 * m["n_repeat_words"] > words, 20 * m["n_repeat_words"] <= words),
        "symbols": rule(5 * m["n_symbols"] > words, 50 * m["n_symbols"] <= words),
        "symbol_groups": rule(10 * m["n_symbol_groups"] > words, 100 * m["n_symbol_groups"] <= words),
        "word_length": rule((chars < 3 * words) | (chars > 7 * words), (chars >= 4 * words) & (chars <= 6 * words)),
        # Texts without any of the letters are of another script.
        "letters": rule((vowels > 0) & (100 * vowels < 22 * chars), (vowels > 0) & (100 * vowels >= 25 * chars)),
        "lines": rule(4 * m["n_dup_lines"] > m["n_lines"], 10 * m["n_dup_lines"] <= m["n_lines"]),
        "capitals": rule(m["n_large_vowels"] > m["n_small_vowels"], 5 * m["n_large_vowels"] <= m["n_small_vowels"]),
        "marks": rule(2 * m["n_marks"] > words, 20 * m["n_marks"] <= words),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


class Model(NamedTuple):
    """Share of good documents, and for each rule how often a vote on a good and on a bad document is good."""

    good: float
    right: list[float]
    wrong: list[float]

    def log_odds(self, rule: int, vote: int) -> float:
        a, b = self.right[rule], self.wrong[rule]
        return math.log(a / b) if vote else math.log((1 - a) / (1 - b))

    def prior(self) -> float:
        return math.log(self.good / (1 - self.good))


def estimate(patterns: Sequence[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> tuple[Model, list[float]] | None:
    """The model that expectation-maximisation finds, and the log-likelihood (with that of the prior) round by round.

    It starts from the votes: a document with a bad vote is held to be bad. The prior grows with the number of documents,
    so the result does not depend on the size of the corpus."""
    total = sum(n for _, n in patterns)
    if not total:
        return None
    rules = range(len(patterns[0][0]))
    posterior = [0.05 if 0 in pattern else 0.95 if 1 in pattern else PRIOR_GOOD for pattern, _ in patterns]
    weight, history = PRIOR_SHARE * total, []
    while True:
        def share(of: list[float], r: int, before: float) -> float:
            good = sum(p * n for p, (pattern, n) in zip(of, patterns) if pattern[r] == 1)
            all_ = sum(p * n for p, (pattern, n) in zip(of, patterns) if pattern[r] is not None)
            return (good + weight * before) / (all_ + weight)

        rest = [1 - p for p in posterior]
        good = (sum(p * n for p, (_, n) in zip(posterior, patterns)) + weight * PRIOR_GOOD) / (total + weight)
        model = Model(good, [share(posterior, r, PRIOR_RIGHT) for r in rules], [share(rest, r, PRIOR_WRONG) for r in rules])
        posterior, likelihood = [], 0.0
        for pattern, n in patterns:
            ways = [math.log(c) + sum(math.log(of[r] if v else 1 - of[r]) for r, v in enumerate(pattern) if v is not None)
                    for c, of in ((model.good, model.right), (1 - model.good, model.wrong))]
            most = max(ways)
            both = most + math.log(sum(math.exp(w - most) for w in ways))
            posterior.append(math.exp(ways[0] - both))
            likelihood += n * both
        for share_, before in ((model.good, PRIOR_GOOD), *((a, PRIOR_RIGHT) for a in model.right), *((b, PRIOR_WRONG) for b in model.wrong)):
            likelihood += weight * (before * math.log(share_) + (1 - before) * math.log(1 - share_))
        history.append(likelihood)
        if len(history) >= rounds or len(history) > 1 and history[-1] - history[-2] <= STILL * total:
            return model, history


def judge(documents: DataFrame, text: str = "text", name: str = "quality_rules", drop_text: bool = False) -> DataFrame:
    """``documents`` with a struct column ``name``: the measures, the posterior, ``base_failed`` and ``kept``.

    ``name`` must not be a column of the table. The measured rows are written once to the checkpoint folder, because
    they are read twice: for the patterns and for the verdicts; ``drop_text`` leaves the text out of them."""
    measured = measure(documents, text, name)
    measured = cut(measured.drop(text) if drop_text else measured)
    rules = votes(F.col(name))
    failed = base_failed(F.col(name))
    counted = measured.where(~failed).select(*(v.alias(k) for k, v in rules.items())).groupBy(*rules).count().collect()
    found = estimate(sorted(((tuple(r[k] for k in rules), r["count"]) for r in counted), key=str))
    logit = F.lit(found[0].prior() if found else 0.0)
    if found:
        for i, v in enumerate(rules.values()):
            logit = logit + F.when(v == 1, found[0].log_odds(i, 1)).when(v == 0, found[0].log_odds(i, 0)).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))
    return measured.withColumn(name, F.struct(
        f"{name}.*", posterior.alias("posterior"), failed.alias("base_failed"), (~failed & (posterior >= 0.5)).alias("kept")))
