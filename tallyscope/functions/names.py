"""Name texts as column expressions. Accent folding is the one that needs Python (Unicode normalisation), in Arrow batches."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions of this module travel to the workers whole, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Misspelt genera and their correct form, the pattern of an epithet, German letters, the class of interest.
GENUS_FIX = {
    "Raphoneis": "Rhaphoneis",
    "Gophonema": "Gomphonema",
    "Navicla": "Navicula",
    "Rhicophenia": "Rhoicosphenia",
    "Sceletonema": "Skeletonema",
    "Cyrosigma": "Gyrosigma",
    "Chaetoceras": "Chaetoceros",
}
EPITHET = r"^[a-zöäüéë\-]+$"
GERMAN_LETTERS = {"ö": "oe", "ä": "ae", "ü": "ue", "Ö": "oe", "Ä": "ae", "Ü": "ue", "ß": "ss"}
# Fixed value: a piece of a misread author name that stands where an epithet should.
AUTHOR_FRAGMENT = r"^(s[ce][ch]?[mn][ai]?[iu]?d?t?s?|schmidts)$"

# A capitalised word followed by a lower-case one, as it stands in running text.
BINOMIAL = r"[A-Z][a-z]+ [a-z]{2,}"


def binomial(headword: Column) -> Column:
    """``Genus epithet`` out of a headword with authors and marks; null when there is none."""
    words = F.split(F.trim(F.regexp_replace(headword, r"\*", "")), r"\s+")
    genus = F.initcap(F.get(words, F.lit(0)))
    fixes = F.create_map(*[F.lit(x) for pair in GENUS_FIX.items() for x in pair])
    ep = F.lower(F.get(words, F.lit(1)))
    return F.when((F.size(words) >= 2) & ep.rlike(EPITHET), F.concat_ws(" ", F.coalesce(F.try_element_at(fixes, genus), genus), ep))


def genus(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def epithet(name: Column) -> Column:
    return F.lower(F.split_part(name, F.lit(" "), F.lit(2)))


@F.pandas_udf(T.StringType())
def _plain(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD").str.replace("[̀-ͯ]", "", regex=True)


def fold_name(name: Column) -> Column:
    """Without accents, in lower case, with single spaces. Only texts beyond ASCII go through Python."""
    plain = F.when(name.rlike(r"[^\x00-\x7F]"), _plain(name)).otherwise(name)
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def fold_name_de(name: Column) -> Column:
    """The same after writing German letters out."""
    out = name
    for k, v in GERMAN_LETTERS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return fold_name(out)


def why_no_match(close: Column, genus_known: Column, genus_class_ok: Column, genus_close: Column, n_elsewhere: Column, extinct: Column) -> Column:
    """Why a register lacks a name, by the first piece of evidence that speaks."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(close), "spelling")
        .when(~yes(genus_known), "genus missing")
        .when(~yes(genus_class_ok), "genus of another class")
        .when(yes(genus_close), "genus spelling")
        .when(F.coalesce(n_elsewhere, F.lit(0)) == 1, "genus doubtful")
        .when(yes(extinct), "fossil genus")
        .otherwise("species missing")
    )


def judge_absent(name: Column, epithet_is_genus: Column, longer: Column) -> Column:
    """A name that is absent everywhere. Shortness proves nothing; a longer name it is the front part of does."""
    return (
        F.when(name.contains(" var. "), "look: variety")
        .when(F.coalesce(epithet_is_genus, F.lit(False)), "junk: genus as epithet")
        .when(longer.isNotNull(), F.concat(F.lit("junk: front part of "), longer))
        .otherwise("look: not registered")
    )


def judge_removed(name: Column, reason: Column, status: Column) -> Column:
    """A name taken out of an index earlier."""
    ep = epithet(name)
    return (
        F.when(status.isNotNull(), F.concat(F.lit("restore: "), status))
        .when(ep.startswith("schmidt") & ~ep.rlike(AUTHOR_FRAGMENT), "look: proper epithet")
        .when(reason.contains("too short") & ~F.rtrim(name).endswith("sp."), "look: short but proper")
        .otherwise(F.concat(F.lit("junk: "), reason))
    )


def judge_review(match_kind: Column) -> Column:
    return (
        F.when(match_kind == "match_quarantine", "quarantine")
        .when(match_kind.isin("near_1", "phonetic"), "spelling proposal")
        .otherwise("look: loose match")
    )


def name_verdict(name: Column, source: Column, lookup: Column, verdict: Column, status: Column, accepted: Column, reason: Column) -> Column:
    """One short note: what the source prints wins, then the lookup, then the register. '' means nothing is known."""
    known = accepted != ""
    return (
        F.when(source != "", F.concat(F.lit("source: "), source, F.when(lookup != "", F.concat(F.lit("; "), lookup)).otherwise("")))
        .when(lookup != "", lookup)
        .when((verdict == "confirmed") & known & (accepted != name), F.concat(status, F.lit(" -> "), accepted))
        .when((verdict == "confirmed") & status.startswith("unaccepted"), F.concat(status, F.lit(", no accepted name given")))
        .when((verdict == "confirmed") & ~known, F.concat(status, F.lit(", accepted name is blank")))
        .when(verdict == "confirmed", status)
        .when(verdict == "spelling proposal", F.concat(F.lit("spelling? "), accepted))
        .when(verdict == "restore", F.concat(F.lit("registered, keep: "), status))
        .when(verdict == "quarantine", "quarantined record")
        .when(verdict == "junk", F.concat(F.lit("index debris: "), reason))
        .otherwise(F.concat(F.lit("look: "), reason))
    )
