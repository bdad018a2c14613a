"""Index pages of plate books, read whole: every token of an entry ends in a field or in ``unparsed``.

An entry is its head line and the lines below it. Its tokens are folded from left to right by one ``aggregate``: a token
opens a place, adds to the last one, is a sample or a remark, or stays unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.names import binomial
from tallyscope.operators.sequence import Blocks, ranges

# The line and token patterns of the three formats, and the words that stop at the genus.
HEADS = {"numbered": r"^\*\*(\d+)\.\s*\*(.+?)\*\*\*\s*$", "one_line": r"^- \*\*\*(.+?)\*\*\*(\s*\*\(속명 추정\)\*)?\s*—\s*(.+?)\s*$", "starred": r"^\*\*\*(.+?)\*\*\*\s*(.*?)\s*$"}
SECTIONS = {"numbered": r"^### (.+?)\s*$", "one_line": r"^## (.+?)\s*$", "starred": r"^## (.+?)\s*$"}
PLACE_LINE = r"^<sub>(.*?)</sub>\s*$"
REMARK = r"^- (생태|분포|비고|원문 표기):\s*(.*)$"
PLATE, BOOK_PAGE, PDF_PAGE = r"^pl\.\s*(\d+)$", r"^책 p\.\s*(\d+)$", r"^PDF p\.\s*(\d+)$"
OCCURRENCE = r"^Tafel\s+(\d+)(?:\s*fig\.(.*?))?\s*\(Band(\d+)\s*PDF\s*p\.(\d+)/(\d+)\)$"
OCCURRENCE_NOTE = r"\s*〔(Tafel 아님[^〕]*)〕\s*"
STARRED_PLACE, STARRED_PDF = r"^(?:pl\.\s*(\d+)|(SEM))(?:\s*fig\.\s*(.+))?$", r"^PDF p\.(\d+)/(\d+)$"
SAMPLE_LEAD, SAMPLE = r"^-\s*(?:pl\.(\d+)|(SEM))\s*—\s*(.+)$", r"^(\d+)\.\s*(.+)$"
SAMPLE_DEPTH, SAMPLE_MAGNIFICATION = r"sec\.([\d-]+),\s*([\d.]+)\s*cm", r"×\s*([\d,]*\d)"
GENUS_WORDS = ["sp.", "sp", "spp.", "group"]
INFRA_RANKS = r"\b(var\.|subsp\.|f\.)\s"

PLACE = "struct<plate:int,plate_label:string,figures:string,book_page:int,pdf_page:int,pdf_plate_page:int,volume:string,note:string>"
SAMPLE_TYPE = "struct<plate:int,plate_label:string,figure:int,section:string,depth_cm:double,magnification:string,raw:string>"
STATE = f"struct<placements:array<{PLACE}>,samples:array<{SAMPLE_TYPE}>,remarks:array<struct<kind:string,text:string>>,unparsed:array<string>>"
FIELDS = ["plate", "plate_label", "figures", "book_page", "pdf_page", "pdf_plate_page", "volume", "note"]


def group(text: Column, pattern: str, n: int) -> Column:
    got = F.regexp_extract(text, pattern, n)
    return F.when(got != "", got)


def figure_list(text: Column) -> Column:
    """Figure numbers as written, without stray points and commas around them."""
    bare = F.btrim(text, F.lit(" .,"))
    return F.when(bare != "", bare)


def place(**fields: Column) -> Column:
    return F.struct(*(fields.get(f, F.lit(None)).alias(f) for f in FIELDS)).cast(PLACE)


# Which group of which pattern gives a field of a place.
PLACE_GROUPS = {
    "numbered": {"plate": (PLATE, 1), "book_page": (BOOK_PAGE, 1), "pdf_page": (PDF_PAGE, 1)},
    "one_line": {"plate": (OCCURRENCE, 1), "figures": (OCCURRENCE, 2), "volume": (OCCURRENCE, 3), "pdf_page": (OCCURRENCE, 4), "pdf_plate_page": (OCCURRENCE, 5)},
    "starred": {"plate": (STARRED_PLACE, 1), "plate_label": (STARRED_PLACE, 2), "figures": (STARRED_PLACE, 3), "pdf_page": (STARRED_PDF, 1), "pdf_plate_page": (STARRED_PDF, 2)},
}


def read_tokens(tokens: Column, fmt: str) -> Column:
    """Tokens with what they say: ``place`` (the fields a token of a place line gives), whether it ``opens`` a place, whether
    it was ``known``, and ``sample`` (null: none).

    Lambdas share no common subexpressions. So every pattern is tried once per token, and what is needed more than once is
    a field of the step before.
    """
    base = ("kind", "lead", "text")

    def step(of: Column, keep: tuple[str, ...], make) -> Column:
        return F.transform(of, lambda t: F.struct(*(t[c].alias(c) for c in keep), *(c.alias(n) for n, c in make(t).items())))

    def bare(t: Column) -> dict[str, Column]:
        if fmt != "one_line":
            return {"note": F.lit(""), "bare": t["text"]}
        return {"note": F.regexp_extract(t["text"], OCCURRENCE_NOTE, 1), "bare": F.trim(F.regexp_replace(t["text"], OCCURRENCE_NOTE, ""))}

    def found(t: Column) -> dict[str, Column]:
        got = {f: F.when(t["kind"] == "place", F.regexp_extract(t["bare"], *g)) for f, g in PLACE_GROUPS[fmt].items()}
        return got | {"_" + n: F.when(t["kind"] == "sample", F.regexp_extract(t["text"], SAMPLE, i)) for i, n in ((1, "figure"), (2, "raw"))}

    def detail(t: Column) -> dict[str, Column]:
        is_sample = t["_figure"] != ""
        return {"_section": F.when(is_sample, F.regexp_extract(t["_raw"], SAMPLE_DEPTH, 1)), "_depth": F.when(is_sample, F.regexp_extract(t["_raw"], SAMPLE_DEPTH, 2)),
                "_magnification": F.when(is_sample, F.regexp_extract(t["_raw"], SAMPLE_MAGNIFICATION, 1))}

    def said(t: Column) -> dict[str, Column]:
        given = lambda f: F.when(t[f] != "", t[f])
        shape = {"figures": lambda f: figure_list(t[f]), "volume": lambda f: F.concat(F.lit("Band"), given(f)), "plate_label": given}
        fields = {f: shape.get(f, lambda f: given(f).cast("int"))(f) for f in PLACE_GROUPS[fmt]}
        understood = F.greatest(*(F.coalesce(t[f] != "", F.lit(False)) for f in PLACE_GROUPS[fmt]))
        opens = F.lit(False) if fmt == "numbered" else understood if fmt == "one_line" else F.coalesce((t["plate"] != "") | (t["plate_label"] != ""), F.lit(False))
        number = t["lead"].try_cast("int")
        sample = F.struct(
            number.alias("plate"), F.when(number.isNull(), t["lead"]).alias("plate_label"), given("_figure").cast("int").alias("figure"), given("_section").alias("section"), given("_depth").cast("double").alias("depth_cm"),
            given("_magnification").alias("magnification"), F.trim(t["_raw"]).alias("raw")).cast(SAMPLE_TYPE)
        return {"place": place(**fields, note=given("note")), "opens": opens, "known": understood, "sample": F.when(t["_figure"] != "", sample)}

    groups = (*PLACE_GROUPS[fmt], "_figure", "_raw")
    at_hand = step(step(tokens, base, bare), (*base, "note", "bare"), found)
    return step(step(at_hand, (*base, "note", *groups), detail), base, said)


def tokens_of(line: Column, fmt: str) -> Column:
    """The tokens of a line of an entry as (kind, lead, text)."""
    kind = "array<struct<kind:string,lead:string,text:string>>"

    def every(what: str, text: Column, mark: str, lead: Column = F.lit(None)) -> Column:
        parts = F.filter(F.transform(F.split(text, mark), lambda t: F.trim(t)), lambda t: t != "")
        return F.transform(parts, lambda t: F.struct(F.lit(what).alias("kind"), lead.cast("string").alias("lead"), t.alias("text")))

    one = lambda what, text, lead=F.lit(None): F.array(F.struct(F.lit(what).alias("kind"), lead.cast("string").alias("lead"), text.alias("text")))
    rest = F.when(F.trim(line) == "", F.array().cast(kind)).otherwise(one("rest", F.trim(line)))
    if fmt == "one_line":
        return F.when(line.rlike(HEADS[fmt]), every("place", F.regexp_extract(line, HEADS[fmt], 3), ";")).otherwise(rest).cast(kind)
    remark = F.when(line.rlike(REMARK), one("remark", F.trim(F.regexp_extract(line, REMARK, 2)), F.regexp_extract(line, REMARK, 1)))
    opened = every("place", F.regexp_extract(line, PLACE_LINE, 1), "·")
    if fmt == "numbered":
        opened = F.concat(one("open", F.lit("")), opened)
    out = F.when(line.rlike(HEADS[fmt]), F.array().cast(kind)).when(line.rlike(PLACE_LINE), opened.cast(kind)).when(line.rlike(REMARK), remark.cast(kind))
    if fmt == "starred":
        # Samples have a plate in front or begin with their figure; other list lines are remarks written by hand.
        led = line.rlike(SAMPLE_LEAD)
        lead = F.coalesce(F.when(F.regexp_extract(line, SAMPLE_LEAD, 1) != "", F.regexp_extract(line, SAMPLE_LEAD, 1)), F.regexp_extract(line, SAMPLE_LEAD, 2))
        out = out.when(led, every("sample", F.regexp_extract(line, SAMPLE_LEAD, 3), "·", lead).cast(kind))
        body = F.trim(F.substring(line, F.lit(3), F.length(line)))
        out = out.when(line.startswith("- ") & body.rlike(SAMPLE), every("sample", body, "·").cast(kind)).when(line.startswith("- "), one("remark", body, F.lit("hand")).cast(kind))
    return out.otherwise(rest.cast(kind))


def fold(tokens: Column, fmt: str) -> Column:
    start = F.struct(*(F.array().alias(f) for f in ("placements", "samples", "remarks", "unparsed"))).cast(STATE)

    def step(s: Column, t: Column) -> Column:
        fields, opens, known = t["place"], t["opens"], t["known"]
        places, n = s["placements"], F.size(s["placements"])
        is_place = t["kind"] == "place"
        last = F.get(places, n - 1)
        joined = F.struct(*(F.coalesce(fields[f], last[f]).alias(f) for f in FIELDS)).cast(PLACE)
        placements = (
            F.when(t["kind"] == "open", F.concat(places, F.array(place()))).when(is_place & known & opens, F.concat(places, F.array(fields)))
            .when(is_place & known & (n > 0), F.concat(F.slice(places, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(joined))).otherwise(places)
        )
        is_sample = t["sample"].isNotNull()
        unread = (is_place & ~(known & (opens | (n > 0)))) | ((t["kind"] == "sample") & ~is_sample) | (t["kind"] == "rest")
        return F.struct(
            placements.alias("placements"), F.when(is_sample, F.concat(s["samples"], F.array(t["sample"]))).otherwise(s["samples"]).alias("samples"),
            F.when(t["kind"] == "remark", F.concat(s["remarks"], F.array(F.struct(t["lead"].alias("kind"), t["text"].alias("text"))))).otherwise(s["remarks"]).alias("remarks"),
            F.when(unread, F.concat(s["unparsed"], F.array(t["text"]))).otherwise(s["unparsed"]).alias("unparsed")).cast(STATE)

    return F.aggregate(read_tokens(tokens, fmt), start, step)


def parse_index(lines: DataFrame, fmt: str) -> DataFrame:
    """Lines (doc, line_no, line) of an index to entries: doc, line_no, item_no, section, name, genus, binomial, rank,
    authority, genus_guess, placements, samples, remarks and unparsed. Lines before the first head belong to none."""
    head = F.when(F.col("line").rlike(HEADS[fmt]), F.struct(F.col("line_no").alias("at"), F.col("line").alias("line")))
    blocks = Blocks(["doc"], [ranges("line_no", 4096)], ["line_no"])
    x = blocks.carry_all(lines, {"_section": group(F.col("line"), SECTIONS[fmt], 1), "_head": head}).filter("_head is not null").filter(~F.col("line").rlike(SECTIONS[fmt]))
    entry = x.groupBy("doc", F.col("_head.at").alias("line_no"), F.col("_head.line").alias("line")).agg(
        F.min_by("_section", "line_no").alias("section"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    tokens = F.flatten(F.transform("_l", lambda x: tokens_of(x["line"], fmt)))
    written = F.regexp_extract("line", HEADS[fmt], 2 if fmt == "numbered" else 1)
    tail = F.regexp_extract("line", HEADS[fmt], 2) if fmt == "starred" else F.lit("")
    level = tail.startswith("sp.") | tail.startswith("group") | tail.startswith("(?)")
    name = F.trim(F.regexp_replace(F.concat(written, F.when(level, F.concat(F.lit(" "), tail)).otherwise("")), r"\*", ""))
    e = entry.select("doc", "line_no", "section", name.alias("name"), fold(tokens, fmt).alias("s"),
                     (F.regexp_extract("line", HEADS[fmt], 1) if fmt == "numbered" else F.lit(None).cast("string")).alias("item_no"),
                     F.when((tail != "") & ~level, tail).alias("authority"), (F.regexp_extract("line", HEADS[fmt], 2) != "" if fmt == "one_line" else F.lit(False)).alias("genus_guess"))
    words = F.split("name", r"\s+")
    only = F.arrays_overlap(F.slice(words, 2, 99), F.array(*map(F.lit, GENUS_WORDS)))
    two = F.when(~only & F.coalesce(binomial(F.col("name")) != "", F.lit(False)), binomial(F.col("name")))
    rank = F.when(only, "genus_only").when(two.isNull(), "unreadable").when(F.col("name").rlike(INFRA_RANKS), "infraspecies").otherwise("species")
    return e.select("doc", "line_no", "item_no", "section", "name", F.get(words, F.lit(0)).alias("genus"), two.alias("binomial"), rank.alias("rank"), "authority", "genus_guess", "s.*")
