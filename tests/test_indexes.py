"""Whole entries of the three index formats; every token ends in a field or in ``unparsed``."""

import pytest

from tallyscope.sources.indexes import parse_index

LINES = "doc bigint, line_no bigint, line string"


@pytest.fixture(scope="module")
def parse(spark):
    def run(fmt, *lines):
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], LINES)
        return [r.asDict(recursive=True) for r in parse_index(df, fmt).orderBy("line_no").collect()]

    return run


def told(place):
    return {k: v for k, v in place.items() if v is not None}


def test_numbered(parse):
    got = parse("numbered", "before any", "### Family", "**169. *Navicula alba***", "<sub>pl. 12 · 책 p.30 · PDF p.41 · fig?</sub>", "<sub>책 p.31</sub>", "- 생태: cold · wet", "- 분포: wide", "a stray line", "",
                "**170. *Synedra cyclopиm***", "**171. *Nitzschia sp.***")
    assert [(e["item_no"], e["name"], e["genus"], e["binomial"], e["rank"], e["section"]) for e in got] == [
        ("169", "Navicula alba", "Navicula", "Navicula alba", "species", "Family"), ("170", "Synedra cyclopиm", "Synedra", None, "unreadable", "Family"), ("171", "Nitzschia sp.", "Nitzschia", None, "genus_only", "Family")]
    assert [told(p) for p in got[0]["placements"]] == [{"plate": 12, "book_page": 30, "pdf_page": 41}, {"book_page": 31}]
    assert [(r["kind"], r["text"]) for r in got[0]["remarks"]] == [("생태", "cold · wet"), ("분포", "wide")]
    assert got[0]["unparsed"] == ["fig?", "a stray line"] and not got[1]["placements"] and not got[1]["unparsed"]


def test_one_line(parse):
    got = parse("one_line", "## A", "- ***Navicula alba var. minor*** *(속명 추정)* — Tafel 3 fig.. 24,25 (Band1 PDF p.7/8); Tafel 9 (Band2 PDF p.1/2) 〔Tafel 아님 · Verzeichnis〕; Tafel x", "- ***Amphora ovalis*** — nothing known")
    assert [told(p) for p in got[0]["placements"]] == [
        {"plate": 3, "figures": "24,25", "volume": "Band1", "pdf_page": 7, "pdf_plate_page": 8}, {"plate": 9, "volume": "Band2", "pdf_page": 1, "pdf_plate_page": 2, "note": "Tafel 아님 · Verzeichnis"}]
    assert got[0]["genus_guess"] and got[0]["rank"] == "infraspecies" and got[0]["unparsed"] == ["Tafel x"]
    assert not got[1]["genus_guess"] and got[1]["placements"] == [] and got[1]["unparsed"] == ["nothing known"]


def test_starred(parse):
    got = parse("starred", "## B", "***Cocconeis*** group", "<sub>PDF p.1/2 · pl. 3 fig. 4, 6 · PDF p.5/6 · SEM · PDF p.7/8</sub>", "- 11. sec.3, 20 cm ×1,800, bar", "- SEM — 2. plain · 3. sec.1-2, 7.5 cm · odd", "- by hand", "- 원문 표기: printed so",
                "***Eunotia lunaris*** (Ehr.) Grun.")
    first, second = got
    assert (first["name"], first["rank"], first["authority"]) == ("Cocconeis group", "genus_only", None)
    assert (second["name"], second["rank"], second["authority"]) == ("Eunotia lunaris", "species", "(Ehr.) Grun.")
    assert [told(p) for p in first["placements"]] == [{"plate": 3, "figures": "4, 6", "pdf_page": 5, "pdf_plate_page": 6}, {"plate_label": "SEM", "pdf_page": 7, "pdf_plate_page": 8}]
    assert [told(s) for s in first["samples"]] == [
        {"figure": 11, "section": "3", "depth_cm": 20.0, "magnification": "1,800", "raw": "sec.3, 20 cm ×1,800, bar"}, {"plate_label": "SEM", "figure": 2, "raw": "plain"},
        {"plate_label": "SEM", "figure": 3, "section": "1-2", "depth_cm": 7.5, "raw": "sec.1-2, 7.5 cm"}]
    assert first["unparsed"] == ["PDF p.1/2", "odd"] and [(r["kind"], r["text"]) for r in first["remarks"]] == [("hand", "by hand"), ("원문 표기", "printed so")]


def test_no_lines(spark):
    for fmt in ("numbered", "one_line", "starred"):
        assert parse_index(spark.createDataFrame([], LINES), fmt).collect() == []
