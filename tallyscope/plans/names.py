"""Queries on names, registers and texts. Names are what stands capitalised in the given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import names as fn
from tallyscope.operators import names as nm
from tallyscope.plans.base import query
from tallyscope.sources.model import Model

HITS = """hits AS (SELECT doc_id, source, binomial, count(*) AS n FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]{{2,}}')) AS binomial FROM documents) q GROUP BY 1, 2, 3)"""
ENTRIES = [
    HITS,
    "entries AS (SELECT DISTINCT source AS atlas_key, binomial, split_part(binomial, ' ', 1) AS genus FROM hits)",
    "places AS (SELECT source AS atlas_key, binomial, doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 400 END AS page FROM hits)",
]
# The register: every name of the benchmark texts, with a status and an accepted name by its length.
REGISTRY = """registry AS (SELECT name, length(name) * 1000 + n AS taxon_id, 'Species' AS rank, CASE WHEN length(name) % 3 = 0 THEN 'unaccepted' ELSE 'accepted' END AS status, CASE WHEN length(name) % 3 = 0 THEN concat(split_part(name, ' ', 1), ' verus') ELSE name END AS accepted,
 CASE WHEN length(name) % 5 = 0 THEN 'Other' ELSE 'Wanted' END AS class, length(name) % 2 = 0 AS is_marine, length(name) % 7 = 0 AS is_fresh
 FROM (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]{{2,}}')) AS name FROM benchmark) q GROUP BY 1) r)"""


def hits(m: Model) -> DataFrame:
    return nm.name_hits(m.documents, ["doc_id", "source"])


def entries(m: Model) -> DataFrame:
    return hits(m).select(F.col("source").alias("atlas_key"), "binomial", fn.genus(F.col("binomial")).alias("genus")).distinct()


def placements(m: Model) -> DataFrame:
    return hits(m).select(F.col("source").alias("atlas_key"), "binomial", "doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 400).alias("page"))


def registry(m: Model) -> DataFrame:
    names = nm.name_hits(m.benchmark, []).withColumnRenamed("binomial", "name")
    size = F.length("name")
    return names.select(
        "name", (size * 1000 + F.col("n")).alias("taxon_id"), F.lit("Species").alias("rank"), F.when(size % 3 == 0, "unaccepted").otherwise("accepted").alias("status"),
        F.when(size % 3 == 0, F.concat(fn.genus(F.col("name")), F.lit(" verus"))).otherwise(F.col("name")).alias("accepted"),
        F.when(size % 5 == 0, "Other").otherwise("Wanted").alias("class"), (size % 2 == 0).alias("is_marine"), (size % 7 == 0).alias("is_fresh"),
    )


@query("index_names", "SELECT binomial, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY 1", HITS)
def _(m: Model) -> DataFrame:
    return nm.index_names(hits(m))


HEAD = "heads AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) p) q)"


def lines_of(m: Model) -> DataFrame:
    """Every line of every text with its number."""
    return m.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(
    "binomial",
    """SELECT doc_id, line_no, CASE WHEN len(w) >= 2 AND regexp_full_match(lower(w[2]), '[a-zöäüéë\\-]+') THEN concat(CASE upper(w[1][1]) || lower(w[1][2:]) WHEN 'Chaetoceras' THEN 'Chaetoceros' ELSE upper(w[1][1]) || lower(w[1][2:]) END, ' ', lower(w[2])) END AS name
FROM (SELECT doc_id, line_no, string_split_regex(trim(replace(line, '*', ''), ' ' || chr(9) || chr(13)), '\\s+') AS w FROM heads) q""",
    HEAD,
)
def _(m: Model) -> DataFrame:
    return lines_of(m).select("doc_id", "line_no", fn.binomial(F.col("line")).alias("name"))


@query("epithet", "SELECT DISTINCT binomial, lower(split_part(binomial, ' ', 2)) AS epithet FROM hits", HITS)
def _(m: Model) -> DataFrame:
    return hits(m).select("binomial").distinct().select("binomial", fn.epithet(F.col("binomial")).alias("epithet"))


FOLD = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"
DE = "replace(replace(replace(replace(replace(replace(replace({0}, 'ö', 'oe'), 'ä', 'ae'), 'ü', 'ue'), 'Ö', 'oe'), 'Ä', 'ae'), 'Ü', 'ue'), 'ß', 'ss')"


@query("fold_name", f"SELECT doc_id, line_no, {FOLD.format('line')} AS folded, {FOLD.format(DE.format('line'))} AS folded_de FROM heads", HEAD)
def _(m: Model) -> DataFrame:
    return lines_of(m).select("doc_id", "line_no", fn.fold_name(F.col("line")).alias("folded"), fn.fold_name_de(F.col("line")).alias("folded_de"))


@query(
    "registry_match",
    """SELECT n.binomial AS name, r.taxon_id, r.rank, r.status, r.accepted FROM (SELECT DISTINCT binomial FROM hits) n
LEFT JOIN (SELECT lower(name) AS k, min(taxon_id) AS tid FROM registry GROUP BY 1) f ON f.k = lower(n.binomial) LEFT JOIN registry r ON lower(r.name) = f.k AND r.taxon_id = f.tid""",
    HITS,
    REGISTRY,
)
def _(m: Model) -> DataFrame:
    return nm.registry_match(hits(m).select(F.col("binomial").alias("name")).distinct(), registry(m))


@query(
    "truncated_names",
    """SELECT a.binomial AS name, count(*) AS n_longer, min(b.binomial) AS first_longer FROM (SELECT DISTINCT binomial FROM hits) a JOIN (SELECT DISTINCT binomial FROM hits) b ON split_part(b.binomial, ' ', 1) = split_part(a.binomial, ' ', 1)
 AND starts_with(split_part(b.binomial, ' ', 2), split_part(a.binomial, ' ', 2)) AND a.binomial <> b.binomial GROUP BY 1""",
    HITS,
)
def _(m: Model) -> DataFrame:
    names = hits(m).select(F.col("binomial").alias("name")).distinct()
    return nm.truncated_names(names, names)


CANDIDATES = [
    HITS,
    REGISTRY,
    "plate AS (SELECT DISTINCT doc_id AS plate, binomial AS name, split_part(binomial, ' ', 1) AS genus, split_part(binomial, ' ', 2) AS ep FROM hits)",
    "cand AS (SELECT p.*, r.genus AS candidate FROM plate p JOIN (SELECT DISTINCT split_part(name, ' ', 1) AS genus, split_part(name, ' ', 2) AS ep FROM registry) r ON r.ep = p.ep AND r.genus <> p.genus WHERE (p.plate, r.genus) IN (SELECT (plate, genus) FROM plate))",
    "clus AS (SELECT plate, genus, candidate, count(*) AS cluster FROM cand GROUP BY 1, 2, 3)",
]


@query(
    "genus_candidates",
    """SELECT plate, name, concat(candidate, ' ', ep) AS proposal, cluster, rivals, CASE greatest(1, base - CASE WHEN cluster = top AND at_top = 1 THEN 0 ELSE 1 END) WHEN 3 THEN 'strong' WHEN 2 THEN 'medium' ELSE 'weak' END AS strength FROM (
SELECT c.*, k.cluster, t.top, t.rivals, (SELECT count(*) FROM clus x WHERE x.plate = c.plate AND x.genus = c.genus AND x.cluster = t.top) AS at_top,
 CASE WHEN c.name NOT IN (SELECT name FROM registry) AND k.cluster >= 2 THEN 3 WHEN c.name NOT IN (SELECT name FROM registry) OR k.cluster >= 3 THEN 2 ELSE 1 END AS base
FROM cand c JOIN clus k ON k.plate = c.plate AND k.genus = c.genus AND k.candidate = c.candidate JOIN (SELECT plate, genus, max(cluster) AS top, count(*) - 1 AS rivals FROM clus GROUP BY 1, 2) t ON t.plate = c.plate AND t.genus = c.genus) q""",
    *CANDIDATES,
)
def _(m: Model) -> DataFrame:
    return nm.genus_candidates(hits(m).select(F.col("doc_id").alias("plate"), F.col("binomial").alias("name")), registry(m))


@query(
    "atlas_search",
    """SELECT e.atlas_key, e.binomial, e.genus, (SELECT count(*) FROM places p WHERE p.atlas_key = e.atlas_key AND p.binomial = e.binomial) AS n_places, (SELECT count(*) FROM entries WHERE contains(lower(binomial), 'thes')) AS n_total
FROM entries e WHERE contains(lower(e.binomial), 'thes') ORDER BY e.binomial, e.atlas_key LIMIT 50 OFFSET 50""",
    *ENTRIES,
)
def _(m: Model) -> DataFrame:
    # The second page of 50; paging is the feature here.
    found = nm.atlas_search(entries(m), placements(m), "thes")
    total = nm.atlas_search(entries(m), placements(m), "thes").agg(F.count("*")).scalar()
    return found.orderBy("binomial", "atlas_key").offset(50).limit(50).withColumn("n_total", total).select("atlas_key", "binomial", "genus", "n_places", "n_total")


@query("atlas_genera", "SELECT genus, count(*) AS n FROM entries WHERE genus <> '' GROUP BY 1 ORDER BY n DESC, genus LIMIT 60", *ENTRIES)
def _(m: Model) -> DataFrame:
    return nm.atlas_genera(entries(m))


VOCAB = "vocab AS (SELECT DISTINCT split_part(name, ' ', 1) AS word FROM registry WHERE length(split_part(name, ' ', 1)) >= 5)"
MENTIONS = [
    REGISTRY,
    VOCAB,
    """pcs AS (SELECT doc_id, no, p, lag(p) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM (SELECT doc_id, u.no, u.p FROM documents, UNNEST(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}_]*[\\p{{L}}\\p{{N}}_]+')) WITH ORDINALITY AS u(p, no)) q)""",
    """spots AS (SELECT doc_id, regexp_extract(p, '([\\p{{L}}\\p{{N}}_]+)$', 1) AS word,
 regexp_matches(right(concat(coalesce(before, ''), regexp_extract(p, '^([^\\p{{L}}\\p{{N}}_]*)', 1)), 14), '(?i)(?:mit|als|wie|an|auf|bei|zu|zum|zur|von|vergl\\.?|siehe|gleich|aehnlich|ähnlich|=|\\()\\s*$') AS aside FROM pcs
 WHERE regexp_matches(regexp_extract(p, '([\\p{{L}}\\p{{N}}_]+)$', 1), '^[A-Z][a-zA-Zé]{{5,}}$'))""",
    """mentions AS (SELECT doc_id, genus, count(*) FILTER (WHERE NOT aside) AS n_heading, count(*) FILTER (WHERE aside) AS n_aside FROM (
 SELECT s.*, coalesce(v.word, (SELECT min(w.word) FROM vocab w WHERE length(s.word) >= 8 AND length(w.word) >= 8 AND left(w.word, 6) = left(s.word, 6))) AS genus FROM spots s LEFT JOIN vocab v ON v.word = s.word) q WHERE genus IS NOT NULL GROUP BY 1, 2)""",
]


def vocab(m: Model) -> DataFrame:
    return registry(m).select(fn.genus(F.col("name")).alias("word")).filter(F.length("word") >= 5).distinct()


def mentions(m: Model) -> DataFrame:
    return nm.vocab_mentions(m.documents, ["doc_id"], vocab(m))


@query("vocab_mentions", "SELECT * FROM mentions", *MENTIONS)
def _(m: Model) -> DataFrame:
    return mentions(m)


@query(
    "initial_abbreviations",
    """SELECT doc_id, h[2:2] AS initial, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(concat(' ', text), '[^\\p{{L}}\\p{{N}}_][A-Z]\\.\\s*[a-zé][a-zé\\-]{{3,}}')) AS h FROM docs2) q
WHERE regexp_extract(h, '([a-zé\\-]+)$', 1) NOT IN ('ist','und','der','die','das','ein','eine','von','mit','nur','sind','wie','aber','kommt','vor','nicht','auch','sich','oder','des','dem','den','zu','im','am','an','auf','bei','aus','ils','vergl','siehe','var','forma','sp','vielleicht','wohl') GROUP BY 1, 2""",
    "docs2 AS (SELECT doc_id, regexp_replace(text, '([A-Z])[a-z]+ ([a-z]{{4,}}[ ,.])', '\\1. \\2', 'g') AS text FROM documents)",
)
def _(m: Model) -> DataFrame:
    # The given texts write names out; here they are abbreviated first, as older works print them.
    short = m.documents.select("doc_id", F.regexp_replace("text", r"([A-Z])[a-z]+ ([a-z]{4,}[ ,.])", "$1. $2").alias("text"))
    return nm.initial_abbreviations(short, ["doc_id"])


@query(
    "index_vs_text",
    """SELECT c.section, c.genus, c.n_index, r.rival, r.n AS rival_n FROM (SELECT doc_id + 1 AS section, split_part(binomial, ' ', 1) AS genus, count(*) AS n_index FROM hits GROUP BY 1, 2 HAVING count(*) >= 2) c
LEFT JOIN (SELECT doc_id, left(genus, 1) AS i, first(genus ORDER BY n_heading DESC, genus DESC) AS rival, max(n_heading) AS n FROM mentions WHERE n_heading > 0 GROUP BY 1, 2) r ON r.doc_id = c.section AND r.i = left(c.genus, 1)
WHERE (c.section, c.genus) NOT IN (SELECT (doc_id, genus) FROM mentions WHERE n_heading > 0)""",
    HITS,
    *MENTIONS,
)
def _(m: Model) -> DataFrame:
    # The index is read against the text that follows the one it was made from, so that claims miss.
    index = hits(m).select((F.col("doc_id") + 1).alias("section"), fn.genus(F.col("binomial")).alias("genus"))
    text = mentions(m).filter("n_heading > 0").select(F.col("doc_id").alias("section"), "genus", F.col("n_heading").alias("n"))
    return nm.index_vs_text(index, text)


def claims(m: Model) -> DataFrame:
    """Names an index gives for a text: its own, and those of the text before."""
    h = hits(m).select("doc_id", F.col("binomial").alias("name"))
    return h.unionByName(h.withColumn("doc_id", F.col("doc_id") + 1)).distinct()


@query("name_in_context")
def _(m: Model) -> DataFrame:
    return nm.name_in_context(claims(m), m.documents, ["doc_id"])


@query(
    "annotate_lines",
    """SELECT doc_id, line_no, CASE WHEN r.status IS NOT NULL THEN concat(line, '  [', r.status, ']') ELSE line END AS line, b <> '' AND r.status IS NULL AS unmatched FROM (SELECT *, regexp_extract(line, '^[A-Z][a-z]+ [a-z]{{2,}}') AS b FROM lines) l LEFT JOIN registry r ON r.name = l.b""",
    REGISTRY,
    """lines AS (SELECT doc_id, u.no - 1 AS line_no, u.line FROM documents, UNNEST(string_split(text, chr(10))) WITH ORDINALITY AS u(line, no))""",
)
def _(m: Model) -> DataFrame:
    lines = m.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))
    return nm.annotate_lines(lines, registry(m).select(F.col("name").alias("binomial"), F.col("status").alias("verdict")))


@query(
    "verify_tally",
    """SELECT coalesce(v, verdict) AS verdict, count(*) AS n, count(v) AS n_verified, count(*) FILTER (WHERE v <> verdict) AS n_changed FROM (
SELECT d.doc_id, CASE WHEN n_chars > 1000 THEN 'good' ELSE 'poor' END AS verdict, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) q GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    master = m.documents.select("doc_id", F.when(F.col("n_chars") > 1000, "good").otherwise("poor").alias("verdict"))
    seen = m.labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("verdict"))
    return nm.verify_tally(master, seen)


@query(
    "taxon_scope",
    """SELECT 'rank' AS what, rank AS value, count(*) AS n FROM registry GROUP BY 2 UNION ALL (SELECT 'status', status, count(*) AS n FROM registry GROUP BY 2 ORDER BY n DESC, status LIMIT 6)
UNION ALL SELECT 'flag', 'is_marine', count(*) FILTER (WHERE is_marine) FROM registry UNION ALL SELECT 'flag', 'is_fresh', count(*) FILTER (WHERE is_fresh) FROM registry""",
    REGISTRY,
)
def _(m: Model) -> DataFrame:
    return nm.taxon_scope(registry(m))


@query("load_taxon_dump", "SELECT taxon_id, name, class, is_marine, lower(name) AS folded, lower(name) AS folded_de FROM registry WHERE class = 'Wanted' OR taxon_id % 11 = 0", REGISTRY)
def _(m: Model) -> DataFrame:
    r = registry(m)
    profile = r.select("taxon_id", "name", "is_marine").groupBy("taxon_id", "name").agg(F.max("is_marine").alias("is_marine")).withColumnRenamed("name", "_n")
    # Two names may share an id in this register, so the profile is read by both.
    phylum = F.when(F.col("taxon_id") % 11 == 0, "Wide").alias("phylum")
    taxa = nm.load_taxa(r.select("taxon_id", "name", "class", phylum), profile, ["Wanted"], ["Wide"]).filter("name = _n")
    return taxa.select("taxon_id", "name", "class", "is_marine", "folded", "folded_de")


MASTER = [
    HITS,
    REGISTRY,
    "allnames AS (SELECT DISTINCT binomial AS name, split_part(binomial, ' ', 1) AS genus, split_part(binomial, ' ', 2) AS ep FROM hits)",
    """longer AS (SELECT DISTINCT a.name FROM allnames a JOIN allnames b ON b.genus = a.genus AND starts_with(b.ep, a.ep) AND b.ep <> a.ep)""",
    """elsew AS (SELECT a.name, count(DISTINCT split_part(r.name, ' ', 1)) AS k FROM allnames a JOIN registry r ON split_part(r.name, ' ', 2) = a.ep AND split_part(r.name, ' ', 1) <> a.genus GROUP BY 1)""",
    """master AS (SELECT a.name, CASE WHEN r.name IS NOT NULL THEN 'confirmed' WHEN l.name IS NOT NULL THEN 'junk' ELSE 'look' END AS verdict,
 CASE WHEN r.name IS NOT NULL THEN '' WHEN a.genus NOT IN (SELECT split_part(name, ' ', 1) FROM registry) THEN 'genus missing' WHEN e.k = 1 THEN 'genus doubtful' ELSE 'species missing' END AS reason
 FROM allnames a LEFT JOIN registry r ON r.name = a.name LEFT JOIN longer l ON l.name = a.name LEFT JOIN elsew e ON e.name = a.name)""",
]


def master(m: Model) -> DataFrame:
    names = hits(m).select(F.col("binomial").alias("name")).distinct()
    reg = registry(m)
    e = reg.select(fn.genus(F.col("name")).alias("_g"), fn.epithet(F.col("name")).alias("_e")).distinct()
    elsewhere = (
        names.withColumn("_e", fn.epithet(F.col("name"))).join(e, "_e").filter(F.col("_g") != fn.genus(F.col("name"))).groupBy("name").agg(F.count_distinct("_g").alias("n_elsewhere"))
    )
    genera = reg.select(fn.genus(F.col("name")).alias("genus")).distinct()
    places = names.filter(F.length("name") % 4 == 0).withColumn("place", F.lit("prose"))
    return nm.taxon_master(names, reg, places, nm.truncated_names(names, names), elsewhere, genera)


@query(
    "taxon_master",
    """SELECT name, verdict, reason, CASE WHEN length(name) % 4 = 0 THEN 'prose' ELSE '' END AS place, verdict <> 'confirmed' AND length(name) % 4 <> 0 AS to_look_up FROM master""",
    *MASTER,
)
def _(m: Model) -> DataFrame:
    return master(m)


@query(
    "why_no_match",
    """SELECT reason, count(*) AS n FROM master GROUP BY 1""",
    *MASTER,
)
def _(m: Model) -> DataFrame:
    return master(m).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "worklist_tiers",
    """SELECT length(name) AS number, name, CASE WHEN reason = 'genus doubtful' THEN 2 ELSE 5 END AS tier FROM master WHERE length(name) % 4 <> 0 AND name NOT IN (SELECT name FROM registry) AND (reason = 'genus doubtful' OR verdict IN ('look', 'junk'))""",
    *MASTER,
)
def _(m: Model) -> DataFrame:
    t = master(m).withColumn("number", F.length("name").cast("bigint"))
    return nm.worklist_tiers(t, registry(m))


@query(
    "name_verdict",
    """SELECT m.name, CASE WHEN length(m.name) % 11 = 0 THEN concat('source: plate', CASE WHEN length(m.name) % 2 = 0 THEN '; lookup' ELSE '' END) WHEN length(m.name) % 2 = 0 AND length(m.name) % 13 = 0 THEN 'lookup'
 WHEN verdict = 'confirmed' AND accepted <> m.name THEN concat(status, ' -> ', accepted) WHEN verdict = 'confirmed' THEN status WHEN verdict = 'junk' THEN concat('index debris: ', reason) ELSE concat('look: ', reason) END AS note
FROM master m LEFT JOIN registry r ON r.name = m.name""",
    *MASTER,
)
def _(m: Model) -> DataFrame:
    t = master(m).join(registry(m).select("name", "status", "accepted"), "name", "left").fillna("", ["status", "accepted"])
    size = F.length("name")
    source = F.when(size % 11 == 0, "plate").otherwise("")
    lookup = F.when((size % 2 == 0) & ((size % 11 == 0) | (size % 13 == 0)), "lookup").otherwise("")
    return t.select("name", fn.name_verdict(F.col("name"), source, lookup, F.col("verdict"), F.col("status"), F.col("accepted"), F.col("reason")).alias("note"))


@query(
    "judge_absent",
    """SELECT a.name, CASE WHEN upper(left(ep, 1)) || substr(ep, 2) IN (SELECT genus FROM allnames) THEN 'junk: genus as epithet' WHEN f.first_longer IS NOT NULL THEN concat('junk: front part of ', f.first_longer) ELSE 'look: not registered' END AS verdict
FROM allnames a LEFT JOIN (SELECT a.name, min(b.name) AS first_longer FROM allnames a JOIN allnames b ON b.genus = a.genus AND starts_with(b.ep, a.ep) AND b.ep <> a.ep GROUP BY 1) f ON f.name = a.name WHERE a.name NOT IN (SELECT name FROM registry)""",
    *MASTER[:3],
)
def _(m: Model) -> DataFrame:
    names = hits(m).select(F.col("binomial").alias("name")).distinct()
    genera = names.select(fn.genus(F.col("name")).alias("_g"), F.lit(True).alias("_is")).distinct()
    absent = names.join(registry(m).select("name"), "name", "left_anti").join(nm.truncated_names(names, names).select("name", "first_longer"), "name", "left")
    absent = absent.withColumn("_g", F.initcap(fn.epithet(F.col("name")))).join(genera, "_g", "left")
    return absent.select("name", fn.judge_absent(F.col("name"), F.col("_is"), F.col("first_longer")).alias("verdict"))


@query(
    "judge_removed",
    """SELECT a.name, CASE WHEN r.status IS NOT NULL THEN concat('restore: ', r.status) WHEN length(a.name) % 2 = 0 THEN 'look: short but proper' ELSE 'junk: author' END AS verdict FROM allnames a LEFT JOIN registry r ON r.name = a.name""",
    *MASTER[:3],
)
def _(m: Model) -> DataFrame:
    names = hits(m).select(F.col("binomial").alias("name")).distinct().join(registry(m).select("name", "status"), "name", "left")
    reason = F.when(F.length("name") % 2 == 0, "too short").otherwise("author")
    return names.select("name", fn.judge_removed(F.col("name"), reason, F.col("status")).alias("verdict"))


@query(
    "judge_review",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'quarantine' WHEN 'click' THEN 'spelling proposal' WHEN 'view' THEN 'spelling proposal' ELSE 'look: loose match' END AS verdict FROM events""",
)
def _(m: Model) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "match_quarantine").when(F.col("event_type") == "click", "near_1").when(F.col("event_type") == "view", "phonetic").otherwise("exact")
    return m.events.select("event_id", fn.judge_review(kind).alias("verdict"))
