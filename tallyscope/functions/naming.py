"""Folder names, slugs and catalogue numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two folder name patterns, the observation suffix, and the key patterns of engine and drawn masks.
CORE_NAME = r"^(?i)([A-Za-z0-9]+)-([A-Za-z0-9]+)\s+([0-9.]+)\s*cm"
OUTCROP_NAME = r"^([A-Za-z]+[0-9]+)\s*-\s*([0-9]+)"
OBSERVATION = r"\s*\(([0-9]+)\)\s*$"
ENGINE_KEY = r"^[0-9]+_[0-9]+_[0-9]+_[0-9]+$"
DRAWN_KEY = r"^m[0-9a-f]{8}$"
CATALOG_NO = (
    r"(?i)^([A-Z0-9]+)-([A-Z0-9]+)-([A-Z0-9]+)(?:-([0-9]+))?-g([0-9]+)(?:-f([0-9]+))?"
    r"-([0-9]+_[0-9]+_[0-9]+_[0-9]+|m[0-9a-f]{8})-([A-Z0-9]+)$"
)
DRAWN_BATCH_CODE = "M"


def _group(text: Column, pattern: str, n: int) -> Column:
    got = F.regexp_extract(text, pattern, n)
    return F.when(got != "", got)


def _plain_number(text: Column) -> Column:
    """A decimal without trailing zeros, as text."""
    d = text.try_cast("double")
    whole = d == F.floor(d)
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def observation_no(folder: Column) -> Column:
    return F.coalesce(_group(folder, OBSERVATION, 1).cast("int"), F.lit(0))


def base_name(folder: Column) -> Column:
    return F.trim(F.regexp_replace(folder, OBSERVATION, ""))


def position_in_outcrop(locality: Column, sample: Column) -> Column:
    """Sample number with the repeated digits of its locality taken off the front."""
    head = F.regexp_replace(locality, "[^0-9]", "")
    rest = F.when((head != "") & F.startswith(sample, head), F.substring(sample, F.length(head) + 1, F.length(sample))).otherwise(sample)
    return F.coalesce(rest.try_cast("int"), sample.try_cast("int"))


def parse_folder(folder: Column) -> Column:
    """Struct (site_code, loc_code, loc_kind, sample_code, depth_cm, sample_no, obs_no); nulls when no pattern fits."""
    base = base_name(folder)
    core_site, core_loc, depth = (_group(base, CORE_NAME, i) for i in (1, 2, 3))
    out_loc, out_sample = F.upper(_group(base, OUTCROP_NAME, 1)), _group(base, OUTCROP_NAME, 2)
    is_core, is_outcrop = core_site.isNotNull(), out_loc.isNotNull()
    letters = F.regexp_replace(out_loc, "[0-9]+$", "")
    out_site = F.when(letters != "", letters).otherwise(out_loc)

    def pick(core: Column | None, outcrop: Column | None) -> Column:
        out = F.when(is_core, core if core is not None else F.lit(None))
        return out.when(is_outcrop, outcrop) if outcrop is not None else out

    return F.struct(
        pick(F.upper(core_site), out_site).alias("site_code"),
        pick(F.upper(core_loc), out_loc).alias("loc_code"),
        pick(F.lit("core"), F.lit("outcrop")).alias("loc_kind"),
        pick(F.concat(_plain_number(depth), F.lit("cm")), out_sample).alias("sample_code"),
        F.when(is_core, depth.try_cast("double")).alias("depth_cm"),
        F.when(~is_core & is_outcrop, position_in_outcrop(out_loc, out_sample)).alias("sample_no"),
        observation_no(folder).alias("obs_no"),
    )


def slide_slug(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), r"[^a-z0-9_-]+", "_")
    return F.regexp_replace(F.regexp_replace(flat, r"_+", "_"), r"^_+|_+$", "")


def code_part(text: Column) -> Column:
    """Capitals and digits of a text; null when none are left."""
    out = F.regexp_replace(F.upper(F.coalesce(text.cast("string"), F.lit(""))), r"[^A-Z0-9]+", "")
    return F.when(out != "", out)


def _padded(digits: Column, width: int) -> Column:
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def sample_part(code: Column) -> Column:
    """Sample code without a ``cm`` ending; numbers get three digits."""
    out = code_part(F.regexp_replace(F.trim(code), r"(?i)\s*cm\s*$", ""))
    return F.when(out.rlike("^[0-9]+$"), _padded(out, 3)).otherwise(out)


def catalog_no(
    site: Column, locality: Column, sample: Column, viewpoint: Column, key: Column, obs_no: Column, frame_seq: Column, batch_code: Column, drawn: Column
) -> Column:
    """Struct (number, why): the number is null and ``why`` names the missing part when it cannot be made."""
    s, loc, smp, batch = code_part(site), code_part(locality), sample_part(sample), code_part(batch_code)
    good_key = key.rlike(ENGINE_KEY) | key.rlike(DRAWN_KEY)
    why = (
        F.when(s.isNull(), "site")
        .when(loc.isNull(), "locality")
        .when(smp.isNull(), "sample")
        .when(viewpoint.isNull(), "viewpoint")
        .when(~F.coalesce(good_key, F.lit(False)), "position")
        .when(~drawn & batch.isNull(), "batch")
    )
    text = F.concat_ws(
        "-",
        *[s, loc, smp],
        F.when(F.coalesce(obs_no, F.lit(0)) != 0, obs_no.cast("string")),
        F.concat(F.lit("g"), _padded(viewpoint.cast("string"), 2)),
        F.concat(F.lit("f"), _padded(frame_seq.cast("string"), 2)),
        key,
        F.when(drawn, DRAWN_BATCH_CODE).otherwise(batch),
    )
    return F.struct(F.when(why.isNull(), text).alias("number"), F.coalesce(why, F.lit("")).alias("why"))


def parse_catalog_no(text: Column) -> Column:
    """Struct of the parts of a catalogue number, null when the text is none."""
    t = F.trim(text)

    def g(i: int) -> Column:
        return F.regexp_extract(t, CATALOG_NO, i)

    key = g(7)
    return F.when(
        t.rlike(CATALOG_NO),
        F.struct(
            F.upper(g(1)).alias("site"),
            F.upper(g(2)).alias("locality"),
            F.upper(g(3)).alias("sample"),
            F.coalesce(g(4).try_cast("int"), F.lit(0)).alias("obs_no"),
            g(5).try_cast("bigint").alias("viewpoint"),
            g(6).try_cast("bigint").alias("frame_seq"),
            F.when(F.lower(key).startswith("m"), F.lower(key)).otherwise(key).alias("mask_key"),
            F.upper(g(8)).alias("batch_code"),
        ),
    )
