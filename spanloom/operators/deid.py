"""De-identification: layers of detectors over the note, one resolution step, one rendering step.

Every function maps a text column to an array of candidate spans; all layers of a row are computed where the row
is, so nothing is shuffled whatever the number of notes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import CANDIDATE, SPAN, digits_in, find, guarded, kept_in_order, labelled, let, piece, public, render, resolve, rx, trimmed

P = v.PRIORITY


def _alternatives(cues: tuple[str, ...]) -> str:
    return "|".join(c.replace(" ", r"\s+") for c in cues)


def _trim_all(spans: Column) -> Column:
    return F.transform(spans, trimmed)


def emails(text: Column) -> Column:
    return find(text, rx(v.EMAIL), gate="@")


def email_layer(text: Column) -> Column:
    return labelled(emails(text), "EMAIL", P["email"], "shape")


def phone_layer(text: Column) -> Column:
    cue = rx(rf"(\b(?:{'|'.join(v.PHONE_CUES)})\b\s*[:.\-]?\s*)({v.PHONE_LOCAL})", fold=True)
    local = F.filter(_trim_all(find(text, cue, group=2)), lambda s: digits_in(s["text"]) >= 7)
    return F.concat(
        labelled(find(text, rx(v.PHONE_INTERNATIONAL), gate=r"\+"), "PHONE_NUMBER", P["phone"], "international"),
        labelled(local, "PHONE_NUMBER", P["phone cue"], "cue"),
    )


def identifier_layer(text: Column) -> Column:
    cue = rx(rf"(\b(?:{_alternatives(v.ID_CUES)})\b\s*[:#.\-]?\s*)({v.ID_VALUE})", fold=True)
    by_cue = F.filter(_trim_all(find(text, cue, group=2)), lambda s: s["text"].rlike("[0-9]"))
    return F.concat(labelled(by_cue, "PATIENT_ID", P["id cue"], "cue"), labelled(find(text, rx(v.ID_SHAPE)), "PATIENT_ID", P["id shape"], "shape"))


def date_layer(text: Column) -> Column:
    """Cues decide; else the earliest of several uncued dates is the birth date, if none has a birth cue, and all others encounters."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string,year:int>>")
    left = lambda s: piece(text, F.greatest(s["start"] - 30, F.lit(0)), s["start"])
    kind = lambda s: F.when(left(s).rlike(rx(v.BIRTH_CUE, True)), "DATE_OF_BIRTH").when(left(s).rlike(rx(v.ENCOUNTER_CUE, True)), "ENCOUNTER_DATE")
    year = lambda s: F.coalesce(F.regexp_extract(s["text"], r"\d{4}", 0).try_cast("int"), F.lit(0))
    dates = F.transform(
        find(text, rx(v.DATE), gate=r"\d"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind"), year(s).alias("year"))
    )
    candidate = lambda d, label, rank, source: F.struct(
        d["start"].alias("start"), d["end"].alias("end"), label.alias("label"), F.lit(rank).alias("priority"), F.lit(source).alias("source")
    )

    def with_inference(dates: Column) -> Column:
        bare = F.coalesce(F.filter(dates, lambda d: d["kind"].isNull()), none)
        born = F.exists(dates, lambda d: F.coalesce(d["kind"] == "DATE_OF_BIRTH", F.lit(False)))
        several = ~born & (F.size(bare) > 1)
        earliest = F.array_min(F.transform(bare, lambda d: F.struct(d["year"].alias("year"), d["start"].alias("start"))))["start"]
        return let(
            F.when(several, earliest).otherwise(-1),
            lambda birth: F.transform(
                dates,
                lambda d: F.when(d["kind"].isNotNull(), candidate(d, d["kind"], P["date cue"], "cue")).otherwise(
                    candidate(d, F.when(d["start"] == birth, "DATE_OF_BIRTH").otherwise("ENCOUNTER_DATE"), P["date inferred"], "inferred")
                ),
            ),
        )

    return let(dates, with_inference)


def patient_layer(text: Column, strict: bool = False) -> Column:
    """strict: names after folded cues ignore case too (see clinician_names)."""
    fold = "(?Ui)" if strict else "(?U)"
    birth = r"(?i:,\s*(?:born|geb|d\.?o\.?b))"
    bracket = r"(?i:\(\s*(?:d\.?o\.?b|born))"
    by_cue = find(text, rx(rf"({v.PATIENT_CUE}(?:{v.TITLE})?)({v.NAME})"), group=2)
    anchors = [
        find(text, fold + "(?m)" + guarded(rf"(^)({v.NAME})\s*(?={birth})", strict), group=2),
        find(text, "(?Um)" + guarded(rf"(^)({v.NAME})\s*(?=/\s*[A-Z0-9-]*\d)"), group=2),
        find(text, fold + guarded(rf"(\b)({v.NAME})\s*(?={bracket})", strict), group=2),
    ]
    lines = F.split(text, "\n", 3)
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    name = F.regexp_extract(F.coalesce(second, F.lit("")), rf"(?U)\A(?:{v.NAME})", 0)
    at = F.length(first) + 1
    banner = F.when(
        F.trim(first).rlike(v.BANNER) & (name != ""), F.array(F.struct(at.alias("start"), (at + F.length(name)).alias("end"), name.alias("text")))
    ).otherwise(F.array().cast(SPAN))
    return F.concat(
        labelled(_trim_all(by_cue), "PATIENT_NAME", P["patient cue"], "cue"),
        *[labelled(_trim_all(a), "PATIENT_NAME", P["patient anchor"], "anchor") for a in anchors],
        labelled(_trim_all(banner), "PATIENT_NAME", P["patient banner"], "banner"),
    )


def clinician_cue_spans(text: Column, strict: bool = False) -> Column:
    """After a cue. strict ignores case in the name as well, so it runs on into lower-case words."""
    cue = rf"\b(?:{_alternatives(v.CLINICIAN_CUES)})\b\s*[:\-]?\s*(?:{v.TITLE})?"
    pattern = rx(rf"({cue})({v.NAME})", True) if strict else rx(rf"((?i:{cue}))({v.NAME})")
    return _trim_all(find(text, pattern, group=2))


def clinician_title_spans(text: Column) -> Column:
    return _trim_all(find(text, rx(rf"(\b{v.TITLE})({v.NAME})"), group=2))


def repeat_spans(text: Column, names: Column) -> Column:
    """Every occurrence of each distinct name, between characters that are no letters."""
    one = lambda n: find(text, F.concat(F.lit(r"(?<![A-Za-z])\Q"), n, F.lit(r"\E(?![A-Za-z])")))
    return F.flatten(F.transform(F.array_distinct(F.filter(names, lambda n: n != "")), one))


def email_name_pattern(local: Column) -> Column:
    """Regex for the name an address is made of, null for fewer than two words; oe, ue, ae and ss may stand for ö, ü, ä and ß."""
    fold = lambda w: reduce(lambda x, f: F.replace(x, F.lit(f[0]), F.lit(f[1])), v.UMLAUTS, F.regexp_replace(w, r"([+%])", r"\\$1"))
    pattern = lambda words: F.when(F.size(words) >= 2, F.concat(F.lit(r"(?Ui)\b"), F.array_join(F.transform(words, fold), r"[ \t]+"), F.lit(r"\b")))
    return let(F.filter(F.split(local, "[._-]+"), lambda w: F.length(w) > 1), pattern)


def email_name_spans(text: Column, addresses: Column) -> Column:
    """Names in the note that an address of the note spells out; the address itself does not count."""
    none = F.array().cast(SPAN)

    def of(a: Column) -> Column:
        hits = let(email_name_pattern(F.substring_index(a["text"], "@", 1)), lambda p: find(text, p))
        return F.coalesce(F.filter(hits, lambda h: ~((h["start"] >= a["start"]) & (h["end"] <= a["end"]))), none)

    return F.flatten(F.transform(addresses, of))


def address_layer(text: Column) -> Column:
    def after(cue: Column) -> Column:
        window = F.substring(text, cue["end"] + 1, F.lit(v.ADDRESS_CHARS))
        value = F.get(F.split(window, rx(v.ADDRESS_END), 2), F.lit(0))
        return let(value, lambda x: trimmed(F.struct(cue["end"].alias("start"), (cue["end"] + F.length(x)).alias("end"), x.alias("text"))))

    by_cue = F.filter(F.transform(find(text, rx(v.ADDRESS_CUE, True)), after), lambda s: (F.length(s["text"]) >= 8) & s["text"].rlike("[0-9]"))
    return F.concat(
        labelled(by_cue, "ADDRESS", P["address cue"], "cue"),
        *[labelled(_trim_all(find(text, rx(shape))), "ADDRESS", P["address shape"], "shape") for shape in v.ADDRESS_SHAPES],
    )


def with_candidates(notes: DataFrame, text: str = "note_text", out: str = "candidates", propagate: tuple[str, ...] = ("clinician",), strict: bool = False) -> DataFrame:
    """`notes` with the candidates of all layers, unresolved. A null note counts as empty.

    Layers that others build on are columns of their own, so that each regex runs once per note. propagate:
    "clinician" names are also found at every repeat, "patient" names too if asked for.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = notes.withColumns({"_emails": emails(t), "_by_cue": clinician_cue_spans(t, strict), "_by_title": clinician_title_spans(t), "_patients": patient_layer(t, strict)})
    names = F.transform(F.concat("_by_cue", "_by_title"), lambda s: s["text"])
    layers = [
        labelled(F.col("_emails"), "EMAIL", P["email"], "shape"), phone_layer(t), identifier_layer(t), date_layer(t), address_layer(t), F.col("_patients"),
        labelled(F.col("_by_cue"), "CLINICIAN_NAME", P["clinician cue"], "cue"),
        labelled(F.col("_by_title"), "CLINICIAN_NAME", P["clinician title"], "title"),
        labelled(email_name_spans(t, F.col("_emails")), "CLINICIAN_NAME", P["clinician email"], "email"),
    ]
    if "clinician" in propagate:
        layers.append(labelled(repeat_spans(t, names), "CLINICIAN_NAME", P["clinician repeat"], "repeat"))
    if "patient" in propagate:
        known = F.transform("_patients", lambda s: piece(t, s["start"], s["end"]))
        layers.append(labelled(repeat_spans(t, known), "PATIENT_NAME", P["patient banner"], "repeat"))
    return df.withColumn(out, F.concat(*layers)).drop("_emails", "_by_cue", "_by_title", "_patients")


def with_pii(notes: DataFrame, text: str = "note_text", **options) -> DataFrame:
    """`notes` with pii_entities (start, end, label) and deidentified_text."""
    df = with_candidates(notes, text, "_candidates", **options).withColumn("_resolved", resolve(F.col("_candidates")))
    return df.withColumns({"pii_entities": public(F.col("_resolved")), "deidentified_text": render(F.coalesce(F.col(text), F.lit("")), F.col("_resolved"))}).drop("_candidates", "_resolved")


# --------------------------------------------------------------------------- the simple variant to compare with

# Patterns and words of the simple variant.
SIMPLE_DATE = r"\b(?:\d{2}[./-]\d{2}[./-](?:\d{2}|\d{4})|\d{2}-[A-Za-z]{3}-\d{4}|\d{4}-\d{2}-\d{2})\b"
SIMPLE_PHONE = r"(?:\+\d{1,3}[ -]?)?(?:\(?\d{2,5}\)?[ /-]?){2,4}\d{3,8}"
SIMPLE_ID = r"\b(?:B-\d{6}|CHN-\d{7}|HYD\d{6}|BER/\d{4}/\d{2}|UHID/\d{5}/\d{2}|MRN-\d{2}-\d{5})\b"
SIMPLE_PHONE_WORDS = ("phone", "telephone", "mobile", "contact", "ph ")


def simple_pii(text: Column) -> Column:
    """Few shapes with short contexts; what was found first stays."""
    context = lambda s, k: F.lower(piece(text, F.greatest(s["start"] - k, F.lit(0)), s["start"]))
    as_candidate = lambda s, label: F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label"), F.lit(0).alias("priority"), F.lit("simple").alias("source"))
    dates = F.transform(
        find(text, rx(SIMPLE_DATE)), lambda s: as_candidate(s, F.when(context(s, 20).rlike("dob|born"), "DATE_OF_BIRTH").otherwise("ENCOUNTER_DATE"))
    )
    phones = F.filter(find(text, rx(SIMPLE_PHONE)), lambda s: context(s, 15).rlike("|".join(SIMPLE_PHONE_WORDS)) & (digits_in(s["text"]) >= 8))
    found = F.concat(
        labelled(emails(text), "EMAIL", 0, "simple"), labelled(find(text, rx(SIMPLE_ID)), "PATIENT_ID", 0, "simple"), dates, labelled(phones, "PHONE_NUMBER", 0, "simple")
    )
    return public(F.sort_array(kept_in_order(found.cast(CANDIDATE))))
