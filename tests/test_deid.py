import pytest

from spanloom.operators import deid

NOTES = {
    "pipes": (
        "SYNTHETIC BERLIN CLINICAL SUMMARY\nLars Becker | MRN: B-904427 | DOB: 25.05.1960 | Encounter date: 11.05.2025\nPhone: +49 30 0000 2893 | Address: Lindenstraße 12, 10969 Berlin\n"
        "Attending physician: Dr. Emil Brandt | emil.brandt@clinic.example\nDx: HTN. LVEF 53%, 65/M. Signed: Dr. Emil Brandt",
        {("PATIENT_NAME", "Lars Becker"), ("PATIENT_ID", "B-904427"), ("DATE_OF_BIRTH", "25.05.1960"), ("ENCOUNTER_DATE", "11.05.2025"), ("PHONE_NUMBER", "+49 30 0000 2893"), ("ADDRESS", "Lindenstraße 12, 10969 Berlin"), ("CLINICIAN_NAME", "Emil Brandt"), ("EMAIL", "emil.brandt@clinic.example")},
    ),
    "letter": (
        "Dear colleague,\nMargaret O'Donnell (DOB 03 Jan 1971), Hospital no: RI/2024/88431, seen on 2025-11-14.\nTel: 0131 496 0821. Seen by Dr Alan Whitfield in clinic",
        {("PATIENT_NAME", "Margaret O'Donnell"), ("PATIENT_ID", "RI/2024/88431"), ("DATE_OF_BIRTH", "03 Jan 1971"), ("ENCOUNTER_DATE", "2025-11-14"), ("PHONE_NUMBER", "0131 496 0821"), ("CLINICIAN_NAME", "Alan Whitfield")},
    ),
    "spelled in an address": ("Mail laura.koenig@x.example, then Laura König came", {("EMAIL", "laura.koenig@x.example"), ("CLINICIAN_NAME", "Laura König")}),
    "title only": ("😀 Dr. Sarah Klein reviewed", {("CLINICIAN_NAME", "Sarah Klein")}),
    "banner": ("SYNTHETIC EMR EXPORT\nNandini Chowdhury then text", {("PATIENT_NAME", "Nandini Chowdhury")}),
    "uncued dates": ("note 03/04/2023, older 01.02.1950", {("DATE_OF_BIRTH", "01.02.1950"), ("ENCOUNTER_DATE", "03/04/2023")}),
    "one uncued date": ("on 01.02.1950", {("ENCOUNTER_DATE", "01.02.1950")}),
    "empty": ("", set()),
    "missing": (None, set()),
    "clinical text stays": ("BP 120/80, EF 35-40%, reviewed by the ward team", set()),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, n) for k, (n, _) in NOTES.items()], "id string, note_text string")
    return {r.id: r for r in deid.with_pii(rows).collect()}


@pytest.mark.parametrize("name", list(NOTES))
def test_notes(found, name):
    r = found[name]
    assert {(s.label, r.note_text[s.start : s.end]) for s in r.pii_entities} == NOTES[name][1]
    spans = [(s.start, s.end) for s in r.pii_entities]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for label, value in NOTES[name][1]:
        assert value not in r.deidentified_text and f"[{label}]" in r.deidentified_text


def test_repeats_are_two_spans(found):
    assert sum(s.label == "CLINICIAN_NAME" for s in found["pipes"].pii_entities) == 2


def test_strict_names_run_on(spark):
    df = spark.createDataFrame([("Seen by Dr Alan Whitfield in clinic",)], "note_text string")
    r = deid.with_pii(df, strict=True).first()
    assert r.note_text[r.pii_entities[0].start : r.pii_entities[0].end] == "Alan Whitfield in"


def test_simple_variant(spark):
    df = spark.createDataFrame([("born 01.02.1950 phone +49 30 0000 2893 B-904427 a.b@c.de",)], "t string")
    spans = df.select(deid.simple_pii(df.t).alias("s")).first().s
    assert sorted(s.label for s in spans) == ["DATE_OF_BIRTH", "EMAIL", "PATIENT_ID", "PHONE_NUMBER"]
