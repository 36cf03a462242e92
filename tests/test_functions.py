"""Row-wise functions on literal samples, nulls and Danish letters."""

import pytest
from pyspark.sql import functions as F

from statutemill.functions import classify, refs, text
from statutemill.functions.rules import LAW_ABBREVIATIONS


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).head().x


@pytest.mark.parametrize(
    "f, given, want",
    [
        (text.clean_law_text, "skat-\nten  §33A og stk.2\n\n\nslut", "skatten § 33A og Stk. 2\nslut"),
        (text.clean_guidance, "Side 3 af 9 Eks: a eksempel, b", " Eksempel: a Eksempel: b"),
        (text.clean_circular, "1.2 Afsnit", "1.2. Afsnit"),
        (text.clean_legal_guidance, "Side 1 af 2a\n\n\n\nEksempel 3. jf.§4\t\tb", "a\n\nEksempel 3: jf. § 4 b"),
        (text.normalize_ref_format, "  §33A,  STK.2 ", "§ 33a, stk. 2"),
        (text.squash_key, "Stk. 2 ", "stk.2"),
        (text.estimate_tokens, "123456789", 2),
        (text.clean_law_text, None, None),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


def test_notes(spark):
    df = spark.createDataFrame([("hoved\nNOTER:\n794 § 33 A er ny\n795 tekst",), ("ingen",), (None,)], "t string")
    main, notes = text.split_main_and_notes(F.col("t"))
    rows = df.select(main.alias("m"), notes.alias("notes_text"))
    assert [tuple(r) for r in rows.collect()][:2] == [("hoved", "794 § 33 A er ny\n795 tekst"), ("ingen", "")]
    assert [(r.note_number, r.content) for r in text.extract_notes(rows).collect()] == [("794", "[NOTE:794] § 33 A er ny"), ("795", "[NOTE:795] tekst")]


@pytest.mark.parametrize(
    "given, want",
    [
        ("SKM2020.123.LSR", "SKM.2020.123.LSR"),
        ("TfS 2020, 123 H", "TfS.2020.123.H"),
        ("U 2020.123 H", "U.2020.123.H"),
        ("noget andet", "noget andet"),
    ],
)
def test_case_normaliser(spark, given, want):
    assert one(spark, given, lambda t: refs.normalize_case_refs(F.array(t))) == [want]


def test_case_refs(spark):
    t = "Jf. SKM2020.123.LSR og U 2019.45 H samt tfs i 2020.1 af Højesterets dom af 3. maj 2001."
    assert one(spark, t, refs.case_refs) == ["U 2019.45 H", "Højesterets dom af 3. maj 2001", "SKM2020.123.LSR"]
    assert one(spark, "SKM2006.635.SKAT", lambda t: refs.normalize_case_refs_guidance(F.array(t))) == ["SKM.2006.635.SKAT"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("efter § 33 gælder", ["LOV § 33"]),
        ("§§ 4-6", ["LOV § 4", "LOV § 5", "LOV § 6"]),
        ("LL § 33 A, stk. 2", ["LL § 33 A, stk. 2"]),
        ("efter § 7 i KSL, og PSL § 3", ["KSL § 7", "PSL § 3"]),
        ("slik og SLIK § 4", ["LOV § 4"]),
        ("ligningslovens § 33 A, stk. 2, og § 5", ["LL § 33 A, stk. 2", "LL § 5"]),
        ("bogføringslovens § 2", ["B § 2"]),
        (None, []),
        ("", []),
    ],
)
def test_law_refs(given, want):
    assert refs.scan_law_refs(given, LAW_ABBREVIATIONS) == want


def test_primary(spark):
    got = one(spark, "LL § 5 og LL § 7, LL § 7", lambda t: refs.with_primary(t, F.array(F.lit("LL § 5"), F.lit("LL § 7"))))
    assert [(r.ref, r.is_primary) for r in got] == [("LL § 5", False), ("LL § 7", True)]


def test_classifiers(spark):
    assert one(spark, "A.B.1.2.3", classify.hierarchy_path) == ["A.B.1", "A.B.1.2", "A.B.1.2.3"]
    assert one(spark, "", classify.hierarchy_path) == []
    assert one(spark, " Bemærk at", classify.chunk_type) == "note"
    assert one(spark, "ÆNDRET: Cirkulære nr. 5", classify.document_type) == "cirkulaere"
    assert one(spark, "intet her", classify.document_type) == "generisk"
    assert one(spark, None, classify.document_type) is None
    assert one(spark, "Version: 2024-01-31", classify.version_date) == "2024-01-31"
    assert one(spark, "En PENSIONIST og en søfarende", classify.affected_groups) == ["søfolk", "pensionister"]
    assert one(spark, "Det gælder ikke for udlændinge. Her gælder ikke for udlændinge; slut", classify.legal_exceptions) == ["gælder ikke for udlændinge"]
    assert one(spark, "Ved dobbeltbeskatning forstås to skatter", lambda t: classify.concepts(t, F.array(F.lit("tema")))) == ["tema", "dobbeltbeskatning"]
    assert one(spark, "reglen om 42 dage", classify.named_exceptions) == ["42-dages reglen"]
    status = lambda t: classify.legal_status(t, F.lit(False), F.array().cast("array<string>"))
    assert one(spark, "Reglen er ophævet.", status) == "ophævet"
    assert one(spark, "gælder indtil den 3. maj 2025", lambda t: classify.expiry_date(t, status(t))) == "3. maj 2025"


def test_scores_stay_in_range(spark):
    rows = spark.range(0, 5000, 37).select(classify.retrievability(F.col("id"), F.col("id") % 5, F.col("id") % 3, F.col("id") % 9, F.col("id") % 2 == 0).alias("x"))
    low, high = rows.agg(F.min("x"), F.max("x")).head()
    assert 0 <= low < high <= 1
