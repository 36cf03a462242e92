"""Packers by property, and table operators on small frames."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statutemill.jobs import derive
from statutemill.operators import balance, clean, crossref, repair, search, segment, validate
from statutemill.operators.pack import by_size, cut_before, pack, pack_paragraphs, sentences
from statutemill.sources import store


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=12), max_size=20), st.integers(1, 20), st.sampled_from(["", " ", "\n\n"]))
def test_pack(pieces, most, sep):
    out = pack(pieces, most, sep)
    assert sep.join(out) == sep.join(pieces)
    for o in out:
        assert len(o) <= most or o in pieces


@settings(max_examples=100, deadline=None)
@given(st.text("Aa.!? \n§1", max_size=200), st.integers(4, 40))
def test_split_texts_keep_their_words(text, most):
    squash = lambda t: "".join(t.split())
    assert squash("".join(pack_paragraphs(text, most))) == squash(text)
    assert squash("".join(by_size(text, most))) == squash(text)
    assert "".join(cut_before(text, segment._PARAGRAPH_MARKS)).strip() == text.strip() or not text.strip()


def test_sentences():
    assert sentences("Se stk. 2 i § 1. Derefter jf. Loven. Slut! Nu") == ["Se stk. 2 i § 1.", "Derefter jf. Loven.", "Slut!", "Nu"]


def test_oversize_is_not_given_twice():
    assert pack(["aa", "b" * 9, "cc"], 5, too_big=lambda p: [p[:5], p[5:]]) == ["aa", "bbbbb", "bbbb", "cc"]


def test_sentence_rows_guard_abbreviations(spark):
    df = spark.createDataFrame([(1, "Se stk. Ja i § 1. Derefter jf. Loven."), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.sentence) for r in segment.sentence_rows(df).orderBy("doc_id", "position").collect()] == [(1, "Se stk. Ja i § 1."), (1, "Derefter jf. Loven.")]


def test_segments_and_sections(spark):
    t = "forord\nC.F.1.2.3 Titel et\nbrød\nC.F.1.2.4 Titel to\nmere"
    df = spark.createDataFrame([(1, t), (2, "uden numre"), (3, None)], "doc_id long, text string")
    got = segment.segment_guidance(df).orderBy("doc_id", "segment_position").collect()
    assert [(r.doc_id, r.section, r.parent_id) for r in got] == [(1, "C.F.1.2.3", "C.F.1"), (1, "C.F.1.2.4", "C.F.1"), (2, "", "")]
    assert segment.section_header(df).orderBy("doc_id").head().section_title == "Titel et"
    parts = segment.segment_documents(df.where("doc_id = 1"), 50)
    assert [r.kind for r in parts["segments"].collect()] == ["main", "main"]
    assert parts["stats"].head().sections == 2


def test_paragraph_segments_keep_text(spark):
    df = spark.createDataFrame([(1, "indledning § 1 første § 2 anden " * 30)], "doc_id long, text string")
    got = segment.segment_paragraphs(df, 200).orderBy("segment_position").collect()
    assert "".join(r.text for r in got) == "indledning § 1 første § 2 anden " * 30
    assert max(len(r.text) for r in got) <= 200


def test_routing(spark):
    df = spark.createDataFrame([(1, "vejledning", "A.1 en A.2 to"), (2, "ukendt", "§ 1 a § 2 b"), (3, "cirkulaere", None), (4, "den_juridiske_vejledning", "C.F.1.2.3 x C.F.1.2.4 y")], "doc_id long, doc_type string, text string")
    got = segment.clean_and_segment(df, max_len=8).groupBy("doc_id").count().collect()
    assert dict(got) == {1: 2, 2: 2, 4: 2}


def chunk_rows(spark):
    return spark.createDataFrame(
        [(1, 1, 0, "A", "x", "kort", ["k"], [("LL § 1", True)]), (1, 2, 0, "A", "x", "også kort", ["m"], [("LL § 1", False), ("LL § 2", False)]), (1, 3, 0, "B", "x", "b" * 300, [], []), (1, 4, 0, "A", None, None, None, None)],
        "doc_id long, chunk_position long, segment_position int, section string, subsection string, content string, concepts array<string>, law_references array<struct<ref:string,is_primary:boolean>>",
    )


def test_merge_keeps_content(spark):
    got = balance.merge_small_chunks(chunk_rows(spark).where("content is not null"), 200, 1000).orderBy("chunk_position").collect()
    assert [r.content for r in got] == ["kort\n\nogså kort", "b" * 300]
    assert got[0].concepts == ["k", "m"] and [tuple(x) for x in got[0].law_references] == [("LL § 1", True), ("LL § 2", False)]


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(["a" * 150, "a" * 150, "b", None, "b", " "])], "doc_id long, chunk_position int, content string")
    once = clean.dedupe_prefix(clean.drop_empty(df), within=())
    assert sorted(r.doc_id for r in once.collect()) == [0, 2]
    assert clean.dedupe_prefix(once, within=()).count() == 2


def test_dedupe_keeps_other_documents(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "a"), (2, 2, "b")], "doc_id long, chunk_position int, content string")
    assert sorted((r.doc_id, r.chunk_position) for r in clean.dedupe_prefix(df).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_a_note_is_no_paragraph(spark):
    chunks = spark.createDataFrame([(1, "§ 1", "Stk. 1", True), (1, "§ 2", "Stk. 1", False)], "doc_id long, paragraph string, stykke string, is_note boolean")
    want = spark.createDataFrame([(1, "§ 1", "Stk. 1"), (1, "§ 2", "Stk. 1")], "doc_id long, paragraph string, stykke string")
    assert [(r.paragraph, r.stykke) for r in validate.missing_paragraphs(want, chunks).collect()] == [("§ 1", "Stk. 1")]


def test_key_phrases_of_notes(spark):
    whole = "For grænsegængere gælder kildeskattelovens §§ 5 A-5 D."
    chunks = spark.createDataFrame([(d, 1, "795", True, t) for d, t in ((1, whole), (2, whole.replace("grænse", "byer og")))], "doc_id long, chunk_position long, note_number string, is_note boolean, content string")
    kept = spark.createDataFrame([(d, "notes", "795", whole) for d in (1, 2)], "doc_id long, kind string, key string, text string")
    assert {r.doc_id: r.verdict for r in validate.note_check(chunks, kept).collect()} == {1: "complete", 2: "modified"}


def test_merging_unites_every_list_and_heeds_the_first_type(spark):
    rows = [(1, i, 0, "A", "x", c * 240, kind, [c]) for i, (c, kind) in enumerate([("a", "eksempel"), ("b", "text"), ("c", "text"), ("d", "text")])]
    df = spark.createDataFrame(rows, "doc_id long, chunk_position long, segment_position int, section string, subsection string, content string, chunk_type string, question_types array<string>")
    got = balance.merge_small_chunks(df, 250, 1000, by_type=True).orderBy("chunk_position").collect()
    assert [(len(r.content), r.question_types) for r in got] == [(482, ["a", "b"]), (482, ["c", "d"])]
    got = balance.merge_small_chunks(df, 250, 1000).collect()
    assert [(len(r.content), r.question_types) for r in got] == [(966, ["a", "b", "c", "d"])]


def test_preserved_parts_come_from_their_own_half(spark):
    t = "§ 1 første.\nEksempel: a.\n\nNOTER:\n101 om § 9 noget\n102 b\n101 igen"
    kept = segment.segment_documents(spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string"), 1000)["preserved"].collect()
    assert sorted((r.kind, r.key) for r in kept if r.kind != "examples") == [("notes", "101"), ("notes", "102"), ("paragraphs", "§ 1")]
    assert [r.text for r in kept if r.key == "101"] == ["igen"]


def test_repaired_rows_have_ids(spark):
    chunks = spark.createDataFrame([(1, "c1", 4, "§ 1", "Stk. 1", "tekst", "t")], "doc_id long, chunk_id string, chunk_position long, paragraph string, stykke string, content string, theme string")
    structure = spark.createDataFrame([(1, "§ 2", "Stk. 2", None), (1, "§ 3", None, "Om skat")], "doc_id long, paragraph string, stykke string, description string")
    nothing = spark.createDataFrame([], "doc_id long, kind string, key string, text string")
    got = repair.repair_missing_paragraphs(chunks, structure, nothing).where("reconstructed").orderBy("paragraph").collect()
    assert [(r.chunk_id, r.chunk_position, r.content, r.theme) for r in got] == [("placeholder_1_§ 2_Stk. 2", 5, "Placeholder for § 2, Stk. 2", "Rekonstrueret"), ("placeholder_1_§ 3", 6, "Om skat", "Rekonstrueret")]


def test_no_self_edges(spark, sf):
    edges = crossref.cross_references(derive.chunks(spark, sf))
    assert edges.where("src = dst").count() == 0
    assert edges.groupBy("doc_id", "src").count().agg(F.max("count")).head()[0] <= 5


def test_repair_takes_the_preserved_text(spark):
    chunks = spark.createDataFrame([(1, "c1", 1, "§ 1", "Stk. 1", "tekst")], "doc_id long, chunk_id string, chunk_position long, paragraph string, stykke string, content string")
    structure = spark.createDataFrame([(1, "§ 1", "Stk. 1"), (1, "§ 2", "Stk. 2"), (1, "§ 3", None)], "doc_id long, paragraph string, stykke string")
    kept = spark.createDataFrame([(1, "paragraphs", "§ 2", "Stk. 1 a Stk. 2 b Stk. 3 c")], "doc_id long, kind string, key string, text string")
    got = {r.paragraph: (r.content, r.chunk_type) for r in repair.repair_missing_paragraphs(chunks, structure, kept).where("reconstructed").collect()}
    assert got == {"§ 2": ("§ 2 Stk. 2 b", "text"), "§ 3": ("Placeholder for § 3", "placeholder")}


def test_score(spark):
    c = "missing_notes missing_paragraphs missing_exceptions missing_groups context_issues".split()
    df = spark.createDataFrame([(1, *[0] * 5, 0.0, 0.0, 0.1), (2, 5, 10, 2, 1, 2, 30.0, 0.0, 0.5), (3, 100, 0, 0, 0, 0, 0.0, 0.0, 0.0)], f"doc_id long, {', '.join(x + ' int' for x in c)}, pct_too_small double, pct_too_large double, redundancy double")
    assert [(r.score, r.status) for r in validate.with_score(df).orderBy("doc_id").collect()] == [(10.0, "ok"), (3.7, "warning"), (0.0, "warning")]


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in (3, 8)] + [(5, None)], "query_id long, embedding array<float>")
    got = {}
    for r in search.knn(q, v, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    want = {i: sorted(range(300), key=lambda j: (float(((x[i].astype(float) - x[j].astype(float)) ** 2).sum()), j))[:4] for i in (3, 8)}
    assert got == want


def test_sentences_equal_sql_on_odd_rows(spark, tmp_path):
    import duckdb
    from statutemill.jobs import catalogue

    texts = ["A b. C d! E", "", None, "Ab.\vCd. Ef", "Ab.\u00a0Cd. ÆB", "x zzz. Yes. No", "   ", "a.\fB.\r\nC", "one<CUT>two. Three", "a\u0001b. C"]
    rows = [*enumerate(texts), (0, "One. Two."), (0, "Three. Four? Five"), (0, "Three. Four? Five"), (None, "Null. Id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(con.execute(catalogue.ORACLES["g9_sentences"]).fetchall(), key=key)
    assert sorted(map(tuple, catalogue.QUERIES["g9_sentences"](spark, str(tmp_path)).collect()), key=key) == want


def test_hits_by_place_are_listed_once_for_questions_of_the_same_places(spark):
    chunks = derive.chunks(spark, "/root/testdata/sf0.001")
    asked = [(i, kind, value, None) for i in range(6) for kind, value in (("paragraph", f"§ {i % 2 + 1}"), ("note", "7"))] + [(i, "theme", "lempelse", None) for i in (0, 1)]
    out = search.metadata_search(spark.createDataFrame(asked, "query_id long, kind string, value string, value2 string"), chunks)
    heads = {}
    for c in chunks.select("content", "paragraph", "is_note", "note_number", "theme").collect():
        for q in range(6):
            ten = c.paragraph == f"§ {q % 2 + 1}" or (c.is_note and c.note_number == "7")
            seven = q < 2 and "lempelse" in c.theme
            if ten or seven:
                heads[q, c.content[:50]] = max(heads.get((q, c.content[:50]), 0), 10.0 if ten else 7.0)
    assert {(r.query_id, r["head"]): r.score for r in out.collect()} == heads and out.count() == len(heads)
    # hits of a question are not grouped: that moved a row for each question and chunk
    keys = re.findall(r"keys?=\[([^\]]*)\], functions=\[partial_min", out._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("query_id" in k for k in keys)


def test_knn_of_equal_vectors_and_questions(spark):
    rng = np.random.default_rng(6)
    distinct = rng.normal(size=(9, 4))
    v = [(i, [float(x) for x in distinct[i % 7]]) for i in range(60)]
    q = [(i, [float(x) for x in distinct[i % 9]]) for i in range(100, 130)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"], r.chunk_id) for r in search.knn(frame(q, "query_id"), frame(v, "chunk_id"), 12).collect()}
    want = set()
    for i, x in q:
        best = sorted((float(((np.array(x) - np.array(y)) ** 2).sum()), j) for j, y in v)[:12]
        want |= {(i, n, j) for n, (_, j) in enumerate(best, 1)}
    assert got == want


def test_knn_broadcasts_no_copies_of_questions(spark):
    # blocks of questions were copied for each lane, and the copies broadcast as if they were one
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search, "_in_blocks", lambda pairs, k, f=search._in_blocks: seen.append(pairs._jdf.queryExecution().executedPlan().toString()) or f(pairs, k))
        rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "chunk_id long, embedding array<double>")
        assert search.knn(rows.withColumnRenamed("chunk_id", "query_id"), rows, 2).count() == 80
    assert len(seen) == 1 and "Broadcast" not in seen[0]


def test_searches_use_all_embeddings(spark, tmp_path):
    from statutemill.jobs import catalogue

    spark.range(700).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(14000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    asked = catalogue._asked(spark, str(tmp_path))
    assert (asked.count(), asked.select("embedding").distinct().count()) == (700, 700)


def test_question_concepts(spark):
    q = spark.createDataFrame([(1, "Gælder § 33 A, stk. 2 for søfolk? Se note 12 om lempelse"), (2, None), (3, "")], "query_id long, question string")
    got = {(r.kind, r.value, r.value2) for r in search.question_concepts(q).collect()}
    assert got == {("paragraph", "§ 33 A", "Stk. 2"), ("note", "12", None), ("theme", "lempelse", None), ("theme", "søfolk", None), ("group", "søfolk", None)}


def test_context(spark, sf):
    c = derive.chunks(spark, sf)
    hits = c.where("doc_id < 5").select(F.lit(1).alias("query_id"), "doc_id", "chunk_id", "content")
    text = search.build_context(hits, c).head().context
    assert text.index("--- LOVTEKST ---") < text.index("--- NOTER OG FORTOLKNINGSBIDRAG ---")


def test_rename_and_replies(spark, tmp_path):
    meta = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, title string")
    mapping = spark.createDataFrame([(1, 9, "ny"), (2, 1, "optaget"), (7, 8, "mangler")], "old long, new long, title string")
    renamed, _, checked = store.rename_documents(meta, meta.select("doc_id"), mapping)
    assert sorted((r.doc_id, r.title) for r in renamed.collect()) == [(2, "b"), (9, "ny")]
    assert {r.old: r.accepted for r in checked.collect()} == {1: True, 2: False, 7: False}
    replies = spark.createDataFrame([(1, 0, '{"chunks": [{"content": "a"}]}'), (2, 0, 'svar: {"chunks": [{"content": "b"}]} slut'), (3, 0, "ikke json")], "doc_id long, segment_position int, reply string")
    assert [(r.doc_id, r.content) for r in store.parse_replies(replies).orderBy("doc_id").collect()] == [(1, "a"), (2, "b"), (3, "ikke json")]
    (tmp_path / "a.json").write_text('[{"content": "x", "metadata": {"k": 1}}]')
    (tmp_path / "b.json").write_text('{"chunks": [{"content": "y"}]}')
    assert sorted(r.content for r in store.read_chunks(spark, f"file://{tmp_path}").collect()) == ["x", "y"]
    (tmp_path / "c.json").write_text('"z"')
    with pytest.raises(Exception, match="neither a list"):
        store.read_chunks(spark, f"file://{tmp_path}").collect()
