"""Segmentation and chunking: one row a document in, ordered rows out.

Pattern steps are built-in expressions; greedy packing runs in vectorised helpers (see pack). Null and empty texts give
no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import refs as refs_fn
from ..functions import rules as R
from ..functions import text as text_fn
from .pack import by_size, cut_before, exploded, map_texts, pack, pack_paragraphs, paragraphs, sentences, slices

_STRING = T.StringType()


def _cut_at(df: DataFrame, pattern: str, text: str = "text") -> Column:
    """Stretches of the text from each match of pattern to the next."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)({pattern}\s+.+?)(?={pattern}\s|$)"), F.lit(1))


def segment_sections(df: DataFrame, pattern: str = r"C\.F\.\d+\.\d+\.\d+") -> DataFrame:
    """Rows (…, segment_position, section, text) from each section id to the next."""
    rows = exploded(df.withColumn("pieces", _cut_at(df, pattern)), position="segment_position")
    return rows.withColumn("section", F.regexp_extract("text", f"({pattern})", 1))


def segment_guidance(df: DataFrame) -> DataFrame:
    """As segment_sections for any id X.Y.n.n.n; a text without ids is one segment. Adds parent_id (the first three parts)."""
    found = _cut_at(df, R.SECTION_ID)
    whole = F.when(F.size(found) > 0, found).when(F.coalesce(F.col("text"), F.lit("")) != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    rows = exploded(df.withColumn("pieces", whole), position="segment_position")
    section = F.regexp_extract("text", f"({R.SECTION_ID})", 1)
    return rows.withColumn("section", section).withColumn("parent_id", F.array_join(F.slice(F.split("section", r"\."), 1, 3), "."))


def hierarchy_edges(segments: DataFrame) -> DataFrame:
    """Distinct (doc_id, parent_id, child_id) of segments with a section."""
    return segments.where("section <> ''").select("doc_id", "parent_id", F.col("section").alias("child_id")).distinct()


def section_header(df: DataFrame) -> DataFrame:
    """section and section_title (the rest of the id's line) of each text; '' without an id."""
    section = F.regexp_extract("text", f"({R.SECTION_ID})", 1)
    title = F.trim(F.regexp_extract("text", rf"{R.SECTION_ID}\s+([^\n]+)", 1))
    return df.withColumn("section", section).withColumn("section_title", title)


def _split_structured(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    # fixed value: headings, key words, numbers and bullets that open a part
    marks = re.compile(
        r"(?=\n\s*\n(?:[A-Z][a-zA-ZæøåÆØÅ\s]+\n|(?:Betingelser|Forudsætninger|Undtagelser|Hovedregel|Praksis|Eksempel|Se også|Bemærk)|\d+\.\s+[A-ZÆØÅ]|[•\-]\s+))"
    )
    parts = cut_before(text, marks)
    return pack(parts, most, too_big=lambda p: pack_paragraphs(p, most))


def _split_segment(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    # fixed value: headings, numbers and key words that open a part
    marks = re.compile(r"(?=\n\s*\n(?:[A-ZÆØÅ][a-zæøåA-ZÆØÅ\s]+\n|\d+\.\s+[A-ZÆØÅ]|Bemærk\s+|Eksempel\s+\d+:|Se også\s+))")
    return pack(cut_before(text, marks), most, too_big=lambda p: pack_paragraphs(p, most))


# Where main parts begin, by kind of text.
_PARAGRAPH_MARKS = re.compile(r"(?=§\s+\d+[A-Za-z]?|Kapitel\s+\d+|Afsnit\s+\d+)")
_GUIDANCE_MARKS = re.compile(r"(?<![A-Z.\d])(?=[A-Z]\.\d+\s)")
_CIRCULAR_MARKS = re.compile(r"(?<![\d.])(?=\d+\.\s)")


def _packed(df: DataFrame, run) -> DataFrame:
    return exploded(map_texts(df, run, _STRING), position="segment_position")


def segment_paragraphs(df: DataFrame, max_len: int = R.MAX_SEGMENT) -> DataFrame:
    """Cut at § n, Kapitel n and Afsnit n, packed to max_len; a piece too big by itself is split by structure."""
    return _packed(df, lambda t: pack(cut_before(t, _PARAGRAPH_MARKS), max_len, too_big=lambda p: _split_structured(p, max_len)))


def segment_guidance_main(df: DataFrame, max_len: int = R.MAX_SEGMENT) -> DataFrame:
    """Cut at main sections (A.1 …), packed to max_len; pieces stay whole."""
    return _packed(df, lambda t: pack(cut_before(t, _GUIDANCE_MARKS), max_len))


def segment_circular(df: DataFrame, max_len: int = R.MAX_SEGMENT) -> DataFrame:
    """Cut at main sections (1. …), packed to max_len; pieces stay whole."""
    return _packed(df, lambda t: pack(cut_before(t, _CIRCULAR_MARKS), max_len))


def split_structured(df: DataFrame, max_len: int = R.SPLIT_ABOVE) -> DataFrame:
    """Texts over max_len cut at headings, keyword paragraphs, numbered items and bullets; what is too big by paragraphs and sentences."""
    return _packed(df, lambda t: _split_structured(t, max_len))


def split_segment(df: DataFrame, max_len: int = R.SPLIT_ABOVE) -> DataFrame:
    """As split_structured with the marks of segments before a model call."""
    return _packed(df, lambda t: _split_segment(t, max_len))


def sentence_list(text: Column, abbreviations: tuple[str, ...] = R.ABBREVIATIONS, cut: str = r"(?<=[.!?])\s+(?=[A-ZÆØÅ])") -> Column:
    """Sentences of a text, without empty ones: cut after . ! ? before a capital; abbreviations end no sentence."""
    if not abbreviations:
        return F.filter(F.split(text, cut), lambda s: s != "")
    short = "|".join(a[:-1].replace(".", r"\.") for a in abbreviations)
    guarded = F.regexp_replace(text, rf"(?<![\p{{L}}])({short})\.", "$1\u0001")
    return F.filter(F.transform(F.split(guarded, cut), lambda s: F.replace(s, F.lit("\u0001"), F.lit("."))), lambda s: s != "")


def sentence_rows(df: DataFrame, abbreviations: tuple[str, ...] = R.ABBREVIATIONS, cut: str = r"(?<=[.!?])\s+(?=[A-ZÆØÅ])") -> DataFrame:
    """Rows (…, position, sentence) of sentence_list."""
    return exploded(df.withColumn("pieces", sentence_list(F.col("text"), abbreviations, cut)), value="sentence")


def split_by_size(df: DataFrame, target: int = R.TARGET) -> DataFrame:
    """Rows (…, position, text): sentences packed to target, very long ones cut at commas and colons."""
    return exploded(map_texts(df, lambda t: by_size(t, target), _STRING))


# Fixed value: where a note begins.
_NOTE_MARKS = re.compile(r"(?=\n\d{3}\s+|\[NOTE:\d{3}\])")


def _split_notes(text: str, most: int) -> list[str]:
    def parts(note: str) -> list[str]:
        n = re.search(r"\d{3}", note)
        body = _split_structured(re.sub(r"^\s*(?:\[NOTE:\d{3}\]|\d{3}\s)\s*", "", note), max(1, most // 2))
        return [f"[NOTE:{n[0] if n else '000'} del {i}/{len(body)}] {b}" for i, b in enumerate(body, 1)]

    return pack(cut_before(text, _NOTE_MARKS), most, too_big=parts)


def split_notes(df: DataFrame, max_len: int = R.MAX_SEGMENT) -> DataFrame:
    """Notes packed to max_len; a note too long becomes labelled parts."""
    return _packed(df, lambda t: _split_notes(t, max_len))


def hard_slice(df: DataFrame, max_len: int = R.MAX_SEGMENT) -> DataFrame:
    """Rows (…, segment_position, segment_count, text): texts over max_len in slices of half of it, others whole."""
    n, step = F.length("text"), max(1, max_len // 2)
    cut = F.transform(F.sequence(F.lit(1), n, F.lit(step)), lambda i: F.substring(F.col("text"), i, F.lit(step)))
    pieces = F.when(F.coalesce(n, F.lit(0)) == 0, F.array().cast("array<string>")).when(n > max_len, cut).otherwise(F.array("text"))
    with_count = df.withColumn("pieces", pieces).withColumn("segment_count", F.size("pieces"))
    return exploded(with_count, position="segment_position")


def segment_documents(df: DataFrame, max_len: int = R.MAX_SEGMENT) -> dict[str, DataFrame]:
    """segments (doc_id, segment_position, kind, text), preserved (doc_id, kind, key, text) and stats, a row a document.

    Notes come off first, and preserved notes are read there, all else in the main text, one row a key; the main text is cut by section ids, else by paragraphs, else by structure.
    """

    def main(t: str) -> list[str]:
        found = re.findall(r"(?s)C\.F\.\d+\.\d+\.\d+\s.+?(?=C\.F\.\d+\.\d+\.\d+\s|$)", t)
        if not found:
            found = cut_before(t, _PARAGRAPH_MARKS)
            found = pack(found, max_len, too_big=lambda p: _split_structured(p, max_len)) if len(found) > 1 else _split_structured(t, max_len)
        return [s for f in found for s in (slices(f, max(1, max_len // 2)) if len(f) > max_len else [f])]

    def split(t: str) -> tuple[str, str]:
        m = re.search(r"NOTER:|\nNoter\n", t) or re.compile(r"\n\d{3}\s+").search(t, len(t) // 2)
        return (t[: m.start()], t[m.start() if m[0][1:2].isdigit() else m.end() :]) if m else (t, "")

    def whole(t: str) -> list[dict]:
        head, notes = split(t)
        rows = [{"kind": "main", "text": s} for s in main(head)] if head else []
        return rows + [{"kind": "notes", "text": s} for s in _split_notes(notes, max_len)]

    row = T.StructType([T.StructField("kind", _STRING), T.StructField("text", _STRING)])
    cut = map_texts(df.select("doc_id", "text"), whole, row)
    segments = cut.select("doc_id", F.posexplode("pieces").alias("segment_position", "p")).select("doc_id", "segment_position", "p.kind", "p.text")
    kept = [("notes", r"(?s)(?:\n|\[NOTE:)(\d{3})(?:\]|\s+)([^\n]+(?:\n(?!\d{3})[^\n]+)*)"), ("paragraphs", r"(?s)(§\s+\d+[A-Za-z]?)(.*?)(?=§\s+\d+|$)"), ("sections", rf"(?s)({R.SECTION_ID})\s+(.+?)(?={R.SECTION_ID}|$)"), ("examples", r"(?s)(Eksempel(?:\s+\d+)?):(.*?)(?=\n\n\w|Eksempel(?:\s+\d+)?:|$)")]

    def rows_of(kind: str, pattern: str) -> Column:
        """What stands last under a key counts; notes are read from the notes, all else from the main text."""
        part = F.col("notes" if kind == "notes" else "main")
        found = F.arrays_zip(F.regexp_extract_all(part, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(part, F.lit(pattern), F.lit(2)).alias("text"))
        rows = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["key"].alias("key"), F.trim(x["text"]).alias("text")))
        keys = F.transform(rows, lambda r: r["key"])
        return F.filter(rows, lambda r, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), r["key"]))

    @F.pandas_udf("main string, notes string")
    def halves(texts: pd.Series) -> pd.DataFrame:
        cut = [split(t or "") for t in texts]
        return pd.DataFrame({"main": [c[0] for c in cut], "notes": ["\n" + c[1] for c in cut]})

    preserved = df.select("doc_id", halves("text").alias("p")).select("doc_id", "p.main", "p.notes").select("doc_id", F.inline(F.concat(*(rows_of(k, p) for k, p in kept))))
    lengths = segments.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum((F.col("kind") == "notes").cast("long")).alias("note_segments"), F.max(F.length("text")).alias("longest"))
    kinds = preserved.groupBy("doc_id").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(k) for k, _ in kept))
    return {"segments": segments, "preserved": preserved, "stats": lengths.join(kinds, "doc_id", "left").na.fill(0)}


def extract_sections(df: DataFrame) -> DataFrame:
    """Rows (doc_id, section_order, section_id, title, content, stykker): by section ids, else by § n."""
    pair = lambda p: F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("id"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("content"))
    ids = pair(r"(?s)(C\.F\.\d+\.\d+\.\d+)\s+(.+?)(?=C\.F\.\d+\.\d+\.\d+|$)")
    paras = pair(r"(?s)(§\s+\d+[a-z]?)\s+(.+?)(?=§\s+\d+|$)")
    rows = df.select("doc_id", F.posexplode(F.when(F.size(ids) > 0, ids).otherwise(paras)).alias("section_order", "s"))
    line = F.trim(F.substring_index(F.col("s.content"), "\n", 1))
    return rows.select("doc_id", "section_order", F.col("s.id").alias("section_id"), F.when(F.length(line) < 100, line).otherwise("").alias("title"), F.trim("s.content").alias("content"), F.regexp_extract_all(F.col("s.content"), F.lit(r"([Ss]tk\.\s+\d+)[.\s]"), F.lit(1)).alias("stykker"))


# Fixed value: a heading on a line of its own.
_HEADING = re.compile(r"\n([A-Z][a-zæøåA-ZÆØÅ \t]+)(?:\n|$)")


def split_subsections(df: DataFrame) -> DataFrame:
    """Rows (…, position, subsection, text): cut at heading lines; what stands before the first is 'Indhold'."""

    def run(t: str) -> list[dict]:
        out, name, at = [], "Indhold", 0
        for m in _HEADING.finditer(t):
            out.append({"subsection": name, "text": t[at : m.start()].strip()})
            name, at = m[1].strip(), m.end()
        return [r for r in [*out, {"subsection": name, "text": t[at:].strip()}] if r["text"]]

    kind = T.StructType([T.StructField("subsection", _STRING), T.StructField("text", _STRING)])
    rows = exploded(map_texts(df, run, kind), value="p")
    return rows.select(*[c for c in rows.columns if c not in ("p", "text")], "p.subsection", "p.text")


_BREAKS = [(score, re.compile("|".join(marks), re.M)) for score, marks in ((10, R.STRONG_BREAKS), (5, R.MEDIUM_BREAKS), (2, R.WEAK_BREAKS))]


def break_score(paragraph: str) -> int:
    return next((score for score, marks in _BREAKS if marks.search(paragraph)), 0)


def by_meaning(text: str, target: int) -> list[str]:
    parts = paragraphs(text)
    scores = [break_score(p) for p in parts]
    out: list[str] = []
    if not any(scores[1:]):
        out = pack(parts, int(1.5 * target), "\n\n")
    else:
        cur = ""
        for p, s in zip(parts, scores):
            fits = len(cur) + len(p) <= target
            if cur and s and not (s < 5 and len(cur) < 0.4 * target and fits):
                out.append(cur)
                cur = p
            else:
                cur = f"{cur}\n\n{p}" if cur else p
        out += [cur] if cur else []
    return [x for o in out for x in (by_size(o, target) if len(o) > 1.5 * target else [o])]


def semantic_split(df: DataFrame, target: int = R.TARGET) -> DataFrame:
    """Rows (…, position, text): cut where a paragraph opens a rule, exception, example …; weak marks cut only larger parts."""
    return exploded(map_texts(df, lambda t: by_meaning(t, target), _STRING))


def basic_chunks(df: DataFrame, target: int = R.TARGET) -> DataFrame:
    """Rows (…, position, text, chunk_type): paragraphs, those over target packed by sentences; short 'Se også' and 'Bemærk' texts stay whole."""

    def run(t: str) -> list[dict]:
        for mark, kind in (("Se også", "reference"), ("Bemærk", "note")):
            if t.startswith(mark) and len(t) <= target:
                return [{"text": t, "chunk_type": kind}]
        out = [x for p in paragraphs(t) for x in (pack(sentences(p), target, strict=True) if len(p) > target else [p])]
        return [{"text": x, "chunk_type": "eksempel" if x.startswith("Eksempel") or "eksempel" in x[:100].lower() else "text"} for x in out]

    kind = T.StructType([T.StructField("text", _STRING), T.StructField("chunk_type", _STRING)])
    rows = exploded(map_texts(df, run, kind), value="p")
    return rows.select(*[c for c in rows.columns if c not in ("p", "text")], "p.text", "p.chunk_type")


_EXAMPLES = tuple(f"(?s){p}" for p in R.EXAMPLE_WORDING)
_IMPLICIT = f"(?sU){R.IMPLICIT_EXAMPLE}"


def extract_examples(df: DataFrame) -> DataFrame:
    """Rows (doc_id, example_num, content): introduced examples, then implicit ones of over 100 characters, numbered i1, i2 …"""
    found = F.array_distinct(F.transform(F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in _EXAMPLES)), F.trim))
    implied = F.filter(F.transform(F.regexp_extract_all("text", F.lit(_IMPLICIT), F.lit(1)), F.trim), lambda x: F.length(x) > 100)
    named = F.transform(found, lambda x, i: F.struct(F.coalesce(F.nullif(F.regexp_extract(x, r"Eksempel\s+(\d+)", 1), F.lit("")), (i + 1).cast("string")).alias("example_num"), x.alias("content")))
    more = F.transform(implied, lambda x, i: F.struct(F.concat(F.lit("i"), (i + 1).cast("string")).alias("example_num"), x.alias("content")))
    return df.select("doc_id", F.inline(F.concat(named, more)))


_RULES = tuple(f"(?s){p}" for p in R.RULE_WORDING)


def related_rule(df: DataFrame, text: str = "text", example: str = "content") -> DataFrame:
    """df with related_rule: the last rule before the example, cut to 300 characters, else the last paragraph of 31 to 299."""
    before = F.substring(F.col(text), F.lit(1), F.instr(F.col(text), F.col(example)) - 1)
    last = F.coalesce(*(F.element_at(F.regexp_extract_all(before, F.lit(p), F.lit(1)), F.when(F.regexp_like(before, F.lit(p)), F.lit(-1))) for p in _RULES))
    cut = F.when(F.length(last) > 300, F.concat(F.substring(last, 1, 300), F.lit("..."))).otherwise(last)
    tail = F.trim(F.element_at(F.filter(F.split(before, "\n\n"), lambda p: F.trim(p) != ""), F.when(F.trim(before) != "", F.lit(-1))))
    return df.withColumn("related_rule", F.coalesce(cut, F.when((F.length(tail) > 30) & (F.length(tail) < 300), tail)))


_TABLES = tuple(f"(?s){p}" for p in R.CASE_TABLE_WORDING)


def extract_case_tables(df: DataFrame) -> DataFrame:
    """Rows (doc_id, content, case_references, chunk_type 'oversigt') of overviews that hold a case reference."""
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in _TABLES))
    rows = df.select("doc_id", F.explode(found).alias("content")).withColumn("case_references", refs_fn.case_refs(F.col("content")))
    return rows.where(F.size("case_references") > 0).withColumn("chunk_type", F.lit("oversigt"))


def chunk_ids(df: DataFrame) -> DataFrame:
    """df with a stable chunk_id: section, subsection, kind and a hash of the first 50 characters."""
    kind = F.when(F.coalesce(F.col("is_example"), F.lit(False)), "example").otherwise(F.coalesce("chunk_type", F.lit("text")))
    return df.withColumn("chunk_id", F.concat_ws("_", "section", "subsection", kind, F.xxhash64(F.substring("content", 1, 50))))


def document_title(text: Column) -> Column:
    """What follows the first four-part section id within the first 1000 characters."""
    return F.nullif(F.trim(F.regexp_extract(F.substring(text, 1, 1000), r"[A-Z]\.[A-Z]\.\d+\.\d+\s+(.*?)(?:\n|$)", 1)), F.lit(""))


def _sections(text: str, _: int) -> list[str]:
    return re.findall(rf"(?s){R.SECTION_ID}\s.+?(?={R.SECTION_ID}\s|$)", text) or [text]


_WAYS = {
    "paragraphs": lambda t, most: pack(cut_before(t, _PARAGRAPH_MARKS), most, too_big=lambda p: _split_structured(p, most)),
    "guidance_main": lambda t, most: pack(cut_before(t, _GUIDANCE_MARKS), most),
    "circular": lambda t, most: pack(cut_before(t, _CIRCULAR_MARKS), most),
    "sections": _sections,
}


def clean_and_segment(docs: DataFrame, rules: dict[str, R.Rules] = R.RULES, max_len: int = R.MAX_SEGMENT) -> DataFrame:
    """Each document (doc_id, doc_type, text) by its type's cleaner and segmenter; an unknown type counts as 'generisk'.

    One pass over docs: the type picks the cleaner in an expression, and the segmenter in the packer's task.
    """
    of = lambda f: F.coalesce(*(F.when(F.col("doc_type") == t, F.lit(f(r))) for t, r in rules.items()), F.lit(f(rules["generisk"])))
    named = docs.select("doc_id", "doc_type", "text", of(lambda r: r.cleaner).alias("_cleaner"), of(lambda r: r.segmenter).alias("_way"))
    cleaned = F.coalesce(*(F.when(F.col("_cleaner") == n, run(F.col("text"))) for n, run in text_fn.CLEANERS.items()))

    @F.pandas_udf(T.ArrayType(_STRING))
    def cut(ways: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_WAYS[w](t, max_len) if t else [] for w, t in zip(ways, texts)], dtype=object)

    rows = named.select("doc_id", "doc_type", cut("_way", cleaned).alias("pieces"))
    return exploded(rows, position="segment_position").select("doc_id", "doc_type", "segment_position", "text")
