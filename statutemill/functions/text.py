"""Cleaning of texts: column in, column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, put in pairs:
        text = F.regexp_replace(text, pattern, put)
    return text


# The patterns of the four cleaners, in their order.


def clean_law_text(text: Column) -> Column:
    """Joins hyphenated line breaks, collapses newlines and spaces, sets the spacing of § n and Stk. n."""
    return _replaced(text, (r"([a-zA-Z])-\n([a-zA-Z])", "$1$2"), (r"\n+", "\n"), (r" +", " "), (r"§\s*(\d+[a-zA-Z]?)", "§ $1"), (r"[sS]tk\.\s*(\d+)", "Stk. $1"))


_PAGE = (r"Side \d+ af \d+", "")
_EXAMPLE = (r"(?i)Eks(?:empel)?[:,.]", "Eksempel:")


def clean_guidance(text: Column) -> Column:
    """Drops page numbers and gives examples one mark."""
    return _replaced(text, _PAGE, _EXAMPLE)


def clean_circular(text: Column) -> Column:
    """As clean_guidance; a dot follows two-part numbers before a title."""
    return _replaced(text, _PAGE, (r"(\d+)\.(\d+)(\s+[A-Za-z])", "$1.$2.$3"), _EXAMPLE)


def clean_legal_guidance(text: Column) -> Column:
    """Drops headers, footers and underlines; sets the spacing of jf., Eksempel n:, § n, stk. n, blank lines, spaces and tabs."""
    return _replaced(
        text,
        (r"(?is)Printet fra (?:Karnov|SKAT).*?licensvilkårene", ""),
        (r"(?i)Side \d+ af \d+", ""),
        (r"(?i)(?:Opdateret: |Version: )\d{1,2}\.\d{1,2}\.\d{4}", ""),
        (r"(?i)Copyright © \d{4} (?:Karnov Group|SKAT)", ""),
        (r"(?U)\n([A-Za-z][\w\s]+)\n-+\n", "\n$1\n"),
        (r"Se også\s*\n", "Se også\n"),
        (r"jf\.\s*", "jf. "),
        (r"Bemærk\s*\n", "Bemærk\n"),
        (r"Eksempel\s*(\d+)[:.]", "Eksempel $1:"),
        (r"§\s*(\d+[a-zA-Z]?)", "§ $1"),
        (r"stk\.\s*(\d+)", "stk. $1"),
        (r"\n\s*\n\s*\n", "\n\n"),
        (r" +", " "),
        (r"\t+", " "),
    )


CLEANERS = {"law": clean_law_text, "guidance": clean_guidance, "circular": clean_circular, "legal_guidance": clean_legal_guidance}

# What starts the notes of a text; the first of these that occurs counts.
_NOTE_STARTS = (r"\nNoter\n", r"\nNOTER:\n", r"\n\d{3}\s+?[§A-Za-z]")


def split_main_and_notes(text: Column) -> tuple[Column, Column]:
    """Main text and notes text; a text without notes is all main text."""
    part = lambda i: F.coalesce(*(F.when(F.regexp_like(text, F.lit(p)), F.regexp_extract(text, f"(?s)^(.*?)(?:{p})(.*)$", i)) for p in _NOTE_STARTS), text if i == 1 else F.lit(""))
    return part(1), part(2)


def extract_notes(df: DataFrame, notes: str = "notes_text") -> DataFrame:
    """Rows of df with number and content ([NOTE:n] text) of each note; empty notes are dropped."""
    pattern = r"(?s)(?:\[NOTE:(\d{3})\]|^(\d{3})|\n(\d{3}))\s*(.*?)(?=\n\d{3}|\[NOTE:\d{3}\]|$)"
    each = lambda i: F.regexp_extract_all(notes, F.lit(pattern), F.lit(i))
    rows = df.withColumn("note", F.explode(F.arrays_zip(each(1).alias("a"), each(2).alias("b"), each(3).alias("c"), each(4).alias("text"))))
    number = F.concat("note.a", "note.b", "note.c")
    body = F.trim(F.regexp_replace(F.col("note.text"), r"^\s+|\s+$", ""))
    return rows.withColumn("note_number", number).withColumn("content", body).where("content <> ''").withColumn("content", F.concat(F.lit("[NOTE:"), "note_number", F.lit("] "), "content")).drop("note")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def normalize_ref_format(text: Column) -> Column:
    """A key for comparing references: trimmed, lower case, one space, '§ n' and 'stk. n'."""
    return _replaced(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), (r"\s+", " "), (r"§\s*(\d+[a-z]?)", "§ $1"), (r"stk\.?\s*(\d+)", "stk. $1"))


def squash_key(text: Column) -> Column:
    """A key for repairing formats: lower case, no white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")
