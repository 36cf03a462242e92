"""The greedy packer: order-dependent, so it runs on the pieces of one document inside a task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R


def pack(pieces: Iterable[str], most: int, sep: str = "", sep_always: bool = False, strict: bool = False, too_big: Callable[[str], list[str]] | None = None) -> list[str]:
    """Joins pieces in order while the sum stays within most (below it, if strict).

    sep_always counts the separator for a first piece too. A piece over most by itself is kept whole, or cut by too_big;
    what was gathered before it is given out first.
    """
    out, cur = [], ""
    for p in pieces:
        if too_big is not None and len(p) > most:
            if cur:
                out.append(cur)
            cur = ""
            out += too_big(p)
            continue
        size = len(cur) + len(p) + (len(sep) if cur or sep_always else 0)
        if cur and (size >= most if strict else size > most):
            out.append(cur)
            cur = p
        else:
            cur = cur + sep + p if cur else p
    return out + [cur] if cur else out


_PROTECTED = re.compile(r"(?<![\wæøåÆØÅ])(?:" + "|".join(re.escape(a) for a in R.ABBREVIATIONS) + ")$")


def sentences(text: str) -> list[str]:
    """Cut after . ! ? before white space and a capital, unless a legal abbreviation ends there."""
    out, at = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+(?=[A-ZÆØÅ])", text):
        if not _PROTECTED.search(text, max(0, m.start() - 8), m.start()):
            out.append(text[at : m.start()])
            at = m.end()
    return [s for s in [*out, text[at:]] if s]


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def by_size(text: str, target: int) -> list[str]:
    """Sentences packed to target; one over one and a half times it is cut at commas and colons."""
    pieces: list[str] = []
    for s in sentences(text):
        pieces += re.split(r"(?<=[,:])\s+", s) if len(s) > 1.5 * target else [s]
    return pack(pieces, target, " ")


def slices(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def pack_paragraphs(text: str, most: int) -> list[str]:
    """Blank-line paragraphs packed to most; one too big goes by sentences, a sentence too big by slices of half of it."""
    half = max(1, most // 2)
    whole = lambda s: slices(s, half)
    return pack(paragraphs(text), most, "\n\n", too_big=lambda p: pack(sentences(p), most, " ", too_big=whole))


def cut_before(text: str, pattern: re.Pattern) -> list[str]:
    """The text in pieces, each but the first beginning with a match; a blank first piece is left out."""
    at = [m.start() for m in pattern.finditer(text)]
    pieces = [text[s:e] for s, e in zip([0, *at], [*at, len(text)])]
    return [p for p in pieces if p.strip()]


def map_texts(df: DataFrame, run: Callable[[str], list], schema: T.DataType, text: str = "text", out: str = "pieces") -> DataFrame:
    """df with an array column out: run over each text; null texts give an empty list."""

    @F.pandas_udf(T.ArrayType(schema))
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: run(t) if t else [])

    return df.withColumn(out, each.asNondeterministic()(F.col(text)))


def exploded(df: DataFrame, pieces: str = "pieces", position: str = "position", value: str = "text") -> DataFrame:
    """A row for each piece, with its place from 0; other columns as they are."""
    keep = [c for c in df.columns if c not in (pieces, position, value)]
    return df.select(*keep, F.posexplode(pieces).alias(position, value))

