"""Filters, deduplication and ordering of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import classify

def _some(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(-1)) > 0


def _note() -> Column:
    return F.coalesce(F.col("is_note"), F.lit(False))


#: Named filters over chunks.
FILTERS = {
    "law_only": lambda: ~_note(),
    "notes_only": _note,
    "with_cross_references": lambda: _some("fortolkningsbidrag") | _some("note_reference"),
    "temporary": lambda: F.col("legal_status") == "midlertidig",
    "with_exceptions": lambda: _some("legal_exceptions"),
    "with_groups": lambda: _some("affected_groups"),
    "without_references": lambda: ~_note() & ~_some("fortolkningsbidrag"),
    "high_priority": lambda: F.col("priority") == "høj",
    "complex": lambda: F.col("complexity") == "kompleks",
}


def named_filter(chunks: DataFrame, name: str) -> DataFrame:
    return chunks.where(FILTERS[name]())


def text_filter(chunks: DataFrame, needle: str) -> DataFrame:
    """Chunks with the needle, as it stands and whatever its case, in paragraph, stykke, note number, content, a concept or a group."""
    want = F.lit(needle.lower().strip())
    fields = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), want) for c in ("paragraph", "stykke", "note_number", "content")]
    lists = [F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), want)), F.lit(False)) for c in ("concepts", "affected_groups")]
    found = F.lit(False)
    for f in fields + lists:
        found = found | f
    return chunks.where(found)


def overview(chunks: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows of chunks, in order, for a table: type label, 100 characters, joined lists."""
    return (
        chunks.orderBy("doc_id", "chunk_position")
        .limit(rows)
        .select(
            "doc_id",
            "chunk_position",
            F.when(_note(), "Note").otherwise("Lovtekst").alias("type"),
            F.concat(F.substring("content", 1, 100), F.lit("...")).alias("text"),
            *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("paragraph", "stykke")),
            F.array_join(F.coalesce("concepts", F.array().cast("array<string>")), ", ").alias("keywords"),
        )
    )


def law_note_counts(hits: DataFrame, key: str = "query_id") -> DataFrame:
    return hits.groupBy(key).agg(F.count_if(~_note()).alias("n_law"), F.count_if(_note()).alias("n_notes"))


def summary_report(summaries: DataFrame) -> DataFrame:
    """doc_id, themes, first 10 concepts, first 5 synonyms and references, first 10 notes with 100 characters each; joined by ', '."""
    joined = lambda c, n: F.array_join(F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, n), ", ").alias(c)
    notes = F.transform(F.slice(F.array_sort(F.map_entries("notes_overview")), 1, 10), lambda e: F.concat(e["key"], F.lit(": "), F.substring(e["value"], 1, 100)))
    return summaries.select("doc_id", joined("main_themes", 1000), joined("key_concepts", 10), joined("synonyms", 5), joined("references", 5), F.array_join(notes, "\n").alias("notes"))


def drop_empty(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.trim(F.regexp_replace(F.coalesce(F.col("content"), F.lit("")), r"\s+", " ")) != "")


def dedupe_prefix(chunks: DataFrame, order: tuple[str, ...] = ("doc_id", "chunk_position"), exact: bool = False, within: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first chunk, in order, of a document's with the same first 100 characters and length (or the same text, if exact).

    within: columns of which chunks must agree too; none means the whole corpus. Ids travel and whole texts stay: keepers are found over a hash of the key, then kept by a semi-join on the order columns.
    """
    key = F.sha2("content", 256) if exact else F.concat_ws("|", F.xxhash64(F.substring("content", 1, 100)), F.length("content"), F.md5(F.substring("content", 1, 100).cast("binary")))
    slim = chunks.select(*dict.fromkeys([*order, *within]), key.alias("_key"))
    best = slim.groupBy(*within, "_key").agg(F.min(F.struct(*order)).alias("first"))
    return chunks.join(best.select("first.*"), list(order), "left_semi")


def _place(hits: DataFrame) -> list[str]:
    """What decides between equal scores."""
    return [c for c in ("position", "doc_id", "chunk_id") if c in hits.columns]


def best_by_prefix(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """The best-scored hit, then the earliest, of those with the same first 50 characters (head, where hits have it), for each query."""
    w = W.partitionBy(key, "head" if "head" in hits.columns else F.substring("content", 1, 50)).orderBy(F.desc("score"), *_place(hits))
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stamp_positions(chunks: DataFrame) -> DataFrame:
    """chunks with position: their place in the document by segment_position, then chunk_position."""
    return chunks.withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy("segment_position", "chunk_position")) - 1)


def stamp_segments(segments: DataFrame) -> DataFrame:
    return segments.withColumn("segment_count", F.count("*").over(W.partitionBy("doc_id")))


def top_k(hits: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """The k best hits of each query, ties by origin, then place."""
    w = W.partitionBy(key).orderBy(F.desc("score"), "origin", *_place(hits))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def defaults() -> dict[str, Column]:
    """Defaults of fields that a chunk must have."""
    none = F.array().cast("array<string>")
    return {
        "concepts": none, "case_references": none, "affected_groups": none, "legal_exceptions": none, "theme": F.lit(""), "subtheme": F.lit(""),
        "is_example": F.lit(False), "chunk_type": F.lit("text"), "complexity": F.lit("moderat"),
    }


def fill_defaults(chunks: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """chunks with each field of defaults(); missing columns are added."""
    out = {c: F.coalesce(F.col(c), d) if c in chunks.columns else d for c, d in (defaults() | (extra or {})).items()}
    return chunks.withColumns(out)


def optimize(chunks: DataFrame) -> DataFrame:
    """Drop empty, dedupe within each document, fill defaults, score, stamp positions."""
    kept = fill_defaults(dedupe_prefix(drop_empty(chunks)))
    laws = F.size("law_references") if "law_references" in kept.columns else F.lit(0)
    score = classify.retrievability(F.length("content"), laws, F.size("case_references"), F.size("concepts"), F.col("is_example"))
    return kept.withColumn("retrievability", score).withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_position")) - 1)
