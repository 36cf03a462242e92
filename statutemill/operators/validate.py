"""Validation of chunks against what their document should hold, and the quality score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules as R
from ..functions.text import normalize_ref_format, squash_key
from .lexicon import missing_by_containment


def missing_notes(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, note_number) of expected notes that no note chunk has."""
    found = chunks.where(F.coalesce("is_note", F.lit(False))).select("doc_id", F.col("note_number").cast("string").alias("note_number")).distinct()
    return expected.select("doc_id", F.col("note_number").cast("string").alias("note_number")).distinct().join(found, ["doc_id", "note_number"], "left_anti")


def missing_paragraphs(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, paragraph, stykke) expected, that no chunk but notes has under normalised spelling; a null stykke means the paragraph."""
    key = lambda c: normalize_ref_format(F.coalesce(F.col(c), F.lit("")))
    law = chunks.where(~F.coalesce("is_note", F.lit(False))) if "is_note" in chunks.columns else chunks
    found = law.select("doc_id", key("paragraph").alias("_p"), key("stykke").alias("_s")).distinct()
    want = expected.select("doc_id", "paragraph", "stykke").distinct().withColumn("_p", key("paragraph")).withColumn("_s", key("stykke"))
    any_part = found.select("doc_id", "_p", F.lit("").alias("_s"))
    return want.join(found.unionByName(any_part).distinct(), ["doc_id", "_p", "_s"], "left_anti").select("doc_id", "paragraph", "stykke")


def context_issues(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, section, subsection, reference): dangling words in the first chunk of a section and subsection."""
    w = W.partitionBy("doc_id", "section", "subsection").orderBy("chunk_position")
    lower = F.lower("content")
    hit = F.coalesce(*(F.nullif(F.regexp_extract(lower, p, 0), F.lit("")) for p in R.DANGLING))
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("reference", hit).where(F.col("reference").isNotNull()).select("doc_id", "chunk_id", "section", "subsection", "reference")


def chunk_sizes(chunks: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Size statistics of each document's chunks."""
    n = F.length(content)
    share = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 1)
    return chunks.groupBy(key).agg(
        F.min(n).cast("long").alias("min_size"), F.max(n).cast("long").alias("max_size"), F.round(F.avg(n), 1).alias("avg_size"), F.percentile(n, 0.5).alias("median_size"),
        share(n < R.TOO_SMALL).alias("pct_too_small"), share(n > R.TOO_LARGE).alias("pct_too_large"),
    )


def processing_stats(chunks: DataFrame) -> DataFrame:
    """For each document: chunks, those that are examples, those with law and with case references, and sizes."""
    some = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(-1)) > 0)
    n = F.length("content")
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.coalesce("is_example", F.lit(False))).alias("examples"), some("law_references").alias("law_refs"),
        some("case_references").alias("case_refs"), F.avg(n).alias("avg_size"), F.stddev_pop(n).alias("std_size"), F.min(n).cast("long").alias("min_size"), F.max(n).cast("long").alias("max_size"),
    )


def grams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


#: Different heads of a document that are joined with each other; more are compared in blocks of BLOCK_HEADS.
FEW_HEADS, BLOCK_HEADS = 64, 1024


def redundancy(chunks: DataFrame, key: str = "doc_id", content: str = "content", few: int = FEW_HEADS, block: int = BLOCK_HEADS) -> DataFrame:
    """(key, n_chunks, redundancy): mean over pairs of a document's chunks of their similarity, from the first 200 characters.

    1 where one holds the other; else the overlap of their 3-grams where it is over a half, else 0. Similarities are summed
    as millionths, in any order the same. Chunks of one head count by their number, so heads are compared once. Those of a
    large document are compared in pairs of blocks, as sets of bits; no row is made for a pair of heads. Each pair is
    weighed exactly: the rarest half of 3-grams, which bounds could go by, is common to most pairs of legal texts.
    """
    heads = chunks.select(key, F.lower(F.substring(F.coalesce(F.col(content), F.lit("")), 1, 200)).alias("head")).groupBy(key, "head").agg(F.count("*").alias("n"))
    counts = heads.groupBy(key).agg(F.sum("n").alias("n_chunks"), F.count("*").alias("m"), (1_000_000 * F.expr("sum(n * (n - 1) div 2)")).alias("copies"))
    sized = heads.join(counts.select(key, "m"), key)
    sums = _joined_heads(sized.where(F.col("m").between(2, few)), key).unionByName(_blocked_heads(sized.where(F.col("m") > few), key, block))
    total = sums.groupBy(key).agg(F.sum("s").alias("s"))
    pairs = F.col("n_chunks") * (F.col("n_chunks") - 1) / 2
    value = F.when(pairs > 0, (F.coalesce("s", F.lit(0)) + F.col("copies")) / (pairs * 1_000_000)).otherwise(0.0)
    return counts.join(total, key, "left").select(key, "n_chunks", value.alias("redundancy"))


def _joined_heads(heads: DataFrame, key: str) -> DataFrame:
    """(key, s): summed similarities of all pairs of a document's heads."""
    head = heads.select(key, "head", "n", grams(F.col("head")).alias("grams"))
    a, b = head.alias("a"), head.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.head") < F.col("b.head")))
    least = F.least(F.size("a.grams"), F.size("b.grams"))
    shared = F.size(F.array_intersect("a.grams", "b.grams")).cast("long")
    overlap = F.floor(shared * 1_000_000 / F.when(least > 0, least))
    alike = F.when(F.contains("a.head", "b.head") | F.contains("b.head", "a.head"), 1_000_000).when(2 * shared > least, overlap).otherwise(0)
    return pairs.groupBy(F.col(f"a.{key}").alias(key)).agg(F.sum(alike * F.col("a.n") * F.col("b.n")).alias("s"))


def _blocked_heads(heads: DataFrame, key: str, block: int) -> DataFrame:
    """(key, s): as _joined_heads, a row for each pair of blocks."""
    blocks = F.ceil(F.col("m") / block)
    packed = heads.withColumn("blocks", blocks).groupBy(key, "blocks", F.pmod(F.xxhash64("head"), blocks).alias("i")).agg(F.collect_list(F.struct("head", "n")).alias("a"))
    others = packed.select(key, F.col("i").alias("j"), F.col("a").alias("b"))
    pairs = packed.select(key, "i", "a", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j")).join(others, [key, "j"])
    kind = heads.schema[key].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                a, o = (Heads(*(side.field(c).to_pylist() for c in ("head", "n"))) for side in (b.column("a")[i].values, b.column("b")[i].values))
                total = a.against(a) if b.column("i")[i] == b.column("j")[i] else a.against(o)
                yield pa.RecordBatch.from_arrays([b.column(key).slice(i, 1), pa.array([total], pa.int64())], [key, "s"])

    return pairs.select(key, "i", "j", "a", "b").mapInArrow(compare, f"`{key}` {kind}, s long")


class Heads:
    """A block of different heads with how often each comes, and their 3-grams."""

    def __init__(self, heads: list[str], n: list[int]) -> None:
        self.heads, self.n = heads, np.array(n, np.int64)
        points = [np.frombuffer(h.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for h in heads]
        self.grams = [np.unique((p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:]) if len(p) > 2 else np.empty(0, np.uint64) for p in points]
        self.sizes = np.array([len(g) for g in self.grams], np.int64)

    def _bits(self, known: np.ndarray) -> np.ndarray:
        """Heads x words: which of the known grams each has."""
        bits = np.zeros((len(self.heads), -(-max(1, len(known)) // 64) * 64), bool)
        for row, g in zip(bits, self.grams):
            row[np.searchsorted(known, g)] = True
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def against(self, other: Heads) -> int:
        """Summed similarities, in millionths, of all pairs of one's heads with the other's; with itself, of each pair once."""
        known = np.unique(np.concatenate([*self.grams, *other.grams]))
        mine, theirs = self._bits(known), other._bits(known)
        shared = np.zeros((len(mine), len(theirs)), np.int64)
        for w in range(mine.shape[1]):
            shared += np.bitwise_count(mine[:, w, None] & theirs[None, :, w])
        least = np.minimum(self.sizes[:, None], other.sizes[None])
        alike = np.where(2 * shared > least, shared * 1_000_000 // np.maximum(least, 1), 0)
        # a head that holds another has all its grams; only heads too short for a gram are looked for as texts
        for i in np.flatnonzero(self.sizes == 0):
            alike[i] = [1_000_000 * (self.heads[i] in h or h in self.heads[i]) for h in other.heads]
        for j in np.flatnonzero(other.sizes == 0):
            alike[:, j] = [1_000_000 * (other.heads[j] in h or h in other.heads[j]) for h in self.heads]
        weighed = alike * self.n[:, None] * other.n[None]
        return int(np.triu(weighed, 1).sum() if other is self else weighed.sum())


def score(chunks: DataFrame, notes: DataFrame, structure: DataFrame, exceptions: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each document of chunks: counts of what is missing, sizes, redundancy, score of 0 to 10 and status."""
    count = lambda d, name: d.groupBy("doc_id").agg(F.count("*").alias(name))
    parts = [
        count(missing_notes(notes, chunks), "missing_notes"),
        count(missing_paragraphs(structure, chunks), "missing_paragraphs"),
        count(missing_by_containment(exceptions, chunks.withColumnRenamed("legal_exceptions", "exception"), "exception"), "missing_exceptions"),
        count(missing_by_containment(groups, chunks.withColumnRenamed("affected_groups", "grp"), "grp"), "missing_groups"),
        count(context_issues(chunks), "context_issues"),
        redundancy(chunks).select("doc_id", "redundancy"),
    ]
    out = chunk_sizes(chunks)
    for p in parts:
        out = out.join(p, "doc_id", "left")
    out = out.na.fill(0, ["missing_notes", "missing_paragraphs", "missing_exceptions", "missing_groups", "context_issues"])
    return with_score(out)


def with_score(counts: DataFrame) -> DataFrame:
    """counts with score and status. Points are whole millionths, so that a score on the edge of rounding is the same anywhere."""
    c = F.col
    tenths = F.round((c("pct_too_small") + c("pct_too_large")) * 10).cast("long")
    surplus = F.floor(c("redundancy") * 1_000_000).cast("long") - 200_000
    lost = 200_000 * c("missing_notes") + 100_000 * c("missing_paragraphs") + 150_000 * c("missing_exceptions") + 100_000 * c("missing_groups") + 250_000 * c("context_issues") + 2_000 * F.greatest(F.lit(0), tenths - 100) + 10 * F.greatest(F.lit(0), surplus)
    points = F.greatest(F.lit(0), F.lit(10_000_000) - lost)
    bad = c("missing_notes") + c("missing_paragraphs") + c("missing_exceptions") + c("missing_groups") + c("context_issues") > 0
    return counts.withColumn("score", F.floor((points + 50_000) / 100_000) / F.lit(10.0)).withColumn("status", F.when(bad, "warning").otherwise("ok"))


def improvement_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Scores and counts of two score() frames side by side, with the gain."""
    side = lambda d, p: d.select("doc_id", *(F.col(c).alias(f"{c}_{p}") for c in ("score", "missing_paragraphs", "context_issues")))
    return side(before, "before").join(side(after, "after"), "doc_id", "full_outer").withColumn("gain", F.round(F.col("score_after") - F.col("score_before"), 1))


def repair_formats(chunks: DataFrame, structure: DataFrame) -> DataFrame:
    """chunks with paragraph and stykke in the summary's spelling, where their squashed keys agree."""
    para = structure.select("doc_id", squash_key(F.col("paragraph")).alias("_pk"), F.col("paragraph").alias("_p")).groupBy("doc_id", "_pk").agg(F.min("_p").alias("_p"))
    stk = structure.where("stykke is not null").select("doc_id", squash_key(F.col("paragraph")).alias("_pk"), squash_key(F.col("stykke")).alias("_sk"), F.col("stykke").alias("_s")).groupBy("doc_id", "_pk", "_sk").agg(F.min("_s").alias("_s"))
    keyed = chunks.withColumn("_pk", squash_key(F.col("paragraph"))).withColumn("_sk", squash_key(F.col("stykke")))
    out = keyed.join(para, ["doc_id", "_pk"], "left").join(stk, ["doc_id", "_pk", "_sk"], "left")
    return out.withColumn("paragraph", F.coalesce("_p", "paragraph")).withColumn("stykke", F.coalesce("_s", "stykke")).select(*chunks.columns)


def _lacks_phrase() -> Column:
    """Whether a note (note_number, got) lacks one of its key phrases."""
    lower = F.lower("got")
    lacks = F.lit(False)
    for number, phrases in R.NOTE_PHRASES.items():
        lacks = lacks | ((F.col("note_number") == number) & ~F.forall(F.array(*map(F.lit, phrases)), lambda p: F.contains(lower, F.lower(p))))
    return lacks


def note_check(chunks: DataFrame, preserved: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(doc_id, note_number, verdict): each preserved note against the text of its chunks, in order.

    missing; truncated below 0.9 of the length; modified above 1.5 of it, or without a phrase that rules.NOTE_PHRASES asks
    of it; else complete. Note chunks whose number is not expected (not preserved, if expected is not given) are modified.
    """
    notes = chunks.where(F.coalesce("is_note", F.lit(False))).withColumn("note_number", F.col("note_number").cast("string"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_position", F.regexp_replace("content", r"\[NOTE:\d+\]\s*", "").alias("t"))))
    text = notes.groupBy("doc_id", "note_number").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("got"))
    want = preserved.where("kind = 'notes'").select("doc_id", F.col("key").cast("string").alias("note_number"), F.col("text").alias("want"))
    ratio = F.length("got") / F.length("want")
    verdict = F.when(F.col("want").isNull(), "modified").when(F.col("got").isNull(), "missing").when(ratio < 0.9, "truncated").when(ratio > 1.5, "modified").when(_lacks_phrase(), "modified").otherwise("complete")
    out = text.join(want, ["doc_id", "note_number"], "full_outer").withColumn("verdict", verdict)
    if expected is not None:
        named = expected.select("doc_id", F.col("note_number").cast("string").alias("note_number")).distinct().withColumn("_e", F.lit(True))
        out = out.join(named, ["doc_id", "note_number"], "left").where("want is not null or _e is null")
    return out.select("doc_id", "note_number", "verdict")


def note_summary(checked: DataFrame) -> DataFrame:
    """doc_id, n_complete and sorted lists of missing, truncated and modified notes."""
    listed = lambda v: F.sort_array(F.collect_list(F.when(F.col("verdict") == v, F.col("note_number")))).alias(v)
    return checked.groupBy("doc_id").agg(F.count_if(F.col("verdict") == "complete").alias("n_complete"), *map(listed, ("missing", "truncated", "modified")))
