"""Classifiers and scalar extractors of chunks and documents: column in, column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def _sum(columns) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c
    return total


def document_type(text: Column) -> Column:
    """2 points a match, 5 for each subtype pattern that occurs, in the first 5000 characters; the best type, or its best subtype; 'generisk' if nothing matches."""
    sample = F.lower(F.substring(text, 1, 5000))
    subs = {t: {s: _sum(F.when(_has(sample, p), 5).otherwise(0) for p in ps) for s, ps in named.items()} for t, (_, named) in R.DOCUMENT_TYPES.items()}
    scores = {t: _sum(2 * _count(sample, p) for p in patterns) + _sum(subs[t].values()) for t, (patterns, _) in R.DOCUMENT_TYPES.items()}
    best = F.greatest(*scores.values())
    out = F.when(best == 0, "generisk")
    for t, score in scores.items():
        if subs[t]:
            top = F.greatest(*subs[t].values())
            name = F.coalesce(*(F.when((top > 0) & (s == top), F.lit(n)) for n, s in subs[t].items()), F.lit(t))
        else:
            name = F.lit(t)
        out = out.when(score == best, name)
    return F.when(text.isNotNull(), out)


def chunk_type(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*(F.when(_has(lower, p), F.lit(t)) for t, p in R.CHUNK_TYPES), F.lit("text"))


def complexity(text: Column, n_law: Column, n_case: Column) -> Column:
    """kompleks above 4 points, moderat above 2, else simpel."""
    size = F.when(F.length(text) > 1000, 2).when(F.length(text) > 500, 1).otherwise(0)
    laws = F.when(n_law > 3, 2).when(n_law > 1, 1).otherwise(0)
    cases = F.when(n_case > 2, 2).when(n_case > 0, 1).otherwise(0)
    words = _sum(F.when(F.lower(text).contains(t), 1).otherwise(0) for t in R.COMPLEX_TERMS)
    points = size + laws + cases + words
    return F.when(points > 4, "kompleks").when(points > 2, "moderat").otherwise("simpel")


def legal_status(text: Column, is_note: Column, law_references: Column) -> Column:
    lower = F.lower(text)
    repealed = F.coalesce(F.exists(law_references, lambda r: F.lower(r).contains("ophævet")), F.lit(False))
    return (
        F.when(F.coalesce(is_note, F.lit(False)) & repealed, "historisk")
        .when(_has(lower, r"(?U)\b(?:ophævet|bortfaldet|udgået|ikke længere gældende)\b"), "ophævet")
        .when(_has(lower, r"(?U)\b(?:midlertidig|tidsbegrænset|gælder indtil|ophører den)\b"), "midlertidig")
        .otherwise("gældende")
    )


def expiry_date(text: Column, status: Column) -> Column:
    found = F.regexp_extract(F.lower(text), r"(?U)(?:indtil|til|ophører|udløber)\s+(?:den\s+)?(\d{1,2}\.?\s+\w+\s+\d{4}|\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})", 1)
    return F.when((status == "midlertidig") & (found != ""), found)


def version_date(text: Column) -> Column:
    """The first of three forms found in the first 500 characters, else ''."""
    head = F.substring(text, 1, 500)
    forms = (r"(?iu)(?:Juridisk vejledning|Version)[\s:]+(\d{4}-\d{2}-\d{2})", r"(?iu)(?:Version|Gældende fra)[\s:]+(\d{1,2}\.\d{1,2}\.\d{4})", r"(?iu)(?:Opdateret|Udgivet)[\s:]+(\d{1,2}/\d{1,2}/\d{4})")
    return F.coalesce(*(F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in forms), F.lit(""))


def is_example(text: Column) -> Column:
    return _has(text, r"(?i)Eksempel:")


def is_example_chunk(text: Column) -> Column:
    """Starts with 'Eksempel', or names an example within its first 100 characters."""
    return text.startswith("Eksempel") | (F.instr(F.lower(F.substring(text, 1, 100)), "eksempel") > 0)


def affected_groups(text: Column, groups: dict[str, tuple[str, ...]] = R.PERSON_GROUPS) -> Column:
    """Groups of which a word stands in the text, in the lexicon's order."""
    lower = F.lower(text)
    named = [F.when(_has(lower, r"(?U)\b(?:" + "|".join(words) + r")\b"), F.lit(g)) for g, words in groups.items()]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


# Wording that names who a rule concerns.
_GROUP_WORDING = (r"(?iu)(?:for|gælder for|omfatter)\s+([^.;,]+?)\s+(?:der|som|når)", r"(?iu)(?:personer|ydere|pligtige|borgere|virksomheder)\s+(?:der|som)\s+([^.;,]+)", r"(?iu)([^.;,]+)\s+(?:er|kan være|anses for)\s+(?:pligtig|omfattet|forpligtet|berettiget)")


def affected_groups_by_wording(text: Column) -> Column:
    """What stands where a rule names its persons, without filler words; of 6 to 49 characters, distinct."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _GROUP_WORDING))
    bare = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"(?U)\b(personer|ydere|pligtige|alle|disse|de|bestemte)\b", "")))
    return F.array_distinct(F.filter(bare, lambda x: (F.length(x) > 5) & (F.length(x) < 50)))


def legal_exceptions(text: Column) -> Column:
    """Clauses worded as exceptions, over 10 characters; one that holds, or is held in, an earlier one is skipped."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in R.EXCEPTIONS))
    long = F.filter(F.transform(found, F.trim), lambda x: F.length(x) > 10)
    add = lambda kept, x: F.when(F.exists(kept, lambda k: F.contains(k, x) | F.contains(x, k)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(long, F.array().cast("array<string>"), add)


def legal_exceptions_distinct(text: Column, lexicon: tuple[str, ...] = ()) -> Column:
    """Clauses worded as exceptions and terms of a lexicon, distinct without regard to case; the first spelling stays."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in R.EXCEPTIONS), lexicon_terms(text, lexicon))
    long = F.filter(F.transform(found, F.trim), lambda x: F.length(x) > 10)
    add = lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(long, F.array().cast("array<string>"), add)


def named_exceptions(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*(F.when(_has(text, p), F.array(*map(F.lit, labels))).otherwise(none) for p, labels in R.NAMED_EXCEPTIONS))))


def lexicon_terms(text: Column, lexicon: tuple[str, ...]) -> Column:
    """Terms that stand in the text, whatever their case."""
    if not lexicon:
        return F.array().cast("array<string>")
    return F.filter(F.array(*map(F.lit, lexicon)), lambda x: F.contains(F.lower(text), F.lower(x)))


# Wording that defines a term.
_DEFINITIONS = (r"(?iu)Ved\s+([^.;,]+)\s+forstås", r"(?iu)([^.;,]+)\s+defineres\s+som", r"(?iu)([^.;,]+)\s+betyder\s+i\s+denne\s+sammenhæng")


def concepts(text: Column, themes: Column, lexicon: tuple[str, ...] = ()) -> Column:
    """First three themes, lexicon terms, defined terms of 4 to 49 characters: distinct, seven at most."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _DEFINITIONS))
    bare = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"(?U)\b(herved|således|dermed|hermed|at)\b", "")))
    defined = F.filter(bare, lambda x: (F.length(x) > 3) & (F.length(x) < 50))
    first = F.slice(F.coalesce(themes, F.array().cast("array<string>")), 1, 3)
    return F.slice(F.array_distinct(F.concat(first, lexicon_terms(text, lexicon), defined)), 1, 7)


def question_types(text: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    lower = F.lower(text)
    return F.array_compact(F.array(*(F.when(_sum(F.when(_has(lower, p), 1).otherwise(0) for p in ps) > 0, F.lit(t)) for t, ps in patterns.items())))


def hierarchy_path(section: Column) -> Column:
    """A.B.1.2.3 gives [A.B.1, A.B.1.2, A.B.1.2.3]; shorter ids give themselves."""
    parts = F.split(section, r"\.")
    deep = F.transform(F.sequence(F.lit(3), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.when(F.coalesce(section, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(parts) < 3, F.array(section)).otherwise(deep)


def hierarchy_level(section: Column) -> Column:
    return F.greatest(F.lit(1), F.size(hierarchy_path(section)))


def themes_of_sections(chunks: DataFrame, section_themes: DataFrame, key_concepts: DataFrame | None = None, default: str = "skatteret") -> DataFrame:
    """chunks with themes: of their section, else of its parent of four parts, of three parts, else the document's first two concepts, else a default.

    section_themes: (doc_id, section_id, themes); key_concepts: (doc_id, key_concepts).
    """
    out, names = chunks, []
    for i, n in enumerate((5, 4, 3)):
        at = section_themes.select(F.col("doc_id").alias(f"_d{i}"), F.col("section_id").alias(f"_s{i}"), F.col("themes").alias(f"_t{i}"))
        own = F.col("section") if n == 5 else F.array_join(F.slice(F.split("section", r"\."), 1, n), ".")
        out = out.join(at, (F.col("doc_id") == F.col(f"_d{i}")) & (own == F.col(f"_s{i}")), "left")
        names.append(f"_t{i}")
    fallback = F.array(F.lit(default))
    if key_concepts is not None:
        out = out.join(key_concepts.select(F.col("doc_id").alias("_dk"), F.slice("key_concepts", 1, 2).alias("_tk")), F.col("doc_id") == F.col("_dk"), "left")
        names.append("_tk")
    found = F.coalesce(*(F.when(F.size(n) > 0, F.col(n)) for n in names), fallback)
    return out.select(*chunks.columns, found.alias("themes"))


def target_size(kind: Column, base: int = R.TARGET) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(int(base * x))) for k, x in R.TYPE_SIZES.items()), F.lit(base))


def _clamped(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6)


def retrievability(length: Column, n_law: Column, n_case: Column, n_concepts: Column, example: Column) -> Column:
    """0.5, up for references, concepts, a size of 800 to 1500 and examples, down for small and very large chunks; 0 to 1."""
    add = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    size = F.when(length.between(800, 1500), 0.2).when(length < 200, -0.2).when(length > 3000, -0.1).otherwise(0.0)
    return _clamped(0.5 + add(n_law > 0, 0.1) + add(n_case > 0, 0.1) + add(n_concepts >= 3, 0.1) + size + add(example, 0.1))


def retrievability_enhanced(text: Column, kind: Column, n_law: Column, n_case: Column, n_concepts: Column, minimum: int = R.MIN_CHUNK, base: int = R.TARGET) -> Column:
    """As retrievability, with sizes relative to the chunk type's target, counts of references, and wording of definitions."""
    n, target = F.length(text), target_size(kind, base)
    size = F.when((n >= minimum) & (n <= target * 1.2), 0.2).when(n > target * 1.5, -0.1).when(n < minimum * 0.8, -0.1).otherwise(0.0)
    wording = F.when(_has(text, r"(?iU)\b(?:består af|defineres som|forståes ved|følger af)\b"), 0.1).otherwise(0.0)
    by_kind = F.when(kind.isin("regel", "definition"), 0.15).when(kind.isin("eksempel", "undtagelse"), 0.1).otherwise(0.0)
    some = lambda c, step, most: F.least(F.lit(most), step * F.coalesce(c, F.lit(0)))
    return _clamped(0.5 + size + some(n_law, 0.05, 0.2) + some(n_case, 0.05, 0.15) + some(n_concepts, 0.03, 0.15) + wording + by_kind)


def reply_key(prompt: Column, model: Column, json_mode: Column) -> Column:
    return F.md5(F.concat(F.substring(prompt, 1, 10000), model, F.when(json_mode, "True").otherwise("False")).cast("binary"))
