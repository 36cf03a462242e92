"""Mixing sources to target weights: iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic. The cells' token weights are raked in turn to the target share
of each source, language and topic; a document is kept with the probability that its cell's calibrated weight asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: shares of tokens to this power, made to sum to 1; 1 leaves a mix as it is, 0 makes it even.
TEMPERATURE = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS, STORE_EVERY = 12, 4
#: The cell that is shortest of its target keeps so many of its documents; all others are thinned in proportion, so that the sample meets the targets.
KEEP = 1.0
#: Probabilities are rounded to so many digits before they are compared, far above the noise of sums in another order.
DIGITS = 6
SEED = "mix"


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")  # a single character needs no regular expression


def form_topic(text: Column, tokens: Column) -> Column:
    """A stand-in where documents carry no topic: the form of a text (table, note, article, longform)."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(F.coalesce(bars, F.lit(0)) * 10 > tokens, "table").when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("longform")


def unit_hash(*key: Column) -> Column:
    """A number in [0, 1) from a key, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def targets_by_temperature(cells: DataFrame) -> dict[str, DataFrame]:
    """For each dimension a frame (value, target): its shares of tokens to the power in TEMPERATURE."""
    out = {}
    for d in DIMENSIONS:
        raised = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(TEMPERATURE[d])).alias("raised"))
        out[d] = raised.select(F.col(d).alias("value"), F.col("raised").alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells with their calibrated share (weight, summing to 1).

    Targets are relative: they are scaled to the values that cells have. A value that no target names keeps no weight.
    """
    for d in DIMENSIONS:
        named = targets[d].select(F.col("value").alias(d), F.col("target").cast("double").alias(f"t_{d}"))
        cells = cells.join(named, d, "left").na.fill(0.0, [f"t_{d}"])
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for i in range(rounds):
        for d in DIMENSIONS:
            held = F.sum("weight").over(W.partitionBy(d))
            cells = cells.withColumn("weight", F.when(held > 0, F.col("weight") / held * F.col(f"t_{d}")).otherwise(0.0))
        if (i + 1) % STORE_EVERY == 0 or i + 1 == rounds:
            cells = stored(cells, "mix-cells")
    total = cells.agg(F.sum("weight").alias("weight"), F.sum("tokens").alias("tokens")).head()  # one row
    return cells.select(
        *DIMENSIONS, "tokens", "n_docs",
        (F.col("weight") / F.lit(total["weight"] or 1.0)).alias("weight"),
        (F.col("tokens") / F.lit(total["tokens"] or 1)).alias("share"),
    )


def _numbered(docs: DataFrame, topic: Column | None) -> DataFrame:
    """docs as a struct (row), doc_id, the three dimensions and n_tokens; each is computed once."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")),
        n_tokens(F.col("text")).alias("n_tokens"),
        *([] if topic is None else [topic.alias("topic")]),
    )
    found = F.col("topic") if topic is not None else form_topic(F.col("row.text"), F.col("n_tokens"))
    return rows.withColumn("topic", F.coalesce(found, F.lit("")))


def rates(numbered: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS, capped: bool = True) -> DataFrame:
    """(source, lang, topic, rate): the probability with which documents of each cell that has tokens are kept; the largest is keep.

    If not capped, how often they are taken on average: over 1 in cells short of their target.
    """
    cells = stored(numbered.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "mix-counts").where("tokens > 0")
    raked = rake(cells, targets or targets_by_temperature(cells), rounds)
    rate = F.col("weight") / F.col("share")
    most = raked.agg(F.max(rate).alias("most")).head()["most"] if capped else 1.0  # one row
    return raked.select(*DIMENSIONS, F.round(F.lit(keep) * (rate / F.lit(most or 1.0)), DIGITS).alias("rate"))


def _drawn(numbered: DataFrame, rate: DataFrame, keep: float) -> DataFrame:
    draw = unit_hash(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    out = numbered.join(rate, list(DIMENSIONS), "left").withColumn("probability", F.coalesce("rate", F.lit(keep)))
    return out.withColumn("kept", draw < F.col("probability"))


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of docs: doc_id, source, lang, topic, n_tokens, probability (6 digits) and kept.

    The draw hangs on doc_id and seed alone, so equal ids agree and a rerun gives the same sample. Null source, language
    or topic count as ''; null and empty texts have no tokens, and a cell without tokens keeps its documents with
    probability keep. An empty table gives an empty result. Other columns are not read.
    """
    read = docs.select("doc_id", "text", *(c for c in ("source", "lang")))
    rows = stored(_numbered(read, topic).drop("row"), "mix-rows")  # a few numbers a document; texts are read once
    return _drawn(rows, rates(rows, targets, keep, rounds), keep).select("doc_id", *DIMENSIONS, "n_tokens", "probability", "kept")


def sample(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs that mix() keeps, all columns. Texts are counted where they lie and are not shuffled."""
    rate = rates(_numbered(docs, topic).drop("row"), targets, keep, rounds)
    return _drawn(_numbered(docs, topic), rate, keep).where("kept").select("row.*")


def resample(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs, all columns, as often as their cells' calibrated weights ask, so that tokens meet the target shares.

    A rate of 1.7 takes a row once and, with probability 0.7, once more; the draw is mix()'s. Texts are not shuffled.
    """
    rate = rates(_numbered(docs, topic).drop("row"), targets, keep, rounds, capped=False)
    drawn = _numbered(docs, topic).join(rate, list(DIMENSIONS), "left").withColumn("probability", F.coalesce("rate", F.lit(keep)))
    draw = unit_hash(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    whole = F.floor("probability")
    times = (whole + (draw < F.col("probability") - whole).cast("int")).cast("int")
    return drawn.withColumn("again", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
