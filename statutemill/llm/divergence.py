"""Source divergence audit: how the words of a language's sources differ, counted in shards by DuckDB.

Tasks count the terms of their texts and send each shard (a hash of language and term) its sums. A shard's SQL adds them
up, drops rare terms, and keeps its counts in a table. Spark sums the groups' totals over all shards. Then each shard's
SQL turns counts into smoothed shares, sums differences for every pair of sources and ranks its own best terms; Spark
adds up the pairs' sums and merges the rankings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import by_group, partitions, stored

#: Documents of its language that a term needs; ranks of terms that are reported; added to every count; the scale of shares.
LEAST_DOCUMENTS, BEST, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Bytes of text that a task counts at a time, and sums it holds before they are sent.
BLOCK_BYTES, HELD_SUMS = 8 << 20, 1_000_000

#: Fixed: a term is a run of letters A-Z, a-z and characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SUMS_SQL = "shard int, data binary"
_SUMS = pa.schema([("shard", pa.int32()), ("data", pa.binary())])
_KEPT_SQL = "shard int, lang string, term string, source string, n long"
_KEPT = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64())])
_PART_SQL = "part string, lang string, source string, item string, value long"
_PART = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _duckdb():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": "false"})


def _packed(rows: pa.Table) -> bytes:
    """Rows as an Arrow stream with names as dictionaries, compressed."""
    for name in ("lang", "source"):
        rows = rows.set_column(rows.schema.get_field_index(name), name, rows[name].combine_chunks().dictionary_encode())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _counter(shards: int):
    """mapInArrow over (lang, source, text): sums of a task's texts, for each shard."""

    def send(con) -> Iterator[pa.RecordBatch]:
        rows = con.sql(f"SELECT CAST(hash(lang, term) % {shards} AS INT) AS shard, lang, term, source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM sums GROUP BY lang, term, source ORDER BY shard, lang, term").to_arrow_table()
        con.execute("DELETE FROM sums")
        for shard, group in by_group(iter(rows.to_batches()), "shard"):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_packed(group.drop_columns(["shard"]))], pa.binary())], schema=_SUMS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        con.execute("CREATE TABLE sums (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        held = 0
        for b in batches:
            at = 0
            while at < len(b):
                upto, size = at + 1, len(b.column("text")[at].as_buffer())
                while upto < len(b) and size < BLOCK_BYTES:
                    size, upto = size + len(b.column("text")[upto].as_buffer()), upto + 1
                block = pa.Table.from_batches([b.slice(at, upto - at)])  # noqa: F841  read by name below
                held += con.execute(f"""
                    INSERT INTO sums SELECT lang, source, term, sum(n), count(*) FROM (
                      SELECT row, any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n FROM (
                        SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS row, * FROM block)
                      ) GROUP BY row, term) GROUP BY lang, source, term""").fetchone()[0]
                at = upto
                if held >= HELD_SUMS:
                    yield from send(con)
                    held = 0
        if held:
            yield from send(con)
        con.close()

    return count


def _keeper(least: int):
    """mapInArrow over blobs sorted by shard: counts of the terms that enough documents of their language hold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        for shard, group in by_group(batches, "shard"):
            con.execute("CREATE OR REPLACE TABLE sums (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT, docs BIGINT)")
            held, most = 0, HELD_SUMS
            for blob in group.column("data"):
                part = _unpacked(blob.as_py())  # noqa: F841
                held += con.execute("INSERT INTO sums SELECT lang, term, source, n, docs FROM part").fetchone()[0]
                if held >= most:  # sums of many tasks become one
                    con.execute("CREATE OR REPLACE TABLE sums AS SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM sums GROUP BY ALL")
                    held = con.execute("SELECT count(*) FROM sums").fetchone()[0]
                    most = max(HELD_SUMS, 2 * held)
            rows = con.sql(f"""
                SELECT lang, term, source, n FROM (SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, sum(sum(docs)) OVER (PARTITION BY lang, term) AS docs FROM sums GROUP BY lang, term, source)
                WHERE docs >= {least} ORDER BY lang, term, source""").to_arrow_table()
            for b in rows.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(b), pa.int32()), *(b.column(c) for c in ("lang", "term", "source", "n"))], schema=_KEPT)
        con.close()

    return keep


def _auditor(shards: int, best: int):
    """mapInArrow over shards' counts and totals: each shard's best terms of each group, and the sums of differences of each pair over the task's shards."""
    share = lambda n, total: f"CAST(1 + ({SCALE}::HUGEINT * ({n} + {SMOOTH})) // ({total}::HUGEINT + {SMOOTH}::HUGEINT * terms) AS BIGINT)"

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        con.execute("CREATE TABLE pairs (lang VARCHAR, source VARCHAR, item VARCHAR, value HUGEINT)")
        for shard, rows in by_group(batches, "shard"):  # noqa: B007  rows is read by name below
            con.execute("CREATE OR REPLACE TABLE counts AS SELECT lang, term, source, n FROM rows WHERE NOT is_total")
            con.execute("CREATE OR REPLACE TABLE totals AS SELECT lang, source, n AS total, lang_total, terms FROM rows WHERE is_total")
            con.execute(f"""
                CREATE OR REPLACE TABLE shares AS WITH t AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term)
                SELECT g.lang, t.term, g.source, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "total")} AS p, {share("t.n", "lang_total")} AS q
                FROM t JOIN totals g ON g.lang = t.lang LEFT JOIN counts c ON c.lang = t.lang AND c.term = t.term AND c.source = g.source""")
            con.execute(f"""
                INSERT INTO pairs SELECT a.lang, a.source, b.source, sum(abs(a.p - b.p)) FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
                UNION ALL SELECT a.lang, a.source, b.source, 0 FROM totals a JOIN totals b ON a.lang = b.lang AND a.source < b.source WHERE hash(a.lang) % {shards} = {shard}""")
            terms = con.sql(f"""
                SELECT 'term' AS part, lang, source, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
                QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {best}""")
            yield from terms.to_arrow_table().cast(_PART).to_batches()
        sums = con.sql("SELECT 'pair' AS part, lang, source, item, CAST(sum(value) AS BIGINT) AS value FROM pairs GROUP BY lang, source, item")
        yield from sums.to_arrow_table().cast(_PART).to_batches()
        con.close()

    return audit


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, best: int = BEST) -> DataFrame:
    """lang, source, part, item, value, rank: for every source of a language, how far each other source of it is (part pair),
    and which terms it has more often than the language as a whole (part term).

    Null lang, source and text are empty. Rows count as documents, repeated ones too. Groups without kept terms take part
    with shares of what is added to every count. A language's sources are compared in all pairs, as the report names every
    one; nothing else grows with their square. Other columns, doc_id among them, are not read.
    """
    n = partitions(docs)
    shards = 4 * n
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    dealt = rows.mapInArrow(_counter(shards), _SUMS_SQL).repartition(n, "shard").sortWithinPartitions("shard")
    kept = stored(dealt.mapInArrow(_keeper(least), _KEPT_SQL), "divergence-counts")
    counts = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").fillna(0, ["n"])
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total")).join(terms, "lang")
    totals = stored(groups.join(langs, "lang", "left").fillna(0, ["lang_total", "terms"]), "divergence-totals")
    sides = kept.select("shard", F.lit(False).alias("is_total"), "lang", "term", "source", "n", F.lit(None).cast("long").alias("lang_total"), F.lit(None).cast("long").alias("terms"))
    sides = sides.unionByName(totals.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_total"), "lang", "source", "n", "lang_total", "terms"), allowMissingColumns=True)
    parts = sides.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_auditor(shards, best), _PART_SQL)
    both = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    summed = parts.groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    merged = summed.select("part", "lang", F.inline(both), "value")
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return merged.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= best)).select("lang", "source", "part", "item", "value", "rank")
