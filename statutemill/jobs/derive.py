"""Legal texts derived from the given tables, for exercising the legal operators: clauses from line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the order), chunk_position, paragraph, stykke, content, section, subsection, concept, is_note, note_number, …"""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    text = lambda c: c.cast("string")
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    number = text(part % 40 + 1)
    content = F.concat(
        F.lit("Ligningslovens § "), number, F.lit(" "), F.chr(65 + supp % 4), F.lit(", stk. "), text(F.col("l_linenumber")), F.lit(" gælder "), F.col("p_name"), F.lit("."),
        F.when(supp % 3 == 0, " Dette gælder ikke for personer i udlandet.").otherwise(""),
        F.when(part % 5 == 0, F.concat(F.lit(" Jf. SKM"), text(F.year("l_shipdate")), F.lit("."), text(order % 900), F.lit(".LSR."))).otherwise(""),
        F.when(part % 11 == 0, " Reglen er midlertidig og gælder indtil den 31. december 2030.").when(part % 13 == 0, " Reglen er ophævet.").otherwise(""),
        F.when(supp % 7 == 0, " En pensionist er omfattet.").otherwise(""),
    )
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ORDER))
    return rows.select(
        order.alias("doc_id"),
        place.cast("long").alias("chunk_position"),
        F.concat(F.lit("§ "), number).alias("paragraph"),
        F.concat(F.lit("Stk. "), text(F.col("l_linenumber"))).alias("stykke"),
        content.alias("content"),
        F.concat(F.lit("C.F."), text(order % 3 + 1), F.lit("."), text(part % 4 + 1), F.lit("."), text(supp % 3 + 1)).alias("section"),
        F.when(part % 2 == 0, "Betingelser").otherwise("Indhold").alias("subsection"),
        F.col("p_brand").alias("concept"),
        (part % 7 == 0).alias("is_note"),
        text(part % 50).alias("note_number"),
        (part % 9 == 0).alias("is_example"),
        F.concat(F.lit("LL § "), number).alias("law_ref"),
        F.concat(F.lit("SKM."), text(F.year("l_shipdate")), F.lit("."), text(order % 900), F.lit(".LSR")).alias("case_ref"),
        (part % 5 == 0).alias("has_case"),
    )


CLAUSES = """clauses AS (
  SELECT l_orderkey AS doc_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS chunk_position,
    '§ ' || (l_partkey % 40 + 1) AS paragraph, 'Stk. ' || l_linenumber AS stykke,
    'Ligningslovens § ' || (l_partkey % 40 + 1) || ' ' || chr(CAST(65 + l_suppkey % 4 AS INT)) || ', stk. ' || l_linenumber || ' gælder ' || p_name || '.'
      || CASE WHEN l_suppkey % 3 = 0 THEN ' Dette gælder ikke for personer i udlandet.' ELSE '' END
      || CASE WHEN l_partkey % 5 = 0 THEN ' Jf. SKM' || year(l_shipdate) || '.' || (l_orderkey % 900) || '.LSR.' ELSE '' END
      || CASE WHEN l_partkey % 11 = 0 THEN ' Reglen er midlertidig og gælder indtil den 31. december 2030.' WHEN l_partkey % 13 = 0 THEN ' Reglen er ophævet.' ELSE '' END
      || CASE WHEN l_suppkey % 7 = 0 THEN ' En pensionist er omfattet.' ELSE '' END AS content,
    'C.F.' || (l_orderkey % 3 + 1) || '.' || (l_partkey % 4 + 1) || '.' || (l_suppkey % 3 + 1) AS section,
    CASE WHEN l_partkey % 2 = 0 THEN 'Betingelser' ELSE 'Indhold' END AS subsection, p_brand AS concept,
    l_partkey % 7 = 0 AS is_note, CAST(l_partkey % 50 AS VARCHAR) AS note_number, l_partkey % 9 = 0 AS is_example,
    'LL § ' || (l_partkey % 40 + 1) AS law_ref, 'SKM.' || year(l_shipdate) || '.' || (l_orderkey % 900) || '.LSR' AS case_ref, l_partkey % 5 = 0 AS has_case
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses in the shape of chunks: ids, lists, structs, defaults."""
    c = clauses(spark, sf_dir)
    none = F.array().cast("array<string>")
    ref = F.struct(F.col("law_ref").alias("ref"), F.lit(True).alias("is_primary"))
    return c.select(
        "doc_id", (F.col("doc_id") * 1000 + F.col("chunk_position")).alias("chunk_id"), "chunk_position", F.lit(0).alias("segment_position"), "paragraph", "stykke", "content", "section", "subsection",
        "is_note", F.when(F.col("is_note"), F.col("note_number")).alias("note_number"), "is_example", F.array("concept").alias("concepts"), F.array(ref).alias("law_references"),
        F.when(F.col("has_case"), F.array("case_ref")).otherwise(none).alias("case_references"), F.when(F.col("has_case"), F.array("case_ref")).otherwise(none).alias("normalized_case_references"),
        F.when(F.col("is_example"), F.array(F.lit("pensionister"))).otherwise(none).alias("affected_groups"), F.when(F.col("is_note"), F.array(F.lit("gælder ikke for personer i udlandet"))).otherwise(none).alias("legal_exceptions"),
        F.when(F.col("is_example"), "lempelse").otherwise("skattepligt").alias("theme"), F.lit("").alias("subtheme"), F.lit("text").alias("chunk_type"), F.lit("moderat").alias("complexity"),
        F.lit("gældende").alias("legal_status"), F.lit(None).cast("string").alias("expiry_date"), F.when(F.col("is_note"), "høj").otherwise("medium").alias("priority"),
        F.when(~F.col("is_note") & F.col("has_case"), F.array("note_number")).otherwise(none).alias("fortolkningsbidrag"),
        F.when(F.col("is_note"), F.array(F.struct("paragraph", "stykke"))).otherwise(F.array().cast("array<struct<paragraph:string,stykke:string>>")).alias("note_reference"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each order's clauses in order, each under its section id, joined by blank lines."""
    c = clauses(spark, sf_dir).withColumn("line", F.concat("section", F.lit(" "), "subsection", F.lit("\n"), "content"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_position", "line")))
    return c.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("text"))


TEXTS = CLAUSES + """,
texts AS (SELECT doc_id, string_agg(section || ' ' || subsection || chr(10) || content, chr(10) || chr(10) ORDER BY chunk_position) AS text FROM clauses GROUP BY doc_id)"""


def guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): orders as guidance; each clause a section with a rule, some with an overview of cases, and an example."""
    c = clauses(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_brand", "p_name").groupBy("p_brand").agg(F.min("p_name").alias("thing"))
    c = c.join(part, F.col("concept") == F.col("p_brand"))
    filler = lambda word, n: F.repeat(F.concat(F.lit(f" {word} "), F.col("thing"), F.lit(",")), n)
    line = F.concat(
        "section", F.lit(" "), "subsection", F.lit("\nRegel for"), filler("om", 24), F.lit(".\n\n"),
        F.when(F.col("has_case"), F.concat(F.lit("Domsoversigt over SKM2020."), F.col("chunk_position").cast("string"), F.lit(".LSR"), filler("ved", 30), F.lit(".\n\n"))).otherwise(""),
        F.lit("Eksempel "), F.col("chunk_position").cast("string"), F.lit(": en borger"), filler("med", 24), F.lit("."),
    )
    parts = F.array_sort(F.collect_list(F.struct("chunk_position", line.alias("line"))))
    return c.groupBy("doc_id").agg(F.concat(F.lit("Version: 2024-01-31 A.B.1.2 Vejledning\n\n"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n")).alias("text"))


#: What guidance_parts() makes of those texts: kind, number, content and rule of each chunk.
GUIDANCE = CLAUSES + """,
g AS (SELECT c.*, thing, 'Regel for' || repeat(' om ' || thing || ',', 24) || '.' AS rule FROM clauses c JOIN (SELECT p_brand, min(p_name) AS thing FROM part GROUP BY p_brand) ON concept = p_brand),
pieces AS (SELECT doc_id, chunk_position, 0 AS n, section, 'eksempel' AS kind, CAST(chunk_position AS VARCHAR) AS example_num, 'Eksempel ' || chunk_position || ': en borger' || repeat(' med ' || thing || ',', 24) || '.' AS content, CASE WHEN length(rule) > 300 THEN substr(rule, 1, 300) || '...' ELSE rule END AS related_rule FROM g
  UNION ALL SELECT doc_id, chunk_position, 1, section, 'oversigt', NULL, 'Domsoversigt over SKM2020.' || chunk_position || '.LSR' || repeat(' ved ' || thing || ',', 30) || '.', NULL FROM g WHERE has_case
  UNION ALL SELECT doc_id, chunk_position, 2, section, 'text', NULL, section || ' ' || subsection || chr(10) || rule, NULL FROM g)"""


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("doc_id", "paragraph", "stykke").distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with every seventh left out."""
    return chunks(spark, sf_dir).where("chunk_id % 7 <> 0")


def questions(spark: SparkSession, sf_dir: str, every: int = 100) -> DataFrame:
    """(query_id, question): one for each order whose key `every` divides."""
    theme = F.when(F.col("o_orderkey") % 200 == 0, "lempelse").otherwise("udlandsophold")
    text = F.concat(F.lit("Hvad siger § "), (F.col("o_orderkey") % 41).cast("string"), F.lit(", stk. "), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit(" om "), theme, F.lit(" og note "), (F.col("o_orderkey") % 60).cast("string"), F.lit("?"))
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey") % every == 0).select(F.col("o_orderkey").alias("query_id"), text.alias("question"))


QUESTIONS = """questions AS (SELECT o_orderkey AS query_id, 'Hvad siger § ' || (o_orderkey % 41) || ', stk. ' || (o_orderkey % 5 + 1) || ' om '
  || CASE WHEN o_orderkey % 200 = 0 THEN 'lempelse' ELSE 'udlandsophold' END || ' og note ' || (o_orderkey % 60) || '?' AS question FROM orders WHERE o_orderkey % 100 = 0)"""
