"""T queries: documents as pages, and pages rendered from part rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators import text as T
from contentkit.plans.queries.base import busy_table, query, table


@query("t1_assemble_page_text", r"""WITH items AS (
  SELECT l_orderkey AS doc_id, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, l_extendedprice,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem),
s AS (SELECT doc_id, seq, CASE WHEN l_returnflag = 'N' THEN '' WHEN l_returnflag = 'R' THEN 'part ' || l_partkey || ' ' ELSE 'part ' || l_partkey END AS str,
             CAST(100 - 10 * (seq // 3) AS DOUBLE) AS y FROM items),
w AS (SELECT *, lag(str) OVER (PARTITION BY doc_id ORDER BY seq) AS prev, lag(y) OVER (PARTITION BY doc_id ORDER BY seq) AS prev_y FROM s),
p AS (SELECT doc_id, seq, CASE WHEN abs(y - prev_y) > 2 THEN chr(10) WHEN prev <> '' AND right(prev, 1) <> ' ' THEN ' ' ELSE '' END || str AS piece FROM w),
j AS (SELECT doc_id, string_agg(piece, '' ORDER BY seq) AS raw FROM p GROUP BY 1),
c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS text FROM j)
SELECT doc_id, text, length(text) AS text_length,
       CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS word_count FROM c""")
def t1(spark, sf):
    from pyspark.sql import Window
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    items = table(spark, sf, "lineitem").withColumn("seq", F.row_number().over(order)).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), "seq",
        F.when(F.col("l_returnflag") == "N", "").when(F.col("l_returnflag") == "R", F.concat(part, F.lit(" "))).otherwise(part).alias("str"),
        (100 - 10 * F.floor(F.col("seq") / 3)).cast("double").alias("y"))
    return T.assemble_page_text(items).select(
        "doc_id", "text", F.col("text_length").cast("bigint").alias("text_length"), F.col("word_count").cast("bigint").alias("word_count"))


def _noisy():
    """Document text with page numbers, broken words, wide gaps and misread labels added."""
    body = F.col("text")
    return F.concat(
        F.lit("page 12\n"), F.regexp_replace(body, r"\. ", ".    "), F.lit("\n— 7 —\nSir 10 Oex 12 lnt 9 Wls 3 CR5 hp30\n\n\n\nend\n 42 \n"))


@query("t2_clean_ocr_text")
def t2(spark, sf):
    docs = busy_table(spark, sf, "documents").select("doc_id", _noisy().alias("text"))
    return docs.select("doc_id", T.clean_ocr_text(F.col("text")).alias("clean"))


@query("t2_clean_page_numbers", r"""WITH n AS (SELECT doc_id, 'PAGE 12' || chr(10) || upper(source) || '    ' || lang || chr(10) || ' - 7 -' || chr(10) || chr(10) || chr(10) || chr(10) || 'CR5 HP30 Oex' AS t FROM documents)
SELECT doc_id, upper(source) || '  ' || lang || chr(10) || chr(10) || 'CR 5 HP 30 Dex' AS clean FROM documents""")
def t2_lines(spark, sf):
    text = F.concat(
        F.lit("PAGE 12\n"), F.upper("source"), F.lit("    "), F.col("lang"), F.lit("\n - 7 -\n\n\n\nCR5 HP30 Oex"))
    return busy_table(spark, sf, "documents").select("doc_id", T.clean_ocr_text(text).alias("clean"))


@query("t3_text_quality", r"""WITH d AS (SELECT doc_id, text, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM documents),
w AS (SELECT doc_id, text, length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) / length(text) AS ratio,
             list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS words FROM d WHERE t <> ''),
m AS (SELECT doc_id, ratio, list_sum(list_transform(words, lambda x: length(x))) / len(words) AS mean FROM w),
s AS (SELECT doc_id, CASE WHEN mean < 3 THEN mean / 3 WHEN mean > 8 THEN greatest(0, 1 - (mean - 8) / 10) ELSE 1 END AS a,
             CASE WHEN ratio < 0.5 THEN ratio / 0.5 WHEN ratio > 0.95 THEN greatest(0, 1 - (ratio - 0.95) / 0.05) ELSE 1 END AS b FROM m)
SELECT doc_id, CAST(round(greatest(0, least(1, a * b)), 9) AS DOUBLE) AS quality FROM s
UNION ALL SELECT doc_id, 0 FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) = ''""")
def t3(spark, sf):
    return busy_table(spark, sf, "documents").select("doc_id", F.round(T.text_quality(F.col("text")), 9).alias("quality"))


@query("t4_merge_ocr", """WITH o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN '  ' ELSE ' seen ' || doc_id || ' again ' END AS t, quality FROM labels)
SELECT d.doc_id, CASE WHEN trim(o.t) <> '' THEN trim(o.t) ELSE d.text END AS text,
       coalesce(trim(o.t) <> '', false) AS was_ocr, CASE WHEN trim(o.t) <> '' THEN CAST(o.quality AS DOUBLE) END AS ocr_confidence
FROM documents d LEFT JOIN o USING (doc_id)""")
def t4(spark, sf):
    pages = T.with_text_stats(busy_table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_number"), "text"))
    seen = F.concat(F.lit(" seen "), F.col("doc_id").cast("string"), F.lit(" again "))
    ocr = table(spark, sf, "labels").select(
        "doc_id", F.lit(1).alias("page_number"), F.when(F.col("toxic") == 1, "  ").otherwise(seen).alias("text"),
        F.col("quality").cast("double").alias("confidence"))
    return T.merge_ocr(pages, ocr).select("doc_id", "text", "was_ocr", "ocr_confidence")


def _page(spark, sf):
    """One page per part: a long block under a heading, a short one that is dropped, and a stat block."""
    return busy_table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_number"),
        F.concat(
            F.lit("PART "), F.col("p_partkey").cast("string"), F.lit("\n  A "), "p_name",
            F.lit(" of good make, sold in every port of the outer rim.\n\nSHORT\nfew words\nNext thing\nLevel: "),
            F.col("p_size").cast("string"), F.lit("\nmade by "), "p_brand", F.lit(" and known for its "), "p_type", F.lit(" line  \n\n\nlast words"),
        ).alias("text"))


@query("t5_segment_pages", """SELECT p_partkey AS doc_id, CAST(0 AS INTEGER) AS block_no, CAST(1 AS INTEGER) AS start_line,
  'PART ' || p_partkey || chr(10) || '  A ' || p_name || ' of good make, sold in every port of the outer rim.' AS text FROM part
UNION ALL SELECT p_partkey, 1, 6, 'Next thing' || chr(10) || 'Level: ' || p_size || chr(10) || 'made by ' || p_brand || ' and known for its ' || p_type || ' line' FROM part""")
def t5(spark, sf):
    return T.segment_pages(_page(spark, sf)).select("doc_id", "block_no", "start_line", "text")


@query("t5_segment_documents")
def t5_documents(spark, sf):
    pages = busy_table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")
    return T.segment_pages(pages).select("doc_id", "block_no", "start_line", F.length("text").alias("block_length"))


@query("t6_doc_metadata", """WITH i AS (SELECT c_custkey, replace(lower(c_name), '#', '_') || '.PDF' AS file_name,
  CASE WHEN c_nationkey % 3 = 0 THEN '  ' WHEN c_nationkey % 3 = 1 THEN ' The Complete Guide of ' || c_name ELSE 'Ab' END AS title,
  CASE WHEN c_nationkey % 4 = 0 THEN 'Rogue  Genius team' WHEN c_nationkey % 4 = 1 THEN 'staff' END AS author,
  CASE WHEN c_nationkey % 5 = 0 THEN 'LEGENDARY Games press' ELSE 'tool' END AS producer FROM customer)
SELECT c_custkey, nullif(trim(title), '') AS title,
  CASE WHEN length(trim(title)) > 3 THEN trim(title)
       ELSE 'Customer ' || substr(split_part(file_name, '_', 2), 1, 9) END AS guessed_source_book,
  CASE WHEN author LIKE 'Rogue%' THEN 'Rogue Genius Games' WHEN producer LIKE 'LEG%' THEN 'Legendary Games' ELSE 'Unknown Publisher' END AS guessed_publisher,
  CASE WHEN c_custkey % 2 = 0 THEN '2020-03-04T05:06:07.000Z' ELSE 'spring' END AS creation_date FROM i""")
def t6(spark, sf):
    n = F.col("c_nationkey")
    info = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")), F.lit(".PDF")).alias("file_name"),
        F.when(n % 3 == 0, "  ").when(n % 3 == 1, F.concat(F.lit(" The Complete Guide of "), "c_name")).otherwise("Ab").alias("title"),
        F.when(n % 4 == 0, "Rogue  Genius team").when(n % 4 == 1, "staff").alias("author"),
        F.lit(None).cast("string").alias("subject"), F.lit("writer").alias("creator"),
        F.when(n % 5 == 0, "LEGENDARY Games press").otherwise("tool").alias("producer"),
        F.when(F.col("c_custkey") % 2 == 0, "D:20200304050607+02'00'").otherwise("spring").alias("creation_date"),
        F.lit(None).cast("string").alias("mod_date"))
    return T.doc_metadata(info).select("c_custkey", "title", "guessed_source_book", "guessed_publisher", "creation_date")
