"""A3-A6 and A9-A12 queries over events, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentkit.operators import rollups as R
from contentkit.plans.queries.base import PART_SQL, part_records, pick, pick_sql, query, table

STATUS = ["pending", "accepted", "edited", "seen"]


def _extracted(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("category"),
        pick(STATUS, F.col("event_id") % 4).alias("status"),
        F.when(F.col("value") > 20, "ai").otherwise("regex").alias("detection_method"),
        F.least(F.lit(1.0), F.col("value") / 50).alias("confidence"))


@query("a3_status_counts", f"""WITH e AS (SELECT {pick_sql(STATUS, 'event_id % 4')} AS status FROM events)
SELECT status AS key, count(*) AS count FROM e GROUP BY 1 UNION ALL SELECT 'rejected', 0""")
def a3(spark, sf):
    return R.status_counts(_extracted(spark, sf))


@query("a3_method_counts", """SELECT CASE WHEN value > 20 THEN 'ai' ELSE 'regex' END AS key, count(*) AS count FROM events GROUP BY 1
UNION ALL SELECT 'manual', 0""")
def a3_methods(spark, sf):
    return R.method_counts(_extracted(spark, sf))


@query("a3_category_counts", "SELECT event_type AS category, count(*) AS count FROM events GROUP BY 1")
def a3_categories(spark, sf):
    return R.category_counts(_extracted(spark, sf))


@query("a4_dominant_category", """WITH c AS (SELECT user_id AS doc_id, event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY 1, 2)
SELECT doc_id, event_type AS dominant_category FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS rn FROM c) WHERE rn = 1""")
def a4(spark, sf):
    return R.dominant_category(_extracted(spark, sf), ["doc_id"])


@query("a4_dominant_overall", """SELECT event_type AS dominant_category FROM (
  SELECT event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY 1) ORDER BY n DESC, o LIMIT 1""")
def a4_all(spark, sf):
    return R.dominant_category(_extracted(spark, sf))


@query("a5_run_summary", """WITH p AS (SELECT source, n_chars < 1000 AS was_ocr, CAST(n_chars % 100 AS DOUBLE) AS conf, doc_id FROM documents),
r AS (SELECT source, count(*) AS record_count FROM documents JOIN labels USING (doc_id) GROUP BY 1),
e AS (SELECT source, count(*) AS error_count FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1)
SELECT p.source AS doc_id, count(*) AS total_pages, count_if(was_ocr) AS ocr_pages,
       CAST(round(coalesce(avg(CASE WHEN was_ocr THEN conf END), 0), 6) AS DOUBLE) AS avg_ocr_confidence,
       coalesce(any_value(record_count), 0) AS record_count, coalesce(any_value(error_count), 0) AS error_count,
       CAST(floor(count_if(was_ocr) * 100.0 / count(*) + 0.5) AS BIGINT) AS ocr_pct
FROM p LEFT JOIN r USING (source) LEFT JOIN e USING (source) GROUP BY 1""")
def a5(spark, sf):
    docs = table(spark, sf, "documents").withColumn("page_id", F.col("doc_id"))
    pages = docs.select(
        F.col("source").alias("doc_id"), (F.col("n_chars") < 1000).alias("was_ocr"),
        (F.col("n_chars") % 100).cast("double").alias("ocr_confidence"))
    labels = table(spark, sf, "labels").join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("doc_id"), "toxic")
    out = R.run_summary(pages, labels, labels.filter("toxic = 1"))
    return out.withColumn("avg_ocr_confidence", F.round("avg_ocr_confidence", 6))


@query("a6_confidence_bands", """WITH e AS (SELECT least(CAST(1 AS DOUBLE), value / 50) AS c FROM events)
SELECT CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS count,
       CAST(min(floor(c * 100 + 0.5)) AS BIGINT) AS min_percent, CAST(max(floor(c * 100 + 0.5)) AS BIGINT) AS max_percent
FROM e GROUP BY 1""")
def a6(spark, sf):
    return R.confidence_bands(_extracted(spark, sf))


DISPOSED = ["imported", "updated", "skipped", "failed", "held"]


@query("a9_disposition_stats", f"""WITH e AS (SELECT {pick_sql(DISPOSED, 'user_id % 5')} AS d FROM events)
SELECT count(*) AS total, count_if(d = 'imported') AS imported, count_if(d = 'updated') AS updated,
       count_if(d = 'skipped') AS skipped, count_if(d = 'failed') AS failed FROM e""")
def a9(spark, sf):
    return R.disposition_stats(table(spark, sf, "events").select(pick(DISPOSED, F.col("user_id") % 5).alias("disposition")))


@query("a10_session_rollup", """SELECT count(*) AS total_entries, count_if(event_type <> 'error' AND event_type <> 'view') AS success_count,
       count_if(event_type = 'error') AS failed_count, count_if(event_type = 'view') AS skipped_count,
       CAST(floor(count_if(event_type <> 'error' AND event_type <> 'view') * 100.0 / count(*) + 0.5) AS BIGINT) AS success_rate
FROM events""")
def a10(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(F.when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("success").alias("outcome"))
    return R.session_rollup(rows)


@query("a6_confidence_percent", f"""WITH {PART_SQL} SELECT id, CAST(floor(level / 50.0 * 100 + 0.5) AS BIGINT) AS percent FROM rec""")
def a6_percent(spark, sf):
    return part_records(spark, sf).select("id", R.confidence_percent(F.col("page_number") / 50.0).alias("percent"))
