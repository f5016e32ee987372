"""Queries of what conversions and runs report: how to look for terms, pages read badly, latencies of late."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.registry import query, read

#: Share of a page's characters below which it counts as read badly; observations that a latency is taken over. Fixed values.
LEAST_COVERED, OBSERVED = 0.95, 20


def extraction_strategy(cased: Column, caseless: Column) -> Column:
    """Terms are looked for by capitals where letters with case prevail, else by recurrence, ties and no letters too."""
    return F.when(cased > caseless, "capitalization").otherwise("recurrence")


@query(r"""SELECT source, CAST(sum(c) AS BIGINT) AS cased, CAST(sum(n - c) AS BIGINT) AS caseless, CASE WHEN sum(c) > sum(n - c) THEN 'capitalization' ELSE 'recurrence' END AS strategy FROM (
SELECT source, len(regexp_extract_all(coalesce(text, ''), '[\p{Lu}\p{Ll}]')) AS c, len(regexp_extract_all(coalesce(text, ''), '\p{L}')) AS n FROM documents) GROUP BY source""")
def extraction_strategies(spark, d):
    """For each source as a book, whose letters add up over its texts."""
    count = lambda p: F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)).cast("long")
    rows = read(spark, d, "documents").select("source", count(r"[\p{Lu}\p{Ll}]").alias("c"), count(r"\p{L}").alias("n"))
    sums = rows.groupBy("source").agg(F.sum("c").alias("cased"), F.sum(F.col("n") - F.col("c")).alias("caseless"))
    return sums.withColumn("strategy", extraction_strategy(F.col("cased"), F.col("caseless")))


def visible(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, T.SPACE + "+", "")).cast("long")


def low_confidence(chars: Column, running: Column, baseline: Column, image_only: Column) -> Column:
    """Whether a page is an image alone, or was read with too few of its characters; those of running heads count as read."""
    return image_only | F.when(baseline > 0, (chars + running) / baseline < LEAST_COVERED).otherwise(False)


@query(rf"""WITH b AS (SELECT doc_id, unnest(pages) AS page_text, generate_subscripts(pages, 1) - 1 AS page FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(12)) AS pages FROM documents)),
c AS (SELECT doc_id, page, length(regexp_replace(page_text, '\s', '', 'g')) AS baseline, length(regexp_replace(regexp_replace(page_text, '[0-9\p{{P}}]', '', 'g'), '\s', '', 'g')) AS chars FROM b)
SELECT doc_id, CAST(page AS BIGINT) AS page, baseline, chars, CASE WHEN baseline > 0 THEN CAST(chars AS DOUBLE) / baseline < CAST({LEAST_COVERED} AS DOUBLE) ELSE false END AS low FROM c""")
def page_confidence(spark, d):
    """Pages of a text end at form feeds; a reading without digits and punctuation is held against them."""
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("page", "page_text"))
    rows = rows.select("doc_id", F.col("page").cast("long").alias("page"), visible(F.col("page_text")).alias("baseline"), visible(F.regexp_replace("page_text", r"[0-9\p{P}]", "")).alias("chars"))
    return rows.withColumn("low", low_confidence(F.col("chars"), F.lit(0), F.col("baseline"), F.lit(False)))


def rolling_p95(latency: Column, window) -> Column:
    """Nearest rank of 95 % among those of the window's observations that have a latency; null without any."""
    seen = F.sort_array(F.collect_list(latency).over(window))  # nulls aren't collected
    return F.try_element_at(seen, F.greatest(F.ceil(F.size(seen) * F.lit(0.95).cast("double")).cast("int"), F.lit(1)))


@query(f"""SELECT event_id, user_id, list_sort(seen)[CAST(ceil(len(seen) * CAST(0.95 AS DOUBLE)) AS BIGINT)] AS p95 FROM (SELECT event_id, user_id, list_filter(
list(CASE WHEN event_type IN ('view', 'click') THEN value END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {OBSERVED - 1} PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS seen FROM events)""")
def latency_of_late(spark, d):
    """After each event, the latency that sizing of batches looks at: over the user's last events, successes alone."""
    late = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1 - OBSERVED, 0)
    rows = read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type").isin("view", "click"), F.col("value")).alias("latency"))
    return rows.select("event_id", "user_id", rolling_p95(F.col("latency"), late).alias("p95"))
