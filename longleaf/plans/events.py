"""Queries of event logs: runs, rates, and the same state from a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from longleaf.registry import query, read
from longleaf.streaming.control import rates
from longleaf.streaming.run_state import run_state


@query("""WITH b AS (SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type = 'signup'), -1) AS since FROM events GROUP BY user_id),
e AS (SELECT e.* FROM events e JOIN b ON e.user_id = b.user_id AND e.event_id >= b.since),
k AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, ts FROM e)
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS requests_failed, count(DISTINCT k) FILTER (WHERE event_type = 'purchase') AS segments, CAST(coalesce(sum(k) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) AS tokens,
date_diff('microsecond', min(ts), max(ts)) // 1000 AS elapsed_ms,
CASE WHEN date_diff('microsecond', min(ts), max(ts)) // 1000 > 0 THEN round(count(DISTINCT k) FILTER (WHERE event_type = 'purchase') / ((date_diff('microsecond', min(ts), max(ts)) // 1000) / 60000.0::DOUBLE), 6) END AS segments_per_minute FROM k GROUP BY user_id""")
def perf_latest_run(spark, d):
    """What each job's latest run has done and how fast: a segment counts once, however often it ends."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    since = e.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))), F.lit(-1)).alias("since"))
    now = e.join(since, "user_id").filter("event_id >= since")
    is_ = lambda kind: F.col("event_type") == kind
    per = now.groupBy("user_id", "k").agg(F.count_if(is_("error")).alias("failed"), F.max(is_("purchase") & F.col("k").isNotNull()).alias("done"), F.sum(F.when(is_("click"), F.col("k"))).alias("tokens"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    out = per.groupBy("user_id").agg(F.sum("failed").alias("requests_failed"), F.count_if("done").alias("segments"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.timestamp_diff("MILLISECOND", F.min("first"), F.max("last")).alias("elapsed_ms"))
    return out.withColumn("segments_per_minute", F.when(F.col("elapsed_ms") > 0, F.round(F.col("segments") / (F.col("elapsed_ms") / F.lit(60000.0)), 6)))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS jobs FROM events GROUP BY ALL""")
def events_by_hour(spark, d):
    per = read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type", "user_id").agg(F.count("*").alias("n"))
    return per.groupBy("hour", "event_type").agg(F.sum("n").alias("n"), F.count("*").alias("jobs"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unread, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS p90, max(value) AS most FROM events GROUP BY event_type""")
def plan_distribution(spark, d):
    """Nearest-rank median and 90th percentile by counts of equal values, not by a sort of all rows."""
    kind = Window.partitionBy("event_type")
    v = read(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("rows"))
    held = F.when(F.col("value").isNotNull(), F.col("rows")).otherwise(0)
    v = v.withColumns({"upto": F.sum(held).over(kind.orderBy("value")), "total": F.sum(held).over(kind)})
    at = lambda p: F.min(F.when(F.col("value").isNotNull() & (F.col("upto") >= F.ceil(F.col("total") * p)), F.col("value")))
    return v.groupBy("event_type").agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("rows")).otherwise(0)).alias("unread"), at(F.lit(0.5)).alias("median"), at(F.lit(0.9)).alias("p90"), F.max("value").alias("most"))


@query("""WITH b AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'signup') AS since FROM events GROUP BY user_id)
SELECT e.user_id, count(*) FILTER (WHERE event_type = 'signup') AS started, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, max(event_id) AS last_event
FROM events e JOIN b ON e.user_id = b.user_id WHERE event_id >= coalesce(since, 0) GROUP BY e.user_id""")
def stream_run_state(spark, d):
    """The state of every job's latest run, from the log read as a stream with state per job."""
    return run_state(spark, d)


#: Of the query: requests at once to begin with, answers that are looked back on, latency that they may have.
FIRST, BACK, SLOW = 8, 4, 60
_OUTCOME = "CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'signup' THEN 'timeout' WHEN 'purchase' THEN 'invalid_json' ELSE 'ok' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS job, event_id, {_OUTCOME} AS outcome, CAST(floor(coalesce(value, 0)) AS BIGINT) AS latency, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT job, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, {FIRST} AS now, CAST(NULL AS BIGINT) AS limited, CAST(NULL AS BIGINT) AS generic, CAST(NULL AS BIGINT) AS grown, CAST([] AS STRUCT(ok BOOLEAN, latency BIGINT)[]) AS seen FROM (SELECT DISTINCT job FROM e)
 UNION ALL SELECT job, k, event_id, CASE WHEN cl THEN greatest(now // 2, 1) WHEN cg THEN greatest(CAST(floor(now * 0.75) AS INT), 1) WHEN g THEN least(now + 1, {4 * FIRST}) ELSE now END, CASE WHEN cl THEN ms ELSE limited END, CASE WHEN cg THEN ms ELSE generic END, CASE WHEN g THEN ms ELSE grown END, seen
 FROM (SELECT *, outcome = 'rate_limited' AND (limited IS NULL OR ms - limited >= 250) AS cl, outcome = 'timeout' AND (generic IS NULL OR ms - generic >= 2000) AS cg,
  outcome = 'ok' AND (grown IS NULL OR ms - grown >= 2000) AND len(seen) = {BACK} AND len(good) = {BACK} AND good[{BACK}] <= {SLOW} AS g
  FROM (SELECT *, list_sort(list_transform(list_filter(seen, lambda x: x.ok), lambda x: x.latency)) AS good FROM (SELECT e.job, e.k, e.event_id, e.outcome, e.ms, r.now, r.limited, r.generic, r.grown, list_append(r.seen, {{'ok': e.outcome = 'ok', 'latency': e.latency}})[-{BACK}:] AS seen FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1))))
SELECT job, event_id, now AS at_once FROM r WHERE k > 0""")
def rate_control(spark, d):
    """How many requests at once a job may have after each answer."""
    rows = read(spark, d, "events").select(F.col("user_id").alias("job"), "event_id", F.expr(_OUTCOME).alias("outcome"), F.floor(F.coalesce("value", F.lit(0))).cast("long").alias("latency"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return rates(rows, FIRST, BACK, SLOW)
