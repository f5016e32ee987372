"""Queries of documents, conversations, run ledgers and event logs; the modules of `plans` add theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.operators.packing import pack
from longleaf.plans import documents, estimates, events, flags, glossary, ledger, quality, reports, runs, scalars, segments, store  # noqa: F401
from longleaf.registry import QUERIES, SQL, query, read  # noqa: F401
from longleaf.registry import TOKENS as _TOKENS
from longleaf.registry import WORDS as _WORDS


@query(f"SELECT lang, count(*) AS docs, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, max({_TOKENS}) AS most FROM documents GROUP BY lang")
def token_estimate_by_lang(spark, d):
    t = T.estimate_tokens(F.col("text"))
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(t).alias("tokens"), F.max(t).alias("most"))


@query(r"""SELECT doc_id, CASE WHEN c > n - c THEN 'cased' WHEN c < n - c THEN 'caseless' ELSE 'undetermined' END AS script_class FROM (
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{Lu}\p{Ll}]')) AS c, len(regexp_extract_all(coalesce(text, ''), '\p{L}')) AS n FROM documents)""")
def script_class_by_doc(spark, d):
    return read(spark, d, "documents").select("doc_id", T.script_class(F.col("text")).alias("script_class"))


@query(f"SELECT doc_id, array_to_string(({_WORDS})[1:8], ' ') AS head, array_to_string(({_WORDS})[-8:], ' ') AS tail FROM documents")
def head_tail_words(spark, d):
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.head_words(text, 8).alias("head"), T.tail_words(text, 8).alias("tail"))


@query(f"SELECT doc_id, sha256(text) AS checksum, {_TOKENS} AS tokens FROM documents")
def checksum_docs(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{T.NUMBER}')) AS BIGINT) AS numbers, CAST(len(regexp_extract_all(coalesce(text, ''), '{T.LINK}')) AS BIGINT) AS links FROM documents")
def numbers_and_links(spark, d):
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.occurrences(text, T.NUMBER).alias("numbers"), T.occurrences(text, T.LINK).alias("links"))


@query(f"SELECT doc_id, length(regexp_replace(text, '{T.MARKER}', '', 'g')) AS n_plain, length(translate(text, '−–—', '---')) AS n_signs FROM documents")
def marker_strip(spark, d):
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.length(T.strip_markers(text)).cast("long").alias("n_plain"), F.length(T.normal_signs(text)).cast("long").alias("n_signs"))


def _packed(spark, d, most: int, items: int | None = None) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), T.estimate_tokens(F.col("text")).alias("tokens"))
    return pack(rows, "conv_id", "turn", "tokens", most, items)


def _pack_sql(most: int, items: int) -> str:
    return f"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS text, {_TOKENS} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT conv_id, k, text, tokens, tokens AS used, 1 AS items, 0 AS segment FROM t WHERE k = 1 UNION ALL
 SELECT t.conv_id, t.k, t.text, t.tokens, CASE WHEN p.used + t.tokens > {most} OR p.items >= {items} THEN t.tokens ELSE p.used + t.tokens END,
 CASE WHEN p.used + t.tokens > {most} OR p.items >= {items} THEN 1 ELSE p.items + 1 END, p.segment + CASE WHEN p.used + t.tokens > {most} OR p.items >= {items} THEN 1 ELSE 0 END
 FROM p JOIN t ON t.conv_id = p.conv_id AND t.k = p.k + 1)
"""


@query(_pack_sql(120, 1_000_000) + "SELECT conv_id, CAST(segment AS BIGINT) AS segment, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, sha256(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS checksum FROM p GROUP BY conv_id, segment")
def segment_pack_conversations(spark, d):
    """Turns in order, packed into segments of at most 120 tokens: size, cost and checksum of each."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return _packed(spark, d, 120).groupBy("conv_id", "segment").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"), F.sha2(body, 256).alias("checksum"))


@query(_pack_sql(400, 3) + "SELECT conv_id, CAST(segment AS BIGINT) AS batch, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY conv_id, segment")
def batch_pack_by_items(spark, d):
    return _packed(spark, d, 400, 3).groupBy("conv_id", F.col("segment").alias("batch")).agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


@query(f"""SELECT conv_id, turn, coalesce(lag(tail) OVER w, '') AS before, coalesce(lead(head) OVER w, '') AS after FROM (SELECT conv_id, turn, array_to_string(({_WORDS})[1:6], ' ') AS head, array_to_string(({_WORDS})[-6:], ' ') AS tail FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def segment_context(spark, d):
    w, text = Window.partitionBy("conv_id").orderBy("turn"), F.col("text")
    rows = read(spark, d, "conversations").select("conv_id", "turn", T.head_words(text, 6).alias("head"), T.tail_words(text, 6).alias("tail"))
    return rows.select("conv_id", "turn", F.coalesce(F.lag("tail").over(w), F.lit("")).alias("before"), F.coalesce(F.lead("head").over(w), F.lit("")).alias("after"))


@query(f"""SELECT conv_id, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT conv_id, {_TOKENS} AS tokens, sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto FROM conversations) WHERE upto <= 150 GROUP BY conv_id""")
def context_window_budget(spark, d):
    """The last turns of a conversation, closest first, until the budget would be passed."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", T.estimate_tokens(F.col("text")).alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).filter("upto <= 150").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))


@query("""SELECT conv_id, turn, CASE WHEN n < 40 THEN NULL ELSE ratio < 0.33 OR ratio > 3 END AS length_warning FROM (SELECT conv_id, turn, lag(length(text)) OVER w AS n, length(text) / nullif(lag(length(text)) OVER w, 0) AS ratio FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n IS NOT NULL""")
def length_ratio_warnings(spark, d):
    before = F.lag(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", before.alias("n"), F.try_divide(F.length("text"), before).alias("ratio")).filter("n is not null")
    return rows.select("conv_id", "turn", F.when(F.col("n") >= 40, (F.col("ratio") < 0.33) | (F.col("ratio") > 3)).alias("length_warning"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN k = n THEN 1000 - coalesce(sum(part) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE part END AS BIGINT) AS share FROM (
SELECT l_orderkey, l_linenumber, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(floor(1000 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey)) AS BIGINT) AS part FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))""")
def apportion_tokens(spark, d):
    """1000 tokens of a job dealt to its items by weight; the last takes what is left."""
    job = Window.partitionBy("l_orderkey")
    order = job.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    part = F.floor(1000 * F.col("l_quantity") / F.sum("l_quantity").over(job))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("k"), F.count("*").over(job).alias("n"), part.alias("part"))
    left = 1000 - F.coalesce(F.sum("part").over(job.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("k") == F.col("n"), left).otherwise(F.col("part")).cast("long").alias("share"))


@query("SELECT l_orderkey, max(l_linenumber) AS last_attempt, count(DISTINCT l_returnflag) AS outcomes, CAST(sum(l_quantity) AS BIGINT) AS tokens FROM lineitem GROUP BY l_orderkey")
def attempt_ledger_summary(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last_attempt"), F.count_distinct("l_returnflag").alias("outcomes"), F.sum("l_quantity").cast("long").alias("tokens"))


@query("""WITH f AS (SELECT 'toxic' AS kind, 'error' AS severity FROM labels WHERE toxic = 1 UNION ALL SELECT 'quality', 'warning' FROM labels WHERE quality = 0)
SELECT kind, severity, count(*) AS n, round(count(*) * 1000.0 / (SELECT count(*) FROM f)) / 10.0 AS share FROM f GROUP BY kind, severity""")
def finding_share(spark, d):
    f = read(spark, d, "labels").select(F.explode(F.array(F.when(F.col("toxic") == 1, F.struct(F.lit("toxic").alias("kind"), F.lit("error").alias("severity"))), F.when(F.col("quality") == 0, F.struct(F.lit("quality").alias("kind"), F.lit("warning").alias("severity"))))).alias("f")).filter("f is not null")
    n = f.groupBy("f.kind", "f.severity").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") * 1000.0 / F.sum("n").over(Window.partitionBy())) / 10.0)


_RANKS = """WITH v AS (SELECT event_type, value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY value) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM v)
SELECT event_type, CAST(max(total) AS BIGINT) AS requests, min(value) FILTER (WHERE upto > round((total - 1) * 0.5)) AS p50, min(value) FILTER (WHERE upto > round((total - 1) * 0.95)) AS p95 FROM r GROUP BY event_type"""


@query(_RANKS)
def latency_percentiles(spark, d):
    """The value at place round((n - 1) p) of the sorted ones, by counts of equal values instead of a sort of all rows."""
    kind = Window.partitionBy("event_type")
    v = read(spark, d, "events").filter("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    v = v.withColumns({"upto": F.sum("n").over(kind.orderBy("value")), "total": F.sum("n").over(kind)})
    at = lambda p: F.min(F.when(F.col("upto") > F.round((F.col("total") - 1) * p), F.col("value")))
    return v.groupBy("event_type").agg(F.max("total").alias("requests"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM events")
def epoch_assign(spark, d):
    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "events").select("event_id", "user_id", F.sum((F.col("event_type") == "signup").cast("long")).over(upto).alias("epoch"))


@query("""WITH b AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'signup') AS since FROM events GROUP BY user_id)
SELECT e.user_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, max(event_id) AS last_event FROM events e JOIN b ON e.user_id = b.user_id WHERE event_id >= coalesce(since, 0) GROUP BY e.user_id""")
def run_state_final(spark, d):
    """What each job's latest run has done; the run's beginning comes from an aggregate, not from a window over all events."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    since = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("since"))
    now = e.join(since, "user_id").filter(F.col("event_id") >= F.coalesce("since", F.lit(0)))
    return now.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("event_id").alias("last_event"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_segments(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP '2000-01-01') WHERE k > 2")
def prune_candidates(spark, d):
    """Finished jobs before a date, but for the two newest of each owner."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    jobs = read(spark, d, "orders").filter("o_orderstatus <> 'O' and o_orderdate < timestamp_ntz '2000-01-01'")
    return jobs.withColumn("k", k).filter("k > 2").select("o_orderkey")


@query("SELECT user_id, event_type, max(event_id) AS kept, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def dedupe_global_scope(spark, d):
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("kept"), F.max_by("value", "event_id").alias("value"))


@query("SELECT DISTINCT o_orderstatus AS status FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def distinct_status_outside(spark, d):
    return read(spark, d, "orders").filter(~F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderstatus").alias("status")).distinct()


@query(rf"""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{T.CAPITALISED}')) AS term FROM documents) GROUP BY term HAVING count(*) >= 5""")
def candidate_capitalized(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.CAPITALISED), 0)).alias("term"))
    per = rows.groupBy("term", "doc_id").agg(F.count("*").alias("n"))  # counts of a document first: no distinct over all rows
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).filter("n >= 5")


@query("""SELECT CASE WHEN d.doc_id IS NULL THEN 'missing source' WHEN l.doc_id IS NULL THEN 'missing target' ELSE 'both' END AS state, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def audit_full_outer(spark, d):
    a, b = read(spark, d, "documents").select(F.col("doc_id").alias("a")), read(spark, d, "labels").select(F.col("doc_id").alias("b"))
    state = F.when(F.col("a").isNull(), "missing source").when(F.col("b").isNull(), "missing target").otherwise("both")
    return a.join(b, F.col("a") == F.col("b"), "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"SELECT source, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, round(sum({_TOKENS}) * 0.25 / 1000000.0, 6) AS cost FROM documents GROUP BY source")
def cost_estimate(spark, d):
    rows = read(spark, d, "documents").groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))
    return rows.withColumn("cost", F.round(F.col("tokens") * F.lit(0.25) / 1e6, 6))
