"""Queries of the job store: status, guarded writes, findings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from longleaf.functions import findings
from longleaf.functions import text as T
from longleaf.registry import dealt, query, read

#: Status of a segment by the line's flags, and sets of status; fixed values.
STATUS = "CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'failed' ELSE 'needs_review' END ELSE CASE l_linestatus WHEN 'O' THEN 'queued' ELSE 'skipped_cached' END END"
RESOLVED = ("succeeded", "skipped_cached")
RESUMABLE = ("queued", "retry_pending", "failed")
_IN = lambda names: ", ".join(f"'{n}'" for n in names)
#: Errors as a store holds them, one for each line of an order in turn.
ERRORS = (
    "provider error: interrupted by user", "error: protected span missing: 1984; inline marker duplicated: m1", "HTTP status 503", "translation is unchanged from the source-language prose",
    "warning: block is missing closing tag </m2>", "returned duplicate block_id b7", "something else",
)
_ERROR = "[" + ", ".join("'" + e + "'" for e in ERRORS) + "]"
_KIND = "CASE WHEN low = '" + findings.STOPPED + "' THEN 'interrupted' " + " ".join(
    "WHEN " + " OR ".join(f"contains(low, '{p}')" for p in phrases) + f" THEN '{kind}'" for kind, phrases in findings.FAILURES) + " ELSE 'other' END"


def segments(spark, d):
    """Lines of orders as segments of jobs."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("ordinal"), F.expr(STATUS).alias("status"), F.col("l_quantity").cast("long").alias("tokens"))


_SEGMENTS = f"(SELECT l_orderkey AS job, l_linenumber AS ordinal, {STATUS} AS status, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem) s"


@query(f"""SELECT job, count(*) AS total, count(*) FILTER (WHERE status NOT IN ({_IN(RESOLVED)})) AS unresolved,
CASE WHEN count(*) FILTER (WHERE status NOT IN ({_IN(RESOLVED)})) = 0 THEN 'succeeded' ELSE 'needs_review' END AS status FROM {_SEGMENTS} GROUP BY job""")
def job_status_recompute(spark, d):
    open_ = F.count_if(~F.col("status").isin(*RESOLVED))
    return segments(spark, d).groupBy("job").agg(F.count("*").alias("total"), open_.alias("unresolved"), F.when(open_ == 0, "succeeded").otherwise("needs_review").alias("status"))


@query(f"SELECT job, ordinal, status FROM {_SEGMENTS} WHERE status IN ({_IN(RESUMABLE)})")
def resumable_segments(spark, d):
    return segments(spark, d).filter(F.col("status").isin(*RESUMABLE)).select("job", "ordinal", "status")


@query(f"SELECT status, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM {_SEGMENTS} GROUP BY GROUPING SETS ((status), ())")
def status_totals(spark, d):
    """Counts by status and, under a null status, of all."""
    return segments(spark, d).rollup("status").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("SELECT user_id, max(event_id) AS note, arg_max(props, event_id) AS guidance FROM events WHERE event_type = 'error' GROUP BY user_id")
def retry_guidance_latest(spark, d):
    return read(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("note"), F.max_by("props", "event_id").alias("guidance"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1
 + (SELECT count(*) FROM orders o WHERE o.o_orderkey = l_orderkey AND o.o_orderstatus = 'F') AS BIGINT) AS ordinal FROM lineitem""")
def attempt_ordinal_append(spark, d):
    """Attempts numbered after those that a job has already."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    begun = read(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_orderkey").agg(F.count("*").alias("begun"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # numbered before the join, which needs no other order: lines are sorted once
    rows = dealt(rows, "l_orderkey", rows).withColumn("k", F.row_number().over(order)).drop("l_quantity").join(begun, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("k") - 1 + F.coalesce("begun", F.lit(0))).cast("long").alias("ordinal"))


@query("""SELECT doc_id, CASE WHEN l.quality = 1 THEN d.lang ELSE coalesce(l.new, d.lang) END AS lang, l.quality = 1 AS frozen FROM documents d LEFT JOIN
(SELECT doc_id AS id, max(quality) AS quality, CASE WHEN max(toxic) = 1 THEN 'flagged' END AS new FROM labels GROUP BY doc_id) l ON l.id = d.doc_id""")
def upsert_guarded(spark, d):
    """New values over old ones, save where a person has corrected the row."""
    new = read(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.when(F.max("toxic") == 1, "flagged").alias("new"))
    frozen = F.col("quality") == 1
    rows = read(spark, d, "documents").select("doc_id", "lang").join(new, F.col("doc_id") == F.col("id"), "left")
    return rows.select("doc_id", F.when(frozen, F.col("lang")).otherwise(F.coalesce("new", "lang")).alias("lang"), frozen.alias("frozen"))


@query(f"""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(string_split({_ERROR}[(l_linenumber - 1) % {len(ERRORS)} + 1], '; ')) AS fragment FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT *, regexp_replace(fragment, '^(warning|error): ', '') AS message FROM e), k AS (SELECT *, lower(message) AS low FROM f)
SELECT {_KIND} AS kind, CASE WHEN starts_with(fragment, 'warning: ') THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM k GROUP BY ALL""")
def classify_errors(spark, d):
    """Stored errors taken apart at semicolons and named by kind."""
    message = F.element_at(F.array(*[F.lit(e) for e in ERRORS]), ((F.col("l_linenumber") - 1) % len(ERRORS) + 1).cast("int"))
    rows = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.explode(F.split(message, "; ")).alias("fragment"))
    kind = findings.failure_kind(F.regexp_replace("fragment", "^(warning|error): ", ""))
    return rows.groupBy(kind.alias("kind"), F.when(F.startswith("fragment", F.lit("warning: ")), "warning").otherwise("error").alias("severity")).agg(F.count("*").alias("n"))


@query("""SELECT l.doc_id, l.quality, l.toxic FROM labels l WHERE NOT (l.quality = 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.source IS NULL))""")
def prune_stale_findings(spark, d):
    """Findings but those whose segment no longer has what they were raised for."""
    stale = read(spark, d, "documents").filter("source is null").select("doc_id").distinct()
    rows = read(spark, d, "labels").select("doc_id", "quality", "toxic")
    return rows.join(stale.withColumnRenamed("doc_id", "stale_id"), (F.col("doc_id") == F.col("stale_id")) & (F.col("quality") == 0), "left_anti")


@query(r"""SELECT regexp_replace(regexp_replace(lower(trim(role)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS kind, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN NULL ELSE sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) END AS excerpt, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN conv_id || ':' || turn END AS alone, count(*) AS occurrences, count(DISTINCT conv_id) AS segments, min(turn) AS first_turn
FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2, 3""")
def issue_collapse(spark, d):
    """Issues of the same kind and excerpt as one, with how often and in how many segments they occur."""
    kind = F.regexp_replace(F.regexp_replace(F.lower(F.trim("role")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    text = F.trim(F.regexp_replace("text", T.SPACE + "+", " "))
    # issues meet by a digest of their whole text; one without text meets no other
    excerpt, alone = F.when(text != "", F.sha2(F.lower(text), 256)), F.when(text == "", F.concat("conv_id", F.lit(":"), "turn"))
    rows = read(spark, d, "conversations").filter("role is not null and text is not null").select(kind.alias("kind"), excerpt.alias("excerpt"), alone.alias("alone"), "conv_id", "turn")
    per = rows.groupBy("kind", "excerpt", "alone", "conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    return per.groupBy("kind", "excerpt", "alone").agg(F.sum("n").alias("occurrences"), F.count("*").alias("segments"), F.min("first").alias("first_turn"))


@query("""SELECT o.o_orderkey AS job, o.o_orderstatus AS status, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS items, date_diff('day', TIMESTAMP '1990-01-01', o.o_orderdate) AS age FROM orders o WHERE o_orderstatus IN ('F', 'P')""")
def job_list(spark, d):
    """Jobs that have begun, with their items and age."""
    items = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"))
    jobs = read(spark, d, "orders").filter("o_orderstatus in ('F', 'P')").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return jobs.select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"), F.coalesce("items", F.lit(0)).alias("items"), F.date_diff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long").alias("age"))
