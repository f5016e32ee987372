"""Queries of the job store by its rules: the ledger of attempts, cache lookups, scopes, findings, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longleaf.plans.store import RESOLVED, STATUS
from longleaf.registry import dealt, query, read

#: Status of a segment that ended with a translation, and all that are known; fixed values.
TERMINAL = (*RESOLVED, "needs_review")
KNOWN = (*TERMINAL, "queued", "failed", "retry_pending")
#: Kinds of findings, and those that only warn; fixed values.
KINDS = ("protected_span_missing", "inline_marker_missing", "inline_marker_duplicated", "inline_marker_unknown", "marker_structure", "batch_block_mismatch", "source_copy_unchanged", "target_language_gate", "provider_error", "interrupted", "other")
WARN = ("source_copy_unchanged", "target_language_gate", "interrupted")
_IN = lambda names: ", ".join(f"'{n}'" for n in names)
#: Lines of orders as segments: their own columns, older ones, attempts.
_COLUMNS = {
    "job": "l_orderkey", "ordinal": "l_linenumber", "status": STATUS, "attempts": "l_linenumber % 4", "tokens_input": "CASE WHEN l_partkey % 3 > 0 THEN CAST(l_quantity AS BIGINT) END", "input_tokens": "CAST(11 AS BIGINT)",
    "tokens_input_cached": "CAST(2 AS BIGINT)", "tokens_output": "CASE WHEN l_partkey % 2 = 0 THEN CAST(7 AS BIGINT) END", "output_tokens": "CAST(5 AS BIGINT)", "part": "l_partkey",
}
_SEGMENTS = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in _COLUMNS.items()) + " FROM lineitem)"
#: The ledger: attempts of segments of even number, a second one for each fourth.
_LEDGER = """(SELECT l_orderkey AS job, l_linenumber AS segment, 1 AS attempt, CAST(17 AS BIGINT) AS tin, CAST(3 AS BIGINT) AS tcached, CAST(9 AS BIGINT) AS tout FROM lineitem WHERE l_linenumber % 2 = 0
 UNION ALL SELECT l_orderkey, l_linenumber, 2, 4, 0, 2 FROM lineitem WHERE l_linenumber % 4 = 0)"""


def segments(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(*[F.expr(v).alias(k) for k, v in _COLUMNS.items()])


def attempts(spark, d) -> DataFrame:
    """(job, segment, attempt, tin, tcached, tout): rows that are only ever added."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").filter("l_linenumber % 2 = 0")
    row = lambda k, a, b, c: F.struct(F.lit(k).alias("attempt"), *[F.lit(x).cast("long").alias(n) for n, x in (("tin", a), ("tcached", b), ("tout", c))])
    each = F.when(F.col("l_linenumber") % 4 == 0, F.array(row(1, 17, 3, 9), row(2, 4, 0, 2))).otherwise(F.array(row(1, 17, 3, 9)))
    return line.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("segment"), F.explode(each).alias("a")).select("job", "segment", "a.*")


_OLD = "CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.job = s.job AND l.segment = s.ordinal) THEN 0 ELSE {} END"
_COUNTS = {"succeeded": "succeeded", "failed": "failed", "needs_review": "needs_review", "retry_pending": "retry_pending", "cached": "skipped_cached"}


@query(f"""WITH l AS {_LEDGER}, s AS {_SEGMENTS}, a AS (SELECT job, CAST(sum(tin) AS BIGINT) AS tin, CAST(sum(tcached) AS BIGINT) AS tcached, CAST(sum(tout) AS BIGINT) AS tout FROM l GROUP BY job),
k AS (SELECT s.*, {_OLD.format("coalesce(tokens_input, input_tokens)")} AS oin, {_OLD.format("tokens_input_cached")} AS ocached, {_OLD.format("coalesce(tokens_output, output_tokens)")} AS oout FROM s),
t AS (SELECT job, count(*) AS segments, {", ".join(f"count(*) FILTER (WHERE status = '{v}') AS {k}" for k, v in _COUNTS.items())}, count(*) FILTER (WHERE attempts > 1) AS retried, sum(oin) AS oin, sum(ocached) AS ocached, sum(oout) AS oout FROM k GROUP BY job)
SELECT o_orderkey AS job, o_orderstatus AS status, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("segments", *_COUNTS, "retried"))}, CAST(coalesce(oin, 0) + coalesce(tin, 0) AS BIGINT) AS tokens_in, CAST(coalesce(ocached, 0) + coalesce(tcached, 0) AS BIGINT) AS tokens_cached, CAST(coalesce(oout, 0) + coalesce(tout, 0) AS BIGINT) AS tokens_out
FROM orders LEFT JOIN t ON t.job = o_orderkey LEFT JOIN a ON a.job = o_orderkey""")
def job_summary(spark, d):
    """Each job's segments by status and its tokens: of a segment with attempts in the ledger these count, of any other its own columns.

    One shuffle: segments and attempts go by job together, meet per segment as sums, and these per job.
    """
    own = segments(spark, d)
    no = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    own = own.select(
        "job", "ordinal", F.lit(1).alias("segments"), *[(F.col("status") == v).cast("int").alias(k) for k, v in _COUNTS.items()], (F.col("attempts") > 1).cast("int").alias("retried"),
        F.coalesce("tokens_input", "input_tokens").alias("oin"), F.col("tokens_input_cached").alias("ocached"), F.coalesce("tokens_output", "output_tokens").alias("oout"), *no("tin", "tcached", "tout"))
    counts = ("segments", *_COUNTS, "retried")
    ledger = attempts(spark, d).select("job", F.col("segment").alias("ordinal"), *[F.lit(None).cast("int").alias(c) for c in counts], *no("oin", "ocached", "oout"), "tin", "tcached", "tout")
    both = dealt(own.unionByName(ledger), "job", own, ledger)
    both = both.groupBy("job", "ordinal").agg(*[F.sum(c).alias(c) for c in (*counts, "oin", "ocached", "oout", "tin", "tcached", "tout")])
    total = lambda new, old: F.sum(F.coalesce(new, old)).alias(new)
    per = both.groupBy("job").agg(*[F.sum(c).alias(c) for c in counts], total("tin", "oin"), total("tcached", "ocached"), total("tout", "oout"))
    jobs = read(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(per, F.col("o_orderkey") == F.col("job"), "left")
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
    return jobs.select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"), *[zero(c, c) for c in ("segments", *_COUNTS, "retried")], zero("tin", "tokens_in"), zero("tcached", "tokens_cached"), zero("tout", "tokens_out"))


@query(f"""WITH s AS {_SEGMENTS} SELECT job, ordinal, part, status, attempts, coalesce(tokens_input, input_tokens) AS tokens_in, coalesce(tokens_output, output_tokens) AS tokens_out, status IN ({_IN(TERMINAL)}) AS terminal FROM s""")
def segment_records(spark, d):
    """Segments with newer columns before older ones, and whether each ended with a translation."""
    own = F.coalesce("tokens_input", "input_tokens").alias("tokens_in"), F.coalesce("tokens_output", "output_tokens").alias("tokens_out")
    return segments(spark, d).select("job", "ordinal", "part", "status", "attempts", *own, F.col("status").isin(*TERMINAL).alias("terminal"))


@query(f"""WITH l AS {_LEDGER} SELECT job, segment, attempt, tin, row_number() OVER (PARTITION BY job ORDER BY segment, attempt) - 1 AS place FROM (SELECT DISTINCT * FROM l) WHERE segment <= 4 AND attempt = 2""")
def attempts_of_phase(spark, d):
    """A job's attempts under optional conditions, in their order."""
    rows = attempts(spark, d).filter("segment <= 4 and attempt = 2").distinct()
    place = F.row_number().over(Window.partitionBy("job").orderBy("segment", "attempt")) - 1
    return rows.select("job", "segment", "attempt", "tin", place.alias("place"))


@query(f"""SELECT o_orderkey, CASE WHEN name IN ({_IN(KNOWN)}) THEN name ELSE 'unknown:' || name END AS status FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE lower(o_orderstatus) END AS name FROM orders)""")
def status_names(spark, d):
    """Stored status texts; one that isn't known is kept as it is."""
    name = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise(F.lower("o_orderstatus"))
    return read(spark, d, "orders").select("o_orderkey", F.when(name.isin(*KNOWN), name).otherwise(F.concat(F.lit("unknown:"), name)).alias("status"))


_FOUND = """(SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN ' llm_llm_tone ' WHEN 'click' THEN 'source_copy_unchanged' WHEN 'view' THEN 'llm_' ELSE event_type END AS kind, CASE WHEN value > 50 THEN ' HIGH' ELSE 'low' END AS severity FROM events)"""


@query(rf"""WITH f AS {_FOUND} SELECT kind_of, llm_kind, llm_severity, default_severity, count(*) AS n FROM (SELECT CASE WHEN kind IN ({_IN(KINDS)}) THEN kind ELSE 'other' END AS kind_of,
CASE WHEN regexp_replace(trim(kind), '^(llm_)+', '') = '' THEN 'llm_other' ELSE 'llm_' || regexp_replace(trim(kind), '^(llm_)+', '') END AS llm_kind, CASE WHEN lower(trim(severity)) = 'high' THEN 'error' ELSE 'warning' END AS llm_severity,
CASE WHEN kind IN ({_IN(WARN)}) THEN 'warning' ELSE 'error' END AS default_severity FROM f) GROUP BY ALL""")
def finding_names(spark, d):
    """Findings of models and of rules under the names that the store knows, with severities by kind or by what a model said."""
    kind = F.when(F.col("event_type") == "purchase", " llm_llm_tone ").when(F.col("event_type") == "click", "source_copy_unchanged").when(F.col("event_type") == "view", "llm_").otherwise(F.col("event_type"))
    rows = read(spark, d, "events").select(kind.alias("kind"), F.when(F.col("value") > 50, " HIGH").otherwise("low").alias("severity"))
    bare = F.regexp_replace(F.trim("kind"), "^(llm_)+", "")
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("other")
    return rows.groupBy(
        known.alias("kind_of"), F.when(bare == "", "llm_other").otherwise(F.concat(F.lit("llm_"), bare)).alias("llm_kind"),
        F.when(F.lower(F.trim("severity")) == "high", "error").otherwise("warning").alias("llm_severity"), F.when(F.col("kind").isin(*WARN), "warning").otherwise("error").alias("default_severity"),
    ).agg(F.count("*").alias("n"))


_TERMS = """(SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'series' ELSE 'book' END AS scope, p_brand AS scope_id, p_name AS source, p_type AS target, CASE WHEN p_partkey % 5 = 0 THEN 'auto_candidate' WHEN p_partkey % 7 = 0 THEN 'rejected' ELSE 'active' END AS state,
 p_size % 2 = 0 AS exact, CASE WHEN p_partkey % 11 = 0 THEN 'de' ELSE 'en' END AS source_lang, CASE WHEN p_partkey % 2 = 0 THEN 'it' ELSE 'fr' END AS target_lang, p_size AS n FROM part)"""
BOOK, SERIES = "Brand#12", "Brand#23"


def terms(spark, d) -> DataFrame:
    """Parts as terms of scopes, languages and states."""
    size, key = F.col("p_size"), F.col("p_partkey")
    return read(spark, d, "part").select(
        key.alias("id"), F.when(size % 3 == 0, "global").when(size % 3 == 1, "series").otherwise("book").alias("scope"), F.col("p_brand").alias("scope_id"), F.col("p_name").alias("source"), F.col("p_type").alias("target"),
        F.when(key % 5 == 0, "auto_candidate").when(key % 7 == 0, "rejected").otherwise("active").alias("state"), (size % 2 == 0).alias("exact"),
        F.when(key % 11 == 0, "de").otherwise("en").alias("source_lang"), F.when(key % 2 == 0, "it").otherwise("fr").alias("target_lang"), size.alias("n"))


def in_scope(book: str, series: str):
    """What holds for a book: terms of all, of its series, and its own."""
    return (F.col("scope") == "global") | ((F.col("scope") == "series") & (F.col("scope_id") == series)) | ((F.col("scope") == "book") & (F.col("scope_id") == book))


@query(f"WITH t AS {_TERMS} SELECT id, scope, source, target FROM t WHERE state = 'active' AND source_lang = 'en' AND target_lang = 'it' AND (scope = 'global' OR (scope = 'series' AND scope_id = '{SERIES}') OR (scope = 'book' AND scope_id = '{BOOK}'))")
def active_terms(spark, d):
    return terms(spark, d).filter((F.col("state") == "active") & (F.col("source_lang") == "en") & (F.col("target_lang") == "it") & in_scope(BOOK, SERIES)).select("id", "scope", "source", "target")


@query(f"WITH t AS {_TERMS} SELECT id, source, n, row_number() OVER (PARTITION BY source_lang, target_lang ORDER BY n DESC, source, id) AS place, source_lang, target_lang FROM t WHERE state = 'auto_candidate'")
def candidate_list(spark, d):
    """Candidates of each pair of languages, the most frequent first."""
    place = F.row_number().over(Window.partitionBy("source_lang", "target_lang").orderBy(F.desc("n"), "source", "id"))
    return terms(spark, d).filter("state = 'auto_candidate'").select("id", "source", "n", place.alias("place"), "source_lang", "target_lang")


@query(f"WITH t AS {_TERMS} SELECT DISTINCT source_lang, target_lang FROM t WHERE state = 'auto_candidate'")
def candidate_pairs(spark, d):
    return terms(spark, d).filter("state = 'auto_candidate'").select("source_lang", "target_lang").distinct()


_PRIORITY = "CASE scope WHEN 'book' THEN 2 WHEN 'series' THEN 1 ELSE 0 END"


@query(f"WITH t AS {_TERMS} SELECT CASE WHEN exact THEN source ELSE lower(source) END AS key, exact, source_lang, target_lang, arg_max(target, {{'p': {_PRIORITY}, 's': id}}) AS target, max({_PRIORITY}) AS priority FROM t WHERE state = 'active' GROUP BY 1, 2, 3, 4")
def merge_scope_terms(spark, d):
    """One row a term, its case rule and its languages: the narrowest scope wins, and among its rows the later one."""
    priority = F.when(F.col("scope") == "book", 2).when(F.col("scope") == "series", 1).otherwise(0)
    rows = terms(spark, d).filter("state = 'active'").withColumn("p", priority)
    key = F.when(F.col("exact"), F.col("source")).otherwise(F.lower("source"))
    return rows.groupBy(key.alias("key"), "exact", "source_lang", "target_lang").agg(F.max_by("target", F.struct("p", "id")).alias("target"), F.max("p").alias("priority"))


@query(f"WITH t AS {_TERMS} SELECT scope, scope_id, lower(source) AS key, count(*) AS n FROM t WHERE state = 'active' GROUP BY ALL HAVING count(DISTINCT target) > 1")
def ambiguous_terms(spark, d):
    """Terms that one scope gives several targets, whose order once decided."""
    rows = terms(spark, d).filter("state = 'active'").groupBy("scope", "scope_id", F.lower("source").alias("key"))
    return rows.agg(F.count("*").alias("n"), F.min("target").alias("a"), F.max("target").alias("b")).filter("a <> b").select("scope", "scope_id", "key", "n")


@query(f"WITH t AS {_TERMS} SELECT scope, sha256(string_agg(id || chr(31) || source || chr(31) || target, chr(30) ORDER BY id)) AS fingerprint, count(*) AS n FROM t WHERE state = 'active' AND scope <> 'global' AND scope_id IN ('{BOOK}', '{SERIES}') GROUP BY scope")
def scope_fingerprints(spark, d):
    """A digest of what a scope holds, in one order: another content is another identity of all that was made with it."""
    rows = terms(spark, d).filter((F.col("state") == "active") & (F.col("scope") != "global") & F.col("scope_id").isin(BOOK, SERIES))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "source", "target"))), lambda x: F.concat_ws("\x1f", x["id"], x["source"], x["target"])), "\x1e")
    return rows.groupBy("scope").agg(F.sha2(body, 256).alias("fingerprint"), F.count("*").alias("n"))


@query(f"WITH t AS {_TERMS} SELECT id, CASE WHEN id % 10 = 0 THEN 'active' WHEN id % 10 = 5 THEN 'rejected' ELSE state END AS state, target || CASE WHEN id % 10 = 0 THEN ' (accepted)' ELSE '' END AS target FROM t WHERE state = 'auto_candidate' AND NOT (scope = 'book' AND scope_id = '{BOOK}')")
def candidate_decisions(spark, d):
    """Candidates accepted or rejected, after a scope has been cleared."""
    rows = terms(spark, d).filter((F.col("state") == "auto_candidate") & ~((F.col("scope") == "book") & (F.col("scope_id") == BOOK)))
    accepted, rejected = F.col("id") % 10 == 0, F.col("id") % 10 == 5
    return rows.select("id", F.when(accepted, "active").when(rejected, "rejected").otherwise(F.col("state")).alias("state"), F.concat("target", F.when(accepted, " (accepted)").otherwise("")).alias("target"))


_CACHE = """(SELECT d.doc_id, sha256(text) AS hash, lang AS fingerprint, source AS provider, CASE doc_id % 4 WHEN 0 THEN 'skipped_cached' WHEN 1 THEN 'failed' ELSE 'succeeded' END AS status, doc_id % 10 AS created, coalesce(q, 0) = 1 AS human FROM documents d LEFT JOIN (SELECT doc_id AS id, max(quality) AS q FROM labels GROUP BY doc_id) ON id = doc_id WHERE text IS NOT NULL)"""


@query(f"""WITH c AS {_CACHE} SELECT hash, fingerprint, provider, arg_max(doc_id, {{'s': CASE status WHEN 'succeeded' THEN 1 ELSE 0 END, 'c': created, 'r': doc_id}}) AS best, count(*) AS candidates FROM c WHERE status IN ({_IN(RESOLVED)}) AND NOT human GROUP BY ALL""")
def cache_lookup_best(spark, d):
    """The translation to reuse for a text: same identity and maker, resolved, by no person; done before copied, newest first.

    An aggregate, so that a text of a third of all rows is looked up in no one task.
    """
    human = read(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"))
    status = F.when(F.col("doc_id") % 4 == 0, "skipped_cached").when(F.col("doc_id") % 4 == 1, "failed").otherwise("succeeded")
    rows = read(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"), F.col("lang").alias("fingerprint"), F.col("source").alias("provider"), status.alias("status"), (F.col("doc_id") % 10).alias("created"))
    rows = rows.filter(F.col("status").isin(*RESOLVED)).join(human.filter("q = 1"), F.col("doc_id") == F.col("id"), "left_anti")
    return rows.groupBy("hash", "fingerprint", "provider").agg(F.max_by("doc_id", F.struct((F.col("status") == "succeeded").cast("int"), "created", "doc_id")).alias("best"), F.count("*").alias("candidates"))


@query("""WITH v AS (SELECT value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY value), r AS (SELECT value, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS total FROM v),
p AS (SELECT min(value) FILTER (WHERE upto > round((total - 1) * 0.5)) AS p50, min(value) FILTER (WHERE upto > round((total - 1) * 0.95)) AS p95 FROM r)
SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS ok, count(*) FILTER (WHERE event_type <> 'view') AS failed, count(*) FILTER (WHERE event_type = 'error') AS limited, count(*) FILTER (WHERE event_type = 'signup') AS timeouts, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, (SELECT p50 FROM p) AS p50, (SELECT p95 FROM p) AS p95 FROM events""")
def telemetry_summary(spark, d):
    """All requests in one row: outcomes, tokens, and latencies at two ranks by counts of equal values."""
    e = read(spark, d, "events")
    is_ = lambda kind: F.count_if(F.col("event_type") == kind)
    sums = e.agg(F.count("*").alias("total"), is_("view").alias("ok"), F.count_if(F.col("event_type") != "view").alias("failed"), is_("error").alias("limited"), is_("signup").alias("timeouts"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))
    known = e.filter("value is not null")
    n = known.count()
    counts = known.groupBy("value").agg(F.count("*").alias("n"))
    # ranks by ranges of values: counts of a range first, then within the one range that a rank falls into
    parts = counts.groupBy(F.floor("value").alias("part")).agg(F.sum("n").alias("n"))
    upto = parts.withColumn("upto", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    rows = counts.join(upto.select("part", (F.col("upto") - F.col("n")).alias("below")), F.floor("value") == F.col("part"))
    rows = rows.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    rank = lambda p: F.min(F.when(F.col("upto") > F.round(F.lit((n - 1) * p)), F.col("value")))
    return sums.join(F.broadcast(rows.agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"))))


@query("""WITH j AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP '2000-01-01') WHERE k > 2)
SELECT 'jobs' AS rows_of, count(*) AS kept FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM j) UNION ALL SELECT 'segments', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM j)""")
def prune_cascade(spark, d):
    """What is left when finished jobs but the newest two of each owner go, with all that belongs to them."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    gone = read(spark, d, "orders").filter("o_orderstatus <> 'O' and o_orderdate < timestamp_ntz '2000-01-01'").withColumn("k", k).filter("k > 2").select(F.col("o_orderkey").alias("gone"))
    left = lambda name, key: read(spark, d, name).join(gone, F.col(key) == F.col("gone"), "left_anti")
    return left("orders", "o_orderkey").agg(F.lit("jobs").alias("rows_of"), F.count("*").alias("kept")).unionAll(left("lineitem", "l_orderkey").agg(F.lit("segments").alias("rows_of"), F.count("*").alias("kept")))


@query("SELECT user_id, count(*) AS flags, count(DISTINCT event_type) AS kinds, round(count(*) * 1000.0 / (SELECT count(*) FROM events WHERE event_type IN ('error', 'signup'))) / 10.0 AS share FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id")
def flagged_segments(spark, d):
    """Who was flagged, how often and with what share of all flags."""
    rows = read(spark, d, "events").filter("event_type in ('error', 'signup')").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    per = rows.groupBy("user_id").agg(F.sum("n").alias("flags"), F.count("*").alias("kinds"))
    total = per.agg(F.sum("flags").alias("all"))
    return per.join(F.broadcast(total)).select("user_id", "flags", "kinds", (F.round(F.col("flags") * 1000.0 / F.col("all")) / 10.0).alias("share"))


_RATES = "SELECT lang, count(*) AS passages, count(*) FILTER (WHERE toxic = 1) AS bad FROM documents d LEFT JOIN (SELECT doc_id AS id, max(toxic) AS toxic FROM labels GROUP BY doc_id) ON id = doc_id WHERE doc_id % 2 = {} GROUP BY lang"


@query(f"""WITH a AS ({_RATES.format(0)}), b AS ({_RATES.format(1)}) SELECT coalesce(a.lang, b.lang) AS lang, a.bad AS bad, b.bad AS before, round(a.bad / a.passages::DOUBLE - b.bad / b.passages::DOUBLE, 9) AS delta FROM a FULL JOIN b ON a.lang = b.lang""")
def baseline_delta(spark, d):
    """Rates of defects against those of a run before, by language; null where one run has none."""
    bad = read(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    rows = read(spark, d, "documents").select("doc_id", "lang").join(bad, F.col("doc_id") == F.col("id"), "left")
    rates = lambda k, n: rows.filter(F.col("doc_id") % 2 == k).groupBy(F.col("lang").alias(f"lang_{n}")).agg(F.count("*").alias(f"all_{n}"), F.count_if(F.col("toxic") == 1).alias(f"bad_{n}"))
    both = rates(0, "a").join(rates(1, "b"), F.col("lang_a") == F.col("lang_b"), "full")
    share = lambda n: F.col(f"bad_{n}") / F.col(f"all_{n}").cast("double")
    return both.select(F.coalesce("lang_a", "lang_b").alias("lang"), F.col("bad_a").alias("bad"), F.col("bad_b").alias("before"), F.round(share("a") - share("b"), 9).alias("delta"))


@query("SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents) WHERE place <= 20")
def sample_passages(spark, d):
    """Twenty documents of each language by the digest of their ids: the same ones whenever they are asked for."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id"))
    return read(spark, d, "documents").select("lang", "doc_id", place.alias("place")).filter("place <= 20")


_NAMES = """(SELECT l_orderkey AS job, CASE l_linenumber % 7 WHEN 1 THEN 'chapter-' || l_linenumber || '-part-' || l_suppkey || '-' || left(sha256(CAST(l_partkey AS VARCHAR)), 16) || '.mp3' WHEN 2 THEN 'chapter-01.mp3' WHEN 3 THEN '.book.m4b.' || l_suppkey || '.part.m4b'
 WHEN 4 THEN 'x.concat.txt' WHEN 5 THEN 'manifest.json' WHEN 6 THEN 'a.PART.TMP' ELSE 'notes-' || l_partkey || '.md' END AS name FROM lineitem)"""
MANAGED = "^chapter-[0-9]+-part-[0-9]+-[0-9a-fA-F]{16}[.](mp3|wav|ogg|opus|flac|aac|m4a)$"


@query(f"""WITH f AS {_NAMES}, p AS (SELECT DISTINCT job, name FROM f WHERE job % 2 = 0) SELECT name_kind, count(*) AS n FROM (SELECT f.job, f.name, CASE WHEN regexp_matches(f.name, '{MANAGED}') THEN CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.job = f.job AND p.name = f.name) THEN 'planned' ELSE 'stale' END
WHEN f.name <> 'manifest.json' AND (ends_with(lower(f.name), '.part.tmp') OR ends_with(lower(f.name), '.replace.bak') OR (starts_with(f.name, '.') AND contains(lower(f.name), '.part.')) OR starts_with(lower(f.name), '.normalized-chapter-') OR ends_with(lower(f.name), '.concat.txt') OR lower(f.name) = 'chapters.ffmeta.txt') THEN 'debris' ELSE 'kept' END AS name_kind FROM f) GROUP BY name_kind""")
def stale_files(spark, d):
    """Files of a run: pieces that are planned, those that no plan names any more, what a crash left behind, and others."""
    name = F.expr(_NAMES[1:].removeprefix("SELECT l_orderkey AS job, ").split(" AS name FROM")[0].replace("sha256(CAST(l_partkey AS VARCHAR))", "sha2(CAST(l_partkey AS STRING), 256)"))
    f = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), name.alias("name"))
    planned = f.filter("job % 2 = 0").distinct().withColumnsRenamed({"job": "j", "name": "m"}).withColumn("planned", F.lit(True))
    low, n = F.lower("name"), F.col("name")
    debris = (n != "manifest.json") & (low.endswith(".part.tmp") | low.endswith(".replace.bak") | (n.startswith(".") & low.contains(".part.")) | low.startswith(".normalized-chapter-") | low.endswith(".concat.txt") | (low == "chapters.ffmeta.txt"))
    rows = f.join(planned, (F.col("job") == F.col("j")) & (F.col("name") == F.col("m")), "left")
    kind = F.when(n.rlike(MANAGED), F.when(F.col("planned"), "planned").otherwise("stale")).when(debris, "debris").otherwise("kept")
    return rows.groupBy(kind.alias("name_kind")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CAST(coalesce(sum(length(coalesce(text, '')) * 60 + 500) OVER w, 0) AS BIGINT) AS start_ms, regexp_replace(role, '([=;#\\\\])', '\\\\\\1', 'g') AS title FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chapter_marks(spark, d):
    """Where each chapter begins: after all before it with a gap for each; signs of the format are escaped in titles."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length(F.coalesce("text", F.lit(""))) * 60 + 500
    return read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long").alias("start_ms"), F.regexp_replace("role", r"([=;#\\])", r"\\$1").alias("title"))
