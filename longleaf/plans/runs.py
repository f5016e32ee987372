"""Queries of runs: calls of a model, its answers, what is wrong with them, progress and logs, reading aloud, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from longleaf.functions import responses, spans
from longleaf.functions.layout import page_texts
from longleaf.functions.sentences import narration_pieces
from longleaf.operators.packing import pack
from longleaf.operators.provider import mock, translate
from longleaf.plans.quality import pairs
from longleaf.registry import query, read


@query("SELECT conv_id || ':' || turn AS item, '[it] ' || coalesce(text, '') AS translation, CAST(NULL AS VARCHAR) AS error FROM conversations")
def translate_mocked(spark, d):
    """All turns through the stand-in for a model, a conversation's turns a batch of bounded tokens."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("tokens", F.length("text"))
    packed = pack(rows, "conv_id", "turn", "tokens", 4000, 16)
    batches = packed.select(F.concat("conv_id", F.lit("_"), "segment").alias("batch"), F.concat("conv_id", F.lit(":"), "turn").alias("item"), "text")
    return translate(batches, mock("prefix")).select("item", "translation", "error")


_ANSWERS = "'{\"items\": [' || array_to_string(list_transform(CASE conv_id % 4 WHEN 1 THEN ids[1:len(ids) - 1] WHEN 2 THEN list_append(ids, ids[1]) ELSE ids END, lambda i: '{\"id\": \"' || i || '\", \"translation\": \"x\"}'), ', ') || ']}'"


@query(f"""WITH c AS (SELECT conv_id, list(CAST(turn AS VARCHAR) ORDER BY turn) AS ids FROM conversations GROUP BY conv_id), a AS (SELECT conv_id, ids, {_ANSWERS} AS content FROM c),
i AS (SELECT conv_id, ids, list_transform(from_json(json_extract(content, '$.items'), '[{{"id": "VARCHAR"}}]'), lambda x: x.id) AS got FROM a), r AS (SELECT *, len(list_filter(ids, lambda x: NOT list_contains(got, x))) > 0 AS refused FROM i)
SELECT conv_id, refused, CASE WHEN refused THEN 0 ELSE len(list_distinct(got)) END AS items, CASE WHEN refused THEN 0 ELSE len(got) - len(list_distinct(got)) END AS failures FROM r""")
def answers_read(spark, d):
    """Answers to batches: whole ones, some without an item, some with one twice, some within prose."""
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    ids = F.transform("turns", lambda t: t.cast("string"))
    rows = rows.withColumn("ids", ids)
    kind = F.col("conv_id") % 4
    sent = F.when(kind == 1, F.slice("ids", 1, F.size("ids") - 1)).when(kind == 2, F.concat("ids", F.slice("ids", 1, 1))).otherwise(F.col("ids"))
    body = F.to_json(F.struct(F.transform(sent, lambda i: F.struct(i.alias("id"), F.lit("x").alias("translation"))).alias("items")))
    content = F.when(kind == 3, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    read_ = responses.answer_items(content, F.col("ids"), F.transform("ids", lambda i: F.lit("x")))
    rows = rows.select("conv_id", read_.alias("r"))
    return rows.select("conv_id", F.col("r.error").isNotNull().alias("refused"), F.size("r.items").cast("long").alias("items"), F.size("r.failures").cast("long").alias("failures"))


@query(None)
def validate_blocks(spark, d):
    """What each target breaks of its source, by kind and severity; numbers may change their local form, which SQL can't tell."""
    rows = pairs(spark, d).select("doc_id", F.explode(responses.block_violations("source", "target", F.lit("paragraph"))).alias("v"))
    return rows.groupBy("doc_id", "v.kind", "v.severity").agg(F.count("*").alias("n"), F.min("v.message").alias("first"))


@query(None)
def missing_spans(spark, d):
    """Protected spans of a source that its target doesn't keep."""
    rows = pairs(spark, d).select("doc_id", F.explode(spans.lost_spans("source", "target")).alias("s"))
    return rows.select("doc_id", "s.kind", "s.text", "s.severity")


#: Characters of a piece that is read aloud.
PIECE = 400
_BLACK = r"length(regexp_replace(coalesce(text, ''), '\s+', '', 'g'))"


@query(f"SELECT doc_id, {_BLACK} AS chars, CAST(0 AS BIGINT) AS too_long, {_BLACK} > 0 AS any FROM documents")
def narration_coverage(spark, d):
    """Whether the pieces of a text have all its characters but blanks, and none is too long. What SQL says is what must hold."""
    from longleaf.functions import text as T

    pieces = narration_pieces(F.coalesce("text", F.lit("")), F.lit(PIECE))
    rows = read(spark, d, "documents").select("doc_id", pieces.alias("p"))
    black = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x, T.SPACE + "+", "")))
    return rows.select("doc_id", black.alias("chars"), F.size(F.filter("p", lambda x: F.length(x) > PIECE)).cast("long").alias("too_long"), (F.size("p") > 0).alias("any"))


@query(None)
def narration_plan(spark, d):
    """Pieces of each document in order, with what stands before and after, an identity of all that, and a file name."""
    rows = read(spark, d, "documents").select("doc_id", narration_pieces(F.coalesce("text", F.lit("")), F.lit(PIECE)).alias("p"))
    # what stands beside a piece is in the same row: nothing is shuffled or sorted
    near = F.transform("p", lambda x, i: F.struct(x.alias("text"), F.right(F.get("p", i - 1), F.lit(100)).alias("before"), F.left(F.get("p", i + 1), F.lit(100)).alias("after")))
    rows = rows.select("doc_id", F.posexplode(near).alias("place", "x")).select("doc_id", "place", "x.*")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("text", "before", "after")]
    identity = F.sha2(F.concat(*[x for p in parts for x in (F.lpad(F.octet_length(p).cast("string"), 10, "0"), p)]), 256)
    name = F.format_string("chapter-%d-part-%d-%s.mp3", F.col("doc_id"), F.col("place"), F.left(identity, F.lit(16)))
    return rows.select("doc_id", "place", F.length("text").alias("chars"), "before", "after", identity.alias("identity"), name.alias("name"))


_ISLAND = "sum(CASE WHEN turn = before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn)"


@query(f"""WITH RECURSIVE b AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE turn % 6 <> 5), t AS (SELECT conv_id, turn, n, CAST({_ISLAND} AS BIGINT) AS island FROM b), i AS (SELECT *, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) AS k FROM t),
p AS (SELECT conv_id, island, k, n, n AS used, 0 AS part FROM i WHERE k = 1 UNION ALL SELECT i.conv_id, i.island, i.k, i.n, CASE WHEN used + i.n > 500 THEN i.n ELSE used + i.n END, part + CASE WHEN used + i.n > 500 THEN 1 ELSE 0 END FROM p JOIN i ON i.conv_id = p.conv_id AND i.island = p.island AND i.k = p.k + 1)
SELECT conv_id, island, CAST(part AS BIGINT) AS part, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS chars FROM p GROUP BY conv_id, island, part""")
def passages(spark, d):
    """Blocks that follow each other in passages of bounded length; a gap in their numbers ends one."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").filter("turn % 6 <> 5").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.lag("turn").over(order).alias("before"))
    gap = F.when(F.col("turn") == F.col("before") + 1, 0).otherwise(1)
    rows = rows.withColumn("island", F.sum(gap).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("key", F.concat("conv_id", F.lit(":"), "island"))
    packed = pack(rows, "key", "turn", "n", 500)
    return packed.groupBy("conv_id", "island", F.col("segment").alias("part")).agg(F.count("*").alias("blocks"), F.sum("n").alias("chars"))


@query("""WITH b AS (SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type = 'signup'), -1) AS since, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY user_id),
r AS (SELECT e.user_id, any_value(total) AS total, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) FILTER (WHERE event_type = 'purchase') AS done, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) / 1000.0::DOUBLE AS secs FROM events e JOIN b ON e.user_id = b.user_id AND event_id >= since GROUP BY e.user_id)
SELECT user_id, total, done, greatest(total - done, 0) AS remaining, secs AS elapsed_secs, CASE WHEN done > 0 AND secs > 0 THEN round(greatest(total - done, 0) / (done / secs), 6) ELSE 0 END AS eta_secs FROM r""")
def run_progress(spark, d):
    """What is left of each job's latest run and for how long, at the rate so far; 0 where there is none."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    since = e.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))), F.lit(-1)).alias("since"), F.count_distinct("k").alias("total"))
    now = e.join(since, "user_id").filter("event_id >= since")
    per = now.groupBy("user_id", "total", "k").agg(F.max((F.col("event_type") == "purchase") & F.col("k").isNotNull()).alias("done"), F.min("ms").alias("first"), F.max("ms").alias("last"))
    out = per.groupBy("user_id", "total").agg(F.count_if("done").alias("done"), ((F.max("last") - F.min("first")) / F.lit(1000.0)).alias("elapsed_secs"))
    left = F.greatest(F.col("total") - F.col("done"), F.lit(0))
    eta = F.when((F.col("done") > 0) & (F.col("elapsed_secs") > 0), F.round(left / (F.col("done") / F.col("elapsed_secs")), 6)).otherwise(F.lit(0.0))
    return out.select("user_id", "total", "done", left.alias("remaining"), "elapsed_secs", eta.alias("eta_secs"))


_LINE = "CASE WHEN event_id % 17 = 0 THEN '{\"kind\": ' WHEN event_id % 29 = 0 THEN '  ' ELSE '{\"kind\": \"' || event_type || '\", \"seq\": ' || event_id || '}' END"


@query(f"""WITH l AS (SELECT user_id, event_id, {_LINE} AS line FROM events), k AS (SELECT *, CASE WHEN trim(line) = '' THEN NULL ELSE json_valid(line) END AS good FROM l),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM k WHERE good) SELECT k.user_id, count(*) FILTER (WHERE good) AS events, count(*) FILTER (WHERE NOT good) AS skipped,
(SELECT string_agg(json_extract_string(line, '$.kind'), ',' ORDER BY place DESC) FROM g WHERE g.user_id = k.user_id AND place <= 5) AS tail FROM k GROUP BY k.user_id""")
def log_tail(spark, d):
    """Lines of a log: those that are events, those that aren't and are counted, and the last five kinds; blank lines are nothing."""
    line = F.expr(_LINE)
    rows = read(spark, d, "events").select("user_id", "event_id", line.alias("line")).filter(F.trim("line") != "")
    event = F.from_json("line", "kind string, seq long, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.select("user_id", "event_id", event.alias("e")).select("user_id", "event_id", F.when(F.col("e._corrupt_record").isNull(), F.col("e.kind")).alias("kind"))
    # the last five of each job without sorting all its events in one task: partial limits come first
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    last = rows.filter("kind is not null").withColumn("place", place).filter("place <= 5").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "kind"))).alias("last"))
    counts = rows.groupBy("user_id").agg(F.count("kind").alias("events"), F.count_if(F.col("kind").isNull()).alias("skipped"))
    return counts.join(last, "user_id", "left").select("user_id", "events", "skipped", F.array_join(F.transform("last", lambda x: x["kind"]), ",").alias("tail"))


@query(None)
def page_paragraphs(spark, d):
    """Turns as lines of printed pages, twenty a page, read back as paragraphs."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.left(F.coalesce("text", F.lit("")), F.lit(60)).alias("text")).filter("text <> ''")
    n = F.col("turn") % 20
    return page_texts(rows.select(
        F.col("conv_id").alias("doc"), F.floor(F.col("turn") / 20).cast("int").alias("page"), F.lit(600).alias("page_width"), F.lit(800).alias("page_height"), (100 + n * 30).cast("int").alias("top"), F.lit(50).alias("left"),
        F.lit(450).alias("width"), F.lit(12).alias("height"), F.when(n == 0, 18).otherwise(12).alias("size"), "text"))
