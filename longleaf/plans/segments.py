"""Queries of segments and batches by all their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.operators.packing import pack, segmented
from longleaf.registry import TOKENS, query, read

#: Tokens of a segment, of a block that stays with its heading, and words of context.
MOST, GLUED, CONTEXT = 160, 80, 12
#: Kinds of blocks that are never translated; fixed values.
LEFT_OUT = ("code", "page_furniture")
#: Tokens of a batch and of one in each mode at most, and items; runs beyond which a block keeps its runs; fixed values.
TARGET, MODE_TARGETS, MOST_ITEMS, MANY_RUNS = 200, {"marker_safe": 10_000, "run_preserving": 4_000}, 3, 12
_KIND = "CASE WHEN turn % 4 = 0 THEN 'heading' WHEN turn % 9 = 7 THEN 'code' ELSE 'paragraph' END"


def blocks(spark, d) -> DataFrame:
    """Turns as blocks: eight conversations a book, one a section, in order; turns of some numbers are headings or code."""
    rows = read(spark, d, "conversations").select(F.expr("conv_id div 8").alias("book"), F.col("conv_id").alias("section"), F.col("turn").alias("ordinal"), F.expr(_KIND).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("tokens", T.estimate_tokens(F.col("text")))


def segments(rows: DataFrame) -> DataFrame:
    """(book, section, segment, id, blocks, tokens, text, checksum, of, ordinal) of blocks in order.

    A block that would pass the budget begins a segment, but a short one stays with the heading before it; blocks count at
    least a token; what isn't translated is left out. The id names section, first block and text.
    """
    packed = segmented(rows.filter(~F.col("kind").isin(*LEFT_OUT)), "section", "ordinal", MOST, GLUED)
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    own = packed.groupBy("book", "section", "segment").agg(parts.alias("parts"), F.sum(F.greatest("tokens", F.lit(1))).alias("tokens"))
    body = F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n")
    own = own.select("book", "section", "segment", "tokens", F.size("parts").cast("long").alias("blocks"), F.col("parts")[0]["ordinal"].alias("first"), body.alias("text")).withColumn("checksum", F.sha2("text", 256))
    own = own.withColumn("id", F.concat(F.lit("seg_"), "section", F.lit("_"), "first", F.lit("_"), F.left("checksum", F.lit(12))))
    book = Window.partitionBy("book").orderBy("section", "segment")
    return own.withColumns({"of": F.count("*").over(Window.partitionBy("section")), "ordinal": F.row_number().over(book) - 1})


_BLOCKS = f"""b AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY ordinal) AS k FROM (SELECT conv_id // 8 AS book, conv_id AS section, turn AS ordinal, {_KIND} AS kind, coalesce(text, '') AS text, {TOKENS} AS tokens FROM conversations) WHERE kind NOT IN ('code', 'page_furniture')),
p AS (SELECT *, greatest(tokens, 1) AS used, 0 AS segment FROM b WHERE k = 1 UNION ALL
 SELECT b.*, CASE WHEN f THEN greatest(b.tokens, 1) ELSE used + greatest(b.tokens, 1) END, segment + CASE WHEN f THEN 1 ELSE 0 END
 FROM (SELECT b.section AS s, b.k AS j, p.used AS used, p.segment AS segment, p.used + greatest(b.tokens, 1) > {MOST} AND NOT (p.kind = 'heading' AND b.tokens <= {GLUED}) AS f FROM p JOIN b ON b.section = p.section AND b.k = p.k + 1) x JOIN b ON b.section = x.s AND b.k = x.j),
g AS (SELECT book, section, CAST(segment AS BIGINT) AS segment, count(*) AS blocks, CAST(sum(greatest(tokens, 1)) AS BIGINT) AS tokens, min(ordinal) AS first, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text FROM p GROUP BY book, section, segment)"""


@query(f"""WITH RECURSIVE {_BLOCKS} SELECT 'seg_' || section || '_' || first || '_' || left(sha256(text), 12) AS id, section, segment, blocks, tokens, sha256(text) AS checksum, count(*) OVER (PARTITION BY section) AS "of",
row_number() OVER (PARTITION BY book ORDER BY section, segment) - 1 AS ordinal FROM g""")
def segments_full(spark, d):
    return segments(blocks(spark, d)).select("id", "section", "segment", "blocks", "tokens", "checksum", "of", "ordinal")


_HEAD = rf"array_to_string((list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))[1:{CONTEXT}], ' ')"
_TAIL = rf"array_to_string((list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))[-{CONTEXT}:], ' ')"


@query(f"""WITH RECURSIVE {_BLOCKS} SELECT section, segment, lag({_TAIL}) OVER w AS before, lead({_HEAD}) OVER w AS after FROM g WINDOW w AS (PARTITION BY book ORDER BY section, segment)""")
def segments_context(spark, d):
    """The last words of the segment before and the first of the one after, over a whole book."""
    book, text = Window.partitionBy("book").orderBy("section", "segment"), F.col("text")
    rows = segments(blocks(spark, d)).select("book", "section", "segment", T.head_words(text, CONTEXT).alias("head"), T.tail_words(text, CONTEXT).alias("tail"))
    return rows.select("section", "segment", F.lag("tail").over(book).alias("before"), F.lead("head").over(book).alias("after"))


_MODE = "CASE WHEN turn % 5 = 0 THEN 'run_preserving' WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'marker_safe' ELSE 'plain' END"


def mode(runs, marked):
    """How a block is sent: with its runs if they are many, else safe for markers and spans if it has any."""
    return F.when(runs > MANY_RUNS, "run_preserving").when(marked, "marker_safe").otherwise("plain")


def limit(mode_, base: int):
    out = F.lit(base)
    for name, most in MODE_TARGETS.items():
        out = F.when(mode_ == name, F.least(F.lit(base), F.lit(most))).otherwise(out)
    return out


def items(spark, d) -> DataFrame:
    """Turns as items of a batch: every fifth has many runs, and numbers are spans."""
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("section"), F.col("turn").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))
    runs = F.when(F.col("ordinal") % 5 == 0, MANY_RUNS + 1).otherwise(1)
    return rows.select("section", "ordinal", mode(runs, F.col("text").rlike("[0-9]")).alias("mode"), T.estimate_tokens(F.col("text")).alias("tokens"))


_ITEMS = f"""i AS (SELECT section, ordinal, mode, tokens, row_number() OVER (PARTITION BY section, mode ORDER BY ordinal) AS k FROM (SELECT conv_id AS section, turn AS ordinal, {_MODE} AS mode, {TOKENS} AS tokens FROM conversations)),
p AS (SELECT section, mode, ordinal, tokens, k, tokens AS used, 1 AS n, 0 AS part FROM i WHERE k = 1 UNION ALL
 SELECT i.section, i.mode, i.ordinal, i.tokens, i.k, CASE WHEN p.used + i.tokens > {TARGET} OR p.n >= {MOST_ITEMS} THEN i.tokens ELSE p.used + i.tokens END, CASE WHEN p.used + i.tokens > {TARGET} OR p.n >= {MOST_ITEMS} THEN 1 ELSE p.n + 1 END,
 p.part + CASE WHEN p.used + i.tokens > {TARGET} OR p.n >= {MOST_ITEMS} THEN 1 ELSE 0 END FROM p JOIN i ON i.section = p.section AND i.mode = p.mode AND i.k = p.k + 1)"""


@query(f"""WITH RECURSIVE {_ITEMS} SELECT section, mode, CAST(part AS BIGINT) AS part, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY section ORDER BY min(ordinal), mode) - 1 AS place FROM p GROUP BY section, mode, part""")
def batch_pack_by_mode(spark, d):
    """Items of a section and mode in batches of bounded tokens and items; batches go by the first segment that they hold."""
    rows = items(spark, d).withColumn("key", F.concat("section", F.lit(":"), "mode"))
    packed = pack(rows, "key", "ordinal", "tokens", TARGET, MOST_ITEMS)
    own = packed.groupBy("section", "mode", F.col("segment").alias("part")).agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.min("ordinal").alias("first"))
    place = F.row_number().over(Window.partitionBy("section").orderBy("first", "mode")) - 1
    return own.select("section", "mode", "part", "items", "tokens", place.alias("place"))


@query(f"""WITH RECURSIVE q AS (SELECT *, sum(new) OVER (PARTITION BY section ORDER BY ordinal) AS island FROM (SELECT section, ordinal, mode, tokens, CASE WHEN mode = lag(mode) OVER (PARTITION BY section ORDER BY ordinal) THEN 0 ELSE 1 END AS new FROM (SELECT conv_id AS section, turn AS ordinal, {_MODE} AS mode, {TOKENS} AS tokens FROM conversations))),
i AS (SELECT *, row_number() OVER (PARTITION BY section, island ORDER BY ordinal) AS k FROM q),
p AS (SELECT section, island, mode, tokens, k, tokens AS used, 0 AS part FROM i WHERE k = 1 UNION ALL SELECT i.section, i.island, i.mode, i.tokens, i.k, CASE WHEN p.used + i.tokens > {TARGET} THEN i.tokens ELSE p.used + i.tokens END, p.part + CASE WHEN p.used + i.tokens > {TARGET} THEN 1 ELSE 0 END
 FROM p JOIN i ON i.section = p.section AND i.island = p.island AND i.k = p.k + 1)
SELECT section, CAST(island AS BIGINT) AS island, mode, CAST(part AS BIGINT) AS part, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY section, island, mode, part""")
def repartition_adjacent(spark, d):
    """Pending batches anew: neighbours of one mode join, and each such island is packed for itself."""
    order = Window.partitionBy("section").orderBy("ordinal")
    rows = items(spark, d).withColumn("new", F.when(F.col("mode") == F.lag("mode").over(order), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    packed = pack(rows.withColumn("key", F.concat("section", F.lit(":"), "island")), "key", "ordinal", "tokens", TARGET)
    return packed.groupBy("section", "island", "mode", F.col("segment").alias("part")).agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


@query(f"""WITH i AS (SELECT conv_id AS section, count(*) AS n, CAST(sum({TOKENS}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)
SELECT section, greatest(300.0::DOUBLE, (tokens + 128) / 30.0::DOUBLE * 1.25 + 30.0::DOUBLE) AS timeout, greatest(CAST(floor(n * 0.8::DOUBLE * 30.0) AS BIGINT), 1) AS cap FROM i""")
def request_limits(spark, d):
    """The time that a request of so many tokens may take, and the tokens that a timeout of so many seconds allows."""
    rows = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("section")).agg(F.count("*").alias("n"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))
    return rows.select("section", F.greatest(F.lit(300.0), (F.col("tokens") + 128) / F.lit(30.0) * 1.25 + 30.0).alias("timeout"), F.greatest(F.floor(F.col("n") * F.lit(0.8) * 30.0), F.lit(1)).cast("long").alias("cap"))
