"""Mixing sources to target weights, without sorting documents (operator 5).

A source's target is met by whole copies of all its documents and then by those documents
whose hash lies under a threshold. The threshold comes from nested histograms: words are summed
by source and by the highest bits of the hash; the bucket in which a source's budget ends
is the only one that the next level refines. Everything is DataFrame expressions.

Defined cases: a null text has no words; sources sort by code point, null last; a document
without words is taken with 0 words; rows with the same id (or, where the id is null, the same text)
share a hash and are taken together; the document in which the budget ends is taken where that comes
nearer to the target; an empty table gives an empty result; texts may be of any length, all of whose words count; other
columns, `its_source` and `copies` among them, come along in the stage and aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Bits of a level, and levels: the hash has BITS * LEVELS bits.
BITS, LEVELS = 12, 5
#: Sources up to which the table of sources is broadcast; beyond, joins shuffle.
BROADCAST_SOURCES = 100_000


def placed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size and a hash of 60 bits, and the columns in more."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(named), 1, BITS * LEVELS // 4), 16, 10).cast("long").alias("hash"), *more,
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The target of each row of sizes (source, source_size).

    All targets together are `share` of all words, dealt by weight; none exceeds `repeats` times
    its source. That is one level of water: sources fill in the order of room for their weight.
    The windows run over one row a source, not over documents.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)) + 1).cast("int"))
    room = (F.col("source_size") * repeats).cast("double")
    filling = Window.orderBy(F.col("room") / F.col("weight"), F.asc_nulls_last("source"))
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.withColumn("weight", weight).withColumn("room", room)
    t = t.withColumn("left", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("room").over(before), F.lit(0.0))).withColumn("level", F.col("left") / F.sum("weight").over(after))
    t = t.withColumn("level", F.when(F.col("room") > F.col("weight") * F.col("level"), F.col("level")))
    t = t.withColumn("level", F.max("level").over(everything))  # the first source that isn't full has the highest
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("room")).otherwise(F.least("room", F.col("weight") * F.col("level"))).alias("target"))


def join_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with the columns of their source, null being a source too."""
    right = sources.withColumnRenamed("source", "its_source")
    return rows.join(F.broadcast(right) if few else right, rows.source.eqNullSafe(right.its_source)).drop("its_source")


def thresholds(scratch: C.Scratch, rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """sources with below: documents whose hash is less are taken once more than `copies` times.

    budget is what whole copies leave of the target. A level finds the bucket in which the words
    of the buckets before and its own pass the budget; `low` is where that bucket begins.
    """
    state = sources.withColumns({"low": F.lit(0).cast("long"), "spent": F.lit(0).cast("long"), "inside": F.col("source_size")})
    for level in range(LEVELS):
        width = 1 << BITS * (LEVELS - 1 - level)
        inside = join_sources(rows.select("source", "size", "hash"), state.select("source", "low", "budget", "spent"), few)
        if level:
            inside = inside.filter((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + width * (1 << BITS)))
        bucket = F.expr(f"low + (hash - low) div {width} * {width}")
        buckets = inside.groupBy("source", bucket.alias("begin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("budget").alias("budget"), F.first("spent").alias("spent"))
        up_to = F.col("spent") + F.sum("words").over(Window.partitionBy("source").orderBy("begin"))
        ends = buckets.withColumn("up_to", up_to).filter(F.col("up_to") > F.col("budget"))
        ends = ends.groupBy("source").agg(F.min(F.struct("begin", "up_to", "words", "rows")).alias("end"))
        ends = ends.select(F.col("source").alias("end_source"), "end")
        kept = [c for c in state.columns if c not in ("low", "spent", "inside", "rows")]
        # no bucket passes the budget where a source is taken whole: its threshold lies above all hashes
        state = scratch.keep(state.join(ends, state.source.eqNullSafe(ends.end_source), "left").select(
            *kept, F.coalesce("end.begin", F.when(F.lit(level == 0), F.lit(1 << BITS * LEVELS)).otherwise(F.col("low"))).cast("long").alias("low"),
            F.coalesce(F.col("end.up_to") - F.col("end.words"), "spent").alias("spent"), F.coalesce("end.words", F.lit(0)).cast("long").alias("inside"), F.coalesce("end.rows", F.lit(0)).cast("long").alias("rows"),
        ))
        if not state.filter("rows > 1").limit(1).count():
            break
    # the last bucket, which mostly holds one document, goes in where that comes nearer to the budget
    nearer = F.col("spent") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("spent")
    return state.withColumn("below", F.when(nearer, F.col("low") + width).otherwise(F.col("low")))


def plan(scratch: C.Scratch, rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, bool]:
    """(source, source_size, target, copies, below) for rows of `placed`, and whether it may be broadcast."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = targets(sizes, weights, share, repeats).withColumn("copies", copies)
    sources = scratch.keep(sources.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")))
    few = sources.count() <= BROADCAST_SOURCES
    found = thresholds(scratch, rows, sources, few)
    return found.select("source", "source_size", "target", "copies", "below"), few


def taken(rows: DataFrame, found: DataFrame, few: bool, repeats: int = REPEATS) -> DataFrame:
    """rows of `placed` with source_size, target and copies, of which a document under its threshold gets one more."""
    extra = F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return join_sources(rows, found, few).withColumn("copies", F.least(F.col("copies") + extra, F.lit(repeats)).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of docs."""
    C.check_columns(docs, "doc_id", "text", "source")
    scratch = C.Scratch(docs.sparkSession)
    rows = scratch.keep(placed(docs))
    out = taken(rows, *plan(scratch, rows, weights, share, repeats), repeats)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op5(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same by running sums over all documents of a source in hash order.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS room FROM s),
f AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM w),
l AS (SELECT max(level) AS level FROM f WHERE room > weight * level),
t AS (SELECT source, source_size, CASE WHEN l.level IS NULL THEN room ELSE least(room, weight * l.level) END AS target FROM w, l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
b AS (SELECT *, target - copies * source_size AS budget FROM c),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.copies, b.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS up_to,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(2, copies + CASE WHEN up_to <= budget OR (up_to - own <= budget AND up_to - budget < budget - (up_to - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns; texts aren't shuffled."""
    scratch = C.Scratch(spark)
    found, few = plan(scratch, scratch.keep(placed(docs)))
    row = "longleaf_row"
    rows = docs.select(F.struct("*").alias(row), "doc_id", "text", "source")
    rows = placed(rows, row)
    copies = F.explode(F.array_repeat(F.col(row), F.col("copies")))
    return taken(rows, found, few).filter("copies > 0").select(copies.alias(row)).select(f"{row}.*")
