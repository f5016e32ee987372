"""Queries of costs and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.operators.packing import pack
from longleaf.registry import TOKENS, query, read

#: Output tokens for one of input, and price of a million tokens in, cached and out.
OUTPUT, RATES = 1.15, (0.5, 0.1, 1.5)
#: Passes with their shares of input and output; fixed values.
PASSES = (("translate", 1.0, 1.15), ("qa", 1.25, 0.20), ("double_check", 1.5, 0.15))


def cost(tokens_in, cached, tokens_out, rates=RATES):
    """Price of a request: input that isn't cached, cached input, output; null where a rate is."""
    rate_in, rate_cached, rate_out = rates
    return (F.greatest(tokens_in - cached, F.lit(0)) / F.lit(1e6) * rate_in) + (cached / F.lit(1e6) * rate_cached) + (tokens_out / F.lit(1e6) * rate_out)


_COST = "(greatest(tin - cached, 0) / 1e6 * 0.5 + cached / 1e6 * 0.1 + tout / 1e6 * 1.5)"


@query(f"""WITH t AS (SELECT source, {TOKENS} AS t FROM documents), s AS (SELECT source, count(*) AS segments, CAST(sum(t) AS BIGINT) AS tin, CAST(sum(t) // 10 AS BIGINT) AS cached, CAST(ceil(sum(t) * {OUTPUT}::DOUBLE) AS BIGINT) AS tout FROM t GROUP BY source)
SELECT source, segments, tin AS tokens_in, tout AS tokens_out, round({_COST}, 6) AS usd FROM s""")
def book_estimate(spark, d):
    """Tokens and price of a book before it is done."""
    rows = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("segments"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens_in"))
    rows = rows.withColumn("tokens_out", F.ceil(F.col("tokens_in") * F.lit(OUTPUT)))
    return rows.withColumn("usd", F.round(cost(F.col("tokens_in"), F.floor(F.col("tokens_in") / 10), F.col("tokens_out")), 6))


_PASS_SQL = " UNION ALL ".join(f"SELECT '{p}' AS pass, {i}::DOUBLE AS share_in, {o}::DOUBLE AS share_out" for p, i, o in PASSES)


@query(f"""WITH t AS (SELECT source, CAST(sum({TOKENS}) AS BIGINT) AS t FROM documents GROUP BY source), p AS ({_PASS_SQL})
SELECT source, pass, CAST(ceil(t * share_in) AS BIGINT) AS tokens_in, CAST(ceil(t * share_out) AS BIGINT) AS tokens_out FROM t, p WHERE t > 0""")
def pass_costs(spark, d):
    """Tokens of each pass over a book; books without any have no rows."""
    rows = read(spark, d, "documents").groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("t")).filter("t > 0")
    passes = F.array(*[F.struct(F.lit(p).alias("pass"), F.lit(i).alias("i"), F.lit(o).alias("o")) for p, i, o in PASSES])
    rows = rows.select("source", "t", F.explode(passes).alias("p"))
    return rows.select("source", "p.pass", F.ceil(F.col("t") * F.col("p.i")).alias("tokens_in"), F.ceil(F.col("t") * F.col("p.o")).alias("tokens_out"))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, greatest({TOKENS}, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT conv_id, k, c, c AS used, 0 AS chunk FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, t.c, CASE WHEN used + t.c > 60 THEN t.c ELSE used + t.c END, chunk + CASE WHEN used + t.c > 60 THEN 1 ELSE 0 END FROM p JOIN t ON t.conv_id = p.conv_id AND t.k = p.k + 1)
SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS items, CAST(sum(c) AS BIGINT) AS tokens FROM p GROUP BY conv_id, chunk""")
def chunk_by_budget(spark, d):
    """Items in order, each at least one token, in chunks of at most 60."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.greatest(T.estimate_tokens(F.col("text")), F.lit(1)).alias("tokens"))
    return pack(rows, "conv_id", "turn", "tokens", 60).groupBy("conv_id", F.col("segment").alias("chunk")).agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


@query(f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS c FROM conversations), e AS (SELECT conv_id, CAST(sum(c) AS BIGINT) AS total, count(*) AS items FROM t GROUP BY conv_id)
SELECT conv_id, total + 128 + 64 * items AS expected_output, least(greatest(2 * (total + 128), total + 128 + 2048), 8192) AS escalated, (total + 128) * 3 / 30.0::DOUBLE > 0.8 * 60 AS split FROM e""")
def output_budgets(spark, d):
    """Output that a batch is expected to need, its next larger cap, and whether its latency warrants a split."""
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("total"), F.count("*").alias("items"))
    base = F.col("total") + 128
    return rows.select("conv_id", (base + 64 * F.col("items")).alias("expected_output"), F.least(F.greatest(2 * base, base + 2048), F.lit(8192)).alias("escalated"), (base * 3 / F.lit(30.0) > F.lit(0.8) * 60).alias("split"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), t AS (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS k, n FROM conversations c JOIN n ON n.conv_id = c.conv_id)
SELECT conv_id || CASE WHEN n = 1 THEN '' WHEN k <= n // 2 THEN '_split_0' ELSE '_split_1' END AS batch, count(*) AS items FROM t GROUP BY 1""")
def split_batches(spark, d):
    """Batches halved in order; one of a single item stays as it is."""
    n = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    half = F.floor(F.col("n") / 2)
    part = F.explode(F.when(F.col("n") == 1, F.array(F.struct(F.lit("").alias("s"), F.col("n").alias("items")))).otherwise(F.array(F.struct(F.lit("_split_0").alias("s"), half.alias("items")), F.struct(F.lit("_split_1").alias("s"), (F.col("n") - half).alias("items")))))
    return n.select("conv_id", part.alias("p")).select(F.concat("conv_id", "p.s").alias("batch"), "p.items")
