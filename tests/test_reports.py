"""Reports by hand-made rows: pages, strategies, latencies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from longleaf.plans import reports as R


def test_low_confidence(spark):
    rows = [(95, 0, 100, False), (94, 0, 100, False), (90, 5, 100, False), (0, 0, 0, False), (0, 0, 0, True), (100, 0, 100, True)]
    frame = spark.createDataFrame(rows, "chars long, running long, baseline long, image_only boolean")
    got = [r.low for r in frame.select(R.low_confidence(*map(F.col, frame.columns)).alias("low")).collect()]
    assert got == [False, True, False, False, True, True]


def test_strategy_of_ties_is_recurrence(spark):
    frame = spark.createDataFrame([(3, 2), (2, 2), (0, 0), (1, 5)], "cased long, caseless long")
    got = [r.s for r in frame.select(R.extraction_strategy(F.col("cased"), F.col("caseless")).alias("s")).collect()]
    assert got == ["capitalization", "recurrence", "recurrence", "recurrence"]


def test_pages_end_at_form_feeds(spark, tmp_path):
    spark.createDataFrame([(1, "ab c\fd1.\f"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in R.page_confidence(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 3, 3, False), (1, 1, 3, 1, True), (1, 2, 0, 0, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False)]


def test_rolling_p95(spark):
    frame = spark.createDataFrame([(k, None if k in (0, 1) else float(k)) for k in range(30)], "k long, x double")
    late = Window.partitionBy(F.lit(1)).orderBy("k").rowsBetween(-19, 0)
    got = [r.p for r in frame.select("k", R.rolling_p95(F.col("x"), late).alias("p")).orderBy("k").collect()]
    want = []
    for k in range(30):
        seen = sorted(float(i) for i in range(max(0, k - 19), k + 1) if i > 1)
        want.append(seen[-(-len(seen) * 95 // 100) - 1] if seen else None)
    assert got == want
