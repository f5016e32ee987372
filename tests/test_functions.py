"""Column functions and operators on literal cases, and against brute force."""

import random

import pandas as pd
from pyspark.sql import functions as F

from longleaf.functions import findings, numbers
from longleaf.operators import terms
from longleaf.plans import estimates, quality


def column(spark, cases, f):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string")
    return [r.v for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_canonical_decimal(spark):
    cases = {"3,14": "3.14", "(1.5)": "1.5", "−7%": "-7%", "1,000.5": None, "5.": "5", "abc": None, "12": "12", ".5": "5", "1.%": None, "": None}
    assert column(spark, cases, numbers.canonical_decimal) == list(cases.values())
    assert column(spark, [None], numbers.canonical_decimal) == [None]


def test_folio(spark):
    cases = {"12": (False, 12), " iv ": (True, 4), "MCMXC": (True, 1990), "12345": None, "page": None, "": None}
    got = column(spark, cases, numbers.folio)
    assert [r and tuple(r) for r in got] == list(cases.values())


def test_failure_kind(spark):
    cases = {
        "provider error: interrupted by user": "interrupted", "Translation interrupted before all blocks completed": "interrupted", "Protected span missing: x": "protected_span_missing",
        "m1 is closed by m2": "marker_structure", "HTTP status 500": "provider_error", "": "other",
    }
    assert column(spark, cases, findings.failure_kind) == list(cases.values())


def test_repetition(spark):
    cases = {"no No, no! NO": True, "a a a b a": False, "": False, "x " * 3: False, "... go go go go": True, "- a - a - a - a": True}
    assert column(spark, cases, findings.repetition) == list(cases.values())
    assert column(spark, [None], findings.repetition) == [False]


def test_commentary(spark):
    cases = {"  Here is the text": True, "Certainly": True, "There is": False, "I speak as an AI": True, "": False}
    assert column(spark, cases, findings.commentary) == list(cases.values())


def test_match_terms_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "Ab" * 500] + ["".join(rng.choice("abcAB ") for _ in range(40)) for _ in range(60)]
    words = [None, "", "ab"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    want = {(k, i) for k, t in enumerate(texts) for i, w in enumerate(words) if t and w and w.lower() in t.lower()}
    a, b = spark.createDataFrame(list(enumerate(texts)), "k int, text string"), spark.createDataFrame(list(enumerate(words)), "term_id int, term string")
    for block in (1000, 7):  # one automaton, and several
        monkeypatch.setattr(terms, "BLOCK", block)
        got = [tuple(r) for r in terms.match_terms(a, b, ["k"]).collect()]
        assert set(got) == want and len(got) == len(want)
    assert terms.match_terms(a, b.limit(0), ["k"]).count() == 0


def test_within_budget(spark):
    df = spark.createDataFrame([(0, [(1, 5), (2, 9), (3, 4), (4, 1)]), (1, [])], "k int, items array<struct<id:int,cost:int>>")
    got = df.select("k", terms.within_budget(F.col("items"), "cost", 10).alias("kept")).orderBy("k").collect()
    assert [[x.id for x in r.kept] for r in got] == [[1, 3, 4], []]


def test_source_copies(spark):
    long = " ".join(f"word{k}" for k in range(50))
    rows = [(0, long, long.upper()), (1, long, long.replace("word7 ", "")), (2, long, "nothing of it"), (3, "Short text", "short TEXT"), (4, "Short text", "other"), (5, "1 2 3", "1 2 3"), (6, "", "")]
    got = quality.source_copies(spark.createDataFrame(rows, "doc_id int, source string, target string")).orderBy("doc_id").toPandas()
    assert list(got["copied"]) == [True, True, False, True, False, False, False]
    assert list(got["overlap"])[:3] == [50, 49, 0]


def test_cost(spark):
    df = spark.createDataFrame(pd.DataFrame({"i": [1_000_000, 10], "c": [200_000, 20], "o": [500_000, 0]}))
    got = [r.usd for r in df.select(F.round(estimates.cost(F.col("i"), F.col("c"), F.col("o")), 9).alias("usd")).collect()]
    assert got == [0.4 + 0.02 + 0.75, 0.000002]
