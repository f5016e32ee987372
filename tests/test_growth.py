"""Work and memory grow no faster than the input."""

import time

import pytest
from pyspark.sql import functions as F

from longleaf import catalog
from longleaf.functions import sentences as S
from longleaf.functions import spans as P

DATA = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_target_is_read_once_for_all_spans(monkeypatch):
    calls = []
    real = P.decimal
    monkeypatch.setattr(P, "decimal", lambda v: calls.append(v) or real(v))
    n = 300
    lost = P.lost(" ".join(f"{i},5x {i}.25" for i in range(n)), " ".join(f"{i}.75" for i in range(n)))
    assert [t for _, t, _ in lost if t == "7.25"] == ["7.25"] and len(calls) <= 4 * n  # each span alone read all numbers of the target


def test_months_are_found_once():
    text = " ".join(f"{i % 100} word word" for i in range(60_000))
    began = time.process_time()
    assert len(P.lost(text, "")) == 100
    assert time.process_time() - began < 20  # the words before and after each occurrence of each number were all read again


@pytest.mark.parametrize(("source", "target", "lost"), [
    ("x, = y", "x, = y", [("math", "x = y", "warning")]), ("x = y", "x = y", []), ("12 March", "March", [("number", "12", "error")]),
    ("1,5 1,5", "1.5", []), ("#a-1", "see #a-1.", []), ("#a-1", "#a-12", [("internal_anchor", "#a-1", "error")]),
])
def test_lost_spans(source, target, lost):
    assert [x for x in P.lost(source, target) if x[1] != "March"] == lost


def test_abbreviations_before_other_ends():
    assert S.sentences("Dr. Who? No. 5 e. Then! Yes! end.") == ["Dr. Who? No. 5 e. Then! Yes! end."]
    assert S.sentences("No way. Mr! x, est. A? B") == ["No way.", "Mr!", "x, est. A? B"]
    text = "Mr. " + "word? " * 40_000
    began = time.process_time()
    assert S.sentences(text) == [text.strip()]
    assert time.process_time() - began < 5


def test_pieces_know_their_neighbours_without_a_shuffle(spark):
    rows = catalog.QUERIES["narration_plan"](spark, DATA)
    assert "Exchange" not in plan(rows)
    rows = rows.filter("doc_id % 10 = 0").orderBy("doc_id", "place").collect()
    assert any(r.place for r in rows)
    for a, b in zip(rows, rows[1:], strict=False):
        assert (b.before is None) == (b.place == 0) and (a.after is None) == (a.doc_id != b.doc_id)


def test_batches_of_texts_are_short(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("One. Two"), "id").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["narration_coverage"](spark, str(tmp_path))
    assert rows.filter("any and too_long = 0").count() == 3000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_word_kinds_are_counted_in_their_row(spark):
    rows = catalog.QUERIES["protected_span_kinds"](spark, DATA)
    assert "ArrowEvalPython" in plan(rows)  # not one row a word by patterns over each character
    from longleaf.plans.scalars import _word_kinds

    assert _word_kinds("(https://a.b/c) x@y.org, 12. 3rd\x1cx 4th #a　[@b] plain hy-phen") == [{"kind": k, "n": 1} for k in ("url", "email")] + [{"kind": "number", "n": 2}] + [{"kind": k, "n": 1} for k in ("anchor", "citation")]


def test_repetition_by_words(spark):
    from longleaf.functions import findings

    cases = {"no No, (no) NO": True, "no no no": False, "no no no-no no": False, "é - x x … x é x": True, "a\x1ca a a a": False, "Kk k k k": True, "İ x x x x": True, "": False, "- - - -": False}
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", findings.repetition(F.col("t")).alias("r"))
    assert "ArrowEvalPython" in plan(rows)  # not three patterns over each character
    assert {r.t: r.r for r in rows.collect()} == {**cases, None: False}


def test_words_of_documents_are_counted_in_their_row(spark, tmp_path):
    rows = catalog.QUERIES["candidate_tfidf"](spark, DATA)
    assert "hashpartitioning(book" in plan(rows) and "doc_id" not in plan(rows).split("Exchange hashpartitioning(book", 1)[1].split("\n", 1)[0]
    docs = [(1, "b", "One one two"), (1, "b", "two tree tree"), (2, "b", "two"), (3, "b", None), (4, None, "x xx xx")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["candidate_tfidf"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("", "xx", 2, 1), ("b", "one", 2, 1), ("b", "tree", 2, 1), ("b", "two", 3, 2)]


@pytest.mark.parametrize("name", ["attempt_ordinal_append", "job_summary"])
def test_tasks_follow_the_size_of_tables(spark, monkeypatch, name):
    from longleaf import registry

    before = sorted(map(repr, catalog.QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(registry, "SHARE", 4096)
    rows = catalog.QUERIES[name](spark, DATA)
    assert "REPARTITION_BY_NUM" in plan(rows)
    assert plan(rows).count("Sort [l_orderkey") <= 2 and sorted(map(repr, rows.collect())) == before
