"""Functions that walk texts, by cases and by rules they must keep."""

import json
import random

import pytest
from pyspark.sql import functions as F

from longleaf.functions import markers as M
from longleaf.functions import responses as R
from longleaf.functions import sentences as S
from longleaf.functions import spans as P


def test_marker_scan():
    text = "a<m1>b<r2/>c</m1><m id='x'>d</m><ref id=\"n\"/><r3><ref id=q><keep k>e</keep><m9/><m <m4>f</m4>"
    assert M.ids(text) == ["m1", "r2", "x", "n", "m9", "m4"]
    assert M.strip("x < y <m1>b</m1> <r2/></m2/>") == "x < y b </m2/>"
    assert M.inner_texts("<m1>a<m2>b</m1>c</m2>") == [("m1", "ab"), ("m2", "b")] and M.inner_texts("</m1>x<m3>y") == []
    assert M.structure_error("<m1>a</m1><r1/>") is None
    assert M.structure_error("<m1>a") == "inline marker <m1> is missing closing tag </m1>"
    assert M.structure_error("a</m2>") == "unexpected inline marker close </m2>" and M.structure_error("<m1><m2></m1></m2>") == "inline marker <m2> is closed by </m1>"
    assert [M.reference(t) for t in (" *2 ", "[12]", "a1", "", "123456789", "...", "†", "²")] == ["*2", "[12]", None, None, None, None, "†", "²"]
    assert M.lost_reference("w<m0><m1>*2</m1></m0>", "w<m0><m1></m1></m0>") == "inline marker m1 lost its reference text '*2'"
    assert M.lost_reference("w<m1>1.000</m1>", "w<m1>1,000</m1>") is None and M.lost_reference("<m1>prose</m1>", "<m1></m1>") is None
    assert M.differences("<m1>a</m1><r2/>", "<m1>a</m1><m1>b</m1><r7/>") == [("missing", "r2"), ("duplicated", "m1"), ("unknown", "r7")]


@pytest.mark.parametrize("token, forms", [("1.234", ["1234", "1.234"]), ("1,234.5", ["1234.5"]), ("1.234.567", ["1234567"]), ("12,5%", ["12.5%"]), ("−3", ["-3"]), ("90 000 000", ["90000000"]), ("1.23.4", []), ("1,23,456", []), ("x", []), ("1.", []), ("1234,567", ["1234.567"])])
def test_readings(token, forms):
    assert P.readings(token) == forms


def test_spans_are_kept():
    assert P.kept("1,234.5", "es sind 1.234,5 Meter") and P.kept("1914-", "x") and P.kept("12:30", "um 12 : 30") and P.kept("3.5%", "3,5% mehr")
    assert P.kept("15", "150") and not P.kept("7", "70") and not P.kept("http://a.b", "http://a.bc") and P.kept("a.txt", "die a.txt.") and not P.kept("7 7", "nur 7")
    assert [P.kind(v) for v in ("http://x", "#a", "a@b.c", "@k", "3rd", "10/12", "x=1", "a.PDF", "word", "f(x)=y", "#")] == ["url", "internal_anchor", "email", "citation", "number", "number", "math", "filename", None, "math", None]
    assert P.protected("see Capitolo IV, (12) and x = y; [@ref] a.md.") == [("number", "12"), ("number", "IV"), ("citation", "[@ref]"), ("filename", "a.md"), ("math", "x = y")]
    assert P.lost("In 1999, 7 of all but 12 May", "In 1999") == [("number", "12", "error"), ("number", "7", "warning")]
    assert P.dangling("12–") and P.compact("(12 / 34)") == "12/34" and P.compact("1") is None and P.decimal("−2,5%") == "-2.5%" and P.decimal("1,2.3") is None


def test_answers_are_read():
    good = {"items": [{"id": "a", "translation": "eins"}, {"id": "b", "translation": "zwei"}]}
    want = {"a": "one", "b": "two"}
    for text in (json.dumps(good), "```json\n" + json.dumps(good) + "\n```", "Sure: " + json.dumps(good) + " done {"):
        assert R.read_items(text, want) == ([("a", "eins"), ("b", "zwei")], [], None)
    quoted = '{"items":[{"id":"a","translation":"un "esempio", qui"},{"id":"b","translation":"x"}]}'
    assert R.read_items(quoted, want)[0][0] == ("a", 'un "esempio", qui') and R.escaped_quotes(quoted)[1] == 2
    assert R.read_items(json.dumps({"items": good["items"][:1]}), want)[2].startswith("batch response incomplete") and R.read_items("nothing", want)[2] == "invalid batch JSON"
    twice = {"items": [*good["items"], good["items"][0], {"id": "q", "translation": ""}, {"id": "q", "translation": ""}]}
    assert [f[0] for f in R.read_items(json.dumps(twice), want)[1]] == ["a", "q"]
    assert R.read_items(json.dumps(good), {"a": "one <m1>x</m1>", "b": ""})[1] == [("a", "inline marker missing: m1")]
    assert R.outermost('x [1, {"a": "]"}] y') == '[1, {"a": "]"}]' and R.outermost("{[}") is None and R.outermost("none") is None
    assert not R._plain({"items": [{"other": 1}]}) and R.decoded('{"id": "a" "b"') is None


def test_sentences():
    assert S.sentences("Mr. X came. He left! Did he? 3.14 is pi…") == ["Mr. X came.", "He left!", "Did he?", "3.14 is pi…"]
    assert S.sentences("他说。“好！”然后走了。") == ["他说。", "“好！”", "然后走了。"] and S.sentences("Head\n\nBody J. R. Smith. End") == ["Head", "Body J. R. Smith.", "End"]
    assert S.narrated("One two. Three four. Five", 10) == ["One two.", "Three", "four.", "Five"] and S.narrated("", 5) == []
    assert S.pieces("一二、三四五，六", 4) == ["一二、", "三四五，", "六"] and S.slices("abcdef", 4) == ["abcd", "ef"]
    rnd = random.Random(3)
    for _ in range(100):
        text = "".join(rnd.choice("ab .!?\n…。，x") for _ in range(rnd.randint(0, 60)))
        assert "".join("".join(S.sentences(text)).split()) == "".join(text.split())
        n = rnd.randint(1, 12)
        assert all(0 < len(p) <= n for p in S.narrated(text, n)) and "".join("".join(S.narrated(text, n)).split()) == "".join(text.split())
    assert [S.chapter(t) for t in ("Chapter 7: x", "CAPITOLO iv", "lipu nanpa VI", "Kapitelo tu", "chapters 1", "Chapter one")] == ["chapter 7", "capitolo IV", "lipu nanpa VI", "KAPITELO TU", None, None]
    assert S.contents_entry("Cap. IV ... pag. 3") and S.contents_entry("cap. 12 a") and not S.contents_entry("Caps are nice")


def test_as_columns(spark):
    rows = spark.createDataFrame([("<m1>a", "x 12. y"), (None, None)], "m string, t string")
    got = rows.select(M.marker_error("m").alias("e"), P.protected_spans("t").alias("p"), S.sentence_array("t").alias("s"), R.block_violations("t", "m", F.lit("paragraph")).alias("v")).collect()
    assert got[0].e.startswith("inline marker") and got[0].p == [("number", "12")] and got[0].s == ["x 12.", "y"] and got[1].e is None
    assert [v.kind for v in got[0].v] == ["marker_structure", "inline_marker_unknown", "protected_span_missing"]
