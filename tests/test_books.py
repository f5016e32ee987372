"""Books both ways, calls of models, and pages of printed text."""

import io
import json
import random
import zipfile

import pytest

from longleaf.functions import layout as L
from longleaf.operators import provider as P
from longleaf.sources import books as B

XHTML = '<html><head><title>T</title></head><body><h1>One &amp; two</h1><p class="a">Hello <b>big <i>world</i></b>, 5 &lt; 6<br/>end.</p><script>x</script><ul><li>a<p>b</p></li></ul><p> </p></body></html>'
OPF = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>My book</dc:title><dc:language>en</dc:language></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b%20c.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="a"/></spine></package>'


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", OPF)
        z.writestr("OEBPS/a.xhtml", XHTML)
        z.writestr("OEBPS/b c.xhtml", "<html><body><p>Second.</p></body></html>")
        z.writestr("OEBPS/i.png", bytes(range(256)))
    return out.getvalue()


def test_blocks_have_markers_and_go_back():
    found = B.marked_blocks(XHTML)
    assert [(b.kind, b.level, b.text) for b in found] == [("heading", 1, "One & two"), ("paragraph", None, "Hello <m0>big <m1>world</m1></m0>, 5 ＜ 6<r0/>end."), ("list_item", None, "a<m0>b</m0>")]
    assert B.patched(XHTML, {i: b.text for i, b in enumerate(found)}) == XHTML
    out = B.patched(XHTML, {1: "Ciao, <m0>mondo <m1>grande</m1></m0> & 5<r0/>fine."})
    assert '<p class="a">Ciao, <b>mondo <i>grande</i></b> &amp; 5<br/>fine.</p>' in out and out.count("One &amp; two") == 1
    for wrong in ({7: "x"}, {1: "no markers"}, {1: "<m0><m1>a</m0></m1><r0/>"}, {0: "a<m3>b</m3>"}):
        with pytest.raises(ValueError):
            B.patched(XHTML, wrong)


def test_books_are_rebuilt(spark):
    data = book()
    told = B.inspected(data)
    assert (told["title"], told["language"], told["resources"], told["blocks"], told["coverage"]) == ("My book", "en", 2, 4, 1.0)
    new = B.rebuilt(data, {"OEBPS/a.xhtml": {0: "Uno"}}, "Italian")
    with zipfile.ZipFile(io.BytesIO(new)) as z, zipfile.ZipFile(io.BytesIO(data)) as old:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "<dc:language>it</dc:language>" in z.read("OEBPS/p.opf").decode() and "<h1>Uno</h1>" in z.read("OEBPS/a.xhtml").decode()
        assert all(z.read(n) == old.read(n) for n in ("OEBPS/b c.xhtml", "OEBPS/i.png", "META-INF/container.xml", "mimetype"))
    assert B.rebuilt(data, {"OEBPS/a.xhtml": {0: "Uno"}}, "Italian") == new
    books = spark.createDataFrame([("x", bytearray(data)), ("y", bytearray(data)), ("z", bytearray(data)), ("w", bytearray(b"no"))], "path string, content binary")
    rows = B.marked_book_blocks(books.filter("path <> 'w'")).collect()
    assert len(rows) == 12 and {r.href for r in rows} == {"OEBPS/a.xhtml", "OEBPS/b c.xhtml"}
    told = {r.path: r for r in B.inspect_books(books).collect()}
    assert told["x"].blocks == 4 and told["x"].title == "My book" and told["w"].error == "not an archive"
    same = [(r.path, r.href, r.ordinal, r.text) for r in rows if r.path == "x"] + [("y", "OEBPS/a.xhtml", 0, "A")] * 2 + [("z", "OEBPS/q.xhtml", 0, "A")]
    out = {r.path: r for r in B.rebuild_books(books.filter("path <> 'w'"), spark.createDataFrame(same, "path string, href string, ordinal int, text string")).collect()}
    assert out["y"].error == "a block has two translations" and out["z"].error == "no resource OEBPS/q.xhtml"
    with zipfile.ZipFile(io.BytesIO(bytes(out["x"].content))) as z, zipfile.ZipFile(io.BytesIO(data)) as old:
        assert all(z.read(n) == old.read(n) for n in old.namelist())
    assert B.language_tag("Toki Pona") == "tok" and B.language_tag("pt_BR") == "pt-br"


def test_models_are_called_in_rounds(spark):
    items = [("a", "one"), ("b", "two <m1>x</m1>"), ("c", "three")]
    done, errors, requests, sent, got = P.rounds(items, P.mock("prefix"), "en", "it")
    assert done == {"a": "[it] one", "b": "[it] two <m1>x</m1>", "c": "[it] three"} and not errors and requests == 1 and sent > 0 < got
    done, errors, requests, *_ = P.rounds(items, P.mock("malformed"), "en", "it")
    assert not done and set(errors) == {"a", "b", "c"} and requests == 1 + 2 + 3
    calls = []

    def lossy(text):  # loses markers the first time, and an item of each larger request
        rows = json.loads(text[text.index("{") :])["items"]
        calls.append(len(rows))
        return json.dumps({"items": [{"id": r["id"], "translation": r["text"] if len(rows) == 1 else "two"} for r in rows]})

    done, errors, requests, *_ = P.rounds(items, lossy, "en", "it")
    assert done == {"a": "two", "c": "two", "b": "two <m1>x</m1>"} and not errors and calls == [3, 1]
    assert P.apportioned(10, [1, 1, 1]) == [3, 3, 4] and P.apportioned(5, []) == [] and P.output_budget(10, 1) == 512 and P.output_budget(10_000, 1) == 8192 and P.output_budget(10_000, 1, 7000, 8000) == 1000
    assert "cat => gatto" in P.prompt([("a", "The Cat")], "en", "it", [("cat", "gatto"), ("dog", "cane")]) and "cane" not in P.prompt([("a", "The Cat")], "en", "it", [("dog", "cane")])
    frame = spark.createDataFrame([(i // 4, i, f"text {i}") for i in range(30)], "batch int, item int, text string")
    out = P.translate(frame, P.mock("upper")).collect()
    assert len(out) == 30 and all(r.translation == f"TEXT {r.item}" and r.error is None and r.tokens_in > 0 for r in out)


def test_pages_are_read(spark):
    rnd = random.Random(2)
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    column = lambda left, n, size=12: [(100 + 15 * i, left, 240, 12, size, words(4)) for i in range(n)]
    page = [(60, 50, 500, 20, 20, "A heading")] + column(50, 12) + column(330, 12)
    found = L.lines(page)
    assert L.two_columns(600, found) and not L.two_columns(600, L.lines(column(50, 12)))
    order = L.ordered(600, found)
    assert order[0].text == "A heading" and [x.left for x in order[1:]] == [50] * 12 + [330] * 12
    assert [x.text for x in L.lines([(10, 0, 30, 10, 10, "left"), (12, 35, 30, 10, 10, "word"), (10, 200, 30, 10, 10, "far")])] == ["left word", "far"]
    pages = [(n, 600, 800, [(20, 50, 100, 10, 10, "Running head"), (780, 290, 20, 10, 10, str(n)), (120, 50, 500, 12, 12, f"Page {n} begins and goes to a hyphen-"), (135, 50, 500, 12, 12, "ated word which isn't"), (150, 50, 500, 12, 12, "at its end")]) for n in (1, 2, 3)]
    pages[1][3][2] = (120, 50, 500, 12, 12, "but continues here.")
    out = L.read_pages(pages)
    assert [t for *_, t in out] == ["Page 1 begins and goes to a hyphenated word which isn't at its end but continues here. ated word which isn't at its end", "Page 3 begins and goes to a hyphenated word which isn't at its end"]
    assert L.heading_levels([(12, 1000), (20, 10), (16, 20), (8, 5)]) == {20: 1, 16: 2} and L.body_size([]) == 0
    rows = spark.createDataFrame([("d", n, w, h, *f) for n, w, h, fs in pages for f in fs], "doc string, page int, page_width int, page_height int, top int, left int, width int, height int, size int, text string")
    assert [r.text for r in L.page_texts(rows).orderBy("ordinal").collect()] == [t for *_, t in out]
