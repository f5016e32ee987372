"""Decoders of books and pages."""

import io
import zipfile

import pytest

from longleaf.sources import blocks as B

PAGE = "<html><head><title>T</title></head><body><h2>A&nbsp;b</h2><p>one <b>two</b><br/>three<script>no</script></p>loose<ul><li>x<p>y</p></li></ul></body></html>"
WANT = [("heading", 2, "A b"), ("paragraph", None, "one two three"), ("paragraph", None, "loose"), ("list_item", None, "x y")]


def book(pages, spine=None, first="mimetype"):
    at = io.BytesIO()
    with zipfile.ZipFile(at, "w") as z:
        z.writestr(first, "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{n}"/>' for k, n in enumerate(pages))
        refs = "".join(f'<itemref idref="{r}"/>' for r in (spine or [f"i{k}" for k in range(len(pages))]))
        z.writestr("O/p.opf", f'<package xmlns="o"><metadata>&eacute;</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for n, text in pages.items():
            z.writestr("O/" + n, text)
    return at.getvalue()


def test_markup_blocks():
    assert B.markup_blocks(PAGE) == WANT
    assert B.markup_blocks("") == B.markup_blocks(None) == []
    assert B.markup_blocks("<p>never closed") == [("paragraph", None, "never closed")]
    assert B.markup_blocks("<div><p>a</div>b") == [("paragraph", None, "a"), ("paragraph", None, "b")]


def test_book_blocks():
    got = B.book_blocks(book({"a.xhtml": PAGE, "b.xhtml": "<p>z</p>"}, ["i1", "i0", "i1"]))
    assert [g[:3] for g in got] == [("O/b.xhtml", 0, 0)] + [("O/a.xhtml", 1, n) for n in range(4)]
    assert [g[3:] for g in got[1:]] == WANT


@pytest.mark.parametrize("data", [b"", b"junk", book({"a.xhtml": PAGE}, first="other"), book({"a.xhtml": PAGE}, ["i7"]), book({"a.xhtml": ""}), book({})])
def test_broken_books(data):
    with pytest.raises(ValueError):
        B.book_blocks(data)


def test_read_books(spark, tmp_path):
    (tmp_path / "good.epub").write_bytes(book({"a.xhtml": PAGE}))
    (tmp_path / "bad.epub").write_bytes(b"junk")
    rows = B.read_books(spark, str(tmp_path)).orderBy("path", "ordinal").collect()
    assert [r.error for r in rows] == ["not an archive", None, None, None, None]
    assert [(r.kind, r.heading_level, r.text) for r in rows[1:]] == WANT


def test_page_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    got = B.page_blocks(pages).orderBy("ordinal").collect()
    assert [(r.page_id, r.kind, r.heading_level, r.text) for r in got] == [(1, *w) for w in WANT]
