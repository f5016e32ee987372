"""Text blocks of markup: books as archives of XHTML, and HTML pages."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Elements that begin a block and the kind of it; fixed values.
KINDS = {
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "list_item", "blockquote": "quote",
    "td": "table_cell", "th": "table_cell", "tr": "table_row", "figcaption": "caption", "caption": "caption", "pre": "code", "code": "code", "aside": "footnote",
}
#: Elements whose content is never text, and those that have none; fixed values.
HIDDEN = {"script", "style", "svg", "math", "head", "template", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Bounds of an archive: entries, bytes of one, bytes of all; fixed values.
MOST_ENTRIES, MOST_ENTRY, MOST_BYTES = 10_000, 64 << 20, 512 << 20
SCHEMA = "href string, section int, ordinal int, kind string, heading_level int, text string"


class Blocks(HTMLParser):
    """One pass over markup: the first element with a kind opens a block, which ends with that element.

    Blocks inside one are part of it; text outside of all is a paragraph up to the next block; hidden elements give no text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.hidden, self.kind, self.level, self.depth, self.parts = [], [], 0, None, None, 0, []

    def _flush(self, kind, level):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((kind, level, text))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.parts.append(" " if tag == "br" else "")
            return
        if tag in HIDDEN:
            self.hidden += 1
        elif self.kind is None and tag in KINDS:
            self._flush("paragraph", None)
            self.kind, self.depth, self.level = tag, len(self.open), int(tag[1]) if re.fullmatch("h[1-6]", tag) else None
        elif self.kind is not None and tag in KINDS:
            self.parts.append(" ")
        self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:  # an element that was never closed ends with the one around it
            last = self.open.pop()
            self.hidden -= last in HIDDEN
            if self.kind is not None and len(self.open) == self.depth:
                self._flush(KINDS[self.kind], self.level)
                self.kind = None
            if last == tag:
                break

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def close(self):
        super().close()
        self._flush("paragraph" if self.kind is None else KINDS[self.kind], None if self.kind is None else self.level)


def markup_blocks(markup: str) -> list[tuple]:
    """(kind, heading_level, text) of the blocks of a page, in order; none for null or empty markup."""
    parser = Blocks()
    parser.feed(markup or "")
    parser.close()
    return parser.out


def _xml(data: bytes) -> ElementTree.Element:
    text = data.decode("utf-8-sig")
    if "<!ENTITY" in text:
        raise ValueError("entity declarations aren't read")
    named = lambda m: f"&#{name2codepoint[m[1]]};" if m[1] in name2codepoint and m[1] not in ("amp", "lt", "gt", "quot") else m[0]
    return ElementTree.fromstring(re.sub(r"&(\w+);", named, text))


def book_blocks(data: bytes) -> list[tuple]:
    """(href, section, ordinal, kind, heading_level, text) of a book's spine.

    ValueError names what is wrong: no archive, a first entry that isn't the media type, entries above the bounds,
    a missing package or spine item, or no text at all.
    """
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not an archive") from e
    entries = book.infolist()
    if not entries or entries[0].filename != "mimetype" or book.read("mimetype").strip() != b"application/epub+zip":
        raise ValueError("the first entry isn't the media type")
    if len(entries) > MOST_ENTRIES or any(e.file_size > MOST_ENTRY for e in entries) or sum(e.file_size for e in entries) > MOST_BYTES:
        raise ValueError("the archive is above its bounds")
    try:
        package = _xml(book.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
        opf = _xml(book.read(package))
        items = {i.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(i.get("href")))) for i in opf.iterfind(".//{*}manifest/{*}item")}
        out, seen = [], set()
        for k, ref in enumerate(opf.iterfind(".//{*}spine/{*}itemref")):
            href = items[ref.get("idref")]
            if href not in seen:  # each resource once
                seen.add(href)
                out.extend((href, k, n, *b) for n, b in enumerate(markup_blocks(book.read(href).decode("utf-8-sig"))))
    except (KeyError, AttributeError, ElementTree.ParseError) as e:
        raise ValueError(f"broken package: {e}") from e
    if not out:
        raise ValueError("no text")
    return out


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, href, section, ordinal, kind, heading_level, text, error) of all books under a path.

    A book that can't be read has one row with its error, so that none is lost. Files are read whole, one at a
    time in each task; archives above the bounds are refused before anything is unpacked.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows = [(at, *b, None) for b in book_blocks(bytes(data))]
                except ValueError as e:
                    rows = [(at, None, None, None, None, None, None, str(e))]
                out = pd.DataFrame(rows, columns=["path", *(c.split()[0] for c in SCHEMA.split(", ")), "error"])
                yield out.astype({c: "Int32" for c in ("section", "ordinal", "heading_level")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(decode, f"path string, {SCHEMA}, error string")


def page_blocks(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, ordinal, kind, heading_level, text): the blocks of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, *b) for k, m in zip(f[key], f[markup], strict=True) for n, b in enumerate(markup_blocks(m))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "kind", "heading_level", "text"]).astype({"heading_level": "Int32"})

    return pages.select(key, markup).mapInPandas(decode, f"`{key}` {kind}, ordinal int, kind string, heading_level int, text string")
