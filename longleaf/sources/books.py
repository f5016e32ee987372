"""Books both ways: XHTML resources as blocks with inline markers, and translated blocks back into their archives."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame

from longleaf.functions import markers
from longleaf.sources.blocks import HIDDEN, KINDS, VOID, book_blocks

_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: Names of languages and their tags; fixed values.
TAGS = {"english": "en", "french": "fr", "german": "de", "italian": "it", "spanish": "es", "portuguese": "pt", "dutch": "nl", "danish": "da", "norwegian": "no", "swedish": "sv", "russian": "ru", "chinese": "zh", "japanese": "ja", "korean": "ko", "arabic": "ar", "hebrew": "he", "toki pona": "tok"}
#: All entries of a rebuilt archive carry the same time, so that the same book gives the same bytes.
TIME = (1980, 1, 1, 0, 0, 0)


class MarkedBlock(NamedTuple):
    start: int
    end: int
    kind: str
    level: int | None
    text: str
    tags: dict[str, str]


def marked_blocks(xhtml: str) -> list[MarkedBlock]:
    """Blocks of a resource with the place of their inside: the first element with a kind opens one, which ends with it.

    Elements inside a block are markers of its text: paired ones `<m0>…</m0>`, those without inside `<r0/>`. `tags` says what
    each marker stands for. White space runs are one blank; character references are decoded.
    """
    out: list[MarkedBlock] = []
    open_: list[str] = []
    block: tuple | None = None  # name, level, where its inside begins, depth
    parts: list[str] = []
    inner: list[tuple[str, str]] = []
    tags: dict[str, str] = {}
    hidden = at = pairs = alone = 0
    while True:
        m = _TOKEN.search(xhtml, at)
        stop = m.start() if m else len(xhtml)
        if block is not None and not hidden and stop > at:
            parts.append(html.unescape(xhtml[at:stop]).replace("<", "＜") if "<" in html.unescape(xhtml[at:stop]) else html.unescape(xhtml[at:stop]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        empty = name in VOID or m[3].endswith("/")
        if m[1]:  # an end
            if name not in open_:
                continue
            while open_:
                last = open_.pop()
                hidden -= last in HIDDEN
                if block is not None and len(open_) == block[3]:
                    while inner:  # what the block's end closes
                        parts.append(f"</{inner.pop()[1]}>")
                    text = " ".join("".join(parts).split())
                    if markers.strip(text).strip():
                        out.append(MarkedBlock(block[2], m.start(), KINDS[block[0]], block[1], text, tags))
                    block, parts, tags, pairs, alone = None, [], {}, 0, 0
                elif block is not None and inner and inner[-1][0] == last:
                    key = inner.pop()[1]
                    tags[f"/{key}"] = m[0] if last == name else f"</{last}>"
                    parts.append(f"</{key}>")
                if last == name:
                    break
            continue
        if block is None:
            if name in KINDS and not empty and not hidden:
                block = (name, int(name[1]) if re.fullmatch("h[1-6]", name) else None, at, len(open_))
        elif not hidden and name not in HIDDEN:
            if empty:
                key, alone = f"r{alone}", alone + 1
                parts.append(f"<{key}/>")
            else:
                key, pairs = f"m{pairs}", pairs + 1
                inner.append((name, key))
                parts.append(f"<{key}>")
            tags[key] = m[0]
        if not empty:
            open_.append(name)
            hidden += name in HIDDEN
    return out


def patched(xhtml: str, targets: dict[int, str]) -> str:
    """The resource with the inside of some blocks replaced: markers are their elements again, everything else stays byte for byte.

    ValueError: a number without block, a marker that the block hasn't, one lost, repeated or badly nested.
    """
    found = marked_blocks(xhtml)
    if strange := set(targets) - set(range(len(found))):
        raise ValueError(f"no block {min(strange)}")
    out, at = [], 0
    for i in sorted(targets):
        b, target = found[i], targets[i]
        if error := markers.structure_error(target):
            raise ValueError(f"block {i}: {error}")
        if wrong := markers.differences(b.text, target):
            raise ValueError(f"block {i}: marker {wrong[0][1]} is {wrong[0][0]}")
        inside, last = [], 0
        for m in markers.scan(target):
            inside.append(html.escape(target[last : m.start], quote=False).replace("＜", "&lt;"))
            inside.append(b.tags.get(f"/{m.name}", "") if m.kind == "close" else b.tags[m.id])
            last = m.end
        inside.append(html.escape(target[last:], quote=False).replace("＜", "&lt;"))
        out += [xhtml[at : b.start], "".join(inside)]
        at = b.end
    return "".join([*out, xhtml[at:]])


def language_tag(language: str) -> str:
    """The tag of a language's name; a tag stays as it is."""
    low = language.strip().lower()
    return TAGS.get(low, low.replace("_", "-"))


def package_of(book: zipfile.ZipFile) -> tuple[str, str]:
    """Path and text of an archive's package."""
    m = re.search(r"full-path\s*=\s*[\"']([^\"']+)", book.read("META-INF/container.xml").decode("utf-8-sig"))
    if not m:
        raise ValueError("no package")
    return m[1], book.read(m[1]).decode("utf-8-sig")


def spine(package: str, opf: str) -> list[str]:
    """Paths of the resources of a package's spine, each once."""
    attribute = lambda tag, n: (re.search(rf"\s{n}\s*=\s*[\"']([^\"']*)", tag) or ["", ""])[1]
    items = {attribute(t, "id"): attribute(t, "href") for t in re.findall(r"<(?:\w+:)?item\s[^>]*>", opf)}
    refs = [attribute(t, "idref") for t in re.findall(r"<(?:\w+:)?itemref\s[^>]*>", opf)]
    return list(dict.fromkeys(posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(html.unescape(items[r])))) for r in refs if r in items))


def inspected(data: bytes) -> dict:
    """What a book is: title, language, resources, blocks, and which share of its visible characters lies in blocks."""
    rows = book_blocks(data)  # refuses what isn't a book
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        package, opf = package_of(book)
        first = lambda n: html.unescape((re.search(rf"<dc:{n}[^>]*>\s*(.*?)\s*</dc:{n}>", opf, re.S) or ["", ""])[1])
        hrefs = spine(package, opf)
        body, inside = 0, 0
        for href in hrefs:
            text = book.read(href).decode("utf-8-sig")
            bare = re.sub(r"<(script|style|head|title|svg|math|template|noscript)\b.*?</\1\s*>|<[^>]*>", " ", text, flags=re.S | re.I)
            body += len("".join(html.unescape(bare).split()))
            inside += sum(len("".join(markers.strip(b.text).split())) for b in marked_blocks(text))
    return {"title": first("title"), "language": first("language"), "resources": len(hrefs), "blocks": len(rows), "chars": body, "coverage": round(inside / body, 6) if body else 0.0}


def rebuilt(data: bytes, targets: dict[str, dict[int, str]], language: str | None = None) -> bytes:
    """A book with translated blocks: resources by path, their blocks by number. Entries that nothing changes keep their bytes.

    The media type comes first and unpacked; entries keep their order; ValueError names a path that isn't there.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = [e.filename for e in book.infolist()]
        if strange := sorted(set(targets) - set(names)):
            raise ValueError(f"no resource {strange[0]}")
        package, opf = package_of(book)
        changed = {href: patched(book.read(href).decode("utf-8-sig"), blocks).encode() for href, blocks in targets.items()}
        if language:
            tag, n = re.subn(r"(<dc:language[^>]*>)[^<]*(</dc:language>)", rf"\g<1>{language_tag(language)}\g<2>", opf, count=1)
            if n:
                changed[package] = tag.encode()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as new:
            for name in sorted(names, key=lambda x: x != "mimetype"):
                kind = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
                info = zipfile.ZipInfo(name, TIME)
                info.compress_type = kind
                new.writestr(info, changed.get(name, book.read(name)))
    return out.getvalue()


def inspect_books(books: DataFrame) -> DataFrame:
    """(path, title, language, resources, blocks, chars, coverage, error) of books (path, content)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["title", "language", "resources", "blocks", "chars", "coverage"]
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append((path, *(inspected(bytes(data))[n] for n in names), None))
                except ValueError as e:
                    rows.append((path, *[None] * 6, str(e)))
            yield pd.DataFrame(rows, columns=["path", *names, "error"]).astype({c: "Int64" for c in ("resources", "blocks", "chars")})

    return books.select("path", "content").mapInPandas(each, "path string, title string, language string, resources long, blocks long, chars long, coverage double, error string")


def marked_book_blocks(books: DataFrame) -> DataFrame:
    """(path, href, ordinal, kind, level, text) of books (path, content): the blocks that `rebuild_books` takes back, with markers."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as book:
                    for href in spine(*package_of(book)):
                        rows += [(path, href, i, b.kind, b.level, b.text) for i, b in enumerate(marked_blocks(book.read(href).decode("utf-8-sig")))]
            yield pd.DataFrame(rows, columns=["path", "href", "ordinal", "kind", "level", "text"]).astype({"level": "Int32"})

    return books.select("path", "content").mapInPandas(each, "path string, href string, ordinal int, kind string, level int, text string")


def rebuild_books(books: DataFrame, translations: DataFrame, language: str | None = None) -> DataFrame:
    """(path, content, error): books (path, content) with translations (path, href, ordinal, text) in place.

    A book whose translations don't fit has an error and no content: a block that is named twice, one that isn't there,
    markers that are lost. A book without translations comes out with its language alone changed.
    """

    def each(key: tuple, book: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in book["content"]:
            try:
                if rows.duplicated(["href", "ordinal"]).any():
                    raise ValueError("a block has two translations")
                targets: dict[str, dict[int, str]] = {}
                for href, i, text in zip(rows["href"], rows["ordinal"], rows["text"], strict=True):
                    targets.setdefault(href, {})[int(i)] = text
                out.append((key[0], rebuilt(bytes(data), targets, language), None))
            except ValueError as e:
                out.append((key[0], None, str(e)))
        return pd.DataFrame(out, columns=["path", "content", "error"])

    right = translations.select("path", "href", "ordinal", "text")
    return books.select("path", "content").groupBy("path").cogroup(right.groupBy("path")).applyInPandas(each, "path string, content binary, error string")
