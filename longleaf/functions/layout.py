"""Pages of printed text: fragments with places, put into lines, columns and paragraphs."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

#: Lines that a page needs to be of two columns, the width of a narrow one, lines of each side, and lines across; fixed values.
LEAST_LINES, NARROW, SIDE, ACROSS = 8, 0.62, 3, 0.10
#: Gaps that end a paragraph, in line gaps, and pixels that count as the same place; fixed values.
GAP, SAME = 1.8, 2


class Line(NamedTuple):
    top: int
    left: int
    right: int
    height: int
    size: int
    text: str


def lines(fragments: list[tuple]) -> list[Line]:
    """Fragments (top, left, width, height, size, text) in rows: those whose top is within half the lesser height of the row's first.

    In a row they go from left to right; a gap wider than five quarters of the height begins another line.
    """
    rows: list[list[tuple]] = []
    for f in sorted(fragments, key=lambda f: (f[0], f[1])):
        if rows and abs(f[0] - rows[-1][0][0]) * 2 <= min(f[3], rows[-1][0][3]):
            rows[-1].append(f)
        else:
            rows.append([f])
    out: list[Line] = []
    for row in rows:
        now: list[tuple] = []
        for f in sorted(row, key=lambda f: f[1]):
            if now and (f[1] - now[-1][1] - now[-1][2]) * 4 > 5 * max(f[3], now[-1][3]):
                out.append(_line(now))
                now = []
            now.append(f)
        out.append(_line(now))
    return out


def _line(parts: list[tuple]) -> Line:
    text = ""
    for a, b in zip([None, *parts], parts, strict=False):
        gap = a is not None and b[1] - a[1] - a[2] > 1 and not text.endswith(" ") and not b[5].startswith(" ")
        text += (" " if gap else "") + b[5]
    biggest = max(parts, key=lambda p: len(p[5]))
    return Line(parts[0][0], parts[0][1], max(p[1] + p[2] for p in parts), max(p[3] for p in parts), biggest[4], text.strip())


def two_columns(width: int, found: list[Line]) -> bool:
    """Whether a page is of two columns: enough narrow lines on both sides, few across the middle."""
    if len(found) < LEAST_LINES:
        return False
    middle = width / 2
    narrow = [x for x in found if x.right - x.left < NARROW * width]
    left, right = sum(x.right <= middle + SAME for x in narrow), sum(x.left >= middle - SAME for x in narrow)
    across = sum(x.left < middle - SAME and x.right > middle + SAME for x in found)
    return left >= SIDE and right >= SIDE and across <= ACROSS * len(found)


def ordered(width: int, found: list[Line]) -> list[Line]:
    """Lines as they are read: of two columns, full lines part the page into bands, each left side before right."""
    if not two_columns(width, found):
        return sorted(found, key=lambda x: (x.top, x.left))
    middle, band, keyed = width / 2, 0, []
    for x in sorted(found, key=lambda x: (x.top, x.left)):
        full = x.left < middle - SAME and x.right > middle + SAME
        band += 2 if full else 0
        keyed.append(((band - 1 if full else band, x.left >= middle - SAME if not full else 0, x.top, x.left), x))
    return [x for _, x in sorted(keyed, key=lambda k: k[0])]


def body_size(sizes: list[tuple[int, int]]) -> int:
    """The size of most characters of (size, characters)."""
    total: Counter = Counter()
    for size, n in sizes:
        total[size] += n
    return max(total, key=lambda s: (total[s], -s)) if total else 0


def heading_levels(sizes: list[tuple[int, int]], most: int = 6) -> dict[int, int]:
    """Levels of sizes above the body's, the largest first."""
    body = body_size(sizes)
    return {s: i + 1 for i, s in enumerate(sorted({s for s, _ in sizes if s > body}, reverse=True)[:most])}


def median_gap(found: list[Line]) -> float:
    gaps = sorted(b.top - a.top for a, b in zip(found, found[1:], strict=False) if b.top > a.top)
    return float(gaps[len(gaps) // 2]) if gaps else 0.0


def fuses(tail: str, head: str) -> bool:
    """Whether a hyphen at a line's end is none of the word: small letters on both sides."""
    t, h = tail.rstrip(), head.lstrip()
    return len(t) > 1 and t[-1] == "-" and t[-2].islower() and h[:1].islower()


def joined(tail: str, head: str) -> str:
    return tail.rstrip()[:-1] + head.lstrip() if fuses(tail, head) else f"{tail} {head}"


def paragraphs(found: list[Line], levels: dict[int, int]) -> list[tuple[str, int | None, str]]:
    """(kind, level, text): a line begins a paragraph after another size, a wide gap, or where it is indented afresh."""
    out: list[tuple[str, int | None, str]] = []
    gap, before = median_gap(found), None
    for x in found:
        new = before is None or x.size != before.size or x.top < before.top or gap and x.top - before.top > GAP * gap or x.left > before.left + x.height and before.left - SAME <= min(y.left for y in found) + x.height
        if new:
            level = levels.get(x.size)
            out.append(("heading" if level else "paragraph", level, x.text))
        else:
            kind, level, text = out[-1]
            out[-1] = (kind, level, joined(text, x.text))
        before = x
    return out


def margins(pages: list[list[Line]], height: int, share: float = 0.12, least: int = 3) -> set[str]:
    """Texts that stand at the top or bottom of at least so many pages, numbers aside: running heads and feet."""
    seen: Counter = Counter()
    for page in pages:
        edge = {re.sub("[0-9]+", "#", " ".join(x.text.split()).lower()) for x in page if x.top < share * height or x.top + x.height > (1 - share) * height}
        seen.update(edge)
    return {t for t, n in seen.items() if n >= least}


def continues(tail: str, head: str) -> bool:
    """Whether a page's first paragraph goes on with the last of the page before: that isn't ended, and this begins small."""
    return bool(tail) and tail.rstrip()[-1:] not in ".!?…:;。！？\"”»" and (head.lstrip()[:1].islower() or fuses(tail, head))


def read_pages(pages: list[tuple[int, int, int, list[tuple]]]) -> list[tuple[int, str, int | None, str]]:
    """(page, kind, level, text) of pages (number, width, height, fragments) in reading order: running heads go, paragraphs join over pages."""
    rows = [(n, w, h, ordered(w, lines(f))) for n, w, h, f in pages]
    levels = heading_levels([(x.size, len(x.text)) for *_, found in rows for x in found])
    height = max((h for _, _, h, _ in rows), default=0)
    running = margins([found for *_, found in rows], height)
    out: list[tuple[int, str, int | None, str]] = []
    for n, _, h, found in rows:
        edge = lambda x, h=h: x.top < 0.12 * h or x.top + x.height > 0.88 * h
        body = [x for x in found if not (edge(x) and (re.sub("[0-9]+", "#", " ".join(x.text.split()).lower()) in running or re.fullmatch(r"[0-9]{1,4}|[ivxlcdm]+", x.text.strip())))]
        for i, (kind, level, text) in enumerate(paragraphs(body, levels)):
            if i == 0 and out and kind == out[-1][1] == "paragraph" and continues(out[-1][3], text):
                out[-1] = (*out[-1][:3], joined(out[-1][3], text))
            else:
                out.append((n, kind, level, text))
    return out


def page_texts(fragments: DataFrame) -> DataFrame:
    """(doc, page, ordinal, kind, level, text) of fragments (doc, page, page_width, page_height, top, left, width, height, size, text).

    A document's pages are read by one task, as paragraphs go on from page to page.
    """

    def each(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        pages = [(int(n), int(p["page_width"].iat[0]), int(p["page_height"].iat[0]), list(p[["top", "left", "width", "height", "size", "text"]].itertuples(index=False, name=None))) for n, p in f.groupby("page")]
        rows = [(key[0], n, i, kind, level, text) for i, (n, kind, level, text) in enumerate(read_pages(pages))]
        return pd.DataFrame(rows, columns=["doc", "page", "ordinal", "kind", "level", "text"]).astype({"level": "Int32"})

    return fragments.groupBy("doc").applyInPandas(each, f"doc {fragments.schema['doc'].dataType.simpleString()}, page int, ordinal int, kind string, level int, text string")
