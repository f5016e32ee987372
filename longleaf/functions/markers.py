"""Inline markers: paired ones (`<m1>`, `</m1>`), empty ones (`<r1/>`, `<m1/>`), and older forms with an id attribute."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from longleaf.functions import spans
from longleaf.functions.udf import mapped

_TOKEN = re.compile(r"</(?P<close>m[0-9]+|m|keep)>|<(?P<empty>[mr][0-9]+)/>|<(?P<open>m[0-9]+)>|<(?P<old>m|keep|ref) [^>]*>")
#: Signs that make a token a reference, and those that may stand beside them; fixed values.
SIGNS, BESIDE = "*†‡§¶#", "[](){}.,-–—/:;"
MOST_REFERENCE = 8


class Marker(NamedTuple):
    kind: str
    name: str
    id: str | None
    start: int
    end: int


def id_of(tag: str) -> str | None:
    """The value of a tag's first id attribute, which is quoted."""
    _, found, rest = tag.partition("id=")
    if not found or rest[:1] not in ('"', "'") or not rest:
        return None
    value, closed, _ = rest[1:].partition(rest[0])
    return value if closed else None


def scan(text: str) -> Iterator[Marker]:
    """The markers of a text in order. What looks like an older one but has no id is text."""
    at = 0 if "<" in text else len(text)
    while m := _TOKEN.search(text, at):
        at = m.end()
        if name := m["close"]:
            yield Marker("close", name, None, m.start(), at)
        elif name := m["empty"]:
            yield Marker("empty", name, name, m.start(), at)
        elif name := m["open"]:
            yield Marker("open", name, name, m.start(), at)
        else:
            name, found, alone = m["old"], id_of(m[0]), m[0].endswith("/>")
            if found is None or name == "ref" and not alone:
                at = m.start() + 1
            else:
                yield Marker("empty" if alone else "open", name, found, m.start(), at)


def ids(text: str) -> list[str]:
    """Ids of opening and empty markers, with repeats."""
    return [m.id for m in scan(text) if m.kind != "close"]


def strip(text: str) -> str:
    """The text without its markers."""
    out, at = [], 0
    for m in scan(text):
        out.append(text[at : m.start])
        at = m.end
    return "".join([*out, text[at:]])


def structure_error(text: str) -> str | None:
    """What is wrong with the nesting of paired markers, or nothing."""
    stack: list[str] = []
    for m in scan(text):
        if m.kind == "open":
            stack.append(m.name)
        elif m.kind == "close":
            if not stack:
                return f"unexpected inline marker close </{m.name}>"
            if (last := stack.pop()) != m.name:
                return f"inline marker <{last}> is closed by </{m.name}>"
    return f"inline marker <{stack[-1]}> is missing closing tag </{stack[-1]}>" if stack else None


def inner_texts(text: str) -> list[tuple[str, str]]:
    """(id, text inside without markers) of paired markers in the order in which they end; an outer end ends inner ones."""
    out, open_ = [], []
    for m in scan(text):
        if m.kind == "open":
            open_.append(m)
        elif m.kind == "close":
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i].name == m.name), None)
            if at is not None:
                out += [(o.id, strip(text[o.end : m.start])) for o in open_[at:]]
                del open_[at:]
    return out


def reference(text: str) -> str | None:
    """The text as a reference token: short, without letters, of numerals and signs; else nothing."""
    token = text.strip()
    numeral = lambda c: c.isnumeric()
    if not 0 < len(token) <= MOST_REFERENCE or any(c.isalpha() for c in token) or not any(numeral(c) or c in SIGNS for c in token):
        return None
    return token if all(numeral(c) or c in " \t\n\f\r" or c in SIGNS or c in BESIDE for c in token) else None


def lost_reference(source: str, target: str) -> str | None:
    """The first marker of the source whose reference the same marker of the target no longer holds."""
    there = dict(inner_texts(target))
    for id_, text in inner_texts(source):
        token = reference(text)
        if token is None or id_ not in there:
            continue
        want, have = "".join(token.split()), "".join(there[id_].split())
        if not spans.stands(want, have) and not set(spans.readings(want)) & set(spans.readings(have)):
            return f"inline marker {id_} lost its reference text '{token}'"
    return None


def differences(source: str, target: str) -> list[tuple[str, str]]:
    """(kind, marker) of what a target does to the markers of its source: missing, duplicated, unknown."""
    want, have = Counter(ids(source)), Counter(ids(target))  # in order of first appearance
    out = [("missing", m) for m in want if m not in have]
    out += [("duplicated", m) for m, n in have.items() if 0 < want[m] < n]
    return out + [("unknown", m) for m in have if m not in want]


marker_error = mapped(structure_error, "string")
marker_texts = mapped(lambda t: [{"id": i, "text": x} for i, x in inner_texts(t)], "array<struct<id: string, text: string>>")
marker_lost = mapped(lost_reference, "string")
marker_differences = mapped(lambda s, t: [{"kind": k, "marker": m} for k, m in differences(s, t)], "array<struct<kind: string, marker: string>>")
