"""Answers of models: JSON that may be wrapped or badly quoted, its items by id, and what is wrong with them."""

from __future__ import annotations

import json
import re

from longleaf.functions import markers, spans
from longleaf.functions.udf import mapped

#: Names that an answer may use, at any depth; fixed values.
KEYS = ("items", "id", "translation", "runs", "text")
_KEY = re.compile(r'\s*"(?:' + "|".join(KEYS) + r')"\s*:')
#: Categories of refused answers with the phrases that name them, in order of precedence; fixed values.
CATEGORIES = (
    ("marker_mismatch", ("batch response incomplete", "batch translation block mismatch", "duplicate item id in batch response", "run count mismatch", "unknown run id", "missing run id",
                         "changed marker run", "inline marker", "protected span", "marker structure", "lost its reference text", "unknown item id")),
    ("missing_field", ("missing field", "invalid length 0", "duplicate field")),
    ("invalid_json", ("invalid batch json", "json parse failed", "eof while parsing", "trailing characters", "expected value", "expected ident", "expected `:`", "expected `,` or `}`",
                      "expected `,` or `]`", "key must be a string", "control character")),
)


def outermost(content: str) -> str | None:
    """The first whole object or array of a text, whatever stands around it."""
    begin = re.search(r"[{\[]", content)
    if not begin:
        return None
    open_: list[str] = []
    for m in re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\]]', re.S).finditer(content, begin.start()):
        c = m[0]
        if c in "{[":
            open_.append("}" if c == "{" else "]")
        elif open_ and c == open_[-1]:
            open_.pop()
            if not open_:
                return content[begin.start() : m.end()]
    return None


def _closes(inside: str, rest: str) -> bool:
    """Whether a quote after `inside` and before `rest` can end a string of an answer."""
    rest = rest.lstrip()
    if rest[:1] in ("", "}", "]"):
        return True
    if rest[0] == ":":
        return inside in KEYS
    after = rest[1:].lstrip()
    return rest[0] == "," and (after[:1] in ("{", "[") and after != "" or _KEY.match(after) is not None)


def escaped_quotes(text: str) -> tuple[str, int]:
    """The text with those quotes escaped that can't end a string, and how many there were."""
    out, begin, n, skip = [], None, 0, False
    for i, c in enumerate(text):
        if begin is None:
            begin = i + 1 if c == '"' else None
        elif skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            if _closes(text[begin:i], text[i + 1 : i + 4097]):
                begin = None
            else:
                out.append("\\")
                n += 1
        out.append(c)
    return "".join(out), n


def _plain(value: object) -> bool:
    if isinstance(value, dict):
        return all(k in KEYS and _plain(v) for k, v in value.items())
    return all(map(_plain, value)) if isinstance(value, list) else True


def _parsed(text: str | None) -> object:
    try:
        return None if text is None else json.loads(text, strict=True)
    except ValueError:
        return None


def decoded(content: str) -> object:
    """The answer as it is, as the whole value within it, or with its quotes escaped; None if none of these is one."""
    for text in (content, outermost(content)):
        if (value := _parsed(text)) is not None:
            return value
    at = content.find("{")
    if at < 0:
        return None
    mended, n = escaped_quotes(content[at:])
    if not n:
        return None
    value = _parsed(mended)
    value = _parsed(outermost(mended)) if value is None else value
    return value if value is not None and _plain(value) else None


def violations(source: str, target: str, block: str = "paragraph") -> list[tuple[str, str, str]]:
    """(kind, severity, message) of all that a target breaks of its source: nesting, markers, references, spans, emptiness."""
    out: list[tuple[str, str, str]] = []
    if markers.strip(source).strip() and not markers.strip(target).strip():
        return [("other", "error", "empty translation for non-empty source")]
    if error := markers.structure_error(target):
        out.append(("marker_structure", "error", f"invalid inline marker structure: {error}"))
    out += [(f"inline_marker_{kind}", "error", f"{'unknown inline marker' if kind == 'unknown' else f'inline marker {kind}'}: {m}") for kind, m in markers.differences(source, target)]
    if error := markers.lost_reference(source, target):
        out.append(("marker_structure", "error", error))
    bare = markers.strip(source)
    return out + [("protected_span_missing", severity, f"protected span missing: {t}") for _, t, severity in spans.lost(bare, markers.strip(target), block)]


def read_items(content: str, wanted: dict[str, str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]], str | None]:
    """(items, failures, error) of an answer to items (id to source).

    An unknown id means nothing, but fails when it repeats; a known one that repeats fails, as does a target that breaks its
    source. If any wanted id is missing, the whole answer is refused.
    """
    value = decoded(content)
    rows = value.get("items") if isinstance(value, dict) else None
    if not isinstance(rows, list) or not all(isinstance(r, dict) and isinstance(r.get("id"), str) and isinstance(r.get("translation"), str) for r in rows):
        return [], [], "invalid batch JSON"
    items, failures, seen, strange = [], [], set(), set()
    for row in rows:
        id_, target = row["id"], row["translation"]
        if id_ not in wanted:
            if id_ in strange:
                failures.append((id_, "duplicate unknown item id"))
            strange.add(id_)
        elif id_ in seen:
            failures.append((id_, "duplicate item ID in batch response"))
        else:
            seen.add(id_)
            bad = [m for _, severity, m in violations(wanted[id_], target) if severity == "error"]
            (failures if bad else items).append((id_, "; ".join(bad) if bad else target))
    missing = [i for i in wanted if i not in seen]
    if missing:
        return [], [], f"batch response incomplete: {len(wanted) - len(missing)} of {len(wanted)} items, missing {', '.join(missing)}"
    return items, failures, None


def _read(content: str, ids: list[str], sources: list[str]) -> dict:
    items, failures, error = read_items(content, dict(zip(ids, sources, strict=True)))
    row = lambda pair: {"id": pair[0], "text": pair[1]}
    return {"items": list(map(row, items)), "failures": list(map(row, failures)), "error": error}


_PAIRS = "array<struct<id: string, text: string>>"
answer_items = mapped(lambda c, i, s: _read(c, list(i), list(s)), f"struct<items: {_PAIRS}, failures: {_PAIRS}, error: string>")
block_violations = mapped(lambda s, t, b: [{"kind": k, "severity": v, "message": m} for k, v, m in violations(s, t, b)], "array<struct<kind: string, severity: string, message: string>>")
