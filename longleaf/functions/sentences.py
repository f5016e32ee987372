"""Prose in sentences and in pieces of bounded length, for reading aloud."""

from __future__ import annotations

import re

from longleaf.functions import text as T
from longleaf.functions.udf import mapped

#: Ends of sentences, those that need no blank after them, what closes a quotation, ends of clauses, abbreviations; fixed values.
ENDS, FULL = ".!?…。！？", "…。！？"
CLOSERS = "\"'”’)]」』）】》"
CLAUSES = "、，；：,"
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st mt vs etc eg ie cf al fig no vol pp ed approx dept est inc ltd capt sgt lt".split())
_UNSPACED = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", T.UNSPACED))
_LONGEST = max(map(len, ABBREVIATIONS))
_END = re.compile(f"[{ENDS}{FULL}\n]")
#: Least share of blanks to letters of a script that puts blanks between words; fixed value.
SPACED = 0.02


def abbreviated(text: str, begin: int, point: int) -> bool:
    """Whether a point of the text belongs to an abbreviation or an initial that begins no earlier than so."""
    at = point
    while at > begin and text[at - 1].isalnum() and point - at <= _LONGEST:
        at -= 1
    return point - at == 1 or text[at:point].lower() in ABBREVIATIONS


def sentences(text: str) -> list[str]:
    """A text's sentences, trimmed. A point ends one before a blank, unless an abbreviation; full-width ends always do; so does a blank line.

    Only signs that may end one are looked at, and the last point of a sentence is kept, so the time grows with the text alone.
    """
    out, begin, at, point, short = [], 0, 0, -1, False

    def cut(end: int) -> None:
        nonlocal begin
        if part := text[begin:end].strip():
            out.append(part)
        begin = end

    while m := _END.search(text, at):
        c, at = m[0], m.end()
        after = text[at : at + 1]
        if c == "\n":
            if after in ("", "\n"):
                cut(at)
            continue
        if c == ".":
            point, short = at - 1, False
        if c not in FULL:
            if after and not after.isspace():
                continue
            if point >= begin:
                short = short or abbreviated(text, begin, point)
                if short:
                    continue
        while at < len(text) and text[at] in CLOSERS:
            at += 1
        while at < len(text) and text[at] == "…":
            at += 1
        cut(at)
    cut(len(text))
    return out


def spaced(text: str) -> bool:
    """Whether a text's script puts blanks between words."""
    letters = sum(map(str.isalpha, text))
    return not letters or sum(map(str.isspace, text)) / letters >= SPACED


def clauses(text: str) -> list[str]:
    """Clauses of a script without blanks, each with the sign that ends it."""
    return [c for c in re.findall(f"[^{CLAUSES}]*[{CLAUSES}]|[^{CLAUSES}]+", text) if c.strip()]


def slices(word: str, most: int) -> list[str]:
    return [word[i : i + most] for i in range(0, len(word), most)]


def _packed(parts: list[str], most: int, between: str, too_long) -> list[str]:
    """Parts in order, as many to a piece as fit with what stands between them; a part too long by itself is cut."""
    out, now = [], ""
    for part in parts:
        if len(part) > most:
            out += [now] if now else []
            out += too_long(part)
            now = ""
        elif now and len(now) + len(between) + len(part) > most:
            out.append(now)
            now = part
        else:
            now = now + between + part if now else part
    out += [now] if now else []
    return out


def pieces(unit: str, most: int) -> list[str]:
    """A long unit cut between words, or between clauses where the script has no blanks; as a last resort within one."""
    words, between = (unit.split(), " ") if spaced(unit) else (clauses(unit), "")
    return _packed(words, most, between, lambda w: slices(w, most))


def narrated(text: str, most: int) -> list[str]:
    """Whole sentences in pieces of at most so many characters."""
    return _packed(sentences(text), most, " ", lambda s: pieces(s, most))


def roman(word: str) -> bool:
    return re.fullmatch("[IVXLCivxlc]+", word) is not None


#: Words for a chapter, and what may follow an older one; fixed values.
CHAPTERS = ("chapter", "capitolo", "chapitre", "kapitel", "capítulo", "capitulo")
COUNTS = ("wan", "tu", "luka", "mute", "ale")


def chapter(text: str) -> str | None:
    """A heading's chapter as a key: its word and its number."""
    words = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in text.split()) if w]
    low = [w.lower() for w in words]
    if len(words) >= 3 and low[:2] == ["lipu", "nanpa"] and roman(words[2]):
        return f"lipu nanpa {words[2].upper()}"
    if words and low[0] == "kapitelo" and 2 <= len(words) <= 5 and all(roman(w) or w.lower() in COUNTS for w in words[1:]):
        return " ".join(words).upper()
    if len(words) < 2 or low[0] not in CHAPTERS or not (re.fullmatch("[0-9]+", words[1]) or roman(words[1])):
        return None
    return f"{low[0]} {words[1].upper()}"


def contents_entry(text: str) -> bool:
    """Whether a line is of a printed table of contents."""
    low = text.strip().lower()
    first = re.sub(r"^[^0-9a-z]+|[^0-9a-z]+$", "", (low[4:].split() or [""])[0]) if low.startswith("cap.") else ""
    return low.count("cap.") >= 2 and low.count("pag.") >= 2 or low.startswith("cap.") and ("pag." in low or re.fullmatch("[0-9ivxlc]+", first) is not None)


sentence_array = mapped(sentences, "array<string>")
narration_pieces = mapped(lambda t, n: narrated(t, int(n)), "array<string>")
chapter_key = mapped(chapter, "string")
toc_entry = mapped(contents_entry, "boolean")
