"""Spans that a translation must keep, and whether it does: links, numbers in any local form, formulas, file names."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property

from longleaf.functions.udf import mapped

#: Punctuation around a token; around a number; fixed values.
AROUND, AROUND_NUMBER = ",;:.!?()\"'", ",;:.!?()[]\"'"
#: Characters of formulas, those of them that aren't operators by themselves, and tokens that compare; fixed values.
MATH = "=+-*/^_()[]{}|<>∑∫√≤≥≈≠±×÷∂∇∞∈"
WEAK = "_-/()[]{}|"
COMPARE = ("=", "<", ">", "<=", ">=", "==", "≤", "≥", "≈", "≠")
#: Ends of file names; fixed values.
FILES = frozenset("azw css csv epub gif htm html jpeg jpg js json md mobi ncx opf pdf png svg txt xhtml xml zip".split())
#: Names of months, by language: English, Italian, Spanish, Portuguese, Danish and Norwegian, French, German; fixed values.
MONTHS = frozenset(
    "january jan february feb march mar april apr may june jun july jul august aug september sep sept october oct november nov december dec"
    " gennaio gen febbraio marzo aprile maggio mag giugno giu luglio lug agosto ago settembre set ottobre ott novembre dicembre dic"
    " enero ene febrero abril abr mayo junio julio septiembre setiembre octubre diciembre"
    " janeiro fevereiro fev março maio mai junho julho outubro out dezembro dez"
    " januar februar marts mars maj juni juli oktober okt desember des"
    " janvier février fevrier avril juin juillet août aout octobre décembre decembre"
    " jänner märz dezember".split()
)
_SIGNS = str.maketrans("−–—", "---")
_GAP = "\u00a0\u202f\u2009"
_NUMBER = re.compile(rf"(?:(?<![^\W_])[-+−–—](?=[0-9]))?[0-9](?:[0-9]|[.,](?=[0-9])|[ {_GAP}](?=[0-9]{{3}}(?![0-9])))*%?")
_RUN = re.compile(r"[0-9.,+%\-−–—]+")
_SIGN = re.escape(MATH)
_STRONG_SIGN = "[" + re.escape("".join(c for c in MATH if c not in WEAK)) + "]"
_STRONG, _AFTER_POINT = re.compile(_STRONG_SIGN), re.compile("[.,]" + _STRONG_SIGN)
_DIGIT, _OPERAND, _THREE = re.compile("[0-9]"), re.compile("[A-Za-z0-9]"), re.compile("[A-Za-z]{3}")
_MATHEMATICAL, _WORD_OF_SIGNS = re.compile(f"[{_SIGN}.,A-Za-z0-9]*"), re.compile(f"[{_SIGN}]*[A-Za-z]+[{_SIGN}]*")
_ALNUM = re.compile(r"[^\W_]+")
#: Different tokens whose kind a worker remembers, and the longest of them; bounds of memory alone.
MEMO, MEMO_CHARS = 1 << 16, 64


def signs(text: str) -> str:
    return text.translate(_SIGNS)


def dangling(value: str) -> bool:
    """A range without an end, such as `1914-`."""
    bare = signs(value).strip(AROUND_NUMBER)
    return bare.endswith("-") and re.search("[0-9]", bare) is not None


def compact(value: str) -> str | None:
    """A span of two digits or more and punctuation of numbers, without blanks; else nothing."""
    bare = signs(value).strip(AROUND_NUMBER)
    if len(re.findall("[0-9]", bare)) < 2 or not re.fullmatch(r"[0-9 \t\n\f\r.,;:/\-+%$()]*", bare):
        return None
    return unspaced(bare)


def unspaced(value: str) -> str:
    return re.sub(r"[ \t\n\f\r]", "", value)


def decimal(value: str) -> str | None:
    """A number with one separator at most, written with a point; else nothing."""
    bare = signs(value).strip(AROUND_NUMBER)
    m = re.fullmatch(r"([-+0-9]*)(?:([.,])([0-9]+))?(%?)", bare)
    if not m or not re.search("[0-9]", bare) or m[2] and not re.fullmatch(r"[-+]*[0-9]*", m[1]) or m[2] and not m[1]:
        return None
    return m[1] + (f".{m[3]}" if m[2] else "") + m[4]


def readings(token: str) -> list[str]:
    """All canonical forms that a numeric token may mean: grouped by threes, with a decimal part, or both."""
    m = re.fullmatch(rf"([-+]?)([0-9]+(?:[.,{_GAP} ][0-9]+)*)(%?)", signs(token))
    if not m:
        return []
    sign, body, percent = m.groups()
    groups, seps = re.split(rf"[.,{_GAP} ]", body), re.findall(rf"[.,{_GAP} ]", body)
    thirds = lambda part: 1 <= len(groups[0]) <= 3 and all(len(g) == 3 for g in part)
    out = []
    if not seps or len(set(seps)) == 1 and thirds(groups[1:]):
        out.append(sign + "".join(groups) + percent)
    if seps and seps[-1] in ".," and (len(seps) == 1 or len(set(seps[:-1])) == 1 and seps[0] != seps[-1] and thirds(groups[1:-1])):
        out.append(f"{sign}{''.join(groups[:-1])}.{groups[-1]}{percent}")
    return list(dict.fromkeys(out))


def stands(span: str, text: str) -> bool:
    """Whether the span is in the text, with no letter or numeral beside a letter or numeral that it ends in."""
    left, right = span[:1].isalnum(), span[-1:].isalnum()
    at = text.find(span)
    while at >= 0:
        end = at + len(span)
        if not (left and at and text[at - 1].isalnum()) and not (right and end < len(text) and text[end].isalnum()):
            return True
        if at + 1 > len(text):
            break
        at = text.find(span, at + max(len(span), 1))
    return False


class Held:
    """What a text holds, in the forms in which spans are looked for: each form is made once a text, when a span first needs it."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def tokens(self) -> frozenset[str]:
        return frozenset(self.text.split())

    @cached_property
    def bare(self) -> frozenset[str]:
        return frozenset(named[t][0] for t in self.tokens)

    @cached_property
    def unspaced(self) -> str:
        return unspaced(self.text)

    @cached_property
    def decimals(self) -> frozenset[str | None]:
        return frozenset(decimal(signs(r)) for r in set(_RUN.findall(self.text)))

    @cached_property
    def places(self) -> dict[str, list[int]]:
        """Places among the text's numbers by each form that one may mean, in order."""
        out: dict[str, list[int]] = {}
        for i, m in enumerate(_NUMBER.finditer(self.text)):
            for form in readings(signs(m[0])):
                out.setdefault(form, []).append(i)
        return out

    @cached_property
    def by_run(self) -> dict[str, list[str]]:
        """Distinct tokens by the whole runs of letters and numerals in them."""
        out: dict[str, list[str]] = {}
        for token in self.tokens:
            for run in set(_ALNUM.findall(token)):
                out.setdefault(run, []).append(token)
        return out

    def stands(self, span: str) -> bool:
        """stands(span, text). All runs of letters and numerals of a span that stands are whole runs of the text, so one by its rarest run is enough."""
        if span and span in self.bare:
            return True
        runs = _ALNUM.findall(span)
        if not runs or len(span.split()) != 1 or span != span.strip():
            return all(r in self.by_run for r in runs) and stands(span, self.text)
        return any(stands(span, t) for t in min((self.by_run.get(r, ()) for r in runs), key=len))

    def numbers_stand(self, span: str) -> bool:
        """Whether each number of the span is in the text in some local form, each for itself, and so is the rest."""
        own = list(_NUMBER.finditer(span))
        if not own:
            return False
        used: set[int] = set()
        for m in own:
            firsts = (next((i for i in self.places.get(form, ()) if i not in used), None) for form in readings(signs(m[0])))
            at = min((i for i in firsts if i is not None), default=None)
            if at is None:
                return False
            used.add(at)
        rest = _NUMBER.sub(" ", span).split()
        first = own[0].start() == 0
        return all(self.stands(t) for t in rest if not (first and any(c.isalpha() for c in t)))

    def keeps(self, span: str) -> bool:
        """Whether the text holds a protected span: as it is, or as a number that means the same."""
        if dangling(span) or self.stands(span):
            return True
        if (c := compact(span)) is not None and c in self.unspaced:
            return True
        if (d := decimal(span)) is not None and d in self.decimals:
            return True
        return self.numbers_stand(span)


def numbers_stand(span: str, text: str) -> bool:
    return Held(text).numbers_stand(span)


def kept(span: str, text: str) -> bool:
    return Held(text).keeps(span)


def _formula(v: str) -> bool:
    """A token that reads as a formula: an operand, an operator, and nothing else."""
    if len(v) < 3 or not _mathematical(v) or not _STRONG.search(v) and not ("_" in v and _DIGIT.search(v)):
        return False
    if _THREE.search(v) or _WORD_OF_SIGNS.fullmatch(v) or _AFTER_POINT.search(v):
        return False
    return _OPERAND.search(v) is not None


def _mathematical(v: str) -> bool:
    return _MATHEMATICAL.fullmatch(v) is not None


def bare(token: str) -> str:
    """A token without the punctuation around it; a citation keeps its brackets."""
    out = token.strip(AROUND)
    return out if out.startswith("[@") and out.endswith("]") else out.strip("[]")


def kind(v: str) -> str | None:
    """What a token is protected as, by the first rule that it fits; letters alone fit none."""
    if v.isalpha():
        return None
    local, at, domain = v.partition("@")
    stem, dot, end = v.rpartition(".")
    if v.startswith(("http://", "https://")):
        return "url"
    if v.startswith("#") and len(v) > 1:
        return "internal_anchor"
    if at and local and "." in domain and not domain.startswith(".") and not domain.endswith("."):
        return "email"
    if v.startswith("@") and len(v) > 1 or v.startswith("[@") and v.endswith("]") and len(v) > 3:
        return "citation"
    if re.search("[0-9]", v) and (v.endswith(("st", "nd", "rd", "th")) or re.fullmatch(r"[0-9.,:;/\-+%$€£]+", v)):
        return "number"
    if _formula(v):
        return "math"
    if dot and stem and end.lower() in FILES and re.fullmatch(r"[A-Za-z0-9_\-/.]+", stem):
        return "filename"
    return None


def _named(token: str) -> tuple[str, str | None, bool]:
    """A token without what is around it, its kind, and whether it may begin something longer: it compares, or announces a chapter."""
    t = bare(token)
    return t, kind(t), t in COMPARE or t.lower() == "capitolo"


class Memo(dict):
    """named[token] is _named(token), and is remembered; goes to other processes empty."""

    def __missing__(self, token: str) -> tuple[str, str | None, bool]:
        value = _named(token)
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[token] = value
        return value

    def __reduce__(self):
        return Memo, ()


named = Memo()


def protected(text: str) -> list[tuple[str, str]]:
    """(kind, text) of all spans of a text, sorted by text, each once: tokens, comparisons of three tokens, chapter numerals."""
    all_ = text.split()
    out, telling_ = set(), set()
    for raw in set(all_):
        if raw.isalpha() and len(raw) != len("capitolo"):
            continue
        t, k, begins = named[raw]
        if k:
            out.add((k, t))
        if begins:
            telling_.add(t)
    if telling_:
        tokens = [t for t in map(bare, all_) if t]
        operand = lambda t: len(t) <= 24 and re.search("[A-Za-z0-9]", t) is not None and _mathematical(t)
        telling = lambda t: _formula(t) or len(t) == 1 and t.isascii() and t.isalpha()
        for a, op, b in zip(tokens, tokens[1:], tokens[2:], strict=False):
            if op in COMPARE and operand(a) and operand(b) and (telling(a) or telling(b)):
                out.add(("math", f"{a} {op} {b}"))
        for a, b in zip(tokens, tokens[1:], strict=False):
            if a.lower() == "capitolo" and re.fullmatch("[IVXLCDM]+", b):
                out.add(("number", b))
    return sorted(out, key=lambda x: (x[1], x[0]))


class Dates:
    """Where a text has names of months, found once a text when a number first asks."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def _words(self) -> tuple[list[int], list[bool]]:
        found = [(m.start(), m[0].lower() in MONTHS) for m in re.finditer(r"[^\W\d_]+", self.text)]
        return [at for at, _ in found], [month for _, month in found]

    @cached_property
    def _numbers(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for m in re.finditer("[0-9]+", self.text):
            out.setdefault(m[0], []).append(m.start())
        return out

    def near(self, number: str) -> bool:
        """Whether the number, of digits alone, stands within two words of the name of a month."""
        starts, months = self._words
        places = (bisect_left(starts, at) for at in self._numbers.get(number, ()))
        return any(any(months[max(0, i - 2) : i + 2]) for i in places)


def severity(kind_: str, text: str, block: str, source: Dates) -> str:
    """How bad the loss of a span is: a lone small number is a warning unless it numbers or dates something."""
    if kind_ == "math":
        return "warning"
    if kind_ != "number":
        return "error"
    digits = len(re.findall("[0-9]", text))
    small = re.fullmatch("[0-9]{1,2}", text) and (block == "list_item" or re.match(rf"\s*{re.escape(text)}[.):\]]", source.text) or source.near(text))
    if digits >= 3 or re.search("[$€£¥]", text) or re.search("[0-9][.,][0-9]", text) or len(re.findall("[0-9]+", text)) >= 2 or small:
        return "error"
    return "warning"


def lost(source: str, target: str, block: str = "paragraph") -> list[tuple[str, str, str]]:
    """(kind, text, severity) of the spans of a source that its target doesn't keep."""
    held, dates = Held(target), Dates(source)
    same = source == target  # a span of one token stands in its own text; those of several are told by their tokens and may not
    return [(k, t, severity(k, t, block, dates)) for k, t in protected(source) if not (same and " " not in t) and not held.keeps(t)]


protected_spans = mapped(lambda t: [{"kind": k, "text": x} for k, x in protected(t)], "array<struct<kind: string, text: string>>")
lost_spans = mapped(lambda s, t: [{"kind": k, "text": x, "severity": v} for k, x, v in lost(s, t)], "array<struct<kind: string, text: string, severity: string>>")
