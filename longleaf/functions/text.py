"""Column functions over text: token costs, script, words, markers, numbers, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of scripts that are written without blanks between words; fixed values.
UNSPACED = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{D7B0}-\x{D7FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{32FFF}]"
#: White space of Unicode, spelt out so that all engines read it alike; fixed values.
BLANKS = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{BLANKS}]"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*%?"
LINK = r"https?://[^\s<>\x22]+"
MARKER = r"</?m[0-9]+/?>|<r[0-9]+/>|</(m|keep)>|<(m|keep|ref) [^>]*id=[^>]*>"
CAPITALISED = r"\p{Lu}\p{Ll}{2,}"


def estimate_tokens(text: Column) -> Column:
    """A quarter of a token for each code point, a whole one for unspaced scripts, rounded up; null gives 0."""
    unspaced = F.length(text) - F.length(F.regexp_replace(text, UNSPACED, ""))
    return F.coalesce(F.ceil((F.length(text) + 3 * unspaced) / 4), F.lit(0)).cast("long")


def script_class(text: Column) -> Column:
    """Whether letters with case outnumber those without: cased, caseless or undetermined."""
    count = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    cased, letters = count(r"[\p{Lu}\p{Ll}]"), count(r"\p{L}")
    rest = letters - cased
    return F.when(cased > rest, "cased").when(cased < rest, "caseless").otherwise("undetermined")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def head_words(text: Column, n: int) -> Column:
    return F.concat_ws(" ", F.slice(words(text), 1, n))


def tail_words(text: Column, n: int) -> Column:
    w = words(text)
    return F.concat_ws(" ", F.when(F.size(w) <= n, w).otherwise(F.slice(w, -n, n)))


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, MARKER, "")


def normal_signs(text: Column) -> Column:
    """Minus signs and dashes that stand for one, as a hyphen."""
    return F.translate(text, "−–—", "---")


def occurrences(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def space_delimited(text: Column, least: float) -> Column:
    """Whether blanks are at least this share of the letters; a text without letters counts as spaced."""
    letters, blanks = occurrences(text, r"\p{L}"), occurrences(text, SPACE)
    return (letters == 0) | (blanks / F.greatest(letters, F.lit(1)) >= least)


def marker_ids(text: Column) -> Column:
    """Ids of opening and empty markers, in order and with repeats; the older forms name theirs in an attribute."""
    quoted = r"^(?:(?!id=).)*id=([\x22'])(.*?)\1"
    found = F.regexp_extract_all(text, F.lit(r"<m[0-9]+/?>|<r[0-9]+/>|<(?:m|keep) [^>]*>|<ref [^>]*/>"), 0)
    found = F.filter(found, lambda x: ~F.contains(x, F.lit(" ")) | x.rlike(quoted))
    return F.transform(found, lambda x: F.when(F.contains(x, F.lit(" ")), F.regexp_extract(x, quoted, 2)).otherwise(F.regexp_replace(x, "[</>]", "")))


def first_kind(value: Column, kinds: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first pattern that the value fits, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in kinds:
        out = out.when(value.rlike(pattern), name)
    return out
