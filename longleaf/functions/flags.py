"""Column functions over single strings: tokens, messages, lines, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.functions.responses import CATEGORIES

#: Punctuation around numbers; fixed value.
AROUND = r"^[,;:.!?()\[\]\x22']+|[,;:.!?()\[\]\x22']+$"
#: Operators of formulas, and those that are ones by themselves; fixed values.
OPERATORS = r"[=+\-*/^_()\[\]{}|<>\x{2211}\x{222B}\x{221A}\x{2264}\x{2265}\x{2248}\x{2260}\x{00B1}\x{00D7}\x{00F7}\x{2202}\x{2207}\x{221E}\x{2208}]"
STRONG = r"[=+*^<>\x{2211}\x{222B}\x{221A}\x{2264}\x{2265}\x{2248}\x{2260}\x{00B1}\x{00D7}\x{00F7}\x{2202}\x{2207}\x{221E}\x{2208}]"
#: Accented letters and the plain ones that stand for them; fixed values.
ACCENTED, PLAIN = "àáâäèéêëìíîïòóôöùúûü’", "aaaaeeeeiiiioooouuuu'"
#: Titles of sections of references; fixed values.
REFERENCES = ("note", "notes", "endnote", "endnotes", "bibliography", "references", "works cited", "index")
#: Characters that only format; fixed values.
INVISIBLE = r"\x{00AD}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{FFF9}-\x{FFFB}"
#: Sentences for people, by what was wrong with an answer.
SENTENCES = {"marker_mismatch": "The structure was not kept.", "missing_field": "A field is missing.", "invalid_json": "The answer is not JSON.", "unknown": "The answer could not be used."}
EMPTY, CUT = "There was no content.", "The answer was cut off."
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def trimmed_number(v: Column) -> Column:
    return F.regexp_replace(T.normal_signs(v), AROUND, "")


def dangling(v: Column) -> Column:
    """A range without an end."""
    return trimmed_number(v).rlike("[0-9].*-$|^-*[0-9].*-$")


def without_blanks(v: Column) -> Column:
    return F.regexp_replace(v, r"[ \t\n\f\r]", "")


def compact(v: Column) -> Column:
    """A span of two digits or more and punctuation of numbers, without blanks; else null."""
    bare = trimmed_number(v)
    return F.when((F.regexp_count(bare, F.lit("[0-9]")) >= 2) & bare.rlike(r"^[0-9 \t\n\f\r.,;:/\-+%$()]*$"), without_blanks(bare))


def folded(word: Column) -> Column:
    return F.translate(F.lower(word), ACCENTED, PLAIN)


def reference_section(title: Column) -> Column:
    names = "|".join(REFERENCES)
    return F.lower(F.trim(title)).rlike(f"^({names})( |$)|(^| )({names})$")


def page_reference(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, f"^{T.SPACE}+", "")).rlike(rf"^p\.{T.SPACE}*[0-9]+\.")


def proper_share(v: Column) -> Column:
    """The share of tokens that begin with a capital or hold a digit; null without tokens."""
    tokens = F.regexp_extract_all(v, F.lit(r"[\p{L}\p{N}]+"), 0)
    proper = F.size(F.filter(tokens, lambda t: t.rlike(r"^\p{Lu}|[0-9]")))
    return F.when(F.size(tokens) > 0, proper / F.size(tokens))


def meant_unchanged(kind: Column, source: Column, target: Column, most: int = 64, share: float = 0.8) -> Column:
    """Whether a block may stay as it is: a title, or a short line of names."""
    line = lambda c: F.trim(F.regexp_replace(T.strip_markers(c), T.SPACE + "+", " "))
    return F.lower(F.trim(kind)).isin("title", "heading") | ((F.length(line(source)) < most) & (F.length(line(target)) < most) & F.coalesce(proper_share(line(source)) > share, F.lit(False)))


def verdict(v: Column) -> Column:
    low = F.lower(F.trim(v))
    return F.when(low.isin("pass", "warn", "fail"), low).otherwise("warn")


def checks_copies(provider: Column, source: Column, target: Column) -> Column:
    """Whether an unchanged answer is an error: not of a mock provider, nor within one language."""
    return (F.lower(provider) != "mock") & F.coalesce(F.lower(source) != F.lower(target), F.lit(True))


def category(message: Column) -> Column:
    """What was wrong with an answer, by the first phrases that its message holds."""
    low, out = F.lower(message), F.when(F.lit(False), "")
    for name, phrases in CATEGORIES:
        out = out.when(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)), name)
    return out.otherwise("unknown")


def friendly(message: Column) -> Column:
    low, kind = F.lower(message), category(message)
    out = F.when(low.startswith("the model produced no content"), EMPTY).when(low.contains("truncated") | low.contains("output budget"), CUT)
    for name, sentence in SENTENCES.items():
        out = out.when(kind == name, sentence)
    return out


def visible(v: Column) -> Column:
    return F.length(F.regexp_replace(v, f"[{T.BLANKS}{INVISIBLE}]", ""))


def fuses(tail: Column, head: Column) -> Column:
    """Whether a line end's hyphen is none of the word that goes on: small letters on both sides."""
    return F.regexp_replace(tail, f"{T.SPACE}+$", "").rlike(r"\p{Ll}-$") & F.regexp_replace(head, f"^{T.SPACE}+", "").rlike(r"^\p{Ll}")


def unhyphens(v: Column) -> Column:
    return v.rlike(rf"[\p{{L}}\p{{N}}_]-{T.SPACE}*$")


def safe_for_terminal(v: Column) -> Column:
    return F.regexp_replace(v, r"[\x{0000}-\x{0008}\x{000B}-\x{001F}\x{007F}-\x{009F}]", "?")


def sliced(v: Column, n: int) -> Column:
    """A word in slices of n characters."""
    return F.when(F.length(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(v) - 1) / n).cast("int")), lambda i: F.substring(v, i * n + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def http_date(v: Column) -> Column:
    """Seconds since 1970 of a date of HTTP, in its two usual forms; else null."""
    body = F.trim(F.get(F.split(v, ","), F.lit(1)))
    at = lambda k, p: F.regexp_extract(body, p, k)
    full, short = r"^([0-9]{1,2})\s+([A-Za-z]{3})\s+([0-9]{1,4})\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})\s+[Gg][Mm][Tt]$", r"^([0-9]{1,2})-([A-Za-z]{3})-([0-9]{1,4})\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})\s+[Gg][Mm][Tt]$"
    pick = lambda k: F.when(body.rlike(full), at(k, full)).when(body.rlike(short), at(k, short))
    number = lambda k: pick(k).try_cast("int")
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(pick(2))), F.lit(0).cast("long"))
    year = F.when((F.length(pick(3)) == 2) & (number(3) < 70), number(3) + 2000).when(F.length(pick(3)) == 2, number(3) + 1900).otherwise(number(3))
    right = (month > 0) & number(1).between(1, 31) & (number(4) <= 23) & (number(5) <= 59) & (number(6) <= 60) & year.between(1600, 9999)
    day = F.datediff(F.date_add(F.make_date(year, month.cast("int"), F.lit(1)), number(1) - 1), F.lit("1970-01-01").cast("date"))
    return F.when(right, day.cast("long") * 86400 + number(4) * 3600 + number(5) * 60 + number(6))


def cached_tokens(answer: Column) -> Column:
    """Cached input tokens that an answer reports under the name of its maker; 0 if it reports none."""
    paths = ("$.usage.prompt_tokens_details.cached_tokens", "$.usage.input_tokens_details.cached_tokens", "$.usage.input_token_details.cache_read", "$.usage.cache_read_input_tokens")
    return F.coalesce(*[F.get_json_object(answer, p).try_cast("long") for p in paths], F.lit(0).cast("long"))


def mocked(mode: Column, language: Column, source: Column) -> Column:
    """What the stand-in for a model answers."""
    return F.when(mode == "prefix", F.concat(F.lit("["), language, F.lit("] "), source)).when(mode == "upper", F.upper(source)).otherwise(source)
