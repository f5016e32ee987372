"""Column functions that judge translated text and name what went wrong."""

from __future__ import annotations

import re
from itertools import islice
from operator import eq

from pyspark.sql import Column
from pyspark.sql import functions as F

from longleaf.functions.text import BLANKS
from longleaf.functions.udf import blank_words, mapped

#: Phrases of stored errors and the kind that each names, in order of precedence; fixed values.
FAILURES = (
    ("interrupted", ("interrupted by user",)),
    ("protected_span_missing", ("protected span missing",)),
    ("inline_marker_missing", ("inline marker missing",)),
    ("inline_marker_duplicated", ("inline marker duplicated",)),
    ("inline_marker_unknown", ("unknown inline marker",)),
    ("marker_structure", ("invalid inline marker structure", "unexpected inline marker close", "is closed by", "is missing closing tag")),
    ("batch_block_mismatch", ("batch translation block mismatch", "missing block translations", "block translations, got", "returned duplicate block_id")),
    ("source_copy_unchanged", ("unchanged from the source-language prose", "of the source-language words")),
    ("target_language_gate", ("toki pona", "pi must group at least two following words", "en may only coordinate subjects")),
    ("provider_error", ("provider error", "http error", "http status", "rate limit", "unauthorized", "invalid api key", "connection", "timed out", "timeout")),
)
#: The one message that is an interruption only as a whole.
STOPPED = "translation interrupted before all blocks completed"


def failure_kind(message: Column) -> Column:
    """The first kind one of whose phrases the message holds, whatever its case; else other."""
    low = F.lower(message)
    holds = lambda phrases: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))
    kind = F.when(low == STOPPED, "interrupted")
    for name, phrases in FAILURES:
        kind = kind.when(holds(phrases), name)
    return kind.otherwise("other")


def commentary(text: Column) -> Column:
    """Whether a model talks about its answer instead of giving it."""
    low = F.lower(F.ltrim(F.coalesce(text, F.lit(""))))
    return low.rlike(r"^(here is |here's |certainly|translation:)") | F.contains(low, F.lit("as an ai"))


_INSIDE = re.compile("[a-z0-9](?:.*[a-z0-9])?", re.S)


def _repeats(low: str) -> bool:
    """Whether four words in a row are equal from their first letter or numeral of ASCII to their last; words without any are none."""
    words = [w if w.isascii() and w.isalnum() else m[0] if (m := _INSIDE.search(w)) else "" for w in blank_words(low)]
    words = list(filter(None, words))
    return b"\1\1\1" in bytes(map(eq, words, islice(words, 1, None)))


repeats = mapped(_repeats, "boolean")


def repetition(text: Column) -> Column:
    """Whether the same word stands four times in a row, ASCII case and punctuation around it aside.

    Words are split and held against each other by built-in functions: patterns over each character took several times as long.
    """
    text = F.coalesce(text, F.lit(""))
    # two signs become letters of ASCII in lower case, which they must not before punctuation is told from words
    return F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), _repetition_stripped(text)).otherwise(repeats(F.lower(text)))


def _repetition_stripped(text: Column) -> Column:
    """The same by steps: punctuation at the edges of words goes, then case, blanks become one."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?<![^{BLANKS}])[^a-zA-Z0-9{BLANKS}]++|[^a-zA-Z0-9{BLANKS}]++(?![^{BLANKS}])", "")
    return F.lower(F.regexp_replace(bare, f"[{BLANKS}]+", " ")).rlike("(?<![^ ])([^ ]++)(?: \\1){3}(?![^ ])")
