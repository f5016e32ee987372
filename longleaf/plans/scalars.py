"""Queries of scalar functions over whole texts."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from longleaf.functions import findings, numbers
from longleaf.functions import text as T
from longleaf.functions.udf import blank_words, mapped
from longleaf.registry import WORDS, query, read

#: Least share of blanks to letters of a script that puts blanks between words; fixed value.
SPACED = 0.02


@query(rf"""SELECT doc_id, n = 0 OR s / n >= {SPACED} AS space_delimited FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\p{{L}}')) AS n, len(regexp_extract_all(coalesce(text, ''), '\s')) AS s FROM documents)""")
def space_delimited_flag(spark, d):
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.space_delimited(text, SPACED).alias("space_delimited"))


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{Lu}\p{Ll}]')) AS cased, len(regexp_extract_all(coalesce(text, ''), '\p{L}')) - len(regexp_extract_all(coalesce(text, ''), '[\p{Lu}\p{Ll}]')) AS caseless FROM documents""")
def script_counts(spark, d):
    cased, letters = T.occurrences(F.col("text"), r"[\p{Lu}\p{Ll}]"), T.occurrences(F.col("text"), r"\p{L}")
    return read(spark, d, "documents").select("doc_id", cased.alias("cased"), (letters - cased).alias("caseless"))


@query(r"""WITH m AS (SELECT conv_id, turn, '<m' || turn || '>' || coalesce(text, '') || '</m' || turn || '><r' || conv_id || '/>' AS text FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '<[mr][0-9]+/?>'), lambda x: regexp_replace(x, '[</>]', '', 'g')), ' ') AS ids, length(regexp_replace(text, '</?m[0-9]+/?>|<r[0-9]+/>', '', 'g')) AS n_plain FROM m""")
def marker_ids_extract(spark, d):
    """Ids of opening and empty markers in order, repeats kept, of turns in markers; and what is left without."""
    text = F.concat(F.lit("<m"), "turn", F.lit(">"), F.coalesce("text", F.lit("")), F.lit("</m"), "turn", F.lit("><r"), "conv_id", F.lit("/>"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    return rows.select("conv_id", "turn", F.concat_ws(" ", T.marker_ids(F.col("text"))).alias("ids"), F.length(T.strip_markers(F.col("text"))).cast("long").alias("n_plain"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\s+')) AS w FROM documents),
c AS (SELECT doc_id, regexp_replace(translate(w, '−–—', '---'), '^[,;:.!?()\[\]\x22'']+|[,;:.!?()\[\]\x22'']+$', '', 'g') AS v FROM t)
SELECT replace(v, ',', '.') AS number, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c WHERE regexp_matches(v, '^([-+0-9]*[0-9][-+0-9]*|([-+]+[0-9]*|[0-9]+)[.,][0-9]+)%?$') GROUP BY 1""")
def canonical_decimals(spark, d):
    """Numbers of all documents in one form, with how often and in how many documents they stand."""
    rows = read(spark, d, "documents").filter(F.col("text").rlike("[0-9]")).select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    per = rows.select("doc_id", numbers.canonical_decimal(F.col("w")).alias("number")).filter("number is not null").groupBy("number", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("number").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


_KINDS = (
    ("url", r"^https?://"),
    ("anchor", r"^#[A-Za-z0-9_-]+$"),
    ("email", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$"),
    ("citation", r"^(@[A-Za-z0-9_:.-]+|\[@.*\])$"),
    ("number", r"^[-+]?[0-9][0-9.,:/%+-]*(st|nd|rd|th)?$"),
    ("filename", r"^[A-Za-z0-9_.-]+[.](txt|md|csv|json|xml|html|pdf|epub|png|jpg|zip|py|rs|toml)$"),
)
_PATTERNS = [(kind, re.compile(p)) for kind, p in _KINDS]


def _word_kinds(text: str) -> list[dict]:
    """How many words of a text are of each kind. Letters alone fit none, nor do words without a sign of one."""
    out = Counter()
    for word in blank_words(text):
        if not word.isalpha() and _TELLING.search(word):
            v = word.lstrip("([\"'").rstrip(")],;:.!?\"'")
            out[next((kind for kind, p in _PATTERNS if p.search(v)), None)] += 1
    return [{"kind": k, "n": n} for k, n in out.items() if k]


_TELLING = re.compile("[0-9@#]|://|[.][a-z]")
word_kinds = mapped(_word_kinds, "array<struct<kind: string, n: long>>")
_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{k}'" for k, p in _KINDS) + " END"


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\s+')) AS w FROM documents),
k AS (SELECT doc_id, {_KIND_SQL} AS kind FROM (SELECT doc_id, regexp_replace(w, '^[(\[\x22'']+|[)\],;:.!?\x22'']+$', '', 'g') AS v FROM t))
SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k WHERE kind IS NOT NULL GROUP BY kind""")
def protected_span_kinds(spark, d):
    """Words that a translation must keep, by the first kind that they fit, counted within their text."""
    rows = read(spark, d, "documents").select("doc_id", F.explode(word_kinds("text")).alias("k"))
    per = rows.groupBy("k.kind", "doc_id").agg(F.sum("k.n").alias("n"))
    return per.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: lower(regexp_replace(x, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g'))), lambda x: x <> '') AS w FROM documents),
r AS (SELECT doc_id, list_bool_or([false] || list_transform(range(1, len(w) - 2), lambda i: w[i] = w[i + 1] AND w[i + 1] = w[i + 2] AND w[i + 2] = w[i + 3])) AS repeats FROM w)
SELECT d.doc_id, r.repeats, regexp_matches(lower(ltrim(coalesce(text, ''))), '^(here is |here''s |certainly|translation:)') OR contains(lower(coalesce(text, '')), 'as an ai') AS commentary FROM documents d JOIN r ON d.doc_id = r.doc_id""")
def repetition_and_commentary(spark, d):
    text = F.col("text")
    return read(spark, d, "documents").select("doc_id", findings.repetition(text).alias("repeats"), findings.commentary(text).alias("commentary"))


@query(rf"""SELECT page_id, host, len(list_filter(string_split(path, '/'), lambda p: p <> '')) AS depth, len(url) - length(replace(url, '%', '')) AS escapes FROM (
SELECT page_id, coalesce(url, '') AS url, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def urls_extract(spark, d):
    """Host, depth of path and percent escapes of every url."""
    url = F.coalesce("url", F.lit(""))
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return read(spark, d, "pages").select(
        "page_id", F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)).alias("host"),
        F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("long").alias("depth"), (F.length(url) - F.length(F.replace(url, F.lit("%"), F.lit("")))).cast("long").alias("escapes"),
    )


@query(f"SELECT sha256(string_agg(array_to_string({WORDS}, ' '), chr(31) ORDER BY turn)) AS fingerprint, count(*) AS turns, conv_id FROM conversations GROUP BY conv_id")
def conversation_fingerprint(spark, d):
    """A checksum of a conversation that white space doesn't change."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", T.words(F.col("text"))).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\x1f")
    return rows.groupBy("conv_id").agg(F.sha2(body, 256).alias("fingerprint"), F.count("*").alias("turns"))
