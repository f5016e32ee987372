"""Queries of functions over single strings, on strings of all the forms that they tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.functions import flags as G
from longleaf.functions import markers
from longleaf.functions import text as T
from longleaf.functions.responses import CATEGORIES
from longleaf.registry import query, read

#: Strings to tell apart; turns of conversations take them in turn.
CASES = (
    "1914-", "(12 / 34)", "12:30", "x-", "7", "3,5%", "−2", "a = b + 1", "Élan d’été", "p. 12. Rest", "In English: this", "Works Cited", "The Notes", "footnotes", "PASS", " fail ", "maybe", "Anna Karenina 1877", "a small line", "",
    "inline marker missing: m1", "Invalid batch JSON: missing field `id`", "EOF while parsing", "response truncated", "The model produced no content; output budget", "trans-", "exam ple", "tab\tbell\x07", "Sun, 06 Nov 1994 08:49:37 GMT",
    "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "Mon, 32 Jan 2020 00:00:00 GMT", '{"usage": {"prompt_tokens_details": {"cached_tokens": 5}}}', '{"usage": {"cache_read_input_tokens": 7}}', "{}", "soft­hyphen​", "go on",
)
_q = lambda s: "'" + s.replace("'", "''") + "'"
_LIST = "[" + ", ".join(_q(c) if "\x07" not in c else "'tab' || chr(9) || 'bell' || chr(7)" for c in CASES) + "]"
_V = f"v AS (SELECT conv_id, turn, role, {_LIST}[(conv_id * 7 + turn) % {len(CASES)} + 1] AS v FROM conversations)"


def strings(spark, d) -> DataFrame:
    v = F.element_at(F.array(*map(F.lit, CASES)), ((F.col("conv_id") * 7 + F.col("turn")) % len(CASES) + 1).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", v.alias("v"))


_BARE = rf"regexp_replace(translate(v, '−–—', '---'), '{G.AROUND.replace(chr(39), chr(39) * 2)}', '', 'g')"


@query(rf"""WITH {_V}, b AS (SELECT *, {_BARE} AS b FROM v) SELECT conv_id, turn, ends_with(b, '-') AND regexp_matches(b, '[0-9]') AS dangling, CASE WHEN len(regexp_extract_all(b, '[0-9]')) >= 2 AND regexp_full_match(b, '[0-9 \t\n\f\r.,;:/\-+%$()]*') THEN regexp_replace(b, '[ \t\n\f\r]', '', 'g') END AS compact,
CAST(len(regexp_extract_all(v, '{G.OPERATORS}')) AS BIGINT) AS operators, CAST(len(regexp_extract_all(v, '{G.STRONG}')) AS BIGINT) AS strong, CAST(len(regexp_extract_all(v, '[0-9.,+%\-−–—]+')) AS BIGINT) AS runs, translate(lower(v), '{G.ACCENTED}', '{G.PLAIN.replace(chr(39), chr(39) * 2)}') AS folded,
greatest(length(regexp_replace(v, '[^\p{{L}}\p{{N}}]', '', 'g')) - 1, 0) AS pairs, CAST(len(regexp_extract_all(v, '[\p{{L}}''’]+')) AS BIGINT) AS words FROM b""")
def token_flags(spark, d):
    v = F.col("v")
    count = lambda p: T.occurrences(v, p)
    return strings(spark, d).select(
        "conv_id", "turn", G.dangling(v).alias("dangling"), G.compact(v).alias("compact"), count(G.OPERATORS).alias("operators"), count(G.STRONG).alias("strong"), count(r"[0-9.,+%\-−–—]+").alias("runs"), G.folded(v).alias("folded"),
        F.greatest(F.length(F.regexp_replace(v, r"[^\p{L}\p{N}]", "")) - 1, F.lit(0)).cast("long").alias("pairs"), count(r"[\p{L}'’]+").alias("words"))


_REF = "|".join(G.REFERENCES)
_TOKENS = r"regexp_extract_all(v, '[\p{L}\p{N}]+')"
_SHARE = rf"CASE WHEN len({_TOKENS}) > 0 THEN len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '^\p{{Lu}}|[0-9]'))) / len({_TOKENS}) END"


@query(rf"""WITH {_V} SELECT conv_id, turn, regexp_matches(lower(trim(v)), '^({_REF})( |$)|(^| )({_REF})$') AS reference, regexp_matches(lower(v), '^{T.SPACE}*p\.{T.SPACE}*[0-9]+\.') AS page, contains(lower(v), 'in english:') AS gloss, {_SHARE} AS proper,
coalesce(length(v) < 64 AND ({_SHARE}) > 0.8, false) AS unchanged, CASE WHEN lower(trim(v)) IN ('pass', 'warn', 'fail') THEN lower(trim(v)) ELSE 'warn' END AS verdict, role <> 'user' AND lower(v) <> 'pass' AS checked,
regexp_matches(v, '^\p{{Lu}}') AND regexp_matches(v, '\p{{L}}.*\p{{L}}') AND regexp_matches(v, '\p{{Ll}}') AS capitalised, trim(v) <> '' AND trim(regexp_replace(v, '\p{{L}}', '', 'g')) = '' AS prose FROM v""")
def line_flags(spark, d):
    v = F.col("v")
    capital = v.rlike(r"^\p{Lu}") & v.rlike(r"\p{L}.*\p{L}") & v.rlike(r"\p{Ll}")
    return strings(spark, d).select(
        "conv_id", "turn", G.reference_section(v).alias("reference"), G.page_reference(v).alias("page"), F.lower(v).contains("in english:").alias("gloss"), G.proper_share(v).alias("proper"), G.meant_unchanged(F.lit("paragraph"), v, v).alias("unchanged"),
        G.verdict(v).alias("verdict"), G.checks_copies(F.when(F.col("role") == "user", "Mock").otherwise("x"), v, F.lit("pass")).alias("checked"), capital.alias("capitalised"), ((F.trim(v) != "") & (F.trim(F.regexp_replace(v, r"\p{L}", "")) == "")).alias("prose"))


_CAT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(v), {_q(p)})" for p in phrases) + f" THEN '{name}'" for name, phrases in CATEGORIES) + " ELSE 'unknown' END"
_SAY = "CASE " + " ".join(f"WHEN c = '{n}' THEN {_q(s)}" for n, s in G.SENTENCES.items()) + " END"


@query(rf"""WITH {_V}, k AS (SELECT *, {_CAT} AS c FROM v) SELECT conv_id, turn, c AS category, CASE WHEN starts_with(lower(v), 'the model produced no content') THEN '{G.EMPTY}' WHEN contains(lower(v), 'truncated') OR contains(lower(v), 'output budget') THEN '{G.CUT}' ELSE {_SAY} END AS sentence,
coalesce(TRY_CAST(CASE WHEN json_valid(v) THEN coalesce(json_extract_string(v, '$.usage.prompt_tokens_details.cached_tokens'), json_extract_string(v, '$.usage.cache_read_input_tokens')) END AS BIGINT), 0) AS cached,
coalesce(CASE WHEN regexp_matches(v, '^[A-Za-z]+, [0-9]') AND contains(v, '1994') THEN epoch(strptime(split_part(v, ', ', 2), '%d %b %Y %H:%M:%S GMT'))::BIGINT WHEN contains(v, '-Nov-94') THEN epoch(strptime(split_part(v, ', ', 2), '%d-%b-%y %H:%M:%S GMT'))::BIGINT END, -1) AS seconds,
CASE turn % 3 WHEN 0 THEN '[it] ' || v WHEN 1 THEN upper(v) ELSE v END AS mocked FROM k""")
def message_flags(spark, d):
    """Answers and their errors: categories, sentences for people, cached tokens, dates, and what the stand-in says."""
    v, turn = F.col("v"), F.col("turn") % 3
    return strings(spark, d).select(
        "conv_id", "turn", G.category(v).alias("category"), G.friendly(v).alias("sentence"), G.cached_tokens(v).alias("cached"), F.coalesce(G.http_date(v), F.lit(-1)).alias("seconds"),
        G.mocked(F.when(turn == 0, "prefix").when(turn == 1, "upper").otherwise("same"), F.lit("it"), v).alias("mocked"))


@query(rf"""WITH {_V}, n AS (SELECT *, lead(v) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM v) SELECT conv_id, turn, length(regexp_replace(v, '[{T.BLANKS}{G.INVISIBLE}]', '', 'g')) AS visible, lower(trim(regexp_replace(v, '\s+', ' ', 'g'))) AS key,
regexp_matches(v, '\p{{Ll}}-{T.SPACE}*$') AND regexp_matches(coalesce(after, ''), '^{T.SPACE}*\p{{Ll}}') AS fuses, regexp_matches(v, '[\p{{L}}\p{{N}}_]-{T.SPACE}*$') AS unhyphens, regexp_replace(v, '[\x{{0000}}-\x{{0008}}\x{{000B}}-\x{{001F}}\x{{007F}}-\x{{009F}}]', '?', 'g') AS safe,
array_to_string(list_transform(range(0, (length(v) + 4) // 5), lambda i: substr(v, i * 5 + 1, 5)), '|') AS slices, left(v, 6) AS head, right(v, 6) AS tail, array_to_string(regexp_extract_all(v, '[^、，；：,]*[、，；：,]|[^、，；：,]+'), '|') AS clauses FROM n""")
def shape_flags(spark, d):
    from pyspark.sql import Window

    v, after = F.col("v"), F.coalesce(F.lead("v").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = strings(spark, d).withColumn("after", after)
    return rows.select(
        "conv_id", "turn", G.visible(v).cast("long").alias("visible"), F.lower(F.trim(F.regexp_replace(v, T.SPACE + "+", " "))).alias("key"), G.fuses(v, F.col("after")).alias("fuses"), G.unhyphens(v).alias("unhyphens"), G.safe_for_terminal(v).alias("safe"),
        F.concat_ws("|", G.sliced(v, 5)).alias("slices"), F.left(v, F.lit(6)).alias("head"), F.right(v, F.lit(6)).alias("tail"), F.concat_ws("|", F.regexp_extract_all(v, F.lit("[^、，；：,]*[、，；：,]|[^、，；：,]+"), 0)).alias("clauses"))


_MARKED = "CASE turn % 5 WHEN 0 THEN '<m1>' || t || '</m1>' WHEN 1 THEN '<m1>' || t WHEN 2 THEN t || '</m2>' WHEN 3 THEN '<m1><m2>' || t || '</m1></m2>' ELSE '<m3><m4>' || t || '</m4></m3>' END"


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), m AS (SELECT conv_id, turn, regexp_extract_all({_MARKED}, '</?m[0-9]+>') AS t FROM c),
r AS (SELECT conv_id, turn, t, 1 AS i, CAST([] AS VARCHAR[]) AS stack, CAST(NULL AS VARCHAR) AS err FROM m UNION ALL
 SELECT conv_id, turn, t, i + 1, CASE WHEN starts_with(t[i], '</') THEN stack[1:len(stack) - 1] ELSE list_append(stack, t[i][2:-2]) END,
 CASE WHEN NOT starts_with(t[i], '</') THEN NULL WHEN len(stack) = 0 THEN 'unexpected inline marker close ' || t[i] WHEN stack[-1] <> t[i][3:-2] THEN 'inline marker <' || stack[-1] || '> is closed by ' || t[i] END FROM r WHERE i <= len(t) AND err IS NULL)
SELECT conv_id, turn, coalesce(err, CASE WHEN len(stack) > 0 THEN 'inline marker <' || stack[-1] || '> is missing closing tag </' || stack[-1] || '>' END) AS error FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC) = 1""")
def marker_errors(spark, d):
    """What is wrong with the nesting of markers in each turn."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("conv_id", "turn", markers.marker_error(F.expr(_MARKED)).alias("error"))
