"""Queries that hold a text against the one it comes from."""

from __future__ import annotations

from collections import Counter

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.functions import findings
from longleaf.functions import text as T
from longleaf.functions.udf import mapped
from longleaf.registry import query, read

#: When a text counts as a copy of its source, and bounds of lengths; fixed values.
COPY_CHARS, COPY_WORDS, COPY_SHARE = 120, 30, 0.92
LEAST_RATIO, MOST_RATIO, RATIO_FROM = 0.33, 3.0, 40
_UNIT = r"[\p{L}\p{N}'']+"


def pairs(spark, d) -> DataFrame:
    """Documents as pairs: a third unchanged, a third without each 15th word, a third without each second."""
    # single spaces stay as they are, so only other blanks are replaced
    source = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f" {T.SPACE}++|(?![ !-~]){T.SPACE}++", " "))
    rows = read(spark, d, "documents").select("doc_id", source.alias("source"))
    w = F.split("source", " ")
    without = lambda n: F.array_join(F.filter(w, lambda x, i: (i + 1) % n != 0), " ")
    kind = F.col("doc_id") % 3
    return rows.select("doc_id", "source", F.when(kind == 0, F.col("source")).when(kind == 1, without(15)).otherwise(without(2)).alias("target"))


_PAIRS = r"""p AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN array_to_string(list_filter(w, lambda x, i: i % 15 <> 0), ' ') ELSE array_to_string(list_filter(w, lambda x, i: i % 2 <> 0), ' ') END AS target
 FROM (SELECT doc_id, source, string_split(source, ' ') AS w FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS source FROM documents)))"""


def _shared(source: str, target: str) -> dict:
    """Words of a source, and how many of them the target has too, each as often as it stands there."""
    a, b = (Counter(regex.findall(r"[\p{L}\p{N}']+", t)) for t in (source, target))
    return {"units": sum(a.values()), "overlap": sum((a & b).values())}


shared_words = mapped(_shared, "struct<units: long, overlap: long>")


def source_copies(rows: DataFrame, key: str = "doc_id", source: str = "source", target: str = "target") -> DataFrame:
    """(key, units, overlap, copied) for each pair: whether the target is its source, or keeps nearly all its words.

    The overlap is of bags and a fact of one row, so nothing is shuffled. Pairs too short to tell are copies only when equal.
    """
    out = rows.select(key, source, target, shared_words(F.lower(source), F.lower(target)).alias("bag"))
    units, overlap = F.col("bag.units"), F.col("bag.overlap")
    near = (F.length(source) >= COPY_CHARS) & (units >= COPY_WORDS) & (overlap >= COPY_WORDS) & (overlap >= COPY_SHARE * units)
    copied = F.col(source).rlike(r"\p{L}") & ((F.lower(source) == F.lower(target)) | near)
    return out.select(key, units.alias("units"), overlap.alias("overlap"), copied.alias("copied"))


@query(rf"""WITH {_PAIRS}, u AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(source, '{_UNIT}'), lambda x: lower(x))) AS w, 1 AS s, 0 AS t FROM p UNION ALL SELECT doc_id, unnest(list_transform(regexp_extract_all(target, '{_UNIT}'), lambda x: lower(x))), 0, 1 FROM p),
b AS (SELECT doc_id, CAST(sum(s) AS BIGINT) AS units, CAST(sum(least(s, t)) AS BIGINT) AS overlap FROM (SELECT doc_id, w, sum(s) AS s, sum(t) AS t FROM u GROUP BY ALL) GROUP BY doc_id)
SELECT p.doc_id, coalesce(units, 0) AS units, coalesce(overlap, 0) AS overlap, regexp_matches(source, '\p{{L}}') AND (lower(source) = lower(target) OR (length(source) >= {COPY_CHARS} AND coalesce(units, 0) >= {COPY_WORDS} AND overlap >= {COPY_WORDS} AND overlap >= {COPY_SHARE}::DOUBLE * units)) AS copied
FROM p LEFT JOIN b ON p.doc_id = b.doc_id""")
def source_copy_overlap(spark, d):
    return source_copies(pairs(spark, d))


def soft_warnings(source, target):
    """Names of what looks wrong with a target: an array, empty if nothing does."""
    n, m = F.greatest(F.length(source), F.lit(1)), F.length(target)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9][0-9.,]*[0-9]"), 0)
    links = lambda c: F.regexp_extract_all(c, F.lit(T.LINK), 0)
    lost = lambda f: F.size(F.array_except(f(source), f(target))) > 0
    rules = {
        "length_ratio": (n >= RATIO_FROM) & ~(m / n).between(LEAST_RATIO, MOST_RATIO), "untranslated": (n >= RATIO_FROM) & (F.trim(source) == F.trim(target)),
        "url_changed": lost(links), "number_changed": lost(numbers), "commentary": findings.commentary(target), "repetition": findings.repetition(target) & ~findings.repetition(source),
    }
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))


_REPEATS = "list_bool_or([false] || list_transform(range(1, len({w}) - 2), lambda i: {w}[i] = {w}[i + 1] AND {w}[i + 1] = {w}[i + 2] AND {w}[i + 2] = {w}[i + 3]))"
_BARE = r"list_filter(list_transform(string_split({c}, ' '), lambda x: lower(regexp_replace(x, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g'))), lambda x: x <> '')"


@query(rf"""WITH {_PAIRS}, n AS (SELECT *, greatest(length(source), 1) AS n, length(target) AS m, {_BARE.format(c="source")} AS sw, {_BARE.format(c="target")} AS tw FROM p),
k AS (SELECT doc_id, unnest([
 CASE WHEN n >= {RATIO_FROM} AND NOT (m / n BETWEEN {LEAST_RATIO} AND {MOST_RATIO}) THEN 'length_ratio' END, CASE WHEN n >= {RATIO_FROM} AND source = target THEN 'untranslated' END,
 CASE WHEN len(list_filter(regexp_extract_all(source, '{T.LINK}'), lambda x: NOT list_contains(regexp_extract_all(target, '{T.LINK}'), x))) > 0 THEN 'url_changed' END,
 CASE WHEN len(list_filter(regexp_extract_all(source, '[0-9][0-9.,]*[0-9]'), lambda x: NOT list_contains(regexp_extract_all(target, '[0-9][0-9.,]*[0-9]'), x))) > 0 THEN 'number_changed' END,
 CASE WHEN regexp_matches(lower(target), '^(here is |here''s |certainly|translation:)') OR contains(lower(target), 'as an ai') THEN 'commentary' END,
 CASE WHEN {_REPEATS.format(w="tw")} AND NOT {_REPEATS.format(w="sw")} THEN 'repetition' END]) AS kind FROM n)
SELECT kind, count(*) AS n, min(doc_id) AS first_doc FROM k WHERE kind IS NOT NULL GROUP BY kind""")
def soft_warning_counts(spark, d):
    rows = pairs(spark, d).select("doc_id", F.explode(soft_warnings(F.col("source"), F.col("target"))).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(rf"""WITH {_PAIRS} SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(source, '[0-9][0-9.,]*[0-9]'), lambda x: NOT list_contains(regexp_extract_all(target, '[0-9][0-9.,]*[0-9]'), x)))), ' ') AS missing FROM p WHERE regexp_matches(source, '[0-9][0-9.,]*[0-9]')""")
def missing_numbers(spark, d):
    """Numbers of two digits or more that the target has lost."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9][0-9.,]*[0-9]"), 0)
    rows = pairs(spark, d).filter(F.col("source").rlike(r"[0-9][0-9.,]*[0-9]"))
    return rows.select("doc_id", F.concat_ws(" ", F.array_sort(F.array_except(numbers("source"), numbers("target")))).alias("missing"))


@query(rf"""WITH {_PAIRS}, g AS (SELECT target FROM p WHERE length(target) > 0 GROUP BY target HAVING count(DISTINCT source) > 1) SELECT p.doc_id, sha256(p.target) AS target FROM p JOIN g ON p.target = g.target""")
def duplicate_targets(spark, d):
    """Different sources that ended as one target. Texts meet as digests, and a digest is counted once a source."""
    rows = pairs(spark, d).filter("target <> ''").select("doc_id", F.sha2("target", 256).alias("target"), F.sha2("source", 256).alias("source"))
    several = rows.groupBy("target").agg((F.min("source") != F.max("source")).alias("several")).filter("several").select("target")
    return rows.join(several, "target").select("doc_id", "target")


@query("""WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT d.lang, count(*) AS passages, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, count(*) FILTER (WHERE toxic = 1) AS defects,
CASE WHEN sum(coalesce(length(text), 0)) = 0 THEN 0 ELSE round(count(*) FILTER (WHERE toxic = 1) * 1000.0::DOUBLE / sum(coalesce(length(text), 0)), 9) END AS per_1k FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY d.lang""")
def defect_rates(spark, d):
    """Defects for a thousand characters of source; 0 where there are none of those."""
    bad = read(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    rows = read(spark, d, "documents").select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(bad, F.col("doc_id") == F.col("id"), "left")
    out = rows.groupBy("lang").agg(F.count("*").alias("passages"), F.sum("n").alias("chars"), F.count_if(F.col("toxic") == 1).alias("defects"))
    return out.withColumn("per_1k", F.coalesce(F.round(F.try_divide(F.col("defects") * 1000.0, F.col("chars")), 9), F.lit(0.0)))


@query("""SELECT quality AS category, count(*) AS findings, count(toxic) AS judged, count(*) FILTER (WHERE toxic = 1) AS upheld, CASE WHEN count(toxic) > 0 THEN round(count(*) FILTER (WHERE toxic = 1)::DOUBLE / count(toxic), 9) END AS true_positive_rate FROM labels GROUP BY quality""")
def precision_by_category(spark, d):
    rows = read(spark, d, "labels").groupBy(F.col("quality").alias("category"))
    out = rows.agg(F.count("*").alias("findings"), F.count("toxic").alias("judged"), F.count_if(F.col("toxic") == 1).alias("upheld"))
    return out.withColumn("true_positive_rate", F.round(F.try_divide(F.col("upheld").cast("double"), F.col("judged")), 9))
