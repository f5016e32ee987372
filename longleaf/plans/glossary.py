"""Queries of glossaries: terms in segments, selection under a budget, mining of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.operators.terms import match_terms, within_budget
from longleaf.registry import query, read

#: Segments before one in which a term is still active, terms that anchor every segment, and tokens of a selection.
RECENT, ANCHORS, BUDGET = 5, 20, 24

_TERMS = rf"""g AS (SELECT term_id, lower(term) AS term, term_id % 11 = 0 AS always, length(term) // 4 + 2 AS cost FROM (SELECT min(item_id * 1000 + k) AS term_id, term FROM (
 SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS k FROM (SELECT item_id, regexp_extract_all(text, '{T.CAPITALISED}') AS w FROM benchmark)) GROUP BY term) WHERE length(term) >= 5),
m AS (SELECT conv_id, turn, role, term_id FROM conversations c JOIN g ON contains(lower(c.text), g.term))"""


def terms(spark, d) -> DataFrame:
    """Capitalised words of the benchmark as a glossary."""
    rows = read(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(T.CAPITALISED), 0)).alias("k", "term"))
    rows = rows.groupBy("term").agg(F.min(F.col("item_id") * 1000 + F.col("k") + 1).alias("term_id")).filter(F.length("term") >= 5)
    return rows.select("term_id", "term", (F.col("term_id") % 11 == 0).alias("always"), F.floor(F.length("term") / 4 + 2).alias("cost"))


def matches(spark, d) -> DataFrame:
    return match_terms(read(spark, d, "conversations"), terms(spark, d), ["conv_id", "turn", "role"])


@query(f"WITH {_TERMS} SELECT g.term_id, g.term, count(m.term_id) AS segments FROM g LEFT JOIN m ON m.term_id = g.term_id GROUP BY ALL")
def glossary_term_matches(spark, d):
    """In how many segments a term stands."""
    found = matches(spark, d).groupBy("term_id").agg(F.count("*").alias("segments"))
    return terms(spark, d).select("term_id", F.lower("term").alias("term")).join(found, "term_id", "left").fillna(0, ["segments"])


@query(f"WITH {_TERMS} SELECT term_id, count(*) AS segments FROM m GROUP BY term_id ORDER BY segments DESC, term_id LIMIT {ANCHORS}")
def high_frequency_anchors(spark, d):
    return matches(spark, d).groupBy("term_id").agg(F.count("*").alias("segments")).orderBy(F.desc("segments"), "term_id").limit(ANCHORS)


_SELECT = f"""{_TERMS}, a AS (SELECT term_id FROM m GROUP BY term_id ORDER BY count(*) DESC, term_id LIMIT {ANCHORS}),
r AS (SELECT conv_id, turn, term_id, 1 AS rule FROM m UNION ALL SELECT conv_id, turn, term_id, 2 FROM conversations, g WHERE always
 UNION ALL SELECT c.conv_id, c.turn, m.term_id, 3 FROM conversations c JOIN m ON c.conv_id = m.conv_id AND c.role = m.role AND m.turn < c.turn AND m.turn >= c.turn - {RECENT}
 UNION ALL SELECT conv_id, turn, term_id, 4 FROM conversations, a),
s AS (SELECT conv_id, turn, term_id, min(rule) AS rule FROM r GROUP BY ALL)"""


def selected(spark, d) -> DataFrame:
    """(conv_id, turn, term_id, rule): the first rule that takes a term into a segment's selection.

    1 it stands there; 2 it is always active; 3 it stood in one of the last segments of the same section; 4 it is an
    anchor of the book. The terms of rules 2 and 4 are one short array, which goes to every segment without a join.
    """
    texts, found = read(spark, d, "conversations").select("conv_id", "turn", "role"), matches(spark, d)
    anchors = found.groupBy("term_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term_id").limit(ANCHORS).select("term_id", F.lit(4).alias("rule"))
    always = terms(spark, d).filter("always").select("term_id", F.lit(2).alias("rule"))
    fixed = [F.struct(F.lit(r.term_id).cast("long").alias("term_id"), F.lit(r.rule).alias("rule")) for r in always.unionByName(anchors).collect()]
    everywhere = texts.select("conv_id", "turn", F.explode(F.array(*fixed)).alias("x")).select("conv_id", "turn", "x.term_id", "x.rule") if fixed else None
    later = found.select("conv_id", "role", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + RECENT)).alias("turn"), "term_id")
    recent = texts.join(later, ["conv_id", "turn", "role"]).select("conv_id", "turn", "term_id", F.lit(3).alias("rule"))
    rules = found.select("conv_id", "turn", "term_id", F.lit(1).alias("rule")).unionByName(recent)
    rules = rules if everywhere is None else rules.unionByName(everywhere)
    return rules.groupBy("conv_id", "turn", "term_id").agg(F.min("rule").alias("rule"))


@query(f"WITH {_SELECT} SELECT rule, count(*) AS n, count(DISTINCT term_id) AS terms FROM s GROUP BY rule")
def glossary_select(spark, d):
    """How many terms each rule brings in."""
    per = selected(spark, d).groupBy("rule", "term_id").agg(F.count("*").alias("n"))
    return per.groupBy("rule").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))


@query(f"""WITH RECURSIVE {_SELECT}, o AS (SELECT s.*, g.cost, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rule, s.term_id) AS k FROM s JOIN g ON g.term_id = s.term_id),
b AS (SELECT conv_id, turn, k, rule, cost <= {BUDGET} AS kept, CASE WHEN cost <= {BUDGET} THEN cost ELSE 0 END AS used FROM o WHERE k = 1
 UNION ALL SELECT o.conv_id, o.turn, o.k, o.rule, b.used + o.cost <= {BUDGET}, CASE WHEN b.used + o.cost <= {BUDGET} THEN b.used + o.cost ELSE b.used END FROM b JOIN o ON o.conv_id = b.conv_id AND o.turn = b.turn AND o.k = b.k + 1)
SELECT conv_id, turn, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS left_out, CAST(max(used) AS BIGINT) AS tokens FROM b GROUP BY conv_id, turn""")
def glossary_budget(spark, d):
    """Each segment's selection in order of rule, as far as its budget goes; a term too long doesn't end it."""
    cost = terms(spark, d).select("term_id", "cost")
    rows = selected(spark, d).join(cost, "term_id").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("rule", "term_id", "cost"))).alias("items"))
    kept = within_budget(F.col("items"), "cost", BUDGET)
    rows = rows.select("conv_id", "turn", F.size("items").alias("n"), kept.alias("kept"))
    tokens = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["cost"])
    return rows.select("conv_id", "turn", F.size("kept").cast("long").alias("kept"), (F.col("n") - F.size("kept")).cast("long").alias("left_out"), tokens.alias("tokens"))


@query(r"""WITH w AS (SELECT coalesce(source, '') AS book, doc_id, unnest(list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x))) AS w FROM documents),
n AS (SELECT book, count(*) AS tokens, count(DISTINCT doc_id) AS docs FROM w GROUP BY book),
t AS (SELECT book, w, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w WHERE length(w) >= 2 GROUP BY book, w HAVING count(*) >= 2),
s AS (SELECT t.*, n.tokens, round(ln(1 + tf) * ln((n.docs + 1) / (df + 1)), 9) AS score FROM t JOIN n ON t.book = n.book)
SELECT book, w AS term, tf, df FROM s QUALIFY row_number() OVER (PARTITION BY book ORDER BY score DESC, tf DESC, w) <= ceil(sqrt(tokens))""")
def candidate_tfidf(spark, d):
    """The words of each book that recur and are bound to few documents: as many as the root of its words.

    A document's words are sorted within its row, where the first of equal ones counts the document, so that tasks
    shuffle sums of a book's words alone. Only where documents come in several rows do their texts meet first. The
    ranking goes over a book's vocabulary, not its words.
    """
    docs = read(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("book"), "doc_id", "text")
    if not docs.groupBy("book", "doc_id").count().filter("count > 1").isEmpty():
        docs = docs.groupBy("book", "doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    words = F.array_sort(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0), F.lower))
    rows = docs.select("book", words.alias("w")).select("book", F.posexplode("w").alias("i", "term"), "w")
    rows = rows.select("book", "term", (F.col("i") == 0).alias("head"), F.coalesce(F.col("term") != F.get("w", F.col("i") - 1), F.lit(True)).alias("first"))
    per = rows.groupBy("book", "term").agg(F.count("*").alias("tf"), F.count_if("first").alias("df"), F.count_if("head").alias("docs"))
    books = per.groupBy("book").agg(F.sum("tf").alias("tokens"), F.sum("docs").alias("docs"))
    counts = per.filter((F.length("term") >= 2) & (F.col("tf") >= 2)).select("book", "term", "tf", "df")
    score = F.round(F.log(1 + F.col("tf")) * F.log((F.col("docs") + 1) / (F.col("df") + 1)), 9)
    ranked = counts.join(books, "book").withColumn("score", score)
    k = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("score"), F.desc("tf"), "term"))
    return ranked.withColumn("k", k).filter(F.col("k") <= F.ceil(F.sqrt("tokens"))).select("book", "term", "tf", "df")


@query(f"WITH {_TERMS}, x AS (SELECT m.conv_id, m.turn, m.term_id, EXISTS (SELECT 1 FROM m n WHERE n.conv_id = m.conv_id AND n.turn = m.turn + 1 AND n.term_id = m.term_id) AS honoured FROM m) SELECT term_id, count(*) AS injected, count(*) FILTER (WHERE honoured) AS honoured FROM x GROUP BY term_id")
def glossary_honored_rate(spark, d):
    """How often a term of a segment stands in the answer to it."""
    found = matches(spark, d).select("conv_id", "turn", "term_id").distinct()
    answer = found.select("conv_id", (F.col("turn") - 1).alias("turn"), "term_id", F.lit(True).alias("honoured"))
    rows = found.join(answer, ["conv_id", "turn", "term_id"], "left")
    return rows.groupBy("term_id").agg(F.count("*").alias("injected"), F.count("honoured").alias("honoured"))


@query("""WITH t AS (SELECT p_name AS source, 2 AS priority, p_partkey AS seq, p_brand AS target, p_type AS notes FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_name, 1, p_partkey, p_brand, NULL FROM part WHERE p_size % 3 = 1 UNION ALL SELECT p_name, 0, p_partkey, NULL, p_type FROM part WHERE p_size % 3 = 2)
SELECT source, arg_max(target, {'p': priority, 's': seq}) FILTER (WHERE target IS NOT NULL) AS target, arg_max(notes, {'p': priority, 's': seq}) FILTER (WHERE notes IS NOT NULL) AS notes, count(*) AS layers FROM t GROUP BY source""")
def style_merge_fieldwise(spark, d):
    """Layers of a style over each other, field by field: each field comes from the narrowest layer that sets it."""
    size = F.col("p_size") % 3
    rows = read(spark, d, "part").select(F.col("p_name").alias("source"), F.struct((2 - size).alias("p"), F.col("p_partkey").alias("s")).alias("at"), F.when(size < 2, F.col("p_brand")).alias("target"), F.when(size != 1, F.col("p_type")).alias("notes"))
    top = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return rows.groupBy("source").agg(top("target"), top("notes"), F.count("*").alias("layers"))
