"""URL filtering by listed rules and by mined association rules (operator 2).

A listed rule names a host (with all its subdomains) and a path prefix; the longest that fits a URL
decides. Where none fits, association rules decide: FP-growth mines the combinations of URL tokens that
go along with `allow` or `block` among labelled URLs, rules are pruned by support, confidence and redundancy,
and an inverted index from token to rules finds those whose tokens are all in a URL. The rule of highest
confidence decides, then of highest support; `block` goes before `allow`; without any, DEFAULT holds.

Labels are whatever a labelled frame says; the query labels the pages that a listed rule judges. The fit reads
about FIT_ROWS labelled rows; matching reads every URL whole. Tokens that lie in just the same labelled rows are one item
to the mining, so that a site whose URLs share a long path doesn't have its rules multiplied by the path's subsets;
at matching, each of them stands for that item.

Defined cases: a null URL, or one without `://`, has empty host and path, no tokens and the default verdict; rows
that repeat are judged alike; URLs of any length are mined and judged; without labelled rows there are no mined rules; an
empty table gives an empty result; other columns, `host`, `path` and `verdict` among them, aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rules of the query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
FIT_ROWS = 100_000
SUPPORT, CONFIDENCE = 0.005, 0.8
#: Mined rules that are sent to the tasks at most; more than that is an error, not a cut.
MOST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column, never null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides, like `org/`, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, being longer, go first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL: its domain, the labels before, path segments and names of parameters."""
    if not url or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path, _, query = rest[len(host) :].partition("#")[0].partition("?")
    labels = [x for x in host.lower().split(".") if x]
    out = {f"end:{labels[-1]}"} if labels else set()
    out |= {f"host:{x}" for x in labels[:-1]}
    out |= {f"path:{re.sub(r'[0-9]+', '0', x.lower())}" for x in path.split("/") if x}
    out |= {f"ask:{x.partition('=')[0]}" for x in re.split("[&;]", query) if x}
    return sorted(out)


def token_column(urls: Column) -> Column:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([tokens(u) for u in b], dtype=object)

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, "array<string>")(urls)


Rule = tuple[frozenset, str, float, float]


def mine(labelled: DataFrame, rows: int = FIT_ROWS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[list[Rule], dict[str, str]]:
    """Rules (items, verdict, confidence, support) from labelled (id, url, verdict), best first; and the item of each token that isn't its own.

    About `rows` rows are read, chosen by the hash of id and URL.
    """
    labelled = labelled.filter("verdict is not null and url is not null")
    n = labelled.count()
    if not n:
        return [], {}
    chosen = labelled.filter(C.hash01(F.struct("id", "url")) < min(1.0, rows / n))
    items = chosen.select(F.xxhash64("id", "url").alias("row"), token_column(F.col("url")).alias("tokens"), F.concat(F.lit("="), "verdict").alias("label")).filter("size(tokens) > 0")
    scratch = C.Scratch(labelled.sparkSession)
    items = scratch.keep(items)
    names = frequent(items, support)
    own = sorted(set(names.values()))
    items = items.select(F.concat(F.array_intersect("tokens", F.lit(own) if own else F.array().cast("array<string>")), F.array("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.filter("size(consequent) = 1 and startswith(consequent[0], '=')").select("antecedent", F.substring(F.col("consequent")[0], 2, 1000).alias("verdict"), "confidence", "support")
    found = found.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: raise support or confidence")
    return prune([(frozenset(r.antecedent), r.verdict, r.confidence, r.support) for r in found]), {t: name for t, name in names.items() if t != name}


def frequent(items: DataFrame, support: float) -> dict[str, str]:
    """Tokens that a frequent set may hold, each with the first of those that lie in the same rows.

    There are at most as many as tokens of a row divided by the support.
    """
    least = max(1, math.ceil(support * items.count()))
    per = items.select("row", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("where"))
    names: dict[tuple, str] = {}
    common = sorted((r.t, (r.n, r.where)) for r in per.filter(F.col("n") >= least).collect())
    return {t: names.setdefault(where, t) for t, where in common}


def prune(found: list[Rule]) -> list[Rule]:
    """Without rules that a rule of fewer tokens makes redundant; best first."""
    confidence = {(a, v): c for a, v, c, _ in found}
    kept = [r for r in found if not any(confidence.get((r[0] - {t}, r[1]), -1) >= r[2] for t in r[0])]
    return sorted(kept, key=lambda r: (-r[2], -r[3], r[1] != "block", len(r[0]), sorted(r[0])))


class Index:
    """From each token to the rules that hold its item; rules are numbered from the best."""

    def __init__(self, rules: list[Rule], names: dict[str, str] | None = None):
        self.rules, self.lists, self.names = rules, {}, names or {}
        for k, (a, *_) in enumerate(rules):
            for t in a:
                self.lists.setdefault(t, []).append(k)
        self.known: dict[tuple, int | None] = {}

    def best(self, found: list[str]) -> int | None:
        """The first rule whose tokens are all there."""
        key = tuple(sorted({t for t in (self.names.get(t, t) for t in found) if t in self.lists}))
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            counts: dict[int, int] = {}
            for t in key:
                for k in self.lists[t]:
                    counts[k] = counts.get(k, 0) + 1
            self.known[key] = min((k for k, n in counts.items() if n == len(self.rules[k][0])), default=None)
        return self.known[key]


def mined(rules: list[Rule], names: dict[str, str], urls: Column) -> Column:
    """A struct (verdict, confidence, because) of mined rules for a URL column; nulls where none matches."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(rules, names)
        for b in batches:
            at = [index.best(tokens(u)) for u in b]
            rows = [(None, None, None) if k is None else (rules[k][1], rules[k][2], " ".join(sorted(rules[k][0]))) for k in at]
            yield pd.DataFrame(rows, columns=["verdict", "confidence", "because"]).astype({"confidence": "float64"})

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(each, "verdict string, confidence double, because string")(urls)


def judged(pages: DataFrame, rules=RULES, rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, because: one row for each row of pages (page_id, url)."""
    C.check_columns(pages, "page_id", "url")
    host, path = parts(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    seen = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumns({"rule": rule, "listed": verdict})
    found, names = mine(seen.select(F.col("page_id").alias("id"), "url", F.col("listed").alias("verdict")), rows)
    out = seen.withColumn("m", mined(found, names, F.col("url")))
    confidence = F.when(F.col("rule").isNull(), F.col("m.confidence"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "m.verdict", F.lit(DEFAULT)).alias("verdict"), confidence.alias("confidence"), F.when(F.col("rule").isNull(), F.col("m.because")).alias("because"))


def op2(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judged(C.table(spark, sf_dir, "pages"))
