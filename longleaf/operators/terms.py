"""Terms in texts, and which of them a request carries."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of one automaton. A table of more terms goes over the texts once for each block of so many.
BLOCK = 200_000


def match_terms(texts: DataFrame, terms: DataFrame, keys: list[str], text: str = "text", term_id: str = "term_id", term: str = "term") -> DataFrame:
    """(keys, term_id): the terms that a text holds anywhere, whatever the case.

    One automaton finds all terms of a block in one pass over each text, so no pair of text and term
    is looked at that doesn't match. Terms are numbered by hash into blocks of about BLOCK, and an
    automaton is the only thing sent to the executors. Null and empty terms and texts match nothing;
    equal terms under different ids match together.
    """
    rows = terms.select(F.col(term_id).alias("term_id"), F.lower(F.col(term)).alias("term")).filter("term <> ''")
    blocks = -(-rows.count() // BLOCK)
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    out = texts.sparkSession.createDataFrame([], f"{kinds}, term_id {terms.schema[term_id].dataType.simpleString()}")
    low = texts.select(*keys, F.lower(F.col(text)).alias("low")).filter("low <> ''")
    for b in range(blocks):
        block = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b)
        by_term: dict[str, list] = {}
        for r in block.toLocalIterator():
            by_term.setdefault(r.term, []).append(r.term_id)
        if by_term:
            out = out.unionByName(low.mapInPandas(_finder(by_term, keys), out.schema))
    return out


def _finder(by_term: dict[str, list], keys: list[str]):
    words = list(by_term)
    ids = [by_term[w] for w in words]

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for k, w in enumerate(words):
            automaton.add_word(w, k)
        automaton.make_automaton()
        for f in frames:
            rows, found = [], []
            for k, text in enumerate(f["low"]):
                here = sorted({t for _, w in automaton.iter(text) for t in ids[w]})
                rows.extend([k] * len(here))
                found.extend(here)
            yield f[keys].iloc[rows].assign(term_id=found)

    return find


def within_budget(items: Column, cost: str, most: int) -> Column:
    """Items of an array in order, each kept if it still fits what those kept before leave: later small ones may fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter(items, lambda x: F.lit(False)).alias("kept"))
    fits = lambda acc, x: acc["used"] + x[cost] <= most
    step = lambda acc, x: F.struct(
        F.when(fits(acc, x), acc["used"] + x[cost]).otherwise(acc["used"]).alias("used"), F.when(fits(acc, x), F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))
    return F.aggregate(items, start, step, lambda acc: acc["kept"])
