"""Greedy packing of ordered rows under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def pack(rows: DataFrame, group: str, order: str, cost: str, most: int, most_items: int | None = None) -> DataFrame:
    """rows with `segment`, counted from 0 in each group: a row that would pass the budget begins the next one.

    A row that alone is above the budget is a segment of its own. Rows of a group are dealt to one task and
    sorted, and a running total goes over them, so memory doesn't grow with the group.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used, items, segment = None, 0, 0, 0
        for f in frames:
            out = []
            for g, c in zip(f[group], f[cost], strict=True):
                if g != last:
                    last, used, items, segment = g, 0, 0, 0
                elif items and (used + c > most or most_items is not None and items >= most_items):
                    used, items, segment = 0, 0, segment + 1
                used, items = used + c, items + 1
                out.append(segment)
            yield f.assign(segment=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(fold, f"{kinds}, segment long")


def segmented(rows: DataFrame, group: str, order: str, most: int, glued: int) -> DataFrame:
    """rows (group, order, kind, tokens, …) with `segment`: like `pack`, but a block of up to `glued` tokens stays with the heading before it.

    Blocks count at least one token.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used, before, segment = None, 0, None, 0
        for f in frames:
            out = []
            for g, kind, tokens in zip(f[group], f["kind"], f["tokens"], strict=True):
                cost = max(tokens, 1)
                if g != last:
                    last, used, segment = g, 0, 0
                elif used + cost > most and not (before == "heading" and tokens <= glued):
                    used, segment = 0, segment + 1
                used, before = used + cost, kind
                out.append(segment)
            yield f.assign(segment=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(fold, f"{kinds}, segment long")
