"""Queries of decoded pages."""

from __future__ import annotations

from longleaf.registry import query, read
from longleaf.sources.blocks import page_blocks


@query(None)
def html_blocks(spark, d):
    """The blocks of every page in order, with their kind; SQL can't walk markup."""
    return page_blocks(read(spark, d, "pages"))
