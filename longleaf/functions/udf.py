"""Python functions as column functions, in Arrow batches: for what walks a text with a stack or a state."""

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from longleaf.functions.text import BLANKS

_BLANK = "[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{m[1]}", BLANKS) + "]+"
#: Rows of a batch at most, and those of them that are Python objects at a time: whole texts are long.
BATCH, SLICE = 500, 50


def blank_words(text: str) -> list[str]:
    """Words between blanks of Unicode; four separators of ASCII, at which Python splits too, are none."""
    return re.split(_BLANK, text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def short_batches() -> None:
    """Lower the session's batches, so that a worker's memory doesn't grow with the rows of its task."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)


def mapped(f: Callable, kind: str) -> Callable:
    """A function of columns that gives f of each row; rows with a null among them give null, or a struct of nulls."""

    def column(*columns):
        short_batches()
        type_ = to_arrow_type(DataType.fromDDL(kind))
        none = {} if pa.types.is_struct(type_) else None

        def some(*columns: pa.Array) -> pa.Array:
            return pa.array([none if any(x is None for x in row) else f(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], type_)

        def each(*columns: pa.Array) -> pa.Array:
            parts = [some(*(c.slice(i, SLICE) for c in columns)) for i in range(0, len(columns[0]), SLICE)]
            return pa.concat_arrays(parts) if parts else pa.array([], type_)

        return F.arrow_udf(each, kind)(*columns)

    return column
