"""Token counts of documents in flat token files without index (operator 3).

A flat file is token ids of a fixed width, one document after another, each closed by an end-of-document
id. Files are read in blocks that know nothing of documents. A task searches a block for separators
all at once and returns the lengths between them and what follows the last. A prefix scan over the blocks
of a file, first within runs of RUN blocks and then over the runs, carries to each block
the tokens of the document that is still open where it begins.

The query writes the documents' tokens into such streams (one a task of the input, cut at BLOCK
tokens wherever that falls) and counts them back; a block lists the documents that close in it.

Defined cases: a null or empty text has no tokens; tokens after a file's last separator are a document that was
never closed and is reported as such by `scan`, not counted as a document; blocks may hold no separator, one,
or many; rows that repeat are counted alike; an empty table gives an empty result; texts may be of any length; other columns,
`tokens` and `block` among them, aren't read. A vocabulary whose ids don't fit the width is an error.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import common as C

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary's tokenizer cuts text before merging: a fixed value of its format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The id that closes a document: free in this vocabulary.
SEPARATOR = 50256
WIDTH = "<u2"
#: Tokens of a block, and blocks of a run of the prefix scan.
BLOCK, RUN = 1 << 19, 1024
SCANNED = "file string, block long, seps long, lengths array<long>, tail long"


def separators(data: bytes, separator: int, width: str = WIDTH) -> tuple[np.ndarray, int]:
    """Tokens before each separator of a block since the last one, and tokens after the last."""
    at = np.flatnonzero(np.frombuffer(data, width) == separator)
    size = len(data) // np.dtype(width).itemsize
    if not len(at):
        return at, size
    return np.diff(at, prepend=-1) - 1, size - int(at[-1]) - 1


def scan(blocks: DataFrame, separator: int = SEPARATOR, width: str = WIDTH, *more: str) -> DataFrame:
    """(file, block, place, tokens): a row for each separator of blocks (file, block, data).

    place counts within the block. Columns named in `more` come along. A row with null place tells how many
    tokens of the file follow its last separator, if any do.
    """
    C.check_columns(blocks, "file", "block", "data", *more)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [separators(bytes(d), separator, width) for d in f.data]
            yield f.drop(columns="data").assign(lengths=[x for x, _ in found], seps=[len(x) for x, _ in found], tail=[t for _, t in found])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    out = ", ".join(f"{n} {kinds[n]}" for n in ("file", "block", *more)) + ", lengths array<long>, seps long, tail long"
    scratch = C.Scratch(blocks.sparkSession)
    kept = scratch.keep(blocks.select("file", "block", "data", *more).mapInPandas(each, out))
    carry = carried(kept.select("file", "block", "seps", "tail"))
    rows = kept.join(carry.withColumnsRenamed({"file": "its_file", "block": "its_block"}), F.expr("file = its_file and block = its_block"))
    closed = rows.select("file", "block", "carry", *more, F.posexplode("lengths").alias("place", "own"))
    closed = closed.select("file", "block", F.col("place").cast("long").alias("place"), (F.col("own") + F.when(F.col("place") == 0, F.col("carry")).otherwise(0)).alias("tokens"), *more)
    last = rows.groupBy("file").agg(F.max_by(F.struct("block", F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carry")).alias("open")), "block").alias("end"))
    left = last.select("file", F.col("end.block").alias("block"), F.lit(None).cast("long").alias("place"), F.col("end.open").alias("tokens"), *[F.lit(None).cast(kinds[m]).alias(m) for m in more])
    return closed.unionByName(left.filter("tokens > 0"))


def carried(blocks: DataFrame) -> DataFrame:
    """(file, block, carry): tokens of the open document at the beginning of each block (file, block, seps, tail).

    The scan's operation on (seps, tail) is associative: a block with separators forgets what came before. It
    runs within runs of blocks, over the runs' sums, and adds both.
    """
    run = F.floor(F.col("block") / RUN)
    inside = Window.partitionBy("file", "run").orderBy("block")
    b = blocks.withColumn("run", run).withColumn("part", F.coalesce(F.sum("seps").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a block with separators begins a new stretch after itself; its tail is the first of that stretch
    b = b.withColumn("opens", F.col("part") + F.col("seps"))
    stretch = b.groupBy("file", "run", "opens").agg(F.sum("tail").alias("open"), F.max("block").alias("upto"))
    runs = stretch.groupBy("file", "run").agg(F.max("opens").alias("seps"), F.max_by("open", "opens").alias("tail"))
    above = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("seps").over(above), F.lit(0))).withColumn("opens", F.col("before") + F.col("seps"))
    upto = Window.partitionBy("file", "opens").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("open", F.sum("tail").over(upto))
    runs = runs.select("file", "run", F.coalesce(F.lag("open").over(Window.partitionBy("file").orderBy("run")), F.lit(0)).alias("enters"))
    so_far = Window.partitionBy("file", "run", "opens").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("open", F.sum("tail").over(so_far)).withColumn("within", F.coalesce(F.lag("open").over(inside), F.lit(0)))
    b = b.join(runs.withColumnsRenamed({"file": "f", "run": "r"}), F.expr("file = f and run = r"))
    return b.select("file", "block", (F.col("within") + F.when(F.col("part") == 0, F.col("enters")).otherwise(0)).alias("carry"))


def read_ranks(path: str = RANKS) -> bytes:
    """The vocabulary file, read where the driver is and sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer(ranks: bytes):
    import tiktoken

    kept = sys.__dict__.setdefault("_longleaf_ranks", {})
    if hash(ranks) not in kept:
        kept.clear()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        if max(table.values(), default=0) > np.iinfo(WIDTH).max or SEPARATOR in table.values():
            raise ValueError(f"ids must fit {WIDTH} and leave {SEPARATOR} free")
        kept[hash(ranks)] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return kept[hash(ranks)]


def streams(docs: DataFrame, ranks: bytes, block: int = BLOCK) -> DataFrame:
    """(file, block, data, ids): the tokens of docs (doc_id, text) as flat streams, cut into blocks; ids of the documents that close in a block."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(ranks).encode_to_numpy
        file, number, held, size, ids = f"part-{TaskContext.get().partitionId():06d}", 0, [], 0, []

        def cut(limit: int) -> Iterator[pd.DataFrame]:
            """Whole blocks of what is held, while there is more than the limit."""
            nonlocal number, held, size, ids
            if size < limit or not size:
                return
            flat = np.concatenate(held)
            for i in range(0, len(flat), block):
                part = flat[i : i + block]
                if len(part) < block and limit > 1:
                    break
                n = int((part == SEPARATOR).sum())
                yield pd.DataFrame({"file": file, "block": number, "data": [part.tobytes()], "ids": [ids[:n]]})
                ids, number, size = ids[n:], number + 1, size - len(part)
            held = [flat[len(flat) - size :]]

        for f in frames:
            for doc, text in zip(f.doc_id.astype("Int64"), f.text, strict=True):
                if text:
                    held.append(encode(text, disallowed_special=()).astype(WIDTH))
                    size += len(held[-1])
                held.append(np.array([SEPARATOR], WIDTH))
                size += 1
                ids.append(None if doc is pd.NA else int(doc))
                if size >= 4 * block:
                    yield from cut(block)
        yield from cut(1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(each, "file string, block long, data binary, ids array<long>")


def counted(docs: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, n_tokens: one row for each row of docs (doc_id, text)."""
    C.check_columns(docs, "doc_id", "text")
    found = scan(streams(docs, ranks), SEPARATOR, WIDTH, "ids").filter("place is not null")
    return found.select(F.expr("ids[int(place)]").alias("doc_id"), F.col("tokens").alias("n_tokens"))


def read_files(spark, path: str, block: int = BLOCK, width: str = WIDTH) -> DataFrame:
    """(file, block, data) of flat token files, through Spark's reader."""
    step = block * np.dtype(width).itemsize
    files = spark.read.format("binaryFile").load(path)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f.path, f.content, strict=True):
                for i in range(0, len(data), step):
                    yield pd.DataFrame({"file": name, "block": i // step, "data": [bytes(data[i : i + step])]})

    return files.select("path", "content").mapInPandas(each, "file string, block long, data binary")


def op3(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, counted in flat streams."""
    return counted(C.table(spark, sf_dir, "documents"), read_ranks())
