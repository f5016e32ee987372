"""Exact deduplication by owners in Patricia tries (operator 8).

Texts are equal when they are the same after each run of white space becomes one blank. Every task
first puts what it reads into a compressed radix trie of its own, so that a group of copies
leaves each task as one row however large it is. The distinct texts are then dealt by length
and content hash, and each partition inserts their whole byte strings into one trie whose
terminal nodes hold the smallest identifier and the number of rows. When a trie outgrows its
budget, the first pass hands on what it has, and the second moves the largest subtree to a
file of the task, to be built alone at the end. Documents find their owner by SHA-256; that
join is the last step, so that Spark can split the partition of a very large group.

Defined cases: a null text counts as empty, and empty texts are copies of each other; of rows with
the same text and id, all count and all are kept where theirs is the smallest id; null ids
are larger than any other; a group whose ids are all null keeps each row; an empty table gives an empty result;
texts may be of any length, one above a trie's budget being a trie of its own; other columns, `owner` and `sha` among
them, aren't read. A subtree's file is the task's own, rebuilt when the task runs again.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text that a trie holds at most, but for a text that is longer by itself.
TRIE_BYTES = 48 << 20
_NODE = 250  # bytes that a node costs besides its edge
_CHUNK = 2000  # rows of an output frame


class Node:
    __slots__ = ("edge", "kids", "owner", "rows")

    def __init__(self, edge: bytes, owner: int | None = None, rows: int = 0):
        self.edge, self.owner, self.rows, self.kids = edge, owner, rows, {}


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def below(node: Node, path: bytes) -> Iterator[tuple[bytes, int, int]]:
    stack = [(node, path)]
    while stack:
        node, path = stack.pop()
        path += node.edge
        if node.rows:
            yield path, node.owner, node.rows
        stack += [(kid, path) for kid in node.kids.values()]


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class PatriciaTrie:
    """Byte strings with their smallest identifier (None: no identifier) and number of rows."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.size, self.strings, self.budget, self.spilled = Node(b""), 0, 0, budget, {}

    def insert(self, key: bytes, owner: int | None, rows: int = 1) -> None:
        for prefix, file in self.spilled.items():
            if key.startswith(prefix):
                pickle.dump((key, owner, rows), file)
                return
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.size += len(key) - at + _NODE
                node, at = kid, len(key)
                break
            if not key.startswith(kid.edge, at):
                n = shared(kid.edge, key[at : at + len(kid.edge)])
                upper = node.kids[key[at]] = Node(kid.edge[:n])
                kid.edge = kid.edge[n:]
                upper.kids[kid.edge[0]] = kid
                self.size += _NODE
                kid = upper
            node, at = kid, at + len(kid.edge)
        self.strings += not node.rows
        node.owner = owner if not node.rows else smaller(node.owner, owner)
        node.rows += rows

    def full(self) -> bool:
        return self.size > self.budget and self.strings > 1

    def spill(self) -> None:
        """Move the largest subtree below the first branch to a file, as later strings of it."""
        node, path = self.root, b""
        while len(node.kids) == 1 and not node.rows:
            (node,) = node.kids.values()
            path += node.edge
        first, kid = max(node.kids.items(), key=lambda x: (sum(len(k) for k, _, _ in below(x[1], b"")), x[0]))
        file = self.spilled[path + bytes([first])] = tempfile.TemporaryFile()
        for item in below(kid, path):
            pickle.dump(item, file)
        del node.kids[first]
        left = list(below(self.root, b""))
        self.strings, self.size = len(left), sum(len(k) + _NODE for k, _, _ in left)

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Each string once, with its owner and rows, and forget them; spilled subtrees come one at a time."""
        yield from below(self.root, b"")
        self.root, self.size, self.strings = Node(b""), 0, 0
        spilled, self.spilled = self.spilled, {}
        for file in spilled.values():
            file.seek(0)
            alone = PatriciaTrie(self.budget)
            while True:
                try:
                    item = pickle.load(file)
                except EOFError:
                    break
                alone.insert(*item)
                if alone.full():
                    alone.spill()
            file.close()
            yield from alone.items()


def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, int | None, int]]:
    for f in frames:
        for text, owner, rows in zip(f.text, f.owner.array, f.rows, strict=True):
            yield bytes(text), None if pd.isna(owner) else int(owner), int(rows)


def frames_of(items: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    out, size = [], 0
    for item in items:
        out.append(item)
        size += len(item[0])
        if len(out) >= _CHUNK or size > TRIE_BYTES // 4:
            yield pd.DataFrame(out, columns=columns).astype({"owner": "Int64"})
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns).astype({"owner": "Int64"})


def distinct_here(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct texts of a task, each with the smallest id and its rows there."""

    def items() -> Iterator[tuple]:
        trie = PatriciaTrie()
        for item in rows_of(frames):
            trie.insert(*item)
            if trie.full():
                yield from trie.items()
        yield from trie.items()

    return frames_of(items(), ["text", "owner", "rows"])


def owners_here(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The owner of each text of a partition, with all rows of the text."""

    def items() -> Iterator[tuple]:
        trie = PatriciaTrie()
        for item in rows_of(frames):
            trie.insert(*item)
            if trie.full():
                trie.spill()
        for text, owner, rows in trie.items():
            yield hashlib.sha256(text).hexdigest(), owner, rows

    return frames_of(items(), ["sha", "owner", "rows"])


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), C.SPACE, " ")


def owners(docs: DataFrame) -> DataFrame:
    """(sha, owner, rows): one row a distinct text of docs (doc_id, text)."""
    C.check_columns(docs, "doc_id", "text")
    rows = docs.select(normalised().cast("binary").alias("text"), F.col("doc_id").cast("long").alias("owner"), F.lit(1).cast("long").alias("rows"))
    local = rows.mapInPandas(distinct_here, "text binary, owner long, rows long")
    dealt = local.repartition(F.length("text"), F.xxhash64("text"))
    return dealt.mapInPandas(owners_here, "sha string, owner long, rows long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    members = docs.select("doc_id", F.sha2(normalised(), 256).alias("text_sha256"))
    own = owners(docs).withColumnsRenamed({"sha": "text_sha256", "owner": "keep_id", "rows": "group_size"})
    return members.join(own, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8(spark, sf_dir: str) -> DataFrame:
    """Who owns each document's text, over the whole table."""
    return exact_duplicates(C.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text, with all its columns; of rows that repeat it, one."""
    sha, key, place = "longleaf_sha", "longleaf_id", "longleaf_place"
    as_key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    own = owners(docs).select("sha", as_key("owner").alias("owner"))
    keyed = docs.withColumn(sha, F.sha2(normalised(), 256)).withColumn(key, as_key("doc_id"))
    first = keyed.join(own.hint("merge"), (keyed[sha] == own.sha) & (keyed[key] == own.owner), "left_semi")
    # the join has dealt and sorted the rows by these keys already
    return first.withColumn(place, F.row_number().over(Window.partitionBy(sha, key).orderBy(sha))).filter(F.col(place) == 1).drop(sha, key, place)
