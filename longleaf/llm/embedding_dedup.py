"""Near-duplicate vectors by a pivot-permutation index (operator 6).

Each vector is described by its KEEP nearest pivots, in order. Two vectors of a label are candidates when they share
at least SHARED of their pivots. Pivots are numbered from the rarest, and a vector stands in the inverted lists of its
first KEEP - SHARED + 1 alone: two vectors that share SHARED pivots share one of these. The list of the first
shared one handles the pair, so that it counts once. Long lists are cut into tiles, and each pair of tiles is a task
of bounded size. Tiles meet twice: first with numbers and pivots alone, where shared pivots are counted, and then those
vectors that have a candidate there come with their components, and cosines in double precision verify.
What comes back are counts and a forest of links, not pairs. Equal vectors of a label are one representative
that counts as often as it occurs.

Pivots are a bounded sample of the vectors, about the square root of their number, as far as PIVOT_BYTES goes; beyond COARSE
of them, a vector looks for its nearest pivots among those near its nearest coarse ones. Every vector is indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, vectors without label,
and rows without id link with nothing; vectors of different length don't link; rows that repeat
link with each other; a component is named by its smallest id; an empty table gives an empty result; vectors may have
any length; other columns, `times` and `kept` among them, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .minhash import forest

KEEP, SHARED = 8, 3
#: Pivots of a length of vector: at least so many, and at most as many as these bytes hold in double precision.
LEAST_PIVOTS, PIVOT_BYTES = 64, 64 << 20
#: Pivots that a vector is compared with one by one; of more, those of its NEAR nearest coarse ones.
COARSE, NEAR = 4096, 16
TILE = 2048
#: Long lists up to which the table of their tiles is broadcast.
BROADCAST_LISTS = 200_000


def units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # against overflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable():
    """Whether a row's vector can link: SQL over label, vec_id and embedding."""
    return F.expr("label is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")


def keyed(vectors: DataFrame) -> DataFrame:
    """The rows with usable, h and g; (h, g) is the same for equal vectors of a label alone."""
    rows = vectors.select("vec_id", "label", "embedding").withColumn("usable", F.coalesce(usable(), F.lit(False)))
    own = lambda seed: F.when(F.col("usable"), F.xxhash64(F.lit(seed), F.lit(True), "label", "embedding")).otherwise(F.xxhash64(F.lit(seed), F.lit(False), "vec_id"))
    return rows.withColumns({"h": own(1), "g": own(2)})


def pivot_count(n: int, dim: int) -> int:
    wanted = max(LEAST_PIVOTS, 2 ** np.ceil(np.log2(max(n, 1) ** 0.5)))
    return int(max(KEEP, min(wanted, PIVOT_BYTES // (8 * dim))))


def choose_pivots(reps: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by length of vector: about pivot_count of each, the lowest hashes below a threshold."""
    lengths = {r.dim: r.n for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for d, k in lengths.items() for x in (d, min(1.0, pivot_count(k, d) / k))])[F.col("dim")] if lengths else None
    chosen = reps.filter(C.hash01(F.struct("h", "g")) < share).select("dim", "rep", "embedding").toPandas().sort_values("rep") if lengths else pd.DataFrame({"dim": [], "embedding": []})
    return {int(d): units(f.embedding) for d, f in chosen.groupby("dim")}


class Pivots:
    """Finds the nearest pivots of vectors of one length, in order."""

    def __init__(self, at: np.ndarray):
        self.at, self.members = at, None
        if len(at) > COARSE:  # a two-level search: each pivot lies with its nearest coarse one
            self.coarse = at[:: len(at) // int(len(at) ** 0.5)]
            own = np.concatenate([(at[i : i + 4096] @ self.coarse.T).argmax(1) for i in range(0, len(at), 4096)])
            self.members = [np.flatnonzero(own == k) for k in range(len(self.coarse))]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        keep = min(KEEP, len(self.at))
        if self.members is None:
            near = x @ self.at.T
            top = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
            return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        out = np.empty((len(x), keep), np.int64)
        order = np.argpartition(-(x @ self.coarse.T), min(NEAR, len(self.coarse)) - 1, axis=1)[:, :NEAR]
        for i, groups in enumerate(order):
            found = np.concatenate([self.members[k] for k in groups])
            found = found if len(found) >= keep else np.arange(len(self.at))
            out[i] = found[np.argsort(-(self.at[found] @ x[i]), kind="stable")[:keep]]
        return out


def described(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(label, dim, rep, pivots): the ordered nearest pivots of each; a length without pivots has one list for all."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finders = {d: Pivots(at) for d, at in pivots.items()}
        for f in frames:
            for dim, part in f.groupby("dim"):
                found = finders.get(int(dim))
                order = np.zeros((len(part), 1), np.int64) if found is None else found.nearest(units(part.embedding))
                yield part[["label", "dim", "rep"]].assign(pivots=list(order.astype(np.int32)))

    return reps.select("label", "dim", "rep", "embedding").mapInPandas(each, "label string, dim int, rep long, pivots array<int>")


def listed(index: DataFrame) -> DataFrame:
    """(label, dim, list, rep, ranks): index with its pivots numbered from the rarest, ascending, and a row for each list."""
    counts = index.select("dim", F.explode("pivots").alias("pivot")).groupBy("dim", "pivot").agg(F.count("*").alias("n")).toPandas()
    rank: dict[int, np.ndarray] = {}
    for dim, f in counts.sort_values(["n", "pivot"]).groupby("dim"):
        rank[int(dim)] = np.zeros(int(f["pivot"].max()) + 1, np.int32)
        rank[int(dim)][f["pivot"].to_numpy()] = np.arange(len(f))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ranks = [np.sort(rank[d][p]) for d, p in zip(f.dim, f["pivots"], strict=True)]
            lists = [r[: max(1, len(r) - SHARED + 1)] for r in ranks]
            at = np.repeat(np.arange(len(f)), [len(x) for x in lists])
            yield f[["label", "dim", "rep"]].iloc[at].assign(list=np.concatenate(lists), ranks=[ranks[i] for i in at])

    return index.mapInPandas(each, "label string, dim int, rep long, list int, ranks array<int>")


def candidates(number: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of two tiles of a list share enough pivots, this list's being the first that both stand in."""
    names, at = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    hot = np.zeros((len(x) + len(y), len(names)), np.float32)
    hot[np.repeat(np.arange(len(hot)), x.shape[1]), at.ravel()] = 1
    a, b = hot[: len(x)], hot[len(x) :]
    fits = a @ b.T >= min(SHARED, x.shape[1])
    # ranks are sorted, so a shared one below this list's is one that both stand in
    before = np.searchsorted(names, number)
    return fits & (a[:, :before] @ b[:, :before].T == 0)


KEYS = ["label", "dim", "list", "i", "j"]


def sides(f: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Of each pair of tiles, the rows of both and whether they are one."""
    side, i, j = f.side.to_numpy(), f.i.to_numpy(), f.j.to_numpy()
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        rows = np.arange(lo, hi)
        own = bool(i[lo] == j[lo])
        x, y = (rows, rows) if own else (rows[side[lo:hi] == 0], rows[side[lo:hi] == 1])
        if len(x) and len(y) and hi - lo > 1:
            yield x, y, own


def meeting(lists: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(label, dim, list, i, j, side, rep, ranks): the vectors that have a candidate in a pair of tiles, told by pivots alone."""
    tiles = lists.groupBy("label", "dim", "list").agg(F.ceil(F.count("*") / TILE).alias("tiles")).filter("tiles > 1").select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("list").alias("p"), "tiles")
    dealt = lists.join(C.sized(scratch.keep(tiles), BROADCAST_LISTS), F.expr("label = l and dim = d and list = p"), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tile = F.pmod(F.xxhash64("rep"), "tiles")
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda v: F.struct(F.least(tile, v).alias("i"), F.greatest(tile, v).alias("j"), F.when(tile <= v, 0).otherwise(1).alias("side")))
    dealt = dealt.withColumn("t", F.explode(others)).select("label", "dim", "list", "t.*", "rep", "ranks")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, starts in C.whole_groups(frames, KEYS):
            fits, numbers = np.zeros(len(f), bool), f["list"].to_numpy()
            for x, y, own in sides(f, starts):
                found = candidates(numbers[x[0]], np.stack(f["ranks"].iloc[x].to_numpy()), np.stack(f["ranks"].iloc[y].to_numpy()))
                if own:
                    np.fill_diagonal(found, False)
                fits[x] |= found.any(1)
                fits[y] |= found.any(0)
            yield f[fits]

    kinds = "label string, dim int, list int, i long, j long, side int, rep long, ranks array<int>"
    return scratch.keep(dealt.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(each, kinds))


def found_links(index: DataFrame, reps: DataFrame, least: float, scratch: C.Scratch) -> DataFrame:
    """(a, b, times): a row with b is a link of the forest; one without says how many links a has in a tile."""
    met = meeting(listed(index), scratch)
    own = reps.select(F.col("rep").alias("its"), "times", "embedding")
    rows = met.join(own.hint("merge"), F.col("rep") == F.col("its")).drop("its")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, starts in C.whole_groups(frames, KEYS):
            ids, times, numbers = f.rep.to_numpy(np.int64), f.times.to_numpy(np.int64), f["list"].to_numpy()
            out: list[tuple] = []
            for x, y, own in sides(f, starts):
                ranks = [np.stack(f["ranks"].iloc[r].to_numpy()) for r in (x, y)]
                unit = [units(f.embedding.iloc[r]) for r in ((x,) if own else (x, y))]
                fits = candidates(numbers[x[0]], *ranks) & (unit[0] @ unit[-1].T >= least)
                p, q = np.nonzero(np.triu(fits, 1) if own else fits)
                p, q, lo = x[p], y[q], min(x[0], y[0])
                n = max(x[-1], y[-1]) + 1 - lo
                counts = np.bincount(p - lo, times[q], n) + np.bincount(q - lo, times[p], n)
                out += [(ids[lo + k], None, int(counts[k])) for k in np.flatnonzero(counts)]
                out += [(ids[lo + x], int(ids[lo + y]), 0) for x, y in forest(n, p - lo, q - lo)]
            yield pd.DataFrame(out, columns=["a", "b", "times"]).astype({"a": "int64", "b": "Int64", "times": "int64"})

    return scratch.keep(rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(each, "a long, b long, times long"))


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors (vec_id, label, embedding)."""
    C.check_columns(vectors, "vec_id", "label", "embedding")
    scratch = C.Scratch(vectors.sparkSession)
    rows = keyed(vectors)
    reps = rows.filter("usable").groupBy("h", "g").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("label").cast("string").alias("label"), F.first("embedding").cast("array<double>").alias("embedding"))
    reps = scratch.keep(reps.withColumn("dim", F.size("embedding")))
    index = scratch.keep(described(reps, choose_pivots(reps)))
    found = found_links(index, reps, least, scratch)
    joined = components(found.filter("b is not null").select("a", "b"), scratch).withColumnsRenamed({"node": "n1"})
    counts = found.filter("b is null").groupBy("a").agg(F.sum("times").alias("links")).withColumnsRenamed({"a": "n2"})
    own = reps.select("h", "g", "rep", "times").join(joined, F.col("rep") == F.col("n1"), "left").join(counts, F.col("rep") == F.col("n2"), "left")
    own = own.select(F.col("h").alias("h2"), F.col("g").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "rep").alias("found"))
    out = rows.select("vec_id", "h", "g").join(own, F.expr("h = h2 and g = g2"), "left")
    component = F.coalesce("found", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors, within labels, at cosine 0.98."""
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
