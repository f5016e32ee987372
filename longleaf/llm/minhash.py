"""Near-duplicate documents by MinHash, banding and verification (operator 9).

A document is the set of its distinct word shingles, each a 64-bit hash. Texts with the same
set become one representative before anything else. Its signature has the minima of many
universal hashes; their bands are keys of buckets. Representatives of a bucket are compared in
two rounds, so that a group of near copies isn't expanded into its pairs:

1. each representative goes to the smallest representative that it shares a bucket with. These
   groups, dealt in tiles of bounded size, meet with their full sets, which confirm or refuse
   each pair of a tile. Confirmed links give first components.
2. in buckets that still hold several components, signatures tell, tile against tile, which representatives may have a
   link across components. Those of smaller components are guests of the largest. Each guest meets one tile of those
   at home with full sets, which brings most of them in; the few that stay out then meet all tiles.

Every pair that shares a bucket is thus confirmed, refused by signature or set, or already in one component.
Components come from alternating large-star and small-star. What is counted of hot keys is kept before it meets
their rows: small tables are broadcast, and with others the join is one whose skewed partitions Spark splits.

Defined cases: without words or text a set is empty and linked with nothing; with fewer words than
a shingle has, the whole sequence is the one shingle; rows with a null id have no component; an id
that repeats is one node, with the smallest id of its texts' components each; an empty table gives an empty
result; texts may be of any length; other columns, `n` and `key` among them, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components, merged

BANDS, ROWS = 32, 5
#: Standard deviations of a signature's estimate by which it may fall short of the threshold.
SLACK = 4.5
#: Members of a tile.
TILE = 256
#: Hashes of a tile that are compared at once.
RANGE = 400_000
#: Rows of (document, group) up to which they are broadcast to the texts; beyond, texts are shuffled to them.
BROADCAST_ROWS = 200_000
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    each = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
    n = min(words, len(each))
    total = np.zeros(len(each) - n + 1, np.uint64)
    for k in range(n):
        total = C.mix64(total * np.uint64(3) + each[k : len(each) - n + 1 + k])
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 256):
        np.minimum(least, (_A[:, None] * found[None, i : i + 256] + _B[:, None]).min(1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = C.mix64(keys * np.uint64(3) + column)
    return keys.view(np.int64)


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, key (of the set), bands, signature (a byte a minimum); of an empty set, nulls."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text in f.text:
                found = shingles(text, words)
                if len(found):
                    least = signature(found)
                    rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), bands(least), C.mix64(least).astype(np.uint8).tobytes()))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n", "key", "bands", "signature"])
            out.insert(0, "doc_id", f.doc_id.array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(each, "doc_id long, n long, key binary, bands array<long>, signature binary")


def similar(inter: np.ndarray, union: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * union


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of these links, enough to join what they join."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[p] = q
            out.append((x, y))
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sorted sets (not of a set with itself), by products of blocks of the incidence matrix.

    Ranges of hashes are taken one after another, so that memory is bounded for sets of any size.
    """
    total = np.zeros((len(sets), len(sets)))
    ranges = 1 + sum(map(len, sets)) // RANGE
    at = np.zeros(len(sets), np.int64)
    for k in range(ranges):
        upto = np.array([len(s) if k + 1 == ranges else np.searchsorted(s, np.uint64((k + 1) * ((1 << 64) // ranges))) for s in sets])
        total += _shared([s[i:j] for s, i, j in zip(sets, at, upto, strict=True)])
        at = upto
    return total


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    total = np.zeros((len(sets), len(sets)))
    common = np.flatnonzero(times > 1)
    column = np.full(len(values), -1)
    column[common] = np.arange(len(common))
    at = column[at]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for i in range(0, len(common), 4096):
        lo, hi = np.searchsorted(at, [i, i + 4096])
        block = np.zeros((len(sets), min(4096, len(common) - i)), np.float32)
        block[owner[lo:hi], at[lo:hi] - i] = 1
        total += block @ block.T
    return total


def tiled(pairs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Groups (a, tile, doc, key) in which each a of kept pairs (a, b, a_key, b_key) meets its bs, TILE at a time."""
    heads = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.first("a_key").alias("key")))
    hot = scratch.keep(heads.filter("tiles > 1").select(F.col("a").alias("hub"), "tiles"))
    dealt = pairs.join(C.sized(hot, BROADCAST_ROWS), F.col("a") == F.col("hub"), "left").withColumn("tile", F.pmod(F.xxhash64("b"), F.coalesce("tiles", F.lit(1))))
    own = heads.select("a", F.explode(upto("tiles")).alias("tile"), F.col("a").alias("doc"), "key")
    return dealt.select("a", "tile", F.col("b").alias("doc"), F.col("b_key").alias("key")).union(own)


def links(docs: DataFrame, groups: DataFrame, words: int, percent: int, scratch: C.Scratch) -> DataFrame:
    """Links (a, b) confirmed on full sets, all pairs of a group (a, tile, doc, key) being confirmed or refused.

    Of a group's links, as many come out as join what all of them join.
    """
    groups = scratch.keep(groups)
    rows = docs.select("doc_id", "text").join(C.sized(groups, BROADCAST_ROWS), F.col("doc_id") == F.col("doc")).select("a", "tile", "doc", "key", "text")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            last, found, out = None, None, []
            for text, key in zip(f.text, f.key, strict=True):
                if last is None or text is not last:
                    last, found = text, shingles(text, words).tobytes()
                out.append(found if xxhash.xxh3_128_digest(found) == bytes(key) else None)
            yield f[["a", "tile", "doc"]].assign(found=out)[lambda x: x.found.notna()]

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, starts in C.whole_groups(frames, ["a", "tile"]):
            ids, sets, out = f.doc.to_numpy(np.int64), f.found.to_numpy(object), []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                own = ids[lo:hi]
                if len(own) > 2 or own[0] != own[-1]:
                    _, at = np.unique(own, return_index=True)
                    found = [np.frombuffer(sets[lo + k], np.uint64) for k in at]
                    sizes = np.array([len(x) for x in found])
                    inter = intersections(found)
                    x, y = np.nonzero(np.triu(similar(inter, sizes[:, None] + sizes[None] - inter, percent), 1))
                    out += [(own[at[p]], own[at[q]]) for p, q in forest(len(at), x, y)]
            yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    found = rows.mapInPandas(sets, "a long, tile long, doc long, found binary")
    out = scratch.keep(found.repartition("a", "tile").sortWithinPartitions("a", "tile").mapInPandas(confirm, "a long, b long"))
    scratch.drop(groups)
    return out


def meetings(members: DataFrame, percent: int, scratch: C.Scratch) -> DataFrame:
    """(main, rep, key, guest): representatives that may have a link across components, by their signatures.

    members, a kept table, has (bucket, rep, key, n, signature, component). main is the largest component of a bucket,
    in which a rep is at home or a guest. The largest component is never compared with itself: its tiles meet
    those of the guests, which also meet each other.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("rows"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("rows", "component")).alias("top"), F.sum("rows").alias("all"), F.count("*").alias("kinds")).filter("kinds > 1")
    sizes = sizes.select(F.col("bucket").alias("at"), F.col("top.component").alias("main"), F.ceil(F.col("top.rows") / TILE).alias("main_tiles"), F.ceil((F.col("all") - F.col("top.rows")) / TILE).alias("rest_tiles"))
    rows = members.join(C.sized(scratch.keep(sizes), BROADCAST_ROWS), F.col("bucket") == F.col("at"))
    number = F.xxhash64(F.lit(3), "rep")
    m, r = F.pmod(number, "main_tiles"), F.pmod(number, "rest_tiles")
    group = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    mains = F.transform(upto("rest_tiles"), lambda i: group(0, i, m, F.lit(0)))
    rest = F.concat(F.transform(upto("main_tiles"), lambda j: group(0, r, j, F.lit(1))), F.transform(upto("rest_tiles"), lambda v: group(1, F.least(r, v), F.greatest(r, v), F.when(r <= v, 0).otherwise(1))))
    keys = ["bucket", "kind", "i", "j"]
    dealt = rows.withColumn("g", F.explode(F.when(F.col("component") == F.col("main"), mains).otherwise(rest))).select("bucket", "g.*", "rep", "key", "n", "signature", "component", "main")
    need = percent / 100
    least = (need - SLACK * (need * (1 - need) / (BANDS * ROWS)) ** 0.5) * BANDS * ROWS

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, starts in C.whole_groups(frames, keys):
            signs = np.frombuffer(b"".join(f.signature), np.uint8).reshape(len(f), -1)
            n, part = f.n.to_numpy(np.int64), f.component.to_numpy(np.int64)
            side, same = f.side.to_numpy(), (f.kind.to_numpy() == 1) & (f.i.to_numpy() == f.j.to_numpy())
            fits = np.zeros(len(f), bool)
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                rows = np.arange(lo, hi)
                x, y = (rows, rows) if same[lo] else (rows[side[lo:hi] == 0], rows[side[lo:hi] == 1])
                for k in x:
                    near = y[(part[y] != part[k]) & (100 * np.minimum(n[y], n[k]) >= percent * np.maximum(n[y], n[k]))]
                    near = near[(signs[near] == signs[k]).sum(1) >= least]
                    fits[near] = True
                    fits[k] |= len(near) > 0
            out = f.loc[fits, ["main", "rep", "key"]]
            yield out.assign(guest=(part != f.main.to_numpy(np.int64))[fits]).drop_duplicates(["main", "rep"])

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(compare, "main long, rep long, key binary, guest boolean").dropDuplicates(["main", "rep"])


def upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def first_visits(met: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Groups (a, tile, doc, key) of met (main, rep, key, guest) in which each guest meets one tile of those at home.

    Where guests and those at home are a tile each, that is all there is to compare.
    """
    n = met.groupBy("main").agg(F.ceil(F.count_if(~F.col("guest")) / TILE).alias("homes"), F.ceil(F.count_if("guest") / TILE).alias("guests")).withColumnRenamed("main", "at")
    rows = met.join(C.sized(scratch.keep(n.filter("guests > 0")), BROADCAST_ROWS), F.col("main") == F.col("at"))
    number = F.xxhash64(F.lit(5), "rep")
    home = F.pmod(number, F.greatest("homes", F.lit(1)))
    tiles = F.when(F.col("guest"), F.array(F.pmod(number, "guests"))).otherwise(F.filter(upto("guests"), lambda g: F.pmod(g, F.greatest("homes", F.lit(1))) == home))
    return rows.select(F.col("main").alias("a"), F.explode(tiles).alias("tile"), F.col("rep").alias("doc"), "key")


def all_visits(met: DataFrame, found: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Groups in which the guests that are still in another component than main meet everyone else there, tile by tile."""
    now = found.select(F.col("node"), F.col("component").alias("now"))
    rows = met.join(now, met.rep == now.node, "left").withColumn("own", F.coalesce("now", "rep")).drop("node", "now")
    rows = rows.join(now, rows.main == now.node, "left").withColumn("host", F.coalesce("now", "main")).drop("node", "now")
    rows = scratch.keep(rows.withColumn("left", F.col("guest") & (F.col("own") != F.col("host"))))
    n = rows.groupBy("main").agg(F.count("*").alias("all"), F.count_if("guest").alias("guests"), F.count_if("left").alias("still"))
    # up to one tile of guests and one of others, the first visits have compared all
    n = n.filter((F.col("still") > 0) & ((F.col("guests") > TILE) | (F.col("all") - F.col("guests") > TILE)))
    n = n.select(F.col("main").alias("at"), F.ceil(F.col("all") / TILE).alias("tiles"), F.ceil(F.col("still") / TILE).alias("rounds"))
    rows = rows.join(C.sized(scratch.keep(n), BROADCAST_ROWS), F.col("main") == F.col("at"))
    number = F.xxhash64(F.lit(7), "rep")
    tile, turn = F.pmod(number, "tiles"), F.pmod(number, "rounds")
    pair = lambda r, t: r * F.col("tiles") + t
    groups = F.transform(upto("rounds"), lambda r: pair(r, tile))
    groups = F.when(F.col("left"), F.array_union(groups, F.transform(upto("tiles"), lambda t: pair(turn, t)))).otherwise(groups)
    return rows.select(F.col("main").alias("a"), F.explode(groups).alias("tile"), F.col("rep").alias("doc"), "key")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text)."""
    C.check_columns(docs, "doc_id", "text")
    scratch, passing = C.Scratch(docs.sparkSession), C.Scratch(docs.sparkSession)
    rows = scratch.keep(described(docs, words))
    some = rows.filter("n > 0 and doc_id is not null")
    reps = scratch.keep(some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    each = reps.select(F.explode("bands").alias("bucket"), "rep")
    shared = each.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("rep").alias("head")).filter("rows > 1").select(F.col("bucket").alias("at"), "head")
    members = passing.keep(each.join(C.sized(passing.keep(shared), BROADCAST_ROWS), F.col("bucket") == F.col("at")).select("bucket", "rep", "head"))
    heads = members.groupBy("rep").agg(F.min("head").alias("head")).filter("rep <> head")
    keys = reps.select("rep", "key")
    named = heads.join(keys, "rep").select(F.col("head").alias("a"), F.col("rep").alias("b"), F.col("key").alias("b_key"))
    named = passing.keep(named.join(keys.select(F.col("rep").alias("a"), F.col("key").alias("a_key")), "a"))
    first = links(docs, tiled(named, passing), words, percent, passing)
    found = components(first, scratch)
    wide = members.select("bucket", "rep").join(reps.select("rep", "key", "n", "signature"), "rep")
    wide = wide.join(found, wide.rep == found.node, "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    met = passing.keep(meetings(passing.keep(wide), percent, passing))
    if not met.isEmpty():
        found = merged(found, links(docs, first_visits(met, passing), words, percent, passing), scratch)
        found = merged(found, links(docs, all_visits(met, found, passing), words, percent, passing), scratch)
    passing.drop(*[t for t, _ in passing.kept])
    named = reps.select("key", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("its"), F.coalesce("component", "rep").alias("found"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, F.col("key") == F.col("its"), "left")
    component = F.coalesce("found", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by sets of two-word shingles."""
    return near_duplicates(C.table(spark, sf_dir, "documents"), words=2)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with all its columns; of rows that repeat it, one."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("longleaf_id")).distinct()
    key, place = "longleaf_key", "longleaf_place"
    # rows without an id stay; a row that repeats an id that stays is dropped
    alone = docs.filter("doc_id is null")
    first = docs.join(kept.hint("merge"), F.col("doc_id").cast("long") == F.col("longleaf_id"), "left_semi").withColumn(key, F.col("doc_id").cast("long"))
    first = first.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(place) == 1).drop(key, place)
    return first.unionByName(alone)
