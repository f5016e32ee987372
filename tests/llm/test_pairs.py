"""Near-duplicate documents and vectors against brute force."""

import math
import random
import re

import numpy as np
import pytest

from longleaf.llm import common as C
from longleaf.llm import components as K
from longleaf.llm import embedding_dedup as E
from longleaf.llm import minhash as M


def classes(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def plain_shingles(text, words):
    """The set by its definition, as tuples of words."""
    found = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    found = [w for w in re.split(rb"[\x20\x09-\x0D]+", found) if w]
    return {tuple(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))} if found else set()


@pytest.mark.parametrize("tile, few", [(256, 200_000), (4, 200_000), (4, 0)])
def test_documents(spark, monkeypatch, tile, few):
    """Also with small tiles, which all kinds of visits need, and without any broadcast."""
    monkeypatch.setattr(M, "TILE", tile)
    monkeypatch.setattr(M, "BROADCAST_ROWS", few)
    monkeypatch.setattr(K, "BROADCAST_EDGES", few)
    rnd, rows = random.Random(3), []
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(60)] for _ in range(6)]
    for i in range(120):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = f"w{rnd.randint(0, 400)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one"), (204, "ONE"), (205, "x " * 50_000), (206, "x"), (207, "É a"), (208, "é a"), (None, "one")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string")
    for words in (2, 5) if tile > 4 else (2,):
        got = {r.doc_id: r for r in M.near_duplicates(docs, words).collect()}
        sets = {i: plain_shingles(t, words) for i, t in rows if i is not None}
        want = classes(sorted(sets), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and len(sets[i] | sets[j]) > 0)  # noqa: B023
        assert {i: r.component_id for i, r in got.items() if i is not None} == want
        assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())
        assert got[None].component_id is None and got[None].kept
    if tile == 4:
        return
    kept = M.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == sum(i == c for i, c in want.items()) + 1


def test_no_documents(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intersections_in_ranges(monkeypatch):
    monkeypatch.setattr(M, "RANGE", 50)
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool, 40)) for _ in range(7)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (M.intersections(sets) == want)[~np.eye(7, dtype=bool)].all()


@pytest.mark.parametrize("tile, few", [(2048, 200_000), (8, 0)])
def test_vectors(spark, monkeypatch, tile, few):
    """Also with small tiles and without any broadcast."""
    monkeypatch.setattr(E, "TILE", tile)
    monkeypatch.setattr(E, "BROADCAST_LISTS", few)
    monkeypatch.setattr(K, "BROADCAST_EDGES", few)
    rng = np.random.default_rng(1)
    rows, centres = [], rng.normal(size=(5, 16))
    for i in range(300):
        rows.append((i, (centres[i % 5] + 0.11 * rng.normal(size=16)).tolist(), int(i % 2)))
    rows += [(i, rows[0][1], 0) for i in range(300, 340)]
    bad = [None, [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, []]
    rows += [(400 + k, v, 0) for k, v in enumerate(bad)] + [(450, rows[0][1], None), (451, [1.0, 2.0], 0), (452, [2.0, 4.0], 0)]
    v = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, times int")
    got = {r.vec_id: r for r in E.near_duplicates(v).collect()}
    x = {i: np.array(e, np.float32).astype(float) for i, e, lab in rows if lab is not None and e and None not in e and np.isfinite(e).all() and any(e)}
    label = {i: lab for i, _, lab in rows}
    cos = lambda a, b: label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.98
    want = classes(sorted(x), cos)
    assert len(got) == len(rows)
    for i in got:
        assert got[i].n_links == (sum(cos(i, j) for j in x if j != i) if i in x else 0)
        assert got[i].component_id == want.get(i, i) and got[i].kept == (want.get(i, i) == i)
    if tile == 8:
        assert E.near_duplicates(v.limit(0)).count() == 0


@pytest.mark.parametrize("coarse", [4096, 100])
def test_recall_of_many_vectors(spark, monkeypatch, tmp_path, coarse):
    """60,000 vectors of 40 labels, one of which holds a third; with the pivots searched one by one and by two levels."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(E, "COARSE", coarse)
    rng, n, dim = np.random.default_rng(4), 60_000, 32
    x = rng.normal(size=(n, dim)).astype(np.float32)
    label = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    near = rng.choice(n, 20_000, replace=False)
    of = rng.choice(n, 20_000)
    spread = rng.choice([0.05, 0.12, 0.19], (20_000, 1))
    x[near] = x[of] / np.linalg.norm(x[of], axis=1, keepdims=True) * dim**0.5 + spread * rng.normal(size=(20_000, dim)).astype(np.float32)
    label[near] = label[of]
    units, links = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 0
    degree = np.zeros(n, np.int64)
    for k in range(40):
        own = np.flatnonzero(label == k)
        for i in range(0, len(own), 2000):
            part = own[i : i + 2000]
            fits = units[part] @ units[own].T >= 0.98
            degree[part] = fits.sum(1) - 1
    import pandas as pd

    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "label": label.astype(np.int32)}).to_parquet(tmp_path / "v.parquet")
    got = E.near_duplicates(spark.read.parquet(str(tmp_path / "v.parquet"))).agg(F.sum("n_links").alias("links"), F.count("*").alias("rows")).first()
    links = int(degree.sum())
    assert got.rows == n and links > 15_000 and 0.99 * links <= got.links <= links, (got.links, links)


@pytest.mark.parametrize("few", [200_000, 0])
def test_components_and_later_links(spark, monkeypatch, few):
    monkeypatch.setattr(K, "BROADCAST_EDGES", few)
    rnd, scratch = random.Random(few), C.Scratch(spark)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(7, 7), (None, 3)]
    later = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(15)] + [(5, 5)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    for more in (later, []):
        have = {frozenset(e) for e in edges + more if None not in e}
        want = classes(sorted(set().union(*have)), lambda i, j: frozenset((i, j)) in have)  # noqa: B023
        found = K.merged(K.components(frame(edges), scratch), frame(more), scratch).collect()
        assert {r.node: r.component for r in found} == {i: c for i, c in want.items() if i != c} and len({r.node for r in found}) == len(found)
    assert K.components(frame([]), scratch).count() == 0


SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    frame = df.select(*df.columns)
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, monkeypatch):
    """One node with four fifths of the edges, one document with four fifths of the pairs: the final plans split their partitions."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(K, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    before = {k: spark.conf.get(k) for k in SKEW}
    try:
        for k, v in SKEW.items():
            spark.conf.set(k, v)
        scratch = C.Scratch(spark)
        hot = F.when(F.col("id") % 5 > 0, F.lit(-1)).otherwise(F.col("id"))
        edges = scratch.keep(spark.range(0, 60_000, 1, 8).select((F.col("id") + 100).alias("a"), hot.alias("b")))
        assert "skew=true" in final_plan(K._large_star(edges, scratch, False))
        turned = scratch.keep(edges.select(F.col("b").alias("a"), (-F.col("a")).alias("b")))
        assert "skew=true" in final_plan(K._small_star(turned, scratch, False))
        pairs = scratch.keep(turned.select("a", "b", F.lit(b"x").alias("a_key"), F.lit(b"y").alias("b_key")))
        assert "skew=true" in final_plan(M.tiled(pairs, scratch))
        met = scratch.keep(edges.select(F.col("b").alias("main"), F.col("a").alias("rep"), F.lit(b"k").alias("key"), (F.col("a") % 50 == 0).alias("guest")))
        assert "skew=true" in final_plan(M.first_visits(met, scratch))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
