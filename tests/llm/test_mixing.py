import random

import pytest

from longleaf.llm import mixing as M

KIND = "doc_id long, text string, source string, extra int, its_source string"


def by_rounds(sizes: dict, weights=M.WEIGHTS) -> dict:
    """Targets by dealing what is left over again until no source is above its room."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, full = dict.fromkeys(sizes, 0.0), M.SHARE * sum(sizes.values()), set()
    while left > 1e-9 and len(full) < len(sizes):
        total = sum(weight[s] for s in sizes if s not in full)
        for s in sizes:
            if s not in full:
                out[s] += left * weight[s] / total
        left = 0.0
        for s in sizes:
            if s not in full and out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2 * sizes[s]
                full.add(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    rnd = random.Random(seed)
    names = [None, "b", "a", "ü", "Z"][: 1 + seed + (seed > 0)]
    rows = [(i, None if i % 11 == 0 else " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(names + names[:1] * 3), 1, "x") for i in range(400)]
    out = M.mix(spark.createDataFrame(rows, KIND)).collect()
    sizes: dict = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, got = by_rounds(sizes), {}
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        got[r.source] = got.get(r.source, 0) + r.taken
    assert len(out) == len(rows)
    assert all(abs(got[s] - want[s]) <= 15 for s in sizes)


def test_stage_takes_effect_and_keeps_columns(spark):
    rows = [(i, "a b c", f"s{i % 3}", i, None) for i in range(60)] + [(None, None, None, 1, "x")] * 2
    docs = spark.createDataFrame(rows, KIND)
    counts = {r.doc_id: r.copies for r in M.mix(docs).collect()}
    out = M.stage(spark, docs, "")
    assert out.columns == docs.columns
    seen = [r.doc_id for r in out.collect()]
    assert all(seen.count(i) == n for i, n in counts.items() if i is not None)


def test_empty_and_long(spark):
    assert M.mix(spark.createDataFrame([], KIND)).count() == 0
    (r,) = M.mix(spark.createDataFrame([(1, "w " * 300_000, "s", 0, "")], KIND)).collect()
    assert r.size == 300_000 and r.target == 450_000 and r.taken in (300_000, 600_000)
