import random

from longleaf.llm import exact_dedup as E


def brute(rows):
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(i)
    return [(i, min((x for x in groups[n] if x is not None), default=None), len(groups[n])) for (i, _), n in zip(rows, norm, strict=True)]


def test_against_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", " ", "a  b", "a\tb", "a b", "a b", "a b ", "abc", "ab", "é", "x" * 200_000, "x" * 200_000 + "y"]
    rows = [(None if rnd.random() < 0.1 else rnd.randint(0, 50), rnd.choice(texts)) for _ in range(300)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, owner int, sha string")
    out = E.exact_duplicates(docs).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    kept = E.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert kept.count() == len({k for k, _ in ((n, 0) for n in {__import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})})


def test_empty(spark):
    assert E.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_spills_whole(tmp_path):
    rnd = random.Random(2)
    keys = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    trie, want = E.PatriciaTrie(budget=3000), {}
    for i, k in enumerate(keys):
        owner = None if i % 17 == 0 else i
        trie.insert(k, owner)
        if trie.full():
            trie.spill()
        old = want.get(k, (None, 0))
        want[k] = (E.smaller(old[0], owner), old[1] + 1)
    got = list(trie.items())
    assert len(got) == len(want) and {k: (o, n) for k, o, n in got} == want
