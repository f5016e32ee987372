import numpy as np
import pandas as pd

from longleaf.llm import language_id as L

EN = "the cat sat on the mat and the dog ran after the ball while it was raining outside in the street"
DE = "der hund lief durch die strasse und die katze schlief auf dem sofa während es draussen stark regnete"
KIND = "doc_id long, text string, lang string, score string, lang_pred int"


def rows():
    return [(i, " ".join(np.random.default_rng(i).permutation((EN if i % 2 else DE).split())), "en" if i % 2 else "de", "x", 1) for i in range(200)]


def model(spark):
    return L.fit(spark.createDataFrame(rows(), KIND))


def recursion(grams: dict, floor: float):
    """Kneser-Ney by its definition, from counts of the longest n-grams of one language."""
    tables = {L.ORDER: dict(grams)}
    for n in range(L.ORDER - 1, 0, -1):
        tables[n] = {}
        for g in tables[n + 1]:
            tables[n][g[1:]] = tables[n].get(g[1:], 0) + 1
    discount = {}
    for n, t in tables.items():
        ones, twos = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        discount[n] = (ones + 0.5) / (ones + 2 * twos + 1)

    def p(c: str, h: str) -> float:
        n = len(h) + 1
        t = {g: k for g, k in tables[n].items() if g[:-1] == h}
        lower = (lambda: 1 / (len(tables[1]) + 1) if h + c in tables[1] else None) if n == 1 else lambda: p(c, h[1:])
        if not t:
            return lower()
        left = discount[n] * len(t) / sum(t.values())
        if n == 1 and c not in t:
            return np.exp(floor)
        return max(t.get(h + c, 0) - discount[n], 0) / sum(t.values()) + left * lower()

    return p


def test_words_follow_the_definition():
    frame = pd.DataFrame({"lang": "en", "text": [EN]})
    counts = pd.concat(L.count_grams([frame]))
    m = L.build(counts.groupby(["lang", "gram"], as_index=False).n.sum())
    p = recursion(counts.set_index("gram").n.to_dict(), m.floor[0])
    for w in ("the", "thunder", "q", "zebra", "insi", "outside"):
        full = " " * (L.ORDER - 1) + w + " "
        want = sum(np.log(p(full[i], full[i - L.ORDER + 1 : i])) for i in range(L.ORDER - 1, len(full)))
        assert abs(m.words([w])[0, 0] - want) < 1e-9


def test_accuracy_and_edges(spark):
    m = model(spark)
    memo = L.Memo(m)
    got = m.answers([EN, DE, None, "", "123 !!", "x" * 100_000, EN + " 7", "中文字符" * 20], memo)
    assert got.lang_pred[:2].tolist() == ["en", "de"] and got.lang_pred[2:5].tolist() == ["und"] * 3
    assert got.score.between(0, 1).all() and (got.score[2:5] == 0).all() and not got.accepted[2:5].any()
    assert got.lang_pred[6] == "en" and not got.accepted[7] and got.accepted[:2].all()
    one = pd.concat([m.answers([t], L.Memo(m)) for t in (EN, DE, "x" * 100_000)])
    assert np.allclose(one.entropy, got.entropy[[0, 1, 5]])


def test_query_shape_and_stage(spark):
    docs = spark.createDataFrame([*rows(), (900, None, "en", None, None), (None, EN, None, None, None)], KIND)
    kept = L.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 201
    none = L.fit(spark.createDataFrame([], KIND))
    assert none.answers(["abc"], L.Memo(none)).lang_pred.tolist() == ["und"]
    found = L.identify(none)
    assert spark.createDataFrame([], KIND).select(found("text")).count() == 0


def test_limits_come_from_all_labelled_rows(spark):
    """Short clean texts with a token or numbers stay, though the calibration sample has none; an unlearnt language goes."""
    from pyspark.sql import functions as F

    token = "hund schlief token = b64b244acde2e3b0aa8f051af1ec018ebaba3add 7844"
    plain = [(i, " ".join(np.random.default_rng(i).permutation((EN if i % 2 else DE).split())), "en" if i % 2 else "de", "x", 1) for i in range(4000)]
    sampled = {r.doc_id for r in spark.createDataFrame(plain, KIND).filter(L.C.hash01(F.col("doc_id")) < 0.4).collect()}
    odd = [i for i in range(0, 4000, 2) if i not in sampled][:40]
    docs = [r if r[0] not in odd else (r[0], token, "de", "x", 1) for r in plain]
    other = "zxqwv kjyqx wqzzk xvvjq qyxkw jjqxz vwxyk qqzjx kxwvq yzqjv " * 8
    docs += [(9000, other, None, "x", 1), (9001, "中文字符" * 20, None, "x", 1), (9002, "katze regnete " + token[13:], None, "x", 1)]
    frame = spark.createDataFrame(docs, KIND)
    kept = {r.doc_id for r in L.stage(spark, frame, "").collect()}
    assert set(odd) <= kept and 9002 in kept and not {9000, 9001} & kept


def test_limits_of_columns_and_arrays_agree(spark):
    m = model(spark)
    texts = [EN, DE, None, "", "7", "a", "ab", "abc", "the cat", EN[:15], EN[:16], "x" * 300, "qzx jkv wqy"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(L.identify(m)("text").alias("found"))
    got = [r.a for r in frame.select("found", L.accepted(m.langs, m.limit).alias("a")).collect()]
    want = m.answers(texts, L.Memo(m)).accepted.tolist()
    assert [bool(x) for x in got] == want and 0 < sum(want) < len(want)


def test_numerals_are_no_letters(spark):
    m = model(spark)
    got = m.answers(["²", "½ ①", "Ⅷ 12", "ª"], L.Memo(m))
    assert got.lang_pred.tolist()[:3] == ["und"] * 3 and got.score.tolist()[:3] == [0.0] * 3 and got.lang_pred[3] != "und"


def test_long_and_many_tokens_are_scored_but_not_kept(spark, monkeypatch):
    m = model(spark)
    monkeypatch.setattr(L, "_PART", 7)
    monkeypatch.setattr(L, "_MEMO", 50)
    rng, memo = np.random.default_rng(2), L.Memo(m)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 100))) for _ in range(60)) for _ in range(40)]
    got = m.answers([*texts, *texts], memo)
    assert len(memo.table) <= 1024 and all(len(t) <= L._LONG for t in memo.at) and len(memo.at) <= 50 + 7
    monkeypatch.setattr(L, "_PART", 50_000)
    want = pd.concat([m.answers([t], L.Memo(m)) for t in texts])
    assert np.allclose(got.entropy[:40], want.entropy) and np.allclose(got.entropy[:40], got.entropy[40:]) and got.letters[:40].tolist() == want.letters.tolist()


def test_ties_and_repeated_rows(spark):
    same = [(i, EN, "en" if i % 2 else "de", "x", 1) for i in range(80)]
    tied = L.fit(spark.createDataFrame(same, KIND), rows=10**6)
    tied.grams, tied.logp = tied.grams, [np.repeat(x[:, :1], 2, axis=1) for x in tied.logp]
    tied.back, tied.floor = [np.repeat(x[:, :1], 2, axis=1) for x in tied.back], np.repeat(tied.floor[:1], 2)
    got = tied.answers([EN, EN, "cat"], L.Memo(tied))
    assert got.lang_pred.tolist() == ["de"] * 3 and np.allclose(got.score, 0.5)
    out = spark.createDataFrame([(1, EN)] * 3, "i long, text string").select(L.identify(tied)("text").alias("f")).collect()
    assert len({(r.f.lang_pred, r.f.score) for r in out}) == 1 and len(out) == 3


def test_an_ngram_is_looked_up_once(spark, monkeypatch):
    """Words that are new but made of n-grams met before cost no search; with few slots the answers are the same."""
    m, memo, looked = model(spark), None, []
    find = L._find
    monkeypatch.setattr(L, "_find", lambda keys, wanted: looked.append(len(wanted)) or find(keys, wanted))
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abc"), 12)) for _ in range(400)) for _ in range(20)]
    memo = L.Memo(m)
    got = m.answers(texts, memo)
    places, grams = 20 * 400 * 13, 4**4 * (2 * L.ORDER - 1)
    assert sum(looked) <= 20 * grams < places
    monkeypatch.setattr(L, "_GRAM_BYTES", 8 * len(m.langs) * 16)
    few = L.Memo(m)
    again = m.answers(texts, few)
    assert len(few.grams.rows) == 16 and got.equals(again)
    plain = np.array([m.words(t.split()).sum(0) for t in texts])
    assert np.allclose(got.entropy, (-plain / 5200).min(1))
