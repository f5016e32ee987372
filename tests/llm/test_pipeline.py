"""All stages of the corpus pipeline over small tables, against what each should do."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from longleaf.llm import language_id, mixing  # noqa: E402
from longleaf.llm import sentencepiece_codec as S  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long, ids string, row int"
EN = "the cat sat on the mat and the dog ran after the ball while it was raining outside in the street".split()
DE = "der hund lief durch die strasse und die katze schlief auf dem sofa während es draussen stark regnete".split()


def rows():
    rnd, out = random.Random(11), []
    for i in range(120):
        words = [rnd.choice(EN if i % 2 else DE) for _ in range(60)]
        out.append((i, " ".join(words), "en" if i % 2 else "de", f"s{i % 3}"))
    near = out[3][1].split()
    near[30] = "cat"
    out += [(500, out[1][1].replace(" ", "  ", 4), "en", "s1"), (501, " ".join(near), "en", "s1"), (502, "中文字符" * 20, None, "s1"), (503, None, "en", "s2"), (504, "", None, None)]
    out += [out[5], out[5], (None, out[7][1], "en", "s0"), (None, " ".join(rnd.choice(EN) for _ in range(50)), None, None)]
    return [(*r, len(r[1] or ""), "x", 1) for r in out]


def run(spark, tmp_path, data):
    spark.createDataFrame(data, KIND).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return pipeline.run(spark, str(tmp_path))


def test_stages_in_turn(spark, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "mixing", "sentencepiece"] and pipeline.ORACLE_SQL is None
    out = run(spark, tmp_path, rows()).collect()
    docs, by = spark.read.parquet(str(tmp_path / "documents.parquet")), {r[0]: r[1] for r in rows()}
    # rows that a language explains, of equal texts the first, of near ones too: by their definitions, on the rows that are left
    accepted = {(r.doc_id, r.text) for r in language_id.stage(spark, docs, "").collect()}
    assert (502, by[502]) not in accepted and (503, None) not in accepted and len(accepted) >= 120
    firsts = {}
    for i, t in sorted(accepted, key=lambda x: (x[0] is None, x[0] or 0)):
        firsts.setdefault(" ".join(t.split()), (i, t))
    sets = {(i, t): {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)} for i, t in firsts.values()}
    kept = [d for d in sets if not any(e != d and (e[0] is not None and (d[0] is None or e[0] < d[0])) and d[0] is not None and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in sets)]
    assert (501, by[501]) not in kept and (500, by[500]) not in kept
    left = docs.sparkSession.createDataFrame([(i, t, next(r[3] for r in rows() if r[:2] == (i, t))) for i, t in kept], "doc_id long, text string, source string")
    want = sorted((str(r.doc_id), r.copies) for r in mixing.mix(left).collect() if r.copies)
    counts: dict = {}
    for r in out:
        counts[str(r.doc_id)] = counts.get(str(r.doc_id), 0) + 1
    assert sorted(counts.items()) == want
    codec = S.Codec(S.read_model())
    assert all(r.round_trip and (r.doc_id is None or list(r.ids) == codec.encode(by[r.doc_id])) for r in out)


@pytest.mark.parametrize("data", [[], [(1, None, None, None, None, None, None)] * 3])
def test_nothing_to_do(spark, tmp_path, data):
    assert run(spark, tmp_path, data).collect() == []
