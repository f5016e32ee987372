"""Codec, token counts, toxicity, URLs and pages."""

import itertools
import random

import pytest

from longleaf.llm import html_extraction as H
from longleaf.llm import sentencepiece_codec as S
from longleaf.llm import token_counts as K
from longleaf.llm import toxicity as X
from longleaf.llm import url_filter as U

TEXTS = [None, "", " ", "a", "The quick  brown fox.\n\tÉté 中文 \U0001f600 ▁x", "x" * 30_000, "ab " * 40_000, " lead", "trail "]


def test_codec_matches_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=S.MODEL)
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, ids string")
    model = S.read_model()
    out = S.encoded(docs, model).collect()
    assert len(out) == len(TEXTS) * 2 and all(r.round_trip for r in out)
    for r in out:
        t = TEXTS[r.doc_id % len(TEXTS)]
        assert r.ids == (None if t is None else sp.encode(t)) and r.n_tokens == len(r.ids or [])
    back = {r.doc_id: r.text for r in S.decoded(S.encoded(docs, model), model).collect()}
    assert all(back[i] == (t and t.replace("▁", " ")) for i, t in enumerate(TEXTS))
    assert S.encoded(docs.limit(0), model).count() == 0


def test_window_is_bounded_and_unigram_is_best():
    m = S.Model(S.read_model())
    s = S.Window(m)
    pieces = [*s.push("internationalisation" * 2000), *s.finish()]
    assert "".join(pieces) == "internationalisation" * 2000 and s.widest < 400
    m.kind, rnd = S.UNIGRAM, random.Random(0)
    for _ in range(40):
        t = "".join(rnd.choice("abeinrst") for _ in range(9))
        best = {0: (0.0, ())}
        for j in range(1, len(t) + 1):
            best[j] = max((best[i][0] + m.score[t[i:j]], (*best[i][1], t[i:j])) for i in range(j) if t[i:j] in m.score and m.code.get(t[i:j]))
        u = S.Window(m)
        got = [*u.push(t), *u.finish()]
        assert abs(sum(m.score[p] for p in got) - best[len(t)][0]) < 1e-6


def test_stream_commits_in_parts():
    """The ids of a text are the same however it is cut, and most are out before it ends; nothing but the window is held."""
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=S.MODEL)
    rnd, codec = random.Random(1), S.Codec(S.read_model())
    texts = [t for t in TEXTS if t] + ["中文字符没有空格" * 300, "a\n\nb \t c  d", "internationalisation" * 50 + "  \n" + " x" * 40]
    for t in texts:
        for size in (1, 2, 7, 1000):
            if size < 7 and len(t) > 5000:
                continue
            s, out, i = S.Stream(codec), [], 0
            while i < len(t):
                n = rnd.randint(1, size)
                out += s.push(t[i : i + n])
                i += n
                assert len(s.open) <= 1000 and (s.window is None or len(s.window.text) < 400)
            assert len(out) > len(sp.encode(t)) - 120
            assert out + s.finish() == sp.encode(t)
    assert S.Codec(S.read_model()).encode("") == [] and len(codec.memo) <= S.MEMO


def test_unknown_runs_are_one_id():
    codec = S.Codec(S.read_model())
    codec.model.bytes, codec.memo = {}, {}
    s, u = S.Stream(codec), codec.model.unknown
    out = [*s.push("a \U0001f600"), *s.push("\U0001f601\U0001f602"), *s.push("\U0001f603 b"), *s.finish()]
    assert out.count(u) == 1


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 12])
def test_token_counts(spark, block, monkeypatch):
    monkeypatch.setattr(K, "RUN", 4)
    ranks = K.read_ranks()
    texts = [None, "", "one", "two words here", "x y z " * 40] * 3
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    found = K.scan(K.streams(docs, ranks, block), K.SEPARATOR, K.WIDTH, "ids").filter("place is not null").selectExpr("ids[int(place)] as i", "tokens").collect()
    e = K.tokenizer(ranks)
    assert sorted((r.i, r.tokens) for r in found) == [(i, len(e.encode_ordinary(t or ""))) for i, t in enumerate(texts)]


def test_token_files(spark, tmp_path):
    import numpy as np

    np.array([5, 6, 9, 9, 7, 9, 1, 2, 3], "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    out = K.scan(K.read_files(spark, str(tmp_path), 2), 9).collect()
    by = {n: [(r.block, r.place, r.tokens) for r in sorted(out, key=lambda r: (r.place is None, r.block, r.place)) if r.file.endswith(n)] for n in ("a.bin", "b.bin")}
    assert [t for *_, t in by["a.bin"]] == [2, 0, 1, 3] and by["a.bin"][-1][1] is None
    assert [t for *_, t in by["b.bin"]] == [0]
    assert K.counted(spark.createDataFrame([], "doc_id long, text string"), K.read_ranks()).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_automaton_finds_what_distance_says():
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(60)}
    trie = X.Trie(words)
    for _ in range(200):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6)))
        want = sorted((distance(w, x), x) for x in words if distance(w, x) <= 1)
        assert trie.within(X.Automaton(w)) == want


def test_toxicity(spark):
    rnd, rows, labels = random.Random(5), [], []
    for i in range(400):
        words = [f"wort{rnd.randint(0, 60)}" for _ in range(30)]
        if i % 4 == 0:
            words[rnd.randrange(2, 28)] = rnd.choice(["scoundrel", "wretched"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, toxic int")
    lex = X.fit(docs, labels)
    m = lex.matcher()
    assert {"scoundrel", "wretched"} <= set(lex.weight) and [w for w, _ in m.hits("such a scoundrell, wort1")] == ["scoundrell"]
    plain, quoted = m.hits("you are a scoundrel here")[0][1], m.hits('he said "scoundrel" in the text')[0][1]
    assert quoted < plain
    ask = spark.createDataFrame([(0, None), (1, ""), (2, "wort1 wort2"), (3, "a scoundrel came"), (4, "wort " * 60_000)], "i long, text string")
    import pyspark.sql.functions as F

    s = {r.i: r.s.score for r in ask.select("i", X.scored(lex, F.col("text")).alias("s")).collect()}
    assert s[3] > 0.3 > s[2] == s[0] == s[1] == s[4]
    assert X.fit(docs, labels.filter("toxic = 0")).weight == {} and X.fit(docs.limit(0), labels).weight == {}


def test_urls(spark):
    urls = [None, "", "nohost", "http://", "HTTP://A.Org/x?y", "http://example.org/es/1", "http://example.orgx/es/1", "http://a.example.org:80/es/", "https://example.org/en/1a", "x://de.com/de/", "http://b.com/fr", "http://ÄB.com?x/fr/", "http://c.net/" + "p/" * 5000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.judged(pages).collect()}
    assert [(got[i].host, got[i].path) for i in range(5)] == [("", "")] * 4 + [("a.org", "/x")]
    assert [got[i].rule for i in range(4, 12)] == ["org/", "example.org/es/", None, None, "example.org/en/1", "com/de/", None, None]
    assert got[5].verdict == "block" and got[4].verdict == "allow" and got[11].host == "Äb.com" and got[11].path == ""
    assert U.judged(pages.limit(0)).count() == 0


def test_index_against_subsets():
    rnd = random.Random(6)
    rules = U.prune([(frozenset(rnd.sample("abcdef", rnd.randint(1, 3))), rnd.choice(["allow", "block"]), rnd.random(), rnd.random()) for _ in range(30)])
    index = U.Index(rules)
    for _ in range(100):
        t = sorted(rnd.sample("abcdefgh", rnd.randint(0, 6)))
        assert index.best(t) == next((k for k, r in enumerate(rules) if r[0] <= set(t)), None)


def test_pages(spark):
    f = H.default_field()
    pages = [None, "", "<p>", "<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One\n two <b>th</b>ree.<p>Four<script>var a='</p>'</script> five.</article><footer>© x</footer>"]
    want = ["", "", "", "T & U One two three. Four five."]
    rows = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extracted(rows, f).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}
    wrong = total = 0
    for page in H.labelled_pages(100, seed=99):
        found, chain = H.Reader().chain(page)
        wrong += sum(int(b.label == "1") != s for b, s in zip(found, f.decode(chain), strict=True))
        total += len(found)
    assert wrong < 0.02 * total


def test_likelihood_gradient():
    import numpy as np

    rng = np.random.default_rng(7)
    x, y, real = rng.integers(0, 2, (3, 4, 5)).astype(float), rng.integers(0, 2, (3, 4)), np.ones((3, 4), bool)
    real[0, 2:] = False
    w, m = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    _, a, b = H.likelihood(w, m, x, y, real)
    for g, p in ((a, w), (b, m)):
        for i in np.ndindex(p.shape):
            p[i] += 1e-5
            up = H.likelihood(w, m, x, y, real)[0]
            p[i] -= 2e-5
            down = H.likelihood(w, m, x, y, real)[0]
            p[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4


def test_toxicity_counts_every_hit():
    assert abs(X.evidence([1.0] * 200) - sum(1 / k for k in range(1, 201))) < 1e-9
    assert abs(X.evidence([1.0, 3.0, 2.0]) - (3 + 2 / 2 + 1 / 3)) < 1e-12 and X.evidence([]) == 0


def swapped(a, b):
    """Optimal string alignment by its definition."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 < j and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_every_term_is_looked_for_misspelt():
    rnd = random.Random(8)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(80)}
    trie = X.Trie(words)
    for n in range(200):
        w, k = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))), 1 + n % 2
        want = sorted((swapped(w, x), x) for x in words if swapped(w, x) <= k)
        assert trie.within(X.Swapping(w, k)) == want
    m = X.Lexicon({"scum": 2.0, "idiot": 2.0, "scoundrels": 2.0, "ass": 2.0}, innocent=frozenset(["scam"])).matcher()
    assert [m.weigh(w) for w in ("scum", "scumm", "idoit", "scuondrel", "as", "scam", "idiotic")] == [2.0, 1.0, 1.0, 0.5, 1.0, 0, 0]


def test_long_urls_are_mined(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'bad'}.example.net/" + "/".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(25)), "allow" if i % 2 else "block") for i in range(400)]
    rules, _ = U.mine(spark.createDataFrame(rows, "id long, url string, verdict string"))
    assert {(frozenset(["host:bad"]), "block"), (frozenset(["host:good"]), "allow")} <= {r[:2] for r in rules}


def test_only_raw_text_is_skipped():
    text = lambda page: [b.text for b in H.Reader().blocks(page)]
    assert text("<p>area <math><mi>x</mi> = 2</math> of <object>a <b>plan</b></object></p><noscript><p>shown</p></noscript>") == ["area x = 2 of a plan", "shown"]
    assert text("<p>a<video src=v>no video</p><p>b</p><script>x = 1</script><p>c</p>") == ["ano video", "b", "c"]
    assert text("<div><p>a</p><select><option>x</div><p>b</p>") == ["a", "b"] and text("<p>a</p><script>x") == ["a"]


def test_attributes_by_the_rules_of_html():
    f, r = H.default_field(), H.Reader()
    page = "<article><h1>Title here</h1><p title=it's>Hello there my good friend.</p><p>It's fine and good today.</p></article>"
    assert r.main_text(page, f) == "Title here Hello there my good friend. It's fine and good today."
    text = lambda page: [b.text for b in r.blocks(page)]
    assert text("<p class = 'a>b' id=\"c>d\" x=e'f\"g>one</p><p =odd a= >two</p><p/>three<p t=\"open>four") == ["one", "two", "three", "four"]
    assert text("<![CDATA[abcdef") == ["abcdef"] and text("<p>a<![CDATA[b]]>c<![CDATA[]]>d") == ["abcd"]
    assert r.kinds(" class=footer class=nav ID='side-bar'")[0] == {"foot", "side"} and r.kinds(" data-class=nav")[0] == frozenset()


def test_an_open_paragraph_ends_at_a_block():
    got = [(b.text, sorted(b.place.tags)) for b in H.Reader().blocks("<p><a><b><i><u><s><em><q>x<p>y<table><tr><td>z<p>w")]
    assert got == [("x", ["a", "b", "em", "i", "p", "q", "s", "u"]), ("y", ["p"]), ("z", ["table", "td", "tr"]), ("w", ["p", "table", "td", "tr"])]


def test_deep_and_long_pages():
    import time

    began = time.time()
    r = H.Reader()
    found = r.blocks("".join(f"<div>w{i}" for i in range(100_000)))
    assert len(found) == 100_000 and found[-1].text == "w99999" and len({id(b.place) for b in found}) == 1
    assert len(r.blocks("<div>" * 100_000 + "</i>" * 100_000 + "<li>x" * 1000)) == 1000
    assert H.Reader().main_text("<article>" + "<p>word one. " * 50_000, H.default_field()).count("word one.") == 50_000
    assert time.time() - began < 30


def test_viterbi_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        names = {f"f{i}": i for i in range(6)}
        field = H.Field(names, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
        chain = [[f"f{i}" for i in range(6) if rng.random() < 0.5] + ["unknown"] for _ in range(rng.integers(1, 9))]

        def score(states):
            own = sum(field.state[names[n], s] for f, s in zip(chain, states, strict=True) for n in f if n in names)  # noqa: B023
            return own + sum(field.move[a, b] for a, b in itertools.pairwise(states))  # noqa: B023

        assert tuple(field.decode(chain)) == max(itertools.product((0, 1), repeat=len(chain)), key=score)


def test_pages_written_by_hand(spark):
    """Layouts that no rule of the training pages made."""
    pages = {
        1: ("<html><head><title>No</title></head><body><div id=top><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><main><h1>Rivers</h1><p>The river rose in spring. It fell again in May.</p><p>People moved back.</p></main><footer>Contact us</footer></body></html>", "Rivers The river rose in spring. It fell again in May. People moved back."),
        2: ("<body><header><nav><a href=a>One</a> <a href=b>Two</a></nav></header><div class='cookie-consent'>We use cookies to serve you better.</div><article><h2>On tea</h2><blockquote>Tea is warm.</blockquote><ul><li>Boil water first.</li><li>Wait a while.</li></ul></article><section id=comments><p>Great post, thanks!</p></section></body>", "On tea Tea is warm. Boil water first. Wait a while."),
        3: ("<body><article class=post><p>First part of the story.</p><aside class=related><a href=x>More like this</a></aside><p>Second part of the story.</p><form><label>Mail</label><input></form></article></body>", "First part of the story. Second part of the story."),
    }
    rows = spark.createDataFrame([(i, None, h) for i, (h, _) in pages.items()] * 2, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in H.extracted(rows).collect()]
    assert sorted(got) == sorted([(i, t) for i, (_, t) in pages.items()] * 2)


def test_mining_against_all_subsets(spark):
    import itertools

    rnd, rows = random.Random(9), []
    for i in range(120):
        path = "/".join(sorted(rnd.sample(["news", "shop", "x", "y", "buy"], rnd.randint(0, 4))))
        url = f"http://{rnd.choice('ab')}.{rnd.choice(['one', 'two'])}.net/{path}" + ("/deep/deeper/deepest?u=1" if i % 5 == 0 else "")
        rows.append((i, url, "block" if ("shop" in path) != (rnd.random() < 0.15) else "allow"))
    rows += rows[:20]  # rows that repeat count again
    rules, names = U.mine(spark.createDataFrame(rows, "id long, url string, verdict string"), support=0.05, confidence=0.6)
    index, sets, n = U.Index(rules, names), [(frozenset(U.tokens(u)), v) for _, u, v in rows], len(rows)
    assert names and rules
    every = sorted(set().union(*(s for s, _ in sets)))
    found = []
    for size in range(1, 7):
        for a in map(frozenset, itertools.combinations(every, size)):
            inside = [v for s, v in sets if a <= s]
            for v in ("allow", "block"):
                k = inside.count(v)
                if k and k >= 0.05 * n and k / len(inside) >= 0.6:
                    found.append((a, v, k / len(inside), k / n))
    asked = {u for _, u, _ in rows} | {"http://c.one.net/deep/shop", "http://q.net/shop/x?u=2", "ftp://elsewhere.org/"}
    for url in asked:
        has, at = set(U.tokens(url)), index.best(U.tokens(url))
        want = max(((c, s, v == "block") for a, v, c, s in found if a <= has), default=None)
        got = None if at is None else (rules[at][2], rules[at][3], rules[at][1] == "block")
        assert (got is None) == (want is None) and (got is None or (abs(got[0] - want[0]) < 1e-9 and abs(got[1] - want[1]) < 1e-9 and got[2] == want[2]))


def test_mined_verdicts_and_repeated_pages(spark):
    """Where no listed rule fits, what goes along with their verdicts decides."""
    urls = [f"http://s{i % 7}.example.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(200)]
    asked = ["http://s1.example.net/de/5", "http://s1.example.net/fr/5", "http://other.info/zz", "http://s1.example.net/de/5"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls + asked)], "page_id long, url string, verdict string, rule string")
    got = {r.page_id: r for r in U.judged(pages).filter("page_id >= 200").collect()}
    assert [(got[200 + k].verdict, got[200 + k].rule) for k in range(4)] == [("block", None), ("allow", None), ("allow", None), ("block", None)]
    assert got[200].because and got[201].because and not got[202].because and got[200].because == got[203].because
    assert U.mine(spark.createDataFrame([], "id long, url string, verdict string")) == ([], {})


def test_shared_paths_are_one_item(spark):
    deep = "/".join(f"{a}{b}" for a in "abcdef" for b in "ghijk")
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.net/{deep if i % 2 else 'p'}/{i}", "block" if i % 2 else "allow") for i in range(200)]
    rules, names = U.mine(spark.createDataFrame(rows, "id long, url string, verdict string"))
    assert len(rules) < 20 and set(names.values()) == {"end:net", "host:bad", "host:good"}
    assert U.Index(rules, names).best(U.tokens("http://x.org/fk")) is not None


def test_long_words_are_terms_too():
    long = "schwachsinn" * 8
    m = X.Lexicon({long: 4.0, "idiot": 2.0}).matcher()
    assert m.weigh(long) == 4.0 and m.weigh(long[:40] + "x" + long[41:]) == 2.0 and m.weigh(long[:-3]) == 0 and m.weigh("y" * 200_000) == 0
    (frame,) = X.words_of([__import__("pandas").DataFrame({"text": [f"a bb {long}"], "toxic": [1]})])
    assert long in set(frame.word)


def test_toxicity_of_held_out_rows(spark):
    """Labels of the given table, some of which call texts toxic that hold no such word."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    r = X.op4(spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id").toPandas()
    assert r[r.toxic == 1].predicted.mean() >= 0.6 and r[r.toxic == 0].predicted.mean() <= 0.02


def test_toxicity_repeats_and_clashing_columns(spark):
    import pyspark.sql.functions as F

    lex = X.Lexicon({"idiot": 5.0})
    rows = spark.createDataFrame([(1, "what an idiot", 9.0, 7)] * 3 + [(2, None, 9.0, 7)], "doc_id long, text string, score double, predicted int")
    got = rows.select("doc_id", X.scored(lex, F.col("text")).alias("found")).select("doc_id", "found.score").collect()
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len(got) == 4


def test_signs_rule_out_no_misspelt_term():
    rnd = random.Random(12)
    terms = {"".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 14))): rnd.random() + 1 for _ in range(150)}
    m = X.Lexicon(terms).matcher()
    words = list({"".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 16))) for _ in range(400)})
    for w in list(terms)[:100]:  # and words made by edits
        letters = list(w)
        for _ in range(rnd.randint(1, 2)):
            i = rnd.randrange(len(letters) + 1)
            edit = rnd.randrange(4)
            if edit == 0:
                letters.insert(i, rnd.choice("abcxyz"))
            elif i < len(letters) and edit == 1:
                del letters[i]
            elif i < len(letters) and edit == 2:
                letters[i] = rnd.choice("abcxyz")
            elif i + 1 < len(letters):
                letters[i : i + 2] = letters[i + 1], letters[i]
        words.append("".join(letters))
    words = [w for w in words if w]
    got = m.nearest(words)
    for w in words:
        near = [(d, -terms[t], t) for t in terms if X.reach(t) and (d := swapped(w, t)) <= X.reach(t)]
        assert got.get(w) == ((min(near)[0], min(near)[2]) if near else None)


def test_known_beginnings_are_not_read_again():
    """Short words that begin alike cost the lattice their ends only, and get the ids that merging gives."""
    codec, read = S.Codec(S.read_model()), []

    class Counted(dict):
        def get(self, key, default=None):
            read.append(key)
            return dict.get(self, key, default)

    codec.model.code = Counted(codec.model.code)
    words = [f"thou{a}{b}{c}" for a in "aeiou" for b in "rstnl" for c in "aeihy"]
    got = [codec.encode(w) for w in words]
    begun = len(S.BLANK + "thou")
    assert len([k for k in read if len(k) == 1]) <= begun + len(words) * (len(S.BLANK + words[0]) - begun)
    assert got == [[*itertools.chain.from_iterable(map(codec.model.id_of, codec.model.merged(S.BLANK + w)))] for w in words]
