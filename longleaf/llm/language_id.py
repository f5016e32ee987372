"""Language identification by interpolated Kneser-Ney character models (operator 1).

One model of order ORDER per language is estimated from character n-grams that stay inside a
word, with its boundaries. All models lie together in sorted arrays of 64-bit n-gram hashes,
with one row of log probabilities (a column for each language) beside each hash. What a letter gets
depends on the n-gram that ends there alone, so a task looks each n-gram up once. A text goes
to the language of lowest cross-entropy per character. A temperature fitted on labelled rows
that the counts left out turns entropies into a score. A limit on the entropy, by language and
length, rejects texts that no model explains; it is a quantile over all labelled rows outside the
counted ones, from a histogram, so every text is scored once and compared afterwards.

Defined cases: a null, empty or letterless text is `und` with score 0 and not accepted; ties go
to the language that sorts first; rows that repeat get the same answer each; with no labelled
row at all, every text is `und`; an empty table gives an empty result; texts and tokens may be of any length; other
columns, `found` and `accepted` among them, are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 4
#: Labelled rows of a language that a fit reads, as expected by a threshold on the id's hash.
FIT_ROWS = 600
#: Of these, the share that calibrates the score instead of being counted.
CALIBRATE = 0.25
#: A text is rejected beyond this multiple of the QUANTILE of entropies among rightly placed rows of its length,
#: with 3 / sqrt(letters) more for chance: a strange script lies far beyond it, odd words and short texts don't.
REJECT = 1.6
QUANTILE = 0.99
#: Lengths are told apart by powers of two, entropies by BINS a nat.
LENGTHS, BINS = 32, 100
#: Letters alone: numerals such as ² or ½ are none.
LETTERS = regex.compile(r"\p{L}+")
#: Of tokens on lines of their own.
_PARTS = regex.compile(r"\p{L}+|\n")
_BASE = 0x9E3779B97F4A7C15
#: Tokens that a task remembers, letters of a token up to which it does, and tokens of a text that are scored at once.
_MEMO, _LONG, _PART = 100_000, 64, 50_000
#: Bytes of the log probabilities of n-grams that a task remembers.
_GRAM_BYTES = 1 << 23


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words between blanks, and the place of each word's first letter."""
    pad = " " * (ORDER - 1)
    cps = np.frombuffer((pad + pad.join(words) + pad).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    return cps, np.cumsum(lens + ORDER - 1) - lens


def keys(cps: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n-gram that ends at each of these places."""
    total = np.full(len(at), n, np.uint64)
    for k in range(n):
        total += cps[at - k] * _power(k)
    return C.mix64(total)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]  # sorted hashes, by order
    logp: list[np.ndarray]  # rows of interpolated log probabilities; NaN where a language hasn't the n-gram
    contexts: list[np.ndarray]  # sorted hashes of what stands before the last letter
    back: list[np.ndarray]  # log weight that a context leaves to the lower order
    floor: np.ndarray  # log probability of a letter that a language has never seen
    temperature: float = 1.0
    limit: np.ndarray | None = None  # by language and length

    def words(self, words: list[str], known: Grams | None = None) -> np.ndarray:
        """For each word, its log probability in each language, closing boundary included."""
        cps, first = padded(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        at = np.repeat(first - np.cumsum(lens + 1) + lens + 1, lens + 1) + np.arange(int((lens + 1).sum()))
        total = self.places(cps, at) if known is None else known.places(self, cps, at)
        return np.add.reduceat(total, np.cumsum(lens + 1) - lens - 1, axis=0)

    def places(self, cps: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each of these places, the log probability of its letter in each language."""
        total = np.broadcast_to(self.floor, (len(at), len(self.langs))).copy()
        for n in range(ORDER):
            if n:
                row, found = _find(self.contexts[n], keys(cps, at - 1, n))
                total[found] += self.back[n][row[found]]
            row, found = _find(self.grams[n], keys(cps, at, n + 1))
            seen = self.logp[n][row[found]]
            total[found] = np.where(np.isnan(seen), total[found], seen)
        return total

    def entropies(self, texts: Iterator[str | None], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Nats a letter in each language, and how many letters (with boundaries) there are."""
        total = memo.totals([t or "" for t in texts])
        sizes = total[:, -1]
        return -total[:, :-1] / np.maximum(sizes, 1)[:, None], sizes

    def answers(self, texts: Iterator[str | None], memo: Memo) -> pd.DataFrame:
        texts = list(texts)
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "entropy": 0.0, "accepted": False, "letters": 0})
        ce, n = self.entropies(texts, memo)
        best = ce.argmin(1)
        rows = np.arange(len(best))
        share = np.exp(-self.temperature * (ce - ce[rows, best][:, None])).sum(1)
        some = n > 0
        fits = some if self.limit is None else some & (ce[rows, best] <= self.limit[best, lengths(n)] + 3 / np.sqrt(np.maximum(n, 1)))
        return pd.DataFrame({
            "lang_pred": np.where(some, np.array(self.langs, dtype=object)[best], "und"),
            "score": np.where(some, 1 / share, 0.0), "entropy": np.where(some, ce[rows, best], 0.0), "accepted": fits, "letters": n.astype(np.int64),
        })


def lengths(letters: np.ndarray) -> np.ndarray:
    """The power of two at or below each number of letters."""
    return np.clip(np.frexp(letters)[1] - 1, 0, LENGTHS - 1)


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, wanted), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == wanted if len(sorted_keys) else np.zeros(len(wanted), bool))


class Grams:
    """Log probabilities by the n-gram of the highest order, in one slot for each remainder of its hash; the last one met has it."""

    def __init__(self, langs: int):
        size = 1 << max(_GRAM_BYTES // (8 * max(langs, 1)), 1).bit_length() - 1
        self.of = np.uint64(size - 1)
        self.keys = ~np.arange(size, dtype=np.uint64)  # no hash of its slot
        self.rows = np.zeros((size, langs))

    def places(self, model: Model, cps: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the model's `places` gives, which is asked for n-grams that no slot holds."""
        hashed = keys(cps, at, ORDER)
        slot = (hashed & self.of).astype(np.int64)
        out = self.rows[slot]
        new = np.flatnonzero(self.keys[slot] != hashed)
        if len(new):
            _, one, each = np.unique(hashed[new], return_index=True, return_inverse=True)
            one = new[one]
            found = model.places(cps, at[one])
            out[new] = found[each]
            to, one_of = np.unique(slot[one], return_index=True)
            self.keys[to], self.rows[to] = hashed[one[one_of]], found[one_of]
        return out


class Memo:
    """Scores of tokens met so far; each batch of new ones is scored at once. Long tokens are scored but not kept."""

    def __init__(self, model: Model):
        self.model, self.grams = model, Grams(len(model.langs))
        self.clear()

    def clear(self) -> None:
        self.at, self.table = {}, np.zeros((1024, len(self.model.langs) + 1))  # row 0 is of tokens that aren't kept

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text in each language, and its letters with boundaries."""
        out = np.zeros((len(texts), self.table.shape[1]))
        part, starts, of = [], [], []
        for i, text in enumerate(texts):
            tokens = text.lower().split()
            for j in range(0, len(tokens), _PART):
                some = tokens[j : j + _PART]
                if len(part) + len(some) > _PART:
                    self.sum(part, starts, of, out)
                    part, starts, of = [], [], []
                starts.append(len(part))
                of.append(i)
                part += some
        if part:
            self.sum(part, starts, of, out)
        return out

    def sum(self, part: list[str], starts: list[int], of: list[int], out: np.ndarray) -> None:
        """Add the tokens from each start to the next to the row of out that they are of; no row comes twice."""
        new = [t for t in dict.fromkeys(part) if t not in self.at]
        if len(self.at) > _MEMO and new:
            self.clear()
            new = list(dict.fromkeys(part))
        if new:
            self.add([t for t in new if len(t) <= _LONG])
            if long := {t: k for k, t in enumerate(t for t in new if len(t) > _LONG)}:
                places = [k for k, t in enumerate(part) if t in long]
                rows = np.array(of)[np.searchsorted(starts, places, "right") - 1]
                np.add.at(out, rows, self.values(list(long))[[long[part[k]] for k in places]])
        rows = np.fromiter(map(self.at.get, part, repeat(0)), np.int64, len(part))
        out[of] += np.add.reduceat(self.table[rows], starts, axis=0)

    def values(self, tokens: list[str]) -> np.ndarray:
        parts = _PARTS.findall("\n".join(tokens))  # a token holds no line feed
        ends = np.fromiter((p == "\n" for p in parts), bool, len(parts))
        words = [p for p in parts if p != "\n"]
        out = np.zeros((len(tokens), self.table.shape[1]))
        if words:
            own = np.empty((len(words), out.shape[1]))
            own[:, :-1] = self.model.words(words, self.grams)
            own[:, -1] = [len(w) + 1 for w in words]
            np.add.at(out, np.cumsum(ends)[~ends], own)
        return out

    def add(self, tokens: list[str]) -> None:
        n = len(self.at) + 1
        while n + len(tokens) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n : n + len(tokens)] = self.values(tokens)
        self.at.update(zip(tokens, range(n, n + len(tokens)), strict=True))


def build(counts: pd.DataFrame) -> Model:
    """The models of a frame (lang, gram, n) that holds the counts of n-grams of the highest order."""
    langs = sorted(counts.lang.unique()) if len(counts) else []
    column = {x: i for i, x in enumerate(langs)}
    tables = {ORDER: counts.rename(columns={"n": "c"})}
    for n in range(ORDER - 1, 0, -1):  # a lower order counts the letters that its n-grams were seen after
        shorter = tables[n + 1].assign(gram=tables[n + 1].gram.str[1:])
        tables[n] = shorter.groupby(["lang", "gram"], as_index=False).agg(c=("c", "size"))
    grams, logp, contexts, back, floor, below = [], [], [np.zeros(0, np.uint64)], [np.zeros((0, len(langs)))], np.zeros(len(langs)), None
    for n in range(1, ORDER + 1):
        t = tables[n].assign(context=lambda x: x.gram.str[:-1])
        ones = t.assign(one=t.c == 1, two=t.c == 2).groupby("lang")[["one", "two"]].sum()
        discount = ((ones.one + 0.5) / (ones.one + 2 * ones.two + 1)).to_dict()
        t["d"] = t.lang.map(discount)
        by = t.groupby(["lang", "context"], as_index=False).agg(total=("c", "sum"), kinds=("c", "size"), d=("d", "first"))
        by["left"] = by.d * by.kinds / by.total
        t = t.merge(by[["lang", "context", "total", "left"]], on=["lang", "context"])
        if n == 1:
            letters = t.gram.nunique() + 1
            floor = np.array([np.log(by.left[by.lang == x].iloc[0] / (letters * 100)) for x in langs])
            lower = 1 / letters
        else:
            t["shorter"] = t.gram.str[1:]
            t = t.merge(below, on=["lang", "shorter"], how="left")
            lower = t.p_below
        t["p"] = (t.c - t.d) / t.total + t.left * lower
        below = t[["lang", "gram", "p"]].rename(columns={"gram": "shorter", "p": "p_below"})
        for names, values, to, rows in ((t.gram, np.log(t.p), grams, logp), *([(by.context, np.log(by.left), contexts, back)] if n > 1 else [])):
            kinds, at = np.unique(names.to_numpy(str), return_inverse=True)
            width = len(kinds[0])
            cps = np.frombuffer(np.asarray(kinds, f"<U{width}").tobytes(), np.uint32).reshape(-1, width).astype(np.uint64)
            total = sum((cps[:, width - 1 - k] * _power(k) for k in range(width)), np.zeros(len(kinds), np.uint64))
            hashed = C.mix64(total + np.uint64(width))
            order = np.argsort(hashed)
            filled = np.full((len(kinds), len(langs)), np.nan if rows is logp else 0.0)
            filled[at, counts_columns(t.lang if rows is logp else by.lang, column)] = values
            to.append(hashed[order])
            rows.append(filled[order])
    return Model(langs, grams, logp, contexts, back, floor)


def counts_columns(langs: pd.Series, column: dict[str, int]) -> np.ndarray:
    return langs.map(column).to_numpy(np.int64)


def count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pad = " " * (ORDER - 1)
    for frame in frames:
        words: dict[str, Counter] = {}
        for lang, text in zip(frame.lang, frame.text, strict=True):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, found in words.items():
            grams: Counter = Counter()
            for w, n in found.items():
                w = f"{pad}{w} "
                for i in range(len(w) - ORDER + 1):
                    grams[w[i : i + ORDER]] += n
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})


def learn(labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[Model, Column]:
    """Models, without limits, of the languages in labelled (doc_id, text, lang), and whether a row is among the counted ones.

    About `rows` rows of each language are read. The driver gets one number a language and the n-grams of those rows, never more.
    """
    C.check_columns(labelled, "doc_id", "text", "lang")
    labelled = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [], [], [], [], np.zeros(0)), F.lit(False)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n))])[F.col("lang")]
    place = C.hash01(F.col("doc_id")) / share
    counted = place < 1 - CALIBRATE
    chosen = labelled.filter(place < 1).withColumn("late", ~counted)
    counts = chosen.filter("not late").select("lang", "text").mapInPandas(count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    model = build(counts) if len(counts) else Model([], [], [], [], [], np.zeros(0))
    if not model.langs:
        return model, counted

    def entropies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(model)
        for f in frames:
            ce, n = model.entropies(f.text, memo)
            yield pd.DataFrame({"lang": f.lang.to_numpy(), "ce": list(ce), "n": n})[lambda x: x.n > 0]

    held = chosen.filter("late").select("lang", "text").mapInPandas(entropies, "lang string, ce array<double>, n double").toPandas()
    held = held[held.lang.isin(model.langs)]
    if len(held):
        ce = np.stack(held.ce.to_numpy())
        own = held.lang.map({x: i for i, x in enumerate(model.langs)}).to_numpy()
        gap = ce - ce[np.arange(len(ce)), own][:, None]
        model.temperature = float(min((2.0**k for k in range(8)), key=lambda t: np.log(np.exp(-t * gap).sum(1)).mean()))
    return model, counted


def limits(langs: list[str], placed: DataFrame) -> np.ndarray:
    """The limit for each language and length, from all of placed (lang, found), which are labelled rows outside the counted ones.

    Rows whose own language wins go into a histogram, which partitions add up; the driver gets its cells. A quantile is
    read at the upper edge of its cell. A shorter text may always have what a longer one may, and beyond the longest
    rows their limit holds; a language that no row has takes those of all languages together.
    """
    right = placed.filter((F.col("found.lang_pred") == F.col("lang")) & (F.col("found.letters") > 0))
    cell = F.floor(F.col("found.entropy") * BINS).cast("int").alias("cell")
    cells = right.groupBy("lang", length().alias("length"), cell).agg(F.count("*").alias("n")).collect()
    if not cells:
        return np.full((len(langs), LENGTHS), np.inf)
    own = {x: np.zeros((LENGTHS, max(r.cell for r in cells) + 1), np.int64) for x in langs}
    for r in cells:
        own[r.lang][r.length, r.cell] += r.n
    every = sum(own.values())
    out = np.empty((len(langs), LENGTHS))
    for i, x in enumerate(langs):
        upto = (own[x] if own[x].any() else every).cumsum(1)
        edge = ((upto >= QUANTILE * upto[:, -1:]).argmax(1) + 1) / BINS
        edge[upto[:, -1] == 0] = 0
        edge = np.maximum.accumulate(edge[::-1])[::-1]
        out[i] = REJECT * np.where(edge > 0, edge, edge[edge > 0][-1])
    return out


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Models and limits of the languages in labelled (doc_id, text, lang); the limits are of all its rows."""
    model, counted = learn(labelled, rows)
    if model.langs:
        rest = labelled.filter("lang is not null and text is not null").filter(~counted)
        model.limit = limits(model.langs, rest.select("lang", identify(model)("text").alias("found")))
    return model


KIND = "lang_pred string, score double, entropy double, accepted boolean, letters long"


def identify(model: Model):
    """A column function: text to (lang_pred, score, entropy, accepted, letters)."""

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = Memo(model)
        for texts in batches:
            yield model.answers(texts, memo)
        del memo
        C.release()

    answers.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(answers, KIND)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(C.fold("doc_id", 5) != 0)


def length() -> Column:
    """What `lengths` gives, of found.letters."""
    return F.least(F.length(F.bin("found.letters")) - 1, F.lit(LENGTHS - 1))


def accepted(langs: list[str], limit: np.ndarray) -> Column:
    """What `answers` accepts by these limits, of found."""
    of = F.create_map(*[y for x, row in zip(langs, limit, strict=True) for y in (F.lit(x), F.array(*map(F.lit, row.tolist())))])
    return (F.col("found.letters") > 0) & (F.col("found.entropy") <= of[F.col("found.lang_pred")][length()] + 3 / F.sqrt(F.greatest("found.letters", F.lit(1))))


def placed(spark, docs: DataFrame, *columns: str) -> DataFrame:
    """These columns of docs, found and accepted: every text is scored once and kept, and the limits come from what was kept."""
    model, counted = learn(training_rows(docs))
    trains = F.col("lang").isNotNull() & F.col("text").isNotNull() & (C.fold("doc_id", 5) != 0)
    tells = F.when(trains & ~counted, F.col("lang"))
    kept = C.Scratch(spark).keep(docs.select(F.struct(*columns).alias("row"), tells.alias("lang"), identify(model)("text").alias("found")))
    if not model.langs:
        return kept.select("row", "found", F.lit(False).alias("accepted"))
    limit = limits(model.langs, kept.filter("lang is not null"))
    return kept.select("row", "found", accepted(model.langs, limit).alias("accepted"))


def op1(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by models learnt outside the held-out fifth."""
    docs = C.table(spark, sf_dir, "documents")
    held = C.fold("doc_id", 5) == 0
    rows = placed(spark, docs, "doc_id").withColumn("doc_id", F.col("row.doc_id"))
    return rows.select("doc_id", held.alias("held_out"), "found.lang_pred", "found.score", "found.entropy", "accepted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language some model explains, with all their columns."""
    return placed(spark, docs, *docs.columns).filter("accepted").select("row.*")
