"""SentencePiece encoding and decoding by a streaming lattice (operator 7).

A text is a stream of characters. The encoder keeps, for each position of a window bounded by the longest
piece, the piece that ends there on the best path and so the position it came from. As soon as all
positions of the window lead back to one boundary, the ids before it are committed and forgotten, so that memory
doesn't grow with the text. Where no piece of the vocabulary can span a boundary (before a blank that
follows something else, at a line end), all paths meet without a look at them: there the window closes, and the
ids of what it held are remembered, so that a stretch which comes again is committed at once.

What the best path is depends on the kind of model. A unigram model takes the path of highest
score (Viterbi). In a BPE model the encoding of a prefix has exactly one last piece, which is the
one that merges with its predecessor's piece to just these two; so the same lattice holds one
backpointer a position and gives what merging gives.

Defined cases: a null text has null ids and counts of 0, an empty text has no ids; characters outside
the vocabulary become their UTF-8 bytes if the model has byte pieces, else one unknown id for each run; rows that
repeat are encoded alike; an empty table gives an empty result; texts may be of any length; other columns, `ids` among
them, aren't read. Decoding gives the text back, but that U+2581 becomes a blank.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain, islice
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Stretches that a task remembers, and the length up to which it does.
MEMO, MEMO_LENGTH = 400_000, 48
#: Of these, how many a worker keeps from one task to the next.
KEPT = 120_000
#: Lengths of a stretch's beginnings whose lattices are remembered for the next that begins alike, and how many of these.
HEAD, HEADS = (8, 5), 100_000
#: Characters between attempts to commit.
STEP = 64
#: Pairs of pieces of which a worker remembers whether they stand next to each other.
PAIRS = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[i : i + size]
            i += size


class Model:
    """Pieces of a model file; what the lattice needs of it."""

    def __init__(self, data: bytes):
        self.kind, self.prefix, pieces = UNIGRAM, True, []
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), float(np.frombuffer(p.get(2, b"\0" * 4), "<f4")[0]), p.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                n = dict(_fields(value))
                self.prefix = bool(n.get(3, 1))
                if n.get(2) or n.get(4, 1) or not n.get(5, 1):
                    raise ValueError("only models that leave text as it is are supported")
        if self.kind not in (UNIGRAM, BPE) or any(t == USER for *_, t in pieces):
            raise ValueError("only unigram and BPE models without user symbols are supported")
        self.pieces = pieces
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.penalty = min(self.score.values(), default=0.0) - 10
        letters = set("".join(self.ids))
        # no piece holds these next to anything else, or has a blank after another character
        self.apart = "".join(c for c in "\n\r\t" if c not in letters)
        #: Neighbours within a piece: between all others lies a certain boundary.
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.by_blank = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        pieces_left = [p for p in self.ids if self.kind == UNIGRAM or self.merged(p) == [p]]
        #: Names of the codes of pieces that a text can end in; unknown characters join as they come.
        self.names = ["", *pieces_left]
        #: By code: the id of the piece, or None if it has none of its own.
        self.own = [None, *map(self.ids.__getitem__, pieces_left)]
        #: Suffixes of these pieces, with the code of the piece or 0.
        self.code = {p[i:]: 0 for p in pieces_left for i in range(len(p))}
        self.code.update((p, k + 1) for k, p in enumerate(pieces_left))
        #: By piece: whether another may follow it.
        self.fits: list[dict[int, bool]] = [{} for _ in self.names]
        self.known = 0

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the adjacent pair of best score merges, the leftmost of equals first."""
        parts, get, never = list(text), self.score.get, -np.inf
        scores = [get(x, never) for x in map(add, parts, parts[1:])]
        while scores and (best := max(scores)) > never:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], never)
        return parts

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the pieces of two codes together leaves just these two."""
        if self.known > PAIRS:
            self.known = 0
            for row in self.fits:
                row.clear()
        x, y = self.names[a], self.names[b]
        found = self.fits[a][b] = self.merged(x + y) == [x, y]
        self.known += 1
        return found

    def stranger(self, letter: str) -> int:
        """A new code for a character that no piece ends in."""
        self.names.append(letter)
        self.own.append(self.ids.get(letter))
        self.fits.append({})
        self.code[letter] = len(self.names) - 1
        return self.code[letter]

    def extend(self, text: str, size: list[int], last: list[int], total: list[float], first: bool) -> None:
        """Continue the lattice over text: size and code of the piece that ends at each position, score of its path.

        first: whether position 0 is where the whole text begins; else the piece that ends there isn't known here.
        """
        if self.kind == BPE:
            total += [0.0] * (len(text) + 1 - len(size))
            return self.merge(text, size, last, first)
        code = self.code
        for end in range(len(size), len(text) + 1):
            found = []
            for n in range(1, end + 1):
                k = code.get(text[end - n : end])
                if n == 1:
                    k = k or self.stranger(text[end - 1])
                elif k is None:
                    break
                if k:
                    found.append((n, k))
            best, n, k = max((total[end - n] + self.score.get(self.names[k], self.penalty), n, k) for n, k in found)
            size.append(n)
            last.append(k)
            total.append(best)

    def merge(self, text: str, size: list[int], last: list[int], first: bool) -> None:
        """`extend` of a BPE model: one piece fits at most, so the shortest is tried first; if none is known to, it is the last letter."""
        get, fits = self.code.get, self.fits
        for end in range(len(size), len(text) + 1):
            at = end - 1
            k = one = get(text[at]) or self.stranger(text[at])
            while True:
                if k:
                    if at:
                        fit = fits[last[at]].get(k)
                        if fit or fit is None and self.neighbours(last[at], k):
                            break
                    elif first:
                        break
                at -= 1
                k = get(text[at:end]) if at >= 0 else None
                if k is None:
                    at, k = end - 1, one
                    break
            size.append(end - at)
            last.append(k)

    def id_of(self, piece: str) -> tuple[int, ...]:
        i = self.ids.get(piece)
        if i is not None:
            return (i,)
        raw = piece.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw) if all(b in self.bytes for b in raw) else (self.unknown,)


class Window:
    """The lattice of what isn't committed yet of a stretch that comes in parts."""

    def __init__(self, model: Model):
        self.model, self.first = model, True  # whether the window begins where the stretch does
        self.text, self.size, self.last, self.total = "", [0], [0], [0.0]
        self.widest = 0  # positions held at once, for tests

    def push(self, part: str) -> list[str]:
        """Pieces that are certain by now."""
        out: list[str] = []
        for i in range(0, len(part), STEP):
            self.text += part[i : i + STEP]
            self.model.extend(self.text, self.size, self.last, self.total, self.first)
            self.widest = max(self.widest, len(self.size))
            if len(self.text) > STEP:
                out += self._commit()
        return out

    def _path(self, end: int) -> list[int]:
        path = [end]
        while end > 0:
            end -= self.size[end]
            path.append(end)
        return path

    def _commit(self) -> list[str]:
        """Pieces up to the last boundary that all positions a later piece can start from lead back to."""
        last = len(self.size) - 1
        meet = None
        for end in range(max(0, last - self.model.longest + 1), last + 1):
            path = self._path(end)
            meet = path if meet is None else [x for x in path if x in set(meet)]
        return self._cut(meet[0] if meet else 0)

    def _cut(self, at: int) -> list[str]:
        """Hand out what lies before `at`, but keep the piece that ends there, which BPE compares with."""
        path = self._path(at)[::-1]
        keep = path[-2] if len(path) > 1 else 0
        path = path[:-1]
        out = [self.text[i:j] for i, j in zip(path[:-1], path[1:], strict=True)]
        if keep:
            base = self.total[keep]
            self.text, self.first = self.text[keep:], False
            self.size, self.last, self.total = [0, *self.size[keep + 1 :]], self.last[keep:], [x - base for x in self.total[keep:]]
        return out

    def finish(self) -> list[str]:
        """The pieces left, when nothing more comes."""
        out, end = [], len(self.text)
        while end:
            start = end - self.size[end]
            out.append(self.text[start:end])
            end = start
        return out[::-1]


class Stream:
    """Ids of a text that comes in parts, committed as soon as they are certain."""

    def __init__(self, codec: Codec):
        self.codec, self.window, self.open, self.begun, self.last = codec, None, "", False, None

    def push(self, part: str) -> list[int]:
        c, out = self.codec, []
        if part and not self.begun:
            self.begun, part = True, BLANK + part if c.model.prefix else part
        part = part.replace(" ", BLANK)
        if self.open and part:  # the stretch that is open goes on, or ends here
            goes_on = c.goes_on(self.open, part)
            out += self._into(part[:goes_on])
            part = part[goes_on:]
        if part:
            out += self._close()
            whole = c.stretches(part)
            if len(c.memo) > MEMO:
                c.forget(MEMO // 2)
            get, own = c.memo.get, c.stretch
            out += chain.from_iterable([get(s) or own(s) for s in whole[:-1]])
            self.open = whole[-1]
        return self._known(out)

    def finish(self) -> list[int]:
        return self._known(self._close())

    def _into(self, part: str) -> list[int]:
        """Read more of the open stretch through its window."""
        if not part:
            return []
        if self.window is None:
            self.window, part = Window(self.codec.model), self.open + part
        self.open = self.open[-1:] + part[-1:] if BLANK in part[-1:] else part[-1:]
        return [*chain.from_iterable(map(self.codec.model.id_of, self.window.push(part)))]

    def _close(self) -> list[int]:
        window, text = self.window, self.open
        self.window, self.open = None, ""
        if window is None:
            return list(self.codec.memo.get(text) or self.codec.stretch(text)) if text else []
        return [*chain.from_iterable(map(self.codec.model.id_of, window.finish()))]

    def _known(self, ids: list[int]) -> list[int]:
        """Without byte pieces, a run of unknown characters is one id."""
        if self.codec.model.bytes or not ids:
            return ids
        unknown, before = self.codec.model.unknown, [self.last, *ids[:-1]]
        self.last = ids[-1]
        return [x for x, y in zip(ids, before, strict=True) if x != unknown or y != unknown]


class Codec:
    def __init__(self, data: bytes):
        self.model = m = Model(data)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.heads: dict[str, tuple[tuple, tuple, tuple]] = {}
        apart = re.escape(m.apart)
        self.stretches = re.compile(f"{BLANK}+[^{BLANK}{apart}]*|[^{BLANK}{apart}]+" + (f"|[{apart}]" if apart else "")).findall if m.by_blank else lambda t: [t]
        self.after_blank, self.after_letter = re.compile(f"{BLANK}*[^{BLANK}{apart}]*").match, re.compile(f"[^{BLANK}{apart}]*").match
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNUSED) else p.replace(BLANK, " ").encode() for p, _, t in m.pieces]
        self.raw[m.unknown] = " ⁇ ".encode()

    def goes_on(self, stretch: str, part: str) -> int:
        """How much of the part belongs to the stretch before it."""
        if not self.model.by_blank:
            return len(part)
        if stretch[-1] in self.model.apart:
            return 0
        return (self.after_blank if stretch[-1] == BLANK else self.after_letter)(part).end()

    def forget(self, keep: int = KEPT) -> None:
        """Keep the stretches that came first, which are the frequent ones."""
        self.heads.clear()
        if len(self.memo) > keep:
            self.memo = dict(islice(self.memo.items(), keep))

    def stretch(self, text: str) -> tuple[int, ...]:
        """The ids of a whole stretch; remembered if it is short."""
        inner = self.model.inner
        cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inner]
        if cuts:  # boundaries that no piece spans, too
            get, own = self.memo.get, self.windowed
            parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            ids = tuple(chain.from_iterable([get(p) or own(p) for p in parts]))
            if len(text) <= MEMO_LENGTH:
                self.memo[text] = ids
            return ids
        return self.windowed(text)

    def windowed(self, text: str) -> tuple[int, ...]:
        """The ids of what lies between two certain boundaries, by its window; a short one is committed when it ends."""
        m, end = self.model, len(text)
        if end > MEMO_LENGTH:
            window = Window(m)
            pieces = window.push(text) + window.finish()
            return tuple(chain.from_iterable(map(m.id_of, pieces)))
        size, last = self.lattice(text, HEAD)[:2]
        path = []
        while end:
            path.append(last[end])
            end -= size[end]
        ids = tuple(map(m.own.__getitem__, reversed(path)))
        if None in ids:
            ids = tuple(chain.from_iterable(map(m.id_of, map(m.names.__getitem__, reversed(path)))))
        self.memo[text] = ids
        return ids

    def lattice(self, text: str, head: tuple[int, ...]) -> tuple[list, list, list]:
        """The whole lattice of a text, that of its beginning as it is remembered at these lengths."""
        size, last, total = [0], [0], [0.0]
        for i, n in enumerate(head):
            if len(text) > n:
                known = self.heads.get(text[:n])
                if known is None:
                    size, last, total = self.lattice(text[:n], head[i + 1 :])
                    if len(self.heads) > HEADS:
                        self.heads.clear()
                    self.heads[text[:n]] = tuple(size), tuple(last), tuple(total)
                else:
                    size, last, total = map(list, known)
                break
        self.model.extend(text, size, last, total, True)
        return size, last, total

    def encode(self, text: str) -> list[int]:
        stream = Stream(self)
        ids = stream.push(text)
        return ids + stream.finish()

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def codec_of(data: bytes) -> Codec:
    """The codec of this process, which serves all tasks that a worker runs; tasks leave little of what they remembered."""
    kept = sys.__dict__.setdefault("_longleaf_codecs", {})
    if hash(data) not in kept:
        kept.clear()
        kept[hash(data)] = Codec(data)
    return kept[hash(data)]


def read_model(path: str = MODEL) -> bytes:
    """The vocabulary file, read where the driver is and sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, n_chars, round_trip, ids: one row for each row of docs (doc_id, text)."""
    C.check_columns(docs, "doc_id", "text")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(model)
        for f in frames:
            for i in range(0, len(f), 1000):
                part = f.iloc[i : i + 1000]
                ids = [None if t is None else codec.encode(t) for t in part.text]
                back = [t is None or codec.decode(x) == t.replace(BLANK, " ") for t, x in zip(part.text, ids, strict=True)]
                yield pd.DataFrame({
                    "doc_id": part.doc_id.array, "n_tokens": [0 if x is None else len(x) for x in ids], "n_chars": [0 if t is None else len(t) for t in part.text],
                    "round_trip": back, "ids": [None if x is None else np.array(x, np.int32) for x in ids],
                })
        codec.forget()
        C.release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(each, f"doc_id {kind}, n_tokens long, n_chars long, round_trip boolean, ids array<int>")


def decoded(encodings: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text: the texts of encodings (doc_id, ids)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(model)
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id.array, "text": [None if x is None else codec.decode(x) for x in f.ids]})

    kind = encodings.schema["doc_id"].dataType.simpleString()
    return encodings.select("doc_id", "ids").mapInPandas(each, f"doc_id {kind}, text string")


def op7(spark, sf_dir: str) -> DataFrame:
    """The ids of every whole document, and whether decoding them gives its text back."""
    return encoded(C.table(spark, sf_dir, "documents"), read_model())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encodings of the documents, one row for each row."""
    return encoded(docs, read_model())
