"""Main text of web pages by a conditional random field over leaf blocks (operator 10).

A forgiving reader turns HTML into leaf blocks: runs of text between block boundaries, each with the
elements above it. A linear-chain conditional random field, with features of ancestor tags,
of the words in their classes, ids and roles, and of the text, tells content from the rest; Viterbi decodes a
page. The field is trained by the maximum of the likelihood on labelled pages that `labelled_pages` builds
by rule: layouts with menus, headers, footers, sidebars, notices, adverts, forms and comments in many wrappings.

Defined cases: a null or empty page, and one without content, has empty text; unclosed, misnested and
unknown tags are read as far as they go; text outside any element is a block of the body; character references
are decoded; each run of white space in a block is one space; blocks are joined by one space in page order;
rows that repeat get the same text; an empty table gives an empty result; other columns, `text` and `n_chars`
among them, aren't read. Time and memory grow with a page's length alone, however deep its elements lie.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common as C

#: Elements whose end and begin cut blocks.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is never text of the page.
SKIPPED = frozenset("script style template title iframe select textarea datalist noembed noframes".split())
#: What the begin of an element closes, if it is the nearest of these.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of classes, ids and roles, by what they say of an element.
WORDS = {
    "ad": "ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promoted promotion banner",
    "side": "sidebar side aside rail widget widgets complementary related recommended recommendations more teaser trending popular",
    "note": "cookie cookies consent gdpr notice notices popup modal overlay alert paywall disclaimer banner-cookie",
    "form": "form search searchbox searchform newsletter subscribe subscription signup login signin register",
    "talk": "comment comments commentlist reply replies respond discussion disqus responses thread reviews",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip topbar",
    "share": "share sharing social socials follow tags tag meta byline author",
    "foot": "footer foot colophon copyright contentinfo bottom legal imprint",
    "head": "header masthead head top branding logo",
    "main": "content article post entry story main body text articlebody maincontent page-content prose",
}
_WORD = {w: k for k, v in WORDS.items() for w in v.split()}
#: An attribute: its name and a quoted or unquoted value. A quote inside an unquoted value is a character like others.
_NAME, _VALUE = r"[^\s/>][^\s/>=]*+", r"\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+"
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE})?+)?+")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in SKIPPED}


#: What a reader remembers at most between pages.
_MEMO = 1 << 14
#: Elements that a search for an open paragraph doesn't leave.
SCOPES = frozenset("button caption html object table td th".split())
_SHOWN = frozenset("article main nav header footer aside form section ul ol table td li p blockquote figure figcaption button label details dialog dl pre fieldset address menu search a".split())
_INNER = frozenset("nav header footer aside form section button ul".split())
_APART = frozenset("nav header footer aside form button menu search dialog".split())


class Place:
    """What the elements above a block say together, shared by all that lie in the same ones."""

    __slots__ = ("features", "inner", "leaf", "said", "tags")

    def __init__(self, tags: frozenset = frozenset(), said: frozenset = frozenset(), leaf: str = "none", inner: tuple = (None, None)):
        self.tags, self.said, self.leaf, self.inner = tags, said, leaf, inner
        out = {f"in:{t}" for t in tags if t in _SHOWN} | {f"is:{x}" for x in said}
        out.add(f"leaf:{'h' if leaf in HEADINGS else leaf if leaf in _SHOWN else 'box'}")
        for t, found in zip(("article", "main"), inner, strict=True):  # what the text lies in inside of an article
            if found is not None:
                out |= {f"{t}>{x}" for x in found}
                break
        else:
            out.add("no article")
            if not said and not _APART & tags:
                out.add("plain")
        self.features = tuple(sorted(out))

    def below(self, tag: str, kinds: frozenset) -> Place:
        """The place inside one more element."""
        more = frozenset([tag] if tag in _INNER else ()) | {f"is:{x}" for x in kinds}
        inner = tuple(found | more if found is not None else frozenset() if tag == t else None for t, found in zip(("article", "main"), self.inner, strict=True))
        return Place(self.tags | {tag}, self.said | kinds, tag if tag in BLOCKS else self.leaf, inner)


class Block:
    __slots__ = ("label", "linked", "place", "text")

    def __init__(self, text: str, place: Place, linked: int, label: str | None):
        self.text, self.place, self.linked, self.label = text, place, linked, label


class Stack:
    """Open elements. The last of each name, and of the blocks, is known without a search."""

    def __init__(self, root: Place):
        self.names: list[str] = []
        self.places, self.labels, self.scopes = [root], [None], [-1]  # the last of these: of the innermost element
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.links = 0

    def push(self, name: str, place: Place, label: str | None) -> None:
        here = len(self.names)
        self.names.append(name)
        self.places.append(place)
        self.labels.append(label or self.labels[-1])
        self.scopes.append(here if name == "p" else -1 if name in SCOPES else self.scopes[-1])
        self.at.setdefault(name, []).append(here)
        if name in BLOCKS:
            self.blocks.append(here)
        self.links += name == "a"

    def last(self, names) -> int:
        """Where the innermost open element of these names is, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, at: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.names) > at:
            name = self.names.pop()
            self.at[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            self.links -= name == "a"
            self.places.pop()
            self.labels.pop()
            self.scopes.pop()


class Reader:
    """Turns pages into leaf blocks and remembers what attributes and places say."""

    def __init__(self):
        self.root = Place()
        self.known: dict[str, tuple[frozenset, str | None]] = {}
        self.under: dict[tuple, Place] = {}

    def kinds(self, attributes: str) -> tuple[frozenset, str | None]:
        """What the class, id and role words say, and a training label; of an attribute that repeats, the first counts."""
        found = self.known.get(attributes)
        if found is None:
            out, label, seen = set(), None, set()
            for name, value in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name in ("class", "id", "role", "data-y") and name not in seen:
                    seen.add(name)
                    value = value[1:-1] if value[:1] in ("'", '"') else value
                    if name == "data-y":
                        label = value
                    else:
                        out |= {_WORD[t] for t in _TOKEN.findall(_CAMEL.sub(" ", value).lower()) if t in _WORD}
            found = frozenset(out), label
            if len(attributes) < 1000:
                self.known[attributes] = found
        return found

    def below(self, place: Place, tag: str, kinds: frozenset) -> Place:
        key = place, tag, kinds
        found = self.under.get(key)
        if found is None:
            found = place.below(tag, kinds)
            if (found.tags, found.said, found.leaf, found.inner) == (place.tags, place.said, place.leaf, place.inner):
                found = place  # one more of what is there already
            self.under[key] = found
        return found

    def blocks(self, page: str | None) -> list[Block]:
        """The leaf blocks of a page in order."""
        if len(self.under) > _MEMO or len(self.known) > _MEMO:
            self.under.clear()
            self.known.clear()
        out: list[Block] = []
        stack, text, linked = Stack(self.root), [], 0

        def cut() -> None:
            nonlocal linked
            if text:
                clean = " ".join(html.unescape("".join(text)).split())
                if clean:
                    out.append(Block(clean, stack.places[-1], linked, stack.labels[-1]))
                text.clear()
            linked = 0

        def parent_end(at: int) -> int:
            """Where the nearest open element with an end ends."""
            for tag in sorted((n for n, places in stack.at.items() if places and ("/", n) not in endless), key=lambda n: -stack.at[n][-1]):
                if end := re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at):
                    return end.start()
                endless.add(("/", tag))
            return len(page)

        endless: set = set()  # names of which no end follows
        page, at = page or "", 0
        while at < len(page):
            m = _TAG.search(page, at)
            if not m:
                text.append(page[at:])
                linked += (len(page) - at) * (stack.links > 0)
                break
            if m.start() > at:
                text.append(page[at : m.start()])
                linked += (m.start() - at) * (stack.links > 0)
            at = m.end()
            name = m[2] or m[5]
            if not name:
                if m[0].startswith("<![CDATA["):
                    text.append(m[0][9:-3] if m[0].endswith("]]>") and len(m[0]) >= 12 else m[0][9:])
                continue
            name, attributes = name.lower(), (m[3] or m[6] or "")
            if m[1] or m[4]:
                if name in BLOCKS:
                    cut()
                own = stack.last((name,))
                if own >= 0 and (name in BLOCKS or not stack.blocks or own > stack.blocks[-1]):
                    stack.close(own)
                continue
            if name in BLOCKS:
                cut()
            if name in SKIPPED:
                if not attributes.endswith("/"):
                    end = None if name in endless else _END[name].search(page, at)
                    at = end.end() if end else parent_end(at)
                    if not end:
                        endless.add(name)
                continue
            if name in VOID:
                continue
            if name in BLOCKS:
                over, within = CLOSES.get(name, ((), ()))
                if (own := stack.last(over)) > stack.last(within):
                    stack.close(own)
                if name != "button" and stack.scopes[-1] >= 0:  # a block ends an open paragraph
                    stack.close(stack.scopes[-1])
                if name in HEADINGS and stack.names and stack.names[-1] in HEADINGS:
                    stack.close(len(stack.names) - 1)
            kinds, label = self.kinds(attributes) if attributes else (frozenset(), None)
            stack.push(name, self.below(stack.places[-1], name, kinds), label)
        cut()
        return out

    def chain(self, page: str | None) -> tuple[list[Block], list[list[str]]]:
        found = self.blocks(page)
        return found, [features(b, i, len(found)) for i, b in enumerate(found)]

    def main_text(self, page: str | None, field: Field) -> str:
        found, chain = self.chain(page)
        return " ".join(b.text for b, s in zip(found, field.decode(chain), strict=True) if s)


def features(b: Block, at: int, of: int) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / max(len(b.text), 1)
    out = list(b.place.features)
    out.append("words:" + ("1" if words < 3 else "3" if words < 8 else "8" if words < 20 else "20"))
    out.append("links:" + ("0" if share < 0.1 else "1" if share < 0.5 else "2"))
    out.append("ends" if b.text[-1] in ".!?…。" else "open")
    if b.text[0] == "©":
        out.append("copyright")
    if at == 0:
        out.append("first")
    if at == of - 1:
        out.append("last")
    return out


class Field:
    """A linear-chain conditional random field of two states, 1 being content."""

    def __init__(self, names: dict[str, int], state: np.ndarray, move: np.ndarray):
        self.names, self.state, self.move = names, state, move
        self.rows = {n: (float(state[i, 0]), float(state[i, 1])) for n, i in names.items()}

    def decode(self, chain: list[list[str]]) -> list[int]:
        """The most likely states (Viterbi); of equals, 0."""
        (m00, m01), (m10, m11) = self.move.tolist()
        get, back, a, b = self.rows.get, [], 0.0, 0.0
        for i, f in enumerate(chain):
            e0 = e1 = 0.0
            for n in f:
                r = get(n)
                if r:
                    e0 += r[0]
                    e1 += r[1]
            if i:
                x, y = a + m00, b + m10
                z, w = a + m01, b + m11
                back.append((y > x, w > z))
                a, b = max(x, y) + e0, max(z, w) + e1
            else:
                a, b = e0, e1
        if not chain:
            return []
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def likelihood(state: np.ndarray, move: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of chains padded to one length, and its gradient: x (chains, steps, features), y states, real which steps there are."""
    score = x @ state  # chains, steps, 2
    n, t, _ = score.shape
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0]
    for i in range(1, t):
        a = np.logaddexp(alpha[:, i - 1, 0, None] + move[0], alpha[:, i - 1, 1, None] + move[1]) + score[:, i]
        alpha[:, i] = np.where(real[:, i, None], a, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        v = score[:, i + 1] + beta[:, i + 1]
        b = np.logaddexp(move[:, 0] + v[:, 0, None], move[:, 1] + v[:, 1, None])
        beta[:, i] = np.where(real[:, i + 1, None], b, 0.0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
    hot = np.eye(2)[y] * real[:, :, None]
    g_state = np.einsum("ntf,nts->fs", x, hot - p)
    pair = real[:, 1:, None, None] * np.exp(np.clip(alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - z[:, None, None, None], -700, 50))
    seen = np.einsum("nti,ntj->ij", hot[:, :-1] * real[:, 1:, None], hot[:, 1:])
    own = (score * hot).sum() + (seen * move).sum() - z.sum()
    return float(own), g_state, seen - pair.sum((0, 1))


def train(chains: list[tuple[list[list[str]], list[int]]], steps: int = 150, ridge: float = 0.5) -> Field:
    """The field of greatest penalised likelihood on labelled chains, by Adam from zero."""
    names = {n: i for i, n in enumerate(sorted({n for c, _ in chains for f in c for n in f}))}
    t = max(len(c) for c, _ in chains)
    x, y, real = np.zeros((len(chains), t, len(names))), np.zeros((len(chains), t), np.int64), np.zeros((len(chains), t), bool)
    for i, (c, labels) in enumerate(chains):
        real[i, : len(c)], y[i, : len(c)] = True, labels
        for j, f in enumerate(c):
            x[i, j, [names[n] for n in f]] = 1
    w = np.zeros(len(names) * 2 + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        _, a, b = likelihood(w[:-4].reshape(-1, 2), w[-4:].reshape(2, 2), x, y, real)
        g = np.concatenate([a.ravel(), b.ravel()]) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return Field(names, w[:-4].reshape(-1, 2), w[-4:].reshape(2, 2))


def labelled_pages(count: int = 320, seed: int = 5) -> Iterator[str]:
    """Pages built by rule, in which data-y tells content (1) from the rest (0)."""
    rnd = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rnd.choice("abcdefghiklmnoprstuv") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(lo, hi)))

    sentence = lambda: words(4, 30).capitalize() + rnd.choice(".....!?")
    link = lambda: f'<a href="/x">{words(1, 3)}</a>'
    named = lambda kind: rnd.choice(WORDS[kind].split())

    def box(kind: str, inner: str, tags=("div", "div", "section")) -> str:
        tag, name = rnd.choice(tags), named(kind)
        return f'<{tag} {rnd.choice(["class", "id", "class"])}="{rnd.choice([name, name, f"{name}-box", f"site-{name}"])}" data-y="0">{inner}</{tag}>'

    def prose(n: int) -> str:
        return "".join(rnd.choice([f"<p>{sentence()} {sentence()}</p>"] * 6 + [f"<p>{words(1, 3)}.</p>", f"<p><b>{sentence()}<br>", f"<h2>{words(1, 5)}</h2>", f"<ul><li>{sentence()}</li><li>{words(2, 6)}</li></ul>", f"<blockquote>{sentence()}</blockquote>", f"<p>{words(3, 9)} {link()} {words(3, 9)}.</p>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", f"<div>{sentence()}</div>"]) for _ in range(n))

    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 7))) + "</ul>"
    loose = lambda: rnd.choice([sentence(), f"<p>{sentence()}</p>", f"<p>{sentence()} {sentence()}</p>", link(), f"<h3>{words(1, 4)}</h3><p>{sentence()}</p>", menu()])
    form = lambda: f"<form data-y=\"0\"><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>{rnd.choice(['', f'<p>{sentence()}</p>'])}</form>"
    talk = lambda: "".join(f"<{t}>{x}</{t}>" for t in [rnd.choice(["p", "div", "li"])] for x in [sentence() for _ in range(rnd.randint(1, 4))])

    for _ in range(count):
        heads = [f'<nav data-y="0">{menu()}</nav>', box("menu", menu()), f'<header data-y="0">{rnd.choice([f"<h1>{words(1, 3)}</h1>", words(1, 4), f"<p>{sentence()}</p>", menu()])}</header>', box("head", loose()), box("note", loose()), box("ad", loose()), f'<!-- ad --><div class="ad" data-y="0">{sentence()}</div>', form(), f'<aside data-y="0">{loose()}</aside>', f'<dialog data-y="0">{loose()}</dialog>']
        tails = [f'<footer data-y="0">&copy; {words(1, 3)} &middot; {sentence()}</footer>', f'<footer data-y="0">{loose()}</footer>', box("foot", loose()), box("side", loose()), f'<aside data-y="0">{loose()}</aside>', box("talk", talk()), f'<section class="{named("talk")}" data-y="0"><h2>{words(1, 2)}</h2>{talk()}</section>', box("share", menu()), box("ad", loose()), box("form", form()), box("note", loose())]
        inside = [box("talk", talk()), box("ad", loose()), box("share", menu()), box("side", loose()), form(), f'<aside data-y="0">{loose()}</aside>', f'<nav data-y="0">{menu()}</nav>', f'<footer data-y="0">{words(1, 8)}</footer>', box("note", loose())]
        title = f"<h1>{words(2, 9)}</h1>"
        title = rnd.choice([title, title, title, f"<header>{title}</header>", ""])
        body = prose(rnd.randint(1, 12))
        if rnd.random() < 0.4:
            body = prose(rnd.randint(1, 4)) + rnd.choice(inside) + body
        if rnd.random() < 0.4:
            body += rnd.choice(inside)
        open_, close = rnd.choice([("<article data-y='1'>", "</article>")] * 3 + [("<main data-y='1'>", "</main>"), ("<main><article data-y='1'>", "</article></main>"), (f"<div class='{named('main')}' data-y='1'>", "</div>"), (f"<div id='{named('main')}' data-y='1'>", "</div>"), ("<div data-y='1'>", "</div>"), (f"<article class='{named('main')}' data-y='1'>", "</article>"), (f"<div class='wrap'><div class='{named('main')}' data-y='1'>", "</div></div>")])
        yield "<body>" + "".join(rnd.sample(heads, rnd.randint(0, 4))) + open_ + title + body + close + "".join(rnd.sample(tails, rnd.randint(0, 4))) + "</body>"


@lru_cache(4)
def default_field() -> Field:
    """The field of the built pages; only the driver trains it."""
    reader, chains = Reader(), []
    for page in labelled_pages():
        found, chain = reader.chain(page)
        if found:
            chains.append((chain, [int(b.label == "1") for b in found]))
    return train(chains)


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages (page_id, url, html)."""
    C.check_columns(pages, "page_id", "url", "html")
    field = field or default_field()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for f in frames:
            text = [reader.main_text(h, field) for h in f.html]
            yield f[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInPandas(each, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op10(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(C.table(spark, sf_dir, "pages"))
