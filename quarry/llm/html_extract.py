"""Main-text extraction with a tree-structured graphical model over the DOM.

Each block element is a node that is content or not. A node's evidence (tag, names in class and id, length of
its own text, share of links) has a likelihood under either state, and each child depends on its parent's
state by a potential for the child's kind of tag. One upward and one downward sum-product pass give exact
marginals; all pages of a batch go through together, a level of their trees at a time. The
potentials are smoothed counts over labelled pages; labelled_pages() makes those from a rule, with the usual
page furniture in many layouts, as the tables have no labels for pages.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style template iframe textarea select title annotation annotation-xml".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var noscript".split())
MATH = set("math maction menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
DRAWN = set("svg g path circle ellipse rect line polyline polygon text tspan textpath defs use symbol marker mask pattern filter lineargradient radialgradient stop clippath".split())
INLINE |= MATH | DRAWN | {"object"}
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": set()}
NEVER = {"head", "form", "button", "fieldset"}
GOOD = "article content main post entry story body text".split()
BAD = "nav menu header footer side aside ad ads advert banner promo sponsor cookie notice alert consent comment reply respond share social related widget login signup subscribe newsletter search breadcrumb pagination copyright tag meta".split()
TAGS = "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside address details".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_LABEL = re.compile(r'data-y="([01])"')
_PART = re.compile(r"[a-z]+")


class Page:
    """Nodes (parent, tag, names, label) and blocks of text (node, text), both in page order."""

    __slots__ = ("parent", "tag", "names", "label", "own", "linked", "blocks")

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.label, self.own, self.linked = [-1], ["html"], [""], [None], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("html", 0)]  # (tag, node it belongs to)
        opened: Counter[str] = Counter()  # open elements by tag
        text: list[str] = []
        links = quiet = at = 0  # open links, open noscripts

        def flush() -> None:
            if text:
                block = " ".join("".join(text).split())
                if block and stack[-1][1] >= 0:
                    self.blocks.append((stack[-1][1], block))
                text.clear()

        def close(k: int) -> None:
            nonlocal links, quiet
            if any(t not in INLINE for t, _ in stack[k:]):
                flush()
            for t, _ in stack[k:]:
                opened[t] -= 1
                links -= t == "a"
                quiet -= t == "noscript"
            del stack[k:]

        def enter(tag: str, node: int) -> None:
            stack.append((tag, node))
            opened[tag] += 1

        def say(raw: str) -> None:
            if raw:
                text.append(html.unescape(raw))
                if quiet:
                    return
                n = len(raw.strip())
                self.own[stack[-1][1]] += n
                if links > 0:
                    self.linked[stack[-1][1]] += n

        for m in _TOKEN.finditer(source):
            say(source[at : m.start()])
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if m[2]:
                for k in range(len(stack) - 1 if opened[tag] > 0 else 0, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                continue
            if tag in CLOSES_P and opened["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] not in INLINE or stack[k][0] == "noscript":
                        break
            if tag in SCOPES and (opened[tag] > 0 or tag in ("dt", "dd")):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag or (tag in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                        close(k)
                        break
                    if stack[k][0] in SCOPES[tag]:
                        break
            if tag in VOID:
                if tag in ("br", "hr", "img"):
                    text.append(" ")
                if tag == "hr":
                    flush()
                continue
            if tag in INLINE:
                if tag in ("mtr", "mtd"):
                    text.append(" ")
                if tag in MATH | DRAWN and m[4].rstrip().endswith("/"):
                    continue
                links += tag == "a"
                quiet += tag == "noscript"
                enter(tag, stack[-1][1])
                continue
            if tag == "html" and len(self.tag) == 1:
                continue
            flush()
            if quiet:  # stands or falls with the element around the noscript, of which it is no evidence
                enter(tag, -1 if tag in NEVER else stack[-1][1])
                continue
            label = _LABEL.search(m[4])
            self.parent.append(stack[-1][1])
            self.tag.append(tag)
            self.names.append(" ".join(x.strip("\"'").lower() for x in _NAME.findall(m[4])))
            self.label.append(int(label[1]) if label else None)
            self.own.append(0)
            self.linked.append(0)
            if not m[4].rstrip().endswith("/") or tag != "path":
                enter(tag, len(self.tag) - 1)
        say(source[at:])
        flush()


N_EVIDENCE = len(TAGS) + 1 + 2 + 2 + 4 + 2
_TAG = {t: k for k, t in enumerate(TAGS)}
_GOOD, _BAD = set(GOOD), set(BAD)


def _evidence(page: Page, k: int) -> list[int]:
    """Which of N_EVIDENCE values the node has: one of each kind."""
    base = len(TAGS) + 1
    parts = set(_PART.findall(page.names[k]))
    bad = bool(parts & _BAD)
    n = page.own[k]
    return [
        _TAG.get(page.tag[k], len(TAGS)),
        base + bool(parts & _GOOD and not bad),
        base + 2 + bad,
        base + 4 + (n > 0) + (n > 25) + (n > 80),
        base + 8 + (2 * page.linked[k] > n),
    ]


def _kind(tag: str) -> int:
    """Kinds of tags that a potential is kept for."""
    return _TAG.get(tag, len(TAGS))


class Potentials:
    """Log-likelihoods of evidence (state, value), log-potentials (kind, parent state, state), prior of the root."""

    def __init__(self, pages: list[Page]):
        seen = np.full((2, N_EVIDENCE), 0.3)
        edge = np.full((len(TAGS) + 1, 2, 2), 0.3)
        edge[:, 1, 1] += 1
        edge[:, 0, 0] += 1
        for page in pages:
            state: list[int] = []
            for k, own in enumerate(page.label):
                state.append(own if own is not None else state[page.parent[k]] if k else 0)
                seen[state[k], _evidence(page, k)] += 1
                if k:
                    edge[_kind(page.tag[k]), state[page.parent[k]], state[k]] += 1
        ends = np.cumsum([0, len(TAGS) + 1, 2, 2, 4, 2])
        for lo, hi in zip(ends[:-1], ends[1:]):
            seen[:, lo:hi] /= seen[:, lo:hi].sum(1, keepdims=True)
        self.seen, self.edge, self.prior = np.log(seen), np.log(edge / edge.sum(2, keepdims=True)), np.log([0.99, 0.01])


def labelled_pages(n: int = 300, seed: int = 5) -> list[Page]:
    """Pages in many layouts; data-y tells whether an element is content, children inherit it."""
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(k)) + "."
    link = lambda: f'<a href="/x">{words(rng.randint(1, 3))}</a>'
    items = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
    name = lambda *xs: (lambda x: rng.choice([f'class="{x}"', f'id="{x}"', f'class="site-{x}"', f'class="{x} wide"']))(rng.choice(xs))

    def noise(tag: str, names: tuple[str, ...], inner: str) -> str:
        use = tag if rng.random() < 0.6 else "div"
        attr = name(*names) if use == "div" or rng.random() < 0.5 else ""
        return f'<{use} {attr} data-y="0">{inner}</{use}>'

    def furniture() -> list[str]:
        return [
            noise("nav", ("nav", "menu", "breadcrumb"), items(rng.randint(3, 8))),
            noise("header", ("header", "banner"), f"<h1>{words(2)}</h1>" if rng.random() < 0.3 else f"<p>{words(3)}</p>"),
            noise("aside", ("sidebar aside", "widget", "related"), f"<h3>{words(2)}</h3>" + items(rng.randint(2, 6)) + (f"<p>{words(12)}</p>" if rng.random() < 0.4 else "")),
            noise("div", ("ad", "ads", "advert", "sponsor", "promo"), words(rng.randint(3, 20)) if rng.random() < 0.6 else f"<p>{words(rng.randint(3, 20))}</p>"),
            noise("div", ("cookie", "notice", "alert", "consent"), f"<p>{words(rng.randint(5, 25))}</p>"),
        ]

    pages = []
    for _ in range(n):
        body = []
        for _ in range(rng.randint(2, 14)):
            x = rng.random()
            body.append(
                f"<p>{words(rng.choice([1, 2, 4, 8, 20, 40, 80]))}</p>" if x < 0.72
                else f"<{'h' + str(k)}>{words(3)}</{'h' + str(k)}>" if (k := rng.randint(2, 4)) and x < 0.82
                else "<ul>" + "".join(f"<li>{words(rng.randint(2, 12))}</li>" for _ in range(4)) + "</ul>" if x < 0.88
                else f"<blockquote>{words(12)}</blockquote>" if x < 0.92
                else f"<table><tr><td>{words(2)}</td><td>{words(2)}</td></tr></table>" if x < 0.94
                else f"<div>{words(20)}</div>" if x < 0.96
                else rng.choice([noise("div", ("ad", "promo", "advert"), words(6)), noise("aside", ("related", "aside"), items(3)), noise("div", ("share", "social"), items(3))])
            )
        inner = (f"<h1>{words(5)}</h1>" if rng.random() < 0.8 else "") + "".join(body)
        if rng.random() < 0.3:
            inner += noise("section", ("comments", "comment list", "respond"), "".join(f"<div><p>{words(rng.randint(4, 30))}</p></div>" for _ in range(rng.randint(1, 5))))
        shape = rng.random()
        main = (
            f'<article data-y="1">{inner}</article>' if shape < 0.45
            else f'<main data-y="1">{inner}</main>' if shape < 0.6
            else f'<main data-y="0"><article data-y="1">{inner}</article></main>' if shape < 0.75
            else f'<div {name("content", "post", "entry", "article", "story")} data-y="1">{inner}</div>'
        )
        before = [x for x in furniture() if rng.random() < 0.6]
        after = [x for x in [*furniture()[2:], noise("section", ("comments", "comment"), "".join(f"<p>{words(rng.randint(4, 30))}</p>" for _ in range(3)))] if rng.random() < 0.4]
        after.append(noise("footer", ("footer", "copyright"), rng.choice([words(8), f"<p>{words(8)}</p>", items(4)])))
        rng.shuffle(before)
        whole = "".join(before) + main + "".join(after)
        pages.append(Page(f'<html data-y="0"><body>{f"<div>{whole}</div>" if rng.random() < 0.3 else whole}</body></html>'))
    return pages


@cache
def trained() -> Potentials:
    return Potentials(labelled_pages())


def marginals(pages: list[Page], model: Potentials) -> list[np.ndarray]:
    """Probability of each node of each page to be content."""
    at = np.cumsum([0] + [len(p.tag) for p in pages])
    parent = np.concatenate([np.array(p.parent) + a for p, a in zip(pages, at)])
    root = np.zeros(at[-1], bool)
    root[at[:-1]] = True
    kind = np.array([_kind(t) for p in pages for t in p.tag])
    evidence = np.array([_evidence(p, k) for p in pages for k in range(len(p.tag))])
    own = model.seen[:, evidence].sum(2).T
    own[np.array([t in NEVER for p in pages for t in p.tag])] += [0, -50]
    depth = np.zeros(at[-1], int)
    for k in np.flatnonzero(~root):
        depth[k] = depth[parent[k]] + 1
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
    up = own.copy()  # evidence of the subtree
    sent = np.zeros_like(own)
    for level in levels[:0:-1]:
        m = np.logaddexp(model.edge[kind[level], :, 0] + up[level, :1], model.edge[kind[level], :, 1] + up[level, 1:])
        sent[level] = m
        np.add.at(up, parent[level], m)
    belief = up.copy()
    belief[root] += model.prior
    for level in levels[1:]:
        rest = belief[parent[level]] - sent[level]
        down = np.logaddexp(model.edge[kind[level], 0] + rest[:, :1], model.edge[kind[level], 1] + rest[:, 1:])
        belief[level] = up[level] + down
        belief[level] -= np.logaddexp(belief[level, 0], belief[level, 1])[:, None]
    p = np.exp(belief[:, 1] - np.logaddexp(belief[:, 0], belief[:, 1]))
    return np.split(p, at[1:-1])


def main_texts(sources: list[str], model: Potentials | None = None) -> list[str]:
    if not sources:
        return []
    pages = [Page(s) for s in sources]
    return ["\n\n".join(t for k, t in page.blocks if p[k] >= 0.5) for page, p in zip(pages, marginals(pages, model or trained()))]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            texts = main_texts([x or "" for x in part.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "html"), pa.array(texts, pa.string())], [*(c for c in part.schema.names if c != "html"), "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the content blocks of each page in order, two newlines between.

    Character references are decoded, white space within a block is one space; a br counts as white space.
    Null or empty pages, and those without content, have an empty text. Unclosed and misnested elements are
    closed as browsers do; an unfinished tag at the end is markup. A formula in MathML is its text without its
    annotations, a drawing's text and what stands in for an object are text; controls of forms are not. A noscript's text counts if the element around it is content. Repeated rows give repeated rows, other columns
    are ignored, an empty table gives none.
    """
    own = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    kind = own.schema["id"].dataType.simpleString()
    out = own.mapInArrow(_extract, f"id {kind}, url {own.schema['url'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
