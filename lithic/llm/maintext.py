"""Main text of web pages as a maximum-scoring subsequence.

A page is read once into elements, tags and runs of words. A run has signs: the kind of block it stands in, how many
words that block has and how many of them are links, whether an article or main element holds it, and what the elements
around it say of themselves (tags such as nav or form, words of a class, id or role that speak of adverts, menus or
comments, the hidden attribute), each by the share of the page's words that the element holds. A logistic regression on
labelled pages gives each sign a weight; a run's words score their sum. So words of main text score positive, words of
other things negative, and block tags cost a fixed price, chosen on the same pages. One linear scan finds the contiguous
region with the largest sum; of its runs, those that score positive are the text.

No sign decides by itself, but three things are never text: what browsers don't show as text (script, style, head and the
like), comments, and markup. A sign around an article or main element, or around a page's h1 and much of its text, says
nothing of what is inside; a header inside an article is the article's own.

Cases: null and empty html give an empty text, as do pages without any word that scores positive; unclosed and cut tags
end with the page; character references without a semicolon are decoded as browsers do; quotes enclose an attribute's
value only after its equals sign, so that a stray one doesn't swallow what follows; ties go to the region that starts
first. Blocks are joined by a line feed; white space in a block is one space. Long pages are read whole, in one pass;
repeated rows are each read; an empty table gives an empty one; other columns keep their names inside ``row``.
"""

from __future__ import annotations

import functools
import html as html_
import random
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import annotate, table

# HTML element names by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
ASIDE = {"nav": "nav", "footer": "footer", "aside": "aside", "form": "form", "header": "header", **dict.fromkeys("button select textarea dialog menu".split(), "control")}
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 hgroup header footer nav aside form fieldset ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hr menu dialog center".split()
)
#: Words of a class, id or role that mark an element as something else than the article.
SIGNS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar side rail widget menu menus nav navbar navigation navigate breadcrumb breadcrumbs pagination pager masthead header footer foot copyright legal disclaimer comment comments commentlist disqus reply replies respond discussion related recommended recommendations search toolbar complementary contentinfo form".split()
)
ARTICLE = frozenset("article main".split())
#: Elements whose end tag may be left out, and the elements that close them when they open.
ENDED_BY = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": BLOCK - {"html"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
_NAME = re.compile(r"[^\s]+")
_PART = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Part of the page's words beyond which a sign around its h1 says nothing.
MUCH = 0.3

METRICS = T.StructType([T.StructField("text", T.StringType())])


class Element(NamedTuple):
    name: str
    parent: int
    says: frozenset[str]  # what its own tag and attributes say
    shown: bool
    article: bool  # it is an article or main element, or inside one


class Run(NamedTuple):
    element: int
    block: int
    text: str
    words: int
    link: bool
    tags: int  # block tags since the run before


class Page(NamedTuple):
    elements: list[Element]
    holds: list[float]  # share of the page's words
    around: list[bool]  # an article or main element, or the page's h1 and much of its text, is inside
    runs: list[Run]


def says(attributes: str) -> frozenset[str]:
    """What attributes say of their element: a sign where a name's last word is one or all are, else a part of one."""
    out = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and value.lower() not in ("false", "until-found") or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NOT_SHOWN.search(value):
            out.add("hidden")
        elif name in ("class", "id", "role"):
            for whole in _NAME.findall(value):
                parts = [x.lower() for part in _PART.findall(whole) for x in _CAMEL.split(part)]
                found = [x for x in parts if x in SIGNS]
                if found:
                    strong = parts[-1] in SIGNS and parts[0] not in ("has", "with", "no", "without", "not") or len(found) == len(parts)
                    out.add("header sign" if set(found) == {"header"} else "sign" if strong else "part sign")
    return frozenset(out)


def read(page: str) -> Page:
    elements: list[Element] = [Element("", -1, frozenset(), True, False)]
    first, last = [0], [0]  # words before an element, and at its end
    runs: list[Run] = []
    stack, marks = [0], []  # marks: elements that hold an article or main element, or an h1
    words = block = tags = links = at = 0

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            i = stack.pop()
            last[i] = words
            links -= elements[i].name == "a"

    def text(raw: str, n: int) -> None:
        nonlocal words, tags
        if elements[stack[-1]].shown:
            runs.append(Run(stack[-1], block, raw, n, links > 0, tags))
            tags = 0
            words += n

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            text(raw, len(raw.split()))
        at, name = m.end(), (m[3] or "").lower()
        if not name:  # comments, declarations, and elements whose content is no text
            continue
        if name in BLOCK:
            block += 1
            tags += 1
        if name == "br":
            text(" ", 0)
        if m[2]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].name == name), 0)
            if k:
                close(k)
            continue
        while elements[stack[-1]].name in ENDED_BY and name in ENDED_BY[elements[stack[-1]].name]:
            close(len(stack) - 1)
        if name == "a" and links:  # links don't nest: an unclosed one ends here
            close(next(k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].name == "a"))
        attributes = m[4] or ""
        if name in ARTICLE or name == "h1":
            marks.append((name, list(stack)))
        if name in VOID or attributes.rstrip().endswith("/") and not re.search(r"=\s*[^\s\"']*/$", attributes.rstrip()):
            continue
        above = elements[stack[-1]]
        own = says(attributes) if attributes and name not in ("html", "body") and name not in ARTICLE else frozenset()
        if name in ASIDE:
            own |= {ASIDE[name]}
        if above.article:
            own -= {"header", "header sign"}
        links += name == "a"
        stack.append(len(elements))
        elements.append(Element(name, stack[-2], own, above.shown and name not in HIDDEN, above.article or name in ARTICLE))
        first.append(words)
        last.append(0)
    if at < len(page):
        raw = page[at:]
        text(raw, len(raw.split()))
    close(0)
    holds = [(b - a) / max(1, words) for a, b in zip(first, last, strict=True)]
    around = [False] * len(elements)
    for name, above in marks:
        for i in above:
            around[i] |= name in ARTICLE or holds[i] >= MUCH
    return Page(elements, holds, around, runs)


def _step(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def signs_of(page: Page) -> list[frozenset[str]]:
    """The signs of each run."""
    about: list[frozenset[str]] = []
    blocks: list[str] = []
    for e, holds, around in zip(page.elements, page.holds, page.around, strict=True):
        own = frozenset() if around else frozenset(f"{s} {_step(holds, (0.4, 0.8))}" for s in e.says)
        about.append((about[e.parent] if e.parent >= 0 else frozenset()) | own)
        blocks.append(e.name if e.name in BLOCK else blocks[e.parent] if e.parent >= 0 else "none")
    words: dict[int, int] = {}
    linked: dict[int, int] = {}
    for r in page.runs:
        words[r.block] = words.get(r.block, 0) + r.words
        linked[r.block] = linked.get(r.block, 0) + r.words * r.link
    made: dict[tuple, frozenset[str]] = {}
    out = []
    for r in page.runs:
        n = words[r.block]
        key = (r.element, _step(n, (3, 8, 20, 60)), _step(linked[r.block] / max(1, n), (0.35, 0.8)))
        if key not in made:
            inside = page.elements[r.element].article
            made[key] = about[r.element] | {"any", f"block {blocks[r.element]}", f"words {key[1]}", f"links {key[2]} {'in' if inside else 'outside'} an article", *(("article",) if inside else ())}
        out.append(made[key])
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum; (0, 0) if there is none."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


class Weights(NamedTuple):
    signs: dict[str, float]
    price: float  # of a block tag
    most: float  # what a run can cost: the longest advert in an article can't cut it in two

    def word(self, signs: frozenset[str]) -> float:
        return max(-4.0, min(4.0, sum(self.signs.get(s, 0.0) for s in signs)))


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    got = read(page)
    score: dict[frozenset[str], float] = {}
    each = [score[s] if s in score else score.setdefault(s, weights.word(s)) for s in signs_of(got)]
    line: list[float] = []
    for r, s in zip(got.runs, each, strict=True):
        line += (-weights.price * r.tags, max(s * r.words, -weights.most))
    start, end = region(line)
    blocks: dict[int, list[str]] = {}
    for r, s in zip(got.runs[start // 2 : (end + 1) // 2], each[start // 2 : (end + 1) // 2], strict=True):
        if s > 0 or not r.words:
            blocks.setdefault(r.block, []).append(r.text)
    return "\n".join(b for b in (" ".join(html_.unescape("".join(x)).split()) for x in blocks.values()) if b)


class Shape(NamedTuple):
    """Labelled pages of one kind, written for this purpose: what stands around the article, and what beside and in it."""

    name: str
    around: tuple[str, str]
    title: str = "h1"


SHAPES = [
    Shape("article", ("<article>", "</article>")),
    Shape("main", ("<main>", "</main>")),
    Shape("role", ('<div role="main">', "</div>")),
    Shape("post", ('<div class="post">', "</div>")),
    Shape("plain div", ("<div>", "</div>")),
    Shape("untitled div", ("<div>", "</div>"), ""),
    Shape("section", ('<section id="content">', "</section>"), "h2"),
    Shape("table", ("<table><tr><td>", "</td></tr></table>")),
    Shape("body", ("", "")),
    Shape("sidebar beside", ('<div class="page has-sidebar"><article>', "</article></div>")),
    Shape("sidebar layout", ('<div class="col-9 with-sidebar">', "</div>")),
    Shape("untitled sidebar layout", ('<div class="col-9 with-sidebar">', "</div>"), "h2"),
    Shape("overflow", ('<div class="overflow-hidden" style="overflow:hidden"><div>', "</div></div>")),
    Shape("share wrapper", ('<div class="share-wrapper">', "</div>")),
    Shape("search result", ('<div id=content class="search-result">', "</div>"), "h2"),
    Shape("page form", ('<form action="/"><div>', "</div></form>")),
    Shape("untitled page form", ('<form id="form1"><div class="text">', "</div></form>"), "h2"),
    Shape("article in an aside", ('<div class="sidebar-layout"><div class="content-with-ads"><article>', "</article></div></div>")),
]


def labelled_pages(shape: Shape, n: int = 14) -> list[tuple[str, str]]:
    """(page, main text). Words that aren't main text begin with z, which no sign sees."""
    draw = random.Random(shape.name)
    known = "stone river light under the old bridge runs slowly and people of town come here in summer to talk about what they saw".split()

    def prose(least: int, most: int, z: str = "") -> str:
        return z + f" {z}".join(draw.choice(known) for _ in range(draw.randint(least, most))) + "."

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{prose(1, 2, "z")}</a></li>' for k in range(n))

    before = [
        lambda: f"<nav><ul>{links(6)}</ul></nav>",
        lambda: f'<div class="ad">{prose(5, 15, "z")}</div>',
        lambda: f"<header><h1>{prose(1, 4, 'z')}</h1><p>{prose(3, 9, 'z')}</p></header>",
        lambda: f'<div id="header"><div class="logo">{prose(1, 3, "z")}</div></div>',
        lambda: f'<div id="cookie-notice">{prose(8, 30, "z")}<button>zok</button></div>',
        lambda: f'<ul class="menu">{links(8)}</ul>',
        lambda: f'<div class="top-menu"><a href=/>zhome</a> <a href=/a>zabout</a> <a href=/b>znews</a></div>',
        lambda: f'<div class="breadcrumbs"><a href=/>zhome</a> &gt; <a href=/x>zx</a></div>',
        lambda: f"<div><p>{prose(2, 5, 'z')} <a href=/x>{prose(2, 4, 'z')}</a></p></div>",
    ]
    after = [
        lambda: f"<footer>&copy; {prose(3, 30, 'z')}</footer>",
        lambda: f'<div id="footer"><p>{prose(3, 30, "z")}</p></div>',
        lambda: f'<section class="comments"><h2>zcomments</h2><p>{prose(5, 60, "z")}</p><p>{prose(5, 60, "z")}</p></section>',
        lambda: f'<div id="comments"><ol class="commentlist">{"".join(f"<li><p>{prose(4, 50, "z")}</p></li>" for _ in range(draw.randint(1, 4)))}</ol></div>',
        lambda: f'<aside class="sidebar"><ul>{links(5)}</ul></aside>',
        lambda: f'<div class="sidebar"><h3>{prose(1, 3, "z")}</h3><p>{prose(5, 40, "z")}</p></div>',
        lambda: f"<form><input name=q><label>{prose(2, 5, 'z')}</label><button>zgo</button></form>",
        lambda: f'<div class="related-posts"><ul>{links(4)}</ul></div>',
        lambda: f'<div class="newsletter"><p>{prose(5, 20, "z")}</p></div>',
    ]
    inner = [
        lambda: f'<div class="advert">{prose(4, 40, "z")}</div>',
        lambda: f'<div class="share-buttons"><a href=/s>zshare</a><a href=/t>zpost</a></div>',
        lambda: f"<aside><p>{prose(4, 40, 'z')}</p></aside>",
        lambda: f'<div class="notice">{prose(4, 12, "z")}</div>',
        lambda: f'<p hidden>{prose(4, 12, "z")}</p>',
        lambda: f"<form><p>{prose(4, 12, 'z')}</p><button>zgo</button></form>",
    ]
    kinds = [
        lambda t: (f"<p>{t}</p>", t),
        lambda t: (f"<p>{t.replace('river', '<b>river</b>').replace('town', '<a href=/t>town</a>')}", t),
        lambda t: (f"<blockquote>{t}</blockquote>", t),
        lambda t: (f'<div class="text">{t}</div>', t),
        lambda t: ("<ul>" + "".join(f"<li>{x}</li>" for x in t.split(" and ")) + "</ul>", "\n".join(t.split(" and "))),
        lambda t: (f"<table><tr><td>{t}</td></tr></table>", t),
        lambda t: (f"<pre>{t}</pre>", t),
        lambda t: (f"<h3>{' '.join(t.split()[:4])}</h3><p>{t}</p>", f"{' '.join(t.split()[:4])}\n{t}"),
        lambda t: (f"<figure><img src=x><figcaption>{t}</figcaption></figure>", t),
        lambda t: (f"{t.split('.')[0]}<br>{t}", f"{t.split('.')[0]} {t}"),
    ]
    out = []
    for k in range(n):
        title, html, text = prose(1, 8) if shape.title else "", "", []
        if title:
            html, text = (f"<{shape.title}>{title}</{shape.title}>" if k % 3 or "<article>" not in shape.around[0] else f"<header><h1>{title}</h1></header>"), [title]
        for i in range(draw.randint(2, 7)):
            kind = kinds[0] if i < 1 or draw.random() < 0.6 else draw.choice(kinds[1:-1])
            part, said = kind(prose(2, 12) if draw.random() < 0.25 else prose(12, 80))
            html += part
            text.append(said)
            if draw.random() < 0.25:
                html += draw.choice(inner)()
        tail = draw.choice(after)() if draw.random() < 0.3 and shape.around[0] else ""
        page = "".join(f() for f in draw.sample(before, draw.randint(0, 3))) + shape.around[0] + html + tail + shape.around[1] + "".join(f() for f in draw.sample(after, draw.randint(0, 3)))
        out.append((f"<!DOCTYPE html><html><head><title>z{title}</title><style>p{{}}</style></head><body>{page}</body></html>", "\n".join(text)))
    return out


def learn(pages: list[tuple[str, str]]) -> Weights:
    """Weights by logistic regression over the runs of labelled pages; price and most cost by whole pages."""
    rows: dict[tuple[frozenset[str], bool], float] = {}
    for page, _ in pages:
        got = read(page)
        for r, s in zip(got.runs, signs_of(got), strict=True):
            if r.words:
                key = (s, not r.text.lstrip(" &copygt;").startswith("z"))
                rows[key] = rows.get(key, 0.0) + r.words**0.5
    names = sorted({x for s, _ in rows for x in s})
    x = np.array([[n in s for n in names] for s, _ in rows], float)
    y, w = np.array([inside for _, inside in rows], float), np.array(list(rows.values()))
    beta, ridge = np.zeros(len(names)), 0.5 * np.eye(len(names))
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step
    signs = dict(zip(names, beta.tolist(), strict=True))
    made = [Weights(signs, price, most) for price in (0.02, 0.05, 0.1, 0.2, 0.4) for most in (1.0, 3.0, 10.0, 40.0)]
    return max(made, key=lambda v: (sum(extract(p, v) == t for p, t in pages), v.price))


@functools.lru_cache(1)
def default_weights() -> Weights:
    return learn([p for s in SHAPES for p in labelled_pages(s)])


def main_text(pages: DataFrame, html: str = "html", weights: Weights | None = None, keep: list[str] | None = None) -> DataFrame:
    """pages as column ``row``, and ``m``: text. No shuffle."""
    known = weights or default_weights()

    def run(texts):
        return [[extract(t.decode("utf-8", "replace") if t else "", known) for t in texts]]

    return annotate(pages, html, run, METRICS, keep)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", F.col("m.text").alias("text"), F.length("m.text").cast("long").alias("n_chars"))
