"""Main text of web pages: a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements with its runs of text as leaves. Every node is either part of the article or not. What a
node looks like (tag, words of its class, id, role and label; a leaf's length, share of links and end) speaks for one or the other,
and a potential between parent and child says how likely article passes into article. Sum-product message passing, once upward and
once downward, gives every leaf's exact marginal; leaves above one half are the text.

Both kinds of potentials are counted on labelled pages: ``labelled_pages`` composes ``TRAINING_PAGES`` of them from labelled parts and
is the documented bound of what the model is fitted on. Pages are read and judged one by one, wherever Spark puts them.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import small_batches

TRAINING_PAGES = 800
RARE = 8
"""A feature of fewer nodes than this says nothing."""
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements by the way they are read.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = set("canvas datalist iframe math noembed noframes noscript object script select style svg template textarea title video audio button".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in ("script", "style", "textarea", "title")}
"""Elements whose content is text up to their end tag, or else up to the end of the page; other unseen elements end with their parent."""
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
KEEPS_P = set("body html head".split())


class Page:
    """Nodes in document order: parent, kind, attributes; leaves also have their text and its characters inside links."""

    def __init__(self, html: str) -> None:
        self.parent, self.kind, self.attrs = [-1], ["#root"], [""]
        self.text: dict[int, str] = {}
        self.linked: dict[int, int] = {}
        self._open = [0]
        self._run: list[str] = []
        self._in_link, self._link_chars = False, 0
        self._unseen: list[str] = []
        self._parse(html)

    def _add(self, kind: str, attrs: str) -> int:
        self.parent.append(self._open[-1])
        self.kind.append(kind)
        self.attrs.append(attrs)
        return len(self.kind) - 1

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self._run)).split()) if self._run else ""
        if text:
            leaf = self._add("#text", "")
            self.text[leaf], self.linked[leaf] = text, self._link_chars
        self._run, self._link_chars = [], 0

    def _close(self, kinds: set[str], walls: set[str]) -> None:
        """Close the innermost open element of ``kinds``, unless one of ``walls`` lies around it."""
        for depth in range(len(self._open) - 1, 0, -1):
            kind = self.kind[self._open[depth]]
            if kind in kinds:
                del self._open[depth:]
                return
            if kind in walls:
                return

    def _words(self, text: str) -> None:
        if text and not self._unseen:
            self._run.append(text)
            if self._in_link:
                self._link_chars += len(text.strip())

    def _skipped(self, name: str, attrs: str, ending: bool) -> bool:
        """Whether a tag belongs to an open unseen element; ``_unseen`` has that element and those open inside it."""
        if name in UNSEEN and not ending:
            if not attrs.endswith("/"):
                self._unseen.append(name)
            return True
        if not self._unseen:
            return name in UNSEEN
        if ending and name in self._unseen:
            last = len(self._unseen) - 1 - self._unseen[::-1].index(name)
            del self._unseen[last:]
            return True
        around = self._in_link if name == "a" else name in (self.kind[i] for i in self._open[1:])
        if ending and around or name == "body":
            self._unseen = []  # an element around it ends, and so does what was left open
            return False
        if not ending and name not in VOID and (name in BLOCK or name == "a"):
            self._unseen.append(name)
        return True

    def _parse(self, html: str) -> None:
        at = 0
        while (m := TOKEN.search(html, at)) is not None:
            self._words(html[at:m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            attrs, ending = m[3] if m[2] else m[6], bool(m[1] or m[4])
            if name in RAW:
                if not ending and not attrs.endswith("/"):
                    stop = RAW[name].search(html, at)
                    at = stop.start() if stop else len(html)
                continue
            if self._skipped(name, attrs, ending):
                continue
            if name not in BLOCK:
                if name == "a":
                    self._in_link = not ending
                elif name in ("br", "wbr", "img", "input"):
                    self._run.append(" " if name != "wbr" else "")
                continue
            self._flush()
            self._in_link = False
            if ending:
                self._close({name}, set())
                continue
            if name not in KEEPS_P:
                self._close({"p"}, {"td", "th", "table", "li", "div", "section", "article", "main", "body"})
            if name in CLOSES:
                self._close(CLOSES[name], SCOPE[name])
            if name in ("html", "body", "head"):
                if name == "body":
                    self._close({"head"}, set())
                if name in (self.kind[i] for i in self._open):
                    continue
            node = self._add(name, attrs)
            if name not in VOID:
                self._open.append(node)
        rest = html[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page ends in
        self._words(rest[:cut.start()] if cut else rest)
        self._flush()


def features(page: Page) -> list[list[str]]:
    """What speaks for each node."""
    out = []
    for i, kind in enumerate(page.kind):
        if kind == "#text":
            text = page.text[i]
            n = len(text)
            size = 0 if n < 8 else 1 if n < 25 else 2 if n < 80 else 3 if n < 200 else 4
            links = page.linked[i] / n
            out.append([f"size {size}", f"links {0 if links < 0.1 else 1 if links < 0.6 else 2}", f"end {text[-1] in '.!?…:;。！？\"”»'}"])
        else:
            found = [f"tag {kind}"]
            attrs = page.attrs[i]
            if attrs:
                words = {w.lower() for m in NAMED.finditer(attrs) for w in PART.findall(m[1] or m[2] or m[3] or "")}
                found += [f"word {w}" for w in sorted(words)]
                if HIDDEN.search(attrs):
                    found.append("hidden")
            out.append(found)
    return out


class Model:
    """Potentials: a log-ratio for each feature, and the chance of article below article and below the rest.

    The chances are two pairs: for an only child, which has what its parent has, and for one of several.
    """

    def __init__(self, weight: dict[str, float], passes: list[tuple[float, float]]) -> None:
        self.weight, self.passes = weight, passes

    @classmethod
    def fit(cls, labelled: list[tuple[Page, set[int]]], prior: float = 0.5) -> Model:
        """From pages and the leaves that are text of the article; an element is article if any leaf below it is."""
        seen = (Counter(), Counter())
        nodes, edges = [0, 0], [[[prior, prior], [1e-6, 1.0]] for _ in range(2)]
        for page, leaves in labelled:
            label = [False] * len(page.kind)
            for i in leaves:
                while i >= 0 and not label[i]:
                    label[i], i = True, page.parent[i]
            siblings = Counter(page.parent)
            for i, found in enumerate(features(page)):
                nodes[label[i]] += 1
                seen[label[i]].update(found)
                if i:
                    parent = page.parent[i]
                    edges[siblings[parent] > 1][0 if label[parent] else 1][0 if label[i] else 1] += 1
        weight = {}
        for f in seen[0].keys() | seen[1].keys():
            if seen[0][f] + seen[1][f] < RARE:
                continue
            if f.startswith("word "):
                # Presence of a word against its rate among nodes of either label.
                p, q = (seen[1][f] + prior) / (nodes[1] + 2 * prior), (seen[0][f] + prior) / (nodes[0] + 2 * prior)
                weight[f] = log(p / q)
            else:
                p, q = (seen[1][f] + prior) / (nodes[1] + 20 * prior), (seen[0][f] + prior) / (nodes[0] + 20 * prior)
                weight[f] = log(p / q)
        return cls(weight, [(a[0] / sum(a), b[0] / sum(b)) for a, b in edges])

    def marginals(self, page: Page) -> list[float]:
        """Each node's probability of being article, by one upward and one downward pass."""
        n, get = len(page.kind), self.weight.get
        siblings = Counter(page.parent)
        chance = [self.passes[siblings[p] > 1] for p in page.parent]
        up1, up0, msg1, msg0 = [1.0] * n, [1.0] * n, [1.0] * n, [1.0] * n
        for i, found in enumerate(features(page)):
            ratio = sum(get(f, 0.0) for f in found)
            up1[i] = exp(max(-30.0, min(30.0, ratio)))
        for i in range(n - 1, 0, -1):
            (inside, below), a, b = chance[i], up1[i], up0[i]
            to1, to0 = inside * a + (1 - inside) * b, below * a + (1 - below) * b
            total = to1 + to0
            msg1[i], msg0[i] = to1 / total, to0 / total
            p = page.parent[i]
            a, b = up1[p] * msg1[i], up0[p] * msg0[i]
            up1[p], up0[p] = (a, b) if 1e-200 < a + b < 1e200 else (a / (a + b), b / (a + b))
        out, down1, down0 = [0.0] * n, [1.0] * n, [1.0] * n
        for i in range(n):
            if i:
                p, (inside, below) = page.parent[i], chance[i]
                # What the parent knows without this child.
                a, b = up1[p] * down1[p] / msg1[i], up0[p] * down0[p] / msg0[i]
                total = a + b
                a, b = a / total, b / total
                down1[i], down0[i] = inside * a + below * b, (1 - inside) * a + (1 - below) * b
            a, b = up1[i] * down1[i], up0[i] * down0[i]
            out[i] = a / (a + b)
        return out

    def text(self, html: str) -> str:
        page = Page(html)
        belief = self.marginals(page)
        return "\n".join(page.text[i] for i in page.text if belief[i] > 0.5)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[Page, set[int]]]:
    """Pages composed of labelled parts: the parts of an article, and all that stands around or inside it without being part of it.

    Article text is marked by a leading word, which is taken off again before anything is counted.
    """
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    mark = "\x02"

    def words(low: int, high: int, end: str = "") -> str:
        return " ".join(rnd.choices(vocabulary, k=rnd.randint(low, high))) + end

    def main(low: int, high: int) -> str:
        text = words(low, high, rnd.choice([".", ".", ".", "?", "", "!"]))
        if rnd.random() < 0.15:
            text += f" <a href='/{rnd.choice(vocabulary)}'>{words(1, 4)}</a>" + rnd.choice([" " + words(1, 20, "."), ".", ""])
        return mark + text

    def links(n: int, of: str = "li") -> str:
        return "".join(f"<{of}><a href='/{rnd.choice(vocabulary)}'>{words(1, 3)}</a></{of}>" for _ in range(n))

    def named(*names: str) -> str:
        if rnd.random() < 0.15:
            return ""
        return rnd.choice([f' class="{{}}"', f' id="{{}}"', f' class="{{}}-{rnd.choice(["box", "wrap", "block", "inner"])}"', ' class="{} {}"']).replace("{} {}", f"{rnd.choice(vocabulary)} {rnd.choice(names)}").replace("{}", rnd.choice(names))

    def around() -> list[str]:
        """Parts that are not the article."""
        para = rnd.choice(["p", "div", "span", ""])
        said = words(2, 25, rnd.choice([".", ""]))
        said = f"<{para}>{said}</{para}>" if para else said
        return [
            f"<nav{named('nav', 'menu', 'navigation', 'navbar')}><ul>{links(rnd.randint(3, 9))}</ul></nav>",
            f"<div{named('menu', 'nav', 'navigation', 'topbar', 'breadcrumb', 'breadcrumbs')}>{links(rnd.randint(2, 8), rnd.choice(['li', 'span', 'div']))}</div>",
            f"<header{named('header', 'masthead', 'site', 'banner', 'top')}>{rnd.choice(['', '<h1>' + words(1, 4) + '</h1>'])}{said}</header>",
            f"<div class='{rnd.choice(['header', 'masthead', 'banner', 'page-header', 'site-header'])}'>{said}</div>",
            f"<aside{named('sidebar', 'aside', 'related', 'widget')}><h3>{words(1, 3)}</h3><ul>{links(rnd.randint(2, 6))}</ul>{said}</aside>",
            f"<div class='{rnd.choice(['sidebar', 'side', 'widget', 'related', 'recommended', 'promo', 'rail'])}'><h3>{words(1, 3)}</h3>{said}{links(2, 'p')}</div>",
            f"<div class='{rnd.choice(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'sponsor', 'promo', 'banner'])}'>{said}</div>",
            f"<div{named('ad', 'ads', 'advert', 'sponsored')}><p>{words(3, 20, '.')}</p></div>",
            f"<div class='{rnd.choice(['cookie', 'cookies', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal', 'overlay', 'disclaimer', 'privacy'])}'>{said}</div>",
            f"<section class='{rnd.choice(['notice', 'cookie-notice', 'newsletter', 'subscribe', 'signup', 'paywall', 'cookie-banner'])}'><p>{words(4, 30, '.')}</p></section>",
            f"<form{named('search', 'login', 'newsletter', 'subscribe', 'form')}><label>{words(1, 4)}</label><input><p>{words(2, 12, '.')}</p></form>",
            f"<section{named('comments', 'comment', 'discussion', 'replies', 'respond')}><h2>{words(1, 2)}</h2>" + "".join(
                f"<{(t := rnd.choice(['div', 'li', 'div', 'li', 'div', 'article']))} class='{rnd.choice(['comment', 'reply', 'comment-body'])}'><p>{words(3, 40, '.')}</p></{t}>" for _ in range(rnd.randint(1, 4))) + "</section>",
            f"<div class='{rnd.choice(['comments', 'comment-list', 'discussion', 'replies', 'disqus'])}'>" + "".join(f"<p>{words(4, 40, '.')}</p>" for _ in range(rnd.randint(1, 4))) + "</div>",
            f"<div class='{rnd.choice(['share', 'social', 'tags', 'meta', 'byline', 'pagination', 'pager', 'toolbar'])}'>{links(3, 'span')}{words(1, 6)}</div>",
            f"<footer{named('footer', 'bottom', 'copyright')}>{said}{rnd.choice(['', '&copy; ' + words(2, 12, '.')])}</footer>",
            f"<div class='{rnd.choice(['footer', 'copyright', 'legal', 'site-footer', 'page-footer'])}'>&copy; {words(2, 20, '.')}</div>",
        ]

    def article() -> list[str]:
        """Parts of the article."""
        def part() -> str:
            kind = rnd.random()
            if kind < 0.7:
                return f"<p>{main(1, rnd.choice([2, 4, 8, 15, 40, 90]))}</p>"
            if kind < 0.78:
                return f"<{(h := rnd.choice(['h2', 'h3', 'h4']))}>{mark}{words(1, 8)}</{h}>"
            if kind < 0.85:
                return f"<{(u := rnd.choice(['ul', 'ol']))}>" + "".join(f"<li>{main(2, 20)}</li>" for _ in range(rnd.randint(2, 5))) + f"</{u}>"
            if kind < 0.9:
                return f"<blockquote><p>{main(4, 40)}</p></blockquote>"
            if kind < 0.94:
                return f"<table><tr><td>{mark}{words(1, 4)}</td><td>{mark}{words(1, 4)}</td></tr></table>"
            return rnd.choice([f"<pre>{mark}{words(3, 30)}</pre>", f"<div>{main(5, 60)}</div>", f"<figure><figcaption>{main(3, 15)}</figcaption></figure>"])

        parts = [part() for _ in range(rnd.randint(1, 14))]
        if rnd.random() < 0.8:
            head = f"<h1>{mark}{words(1, 12)}</h1>"
            parts.insert(0, rnd.choice([head, head, f"<header>{head}</header>"]))
        return parts

    out = []
    for _ in range(count):
        parts = article()
        for extra in rnd.sample(around(), rnd.choice([0, 0, 1, 2])):
            if not extra.startswith(("<header", "<footer", "<nav")):
                parts.insert(rnd.randint(1, len(parts)), extra)
        open_, close = rnd.choice([
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article class='post'>", "</article></main>"), ("<main>", "</main>"),
            ("<div class='content'>", "</div>"), ("<div id='main-content'><div class='entry-content'>", "</div></div>"), ("<div class='post-body'>", "</div>"),
            ("<section class='article story'>", "</section>"), ("<div class='text'>", "</div>"), ("<div>", "</div>"), ("", "")])
        every = around()
        before = rnd.sample([x for x in every if "footer" not in x], rnd.randint(0, 4))
        after = rnd.sample([x for x in every if not x.startswith(("<nav", "<header"))], rnd.randint(0, 4))
        if rnd.random() < 0.06:
            open_, parts, close = "", [], ""  # a page without an article
        page = Page("<html><body>" + "".join(before) + open_ + "".join(parts) + close + "".join(after) + "</body></html>")
        leaves = {i for i, t in page.text.items() if t.startswith(mark)}
        page.text = {i: t.removeprefix(mark) for i, t in page.text.items()}
        out.append((page, leaves))
    return out


def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but ``html``, and ``text`` and ``n_chars`` (replacing columns of these names), a row per row.

    Blocks are joined by \\n in page order, white space inside a block is one space. Null, empty and pages without an article have an
    empty text. Repeated rows, null ids and urls are kept as they are; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    model = model or Model.fit(labelled_pages())
    # A given column may have any name: they are numbered on the way through Python.
    given = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    numbered = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [model.text(x) for x in b["html"]]
            yield b.drop(columns="html").assign(text=text, n_chars=[len(t) for t in text])

    schema = ", ".join([*(f"c{i} {numbered.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(given))), "text string", "n_chars long"])
    out = numbered.mapInPandas(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(given)), "text", "n_chars")
