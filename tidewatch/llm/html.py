"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

Every element gets features (density of its subtree, tokens of its and its ancestors' attributes, depth, siblings, place in the page) and the
trees' probability that it holds main text. Decoding picks the likeliest labelling in which an element that is out has nothing in below
it, by one pass from the leaves up; so no kept paragraph stands in a dropped menu. The trees are trained here, on pages that a
seeded generator lays out in many ways and whose main text is known.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul br".split()
)
#: Never text for a reader.
DEAD = frozenset("script style noscript template head title meta link iframe object svg canvas select option button textarea input label".split())
#: A start tag in the key's list ends an open element named by the value, up to the nearest of the barriers.
ENDS = {t: "p" for t in BLOCK if t not in ("br", "body", "html", "head", "title", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr")} | {"option": "option", "td": "td", "th": "th", "tr": "tr", "tbody": "tbody"}
ALSO = {"li": "li", "dt": "dd", "dd": "dt", "td": "th", "th": "td"}
BARRIER = frozenset("table ul ol dl div section article aside nav header footer main form body html".split())
#: Groups of tags, and of tokens in class, id and role.
TAGS = ("p", "h1 h2 h3 h4 h5 h6", "div", "article main", "section", "nav menu", "header", "footer", "aside", "ul ol dl", "li dt dd", "a", "form fieldset", "table tbody thead tr td th", "blockquote pre figure figcaption", "b i em strong span u small sub sup code")
TOKENS = (
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager tabs toc",
    "header masthead banner topbar head hero logo",
    "footer foot contentinfo copyright bottom legal",
    "sidebar side aside complementary widget rail related recommended recommendations trending popular more",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion",
    "cookie cookies consent notice alert popup modal overlay gdpr privacy banner",
    "comment comments disqus reply replies respond discussion feedback commentlist reviews",
    "form search login signup subscribe newsletter share social sharing follow",
    "article content main post entry story body text page",
)
TAG_AT = {t: k for k, group in enumerate(TAGS) for t in group.split()}
TOKEN_AT: dict[str, list[int]] = {}
for _k, _group in enumerate(TOKENS):
    for _t in _group.split():
        TOKEN_AT.setdefault(_t, []).append(_k)
SPLIT = re.compile(r"[a-z]+")


class Page(HTMLParser):
    """Elements as parallel lists in page order (so a parent stands before its children), and text runs with their element."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.tokens, self.hidden = ["#root"], [-1], [()], [False]
        self.open = [0]
        self.runs: list[tuple[int, str]] = []  # (element, text); a text of None marks a break
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for end in (ENDS.get(tag), ALSO.get(tag)):
            if end:
                self._end(end, BARRIER)
        at = len(self.tag)
        marks, hidden = [], False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                marks += SPLIT.findall(value.lower())
            elif name == "hidden" or (name == "style" and value and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and value == "true"):
                hidden = True
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.tokens.append(tuple(marks))
        self.hidden.append(hidden)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends void elements only

    def handle_endtag(self, tag: str) -> None:
        self._end(tag, frozenset())

    def _end(self, tag: str, barrier: frozenset) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[k]]
            if name == tag:
                del self.open[k:]
                return
            if name in barrier:
                return

    def handle_data(self, data: str) -> None:
        self.runs.append((self.open[-1], data))


D = len(TAGS) + 2 * len(TOKENS) + 18


def features(page: Page) -> np.ndarray:
    """A row for each element."""
    n = len(page.tag)
    own, links, stops, first = [0] * n, [0] * n, [0] * n, [-1.0] * n
    inside_a, dead, up_tokens = [False] * n, [False] * n, [0] * n
    tokens, depth, kids, paragraphs, nodes, tagged = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
    for v in range(n):
        p = page.parent[v]
        tag = page.tag[v]
        bits = 0
        for t in page.tokens[v]:
            for k in TOKEN_AT.get(t, ()):
                bits |= 1 << k
        tokens[v] = bits
        tagged[v] = TAG_AT.get(tag, -1)
        if p >= 0:
            inside_a[v] = inside_a[p] or tag == "a"
            dead[v] = dead[p] or tag in DEAD or page.hidden[v]
            up_tokens[v] = up_tokens[p] | tokens[p]
            depth[v] = depth[p] + 1
    order = [0] * n
    total = 0
    for v, text in page.runs:
        if not dead[v]:
            k = len(text) - text.count(" ") if text.strip() else 0
            if first[v] < 0:
                first[v] = total
            own[v] += k
            total += k
            links[v] += k * inside_a[v]
            stops[v] += text.count(".") + text.count(",")
    size, link, stop = own[:], links[:], stops[:]
    same: dict[tuple[int, str], int] = {}
    place = [0] * n
    for v in range(1, n):
        p = page.parent[v]
        place[v] = kids[p]
        kids[p] += 1
        key = (p, page.tag[v])
        same[key] = same.get(key, 0) + 1
    for v in range(n - 1, 0, -1):
        p = page.parent[v]
        size[p] += size[v]
        link[p] += link[v]
        stop[p] += stop[v]
        nodes[p] += nodes[v]
        paragraphs[p] += paragraphs[v] + (page.tag[v] == "p" and size[v] > 0)
        if first[v] >= 0 and (first[p] < 0 or first[v] < first[p]):
            first[p] = first[v]
    total = max(1, total)
    out = np.zeros((n, D))
    base, ups, rest = len(TAGS), len(TAGS) + len(TOKENS), len(TAGS) + 2 * len(TOKENS)
    for v in range(n):
        row, p = out[v], max(0, page.parent[v])
        if tagged[v] >= 0:
            row[tagged[v]] = 1
        for k in range(len(TOKENS)):
            row[base + k] = tokens[v] >> k & 1
            row[ups + k] = up_tokens[v] >> k & 1
        row[rest:] = (
            math.log1p(size[v]), math.log1p(own[v]), link[v] / max(1, size[v]), math.log1p(nodes[v]), size[v] / nodes[v] ** 0.5, stop[v] / max(1, size[v]), size[v] / total, max(0, first[v]) / total,
            depth[v], kids[v], place[v], place[v] / max(1, kids[p]), same.get((page.parent[v], page.tag[v]), 1), paragraphs[v], math.log1p(size[p]), link[p] / max(1, size[p]), tagged[p], tagged[page.parent[p]] if page.parent[p] >= 0 else -1,
        )
    return out


class Boosted:
    """Gradient-boosted trees of a fixed depth over binned features, for the logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 5, rate: float = 0.3, bins: int = 24, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        margin, size = np.zeros(len(x)), 1 << self.depth
        self.feature, self.cut, self.leaf = np.zeros((self.trees, size), np.int64), np.full((self.trees, size), np.inf), np.zeros((self.trees, size))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            node = np.ones(len(x), np.int64)  # heap numbers; a level's nodes are 2^level .. 2^(level + 1) - 1
            for level in range(self.depth):
                base = 1 << level
                best = np.full(base, 1e-9)
                split = np.zeros(base, np.int64), np.full(base, self.bins, np.int64)
                for j in range(x.shape[1]):
                    k = (node - base) * self.bins + b[:, j]
                    gs, hs = (np.bincount(k, v, base * self.bins).reshape(base, -1).cumsum(1) for v in (g, h))
                    gain = gs**2 / (hs + self.ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    at = gain.argmax(1)
                    top = gain[np.arange(base), at]
                    better = top > best
                    best[better] = top[better]
                    split[0][better], split[1][better] = j, at[better]
                for i in range(base):
                    j, c = split[0][i], split[1][i]
                    self.feature[t, base + i] = j
                    self.cut[t, base + i] = self.cuts[j][c] if c < len(self.cuts[j]) else np.inf
                node = 2 * node + (b[np.arange(len(x)), split[0][node - base]] > split[1][node - base])
            gs, hs = (np.bincount(node - size, v, size) for v in (g, h))
            self.leaf[t] = -self.rate * gs / (hs + self.ridge)
            margin += self.leaf[t][node - size]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows, size = np.zeros(len(x)), np.arange(len(x)), 1 << self.depth
        for t in range(self.trees):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t][node - size]
        return out


def follows(page: Page, v: int) -> bool:
    """Whether an element goes with its block: an inline one, neither dead nor hidden, whose attributes name nothing but content."""
    tag = page.tag[v]
    named = any(k < len(TOKENS) - 1 for t in page.tokens[v] for k in TOKEN_AT.get(t, ()))
    return v > 0 and (tag not in BLOCK or tag == "br") and tag not in DEAD and not page.hidden[v] and not named


def decoded(page: Page, margin: np.ndarray) -> list[bool]:
    """Which elements are in: the likeliest labelling in which all below an element that is out is out, and inline elements (whose
    evidence counts) are where the block around them is."""
    n = len(page.tag)
    inline = [follows(page, v) for v in range(n)]
    margin = np.clip(margin, -12, 12)
    yes, no = (-np.logaddexp(0, -margin)).tolist(), (-np.logaddexp(0, margin)).tolist()
    out, into = no[:], yes[:]
    for v in range(n):
        if page.tag[v] in DEAD or page.hidden[v]:
            into[v] = -math.inf
    for v in range(n - 1, 0, -1):
        p = page.parent[v]
        out[p] += out[v]
        into[p] += into[v] if inline[v] else max(into[v], out[v])
    keep = [False] * n
    keep[0] = True
    for v in range(1, n):
        keep[v] = keep[page.parent[v]] and (inline[v] or into[v] > out[v])
    return keep


def text_of(page: Page, keep: list[bool]) -> str:
    """Text runs of kept elements; a change of block is a space, white space is one space."""
    parts: list[str] = []
    block, last = [0] * len(page.tag), None
    for v in range(1, len(page.tag)):
        block[v] = v if page.tag[v] in BLOCK else block[page.parent[v]]
    for (v, text), k in zip(page.runs, page.breaks, strict=True):
        if keep[v]:
            if (block[v], k) != last:
                parts.append(" ")
                last = (block[v], k)
            parts.append(text)
    return " ".join("".join(parts).split())


class _Text(Page):
    """Page whose runs also know how many block starts stood before them, so that text on both sides of a break is told apart."""

    def __init__(self, html: str):
        self.breaks: list[int] = []
        self._count = 0
        super().__init__(html)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._count += tag in BLOCK
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._count += tag in BLOCK
        super().handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.breaks.append(self._count)
        super().handle_data(data)


# --- pages to learn from -------------------------------------------------------------------------------------------------------------


class Layouts:
    """Seeded generator of pages. ``page()`` gives the html; an attribute ``data-m`` marks what is main (and is no feature)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choice("abdefgilmnoprstu") for _ in range(self.r.randint(1, 9))) for _ in range(n))

    def sentence(self) -> str:
        w = self.words(self.r.randint(3, 18))
        return w.capitalize() + self.r.choice([".", ".", ".", "", "!", " &amp;&amp;&amp;"])

    def prose(self, low: int = 1, high: int = 8) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        return out if self.r.random() < 0.85 else f'{out} <a href="/x">{self.words(2)}</a> {self.sentence()}'

    def box(self, tags: str, names: str, inner: str, named: float = 0.8) -> str:
        tag = self.r.choice(tags.split())
        name = self.r.choice(names.split()) if self.r.random() < named else self.words(1)
        mark = self.r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.words(1)}"', f' class="{self.words(1)}-{name}"'])
        return f"<{tag}{mark if tag == 'div' or self.r.random() < 0.5 else ''}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        each = [f'<a href="/{k}">{self.words(self.r.randint(1, 3))}</a>' for k in range(self.r.randint(low, high))]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>", lambda: " | ".join(each), lambda: "".join(f"<p>{x}</p>" for x in each)])()

    def junk(self, where: str, named: float = 0.8) -> str:
        """Inside the main element and after it junk always bears a name: nothing else tells a reader's comment from a paragraph."""
        r, box = self.r, lambda *a: self.box(*a, named=named)
        kinds = {
            "top": [lambda: box("nav div header", "nav menu navbar navigation breadcrumb", self.links()), lambda: box("header div", "header masthead banner topbar", f"<h1>{self.words(2)}</h1>" * r.randint(0, 1) + f"<p>{self.words(5)}</p>" + self.links(0, 5))],
            "any": [
                lambda: box("div aside", "ad ads advert sponsored promo advertisement", self.prose(1, 3)),
                lambda: box("div section", "cookie notice consent alert popup gdpr", f"<p>{self.prose(1, 3)}</p><button>{self.words(1)}</button>"),
                lambda: box("aside div", "sidebar related widget side complementary trending", r.choice([self.links(), f"<h3>{self.words(2)}</h3><p>{self.prose(1, 3)}</p>", self.prose(1, 2)])),
                lambda: box("form div", "search login newsletter subscribe signup form", f"<form><label>{self.words(2)}</label><input name=q> {self.sentence()}<button>{self.words(1)}</button></form>"),
                lambda: f"<form><p>{self.sentence()}</p><input><select><option>{self.words(1)}<option>{self.words(1)}</select></form>",
                lambda: box("div ul", "share social follow", self.links(2, 5)),
            ],
            "end": [
                lambda: box("section div ol ul", "comments comment commentlist disqus replies discussion", f"<h3>{self.words(1)}</h3>" * r.randint(0, 1) + "".join(box("div li article p", "comment reply", f"<b>{self.words(1)}</b> <p>{self.prose(1, 4)}</p>") for _ in range(r.randint(1, 5)))),
                lambda: box("footer div", "footer copyright legal foot", f"&copy; {self.words(2)} &middot; {self.prose(1, 3)}" if r.random() < 0.7 else f"<p>&copy; {self.words(3)}</p>" + self.links()),
            ],
        }
        return r.choice(kinds[where])()

    def main(self) -> str:
        r, m = self.r, " data-m"
        out = [f"<{(h := r.choice(['h1', 'h1', 'h2']))}{m}>{self.words(r.randint(3, 12))}</{h}>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 21])):
            out.append(
                r.choice(
                    [lambda: f"<p{m}>{self.prose()}</p>"] * 9
                    + [
                        lambda: f"<p{m}><b{m}>{self.prose(1, 5)}<br><p{m}>{self.prose()}</p>",
                        lambda: f"<p{m}>{self.prose()}",
                        lambda: f"<h2{m}>{self.words(4)}</h2><p{m}>{self.prose()}</p>",
                        lambda: f"<ul{m}>" + "".join(f"<li{m}>{self.prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                        lambda: f"<blockquote{m}>{self.prose(1, 3)}</blockquote>",
                        lambda: f"<table{m}>" + "".join(f"<tr{m}><td{m}>{self.words(2)}</td><td{m}>{self.words(3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>",
                        lambda: f"<div{m}>{self.prose()}</div>",
                        lambda: f"<pre{m}>{self.prose(1, 3)}</pre>",
                        lambda: f"<p{m}>{self.words(r.randint(1, 3))}.</p>",
                        lambda: f"<p{m}>{self.sentence()}</p>",
                    ]
                )()
            )
        if r.random() < 0.25:
            out.insert(r.randint(0, len(out)), self.junk("any", 1.0))
        return "\n".join(out) if r.random() < 0.5 else "".join(out)

    def page(self) -> str:
        r, m = self.r, " data-m"
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        name = r.choice(["article", "content", "post", "entry", "story", "main"]) if tag == "div" and r.random() < 0.8 else self.words(1)
        inner = self.main()
        if r.random() < 0.15:
            inner += self.junk("end", 1.0)
        body = f'<{tag}{m} class="{name}">{inner}</{tag}>' if tag == "div" or r.random() < 0.3 else f"<{tag}{m}>{inner}</{tag}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f'<div{m} class="{r.choice(["wrap", "container", "row", "page", self.words(1)])}">' + "".join(self.junk("any", 1.0) for _ in range(r.choice([0, 0, 1]))) + body + "".join(self.junk(r.choice(["any", "end"]), 1.0) for _ in range(r.choice([0, 0, 1]))) + "</div>"
        top = [self.junk(r.choice(["top", "top", "any"])) for _ in range(r.choice([0, 1, 2, 3]))]
        end = [self.junk(r.choice(["any", "end"]), 0.95) for _ in range(r.choice([0, 1, 1, 2]))] + [self.junk("end", 0.95)] * (r.random() < 0.7)
        head = f"<head><meta charset=utf-8><title>{self.words(4)}</title><style>p{{}}</style><script>x('</p>')</script></head>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html{m}>{head}<body{m}>" + "".join([*top, body, *end]) + "</body></html>"


class _Marked(_Text):
    def __init__(self, html: str):
        self.main = [True]
        super().__init__(html)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        inline = tag in ("a", "b", "br") and self.main[self.parent[-1]]
        self.main.append(inline or any(k == "data-m" for k, _ in attrs))


@functools.cache
def trained(pages: int = 500, seed: int = 11) -> Boosted:
    """The trees, from ``pages`` generated pages; about two seconds, the same each time."""
    made, x, y = Layouts(seed), [], []
    for _ in range(pages):
        page = _Marked(made.page())
        x.append(features(page))
        y.append(np.array(page.main, float))
    x, y = np.concatenate(x), np.concatenate(y)
    return Boosted().fit(x, y, np.ones(len(x)))


def extract(html: list[str | None], model: Boosted) -> list[str]:
    """Main text of each page; a null or empty page has none."""
    pages = [_Text(h or "") for h in html]
    x = [features(p) for p in pages]
    margin = model.margin(np.concatenate(x)) if x else np.empty(0)
    out, at = [], 0
    for p, f in zip(pages, x, strict=True):
        out.append(text_of(p, decoded(p, margin[at : at + len(f)])))
        at += len(f)
    return out


def extracted(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), html: str = "html", model: Boosted | None = None) -> DataFrame:
    """pages -> the ``carry`` columns, text and n_chars (code points), one row for every row.

    A null, empty or text-free page gives an empty text. Whole pages, however long; repeated rows give repeated results; an empty table
    gives an empty result; columns that are not carried are not read, so their names can't clash.
    """
    model = model or trained()
    picked = pages.select(*carry, F.col(html).alias("__html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__html"] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [n for n in b.schema.names if n != "__html"]
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = extract(part.column("__html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return picked.mapInArrow(run, schema)
