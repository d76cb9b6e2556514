"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of inline text is a node with a hidden state, content or not. The model is a directed tree:
a prior for the root, P(state | parent's state, kind of node, whether the parent is the page) on every edge, and P(feature | state, kind) for the features of
a node (class and id words, link share, length, sentence end, notice words). All tables are trained, with add-one smoothing,
on labelled pages. Inference is exact: sum-product messages go up from the leaves and down from the root, and a run of text is
kept when its marginal of being content is at least a half.

The labelled pages are made here by a seeded rule (`labelled_pages`): page layouts with `data-y` labels, since the data have
none. They share nothing with the pages that are read but HTML itself. Pass other pages to `DomModel.train` to use those.

Text is decoded (character references), white space inside a block becomes one blank, blocks are trimmed and joined by one
line break in page order; a line break element counts as white space. Tags are read by the states of the HTML standard: unquoted
values may hold apostrophes, a slash does not close a script, elements that are not text (scripts, styles, vector
graphics, choices of forms, fallbacks of media) end at their own end tag, however they nest. Formulas and other inline elements are
text; text of a button counts as that of a link. Defined cases: null or empty html gives an empty text; unclosed, stray and cut-off tags are
tolerated; a page without content gives an empty text; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements of HTML.
RAW = set("script style noscript iframe textarea title noembed noframes".split())
FLAT = set("select option datalist annotation".split())
SKIP = RAW | FLAT | set("template svg canvas video audio annotation-xml".split())
VOID = set("br hr img input meta link area base col embed source track wbr param".split())
BLOCK = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav aside header footer form fieldset address details summary dialog hgroup search center".split())
CLOSES_P = BLOCK - {"html", "body"}
GROUP = {t: g for g, ts in {
    "heading": "h1 h2 h3 h4 h5 h6", "text": "p blockquote pre dd dt figcaption caption", "list": "ul ol dl", "item": "li", "cell": "td th",
    "table": "table thead tbody tfoot tr", "box": "div section center hgroup details summary", "page": "html body", "main": "main", "article": "article",
    "nav": "nav search dialog", "aside": "aside", "header": "header", "footer": "footer address", "form": "form fieldset", "figure": "figure",
}.items() for t in ts.split()}

#: Words of class, id and role attributes.
BAD = set("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail widget widgets related recommended trending footer foot copyright legal header masthead topbar toolbar comment comments disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register search share sharing social follow tags pagination pager paywall form contentinfo complementary dialog tooltip skip".split())
GOOD = set("content article post entry story text body main maincontent prose body-text articlebody entry-content post-content".split())
NOTICE = re.compile(r"©|copyright|all rights reserved|cookies?\b|privacy policy|subscribe|sign up|log in|click here|advertisement|sponsored", re.I)

_VALUE = r"""\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?+"""
_ATTRIBUTE = re.compile(rf"(=?+[^\s/>=]++|=)(?:{_VALUE})?+")
_TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\Z)|</>
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=?+[^\s/>=]++|=)(?:{_VALUE.replace("(", "(?:").replace("(?:?:", "(?:")})?+)*+)(?:>|\Z)""",
    re.S | re.X,
)
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("children", "evidence", "kind", "label", "message", "parent", "parts", "posterior", "tag", "text", "words")

    def __init__(self, tag: str, parent: Node | None, words: tuple = (), label: str | None = None):
        self.tag, self.parent, self.words, self.label = tag, parent, words, label
        self.children, self.parts, self.text = [], [], ""
        if parent is not None:
            parent.children.append(self)


def _implied(node: Node, tag: str) -> Node:
    """Where an element with that tag goes when the innermost open block is node: end tags that HTML lets one leave out."""
    ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
    if tag in CLOSES_P and node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
        node = node.parent
    if ends:
        at = node
        while at.parent is not None and at.tag not in ("ul", "ol", "dl", "table", "body"):
            if at.tag in ends:
                node = at.parent
                if tag != "tr" or at.tag == "tr":
                    break
            at = at.parent
    return node


def _after(page: str, at: int, tag: str) -> int:
    """Where the page goes on after an element that is not text, whose start tag ends at `at`: behind its own end tag, or
    before the end tag of a block that it stands in, or before a block that it cannot hold."""
    if tag in RAW:
        end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
        return len(page) if end is None else end.end()
    depth, foreign, inside = 1, 0, []
    while m := _TOKEN.search(page, at):
        inner = (m[3] or "").lower()
        if inner == tag:
            depth += -1 if m[2] or tag in FLAT else not m[4].endswith("/")
            if depth == 0:
                return m.end()
        elif inner in BLOCK and tag != "template":
            if not m[2] and not foreign and (tag == "svg" or tag in FLAT):
                return m.start()
            elif not m[2]:
                inside.append(inner)
            elif inner not in inside:
                return m.start()
            else:
                while inside.pop() != inner:
                    pass
        elif inner == "foreignobject":
            foreign += -1 if m[2] else 1
        at = m.end()
        if inner in RAW and not m[2]:
            at = _after(page, at, inner)
    return len(page)


def parse(page: str) -> Node:
    """A tree of block elements; runs of inline text are leaves with tag #text and parts (text, inside a link)."""
    root = Node("html", None)
    node, run, link, button, at, n = root, None, 0, 0, 0, len(page)

    def add(piece: str) -> None:
        nonlocal run
        if run is None:
            if not piece.strip():
                return
            run = Node("#text", node)
        run.parts.append((piece, link + button > 0))

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                add(m[1])
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag in SKIP:
            if not closing and (tag in RAW or not m[4].endswith("/")):
                at = _after(page, at, tag)
            continue
        if tag == "br" or tag == "hr":
            add(" ")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag == "button":
            button = 0 if closing else 1
        if tag not in BLOCK:
            continue
        run, link, button = None, 0, 0
        if closing:
            open_ = node
            while open_ is not None and open_.tag != tag:
                open_ = open_.parent
            if open_ is not None and open_.parent is not None:
                node = open_.parent
            continue
        found: dict[str, str] = {}
        if "=" in m[4]:
            for name, a, b, c in _ATTRIBUTE.findall(m[4]):
                found.setdefault(name.lower(), a or b or c)
        words = tuple(_NAME.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
        if tag == "html":
            continue
        node = Node(tag, _implied(node, tag), words, found.get("data-y"))
        if m[4].endswith("/"):
            node = node.parent
    return root


def _features(node: Node) -> list[tuple[str, object]]:
    bad, good = any(w in BAD for w in node.words), any(w in GOOD for w in node.words)
    out: list[tuple[str, object]] = [("names", 2 * bad + good)] if node.tag != "#text" else []
    if node.tag == "#text":
        raw = [(_html.unescape(p), linked) for p, linked in node.parts]
        node.text = " ".join("".join(p for p, _ in raw).split())
        total = sum(len(p) for p, _ in raw) or 1
        linked = sum(len(p) for p, inside in raw if inside) / total
        n = len(node.text)
        out += [("links", 0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.7 else 3), ("length", 0 if n < 15 else 1 if n < 40 else 2 if n < 100 else 3), ("end", node.text[-1:] in tuple(".!?…:;\"”»")), ("notice", bool(NOTICE.search(node.text)) and n < 200)]
    return out


def _kind(node: Node) -> str:
    if node.tag == "#text":
        return "#" + GROUP[node.parent.tag]
    return GROUP[node.tag]


def _under(node: Node) -> bool:
    """Whether the node stands in the page itself, not in a part of it."""
    return GROUP.get(node.parent.tag) == "page"


def _order(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


class DomModel:
    def __init__(self, edge: dict, emit: dict):
        self.edge, self.emit = edge, emit  # (kind, in the page itself, parent's state) -> P(1); (kind, feature, value) -> log odds pair

    @classmethod
    def train(cls, pages: list[str]) -> DomModel:
        """Pages whose elements carry data-y="1" or "0"; what carries none has its parent's label, the root has 0."""
        edges, values, states = Counter(), Counter(), Counter()
        domain: dict[str, set] = {}
        for page in pages:
            for node in _order(parse(page)):
                node.label = int(node.label) if node.label is not None else 0 if node.parent is None else node.parent.label
                kind = _kind(node)
                if node.parent is not None:
                    edges[kind, _under(node), node.parent.label, node.label] += 1
                for name, value in _features(node):
                    domain.setdefault(name, set()).add(value)
                    for k in (kind, "*"):
                        values[k, name, value, node.label] += 1
                        states[k, name, node.label] += 1
        kinds = {k for k, *_ in edges} | {"#" + g for g in GROUP.values()} | set(GROUP.values())
        all_edges = Counter()
        for (_, u, p, y), c in edges.items():
            all_edges[u, p, y] += c
        edge, emit = {}, {}
        for k in kinds:
            for u, p in ((False, 0), (False, 1), (True, 0), (True, 1)):
                back = (all_edges[u, p, 1] + 1) / (all_edges[u, p, 0] + all_edges[u, p, 1] + 2)
                edge[k, u, p] = (edges[k, u, p, 1] + 2 * back) / (edges[k, u, p, 0] + edges[k, u, p, 1] + 2)
            for name, found in domain.items():
                for v in found:
                    pair = []
                    for y in (0, 1):
                        back = (values["*", name, v, y] + 1) / (states["*", name, y] + len(found))
                        pair.append(math.log((values[k, name, v, y] + 4 * back) / (states[k, name, y] + 4)))
                    emit[k, name, v] = tuple(pair)
        return cls(edge, emit)

    def marginals(self, root: Node) -> list[Node]:
        """Sets posterior, P(content | page), of every node; the nodes in page order."""
        nodes = _order(root)
        for node in nodes:
            node.kind = _kind(node)
            e0 = e1 = 0.0
            for name, value in _features(node):
                a, b = self.emit.get((node.kind, name, value), (0.0, 0.0))
                e0, e1 = e0 + a, e1 + b
            node.evidence = [e0, e1]
        for node in reversed(nodes):  # upward: evidence of the subtree, then the message to the parent
            e0, e1 = node.evidence
            for child in node.children:
                e0, e1 = e0 + child.message[0], e1 + child.message[1]
            top = max(e0, e1)
            node.evidence = [e0 - top, e1 - top]
            if node.parent is not None:
                a, b = math.exp(e0 - top), math.exp(e1 - top)
                on0, on1 = self.edge[node.kind, _under(node), 0], self.edge[node.kind, _under(node), 1]
                node.message = (math.log((1 - on0) * a + on0 * b), math.log((1 - on1) * a + on1 * b))
        for node in nodes:  # downward: the parent's belief without this child's message
            a, b = math.exp(node.evidence[0]), math.exp(node.evidence[1])
            if node.parent is None:
                node.posterior = 0.05 * b / (0.95 * a + 0.05 * b)
                continue
            p = min(max(node.parent.posterior, 1e-12), 1 - 1e-12)
            without = math.log(1 - p) - node.message[0], math.log(p) - node.message[1]
            top = max(without)
            q0, q1 = math.exp(without[0] - top), math.exp(without[1] - top)
            on0, on1 = self.edge[node.kind, _under(node), 0], self.edge[node.kind, _under(node), 1]
            off, on = (q0 * (1 - on0) + q1 * (1 - on1)) * a, (q0 * on0 + q1 * on1) * b
            node.posterior = on / (on + off)
        return nodes

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        return "\n".join(n.text for n in self.marginals(parse(page)) if n.tag == "#text" and n.posterior >= 0.5 and n.text)


def labelled_pages(n: int = 600, seed: int = 6) -> list[str]:
    """Layouts of web pages with data-y labels, by rule from a seeded generator."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    sentences = lambda: " ".join(phrase(1, 14) + r.choice([".", ".", ".", "!", "?"]) for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
    prose = lambda: r.choice([sentences, sentences, sentences, sentences, lambda: sentences().replace(" ", r.choice(["### ", "&amp;&amp; "]), 9), lambda: phrase(1, 12), lambda: r.choice(notices) if r.random() < 0.3 else sentences()])()
    notices = ["All rights reserved.", "Copyright.", "Subscribe to the newsletter.", "We use cookies.", "Click here."]
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
    named = lambda *names: r.choice(["class", "class", "id"]) + f'="{r.choice(names)}"'
    inline = lambda s: s if r.random() < 0.7 else f"{s} {link()} {phrase(2, 6)}." if r.random() < 0.6 else f"<b>{s}</b>"

    def paragraph() -> str:
        k = r.random()
        if k < 0.78:
            return r.choice([f"<p>{inline(prose())}</p>", f"<p>{inline(prose())}</p>", f"<p>{prose()}", f"<p><b>{prose()}<br>", f"<div>{prose()}</div>"])
        return r.choice([
            f"<h{r.randint(2, 4)}>{phrase(1, 7)}</h2>", f"<blockquote>{prose()}</blockquote>", "<ul>" + "".join(f"<li>{r.choice([phrase(2, 9), prose()])}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
            f"<figure><img src=x><figcaption>{prose()}</figcaption></figure>", f"<pre>{prose()}</pre>",
            "<table>" + "".join(f"<tr><td>{phrase(1, 3)}</td><td>{phrase(1, 6)}</td></tr>" for _ in range(3)) + "</table>",
        ])

    def inside() -> str:
        """What may stand in an article and is not its text."""
        return r.choice([
            f'<div data-y="0" {named("ad", "advert", "ads", "sponsored", "promo")}>{r.choice([prose(), phrase(2, 8)])}</div>', f'<aside data-y="0">{prose()}{links()}</aside>',
            f'<div data-y="0" {named("share", "social", "tags", "related")}>{link()} {link()} {link()}</div>', f'<form data-y="0"><label>{phrase(1, 4)}</label><input><p>{prose()}</p></form>', f'<nav data-y="0">{links()}</nav>',
            f'<div data-y="0" {named("newsletter", "subscribe", "notice")}><p>{prose()}</p></div>',
        ])

    def around(after: bool) -> str:
        options = [
            lambda: f'<nav data-y="0">{links()}</nav>', lambda: f'<div data-y="0" {named("ad", "ads", "advert", "banner", "sponsored", "promo")}>{prose()}</div>',
            lambda: f'<div data-y="0" {named("menu", "nav", "navbar", "breadcrumbs", "topbar")}>{links() if r.random() < 0.6 else link() + " &gt; " + link()}</div>', lambda: f'<div data-y="0" {named("cookie-notice", "notice", "consent", "alert", "popup")}><p>{prose()}</p></div>',
            lambda: f'<aside data-y="0" {named("sidebar", "side", "x")}><h3>{phrase(1, 3)}</h3>{links()}<p>{prose()}</p></aside>', lambda: f'<div data-y="0" {named("sidebar", "widget", "related", "rail")}><h4>{phrase(1, 3)}</h4>{links()}<p>{prose()}</p></div>',
            lambda: f'<form data-y="0" {named("search", "newsletter", "login", "q")}><p>{prose()}</p><input></form>', lambda: f'<header data-y="0"><h1>{phrase(1, 3)}</h1><p>{phrase(2, 8)}</p>{links()}</header>',
        ]
        comments = lambda: f'<{(t := r.choice(["section", "div"]))} data-y="0" {named("comments", "comment-list", "discussion", "replies")}><h3>{phrase(1, 2)}</h3>' + "".join(r.choice([f'<div class="comment"><p>{prose()}</p></div>', f"<li><p>{prose()}</p></li>", f'<article class="comment"><p>{prose()}</p></article>', f"<p>{prose()}</p>"]) for _ in range(r.randint(1, 5))) + f"</{t}>"
        footer = lambda: f'<footer data-y="0">{r.choice([f"&copy; {word()}.example.com &middot; {prose()}", f"<p>&copy; {phrase(2, 6)}</p>{links()}", prose()])}</footer>'
        foot = lambda: f'<div data-y="0" {named("footer", "copyright", "legal")}><p>{prose()}</p>{links()}</div>'
        return "".join(r.choice(options + [comments, comments, footer, footer, foot] * after)() for _ in range(r.randint(1, 4)))

    pages = []
    for _ in range(n):
        body = f"<h1>{phrase(1, 8)}</h1>" * (r.random() < 0.8)
        if r.random() < 0.15:
            body = f"<header>{body}</header>"
        body += "".join(inside() if r.random() < 0.06 else paragraph() for _ in range(r.choice([1, 2, 3, 5, 9, 16])))
        opening = r.choice(["article", "article", "article", "main", "div class=content", 'div id="article"', 'section class="post"', "div", "main><article", ""])
        closing = "".join(f"</{t.split()[0]}>" for t in reversed(opening.split("><")) if t)
        if opening:
            body = f'<{opening.replace(">", " data-y=1>")} data-y="1">{body}{closing}'
        else:  # right in the page: what has no label is labelled
            body = re.sub(r"<(p|h[1-6]|blockquote|ul|figure|pre|table|div|header)(?=>)", r'<\1 data-y="1"', body)
        pages.append(f"<html><head><title>{phrase(1, 4)}</title></head><body>{around(False)}{body}{around(True)}</body></html>")
    return pages


_DEFAULT: list[DomModel] = []


def default_model() -> DomModel:
    if not _DEFAULT:
        _DEFAULT.append(DomModel.train(labelled_pages()))
    return _DEFAULT[0]


def html_text(pages: DataFrame, model: DomModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages. The model is a few tables of fixed size."""
    model = model or default_model()
    small = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [model.text(h) for h in part["html"]]
            yield part[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    kinds = {f.name: f.dataType.simpleString() for f in small.schema.fields}
    return small.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
