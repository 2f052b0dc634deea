"""Main text of web pages by a tree-structured graphical model.

The nodes are DOM elements, each content or boilerplate. A node has a potential from its own features, and each parent-child edge one from both labels and the child's kind of element; both are log-frequencies learned from labelled pages. Sum-product messages go up and down the tree once and give each node's exact marginal; blocks of text follow their node.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
MARKS = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|data-y|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
#: Elements whose content is not parsed as markup.
OPAQUE = {"script", "style", "textarea", "title", "iframe"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Start tags that end an open element: child -> elements it ends, within the nearest of the stops.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
STOPS = {"html", "body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "table", "ul", "ol", "dl", "td", "th", "blockquote", "figure", "fieldset"}
DROPPED = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "video", "audio", "select", "button", "head"}
#: What a head may hold; anything else ends one that is open.
METADATA = set("head html base basefont bgsound link meta noframes noscript script style template title".split())
BUTTONS = {t: re.compile(rf"<(/?){t}\b", re.IGNORECASE) for t in ("button", "select")}
BOILER = set(
    "nav navbar navigation menu menus header masthead footer foot sidebar side aside ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert "
    "comment comments commentlist reply replies discussion disqus respond share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager popup modal overlay newsletter subscribe subscription signup login search form widget toolbar topbar copyright legal disclaimer tags skip".split()
)
MAIN = set("article content main post entry story body text page-content maincontent".split())
#: Elements that do not part the text around them.
SEAMLESS = INLINE | DROPPED - {"head", "title"}
KINDS = {"article": "main", "main": "main", "nav": "frame", "header": "frame", "footer": "frame", "aside": "frame", "form": "frame", "dialog": "frame", "menu": "frame", "fieldset": "frame", "p": "text", "blockquote": "text", "pre": "text", "h1": "title", "h2": "title", "h3": "title", "h4": "title", "h5": "title", "h6": "title"}
KINDS |= {"ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "tr": "table", "td": "item", "th": "item", "div": "box", "section": "box", "body": "root", "html": "root", "#": "root"}


class Page:
    """The elements of a page and its text pieces by block."""

    def __init__(self, html: str):
        self.tag, self.parent, self.mark, self.label = ["#"], [-1], [""], [None]
        self.blocks: list[list[tuple[int, str]]] = []
        self.block: list[tuple[int, str]] = []
        self.linked = defaultdict(int)
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements: tag, node
        unclosed = set()  # nodes of buttons and selects without an end tag
        links = at = 0
        while at < len(html):
            m = TOKEN.search(html, at)
            if stack[-1][0] == "head" and html[at : m.start() if m else len(html)].strip():
                self.flush()
                stack.pop()
            if m is None:
                self.piece(stack[-1][1], html[at:], links)
                break
            if m.start() > at:
                self.piece(stack[-1][1], html[at : m.start()], links)
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[5] and not m[0].endswith(">"):  # cut off within a tag
                break
            if m[1] or m[4]:
                if any(t == tag for t, _ in stack[1:]):
                    while True:
                        t, _ = stack.pop()
                        links -= t == "a"
                        if t not in SEAMLESS:
                            self.flush()
                        if t == tag:
                            break
                elif tag not in SEAMLESS:
                    self.flush()
                continue
            marks = m[3] or m[6] or ""
            inline = tag in INLINE
            if stack[-1][0] == "head" and tag not in METADATA:
                self.flush()
                stack.pop()
            if unclosed and tag in CLOSES and tag != "option":
                k = next((k for k, (_, node) in enumerate(stack) if node in unclosed), len(stack))
                links -= sum(t == "a" for t, _ in stack[k:])
                del stack[k:]
            if tag not in SEAMLESS:
                self.flush()
                if ends := CLOSES.get(tag):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in ends:
                            links -= sum(t == "a" for t, _ in stack[k:])
                            del stack[k:]
                            break
                        if stack[k][0] in STOPS:
                            break
            if tag == "br":
                self.block.append((stack[-1][1], " "))
            if tag in VOID:
                continue
            mark = self.marks(marks)
            node = stack[-1][1]
            if not inline or mark[0] or mark[1] is not None or mark[2]:
                self.tag.append(tag)
                self.parent.append(node)
                self.mark.append(mark[0])
                self.label.append(mark[1])
                node = len(self.tag) - 1
                if mark[2]:
                    self.mark[node] = "hidden"
            if tag in OPAQUE:
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
                continue
            if marks.endswith("/") and tag in ("svg", "math"):
                continue
            if tag in BUTTONS and ((end := BUTTONS[tag].search(html, at)) is None or not end[1]):
                unclosed.add(node)
            stack.append((tag, node))
            links += tag == "a"
        self.flush()

    @staticmethod
    def marks(text: str) -> tuple[str, str | None, bool]:
        """Boilerplate or main by class, id and role; a training label; hidden."""
        words, label, hidden = [], None, False
        for m in MARKS.finditer(text):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "data-y":
                label = value
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
            elif name != "style":
                words += re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        if not BOILER.intersection(words) - {"header"} and MAIN.intersection(words):
            return "main", label, hidden  # the header of a post is its own
        return ("boiler" if BOILER.intersection(words) else "main" if MAIN.intersection(words) else ""), label, hidden

    def piece(self, node: int, text: str, links: int) -> None:
        if text:
            text = entities.unescape(text)
            self.block.append((node, text))
            if links:
                self.linked[node] += len(text.strip())

    def flush(self) -> None:
        if self.block and any(not t.isspace() for _, t in self.block):
            self.blocks.append(self.block)
        self.block = []

    def features(self) -> list[tuple[tuple[str, ...], str]]:
        """For each node: values of its features, and the kind that its edge potential depends on."""
        n = len(self.tag)
        own = [0] * n
        for block in self.blocks:
            for node, text in block:
                own[node] += len(text.strip())
        size, linked = own[:], [self.linked.get(k, 0) for k in range(n)]
        for k in range(n - 1, 0, -1):
            size[self.parent[k]] += size[k]
            linked[self.parent[k]] += linked[k]
        out = []
        for k in range(n):
            kind = "dropped" if self.tag[k] in DROPPED else KINDS.get(self.tag[k], "other")
            mark = self.mark[k]
            density = linked[k] / size[k] if size[k] else 0.0
            text = (f"tag={self.tag[k] if kind in ('frame', 'main', 'text', 'title') else kind}", f"mark={mark}", f"links={(density > 0.1) + (density > 0.5)}", f"size={(size[k] > 0) + (size[k] > 80)}")
            out.append((text, f"{kind}{mark}"))
        return out


class Model:
    """Log-potentials of nodes and edges."""

    def __init__(self, pages: list[str]):
        node: dict[tuple[str, int], int] = defaultdict(int)
        edge: dict[tuple[str, int, int], int] = defaultdict(int)
        total, values = [0, 0], defaultdict(set)
        for html in pages:
            page = Page(html)
            label = [0] * len(page.tag)
            for k, (features, kind) in enumerate(page.features()):
                up = label[page.parent[k]] if k else 0
                label[k] = up if page.label[k] is None else int(page.label[k])
                total[label[k]] += 1
                for f in features:
                    node[f, label[k]] += 1
                    values[f.split("=")[0]].add(f)
                if k:
                    edge[kind, up, label[k]] += 1
        self.feature = {f: math.log((node[f, 1] + 1) / (total[1] + len(v))) - math.log((node[f, 0] + 1) / (total[0] + len(v))) for v in values.values() for f in v}
        kinds = {kind for kind, _, _ in edge}
        self.edge = {kind: self.table(edge, kind) for kind in kinds}
        self.unseen = (0.95, 0.05, 0.05, 0.95)

    @staticmethod
    def table(edge: dict[tuple[str, int, int], int], kind: str) -> tuple[float, float, float, float]:
        """P(child | parent) as 00, 01, 10, 11; half a case is added, labels stay by default."""
        out = []
        for up in (0, 1):
            n = [edge[kind, up, y] + (0.9 if y == up else 0.1) for y in (0, 1)]
            out += [x / sum(n) for x in n]
        return tuple(out)

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node, by one sweep up and one down."""
        n, parent = len(page.tag), page.parent
        local, table = [1.0] * n, [self.unseen] * n
        for k, (features, kind) in enumerate(page.features()):
            table[k] = self.edge.get(kind, self.unseen)
            if k:
                local[k] = math.exp(max(-30.0, min(30.0, sum(self.feature.get(f, 0.0) for f in features))))
        in0, in1 = [1.0] * n, local[:]  # node potential times messages of its children
        in1[0] = 1e-6  # the document as such is not content
        up0, up1 = [1.0] * n, [1.0] * n
        for k in range(n - 1, 0, -1):
            t = table[k]
            a, b = t[0] * in0[k] + t[1] * in1[k], t[2] * in0[k] + t[3] * in1[k]
            up0[k], up1[k] = a / (a + b), b / (a + b)
            p = parent[k]
            in0[p] *= up0[k]
            in1[p] *= up1[k]
            s = in0[p] + in1[p]
            in0[p] /= s
            in1[p] /= s
        all0, all1 = in0[:], in1[:]
        for k in range(1, n):
            p, t = parent[k], table[k]
            out0, out1 = all0[p] / up0[k], all1[p] / up1[k]  # the parent's belief without this child's message
            d0, d1 = out0 * t[0] + out1 * t[2], out0 * t[1] + out1 * t[3]
            all0[k], all1[k] = in0[k] * d0, in1[k] * d1
            s = all0[k] + all1[k]
            all0[k] /= s
            all1[k] /= s
        return [y / (x + y) for x, y in zip(all0, all1, strict=True)]

    def extract(self, html: str) -> str:
        page = Page(html)
        belief = self.marginals(page)
        for k in range(1, len(belief)):  # what is never shown as text, and all within it
            if page.tag[k] in DROPPED or page.mark[k] == "hidden" or belief[page.parent[k]] < 0:
                belief[k] = -1.0
        blocks = (" ".join("".join(t for node, t in block if belief[node] > 0.5).split()) for block in page.blocks)
        return "\n\n".join(b for b in blocks if b)


def labelled_pages(n: int = 240, seed: int = 11) -> list[str]:
    """Labelled pages (data-y: 1 content, 0 boilerplate; children inherit), from layouts with and without semantic elements."""
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))).capitalize() + "."

    def links(k: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 2)}</a></li>' for _ in range(k))

    def boiler() -> str:
        kind = rng.randint(0, 11)
        name = rng.choice(("ad", "sidebar", "cookie-notice", "comments", "related", "share", "promo", "newsletter", "breadcrumb", "banner", "menu", "footer"))
        return (
            f'<nav data-y="0"><ul>{links(rng.randint(3, 8))}</ul></nav>', f'<header data-y="0"><h1>{words(1, 4)}</h1><p>{words(2, 6)}</p></header>', f'<footer data-y="0"><p>{words(4, 12)}</p></footer>',
            f'<aside data-y="0"><h3>{words(1, 3)}</h3><p>{words(5, 40)}</p><ul>{links(4)}</ul></aside>', f'<form data-y="0"><label>{words(1, 3)}</label><p>{words(2, 12)}</p></form>', f'<div class="{name}" data-y="0"><p>{words(5, 40)}</p><p>{words(5, 40)}</p></div>',
            f'<div id="{name}" data-y="0">{words(5, 30)}</div>', f'<section class="{name}" data-y="0"><h2>{words(1, 3)}</h2><div>{words(10, 50)}</div><ul>{links(2)}</ul></section>', f'<div class="{name}" data-y="0">{words(3, 9)}<a href="/y">{words(1, 3)}</a></div>',
            f'<ul data-y="0">{links(rng.randint(3, 9))}</ul>', f'<p class="{name}" data-y="0">{words(5, 20)}</p>', f'<ol class="{name}" data-y="0"><li><p>{words(8, 40)}</p></li><li><p>{words(8, 40)}</p></li></ol>',
        )[kind]

    def body(inner: bool) -> str:
        parts = [f"<h1>{words(3, 9)}</h1>"]
        for _ in range(rng.randint(1, 9)):
            parts.append(rng.choice((f"<p>{words(1, 6)}</p>", f"<p>{words(10, 80)}</p>", f"<p>{words(10, 80)}</p>", f"<p>{words(10, 60)} <a href='/z'>{words(1, 3)}</a> {words(5, 30)}</p>", f"<p>{words(5, 30)} <span class='ad' data-y='0'>{words(1, 6)}</span> {words(2, 9)}</p>", f"<p>{words(5, 30)} <span class='hl'>{words(1, 6)}</span></p>", f"<h2>{words(2, 6)}</h2>", f"<ul><li>{words(3, 15)}</li><li>{words(3, 15)}</li></ul>", f"<blockquote>{words(8, 30)}</blockquote>", f"<div><p>{words(8, 50)}</p></div>", f"<section><h2>{words(1, 5)}</h2><p>{words(8, 60)}</p></section>", f"<pre>{words(5, 20)}</pre>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<figure><figcaption>{words(3, 10)}</figcaption></figure>")))
            if inner and rng.random() < 0.12:
                parts.append(boiler())
        return "".join(parts)

    out = []
    for _ in range(n):
        wrap = rng.choice(('<article data-y="1">{}</article>', '<article data-y="1">{}</article>', '<main><article data-y="1">{}</article></main>', '<main data-y="1">{}</main>', '<div class="content" data-y="1">{}</div>', '<div id="main"><div class="post" data-y="1">{}</div></div>', '<div class="wrap"><article data-y="1"><header data-y="1"><h1>T</h1></header>{}</article></div>'))
        before, after = "".join(boiler() for _ in range(rng.randint(0, 3))), "".join(boiler() for _ in range(rng.randint(0, 3)))
        page = wrap.replace("{}", body(True))
        out.append(f'<html><head data-y="0"><title>{words(2, 5)}</title><style>p{{}}</style></head><body>{before}{page}{after}</body></html>')
    return out


def extract_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null html counts as empty and gives an empty text. Broken markup is read as browsers mostly do: unclosed elements end with their parents, an open head at the first thing that isn't metadata, an unclosed button or select at the next block, a tag cut off at the end is dropped. Repeated rows are read each; null ids and urls stay null. Other columns are not looked at. Empty input: empty output.
    """
    model = Model(labelled if labelled is not None else labelled_pages())

    @F.arrow_udf("string")
    def text(htmls: pa.Array) -> pa.Array:
        return pa.array([model.extract(h) for s in slices(htmls) for h in htmls.slice(*s).to_pylist()], pa.string())

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return own.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
