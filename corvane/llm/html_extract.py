"""Main-text extraction with a tree-structured graphical model.

The block elements of a page form a tree of binary variables: content or not.
A parent-child potential says how often a child is content below content and
below boilerplate; a node's own potential comes from its tag, class and id
words, share of linked text, length and punctuation. Sum-product messages
passed upward and then downward give each node's exact marginal. All
potentials are counts over labelled pages; the default ones are made by
``labelled_pages``, a generator of page layouts whose blocks are labelled as
they are written.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import text_column

#: Labelled pages that the default model is fitted on.
TRAINING_PAGES = 400
#: Added to every feature's count.
SMOOTHING = 0.02

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math textarea".split())
BLOCKS = frozenset("html head body title main article section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption details summary address button select option label hgroup menu dialog center hr".split())
#: Start tags that end an open paragraph, as HTML's parsing rules have it.
ENDS_P = BLOCKS - frozenset("html head body title tr td th thead tbody tfoot caption option label button select".split())
#: Elements that end an open element of their kind, up to the listed container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FRAME = frozenset(("#root", "html", "body"))
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
UNQUOTED = re.compile(r"[^>\"']*")
RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"\b(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: list[str]
    label: int | None = None
    text: int = 0  # characters of the node and all below it
    linked: int = 0
    own: int = 0  # characters of its own blocks
    ends: int = 0  # sentence ends in them


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, text) in page order


def markup(source: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of every tag, comment and declaration, in time linear in the
    page. A name starts with / in end tags and is empty for what is no tag; the text of raw
    elements belongs to their start tag.

    A quoted value may hold >. Once a quote proves to be open until the end of the page, quotes
    count no more. What has no > ahead is text, but for an open comment, which takes the rest.
    """
    at, last, quotes = 0, source.rfind(">"), True
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(source)
            yield start, at, "", ""
            continue
        if start > last:
            at = source.find("<!--", start)
            if at < 0:
                return
            continue
        if source.startswith(("<!", "<?"), start):
            at = source.find(">", start) + 1
            yield start, at, "", ""
            continue
        name = NAME.match(source, start + 1)
        if not name:
            at = start + 1
            continue
        end = UNQUOTED.match(source, name.end()).end() if quotes else source.find(">", name.end())
        while end < len(source) and source[end] != ">":
            close = source.find(source[end], end + 1)
            if close < 0:
                break
            end = UNQUOTED.match(source, close + 1).end()
        if end >= len(source) or source[end] != ">":
            quotes, end = False, source.find(">", name.end())  # there is one: ``last``
        tag, attributes, at = name[0].lower(), source[name.end() : end], end + 1
        if tag in RAW and not attributes.endswith("/"):
            close = RAW_END[tag].search(source, at)
            end = source.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(source)
        yield start, at, tag, attributes


def parse(source: str, labelled: bool = False) -> Page:
    """The tree of block elements, parents first, and the text of each block; ``labelled`` reads
    the labels of training pages."""
    page = Page([Node("#root", -1, [])])
    nodes, open_tags = page.nodes, [("#root", 0)]  # open_tags: (tag, its block node)
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open tags of a name
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                at = open_tags[-1][1]
                page.blocks.append((at, text))
                node = nodes[at]
                node.text += len(text)
                node.own += len(text)
                node.linked += min(linked, len(text))
                node.ends += text.count(". ") + text.count("? ") + text.count("! ") + (text[-1] in ".?!")
            linked = 0

    def text_piece(raw: str) -> None:
        nonlocal linked
        pieces.append(html.unescape(raw) if "&" in raw else raw)
        if places["a"]:
            linked += len(raw.strip())

    def close_down_to(k: int) -> None:
        while len(open_tags) > k:
            places[open_tags.pop()[0]].pop()

    at = 0
    for start, end, tag, attributes in markup(source):
        if start > at:
            text_piece(source[at:start])
        at = end
        if not tag or tag in RAW:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCKS:
                flush()
            if places[tag]:
                close_down_to(places[tag][-1])
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if tag in ENDS_P and places["p"]:
            close_down_to(places["p"][-1])
        if tag in SIBLINGS:
            same, stop = (max((places[t][-1] for t in kind if places[t]), default=-1) for kind in SIBLINGS[tag])
            if same > stop:
                close_down_to(same)
        if tag in BLOCKS:
            found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
            label = found.pop("data-label", None)
            names = sorted({w for v in found.values() for w in WORD.findall(v.lower())})
            nodes.append(Node(tag, open_tags[-1][1], names, int(label) if labelled and label else None))
            open_tags.append((tag, len(nodes) - 1))
        else:
            open_tags.append((tag, open_tags[-1][1]))
        places[tag].append(len(open_tags) - 1)
    if at < len(source):
        text_piece(source[at:])
    flush()
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.text += node.text
        up.linked += node.linked
    return page


def features(node: Node) -> list[str]:
    share = 10 * node.linked // node.text if node.text else -1
    return [
        f"tag {node.tag}",
        *(f"name {w}" for w in node.names),
        f"linked {-1 if share < 0 else (share > 2) + (share > 6)}",
        f"length {min(4, len(str(node.own // 10))) if node.own else 0}",
        f"ends {min(2, node.ends) if node.own else -1}",
    ]


@dataclass
class Model:
    """``below[f][p]``: chance that a child of a node of label p is content, for parents inside the
    page (f = 0) and for its frame, html and body (f = 1), which hold content and boilerplate side
    by side; ``weight``: log likelihood ratio of each feature."""

    below: tuple[tuple[float, float], tuple[float, float]]
    weight: dict[str, float]

    @classmethod
    def fit(cls, pages: list[str]) -> Model:
        """From pages whose blocks carry data-label="0" or "1"; blocks without one take their parent's."""
        edges, seen, total = Counter(), (Counter(), Counter()), Counter()
        for source in pages:
            nodes = parse(source, labelled=True).nodes
            labels = [1]
            for node in nodes[1:]:
                labels.append(labels[node.parent] if node.label is None else node.label)
                edges[nodes[node.parent].tag in FRAME, labels[node.parent], labels[-1]] += 1
                total[labels[-1]] += 1
                seen[labels[-1]].update(features(node))
        below = tuple(tuple((edges[f, p, 1] + 0.5) / (edges[f, p, 0] + edges[f, p, 1] + 1) for p in (0, 1)) for f in (0, 1))
        weight = {f: log((seen[1][f] + SMOOTHING) / total[1]) - log((seen[0][f] + SMOOTHING) / total[0]) for f in {*seen[0], *seen[1]}}
        return cls(below, weight)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node, by sum-product on odds."""
        known, low, high = self.weight, 1e-30, 1e30
        chance = [self.below[nodes[n.parent].tag in FRAME] for n in nodes]
        own = [exp(max(-40.0, min(40.0, sum(known.get(f, 0.0) for f in features(n))))) for n in nodes]
        own[0] = high  # the root stands above the page
        up = [1.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after parents
            o, (q0, q1) = own[i], chance[i]
            up[i] = (o * q1 + 1 - q1) / (o * q0 + 1 - q0)
            p = nodes[i].parent
            own[p] = max(low, min(high, own[p] * up[i]))
        odds = own[:1]
        for i in range(1, len(nodes)):
            q0, q1 = chance[i]
            rest = max(low, min(high, odds[nodes[i].parent] / up[i]))
            down = (rest * q1 + q0) / (rest * (1 - q1) + 1 - q0)
            odds.append(max(low, min(high, own[i] * down)))
        return [o / (1 + o) for o in odds]

    def main_text(self, source: str) -> str:
        page = parse(source)
        content = self.marginals(page.nodes)
        return "\n".join(text for at, text in page.blocks if content[at] > 0.5)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7) -> list[str]:
    """Page layouts with labelled blocks: articles in various containers among menus,
    headers, footers, sidebars, notices, adverts, forms and reader comments."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    letters = "aeioulnrstmdp"

    def words(k: int) -> str:
        return " ".join("".join(pick(letters) for _ in range(rng.randint(2, 9))) for _ in range(k))

    def prose(k: int | None = None) -> str:
        parts = []
        for _ in range(k or rng.randint(1, 6)):
            s = words(rng.randint(3, 18)).capitalize()
            parts.append((f'{s} <a href="/x">{words(2)}</a>' if chance(0.08) else s) + pick([".", ".", ".", "!", "?"]))
        return pick([" ", " "]).join(parts) if chance(0.9) else words(rng.randint(1, 30)).upper()

    def block(tag: str, label: int, body: str, names: str = "") -> str:
        attribute = f' {pick(["class", "class", "id"])}="{names}"' if names else ""
        return f'<{tag} data-label="{label}"{attribute}>{body}</{tag}>'

    def links(k: int) -> str:
        return block("ul", 0, "".join(block("li", 0, f'<a href="/{words(1)}">{words(rng.randint(1, 3))}</a>') for _ in range(k)))

    def article() -> str:
        out = [block("h1", 1, words(rng.randint(1, 9)))] if chance(0.9) else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.68:
                out.append(block("p", 1, prose()))
            elif kind < 0.76:
                out.append(block(pick(["h2", "h3", "h4"]), 1, words(rng.randint(1, 6))))
            elif kind < 0.82:
                out.append(block(pick(["ul", "ol"]), 1, "".join(block("li", 1, prose(1)) for _ in range(rng.randint(2, 5)))))
            elif kind < 0.86:
                out.append(block("blockquote", 1, block("p", 1, prose())))
            elif kind < 0.89:
                out.append(block("pre", 1, words(12)))
            elif kind < 0.92:
                cells = lambda t: "".join(block(t, 1, words(2)) for _ in range(3))
                out.append(block("table", 1, block("tbody", 1, block("tr", 1, cells("th")) + "".join(block("tr", 1, cells("td")) for _ in range(3)))))
            elif kind < 0.95:
                out.append(block("figure", 1, block("figcaption", 1, prose(1))))
            elif kind < 0.97:
                out.append(block("section", 1, block("h2", 1, words(3)) + block("p", 1, prose())))
            else:
                out.append(block("div", 1, prose()))
            if chance(0.07):
                out.append(advert())
        return "".join(out)

    def advert() -> str:
        names = pick(["ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "banner", "ad-slot"])
        return block(pick(["div", "div", "aside", "section"]), 0, pick([prose(), block("p", 0, prose()), f'<a href="/b">{words(4)}</a>']), names)

    def boilerplate() -> list[str]:
        notice = pick(["cookie", "cookie-notice", "notice", "consent", "gdpr", "popup", "newsletter", "alert", "subscribe", "modal", "overlay"])
        field_ = block("label", 0, words(2)) + "<input name=q>" + block("button", 0, words(1))
        form = block("form", 0, pick([field_, block("p", 0, prose(1)) + field_, block("div", 0, field_)]), pick(["", "search", "login", "signup", "contact"]))
        side = block(pick(["aside", "aside", "div"]), 0, block("h3", 0, words(2)) + pick([links(4), block("p", 0, prose()), block("div", 0, prose(1))]), pick(["sidebar", "side", "widget", "related", "recommended", "trending"]))
        comment = lambda: block(pick(["div", "li", "article"]), 0, pick(["", block("h4", 0, words(1))]) + block("p", 0, prose()), pick(["comment", "comment-body", "reply"]))
        comments = block(pick(["section", "div", "ol"]), 0, block("h2", 0, words(1)) + "".join(comment() for _ in range(rng.randint(1, 4))), pick(["comments", "comment-list", "discussion", "responses", "disqus"]))
        share = block("div", 0, links(3), pick(["share", "social", "breadcrumb", "breadcrumbs", "tags", "pagination", "pager", "menu", "nav", "navbar", "toolbar"]))
        return [x for x, p in ((advert(), 0.6), (block("div", 0, block("p", 0, prose()) + pick(["", block("button", 0, words(1))]), notice), 0.4), (form, 0.4), (side, 0.5), (comments, 0.4), (share, 0.4)) if chance(p)]

    out = []
    for _ in range(n):
        head = block("head", 0, '<meta charset="utf-8">' + block("title", 0, words(5)))
        top = pick([block("header", 0, block("h1", 0, words(2)) + block("p", 0, words(4)) if chance(0.3) else block("div", 0, words(2))), ""]) + (block("nav", 0, links(rng.randint(2, 8))) if chance(0.8) else block("div", 0, links(rng.randint(2, 8)), pick(["menu", "nav", "navigation", "topbar"])))
        foot = block("footer", 0, pick([f"&copy; {words(2)}. {prose(1)}", links(4) + block("p", 0, prose(1))])) if chance(0.8) else block("div", 0, f"&copy; {prose(1)}", pick(["footer", "copyright", "legal", "bottom"]))
        tag, names = pick([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "main"), ("section", "article"), ("div", "post-body entry"), ("div", "")])
        body = block(tag, 1, article(), names)
        if chance(0.15):
            body = article()
        elif chance(0.3):
            body = block(pick(["main", "div"]), 1, body, pick(["", "wrapper", "page", "container"]))
        extra = boilerplate()
        k = rng.randint(0, len(extra))
        out.append(f'<html data-label="1">{head}{block("body", 1, top + "".join(extra[:k]) + body + "".join(extra[k:]) + foot)}</html>')
    return out


def extract_pages(pages: DataFrame, model: Model | None = None, html_name: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty html, and pages without content, give the empty text. Very long
    and broken pages are parsed whole, in time linear in their length. Repeated
    rows are repeated; page_id and url pass through, null or not; other columns
    are not read. The model is a few hundred numbers, whatever the data.
    """
    fitted = model or Model.fit(labelled_pages())
    rows = pages.select("page_id", "url", text_column(pages, html_name).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [fitted.main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
