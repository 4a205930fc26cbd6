"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

The page is parsed leniently (unclosed and implied ends, raw-text elements, comments, quoted
attributes). Every element and every block of text is a node with features of its subtree density,
attribute tokens, depth and siblings; the trees give the odds that a node holds main text, and a
tree dynamic program picks the best set in which no node is kept under a dropped one. Scripts,
styles, form controls and other parts that are never prose are not nodes at all.

Null, empty and text-free pages give the empty text. Character references are decoded, white space
in a block (str.split's), a br too, becomes one space. Only block elements end a block: pictures,
scripts, controls, breaks within words and unknown elements stay inside the sentence that holds
them. Blocks are joined by one newline. A page without any markup is its own main text. Repeated
rows give repeated texts; other columns are not read; page ids of any type, null included, come back
as they were. Of equal odds, a node is dropped. A page of any length is one tree, read in linear
time: a tag ends at the first > outside quoted attribute values, a quote that never closes counts as
an ordinary character, what follows the last > of the page in an open tag is dropped, as browsers
do, and the open elements of each name are kept, so that an end tag costs the same at any depth.

The trees are fitted on pages drawn by page_sample from a seeded generator of layouts, whose main
blocks are known; that sample is the documented bound of the training set. It is fitted once per
driver, in a few seconds.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm.common import map_batches, text_of
from lexforge.llm.gbt import BoostedTrees

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+)>""")
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

# Fixed values of HTML: elements by how they nest and show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style textarea title noscript template iframe noembed noframes head select datalist option button svg canvas object audio video input annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl body html div article section main aside".split())
# Words that authors put in class, id and role names.
TOKENS = {
    "main": "article articlebody blog body content entry main maincontent post story text".split(),
    "nav": "breadcrumb breadcrumbs menu menubar nav navbar navigation pager pagination tabs toc toolbar".split(),
    "top": "banner brand header head masthead top topbar".split(),
    "foot": "bottom copyright footer footers".split(),
    "side": "aside author bio complementary more popular recent recommended related rail sidebar side tags widget".split(),
    "notice": "alert alertdialog consent cookie cookies dialog gdpr modal notice notification overlay popup privacy".split(),
    "advert": "ad ads adsense advert advertisement adverts dfp promo promotion promoted sponsor sponsored".split(),
    "form": "contact form login newsletter register search searchbox signup subscribe subscription".split(),
    "talk": "comment comments commentlist discussion disqus replies reply respond reviews".split(),
    "share": "follow share sharing social".split(),
}
_KIND = {w: k for k, words in TOKENS.items() for w in words}
_TAGS = {"main": ("article", "main"), "nav": ("nav", "menu"), "top": ("header",), "foot": ("footer",), "aside": ("aside",), "form": ("form", "fieldset"), "p": ("p", "pre", "blockquote"), "head": ("h1", "h2", "h3", "h4", "h5", "h6"), "list": ("ul", "ol", "dl"), "item": ("li", "dt", "dd"), "table": ("table", "tr", "td", "th", "tbody"), "figure": ("figure", "figcaption", "img"), "div": ("div", "section", "span", "center")}
_TAG_OF = {t: k for k, ts in _TAGS.items() for t in ts}
TAG_KINDS, TOKEN_KINDS = tuple(_TAGS), tuple(TOKENS)
FEATURES = (
    *(f"tag_{t}" for t in TAG_KINDS), *(f"own_{k}" for k in TOKEN_KINDS), *(f"above_{k}" for k in TOKEN_KINDS),
    *(f"under_{t}" for t in ("main", "nav", "top", "foot", "aside", "form", "item", "head")),
    "block", "depth", "siblings", "sibling_at", "same_siblings", "children", "log_text", "text_share", "link_ratio", "text_per_node",
    "p_below", "main_below", "sentences", "commas", "words_per_block", "page_at", "next_text", "previous_text", "item_ratio",
)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: set[str] = field(default_factory=set)
    text: str | None = None  # of a block
    chars: int = 0
    linked: int = 0


def parse(source: str) -> list[Node]:
    """Nodes in page order, a parent before its children; node 0 is the page."""
    nodes = [Node("#page", -1, 0)]
    stack = [0]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
    holders = [0]  # where the open block elements are
    texts: list[str] = []
    unseen = linked = block = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            words = " ".join("".join(texts).split())
            texts.clear()
            if words:
                nodes.append(Node("#text", block, nodes[block].depth + 1, set(), words, len(words), min(linked, len(words))))
        linked = 0

    def add(raw: str) -> None:
        nonlocal block, linked
        if unseen or not raw:
            return
        words = html.unescape(raw)
        if not texts:
            if words.isspace():
                return
            block = stack[holders[-1]]
        texts.append(words)
        if places.get("a"):
            linked += len(words.strip())

    def pop_to(depth: int) -> None:
        nonlocal unseen
        while len(stack) > depth:
            tag = nodes[stack.pop()].tag
            places[tag].pop()
            unseen -= tag in UNSEEN
        while holders[-1] >= depth:
            holders.pop()

    def nearest(tags: frozenset[str] | set[str]) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_implied(tags: set[str]) -> None:
        """Ends the elements of these names in which no list, table or section was opened."""
        scope = nearest(SCOPE)
        while (k := nearest(tags)) > scope:
            pop_to(k)

    at, end = 0, len(source)
    while at < end:
        start = source.find("<", at)
        if start < 0:
            add(source[at:])
            break
        add(source[at:start])
        follows = source[start + 1 : start + 2]
        if follows in ("!", "?"):
            opening, closing = next((p for p in (("<!--", "-->"), ("<![CDATA[", "]]>")) if source.startswith(p[0], start)), (source[start : start + 2], ">"))
            stop = source.find(closing, start + len(opening))
            if opening == "<![CDATA[":
                add(html.escape(source[start + len(opening) : stop if stop >= 0 else end]))
            at = stop + len(closing) if stop >= 0 else end
            continue
        m = _TAG.match(source, start)
        if m is None:
            named = follows == "/" and source[start + 2 : start + 3] or follows
            if named.isascii() and named.isalpha():
                break  # no > follows outside quotes
            add("<")
            at = start + 1
            continue
        at = m.end()
        tag = m.group(2).lower()
        if tag == "br":
            add("\n")
            continue
        if m.group(1):
            depth = nearest({tag})
            if depth:
                if tag in BLOCK:
                    flush()
                elif tag not in UNSEEN and holders[-1] > depth:
                    continue  # a stray end of formatting does not end the blocks opened since
                pop_to(depth)
            elif tag == "p":
                flush()
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in BLOCK:
            flush()
        if tag == "body" and places.get("head"):
            pop_to(places["head"][0])
        if tag in ENDS_P:
            close_implied({"p"})
        if tag in CLOSES:
            close_implied(CLOSES[tag])
        if tag in VOID or m.group(3).endswith("/") and tag not in RAW and tag in UNSEEN:
            continue
        node = Node(tag, stack[-1], nodes[stack[-1]].depth + 1)
        if m.group(3):
            for a in _ATTR.finditer(m.group(3)):
                node.tokens.update(_KIND[w] for w in map(str.lower, _SPLIT.split(a[2] or a[3] or a[4] or "")) if w in _KIND)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            holders.append(len(stack))
        nodes.append(node)
        stack.append(len(nodes) - 1)
        unseen += tag in UNSEEN
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            add(html.escape(source[at : close.start() if close else end]))
            at = close.end() if close else end
            if tag in BLOCK:
                flush()
            pop_to(len(stack) - 1)
    flush()
    return nodes


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row of FEATURES per node."""
    n = len(nodes)
    chars, linked, blocks, size, p_below, items, sentences, commas, main_below = (np.zeros(n) for _ in range(9))
    children, at_child, same = np.zeros(n), np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    tags: dict[tuple[int, str], int] = {}
    before = np.zeros(n)
    seen = 0.0
    for i, x in enumerate(nodes):
        before[i] = seen
        size[i] = 1
        if x.text is not None:
            chars[i], linked[i], blocks[i] = x.chars, x.linked, 1
            sentences[i] = x.text.count(". ") + (x.text[-1:] in ".!?")
            commas[i] = x.text.count(",")
            seen += x.chars
        p_below[i], items[i], main_below[i] = x.tag == "p", x.tag == "li", x.tag in ("article", "main") or "main" in x.tokens
        if x.parent >= 0:
            at_child[i] = children[x.parent]
            children[x.parent] += 1
            last[x.parent] = i
            tags[x.parent, x.tag] = tags.get((x.parent, x.tag), 0) + 1
    parents = np.array([x.parent for x in nodes])
    for total in (chars, linked, blocks, size, p_below, items, sentences, commas, main_below):
        for i in range(n - 1, 0, -1):
            total[parents[i]] += total[i]
    page = max(chars[0], 1.0)
    leaf = [i for i in range(n) if nodes[i].text is not None]
    after, previous = np.zeros(n), np.zeros(n)
    for k, i in enumerate(leaf):
        after[i] = chars[leaf[k + 1]] if k + 1 < len(leaf) else 0
        previous[i] = chars[leaf[k - 1]] if k else 0
    out = np.zeros((n, len(FEATURES)))
    col = {f: j for j, f in enumerate(FEATURES)}
    above: list[frozenset[str]] = [frozenset()] * n
    under: list[frozenset[str]] = [frozenset()] * n
    for i, x in enumerate(nodes):
        kind = _TAG_OF.get(x.tag)
        if kind:
            out[i, col[f"tag_{kind}"]] = 1
        for t in x.tokens:
            out[i, col[f"own_{t}"]] = 1
        if x.parent >= 0:
            p = nodes[x.parent]
            above[i] = above[x.parent] | p.tokens if p.tokens else above[x.parent]
            pk = _TAG_OF.get(p.tag)
            under[i] = under[x.parent] | {pk} if pk and pk not in under[x.parent] else under[x.parent]
            same[i] = tags[x.parent, x.tag]
        for t in above[i]:
            out[i, col[f"above_{t}"]] = 1
        for t in under[i]:
            if f"under_{t}" in col:
                out[i, col[f"under_{t}"]] = 1
    values = {
        "block": [x.text is not None for x in nodes], "depth": [x.depth for x in nodes], "siblings": np.where(parents >= 0, children[parents], 1), "sibling_at": at_child / np.maximum(np.where(parents >= 0, children[parents], 1), 1),
        "same_siblings": same, "children": children, "log_text": np.log1p(chars), "text_share": chars / page, "link_ratio": linked / np.maximum(chars, 1), "text_per_node": chars / size, "p_below": p_below, "main_below": main_below,
        "sentences": sentences / np.maximum(blocks, 1), "commas": commas / np.maximum(blocks, 1), "words_per_block": chars / np.maximum(blocks, 1), "page_at": before / page, "next_text": np.log1p(after), "previous_text": np.log1p(previous), "item_ratio": items / size,
    }
    for name, v in values.items():
        out[:, col[name]] = v
    return out


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """Kept flags of highest total odds in which a kept node's ancestors are all kept."""
    n = len(nodes)
    logits = np.clip(logits, -4, 4)
    below, keep = logits.copy(), logits.copy()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        below[p] += below[i]
        keep[p] += max(keep[i], -below[i])
    kept = np.zeros(n, dtype=bool)
    for i, x in enumerate(nodes):
        kept[i] = (x.parent < 0 or kept[x.parent]) and keep[i] > -below[i]
    return kept


def page_sample(count: int, seed: int) -> list[tuple[str, set[str]]]:
    """(html, texts of its main blocks) of generated pages in many layouts."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    some = lambda x, p: x if rng.random() < p else ""
    syllables = ["ba", "con", "de", "er", "fi", "gra", "hel", "in", "jo", "ka", "lum", "men", "nor", "os", "pre", "qui", "ra", "sti", "tor", "un", "ver", "wy", "xe", "zu", "é", "ü"]

    def words(n: int) -> str:
        return " ".join("".join(pick(*syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(n))

    def sentence(lo: int = 5, hi: int = 18) -> str:
        w = words(int(rng.integers(lo, hi)))
        return w.capitalize().replace(" ", ", ", int(rng.random() < 0.4)) + pick(".", ".", ".", "!", "?")

    def prose(lo: int = 1, hi: int = 7) -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(lo, hi))))

    def element(tag: str, body: str, names: tuple[str, ...] = ()) -> str:
        attr = f' {pick("class", "id")}="{pick(*names)}"' if names and rng.random() < 0.85 else ""
        return f"<{tag}{attr}>{body}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{words(int(rng.integers(1, 4)))}</a>{pick("</li>", "</li>", "")}' for _ in range(n)) + "</ul>"

    pages = []
    for _ in range(count):
        main: list[str] = []

        def own(text: str, main: list[str] = main) -> str:
            main.append(" ".join(text.split()))
            return text

        def named(tag: str, body: str, names: tuple[str, ...]) -> str:
            return f'<{tag} {pick("class", "id")}="{pick(*names)}">{body}</{tag}>'

        def bare(tag: str, body: str, names: tuple[str, ...]) -> str:
            return f"<{tag}>{body}</{tag}>"

        def advert() -> str:
            return named(pick("div", "div", "aside", "section"), pick(sentence(), prose(1, 3), f'<a href="#">{words(4)}</a>'), ("ad", "ads", "advert", "sponsored", "ad-slot", "promo"))

        def paragraph(body: str) -> str:
            style = rng.random()
            if style < 0.7:
                return f"<p>{body}</p>"
            return f"<p>{body}" if style < 0.85 else f"<p><b>{body}<br>"

        def content() -> str:
            out = []
            if rng.random() < 0.85:
                title = own(sentence(4, 12))
                out.append(pick(f"<h1>{title}</h1>", f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>"))
            for _ in range(int(rng.integers(1, 14)) if rng.random() < 0.85 else int(rng.integers(1, 3))):
                what = rng.random()
                if what < 0.66:
                    out.append(paragraph(own(pick(prose(), prose(), sentence(1, 6), words(1).capitalize() + "."))))
                elif what < 0.74:
                    out.append(f"<h{pick(2, 3)}>{own(words(int(rng.integers(1, 7))))}</h{pick(2, 3)}>")
                elif what < 0.82:
                    out.append("<ul>" + "".join(f"<li>{own(sentence(3, 14))}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
                elif what < 0.87:
                    out.append(f"<blockquote>{paragraph(own(prose(1, 3)))}</blockquote>")
                elif what < 0.91:
                    out.append(f"<pre><code>{own(words(6))}</code></pre>")
                elif what < 0.94:
                    out.append("<table>" + "".join(f"<tr><td>{own(words(3))}</td><td>{own(words(2))}</td></tr>" for _ in range(3)) + "</table>")
                elif what < 0.955:
                    out.append(advert())
                elif what < 0.98:
                    cards = "".join(named(pick("div", "article", "li"), f'<h{pick(3, 4)}><a href="/{words(1)}">{sentence(3, 9)}</a></h4>' + some(f"<p>{sentence()}</p>", 0.6), ("card", "teaser", "item")) for _ in range(int(rng.integers(2, 5))))
                    out.append(cards if rng.random() < 0.3 else named(pick("section", "div", "aside"), f"<h{pick(2, 3)}>{words(2)}</h3>" + cards, ("related", "recommended", "more", "popular")))
                else:
                    out.append(named("div", links(3), ("share", "social-share", "related", "tags")))
            return "".join(out)

        tag = pick("article", "article", "main", "div", "div", "section")
        names = ("content", "post", "article-body", "entry-content", "main-content", "story", "text")
        body = content()
        kind = rng.random()
        if 0.25 <= kind < 0.4:  # short notes without names: a menu, a few paragraphs, a foot
            body = "".join(f"<p>{own(pick(sentence(1, 4), sentence(), prose(1, 3)))}</p>" for _ in range(int(rng.integers(1, 4))))
            tag = pick("div", "div", "article", "main", "section")
        middle = element(tag, body, () if tag in ("article", "main") and rng.random() < 0.6 else names)
        if tag in ("div", "section") and not middle.startswith(f"<{tag} "):
            middle = middle.replace(f"<{tag}>", f'<{tag} class="{pick(*names)}">', 1) if rng.random() < 0.6 else middle
        talk = named(pick("section", "div", "ol"), "<h3>" + words(2) + "</h3>" + "".join(element(pick("div", "li", "article"), paragraph(prose(1, 4)), ("comment", "reply", "comment-body")) for _ in range(int(rng.integers(1, 6)))), ("comments", "comment-list", "disqus", "replies"))
        side = element(pick("aside", "aside", "div"), "<h3>" + words(2) + "</h3>" + pick(links(5), paragraph(prose(1, 3)), links(4) + paragraph(sentence())), ("sidebar", "widget", "related", "rail"))
        if side.startswith("<div>"):
            side = side.replace("<div>", '<div class="sidebar">', 1)
        form = pick(element, element, bare)(pick("form", "form", "div"), some(f"<h{pick(2, 3, 4)}>{words(2)}</h3>", 0.3) + pick(sentence(3, 8), f"<p>{sentence(3, 12)}</p>", f"<p>{prose(1, 3)}</p>") + pick('<input name="q">', f'<label>{words(1)} <input name="q"></label>', f'<p><label for="q">{words(2)}</label><input id="q"></p>') + f"<button>{words(1)}</button>", ("login", "newsletter", "search-form", "subscribe"))
        if form.startswith("<div>"):
            form = form.replace("<div>", '<div id="newsletter">', 1)
        notice = element("div", pick(sentence(), prose(1, 3)) + f"<button>{words(1)}</button>", ("cookie-notice", "consent", "alert", "gdpr", "popup"))
        if notice.startswith("<div>"):
            notice = notice.replace("<div>", '<div class="cookie">', 1)
        head = element(pick("header", "header", "div"), pick(words(2), f"<a href='/'>{words(2)}</a>", f"<h1>{words(2)}</h1>{sentence()}"), ("header", "masthead", "top", "banner"))
        if head.startswith("<div>"):
            head = head.replace("<div>", '<div id="header">', 1)
        nav = element(pick("nav", "nav", "div"), links(int(rng.integers(2, 9))), ("menu", "nav", "navbar", "breadcrumb"))
        foot = pick(element, element, bare)(pick("footer", "footer", "div"), pick(f"&copy; {words(2)} &middot; {sentence()}", links(4) + sentence(), prose(1, 3), f"<p>{sentence(3, 9)}</p>", f"<p>{prose(1, 4)}</p>", f"<p>&copy; {words(2)}</p><p>{sentence()}</p>", sentence(2, 7)), ("footer", "bottom", "copyright"))
        if foot.startswith("<div>"):
            foot = foot.replace("<div>", '<div class="footer">', 1)
        if kind < 0.25:  # bare pages: no wrapper, sometimes no markup
            main.clear()
            plain = pick("".join(f"<p>{own(pick(prose(), sentence(1, 4)))}</p>" for _ in range(int(rng.integers(1, 6)))), own(prose(1, 9)), "<h1>" + own(sentence(3, 9)) + "</h1>" + own(prose(1, 9)))
            rest = some(form, 0.3) + some(foot, 0.8)
            pages.append((pick(plain, f"<html><body>{plain}</body></html>", *[f"<html><body>{some(head, 0.3)}{some(nav, 0.5)}{plain if plain.startswith('<p>') else f'<div>{plain}</div>'}{rest}</body></html>"] * 3), set(main)))
            continue
        if rng.random() < 0.1:  # columns laid out as cells of a table
            middle = f'<table width="100%"><tr>{some(named("td", links(4), ("menu", "nav", "sidebar")), 0.7)}<td>{pick(body, middle)}</td></tr></table>'
        core = pick(middle + some(talk, 0.35), middle + some(talk, 0.35), f'<div class="{pick("wrap", "container", "row", "main")}">{middle}{some(side, 0.7)}{some(talk, 0.3)}</div>')
        body = some(notice, 0.25) + some(head, 0.5) + some(nav, 0.85) + some(advert(), 0.5) + some(form, 0.15) + some(side, 0.2) + core + some(side, 0.25) + some(advert(), 0.2) + some(form, 0.2) + some(foot, 0.9) + some(notice, 0.1)
        pages.append((f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{body}</body></html>", set(main)))
    return pages


def train(pages: int = 600, seed: int = 5) -> BoostedTrees:
    """Trees fitted on generated pages; a node is positive if main text lies in its subtree."""
    x, y = [], []
    for source, main in page_sample(pages, seed):
        nodes = parse(source)
        good = np.array([n.text is not None and n.text in main for n in nodes], dtype=float)
        for i in range(len(nodes) - 1, 0, -1):
            good[nodes[i].parent] = max(good[nodes[i].parent], good[i])
        x.append(node_features(nodes))
        y.append(good)
    return BoostedTrees(rounds=50, depth=5, rate=0.3, bins=32).fit(np.concatenate(x), np.concatenate(y))


@functools.lru_cache(maxsize=1)
def default_trees() -> BoostedTrees:
    return train()


def main_texts(sources: list[str], trees: BoostedTrees) -> list[str]:
    """Main texts of some pages, scored together."""
    parsed = [parse(s) for s in sources]
    if not parsed:
        return []
    logits = trees.margin(np.concatenate([node_features(n) for n in parsed]))
    out, at = [], 0
    for nodes in parsed:
        kept = decode(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(n.text for n, k in zip(nodes, kept, strict=True) if k and n.text is not None))
    return out


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), trees: BoostedTrees | None = None) -> DataFrame:
    """keep columns, text and n_chars of every page."""
    shared = df.sparkSession.sparkContext.broadcast(trees or default_trees())  # bounded by rounds and depth

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts = []
        for at in range(0, len(frame), 64):
            texts += main_texts([text_of(t) for t in frame["t"].iloc[at : at + 64]], shared.value)
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    columns = [*(df[c].alias(f"k{i}") for i, c in enumerate(keep)), df[html_col].alias("t")]
    got = map_batches(df.select(*columns), run, "text string, n_chars long", carry=[f"k{i}" for i in range(len(keep))])
    for i, c in enumerate(keep):
        got = got.withColumnRenamed(f"k{i}", c)
    return got


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
