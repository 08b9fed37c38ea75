"""HTML extraction by a tree-structured graphical model.

Each block element of a page is a node with a binary variable (content or not). Node potentials are
learned weights of its tag, its parent's tag, the landmark element around it, its class, id and role
words, the length, links and punctuation of its text and its subtree, headings, paragraphs and
controls among its children, siblings built like it, and cue words of short texts (CUES, English
only; they weigh in, but none decides alone); one learned table couples
every child with its parent. Sum-product messages pass from the leaves to the root and back, all
pages of a batch at once, level by level, and give exact marginals. Weights are fitted by maximum
likelihood on labelled pages: a bounded sample of the table's own pages whose <article> or <main>
element marks the content, and generated pages (generate_pages) with known labels in semantic and
div-and-class layouts with side bars, notices, adverts, forms and reader comments.

Text is cut at the borders of block elements; a block belongs to its nearest block element and is
kept when that node's content marginal is at least 0.5; where no block reaches that, the blocks within
half of the best marginal are, if it is at least FAINT (else the text is empty). Character references are decoded, white
space (a <br> too) becomes one space, blocks are trimmed and joined by one line feed.

parse() takes markup as browsers do: <html>, <head> and <body> tags and the end tags of p, li, dt,
dd, tr, td, th and the like may be missing; a quotation mark opens a value only after "="; inline
end tags do not close the blocks that were opened inside them. Its time grows with the page's
length, whatever is nested or left open. Nodes below MAX_DEPTH hang on the ancestor at that depth.

Defined cases: null html is empty and gives an empty text; text outside any element belongs to the
page's root; unclosed comments, scripts and tags run to the end; a quotation mark that never closes
is an ordinary character; end tags without a start are ignored; very long pages are taken whole (a
block of BLOCK_BYTES or one page is in memory at a time); repeated pages are extracted each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import blocks

#: Pages that training reads at most, in hash order, and the length below which a page may be one of them.
TRAIN_PAGES, TRAIN_CHARS = 300, 50_000
GENERATED_PAGES = 600
BUCKETS = 1 << 12
MAX_DEPTH = 512
#: The least marginal that the best block of a page without any likely block needs for the page to have a text.
FAINT = 0.03
#: Bytes of markup that are parsed together.
BLOCK_BYTES = 400_000
#: Elements that make blocks, that have no end tag, whose content is raw text that is not shown, whose text
#: is not shown, and tags that change nothing.
BLOCK = frozenset(
    "div section article main nav header footer aside form fieldset ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hgroup menu dialog center button object canvas video audio search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe noembed noframes".split())
HIDDEN = frozenset("template select option optgroup datalist".split())
IGNORED = frozenset(("html", "head", "body"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that implied ends do not reach through, and what a start tag closes up to which elements.
WALLS = frozenset("table td th caption button object template".split())
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)), "option": (("option",), ("select",)),
}
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
#: Words that notices, comments, related items, adverts and page ends tend to begin with or hold in few words.
CUES = {
    "notice": frozenset("cookie cookies consent privacy gdpr accept".split()),
    "reply": frozenset("comment comments reply replies says commented responses".split()),
    "more": frozenset("related recommended more trending popular latest share subscribe newsletter follow sign".split()),
    "advert": frozenset("advertisement sponsored promoted sale offer discount".split()),
    "end": frozenset("copyright rights reserved terms powered ©".split()),
}
LANDMARKS = ("", "article", "main", "nav", "aside", "footer", "header", "form", "section")
#: Class, id and role words that mark clutter inside an <article> when its pages are taken as labelled.
CLUTTER = frozenset("ad ads advert advertisement sponsored promo share social comment comments reply replies related newsletter cookie cookies notice banner popup subscribe menu nav navbar sidebar breadcrumb breadcrumbs".split())
_PIECE = re.compile(
    r"""(?P<text>[^<]++)|<!--(?:-?>|.*?(?:--!?>|\Z))|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"""
    r"""|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<bare><)""",
    re.S,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
TAGS = ("#page", *sorted(BLOCK))
_TAG = {t: i for i, t in enumerate(TAGS)}


class Page(NamedTuple):
    parent: np.ndarray  # of each node; node 0 is the page
    depth: np.ndarray
    tag: np.ndarray  # index into TAGS
    landmark: np.ndarray  # index into LANDMARKS
    own: np.ndarray  # words of the node's own text
    links: np.ndarray  # those inside links
    stops: np.ndarray  # sentence ends
    names: list[tuple[int, str]]  # (node, class, id or role word, or cue word of a short text)
    blocks: list[tuple[int, str]]  # (node, text)


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


_known: dict[str, int] = {}


def _id(name: str) -> int:
    if name not in _known:
        if len(_known) > 100_000:
            _known.clear()
        _known[name] = _feature(name)
    return _known[name]


def parse(source: str) -> Page:
    """Block nodes (0 is the page), what their features need, and the page's text blocks in order."""
    parent, depth, tags, landmark = array("i", [-1]), array("i", [0]), array("i", [0]), array("i", [0])
    own, links, stops = array("i", [0]), array("i", [0]), array("i", [0])
    names: list[tuple[int, str]] = []
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block node they belong to; '' was closed early
    at: dict[str, list[int]] = defaultdict(list)  # places of each tag's open elements in the stack
    walls, blocks_at = [0], [0]  # places of walls and of block elements
    text: list[str] = []
    linked = hidden = 0

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                out.append((stack[-1][1], joined))

    def forget(tag: str) -> None:
        nonlocal linked, hidden
        at[tag].pop()
        linked -= tag == "a"
        hidden -= tag in HIDDEN

    def pop_to(place: int) -> None:
        while len(stack) > place:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
                blocks_at.pop()
            stack.pop()
            if tag:
                forget(tag)
                if tag in WALLS:
                    walls.pop()

    def end(tag: str) -> None:
        if not at[tag]:
            return
        place = at[tag][-1]
        if tag in TABLE_PARTS or tag in WALLS or (tag in BLOCK and place > walls[-1]):
            pop_to(place)
        elif tag not in BLOCK:
            if place > blocks_at[-1]:
                pop_to(place)
            else:  # an inline element that was opened around blocks: it ends, they go on
                stack[place] = ("", stack[place][1])
                forget(tag)

    def start(tag: str, rest: str) -> None:
        nonlocal linked, hidden
        if tag in BLOCK:
            if at["p"] and at["p"][-1] > walls[-1]:
                pop_to(at["p"][-1])
            if tag in HEADINGS and stack[blocks_at[-1]][0] in HEADINGS:
                pop_to(blocks_at[-1])
        if tag in CLOSES:
            closed, around = CLOSES[tag]
            limit = max((at[t][-1] for t in around if at[t]), default=0)
            places = [at[t][-1] for t in closed if at[t] and at[t][-1] > limit]
            if places:
                pop_to(min(places))
        node = stack[-1][1]
        if tag in BLOCK:
            flush()
            up = parent[node] if depth[node] >= MAX_DEPTH else node
            node = len(parent)
            parent.append(up)
            depth.append(depth[up] + 1)
            tags.append(_TAG[tag])
            landmark.append(LANDMARKS.index(tag) if tag in LANDMARKS else landmark[up])
            for counts in (own, links, stops):
                counts.append(0)
            if rest:
                words = _NAME.findall(" ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(rest)).lower())
                names.extend((node, w) for w in dict.fromkeys(words))
            blocks_at.append(len(stack))
        elif rest.endswith("/"):
            return
        elif tag == "a" and at["a"]:
            end("a")
        if tag in WALLS:
            walls.append(len(stack))
        at[tag].append(len(stack))
        stack.append((tag, node))
        linked += tag == "a"
        hidden += tag in HIDDEN

    place, match = 0, _PIECE.match
    while m := match(source, place):
        place = m.end()
        if (piece := m["text"] or m["bare"]) is not None:
            if hidden:
                continue
            if "&" in piece:
                piece = html.unescape(piece)
            text.append(piece)
            node, n = stack[-1][1], len(piece.split())
            own[node] += n
            if linked:
                links[node] += n
            stops[node] += piece.count(".") + piece.count("!") + piece.count("?")
        elif (tag := m["start"]) is not None:
            tag = tag.lower()
            if tag in RAW:
                close = _RAW_END[tag].search(source, place)
                place = close.end() if close else len(source)
            elif tag in VOID:
                if tag == "hr":
                    if at["p"] and at["p"][-1] > walls[-1]:
                        pop_to(at["p"][-1])
                    flush()
                elif tag == "br" and not hidden:
                    text.append(" ")
            elif tag not in IGNORED:
                start(tag, m["rest"])
        elif (tag := m["end"]) is not None:
            if (tag := tag.lower()) == "br":
                text.append(" ")
            else:
                end(tag)
    pop_to(1)
    flush()
    for node, block in out:
        if len(block) <= 160:
            words_of = [w.strip(",.:;!?()") for w in block.lower().split()]
            for kind, cues in CUES.items():
                if not cues.isdisjoint(words_of):
                    names.append((node, "~" + kind))
                    names.append((max(parent[node], 0), "~below-" + kind))
    return Page(*(np.array(x, np.int64) for x in (parent, depth, tags, landmark, own, links, stops)), names, out)


class Forest(NamedTuple):
    parent: np.ndarray
    levels: list[np.ndarray]  # nodes by depth
    flat: np.ndarray  # feature ids
    owner: np.ndarray  # node of each


def _ids(prefix: str, values) -> np.ndarray:
    return np.array([_feature(f"{prefix}:{v}") for v in values], np.int32)


_TAG_IDS, _UP_IDS, _LAND_IDS = _ids("tag", TAGS), _ids("up", TAGS), _ids("in", LANDMARKS)
_OWN_IDS, _ALL_IDS, _STOP_IDS, _LINK_IDS, _BELOW_IDS = _ids("own", range(8)), _ids("all", range(12)), _ids("stops", range(4)), _ids("links", range(3)), _ids("below", range(3))
_HEADED_IDS, _PARAGRAPH_IDS, _ALIKE_IDS, _UP_HEADED_IDS = _ids("headed", range(4)), _ids("paragraphs", range(4)), _ids("alike", range(4)), _ids("up-headed", range(4))
_LINK_SIZE_IDS = np.array([[_feature(f"links-all:{a}:{b}") for b in range(8)] for a in range(3)], np.int32)
_HEAD_TAGS, _CONTROL_TAGS, _TEXT_TAGS = ([_TAG[t] for t in group] for group in (sorted(HEADINGS), ("button", "form"), ("p", "blockquote", "pre", "li", "div")))
_TAG_LAND_IDS = np.array([[_feature(f"tag-in:{t}:{x}") for x in LANDMARKS] for t in TAGS], np.int32)


def _bits(n: np.ndarray, most: int) -> np.ndarray:
    """Bit length of min(n, most)."""
    return np.frexp(np.minimum(n, most).astype(float))[1]


def forest(pages: list[Page]) -> Forest:
    """All pages' trees in one set of arrays."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.cumsum(sizes) - sizes
    parent = np.concatenate([p.parent + np.where(p.parent < 0, 0, b) for p, b in zip(pages, base, strict=True)])
    depth, tag, landmark, own, links, stops = (np.concatenate([p[i] for p in pages]) for i in range(1, 7))
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1)))
    total, total_links = own.copy(), links.copy()
    for nodes in reversed(levels[1:]):
        np.add.at(total, parent[nodes], total[nodes])
        np.add.at(total_links, parent[nodes], total_links[nodes])
    n = len(parent)
    child = np.flatnonzero(parent >= 0)
    size = np.bincount(parent[child], minlength=n)
    up = np.where(parent < 0, 0, parent)
    heads, controls = np.isin(tag, _HEAD_TAGS), np.isin(tag, _CONTROL_TAGS)
    headed, pressed = np.bincount(up[child], heads[child], n) > 0, np.bincount(up[child], controls[child], n) > 0
    texts = np.isin(tag, _TEXT_TAGS) & (own > 0)
    paragraphs = np.minimum(np.bincount(up[child], texts[child], n), 3).astype(np.int64)
    # siblings that are built alike: compound nodes of one tag below one parent
    group = up * len(TAGS) + tag
    _, at, alike = np.unique(np.where(size > 0, group, -1), return_inverse=True, return_counts=True)
    repeated = np.where((size > 0) & (parent >= 0), np.minimum(alike[at.reshape(-1)], 3), 0)
    share = lambda part, whole: np.where(part == 0, 0, 1 + (2 * part > whole))
    dense = np.column_stack([
        np.full(n, _feature("bias"), np.int32), _TAG_IDS[tag], _UP_IDS[np.where(parent < 0, 0, tag[parent])], _LAND_IDS[landmark], _TAG_LAND_IDS[tag, landmark], _OWN_IDS[_bits(own, 80)], _ALL_IDS[_bits(total, 2000)],
        _LINK_IDS[share(links, own)], _BELOW_IDS[share(total_links, total)], _STOP_IDS[np.minimum(stops, 3)],
        _HEADED_IDS[headed + 2 * pressed], _PARAGRAPH_IDS[paragraphs], _ALIKE_IDS[repeated], _UP_HEADED_IDS[headed[up] + 2 * pressed[up]], _LINK_SIZE_IDS[share(total_links, total), _bits(total, 120)],
    ])
    owner = np.repeat(np.arange(n, dtype=np.int32), dense.shape[1])
    named = np.array([(i + b, _id(f"name:{w}")) for p, b in zip(pages, base.tolist(), strict=True) for i, w in p.names], np.int32).reshape(-1, 2)
    return Forest(parent, levels, np.concatenate([dense.ravel(), named[:, 1]]), np.concatenate([owner, named[:, 0]]))


def sum_product(f: Forest, weight: np.ndarray, couple: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node, and (if pairs) the joint marginals of each node (not roots) with its parent: [node, parent's, own]."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(f.owner, weight[f.flat], n)
    up, message = own.copy(), np.zeros((n, 2))  # log beliefs from below; messages to the parent
    for nodes in reversed(f.levels[1:]):
        x = up[nodes][:, None, :] + couple[None]
        message[nodes] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        np.add.at(up, f.parent[nodes], message[nodes])
    full = up.copy()  # log beliefs with what comes from above
    joint = np.zeros((n if pairs else 0, 2, 2))
    for nodes in f.levels[1:]:
        above = full[f.parent[nodes]] - message[nodes]
        j = above[:, :, None] + couple[None] + up[nodes][:, None, :]
        full[nodes] = np.logaddexp(j[:, 0], j[:, 1])
        if pairs:
            j = np.exp(j - j.max((1, 2), keepdims=True))
            joint[nodes] = j / j.sum((1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -40, 40))), joint


def fit(pages: list[Page], labels: list[list[int]], steps: int = 300, rate: float = 0.3, ridge: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Node weights and the parent-child table by maximum likelihood, with the exact marginals as expectations."""
    f, y = forest(pages), np.array([v for own in labels for v in own])
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[f.parent[child]], y[child]), 1)
    weight, couple = np.zeros(BUCKETS), np.zeros((2, 2))
    m, v, mc, vc = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros((2, 2))
    for step in range(1, steps + 1):
        p, joint = sum_product(f, weight, couple)
        g = np.bincount(f.flat, (y - p)[f.owner], BUCKETS) / len(y) - ridge * weight
        gc = (seen - joint[child].sum(0)) / len(y) - ridge * couple
        for w, grad, first, second in ((weight, g, m, v), (couple, gc, mc, vc)):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            w += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weight, couple


def silver_labels(page: Page) -> list[int] | None:
    """Labels of a page whose <article> or <main> marks the content; None for a page without one."""
    marks = np.flatnonzero(page.tag == _TAG["article"])
    marks = marks if len(marks) else np.flatnonzero(page.tag == _TAG["main"])
    if not len(marks):
        return None
    y = [0] * len(page.tag)
    for up in marks.tolist():
        while up >= 0 and not y[up]:
            y[up] = 1
            up = int(page.parent[up])
    inside = set(marks.tolist())
    off = {_TAG[t] for t in ("nav", "aside", "footer", "form", "button")}
    clutter = {i for i, w in page.names if w in CLUTTER}
    for i, (up, tag) in enumerate(zip(page.parent.tolist(), page.tag.tolist(), strict=True)):
        if up in inside and tag not in off and i not in clutter:
            inside.add(i)
            y[i] = 1
    return y


def generate_pages(n: int = GENERATED_PAGES, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """(html, its content blocks) of generated pages: semantic or div layouts with all kinds of clutter.

    The words are placeholders: the model sees lengths, links, punctuation, tags and names, not words.
    """
    r = random.Random(seed)

    def sentence(low: int, high: int) -> str:
        return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))).capitalize() + r.choice((".", ".", ".", "?", ""))

    def some(low: int, high: int) -> str:
        return " ".join(sentence(low, high) for _ in range(r.choice((1, 1, 2, 3))))

    made_up = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))

    def clutter(kind: str) -> str:
        link = lambda: f'<a href="/{r.randint(1, 99)}">{sentence(1, 3).rstrip(".?")}</a>'
        if kind == "menu":
            body = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 8))) + "</ul>"
            return r.choice((f"<nav>{body}</nav>", f"<div class='{made_up()}'>{body}</div>", f'<div class="{r.choice(("menu", "navbar", "nav main-menu", "navigation", "breadcrumbs"))}">{body}</div>', f"<header><nav>{body}</nav></header>"))
        if kind == "header":
            return r.choice((f"<header><h1>{sentence(1, 4)}</h1><p>{sentence(2, 6)}</p></header>", f'<div id="header" class="site-header"><div class="logo">{link()}</div><p>{sentence(2, 6)}</p></div>'))
        if kind == "footer":
            body = f"{r.choice(('&copy; ', ''))}{sentence(1, r.choice((3, 12)))} {link() if r.random() < 0.5 else ''}"
            return r.choice((f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<footer><p>{body}</p></footer>", f'<div class="footer"><p>{body}</p></div>', f'<div id="copyright">{body}</div>', f"<div class='{made_up()}'>&copy; {sentence(1, 4)} {r.choice(('All rights reserved.', 'Terms', ''))}</div>"))
        if kind == "side":
            body = f"<h3>{sentence(1, 3)}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6))) + f"</ul><p>{sentence(4, 14)}</p>"
            return r.choice((f"<aside>{body}</aside>", f'<div class="{r.choice(("sidebar", "widget", "related", "recent-posts"))}">{body}</div>'))
        if r.random() < 0.35 and kind in ("notice", "ad", "comments", "related"):  # under names that say nothing, or that no other page has
            name = r.choice((f' class="{made_up()}"', f' id="{made_up()}-{made_up()}"', f' class="{made_up()} {made_up()}"', ""))
            cue = r.choice({"notice": ("We use cookies", "Cookies and privacy", "This site asks for your consent", "Your privacy"), "ad": ("Advertisement", "Sponsored", "Special offer"), "comments": ("Comments", "2 comments", "Replies", "Leave a reply"), "related": ("Related", "Read more", "More on this", "Recommended")}[kind])
            if kind == "notice":
                return f"<div{name}><p>{cue} {sentence(4, 14)}</p>{r.choice(('<button>Accept</button>', '<button>OK</button><button>' + sentence(1, 2) + '</button>', ''))}</div>" if r.random() < 0.6 else f"<div{name}>{cue} {sentence(3, 12)} {link()} <button>Accept</button></div>"
            if kind == "ad":
                return f"<div{name}><p>{cue}</p><p>{link()} {sentence(2, 8)}</p></div>"
            if kind == "related":
                return r.choice((f"<aside>{cue}: {link()}</aside>", f"<aside><p>{cue}: {link()} {link()}</p></aside>", f"<div{name}><h4>{cue}</h4>" + "".join(f"<div>{link()}</div>" for _ in range(r.randint(2, 4))) + "</div>"))
            tag, one = r.choice(("div", "li", "div", "section")), r.choice(("<b>{}</b> <p>{}</p>", "<p><b>{}</b></p><p>{}</p>", "<div>{}</div><div>{} <a href='#'>Reply</a></div>"))
            posts = "".join(f"<{tag}>{one.format(sentence(1, 2).rstrip('.?'), some(2, 18))}</{tag}>" for _ in range(r.randint(1, 5)))
            return f"<div{name}>{r.choice((f'<h3>{cue}</h3>', f'<p>{cue}</p>', f'<h2>{cue}</h2>'))}{'<ul>' + posts + '</ul>' if tag == 'li' else posts}</div>"
        if kind == "related":
            return f"<aside>Related: {link()}</aside>"
        if kind == "notice":
            return f'<div class="{r.choice(("cookie", "cookie-notice", "notice", "banner", "alert", "popup", "newsletter"))}"><p>{some(4, 16)}</p></div>'
        if kind == "ad":
            return r.choice((f'<div class="{r.choice(("ad", "ads", "advert", "ad-slot", "sponsored", "promo"))}">{some(2, 12)}</div>', f'<aside class="ad"><p>{some(3, 14)}</p></aside>'))
        if kind == "form":
            return f'<form action="/go"><p>{sentence(2, 8)}</p><label>{sentence(1, 3)}</label><input name="q"><button>{sentence(1, 1)}</button></form>'
        if kind == "share":
            return f'<div class="{r.choice(("share", "social", "tags", "meta byline"))}">{link()} {link()}</div>'
        comments = "".join(f'<div class="{r.choice(("comment", "reply"))}"><p>{some(3, 25)}</p></div>' for _ in range(r.randint(1, 5)))
        return r.choice((f'<section class="comments"><h3>{sentence(1, 2)}</h3>{comments}</section>', f'<div id="comments">{comments}</div>', f'<section id="comments"><ul>{comments.replace("<div", "<li").replace("</div", "</li")}</ul></section>'))

    for i in range(n):
        kept: list[str] = []

        def keep(tag: str, words: str) -> str:
            kept.append(words)  # noqa: B023
            return f"<{tag}>{words}</{tag.split()[0]}>"

        brief = r.random() < 0.3  # some articles are but a few words
        para = r.choice(("p", "p", "p", "p", "div", f'div class="{made_up()}"'))
        layout = r.random()  # most have a title and a body, some a body only, some are sections under headings
        title = keep("h1", sentence(3, 12)) if layout < 0.84 else ""
        body = [f"<header>{title}</header>" if title and r.random() < 0.1 else title]
        if layout > 0.92:
            brief = False
            body.append(keep(para, some(5, 24)))
        for _ in range(r.randint(0, 2 if brief else 9)):
            pick = r.random()
            if pick < 0.58:
                body.append(keep(para, " ".join(sentence(1, 5 if brief else 24) for _ in range(r.randint(1, 2 if brief else 6)))))
            elif pick < 0.66:
                body.append(keep("h2", sentence(2, 8)))
            elif pick < 0.72:
                body.append("<ul>" + "".join(keep("li", sentence(2, 14)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif pick < 0.75:  # a list of links that belongs to the text
                items = [sentence(1, 6) for _ in range(r.randint(2, 4))]
                kept.extend(items)
                body.append("<ul>" + "".join(f'<li><a href="/{made_up()}">{x}</a></li>' for x in items) + "</ul>")
            elif pick < 0.79:
                body.append("<blockquote>" + keep("p", sentence(6, 30)) + "</blockquote>")
            elif pick < 0.82:
                body.append("<table><tr>" + "".join(keep("td", sentence(1, 5)) for _ in range(3)) + "</tr></table>")
            elif pick < 0.85:
                body.append(r.choice(("<figure><img src='x'>{}</figure>", "<section>{}</section>", "<dl>{}</dl>")).format(keep(r.choice(("figcaption", "pre", "dd")), sentence(3, 12))))
            else:
                body.append(clutter(r.choice(("ad", "share", "notice", "related"))))
        if r.random() < 0.3:
            body.append(clutter("comments"))
        if r.random() < 0.25 or layout > 0.95:  # an article in sections of its own, each with a heading
            for _ in range(r.randint(1, 4)):
                tag = r.choice(("section", "section", "div"))
                body.append(f"<{tag}>{keep(r.choice(('h2', 'h3')), sentence(1, 6))}" + "".join(keep("p", some(4, 20)) for _ in range(r.randint(1, 3))) + f"</{tag}>")
            if r.random() < 0.4:  # words of notices in the text itself
                body.append(keep("p", f"{sentence(5, 12)} {r.choice(('Cookies', 'Comments', 'Privacy', 'More', 'The terms', 'An offer', 'Related'))} {sentence(3, 9)}"))
        inner = "".join(body)
        wrap = r.choice(("<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main" class="post entry">{}</div>', '<div class="article-body">{}</div>', "<div>{}</div>", "<section>{}</section>", "{}", '<div class="@">{}</div>', '<div class="@"><div class="@">{}</div></div>'))
        page = wrap.replace("@", made_up()).format(inner)
        for _ in range(r.choice((0, 0, 0, 0, 1, 2, 3))):
            page = f"<div{r.choice(('', f' class={made_up()!r}', f' id={made_up()!r}'))}>{page}</div>"
        if r.random() < 0.04:  # a page without a text
            page = ""
            kept.clear()
        head = [clutter(k) for k in ("notice", "header", "menu", "ad") if r.random() < 0.6]
        tail = [clutter(k) for k in ("comments", "side", "form", "share", "ad", "footer") if r.random() < 0.5]
        middle = f"<div class='wrap'>{page}{clutter('side')}</div>" if r.random() < 0.25 else page
        yield f"<!DOCTYPE html><html><head><title>{i}</title></head><body>{''.join(head)}{middle}{''.join(tail)}</body></html>", kept


def generated_labels(page: Page, kept: list[str]) -> list[int]:
    """A node is content when one of the kept blocks is its own or below it."""
    y, left, parent = [0] * len(page.parent), {}, page.parent.tolist()
    for text in kept:
        key = " ".join(text.split())
        left[key] = left.get(key, 0) + 1
    for node, text in page.blocks:
        if left.get(text, 0):
            left[text] -= 1
            while node >= 0 and not y[node]:
                y[node] = 1
                node = parent[node]
    return y


class Model(NamedTuple):
    weight: np.ndarray
    couple: np.ndarray


def train(pages: DataFrame, n: int = TRAIN_PAGES) -> Model:
    """Fit on at most n pages of the table, in hash order, and on the generated pages."""
    hashed = pages.where(F.length("html") < TRAIN_CHARS).select("html", F.xxhash64("html").alias("_h"))
    picked = hashed.select("_h").distinct().orderBy("_h").limit(n)  # hashes are ranked, not pages
    rows = hashed.join(F.broadcast(picked), "_h").dropDuplicates(["_h"]).orderBy("_h").collect()  # at most n pages of TRAIN_CHARS
    parsed: list[Page] = []
    labels: list[list[int]] = []
    for row in rows:
        page = parse(row["html"])
        if (y := silver_labels(page)) is not None:
            parsed.append(page)
            labels.append(y)
    for source, kept in generate_pages():
        page = parse(source)
        parsed.append(page)
        labels.append(generated_labels(page, kept))
    return Model(*fit(parsed, labels))


def likeliest(page: Page, content: np.ndarray) -> list[str]:
    """Of a page where no block reaches 0.5: the blocks whose marginal is at least half of the best one's, if that is
    at least FAINT."""
    best = max(content[node] for node, _ in page.blocks)
    return [t for node, t in page.blocks if best >= FAINT and 2 * content[node] >= best]


def extract_texts(sources: list[str], model: Model) -> list[str]:
    pages = [parse(s) for s in sources]
    content, _ = sum_product(forest(pages), model.weight, model.couple, pairs=False) if pages else (np.zeros(0), None)
    out, base = [], 0
    for p in pages:
        own = content[base : base + len(p.parent)]
        kept = [t for node, t in p.blocks if own[node] >= 0.5]
        if not kept and p.blocks:
            kept = likeliest(p, own)
        out.append("\n".join(kept))
        base += len(p.parent)
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "html", BLOCK_BYTES):
                texts = extract_texts([s or "" for s in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
