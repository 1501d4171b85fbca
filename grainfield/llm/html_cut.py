"""Main text of web pages by a minimum cut.

A page is cut into blocks: runs of text between block-level tags, each with its place in the document tree. A classifier
gives every block log-odds of being content, from its length, share of link text, last character, tag, and what tags,
roles and class names of its ancestors say (the innermost one that says anything counts most, so that an article inside a
"content-sidebar-wrap" or an unclosed aside is still an article). These costs are the capacities to the two terminals, in
hundredths. Neighbouring blocks, and the next block under the same parent, are joined by edges of the same scale that halve
with every step of their distance in the tree. The minimum cut of this graph (by maximum flow) parts content from
boilerplate: a short paragraph stays with the article around it, a long notice goes with its sidebar.

The weights are a logistic regression (fit_weights) on labelled made-up pages; they are a parameter. A page on which no
block is likelier content than not has its own prior: the log-odds of its blocks outside boilerplate are raised until the
best is content.

Character references are decoded, white space inside a block becomes one blank, blocks are joined by a line feed in page
order. Scripts, styles, the head and other unseen parts are no blocks. Pages are read to the end, whatever their length,
and in time proportional to it.

Cases: null and empty html, and html without text, give an empty text; unclosed and stray tags are taken as browsers take
them; a null url or id stays; repeated rows give repeated results; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

QUOTED_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style head title noscript template svg math iframe object canvas audio video textarea select option datalist".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = set("article aside section div table ul ol dl body main nav header footer form".split())

BAD_TAGS = set("nav footer aside form button menu dialog".split())
BAD_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
BAD_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar sidebar aside widget widgets related recommended recommendations "
    "share sharing social comment comments reply replies respond disqus newsletter subscribe subscription signup login search popup modal "
    "overlay pagination pager toolbar copyright disclaimer skip header".split()
)
#: Words that boilerplate and articles share.
WEAK_WORDS = set("discussion byline author meta tags".split())
#: Notices are no part of an article, also within one.
NOTICES = set("notice notices alert alerts".split())
BAD_WORDS |= NOTICES
#: What a class or id says of readers' comments, whose text never counts, whatever elements they are made of; and what makes it
#: a remark on an article instead. Elements that hold articles say so only by these very names.
COMMENTS = set("comment comments commentlist disqus respond replies".split())
REMARKS = set("open closed enabled disabled allowed count no has with without on policy".split())
COMMENT_NAMES = {"comment", "comments", "comment-body", "comment-content", "reply"}
GOOD_TAGS = {"article", "main"}
GOOD_WORDS = set("article content post entry story body main text".split())
PAGE = {"html", "body"}

SIZES = [3, 6, 12, 25]
#: Hundredths of log-odds by feature: fit_weights() on the pages of tests/llm/page_layouts.py.
WEIGHTS = {
    "around_bad": -100, "around_good": 6, "bad_tag": -341, "bad_word": -387, "bias": -38, "good_tag": 362, "good_word": 303,
    "heading": 93, "in_blockquote": 65, "in_li": 104, "in_p": 5, "in_td": 136, "links_most": -330, "links_some": -36,
    "mixed": -176, "stop": 142, "weak_word": 131, "words_0": -49, "words_1": -27, "words_2": -95, "words_3": 12,
    "words_4": 122,
}
#: Capacity of an edge between siblings, in hundredths of log-odds; it halves with each further step in the tree.
JOINED, BORDER = 500, 2
#: What blocks that may be content gain, step by step, on a page where the cut would leave nothing.
LIFTS = (0, 50, 100, 200, 400, 800)
NEVER = -1_000_000


@dataclass(slots=True)
class Element:
    name: str
    up: Element | None
    depth: int
    inner: str  # what the innermost ancestor (or this one) that says anything says
    good: bool  # what those around that one say
    bad: bool
    hidden: bool  # never seen, or a reader's comment
    article: bool
    link: bool


@dataclass(slots=True)
class Block:
    parent: Element
    kind: str
    raw: list[str] = field(default_factory=list)
    linked: int = 0
    size: int = 0
    text: str = ""


def _is_comment(name: str, value: str) -> bool:
    """Whether a class or id names readers' comments."""
    if name in GOOD_TAGS:
        return any(token.lower() in COMMENT_NAMES for token in value.split())
    words = [{w.lower() for w in WORD.findall(token)} for token in value.split()]
    return any(w & COMMENTS and not w & REMARKS for w in words)


def _says(name: str, rest: str, article: bool) -> tuple[str, bool]:
    """What an element says of its text ('' if nothing), and whether it is hidden."""
    good, bad = ["good_tag"] if name in GOOD_TAGS else [], ["bad_tag"] if name in BAD_TAGS or name == "header" and not article else []
    weak = hidden = False
    for key, *values in ATTRIBUTE.findall(rest) if rest else ():
        key, value = key.lower(), "".join(values)
        if key in ("class", "id") and name not in PAGE:
            words = [w.lower() for w in WORD.findall(value)]
            hit = {w for i, w in enumerate(words) if not (i and words[i - 1] in ("no", "has", "with", "without"))}
            good += ["good_word"] * bool(hit & GOOD_WORDS)
            hidden = hidden or _is_comment(name, value)
            if name in GOOD_TAGS:
                bad += ["bad_word"] * bool(hit & NOTICES and not hit & GOOD_WORDS)
            else:
                bad += ["bad_word"] * bool(hit & BAD_WORDS)
                weak = weak or bool(hit & WEAK_WORDS)
        elif key == "role":
            good += ["good_tag"] * (value.lower() in ("main", "article"))
            bad += ["bad_tag"] * (value.lower() in BAD_ROLES)
        elif key == "itemprop":
            good += ["good_tag"] * (value == "articleBody")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    if good and bad:
        return "mixed", hidden
    return (min(bad) if bad else "weak_word" if weak else max(good) if good else ""), hidden


def _element(name: str, rest: str, up: Element) -> Element:
    says, hidden = _says(name, rest, up.article)
    good = up.good or says != "" and up.inner.startswith("good")
    bad = up.bad or says != "" and up.inner.startswith("bad")
    return Element(name, up, up.depth + 1, says or up.inner, good, bad, hidden or up.hidden, up.article or name == "article", up.link or name == "a")


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    root = Element("", None, 0, "", False, False, False, False, False)
    stack: list[Element] = [root]
    inside: Counter[str] = Counter()  # how many elements of a name are open
    done: list[Block] = []
    now: Block | None = None
    at, quotes, last = 0, True, page.rfind(">")

    def text(piece: str) -> None:
        nonlocal now
        top = stack[-1]
        if now is None:
            if not piece.strip():
                return
            parent = top
            while parent.name in INLINE:
                parent = parent.up
            now = Block(parent, parent.name)
        now.raw.append(piece)
        now.size += len(piece)
        if top.link:
            now.linked += len(piece)

    def flush() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(html.unescape("".join(now.raw)).split())
            if now.text:
                done.append(now)
            now = None

    def pop_to(names: set[str], fence: set[str]) -> None:
        if not any(inside[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                for e in stack[i:]:
                    inside[e.name] -= 1
                del stack[i:]
                return
            if stack[i].name in fence:
                return

    while (open_ := page.find("<", at)) >= 0:
        if open_ > at:
            text(page[at:open_])
        follows = page[open_ + 1 : open_ + 2]
        if follows in ("!", "?"):
            if page.startswith("<!--", open_):
                end = page.find("-->", open_ + 4)
                at = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", open_) and (end := page.find("]]>", open_)) >= 0:
                text(html.escape(page[open_ + 9 : end], quote=False))
                at = end + 3
            else:
                end = page.find(">", open_)
                at = len(page) if end < 0 else end + 1
            continue
        named = TAG_NAME.match(page, open_)
        if named is None or open_ > last:  # no tag, or one that never ends: browsers leave an unfinished tag out
            if named is not None:
                at = len(page)
                break
            text("<")
            at = open_ + 1
            continue
        m = QUOTED_TAG.match(page, open_) if quotes else None
        if m is not None:
            close, name, rest = bool(m[1]), m[2].lower(), m[3]
            at = m.end()
        else:  # a quote that never ends: from here on tags end at their first >
            quotes, at = False, page.find(">", open_) + 1
            close, name, rest = page[open_ + 1] == "/", named[1].lower(), page[named.end() : at - 1]
        if close:
            if name not in INLINE:
                flush()
            if name == "p":
                pop_to({"p"}, CLOSES_P - {"p"})
            elif name in INLINE:
                pop_to({name}, SCOPE)
            else:
                pop_to({name}, {"article", "main"} - {name} if name in ("div", "section", "span") else set())
            continue
        if name in UNSEEN and not rest.endswith("/"):
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z" if name != "head" else r"</head\s*>|(?=<body)|\Z", re.I).search(page, at)
            at = found.end()
            if name not in INLINE:
                text(" ")
            continue
        if name == "br":
            text(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                pop_to({"p"}, SCOPE)
            if name in SAME:
                pop_to(SAME[name], {"ul", "ol", "dl", "table"} - {name})
        if name in VOID or rest.endswith("/") and name not in ("div", "p", "a", "span"):
            continue
        stack.append(_element(name, rest, stack[-1]))
        inside[name] += 1
    text(page[at:])
    flush()
    return done


def features(block: Block) -> list[str]:
    """The names of what holds for a block."""
    e, words, links = block.parent, block.text.count(" ") + 1, block.linked / max(1, block.size)
    out = [f"words_{sum(words >= s for s in SIZES)}"]
    out += ["links_most"] if links > 0.8 else ["links_some"] if links > 0.3 else []
    out += ["stop"] if block.text[-1] in ".!?…:;\"'»”" else []
    kind = block.kind
    out += ["heading"] if kind in ("h1", "h2", "h3", "h4", "h5", "h6") else [f"in_{kind}"] if kind in ("p", "li", "td", "blockquote") else []
    out += [e.inner] if e.inner else []
    return out + ["around_good"] * e.good + ["around_bad"] * e.bad


def unary_costs(blocks: list[Block], weights: dict[str, int] | None = None, lift: int = 0) -> list[int]:
    """What a block gains as content over boilerplate, in hundredths of log-odds; negative for boilerplate.

    lift is added to blocks that may be content: seen, not in boilerplate by what is around them, and no list of links.
    """
    weights = WEIGHTS if weights is None else weights
    bias = weights.get("bias", 0)
    out = []
    for b in blocks:
        held = features(b)
        may = not (b.parent.inner.startswith("bad") or "links_most" in held)
        out.append(NEVER if b.parent.hidden else bias + sum(weights.get(f, 0) for f in held) + lift * may)
    return out


def _distance(a: Element, b: Element) -> int:
    """Steps between two blocks in the tree, by way of their parents."""
    steps = 2
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def smoothness(blocks: list[Block], joined: int = JOINED) -> list[tuple[int, int, int]]:
    """Edges (block, block, capacity) between neighbours in the page and between next blocks under one parent.

    Where the elements around two neighbours say different things of their text, the edge counts as BORDER steps longer.
    """
    edges, last = [], {}
    for i, b in enumerate(blocks):
        parent = id(b.parent)
        if i:
            border = BORDER if blocks[i - 1].parent.inner[:3] != b.parent.inner[:3] else 0
            edges.append((i - 1, i, joined >> min(_distance(blocks[i - 1].parent, b.parent) - 2 + border, 30)))
        if (j := last.get(parent, i - 1)) < i - 1:
            edges.append((j, i, joined))
        last[parent] = i
    return edges


def min_cut(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut (Dinic's maximum flow).

    unary: capacity from the source if positive, to the sink if negative; edges count in both directions.
    """
    n = len(unary)
    if all(u >= 0 for u in unary) or all(u <= 0 for u in unary):
        return [max(unary, default=0) > 0] * n
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a, b, there, back):
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    source, sink = n, n + 1
    for i, u in enumerate(unary):
        if u > 0:
            link(source, i, u, 0)
        elif u < 0:
            link(i, sink, -u, 0)
    for a, b, w in edges:
        if w:
            link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], line = 0, [source]
        for x in line:
            for e in out[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if not room[e])
                x = to[path[cut] ^ 1]
                del path[cut:]
            while tried[x] < len(out[x]):
                e = out[x][tried[x]]
                if room[e] and level[to[e]] == level[x] + 1:
                    break
                tried[x] += 1
            else:
                if x == source:
                    break
                level[x] = -1
                x = to[path.pop() ^ 1]
                continue
            path.append(e)
            x = to[e]


def content_of(blocks: list[Block], weights: dict[str, int] | None = None, joined: int = JOINED) -> list[bool]:
    """Which blocks are content: the minimum cut, with the least lift that leaves something where anything may be content."""
    edges, keep = smoothness(blocks, joined), []
    for lift in LIFTS:
        keep = min_cut(unary_costs(blocks, weights, lift), edges)
        if any(keep):
            break
    return keep


def main_text(page: str | None, weights: dict[str, int] | None = None, joined: int = JOINED) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, k in zip(blocks, content_of(blocks, weights, joined)) if k)


def fit_weights(pages: list[tuple[str, list[str]]], rounds: int = 400, ridge: float = 1e-3) -> dict[str, int]:
    """Logistic regression of the features on labelled pages (html, texts of the content blocks), in hundredths."""
    rows, labels = [], []
    for page, content in pages:
        wanted = set(content)
        for b in blocks_of(page):
            rows.append(["bias", *features(b)])
            labels.append(b.text in wanted)
    names = sorted({f for r in rows for f in r})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r]] = 1
    y, w = np.array(labels, float), np.zeros(len(names))
    for _ in range(rounds):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge * len(y) + 1e-9) * np.eye(len(names)), x.T @ (y - p) - ridge * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {f: int(round(100 * v)) for f, v in zip(names, w)}


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col and text of every page."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({id_col: frame[id_col], url_col: frame[url_col], "text": [main_text(h) for h in frame[html_col]]})

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInPandas(run, f"`{id_col}` {kind}, `{url_col}` string, text string")
