"""Pages (page_id, url, html) to text, content blocks and links. The parser is a small helper of mapInArrow; everything after it is columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.functions.text import coverage_score
from grainfield.functions.urls import authority, is_skipped, path, same_site
from grainfield.operators.relevance import with_hits
from grainfield.operators.tables import first_per_key

DROPPED = {"script", "style", "nav", "footer", "header"}
BLOCKS = {"div", "section", "article", "main"}
CONTEXT = {"p", "li", "div", "td"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# What marks a page that a browser has to render, and when its text is too short.
SPA_MARKERS = r'<div id="(root|app|__next)"|ng-app|data-reactroot|window\.__nuxt__'
SHORT_HTML, SHORT_BLOCK, LONG_BLOCK, MOST_BLOCKS, MOST_CONTEXT, MOST_ANCHOR = 500, 100, 500, 10, 300, 200
DEEPEST = 256
#: So many pages are parsed before their texts and links are handed on.
PAGES = 64
# What a start tag ends, as HTML says: elements, each unless one of those after it lies between.
PARAGRAPH_ENDS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
_TABLE, _SCOPE = frozenset({"table"}), frozenset({"button", "table", "td", "th"})
ENDED_BY = {t: (("p", _SCOPE),) for t in PARAGRAPH_ENDS} | {
    "li": (("li", frozenset({"ul", "ol"})),), "dt": (("dt", frozenset({"dl"})), ("dd", frozenset({"dl"}))), "dd": (("dt", frozenset({"dl"})), ("dd", frozenset({"dl"}))),
    "tr": (("tr", _TABLE),), "td": (("td", _TABLE | {"tr"}), ("th", _TABLE | {"tr"})), "th": (("td", _TABLE | {"tr"}), ("th", _TABLE | {"tr"})), "option": (("option", frozenset({"select"})),),
}
TAG = re.compile("<[a-zA-Z/!?]")
#: The ampersand of a character reference without its semicolon.
UNENDED = re.compile("&(?=#?[a-zA-Z0-9]++(?!;))")
DOCUMENT = r'https?://[^\s"<>]+\.[pP][dD][fF]'


class _Stream:
    """Texts joined by blanks, with their length, so that a place in it tells where later text will stand."""

    def __init__(self):
        self.texts: list[str] = []
        self.size = 0

    def add(self, text: str) -> None:
        self.size += len(text) + (self.size > 0)
        self.texts.append(text)

    def after(self) -> int:
        """Where the next text will begin."""
        return self.size + (self.size > 0)


class _Page(HTMLParser):
    """Text, links, and the place of every block and link context in the text: each is kept once, however deep elements lie.

    Elements that are not closed end where HTML says (a new item ends the last one of its list, a block a paragraph) or with
    the one around them; an end tag without its element is passed over.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list | None, list | None]] = []  # tag, span as a block, span as a context
        self.count: Counter = Counter()
        self.kept, self.shown = _Stream(), _Stream()  # without DROPPED elements; without scripts and styles
        self.blocks: list[list[int]] = []
        self.contexts: list[list[int]] = []  # the spans of the open contexts
        self.nested = 0
        self.links: list[dict] = []
        self.inside: dict | None = None

    def handle_starttag(self, tag, attrs):
        for closed, until in ENDED_BY.get(tag, ()):
            self._end(closed, until)
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.inside = {"href": href.strip(), "near": self.contexts[-1] if self.contexts else None, "text": [], "size": 0}
            self.links.append(self.inside)
        if tag in VOID:
            return
        block = context = None
        if tag in BLOCKS:
            self.nested += 1
            if self.nested <= DEEPEST:
                block = [self.kept.after(), -1]
                self.blocks.append(block)
        if tag in CONTEXT:
            context = [self.shown.after(), -1]
            self.contexts.append(context)
        self.count[tag] += 1
        self.open.append((tag, block, context))

    def _pop(self) -> str:
        tag, block, context = self.open.pop()
        self.count[tag] -= 1
        if block is not None:
            block[1] = self.kept.size
        if tag in BLOCKS:
            self.nested -= 1
        if context is not None:
            context[1] = self.shown.size
            self.contexts.pop()
        return tag

    def _end(self, tag: str, until: frozenset = frozenset()) -> None:
        """Ends the innermost such element and those in it, unless one of `until` lies between."""
        if not self.count[tag]:
            return
        if until:
            for inner, _, _ in reversed(self.open):
                if inner in until:
                    return
                if inner == tag:
                    break
        while self._pop() != tag:
            pass

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = None
        self._end(tag)

    def handle_data(self, data):
        if not (text := " ".join(data.split())):
            return
        if not any(self.count[t] for t in DROPPED):
            self.kept.add(text)
        if not (self.count["script"] or self.count["style"]):
            self.shown.add(text)
        if self.inside is not None and self.inside["size"] < MOST_ANCHOR:
            self.inside["text"].append(text)
            self.inside["size"] += len(text) + 1


def _parse(html: str | None, unended: bool = True) -> tuple[str, list[dict], list[dict]]:
    page, html = _Page(), html or ""
    html = html if unended else UNENDED.sub("&amp;", html)
    page.feed(html[: end.start()] if (end := TAG.search(html, html.rfind(">") + 1)) else html)  # a tag that never ends is none, and is looked for once
    page.close()
    while page.open:
        page._pop()
    shown = " ".join(page.shown.texts)
    blocks = [{"start": start, "size": end - start} for start, end in page.blocks if end > start]
    context = lambda near: shown[near[0] : min(near[1], near[0] + MOST_CONTEXT)] if near else ""
    links = [{"href": x["href"], "anchor": " ".join(x["text"])[:MOST_ANCHOR], "context": context(x["near"])} for x in page.links]
    return " ".join(page.kept.texts), blocks, links


def _parse_batches(batches: Iterator, unended: bool) -> Iterator:
    import pyarrow as pa

    kinds = [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])), pa.list_(pa.struct([(c, pa.string()) for c in ("href", "anchor", "context")]))]
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            some = batch.slice(at, PAGES)
            parsed = zip(*(_parse(h, unended) for h in some.column("html").to_pylist()))
            yield pa.RecordBatch.from_arrays([some.column("page_id").cast(pa.int64()), some.column("url"), *map(pa.array, parsed, kinds)], ["page_id", "url", "text", "blocks", "links"])


def parse_pages(pages: DataFrame, unended: bool = True) -> DataFrame:
    """page_id, url, text, blocks, links of every page; null html is an empty page.

    Character references without their semicolon (&amp for &amp;) are decoded as browsers do, or with `unended` off stay as they stand.

    blocks are the places (start from 0, size) of the elements with text of their own in the page's text, in order of their
    begin; block_texts() gives their texts. A block inside more than DEEPEST others is not listed; its text is part of theirs.
    A task holds what Spark sends it at a time and the results of PAGES pages, however many pages there are.
    """

    return pages.select("page_id", "url", "html").mapInArrow(partial(_parse_batches, unended=unended), "page_id long, url string, text string, blocks array<struct<start:int,size:int>>, links array<struct<href:string,anchor:string,context:string>>")


def block_texts(blocks: Column | str = "blocks", text: Column | str = "text") -> Column:
    """The texts of a page's blocks."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(blocks, lambda b: F.substring(text, b["start"] + 1, b["size"]))


def resolve(href: Column, base: Column) -> Column:
    """href against its page, without fragment; dot segments go."""
    href = F.regexp_replace(href, "#.*$", "")
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    root = F.concat(scheme, F.lit("//"), authority(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    full = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).when(href.startswith("?"), F.concat(root, path(base), href)).otherwise(F.concat(root, folder, href))
    return F.regexp_replace(F.regexp_replace(full, r"/\./", "/"), r"/[^/.]+/\.\./", "/")


def links(parsed: DataFrame, *keep: str) -> DataFrame:
    """page_id, page_url, pos, url, anchor, context (and columns to keep) of links on the same site that are worth a visit."""
    rows = parsed.select("page_id", F.col("url").alias("page_url"), *keep, F.posexplode("links").alias("pos", "l"))
    rows = rows.where((F.col("l.href") != "") & ~F.col("l.href").startswith("#") & ~F.lower("l.href").startswith("javascript:"))
    rows = rows.select("page_id", "page_url", *keep, "pos", resolve(F.col("l.href"), F.col("page_url")).alias("url"), "l.anchor", "l.context")
    return rows.where(F.col("url").rlike("^https?://") & same_site("url", "page_url") & ~is_skipped("url"))


def document_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url of the absolute document urls anywhere in the raw html, on the page's host, each once."""
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit(DOCUMENT), F.lit(0)))).alias("pos", "url"))
    return rows.where(authority("url") == authority("page_url")).select("page_id", "pos", "url")


def all_links(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """links() and the documents found by pattern alone: page_id, pos, url, anchor, context, source; of a url the anchor's link stays, else the first."""
    anchors = links(parsed).select("page_id", F.col("pos").cast("long"), "url", "anchor", "context", F.lit("anchor").alias("source"))
    found = document_links(pages).select("page_id", (F.lit(1 << 40) + F.col("pos")).alias("pos"), "url", F.lit("PDF").alias("anchor"), F.lit("").alias("context"), F.lit("pattern").alias("source"))
    return first_per_key(anchors.unionByName(found), ["page_id", "url"], "pos").select("page_id", "pos", "url", "anchor", "context", "source")


def pattern_only(every: DataFrame) -> DataFrame:
    """U4: the documents of all_links() that no anchor names."""
    return every.where("source = 'pattern'").select("page_id", "url")


def content_blocks(parsed: DataFrame, model: dict[str, list[str]], least: float = 0.05) -> DataFrame:
    """page_id, pos, block, score: the first blocks that are long enough and score."""
    long = F.filter("blocks", lambda b: b["size"] > SHORT_BLOCK)
    rows = parsed.select("page_id", "text", F.posexplode(long).alias("pos", "b")).select("page_id", "pos", F.substring("text", F.col("b.start") + 1, F.col("b.size")).alias("block"))
    rows = with_hits(rows, "block", model, "_hits").withColumn("score", coverage_score(F.col("_hits"), model))
    kept = F.when(F.col("score") > least, F.struct("pos", F.substring("block", 1, LONG_BLOCK).alias("block"), "score"))  # no filter, which would be moved before the score and make it anew for every keyword
    best = rows.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(kept)), 1, MOST_BLOCKS).alias("b"))
    return best.select("page_id", F.inline("b"))


def is_rendered(html: Column | str) -> Column:
    """Short html or a marker of a client-rendered page."""
    html = F.col(html) if isinstance(html, str) else html
    return (F.length(F.trim(html)) < SHORT_HTML) | F.lower(html).rlike(SPA_MARKERS)


def is_shell(html: Column | str) -> Column:
    """P20: a marker, and little text without tags."""
    html = F.col(html) if isinstance(html, str) else html
    return F.lower(html).rlike(SPA_MARKERS) & (F.length(F.trim(F.regexp_replace(html, "<[^>]*>", ""))) < SHORT_HTML)


def robots_rules(robots: DataFrame) -> DataFrame:
    """Host, grp, agents, delay, pos, allow, path from rows (host, txt); pos is null for a group without rules.

    Agents in a row share the rules after them; a blank line ends a group, and rules without agents don't count. An empty
    path allows everything.
    """
    lines = robots.select("host", F.posexplode(F.transform(F.split("txt", r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, "#.*$", "")))).alias("pos", "line"))
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    kind = F.when(F.col("line") == "", "blank").when(F.contains("line", F.lit(":")) & key.isin("user-agent", "allow", "disallow", "crawl-delay"), key)
    lines = lines.withColumns({"kind": kind, "value": value}).where("kind is not null")
    file = Window.partitionBy("host").orderBy("pos")  # the lines of one file
    begins = (F.col("kind") == "blank") | (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(file), F.lit("blank")) != "user-agent")
    lines = lines.withColumn("begins", begins.cast("int")).withColumn("grp", F.sum("begins").over(file))
    allow = (F.col("kind") == "allow") | (F.col("value") == "")
    rule = F.when(F.col("kind").isin("allow", "disallow"), F.struct("pos", allow.alias("allow"), F.col("value").alias("path")))
    agents = F.collect_list(F.when(F.col("kind") == "user-agent", F.lower("value")))
    delay = F.max_by(F.when(F.col("kind") == "crawl-delay", F.col("value").try_cast("double")), F.when(F.col("kind") == "crawl-delay", F.col("pos")))
    groups = lines.groupBy("host", "grp").agg(agents.alias("agents"), delay.alias("delay"), F.array_sort(F.collect_list(rule)).alias("rules")).where(F.size("agents") > 0)
    return groups.select("host", "grp", "agents", "delay", F.inline_outer("rules"))


def robots_groups(rules: DataFrame, agent: str) -> DataFrame:
    """host, delay and rules (in order) of the group that is an agent's: the first that names it, else the first for all."""
    name = agent.partition("/")[0].lower()
    per_group = rules.groupBy("host", "grp").agg(F.first("agents").alias("agents"), F.first("delay").alias("delay"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "allow", "path")))).alias("rules"))
    own = F.exists("agents", lambda a: (a != "*") & F.contains(F.lit(name), a))
    rank = F.when(own, F.struct(F.lit(0), "grp")).when(F.array_contains("agents", "*"), F.struct(F.lit(1), "grp"))
    return per_group.where(rank.isNotNull()).groupBy("host").agg(F.min_by(F.struct("delay", "rules"), rank).alias("g")).select("host", "g.delay", "g.rules")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*", exempt: Column | None = None) -> DataFrame:
    """Urls (page_id, url) with allowed and delay: the first rule of the agent's group whose path begins the url's path decides, none allows; exempt urls (a seed) always are."""
    rows = urls.select("page_id", "url", authority("url").alias("host"), path("url").alias("_path"), (exempt if exempt is not None else F.lit(False)).alias("_free"))
    rows = rows.join(robots_groups(rules, agent), "host", "left")
    first = F.get(F.filter("rules", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])), 0)
    return rows.select("page_id", "url", (F.col("_free") | F.coalesce(first["allow"], F.lit(True))).alias("allowed"), "delay")
