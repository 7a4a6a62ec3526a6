"""Main text of web pages by consensus host paths (operator 7).

Every page scores its containers; the scores vote, per host and in Spark, for generalised
tag-class paths; then each page is extracted again with its host's winning path. Work and
memory of a page grow with its length only, however deep or broken its markup is: a container
knows its parent and the run of blocks below it, and a path is a 64-bit hash of its parent's
path and its own tag and classes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_UNTIL = re.compile(r"[^\"'>]*")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|\Z)""", re.I)

#: Elements whose content is text up to their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
#: Elements that are never part of an article.
DROPPED = {
    "nav", "header", "footer", "aside", "form", "noscript", "template", "object", "svg", "math", "button", "select",
    "dialog", "menu", "canvas", "audio", "video", "map", "head", "fieldset", "datalist", "applet", "embed",
}
#: Elements that hold blocks.
CONTAINERS = {
    "html", "body", "main", "article", "section", "div", "center", "table", "tbody", "thead", "tfoot", "tr", "td", "th",
    "ul", "ol", "li", "dl", "dd", "dt", "blockquote", "figure", "details", "hgroup",
}
#: Elements that begin and end a block.
BLOCKS = CONTAINERS | DROPPED | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "address", "figcaption", "summary", "caption", "legend", "option", "optgroup", "search"}
#: Blocks that end where a container begins.
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: An open element of the key's kind ends where one of the same set begins, up to the element that holds both.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"})}
#: Words of class, id or role that mark what is no article.
NOISE = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos
    promotion promotions sidebar sidebars menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs masthead
    header footer foot cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe
    subscription signup login comment comments commentlist disqus respond replies reply discussion share sharing social
    related recommended recommendations widget widgets toolbar pagination pager skip search searchbox contentinfo
    complementary""".split()
)
#: Those of them that an article's own parts have too.
SOFT = frozenset("discussion notice notices social search reply replies related promotion".split())
#: Words that stand beside them in the names of leaf blocks of the same kind.
NEUTRAL = frozenset("box wrap wrapper text item items bar block link links title inner container area unit label message msg list top bottom left right close body row".split())
#: Words of an inline element's class or id that mark an advert within a block.
ADVERT = frozenset("ad ads advert adverts advertisement adsense adsbygoogle adslot sponsor sponsored".split())
INLINE = {"span", "ins"}
#: Words of class or id that mark an article.
SIGNAL = frozenset("article content entry post story main body text articlebody maincontent hentry".split())
_WITH = re.compile(r"\b(?:has|with|no|without)[-_][\w-]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")


def _attributes(raw: str) -> tuple[list[str], set[str], bool, bool]:
    """Generalised classes, words of class, id and role, whether the element is hidden, and whether a whole name is noise."""
    classes, words, hidden, whole = [], set(), False, False
    for name, value in _ATTR.findall(raw):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name == "class":
            classes = sorted({_DIGITS.sub("#", c.lower()) for c in value.split()})
        if name in ("class", "id", "role", "itemprop"):
            for token in _WITH.sub(" ", value).split():
                own = {w.lower() for w in _WORD.findall(token)}
                words |= own
                whole |= bool(own & NOISE) and own <= NOISE | NEUTRAL
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return classes, words, hidden, whole


class _Tags:
    """Tags of a page in order: (start, end, whether it closes, its name or '', its attributes).

    Comments, declarations and sections have no name. What looks for an end that the rest of the
    page lacks looks once, so that a page of broken tags takes no longer than another.
    """

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ("\"", "'", ">", "-->", "]]>")}

    def _end(self, at: int, mark: str) -> int:
        """The place behind the next mark, or the page's end."""
        return self.html.find(mark, at) + len(mark) if at <= self.last[mark] else len(self.html)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        html = self.html
        m = _OPEN.search(html, at)
        if m is None:
            return None
        start, mark = m.start(), m[0]
        if mark == "<!--":
            return start, self._end(m.end(), "-->"), False, "", ""
        if mark == "<![CDATA[":
            return start, self._end(m.end(), "]]>"), False, "", ""
        if mark in ("<!", "<?"):
            return start, self._end(m.end(), ">"), False, "", ""
        name = _NAME.match(html, m.end() - 1)
        if name.end() > self.last[">"]:
            return start, len(html), False, "", ""  # a tag that never ends is no text
        at = name.end()
        while True:
            at = _UNTIL.match(html, at).end()
            if at >= len(html):
                end = html.find(">", name.end())  # a quote that never ends is none
                break
            if html[at] == ">":
                end = at
                break
            quote, before = html[at], at - 1
            while html[before].isspace():
                before -= 1
            if html[before] != "=":  # not a value's own quotes
                at += 1
                continue
            at = html.find(quote, at + 1) + 1 if at + 1 <= self.last[quote] else at + 1
        return start, end + 1, mark[1] == "/", name[0].lower(), html[name.end() : end]

    def raw_end(self, tag: str, at: int) -> int:
        """The place behind the end tag of an element that holds raw text."""
        m = re.compile(rf"</{tag}\b", re.I).search(self.html, at)
        return self._end(m.end(), ">") if m else len(self.html)


@dataclass
class Page:
    """Blocks in page order and the containers around them, parents before children.

    ``text``, ``linked`` (characters of it in links) and ``node`` (the innermost container) have an entry a block; ``path``, ``factor``, ``parent``, ``depth``, ``first`` and
    ``last`` (the run of blocks below it) one a container. Container 0 is the page.
    """

    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    factor: list[float] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)


@dataclass
class _Open:
    """An open element: its tag, nearest container, whether it is dropped, innermost element with a noise word, whether it is of an article."""

    tag: str
    node: int
    dropped: bool
    suspect: int
    article: bool


def parse(html: str) -> Page:
    """What may belong to an article: blocks, unescaped with single spaces, and their containers.

    A NOISE word drops an element unless it holds most of the page, or is a SOFT one's on text
    within an article; a block such as a paragraph is dropped if a whole name of its class or id
    is noise, an advert within a block if its element says so.
    """
    tags, page = _Tags(html), Page()
    paths = page.path

    def container(path: int, factor: float, parent: int, depth: int) -> int:
        paths.append(path)
        page.factor.append(factor)
        page.parent.append(parent)
        page.depth.append(depth)
        return len(paths) - 1

    container(0, 0.5, -1, 0)
    # elements with a noise word: the one around, whether one is soft within an article, whether the page's core lies below
    around: list[int] = [-1]
    soft: list[bool] = [False]
    holds: list[bool] = [False]
    blocks: list[tuple[str, int, int, int]] = []
    stack = [_Open("", 0, False, 0, False)]
    places: dict[str, list[int]] = {}
    text, skip, skip_tag = [], 0, ""
    link_at, linked, at, n = None, 0, 0, len(html)

    def push(x: _Open) -> None:
        places.setdefault(x.tag, []).append(len(stack))
        stack.append(x)

    def cut(k: int) -> None:
        """Close the open elements from the k-th on."""
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def flush() -> None:
        nonlocal linked, link_at, skip
        skip = 0
        if text:
            top = stack[-1]
            if not top.dropped:
                block = _SPACE.sub(" ", unescape("".join(text))).strip()
                if block:
                    open_link = sum(map(len, text[link_at:])) if link_at is not None else 0
                    blocks.append((block, top.node, min(len(block), linked + open_link), top.suspect))
            text.clear()
        linked = 0
        link_at = 0 if link_at is not None else None

    def suspected(words: set[str]) -> int:
        around.append(stack[-1].suspect)
        soft.append(stack[-1].article and words & NOISE <= SOFT)
        holds.append(False)
        return len(around) - 1

    while at < n:
        found = tags.next(at)
        if found is None:
            if not skip:
                text.append(html[at:])
            break
        start, end, closes, tag, attributes = found
        if start > at and not skip:
            text.append(html[at:start])
        at = end
        if not tag:
            continue
        if tag in RAW and not closes:
            at = tags.raw_end(tag, at)
            if tag in ("iframe", "title", "textarea"):
                flush()
            continue
        if tag == "a":
            if link_at is not None:
                linked += sum(map(len, text[link_at:]))
            link_at = None if closes else len(text)
            continue
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        if tag in INLINE:
            if skip and tag == skip_tag:
                skip += -1 if closes else 1
            elif not skip and not closes and attributes and _attributes(attributes)[1] & ADVERT:
                skip, skip_tag = 1, tag
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if tag == "h1" and not closes:
            holds[stack[-1].suspect] = True
        if tag not in CONTAINERS and tag not in DROPPED:
            # p, headings and their like: blocks only, unless their class says they are noise
            top = stack[-1]
            if not closes and attributes:
                _, words, hidden, whole = _attributes(attributes)
                if hidden or whole:
                    push(_Open(tag, top.node, hidden or top.dropped, suspected(words) if whole else top.suspect, top.article))
            elif closes and top.tag == tag:
                cut(len(stack) - 1)
            continue
        if closes:
            if places.get(tag):
                cut(places[tag][-1])
            link_at = None
            continue
        while stack[-1].tag in LEAVES:
            cut(len(stack) - 1)
        if tag in CLOSED_BY:
            ends, within = CLOSED_BY[tag]
            bound = max((places[t][-1] for t in within if places.get(t)), default=0)
            k = max((places[t][-1] for t in ends if places.get(t)), default=0)
            if k > bound:
                cut(k)
        if attributes.endswith("/") and tag not in ("html", "body"):
            continue
        classes, words, hidden, _ = _attributes(attributes) if attributes else ([], set(), False, False)
        top = stack[-1]
        core = tag in ("html", "body", "main", "article")
        dropped = top.dropped or tag in DROPPED or hidden
        suspect = top.suspect if core or dropped or not words & NOISE else suspected(words)
        if tag in ("main", "article") and not words & NOISE:
            holds[suspect] = True
        node = top.node
        if not dropped:
            factor = 1.5 if tag in ("article", "main") else 0.8 if tag in ("html", "body") else 1.3 if words & SIGNAL else 1.0
            own = f"{tag}{''.join('.' + c for c in classes)}"
            path = xxhash.xxh64_intdigest(own.encode("utf-8", "replace"), seed=paths[node]) >> 1
            node = container(path, factor * (1 + 0.01 * min(len(stack), 30)), node, page.depth[node] + 1)
        push(_Open(tag, node, dropped, suspect, top.article or tag in ("article", "main") or bool(words & SIGNAL)))
    flush()

    own, size = [0] * len(soft), [0] * len(soft)
    for block, _, in_links, k in blocks:
        own[k] += len(block) - in_links
        size[k] += len(block)
    for k in range(len(soft) - 1, 0, -1):
        own[around[k]] += own[k]
        size[around[k]] += size[k]
        holds[around[k]] |= holds[k]
    total = own[0]
    noise = [False]
    for k in range(1, len(soft)):
        most = 2 * own[k] >= total and (holds[k] or 10 * own[k] >= 9 * total)
        noise.append(noise[around[k]] or not (most or soft[k] and 2 * own[k] > size[k]))
    page.first = [-1] * len(paths)
    page.last = [-1] * len(paths)
    for block, node, in_links, k in blocks:
        if not noise[k]:
            i = len(page.text)
            page.first[node] = i if page.first[node] < 0 else page.first[node]
            page.last[node] = i + 1
            page.text.append(block)
            page.linked.append(in_links)
            page.node.append(node)
    for k in range(len(paths) - 1, 0, -1):
        if page.first[k] >= 0:
            up = page.parent[k]
            page.first[up] = page.first[k] if page.first[up] < 0 else min(page.first[up], page.first[k])
            page.last[up] = max(page.last[up], page.last[k])
    return page


def scores(page: Page) -> list[float]:
    """Each container's score: characters of text outside links below it, by what kind of element it is."""
    sums = [0.0] * len(page.path)
    for text, linked, node in zip(page.text, page.linked, page.node):
        sums[node] += len(text) - linked
    for k in range(len(sums) - 1, 0, -1):
        sums[page.parent[k]] += sums[k]
    return [s * f for s, f in zip(sums, page.factor)]


def best_of(page: Page) -> tuple[int, list[float]]:
    """The page's best container, and all scores.

    Where all that a container around it has besides is text of its own, outside links, that
    container is the best one; it takes the best score and those within it lose a tenth.
    """
    got = scores(page)
    first = best = max(range(len(got)), key=lambda k: (got[k], -k))
    k = first
    while (outer := page.parent[k]) > 0 and page.factor[outer] >= 1.0 and page.first[k] >= 0:
        more = [*range(page.first[outer], page.first[k]), *range(page.last[k], page.last[outer])]
        if not all(page.node[i] == outer and 2 * page.linked[i] < len(page.text[i]) for i in more):
            break
        k = outer
        best = outer if more else best
    k, top = first, got[first]
    while k != best:
        got[k] *= 0.9
        k = page.parent[k]
    if best != first:
        got[best] = top
    return best, got


def votes(html: str) -> Counter:
    """Thousandths of a vote for each (depth, path): its best container's part of the page's best score."""
    page = parse(html)
    k, got = best_of(page)
    best = got[k]
    out: Counter = Counter()
    if best > 0:
        for path, depth, s in zip(page.path, page.depth, got):
            if path and s > 0:
                out[depth, path] += s
        out = Counter({p: min(1000, round(1000 * s / best)) for p, s in out.items()})
    return out


def extract(html: str, path: int | None) -> str:
    """The blocks below containers of this path, or below the page's best one if they hold under a quarter of its text."""
    page = parse(html)
    best, _ = best_of(page)
    own = page.text[page.first[best] : page.last[best]] if page.first[best] >= 0 else []
    found = []
    if path:
        inside = [False] * len(page.path)
        for k in range(1, len(inside)):
            inside[k] = page.path[k] == path or inside[page.parent[k]]
        found = [t for t, node in zip(page.text, page.node) if inside[node]]
    if 4 * sum(map(len, found)) < sum(map(len, own)):
        found = own
    return "\n".join(found)


def host_of(url: Column) -> Column:
    """The host in lower case, without port; '' for a null url or one without a host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host; ties go to the deeper path, then to the greater hash.

    Votes are summed within each batch and then per (host, path), so a hot host is a few
    rows from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, int, int], int] = {}
            for host, html in zip(*(c.to_pylist() for c in batch.columns)):
                for (depth, path), v in votes((html or b"").decode("utf-8", "replace")).items():
                    total[host, depth, path] = total.get((host, depth, path), 0) + v
            if total:
                hosts, depths, paths = zip(*total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts), pa.array(depths, pa.int64()), pa.array(paths, pa.int64()), pa.array(total.values(), pa.int64())], names=["host", "depth", "path", "votes"]
                )

    cast = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("binary").alias("html"))
    summed = cast.mapInArrow(run, "host string, depth long, path long, votes long").groupBy("host", "depth", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.max(F.struct("votes", "depth", "path")).alias("top")).select("host", F.col("top.path").alias("path"))


def extract_pages(pages: DataFrame, max_broadcast: int = 50_000) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html).

    A null or empty html has an empty text, a null url the host ''. Repeated rows are repeated;
    other columns are ignored; an empty table stays empty. Hosts' paths are broadcast when they
    are ``max_broadcast`` at most, and joined by host, where a hot host can be split, beyond.
    """
    paths = store.materialize(host_paths(pages), "host-paths")
    few = paths.limit(max_broadcast + 1).count() <= max_broadcast
    d = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("binary").alias("html"))
    d = d.join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract((h or b"").decode("utf-8", "replace"), p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return d.mapInArrow(run, f"page_id {kind}, url string, text string")
