"""Main text of web pages by what the pages of a host have in common.

A page is a list of regions, its article or main elements and otherwise the outermost elements of
its body, with their blocks of text. A name (class, id or role) that says what is not the article
makes an element a region of its own, but never html or body, nor an element that holds the
article or most of the page's free text; an article in an article, and elements named as reader
comments, are noise even if they hold most of it. The lists of regions of one host are aligned: where texts
of a region differ it has a slot, and what only one list has is optional. The result is a wrapper,
a list of regions again, so wrappers are aligned like pages: each task aligns the pages of a host
that it has in blocks, and wrappers of a host then meet in rounds of bounded fan-in.

A page is then read region by region, with no share that a region must have: its article or main
if it has one, with other articles only where they stand beside it and do not begin with a link, else all regions but the template. Template is what the host's pages show as mostly
links or as the same text on all of at least ``SURE_PAGES`` pages, and what is named so, unless the
host has most of its varying free text there. If that leaves nothing, the page is judged by itself.

This is not the alignment of whole token streams by which union-free expressions are inferred:
below regions nothing is aligned, a fixed block inside an article stays, and the marks of optional
and repeated groups describe a host but decide nothing.

Defined results: null or empty html gives an empty text; a page without a host is judged by its own
one-page wrapper; unclosed tags end with what surrounds them, and whatever is left open, a page takes
time by its length; comments more than ``LONG_COMMENTS`` times as long as all else count as the article; null and repeated ids are rows like
others; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank.llm.common import written

#: Pages of a host that one task aligns before it passes the wrapper on.
BLOCK_PAGES = 64
FAN_IN = 64
#: Pages that must show the same text before it counts as template.
SURE_PAGES = 3
#: How many times longer than all else named comments must be to count as the article.
LONG_COMMENTS = 10

# HTML's elements by how they are read.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
    "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_NOT_TEXT = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "search", "head"}
_ENDS_P = _BLOCK - {"html", "body"}
# Words in class, id or role that name what is not the article.
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menus?|breadcrumbs?|header|masthead|"
    r"footer|foot|sidebar|side|aside|widget\w*|related|recommend\w*|share|sharing|social|cookies?|consent|"
    r"notices?|popup|modal|overlay|newsletter|subscri\w*|signup|login|search\w*|forms?|comments?|replies|reply|"
    r"discussion|disqus|legal|copyright|toolbar|pagination|pager|alert|complementary|contentinfo|navigation|gdpr)"
    r"(?:$|[\s_-])",
    re.I,
)
# Words in a name that say reader comments.
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|discussion|disqus)(?:$|[\s_-])", re.I)
# A tag to its end; quotes count only after an equals sign. Nothing is given back, so one try is one pass.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
# The same to the first bracket, for what follows a tag that quotes leave open to the page's end.
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")
_NUMBERS = re.compile(r"[0-9]+")
_PARTS = re.compile(r"[A-Za-z0-9][-_]+(?=[A-Za-z0-9])")


def _after(html: str, end: str, at: int) -> int:
    """The place after the next ``end``, that of the page's end if there is none."""
    found = html.find(end, at)
    return len(html) if found < 0 else found + len(end)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): open, close or text; scripts and the like are skipped whole.

    The page is passed once, whatever is left open in it.
    """
    at = begin = 0
    tag = _TAG
    while (at := html.find("<", at)) >= 0:
        mark = html[at + 1 : at + 2]
        if mark in ("!", "?"):
            if at > begin:
                yield "text", "", html[begin:at]
            end = "-->" if html.startswith("<!--", at) else "]]>" if html.startswith("<![CDATA[", at) else ">"
            at = begin = _after(html, end, at + 2)
            continue
        found = tag.match(html, at)
        if not found and (mark + html[at + 2 : at + 3]).strip("/")[:1].isalpha():
            tag = _LOOSE
            found = tag.match(html, at)
            if not found and ">" not in html[at:]:
                break
        if not found:
            at += 1
            continue
        if at > begin:
            yield "text", "", html[begin:at]
        at = begin = found.end()
        name = found[2].lower()
        if found[1]:
            yield "close", name, ""
            continue
        if name in _RAW:
            end = _RAW_END[name].search(html, at)
            at = begin = _after(html, ">", end.end()) if end else len(html)
            continue
        named = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(found[3])} if found[3] else {}
        label = " ".join(named.get(k, "") for k in ("class", "id", "role")).strip()
        hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(
            r"display\s*:\s*none", named.get("style", ""), re.I
        )
        yield "open", name, ("\x00" if hidden else "") + label
        if name in _VOID:
            yield "close", name, ""
    if begin < len(html):
        yield "text", "", html[begin:]


class Region:
    """A part of a page: its signature, whether it is noise or the article's, its texts, how much is links."""

    def __init__(self, signature: str, noise: bool = False, main: bool = False):
        self.signature = signature
        self.noise, self.main = noise, main
        self.blocks: list[str] = []
        self.linked = 0


class _Element:
    """An element of a page and what its names and its place say of it.

    ``free`` is the text outside of links in it, ``clean`` what of that no doubtful element inside
    holds, ``own`` what of that belongs to no other article or main inside.
    """

    __slots__ = (
        "name", "label", "parent", "main", "story", "named", "hard", "reply", "doubtful", "dropped", "shaded", "home",
        "outer", "free", "clean", "own", "head", "noise",
    )

    def __init__(self, name: str, label: str, hidden: bool, parent: _Element | None):
        self.name, self.label, self.parent = name, label, parent
        self.main = name in ("article", "main")
        self.story = name == "article" or bool(parent and parent.story)
        self.named = name not in ("html", "body") and bool(label) and bool(_NOISE.search(label))
        self.hard = hidden or name in _NOT_TEXT
        # A header inside an article is its heading.
        if name == "header" and parent and parent.home and not hidden:
            self.hard = self.named = False
        # An article in an article is a comment on it, or another story.
        inner = name == "article" and bool(parent and parent.story)
        self.reply = inner or bool(parent and parent.reply) or (self.main and bool(_COMMENTS.search(label)))
        self.doubtful = self.named or inner
        self.dropped = self.hard or bool(parent and parent.dropped)
        self.shaded = self.doubtful or bool(parent and parent.shaded)
        self.home: _Element | None = self if self.main else parent.home if parent else None
        self.outer: _Element | None = parent and parent.outer
        if self.outer is None and name in ("div", "section", "table", "td"):
            self.outer = self
        self.free = self.clean = self.own = 0
        self.head: bool | None = None  # whether its first block is a link
        self.noise: _Element | None = None

    @property
    def signature(self) -> str:
        # Numbers, and names of four or more parts, are those of a page and not of its template.
        words = [_NUMBERS.sub("#", w) for w in self.label.lower().split() if len(_PARTS.findall(w)) < 3]
        return f"{self.name}.{' '.join(words)}" if words else self.name


def _parsed(html: str) -> tuple[list[_Element], list[tuple[str, bool, _Element | None]]]:
    """The elements in order, and the blocks of text with whether they are links and where they are."""
    elements: list[_Element] = []
    blocks: list[tuple[str, bool, _Element | None]] = []
    # Open names, each with its element, or that around it where it changes nothing.
    stack: list[tuple[str, _Element | None]] = []
    blocks_open: Counter[str] = Counter()
    # Elements inside a line that are open in each block.
    inline_open: list[Counter[str]] = [Counter()]
    buffer: list[str] = []
    anchors = linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
        buffer.clear()
        # A block is a link where links hold the most of it.
        is_link, linked = 2 * linked > len(text), 0
        place = stack[-1][1] if stack else None
        if not text or (place and place.dropped):
            return
        blocks.append((text, is_link, place))
        if place:
            if not is_link:
                place.free += len(text)
                place.clean += len(text)
                place.own += len(text)
            if place.home and place.home.head is None:
                place.home.head = is_link

    def leave() -> str:
        nonlocal anchors
        name = stack.pop()[0]
        if name in _BLOCK:
            blocks_open[name] -= 1
            inline_open.pop()
        else:
            inline_open[-1][name] -= 1
            anchors -= name == "a"
        return name

    for kind, name, value in tokens(html):
        is_block = name in _BLOCK
        if kind == "text":
            buffer.append(value)
            if anchors:
                linked += len(value.strip())
        elif kind == "open":
            if name == "br":
                buffer.append(" ")
            if name in _VOID and name != "hr":
                continue
            if is_block:
                flush()
                # A paragraph ends where a block begins, and a list item where its like does.
                while stack:
                    last = stack[-1][0]
                    if not (
                        (last == "p" and name in _ENDS_P)
                        or (last == name and name in ("li", "dt", "dd", "tr", "td", "th"))
                        or (last not in _BLOCK and last != "a" and blocks_open["p"])
                    ):
                        break
                    leave()
            elif name == "a":
                # Links do not hold links.
                while inline_open[-1]["a"]:
                    leave()
                anchors += 1
            element = stack[-1][1] if stack else None
            if is_block or value or name in _NOT_TEXT:
                element = _Element(name, value.lstrip("\x00"), value[:1] == "\x00", element)
                elements.append(element)
            stack.append((name, element))
            if is_block:
                blocks_open[name] += 1
                inline_open.append(Counter())
            else:
                inline_open[-1][name] += 1
        else:
            if is_block:
                flush()
            # Blocks are not closed by the end of an element inside a line.
            if blocks_open[name] if is_block else inline_open[-1][name]:
                while leave() != name:
                    pass
    flush()
    return elements, blocks


def _judge(elements: list[_Element], rest: int) -> tuple[_Element | None, set[_Element]]:
    """The article, if there is one, and what it is in; marks each element that is in noise.

    ``rest`` is the text outside of all elements.
    """
    total = clean = rest
    for x in reversed(elements):
        if x.parent:
            x.parent.free += x.free
            x.parent.clean += 0 if x.doubtful else x.clean
            x.parent.own += 0 if x.doubtful or x.main else x.own
        else:
            total += x.free
            clean += 0 if x.doubtful else x.clean
    # The article has the most text of its own, one outside of doubtful elements first.
    article, reply = (
        max(
            (x for x in elements if x.head is not None and x.reply == is_reply),
            key=lambda x: (x.own, not x.shaded),
            default=None,
        )
        for is_reply in (False, True)
    )
    if reply and (not article or LONG_COMMENTS * article.own < reply.own):
        article = reply
    around, x = set(), article
    while x:
        around.add(x)
        x = x.parent
    for x in elements:
        if x.parent and x.parent.noise:
            x.noise = x.parent.noise
        elif x.doubtful and x not in around:
            # The most of the text outweighs a name, but comments may be longer than their article.
            beside = article.clean if article and x.home else clean
            outweighed = 2 * x.free > total and (not article or x.home)
            if _COMMENTS.search(x.label) or not x.named:
                outweighed = outweighed and LONG_COMMENTS * beside < x.free
            x.noise = None if outweighed else x
    return article, around


def _is_of(home: _Element | None, article: _Element | None, around: set[_Element]) -> bool:
    """Whether an article or main element belongs to the article, or tells another story."""
    if home is None or article is None:
        return False
    return home in around or (home.parent in (article, article.parent) and not home.head)


def regions(html: str | None) -> list[Region]:
    """The regions of a page in order; what tags exclude is left out."""
    elements, blocks = _parsed(html or "")
    article, around = _judge(elements, sum(len(text) for text, linked, x in blocks if x is None and not linked))
    homes: dict[_Element | None, bool] = {}
    out: list[Region] = []
    for text, linked, x in blocks:
        noise = x and x.noise
        home = x and x.home
        if home not in homes:
            homes[home] = _is_of(home, article, around)
        # The innermost article or main, else the outermost element below body.
        place = noise or home or (x and x.outer)
        key = (place.signature if place else "body", noise is not None, homes[home] and not noise)
        if not out or (out[-1].signature, out[-1].noise, out[-1].main) != key:
            out.append(Region(*key))
        out[-1].blocks.append(text)
        if linked:
            out[-1].linked += len(text)
    return out


def wrapper_of(found: list[Region]) -> list[dict]:
    """The wrapper of one page."""
    groups: dict[tuple[str, bool], Region] = {}
    for region in found:
        # Regions of one signature are one repeated group.
        one = groups.setdefault((region.signature, region.noise), Region(region.signature, region.noise))
        one.blocks += region.blocks
        one.linked += region.linked
    out: list[dict] = []
    for region in groups.values():
        text = "\n".join(region.blocks)
        out.append(
            {
                "signature": region.signature,
                "noise": region.noise,
                "optional": False,
                "repeated": len(region.blocks) > 1,
                # Long texts are compared by their digest.
                "text": text if len(text) < 100 else hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
                "chars": sum(map(len, region.blocks)),
                "linked": region.linked,
                "slots": 0,
                "pages": 1,
            }
        )
    return out


def align(left: list[dict], right: list[dict]) -> list[dict]:
    """One wrapper of two: mismatched texts become slots, unmatched parts optional groups."""
    match = difflib.SequenceMatcher(
        None, *([(x["signature"], x["noise"]) for x in side] for side in (left, right)), autojunk=False
    )

    def joined(x: dict, y: dict) -> dict:
        same = x["text"] is not None and x["text"] == y["text"]
        return x | {
            "optional": x["optional"] or y["optional"],
            "repeated": x["repeated"] or y["repeated"],
            "text": x["text"] if same else None,
            "slots": x["slots"] + y["slots"] + (not same),
            **{k: x[k] + y[k] for k in ("chars", "linked", "pages")},
        }

    out: list[dict] = []
    for kind, a, b, c, d in match.get_opcodes():
        if kind == "equal":
            out += [joined(x, y) for x, y in zip(left[a:b], right[c:d], strict=True)]
            continue
        for x in left[a:b] + right[c:d]:
            # The same optional group is kept once.
            if out and (out[-1]["signature"], out[-1]["noise"]) == (x["signature"], x["noise"]):
                out[-1] = joined(out[-1], x) | {"optional": True, "repeated": True}
            else:
                out.append(x | {"optional": True})
    return out


def template_of(wrapper: list[dict]) -> tuple[set[str], set[str]]:
    """The signatures that the host shows as template, and those named noise that it overrules."""
    seen: dict[str, list[dict]] = {}
    for x in wrapper:
        seen.setdefault(x["signature"], []).append(x)
    template, varying = set(), {}
    for signature, items in seen.items():
        chars, linked, pages = (sum(x[k] for x in items) for k in ("chars", "linked", "pages"))
        fixed = pages >= SURE_PAGES and not any(x["slots"] for x in items)
        if 2 * linked > chars or (fixed and len({x["text"] for x in items}) == 1):
            template.add(signature)
        else:
            varying[signature] = chars - linked
    whole = sum(varying.values())
    named = {x["signature"] for x in wrapper if x["noise"]}
    # A host's comments may be longer than its articles.
    named -= {s for s in named if _COMMENTS.search(s.partition(".")[2])}
    return template, {s for s, free in varying.items() if s in named and 2 * free > whole}


def _chosen(found: list[Region], template: set[str], overruled: set[str]) -> list[Region]:
    main = [r for r in found if r.main]
    return main or [
        r for r in found if (not r.noise or r.signature in overruled) and r.signature not in template
    ]


def extracted(html: str | None, known: tuple[set[str], set[str]] | None) -> str:
    """The article's blocks, joined by an empty line."""
    found = regions(html)
    chosen = _chosen(found, *known) if known else []
    if not chosen:
        chosen = _chosen(found, *template_of(wrapper_of(found)))
    return "\n\n".join(block for r in chosen for block in r.blocks)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))


def infer(pages: DataFrame, block_pages: int = BLOCK_PAGES, fan_in: int = FAN_IN) -> DataFrame:
    """(host, wrapper): the wrapper of each host, from all its pages."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: dict[str, list[dict]] = {}
            for host, html in zip(pdf["host"], pdf["html"], strict=True):
                own = wrapper_of(regions(html))
                held[host] = align(held[host], own) if host in held else own
            yield pd.DataFrame(
                {"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]}
            )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        total: list[dict] | None = None
        for text in sorted(pdf["wrapper"]):
            own = json.loads(text)
            total = own if total is None else align(total, own)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(total)]})

    rows = written(
        pages.select(host_of().alias("host"), "html")
        .filter("host <> ''")
        .mapInPandas(learn, "host string, wrapper string"),
        "wrappers",
    )
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    while most > 1:
        parts = max(1, -(-most // fan_in))
        salted = rows.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts)))
        rows = written(
            salted.groupBy("host", "part").applyInPandas(meet, "host string, wrapper string"),
            "wrappers",
        )
        most = 1 if parts == 1 else rows.groupBy("host").count().agg(F.max("count")).first()[0]
    return rows


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url and the main text of the whole page."""
    wrappers = infer(pages).withColumnRenamed("host", "__host")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[str, tuple[set[str], set[str]]] = {}
            texts = []
            for html, wrapper in zip(pdf["html"], pdf["wrapper"], strict=True):
                if wrapper is not None and wrapper not in known:
                    known[wrapper] = template_of(json.loads(wrapper))
                texts.append(extracted(html, known.get(wrapper)))
            out = pdf[["page_id", "url"]].assign(text=texts)
            yield out.assign(page_id=out["page_id"].astype("Int64"))

    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host")
    )
    # Hosts with a third of the pages are split by the adaptive join.
    return (
        own.join(wrappers, F.col("host") == F.col("__host"), "left")
        .select("page_id", "url", "html", "wrapper")
        .mapInPandas(read, "page_id long, url string, text string")
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )
