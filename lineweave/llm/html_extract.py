"""Main text of web pages by equivalence-class template deduction.

1. A page is read as tokens: its tags, each with the containers that it stands in and its class or id, and its
   texts in their place. The occurrence vector of a token says how often it is in each page of its host; it is
   summed up as one hash over the pages, so that a host of any size is aggregated in parts.
2. Tokens of a host with the same vector form an equivalence class. A class is valid if it is in at least
   ``SUPPORT`` of at least ``MIN_PAGES`` pages of the host and has ``MIN_CLASS`` tokens or more. The tokens of
   valid classes, ordered by their mean place in the pages, nest into the host's template.
   Pages of a host with equal html count once.
3. On each page template tokens are matched in that order; what stands out of order is data. Template tags bound
   the slots; what remains in a slot is its content. Template texts go, but not those inside an article or main element, and
   not those that stand in one container, below the body, with the page's own text, inside the container of the longest slot.
4. Slots are kept or not by what encloses them: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
   styles and comments go, by element, role, class or id. Where a page has an article or main element, its
   slots are the text; otherwise all slots are.

Blocks are joined by a blank line; white space inside a block, line breaks too, is one space; character
references are decoded. Nothing else is dropped or cut.

Defined results: null html gives an empty text; a page without url, or the only one of its host, is judged by
step 4 alone; repeated pages get equal texts; broken markup is read as far as it goes; a tag that never
closes ends with what encloses it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import wordhash as wh
from lineweave.session import stored

SUPPORT, MIN_PAGES, MIN_CLASS = 0.9, 10, 3

NAME_OF_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'|[\"']")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z0-9]+")

# Elements of the HTML standard and usual names in class and id.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noframes", "object"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
CONTAINERS = {"html", "head", "body", "div", "section", "nav", "ul", "ol", "dl", "table", "article", "main", "aside", "footer",
              "header", "form", "figure", "details", "dialog", "fieldset"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "caption", "thead", "tbody",
                       "tfoot", "blockquote", "pre", "address", "figcaption", "hr", "legend", "summary", "hgroup", "center"}
NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "option", "label", "fieldset"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu",
               "menubar", "toolbar"}
NOISE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "banner", "sponsor",
               "sponsored", "promo", "promotion", "sidebar", "widget", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
               "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share",
               "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus",
               "respond", "replies", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead",
               "pagination", "pager", "search", "searchbox", "toolbar", "skip", "hidden"}
# Parts that a name has beside one of those when it still means the same, as in share-buttons; market-share is no such name.
PLAIN_PARTS = {"box", "block", "area", "list", "links", "button", "buttons", "container", "wrapper", "bar", "icons", "icon", "form", "section",
               "posts", "articles", "items", "stories", "inner", "outer", "content", "main", "post", "page", "site", "top", "bottom", "left", "right"}
OUTSIDE_NAMES = {"header", "topbar"}  # noise outside an article only
# Articles in these are comments, teasers and the like, not the page's own.
FOREIGN_TAGS = {"aside", "form", "footer", "dialog"}
FOREIGN_NAMES = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "related", "recommended", "recommendations"}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _foreign(tag: str, attributes: dict[str, str]) -> bool:
    return tag in FOREIGN_TAGS or bool(set(NAME.findall(attributes.get("class", "") + " " + attributes.get("id", ""))) & FOREIGN_NAMES)


def _noise(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if attributes.get("role") in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    given = (attributes.get("class", "") + " " + attributes.get("id", "")).split()
    names = [set(NAME.findall(name)) for name in given]
    if inside:  # part of an article unless the whole name says otherwise
        return any(parts & NOISE_NAMES and parts <= NOISE_NAMES | PLAIN_PARTS for parts in names)
    return any(parts & (NOISE_NAMES | OUTSIDE_NAMES) for parts in names)


def tags_of(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(begin, end, slash, name, attributes)`` of comments (no name) and tags, in one pass without going back.

    A tag ends at the first ``>`` outside of quotes; a quote that is not closed before the next ``<`` is a character like others.
    """
    at, size = 0, len(source)
    while (begin := source.find("<", at)) >= 0:
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            yield begin, at, "", "", ""
            continue
        if source.startswith("<![CDATA[", begin):
            end = source.find("]]>", begin)
            at = size if end < 0 else end + 3
            yield begin, at, "", "", ""
            continue
        if source.startswith(("<!", "<?"), begin):
            end = source.find(">", begin)
            at = size if end < 0 else end + 1
            yield begin, at, "", "", ""
            continue
        name = NAME_OF_TAG.match(source, begin + 1)
        if not name:
            at = begin + 1
            continue
        end = source.find(">", name.end())
        if end < 0:
            return  # no tag ends any more
        scanned = name.end()
        while True:  # is this ">" inside of quotes?
            open_quote = next((m for m in QUOTED.finditer(source, scanned, end) if len(m[0]) == 1), None)
            if open_quote is None:
                break
            limit = source.find("<", end)
            close = source.find(open_quote[0], end, size if limit < 0 else limit)
            further = source.find(">", close) if close >= 0 else -1
            if further < 0:
                break
            scanned, end = close + 1, further
        at = end + 1
        yield begin, at, name[1], name[2].lower(), source[name.end():end]


class Page:
    """Tokens of a page, and the tree of the containers that they stand in.

    ``tokens`` are ``(kind, key, text, noise, main, container)``; kind is ``tag`` or ``text``. A text token is one block: all inline
    text between two block tags. ``key`` tells a token from others; a container is known in it by a hash of its path. Container 0 is the page;
    ``parent``, ``tag`` and ``last`` (the last container inside) are lists by container, which are numbered in page order.
    """

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, str, bool, bool, int]] = []
        self.parent, self.tag, self.last = [-1], [""], [0]
        self._read(source)

    def _read(self, source: str) -> None:
        path: list[tuple[str, str, int]] = [("", "", 0)]  # tag, hash, container
        open_tags: dict[str, int] = {}
        noise: list | None = None  # path length, tag, open tags of that name, block tags inside an inline one (None: a block)
        foreign = False
        mains: list[int] = []
        words: list[str] = []
        quiet: list[str] = []  # inline noise of the block that is read

        def flush() -> None:
            for part, loud in ((words, noise is not None and noise[3] is None), (quiet, True)):
                text = " ".join(html.unescape("".join(part)).split()) if part else ""
                part.clear()
                if text:
                    self.tokens.append(("text", f"{path[-1][1]}#{text}", text, loud, bool(mains), path[-1][2]))

        def say(text: str) -> None:
            (words if noise is None or noise[3] is None else quiet).append(text)

        at, skip = 0, 0
        for begin, end, slash, tag, raw in tags_of(source):
            if begin < skip:
                continue
            if begin > at:
                say(source[at:begin])
            at = end
            if not tag:
                continue
            if tag in RAW:
                if not slash and not raw.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    stop = source.find(">", close.end()) if close else -1
                    at = skip = stop + 1 if stop >= 0 else len(source)
                    self.tokens.append(("tag", f"{path[-1][1]}/{tag}", "", True, False, path[-1][2]))
                continue
            if tag == "br":
                say(" ")
                continue
            attributes = None
            if tag not in BLOCKS and not slash:
                attributes = _attributes(raw)
                if tag in VOID or not attributes and tag not in NOISE_TAGS:
                    continue
            if tag in BLOCKS:
                flush()
            if slash:
                if noise and noise[1] == tag:
                    noise[2] -= 1
                    if not noise[2]:
                        noise = None
                elif noise and noise[3] is not None and tag in BLOCKS:
                    noise[3] -= 1
                    if noise[3] < 0:  # the block that it stands in ends, and so does inline noise that never closed
                        noise = None
                if open_tags.get(tag):
                    while True:
                        name, _, container = path.pop()
                        open_tags[name] -= 1
                        self.last[container] = len(self.tag) - 1
                        if name == tag:
                            break
                    while mains and mains[-1] >= len(path):
                        mains.pop()
                    if noise and noise[0] > len(path):
                        noise = None
                continue
            attributes = _attributes(raw) if attributes is None else attributes
            label = tag + "".join(f".{attributes[a]}" for a in ("id", "class") if attributes.get(a))
            place = hashlib.blake2b(f"{path[-1][1]}/{label}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            loud = _noise(tag, attributes, bool(mains))
            if tag in ("article", "main") and not loud and noise and not foreign and not mains:
                noise = None  # a menu or notice that never closed
            if noise is None and loud:
                noise, foreign = [len(path), tag, 1, None if tag in BLOCKS else 0], _foreign(tag, attributes)
            elif noise and noise[1] == tag:
                noise[2] += 1
            elif noise and noise[3] is not None and tag in BLOCKS and tag != "hr":
                noise[3] += 1
            if tag in ("article", "main") and noise is None:
                mains.append(len(path))
            if tag in BLOCKS:
                self.tokens.append(("tag", place, "", noise is not None, bool(mains), path[-1][2]))
            if tag in CONTAINERS:
                self.parent.append(path[-1][2]), self.tag.append(tag), self.last.append(0)
                path.append((tag, place, len(self.tag) - 1))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        if at < len(source):
            say(source[at:])
        flush()
        for _, _, container in path:
            self.last[container] = len(self.tag) - 1

    def common(self, containers: list[int]) -> int:
        """The innermost container that holds all of these: in page order, that of the first and the last."""
        at, last = min(containers), max(containers)
        while self.last[at] < last:
            at = self.parent[at]
        return at


def _hashes(keys: list[str]) -> np.ndarray:
    data, offsets = wh.text_buffers(pa.array(keys, pa.large_string()))
    return wh.run_hashes(data, offsets[:-1], offsets[1:], np.arange(1, 257, dtype=np.uint64)) if len(keys) else np.zeros(0, np.uint64)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of each page with their counts and mean places (0 to 1)."""
    for batch in batches:
        for part in wh.slices(batch, "html"):
            page, tokens, counts, places = [], [], [], []
            for i, source in enumerate(part.column("html").to_pylist()):
                keys = _hashes([t[1] for t in Page(source or "").tokens])
                token, first, count = np.unique(keys, return_index=True, return_counts=True)
                page.append(np.full(len(token), i))
                tokens.append(token), counts.append(count), places.append((first + 1) / (len(keys) + 1))
            index = pa.array(np.concatenate(page))
            yield pa.RecordBatch.from_arrays(
                [part.column("host").take(index), part.column("page").take(index), pa.array(np.concatenate(tokens).view(np.int64)),
                 pa.array(np.concatenate(counts)), pa.array(np.concatenate(places).astype(np.float64))],
                ["host", "page", "token", "n", "place"])


def templates(rows: DataFrame) -> DataFrame:
    """``host, template``: the tokens of valid equivalence classes in the order of their mean places."""
    keyed = rows.filter("host is not null").withColumn("digest", F.xxhash64("html"))
    counted = keyed.groupBy("host", "digest").agg(F.count("*").alias("n"))
    # only html that repeats is moved, to be counted once
    repeats = stored(counted.filter("n > 1").select("host", "digest"), "repeats")
    again = keyed.join(repeats, ["host", "digest"], "left_semi").dropDuplicates(["host", "html"])
    distinct = keyed.join(repeats, ["host", "digest"], "left_anti").unionByName(again).select("host", "page", "html")
    seen = distinct.mapInArrow(
        _occurrences, "host string, page bigint, token bigint, n bigint, place double")
    vectors = seen.groupBy("host", "token").agg(
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"), F.count("*").alias("pages"), F.avg("place").alias("place"))
    hosts = counted.groupBy("host").agg(F.count("*").alias("all_pages")).filter(F.col("all_pages") >= MIN_PAGES)
    # tokens on few pages are in no template, whatever the host: most of a page's own go before they meet the hosts
    frequent = vectors.filter(F.col("pages") >= SUPPORT * MIN_PAGES).join(hosts, "host").filter(F.col("pages") >= SUPPORT * F.col("all_pages"))
    valid = frequent.groupBy("host", "vector").agg(
        F.count("*").alias("size"), F.collect_list(F.struct("place", "token")).alias("tokens")).filter(F.col("size") >= MIN_CLASS)
    return valid.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens")).select(
        "host", F.transform("tokens", lambda t: t["token"]).alias("template"))


def page_text(source: str, template: list[int] | None) -> str:
    page = Page(source)
    order = {int(t): i for i, t in enumerate(template or [])}
    keys = _hashes([t[1] for t in page.tokens]).view(np.int64).tolist() if order else [0] * len(page.tokens)
    blocks: list[tuple[int, str, bool, int]] = []  # container, text, of the template, slot between template tags
    last, slot, main = -1, 0, any(t[4] and not t[3] and t[2] for t in page.tokens)
    for key, (kind, _, text, noise, inside, container) in zip(keys, page.tokens, strict=True):
        place = order.get(key, -1)
        matched = place > last
        if matched:
            last = place
        if kind == "tag":
            slot += matched
        elif not noise and (inside or not main):
            blocks.append((container, text, matched and not inside, slot))
    own = _own_containers(page, blocks)
    return "\n\n".join(text for container, text, shared, _ in blocks if not shared or container in own)


def _own_containers(page: Page, blocks: list[tuple[int, str, bool, int]]) -> set[int]:
    """Containers below the body that hold the page's own text, inside the container of its longest slot."""
    sizes: dict[int, int] = {}
    for _, text, shared, slot in blocks:
        if not shared:
            sizes[slot] = sizes.get(slot, 0) + len(text)
    if not sizes:
        return set()
    longest = max(sizes, key=sizes.get)
    common = page.common([c for c, _, shared, slot in blocks if slot == longest and not shared])
    return {c for c, _, shared, _ in blocks if not shared and common <= c <= page.last[common] and page.tag[c] not in ("", "html", "body")}


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wh.slices(batch, "html"):
            texts = [page_text(h or "", t) for h, t in zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([t is not None for t in part.column("template").to_pylist()])],
                ["id", "url", "text", "n_chars", "has_template"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``id_col, url_col, text, n_chars, has_template``."""
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    rows = rows.withColumn("host", F.lower(F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    keyed = rows.select("host", F.xxhash64("id", "url").alias("page"), "html")
    # written first, so that its size is known: pages are not shuffled unless the templates of all hosts are large
    out = rows.join(stored(templates(keyed), "templates"), "host", "left").select("id", "url", "html", "template")
    return (out.mapInArrow(_texts, "id bigint, url string, text string, n_chars bigint, has_template boolean")
            .withColumnsRenamed({"id": id_col, "url": url_col}))
