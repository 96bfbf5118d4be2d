"""Patent and product pages: bibliography, abstract, description, claims, images and media from HTML.

The markup is read by the standard library's parser, a batch of pages at a time; an unclosed or stray tag never raises.
Null and empty pages give empty fields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovex.functions.text import ws_normalize
from trovex.operators import claims as K

# Names in the markup, and where patent images and product media live.
META_NAMES = ("DC.title", "DC.identifier", "DC.creator")
LEAST_CLAIM = 10
CLAIM_INTRO = "what is claimed"
NUMBERED = re.compile(r"^(claim\s*)?\d+[\.\:\-]\s+", re.IGNORECASE)
IMAGE_HOST = "https://patentimages.storage.googleapis.com/"
PATENT_PNG = re.compile(r"https://patentimages\.storage\.googleapis\.com/[A-Za-z0-9/_\-]+\.png")
VIDEO_META = ("og:video:secure_url", "og:video", "og:video:url")
VIDEO_KEYS = ("contentUrl", "url", "embedUrl")
SHOP_MP4 = re.compile(r"[\"'](https?://m\.media-amazon\.com/[^\"']+\.mp4[^\"']*)[\"']", re.IGNORECASE)
ANY_MP4 = re.compile(r"https?://[^\s\"'<>]+?\.mp4(?:\?[^\"\s'<>]*)?", re.IGNORECASE)
ANY_M3U8 = re.compile(r"https?://[^\s\"'<>]+?\.m3u8(?:\?[^\"\s'<>]*)?", re.IGNORECASE)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element: tag, attributes, and children, which are nodes and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator["Node"]:
        """This element and all below it, in document order; no recursion, so depth is no limit."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def first(self, test: Callable[["Node"], bool]) -> "Node | None":
        return next((n for n in self.walk() if test(n)), None)

    def strings(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("\xa0", " ")).strip()


def _text(node: Node | None) -> str:
    return squeeze("".join(node.strings())) if node else ""


def _named(tag: str, key: str, value: str) -> Callable[[Node], bool]:
    return lambda n: n.tag == tag and n.attrs.get(key) == value


def _first(nodes: list[Node], test: Callable[[Node], bool]) -> Node | None:
    return next((n for n in nodes if test(n)), None)


def bibliography(nodes: list[Node]) -> dict[str, str]:
    """Named meta tags, then all itemprop values of dd and meta elements; of a repeated key the last value stays."""
    out, metas = {}, [n for n in nodes if n.tag == "meta"]
    for name in META_NAMES:
        tag = _first(metas, _named("meta", "name", name))
        if tag and tag.attrs.get("content"):
            out[name] = tag.attrs["content"]
    for n in nodes:
        if n.tag in ("dd", "meta") and n.attrs.get("itemprop"):
            value = n.attrs.get("content") if n.tag == "meta" else _text(n)
            if value:
                out[n.attrs["itemprop"]] = value
    return out


def claim_texts(nodes: list[Node]) -> list[str]:
    """The numbered claims of the claims section, each once, without a first one that holds all others; the whole section
    as one where nothing is numbered."""
    section = _first(nodes, _named("section", "itemprop", "claims"))
    if not section:
        return []
    texts = [_text(n) for n in section.walk() if n is not section and n.tag in ("claim-text", "div")]
    texts = list(dict.fromkeys(t for t in texts if len(t) >= LEAST_CLAIM and CLAIM_INTRO not in t.lower() and NUMBERED.match(t)))
    if len(texts) > 1 and all(t.lower() in texts[0].lower() for t in texts[1:]):
        texts = texts[1:]
    whole = _text(section)
    return texts or ([whole] if whole else [])


def patent_page(html: str | None) -> tuple:
    """(bibliographic, abstract, description, claim texts, images) of a page."""
    nodes = list(parse(html).walk())
    abstract = _first(nodes, _named("div", "itemprop", "abstract"))
    if abstract:
        said = _text(abstract)
    else:
        meta = _first(nodes, _named("meta", "name", "DC.description"))
        said = meta.attrs.get("content", "") if meta else ""
    body = _first(nodes, _named("div", "itemprop", "description"))
    if body:
        described = _text(body)
    else:
        body = _first(nodes, lambda n: (n.tag == "section" and n.attrs.get("id") == "description") or (n.tag == "div" and "description" in n.attrs.get("class", "").split()))
        described = " ".join(x.strip() for x in body.strings() if x.strip()) if body else ""
    images = [n.attrs["src"] for n in nodes if n.tag == "img" and "patent" in n.attrs.get("src", "").lower()]
    return bibliography(nodes), said, described, claim_texts(nodes), images


_PAGE = T.StructType(
    [
        T.StructField("bibliographic", T.MapType(T.StringType(), T.StringType())),
        T.StructField("abstract", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("claim_texts", T.ArrayType(T.StringType())),
        T.StructField("images", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(_PAGE)
def _read_page(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([patent_page(h) for h in html], columns=_PAGE.names)


def read_patent_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without their markup, with bibliographic, abstract, description, images and claims: (text, claim_number, dependent, depends_on)."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html]
    rows = pages.select(*rest, _read_page(html).alias("__page"))

    def claim(t: Column) -> Column:
        c = K.parse_claim(t)
        return F.struct(t.alias("text"), c["claim_number"].alias("claim_number"), c["depends_on"].isNotNull().alias("dependent"), c["depends_on"].alias("depends_on"))

    fields = [F.col(f"__page.{c}").alias(c) for c in ("bibliographic", "abstract", "description", "images")]
    return rows.select(*rest, *fields, F.transform("__page.claim_texts", claim).alias("claims"))


def linked_data(html: str) -> Iterator[object]:
    """The values of a page's JSON-LD scripts, malformed ones left out."""
    for m in re.finditer(r"<script[^>]+application/ld\+json[^>]*>(.*?)</script>", html, re.DOTALL | re.IGNORECASE):
        try:
            yield json.loads(m.group(1))
        except ValueError:
            continue


def _inside(value: object) -> Iterator[object]:
    """A JSON value and all within it, in order."""
    stack = [value]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []))


def video_url(html: str | None) -> str | None:
    """A page's video: og:video tags, video and source elements, JSON-LD, the shop's own links, any MP4, any playlist."""
    if not html:
        return None
    root = parse(html)
    for name in VIDEO_META:
        tag = root.first(_named("meta", "property", name))
        if tag and tag.attrs.get("content", "").strip().endswith(".mp4"):
            return tag.attrs["content"].strip()
    for n in root.walk():
        if n.tag in ("video", "source") and n.attrs.get("src", "").strip().endswith(".mp4"):
            return n.attrs["src"].strip()
    for value in linked_data(html):
        for x in _inside(value):
            if isinstance(x, dict) and "Video" in str(x.get("@type")):
                for k in VIDEO_KEYS:
                    if isinstance(x.get(k), str) and x[k].endswith(".mp4"):
                        return x[k]
    for pattern, group in ((SHOP_MP4, 1), (ANY_MP4, 0), (ANY_M3U8, 0)):
        if m := pattern.search(html):
            return m.group(group)
    return None


def patent_images(html: str | None) -> list[str]:
    """The image links of a patent page, in the markup and in JSON-LD, each once."""
    if not html:
        return []
    found = PATENT_PNG.findall(html)
    for value in linked_data(html):
        found += [x for x in _inside(value) if isinstance(x, str) and x.startswith(IMAGE_HOST) and x.endswith(".png")]
    return list(dict.fromkeys(found))


@F.pandas_udf(T.StringType())
def find_video(html: pd.Series) -> pd.Series:
    return html.map(video_url)


@F.pandas_udf(T.ArrayType(T.StringType()))
def find_patent_images(html: pd.Series) -> pd.Series:
    return html.map(patent_images)


def file_name(url: Column) -> Column:
    return F.element_at(F.split(F.substring_index(url, "?", 1), "/"), -1)


def match_by_name(found: Column, thumbnails: Column) -> Column:
    """struct(matched, additional): ``found`` links with the file name of a thumbnail but another URL, and those with no such name."""
    names = F.transform(thumbnails, file_name)
    same = lambda u: F.array_contains(names, file_name(u))
    matched = F.filter(found, lambda u: same(u) & ~F.array_contains(thumbnails, u))
    return F.struct(matched.alias("matched"), F.filter(found, lambda u: ~same(u)).alias("additional"))


def page_title(html: Column) -> Column:
    return ws_normalize(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def kind_of_title(title: Column) -> Column:
    """The kind code of a title that starts with a publication number; empty if there is none."""
    return F.regexp_extract(F.upper(F.replace(title, F.lit(" "), F.lit(""))), r"\b([A-Z]{1,3})(\d{4,})([A-Z]\d{0,2})\b", 3)
