"""Main text of web pages: what a site repeats on its pages is removed, then what is no article.

Every element's subtree is hashed. Spark counts, per host, on how many pages a
subtree stands; one that stands on many is the site's template, not the page's
text. What structure and names give away (menus, forms, comments, ...) goes as
well, also where it differs from page to page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import row_key, saved

#: A comment, a declaration, or a tag with its attributes; an unfinished tag at the end counts as one.
_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: White space that is not a single blank already.
_SPACES = re.compile(r"[\t\n\r\f\v][ \t\n\r\f\v]*| [ \t\n\r\f\v]+")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup"
    " time tt u var wbr img br".split()
)
#: Elements that are never part of an article's text.
NO_TEXT = frozenset(
    "script style noscript template iframe object embed svg math canvas audio video map head title nav header footer aside form button input"
    " select option textarea fieldset menu dialog noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id, cut at capitals and signs, that say what an element is.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer foot"
    " sidebar sidebars aside rail widget widgets related recommended recommendations trending popular"
    " cookie cookies consent gdpr notice notices popup modal overlay paywall newsletter subscribe subscription signup login"
    " share sharing social comment comments comentarios kommentare commentaires commentlist replies reply respond disqus"
    " form search skip disclaimer copyright".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SECTIONS = frozenset("article main body html".split())
#: Start tags that end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " hr main menu nav ol p pre search section summary table ul".split()
)
#: Start tags that end an open element of one of these kinds, up to the nearest of the second.
_ENDS_OWN = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)
    digest: int = 0

    def names(self) -> set[str]:
        return {w.lower() for a in ("class", "id") for w in _WORDS.findall(self.attributes.get(a, ""))}

    def apart(self) -> bool:
        """Whether the element itself says that it is not the article's text."""
        if self.tag in NO_TEXT or self.attributes.get("role", "").lower() in ROLES or "hidden" in self.attributes:
            return True
        return self.tag not in _SECTIONS and bool(self.names() & NAMES)


def parse(source: str | None) -> Element:
    """The tree of a page as far as text needs it: a closing tag ends the nearest open element of its name,
    formatting elements (`b`, `span`) never outlive their block, and unknown ones are kept. Texts are undecoded."""
    root = Element("#page", {})
    open_, at, source = [root], 0, source or ""
    while at < len(source):
        token = _TOKEN.search(source, at)
        text = source[at : token.start()] if token else source[at:]
        if text:
            open_[-1].children.append(text)
        if not token:
            break
        at = token.end()
        closing, name = token.group(1), (token.group(2) or "").lower()
        if not name or (not token.group().endswith(">") and at == len(source)):
            continue
        if closing:
            _close(open_, name)
            continue
        _make_room(open_, name)
        raw = token.group(3)
        found = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}
        element = Element(name, found)
        open_[-1].children.append(element)
        if name in VOID or raw.endswith("/") and name not in INLINE and name not in _ENDS_P:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            element.children.append(source[at : end.start()] if end else source[at:])
            at = end.end() if end else len(source)
            continue
        open_.append(element)
    return root


def _close(open_: list[Element], name: str) -> None:
    for n in range(len(open_) - 1, 0, -1):
        if open_[n].tag == name:
            del open_[n:]
            return
        if name in INLINE and open_[n].tag not in INLINE:
            return


def _make_room(open_: list[Element], name: str) -> None:
    """Ends what a start tag ends: open paragraphs, items of the same list, and formatting inside them."""
    if name in _ENDS_P:
        for n in range(len(open_) - 1, 0, -1):
            if open_[n].tag == "p":
                del open_[n:]
                break
            if open_[n].tag not in INLINE:
                break
    if name in _ENDS_OWN:
        own, within = _ENDS_OWN[name]
        for n in range(len(open_) - 1, 0, -1):
            if open_[n].tag in own:
                del open_[n:]
                if name != "tr":
                    break
                return _make_room(open_, name)
            if open_[n].tag in within:
                break
    return None


def hashed(root: Element) -> list[Element]:
    """Gives every element the hash of its subtree (names, classes, decoded text) and lists them, innermost first."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack.extend(c for c in element.children if isinstance(c, Element))
    order.reverse()
    for element in order:
        parts = [element.tag, element.attributes.get("class", ""), element.attributes.get("id", "")]
        for child in element.children:
            parts.append(str(child.digest) if isinstance(child, Element) else _SPACES.sub(" ", child).strip())
        element.digest = xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)
    return order


def _main(root: Element) -> list[Element]:
    """The articles of a page that are not inside another or inside something set apart, else its main part, else all."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            element = stack.pop()
            if element.tag == wanted or (wanted == "main" and element.attributes.get("role", "").lower() == "main"):
                if not element.names() & NAMES:
                    found.append(element)
                continue
            if not element.apart():
                stack.extend(c for c in reversed(element.children) if isinstance(c, Element))
        if found:
            return found
    return [root]


def blocks(root: Element, template: frozenset[int]) -> list[str]:
    """The text blocks of the article, without what is set apart and without the subtrees of ``template``.

    An article's running text stays although the same subtree is template elsewhere on the host.
    """
    safe = _safe(root) if template else set()
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACES.sub(" ", entities.unescape("".join(run))).strip(" ")
        run.clear()
        if text:
            out.append(text)

    for part in _main(root):
        stack: list = [part]
        while stack:
            node = stack.pop()
            if node is None:
                end()
            elif isinstance(node, str):
                run.append(node)
            elif node.tag == "br":
                run.append(" ")
            elif node is part or not (node.apart() or (node.digest in template and id(node) not in safe)):
                inline = node.tag in INLINE
                if not inline:
                    end()
                    stack.append(None)
                stack.extend(reversed(node.children))
        end()
    return out


def host(url: Column) -> Column:
    """The host of an address in small letters, without port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: A subtree is template if it stands on at least so many pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 8, 0.02


def template_subtrees(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``_k_id, _k_null, _k_text, template`` for the pages (``page_id, url, html``) that hold template subtrees.

    A page names each of its subtrees once; only the counts per host and
    subtree decide, so a host of any size is counted by many tasks.
    """

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, hosts, found = [], [], []
            for key, where, page in zip(frame["key"], frame["host"], frame["html"], strict=True):
                digests = _candidates(parse(page))
                keys += [key] * len(digests)
                hosts += [where] * len(digests)
                found += digests
            if found:  # columns without values have no type that Arrow could convert
                yield pd.DataFrame({"key": keys, "host": hosts, "subtree": found})

    key = F.xxhash64(*row_key("page_id", "html"), "url")
    source = pages.select(key.alias("key"), host(F.col("url")).alias("host"), "html")
    named = saved(source.mapInPandas(name, "key long, host string, subtree long"), "subtrees")
    counts = named.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    on_host = source.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    many = counts.where(F.col("n") >= min_pages).join(on_host, "host").where(F.col("n") >= F.col("pages") * min_share)
    return named.join(many.select("host", "subtree"), ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("template"))


def _safe(root: Element) -> set[int]:
    """The elements (by ``id``) of an article's running text, which stands even if it recurs."""
    safe: set[int] = set()
    for part in _main(root):
        if part.tag == "#page":
            continue
        stack = [part]
        while stack:
            element = stack.pop()
            safe.add(id(element))
            stack.extend(c for c in element.children if isinstance(c, Element) and c.tag in _RUNNING and not c.apart())
    return safe


def _candidates(root: Element) -> list[int]:
    """The hashes of a page's subtrees that counting may remove."""
    order, safe = hashed(root), _safe(root)
    return list({e.digest for e in order if e is not root and e.tag not in _SECTIONS and e.tag not in VOID and id(e) not in safe})


_RUNNING = INLINE | frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption div section article".split()
)


def page_texts(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    ``text`` holds the blocks of the page's article in order, joined by one line
    feed; empty for null, empty and textless pages. Pages without a usable
    address share the empty host. Rows with equal ids, addresses and html give
    equal texts; an empty table gives no rows; other columns are not read.
    """

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for page, template in zip(frame["html"], frame["template"], strict=True):
                root, known = parse(page), frozenset() if template is None else frozenset(int(x) for x in template)
                if known:
                    hashed(root)
                texts.append("\n".join(blocks(root, known)))
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts})

    key = F.xxhash64(*row_key("page_id", "html"), "url")
    found = template_subtrees(pages, min_pages=min_pages, min_share=min_share)
    whole = pages.select("page_id", "url", "html", key.alias("key")).join(found, "key", "left")
    schema = pages.select("page_id", "url").schema.add("text", "string")
    out = whole.select("page_id", "url", "html", "template").mapInPandas(extract, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
