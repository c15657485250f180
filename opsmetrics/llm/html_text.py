"""Main text of web pages: page structure, and subtrees that a site repeats.

A page is parsed into elements, and every element's subtree is hashed, in an article element
or not. Spark counts on how many pages of a host, and of its section there, the first folder of
the path, a hash occurs; subtrees that recur across many of them are templates and dropped.
Pages of the same main text count as one. Elements that are no part of an article by their tag,
class, id or role are listed: they are hashed and counted like others, and dropped on any site.
"""

from __future__ import annotations

import re
from functools import partial
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.tables import materialize
from opsmetrics.llm.text import slices, texts_of
from opsmetrics.llm.url_rules import url_parts

# The HTML standard's void and raw-text elements, the elements an open
# paragraph ends at, and list, table and option elements that end their like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead "
    "tr ul".split())
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main body td th".split())
LIST_SCOPES = SCOPES - {"td", "th"}

# What is no part of an article.
DROPPED_TAGS = frozenset(
    "head nav header footer aside form menu button select dialog object canvas audio video "
    "search".split()) | RAW
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside "
    "comment comments commentlist respond disqus cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe signup share sharing social related recommended widget "
    "login search pagination pager".split())

DROPPED_ARTICLES = frozenset("ad ads advert comment comments sponsored promo".split())
NAMED_FREELY = frozenset("html body main h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"
    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_NAME_PART = re.compile(r"[A-Za-z]+")

MIN_PAGES = 10
FEW_PAGES = 3
MIN_SHARE = 0.5


class Element:
    __slots__ = ("tag", "children", "listed", "template")

    def __init__(self, tag: str, listed: bool = False):
        self.tag, self.children = tag, []
        self.listed, self.template = listed, False

    @property
    def dropped(self) -> bool:
        return self.listed or self.template


def _is_listed(tag: str, attributes: str) -> bool:
    if tag in DROPPED_TAGS:
        return True
    if "=" not in attributes or tag in NAMED_FREELY:
        return "hidden" in attributes.split()
    unwanted = DROPPED_ARTICLES if tag == "article" else DROPPED_NAMES
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "role" and "".join(values).strip().lower() in DROPPED_ROLES:
            return True
        if name in ("class", "id") and unwanted.intersection(
                part.lower() for part in _NAME_PART.findall(unescape("".join(values)))):
            return True
    return False


def parse(html: str) -> Element:
    """A tree of elements and texts. Unclosed elements end where the HTML standard's main
    rules or the page end them; stray end tags are ignored. ``places`` has the depths of the
    open elements of each tag, so that a step costs what it closes."""
    root = Element("#root")
    path, at, length = [root], 0, len(html)
    places: dict[str, list[int]] = {}

    def close(depth):
        for element in path[depth:]:
            places[element.tag].pop()
        del path[depth:]

    def innermost(tags):
        return max((places[tag][-1] for tag in tags if places.get(tag)), default=0)

    while at < length:
        match = _TOKEN.search(html, at)
        if match is None:
            path[-1].children.append(html[at:])
            break
        if match.start() > at:
            path[-1].children.append(html[at:match.start()])
        at = match.end()
        if match.group(2) is None:
            continue
        tag = match.group(2).lower()
        if match.group(1):
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in BLOCKS and places.get("p") and places["p"][-1] > innermost(SCOPES):
            close(places["p"][-1])
        if tag in ENDS_LIKE:
            depth = innermost(ENDS_LIKE[tag])
            if depth and depth > innermost(LIST_SCOPES):
                close(depth)
        attributes = match.group(3)
        element = Element(tag, _is_listed(tag, attributes))
        path[-1].children.append(element)
        if tag in VOID or attributes.rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = ended.end() if ended else length
            continue
        places.setdefault(tag, []).append(len(path))
        path.append(element)
    return root


def _find(element: Element, tags: tuple[str, ...], found: list[Element]) -> list[Element]:
    """Outermost elements of the tags, not inside dropped ones; no recursion, as pages may
    nest without bound."""
    waiting = [element]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str) or node.dropped:
            continue
        if node.tag in tags:
            found.append(node)
        else:
            waiting.extend(reversed(node.children))
    return found


def content(html: str) -> list[Element]:
    """The articles of a page, else its main element, else the whole page."""
    return _content(parse(html))


def _content(root: Element) -> list[Element]:
    return (_find(root, ("article",), []) or _find(root, ("main",), []) or [root])


def _events(root: Element, whole: bool = False):
    """(element, entering) and (text, True) in page order, without dropped elements unless
    ``whole``."""
    waiting = [(root, True)]
    while waiting:
        node, entering = waiting.pop()
        yield node, entering
        if isinstance(node, str) or not entering:
            continue
        waiting.append((node, False))
        waiting.extend((child, True) for child in reversed(node.children)
                       if whole or isinstance(child, str) or not child.dropped)


def _digest(parts: list[str]) -> int:
    hashed = blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(hashed.digest(), "big", signed=True)


def subtrees(root: Element):
    """(element, hash of tags and texts) of every block element with text, inner first. Listed
    elements are hashed by themselves and are no part of the elements around them."""
    open_parts: list[list[str]] = []
    for node, entering in _events(root, whole=True):
        if isinstance(node, str):
            text = " ".join(node.split())
            if text and open_parts:
                open_parts[-1].append(text)
        elif entering:
            open_parts.append([])
        else:
            parts = open_parts.pop()
            value = _digest([node.tag, *parts]) if parts else None
            if value is not None:
                if open_parts and not node.listed:
                    open_parts[-1].append(f"<{value}>")
                if node.tag in BLOCKS:
                    yield node, value


def page_hashes(html: str) -> tuple[int | None, set[int]]:
    """A hash of the page's main text (None without any), and hashes of all its subtrees."""
    root = parse(html)
    value_of = {id(element): value for element, value in subtrees(root)}
    main = [str(value_of[id(node)]) for part in _content(root)
            for node, entering in _events(part) if not entering and id(node) in value_of]
    return (_digest(main) if main else None), set(value_of.values())


def _visible(root: Element) -> str:
    """Blocks in page order without dropped elements, joined by newlines."""
    blocks, current = [], []

    def end_block():
        text = " ".join(unescape("".join(current)).split())
        current.clear()
        if text:
            blocks.append(text)

    for node, entering in _events(root):
        if isinstance(node, str):
            current.append(node)
        elif node.tag in BLOCKS:
            end_block()
        elif node.tag == "br" and entering:
            current.append(" ")
    end_block()
    return "\n".join(blocks)


def _removed(root: Element) -> tuple[int, int]:
    """Code points of the page's texts, trimmed, in listed elements and in templates; a text
    in both counts for both."""
    counts, inside = [0, 0], [0, 0]
    for node, entering in _events(root, whole=True):
        if isinstance(node, str):
            if any(inside):
                size = len(node.strip())
                for i in (0, 1):
                    if inside[i]:
                        counts[i] += size
        else:
            step = 1 if entering else -1
            inside[0] += step * node.listed
            inside[1] += step * node.template
    return counts[0], counts[1]


def article(html: str, templates: frozenset[int] | set[int] = frozenset(),
            lists: bool = True) -> tuple[str, int, int]:
    """Main text of a page, and the code points of its texts that the lists and the templates
    each remove. ``lists=False`` drops templates alone."""
    root = parse(html)
    parts = _content(root)
    if templates:
        for element, value in list(subtrees(root)):
            element.template = value in templates
    removed = _removed(root)
    if not lists:
        for node, _ in _events(root, whole=True):
            if not isinstance(node, str):
                node.listed = False
    text = "\n".join(filter(None, (_visible(part) for part in parts if not part.dropped)))
    return text, *removed


def main_text(html: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the article in page order, joined by newlines."""
    return article(html, templates)[0]


_HASHES = pa.schema([("host", pa.string()), ("site", pa.string()), ("main", pa.int64()),
                     ("hashes", pa.list_(pa.int64()))])


def _hash_pages(batches):
    for batch in slices(batches, "html"):
        found = [page_hashes(html) for html in texts_of(batch.column("html"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("site"),
             pa.array([main for main, _ in found], pa.int64()),
             pa.array([sorted(hashes) for _, hashes in found], _HASHES.types[3])],
            schema=_HASHES)


def _extract(batches):
    for batch in slices(batches, "html"):
        templates = batch.column("_templates").to_pylist()
        found = [article(html, set(t or ()))
                 for html, t in zip(texts_of(batch.column("html")), templates)]
        out = batch.select(["_row", "url"])
        out = out.append_column("text", pa.array([text for text, _, _ in found], pa.string()))
        for name, values in (("n_chars", [len(text) for text, _, _ in found]),
                             ("n_listed", [listed for _, listed, _ in found]),
                             ("n_template", [template for _, _, template in found])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        yield out


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES,
                   min_share: float = MIN_SHARE, few_pages: int = FEW_PAGES) -> DataFrame:
    """``site, hash`` of the subtrees on at least ``min_pages`` pages and ``min_share`` of
    the pages of their site; on a site of fewer pages, of those on all of them if there are
    ``few_pages``. ``pages`` has ``host, site, html``; a page counts for both. Pages of the
    same main text are one page, pages without any are none. A subtree counts once a page,
    and counts are summed in the tasks before anything moves, so a hot host is no hot key."""
    seen = (pages.mapInArrow(_hash_pages,
                             "host string, site string, main bigint, hashes array<bigint>")
            .filter("main IS NOT NULL").groupBy("host", "site", "main")
            .agg(F.min("hashes").alias("hashes")))
    numbers = materialize(
        seen.select(F.explode(F.array_distinct(F.array("host", "site"))).alias("site"), "hashes")
        .select("site", F.explode(F.concat(
            F.array(F.lit(None).cast("bigint")), "hashes")).alias("hash"))
        .groupBy("site", "hash").agg(F.count(F.lit(1)).alias("pages")))
    totals = numbers.filter("hash IS NULL").select("site", F.col("pages").alias("of"))
    return (numbers.filter(f"hash IS NOT NULL AND pages >= {int(min(min_pages, few_pages))}")
            .join(totals, "site")
            .filter((F.col("pages") >= F.least(F.lit(min_pages), "of"))
                    & (F.col("pages") >= min_share * F.col("of")))
            .select("site", "hash"))


def extract_text(pages: DataFrame, row_id: str = "page_id", min_pages: int = MIN_PAGES,
                 min_share: float = MIN_SHARE) -> DataFrame:
    """``row_id, url, text, n_chars, n_listed, n_template`` of every row of ``pages``.

    The text is that of the article elements, else of the main element, else of the page,
    without elements listed by tag, role, class or id and without the subtrees that recur
    on the host or, of URLs with a folder, on the first folder. ``n_listed`` and
    ``n_template`` are the code points of the whole page's texts in either, some in both. Character references are
    decoded, white space inside a block becomes one space, blocks are trimmed and joined
    by newlines. Null or empty HTML gives an empty text; a null URL belongs to the host
    with the empty name. Rows stay rows, also repeated ones and those with a null id. No
    rows give none. Other columns are not read. This runs jobs.

    The templates of a host or section are no more than 1 / ``min_share`` times the subtrees
    of its average page, so they go to its pages as one array.
    """
    host, path = url_parts("url")
    folder = F.regexp_extract(path, "^/([^/]+)/", 0)
    rows = (pages.select(F.col(row_id).alias("_row"), "url", "html").withColumn("host", host)
            .withColumn("site", F.concat("host", folder)))
    found = materialize(
        site_templates(rows.select("host", "site", "html"), min_pages, min_share))
    sites = rows.select("host", "site").distinct()
    of_host = sites.join(found.withColumnRenamed("site", "host"), "host").select("site", "hash")
    templates = materialize(
        of_host.union(found).groupBy("site").agg(F.collect_set("hash").alias("_templates"))
        .withColumnRenamed("site", "_site"))
    joined = (rows.join(templates, F.col("site") == F.col("_site"), "left")
              .select("_row", "url", "html", "_templates"))
    of_row = rows.schema["_row"].dataType.simpleString()
    return (joined.mapInArrow(_extract, f"_row {of_row}, url string, text string, n_chars bigint, "
                                        "n_listed bigint, n_template bigint")
            .withColumnRenamed("_row", row_id))
