"""Main text of web pages by removal of site templates.

1. Every page is parsed into a tree of elements. Subtrees outside the article (an ``article`` or
   ``main`` element; without one, all subtrees) and the boxes, tables, figures and lists of links
   within it are hashed: tag, attributes and text, all below.
2. Spark counts, per host, in how many different surroundings (the hash of the parent subtree, or
   of the page's article for elements next to it) a subtree occurs. Copies of one page are one
   surrounding, so a page that a host serves many times is no template.
3. Boxes, tables, figures and lists that recur in at least ``LEAST_PAGES`` surroundings of a host (of
   its articles' inner ones: ``LEAST_INNER``) are deleted, however many pages the host has. Outside
   articles plain passages (paragraphs, headings, inline elements) go as well, but only if they recur
   in ``LEAST_SHARE`` of the host's different pages too: texts share words. Elements whose tag or attributes say that they are no article text (navigation, footers, adverts, forms,
   comments and so on) are deleted as well: they may be different on every page.
4. Every page meets its own deletions in one join on its hash, in compressed form. What is left of the article (or body) is cut into blocks at block elements. Character
   references are decoded, white space within a block becomes one space, empty blocks go, and
   blocks are joined by newlines in page order.

Null pages read as empty and give an empty text; pages without a host share no templates; rows
that repeat a page_id are separate pages. Unclosed, misnested and cut-off markup is read as far
as it goes. Paragraphs, headings and lists without links within an article stay however often they
recur: texts share passages, and a page may quote another one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import Steps, text_slices

LEAST_PAGES = 5
LEAST_SHARE = 0.02
LEAST_INNER = 10
_BOXES = set("center details div fieldset figure section table".split())
_LISTS = set("dir dl menu ol ul".split())

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Fixed values of the HTML standard.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp noframes iframe noembed".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav"
    " ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_PARAGRAPH = _BLOCK - set("body caption html legend option tbody td tfoot th thead tr li dd dt".split())
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

_NO_TEXT = set(
    "head script style template noscript svg math canvas object embed iframe audio video map"
    " nav footer aside form button select input textarea dialog menu search noframes title".split()
)
_SAYS_NO_TEXT = re.compile(
    r"(?:ad|ads|advert|adverts|advertisement|advertising|adsense|adslot|banner|sponsor|sponsored|promo"
    r"|promotion|sidebar|side-bar|aside|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|cookie|cookies"
    r"|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    r"|comment|comments|comment-list|disqus|reply|replies|respond|share|sharing|social|footer|site-header|masthead"
    r"|topbar|toolbar|related|recommended|widget|pagination|pager|skip-link|search)",
    re.I,
)
# Names of several words: what a block is stands at the end ("entry-comments"), and may be followed by its form
# ("comments-list"). A first word such as "no" or "has" speaks of something else's absence or presence.
_SAYS_SO_IN_WORDS = re.compile(
    r"(?!(?:no|has|with|without|is|hide|show)[-_])(?:[a-z0-9]+[-_]+)*"
    r"(?:(?:comments|replies|disqus)(?:[-_]+(?:list|section|area|thread|form|box|wrapper|container))?"
    r"|comment[-_]+(?:list|section|area|thread|form|box|wrapper|container)"
    r"|(?:share|sharing|social)[-_]+(?:buttons?|links?|bar|icons?|tools|list)"
    r"|(?:site|left|right|page|primary|secondary)[-_]+sidebar)",
    re.I,
)
# The class and id of these say nothing about their text: pages and passages are named for their looks.
_ANY_NAME = set("#root html body h1 h2 h3 h4 h5 h6 p".split())
_ROLES = set("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())


class Node:
    """An element: tag, attributes, and children that are elements or text."""

    __slots__ = ("attributes", "children", "digest", "linked", "size", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.digest = tag, attributes, [], b""
        self.size = self.linked = 0  # characters but white space: all, and within links


def parse(html: str) -> Node:
    """The tree of a page; void elements, implied and missing end tags as browsers read them."""
    root = Node("#root")
    stack, at = [root], 0

    def close(tags: set[str], within: set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                del stack[depth:]
                return
            if stack[depth].tag in within:
                return

    while True:
        found = _MARK.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text:
            stack[-1].children.append(text)
        if not found:
            return root
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        tag = name.lower()
        if found.group(1):
            if any(n.tag == tag for n in stack):
                # an end tag of an inline element does not close a block around it
                barrier = set() if tag in _BLOCK else _BLOCK
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
                    if stack[depth].tag in barrier:
                        break
            continue
        if tag in _ENDS_PARAGRAPH:
            close({"p"}, _BLOCK - {"p"})
        if tag in _ENDS:
            close(*_ENDS[tag])
        node = Node(tag, found.group(3) or "")
        stack[-1].children.append(node)
        if tag in _VOID or (found.group(3) or "").endswith("/"):
            if tag in _VOID or tag not in _BLOCK:
                continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            stop = end.start() if end else len(html)
            close_mark = html.find(">", stop) if end else -1
            at = close_mark + 1 if close_mark >= 0 else len(html)
            continue
        stack.append(node)


def _walk(node: Node) -> Iterator[tuple[Node, bool]]:
    """Elements with (True) on the way down and (False) on the way up; no recursion."""
    work = [(node, True)]
    while work:
        now, down = work.pop()
        yield now, down
        if down:
            work.append((now, False))
            work += [(c, True) for c in reversed(now.children) if isinstance(c, Node)]


def hash_subtrees(root: Node) -> None:
    for node, down in _walk(root):
        if not down:
            held = hashlib.blake2b(f"{node.tag} {' '.join(node.attributes.split())}".encode(), digest_size=8)
            for child in node.children:
                if isinstance(child, Node):
                    held.update(b"<" + child.digest)
                    node.size += child.size
                    node.linked += child.linked
                else:
                    words = child.split()
                    held.update(" ".join(words).encode())
                    node.size += sum(map(len, words))
            if node.tag == "a":
                node.linked = node.size
            node.digest = held.digest()


def is_box(node: Node, inner: bool) -> bool:
    """A subtree that is no plain passage; within an article, a list is one only if most of it is links."""
    if node.tag in _LISTS:
        return not inner or 2 * node.linked > node.size
    return node.tag in _BOXES


def says_no_text(node: Node, around_article: bool = False) -> bool:
    """Tag or attributes mark the element as something else than article text.

    Only whole class and id names count, of one word or of several. What lies around an article may have any name and role, and
    be a form."""
    if node.tag in _NO_TEXT and not (around_article and node.tag == "form"):
        return True
    if not node.attributes:
        return False
    named = not around_article and node.tag not in _ANY_NAME
    for m in _ATTRIBUTE.finditer(node.attributes):
        name = m.group(1).lower()
        value = next((g for g in m.groups()[1:] if g is not None), "")
        if named and name in ("class", "id") and any(
            _SAYS_NO_TEXT.fullmatch(part) or _SAYS_SO_IN_WORDS.fullmatch(part) for part in value.split()
        ):
            return True
        if named and name == "role" and value.strip().lower() in _ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def articles(root: Node) -> list[Node]:
    """Outermost article elements that are not marked otherwise; else main elements.

    Where marks hide all of them, names, roles and forms on the way down do not count."""
    for around, tag in ((False, "article"), (False, "main"), (True, "article"), (True, "main")):
        found, work = [], [root]
        while work:
            node = work.pop()
            if node is not root and says_no_text(node, around):
                continue
            if node.tag == tag:
                found.append(node)
            else:
                work += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return []


PLAIN, BOX, INNER = range(3)  # outside articles: passages and boxes; boxes within


def templates_of(html: str) -> tuple[bytes, list[tuple[int, int, int]]]:
    """Digest of the page's content, and (subtree, surrounding, kind) of each subtree."""
    root = parse(html)
    hash_subtrees(root)
    main = articles(root)
    tops = {id(n) for n in main}
    content = b"".join(n.digest for n in main) or root.digest
    # the root stands for the page in its host's count; equal roots are copies, so it is no template
    found = [(_number(root.digest), _number(content), PLAIN)]
    work: list = [(root, None, False)]
    while work:
        node, parent, inner = work.pop()
        top = id(node) in tops
        box = is_box(node, inner)
        counted = box if inner else not top and node.tag not in ("html", "body", "head", "#root")
        if parent is not None and counted:
            around = content if parent.tag in ("html", "body", "#root") else parent.digest
            place = _number(hashlib.blake2b(around + content, digest_size=8).digest())
            found.append((_number(node.digest), place, INNER if inner else BOX if box else PLAIN))
        work += [(c, node, inner or top) for c in node.children if isinstance(c, Node)]
    return content, list(dict.fromkeys(found))


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def main_text(html: str, templates: set[int]) -> str:
    """The text of a page without the given subtrees and without what is marked otherwise."""
    root = parse(html)
    hash_subtrees(root)
    main = articles(root)
    blocks: list[list[str]] = [[]]
    for top in main or [root]:
        work: list = [(top, True)]
        while work:
            item, down = work.pop()
            if isinstance(item, str):
                blocks[-1].append(item)
                continue
            if item.tag in ("br", "wbr"):
                blocks[-1].append(" " if item.tag == "br" else "")
                continue
            if item.tag in _BLOCK:
                blocks.append([])
            if not down:
                continue
            if item is not top and says_no_text(item):
                continue
            if item is not top and (not main or is_box(item, True)) and _number(item.digest) in templates:
                continue
            if not main and item.tag == "header":
                continue
            work.append((item, False))
            work += [(c, True) for c in reversed(item.children)]
    texts = (" ".join(unescape("".join(parts)).split()) for parts in blocks)
    return "\n".join(t for t in texts if t)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _subtrees(pages: DataFrame) -> DataFrame:
    """page key, host, subtree, surrounding, kind, content."""

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, "html"):
                keys = batch.column("key").slice(first, len(texts))
                hosts = batch.column("host").slice(first, len(texts))
                rows, trees, around, kinds, content = [], [], [], [], []
                for row, html in enumerate(texts):
                    digest, found = templates_of(html)
                    for tree, place, kind in found:
                        rows.append(row)
                        trees.append(tree)
                        around.append(place)
                        kinds.append(kind)
                        content.append(_number(digest))
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(taken),
                        hosts.take(taken),
                        pa.array(trees, pa.int64()),
                        pa.array(around, pa.int64()),
                        pa.array(kinds, pa.int32()),
                        pa.array(content, pa.int64()),
                    ],
                    names=["key", "host", "tree", "around", "kind", "content"],
                )

    return pages.select("key", "host", "html").mapInArrow(
        run, "key long, host string, tree long, around long, kind int, content long"
    )


def site_templates(found: DataFrame) -> DataFrame:
    """host, tree, n, share of the subtrees that recur across a host's different pages."""
    pages = (
        found.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    )
    # distinct first: one row for each surrounding, so a hot host is counted in many tasks
    recurring = (
        found.select("host", "tree", "around")
        .distinct()
        .groupBy("host", "tree")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= LEAST_PAGES)
    )
    share = F.col("n") / F.col("pages")
    return recurring.join(pages, "host").select("host", "tree", "n", share.alias("share"))


def _packed(pages: DataFrame) -> DataFrame:
    """page_id, url, key, and the html in compressed form."""

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for first, texts in text_slices(batch, "html"):
                part = batch.slice(first, len(texts))
                packed = pa.array([compressor.compress(t.encode()) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), part.column("key"), packed],
                    names=["page_id", "url", "key", "packed"],
                )

    fields = [pages.schema[name] for name in ("page_id", "url", "key")]
    schema = T.StructType([*fields, T.StructField("packed", T.BinaryType())])
    return pages.select("page_id", "url", "key", "html").mapInArrow(run, schema)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    steps = Steps(pages.sparkSession)
    named = pages.select(
        "page_id", "url", "html", host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("key")
    )
    with_host = named.filter(F.coalesce(F.col("host") != "", F.lit(False)) & F.col("html").isNotNull())
    found = steps.keep(_subtrees(with_host), "page_trees")
    templates = steps.keep(site_templates(found), "page_templates")
    per_page = steps.keep(
        found.select("key", "host", "tree", "kind")
        .join(templates, ["host", "tree"])
        .filter(
            F.when(F.col("kind") == PLAIN, F.col("share") >= LEAST_SHARE)
            .when(F.col("kind") == INNER, F.col("n") >= LEAST_INNER)
            .otherwise(F.lit(True))
        )
        .groupBy("key")
        .agg(F.collect_set("tree").alias("trees")),  # at most the elements of one page
        "page_deletions",
    )
    steps.drop("page_trees", "page_templates")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()

        def taken(part, out):
            return pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"),
                    part.column("url"),
                    pa.array(out, pa.string()),
                    pa.array([len(t) for t in out], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

        for batch in batches:
            first, out, held = 0, [], 0
            for packed, trees in zip(batch.column("packed"), batch.column("trees")):
                html = unpack.decompress(packed.as_py()).decode()
                out.append(main_text(html, set(trees.as_py() or ())))
                held += len(html)
                if held >= 1 << 20:
                    yield taken(batch.slice(first, len(out)), out)
                    first, out, held = first + len(out), [], 0
            if out:
                yield taken(batch.slice(first, len(out)), out)

    schema = T.StructType(
        [
            pages.schema["page_id"],
            pages.schema["url"],
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )
    # one strategy at every size: both sides are dealt by the page's hash
    return _packed(named).join(per_page.hint("merge"), "key", "left").select(
        "page_id", "url", "packed", "trees"
    ).mapInArrow(run, schema)
