"""Main text of web pages by wrapper induction.

Pages of a host share a template. The distinct block trees of a host are aligned by simple tree matching
and grown into one wrapper tree. Every page of the host is then aligned to it, and Spark counts over the
distinct page contents of the host how often a text stands in a wrapper node: a text found there in two
contents at least, and in at least ``CONSTANT_SHARE`` of those that have the node, is template if the
pages that have it vary elsewhere; what varies is content.

Elements that hold menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
reader comments are left out beforehand: by tag or role anywhere, by a whole class in a main or article
element and for headings, paragraphs and the like, elsewhere by the last word of a class or id. If a page
marks its main or article element, only the blocks inside those with the most text count. Elsewhere,
blocks mostly made of links are menus.

A block is the text between two borders of block elements. Siblings of one kind that follow each
other fold into one tree node, so trees stay small however long a page is; nodes deeper than
``MAX_DEPTH`` count as their ancestor there.

Nulls and ties: a null html is an empty page with an empty text; a null or odd url belongs to the
nameless host; repeated pages are separate rows, counted as one page; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_refs
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import small_batches
from sievecrest.session import cut_lineage

GROUPS = 64
CONSTANT_SHARE = 0.9
MAX_DEPTH = 200

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
_DROP_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select option textarea iframe object embed svg math "
    "canvas audio video dialog menu".split()
)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adbox adslot sponsor sponsored sponsors promo promotion banner menu "
    "nav navbar navigation topnav breadcrumb breadcrumbs sidebar sidebars aside footer comment comments commentlist reply "
    "replies disqus cookie cookies consent gdpr notice notices newsletter subscribe subscription signup share sharing social "
    "related recommended recommendations popup modal overlay widget widgets toolbar pagination pager masthead skip login".split()
)
_KEEP_NAMES = frozenset("content article main post entry story body".split())
_COMMENT_NAMES = frozenset("comment comments commentlist reply replies disqus".split())
_LAYOUT = frozenset(
    "area articles bar block bottom box buttons col column container content entries form icons inner item items left link links "
    "list outer panel posts right row section stories top wrap wrapper".split()
)
_TEXT_TAGS = frozenset("a b blockquote caption code dd dt em figcaption h1 h2 h3 h4 h5 h6 i li p pre strong td th".split())
_CLOSES = {
    "li": ("li", frozenset(("ul", "ol", "menu"))),
    "dt": ("dt dd", frozenset(("dl",))),
    "dd": ("dt dd", frozenset(("dl",))),
    "tr": ("tr td th", frozenset(("table",))),
    "td": ("td th", frozenset(("tr", "table"))),
    "th": ("td th", frozenset(("tr", "table"))),
    "option": ("option", frozenset(("select",))),
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>?|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")


class Node:
    """A block element, or a run of equal sibling ones."""

    __slots__ = ("label", "kids", "id")

    def __init__(self, label: str):
        self.label, self.kids, self.id = label, [], -1

    def child(self, label: str) -> Node:
        if not self.kids or self.kids[-1].label != label:
            self.kids.append(Node(label))
        return self.kids[-1]


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html_refs.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)}


def _says(attributes: dict[str, str], names: frozenset[str]) -> bool:
    """Whether the last word of a class or id is one of the names, but for words of layout behind it."""
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        runs = re.findall(r"[a-z]+", token)
        while len(runs) > 1 and runs[-1] in _LAYOUT:
            runs.pop()
        if runs and runs[-1] in names:
            return True
    return False


def _dropped(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is left out with all it holds. ``inside``: in a main or article element."""
    if tag in ("html", "body", "main"):
        return False
    if tag in _DROP_TAGS or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
        return True
    if attributes.get("role", "").lower() in _DROP_ROLES:
        return True
    if inside or tag in _TEXT_TAGS:
        names = set(attributes.get("class", "").lower().split())
        return bool(names & _COMMENT_NAMES or (names & _DROP_NAMES and not names & _KEEP_NAMES))
    if _says(attributes, _COMMENT_NAMES):
        return True
    return _says(attributes, _DROP_NAMES | {"header"}) and not _says(attributes, _KEEP_NAMES)


def parse_page(page: str) -> tuple[Node, list[tuple[Node, str, int, int]]]:
    """The folded block tree and its blocks: (node, text, characters inside links, region).

    A region is an outermost main or article element: 0 for none, else numbered from 1, articles negative.
    """
    root = Node("")
    # Open elements: tag, node, left out, region, link, depth of nodes.
    stack: list[tuple[str, Node, bool, int, bool, int]] = [("", root, False, 0, False, 0)]
    blocks: list[tuple[Node, str, int, int]] = []
    words: list[str] = []
    linked = regions = 0

    def border() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            _, node, _, region, _, _ = stack[-1]
            blocks.append((node, text, min(linked, len(text)), region))
        words.clear()
        linked = 0

    def close(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                if any(s[0] in _BLOCK for s in stack[i:]):
                    border()
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at = 0
    while at < len(page):
        found = _TOKEN.match(page, at)
        at = found.end()
        piece, tag = found.group(), (found.group(2) or "").lower()
        if not tag:
            if piece[:2] in ("<!", "<?"):
                continue
            if not stack[-1][2]:
                text = html_refs.unescape(piece)
                words.append(text)
                if stack[-1][4]:
                    linked += len(" ".join(text.split()))
            continue
        if found.group(1):
            close((tag,), frozenset(("table",)) if tag in ("p", "li", "b", "i", "a", "span") else frozenset())
            continue
        if tag in _VOID:
            if tag == "hr":
                border()
            elif tag == "br":
                words.append(" ")
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        attributes = _attributes(found.group(3)) if "=" in found.group(3) or found.group(3).strip(" /") else {}
        if tag in _BLOCK:
            if tag not in ("html", "head"):
                close(("p",), frozenset(("table", "td", "th", "li", "div", "section", "article", "main", "blockquote", "body")))
            if tag in _CLOSES:
                tags, stop = _CLOSES[tag]
                close(tuple(tags.split()), stop)
            if tag == "body":
                close(("head",), frozenset())
            border()
        _, node, left_out, region, link, depth = stack[-1]
        left_out = left_out or _dropped(tag, attributes, bool(region))
        if not region and not left_out:
            main = tag == "main" or attributes.get("role", "").lower() == "main"
            if main or tag == "article" or "articleBody" in attributes.get("itemprop", ""):
                regions += 1
                region = regions if main else -regions
        if tag in _BLOCK and not left_out and depth < MAX_DEPTH:
            node, depth = node.child(".".join([tag, *sorted(set(attributes.get("class", "").split()))])), depth + 1
        stack.append((tag, node, left_out, region, link or tag == "a", depth))
    border()
    return root, blocks


def match_trees(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the largest order-preserving match of two trees, and its pairs."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.kids), len(b.kids)
    if not m or not n:
        return 1, [(a, b)]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, m + 1):
        above, row = best[i - 1], best[i]
        for j in range(1, n + 1):
            most = max(above[j], row[j - 1])
            if a.kids[i - 1].label == b.kids[j - 1].label:
                pairs[i, j] = match_trees(a.kids[i - 1], b.kids[j - 1])
                most = max(most, above[j - 1] + pairs[i, j][0])
            row[j] = most
    i, j, out = m, n, [(a, b)]
    while i and j:
        if (i, j) in pairs and best[i][j] == best[i - 1][j - 1] + pairs[i, j][0]:
            out += pairs[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, out


def grow_wrapper(wrapper: Node, page: Node) -> None:
    """Align a page and put what the wrapper lacks after its last aligned left neighbour."""
    to_wrapper = {id(p): w for w, p in match_trees(wrapper, page)[1]}
    todo = [page]
    while todo:
        node = todo.pop()
        mine = to_wrapper[id(node)]
        place = 0
        for kid in node.kids:
            if id(kid) in to_wrapper:
                place = next(i for i, k in enumerate(mine.kids) if k is to_wrapper[id(kid)]) + 1
                todo.append(kid)
            else:
                mine.kids.insert(place, kid)
                place += 1


def dump_tree(node: Node) -> str:
    def plain(n: Node):
        return [n.label, [plain(k) for k in n.kids]]

    return json.dumps(plain(node))


def load_tree(text: str) -> Node:
    """The tree with its nodes numbered from 0 in page order."""
    count = 0

    def build(raw) -> Node:
        nonlocal count
        node = Node(raw[0])
        node.id, count = count, count + 1
        node.kids = [build(k) for k in raw[1]]
        return node

    return build(json.loads(text))


def _preorder(tree: Node) -> Iterator[Node]:
    todo = [tree]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.kids)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def induce_wrappers(contents: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(host, wrapper) from all distinct block trees of each host.

    The trees of a host are dealt to ``groups`` by their hash, each group grows a wrapper in the order of
    the trees, and these are grown into one.
    """
    shapes = contents.select("host", F.explode("shapes").alias("tree")).distinct()
    dealt = shapes.withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int"))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(rows["tree"])
        wrapper = load_tree(texts[0])
        for text in texts[1:]:
            grow_wrapper(wrapper, load_tree(text))
        return rows.iloc[:1].assign(tree=dump_tree(wrapper))

    parts = dealt.groupBy("host", "part").applyInPandas(grow, "host string, tree string, part int")
    whole = parts.groupBy("host").applyInPandas(grow, "host string, tree string, part int")
    return whole.select("host", F.col("tree").alias("wrapper"))


def _content_blocks(page: str | None) -> tuple[Node, list[tuple[Node, int, str]]]:
    """The block tree of a page and the (node, hash, text) of its blocks that may be content.

    If a page has text in main or article elements, these are all blocks of its mains, or those of its
    articles beside them, whichever has the element with the most text outside links; else all blocks but
    those mostly made of links.
    """
    tree, blocks = parse_page(page or "")
    size: Counter[int] = Counter()
    for _, text, links, region in blocks:
        if region:
            size[region] += len(text) - links
    best = max(size, key=lambda r: (size[r], r), default=0)
    return tree, [
        (node, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - 2**63, text)
        for node, text, links, region in blocks
        if (region * best > 0 if best else 2 * links <= len(text))
    ]


def _places(wrapper: Node, tree: Node) -> dict[int, int]:
    """Wrapper node of every aligned node of a tree, by its identity."""
    return {id(p): w.id for w, p in match_trees(wrapper, tree)[1]}


class _Trees:
    """Wrapper trees by their text, a bounded number at a time."""

    def __init__(self, limit: int = 256):
        self.limit, self.held = limit, {}

    def get(self, text: str | None) -> Node:
        if text not in self.held:
            if len(self.held) >= self.limit:
                self.held.clear()
            self.held[text] = load_tree(text) if text else Node("")
        return self.held[text]


def page_contents(pages: DataFrame) -> DataFrame:
    """(host, page, first, shapes): every distinct content of a host once, however many rows have it.

    ``page`` is the hash of the texts of the content blocks; ``first`` has the least block tree with this
    content and node number, hash and characters of each block; ``shapes`` are all its block trees.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(*(c.to_pylist() for c in batch.columns)):
                tree, blocks = _content_blocks(page)
                number = {id(n): i for i, n in enumerate(_preorder(tree))}
                hashes = [digest for _, digest, _ in blocks]
                content = xxhash.xxh64_intdigest(np.array(hashes, np.int64).tobytes()) - 2**63
                rows.append((host, content, dump_tree(tree), [number[id(n)] for n, _, _ in blocks], hashes, [len(t) for _, _, t in blocks]))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["host", "page", "shape", "nodes", "hashes", "chars"])

    schema = "host string, page long, shape string, nodes array<int>, hashes array<long>, chars array<int>"
    found = small_batches(pages).select("host", "html").mapInArrow(read, schema)
    first = F.min(F.struct("shape", "nodes", "hashes", "chars")).alias("first")
    return found.groupBy("host", "page").agg(first, F.collect_set("shape").alias("shapes"))


def _aligned(contents: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, nodes, hashes, chars) of every content: its distinct texts in wrapper nodes."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for batch in batches:
            placed: dict[tuple[str, str], list[int]] = {}
            out: list[list] = []
            for _, wrapper, shape, nodes, hashes, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if (wrapper, shape) not in placed:
                    tree = load_tree(shape)
                    places = _places(trees.get(wrapper), tree)
                    placed[wrapper, shape] = [places.get(id(n), -1) for n in _preorder(tree)]
                place = placed[wrapper, shape]
                size: Counter[tuple[int, int]] = Counter()
                for node, digest, n in zip(nodes, hashes, chars):
                    size[place[node], digest] += n
                out.append([[k[0] for k in size], [k[1] for k in size], list(size.values())])
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = [pa.array([row[i] for row in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["host", "nodes", "hashes", "chars"])

    joined = contents.join(wrappers, "host").select("host", "wrapper", "first.*")
    return joined.mapInArrow(align, "host string, nodes array<int>, hashes array<long>, chars array<int>")


def constant_texts(contents: DataFrame, wrappers: DataFrame, share: float = CONSTANT_SHARE) -> DataFrame:
    """(host, nodes, hashes): texts that nearly all distinct contents with their wrapper node have there."""
    aligned = cut_lineage(_aligned(contents, wrappers))
    slots = aligned.select("host", F.explode(F.array_distinct("nodes")).alias("nodes")).groupBy("host", "nodes").agg(F.count(F.lit(1)).alias("pages"))
    each = aligned.select("host", F.explode(F.arrays_zip("nodes", "hashes")).alias("at")).select("host", "at.nodes", "at.hashes")
    texts = each.where("nodes >= 0").groupBy("host", "nodes", "hashes").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    common = texts.join(slots, ["host", "nodes"]).where(F.col("n") >= share * F.col("pages"))
    return _by_host(_outweighed(aligned, cut_lineage(_by_host(common))))


def _by_host(texts: DataFrame) -> DataFrame:
    return texts.groupBy("host").agg(F.collect_list("nodes").alias("nodes"), F.collect_list("hashes").alias("hashes"))


def _outweighed(aligned: DataFrame, common: DataFrame) -> DataFrame:
    """(host, nodes, hashes) of the common texts beside which their pages vary.

    Copies with small edits share all but a few words, and what they share is their article. So the text
    in which the contents with a common text differ, over all of them, must be longer than what is common
    to one of them on average.
    """
    joined = aligned.join(common.withColumnsRenamed({"nodes": "in_nodes", "hashes": "in_hashes"}), "host")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int, int], list[int]] = {}
            for host, nodes, hashes, chars, in_nodes, in_hashes in zip(*(c.to_pylist() for c in batch.columns)):
                among = set(zip(in_nodes, in_hashes))
                shared = [(k, n) for *k, n in zip(nodes, hashes, chars) if tuple(k) in among]
                same = sum(n for _, n in shared)
                for (node, digest), _ in shared:
                    row = sums.setdefault((host, node, digest), [0, 0, 0])
                    row[0], row[1], row[2] = row[0] + 1, row[1] + same, row[2] + sum(chars) - same
            rows = [(*k, *v) for k, v in sums.items()]
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 4)
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["host", "nodes", "hashes", "n", "same", "varied"])

    weighed = joined.mapInArrow(weigh, "host string, nodes int, hashes long, n long, same long, varied long")
    total = weighed.groupBy("host", "nodes", "hashes").agg(*[F.sum(c).alias(c) for c in ("n", "same", "varied")])
    return total.where("varied > same / n")


def extract_main_text(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_template) of every page.

    Pages are read once to count and once to extract; what is kept in between are the block trees and
    block hashes of distinct contents, and a wrapper and its constants a host.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url")))
    contents = cut_lineage(page_contents(pages))
    wrappers = cut_lineage(induce_wrappers(contents))
    templates = cut_lineage(wrappers.join(constant_texts(contents, wrappers), "host", "left"))
    joined = small_batches(pages).join(templates, "host").select("page_id", "url", "html", "wrapper", "nodes", "hashes")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for batch in batches:
            texts, blocks, dropped = [], [], []
            for page, wrapper, nodes, hashes in zip(*(c.to_pylist() for c in batch.columns[2:])):
                constant = set(zip(nodes or (), hashes or ()))
                tree, found = _content_blocks(page)
                place = _places(trees.get(wrapper), tree) if constant else {}
                kept = [text for node, digest, text in found if (place.get(id(node), -1), digest) not in constant]
                texts.append("\n".join(kept))
                blocks.append(len(found))
                dropped.append(len(found) - len(kept))
            counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array(blocks, pa.int32()), pa.array(dropped, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), *counts], ["page_id", "url", "text", "n_chars", "n_blocks", "n_template"]
            )

    id_type = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(extract, f"page_id {id_type}, url string, text string, n_chars long, n_blocks int, n_template int")
