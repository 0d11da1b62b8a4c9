"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node is a path of element styles (tag, class, id), and holds how many
pages have it and how its content varies between them. A node's importance is the entropy of its content over the pages, as
a share of the largest possible: 0 where all pages show the same, 1 where each shows its own. Branches of low importance
that enough pages share are removed from each page, and so are those that HTML or their class names mark as menus, headers,
footers, side matter, notices, adverts, forms or reader comments. Headings and running text inside an article stay. Themes
also put such words on what holds the whole page (``no-sidebar``, ``comments-open``), so names do not drop html, body, main,
an outermost article, or a branch that holds main or the article.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import map_batches, materialise, table

#: A branch counts as shared from so many distinct pages of a host, and as unimportant up to this entropy.
SHARED_PAGES = 8
UNIMPORTANT = 0.2

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[a-zA-Z/](?:[^<>"']|"[^"]*"|'[^']*')*>|<[a-zA-Z/][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not interrupt a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike"
    " strong sub sup time tt u var wbr img".split()
)
DROPPED_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg math button select textarea title menu dialog object"
    " canvas video audio map xmp noembed noframes datalist fieldset".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices notification alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment"
    " comments commentlist replies reply respond disqus share sharing social related recommended recommendations newsletter"
    " subscribe signup login search widget widgets pagination pager toolbar copyright".split()
)
#: Dropped only outside an article, where they head the page and not the text.
DROPPED_OUTSIDE = frozenset("header masthead topbar".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption article main body html".split())
#: Their own class names drop them never; an article in another one is a comment or the like, and is dropped by them.
HOLDERS = frozenset("html body main article".split())
NAMED, MARKED = 1, 2
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " menu nav ol p pre section table ul".split()
)
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    """An open block element: its style path, whether it is dropped (``NAMED`` by class names only, or ``MARKED``), in main
    or an article, in an article that a named branch holds, in an article element, and removable by importance; whether it or
    an element around it is unimportant; and the page's text before it (pieces, hash), once it has been looked at."""

    __slots__ = ("tag", "path", "dropped", "article", "held", "nested", "branch", "low", "before")

    def __init__(self, tag: str, path: int, dropped: int, article: bool, held: bool, nested: bool, branch: bool):
        self.tag, self.path, self.dropped, self.article, self.held, self.nested, self.branch = tag, path, dropped, article, held, nested, branch
        self.low, self.before = False, None


def opened(tag: str, source: str, above: Node) -> Node:
    marks = {k.lower(): v.strip("\"'").lower() for k, v in MARKS.findall(source)} if " " in source or "\n" in source else {}
    named = f"{marks.get('class', '')} {marks.get('id', '')}"
    style = f"{tag}.{re.sub(r'[0-9]+', '', named)}" if marks else tag
    path = (above.path * 1_000_003 + zlib.crc32(style.encode())) & 0x7FFFFFFFFFFFFFFF
    names = set(re.split(r"[^a-z]+", named)) if marks else set()
    article = above.article or tag in ("article", "main")
    holder = tag in HOLDERS and not (tag == "article" and above.nested)
    dropped, held = above.dropped, above.held
    if dropped == NAMED and holder:
        if tag == "main":
            dropped = 0
        elif tag == "article" and not DROPPED_NAMES & set(named.split()):
            dropped, held = 0, True
    if tag in DROPPED_TAGS or marks.get("role") in DROPPED_ROLES or tag == "header" and not article:
        dropped = MARKED
    elif not dropped and not holder and (names & DROPPED_NAMES or not article and names & DROPPED_OUTSIDE):
        dropped = NAMED
    return Node(tag, path, dropped, article, held, above.nested or tag == "article", tag not in RUNNING)


def pieces(page: str, unimportant: frozenset[int] = frozenset(), closed: Callable[[Node], None] | None = None) -> Iterator[tuple[list[Node], str]]:
    """(open block elements, text) in page order; a text of "" marks the edge of a block. Entities are decoded.

    ``closed`` is called with each element that ends, inner ones first, also at the end of the page. One step for each token
    and element, however deep they are.
    """
    stack = [Node("", 1, 0, False, False, False, False)]
    open_tags: Counter[str] = Counter()
    at = 0

    def pop() -> Node:
        node = stack.pop()
        open_tags[node.tag] -= 1
        if closed:
            closed(node)
        return node

    while True:
        m = TOKEN.match(page, at)
        if m is None:
            while len(stack) > 1:
                pop()
            return
        at, token = m.end(), m[0]
        if token[0] != "<" or token == "<":
            yield stack, html.unescape(token) if "&" in token else token
            continue
        name = NAME.match(token)
        if name is None:
            continue
        tag = name[1].lower()
        if tag == "br":
            yield stack, " "
            continue
        if tag in INLINE:
            continue
        yield stack, ""
        if token[1] == "/":
            if open_tags[tag] > 0:
                while pop().tag != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[-1].tag == "p" or stack[-1].tag in CLOSES_SAME.get(tag, ()):
            pop()
        node = opened(tag, token, stack[-1])
        node.low = stack[-1].low or node.branch and node.path in unimportant
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif not token.endswith("/>"):
            stack.append(node)
            open_tags[tag] += 1


HASH, MASK = 1_000_003, 0x7FFFFFFFFFFFFFFF


def tree_nodes(page: str) -> dict[int, list[int]]:
    """The page's part of the style tree: for each style path a hash of its content and one of its children's styles."""
    found: dict[int, list[int]] = {}
    count, running = 0, 0  # pieces of text so far, and their hash

    def closed(node: Node) -> None:
        """The hash of what an element held follows from the hashes of the page before and after it."""
        if node.before is not None:
            n, power = count - node.before[0], pow(HASH, count - node.before[0], MASK + 1)
            if n:
                content = found[node.path]
                content[0] = (content[0] * power + running - node.before[1] * power) & MASK

    for stack, text in pieces(page, closed=closed):
        top = stack[-1]
        if len(stack) > 1 and top.before is None:
            top.before = count, running
            found.setdefault(top.path, [0, 0])
            if len(stack) > 2:
                shape = found.setdefault(stack[-2].path, [0, 0])
                shape[1] = (shape[1] * HASH + top.path) & MASK
        if text and not text.isspace():
            count, running = count + 1, (running * HASH + zlib.crc32(" ".join(text.split()).encode()) + 1) & MASK
    return found


def main_text(page: str | None, unimportant: frozenset[int] = frozenset()) -> str:
    """The running text; of articles only, where a page has any.

    Articles in a branch whose names would drop it count where they hold more text than the rest: the branch is then what
    holds the page, and else a list of comments or related pages.
    """
    inside, held, articles, outside = [], [], [], []
    for stack, text in pieces(page or "", unimportant):
        top = stack[-1]
        if text == "":
            for part in (inside, held, articles, outside):
                part.append(" ")
        elif not top.dropped and not top.low:
            if top.article:
                (held if top.held else inside).append(text)
                articles.append(text)
            else:
                outside.append(text)
    rest, kept = (" ".join("".join(part).split()) for part in (inside, held))
    rest = rest or " ".join("".join(outside).split())
    return " ".join("".join(articles).split()) if len(kept) > len(rest) else rest


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, importance) of every node of every host's merged tree.

    A node's importance is the larger of two entropies, of its content and of its children's styles. Page copies count
    once. Counts are summed by (host, path, value) before anything is grouped by path, so a host with most of the pages is
    spread out.
    """
    rows = pages.select(host(pages[url_col]).alias("host"), pages[html_col].alias("html")).where("host <> '' and html is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = {"host": [], "page": [], "path": [], "content": [], "shape": []}
            for h, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = page.as_py()
                key = zlib.crc32(page.encode())
                for path, (content, shape) in tree_nodes(page).items():
                    for k, v in zip(out, (h, key, path, content, shape), strict=True):
                        out[k].append(v)
            yield out

    seen = map_batches(rows, run, "host string, page long, path long, content long, shape long").distinct()
    values = seen.select("host", "path", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("content", "shape")])))
    counts = values.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    n, total = F.col("n").cast("double"), F.sum("n").cast("double")
    entropy = F.when(total > 1, 1 - F.sum(n * F.ln(n)) / (total * F.ln(total))).otherwise(1.0)
    by_kind = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), entropy.alias("importance"))
    return by_kind.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max("importance").alias("importance"))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shared: int = SHARED_PAGES, unimportant: float = UNIMPORTANT
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null, empty and textless pages give "". Pages without a host have no tree and lose only what is marked. Repeated rows
    each give a row. Very long and very deep pages are read whole, in time that grows with their length. Other columns are not
    read, so their names do not matter. The low branches of each host are one short row; Spark broadcasts them when their table is small and
    else joins by host, splitting a host that holds many pages.
    """
    tree = style_tree(pages, url_col, html_col)
    low = tree.where((F.col("pages") >= shared) & (F.col("importance") <= unimportant))
    low = materialise(low.groupBy("host").agg(F.collect_set("path").alias("low")), "style-trees")
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host(pages[url_col]).alias("host")
    )
    joined = rows.join(low, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = [main_text(p.as_py(), frozenset(x.as_py() or ())) for p, x in zip(b.column(2), b.column(3), strict=True)]
            yield {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(joined, run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
