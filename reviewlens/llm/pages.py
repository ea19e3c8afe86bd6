"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes: an element is named by its tag, role, class and
id (digits made alike), a node by the names on its way from the root. Over the host's different pages every
node has two entropies: of what it says (content) and of how its children look (presentation). A branch
that looks and reads alike everywhere says nothing about its page; one that differs is what the page is for.
A branch's importance is the mean of both entropies, content weighing more, times a prior of what its names
mean: nothing for menus, adverts, forms, comments and the like, and nothing beside the page's own article or main
element where it has one. Branches below ``LOW`` are left out, inside an article too: a line that all articles of
a host end with goes. Pages with the same text of their own count as one page, so copies of an article do not look
like such a line.

Two passes: the first gives each page's nodes (one row each, summed over the host before anything is
shuffled twice), the second cuts the pages with their host's unimportant nodes, numbers of 64 bits.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import saved, strings
from reviewlens.llm.urls import split_url

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>]++)*+>|[^>]*>)",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option legend".split()
)
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS_ITEMS = frozenset("ul ol dl table tbody thead tfoot select menu body article main section".split())
# Elements and names (of class, id and role) that never hold a page's own text.
NOISE_TAGS = frozenset("head script style title noscript template iframe noembed noframes svg canvas object nav footer aside form button select textarea dialog menu".split())
COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
NOISE_NAMES = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead share "
    "sharing social related recommended widget toolbar pagination pager login search contentinfo complementary dialog".split()
)
OWN = frozenset(("article", "main"))
BESIDE = frozenset("aside footer nav menu".split())  # an article in one of these is a teaser, not the page's own
LOW, CONTENT_WEIGHT, LEAST_PAGES = 0.3, 0.9, 5


class Element:
    __slots__ = ("tag", "path", "noise", "own", "chatter", "beside", "doubtful")

    def __init__(self, tag: str, names: list[str], above: Element | None):
        parts = {p.lower() for n in names for p in PARTS.findall(n)}
        label = ".".join([tag, *(re.sub(r"\d+", "0", n) for n in names)])
        self.tag = tag
        self.path = f"{above.path}>{label}" if above else label
        self.chatter = bool(parts & COMMENTS) or bool(above and above.chatter)
        self.beside = tag in BESIDE or bool(above and above.beside)
        self.own = bool(above and above.own) or (tag in OWN or "main" in names) and not self.chatter and not self.beside and not parts & NOISE_NAMES
        named = tag not in ("html", "body") and bool(parts & NOISE_NAMES)
        outer = tag == "header" and not (above and above.own)
        starts = self.own and not (above and above.own)
        # an article inside a "sidebar": a teaser, or the page itself in a layout of that name
        self.doubtful = self.own and bool(above and (above.doubtful if above.own else above.noise))
        self.noise = not starts and bool(above and above.noise) or tag in NOISE_TAGS or named or outer or self.chatter


def blocks_of(html: str) -> list[tuple[Element, str]]:
    """The text blocks of a page in order, each with the element that holds it."""
    root = Element("", [], None)
    stack, out, text = [root], [], []

    def end_block() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                holder = next((e for e in reversed(stack) if e.tag in BLOCK), stack[0])
                deepest = stack[-1]
                out.append((deepest if deepest.noise and not holder.noise else holder, " ".join(words)))
            text.clear()

    def pop_to(i: int) -> None:
        end_block()
        del stack[i:]

    at = 0
    while m := MARKUP.search(html, at):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if i and tag in BLOCK:
                pop_to(i)
            elif i and not any(e.tag in BLOCK for e in stack[i:]):
                if stack[i].noise:
                    end_block()
                del stack[i:]
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if i and not any(e.tag in OWN or e.tag in HOLDS_ITEMS for e in stack[i:]):
                pop_to(i)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES_ITSELF.get(tag, ()):
                    pop_to(i)
                    break
                if stack[i].tag in HOLDS_ITEMS:
                    break
            end_block()
        if tag in VOID:
            continue
        names = [v.strip() for g in NAMED.findall(m[3]) for v in [g[1] or g[2] or g[3]] if v.strip()]
        here = Element(tag, sorted({w for n in names for w in n.split()}), stack[-1])
        if here.noise and not stack[-1].noise:
            end_block()
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = closing.end() if closing else len(html)
            continue
        if not m[3].endswith("/>") or tag in BLOCK:
            stack.append(here)
    text.append(html[at:])
    end_block()
    return out


def claimed(html: str) -> list[tuple[Element, str]]:
    """The blocks whose prior is not nothing: those of the page's own article or main element, else all that no
    name tells to be noise. An article in a branch of such a name claims the page if it is the larger part of it."""
    blocks = [(e, t) for e, t in blocks_of(html) if not e.noise]
    own = [(e, t) for e, t in blocks if e.own and not e.doubtful]
    if own:
        return own
    inside, rest = ([b for b in blocks if b[0].own == x] for x in (True, False))
    return inside if sum(len(t) for _, t in inside) > sum(len(t) for _, t in rest) else rest


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def nodes_of(html: str) -> Iterator[tuple[int, int, int, int]]:
    """Every style node of a page that the tree judges: hash of its path, of its texts, its looks (number of
    texts), and the hash of all of the page's texts."""
    said: dict[str, list[str]] = {}
    blocks = claimed(html)
    page = hash_of("\n".join(t for _, t in blocks))
    for e, text in blocks:
        said.setdefault(e.path, []).append(text)
    for path, texts in said.items():
        yield hash_of(path), hash_of("\n".join(texts)), len(texts), page


def unimportant(pages: DataFrame) -> DataFrame:
    """host, paths: the hashes of its style nodes of low importance, from (host, html).

    Pages of equal text count as one. A node that fewer than ``LEAST_PAGES`` of them have is not judged.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (host, *node)
                for host, html in zip(batch["host"].to_pylist(), strings(batch["html"]), strict=True)
                for node in nodes_of(html)
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "path", "content", "looks", "page"])

    nodes = pages.select("host", "html").mapInArrow(run, "host string, path bigint, content bigint, looks bigint, page bigint")
    different = nodes.groupBy("host", "path", "content", "looks", "page").count()

    def entropy(of: str, name: str) -> DataFrame:
        n = F.sum("n")
        counts = different.groupBy("host", "path", of).agg(F.count("*").alias("n")).groupBy("host", "path")
        spread = F.log(n) - F.sum(F.col("n") * F.log("n")) / n
        return counts.agg(n.alias(f"{name}_pages"), F.when(n > 1, spread / F.log(n)).otherwise(1.0).alias(name))

    both = entropy("content", "says").join(entropy("looks", "shows"), ["host", "path"])
    importance = CONTENT_WEIGHT * F.col("says") + (1 - CONTENT_WEIGHT) * F.col("shows")
    low = both.filter((F.col("says_pages") >= LEAST_PAGES) & (importance < LOW))
    return low.groupBy("host").agg(F.collect_list("path").alias("paths"))


def main_text(html: str, low: list[int] | None) -> str:
    """The blocks of important branches, one a line; ``low`` has the hashes of the host's others."""
    blocks = claimed(html)
    if low:
        blocks = [(e, t) for e, t in blocks if hash_of(e.path) not in low]
    return "\n".join(t for _, t in blocks)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null html, or html without text of its own, gives an empty text. Null urls form a host of their own, the
    empty one. Repeated rows are extracted each. Broken markup is closed as browsers do in the plain cases:
    an open paragraph ends at the next block, an end tag without a start is ignored.
    """
    host, _ = split_url(F.col(url))
    few = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host.alias("host"))
    low = saved(unimportant(few), "site-style-tree")
    joined = few.join(low, "host", "left").select("page_id", "url", "html", "paths")
    kinds = dict(joined.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, p) for h, p in zip(strings(batch["html"]), batch["paths"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
