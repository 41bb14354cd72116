"""Main text of web pages, with site template removal.

Each page is read once to its block elements. Every block element gets a hash of its subtree and two
places: the names (tag and class) of the elements around it, its own name, and its number among the
siblings of that name, counted from the front and from the back. Spark counts, per host, on how many
pages of different text a subtree stands in a place, and how many pages have that place at all. A
subtree that fills a place on most of the pages having it is template and goes, however few of a large
host's pages those are; a passage that many articles repeat stands where others have other text, and
stays. What markup names as boilerplate goes too (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) and what is hidden from readers; inside an article only tags,
roles and unmistakable class names count as such. Where a page has an article or main element, only
that is read.

Pages of a host with many rows are spread over all tasks of the join with the host's templates. An
element keeps one pointer to its parent, so memory grows with the page and not with its depth.

Defined results: null or empty html gives an empty text; unclosed and cut-off tags end with the page;
a null url is a host of its own; copies of a page count once towards templates; an empty table gives
no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import shuffle_partitions, staged, table
from srcgraph.session import lookup_join

#: A subtree is template on this many pages of different text at least, and this share of those with its place.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: The same inside an article: repeated passages are content unless nearly every page has them in that place.
ARTICLE_PAGES, ARTICLE_SHARE = 10, 0.9

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_GONE = frozenset(
    "head nav footer aside form menu dialog button select option input label fieldset svg canvas object audio video map "
    "template noscript iframe script style textarea title".split()
)
_MAIN = frozenset(("article", "main"))
#: A start tag of the left kind ends an open element of the right kinds.
_ENDS = {t: frozenset(("p",)) for t in _BLOCK - {"html", "body"}} | {
    "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")),
    "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")),
}
_SCOPES = frozenset(("article", "main", "section", "div", "table", "ul", "ol", "dl", "body", "html", "blockquote", "nav", "aside", "footer", "header", "form"))
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menus?|sidebars?|side|footer|header|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|banners?|"
    r"alerts?|popups?|modals?|overlay|newsletters?|subscribe|signup|login|ads?|adverts?|advertisements?|advertising|sponsor\w*|promos?|"
    r"promotions?|social|shar(?:e|ing)|comments?|commentlist|disqus|replies|reply|respond|related|recommended|widgets?|"
    r"toolbar|pagination|pager|skip|copyright|disclaimer|search)(?=$|[\s_-])",
    re.IGNORECASE,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.DOTALL
)
#: Inside an article a name counts where it begins a class or an id; names that articles use for their own parts do not.
_MISPLACED = re.compile(
    r"(?:^|\s)(?:nav|navigation|menus?|sidebars?|breadcrumbs?|cookies?|consent|gdpr|notices?|banners?|popups?|modals?|newsletters?|"
    r"subscribe|signup|ads?|adverts?|advertisements?|advertising|sponsor\w*|promos?|promotions?|social|shar(?:e|ing)|comments?|"
    r"commentlist|disqus|replies|respond|related|recommended|pagination|pager)(?=$|[\s_-])",
    re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _attributes(source: str) -> dict[str, str]:
    """Attribute values by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _drops(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in _GONE or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("role", "").lower() in _ROLES:
        return True
    named = _MISPLACED if in_main else _BOILERPLATE
    return any(named.search(attributes.get(name, "")) for name in ("class", "id"))


def _hash(*parts: int | bytes) -> int:
    """Signed 64-bit hash of numbers and names."""
    data = b"\0".join(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True) for p in parts)
    return xxhash.xxh64_intdigest(data) - 2**63


class _Page:
    """Blocks of one page, each with the block element it stands in, and the block elements.

    Lists by number of the element, parents first: hash of the subtree, parent (-1: none), whether it
    stands in an article, name under its parent, and number among the siblings of that name.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, bool]] = []
        self.hashes: list[int] = []
        self.parents: list[int] = []
        self.inside: list[bool] = []
        self.paths: list[int] = []
        self.numbers: list[int] = []
        self.siblings: Counter[tuple[int, int]] = Counter()
        self.main = False
        # An open element: tag, dropped, in main, number of the innermost block element, hash so far, own number or -1.
        self.open: list[list] = [["", False, False, -1, xxhash.xxh64(), -1]]
        self.opened: Counter[str] = Counter()
        self.text: list[str] = []
        end = 0
        while (m := _TOKEN.search(source, end)) is not None:
            self._text(source[end : m.start()])
            end = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
                continue
            self._start(tag, m[3])
            if tag in _RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, end)
                end = stop.start() if stop else len(source)
            elif m[3].endswith("/") and tag not in _BLOCK:
                self._close(tag)
        self._text(source[end:])
        while len(self.open) > 1:
            self._pop()
        self._flush()

    def _text(self, text: str) -> None:
        if text and not self.open[-1][1]:
            text = entities.unescape(text)
            self.text.append(text)
            self.open[-1][4].update(" ".join(text.split()).encode("utf-8", "replace"))

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.blocks.append((text, self.open[-1][3], self.open[-1][2]))

    def _start(self, tag: str, source: str) -> None:
        if tag == "br" or tag == "hr":
            self.text.append(" ")
        if tag in _VOID:
            return
        ends = _ENDS.get(tag)
        if ends:
            self._flush()
            # Only where one of them is open: a long run of other open elements is not searched for nothing.
            k = len(self.open) - 1
            while k > 0 and any(self.opened[t] for t in ends):
                if self.open[k][0] in ends:
                    while len(self.open) > k:
                        self._pop()
                elif self.open[k][0] in _SCOPES:
                    break
                k -= 1
        above = self.open[-1]
        attributes = _attributes(source) if source.strip() else {}
        dropped = above[1] or _drops(tag, attributes, above[2])
        main = above[2] or (tag in _MAIN and not dropped)
        self.main |= main
        inner, own = above[3], -1
        if tag in _BLOCK:
            self._flush()
            if not dropped:
                own = self._element(tag, attributes.get("class", ""), above[3], above[2])
                inner = own
        state = xxhash.xxh64()
        state.update(b"<" + tag.encode("utf-8", "replace"))
        self.open.append([tag, dropped, main, inner, state, own])
        self.opened[tag] += 1

    def _element(self, tag: str, classes: str, parent: int, inside: bool) -> int:
        name = f"{tag}.{' '.join(sorted(set(classes.lower().split())))}".encode("utf-8", "replace")
        path = _hash(self.paths[parent] if parent >= 0 else 0, name)
        self.hashes.append(0)
        self.parents.append(parent)
        self.inside.append(inside)
        self.paths.append(path)
        self.numbers.append(self.siblings[parent, path])
        self.siblings[parent, path] += 1
        return len(self.hashes) - 1

    def _pop(self) -> None:
        top = self.open[-1]
        if top[0] in _BLOCK:
            self._flush()
        self.open.pop()
        self.opened[top[0]] -= 1
        if not top[1]:
            digest = top[4].digest()
            self.open[-1][4].update(digest)
            if top[5] >= 0:
                self.hashes[top[5]] = int.from_bytes(digest, "little", signed=True)

    def _close(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in _SCOPES and tag not in _BLOCK:
                return

    def content(self) -> list[tuple[str, int]]:
        return [(text, element) for text, element, inside in self.blocks if inside or not self.main]

    def places(self, element: int) -> tuple[int, int]:
        """The element's place counted from the front and from the back."""
        path, number = self.paths[element], self.numbers[element]
        last = self.siblings[self.parents[element], path]
        return _hash(path, number), _hash(path, number - last)

    def around(self, content: list[tuple[str, int]]) -> set[int]:
        """The elements that hold some of the content."""
        found: set[int] = set()
        for _, element in content:
            while element >= 0 and element not in found:
                found.add(element)
                element = self.parents[element]
        return found

    def kept(self, template: set[int]) -> list[str]:
        """The texts of the content outside of template elements."""
        content = self.content()
        if template:
            gone = [False] * len(self.hashes)
            for i in range(len(gone)):
                above = self.parents[i] >= 0 and gone[self.parents[i]]
                gone[i] = above or any(_hash(p, self.hashes[i]) in template for p in self.places(i))
            content = [(text, i) for text, i in content if i < 0 or not gone[i]]
        return [text for text, _ in content]


def _host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page_text, place, subtree, inside): the subtrees with content of each page, in both their places.

    ``subtree`` is a hash of the subtree and its place.
    """
    schema = "host string, page_text long, place long, subtree long, inside boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = _Page(source or "")
                content = page.content()
                key = xxhash.xxh64_intdigest("\n".join(t for t, _ in content).encode("utf-8", "replace")) - 2**63
                found = {(p, _hash(p, page.hashes[i]), page.inside[i]) for i in page.around(content) for p in page.places(i)}
                rows += [(host, key, *each) for each in found]
            columns = zip(*rows) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "page_text", "place", "subtree", "inside"]
            )

    return pages.select(_host().alias("host"), "html").mapInArrow(run, schema)


def templates(pages: DataFrame) -> DataFrame:
    """(host, place, subtree, n, pages): what fills a place on most of the pages of the host that have it."""
    seen = staged(subtrees(pages).groupBy("host", "place", "subtree", "page_text").agg(F.bool_or("inside").alias("inside")))
    counts = seen.groupBy("host", "place", "subtree").agg(F.count("*").alias("n"), F.bool_or("inside").alias("inside"))
    placed = seen.groupBy("host", "place", "page_text").agg(F.lit(1).alias("one"))
    sizes = placed.groupBy("host", "place").agg(F.count("*").alias("pages"))
    enough = F.when(
        F.col("inside"), (F.col("n") >= ARTICLE_PAGES) & (F.col("n") >= F.col("pages") * ARTICLE_SHARE)
    ).otherwise((F.col("n") >= MIN_PAGES) & (F.col("n") >= F.col("pages") * MIN_SHARE))
    recurring = counts.filter(F.col("n") >= MIN_PAGES)
    return recurring.join(sizes, ["host", "place"]).filter(enough).select("host", "place", "subtree", "n", "pages")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    # Written first, so that Spark knows its size: a small list travels to the pages, a large one is
    # joined by host, the most frequent hosts over all tasks.
    found = staged(templates(pages).groupBy("host").agg(F.collect_set("subtree").alias("subtrees")))
    keyed = pages.select("page_id", "url", "html", _host().alias("host"))
    met = lookup_join(keyed, found, ["host"], ["page_id", "url"], how="left", salts=shuffle_partitions(pages.sparkSession))
    schema = "page_id long, url string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                "\n\n".join(_Page(source or "").kept(set(gone or ())))
                for source, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    return met.select("page_id", "url", "html", "subtrees").mapInArrow(run, schema)


def op9(spark, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
