"""Main text of web pages: site templates are counted per host and deleted, then the rest is cut to the article.

Every page is parsed to a tree, and each element with text gets a hash of its
tag names and text, whatever its attributes. Spark counts on how many pages of
a host each hash occurs; pages with the same text count once, so copies of an
article make no template of it. Subtrees on ``MIN_PAGES`` pages or more and on
``MIN_SHARE`` of the host's pages are its template and are deleted from all of
them. The share also bounds a host's templates to ``1 / MIN_SHARE`` times the
elements of a mean page.

Inside an article paragraphs, headings, lists and quotes are what its author
wrote, and pages may share them by quotation: there only containers (``div``,
``section`` and the like) are counted. On pages that mark no article a
template that would take more than half of the text is taken for shared
content and stays.

What differs from page to page, as an advert does, is known by its element,
role or class: ``nav``, ``aside``, ``form`` and so on, page headers and
footers, and names such as ``ad``, ``cookie`` or ``comments``.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import bounded_batches, salted_join, texts_of
from corvida.llm.urlfilter import host_of
from corvida.session import Stage

MIN_PAGES, MIN_SHARE = 5, 0.02

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that end open ones of their kind, and where the search for these stops.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = frozenset("table td th caption template object".split())
TABLES, TABLE_SCOPES = frozenset("table caption colgroup thead tbody tfoot tr td th".split()), frozenset(("table", "template"))
#: Elements deeper than this become siblings, as in browsers.
MOST_DEPTH = 512

# What is never main text.
DROPPED = frozenset("script style template noscript title iframe object svg canvas audio video xmp noembed noframes nav menu aside footer form button select textarea dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies share sharing social related recommended pagination pager".split())
#: Names of what stands over a page, but may be an article's own heading inside one.
HEADS = frozenset("header masthead banner".split())
CONTAINERS = frozenset("div section aside nav header footer form menu fieldset address details center table".split())
ROOTS = frozenset(("html", "body", "main", "article"))

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


class Page:
    """The elements of a page and its text pieces, in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#page"], [-1], [""]
        self.pieces: list[tuple[int, str]] = []  # element and text
        self.parts: list[list[int | str]] = [[]]  # of each element: its texts and children
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        open_: Counter[str] = Counter()  # elements on the stack

        def text(piece: str) -> None:
            if piece:
                self.pieces.append((stack[-1], piece))
                self.parts[stack[-1]].append(piece)

        def close(names: frozenset[str] | set[str], until: frozenset[str] | set[str], inline: bool = False) -> bool:
            for depth in range(len(stack) - 1, 0, -1) if any(open_[t] for t in names) else ():
                tag = self.tags[stack[depth]]
                if tag in names:
                    open_.subtract(self.tags[e] for e in stack[depth:])
                    del stack[depth:]
                    return True
                if tag in until or inline and tag not in INLINE:
                    break
            return False

        while at < n:
            found = _TOKEN.search(source, at)
            if not found:
                text(source[at:])
                return
            text(source[at : found.start()])
            at = found.end()
            ending, tag = found[1], (found[2] or "").lower()
            if not tag:
                continue
            if ending:
                close({tag}, (TABLE_SCOPES if tag in TABLES else SCOPES) - {tag}, tag in INLINE)
                continue
            if tag in BLOCKS:
                close({"p"}, SCOPES)
            if tag in SIBLINGS:
                for _ in SIBLINGS[tag][0]:
                    close(*SIBLINGS[tag])
            if len(stack) > MOST_DEPTH:
                open_[self.tags[stack.pop()]] -= 1
            number = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.attributes.append(found[3])
            self.parts[stack[-1]].append(number)
            self.parts.append([])
            if tag in VOID:
                # a break ends no block; it is white space within one
                self.pieces.append((number, " " if tag in ("br", "wbr") else ""))
                self.parts[number].append(" ")
            elif tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else n
            else:
                stack.append(number)
                open_[tag] += 1

    def hashes(self) -> list[int]:
        """A hash of each element's tag names and text; 0 for one without text."""
        out: list[int] = [0] * len(self.tags)
        for e in range(len(self.tags) - 1, -1, -1):  # children come after their parents
            said = []
            for part in self.parts[e]:
                if isinstance(part, int):
                    said += [f"<{out[part]}>"] if out[part] else []
                elif words := " ".join(part.split()):
                    said.append(words)
            out[e] = (xxhash.xxh64_intdigest("\0".join([self.tags[e], *said])) or 1) if said else 0
        return out

    def _inside(self, wanted: list[bool]) -> list[bool]:
        """Whether an element or one around it is wanted."""
        out = wanted[:]
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parents[e]]
        return out

    def _within(self, elements: list[int]) -> list[bool]:
        some = set(elements)
        return self._inside([e in some for e in range(len(self.tags))])

    def dropped(self) -> list[bool]:
        """Elements that are no main text by their tag, role or names."""
        article = self._inside([tag in ("article", "main") for tag in self.tags])
        out = []
        for e, tag in enumerate(self.tags):
            gone = tag in DROPPED or tag == "header" and not article[e]
            if not gone and self.attributes[e] and tag not in ("html", "body", "main"):
                for name, *values in _ATTRIBUTE.findall(self.attributes[e]):
                    value, name = "".join(values), name.lower()
                    if name in ("class", "id"):
                        words = {w.lower() for w in _NAME.findall(value)}
                        gone |= tag not in INLINE and bool(words & NAMES or not article[e] and words & HEADS)
                    elif name == "role":
                        gone |= value.strip().lower() in ROLES
                    else:
                        gone |= name == "hidden" or "display:none" in value.replace(" ", "").lower()
            out.append(gone)
        return out

    def main_text(self, templates: frozenset[int] = frozenset()) -> tuple[str, list[int], int]:
        """Main text, hashes of the subtrees that may be a template, and how many of ``templates`` were deleted."""
        hashes, dropped = self.hashes(), self.dropped()
        has_text = [False] * len(self.tags)
        for e, piece in self.pieces:
            if not piece.isspace():
                has_text[e] = True
        for e in range(len(has_text) - 1, 0, -1):
            has_text[self.parents[e]] |= has_text[e]
        roots = [e for e, tag in enumerate(self.tags) if tag == "article" and has_text[e]] or [e for e, tag in enumerate(self.tags) if tag == "main" and has_text[e]]
        gone = self._inside(dropped)
        if roots and all(gone[e] for e in roots):
            # what holds all articles is no sidebar, whatever it is called
            within = self._within(roots)
            outer = [e for e in roots if not within[self.parents[e]]]
            for e in [e for e in outer if not dropped[e]] or outer:
                while e > 0:
                    dropped[e] = False
                    e = self.parents[e]
            gone = self._inside(dropped)
        roots = [e for e in roots if not gone[e]]
        inside = self._inside([e in set(roots) for e in range(len(self.tags))] if roots else [True] * len(self.tags))
        marked = inside if roots else [False] * len(self.tags)
        may = [bool(h) and tag not in ROOTS and tag not in INLINE and e > 0 and (tag in CONTAINERS or not marked[e]) for e, (h, tag) in enumerate(zip(hashes, self.tags))]
        cut = [m and h in templates for m, h in zip(may, hashes)]
        in_template = self._inside(cut)
        kept = self._text([i and not g for i, g in zip(inside, gone)])
        shorter = self._text([i and not g and not t for i, g, t in zip(inside, gone, in_template)]) if templates else kept
        if not roots and 2 * len(shorter) < len(kept):
            shorter, cut = kept, []
        return shorter, [h for m, h in zip(may, hashes) if m], sum(cut)

    def _text(self, wanted: list[bool]) -> str:
        """Text of the wanted elements: a line for each block, white space within it made one space."""
        blocks, held, last = [], [], 0

        def empty() -> None:
            if words := " ".join("".join(held).split()):
                blocks.append(words)
            held.clear()

        block_of = [0] * len(self.tags)
        for e in range(1, len(self.tags)):
            block_of[e] = block_of[self.parents[e]] if self.tags[e] in INLINE else e
        for e, piece in self.pieces:
            if block_of[e] != last:
                empty()
                last = block_of[e]
            if wanted[e]:
                held.append(html.unescape(piece))
        empty()
        return "\n".join(blocks)


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def host_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, templates`` of ``pages(host, html)``: hashes of the subtrees that recur on many pages of the host; pages with equal main text count once."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Page(t.decode("utf-8", "replace")).main_text() for t in texts_of(batch, "html")]
            contents = pa.array([_signed(xxhash.xxh64_intdigest(text)) for text, _, _ in made], pa.int64())
            trees = pa.array([[_signed(h) for h in sorted(set(hashes))] for _, hashes, _ in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), contents, trees], names=["host", "content", "trees"])

    stage = Stage(pages.sparkSession, "templates")
    seen = stage.write(pages.where("host != ''").select("host", F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, content long, trees array<long>"))
    hosts = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    trees = seen.select("host", "content", F.explode("trees").alias("tree")).distinct().groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = trees.join(hosts, "host").where(F.col("n") >= min_share * F.col("n_pages"))
    return stage.write(often.groupBy("host").agg(F.array_sort(F.collect_list("tree")).alias("templates")))


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, url, text, n_templates`` of ``pages(page_id, url, html)``.

    ``text`` has a line for each block of the main text, in page order, with
    character references decoded and white space made one space; it is empty
    for a null or empty page and one without main text. ``n_templates`` counts
    the template subtrees deleted from the page. Articles are taken if a page
    marks any, else ``main``, else the whole page. Pages are read whole, broken
    markup as browsers read it in the cases that occur often: open paragraphs,
    list items and cells end where the next begins. Pages without a host have
    no templates. Repeated rows and ids, null ids too, each give a row; other
    columns are left.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    few = host_templates(rows, min_pages, min_share)
    joined = salted_join(rows, few, "host", "page_id").select("page_id", "url", "html", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, ...], frozenset[int]] = {}
        for batch in batches:
            texts, cuts = [], []
            for source, known in zip(texts_of(batch, "html"), batch.column(3).to_pylist()):
                key = tuple(known or ())
                if key not in sets:
                    sets.clear()
                    sets[key] = frozenset(h % (1 << 64) for h in key)
                text, _, n = Page(source.decode("utf-8", "replace")).main_text(sets[key])
                texts.append(text)
                cuts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(cuts, pa.int64())], names=["page_id", "url", "text", "n_templates"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_templates long")
