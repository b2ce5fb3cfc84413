"""HTML extraction: blocks of a page, less what it shares with the pages of the nearest URLs on its host.

A page's markup is read once into blocks, in time in proportion to its length. Elements that never hold main text (scripts,
styles, navigation, headers and footers of pages, asides, forms, and elements whose class, id or role names an advert, a notice,
a menu, a sidebar or reader comments) are left out with all inside them. What is left is main text where an article
or main element holds it: two pages may carry the same article, or quote the same passage, so nothing that such an element holds
is deleted for being shared. If a page has no article or main element with text, its blocks are the template's or the text's,
which markup doesn't tell: there the page is paired with its neighbours in the order of host and path, which are the
pages of the nearest paths before and behind it, the blocks are aligned with those of either by longest common subsequence,
and shared blocks are deleted.

Character references are decoded, white space inside a block is one space, blocks are trimmed and joined by one space in
page order. Null html is the empty page, and an empty page or one of template only has an empty text. Pages with the same URL
are ordered by page_id and html; a null URL is the empty one. Columns other than page_id, url and html aren't read.

Pages are range-partitioned by host and path, so that a host with any share of all pages is divided; at the border of a
partition a page has one neighbour instead of two.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
#: Elements whose content isn't markup, and has no text of the page.
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "template", "iframe", "textarea", "select", "title")}
_OUT = frozenset({"nav", "header", "footer", "aside", "form", "head", "button", "menu"})
_MAIN = frozenset({"article", "main"})
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|newsletter|subscribe|nav|navbar|navigation|menu\w*|breadcrumbs?|"
    r"sidebar|header|masthead|footer|foot|comments?|comment-\w+|replies|reply|respond|disqus|search|login|signup|contentinfo)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: An article or main element with such a class, id or role is a reader's comment or a teaser.
_NO_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|comment-\w+|reply|replies|respond|ads?|advert\w*|sponsor\w*|teaser|related)(?:$|[\s_-])", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


def _unwanted(name: str, attributes: str, main: bool) -> bool:
    if name in _OUT:
        return not (name == "header" and main)  # an article's own header holds its heading
    if name in ("body", "html") or not attributes:
        return False
    pattern = _NO_ARTICLE if name in _MAIN else _UNWANTED
    return any(pattern.search(a or b or c or "") for a, b, c in _ATTRIBUTE.findall(attributes))


class _Tags:
    """Where the tags of a page end. An open quote that no other closes is a character like others."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def end(self, at: int) -> int:
        """Behind the tag whose name ends at at, or the page's end."""
        page, last = self.page, self.last
        while at <= last[">"]:
            found = _STOP.search(page, at)
            sign, at = found[0], found.end()
            if sign == ">":
                return at
            if at <= last[sign]:
                at = page.find(sign, at) + 1
        return len(page)


def blocks(page: str) -> tuple[list[str], list[str]]:
    """(blocks inside article or main elements, other blocks), without those of unwanted elements."""
    inside: list[str] = []
    outside: list[str] = []
    part: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # (element, unwanted, main)
    depth: dict[str, int] = {}  # how many of an element are open
    at, n, tags = 0, len(page), _Tags(page)

    def flush() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(part))).strip()
        part.clear()
        if text:
            (inside if stack and stack[-1][2] else outside).append(text)

    while at < n:
        less = page.find("<", at)
        if less < 0:
            less = n
        skip = bool(stack) and stack[-1][1]
        if less > at and not skip:
            part.append(page[at:less])
        if less == n:
            break
        after = page[less + 1 : less + 2]
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = end + 3 if end >= 0 else n
            continue
        if after in ("!", "?"):
            end = page.find(">", less)
            at = end + 1 if end >= 0 else n
            continue
        close = after == "/"
        found = _NAME.match(page, less + 1 + close)
        if not found:
            if not skip:
                part.append("<")
            at = less + 1
            continue
        name = found[0].lower()
        at = tags.end(found.end())
        attributes = page[found.end() : at].rstrip(">")
        if name not in _INLINE:
            flush()
        if close:
            if depth.get(name):
                while True:
                    gone = stack.pop()[0]
                    depth[gone] -= 1
                    if gone == name:
                        break
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            depth["p"] -= 1
        above = stack[-1] if stack else ("", False, False)
        stack.append((name, above[1] or _unwanted(name, attributes, above[2]), above[2] or name in _MAIN))
        depth[name] = depth.get(name, 0) + 1
    flush()
    return inside, outside


#: Cells of an alignment that are kept at once, in bits.
_CELLS = 1 << 28


def _rows(own: list[str], other: list[str]) -> Iterator[int]:
    """Of each line of own, a number whose bits are 0 where the longest common subsequence up to it grows by a line of other."""
    places: dict[str, int] = {}
    for j, line in enumerate(other):
        places[line] = places.get(line, 0) | 1 << j
    every = row = (1 << len(other)) - 1
    for line in own:
        met = row & places.get(line, 0)
        row = (row + met | row - met) & every
        yield row


def _lengths(own: list[str], other: list[str]) -> np.ndarray:
    """Of own with each beginning of other."""
    row = (1 << len(other)) - 1
    for row in _rows(own, other):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(other)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _shared(own: list[str], other: list[str]) -> list[int]:
    """Lines of own in a longest common subsequence."""
    if len(own) * len(other) > _CELLS and len(own) > 1:
        half = len(own) // 2
        cut = int((_lengths(own[:half], other) + _lengths(own[half:][::-1], other[::-1])[::-1]).argmax())
        return _shared(own[:half], other[:cut]) + [half + i for i in _shared(own[half:], other[cut:])]
    rows = [(1 << len(other)) - 1, *_rows(own, other)]
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    i, j, found = len(own), len(other), []
    left = length(i, j)
    while left:
        if length(i - 1, j) == left:
            i -= 1
        elif length(i, j - 1) == left:
            j -= 1
        else:
            i, j, left = i - 1, j - 1, left - 1
            found.append(i)
    return found[::-1]


def unshared(own: list[str], other: list[str]) -> list[str]:
    """own without a longest common subsequence of both. Equal ends are taken first, the rest by rows of bits."""
    a, b = 0, 0
    least = min(len(own), len(other))
    while a < least and own[a] == other[a]:
        a += 1
    while b < least - a and own[-1 - b] == other[-1 - b]:
        b += 1
    mine = own[a : len(own) - b]
    shared = set(_shared(mine, other[a : len(other) - b]))
    return [line for i, line in enumerate(mine) if i not in shared]


def _text(inside: list[str], outside: list[str], near: list[list[str]]) -> str:
    if inside:
        return " ".join(inside)
    for other in near:
        outside = unshared(outside, other)
    return " ".join(outside)


def extracted(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
        F.lower(F.regexp_extract(url, r"(?s)^(?:.*?://)?([^/?#]*)", 1)).alias("_host"),
        F.regexp_extract(url, r"(?s)^(?:.*?://)?[^/?#]*([^?#]*)", 1).alias("_path"),
    )
    order = ["_host", "_path", "page_id"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64("html"))
    schema = placed.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (host, other blocks) of the page before the one that waits
        waits = None  # (page_id, url, host, blocks inside, other blocks), until the page behind it is known

        def done(behind: tuple[str, list[str]] | None) -> tuple:
            page, url, host, inside, outside = waits
            near = [blocks_ for own, blocks_ in filter(None, (before, behind)) if own == host]
            return page, url, _text(inside, outside, near)

        for batch in batches:
            out: list[tuple] = []
            for page, url, markup, host in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "_host")), strict=True):
                inside, outside = blocks(markup)
                if waits:
                    out.append(done((host, outside)))
                    before = (waits[2], waits[4])
                waits = (page, url, host, inside, outside)
            yield _batch(out, batch.schema)
            kinds = batch.schema
        if waits:
            yield _batch([done(None)], kinds)

    return placed.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    ids, urls, texts = zip(*rows, strict=True) if rows else ((), (), ())
    arrays = [pa.array(ids, kinds.field("page_id").type), pa.array(urls, kinds.field("url").type), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])
