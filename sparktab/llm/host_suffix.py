"""Main text of web pages, with boilerplate found by a suffix array over each host.

A page is cut into blocks of text. Markup says of most blocks what they are: those within
an article are main text, those within menus, headers, footers, sidebars, forms, adverts,
notices, comments, scripts or styles are not. What markup leaves open (pages without an
article element) the host decides: the token streams of its pages, without their main
text, are concatenated, suffixes are sorted by their first RUN tokens, and neighbours that
agree in all of these are a substring repeated between pages. Tokens covered by substrings
of at least RUN tokens that stand on at least PAGES distinct pages are boilerplate and are
removed; the runs between them are kept.

Inside an article repeats count for nothing: hosts republish articles and quote the same
passages, and main text must come out whole.

A large host is never gathered: its pages are dealt by range, each task sorts the suffixes
of at most SHARD_TOKENS tokens at a time, and the repeated prefixes of all shards are
summed by (host, hash), with partial sums before the shuffle. Only hosts that have open
pages take part.

Defined cases: null and empty html have no text; a null or odd url has the host ''; rows
that repeat are rows of their own, but pages of a host with the same text are one page when
repeats are counted; a null page_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm import blocks, words

RUN, PAGES, SHARD_TOKENS = 8, 3, 1_000_000

# Elements by what they do to the text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "head", "menu", "button", "select", "dialog"}
MAIN = {"article": 2, "main": 1}
#: Words that mark a part outside the article, as a whole class, id or role or joined to each other and to FORMS.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "cookie", "cookies", "consent", "notice", "popup", "modal",
    "newsletter", "subscribe", "share", "social", "comment", "comments", "respond", "related", "search", "complementary",
    "contentinfo", "disclaimer",
}
FORMS = {"site", "box", "widget", "links", "buttons", "list"}
#: These marks also hold joined to PLACES (ad-slot, user-comments, related-posts), which others do not (section-header).
PLAIN = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "comment", "comments", "share", "related",
    "newsletter", "subscribe", "cookie", "cookies", "consent",
}
PLACES = {
    "user", "users", "reader", "readers", "section", "slot", "unit", "area", "container", "wrapper", "block", "bar", "post",
    "posts", "article", "articles", "stories", "thread", "form", "inline", "bottom", "top", "placeholder",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Within an article only these can be marked.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "fieldset", "figure", "details"}

_PART = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>"'<]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>|[^<]+|<""", re.S)
_TAG = re.compile(r"""</?[a-zA-Z][^\s/>"'<]*+""")
_STOP = re.compile(r"""[>"']""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
#: White space of HTML and the spaces of Unicode.
_SPACE = re.compile(r"\s+")

PARSED = "page_id long, url string, host string, n_open int, text string, texts array<string>, kinds array<int>"
KEPT, LIKELY, OPEN, OUT = 2, 1, 0, -1
MARKED = -2  # out, unless an article or main element within says otherwise


def host_of(url: str | None) -> str:
    """Lower-case host of a url, without user, port and a leading www."""
    if not url or "://" not in url:
        return ""
    host = re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].rsplit("@", 1)[-1].split(":", 1)[0].lower()
    return host[4:] if host.startswith("www.") else host


def is_mark(name: str) -> bool:
    """Whether a class, id or role marks a part outside the article: with-sidebar or related-work do not."""
    parts = set(_WORD.findall(name))
    return bool(parts & MARKS and parts <= MARKS | FORMS or parts & PLAIN and parts <= PLAIN | FORMS | PLACES)


class Markup:
    """The parts of a page, one after another, in time linear in its length however broken it is.

    A tag without an end would be looked for up to the end of the page, again for each such
    tag. Where the text after a tag's name first meets a quote or its end decides whether the
    tag ends; those places are kept when a tag did not, with all places on its way, and a
    later tag that comes to one of them is text at once. As a quote either opens or closes,
    ways that differ never meet: there are three at most.
    """

    def __init__(self, page: str):
        self.page, self.end = page, page.rfind(">") + 1
        self.stops: list[int] | None = None
        self.dead: set[int] = set()

    def at(self, at: int):
        """The part that begins here, None for a < that is known to begin no tag; its second group is None if it is no tag."""
        page = self.page
        if page[at] != "<":
            return _PART.match(page, at)
        if at >= self.end and not page.startswith("<!--", at):
            return None
        name = _TAG.match(page, at)
        if name is None:
            return _PART.match(page, at)
        if self.stops is not None and bisect_left(self.stops, name.end()) in self.dead:
            return None
        part = _PART.match(page, at)
        if part.group(2) is None:
            self._remember(name.end())
        return part

    def _remember(self, at: int) -> None:
        if self.stops is None:
            self.stops = [m.start() for m in _STOP.finditer(self.page)]
        stops, page = self.stops, self.page
        i = bisect_left(stops, at)
        while i < len(stops):
            self.dead.add(i)
            quote = page[stops[i]]
            i += 1
            while i < len(stops) and page[stops[i]] != quote:
                i += 1
            if i == len(stops):
                return
            i += 1
        self.dead.add(i)


def page_blocks(page: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, with their kind: KEPT (in an article, or without one in the main element), OPEN
    or OUT. An article or main element that is marked, or within a marked part, counts where no unmarked article does."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int | None]] = []  # open elements and the kind they set
    kinds = [OPEN]
    opened, marks = Counter(), 0  # open elements by name; marked ones among kinds

    def close_block():
        if text:
            whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                out.append((whole, max(kinds[-1], OUT)))
            text.clear()

    def close_element() -> str:
        nonlocal marks
        name, kind = stack.pop()
        opened[name] -= 1
        if kind is not None:
            marks -= kinds.pop() == MARKED
        return name

    markup = Markup(page)
    at, n = 0, len(page)
    while at < n:
        part = markup.at(at)
        if part is None:
            text.append("<")
            at += 1
            continue
        at = part.end()
        name = part.group(2)
        if name is None:
            if page[part.start()] != "<" or part.end() - part.start() == 1:
                text.append(part.group())
            continue
        name = name.lower()
        if part.group(1):
            if name in INLINE and not any(t == name for t, _ in stack[-8:]):
                continue
            if opened[name]:
                close_block() if name not in INLINE else None
                while stack:
                    if stack[-1][1] is not None:
                        close_block()
                    if close_element() == name:
                        break
            elif name not in INLINE:
                close_block()
            continue
        if name == "br":
            text.append(" ")
            continue
        attributes = part.group(3)
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at, markup.end)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else n
            continue
        if name not in INLINE:
            close_block()
            while stack and stack[-1][0] == "p":  # a block ends an open paragraph
                close_element()
        if name in VOID or attributes.endswith("/"):
            continue
        kind = None
        if kinds[-1] != OUT:
            if name in OUTSIDE:
                kind = OUT
            elif name not in ("html", "body") and "=" in attributes:
                named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower()
                if named and name not in HEADINGS and (kinds[-1] <= OPEN or name in CONTAINERS or name in MAIN) and any(map(is_mark, named.split())):
                    kind = MARKED
                elif re.search(r"\bmain\b", named) and name in ("div", "section") and "role" in attributes.lower():
                    kind = LIKELY
            if name in MAIN and kind in (None, MARKED):
                marked = kind == MARKED or marks > 0
                kind = None if kinds[-1] == KEPT and not marked else MARKED if kinds[-1] == KEPT and kind == MARKED else LIKELY if marked else MAIN[name]
        if kind is not None:
            close_block()
            kinds.append(kind)
            marks += kind == MARKED
        if kind is not None or name not in INLINE:
            stack.append((name, kind))
            opened[name] += 1
    close_block()
    best = max((kind for _, kind in out), default=OPEN)
    if best <= OPEN:
        return out
    return [(t, KEPT if kind == best else OUT) for t, kind in out]


def parse(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One row per page: id, url, host, number of open blocks, main text (null if blocks are open), and the other blocks
    with their kinds."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                rows = []
                for url, page in zip(some.column("url").to_pylist(), some.column("html").to_pylist()):
                    found = page_blocks(page or "")
                    n_open = sum(kind == OPEN for _, kind in found)
                    text = None if n_open else "\n".join(t for t, kind in found if kind == KEPT)
                    other = [x for x in found if x[1] != KEPT]
                    rows.append((url, host_of(url), n_open, text, [t for t, _ in other], [kind for _, kind in other]))
                types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]
                columns = [some.column("page_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PARSED.split(", ")])

    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return given.mapInArrow(run, PARSED)


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a page's blocks, and the number of each token's block."""
    data, offsets = words.buffer_of(pa.array(texts, pa.string()))
    starts, ends, first = words.spans(data, offsets, words.SPACED)
    return words.hashes(data, starts, ends), words.text_of(first)


def prefix_groups(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array's order by the first run tokens, by prefix doubling: positions sorted by their first run
    tokens, and for each the number of its group of equal prefixes. Suffixes shorter than run tokens before their
    page's end are left out."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank, size = rank.astype(np.int64) + 1, 1
    while size < run:
        step = min(size, run - size)  # the last doubling overlaps
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        rank, size = rank.astype(np.int64) + 1, size + step
    whole = np.zeros(n, bool)
    if n >= run:
        whole[: n - run + 1] = page[: n - run + 1] == page[run - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(rank[at], kind="stable")]
    return order, rank[order]


def repeated(open_pages: DataFrame) -> DataFrame:
    """(host, prefix) for token sequences of RUN tokens that stand on at least PAGES pages of the host."""

    def shard(tokens, pages, host):
        tokens, page = np.concatenate(tokens), np.concatenate(pages)
        order, group = prefix_groups(tokens, page)
        if not len(order):
            return None
        gram = words.grams(tokens, RUN)[order]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        own = np.concatenate([[True], (group[1:] != group[:-1]) | (page[order][1:] != page[order][:-1])])
        n_pages = np.add.reduceat(own.astype(np.int64), heads)
        return pa.RecordBatch.from_arrays([pa.array([host] * len(heads)), pa.array(gram[heads].view(np.int64)), pa.array(n_pages)], ["host", "prefix", "n"])

    def run(batches):
        host, tokens, pages, held, number = None, [], [], 0, 0
        for batch in batches:
            for h, texts in zip(*(batch.column(c).to_pylist() for c in ("host", "texts"))):
                if tokens and (h != host or held > SHARD_TOKENS):
                    found = shard(tokens, pages, host)
                    if found is not None:
                        yield found
                    tokens, pages, held = [], [], 0
                host = h
                own, _ = stream(texts)
                number += 1
                tokens.append(own)
                pages.append(np.full(len(own), number))
                held += len(own)
        if tokens:
            found = shard(tokens, pages, host)
            if found is not None:
                yield found

    parts = int(open_pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = open_pages.repartitionByRange(parts, "host", "row").sortWithinPartitions("host", "row")
    counted = dealt.select("host", "texts").mapInArrow(run, "host string, prefix long, n long")
    return counted.groupBy("host", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES).select("host", "prefix")


def decide(undecided: DataFrame, found: DataFrame) -> DataFrame:
    """(row, text) of pages with open blocks: the runs of open blocks that no repeated sequence covers."""

    def prefixes(batches):
        for batch in batches:
            for row, host, texts in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "texts"))):
                tokens, _ = stream(texts)
                gram = words.grams(tokens, RUN).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(gram), pa.int64()), pa.array([host] * len(gram), pa.string()), pa.array(gram), pa.array(np.arange(len(gram)), pa.int32())],
                    ["row", "host", "prefix", "at"],
                )

    asked = undecided.select("row", "host", "texts").mapInArrow(prefixes, "row long, host string, prefix long, at int")
    hits = asked.join(found, ["host", "prefix"]).groupBy("row").agg(F.collect_list("at").alias("hits"))

    def finish(batches):
        for batch in batches:
            made = []
            for texts, kinds, hits in zip(*(batch.column(c).to_pylist() for c in ("texts", "kinds", "hits"))):
                tokens, block = stream(texts)
                at = np.array(hits or [], np.int64)
                gone = words.covered(len(tokens), at, at + RUN) if len(tokens) else np.zeros(0, bool)
                kept = []
                for i, (text, kind) in enumerate(zip(texts, kinds)):
                    if kind == OPEN:
                        left = [w for w, out in zip(text.encode().split(), gone[block == i].tolist()) if not out]
                        if left:
                            kept.append(b" ".join(left).decode())
                made.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string())], ["page_id", "url", "text"])

    return undecided.join(hits, "row", "left").select("page_id", "url", "texts", "kinds", "hits").mapInArrow(finish, "page_id long, url string, text string")


def distinct_pages(pages: DataFrame, text: Column) -> DataFrame:
    """The host and the least row of the pages of each host that have the same text."""
    return pages.groupBy("host", F.xxhash64(text).alias("text")).agg(F.min("row").alias("row")).select("host", "row")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    parsed = blocks.staged(parse(pages, id_col, url_col, html_col), "pages").withColumn("row", F.monotonically_increasing_id())
    undecided, decided = parsed.where("n_open > 0"), parsed.where("n_open = 0")
    hosts = undecided.select("host").distinct()
    page_text = F.xxhash64(F.concat_ws("\n", F.coalesce("text", F.lit("")), F.array_join("texts", "\n"))).alias("page_text")
    seen = distinct_pages(parsed.select("host", "row", page_text).join(hosts, "host", "left_semi"), F.col("page_text"))
    evidence = repeated(parsed.select("host", "row", "texts").join(seen.select("row"), "row", "left_semi"))
    whole = decided.select("page_id", "url", "text").unionByName(decide(undecided, evidence))
    return whole.withColumn("n_chars", F.length("text").cast("long"))
