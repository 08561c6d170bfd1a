"""Main text of web pages with a suffix array per host.

A page is read once into blocks (runs of text between block tags), each with
the zone its tags put it in: ``main`` (inside an article or main element),
``chrome`` (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, by element, role, class or id) or ``open`` (anything else).

The token streams of a host's pages outside ``main`` are its string; its
suffixes are ordered by grouping on (host, suffix cut at RUN tokens), so a group
is the suffixes with a common prefix of RUN tokens or more.  A longer run is
covered by the prefixes of its own suffixes, so no longer prefix is compared.
A run is boilerplate if it stands in the square root of the host's pages or
more (two at least), and not only in copies of one stream; an open block of
fewer than RUN tokens is a run of its own.  The other tokens of open blocks
are kept.  An article is kept whole, also where two pages carry the same one;
chrome goes also where a page has its own.  An article inside a chrome wrapper
(a form around the page, a div named after a menu) is ``main`` if the page has
no other; not so in sidebars, menus, footers, reader comments and teasers.

Suffixes are counted with partial aggregation (a footer that a third of all
pages carry is combined before the shuffle) and only the smallest and largest
stream and page of each is kept, and their number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.llm.textkit import U64, mix64, seeds, words
from govlake.session import materialize

#: Fewest tokens of a repeated run, short blocks apart.
RUN = 12

MAIN_TAGS = {"article", "main"}
CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset",
               "head", "noscript", "figure", "iframe", "object", "svg", "canvas", "audio", "video"}
SILENT_TAGS = {"script", "style", "template", "title", "textarea", "option"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK_TAGS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div",
              "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
              "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
              "td", "tfoot", "th", "thead", "tr", "ul"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}
CHROME_WORDS = re.compile(
    r"(^|[^a-z])(ad|ads|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|header|"
    r"masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|recommend\w*|related|"
    r"replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)([^a-z]|$)")
#: Chrome that holds articles of others: an article in it is never the page's.
ASIDE_TAGS = {"nav", "footer", "aside", "menu", "dialog", "head", "noscript", "figure"}
ASIDE_WORDS = re.compile(r"(^|[^a-z])(ad|ads|advert\w*|comments?|disqus|footer|newsletter|popup|promo\w*|recommend\w*|"
                         r"related|replies|respond|sidebar|sponsor\w*|widget)([^a-z]|$)")
#: An article's own header holds its title.
TITLE_IN_MAIN = {"header", "figure"}
_SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Collects (zone, text) blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.text: list[str] = []
        # tag, enters main, is chrome, is silent, is an aside, counts of main and chrome outside a wrapped article
        self.open: list[tuple] = []
        self.main = self.chrome = self.silent = self.aside = self.wrapped = 0

    def _flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                zone = "chrome" if self.chrome else "wrapped" if self.wrapped else "main" if self.main else "open"
                self.blocks.append((zone, text))
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
        if tag in VOID_TAGS:
            return
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
            self._close()
        named = {k: (v or "").lower() for k, v in attrs}
        chrome = ((tag in CHROME_TAGS and not (self.main and tag in TITLE_IN_MAIN))
                  or named.get("role") in CHROME_ROLES or "hidden" in named or named.get("aria-hidden") == "true"
                  or bool(tag not in ("html", "body") and tag not in MAIN_TAGS
                          and CHROME_WORDS.search(f"{named.get('class', '')} {named.get('id', '')}")))
        main, silent = tag in MAIN_TAGS or named.get("role") == "main", tag in SILENT_TAGS
        aside = chrome and (tag in ASIDE_TAGS or named.get("role") in ("navigation", "contentinfo", "complementary")
                            or "hidden" in named or named.get("aria-hidden") == "true"
                            or bool(ASIDE_WORDS.search(f"{named.get('class', '')} {named.get('id', '')}")))
        if chrome or main or silent:
            self._flush()
        # an article inside a chrome wrapper starts anew; what it wraps itself is judged as in any article
        outside = None
        if main and self.chrome and not (chrome or self.main or self.aside):
            outside, self.chrome = self.chrome, 0
            self.wrapped += 1
        self.open.append((tag, main, chrome, silent, aside, outside))
        self.aside += aside
        self.main += main
        self.chrome += chrome
        self.silent += silent

    def _close(self) -> None:
        _, main, chrome, silent, aside, outside = self.open.pop()
        if main or chrome or silent:
            self._flush()
        self.main -= main
        self.chrome -= chrome
        self.silent -= silent
        self.aside -= aside
        if outside is not None:
            self.chrome = outside
            self.wrapped -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if depth is not None:
            while len(self.open) > depth:
                self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID_TAGS:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)     # "<p/>" opens in HTML

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)


def page_blocks(html: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block of a page, in page order."""
    reader = _Blocks()
    reader.feed(html or "")
    reader.close()
    while reader.open:
        reader._close()
    reader._flush()
    zone = "chrome" if any(z == "main" for z, _ in reader.blocks) else "main"
    return [(zone if z == "wrapped" else z, t) for z, t in reader.blocks]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.coalesce(host, F.lit(""))


def _token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = "\n".join(texts).encode()
    off = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])
    off[-1] = len(data)
    w = words(np.frombuffer(data, np.uint8), off)
    return w.hash, w.first


def _suffixes(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the suffixes of a stream, cut at RUN tokens."""
    n = len(tokens) - RUN + 1
    weight = seeds(RUN, 211)
    out = np.zeros(max(n, 0), dtype=U64)
    for j in range(RUN):
        out += tokens[j:j + len(out)] * weight[j]
    return mix64(out)


def _short_blocks(zones: list[str], tokens: np.ndarray, first: np.ndarray) -> list[tuple[int, np.uint64]]:
    """(block, hash) of the open blocks of fewer than RUN tokens."""
    weight, out = seeds(RUN, 223), []
    for k, zone in enumerate(zones):
        t = tokens[first[k]:first[k + 1]]
        if zone == "open" and 0 < len(t) < RUN:
            out.append((k, mix64((t * weight[:len(t)]).sum(keepdims=True, dtype=U64) + U64(len(t)))[0]))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url and ``text`` (main-text blocks
    joined by newlines).

    White space inside a block becomes one space; character references are
    decoded; a null or empty page, or one without main text, gives an empty
    text.  A null url is a host of its own name "".  Pages that share an id
    count as one page for repeats and are extracted each; no rows give no rows.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    src = src.withColumn("host", host_of(F.col("url")))
    kind = src.schema["id"].dataType.simpleString()

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, html in enumerate(b.column("html").to_pylist()):
                blocks = [x for x in page_blocks(html) if x[0] != "main"]
                if not blocks:
                    continue
                tokens, first = _token_hashes([t for _, t in blocks])
                short = [h for _, h in _short_blocks([z for z, _ in blocks], tokens, first)]
                run = np.unique(np.concatenate([_suffixes(tokens), np.array(short, dtype=U64)]))
                if len(run):
                    at = pa.array(np.full(len(run), i))
                    stream = int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little",
                                            signed=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("host").take(at), b.column("id").take(at), pa.array(run.view(np.int64)),
                         pa.array(np.full(len(run), stream))], names=["host", "id", "suffix", "stream"])

    found = materialize(src.filter("id is not null")
                        .mapInArrow(suffixes, f"host string, id {kind}, suffix bigint, stream bigint"), "suffixes")
    pages_of = (src.filter("id is not null").select("host", "id").distinct().groupBy("host")
                .agg(F.greatest(F.lit(2), F.ceil(F.sqrt(F.count("*")))).alias("least")))
    # neighbours in the host's suffix order that agree on RUN tokens, in distinct pages and streams
    repeated = (found.groupBy("host", "suffix")
                .agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"),
                     F.min("stream").alias("from"), F.max("stream").alias("to"))
                .filter("n > 1 and lo != hi and from != to").select("host", "suffix", "n")
                .join(pages_of, "host").filter("n >= least").select("host", "suffix"))
    of_page = (found.join(repeated, ["host", "suffix"]).groupBy("id")
               .agg(F.collect_set("suffix").alias("repeated")))      # at most the page's own suffixes
    both = src.join(of_page, "id", "left").select("id", "url", "html", "repeated")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for html, again in zip(b.column("html").to_pylist(), b.column("repeated").to_pylist()):
                out.append("\n".join(_main_text(page_blocks(html), again)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string())],
                                             names=["id", "url", "text"])

    return (both.mapInArrow(text, f"id {kind}, url string, text string")
            .withColumnRenamed("id", id_col).withColumnRenamed("url", url_col))


def _main_text(blocks: list[tuple[str, str]], repeated: list[int] | None) -> list[str]:
    """Texts of main blocks, and of open blocks what no repeated run covers."""
    rest = [t for zone, t in blocks if zone != "main"]
    covered, first = np.zeros(0, dtype=bool), np.zeros(1, dtype=np.int64)
    if any(zone == "open" for zone, _ in blocks):
        tokens, first = _token_hashes(rest)
        covered = np.zeros(len(tokens), dtype=bool)
        if repeated:
            again = set(repeated)
            hit = np.isin(_suffixes(tokens).view(np.int64), np.array(repeated, dtype=np.int64))
            for s in np.flatnonzero(hit):
                covered[s:s + RUN] = True
            for k, h in _short_blocks([z for z, _ in blocks if z != "main"], tokens, first):
                if h.astype(np.int64) in again:
                    covered[first[k]:first[k + 1]] = True
    out, k = [], -1
    for zone, t in blocks:
        if zone != "main":
            k += 1
        if zone == "main":
            out.append(t)
        elif zone == "open":
            gone = covered[first[k]:first[k + 1]]
            if not gone.any():
                out.append(t)
            elif not gone.all():
                out.append(" ".join(w for w, g in zip(t.split(" "), gone) if not g))
    return out
