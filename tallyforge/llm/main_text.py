"""Main text of web pages: what a host repeats on page after page is taken away, what is unique stays.

1. Each page is read into blocks of text with what their elements say: inside the main element (``article``, ``main``,
   an article body), never article text (menus, forms, side bars, comments ...), or neither.
2. The blocks outside main elements are streams of words; each word begins a suffix. A host's streams are concatenated in
   shards, their suffixes sorted as far as LONG words go, and equal ones put together; the shards' intervals meet in one
   sum by substring, so a host of any size is dealt out evenly. A longer repeat is the union of its LONG-word windows.
3. A substring found on at least PAGES pages of the host with different content covers its words, and a block of which
   more than half is covered is taken away whole. Copies of a page count once, so an article that is published many times
   is no boilerplate. Main elements are kept whatever repeats in them, so their words are no suffixes.
4. Kept are, in page order: all blocks of main elements, repeated or not; and the uncovered ones outside that no element
   speaks against, where the page has no main element (else only its headline).

A null html is empty text; a null url is a host of its own. Pages with equal ids and repeated rows each give a row. Empty
tables give no rows. Markup that never ends runs to the end of the page. Columns other than page_id, url, html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import written

#: Words that a repeated substring has at least (fewer where whole blocks end a stream), and pages that it is on.
LONG, PAGES = 6, 3

# Fixed names of HTML and usual names of page parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav noscript ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in "script style textarea title xmp iframe noembed noframes".split()}
#: Elements that are no article text unless a main element inside them says so; those that are none whatever is inside.
OUTSIDE = set("nav header footer form menu search".split())
NEVER = set("aside head noscript template dialog button select datalist option label svg object canvas audio video map".split())
MAIN_NAME = re.compile(r"(article|post|entry|story)[-_ ]?(body|content|text)|main[-_]?(content|text)")
WEAK_WORDS = set("nav navbar navigation menu header masthead topbar banner footer notice notices alert notification announcement copyright colophon".split())
STRONG_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted comment comments commentlist disqus respond replies sidebar aside widget widgets related "
    "recommended recommendations newsletter subscribe subscription signup cookie cookies consent gdpr popup modal overlay share sharing social breadcrumb breadcrumbs pagination pager toolbar "
    "search login skip".split()
)
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "search": -1, "form": -1, "complementary": -2, "dialog": -2, "alert": -2, "alertdialog": -2, "menu": -1, "menubar": -1}

#: What elements say of the text in them: never, not unless a main element is inside, nothing, main element.
NO, UNLIKELY, OPEN, MAIN = -2, -1, 0, 1

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def decoded(text: str) -> str:
    """Character references as characters; numbers beyond Unicode as U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub(r"&#\1", text))
    return unescape(text)


def says(tag: str, attributes: dict[str, str], around: int) -> int:
    """What an element says of its text, given what the elements around it say."""
    if around == NO:
        return NO
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}" if tag not in ("html", "body") else ""
    role = attributes.get("role", "").lower()
    parts = [x.lower() for x in _PART.findall(named)]
    words = {w for before, w in zip(["", *parts], parts, strict=False) if before not in ("no", "with", "has", "without")}
    style = attributes.get("style", "").replace(" ", "").lower()
    if tag in NEVER or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or words & STRONG_WORDS or ROLES.get(role) == NO:
        return NO
    if tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "") == "articleBody" or MAIN_NAME.search(named.lower()):
        return MAIN
    weak = words & WEAK_WORDS
    if around == MAIN:  # an article has a header of its own
        weak -= {"header", "masthead", "banner"}
        return UNLIKELY if weak or tag in OUTSIDE - {"header"} or role in ROLES and role != "banner" else MAIN
    return UNLIKELY if weak or tag in OUTSIDE or role in ROLES else around


class Reader:
    """One page's blocks (text, what elements say, headline) in order; linear in the page."""

    def __init__(self, html: str):
        self.html, self.blocks = html, []
        self.pieces: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = []
        self.count: dict[str, int] = {}
        self.now, self.headline = OPEN, False
        self.unclosed = set()  # quotes that do not occur again
        self._read()
        self._end_block()

    def _end_block(self) -> None:
        if not self.pieces:
            return
        for out in (False, True):
            own = [x for x in self.pieces if (x[0] < OPEN) == out]
            text = " ".join("".join(t for _, t in own).split())
            if text:
                self.blocks.append((text, own[0][0], self.headline))
        self.pieces = []

    def _text(self, start: int, end: int) -> None:
        if start < end:
            self.pieces.append((self.now, decoded(self.html[start:end])))

    def _tag_end(self, at: int) -> int:
        """Where the tag's > is; quotes count after an equals sign only."""
        while m := _STOP.search(self.html, at):
            at = m.end()
            quote = m[0]
            if quote == ">":
                return m.start()
            if quote in self.unclosed or not self.html[max(0, m.start() - 8) : m.start()].rstrip().endswith("="):
                continue
            close = self.html.find(quote, at)
            if close < 0:
                self.unclosed.add(quote)
            else:
                at = close + 1
        return -1

    def _pop(self, tag: str) -> None:
        while self.open:
            name, _ = self.open.pop()
            self.count[name] -= 1
            if name == tag:
                break
        self.now = self.open[-1][1] if self.open else OPEN

    def _start(self, tag: str, inside: str) -> None:
        if tag in ("br", "td", "th", "wbr", "img", "input"):
            self.pieces.append((self.now, "" if tag == "wbr" else " "))
        if tag in BLOCK:
            self._end_block()
            if self.count.get("p"):
                self._pop("p")
            self.headline = tag == "h1"
        if tag in VOID:
            return
        attributes = {}
        if inside and not inside.isspace():
            for m in _ATTRIBUTE.finditer(inside):
                attributes.setdefault(m[1].lower(), decoded(m[2] or m[3] or m[4] or ""))
        then = says(tag, attributes, self.now)
        if tag in BLOCK or then != self.now or self.count.get(tag):
            self.open.append((tag, then))
            self.count[tag] = self.count.get(tag, 0) + 1
            self.now = then

    def _end(self, tag: str) -> None:
        if tag in ("br", "td", "th"):
            self.pieces.append((self.now, " "))
        if tag in BLOCK:
            self._end_block()
            self.headline = False
        if self.count.get(tag):
            self._pop(tag)

    def _read(self) -> None:
        html, at = self.html, 0
        while (lt := html.find("<", at)) >= 0:
            self._text(at, lt)
            after = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                close = lt + 4 if html.startswith((">", "->"), lt + 4) else html.find("-->", lt + 4)
                at = html.find(">", close) + 1 if close >= 0 else len(html)
            elif after in ("!", "?") or after == "/" and not _NAME.match(html, lt + 2):
                at = html.find(">", lt) + 1 or len(html)
            elif m := _NAME.match(html, lt + 1 + (after == "/")):
                end = self._tag_end(m.end())
                if end < 0:
                    return
                tag, at = m[0].lower(), end + 1
                if after == "/":
                    self._end(tag)
                elif tag in RAW:
                    close = RAW[tag].search(html, at)
                    if not close:
                        return
                    at = html.find(">", close.end()) + 1 or len(html)
                else:
                    self._start(tag, html[m.end() : end])
            else:
                self.pieces.append((self.now, "<"))
                at = lt + 1
        self._text(at, len(html))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def tokens(block: str) -> list[tuple[int, int]]:
    """A block's tokens (hash, words): its words."""
    return [(_hash(word), 1) for word in block.split(" ")]


_PARSED = "row long, page_id long, url string, host long, content long, main boolean, text string, blocks array<struct<text: string, says: int, headline: boolean, after: int>>"
_BLOCK = pa.struct([("text", pa.string()), ("says", pa.int32()), ("headline", pa.bool_()), ("after", pa.int32())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's main text, and its other blocks; ``after`` is the number of main blocks before one."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(_BLOCK)]
    for batch in batches:
        for begin in range(0, len(batch), 256):
            part, out = batch.slice(begin, 256), []
            for row, page, url, html in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                blocks, rest, main = Reader(html or "").blocks, [], []
                for text, say, headline in blocks:
                    if say == MAIN:
                        main.append(text)
                    else:
                        rest.append({"text": text, "says": say, "headline": headline, "after": len(main)})
                host = re.sub(r"^[^/]*//|[/?#].*$", "", url or "", flags=re.DOTALL).rpartition("@")[2].lower()
                content = _hash("\n".join(main) if main else max((t for t, *_ in blocks), key=len, default=""))
                out.append((row, page, url, _hash(host), content, bool(main), "\n".join(main), rest))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in re.sub("<.*>", "", _PARSED).split(", ")])


def _sorted_suffixes(host: np.ndarray, token: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated streams: the order of the suffixes, cut at LONG words, where equal ones begin, and how many words each has.

    ends: for each place, the end of its stream.
    """
    n = len(token)
    at, columns = np.arange(n), []
    for k in range(LONG):
        columns.append(np.where(at + k < ends, token[np.minimum(at + k, n - 1)], -1))
    order = np.lexsort([*columns[::-1], host])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in (host, *columns):
        new[1:] |= x[order[1:]] != x[order[:-1]]
    return order, new, np.minimum(ends - at, LONG)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard of pages: each suffix's substring (a hash with its host), page content, page row, first word (of all the page's) and words.

    A suffix of fewer than LONG words counts from the beginning of a block only.
    """
    for batch in batches:
        host, row, content, token, word, starts, ends = [], [], [], [], [], [], []
        for h, r, c, blocks in zip(*(batch.column(x).to_pylist() for x in ("host", "row", "content", "blocks")), strict=True):
            page = begin = len(token)
            for k, b in enumerate(blocks):
                if k and b["after"] != blocks[k - 1]["after"]:  # main text lies between
                    ends += [len(token)] * (len(token) - begin)
                    begin = len(token)
                own = [t for t, _ in tokens(b["text"])]
                token += own
                starts += [True, *[False] * (len(own) - 1)]
            ends += [len(token)] * (len(token) - begin)
            n = len(token) - page
            word += range(n)
            host += [h] * n
            row += [r] * n
            content += [c] * n
        if not token:
            continue
        host, row, content, token, word, ends = (np.array(x, np.int64) for x in (host, row, content, token, word, ends))
        order, new, taken = _sorted_suffixes(host, token, ends)
        first = order[np.flatnonzero(new)]
        name = np.fromiter((xxhash.xxh3_64_intdigest(np.append(token[a : a + taken[a]], host[a]).tobytes()) >> 1 for a in first.tolist()), np.int64, len(first))
        name = name[np.cumsum(new) - 1]
        good = (taken[order] == LONG) | np.array(starts, bool)[order]
        name, order = name[good], order[good]
        yield pa.record_batch([pa.array(name), pa.array(content[order]), pa.array(row[order]), pa.array(word[order].astype(np.int32)), pa.array(taken[order].astype(np.int32))], ["substring", "content", "row", "word", "words"])


def covered(parsed: DataFrame) -> DataFrame:
    """Blocks (row, block) outside main elements that lie by more than half in substrings which PAGES or more pages of the host have."""
    outside = parsed.where(F.size("blocks") > 0)
    suffixes = written(outside.select("row", "host", "content", "blocks").mapInArrow(_suffixes, "substring long, content long, row long, word int, words int"), "page-suffixes", compression="zstd")
    pages = suffixes.select("substring", "content").distinct().groupBy("substring").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= PAGES)
    hit = suffixes.select("substring", "row", "word", "words").join(pages.select("substring"), "substring")
    hit = hit.select("row", F.explode(F.sequence("word", F.col("word") + F.col("words") - 1)).alias("word")).distinct()
    # of each block: its words before (of the page's blocks) and its own
    sizes = outside.select("row", F.transform("blocks", lambda b: F.size(F.split(b["text"], " "))).alias("sizes"))
    upto = sizes.join(hit.groupBy("row").agg(F.sort_array(F.collect_list("word")).alias("hit")), "row")
    return upto.mapInArrow(_mostly, "row long, block int")


def _mostly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks more than half of whose words (sizes) are hit."""
    for batch in batches:
        rows, found = [], []
        for r, sizes, hit in zip(*(batch.column(x) for x in ("row", "sizes", "hit")), strict=True):
            end = np.cumsum(np.asarray(sizes.values))
            n = np.diff(np.searchsorted(np.asarray(hit.values), end), prepend=0)
            most = np.flatnonzero(2 * n > np.asarray(sizes.values))
            rows += [r.as_py()] * len(most)
            found += most.tolist()
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(found, pa.int32())], ["row", "block"])


def main_text(pages: DataFrame) -> DataFrame:
    """Each page with its main text and the text's length in code points."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = written(rows.mapInArrow(_parse, _PARSED), "pages", compression="zstd")
    gone = covered(parsed)
    # what elements speak against is told by the element, whether it repeats or not
    blocks = parsed.select("row", "main", F.posexplode("blocks").alias("block", "b"))
    likely = blocks.where((F.col("b.says") == OPEN) & (~F.col("main") | F.col("b.headline") & (F.col("b.after") == 0))).select("row", "block", F.col("b.text").alias("text"))
    unique = likely.join(gone, ["row", "block"], "left_anti")
    lines = unique.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("lines"))
    lines = written(lines.select("of", F.array_join(F.col("lines.text"), "\n").alias("unique")), "page-unique")
    # small files are sent to all tasks, larger ones are joined by shuffling: Spark knows the written table's size
    found = parsed.join(lines, F.col("row") == F.col("of"), "left")
    text = F.concat_ws("\n", "unique", F.when(F.col("text") != "", F.col("text")))
    return found.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))

