"""Main text of web pages, with a host suffix array against boilerplate.

A page is parsed into blocks, each in a zone: *main* (inside an article or main element), *noise* (inside a menu, header,
footer, sidebar, notice, advert, form, comment section and the like, known by element, role or class), or *free* (anywhere else in
the body). Scripts, styles and markup have no text. Within an article, words of a class that layouts use too (``DOUBTFUL``) mark noise only
where the text is short or mostly links, and such a class around an article doesn't count; headings in an article's own header are main.

Zones are the input of the second step, for all pages and zones. The blocks' tokens are laid end to end, page by page. The strings of
``TOKENS`` tokens from every token of a block on are looked at; shorter blocks are strings as a whole. A suffix array of
all tokens gives classes of equal strings and
in how many pages each occurs; pages of equal text count once. A host is dealt to shards of ``SHARD_PAGES`` pages by their
text, and the counts of its shards are added, so that the host decides and not the shard: a string in ``PAGES`` pages of the host is repeated.
For that, shards of a host of several send all their different strings, as sorted runs of 64-bit digests cut into ranges.
A run of successive strings of a block that are all repeated is boilerplate if it reaches the block's start or end.

The text of a page is its main zone, or without one its free blocks, less boilerplate. Articles may quote the same passages, so in
main zones a string counts as repeated only in ``MAIN_PAGES`` pages and as many as half of the host's rows, and short blocks stay. A main zone is kept
whole if more than half of it would go: such a page is a near copy of others. Free text is kept whole if nine tenths would go.

Defined results: null or empty html, or html without text, gives an empty text; a null url is a host of its own;
repeated rows and pages of equal text count once against boilerplate and get their text each; broken markup ends with its container or the page; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, slices
from .suffix import suffix_ranks

TOKENS, PAGES, MAIN_PAGES, SHARD_PAGES = 12, 3, 5, 1024
#: Bytes of text that are hashed at a time, and shards of a host whose strings of one range meet.
CHUNK, MEET = 1 << 20, 4
MAIN, NOISE, FREE = range(3)

#: Elements without text of their own for the reader.
SILENT = frozenset("head title script style noscript template iframe object svg canvas math select option datalist button textarea audio video map".split())
NOISE_ELEMENTS = frozenset("nav header footer aside form menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class or id that mark noise.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars header footer masthead toolbar pagination pager comment comments commentlist disqus respond reply replies "
    "related recommended newsletter subscribe subscription signup login share sharing social popup modal overlay widget widgets search form disclaimer copyright skip".split()
)
#: Those of them that layouts use for other things too.
DOUBTFUL = frozenset("form header menu menus notice notices alert alerts search login signup share sharing social widget widgets toolbar overlay modal popup promotion banner banners skip reply respond subscribe subscription newsletter consent".split())
#: So many words, in an element of a doubtful class, are text of the article.
PLENTY = 40
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
MAIN_ELEMENTS = frozenset(["article", "main"])
#: Noise that no article lies in: if one begins there, the end tag is missing.
UNCLOSED = frozenset(["nav", "header", "form"])
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that this element ends, if it is the innermost of the two that are open.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WHITE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _kind(tag: str, attributes: list) -> str:
    """"noise", "doubt" (by doubtful words of the class alone) or ""."""
    if tag in NOISE_ELEMENTS:
        return "noise"
    found = set()
    for name, value in attributes:
        if name == "role" and value and value.lower() in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "noise"
        if name in ("class", "id") and value:
            found |= NOISE_WORDS.intersection(w.lower() for w in _NAME.findall(_HUMP.sub(" ", value)))
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return "noise"
    return "" if not found else "doubt" if found <= DOUBTFUL else "noise"


class _Blocks(HTMLParser):
    """(zone, text) blocks in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.blocks: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.counts = {"silent": 0, "noise": 0, "doubt": 0, "outer doubt": 0, "main": 0, "own header": 0, "heading": 0, "link": 0}
        self.linked = 0
        self.doubts: dict[int, list[int]] = {}  # of the outermost doubtful element: words, words in links, first block
        self.doubt = 0

    def zone(self) -> int:
        c = self.counts
        if c["noise"] or c["own header"] and not c["heading"] or c["outer doubt"] and not c["main"]:
            return NOISE
        return MAIN if c["main"] else FREE

    def flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self.parts)).strip()
        linked, self.parts, self.linked = self.linked, [], 0
        if text:
            zone = self.zone()
            if zone == MAIN and self.counts["doubt"]:  # opened in the article
                held = self.doubts.setdefault(self.doubt, [0, 0])
                held[0] += text.count(" ") + 1
                held[1] += linked
                zone = -1 - self.doubt
            self.blocks.append((zone, text))

    def settled(self) -> list[tuple[int, str]]:
        """The blocks, when what is doubtful has been read to its end."""
        text = {-1 - d: MAIN if words >= PLENTY and 2 * linked < words else NOISE for d, (words, linked) in self.doubts.items()}
        return [(text.get(zone, zone), x) for zone, x in self.blocks]

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] not in INLINE:
                if self.stack[k][0] in ENDED_BY.get(tag, ()):
                    self.close_to(k)
                break
        if tag in MAIN_ELEMENTS and self.counts["noise"]:
            noise = [k for k, (_, kind) in enumerate(self.stack) if kind == "noise"]
            if all(self.stack[k][0] in UNCLOSED for k in noise):
                self.close_to(noise[0])
        kind = self.kind_of(tag, attributes)
        if kind:
            if kind == "doubt" and not self.counts["doubt"]:
                self.doubt += 1
            if tag in INLINE and kind != "link":
                self.flush()
            self.counts[kind] += 1
        self.stack.append((tag, kind))

    def kind_of(self, tag: str, attributes: list) -> str:
        if tag in SILENT:
            return "silent"
        if tag in ("html", "body"):
            return ""
        if tag in MAIN_ELEMENTS:
            return _kind("", attributes).replace("doubt", "") or "main"
        kind = _kind(tag, attributes)
        if self.counts["main"]:
            if tag == "header" and not _kind("", attributes):
                return "own header"
            if tag in HEADINGS and self.counts["own header"] and not kind:
                return "heading"
        elif kind == "doubt":
            return "outer doubt"
        return kind or ("link" if tag == "a" else "")

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        if tag not in INLINE:
            self.flush()
        if tag not in VOID:
            self.handle_starttag(tag, attributes)

    def close_to(self, k: int) -> None:
        self.flush()
        for _, kind in self.stack[k:]:
            if kind:
                self.counts[kind] -= 1
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag in INLINE and any(t not in INLINE for t, _ in self.stack[k:]):
                    return
                if tag in INLINE and not any(kind not in ("", "link") for _, kind in self.stack[k:]):
                    self.counts["link"] -= sum(kind == "link" for _, kind in self.stack[k:])
                    del self.stack[k:]
                else:
                    self.close_to(k)
                return
            if self.stack[k][1] in ("main", "noise", "doubt", "outer doubt", "own header") and tag not in MAIN_ELEMENTS | NOISE_ELEMENTS | {"body", "html", "div", "section"}:
                return

    def handle_data(self, data: str) -> None:
        if not self.counts["silent"]:
            self.parts.append(data)
            if self.counts["link"]:
                self.linked += len(data.split())


def blocks_of(html: str) -> list[tuple[int, str]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.settled()


_R, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_R, -1, 1 << 64)
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hashes(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the symbols of each stretch, the same wherever it lies."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * _powers(_R, len(symbols)))])
    h = (sums[end] - sums[begin]) * _powers(_INVERSE, len(symbols) + 1)[begin]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


class Strings:
    """The strings of some blocks: ``start`` (in the tokens of all), ``block`` and ``digest`` of each, in order.

    No block is empty, and one space separates its tokens. With ``every`` over 1 only strings at both ends of a block and those
    whose hash it divides are listed, for a look at few; the operator lists all.
    """

    def __init__(self, blocks: list[str], tokens: int = TOKENS, every: int = 1) -> None:
        self.tokens = tokens
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in _groups(blocks):
            data = np.frombuffer(part, np.uint8)
            end = np.flatnonzero((data == 32) | (data == 10))
            hashes.append(_hashes(_BYTES[data], np.concatenate([[0], end[:-1] + 1]), end))
            sizes.append(np.diff(np.flatnonzero(data[end] == 10), prepend=-1))
        self.ids, self.sizes = np.concatenate(hashes), np.concatenate(sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(self.ids)) - self.begin[owner]
        self.room = self.sizes[owner] - place
        self.start = np.flatnonzero((place == 0) | (self.room >= tokens))
        self.digest = _hashes(self.ids, self.start, self.start + np.minimum(self.room[self.start], tokens))
        if every > 1:
            listed = (place[self.start] == 0) | (self.room[self.start] == tokens) | (self.digest % np.uint64(every) == 0)
            self.start, self.digest = self.start[listed], self.digest[listed]
        self.block = owner[self.start]

    def classes(self) -> np.ndarray:
        """A number for each string, the same for equal ones: ranks in a suffix array of all tokens, sorted to the length of strings; blocks shorter than that have numbers of their own."""
        n, step = len(self.ids), self.tokens
        while step % 2 == 0:
            step //= 2
        every = np.arange(n)
        keys = _hashes(self.ids, every, every + np.minimum(self.room, step))
        out = suffix_ranks(keys, step, self.tokens)[1][self.start].astype(np.int64)
        short = np.flatnonzero(self.sizes[self.block] < self.tokens)
        out[short] = n + np.unique(self.digest[short], return_inverse=True)[1]
        return out

    def counts(self, page: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the different strings and in how many pages each occurs, if in ``least``; ``page``: of each block."""
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        own = self.classes()
        often = np.bincount(own)[own]
        more = np.flatnonzero(often >= max(least, 2))
        own = own[more]
        several, first = np.unique(own, return_index=True)
        span = int(page.max()) + 1
        pairs = np.unique(np.searchsorted(several, own) * span + page[self.block[more]])
        n = np.bincount(pairs // span, minlength=len(several))
        once = self.digest[often == 1] if least < 2 else self.digest[:0]
        return np.concatenate([once, self.digest[more[first]][n >= least]]), np.concatenate([np.ones(len(once), np.int64), n[n >= least]])

    def covered(self, repeated: np.ndarray, in_main: np.ndarray, free: np.ndarray) -> list[tuple[int, int, int]]:
        """(block, from, to) in tokens of boilerplate, in order. ``repeated``: sorted digests; ``in_main``: of each of them; ``free``: of each block, whether it is free or of a main zone."""
        if not len(repeated):
            return []
        at = np.minimum(np.searchsorted(repeated, self.digest), len(repeated) - 1)
        hot = repeated[at] == self.digest
        hot &= free[self.block] | in_main[at] & (self.sizes[self.block] >= self.tokens)
        out = []
        joins = np.concatenate([[False], hot[1:] & hot[:-1] & (self.block[1:] == self.block[:-1])])
        head = np.flatnonzero(hot & ~joins)
        tail = np.flatnonzero(hot & ~np.concatenate([joins[1:], [False]]))
        for a, z in zip(head.tolist(), tail.tolist(), strict=True):
            b = int(self.block[a])
            low, high = int(self.start[a] - self.begin[b]), min(int(self.start[z] - self.begin[b]) + self.tokens, int(self.sizes[b]))
            if low == 0 or high == self.sizes[b]:
                out.append((b, low, high))
        return out


def _groups(blocks: list[str]) -> Iterator[bytes]:
    """Blocks, each with a line feed at its end, joined to some CHUNK bytes."""
    now, size = [], 0
    for x in blocks:
        now.append(x)
        size += len(x)
        if size >= CHUNK:
            yield "\n".join([*now, ""]).encode()
            now, size = [], 0
    if now:
        yield "\n".join([*now, ""]).encode()


def page_texts(pages: list[tuple[bytes, list[str]]], repeated: np.ndarray, in_main: np.ndarray, tokens: int = TOKENS) -> list[str]:
    """The texts of pages, each given by the zones and texts of its blocks, of a host with these repeated strings (sorted), of which some count in main zones."""
    text_zone = [MAIN if MAIN in zones else FREE for zones, _ in pages]
    blocks = [[x for z, x in zip(zones, texts, strict=True) if z == own] for (zones, texts), own in zip(pages, text_zone, strict=True)]
    page = np.repeat(np.arange(len(pages)), [len(x) for x in blocks])
    s = Strings([x for of in blocks for x in of], tokens)
    first = np.searchsorted(page, np.arange(len(pages)))
    total = np.bincount(page, weights=s.sizes, minlength=len(pages))
    gone: dict[int, list[tuple[int, int, int]]] = {}
    for b, low, high in s.covered(repeated, in_main, np.array(text_zone, np.int64)[page] == FREE):
        gone.setdefault(int(page[b]), []).append((b - int(first[page[b]]), low, high))
    for i, runs in gone.items():
        words = {b: blocks[i][b].split(" ") for b, _, _ in runs}
        n = sum(map(len, words.values()))
        for b, low, high in reversed(runs):  # those of one block may overlap
            del words[b][low:high]
        n -= sum(map(len, words.values()))
        if (2 * n <= total[i]) if text_zone[i] == MAIN else (10 * n <= 9 * total[i]):
            for b, left in words.items():
                blocks[i][b] = " ".join(left)
    return ["\n".join(x for x in of if x) for of in blocks]


def _blocks(packed: pa.ChunkedArray) -> list[list[str]]:
    texts = [zlib.decompress(x).decode() for x in packed.to_pylist()]
    return [x.split("\n") if x else [] for x in texts]


def _packed(digests: np.ndarray) -> bytes:
    """Sorted digests, as the bytes of their differences by place."""
    return zlib.compress(np.diff(digests, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _merged(t: pa.Table, least: int) -> pa.Table:
    """Of the strings of one range: for each shard of the host its strings that the host repeats."""
    runs = [_unpacked(x) for x in t["strings"].to_pylist()]
    counts = [np.frombuffer(zlib.decompress(x), np.int32) for x in t["n"].to_pylist()]
    strings, place = np.unique(np.concatenate(runs), return_inverse=True)
    n = np.bincount(place, weights=np.concatenate(counts), minlength=len(strings))
    main = (n >= MAIN_PAGES) & (2 * n >= t["rows"][0].as_py())
    out, at = [], 0
    for run in runs:
        own = place[at : at + len(run)]
        hot = n[own] >= least
        out.append((_packed(run[hot]), main[own[hot]].tobytes()))
        at += len(run)
    return pa.table({"host": t["host"], "shard": t["shard"], "strings": pa.array([x for x, _ in out], pa.binary()), "in_main": pa.array([x for _, x in out], pa.binary())})


def _parsed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, content (a hash of the text), zones (a byte for each block) and blocks (joined by line feeds, compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [blocks_of(h or "") for h in b.column(2).to_pylist()]
            texts = ["\n".join(x for _, x in blocks).encode() for blocks in found]
            content = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)
            zones = pa.array([bytes(z for z, _ in blocks) for blocks in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(content), zones, pa.array([zlib.compress(x, 3) for x in texts], pa.binary())], ["page_id", "url", "content", "zones", "blocks"])

    return pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(run, "page_id long, url string, content long, zones binary, blocks binary")


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", tokens: int = TOKENS, least: int = PAGES, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text of every page.

    Blocks are shuffled once, to their host's shards; both steps, counting and covering, read that shuffle. Only hosts of
    more than one shard are listed, and their shards exchange digests.
    """
    hosts = pages.groupBy(_host(url).alias("host")).agg(F.count("*").alias("rows"))
    large = cut(hosts.withColumn("shards", F.ceil(F.col("rows") / shard_pages).cast("int")).where("shards > 1"), "large")
    dealt = _parsed(pages, page_id, url, html).withColumn("host", _host("url")).join(large, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.col("content"), F.col("shards")).cast("int")).select("host", "shard", "shards", "rows", "page_id", "url", "content", "zones", "blocks")
    dealt = dealt.repartition(partitions(dealt), "host", "shard")  # else Spark would leave a host's shards together, as the join has dealt them

    def count(t: pa.Table) -> pa.Table:
        shards, shard = t["shards"][0].as_py(), t["shard"][0].as_py()
        blocks = _blocks(t["blocks"])
        s = Strings([x for of in blocks for x in of], tokens)
        _, page = np.unique(t["content"].to_numpy(), return_inverse=True)
        digest, n = s.counts(np.repeat(page, [len(of) for of in blocks]), least if shards == 1 else 1)
        order = np.argsort(digest)
        digest, n = digest[order], n[order].astype(np.int32)
        pieces = -(-shards // MEET)
        cuts = np.searchsorted(digest >> np.uint64(32), np.array([-(-(k << 32) // pieces) for k in range(pieces)] + [1 << 32], np.uint64))
        parts = [(k, _packed(digest[a:z]), zlib.compress(n[a:z].tobytes(), 1)) for k, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < z]
        rows = t.num_rows if shards == 1 else t["rows"][0].as_py()
        host = [t["host"][0].as_py()] * len(parts)
        return pa.table([pa.array(c, k) for c, k in zip((host, [shard] * len(parts), [rows] * len(parts), *([p[i] for p in parts] for i in range(3))), (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["host", "shard", "rows", "piece", "strings", "n"])

    def merge(t: pa.Table) -> pa.Table:
        return _merged(t, least)

    def cover(t: pa.Table, repeated: pa.Table) -> pa.Table:
        strings = np.concatenate([np.zeros(0, np.uint64), *map(_unpacked, repeated["strings"].to_pylist())])
        in_main = np.frombuffer(b"".join(repeated["in_main"].to_pylist()), bool)
        order = np.argsort(strings)
        texts = page_texts(list(zip(t["zones"].to_pylist(), _blocks(t["blocks"]), strict=True)), strings[order], in_main[order], tokens)
        return pa.table({"page_id": t["page_id"], "url": t["url"], "text": pa.array(texts, pa.string())})

    counts = dealt.groupBy("host", "shard").applyInArrow(count, "host string, shard int, rows long, piece int, strings binary, n binary")
    repeated = counts.groupBy("host", "piece").applyInArrow(merge, "host string, shard int, strings binary, in_main binary")
    return dealt.groupBy("host", "shard").cogroup(repeated.groupBy("host", "shard")).applyInArrow(cover, "page_id long, url string, text string")
