"""Main text of web pages with a host suffix array (operator 5).

A page is scanned into blocks. Markup settles most: what is in article or main is the text, but for the menus, sidebars, forms,
adverts, notices and reader comments inside; menus, headers, footers and the like outside are boilerplate. Blocks outside the
article that no markup names stay open. The token streams of all pages outside their articles are concatenated by host and
their suffixes, cut at `RUN` tokens, are sorted: neighbours that are equal and come from distinct pages are a string that the
host repeats. Open tokens that such strings cover are boilerplate, the unique runs left of them are text.

Suffixes are merged within a batch before they are sorted, so a host with a third of all pages sends each of its common strings
once per batch. A page without an article whose whole text the host repeats is a copy of another page and keeps its text.

Defined results: null html is empty; a null url is a host of its own name ""; unclosed and stray tags are borne; repeated rows
and rows with null page_id have results of their own (equal page_ids count as one page); an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import checkpointed, salted_lookup

RUN = 8
#: Most positions that are broadcast to the pages; more are joined by a shuffle.
BROADCAST_PLACES = 500_000
NO_ID = -(2**63)
MAIN, OPEN, OUT = 0, 1, 2
SCANNER = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that begin a new block.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose nesting is followed, and those that are never text.
NESTED = frozenset("article aside body button dialog div dl fieldset figure footer form head header main menu nav ol search section select table ul".split())
NEVER = frozenset("aside button dialog footer form head menu nav search select".split())
#: Words of class, id and role that name boilerplate anywhere, and those that do so outside an article only.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus menu modal nav navbar"
    " navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
OUTER = frozenset("footer header login masthead search top topbar".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _noise(attributes: str, inside: bool) -> bool:
    words = {w for m in NAMES.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}
    return bool(words & NOISE) or (not inside and bool(words & OUTER))


def blocks(page: str) -> list[tuple[int, str]]:
    """(state, text) of every block with text, in page order; references decoded, white space single."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    held: list[str] = []

    def close() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append((stack[-1][1], text))
            held.clear()

    for found in SCANNER.finditer(page):
        name = found[3]
        if name is None:
            text = found[0]
            if text[0] != "<" or text == "<":
                held.append(text)
            continue
        name = name.lower()
        if name in BLOCKS:
            close()
        if name not in NESTED:
            continue
        if found[2]:
            # a stray end closes nothing; an end closes what is left open inside
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if at:
                close()
                del stack[at:]
        elif not found[4].endswith("/"):
            state = stack[-1][1]
            if state != OUT:
                if name in NEVER or (name == "header" and state != MAIN) or _noise(found[4], state == MAIN or name in ("article", "main")):
                    state = OUT
                elif name in ("article", "main"):
                    state = MAIN
            if state != stack[-1][1]:
                close()
            stack.append((name, state))
    close()
    return out


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return found[1].lower() if found else ""


def stream(found: list[tuple[int, str]]) -> tuple[list[str], list[bool]]:
    """Tokens outside the article, an empty one where the article stands between, and which of them are open."""
    tokens: list[str] = []
    open_: list[bool] = []
    for state, text in found:
        mine = [""] if state == MAIN else text.split()
        tokens += mine
        open_ += [state == OPEN] * len(mine)
    return tokens, open_


def suffixes(tokens: list[str]) -> list[tuple[int, bytes]]:
    """(position, code of the next RUN tokens) wherever RUN tokens follow; codes sort like strings over token codes."""
    codes = [zlib.crc32(t.encode("utf-8", "replace")).to_bytes(4, "big") for t in tokens]
    joined, gap = b"".join(codes), [i for i, t in enumerate(tokens) if not t]
    out, at = [], 0
    for end in [*gap, len(tokens)]:
        out += [(i, joined[4 * i : 4 * (i + RUN)]) for i in range(at, end - RUN + 1)]
        at = end + 1
    return out


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
    )


def suffix_array(pages: DataFrame) -> DataFrame:
    """(host, suffix, low, high) of all pages, sorted within ranges: low and high are the smallest and largest page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: dict[tuple[str, bytes], tuple[int, int]] = {}
            for page, url, text in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                page, host = NO_ID if page is None else page, host_of(url)
                for _, suffix in suffixes(stream(blocks(text or ""))[0]):
                    low, high = ends.get((host, suffix), (page, page))
                    ends[(host, suffix)] = min(low, page), max(high, page)
            columns = list(zip(*[(*k, *v) for k, v in ends.items()], strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "suffix", "low", "high"])

    found = _rows(pages).mapInArrow(run, "host string, suffix binary, low long, high long")
    return found.repartitionByRange("host", "suffix").sortWithinPartitions("host", "suffix")


def repeated(array: DataFrame) -> DataFrame:
    """(key) of the suffixes that distinct pages of a host share: equal neighbours of the suffix array."""
    keyed = array.groupBy("host", "suffix").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return keyed.filter("low < high").select(F.xxhash64("host", "suffix").alias("key"))


def covered(pages: DataFrame) -> DataFrame:
    """(row, places): positions in the streams of pages with open blocks where a repeated string starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, url, text in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                tokens, open_ = stream(blocks(text or ""))
                near = np.convolve(open_, np.ones(RUN, dtype=int))[RUN - 1 :] if any(open_) else []
                out += [(row, host_of(url), s, i) for i, s in suffixes(tokens) if len(near) and near[i]]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "host", "suffix", "place"])

    asked = checkpointed(_rows(pages).mapInArrow(run, "row long, host string, suffix binary, place int").withColumn("key", F.xxhash64("host", "suffix")).select("row", "key", "place"))
    facts = repeated(suffix_array(pages)).withColumn("found", F.lit(True))
    return salted_lookup(asked, "key", "row", facts).filter("found").groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("places"))


def main_text(page: str, places: list[int]) -> str:
    """Text of a page, without the open tokens that strings of RUN tokens from `places` cover."""
    found = blocks(page)
    tokens, open_ = stream(found)
    gone = np.zeros(len(tokens) + RUN, dtype=bool)
    for place in places:
        gone[place : place + RUN] = True
    if not any(state == MAIN for state, _ in found) and not any(o and not g for o, g in zip(open_, gone.tolist(), strict=False)):
        gone[:] = False
    out, at = [], 0
    for state, text in found:
        if state == MAIN:
            out.append(text)
            at += 1
            continue
        mine = text.split()
        if state == OPEN and (left := " ".join(t for i, t in enumerate(mine, at) if not gone[i])):
            out.append(left)
        at += len(mine)
    return " ".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", p or []) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])

    marks = checkpointed(covered(pages))
    size = marks.agg(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    marks = F.broadcast(marks) if size <= BROADCAST_PLACES else marks
    joined = _rows(pages).join(marks, "row", "left").select("page_id", "url", "html", "places")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
