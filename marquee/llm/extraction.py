"""The main text of web pages, told from what a host repeats.

A page becomes blocks of text in page order. Elements that never hold the article (menus,
footers, sidebars, notices, adverts, forms, scripts, comments of readers, hidden ones) give
none: they are told by their tags, and containers by whole class names and ids; headings and inline
elements are text whatever their names. The blocks of a page, cut into symbols, are its
stream. Over the streams of a host, suffix arrays find strings of ``LENGTH`` bytes and more that repeat
on distinct pages (``streams``). A block is boilerplate if, for ``COVERED`` of its bytes,

* it lies outside an article, and such strings cover it; or
* its symbols stand on ``SHARE`` of the host's pages and at least ``PAGES`` of them, however short it is.

The rest, the unique runs, is the text: of a page with an article element (or a main one) what lies in
it, of another page all. A repeated passage of an article alone is no boilerplate: copies
of a page, and passages that articles share, stay.

Character references are decoded, white space in a block becomes one space, blocks are
joined by an empty line. Null html counts as empty and gives an empty text. Pages without a
host in their address share one scope. Repeated rows are one page. Null ids take part; other
columns are left out.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, record_batch, shipped, texts
from marquee.llm.components import discard, stored
from marquee.llm.streams import SYMBOL, covered, symbols_of
from marquee.llm.suffix_dedup import row_id

LENGTH = 200
COVERED, SHARE, PAGES = 0.8, 0.5, 5

_RAW = "script|style|noscript|template|iframe|object|svg|math|canvas|textarea|title|xmp"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([a-z:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_DROPPED = frozenset("nav footer aside form button select option dialog menu head audio video label".split())
_DROPPED_INSIDE = _DROPPED - {"button", "label"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_CLOSED_BY_BLOCK = frozenset({"p"})
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices alert "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist replies disqus popup modal overlay widget pagination pager".split()
)
_NAMES_OUTSIDE = _NAMES | {"header", "topbar", "author", "byline", "toolbar"}
#: What class names and ids of containers add to these names.
_CARRIERS = frozenset(
    "area bar block bottom box button buttons col column container content global group holder icons inline inner item items left "
    "link links list main mobile outer page post posts primary reader right row secondary section site slot sticky story "
    "title top unit user wrap wrapper zone".split()
)
_CONTAINERS = frozenset("article center dd details div dl dt fieldset figure li ol section table td tr ul".split())
_SIZE = re.compile("[0-9]+(?:x[0-9]+)?")
_BLOCK = pa.struct([("text", pa.large_string()), ("inside", pa.bool_())])


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a whole class name or id says what never belongs to an article."""
    words = [word for word in re.split(r"[-_]+", value) if word and not _SIZE.fullmatch(word)]
    return not names.isdisjoint(words) and (names | _CARRIERS).issuperset(words)


def _dropped(name: str, rest: str, inside: bool) -> bool:
    if name in (_DROPPED_INSIDE if inside else _DROPPED) or (name == "header" and not inside):
        return True
    if not rest.strip(" /\n\t"):
        return False
    names = _NAMES if inside else _NAMES_OUTSIDE
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        # A paragraph's id marks a place in the text; its class, like a container's, says what it is.
        if (key == "class" and (name in _CONTAINERS or name == "p")) or (key == "id" and name in _CONTAINERS - {"article"}):
            if any(_named(part, names) for part in value.split()):
                return True
        elif key == "role" and value in _ROLES:
            return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks_of(html: str) -> list[tuple[str, bool]]:
    """Text blocks in page order, and whether each lies in an article or main element."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # name, dropped, inside

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text and not stack[-1][1]:
                out.append((text, stack[-1][2]))

    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at and not stack[-1][1]:
            parts.append(html[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name in _INLINE and name not in _VOID and not token["rest"] and name != stack[-1][0]:
            continue
        if name in _VOID:
            if name == "br":
                parts.append(" ")
            elif name not in _INLINE:
                flush()
            continue
        if token["close"]:
            if name not in _INLINE:
                flush()
            names = [entry[0] for entry in stack]
            if name in names:
                if names[::-1].index(name) < len(stack) - 1:
                    cut = len(names) - 1 - names[::-1].index(name)
                    if stack[-1][1] != stack[cut - 1][1]:
                        flush()
                    del stack[cut:]
            continue
        _, dropped, inside = stack[-1]
        if name not in _INLINE:
            flush()
            if stack[-1][0] in _CLOSED_BY_BLOCK:
                stack.pop()
                _, dropped, inside = stack[-1]
        if token["rest"].endswith("/") and name not in ("article", "main", "div", "p", "section"):
            continue
        gone = dropped or _dropped(name, token["rest"], inside)
        if gone and not dropped:
            flush()
        if name in _INLINE and not gone:
            continue
        stack.append((name, gone, inside or name in ("article", "main")))
    if not stack[-1][1]:
        parts.append(html[at:])
    flush()
    return out


def host_of(url: str) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(F.lower(F.coalesce(found, F.lit(""))), r"^www\.|\.$", "")


def parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """unit, host, key, url, blocks: a row for each row of pages."""
    rid = row_id(key, html)
    rows = pages.select(
        F.xxhash64(F.coalesce(F.col(key).cast("string").cast("binary"), rid)).alias("unit"),
        host_of(url).alias("host"),
        F.col(key).alias("key"),
        F.col(url).alias("url"),
        F.col(html).alias("html"),
    )

    def work(batches):
        for batch in pieces(batches, "html"):
            found = [[{"text": t, "inside": i} for t, i in blocks_of(page)] for page in texts(batch, "html")]
            fields = [batch.schema.field(c) for c in ("unit", "host", "key", "url")]
            schema = pa.schema([*fields, ("blocks", pa.list_(_BLOCK))])
            yield record_batch(schema, *(batch.column(f.name) for f in fields), found)

    kind, address = rows.schema["key"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()
    return rows.transform(shipped).mapInArrow(
        work, f"unit long, host string, key {kind}, url {address}, blocks array<struct<text:string,inside:boolean>>"
    )


def _streams(rows: DataFrame) -> DataFrame:
    """row, unit, scope, symbols of each page."""
    symbol = pa.struct([("digest", pa.int64()), ("size", pa.int32()), ("block", pa.int32()), ("bytes", pa.int32()), ("inside", pa.bool_())])

    def work(batches):
        for batch in batches:
            scopes, blocks = (batch.column(c).to_pylist() for c in ("scope", "blocks"))
            found = [symbols_of([(b["text"].encode(), b["inside"]) for b in page], scope) for scope, page in zip(scopes, blocks)]
            fields = [batch.schema.field(c) for c in ("row", "unit", "scope")]
            schema = pa.schema([*fields, ("symbols", pa.list_(symbol))])
            yield record_batch(schema, *(batch.column(f.name) for f in fields), found)

    named = rows.select("row", "unit", F.xxhash64("host").alias("scope"), "blocks")
    return named.transform(shipped).mapInArrow(work, f"row long, unit long, scope long, symbols array<{SYMBOL}>")


def _judged(pages: DataFrame) -> DataFrame:
    """row, gone: the numbers of the blocks that are boilerplate.

    ``pages`` has row, symbols (with n, the units that have each), ranges and pages (of the host).
    """

    def gone(symbols, ranges, count):
        common = max(PAGES, SHARE * count)
        inside_range = {place for r in ranges or () for place in range(r["start"], r["end"])}
        blocks: dict[int, list[int]] = {}
        for s in symbols:
            block = blocks.setdefault(s["block"], [s["bytes"], 0])
            if s["n"] >= common or (not s["inside"] and s["at"] in inside_range):
                block[1] += s["size"]
        return sorted(i for i, (size, hit) in blocks.items() if hit and hit >= COVERED * size)

    def work(batches):
        schema = pa.schema([("row", pa.int64()), ("gone", pa.list_(pa.int32()))])
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("row", "symbols", "ranges", "pages"))
            out = [(row, found) for row, *rest in zip(*columns) if (found := gone(*rest))]
            yield record_batch(schema, *(map(list, zip(*out)) if out else [[], []]))

    return pages.select("row", "symbols", "ranges", "pages").transform(shipped).mapInArrow(work, "row long, gone array<int>")


def boilerplate(rows: DataFrame, length: int = LENGTH, **most) -> DataFrame:
    """row, gone: the numbers of the blocks of a page (row, unit, host, blocks) that are boilerplate."""
    held: list[str] = []
    pages = stored(_streams(rows), "streams", held, compression="zstd")
    # Two numbers carry what a symbol has beside its digest, as every symbol is shuffled.
    place = F.shiftleft(F.col("at").cast("long"), 32) + F.col("s.size")
    block = F.shiftleft(F.col("s.block").cast("long"), 32) + 2 * F.col("s.bytes") + F.col("s.inside").cast("int")
    each = pages.select("row", "unit", F.posexplode("symbols").alias("at", "s"))
    counts = each.select("s.digest", "unit").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    # Written, so that Spark knows how few they are.
    counts = stored(counts.where("n > 1"), "counts", held)
    lists = (
        each.select("row", "s.digest", place.alias("place"), block.alias("block"))
        .join(counts, "digest")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("place", "digest", "block", "n"))).alias("packed"))
    )

    def unpacked(s):
        low = lambda value: value.bitwiseAND(F.lit((1 << 32) - 1))
        return F.struct(
            F.shiftright(s["place"], 32).cast("int").alias("at"),
            s["digest"].alias("digest"),
            low(s["place"]).cast("int").alias("size"),
            F.shiftright(s["block"], 32).cast("int").alias("block"),
            F.shiftright(low(s["block"]), 1).cast("int").alias("bytes"),
            (low(s["block"]) % 2 == 1).alias("inside"),
            s["n"].alias("n"),
        )

    lists = lists.join(pages.select("row", "unit", "scope"), "row")
    lists = stored(lists.select("row", "unit", "scope", F.transform("packed", unpacked).alias("symbols")), "lists", held)
    ranges = covered(lists, length, **most)
    hosts = pages.select("scope", "unit").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("pages"))
    found = stored(_judged(lists.join(ranges, "row", "left").join(hosts, "scope")), "boilerplate")
    discard(rows.sparkSession, held)
    return found


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", length: int = LENGTH, **most
) -> DataFrame:
    """key, url, text, n_chars, n_boilerplate (blocks dropped as repeated)."""
    rows = stored(parsed(pages, key, url, html).select(F.monotonically_increasing_id().alias("row"), "*"), "blocks", compression="zstd")
    joined = rows.join(boilerplate(rows, length, **most), "row", "left")
    numbered = F.transform("blocks", lambda b, i: F.struct(b["text"].alias("text"), b["inside"].alias("inside"), i.alias("i")))
    left = F.filter(numbered, lambda b: F.col("gone").isNull() | ~F.array_contains("gone", b["i"]))
    article = F.exists("blocks", lambda b: b["inside"])
    main = F.filter("left", lambda b: b["inside"] | ~F.col("article"))
    text = F.array_join(F.transform(main, lambda b: b["text"]), "\n\n")
    return joined.select("key", "url", "gone", left.alias("left"), article.alias("article")).select(
        F.col("key").alias(key),
        F.col("url").alias(url),
        text.alias("text"),
        F.length(text).cast("long").alias("n_chars"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_boilerplate"),
    )


__all__ = ["blocks_of", "boilerplate", "extract", "host_of"]
