"""Long runs of symbols that repeat on distinct pages of a host.

A page's blocks are cut into symbols: a block's end ends one, and so does, inside a long
block, every place whose 32 bytes before have a digest that ends in zeros, so equal
text is cut alike wherever it stands. A symbol travels as a 64-bit digest, salted by its
host, with its size; the text itself is never shuffled.

1. Symbols met on one page only are dropped after a count. What is left of a page are runs.
2. A window is the shortest string of symbols from a place in a run that has ``length`` bytes.
   Its anchor is its least symbol. A passage is what the windows of one anchor cover; equal
   passages are one, with the least and the largest unit that hold them.
3. The different passages of an anchor meet in a task, which builds a suffix array over
   their symbols: a window's occurrences are neighbours there, and it repeats if they lie on distinct pages.
4. An anchor with more than ``most`` different passages is taken apart into its windows, which are
   counted by themselves. So no task holds more than a bounded number of passages, and none is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import record_batch, shipped
from marquee.llm.components import discard, stored
from marquee.llm.suffixes import suffix_array
from marquee.llm.windows import GRAM, _digests

#: Zero bits that end a symbol inside a block: it has some 128 bytes.
ZEROS = 7
MOST = 4096
#: Symbols of a suffix array, unless one anchor has more.
BATCH = 1 << 14

SYMBOL = "struct<digest:long,size:int,block:int,bytes:int,inside:boolean>"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def symbols_of(blocks: list[tuple[bytes, bool]], salt: int) -> list[dict]:
    """digest, size, block, bytes (of the block) and inside of each symbol of a page, in order."""
    import xxhash

    out = []
    for number, (text, inside) in enumerate(blocks):
        cuts = [0, len(text)]
        if len(text) > GRAM:
            ends = np.flatnonzero(_digests(text) >> np.uint64(64 - ZEROS) == 0) + GRAM
            cuts = [0, *ends[ends < len(text)].tolist(), len(text)]
        for start, end in zip(cuts, cuts[1:]):
            digest = xxhash.xxh3_64_intdigest(text[start:end], seed=salt % 2**64)
            digest -= (digest >> 63) << 64
            out.append({"digest": digest, "size": end - start, "block": number, "bytes": len(text), "inside": inside})
    return out


def windows_of(sizes: list[int], length: int) -> list[int]:
    """The end of the window from each place of a run, as far as there are windows."""
    out, end, total = [], 0, 0
    for start in range(len(sizes)):
        while total < length and end < len(sizes):
            total += sizes[end]
            end += 1
        if total < length:
            break
        out.append(end)
        total -= sizes[start]
    return out


def passages_of(digests: list[int], sizes: list[int], length: int) -> list[tuple[int, int, int]]:
    """First place, end and anchor's digest of each passage of a run."""
    out: list[list[int]] = []
    for start, end in enumerate(windows_of(sizes, length)):
        anchor = min(range(start, end), key=lambda i: (digests[i], i))
        if out and out[-1][3] == anchor:
            out[-1][1] = end
        else:
            out.append([start, end, digests[anchor], anchor])
    return [tuple(p[:3]) for p in out]


def repeated_windows(
    passages: list[list[int]], sizes: list[list[int]], low: np.ndarray, high: np.ndarray, length: int
) -> list[list[tuple[int, int]]]:
    """Of each passage, the windows (first place, end) that lie on distinct units, by a suffix array.

    The least of ``low`` and the largest of ``high`` over a window's passages tell.
    """
    values = np.unique(np.concatenate([np.asarray(p, np.int64) for p in passages]))
    text, owner, place = [], [], []
    for i, passage in enumerate(passages):
        text += [*(np.searchsorted(values, passage) + 1).tolist(), 0]
        owner += [i] * (len(passage) + 1)
        place += range(len(passage) + 1)
    order = suffix_array(np.array(text))
    owner, place = np.array(owner)[order], np.array(place)[order]
    # Symbols shared with the suffix before, by Kasai's rule.
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    shared, common = np.zeros(len(order), np.int64), 0
    following, ranks = order.tolist(), rank.tolist()
    for i in range(len(text)):
        if not ranks[i]:
            common = 0
            continue
        j = following[ranks[i] - 1]
        while i + common < len(text) and j + common < len(text) and text[i + common] == text[j + common] != 0:
            common += 1
        shared[ranks[i]] = common
        common = max(0, common - 1)
    width = np.zeros(len(order), np.int64)
    ends = [windows_of(s, length) for s in sizes]
    for at, (i, p) in enumerate(zip(owner.tolist(), place.tolist())):
        if p < len(ends[i]):
            width[at] = ends[i][p] - p
    out: list[list[tuple[int, int]]] = [[] for _ in passages]
    low, high = low[owner], high[owner]
    for w in np.unique(width[width > 0]).tolist():
        heads = np.flatnonzero(np.r_[True, shared[1:] < w])
        again = np.minimum.reduceat(low, heads) < np.maximum.reduceat(high, heads)
        hit = np.repeat(again, np.diff(np.r_[heads, len(order)])) & (width == w)
        for i, p in zip(owner[hit].tolist(), place[hit].tolist()):
            out[i].append((p, p + w))
    return [sorted(each) for each in out]


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """Ranges of the list in which places follow each other."""
    edges = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1] + 1), len(places)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _passages(lists: DataFrame, length: int) -> DataFrame:
    """key, digests, sizes, row, unit, at: a row for each passage of each page."""

    def work(batches):
        schema = pa.schema(
            [("key", pa.int64()), ("digests", _LONGS), ("sizes", _INTS), ("row", pa.int64()), ("unit", pa.int64()), ("at", pa.int32())]
        )
        for batch in batches:
            out = []
            for row, unit, symbols in zip(*(batch.column(c).to_pylist() for c in ("row", "unit", "symbols"))):
                places, digests, sizes = ([s[name] for s in symbols] for name in ("at", "digest", "size"))
                for a, b in _runs(places):
                    for start, end, key in passages_of(digests[a:b], sizes[a:b], length):
                        out.append((key, digests[a + start : a + end], sizes[a + start : a + end], row, unit, places[a + start]))
            yield record_batch(schema, *(map(list, zip(*out)) if out else [[] for _ in schema]))

    return lists.transform(shipped).mapInArrow(work, "key long, digests array<long>, sizes array<int>, row long, unit long, at int")


def _by_suffix_array(different: DataFrame, length: int) -> DataFrame:
    """key, digests, found (start, end) of passages (key, digests, sizes, low, high) of each key."""
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def solve(held):
        keys, digests, sizes, low, high = zip(*held)
        found = repeated_windows(list(digests), list(sizes), np.array(low), np.array(high), length)
        schema = pa.schema([("key", pa.int64()), ("digests", _LONGS), ("found", pairs)])
        return record_batch(schema, list(keys), list(digests), [[{"start": a, "end": b} for a, b in each] for each in found])

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "digests", "sizes", "low", "high"))):
                if size > BATCH and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield solve(held)

    spread = different.select("key", "digests", "sizes", "low", "high").repartition("key").sortWithinPartitions("key")
    return spread.transform(shipped).mapInArrow(work, "key long, digests array<long>, found array<struct<start:int,end:int>>")


def _by_window(different: DataFrame, length: int, held: list[str]) -> DataFrame:
    """The same for keys with many passages: each window counted by itself."""

    def work(batches):
        schema = pa.schema([("start", pa.int32()), ("end", pa.int32()), *((n, pa.int64()) for n in ("key", "low", "high")), ("digests", _LONGS)])
        for batch in batches:
            out = []
            for key, digests, sizes, low, high in zip(*(batch.column(c).to_pylist() for c in ("key", "digests", "sizes", "low", "high"))):
                out += [(start, end, key, low, high, digests) for start, end in enumerate(windows_of(sizes, length))]
            yield record_batch(schema, *(map(list, zip(*out)) if out else [[] for _ in schema]))

    kinds = "start int, end int, key long, low long, high long, digests array<long>"
    windows = different.select("key", "digests", "sizes", "low", "high").transform(shipped).mapInArrow(work, kinds)
    windows = stored(windows.withColumn("window", F.slice("digests", F.col("start") + 1, F.col("end") - F.col("start"))), "windows", held)
    again = windows.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
    hit = windows.join(again.select("window"), "window", "left_semi")
    return hit.groupBy("key", "digests").agg(F.collect_set(F.struct("start", "end")).alias("found"))


def covered(lists: DataFrame, length: int, most: int = MOST) -> DataFrame:
    """row, ranges: places (start, end) that windows cover which repeat on distinct units.

    ``lists`` has row, unit and symbols: at, digest and size of a page's symbols that other units have too, in order.
    """
    held: list[str] = []
    passages = stored(_passages(lists.select("row", "unit", "symbols"), length), "passages", held)
    different = passages.groupBy("key", "digests").agg(
        F.first("sizes").alias("sizes"), F.min("unit").alias("low"), F.max("unit").alias("high")
    )
    different = stored(different, "different", held)
    keys = different.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("least"), F.max("high").alias("most"))
    keys = stored(keys.where("least < most").select("key", "n"), "keys", held)
    sized = different.join(keys, "key")
    found = _by_suffix_array(sized.where(F.col("n") <= most), length).unionByName(
        _by_window(sized.where(F.col("n") > most), length, held)
    )
    found = stored(found.where(F.size("found") > 0), "found", held)
    back = passages.select("key", "digests", "row", "at").join(found, ["key", "digests"])
    ranges = back.select("row", "at", F.explode("found").alias("f")).select(
        "row", F.struct((F.col("at") + F.col("f.start")).alias("start"), (F.col("at") + F.col("f.end")).alias("end")).alias("range")
    )
    ranges = stored(ranges.groupBy("row").agg(F.collect_set("range").alias("ranges")), "ranges")
    discard(lists.sparkSession, held)
    return ranges
