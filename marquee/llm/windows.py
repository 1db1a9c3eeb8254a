"""Windows of bytes that occur more than once, over all texts.

Every window of ``window`` bytes has an anchor: the run of ``GRAM`` bytes in it with the
least digest, the leftmost of equals. The choice depends on the window's bytes alone, so
equal windows have equal anchors at equal distances. Neighbouring windows mostly share their
anchor, and a passage is what the windows of one anchor cover.

1. Passages are listed by their anchor's digest and their own, without their bytes.
   Anchors met once are dropped after a count. Equal passages are one, with the least
   and the largest unit they occur in.
2. The bytes of a passage are fetched once, if its anchor has other passages as well.
3. The passages of an anchor meet in a task, which builds suffix arrays over blocks of
   bounded size and marks the windows that occur elsewhere.
4. An anchor with more than ``MOST`` different passages is split: its windows are halved by
   their distance from the anchor, and the bytes that all windows of a half share are the
   new key. After as many halvings as needed, at most ``log2(window)``, a key is the window
   itself. So no task holds more than a bounded number of passages, and none is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, raw, record_batch, shipped
from marquee.llm.components import stored
from marquee.llm.suffixes import repeated_starts

GRAM = 32
#: Different passages of an anchor in one task, and the bytes of a suffix array's block.
MOST, BLOCK = 4096, 1 << 20
#: Window starts worked on at once, so that positions fit beside the digests.
STRETCH = 1 << 22

_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RANGES = "array<struct<start:int,end:int>>"


def _digests(text: bytes) -> np.ndarray:
    """A digest of every run of GRAM bytes."""
    n = len(text) - GRAM + 1
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    out = np.zeros(n, np.uint64)
    for k, prime in enumerate(_PRIMES):
        out += words[8 * k : 8 * k + n] * prime
        out ^= out >> np.uint64(29)
    out *= _PRIMES[1]
    return out ^ (out >> np.uint64(32))


def anchors(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each passage in order: first window's start, windows, the anchor's place in it, digest."""
    found = []
    width = window - GRAM + 1
    for start in range(0, len(text) - window + 1, STRETCH):
        part = text[start : start + STRETCH + window - 1]
        digest = _digests(part)
        n = len(digest)
        # The least of each run of ``width`` values: of the rest of one block, and of the next's start.
        key = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
        key[:n] = (digest & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
        blocks = key.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        rest = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(rest[: n - width + 1], ahead[width - 1 : n])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, len(place)])
        at = place[first]
        found.append((first + start, count, at - first, digest[at]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(column) for column in zip(*found))


def _list(rows: DataFrame, window: int) -> DataFrame:
    """A row for each passage of each text: rid, unit, hash, digest, start, windows, anchor."""
    import xxhash

    def work(batches):
        schema = pa.schema(
            [("rid", pa.binary()), ("unit", pa.int64()), ("hash", pa.int64()), ("digest", pa.binary()),
             ("start", pa.int32()), ("windows", pa.int32()), ("anchor", pa.int32())]
        )
        for batch in pieces(batches, "text"):
            rids, units, scopes = (batch.column(c).to_pylist() for c in ("rid", "unit", "scope"))
            columns = [[] for _ in schema]
            for rid, unit, scope, text in zip(rids, units, scopes, raw(batch)):
                if len(text) < window:
                    continue
                first, count, place, digest = anchors(text, window)
                salt = np.uint64((scope * 0x9E3779B97F4A7C15) % 2**64)
                names = ((digest ^ salt) * _PRIMES[0]).view(np.int64).tolist()
                first, count, place = first.tolist(), count.tolist(), place.tolist()
                columns[0] += [rid] * len(first)
                columns[1] += [unit] * len(first)
                columns[2] += names
                columns[3] += [
                    xxhash.xxh3_128_digest(text[s : s + n - 1 + window], seed=p) for s, n, p in zip(first, count, place)
                ]
                columns[4] += first
                columns[5] += count
                columns[6] += place
            yield record_batch(schema, *columns)

    return rows.transform(shipped).mapInArrow(
        work, "rid binary, unit long, hash long, digest binary, start int, windows int, anchor int"
    )


def _fetch(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``wanted`` (rid, start, windows, ...) with the bytes of each passage."""
    held = [c for c in wanted.columns if c != "rid"]
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct(*held)).alias("wanted"))
    texts = rows.select("rid", "text").join(lists, "rid").dropDuplicates(["rid"])
    one = texts.select(F.explode("wanted").alias("w"), "text").select("w.*", "text")
    passage = F.substring("text", F.col("start") + 1, F.col("windows") + (window - 1))
    return one.withColumn("bytes", passage).drop("text", "start")


def _mark(passages: DataFrame, window: int) -> DataFrame:
    """key, digest, ranges of (key, digest, windows, anchor, low, high, bytes), by key."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("ranges", _RANGES)])
    names = ("key", "digest", "windows", "anchor", "low", "high", "bytes")

    def solve(rows):
        keys, digests, windows, anchor, low, high, texts = zip(*rows)
        found = repeated_starts(list(texts), *(np.array(v, np.int64) for v in (anchor, windows, low, high)), window)
        ranges = [[{"start": a, "end": b} for a, b in each] for each in found]
        return record_batch(schema, list(keys), list(digests), ranges)

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in names)):
                if size > BLOCK and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield solve(held)

    spread = passages.select(*names).repartition("key").sortWithinPartitions("key")
    return spread.transform(shipped).mapInArrow(work, f"key long, digest binary, ranges {RANGES}")


def _halves(passages: DataFrame, window: int, level: int) -> DataFrame:
    """Each passage cut by its windows' distances from the anchor, in runs of 2 ** -level."""
    import xxhash

    size = 1 << max((window - GRAM).bit_length() - level, 0)
    names = ("hash", "parent", "first", "windows", "anchor", "low", "high", "bytes")
    schema = pa.schema(
        [("hash", pa.int64()), ("parent", pa.binary()), ("first", pa.int32()), ("windows", pa.int32()),
         ("anchor", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("bytes", pa.binary()),
         ("key", pa.int64()), ("digest", pa.binary())]
    )

    def work(batches):
        for batch in batches:
            out = []
            for owner, parent, first, windows, anchor, low, high, text in zip(
                *(batch.column(name).to_pylist() for name in names)
            ):
                for run in range((anchor - windows + 1) // size, anchor // size + 1):
                    # Windows at distances near to far from the anchor, those of this run.
                    near, far = run * size, run * size + size - 1
                    start, end = max(anchor - far, 0), min(anchor - near, windows - 1)
                    part = text[start : end + window]
                    core = text[anchor - near : anchor - far + window]
                    name = xxhash.xxh3_64_intdigest(core, seed=(owner * 1024 + run) % 2**64)
                    name -= (name >> 63) << 64
                    digest = xxhash.xxh3_128_digest(part, seed=anchor - start)
                    out.append((owner, parent, first + start, end - start + 1, anchor - start, low, high, part, name, digest))
            columns = list(zip(*out)) or [[] for _ in schema]
            yield record_batch(schema, *map(list, columns))

    kinds = "hash long, parent binary, first int, windows int, anchor int, low long, high long, bytes binary"
    return passages.select(*names).transform(shipped).mapInArrow(work, f"{kinds}, key long, digest binary")


def repeated(rows: DataFrame, window: int, by_unit: bool = False, most: int = MOST) -> DataFrame:
    """rid, ranges: ranges of starts of the windows of a text that occur elsewhere as well.

    ``rows`` has rid (binary, equal for equal rows only), unit (long, not null), scope
    (long; windows of different scopes are different) and text (binary). Elsewhere is any other
    place, or, ``by_unit``, a text of another unit. Texts without such windows are left out.
    """
    listed = stored(_list(rows, window), "passages")
    # Counts are written before they are joined: the join then reads two plain shuffles, of
    # which Spark splits the large partitions that a frequent anchor makes.
    several = listed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    listed = stored(listed.join(stored(several, "several"), "hash"), "anchored")
    low, high = F.min("unit"), F.max("unit")
    if not by_unit:
        # Two passages differ in their digest; one that occurs twice differs from itself.
        low = F.xxhash64("hash", "digest")
        high = low + F.when(F.count(F.lit(1)) > 1, 1).otherwise(0)
        low, high = F.shiftright(low, 1), F.shiftright(low, 1) + (high - low)
    passages = listed.groupBy("hash", "digest").agg(
        F.min(F.struct("rid", "start")).alias("at"),
        F.first("windows").alias("windows"),
        F.first("anchor").alias("anchor"),
        low.alias("low"),
        high.alias("high"),
    )
    passages = stored(passages, "different")
    sizes = passages.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), (F.min("low") < F.max("high")).alias("again")
    )
    sizes = stored(sizes.where("again").drop("again"), "sizes")
    passages = stored(passages.join(sizes, "hash"), "candidates")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("windows").alias("end")))
    # A passage within reach of two units by itself needs no comparison.
    done = passages.where("low < high").select("hash", "digest", whole.alias("ranges"))
    wanted = passages.where("n > 1").select(
        "at.rid", "at.start", "hash", "digest", "windows", "anchor", "low", "high", "n"
    )
    fetched = stored(_fetch(rows, wanted, window), "fetched")
    few = fetched.where(F.col("n") <= most).withColumnRenamed("hash", "key")
    marked = _mark(few, window).withColumnRenamed("key", "hash")
    open_ = fetched.where(F.col("n") > most).select(
        "hash", F.col("digest").alias("parent"), F.lit(0).alias("first"), "windows", "anchor", "low", "high", "bytes"
    )
    results = [done, marked]
    level = 0
    while not open_.isEmpty():
        level += 1
        parts = stored(_halves(open_, window, level), "halves")
        keys = parts.groupBy("key", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        keys = keys.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), (F.min("low") < F.max("high")).alias("again")
        )
        keys = stored(keys.where("again").drop("again"), "keys")
        parts = stored(parts.join(keys, "key"), "halves")
        alone = parts.where("n = 1").withColumn("ranges", whole)
        some = parts.where((F.col("n") > 1) & (F.col("n") <= most))
        different = some.groupBy("key", "digest").agg(
            F.first("windows").alias("windows"),
            F.first("anchor").alias("anchor"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.first("bytes").alias("bytes"),
        )
        some = some.join(_mark(different, window), ["key", "digest"])
        shift = F.transform(
            "ranges", lambda r: F.struct((r["start"] + F.col("first")).alias("start"), (r["end"] + F.col("first")).alias("end"))
        )
        results += [
            part.select("hash", F.col("parent").alias("digest"), shift.alias("ranges")) for part in (alone, some)
        ]
        open_ = parts.where(F.col("n") > most).drop("n", "key", "digest")
    found = results[0]
    for result in results[1:]:
        found = found.unionByName(result)
    found = found.where(F.size("ranges") > 0)
    back = listed.select("hash", "digest", "rid", "start").join(found, ["hash", "digest"])
    spans = back.select("rid", F.col("start").alias("first"), F.explode("ranges").alias("r")).select(
        "rid", (F.col("first") + F.col("r.start")).alias("start"), (F.col("first") + F.col("r.end")).alias("end")
    )
    return spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
