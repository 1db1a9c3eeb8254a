"""Near-duplicates by SimHash fingerprints, found with vantage-point trees.

A fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 values of a
text's word shingles. Fingerprints link at ``DISTANCE`` or fewer differing bits, and a class
is what links connect.

Equal fingerprints are one point. Up to ``TREE`` points are one shard. More are dealt to shards
that overlap: of ``blocks`` runs of bits, two linked points agree in all but ``DISTANCE`` at
least, so there is a shard for each choice of runs and their value, and every link lies inside
one. (Shards cut by distance from a vantage point alone would overlap too far: random
fingerprints lie at 32 +- 4 bits from any point, so that a median cut copies some 36 % of the
points, and cutting 15 million down to thousands would hold each point over 80 times.) Runs are
only so long that a shard has at least half of ``TREE`` points, were the bits even; there are
more of them where that would exceed ``EXPECTED``. A shard with more than ``SHARD`` points is cut into
rings by the distance from a vantage point, and each ring also gets the points of the ring before.

Inside a shard a vantage-point tree finds the pairs: points are split at the median distance
from a vantage point, and a branch is visited only if the triangle inequality allows a link
across the split. All points in reach of a vantage point are one class at once, so a dense
group is never compared pair by pair. A shard emits a forest, less links than points, and
the classes come from joins (``components``).

A text without words has fingerprint zero and is linked like any other; null counts as
empty. Rows with a null key take part and get the least key of their class, null if it has
none. Repeated rows share a class. Other columns are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, raw, record_batch, shipped
from marquee.llm.components import components, stored

BITS = 64
DISTANCE = 4
WORDS = 4
SEED = 42
#: Points for whose tree the length of runs is chosen, most points expected in a shard when the
#: number of runs is chosen, and the most before rings.
TREE, EXPECTED, SHARD = 1024, 4096, 1 << 16
#: Points compared pair by pair.
LEAF = 64

_SPREAD = np.zeros(256, np.uint64)  # a byte's bits, highest first, as eight counters
for _byte in range(256):
    _SPREAD[_byte] = int.from_bytes(bytes(_byte >> (7 - i) & 1 for i in range(8)), "little")


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of each run of ``words`` words, joined by spaces; of all words if they are fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.lower().split()  # bytes: A-Z alone, and ASCII white space
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [digest(joined, SEED)]
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces[: len(found) - words] + 1).tolist()]
    ends = [*spaces[words - 1 :].tolist(), len(joined)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends)]


def fingerprint(values: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of texts from their shingles' hashes."""
    counts = np.array([len(v) for v in values])
    out = np.zeros(len(values), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    size = counts[some]
    lanes = np.concatenate([values[i] for i in some]).astype(">u8").view(np.uint8).reshape(-1, 8)
    # 255 values fit into counters of a byte.
    runs = -(-size // 255)
    first = np.repeat(np.cumsum(size) - size, runs)
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    sums = np.add.reduceat(_SPREAD[lanes], first + 255 * nth, axis=0)
    by_bit = sums.view(np.uint8).reshape(len(sums), BITS)
    totals = np.add.reduceat(by_bit, np.cumsum(runs) - runs, axis=0, dtype=np.int64)
    bits = np.packbits(2 * totals > size[:, None], axis=1)
    out[some] = np.ascontiguousarray(bits).view(">u8").ravel()
    return out


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, fp: the fingerprint's 64 bits as a long."""
    kind = documents.schema[key].dataType.simpleString()

    def work(batches):
        for batch in pieces(batches, text):
            values = [np.array(shingle_hashes(value, words), np.uint64) for value in raw(batch, text)]
            schema = pa.schema([batch.schema.field(key), ("fp", pa.int64())])
            yield record_batch(schema, batch.column(key), fingerprint(values).view(np.int64))

    return documents.select(key, text).transform(shipped).mapInArrow(work, f"`{key}` {kind}, fp long")


def masks(points: int) -> list[int]:
    """The bits on which the points of a shard agree, for each choice of runs."""
    bits = (max(points - 1, 0) // TREE).bit_length()
    if not bits:
        return [0]
    for blocks in range(DISTANCE + 1, 17):
        agreed, room = blocks - DISTANCE, BITS // blocks
        if points <= EXPECTED << agreed * room or blocks == 16:
            width = min(max(bits // agreed, 1), room)
            runs = [(1 << BITS * i // blocks + width) - (1 << BITS * i // blocks) for i in range(blocks)]
            return [sum(chosen) for chosen in combinations(runs, agreed)]
    raise AssertionError


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Forest:
    """Classes of a shard's points."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.parent = list(range(len(points)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, one: int, others: list[int]) -> None:
        a = self.root(one)
        for other in others:
            b = self.root(other)
            if a != b:
                a, b = min(a, b), max(a, b)
                self.parent[b] = a

    def distance(self, i: int, members: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.points[members] ^ self.points[i])

    def compare(self, ones: np.ndarray, others: np.ndarray) -> None:
        """Link all pairs within DISTANCE, a block at a time."""
        for start in range(0, len(ones), 512):
            block = ones[start : start + 512]
            for begin in range(0, len(others), 4096):
                right = others[begin : begin + 4096]
                near = np.bitwise_count(self.points[block][:, None] ^ self.points[right]) <= DISTANCE
                for i in np.flatnonzero(near.any(1)):
                    self.join(int(block[i]), right[near[i]].tolist())

    def inside(self, members: np.ndarray) -> None:
        """Link all pairs of members."""
        todo = [members]
        while todo:
            members = todo.pop()
            if len(members) <= LEAF:
                self.compare(members, members)
                continue
            vantage, rest = int(members[0]), members[1:]
            d = self.distance(vantage, rest)
            ball = d <= DISTANCE
            self.join(vantage, rest[ball].tolist())
            if ball.sum() * 10 > len(rest):
                # One class already; its links outwards end at most twice as far.
                self.across(rest[ball], rest[(d > DISTANCE) & (d <= 2 * DISTANCE)])
                todo.append(rest[~ball])
                continue
            middle = int(np.median(d))
            inner = d <= middle
            if inner.all():
                self.compare(rest, rest)
                continue
            self.across(rest[inner & (d > middle - DISTANCE)], rest[~inner & (d <= middle + DISTANCE)])
            todo += [rest[inner], rest[~inner]]

    def across(self, ones: np.ndarray, others: np.ndarray) -> None:
        """Link all pairs of one member of each."""
        todo = [(ones, others)]
        while todo:
            ones, others = todo.pop()
            if not len(ones) or not len(others):
                continue
            if len(ones) < len(others):
                ones, others = others, ones
            if len(ones) * len(others) <= 1 << 18:
                self.compare(others, ones)
                continue
            vantage = int(ones[0])
            a, b = self.distance(vantage, ones), self.distance(vantage, others)
            middle = int(np.median(a))
            inner, low, high = a <= middle, b <= middle + DISTANCE, b > middle - DISTANCE
            work = int(inner.sum()) * int(low.sum()) + int((~inner).sum()) * int(high.sum())
            if inner.all() or work > 0.9 * len(ones) * len(others):
                self.compare(others, ones)
            else:
                todo += [(ones[inner], others[low]), (ones[~inner], others[high])]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.root(i) for i in range(len(self.points))])
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return self.points[roots[moved]], self.points[moved]


def shard_links(shard: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within each shard; equal shards are adjacent."""
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(shard)])
    found = []
    small = np.repeat(sizes <= LEAF, sizes)
    some, names = points[small], shard[small]
    for step in range(1, int(sizes[sizes <= LEAF].max(initial=0))):
        near = (names[step:] == names[:-step]) & (np.bitwise_count(some[step:] ^ some[:-step]) <= DISTANCE)
        found.append((some[:-step][near], some[step:][near]))
    for start, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        forest = Forest(points[start : start + size])
        forest.inside(np.arange(size))
        found.append(forest.links())
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _links(batches):
    """Batches of (shard, fp) in order of shard; a shard is held whole, eight bytes a point."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    for batch in batches:
        new = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in ("shard", "fp")])
        held.append(new)
        if not new.shape[1] or (held[0].shape[1] and held[0][0, 0] == new[0, -1]):
            continue
        rows = np.concatenate(held, axis=1)
        whole = int(np.searchsorted(rows[0], rows[0, -1]))
        a, b = shard_links(rows[0, :whole], rows[1, :whole].view(np.uint64))
        held = [rows[:, whole:]]
        yield record_batch(schema, a.view(np.int64), b.view(np.int64))
    rows = np.concatenate(held, axis=1)
    a, b = shard_links(rows[0], rows[1].view(np.uint64))
    yield record_batch(schema, a.view(np.int64), b.view(np.int64))


def sharded(points: DataFrame, chosen: list[int], most: int = SHARD) -> DataFrame:
    """shard, fp: every point in each of its shards; shards over ``most`` points cut into rings."""
    parts = [
        F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value"))
        for i, mask in enumerate(chosen)
    ]
    rows = points.select("fp", F.explode(F.array(*parts)).alias("part")).select("fp", "part.*")
    large = (
        rows.groupBy("i", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("vantage"))
        .where(F.col("n") > most)
        .drop("n")
    )
    ring = F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))) / (DISTANCE + 1)).cast("int")
    rings = F.when(F.col("vantage").isNull(), F.array(F.lit(0))).otherwise(F.array(ring, ring + 1))
    cut = rows.join(large, ["i", "value"], "left").select("i", "value", "fp", F.explode(rings).alias("ring"))
    return cut.select(F.xxhash64("i", "value", "ring").alias("shard"), "fp")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, fp, component: each row's fingerprint and the least key of its class."""
    rows = stored(fingerprints(documents, key, text, words), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min(key).alias("first")), "points")
    shards = sharded(points, masks(points.count()))
    shards = shards.repartition("shard").sortWithinPartitions("shard", "fp")
    classes = components(shards.transform(shipped).mapInArrow(_links, "a long, b long"))
    named = points.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component").select("fp", F.col("least").alias("component"))
    return rows.join(named, "fp").select(key, "fp", "component")


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each class, all columns as they are: the least by key, null last, and digest
    of the text; of rows equal in both any one."""
    name = F.struct(
        F.col(key).isNull().alias("absent"),
        F.col(key).alias("key"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"),
    )
    classes = near_duplicates(documents.select(name.alias("name"), text), "name", text, words)
    kept = classes.select(F.col("component").alias("kept")).distinct()
    rows = documents.select(F.struct("*").alias("row"), name.alias("name"))
    same = (rows["name.digest"] == kept["kept.digest"]) & rows["name.key"].eqNullSafe(kept["kept.key"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["name"]).select("row.*")
