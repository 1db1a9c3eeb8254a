"""Near-duplicate vectors by NN-descent, linked at a cosine threshold.

Equal vectors are one node with a count. A first neighbour graph comes from random
hyperplanes: nodes with equal signs in one of the tables are compared. There are as many
tables as a pair at the threshold needs to meet in one with the chance ``MET``, ``TABLES`` at
least, and all pairs of nodes with equal signs are compared, however many. Then the graph
is refined: the neighbours of a node, in either direction, are compared with each other, if one
of the two entries is new since the last round, and each keeps its ``LIST`` best, whatever
their cosine. A task gives only pairs that the list of an end would take. Where a list is full
of links it is saturated: it may hide more of them, so it is allowed twice as many each round.
Rounds end when hardly a link is new.

Links connect nodes to classes (``components``). A list full of closer links may not hold the
only link to another class, so classes do not come from the lists: whatever is compared, in a
table or around a node, also gives who is of one class by the links found there, less rows than
nodes. Every link of a node lies inside its class, so links are counted there, a block of a
class against a block: no list limits the count, and no pair becomes a row. A class of any size
is spread over many tasks.

The classes are audited: of the nodes in large classes (over ``LIST`` nodes), in small ones and
in none each, about ``AUDIT`` or the square root of all if that is more, chosen by a digest,
are compared with all nodes, which are dealt to parts that each get the sample. Recall is the
mean, over nodes that have links, of the share of them inside the node's class; the lesser of
that in large classes and that of the other nodes counts. While it is under ``RECALL``, further
tables and rounds follow, ``ATTEMPTS`` in all, and then the job fails with the recall reached:
no result has less.

Vectors that are null, zero, of another length than the first in order of the key, or hold
null or non-finite components link with nothing, nor do rows with a null key; such rows are
a class of their own. Repeated rows are copies of each other and count as such. Other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.arrow import record_batch, shipped
from marquee.llm.components import components, discard, stored

THRESHOLD = 0.95
#: Least tables of hyperplanes, nodes expected with equal signs, and nodes compared at once.
TABLES, EXPECTED, BLOCK = 16, 32, 512
#: Chance that a pair at the threshold has equal signs in one of the tables.
MET = 0.99
#: Neighbours listed.
LIST = 16
ROUNDS = 4
AUDIT, RECALL, ATTEMPTS = 256, 0.99, 6
#: Nodes of a part that the audit's sample is compared with.
PART = 1 << 16
#: Nodes of a class in one block when links are counted.
COUNTED = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _plain(vectors: DataFrame, vector: str) -> Column:
    """The vector with one kind of zero, floats as they are and other numbers as doubles."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    return F.transform(vector, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))


def nodes_of(vectors: DataFrame, key: str, vector: str, salt: int = 0) -> DataFrame:
    """node, vec, copies: the usable vectors, each once."""
    usable = vectors.where(
        F.col(key).isNotNull()
        & F.col(vector).isNotNull()
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vector, lambda x: x != 0)
    ).withColumn("vec", _plain(vectors, vector))
    length = usable.groupBy().agg(F.min_by(F.size("vec"), F.col(key)).alias("n")).first()
    usable = usable.where(F.size("vec") == ((length.n if length else 0) or 0))
    return usable.groupBy("vec").agg(F.count(F.lit(1)).alias("copies")).select(
        F.xxhash64("vec", F.lit(salt)).alias("node"), "vec", "copies"
    )


def groups(batches, name: str, *columns: str) -> Iterator[tuple]:
    """Runs of rows with one value of ``name`` as arrays, from batches in its order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(name).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
        if held and held[-1].column(name)[0].as_py() != names[0]:
            yield _joined(held, columns)
            held = []
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
            held.append(batch.slice(start, end - start))
            if end < len(names):
                yield _joined(held, columns)
                held = []
    if held:
        yield _joined(held, columns)


def _joined(held: list[pa.RecordBatch], columns: tuple[str, ...]) -> tuple:
    table = pa.Table.from_batches(held).combine_chunks()
    return tuple(table.column(c).chunk(0) for c in columns)


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cos", pa.float64())])


def _classes(linked: np.ndarray) -> np.ndarray:
    """The least index that each can reach."""
    least = np.arange(len(linked))
    while True:
        near = np.where(linked, least, len(least)).min(1)
        found = np.minimum(least, near)
        found = found[found]
        if (found == least).all():
            return least
        least = found


def _compare(most: int):
    """Of each block the pairs that an end's list may take, at most ``most`` from a node.

    A pair of two entries that are not fresh has met before. Rows without a cosine say that
    two nodes are of one class.
    """

    def work(batches):
        held, size = [], 0
        for node, vec, fresh, bar in groups(batches, "block", "node", "vec", "fresh", "bar"):
            name, first = np.unique(node.to_numpy(zero_copy_only=False), return_index=True)
            unit = _matrix(vec)[first]
            old = ~fresh.to_numpy(zero_copy_only=False)[first]
            cos = unit @ unit.T
            np.fill_diagonal(cos, -2.0)
            linked = cos >= THRESHOLD
            if linked.any():
                least = _classes(linked)
                moved = np.flatnonzero(least != np.arange(len(name)))
                held.append((name[least[moved]], name[moved], np.full(len(moved), np.nan)))
                size += len(moved)
            cos[np.ix_(old, old)] = -2.0
            cos[cos < bar.to_numpy(zero_copy_only=False)[first][:, None]] = -2.0
            if len(name) > most:
                v = np.argpartition(-cos, most, axis=1)[:, :most].ravel()
                u = np.repeat(np.arange(len(name)), most)
                taken = cos[u, v] > -2.0
                u, v = u[taken], v[taken]
            else:
                u, v = np.nonzero(cos > -2.0)
            held.append((name[u], name[v], cos[u, v]))
            size += len(u)
            if size > 100_000 or len(held) > 1000:
                yield pairs(held)
                held, size = [], 0
        if held:
            yield pairs(held)

    def pairs(held):
        u, v, cos = map(np.concatenate, zip(*held))
        return record_batch(_PAIRS, u, v, pa.array(cos, mask=np.isnan(cos)))

    return work


def _blocks(rows: DataFrame, name: str, most: int, whole: bool = False, held: list[str] | None = None) -> DataFrame:
    """``rows`` dealt into blocks of nodes with one ``name``, those of many cut by a digest.

    ``whole``: two parts of a name are a block each, so that all its nodes meet.
    """
    rows = stored(rows, "members", held)
    # Written, so that Spark can split the shuffle of a frequent name in the join.
    sizes = stored(rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes", held)
    if not whole:
        part = F.pmod(F.xxhash64("node", name), F.ceil(F.col("n") / most).cast("long"))
        return rows.join(sizes, name).withColumn("block", F.xxhash64(name, part)).drop("n", name)
    parts = F.when(F.col("n") <= most, F.lit(1)).otherwise(F.ceil(2 * F.col("n") / most)).cast("long")
    rows = rows.join(sizes, name).withColumn("parts", parts)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", name), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.withColumn("other", other).where("part <> other OR parts = 1")
    block = F.xxhash64(name, F.least("part", "other"), F.greatest("part", "other"))
    return rows.withColumn("block", block).drop("n", name, "parts", "part", "other")


def _solved(rows: DataFrame, most: int) -> DataFrame:
    spread = rows.select("block", "node", "vec", "fresh", "bar").repartition("block").sortWithinPartitions("block")
    return spread.transform(shipped).mapInArrow(_compare(most), "u long, v long, cos double")


def tables(bits: int) -> int:
    """Tables in which a pair at the threshold has ``bits`` equal signs once, with chance ``MET``."""
    equal = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    return max(TABLES, int(np.ceil(np.log1p(-MET) / np.log1p(-equal))))


def by_signs(nodes: DataFrame, count: int, attempt: int, held: list[str] | None = None) -> DataFrame:
    """Pairs of nodes with equal signs in one of the tables, and who is of one class."""
    bits = int(np.ceil(np.log2(max(count / EXPECTED, 1)))) + 1
    turns = tables(bits)

    def work(batches):
        schema = pa.schema([("node", pa.int64()), ("sides", pa.list_(pa.int64()))])
        planes = None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                unit = _matrix(some.column("vec"))
                if planes is None:
                    planes = np.random.default_rng([7, attempt]).normal(size=(unit.shape[1], turns * bits))
                signs = (unit @ planes > 0).reshape(len(unit), turns, bits)
                sides = signs @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(turns) << bits)
                yield record_batch(schema, some.column("node"), sides.tolist())

    sides = nodes.select("node", "vec").transform(shipped).mapInArrow(work, "node long, sides array<long>")
    rows = sides.select("node", F.explode("sides").alias("side"))
    known = nodes.select("node", "vec", F.lit(True).alias("fresh"), F.lit(-2.0).alias("bar"))
    return _solved(_blocks(rows, "side", BLOCK, whole=True, held=held).join(known, "node"), LIST)


def best(pairs: DataFrame, turn: int) -> DataFrame:
    """Each node's list: its LIST best, or of links alone as many more as ``turn`` allows.

    An entry is fresh if no row of the pair is ``old``.
    """
    old = F.col("old") if "old" in pairs.columns else F.lit(False)
    rows = pairs.where("cos IS NOT NULL").groupBy("u", "v").agg(F.max("cos").alias("cos"), (~F.bool_or(old)).alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))
    more = (F.col("rank") <= LIST * 2**turn) & (F.col("cos") >= THRESHOLD)
    return rows.withColumn("rank", rank).where((F.col("rank") <= LIST) | more)


def _bars(lists: DataFrame, turn: int) -> DataFrame:
    """node, bar: the least cosine that a node's list may take in a round."""
    last = F.max(F.when(F.col("rank") == LIST, F.col("cos")))
    full = F.count(F.lit(1)) >= LIST * 2**turn
    bar = F.when(full, F.min("cos")).otherwise(F.coalesce(F.least(last, F.lit(THRESHOLD)), F.lit(-2.0)))
    return lists.groupBy(F.col("u").alias("node")).agg(bar.alias("bar"))


def descend(lists: DataFrame, nodes: DataFrame, held: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The lists after rounds in which neighbours of a node meet, and who is of one class by them.

    ``held`` names the tables of ``lists``; those of a round go when the next is written.
    """
    same: list[DataFrame] = []
    link = F.col("cos") >= THRESHOLD
    for turn in range(1, ROUNDS + 1):
        if lists.isEmpty():
            break
        around = lists.select(F.col("u").alias("pivot"), F.col("v").alias("node"), "fresh").unionByName(
            lists.select(F.col("v").alias("pivot"), F.col("u").alias("node"), "fresh")
        )
        around = around.groupBy("pivot", "node").agg(F.bool_or("fresh").alias("fresh"))
        moving = lists.where("fresh").select(F.explode(F.array("u", "v")).alias("pivot")).distinct()
        around = around.join(moving, "pivot", "left_semi")
        known = nodes.select("node", "vec").join(_bars(lists, turn), "node", "left").fillna({"bar": -2.0})
        used: list[str] = []
        met = _solved(_blocks(around, "pivot", BLOCK, held=used).join(known, "node"), LIST * 2**turn)
        met = stored(met, "met", used)
        before = lists.select("u", "v", "cos", F.lit(True).alias("old"))
        after: list[str] = []
        lists = stored(best(before.unionByName(met.withColumn("old", F.lit(False))), turn), "lists", after)
        same.append(stored(met.where("cos IS NULL").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "same"))
        discard(nodes.sparkSession, held + used)
        held[:] = after
        links, found = lists.where(link).agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if found <= 0.001 * links:
            break
    return lists, same


def audit(nodes: DataFrame, classes: DataFrame, most: int = AUDIT, attempt: int = 0) -> float:
    """Mean share of a linked node's links inside its class, by brute force for a sample.

    The lesser of the mean in large classes and that of all other nodes; 1 without links.
    """
    held: list[str] = []
    sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n").isNull(), 0).when(F.col("n") <= LIST, 1).otherwise(2)
    named = nodes.select("node").join(classes, "node", "left").join(sizes, "component", "left")
    named = stored(named.select("node", F.coalesce("component", "node").alias("component"), kind.alias("kind")), "audited", held)
    counts = {r.kind: r["count"] for r in named.groupBy("kind").count().collect()}
    total = sum(counts.values())
    most = max(most, int(total**0.5))
    share = {k: min(1.0, most / n) for k, n in counts.items()}
    chosen = F.lit(False)
    for k, part in share.items():
        chosen |= (F.col("kind") == k) & (F.pmod(F.xxhash64("node", F.lit(attempt)), F.lit(1 << 40)) < int(part * (1 << 40)))
    rows = nodes.select("node", "vec").join(named.withColumn("asked", chosen), "node")
    parts = -(-total // PART)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(parts, 1) - 1).cast("long"))).alias("part")
    asked = rows.where("asked").select(every, F.lit(0).alias("turn"), "node", "vec", "component")
    told = F.pmod(F.xxhash64("node", F.lit("part")), F.lit(max(parts, 1))).cast("long").alias("part")
    dealt = asked.unionByName(rows.select(told, F.lit(1).alias("turn"), "node", "vec", "component"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "turn")

    def work(batches):
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("inside", pa.int64())])
        sample, at = [], None  # of each: node, component, vectors, links, links inside

        def counted():
            for name, _, _, links, inside in sample:
                some = np.flatnonzero(links)
                yield record_batch(schema, name[some], links[some], inside[some])

        for batch in batches:
            part, turn = batch.column("part").to_numpy(), batch.column("turn").to_numpy()
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (turn[1:] != turn[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                for low in range(start, end, 1024):
                    if part[low] != at:
                        yield from counted()
                        sample, at = [], part[low]
                    some = batch.slice(low, min(1024, end - low))
                    node, component = some.column("node").to_numpy(), some.column("component").to_numpy()
                    unit = _matrix(some.column("vec"))
                    if turn[low] == 0:
                        sample.append((node, component, unit, np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)))
                        continue
                    for name, group, vec, links, inside in sample:
                        # Room for rounding: links at the threshold itself are no test.
                        linked = (vec @ unit.T >= THRESHOLD + 1e-9) & (name[:, None] != node)
                        links += linked.sum(1)
                        inside += (linked & (group[:, None] == component)).sum(1)
        yield from counted()

    found = dealt.transform(shipped).mapInArrow(work, "node long, links long, inside long")
    found = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("inside").alias("inside")).join(named, "node")
    found = found.groupBy("kind").agg(F.sum(F.col("inside") / F.col("links")).alias("share"), F.count(F.lit(1)).alias("n"))
    sums = {0: [0.0, 0.0], 2: [0.0, 0.0]}  # by side: large classes, and the others
    for r in found.collect():
        side = sums[2 if r.kind == 2 else 0]
        side[0] += r.share / share[r.kind]
        side[1] += r.n / share[r.kind]
    discard(nodes.sparkSession, held)
    return min((inside / linked for inside, linked in sums.values() if linked), default=1.0)


def count_links(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """node, links: copies of other nodes linked with a node of a class."""
    members = nodes.join(classes, "node")
    sizes = classes.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / COUNTED).cast("long").alias("parts"))
    members = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # A pair of parts is a block; a part goes to all blocks that it is one of.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = members.withColumn("other", other).select(
        F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other")).alias("block"),
        (F.col("part") > F.col("other")).alias("second"),
        (F.col("part") == F.col("other")).alias("same"),
        "node", "vec", "copies",
    )

    def work(batches):
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])
        for second, same, node, vec, copies in groups(batches, "block", "second", "same", "node", "vec", "copies"):
            second = second.to_numpy(zero_copy_only=False)
            node, copies, unit = node.to_numpy(), copies.to_numpy(), _matrix(vec)
            if same[0].as_py():
                linked = unit @ unit.T >= THRESHOLD
                np.fill_diagonal(linked, False)
                yield record_batch(schema, node, linked @ copies)
            else:
                linked = unit[~second] @ unit[second].T >= THRESHOLD
                yield record_batch(schema, node[~second], linked @ copies[second])
                yield record_batch(schema, node[second], linked.T @ copies[~second])

    spread = dealt.repartition("block").sortWithinPartitions("block")
    return spread.transform(shipped).mapInArrow(work, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n_links, component (the least key of the class), recall (of the audit)."""
    vectors = vectors.select(key, vector)
    spark, salt = vectors.sparkSession, 0
    while True:
        written: list[str] = []
        nodes = stored(nodes_of(vectors, key, vector, salt), "nodes", written)
        count, names = nodes.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
        if count == names:
            break
        discard(spark, written)  # two vectors with one digest
        salt += 1
    none = spark.createDataFrame([], "u long, v long, cos double, old boolean")
    lists, of_lists, same, recall = none, [], none.select(F.col("u").alias("a"), F.col("v").alias("b")), 0.0
    for attempt in range(ATTEMPTS):
        used: list[str] = []
        found = stored(by_signs(nodes, count, attempt, used), "met", used)
        after: list[str] = []
        before = lists.select("u", "v", "cos", F.lit(True).alias("old"))
        merged = stored(best(before.unionByName(found.withColumn("old", F.lit(False))), 0), "lists", after)
        first = stored(found.where("cos IS NULL").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "same")
        discard(spark, of_lists + used)
        lists, more = descend(merged, nodes, of_lists := after)
        same = reduce(DataFrame.unionByName, [first, *more], same)
        classes = stored(components(same), "classes")
        recall = audit(nodes, classes, attempt=attempt)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"after {ATTEMPTS} attempts the audit finds a recall of {recall:.4f}, under {RECALL}")
    discard(spark, of_lists)
    counted = nodes.drop("vec").join(classes, "node", "left").join(count_links(nodes, classes), "node", "left")
    counted = counted.select(
        "node",
        F.coalesce("component", "node").alias("class"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    node = F.xxhash64(_plain(vectors, vector), F.lit(salt))
    rows = vectors.withColumn("node", F.when(F.col(key).isNotNull(), node)).drop(vector)
    rows = rows.join(counted, "node", "left")
    least = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(key).alias("least"))
    return rows.join(least, "class", "left").select(
        key,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", key).alias("component"),
        F.lit(float(recall)).alias("recall"),
    )
