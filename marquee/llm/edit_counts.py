"""Token counts that follow edits without encoding a text again.

A text is split into pre-tokens, and a segment tree holds the characters and tokens of its
subtrees; a leaf has some dozens of pre-tokens. An edit re-encodes only what it touches: from
``CONTEXT`` characters before it, where no earlier pre-token can have looked, to the first
pre-token after it that starts where one started before. The sums on the way to the root
are updated, and the root has the count.

An edit is (start, removed, inserted) in code points of the text as the earlier edits left
it; starts and lengths beyond the text are cut to it, null start or length count as 0 and
null text as empty. Edits apply in the order given. Null texts count as empty. Repeated
rows are counted one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, record_batch, shipped, texts

#: Characters after a pre-token that decide where it ends, at most.
CONTEXT = 4
LEAF = 64
REMEMBERED = 1 << 18
EDITS = "array<struct<start:long,removed:long,inserted:string>>"


class Counter:
    """Splits text into pre-tokens and counts the tokens of each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def tokens(self, pretokens: list[str]) -> list[int]:
        try:
            return [self.known[p] for p in pretokens]
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = []
            for p in pretokens:
                n = self.known.get(p)
                if n is None:
                    n = len(self.encoding.encode_ordinary(p))
                    if len(p) <= 64:
                        self.known[p] = n
                found.append(n)
            return found


class CountTree:
    """A text's pre-tokens in leaves, under sums of characters and tokens."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pretokens = counter.split(text)
        self.leaves = self._cut(pretokens, counter.tokens(pretokens))
        self.reencoded = 0
        self._build()

    @staticmethod
    def _cut(pretokens: list[str], counts: list[int]) -> list[tuple[list[str], list[int]]]:
        return [(pretokens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pretokens), LEAF)] or [([], [])]

    def _build(self) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * 2 * self.width, [0] * 2 * self.width
        for i, (pretokens, counts) in enumerate(self.leaves):
            self.chars[self.width + i] = sum(map(len, pretokens))
            self.sums[self.width + i] = sum(counts)
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def _update(self, leaf: int) -> None:
        i = self.width + leaf
        self.chars[i] = sum(map(len, self.leaves[leaf][0]))
        self.sums[i] = sum(self.leaves[leaf][1])
        while i := i // 2:
            self._add(i)

    @property
    def tokens(self) -> int:
        return self.sums[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf with a character, the last if there is none, and where the leaf starts."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if position - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        leaf = min(i - self.width, len(self.leaves) - 1)
        return leaf, before

    def edit(self, start: int, removed: int, inserted: str) -> None:
        start = min(max(start, 0), self.length)
        removed = min(max(removed, 0), self.length - start)
        if not removed and not inserted:
            return
        end = start + removed
        first, at = self._find(max(start - CONTEXT, 0))
        kept, offset = 0, at  # pre-tokens of the first leaf that stay, and where they end
        for pretoken in self.leaves[first][0]:
            if offset + len(pretoken) > start - CONTEXT:
                break
            offset += len(pretoken)
            kept += 1
        last = max(self._find(end)[0], first)
        while True:
            old = [p for leaf in self.leaves[first : last + 1] for p in leaf[0]][kept:]
            text = "".join(old)
            changed = text[: start - offset] + inserted + text[end - offset :]
            whole = last == len(self.leaves) - 1
            starts, place = {}, offset
            for i, pretoken in enumerate(old):
                starts[place] = i
                place += len(pretoken)
            fresh, place, met = [], 0, len(old) if whole else None
            for pretoken in self.counter.split(changed):
                before = place - len(inserted) + removed + offset  # where it would have started
                if place >= start - offset + len(inserted) and before in starts:
                    met = starts[before]
                    break
                place += len(pretoken)
                if not whole and place > len(changed) - CONTEXT:
                    met = None
                    break
                fresh.append(pretoken)
            if met is not None:
                break
            last += 1  # the change reaches further than what was looked at
        self.reencoded += len(fresh)
        pretokens = [p for leaf in self.leaves[first : last + 1] for p in leaf[0]]
        counts = [c for leaf in self.leaves[first : last + 1] for c in leaf[1]]
        pretokens = pretokens[:kept] + fresh + pretokens[kept + met :]
        counts = counts[:kept] + self.counter.tokens(fresh) + counts[kept + met :]
        if first == last and len(pretokens) <= 2 * LEAF:
            self.leaves[first] = pretokens, counts
            self._update(first)
        elif first + 1 == last and 2 <= len(pretokens) <= 4 * LEAF:
            half = len(pretokens) // 2
            for leaf, part in ((first, slice(half)), (last, slice(half, None))):
                self.leaves[leaf] = pretokens[part], counts[part]
                self._update(leaf)
        else:
            self.leaves[first : last + 1] = self._cut(pretokens, counts)
            self._build()

    def text(self) -> str:
        return "".join(p for pretokens, _ in self.leaves for p in pretokens)


@lru_cache(maxsize=2)
def _counter(ranks: bytes, pattern: str) -> Counter:
    lines = (line.split() for line in ranks.splitlines() if line)
    return Counter({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)


def default_ranks() -> bytes:
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def with_edits(documents: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``documents`` with a column of the edits (key, seq, start, removed, inserted) of each.

    A text's edits follow one another, so they meet in its row; seq orders them.
    """
    ordered = edits.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("seq", "start", "removed", "inserted"))).alias("__edits")
    )
    ordered = ordered.withColumnRenamed(key, "__key")
    listed = F.transform("__edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["removed"].cast("long").alias("removed"), e["inserted"].alias("inserted")))
    return documents.join(ordered, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("edits", listed).drop("__key", "__edits")


def count_edited(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    edits: str = "edits",
    ranks: bytes | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """key, tokens before and after the edits, pre-tokens re-encoded, characters after.

    ``ranks`` holds the bytes of a file of base64 tokens and ranks, which travel with the tasks.
    """
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    kind = documents.schema[key].dataType.simpleString()

    def work(batches):
        counter = _counter(ranks, pattern)
        for batch in pieces(batches, text):
            rows = []
            for value, changes in zip(texts(batch, text), batch.column(edits).to_pylist()):
                tree = CountTree(value, counter)
                before = tree.tokens
                for change in changes or []:
                    if change:
                        tree.edit(change["start"] or 0, change["removed"] or 0, change["inserted"] or "")
                rows.append((before, tree.tokens, tree.reencoded, tree.length))
            schema = pa.schema(
                [batch.schema.field(key)]
                + [(name, pa.int64()) for name in ("n_tokens_before", "n_tokens", "n_reencoded", "n_chars")]
            )
            yield record_batch(schema, batch.column(key), *(map(list, zip(*rows)) if rows else [[]] * 4))

    return documents.select(key, text, edits).transform(shipped).mapInArrow(
        work, f"`{key}` {kind}, n_tokens_before long, n_tokens long, n_reencoded long, n_chars long"
    )
