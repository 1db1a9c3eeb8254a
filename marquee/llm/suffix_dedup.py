"""Removing the bytes of long strings that occur more than once anywhere.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts at another
place, in the same text or another, overlaps included, judged on the texts as given. The
strings are found by suffix arrays over the passages that share an anchor (``windows``,
``suffixes``).

Null texts count as empty. Repeated rows are copies of each other, so all their strings
repeat; rows equal in key and text get equal results. Null keys are kept as such. Other
columns are left out by ``dedup`` and kept by ``rewrite``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, raw, record_batch, shipped, unused
from marquee.llm.windows import RANGES, repeated

LENGTH = 400
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def row_id(key: str, text: str) -> Column:
    """Equal for rows of equal key and text."""
    name = F.concat(F.coalesce(F.concat(F.lit("+"), F.col(key).cast("string")), F.lit("-")), F.lit("\0"))
    return F.unhex(F.md5(F.concat(name, F.coalesce(F.col(text), F.lit("")))))


def removed(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in the ranges."""
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in ranges):
        end += length - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def whole_words(text: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The spans that hold ``words`` words or more, cut ones included."""
    return [(a, b) for a, b in spans if not words or len(text[a:b].split(None, words)) >= words]


def _with_ranges(documents: DataFrame, length: int, key: str, text: str, most: dict) -> DataFrame:
    """row (all columns) and ranges."""
    texts = documents.select(row_id(key, text).alias("rid"), F.col(text).cast("binary").alias("text"))
    found = repeated(texts.select("rid", F.lit(0).cast("long").alias("unit"), F.lit(0).cast("long").alias("scope"), "text"), length, **most)
    rows = documents.select(F.struct("*").alias("row"), row_id(key, text).alias("rid"))
    return rows.join(found.select("rid", "ranges"), "rid", "left").select("row", "ranges")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def dedup(documents: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", **most) -> DataFrame:
    """key, n_bytes, spans (the bytes removed, start and end), kept (the remaining bytes)."""
    rows = _with_ranges(documents.select(key, text), length, key, text, most)
    kind = documents.schema[key].dataType.simpleString()

    def work(batches):
        for batch in pieces(batches, text):
            spans = [removed(r or [], length) for r in batch.column(2).to_pylist()]
            whole = raw(batch, text)
            schema = pa.schema([batch.schema.field(key), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.large_binary())])
            yield record_batch(
                schema,
                batch.column(key),
                [len(value) for value in whole],
                [[{"start": a, "end": b} for a, b in each] for each in spans],
                [cut(value, each) for value, each in zip(whole, spans)],
            )

    spans = "array<struct<start:long,end:long>>"
    return rows.select(f"row.{key}", f"row.{text}", "ranges").transform(shipped).mapInArrow(work, f"`{key}` {kind}, n_bytes long, spans {spans}, kept binary")


def rewrite(
    documents: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", words: int = 0, **most
) -> DataFrame:
    """The rows with their remaining text; characters cut in two are dropped, null stays null.

    Runs of fewer than ``words`` words stay.
    """
    columns = documents.columns
    rows = _with_ranges(documents, length, key, text, most)

    def work(batches):
        for batch in pieces(batches, text):
            at = batch.schema.get_field_index(text)
            kept = [
                value if not ranges else cut(value, whole_words(value, removed(ranges, length), words)).decode("utf-8", "ignore").encode()
                for value, ranges in zip(batch.column(at).cast(pa.large_binary()).to_pylist(), batch.column(len(columns)).to_pylist())
            ]
            kept = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(text).type)
            yield batch.set_column(at, text, kept).select(columns)

    return rows.select("row.*", F.col("ranges").alias(unused(columns, "ranges"))).transform(shipped).mapInArrow(work, documents.schema)


__all__ = ["RANGES", "cut", "dedup", "removed", "rewrite", "row_id", "whole_words"]
