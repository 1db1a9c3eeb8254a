"""Secrets in texts, judged by how many repositories and owners hold the same value.

Three base patterns and four further kinds give candidates. A candidate's value is known
by a 128-bit digest only; digests are counted over the whole corpus by distinct owner and by
distinct repository within an owner. A value found at ``WIDE`` owners or more, or in ``COPIES``
repositories or more, is a copied example; one found at a single owner, in fewer
repositories, that does not read like a placeholder is live; others are shared. Candidates of the base
kinds are spans in any case, those of the further kinds only if they are live.

``assign``, ``access`` and ``hex`` are matched leftmost and without overlap per kind, those
with too short a value dropped. The further kinds never overlap a span before them:
``key`` (private key blocks), ``issued`` (tokens that name their issuer), ``login`` (user and
password in an address), ``opaque`` (runs of ``OPAQUE`` characters or more, in at least two of
capitals, small letters and digits, at ``ENTROPY`` bits a character or more).

Null texts count as empty. A null owner or repository is one of its own. Repeated rows give
repeated results; they are one owner, so a value repeated by one owner is not copied. Null keys are
kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, record_batch, shipped, texts
from marquee.llm.components import stored

#: The base patterns, in the order in which kinds are listed.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Published forms of keys and tokens.
FURTHER = (
    ("key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\s]|-(?!----))*-----END (?:[A-Z]+ )*PRIVATE KEY-----"), 0),
    ("issued", re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)"), 0),
    ("login", re.compile(r"\b[a-z][a-z0-9+.-]{1,19}://[^\s/:@\"'<>]+:([^\s/:@\"'<>]{6,})@"), 1),
    ("opaque", re.compile(r"[A-Za-z0-9+/_=-]+"), 0),
)
KINDS = tuple(kind for kind, *_ in (*BASE, *FURTHER))
WIDE, COPIES = 3, 5
OPAQUE, ENTROPY = 20, 3.0
_PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|change_?me|your[_-]|test|x{4,}|0123456789|1234567890|abcdef(?:gh|012)", re.IGNORECASE)

SPANS = "array<struct<kind:string,start:int,end:int,value:binary,plausible:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("plausible", pa.bool_())]))


def entropy(value: str) -> float:
    """Bits a character, from the value's own frequencies."""
    return sum(n * math.log2(len(value) / n) for n in Counter(value).values()) / max(1, len(value))


def plausible(value: str) -> bool:
    """Whether a value could be in use: it varies and names no placeholder."""
    return entropy(value) >= 2 and not _PLACEHOLDER.search(value)


def _opaque(value: str) -> bool:
    kinds = sum(re.search(c, value) is not None for c in ("[A-Z]", "[a-z]", "[0-9]"))
    return kinds > 1 and re.search("[0-9]", value) is not None and entropy(value) >= ENTROPY


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end (code points) and value of each candidate, in order of place and kind."""
    found = []
    for kind, pattern, group, least in BASE:
        for match in pattern.finditer(text):
            if len(match[group]) >= least:
                found.append((kind, *match.span(), match[group]))
    covered = sorted((start, end) for _, start, end, _ in found)
    for kind, pattern, group in FURTHER:
        taken, at = [], 0
        for match in pattern.finditer(text):
            start, end = match.span()
            if kind == "opaque" and (end - start < OPAQUE or not _opaque(match[0])):
                continue
            while at < len(covered) and covered[at][1] <= start:
                at += 1
            if at == len(covered) or covered[at][0] >= end:
                taken.append((start, end))
                found.append((kind, start, end, match[group]))
        covered = sorted(covered + taken)
    return sorted(found, key=lambda c: (c[1], KINDS.index(c[0])))


def found_in(documents: DataFrame, key: str, text: str, owner: str, repository: str) -> DataFrame:
    """key, owner, repository, spans: every candidate of each row, with the digest of its value."""

    def work(batches):
        for batch in pieces(batches, "text"):
            spans = [
                [
                    {"kind": kind, "start": a, "end": b, "value": hashlib.md5(value.encode()).digest(), "plausible": plausible(value)}
                    for kind, a, b, value in candidates(whole)
                ]
                for whole in texts(batch)
            ]
            schema = pa.schema([*(batch.schema.field(name) for name in ("key", "owner", "repository")), ("spans", _SPANS)])
            yield record_batch(schema, *(batch.column(i) for i in range(3)), spans)

    rows = documents.select(
        F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.col(text).alias("text")
    )
    kinds = [rows.schema[name].dataType.simpleString() for name in ("key", "owner", "repository")]
    schema = f"key {kinds[0]}, owner {kinds[1]}, repository {kinds[2]}, spans {SPANS}"
    return rows.transform(shipped).mapInArrow(work, schema)


def ownership(spans: DataFrame) -> DataFrame:
    """value, owners, repositories: over all candidates, null as one owner or repository.

    Counted in two steps of partial sums, so a value in very many rows costs a row per task.
    """
    holders = spans.select("value", F.struct("owner").alias("owner"), F.struct("repository").alias("repository")).distinct()
    by_owner = holders.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def verdict(wide: int = WIDE, copies: int = COPIES) -> Column:
    """``copied``, ``live`` or ``shared``, from owners, repositories and plausible."""
    copied = (F.col("owners") >= wide) | (F.col("repositories") >= copies)
    return F.when(copied, "copied").when((F.col("owners") == 1) & F.col("plausible"), "live").otherwise("shared")


def scan(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: str = "source",
    wide: int = WIDE,
    copies: int = COPIES,
) -> DataFrame:
    """key and spans: kind, start, end, value (digest), owners, repositories and verdict of each,
    in order of start and kind; candidates of the further kinds only where they are live."""
    rows = stored(found_in(documents, key, text, owner, repository).select("*", F.monotonically_increasing_id().alias("row")), "candidates")
    spans = rows.where(F.size("spans") > 0).select("row", "owner", "repository", F.posexplode("spans").alias("place", "span"))
    spans = spans.select("row", "owner", "repository", "place", "span.*")
    counts = stored(ownership(spans), "ownership")
    judged = spans.join(counts, "value").withColumn("verdict", verdict(wide, copies))
    kept = judged.where(F.col("kind").isin([kind for kind, *_ in BASE]) | (F.col("verdict") == "live"))
    names = ("place", "kind", "start", "end", "value", "owners", "repositories", "verdict")
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("spans"))
    none = F.from_json(F.lit("[]"), lists.schema["spans"].dataType)
    return rows.select("row", "key").join(lists, "row", "left").select(
        F.col("key").alias(key), F.transform(F.coalesce("spans", none), lambda s: s.dropFields("place")).alias("spans")
    )


def as_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, spans a base kind, the digest of the base spans, all spans as text, and how many are
    live and copied."""
    base = F.filter("spans", lambda s: s["kind"].isin([kind for kind, *_ in BASE]))
    count = lambda name, value: F.size(F.filter("spans", lambda s: s[name] == value)).cast("long")
    return scanned.select(
        key,
        *(count("kind", kind).alias(f"n_{kind}") for kind, *_ in BASE),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "copied").alias("n_copied"),
    )
