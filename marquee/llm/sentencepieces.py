"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

An agenda ordered by score holds the adjacent symbol pairs that form a piece: the best
pair, the leftmost of equals, is merged, and the pairs that the merge creates join the
agenda. Short segments share their steps: a row of ranks is each one's agenda, and its
least entry the next pair; a long one has a heap. What no merge can cross (the start of a run of spaces, a line feed) cuts a text
into segments that are encoded on their own and remembered while a Python worker lives,
in a memory of bounded size.

The library checks the result inside the Arrow batches: every segment when it is first
met, and whole texts, one of ``audit_every`` by digest, ids and decoded text. A difference
ends the job with an error.

Null texts count as empty; an empty text has only the begin and end ids. Repeated rows and
ids are encoded one by one. Columns other than the key and the text are left out.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, record_batch, shipped, texts

SPACE = "▁"
REMEMBERED = 1 << 19
REMEMBERED_LENGTH = 64
#: Segments encoded at once, and text bytes of a piece.
LEARNED, PIECE = 1 << 14, 2 << 20
#: Characters of a segment whose agenda is a row; longer ones have a heap.
ROW = 24
NONE = np.iinfo(np.int32).max
AUDIT_EVERY = 16


class Agenda:
    """The encoder and decoder for one model."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm, trainer = spec.normalizer_spec, spec.trainer_spec
        normal, control, byte, unknown = 1, 3, 6, 2
        kinds = {piece.type for piece in spec.pieces}
        if (
            trainer.model_type != 2
            or not trainer.byte_fallback
            or trainer.treat_whitespace_as_suffix
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not norm.add_dummy_prefix
            or not norm.escape_whitespaces
            or kinds - {normal, control, byte, unknown}
        ):
            raise ValueError("needs a merge-type model with byte fallback that keeps white space")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        found = [(piece.piece, piece.score, i) for i, piece in enumerate(spec.pieces) if piece.type == normal]
        if any(SPACE in piece.lstrip(SPACE) for piece, _, _ in found):
            raise ValueError("needs a model whose pieces have spaces only at the start")
        ranks = {score: rank for rank, score in enumerate(sorted({score for _, score, _ in found})[::-1])}
        self.rank = {piece: ranks[score] for piece, score, _ in found}
        self.id = {piece: i for piece, _, i in found}
        self.longest = max(map(len, self.rank))
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == byte}
        # Symbols: a piece has its id, another character of some piece the numbers after them.
        symbols = dict(self.id)
        for piece in self.rank:
            for character in piece:
                symbols.setdefault(character, len(spec.pieces) + len(symbols))
        self.unknown = len(spec.pieces) * 2 + len(symbols)
        self.base = self.unknown + 1
        self.symbol = np.full(0x110000, self.unknown, np.int64)
        for piece, number in symbols.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = number
        pairs = sorted(
            (symbols[piece[:k]] * self.base + symbols[piece[k:]], self.rank[piece], self.id[piece])
            for piece in self.rank
            for k in range(1, len(piece))
            if piece[:k] in symbols and piece[k:] in symbols
        )
        self.pairs = np.array([pair[0] for pair in pairs] + [np.iinfo(np.int64).max])
        self.pair_rank = np.array([pair[1] for pair in pairs] + [NONE], np.int32)
        self.pair_id = np.array([pair[2] for pair in pairs] + [0], np.int32)
        self.byte_of = {i: bytes([value]) for value, i in self.byte_id.items()}
        self.bytes_of = {i: piece.replace(SPACE, " ").encode() for piece, _, i in found}
        self.begin = np.array([self.library.bos_id()], "<u4").tobytes()
        self.end = np.array([self.library.eos_id()], "<u4").tobytes()
        line = not any("\n" in piece for piece in self.rank)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if line else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.line = line
        # What is remembered of a segment: packed ids and decoded bytes.
        self.packed: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # what segments decode to that do not give themselves back

    def merge(self, text: str) -> list[int]:
        """The ids of a normalised segment."""
        rank, longest, n = self.rank, self.longest, len(text)
        symbols = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = text[i : i + 2]
            if pair in rank:
                agenda.append((rank[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != len(pair):
                continue  # one of the two was merged meanwhile
            symbols[left], symbols[right] = pair, ""
            following = after[left] = after[right]
            preceding = before[left]
            if following < n:
                before[following] = left
                joined = pair + symbols[following]
                if len(joined) <= longest and joined in rank:
                    heapq.heappush(agenda, (rank[joined], left, following, joined))
            if preceding >= 0:
                joined = symbols[preceding] + pair
                if len(joined) <= longest and joined in rank:
                    heapq.heappush(agenda, (rank[joined], preceding, left, joined))
        ids = []
        for symbol in symbols:
            if symbol:
                if symbol in self.id:
                    ids.append(self.id[symbol])
                else:
                    ids += [self.byte_id[byte] for byte in symbol.encode()]
        return ids

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of two symbols joined, NONE if they form no piece."""
        wanted = left * self.base + right
        at = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[at] == wanted, self.pair_rank[at], NONE), self.pair_id[at]

    def merge_rows(self, segments: list[str]) -> list[list[int]]:
        """The ids of segments of at most ROW characters."""
        if not segments:
            return []
        width = max(map(len, segments))
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.array(segments, f"U{width}").view(np.uint32).reshape(len(segments), width)
        # The last column stands for both ends.
        symbols = np.full((len(segments), width + 1), self.unknown, np.int64)
        symbols[:, :-1] = self.symbol[codes]
        symbols[np.arange(width + 1) >= lengths[:, None]] = self.unknown
        alive = np.arange(width + 1) < lengths[:, None]
        by_byte = ((symbols == self.unknown) & alive).any(1)
        after = np.tile(np.arange(1, width + 2), (len(segments), 1))
        after[:, -1] = width
        before = np.tile(np.arange(-1, width), (len(segments), 1))
        before[:, 0] = width
        rank = np.full(symbols.shape, NONE, np.int32)
        joined = np.zeros(symbols.shape, np.int32)
        rank[:, :-1], joined[:, :-1] = self._pair(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(segments))
        while len(rows):
            best = rank[rows].argmin(1)
            more = rank[rows, best] != NONE
            rows, left = rows[more], best[more]
            right = after[rows, left]
            following = after[rows, right]
            preceding = before[rows, left]
            symbols[rows, left] = joined[rows, left]
            alive[rows, right] = False
            rank[rows, right] = NONE
            after[rows, left] = following
            before[rows, following] = left
            last = following == width
            for one, other, at in ((left, following, left), (preceding, left, preceding)):
                rank[rows, at], joined[rows, at] = self._pair(symbols[rows, one], symbols[rows, other])
            rank[rows[last], left[last]] = NONE
            rank[rows, -1] = NONE
        kept = symbols[alive].tolist()
        ends = alive.sum(1).cumsum().tolist()
        out, start = [], 0
        for i, end in enumerate(ends):
            out.append(kept[start:end])
            start = end
        for i in np.flatnonzero(by_byte):
            out[i] = self.merge(segments[i])
        characters = max(self.id.values()) + 1
        for i in np.flatnonzero(((symbols >= characters) & alive).any(1) & ~by_byte):
            out[i] = self.merge(segments[i])
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the ids of whole segments, the space put in front included."""
        try:
            return b"".join([self.bytes_of[i] for i in ids])
        except KeyError:
            joined = b"".join([self.byte_of.get(i) or self.bytes_of.get(i, b"") for i in ids])
            return joined.decode("utf-8", "replace").encode()

    def learn(self, segments: set[str]) -> None:
        """Encode segments, check them against the library and remember them, some at a time."""
        listed = sorted(segments, key=len)
        for start in range(0, len(listed), LEARNED):
            self._learn(listed[start : start + LEARNED])

    def _learn(self, segments: list[str]) -> None:
        """``learn`` for segments in order of length."""
        lead = self.merge(SPACE) + self.merge("\n") if self.line else []
        rows = sum(len(segment) <= ROW for segment in segments)
        found = []
        for start in range(0, rows, 8192):
            found += self.merge_rows(segments[start : min(start + 8192, rows)])
        found += [self.merge(segment) for segment in segments[rows:]]
        packed = np.fromiter((i for ids in found for i in ids), "<u4").tobytes()
        at, asked, expected = 0, [], []
        for segment, ids in zip(segments, found):
            self.packed[segment] = packed[at : (at := at + 4 * len(ids))]
            if (decoded := self.decode(ids)) != segment.replace(SPACE, " ").encode():
                self.odd[segment] = decoded
            if segment[0] == SPACE and len(segment) > 1:
                asked.append(segment[1:].replace(SPACE, " "))
                expected.append(ids)
            elif segment[0] != SPACE and lead:
                asked.append("\n" + segment.replace(SPACE, " "))
                expected.append(lead + ids)
        if asked and self.library.encode(asked, num_threads=1) != expected:
            raise ValueError("the agenda and the sentencepiece library differ on a segment")

    def run(self, documents: list[str], audit_every: int) -> Iterator[tuple[bytes, str]]:
        """Packed ids and decoded text of each document."""
        cut = [self.cut(SPACE + text.replace(" ", SPACE)) if text else [] for text in documents]
        wanted = set().union(*cut)
        unseen = wanted.difference(self.packed)
        if len(self.packed) + len(unseen) > REMEMBERED:
            self.packed.clear()
            self.odd.clear()
            unseen = wanted
        self.learn(unseen)
        packed, odd = self.packed.__getitem__, self.odd
        for text, segments in zip(documents, cut):
            ids = self.begin + b"".join(map(packed, segments)) + self.end
            if odd.keys().isdisjoint(segments):
                decoded = "".join(segments).replace(SPACE, " ")[1:]
            else:
                plain = (odd[s] if s in odd else s.replace(SPACE, " ").encode() for s in segments)
                decoded = b"".join(plain)[1:].decode()
            if not zlib.crc32(text.encode()) % audit_every:
                expected = self.library.encode(text, add_bos=True, add_eos=True, num_threads=1)
                if np.array(expected, "<u4").tobytes() != ids or self.library.decode(expected) != decoded:
                    raise ValueError("the agenda and the sentencepiece library differ on a text")
            yield ids, decoded
        for segment in unseen:
            if len(segment) > REMEMBERED_LENGTH:
                del self.packed[segment]
                odd.pop(segment, None)


@lru_cache(maxsize=2)
def _agenda(model: bytes) -> Agenda:
    return Agenda(model)


def default_model() -> bytes:
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def encode_decode(
    documents: DataFrame,
    model: bytes | None = None,
    key: str = "doc_id",
    text: str = "text",
    audit_every: int = AUDIT_EVERY,
) -> DataFrame:
    """key, ids (little-endian unsigned 32-bit integers, begin and end included), decoded.

    ``model`` holds the bytes of the model file, which travel with the tasks.
    """
    model = model or default_model()
    kind = documents.schema[key].dataType.simpleString()

    def work(batches):
        agenda = _agenda(model)
        for batch in pieces(batches, text, PIECE):
            done = list(agenda.run(texts(batch, text), audit_every))
            schema = pa.schema([batch.schema.field(key), ("ids", pa.large_binary()), ("decoded", pa.large_string())])
            yield record_batch(schema, batch.column(key), [a for a, _ in done], [b for _, b in done])

    return documents.select(key, text).transform(shipped).mapInArrow(work, f"`{key}` {kind}, ids binary, decoded string")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens and the SHA-256 of the packed ids and of the decoded text."""
    return encoded.select(
        key,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
