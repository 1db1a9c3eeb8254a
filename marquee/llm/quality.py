"""Quality rules by labelling lines: a linear-chain conditional random field.

Each line with a word is content or boilerplate. The field scores a line by its features
and each pair of neighbouring lines by their labels; Viterbi decoding finds the best
labelling of a text as a whole. A text is kept if at least ``SHARE`` of its words are in
content lines and the plain rules hold (``MIN_WORDS`` words, at most ``MAX_REPEATED`` percent of
them in 5-word windows that occur twice or more).

The field is trained here, by gradient ascent on the likelihood, on at most ``SAMPLE``
labelled texts, those of the least key digests: the lines of a text take its quality as
their label. Counts, features and decoding cover every line of every text.

Words are runs of other characters than space and U+0009 to U+000D. Null texts count as
empty; they fail the rules. Ties between labellings go to content. Repeated rows and keys are
judged one by one; null keys and labels train nothing. Without labelled texts of both kinds
all lines are content.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, record_batch, shipped, texts

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
#: Of 100 words.
MAX_REPEATED = 20
SHARE = 0.5
SAMPLE = 4000
#: Lines of a chain in training; longer texts give several chains.
CHAIN = 64
STEPS = 150

_DIGIT = re.compile("[0-9]")
_REPEATED_MARK = re.compile(r"[!?#*$%&|<>~^_=]{2,}")
_URL = re.compile(r"https?://|www\.")
FEATURES = 12


@dataclass
class Field:
    """Weights of a line's features, of label pairs [previous, next] and of the first label."""

    weights: np.ndarray
    bias: float
    pairs: np.ndarray
    first: np.ndarray

    def decode(self, features: np.ndarray) -> list[bool]:
        """The best labels of a chain of lines, True for content."""
        unary = (features @ self.weights + self.bias).tolist()
        (bb, bc), (cb, cc) = self.pairs.tolist()
        lead, back = 0.0, []
        for i, u in enumerate(unary):
            if i:
                to_content, to_other = lead + cc, lead + cb
                back.append((to_content >= bc, to_other >= bb))
                lead = u + (to_content if to_content >= bc else bc) - (to_other if to_other >= bb else bb)
            else:
                lead = u + float(self.first[1] - self.first[0])
        labels = [lead >= 0] if unary else []
        for content, other in reversed(back):
            labels.append(content if labels[-1] else other)
        return labels[::-1]


def line_features(line: str, words: list[str], seen: set[str]) -> list[float]:
    n, size = len(words), len(line)
    symbols = sum(map(line.count, SYMBOLS))
    distinct = len(set(words))
    upper = sum(map(str.isupper, words))
    return [
        min(symbols / n, 4.0),
        symbols / size,
        1 - distinct / n,
        float(n >= 8 and 2 * distinct < n),
        upper / n,
        len(_REPEATED_MARK.findall(line)) / n,
        len(_DIGIT.findall(line)) / size,
        float(line in seen),
        min(size / n, 30.0) / 10,
        min(n, 40) / 40,
        float(line.rstrip(WHITE)[-1] in ".!?:;\"'»”"),
        float(bool(_URL.search(line))),
    ]


def lines_of(text: str) -> tuple[list[list[float]], list[int], list[int], int]:
    """Of lines with a word: features, words, numbers; and how many equal an earlier one."""
    features, words, numbers, seen, again = [], [], [], set(), 0
    for number, line in enumerate(text.split("\n")):
        found = line.encode().split()
        if not found:
            continue
        features.append(line_features(line, [word.decode() for word in found], seen))
        words.append(len(found))
        numbers.append(number)
        again += line in seen
        seen.add(line)
    return features, words, numbers, again


def repeated_words(documents: list[list[bytes]]) -> np.ndarray:
    """For each text: words in windows that occur twice or more in it, the first included."""
    sizes = np.array([len(words) for words in documents], np.int64)
    out = np.zeros(len(documents), np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return out
    flat = np.empty(total, object)
    flat[:] = [word for words in documents for word in words]
    codes = pd.factorize(flat)[0].astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(32)
    owner = np.repeat(np.arange(len(documents)), sizes)
    # A window's name is a 64-bit digest of its words, compared within one text only.
    name = np.zeros(total - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        name = name * np.uint64(0xD6E8FEB86659FD93) + codes[k : k + len(name)]
    valid = np.flatnonzero(owner[: len(name)] == owner[WINDOW - 1 :])
    order = valid[np.lexsort((name[valid], owner[valid]))]
    same = (name[order[1:]] == name[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    hit = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + WINDOW, -1)
    return np.bincount(owner, np.cumsum(step[:-1]) > 0, len(documents)).astype(np.int64)


def _chains(features: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [
        (lines[start : start + CHAIN], label)
        for lines, label in zip(features, labels)
        for start in range(0, len(lines), CHAIN)
    ]
    x = np.zeros((len(rows), CHAIN, FEATURES))
    mask = np.zeros((len(rows), CHAIN), bool)
    for i, (lines, _) in enumerate(rows):
        x[i, : len(lines)] = lines
        mask[i, : len(lines)] = True
    return x, mask, np.array([label for _, label in rows])


def fit(features: list[np.ndarray], labels: list[int]) -> Field:
    """The field that makes the given labels of whole texts (1 content) likely."""
    pairs, first = np.zeros((2, 2)), np.zeros(2)
    if len(set(labels)) < 2 or not sum(map(len, features)):
        return Field(np.zeros(FEATURES), 1.0, pairs, first)
    x, mask, y = _chains(features, labels)
    mean, scale = x[mask].mean(0), x[mask].std(0) + 1e-6
    x = np.where(mask[..., None], (x - mean) / scale, 0.0)
    n, length = mask.shape
    theta = np.zeros(FEATURES + 7)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    observed = mask * y[:, None]
    inner = mask[:, 1:]
    for step in range(1, STEPS + 1):
        weights, bias = theta[:FEATURES], theta[FEATURES]
        pairs, first = theta[FEATURES + 1 : FEATURES + 5].reshape(2, 2), theta[FEATURES + 5 :]
        unary = np.stack([np.zeros((n, length)), x @ weights + bias], -1)
        ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = unary[:, 0] + first
        for t in range(1, length):
            to = np.logaddexp(ahead[:, t - 1, :1] + pairs[0], ahead[:, t - 1, 1:] + pairs[1]) + unary[:, t]
            ahead[:, t] = np.where(mask[:, t, None], to, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            right = behind[:, t + 1] + unary[:, t + 1]
            to = np.logaddexp(pairs[:, 0] + right[:, :1], pairs[:, 1] + right[:, 1:])
            behind[:, t] = np.where(mask[:, t + 1, None], to, behind[:, t + 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        content = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None]) * mask
        error = observed - content
        gradient = np.zeros_like(theta)
        gradient[:FEATURES] = np.einsum("nt,ntf->f", error, x)
        gradient[FEATURES] = error.sum()
        joint = (
            ahead[:, :-1, :, None] + pairs + (behind + unary)[:, 1:, None, :] - total[:, None, None, None]
        )
        expected = (np.exp(np.minimum(joint, 0)) * inner[..., None, None]).sum((0, 1))
        seen = np.diag([(inner * (1 - y)[:, None]).sum(), (inner * y[:, None]).sum()])
        gradient[FEATURES + 1 : FEATURES + 5] = (seen - expected).ravel()
        share = content[:, 0].sum()
        gradient[FEATURES + 5 :] = np.array([(1 - y).sum() - (n - share), y.sum() - share])
        gradient = gradient / n - 0.001 * theta
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = theta[:FEATURES] / scale
    return Field(
        weights,
        float(theta[FEATURES] - mean @ weights),
        theta[FEATURES + 1 : FEATURES + 5].reshape(2, 2),
        theta[FEATURES + 5 :],
    )


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          quality: str = "quality", sample: int = SAMPLE) -> Field:
    """A field from at most ``sample`` texts with a label of quality (1 good, 0 bad)."""
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(quality).isin(0, 1))
        .groupBy(key)
        .agg(F.min(quality).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col(key).cast("string")), key)
        .limit(sample)
    )
    rows = documents.select(key, text).join(F.broadcast(chosen), key).select(key, text, "label")

    def work(batches):
        schema = pa.schema([("label", pa.int32()), ("digest", pa.large_binary()), ("features", pa.large_binary())])
        for batch in pieces(batches, text):
            found = [np.array(lines_of(value)[0], np.float64) for value in texts(batch, text)]
            keys = [str(value).encode() for value in batch.column(key).to_pylist()]
            yield record_batch(schema, batch.column("label"), keys, [lines.tobytes() for lines in found])

    # One row of each key, the same in every run, so the bound holds.
    found = rows.transform(shipped).mapInArrow(work, "label int, digest binary, features binary").groupBy("digest")
    found = found.agg(F.min(F.struct("label", "features")).alias("row")).orderBy("digest")
    got = [row.row for row in found.collect()]
    return fit([np.frombuffer(row.features).reshape(-1, FEATURES) for row in got], [row.label for row in got])


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, share double, labels string"


def judge(documents: list[str], field: Field) -> list[list]:
    """The columns of MEASURES for each text, as lists."""
    words = [text.encode().split() for text in documents]
    repeated = repeated_words(words)
    out = [[] for _ in MEASURES.split(", ")]
    for text, found, again in zip(documents, words, repeated.tolist()):
        features, sizes, numbers, twice = lines_of(text)
        labels = field.decode(np.array(features)) if features else []
        marks = [" "] * (text.count("\n") + 1)
        for number, label in zip(numbers, labels):
            marks[number] = "c" if label else "b"
        content = sum(size for size, label in zip(sizes, labels) if label)
        share = content / len(found) if found else 0.0
        failed = len(found) < MIN_WORDS or 100 * again > MAX_REPEATED * len(found)
        values = (
            len(found),
            len(text) - sum(map(text.count, WHITE)),
            sum(map(text.count, SYMBOLS)),
            twice,
            again,
            failed,
            not failed and share >= SHARE,
            share,
            "".join(marks),
        )
        for column, value in zip(out, values):
            column.append(value)
    return out


def assess(documents: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts, the verdicts, the content share and a letter for each line.

    ``labels`` has c for content, b for boilerplate and a space for a line without a word.
    """
    kind = documents.schema[key].dataType.simpleString()

    def work(batches):
        for batch in pieces(batches, text):
            schema = pa.schema(
                [batch.schema.field(key)]
                + [(name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("share", pa.float64()), ("labels", pa.string())]
            )
            yield record_batch(schema, batch.column(key), *judge(texts(batch, text), field))

    return documents.select(key, text).transform(shipped).mapInArrow(work, f"`{key}` {kind}, {MEASURES}")


def keep(documents: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows whose text is kept, all columns as they are."""

    def work(batches):
        for batch in pieces(batches, text):
            yield batch.filter(pa.array(judge(texts(batch, text), field)[6], pa.bool_()))

    return documents.transform(shipped).mapInArrow(work, documents.schema)
