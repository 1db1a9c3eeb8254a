"""Toxicity by a lexicon, misspellings included, and the context of each hit.

The lexicon is a trie of words and word beginnings that training texts marked toxic have far
more often than others. A word is matched by the trie and Levenshtein automata run side by
side: a state is the set of trie nodes within reach and the edits spent, and states are made
when first met. A misspelled term (one edit, from ``FUZZY`` characters on) is a hit of its
own kind, so training can weigh it less. A hit weighs its term's log odds.

The words around a hit tell quotation from abuse: a hit inside quotation marks, or after a
reporting word, counts apart from the others. A logistic model turns the counts of a text
into a score from 0 to 1.

Lexicon and model are fitted here on at most ``SAMPLE`` training texts of each label, those
of the least key digests, less near copies among them: one of the texts that share the least
digest of their word shingles, by any of ``SKETCHES`` digests, is enough. Training rows are those whose key digest is not held out; label,
language, source and key are never inputs of a score. Every text is scored whole.

Null texts count as empty and, like texts without a hit, get the score of no evidence.
Repeated rows are scored one by one. Rows with a null key are scored and train nothing.
Without training texts of both labels every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import pieces, record_batch, shipped, texts

SAMPLE = 4000
THRESHOLD = 0.3
#: Characters from which a term may be misspelled, and a word beginning may be a term.
FUZZY, STEM = 5, 4
#: Evidence a term needs: texts, deviations (signed root of the log-likelihood ratio), and
#: share of toxic texts if both labels had equally many.
LEAST, DEVIATIONS, PRECISION = 5, 5.2, 0.75
#: Words before a hit in which a reporting word marks a quotation.
CONTEXT = 4
#: Digests of shingles of ``SHINGLE`` words by which training texts are near copies.
SKETCHES, SHINGLE = 3, 6
MAX_STATES, REMEMBERED = 50_000, 1 << 18
FEATURES = 7

REPORTING = frozenset(
    "said says wrote writes called calls quoted quote sagte sagt schrieb nannte zitat "
    "dit disait écrit appelé dijo dice escribió llamó cita".split()
)
_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile("\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»")


class Lexicon:
    """Terms as a trie, matched with up to one edit by automata made on the way."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        """Words and word beginnings with their weights."""
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.depth = [0]
        self.reach = [0]
        for terms, ends, term in [(words, self.word, w) for w in words] + [(stems, self.stem, s) for s in stems]:
            node = 0
            self.reach[0] = max(self.reach[0], len(term))
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.word.append(0.0)
                    self.stem.append(0.0)
                    self.depth.append(self.depth[node] + 1)
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], len(term))
            ends[node] = terms[term]
        self._restart()

    def _restart(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.open = self._state({(0, 0)})

    def _state(self, members: set[tuple[int, int]]) -> int:
        """The automaton's state of trie nodes and edits, with letters left out of the word."""
        todo = list(members)
        while todo:
            node, edits = todo.pop()
            if edits == 0:
                for child in self.children[node].values():
                    if self.reach[child] >= FUZZY and (child, 1) not in members:
                        members.add((child, 1))
        state = frozenset((n, e) for n, e in members if e == 0 or (n, 0) not in members)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return self.number[state]

    def _step(self, state: int, letter: str) -> int:
        members = set()
        for node, edits in self.states[state]:
            if self.stem[node] and (edits == 0 or self.depth[node] >= FUZZY + 2):
                members.add((node, edits))  # a word beginning stays matched
            children = self.children[node]
            if letter in children:
                members.add((children[letter], edits))
            if edits == 0 and self.reach[node] >= FUZZY:
                members.add((node, 1))
                members.update((c, 1) for c in children.values() if self.reach[c] >= FUZZY)
        return self._state(members)

    def match(self, word: str) -> tuple[int, float] | None:
        """Edits between the word and its nearest term, and the largest weight of such a term."""
        if len(self.states) > MAX_STATES:
            self._restart()
        state = self.open
        for letter in word:
            moves = self.moves[state]
            if letter not in moves:
                moves[letter] = self._step(state, letter)
            state = moves[letter]
            if not self.states[state]:
                return None
        best = None
        for node, edits in self.states[state]:
            for weight, least in ((self.word[node], FUZZY), (self.stem[node], FUZZY + 2)):
                if weight and (edits == 0 or self.depth[node] >= least):
                    best = min(best or (2, 0.0), (edits, -weight))
        return best and (best[0], -best[1])


def terms_of(text: str) -> set[str]:
    """A text's words, ended by a space, and their beginnings."""
    words = set(_WORD.findall(text.lower()))
    return {word + " " for word in words} | {word[:k] for word in words for k in range(STEM, len(word) + 1)}


def sketch(text: str) -> list[int]:
    """The least digests of the text's word shingles."""
    words = text.encode().lower().split()
    shingles = {b" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE, 0) + 1)}
    least = [min(xxhash.xxh64_intdigest(shingle, seed) for shingle in shingles) for seed in range(SKETCHES)]
    return [value - (value >> 63 << 64) for value in least]


def choose_terms(
    counts: dict[str, tuple[int, int]], toxic: int, clean: int
) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings with strong evidence, the general ones first, and their log odds."""
    strong, share = {}, toxic / (toxic + clean)
    for term, (a, b) in counts.items():
        if a < LEAST or a < PRECISION * (a + b * toxic / clean):
            continue
        ratio = a * math.log(a / ((a + b) * share))
        if b:
            ratio += b * math.log(b / ((a + b) * (1 - share)))
        if 2 * ratio >= DEVIATIONS**2:
            strong[term] = a
    longer = Counter()
    for term, a in strong.items():
        longer[term[:-1]] = max(longer[term[:-1]], a)
    words, stems = {}, {}
    for term in sorted(strong, key=lambda t: (len(t), t)):
        if any(term.startswith(stem) for stem in stems):
            continue
        a, b = counts[term]
        weight = math.log((a + 0.5) / (b * toxic / clean + 0.5))
        if term[-1] == " ":
            words[term[:-1]] = weight
        elif longer[term] < 0.9 * strong[term]:
            stems[term] = weight  # no single longer term has nearly all its texts
    return words, stems


def hits_of(
    text: str, found: dict[str, tuple[int, float] | None]
) -> tuple[int, list[tuple[int, int, int, float, bool]]]:
    """Number of words, and of each hit: start, end, edits, weight, whether it is quoted."""
    spans = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text)]
    quoted = [m.span() for m in _QUOTED.finditer(text)]
    hits, at = [], 0
    for i, (start, end, word) in enumerate(spans):
        hit = found.get(word)
        if hit is None:
            continue
        while at < len(quoted) and quoted[at][1] < end:
            at += 1
        inside = at < len(quoted) and quoted[at][0] < start and end < quoted[at][1]
        reported = any(before in REPORTING for _, _, before in spans[max(0, i - CONTEXT) : i])
        hits.append((start, end, *hit, inside or reported))
    return len(spans), hits


def features_of(text: str, lexicon: Lexicon, known: dict[str, tuple[int, float] | None]) -> tuple[list[float], list]:
    """Numbers for the model, and the hits they come from."""
    words = set(_WORD.findall(text.lower()))
    for word in words.difference(known):
        known[word] = lexicon.match(word)
    if not any(known[word] is not None for word in words):
        return [0.0] * FEATURES, []
    n, hits = hits_of(text, known)
    sums = Counter()
    for _, _, edits, weight, quoted in hits:
        sums[edits, quoted] += weight
    plain = [weight for _, _, edits, weight, quoted in hits if not edits and not quoted]
    kinds = {known[word][1] for word in words if known[word] and not known[word][0]}
    return [
        max(plain, default=0.0),
        math.log1p(sums[0, False]),
        math.log1p(sums[1, False]),
        math.log1p(sums[0, True]),
        math.log1p(sums[1, True]),
        min(100 * (sums[0, False] + sums[1, False]) / n, 60.0) / 30,
        math.log1p(sum(kinds)),
    ], hits


def _sigmoid(odds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-odds))


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a little shrinkage, by Newton steps; the bias comes last."""
    x = np.c_[x, np.ones(len(x))]
    theta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        theta = theta + np.linalg.solve(hessian, x.T @ (y - p) - ridge * theta)
    return theta


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] | None = None


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from at most ``sample`` training texts of each label (1 toxic, 0 not)."""
    usable = (
        labels.where(F.col(key).isNotNull() & F.col(toxic).isin(0, 1) & ~held_out(key))
        .groupBy(key)
        .agg(F.max(toxic).cast("int").alias("label"))
    )
    order = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    chosen = [usable.where(F.col("label") == label).orderBy(*order).limit(sample) for label in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    sampled = documents.select(key, text).join(F.broadcast(chosen), key)
    sketches = "text string, label int, " + ", ".join(f"s{i} long" for i in range(SKETCHES))

    def sketched(batches):
        schema = pa.schema([("text", pa.large_string()), ("label", pa.int32())] + [(f"s{i}", pa.int64()) for i in range(SKETCHES)])
        for batch in pieces(batches, "text"):
            values = texts(batch)
            yield record_batch(schema, values, batch.column("label"), *map(list, zip(*map(sketch, values))))

    # One text for each key, so that the bound holds, and the same ones in every run.
    sampled = sampled.groupBy(key).agg(F.min(F.struct("label", F.col(text).alias("text"))).alias("row"))
    sampled = sampled.select("row.text", "row.label").transform(shipped).mapInArrow(sketched, sketches)
    names = [f"s{i}" for i in range(SKETCHES)]
    for name in names:
        rest = F.struct(*(other for other in names if other != name), "text")
        sampled = sampled.groupBy("label", name).agg(F.min(rest).alias("row")).select("label", name, "row.*")
    sampled = sampled.select("text", "label").persist()
    try:
        sizes = dict(sampled.groupBy("label").count().collect())
        toxic_texts, clean_texts = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic_texts or not clean_texts:
            return Model()
        def count(batches):
            schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
            for batch in pieces(batches, "text"):
                of = Counter(), Counter()
                for value, label in zip(texts(batch), batch.column("label").to_pylist()):
                    of[label].update(terms_of(value))
                names = list(of[0] | of[1])
                yield record_batch(schema, names, [of[1][n] for n in names], [of[0][n] for n in names])

        counts = (
            sampled.transform(shipped).mapInArrow(count, "term string, toxic long, clean long")
            .groupBy("term")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            # At most so many terms pass: those of all sampled toxic texts over LEAST.
            .where((F.col("toxic") >= LEAST) & (F.col("toxic") * clean_texts >= 5 * F.col("clean") * toxic_texts))
        )
        words, stems = choose_terms({r.term: (r.toxic, r.clean) for r in counts.collect()}, toxic_texts, clean_texts)

        def measure(batches):
            schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])
            lexicon, known = Lexicon(words, stems), {}
            for batch in pieces(batches, "text"):
                rows = [features_of(value, lexicon, known)[0] for value in texts(batch)]
                yield record_batch(schema, batch.column("label"), rows)

        rows = sampled.transform(shipped).mapInArrow(measure, "label int, x array<double>").collect()
    finally:
        sampled.unpersist()
    rows.sort(key=lambda row: (row.label, row.x))
    x, y = np.array([row.x for row in rows]), np.array([row.label for row in rows], float)
    weight = fit_weights(x, y)
    # Balanced sampling shifts the log odds by the ratio of the labels' shares.
    shares = dict(usable.groupBy("label").count().collect())
    weight[-1] += math.log(shares[1] / shares[0]) - math.log(toxic_texts / clean_texts)
    return Model(words, stems, weight.tolist())


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, hits: the score and the spans found, with edits, weight and whether quoted."""
    kind = documents.schema[key].dataType.simpleString()
    names = ("start", "end", "edits", "weight", "quoted")
    hit = pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))))

    def work(batches):
        lexicon = Lexicon(model.words, model.stems)
        weights = np.array(model.weights or [0.0] * FEATURES + [-math.inf])
        known: dict[str, tuple[int, float] | None] = {}
        for batch in pieces(batches, text):
            if len(known) > REMEMBERED:
                known.clear()
            found = [features_of(value, lexicon, known) for value in texts(batch, text)]
            odds = np.array([x for x, _ in found]).reshape(-1, FEATURES) @ weights[:-1] + weights[-1]
            hits = [[dict(zip(names, h)) for h in each] for _, each in found]
            schema = pa.schema([batch.schema.field(key), ("score", pa.float64()), ("hits", pa.list_(hit))])
            yield record_batch(schema, batch.column(key), _sigmoid(odds), hits)

    spans = "array<struct<start:long,end:long,edits:long,weight:double,quoted:boolean>>"
    return documents.select(key, text).transform(shipped).mapInArrow(work, f"`{key}` {kind}, score double, hits {spans}")
