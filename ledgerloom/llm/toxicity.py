"""Toxicity: a counterfactually regularised linear classifier.

Texts are bags of lower-cased words and of the first bytes of longer words, so that
inflected forms share a feature; one that occurs n times has the value log2(1 + n). Those that tell the labels apart are
selected by their counts in a bounded sample of labelled rows; the identity
terms (names of groups of people) are always among them. In each labelled text
with an identity term, the terms are swapped for others of their kind, and the
logistic fit is penalised for the square of the change of the score: the mere
mention of a group then weighs the same whichever group it is, and a score
moves only with words that aren't identity terms.

Where the sample has none of the given terms in MIN_TEXTS texts, as in a corpus of another language, the groups are taken from the
data: of the features that a tenth of its texts or more have, those that tell the labels apart least. They are swapped
for one another likewise, so that no neutral and common word is held against a text more than the next. `model.groups` says which were used.

Defined cases: a null text is scored as the empty text; rows are scored one by
one, so repeated or null ids are harmless (a null id is not held out); labels
other than 0 and 1, or null, are not used; ids are whole numbers; without labels of both classes every
score is the share of label 1 (0 without labels). Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import _labelled, _text as X
from ledgerloom.store import discard, stash

#: Words selected by the labels, at most; texts of the sample that hold a selected word, at least.
MAX_WORDS, MIN_TEXTS = 512, 5
#: Bytes of the stems that are features beside the whole words.
STEMS = (4, 6)
L2, FAIR = 0.3, 10.0
THRESHOLD = 0.7
#: Features that stand in for identity terms where the sample has none, and the least share of its texts that have each.
NEUTRAL, NEUTRAL_SHARE = 16, 0.1
LEARN_FOLDS, HELD_FOLD = 3, 1

#: Kinds of identity terms; a term is swapped for the others of its kind.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly"),
)


def _made(term: str) -> np.ndarray:
    """The features of a word: its own first."""
    raw = term.encode()
    return _features(X.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), X.NOT_ALNUM, lower=True))[1]


def _values(column: pa.Array, known: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, feature, value) of the distinct features of each text: the hash, or the place in the sorted array `known`."""
    for a, _, raw, offsets in X.pieces(column):
        words = X.split(raw, offsets, X.NOT_ALNUM, lower=True)
        row, h = _features(words)
        if known is not None:
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            row, h = row[hit], at[hit]
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        yield a + row[first], h[first], np.log2(1 + np.diff(np.concatenate((first, [len(h)]))))


def _features(words: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of the stems of longer words."""
    rows, hashes = [words.text_of], [words.hashes]
    for length in STEMS:
        long = np.flatnonzero(words.end - words.start > length)
        if len(long):
            start = words.start[long]
            rows.append(rows[0][long])
            hashes.append(X.mix(X.range_hashes(words.data, start, start + length) + np.uint64(length)))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Linear:
    """Sorted word hashes with weights; the offset is that of a text without any of them."""

    words: np.ndarray
    weights: np.ndarray
    offset: float
    #: "terms" if identity terms were swapped in the fit, "neutral" if features from the data were, else "none".
    groups: str = "none"

    def score(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.offset)
        if len(self.words):
            for row, at, value in _values(column, self.words):
                np.add.at(total, row, self.weights[at] * value)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


@dataclass
class Kind:
    """The places of a kind's terms among the features, and for each term the features that it makes (itself and its stems)."""

    terms: np.ndarray
    makes: np.ndarray


def swap_changes(x: np.ndarray, kinds: list[Kind], turn: int) -> np.ndarray:
    """Of the rows with an identity term, the features lost less those gained when each term becomes the turn-th after it of its kind."""
    change = np.zeros_like(x)
    for kind in kinds:
        if turn % len(kind.terms):
            change += x[:, kind.terms] @ (kind.makes - np.roll(kind.makes, -turn, axis=0))
    return change[np.abs(change).any(1)]


def fit_matrix(x: np.ndarray, y: np.ndarray, kinds: list[Kind], l2: float = L2, fair: float = FAIR) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise log loss + l2 |w|^2 / 2 + fair times the mean squared change under swaps, by Newton steps."""
    n, k = x.shape
    design, at = np.hstack([x, np.ones((n, 1))]), np.zeros(k + 1)
    ridge = np.diag([l2] * k + [1e-6])
    for turn in range(1, max((len(kind.terms) for kind in kinds), default=1)):
        change = swap_changes(x, kinds, turn)
        if len(change):
            ridge[:-1, :-1] += 2 * fair * n / len(change) * (change.T @ change)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        slope = design.T @ (p - y) + ridge @ at
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge, slope)
        at = at - step * min(1, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return at[:-1], float(at[-1])


def fit(
    docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, label: str = "toxic", max_rows: int = _labelled.MAX_ROWS, max_words: int = MAX_WORDS,
    min_texts: int = MIN_TEXTS, l2: float = L2, fair: float = FAIR, identities: tuple[tuple[str, ...], ...] = IDENTITIES, neutral: int = NEUTRAL, id_col: str = "doc_id", text_col: str = "text",
) -> Linear:
    """Learns from at most max_rows labels that meet `learn`; by default those outside of the held-out fold.

    neutral=0 leaves out the groups from the data.
    """
    learn = _labelled.fold(F.col("doc_id"), LEARN_FOLDS) != HELD_FOLD if learn is None else learn
    rows = stash(_labelled.sample(docs, labels, label, learn, max_rows=max_rows, id_col=id_col, text_col=text_col), "sample")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_numpy()
            for row, h, _ in _values(b.column(0), None):
                word, at = np.unique(h, return_inverse=True)
                ones = np.bincount(at, y[row], len(word)).astype(np.int64)
                yield pa.record_batch([X.signed(word), ones, np.bincount(at, minlength=len(word)).astype(np.int64)], names=["h", "ones", "n"])

    texts = rows.agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).first()
    ones, n = int(texts.ones or 0), int(texts.n)
    if not 0 < ones < n:
        discard(rows)
        return Linear(np.zeros(0, np.uint64), np.zeros(0), float(np.log(1e9) if n and ones == n else -np.log(1e9)))
    counts = stash(rows.select("text", "y").mapInArrow(spell, "h bigint, ones bigint, n bigint").groupBy("h").agg(F.sum("ones").alias("a"), F.sum("n").alias("n")).where(F.col("n") >= min_texts), "features")
    base = ones / n
    apart = F.abs(F.col("a") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    told = [r.h for r in counts.orderBy(apart.desc(), "h").limit(max_words).select("h").collect()]
    made = [[_made(term) for term in kind] for kind in identities]
    own = [int(X.signed(m[:1])[0]) for kind in made for m in kind]
    groups = "terms" if own and not counts.where(F.col("h").isin(own)).isEmpty() else "none"
    if groups == "none" and neutral > 1:
        plain = [r.h for r in counts.where(F.col("n") >= NEUTRAL_SHARE * n).orderBy(apart, "h").limit(neutral).select("h").collect()]
        if len(plain) > 1:
            groups, made = "neutral", [[X.unsigned(np.array([h], np.int64)) for h in plain]]
    discard(counts)
    words = np.unique(np.concatenate([X.unsigned(np.array(told, np.int64)), *(m for kind in made for m in kind)]))
    kinds = [Kind(np.searchsorted(words, [m[0] for m in kind]), np.array([np.isin(words, m) for m in kind], float)) for kind in made]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[tuple[int, float]]] = [[] for _ in range(len(b))]
            for row, at, value in _values(b.column(0), words):
                for r, w, v in zip(row.tolist(), at.tolist(), value.tolist(), strict=True):
                    found[r].append((w, v))
            lists = [pa.array([[x[k] for x in row] for row in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.float64()))]
            yield pa.record_batch([*lists, b.column(1), b.column(2), b.column(3)], names=["w", "v", "y", "o1", "o2"])

    got = rows.mapInArrow(look, "w array<int>, v array<double>, y int, o1 bigint, o2 bigint").orderBy("o1", "o2", "y").limit(max_rows).select("w", "v", "y").collect()
    discard(rows)
    x = np.zeros((len(got), len(words)), np.float32)
    for i, r in enumerate(got):
        x[i, r.w] = r.v
    weights, offset = fit_matrix(x.astype(float), np.array([r.y for r in got], float), kinds, l2, fair)
    return Linear(words, weights, offset, groups)


def score(docs: DataFrame, model: Linear, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and score, the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(held.value.score(b.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id bigint, score double")
