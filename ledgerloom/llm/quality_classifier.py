"""Quality classifier: a regularised quadratic discriminant over text statistics.

Each text becomes a vector of transformed statistics (logarithms, logits of
shares). Each class has a mean and a covariance, shrunk towards the pooled
covariance and then towards a multiple of the identity; its Cholesky factor is
computed once and broadcast. The score of a text is the difference of the two
Mahalanobis log densities, put on the scale of probabilities by a logistic fit
to the training rows.

Defined cases: a null text is scored as the empty text; rows are scored one by
one, so repeated or null ids are harmless (a null id is not held out); labels
other than 0 and 1, or null, are not used; if a class has fewer than two
labelled rows, the share of label 1 (0.5 without labels) is every text's score.
Texts are read whole. Ids are whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import by_place
from ledgerloom.llm import _labelled, _text as X

#: Shares of the pooled covariance and of the scaled identity in a class's covariance.
POOLED, RIDGE = 0.1, 0.05
#: A text of n words keeps n / (n + SOFT) of its distance from the average: short texts tell little.
SOFT = 10.0
THRESHOLD = 0.3
LEARN_FOLDS = 5


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (whole + 1.0))


#: Kinds of bytes; each byte is of one.
_KINDS = ("other", "upper", "lower", "digit", "wide", "mark", "symbol", "!", ".", ",", "|", "space", "line")
_KIND = np.zeros(256, np.uint8)
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = _KINDS.index("mark")
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = (_KINDS.index(k) for k in ("upper", "lower", "digit", "wide"))
_KIND[[ord(c) for c in "#*$%&<>"]] = _KINDS.index("symbol")
for _c in "!.,|":
    _KIND[ord(_c)] = _KINDS.index(_c)
_KIND[32], _KIND[10] = _KINDS.index("space"), _KINDS.index("line")


def _mean_and_spread(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each row's values, 0 without values."""
    count = np.maximum(np.bincount(row, minlength=n), 1)
    mean = np.bincount(row, values, n) / count
    return mean, np.sqrt(np.bincount(row, (values - mean[row]) ** 2, n) / count)


def _repeats(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often the most frequent occurs."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, int)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row[first], np.diff(np.concatenate((first, [len(h)]))))
    return np.bincount(row[first], minlength=n), most


def _packed(raw: np.ndarray) -> int:
    packer = zlib.compressobj(1)
    return len(packer.compress(raw)) + len(packer.flush())


def _chunk_statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * len(_KINDS), size) + _KIND[raw], minlength=n * len(_KINDS)).reshape(n, -1)
    of = lambda *names: sum(kinds[:, _KINDS.index(k)] for k in names)
    whole, letters = np.maximum(size, 1), of("upper", "lower", "wide")

    words = X.split(raw, offsets)
    count, row = words.counts, words.text_of
    distinct, most = _repeats(words.hashes, row, n)
    twice = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1]))
    cased = np.concatenate(([0], np.cumsum(_KIND[raw] == _KINDS.index("upper")))), np.concatenate(([0], np.cumsum(_KIND[raw] == _KINDS.index("lower"))))
    upper, lower = (x[words.end] - x[words.start] for x in cased)
    shouted = np.bincount(row[(upper > 0) & (lower == 0)], minlength=n)
    word_mean, word_spread = _mean_and_spread((words.end - words.start).astype(float), row, n)

    breaks = np.flatnonzero(raw == 10)
    start, end = np.sort(np.concatenate((offsets[:-1], breaks + 1))), np.sort(np.concatenate((offsets[1:], breaks)))
    of_text = np.repeat(np.arange(n), np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=n) + 1)
    full = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)  # lines with a word
    start, end, of_text = start[full], end[full], of_text[full]
    lines = np.bincount(of_text, minlength=n)
    line_mean, line_spread = _mean_and_spread((end - start).astype(float), of_text, n)
    different, _ = _repeats(X.range_hashes(raw, start, end), of_text, n)

    packed = np.array([_packed(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    return np.stack(
        [
            np.log1p(count),
            np.log1p(word_mean),
            np.log1p(word_spread),
            _logit(of("upper"), letters),
            _logit(of("digit"), whole),
            _logit(of("wide"), letters),
            _logit(of("mark", "symbol", "!", ".", ",", "|"), whole),
            _logit(of("symbol", "|"), whole),
            _logit(of("!"), whole),
            _logit(of("."), count),
            _logit(of(","), count),
            _logit(of("|"), count),
            _logit(of("space", "line"), whole),
            _logit(distinct, count),
            _logit(most, count),
            _logit(np.bincount(row[twice], minlength=n), count),
            _logit(shouted, count),
            np.log1p(lines),
            np.log1p(line_mean),
            np.log1p(line_spread),
            _logit(lines - different, lines),
            np.log(packed / whole + 0.01),
        ],
        1,
    )


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; the first is log(1 + words)."""
    parts = [_chunk_statistics(raw, offsets) for _, _, raw, offsets in X.pieces(column)]
    return np.concatenate(parts) if parts else np.zeros((0, 22))


@dataclass
class Discriminant:
    """Class means with inverse Cholesky factors and log terms, and the logistic scale of the scores."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, float]]
    slope: float
    offset: float

    def _standard(self, vectors: np.ndarray) -> np.ndarray:
        z = (vectors - self.centre) / self.scale
        n = np.expm1(vectors[:, :1])
        return np.hstack([z[:, :1], z[:, 1:] * (n / (n + SOFT))])

    def difference(self, vectors: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = self._standard(vectors)
        logs = [terms - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, terms in self.classes]
        return logs[1] - logs[0]

    def score(self, vectors: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(vectors), self.offset)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(vectors) + self.offset, -500, 500)))


def fit_vectors(vectors: np.ndarray, y: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(np.zeros(1), np.ones(1), [], 0.0, float(y.mean()) if len(y) else 0.5)
    model = Discriminant(vectors.mean(0), vectors.std(0) + 1e-6, [], 1.0, 0.0)
    z = model._standard(vectors)
    covariances = [np.cov(z[y == k].T) for k in (0, 1)]
    shared = sum(c * (y == k).mean() for k, c in enumerate(covariances))
    for k, own in enumerate(covariances):
        c = (1 - pooled) * own + pooled * shared
        c = (1 - ridge) * c + (ridge * np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        model.classes.append((z[y == k].mean(0), np.linalg.inv(factor), float(np.log((y == k).mean()) - np.log(np.diag(factor)).sum())))
    model.slope, model.offset = _logistic(model.difference(vectors), y)
    return model


def _logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, with targets a little off 0 and 1."""
    middle, spread = s.mean(), s.std() + 1e-9
    z, ones, zeros = (s - middle) / spread, (y == 1).sum(), (y == 0).sum()
    aim, at = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2)), np.array([1.0, 0.0])
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        slope = design.T @ (p - aim) + np.array([1e-3, 0]) * at
        curve = (design * (p * (1 - p) + 1e-12)[:, None]).T @ design + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(curve, slope)
        at = at - step * min(1, 5 / (np.abs(step).max() + 1e-9))
    return float(at[0] / spread), float(at[1] - at[0] * middle / spread)


def fit(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, label: str = "quality", max_rows: int = _labelled.MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Learns from at most max_rows labels that meet `learn`; by default those outside of the held-out fold."""
    learn = _labelled.fold(F.col("doc_id"), LEARN_FOLDS) != 0 if learn is None else learn
    rows = _labelled.sample(docs, labels, label, learn, max_rows=max_rows, id_col=id_col, text_col=text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(list(statistics(b.column(0))), pa.list_(pa.float64())), b.column(1), b.column(2), b.column(3)], names=["v", "y", "o1", "o2"])

    got = rows.mapInArrow(measure, "v array<double>, y int, o1 bigint, o2 bigint").orderBy("o1", "o2", "y").limit(max_rows).select("v", "y").collect()
    return fit_vectors(np.array([r.v for r in got]), np.array([r.y for r in got]))


def score(docs: DataFrame, model: Discriminant, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and score, the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(held.value.score(statistics(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id bigint, score double")


def keep(docs: DataFrame, model: Discriminant, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score the threshold or more; all columns stay."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.score(statistics(b.column(at))) >= threshold, pa.bool_()))

    places = by_place(docs)
    return places.mapInArrow(run, places.schema).toDF(*docs.columns)
