"""Vectors of texts: an encoder that each Python worker builds once, and one that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Turns texts into rows of a matrix.
Encoder = Callable[[list[str]], np.ndarray]


def encoded(text: Column, make: Callable[[], Encoder]) -> Column:
    """The vectors of the texts by the encoder that `make` builds, once per task; null for a null text.

    It fails open: where the encoder can't be built or fails on a batch, the batch has no vectors.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            encode = make()
        except Exception:
            encode = None
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            some = texts[texts.notna()]
            if encode is not None and len(some):
                try:
                    out[some.index] = [np.asarray(v, np.float64).tolist() for v in encode(some.tolist())]
                except Exception:
                    pass
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)


def hashing_encoder(width: int = 512, size: int = 3) -> Encoder:
    """Counts of runs of `size` characters of the lower-cased text, hashed to `width` places."""

    places: dict[str, int] = {}

    def place(gram: str) -> int:
        at = places.get(gram)
        if at is None:
            at = int(hashlib.md5(gram.encode()).hexdigest()[:6], 16) % width
            if len(places) < 1_000_000:
                places[gram] = at
        return at

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for row, text in zip(out, texts, strict=True):
            low = text.lower()
            np.add.at(row, [place(low[i : i + size]) for i in range(len(low) - size + 1)], 1.0)
        return out

    return encode
