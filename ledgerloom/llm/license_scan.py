"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a window of consecutive words over more than one line:
as many words as the template has, divided by `threshold`, so that a wrapped statement
with a few other words between is met. It matches a template if it holds at least the
share `threshold` of the template's distinct words. A window counts where none of its lines
holds as much, and of overlapping ones of a template the best, then the first. The join is exact and
filters before it verifies: the words of all templates are ordered by the number of
documents of the whole corpus that hold them, rarest first; a match needs a
word of the template's prefix (all but the last ceil(threshold * size) - 1 words in
that order), enough distinct words in the block, and, from the first common
word on, enough words left in both. Pairs that remain are verified word by word.

Beside the templates, base phrases are found wherever their words stand
consecutively in a text, across lines too.

Defined cases: a null or empty text has no words, no blocks and no labels; rows
are judged one by one, so repeated or null ids are harmless; a template without
words matches nothing; long texts are read whole; without documents every word counts 0.
Ids are whole numbers. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import _text as X

#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: License statements and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is dedicated to the public domain", "public-domain"),
    ("unauthorized copying or distribution of this file is strictly prohibited", "proprietary"),
)
THRESHOLD = 0.85


def _words(text: str) -> X.Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    return X.split(raw, np.array([0, len(raw)]), X.NOT_ALNUM, lower=True)


class Index:
    """The templates' words in global order, with the prefixes by word, and the phrases by hash."""

    def __init__(self, templates, phrases, threshold: float, counts: dict[bytes, int]):
        spelt = [(sorted({w.word(i) for i in range(len(w.hashes))}), label) for text, label in templates for w in [_words(text)]]
        order = sorted({x for words, _ in spelt for x in words}, key=lambda x: (counts.get(x, 0), x))
        self.spelling, rank = order, {x: i for i, x in enumerate(order)}
        hashes = np.array([int(_words(x.decode()).hashes[0]) for x in order], np.uint64)
        by_hash = np.argsort(hashes)
        self.hashes, self.rank = hashes[by_hash], by_hash
        self.templates = [(np.array(sorted(rank[x] for x in words)), label, ceil(threshold * len(words) - 1e-9)) for words, label in spelt if words]
        self.spans = [ceil(len(w.hashes) / threshold - 1e-9) if threshold else len(w.hashes) for text, _ in templates if len((w := _words(text)).hashes)]
        self.prefix = np.zeros(len(order), bool)
        self.by_word: dict[int, list[int]] = {}
        for t, (words, _, need) in enumerate(self.templates):
            for x in words[: len(words) - need + 1].tolist():
                self.prefix[x] = True
                self.by_word.setdefault(x, []).append(t)
        self.phrases: dict[int, dict[int, tuple[tuple[bytes, ...], str]]] = {}
        for text, label in phrases:
            w = _words(text)
            n = len(w.hashes)
            self.phrases.setdefault(n, {})[int(X.windows(w.hashes, n)[0])] = (tuple(w.word(i) for i in range(n)), label)

    def ranks(self, words: X.Words) -> np.ndarray:
        """Place in the global order of every word, or -1."""
        if not len(self.hashes):
            return np.full(len(words.hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hashes, self.rank[at], -1)

    def matches(self, found: list[int], n_distinct: int) -> Iterator[tuple[int, str, float]]:
        """(template, label, containment) of the templates met by a block with the sorted ranks `found` among its distinct words."""
        seen: set[int] = set()
        for j, x in enumerate(found):
            for t in self.by_word.get(x, ()):
                words, label, need = self.templates[t]
                if t in seen or n_distinct < need:
                    continue
                seen.add(t)
                if 1 + min(len(words) - int(np.searchsorted(words, x)) - 1, len(found) - j - 1) < need:
                    continue
                common = len(np.intersect1d(words, found[j:], assume_unique=True))
                if common >= need:
                    yield t, label, common / len(words)

    def wrapped(self, words: X.Words, rank: np.ndarray, line: np.ndarray, shares: dict[tuple[int, int], float]) -> Iterator[tuple[int, str, float]]:
        """(first word, label, containment) of the windows over lines that meet a template; shares: of (line, template) where a line does."""
        hot = np.flatnonzero(rank >= 0)
        ends_at = hot + words.left[hot]
        for t, (own, label, need) in enumerate(self.templates):
            among = np.isin(rank[hot], own)
            at, until = hot[among], np.minimum(hot[among] + self.spans[t], ends_at[among])
            rare = at[np.isin(rank[at], own[: len(own) - need + 1])]
            if not len(rare):
                continue
            next_rare = rare[np.minimum(np.searchsorted(rare, at - self.spans[t] + 1), len(rare) - 1)]
            near = np.abs(next_rare - at) < self.spans[t]
            at, until = at[near], until[near]
            to, distinct = np.searchsorted(at, until), np.zeros(len(at), np.int64)
            for x in own.tolist():
                held = np.concatenate(([0], np.cumsum(rank[at] == x)))
                distinct += held[to] > held[:-1]
            maybe = np.flatnonzero((distinct >= need) & (line[at] < line[at[to - 1]]))
            found = []
            for j in maybe.tolist():
                inside = [i for i in at[j : to[j]].tolist() if words.word(i) == self.spelling[rank[i]]]
                share = len({int(rank[i]) for i in inside}) / len(own)
                if share * len(own) < need - 1e-9 or line[inside[0]] == line[inside[-1]]:
                    continue
                if all(shares.get((n, t), 0.0) < share for n in range(int(line[inside[0]]), int(line[inside[-1]]) + 1)):
                    found.append((-share, inside[0], inside[-1]))
            taken: list[tuple[int, int]] = []
            for share, a, b in sorted(found):
                k = bisect_left(taken, (a, b))
                if (k == 0 or taken[k - 1][1] < a) and (k == len(taken) or b < taken[k][0]):
                    taken.insert(k, (a, b))
                    yield a, label, -share

    def places(self, words: X.Words, left: np.ndarray) -> Iterator[tuple[int, str]]:
        for n, known in self.phrases.items():
            h = X.windows(words.hashes, n)
            maybe = np.flatnonzero(np.isin(h, np.array(list(known), np.uint64)))
            for i in maybe[left[maybe] >= n].tolist():
                spelt, label = known[int(h[i])]
                if all(words.word(i + k) == w for k, w in enumerate(spelt)):
                    yield i, label


def _scan(column: pa.Array, index: Index) -> Iterator[tuple[int, list[tuple[int, str]], list[tuple[int, str, float]]]]:
    """Words, phrase places (word, label) and matched blocks (first line, label, containment) of each text."""
    for _, _, raw, offsets in X.pieces(column):
        words = X.split(raw, offsets, X.NOT_ALNUM, lower=True)
        first, text_of = words.first, words.text_of
        base: dict[int, list[tuple[int, str]]] = {}
        blocks: dict[int, list[tuple[int, str, float]]] = {}
        for i, label in index.places(words, words.left):
            base.setdefault(int(text_of[i]), []).append((i - int(first[text_of[i]]), label))
        rank = index.ranks(words)
        hot = np.flatnonzero(rank >= 0)
        hot = hot[index.prefix[rank[hot]]] if len(hot) else hot
        if len(hot):
            breaks = np.flatnonzero(raw == 10)
            line = np.searchsorted(breaks, words.start) + text_of  # unique over texts: a text's end is a break too
            shares: dict[tuple[int, int], float] = {}
            number = lambda i: int(np.searchsorted(breaks, words.start[i]) - np.searchsorted(breaks, offsets[text_of[i]]))  # noqa: B023, E731
            for at in np.unique(line[hot]).tolist():
                a, b = np.searchsorted(line, [at, at + 1])
                own = [i for i in range(a, b) if rank[i] >= 0 and words.word(i) == index.spelling[rank[i]]]
                found = sorted({int(rank[i]) for i in own})
                text = int(text_of[a])
                for t, label, share in index.matches(found, len(np.unique(words.hashes[a:b]))):
                    shares[at, t] = share
                    blocks.setdefault(text, []).append((number(a), label, share))
            for i, label, share in index.wrapped(words, rank, line, shares):
                blocks.setdefault(int(text_of[i]), []).append((number(i), label, share))
        for t, n in enumerate(words.counts.tolist()):
            yield n, sorted(base.get(t, [])), sorted(blocks.get(t, []))


def document_frequencies(docs: DataFrame, templates=TEMPLATES, *, text_col: str = "text") -> dict[bytes, int]:
    """Documents of the whole table that hold each word of the templates."""
    plain = Index(templates, (), 1.0, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plain.spelling), np.int64)
        for batch in batches:
            for _, _, raw, offsets in X.pieces(batch.column(0)):
                words = X.split(raw, offsets, X.NOT_ALNUM, lower=True)
                rank = plain.ranks(words)
                hit = rank >= 0
                pairs = np.unique(words.text_of[hit] * len(total) + rank[hit])
                total += np.bincount(pairs % len(total), minlength=len(total)) if len(pairs) else 0
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["w", "n"])

    rows = docs.select(text_col).mapInArrow(count, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {plain.spelling[r.w]: r.n for r in rows}


def scan(docs: DataFrame, *, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, base (word, label) of every phrase, and blocks (first line, label, containment) of every matched block."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, phrases, threshold, document_frequencies(docs, templates, text_col=text_col)))
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    block_type = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_scan(batch.column(1), index.value))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in base] for _, base, _ in found], base_type),
                    pa.array([[{"line": i, "label": x, "containment": c} for i, x, c in blocks] for _, _, blocks in found], block_type),
                ],
                names=["doc_id", "n_words", "base", "blocks"],
            )

    schema = "doc_id bigint, n_words bigint, base array<struct<word:bigint,label:string>>, blocks array<struct<line:bigint,label:string,containment:double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query op10 from the rows of scan; a phrase scores 1, a block its containment."""
    base = F.array_sort(F.array_distinct("base.label"))
    both = F.array_sort(F.array_union("base.label", "blocks.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )


_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH t AS (SELECT list_distinct(string_split(x, ' ')) AS t, label FROM (VALUES {", ".join(f"('{t}', '{x}')" for t, x in TEMPLATES)}) AS v(x, label)),
ph AS (SELECT string_split(x, ' ') AS x, label FROM (VALUES {", ".join(f"('{t}', '{x}')" for t, x in PHRASES)}) AS v(x, label)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_ALNUM}'), lambda x: x <> '') AS w, {_LOWER} AS text FROM documents),
p AS (SELECT doc_id, p - 1 AS p, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), ph WHERE w[p] = x[1] AND w[p : p + len(x) - 1] = x),
b AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id),
l AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(x, '{_ALNUM}'), lambda y: y <> '')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(t, w)) / len(t)::DOUBLE AS share FROM l, t WHERE len(list_intersect(t, w)) >= ceil({THRESHOLD} * len(t) - 1e-9)),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word, CAST(b.z AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""
