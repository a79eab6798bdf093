"""License scans: exact set-similarity join of text blocks with license templates.

A template is the set of its words. A block contains it when at least ``THETA`` of the template's words
are among the block's words. The join is exact and filtered the usual way: the words of all templates are
ordered by how many documents have them (rarest first), counted over the whole corpus; a block can only reach
the threshold if it holds one of a template's first ``|T| - ceil(THETA |T|) + 1`` words (prefix filter), if
it has enough words (length filter), and if enough of the template's words are left from the first shared
one on (positional filter).

A block that holds enough words is judged once more, because templates share most of their words. Of the words that
no other label's templates have, weighted by their rarity in the corpus, it must hold as large a part too; and if all
words it shares with a template are among those that the same place shares with a larger part of another
label's, it is that label's.

The blocks for a template of m words are all windows of 2m words that start at a multiple of m, so every run
of up to m words lies wholly inside one of them, however long the text is and wherever lines break.
The templates are a fixed list of this module and go along with the task; the corpus is never shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.llm import tokens as T

THETA = 0.8

# fixed values: phrases whose every place counts, with their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# fixed values: notices as the licenses' own texts word them
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
        " free software foundation either version 3 of the license",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
    " labels string, score double, blocks array<struct<label:string,first_word:long,containment:double>>"
)
_BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))


def _hashes(text: str) -> list[int]:
    return [int(T.word_hash(w)) for w in text.split()]


def _count_words(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, at in T.chunks(batch.column(0)):
                w = T.words(data, at, T.PUNCTUATION)
                place = np.searchsorted(vocabulary, w.hash).clip(max=len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[place] == w.hash)
                pairs = np.unique(w.text_of()[hit] * len(vocabulary) + place[hit])
                found += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(found)], ["word", "docs"])

    return count


def word_counts(docs: DataFrame, templates: dict[str, list[str]]) -> dict[int, int]:
    """Documents that have each template word, over the whole corpus."""
    vocabulary = np.unique(np.array([h for texts in templates.values() for t in texts for h in _hashes(t)], np.uint64))
    rows = docs.select("text").mapInArrow(_count_words(vocabulary), "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    # one row per word of the fixed templates
    seen = {r["word"]: r["docs"] for r in rows.collect()}
    return {int(h): seen.get(i, 0) for i, h in enumerate(vocabulary)}


def ranks_of(counts: dict[int, int]) -> dict[int, int]:
    """Rank of each template word, rarest first."""
    return {h: rank for rank, h in enumerate(sorted(counts, key=lambda h: (counts[h], h)))}


def weights_of(counts: dict[int, int]) -> dict[int, float]:
    """Weight of each template word: 1 for the commonest, more for rare ones."""
    most = max([1, *counts.values()])
    return {h: math.log((most + 1) / (n + 1)) + 1 for h, n in counts.items()}


def word_order(docs: DataFrame, templates: dict[str, list[str]]) -> dict[int, int]:
    """Rank of each template word by the documents that have it, rarest first."""
    return ranks_of(word_counts(docs, templates))


class Join:
    """The filtered join of the words of one text with all templates."""

    def __init__(self, order: dict[int, int], templates: dict[str, list[str]], theta: float = THETA, weight: dict[int, float] | None = None) -> None:
        self.templates, self.theta = [], theta
        labels_of: dict[int, set[str]] = {}
        for label, texts in templates.items():
            for text in texts:
                for h in _hashes(text):
                    labels_of.setdefault(h, set()).add(label)
        self.words = np.array(sorted(order), np.uint64)
        self.rank = np.array([order[int(h)] for h in self.words], np.int64)
        for label, texts in templates.items():
            for text in texts:
                hashes = _hashes(text)
                ranks = sorted({order[h] for h in hashes})
                need = math.ceil(theta * len(ranks) - 1e-9)
                # the words that set the label apart, with their weights
                own = {order[h]: (weight or {}).get(h, 1.0) for h in hashes if len(labels_of[h]) == 1}
                self.templates.append((label, len(hashes), np.array(ranks), need, np.array(ranks[: len(ranks) - need + 1]), own))

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of template words, and their ranks."""
        place = np.searchsorted(self.words, hashes).clip(max=len(self.words) - 1)
        at = np.flatnonzero(self.words[place] == hashes)
        return at, self.rank[place[at]]

    def blocks(self, at: np.ndarray, rank: np.ndarray, n_words: int) -> list[tuple[str, int, float]]:
        """(label, first word of the block, containment) of all blocks at or above the threshold."""
        return [(label, first, share) for label, first, _, share, _, _ in self._found(at, rank, n_words)]

    def judged(self, at: np.ndarray, rank: np.ndarray, n_words: int) -> list[tuple[str, int, float]]:
        """Those of them that hold the words that set their label apart, and that no other label's block has a better claim to."""
        return [(label, first, share) for label, first, _, share, _, _ in self._best([b for b in self._found(at, rank, n_words) if b[5]])]

    def _found(self, at: np.ndarray, rank: np.ndarray, n_words: int) -> list[tuple[str, int, int, float, set[int], bool]]:
        """(label, first word, end, containment, words held, whether they set the label apart)."""
        found = []
        for label, m, ranks, need, prefix, own in self.templates:
            starts = at[np.isin(rank, prefix)]
            if not len(starts) or n_words < need:
                continue
            # blocks of 2m words that start at a multiple of m and hold a prefix word
            for first in np.unique(np.concatenate([starts // m * m, np.maximum(starts // m - 1, 0) * m])).tolist():
                a, b = np.searchsorted(at, [first, first + 2 * m])
                if min(n_words, first + 2 * m) - first < need:
                    continue
                mine = np.unique(rank[a:b])
                mine = mine[np.isin(mine, ranks)]
                # what is left of the template from its first shared word on bounds the overlap
                if not len(mine) or len(ranks) - np.searchsorted(ranks, mine[0]) < need:
                    continue
                held = set(mine.tolist())
                apart = sum(w for r, w in own.items() if r in held) >= self.theta * sum(own.values()) - 1e-9
                if len(mine) >= need:
                    found.append((label, first, first + 2 * m, len(mine) / len(ranks), held, apart))
        return found

    @staticmethod
    def _best(found: list[tuple]) -> list[tuple]:
        """All blocks but those whose words another label's block at the same place holds, and more."""
        found = sorted(found, key=lambda b: (b[1], b[0], b[2]))
        widest = max((end - first for _, first, end, *_ in found), default=0)
        firsts = [b[1] for b in found]
        out = []
        for b in found:
            near = found[bisect_left(firsts, b[1] - widest) : bisect_left(firsts, b[2])]
            if not any(o[0] != b[0] and o[2] > b[1] and b[4] < o[4] for o in near):
                out.append(b)
        return out


def _scanner(counts: dict[int, int], templates: dict[str, list[str]], theta: float):
    phrases = [(label, _hashes(text)) for text, label in PHRASES.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Join(ranks_of(counts), templates, theta, weights_of(counts))
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(1)):
                w = T.words(data, at, T.PUNCTUATION)
                text = w.text_of()
                places, labels = [], []
                for label, hashes in phrases:
                    run = len(w.hash) - len(hashes) + 1
                    if run <= 0:
                        continue
                    same = text[:run] == text[len(hashes) - 1 :]
                    for j, h in enumerate(hashes):
                        same &= w.hash[j : j + run] == np.uint64(h)
                    places.append(np.flatnonzero(same))
                    labels += [label] * len(places[-1])
                place = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
                base: dict[int, list[tuple[int, str]]] = {}
                for p, label in zip(place.tolist(), labels):
                    base.setdefault(int(text[p]), []).append((p - int(w.of[text[p]]), label))
                known, rank = join.known(w.hash)
                cut = np.searchsorted(known, w.of)
                rows = []
                for i in range(last - first):
                    n = int(w.of[i + 1] - w.of[i])
                    mine = base.get(i, [])
                    a, b = cut[i], cut[i + 1]
                    blocks = join.judged(known[a:b] - w.of[i], rank[a:b], n) if b > a else []
                    own = {label for _, label in mine}
                    rows.append((
                        n, len(mine), min((p for p, _ in mine), default=None), max((p for p, _ in mine), default=None),
                        ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in blocks})),
                        1.0 if own else max((x[2] for x in blocks), default=0.0),
                        [{"label": x, "first_word": p, "containment": c} for x, p, c in blocks],
                    ))
                columns = list(zip(*rows))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _BLOCKS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last].cast(pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
                )

    return scan


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, theta: float = THETA) -> DataFrame:
    """One row per row of ``docs``: places of the phrases, all labels, and every block that contains a template of its label.

    ``score`` is the largest containment found, 1 where a phrase stands word for word, 0 without any. Null
    and empty texts have no words, no label and score 0. Repeated rows are scanned each on their own; further
    columns of ``docs`` are not looked at.
    """
    templates = templates or TEMPLATES
    return docs.select("doc_id", "text").mapInArrow(_scanner(word_counts(docs, templates), templates, theta), SCHEMA)
