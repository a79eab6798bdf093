"""Language-model scoring: interpolated modified Kneser-Ney bigrams.

Counting runs in two passes over the training texts. Each task turns its texts into sorted arrays of 64-bit word and
pair hashes with counts, already added up, and deals them out by hash; each shard merges what it gets. A word that
starts more pairs than a shard should hold is spread over several shards by its second word. The shards are written
as sorted arrays to the shared folder (``spark.checkpoint.dir``, which must be a path that workers can open, such as
a mounted one) and memory-mapped by the workers that score: a batch looks its distinct words and pairs up in order.

The order is two: pair counts are about as large as the text itself, and each further order adds as much again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.llm import tokens as T
from rowledger.llm.common import new_path, partitions_for, write_once

CHUNK = 1 << 22          # bytes of text that are added up before they are dealt out
SHARD_BYTES = 24 << 20   # bytes of text per shard
BEGIN, END = T.word_hash(" begin", lower=False), T.word_hash(" end", lower=False)  # no word has a blank
# discounts where the counts of counts don't determine them (almost no text)
FALLBACK = (0.5, 1.0, 1.5)

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def token_stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous and own hash of every token, and the first token of each text; each text ends in END."""
    w = T.words(data, at)
    n = len(at) - 1
    of = w.of + np.arange(n + 1)
    own = np.empty(of[-1], np.uint64)
    own[of[1:] - 1] = END
    inner = np.ones(len(own), bool)
    inner[of[1:] - 1] = False
    own[inner] = w.hash
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[of[:-1]] = BEGIN
    return before, own, of


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return T.mix(first * np.uint64(0x9E3779B97F4A7C15) ^ second)


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], order[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def small(counts: np.ndarray) -> np.ndarray:
    """The counts in the narrowest unsigned type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: each one's type, then its values."""
    return b"".join(np.frombuffer(a.dtype.str[1:].encode().ljust(4), np.uint8).tobytes() + np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays)


def unpack(raw: bytes) -> list[np.ndarray]:
    found, i = [], 0
    while i < len(raw):
        kind, size = bytes(raw[i : i + 4]).decode().strip(), int(np.frombuffer(raw, np.int64, 1, i + 4)[0])
        found.append(np.frombuffer(raw, np.dtype(kind), size // np.dtype(kind).itemsize, i + 12))
        i += 12 + size
    return found


def merged(column: pd.Series) -> list[np.ndarray]:
    """The same arrays of all rows, one after another."""
    return [np.concatenate(x) for x in zip(*(unpack(raw) for raw in column))]


@dataclass
class Deal:
    """Which shard a pair belongs to: its first word's, or one of several for words that start very many pairs."""

    shards: int
    hot: np.ndarray    # hashes, in order
    parts: np.ndarray  # shards that each is spread over

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        shard = (first >> np.uint64(8)) % np.uint64(self.shards)
        if len(self.hot):
            place = np.searchsorted(self.hot, first).clip(max=len(self.hot) - 1)
            hot = np.flatnonzero(self.hot[place] == first)
            shard[hot] = (shard[hot] + (second[hot] >> np.uint64(8)) % self.parts[place[hot]].astype(np.uint64)) % np.uint64(self.shards)
        return shard.astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), [a[order[cut[s] : cut[s + 1]]] for a in arrays]


def _word_counts(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in T.chunks(batch.column(0), CHUNK):
                _, own, _ = token_stream(data, at)
                word, _, n = added_up(own, np.ones(len(own), np.int64))
                rows = [(s, pack(w, small(c))) for s, (w, c) in _by_shard((word >> np.uint64(8)) % np.uint64(shards), shards, word, n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])

    return count


def _pair_counts(deal: Deal):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in T.chunks(batch.column(0), CHUNK):
                before, own, _ = token_stream(data, at)
                _, place, n = added_up(pair_key(before, own), np.ones(len(own), np.int64))
                first, second = before[place], own[place]
                order = np.argsort(first, kind="stable")  # each first word is sent once, with its number of pairs
                first, second, n = first[order], second[order], n[order]
                rows = []
                for s, (a, b, c) in _by_shard(deal(first, second), deal.shards, first, second, n):
                    begins = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                    rows.append((s, pack(a[begins], small(np.diff(np.append(begins, len(a)))), b, small(c))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])

    return count


def _save(folder: str, shard: int, **arrays: np.ndarray) -> None:
    """Write arrays so that a repeated or second attempt does no harm."""
    for name, values in arrays.items():
        path = f"{folder}/{name}-{shard:06d}.npy"
        part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(part, "wb") as out:
            np.save(out, values)
        os.replace(part, path)


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _merge_pairs(folder: str, deal: Deal):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        parts = [unpack(raw) for raw in rows["data"]]
        first = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        second = np.concatenate([p[2] for p in parts])
        key, place, n = added_up(pair_key(first, second), np.concatenate([p[3].astype(np.int64) for p in parts]))
        first, second = first[place], second[place]
        context, _, total = added_up(first, n)
        kinds = [added_up(first, (np.minimum(n, 3) == k).astype(np.int64))[2] for k in (1, 2, 3)]
        _save(folder, shard, pair=key, pair_n=small(n), context=context, context_n=total, context_1=kinds[0], context_2=kinds[1], context_3=kinds[2])
        hot = np.isin(context, deal.hot)
        word, _, types = added_up(second, np.ones(len(second), np.int64))
        out = [(s, pack(w, small(c)), None, None) for s, (w, c) in _by_shard((word >> np.uint64(8)) % np.uint64(deal.shards), deal.shards, word, types)]
        # of words that are spread, every shard has a part; there are fewer of them than shards
        out.append((-1, None, _counts_of_counts(n), pack(context[hot], total[hot], *(k[hot] for k in kinds))))
        return pd.DataFrame(out, columns=["shard", "data", "coc", "hot"])

    return merge


def _merge_words(rows: pd.DataFrame) -> pd.DataFrame:
    word, n = merged(rows["data"])
    word, _, n = added_up(word, n.astype(np.int64))
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "data": [pack(word, small(n))], "tokens": [int(n.sum())], "types": [len(word)]})


def _often(least: int):
    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                word, n = unpack(raw)
                hit = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(word[hit].view(np.int64)), pa.array(n[hit].astype(np.int64))], ["word", "n"])

    return often


def _save_words(folder: str):
    def save(key: tuple[int], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        word, n = merged(left["data"])
        word, _, n = added_up(word, n.astype(np.int64))
        types = np.zeros(len(word), np.int64)
        if len(right):
            follower, kinds = merged(right["data"])
            follower, _, kinds = added_up(follower, kinds.astype(np.int64))
            types[np.searchsorted(word, follower)] = kinds  # every follower is a counted word
        _save(folder, key[0], word=word, word_n=n, word_types=types)
        return pd.DataFrame({"coc": [_counts_of_counts(types)], "types": [int(types.sum())]})

    return save


def discounts(coc: list[int]) -> np.ndarray:
    """Modified Kneser-Ney's discounts of counts 1, 2 and from 3 up; index 0 is unused."""
    n1, n2, n3, n4 = coc
    found = [0.0, *FALLBACK]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for k, (n, more) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            if n:
                found[k] = min(max(k - (k + 1) * y * more / n, 0.0), float(k))
    return np.array(found)


@dataclass
class Model:
    """What scoring needs besides the memory-mapped arrays in ``folder``."""

    folder: str
    deal: Deal
    tokens: int
    types: int
    pair_types: int
    pair_discount: np.ndarray
    word_discount: np.ndarray
    word_kinds: list[int]  # words that follow one, two, and three or more different words
    hot: list[np.ndarray]  # spread words, with count and numbers of pairs seen once, twice, oftener

    def _lookup(self, shard: np.ndarray, keys: np.ndarray, name: str, *columns: str) -> list[np.ndarray]:
        """Values of ordered keys, 0 for unknown ones."""
        found = [np.zeros(len(keys), np.int64) for _ in columns]
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.deal.shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            path = f"{self.folder}/{name}-{s:06d}.npy"
            if not os.path.exists(path):  # nothing was dealt to this shard
                continue
            mine = order[cut[s] : cut[s + 1]]
            known = np.load(path, mmap_mode="r")
            if not len(known):
                continue
            place = np.searchsorted(known, keys[mine]).clip(max=len(known) - 1)
            hit = known[place] == keys[mine]
            for values, column in zip(found, columns):
                values[mine[hit]] = np.load(f"{self.folder}/{column}-{s:06d}.npy", mmap_mode="r")[place[hit]]
        return found

    def words(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each word, and its probability by the number of different words before it."""
        n, kinds = self._lookup((word >> np.uint64(8)) % np.uint64(self.deal.shards), word, "word", "word_n", "word_types")
        even = 1 / (self.types + 1)
        if not self.pair_types:
            return n, np.full(len(word), even)
        left = sum(d * k for d, k in zip(self.word_discount[1:], self.word_kinds)) / self.pair_types
        return n, np.maximum(kinds - self.word_discount[np.minimum(kinds, 3)], 0) / self.pair_types + left * even

    def contexts(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each word as first of a pair, and the sum of its pairs' discounts."""
        names = ("context_n", "context_1", "context_2", "context_3")
        found = self._lookup((word >> np.uint64(8)) % np.uint64(self.deal.shards), word, "context", *names)
        if len(self.hot[0]):
            place = np.searchsorted(self.hot[0], word).clip(max=len(self.hot[0]) - 1)
            hit = self.hot[0][place] == word
            for values, whole in zip(found, self.hot[1:]):
                values[hit] = whole[place[hit]]
        return found[0], sum(d * x for d, x in zip(self.pair_discount[1:], found[1:]))

    def score(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Tokens, known tokens, base score and score of every text."""
        before, own, of = token_stream(data, at)
        word, word_at = np.unique(own, return_inverse=True)
        n, lower = self.words(word)
        first, first_at = np.unique(before, return_inverse=True)
        total, discount = self.contexts(first)
        key, sample, key_at = np.unique(pair_key(before, own), return_index=True, return_inverse=True)
        pairs = self._lookup(self.deal(before[sample], own[sample]), key, "pair", "pair_n")[0]
        kept = np.maximum(pairs - self.pair_discount[np.minimum(pairs, 3)], 0)[key_at]
        known = total[first_at] > 0
        scale = np.maximum(total[first_at], 1)
        p = np.where(known, kept / scale + discount[first_at] / scale * lower[word_at], lower[word_at])
        base = np.log10((n + 1) / (self.tokens + self.types + 1))[word_at]
        return [np.diff(of), T.counts_within((n > 0)[word_at], of), np.add.reduceat(base, of[:-1]), np.add.reduceat(np.log10(p), of[:-1])]


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(2), CHUNK):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last].cast(pa.int64()), batch.column(1)[first:last], *(pa.array(x) for x in model.score(data, at))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return score


def opened_by_workers(path: str) -> str:
    """The plain path of a folder in the shared file system."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"workers memory-map the model, so spark.checkpoint.dir must be a mounted path, not {path}")
    return unquote(parts.path)


def fit_model(spark: SparkSession, train: DataFrame) -> Model:
    """Count ``train.text`` and write the sorted arrays. Nothing that grows with the corpus comes to the driver."""
    train = train.select("text")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # as many tasks as shards, so that no task grows with the input
    shards = partitions_for(spark, size, SHARD_BYTES)
    folder = opened_by_workers(new_path(spark, "bigrams"))
    os.makedirs(folder)
    words = write_once(
        train.mapInArrow(_word_counts(shards), "shard int, data binary").repartition(shards, "shard").groupBy("shard")
        .applyInPandas(_merge_words, "shard int, data binary, tokens long, types long"),
        "word-counts",
    )
    tokens, types = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("types")).first())
    # fewer words than shards can make up such a part of all tokens
    least = max(1, tokens // shards)
    often = sorted(
        ((r["word"] % (1 << 64), r["n"]) for r in words.select("data").mapInArrow(_often(least), "word long, n long").collect()),
    ) if tokens > 1000 * shards else []
    # the begin of a text stands before as many tokens as there are ends
    begin = [(int(BEGIN), n) for w, n in often if w == int(END)]
    spread = sorted([x for x in often if x[0] != int(END)] + begin)
    deal = Deal(
        shards, np.array([w for w, _ in spread], np.uint64),
        np.array([min(shards, 1 + 2 * n // least) for _, n in spread], np.int64),
    )
    merged_pairs = write_once(
        train.mapInArrow(_pair_counts(deal), "shard int, data binary").repartition(shards, "shard").groupBy("shard")
        .applyInPandas(_merge_pairs(folder, deal), "shard int, data binary, coc array<long>, hot binary"),
        "pair-counts",
    )
    pair_coc, hot = [0] * 4, [[np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 4]
    # a row per shard, with the parts of spread words
    for r in merged_pairs.where("shard = -1").select("coc", "hot").collect():
        pair_coc = [a + b for a, b in zip(pair_coc, r["coc"])]
        hot.append(unpack(bytes(r["hot"])))
    parts = [np.concatenate(x) for x in zip(*hot)]
    whole = [added_up(parts[0], x)[2] for x in parts[1:]]
    saved = write_once(
        words.repartition(shards, "shard").groupBy("shard")
        .cogroup(merged_pairs.where("shard >= 0").select("shard", "data").repartition(shards, "shard").groupBy("shard"))
        .applyInPandas(_save_words(folder), "coc array<long>, types long"),
        "word-types",
    )
    word_coc, pair_types = [0] * 4, 0
    kinds = [0, 0, 0]
    for r in saved.collect():  # a row per shard
        word_coc = [a + b for a, b in zip(word_coc, r["coc"])]
        pair_types += r["types"]
    kinds = [word_coc[0], word_coc[1], types - word_coc[0] - word_coc[1]]
    return Model(folder, deal, tokens, types, pair_types, discounts(pair_coc), discounts(word_coc), kinds, [added_up(parts[0], parts[1])[0], *whole])


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs``: tokens, those known, base score, and the model's log10 probability.

    Learns from the rows that are not held out. Null and empty texts are one token, the end. Without training text
    every token has probability 1 / (0 + 1), so scores are 0. Repeated rows count as often as they occur and are
    scored each on their own. Further columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    model = fit_model(spark, docs.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_scorer(model), SCORES)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
