"""Language identification by the nearest centroid.

A text is the TF-IDF vector of its letter n-grams, hashed to ``SIZE`` buckets and normalised. Every language
has several centroids (spherical k-means over a bounded sample of its training texts), compared by cosine.
A text farther from all centroids than its language's own training texts is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.llm import tokens as T

SIZE = 1 << 13
CENTROIDS = 4
# bound of the sample that the centroids of a language are fitted on; document frequencies use all rows
FIT_TEXTS = 600
ROUNDS = 8
# rejected: cosine distance beyond this quantile of the training sample's distances, plus a margin
REJECT_QUANTILE, REJECT_MARGIN = 0.995, 0.1

_K1, _K2, _K3 = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


def buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the 3-byte run at each place: letters in lower case, all other ASCII as one blank."""
    plain = T.LOWER[data]
    plain = np.where(T.PUNCTUATION[data] | ((data >= 0x30) & (data <= 0x39)), np.uint8(32), plain).astype(np.uint32)
    runs = plain[:-2] * _K1 ^ plain[1:-1] * _K2 ^ plain[2:] * _K3
    return ((runs ^ (runs >> np.uint32(15))) * _K1 >> np.uint32(32 - 13)).astype(np.int64)


def vectors(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, counts of up to 128 texts in each bucket)."""
    padded = np.concatenate([data, np.full(2, 32, np.uint8)])
    places = buckets(padded)
    for first in range(0, len(at) - 1, 128):
        rows = range(first, min(first + 128, len(at) - 1))
        yield first, np.stack([np.bincount(places[at[i] : max(at[i], at[i + 1] - 2)], minlength=SIZE) for i in rows]).astype(np.float32)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for _, _, data, at in T.chunks(batch.column(0)):
            n += len(at) - 1
            for _, counts in vectors(data, at):
                seen += (counts > 0).sum(axis=0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, SIZE)), pa.array(np.concatenate([[n], seen]))], ["bucket", "texts"]
    )


def inverse_frequencies(train: DataFrame) -> np.ndarray:
    """IDF of each bucket over all training texts; the result has a fixed number of rows."""
    rows = (
        train.select("text").mapInArrow(_frequencies, "bucket long, texts long")
        .groupBy("bucket").agg(F.sum("texts").alias("texts")).collect()
    )
    texts = np.zeros(SIZE + 1)
    for r in rows:
        texts[r["bucket"] + 1] = r["texts"]
    return np.log((texts[0] + 1) / (texts[1:] + 1)).astype(np.float32) + np.float32(1)


def _fitter(idf: np.ndarray):
    def fit(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means over one language's sample."""
        rows = rows.sort_values(["rank", "text"]).head(FIT_TEXTS)
        data, at = T.utf8(pa.array(rows["text"], pa.string()))
        x = np.concatenate([weigh(c, idf) for _, c in vectors(data, at)])
        chosen = [0]
        while len(chosen) < min(CENTROIDS, len(x)):  # far from those chosen so far
            chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
        centers = x[chosen]
        for _ in range(ROUNDS):
            nearest = (x @ centers.T).argmax(axis=1)
            sums = np.stack([x[nearest == k].sum(axis=0) if (nearest == k).any() else centers[k] for k in range(len(centers))])
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        reach = min(1.0, float(np.quantile(1 - (x @ centers.T).max(axis=1), REJECT_QUANTILE)) + REJECT_MARGIN)
        return pd.DataFrame({"lang": key[0], "centers": [c.astype(np.float32).tobytes() for c in centers], "reach": reach})

    return fit


def fit_centroids(train: DataFrame, idf: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and vector of each centroid, and each centroid's rejection distance.

    The sample of a language is at most ``FIT_TEXTS`` of its different training texts, drawn by hash.
    """
    key = F.xxhash64("text", F.lit(11))
    # copies are merged before anything is counted or dealt out by language
    different = train.select("lang", key.alias("rank")).distinct()
    sizes = different.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a hash threshold per language, from its number of different texts, keeps the sampled texts few before the shuffle;
    # it is so far above FIT_TEXTS that fewer texts fall below it only if the language has no more
    share = F.lit(1.5 * FIT_TEXTS + 200) / F.col("n")
    low = F.pmod(F.col("rank"), F.lit(1 << 30)) < share * (1 << 30)
    few = F.broadcast(sizes.withColumnRenamed("lang", "of"))
    sample = train.withColumn("rank", key).join(few, F.col("lang") == F.col("of")).where(low)
    sample = sample.groupBy("lang", "rank").agg(F.min("text").alias("text"))
    rows = sample.groupBy("lang").applyInPandas(_fitter(idf), "lang string, centers binary, reach double").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["centers"])))
    if not rows:
        return [], np.zeros((0, SIZE), np.float32), np.zeros(0)
    return (
        [r["lang"] for r in rows],
        np.stack([np.frombuffer(bytes(r["centers"]), np.float32) for r in rows]),
        np.array([r["reach"] for r in rows]),
    )


def _predictor(langs: list[str], centers: np.ndarray, reach: np.ndarray, idf: np.ndarray):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = np.ascontiguousarray(centers.T)
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(2)):
                best, near = np.zeros(last - first, np.int64), np.zeros(last - first)
                if langs:
                    for i, counts in vectors(data, at):
                        cosine = weigh(counts, idf) @ turned
                        best[i : i + len(counts)] = cosine.argmax(axis=1)
                        near[i : i + len(counts)] = cosine.max(axis=1)
                lettered = [any(c.isalpha() for c in data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(at[:-1], at[1:])]
                known = [bool(langs) and x for x in lettered]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last].cast(pa.int64()), batch.column(1)[first:last],
                        pa.array([langs[k] if x else "und" for k, x in zip(best.tolist(), known)], pa.string()),
                        pa.array([min(1.0, max(0.0, s)) if x else 0.0 for s, x in zip(near.tolist(), known)], pa.float64()),
                        pa.array([not x or 1 - s > reach[k] for s, k, x in zip(near.tolist(), best.tolist(), known)], pa.bool_()),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    return predict


def identify_language(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs``: nearest language, cosine to it, and whether it is too far from all.

    Learns only from ``text`` and ``lang`` of rows that are not held out and have both. Null texts and texts
    without a letter are ``und`` with score 0, and so is everything if nothing can be learned. Texts too short for an
    n-gram go to the first language with score 0. Repeated rows are judged each on their own.
    """
    train = docs.where(~held_out & F.col("lang").isNotNull() & (F.length("text") > 0)).select("text", "lang")
    idf = inverse_frequencies(train)
    langs, centers, reach = fit_centroids(train, idf)
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        _predictor(langs, centers, reach, idf),
        "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean",
    )
