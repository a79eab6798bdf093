"""Importance resampling against plain counting, one feature at a time."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rowledger.llm import queries, resampling
from rowledger.llm import tokens as T
from rowledger.llm.common import documents, table

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n-.", "One", "Äpfel und ÄPFEL, straße 日本語 \U0001f600", "a b c a b c d-e f'g", "x" * 300 + " b " + "y" * 70_000 + " ü", "word " * 40]


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_buckets():
    rng = random.Random(6)
    texts = ODD + [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    text, bucket, n_words = resampling.buckets(*T.utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert (int(n_words[i]), sorted(bucket[text == i].tolist())) == (features(t)[0], sorted(features(t)[1]))


def test_bit_planes_sum_exactly():
    rng = np.random.default_rng(7)
    gains = rng.integers(-15_000, 15_000, resampling.BUCKETS)
    gains[:3] = -(1 << 15), (1 << 15) - 1, 0
    counts = np.zeros((6, resampling.LAID), np.int64)
    counts[:4, : resampling.BUCKETS] = rng.integers(0, 40, (4, resampling.BUCKETS))
    counts[4, 1] = 123_456_789
    assert (resampling.Weigher(gains)(counts) == counts[:, : resampling.BUCKETS] @ gains).all()
    assert (resampling.Weigher(np.zeros(resampling.BUCKETS, np.int64))(counts) == 0).all()


def brute(docs, target, share=5, least=20):
    """docs: (doc_id, text). Returns rows as (doc_id, n_features, weight, score, rank)."""
    found = [(i, *features(t)) for i, t in docs]
    s, t = [0] * 10_000, [0] * 10_000
    for _, _, f in found:
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((n >= least, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, len(f), weight))
    drawn = sum(r[0] for r in rows) * share // 100
    rows.sort(key=lambda r: (not r[0], -r[1], r[2] is not None, r[2] or 0, r[3]))
    return sorted(((i, n, w, score, k + 1 if k < drawn else None) for k, (_, score, i, n, w) in enumerate(rows)), key=repr)


def test_query_is_plain_counting(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark, DATA).collect()]
    target = [r.text for r in table(spark, DATA, "benchmark").collect()]
    got = queries.op12_importance_resampling(spark, DATA)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target)


def test_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(7, ODD[7]), (7, ODD[7]), (None, ODD[5]), (None, None), (3, "x " * 25)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("weight", "rank", "row", "eligible", "bucket", "place", "n")})
    target = spark.createDataFrame([("One word",), (None,), ("",)], "text string")
    got = resampling.resample(frame.repartition(3), target, share=60)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, ["One word", None, ""], share=60)
    assert resampling.resample(frame.where("false"), target).count() == 0
    without = sorted((tuple(r) for r in resampling.resample(frame, target.where("false"), share=60).collect()), key=repr)
    assert without == brute(docs, [], share=60)
