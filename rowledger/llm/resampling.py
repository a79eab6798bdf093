"""Importance resampling towards a target: n-gram features in hashed buckets, weights by bit-sliced sums, Gumbel draw.

A bucket's gain says how much commoner its features are in the target than in the documents. A document's weight
is the sum of gains over its features: its bucket counts are written as bit planes (plane k has a bucket's bit k of its
count), the gains as planes of two's complement, and the weight is the sum over both kinds of planes of the bits that
stand in both, counted and shifted by both places (the sign's plane counts negative). All whole numbers, so exact.

Two passes over the texts: bucket counts of all documents, added up in every task; then the weights. The draw
keeps the highest scores with Gumbel noise hashed from the id; places are counted over sorted ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.llm import tokens as T
from rowledger.llm.common import ranked, write_once

BUCKETS = 10_000
LAID = -(-BUCKETS // 64) * 64  # counters of a document: whole words of bits
LONGEST = 3        # words of a feature
SHARE = 5          # of a hundred eligible documents, drawn
LEAST_WORDS = 20
SEED = 42
DOCS = 64          # documents whose counts are laid out at a time

POLYNOMIAL = 0xEDB88320  # fixed value: crc32, bits reversed


def _one_byte() -> np.ndarray:
    """The checksum's next state by the low byte of the state and one more byte."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = (state >> np.uint32(1)) ^ np.where(state & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return state


_STEP = _one_byte()
_FAR = 256


def _zero_bytes() -> np.ndarray:
    """What so many further bytes do to each byte of a checksum: [bytes, place of the byte, its value]."""
    table = np.zeros((_FAR, 4, 256), np.uint32)
    for place in range(4):
        table[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for n in range(1, _FAR):
        table[n] = _STEP[table[n - 1] & 255] ^ (table[n - 1] >> np.uint32(8))
    return table.reshape(-1)


_ZEROS = _zero_bytes()


def _longer(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums carried over ``by`` further bytes; combined with those bytes' own checksum by exclusive or."""
    out, left = crc.copy(), by.copy()
    rows = np.arange(len(crc))
    while len(rows):
        at, here = np.minimum(left[rows], _FAR - 1) * 1024, out[rows]
        moved = _ZEROS[at + (here & 255)]
        for place in (1, 2, 3):
            moved ^= _ZEROS[at + 256 * place + ((here >> np.uint32(8 * place)) & 255)]
        out[rows] = moved
        left[rows] -= _FAR - 1
        rows = rows[left[rows] > 0]
    return out


def _space(crc: np.ndarray) -> np.ndarray:
    """Checksums of the same bytes with a space behind them."""
    inner = ~crc
    return ~(_STEP[(inner ^ np.uint32(32)) & 255] ^ (inner >> np.uint32(8)))


def word_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of the byte spans [start, end), longer ones one by one."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    sizes, first = length[order], start[order]
    for i in range(min(int(sizes[0]) if len(sizes) else 0, _FAR)):
        n = int(np.searchsorted(-sizes, -i, "left"))
        crc[:n] = _STEP[(crc[:n] ^ data[first[:n] + i]) & 255] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(length > _FAR):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of some texts, and the number of words of each text."""
    lowered = T.LOWER[data]
    w = T.words(lowered, at, separator=T.PUNCTUATION, lower=False)
    text, length = w.text_of(), w.end - w.start
    single = word_checksums(lowered, w.start, w.end)
    crc, owners, found = single, [text], [single]
    for n in range(1, LONGEST):
        # runs of n + 1 words: those of n words, a space and the next word, if that stands in the same text
        more = len(text) - n
        if more <= 0:
            break
        crc = _longer(_space(crc[:more]), length[n:]) ^ single[n:]
        whole = text[n:] == text[:more]
        owners.append(text[:more][whole])
        found.append(crc[whole])
    return np.concatenate(owners), np.concatenate(found) % np.uint32(BUCKETS), np.diff(w.of)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, at in T.chunks(batch.column(0)):
            total += np.bincount(buckets(data, at)[1], minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; a row per bucket reaches the driver."""
    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for every bucket."""
    s_all, t_all = float(documents.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(documents, target)], np.int64)


def planes(numbers: np.ndarray, n: int) -> np.ndarray:
    """Bits 0 to n - 1 of whole numbers, by plane, row and 64 buckets."""
    return np.stack([np.packbits((numbers >> k & 1).astype(np.uint8), axis=-1).view(np.uint64) for k in range(n)])


class Weigher:
    """Exact sums of gains by bit planes."""

    def __init__(self, by_bucket: np.ndarray) -> None:
        # enough bits for every gain, and the sign
        self.n = max(int(np.abs(by_bucket).max(initial=0)).bit_length() + 1, 2)
        self.gains = planes(np.pad(by_bucket, (0, LAID - BUCKETS)), self.n)
        self.worth = [1 << j for j in range(self.n - 1)] + [-(1 << (self.n - 1))]

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Weight of each row of ``LAID`` counts."""
        out, most = np.zeros(len(counts), np.int64), counts.max(axis=1, initial=0)
        for k in range(int(most.max(initial=0)).bit_length()):
            rows = np.flatnonzero(most >= 1 << k)
            here = planes(counts[rows] >> k, 1)[0]
            for plane, worth in zip(self.gains, self.worth):
                out[rows] += (worth << k) * np.bitwise_count(here & plane).sum(axis=1, dtype=np.int64)
        return out


def _weights(by_bucket: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(by_bucket)
        for batch in batches:
            for first, last, data, at in T.chunks(batch.column(0)):
                text, bucket, n_words = buckets(data, at)
                n, weight = last - first, np.zeros(last - first, np.int64)
                order = np.argsort(text, kind="stable")
                text, bucket = text[order], bucket[order].astype(np.int64)
                cut = np.searchsorted(text, np.arange(n + 1))
                for a in range(0, n, DOCS):
                    b = min(n, a + DOCS)
                    here = slice(cut[a], cut[b])
                    counts = np.bincount((text[here] - a) * LAID + bucket[here], minlength=(b - a) * LAID)
                    weight[a:b] = weigher(counts.reshape(b - a, LAID))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[first:last], pa.array(n_words), pa.array(np.diff(cut)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"]
                )

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1, hashed from the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row per row of ``docs``; rank is null for those not drawn.

    ``share`` of a hundred documents with ``least_words`` words or more are drawn, rounded down. Ties go to the smaller
    id, then to fewer features; repeated rows with the same id are drawn one after the other, a null id (hashed as an
    empty one) before all others. Null and empty texts, and texts without words, have weight 0 and are never drawn.
    Long texts are read whole, one at a time if need be. Empty tables give no rows; an empty target gives gains from smoothing
    alone. Other columns are not read.
    """
    by_bucket = gains(bucket_counts(docs), bucket_counts(target))
    scored = docs.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_weights(by_bucket), "doc_id long, n_words long, n_features long, weight long")
    scored = write_once(
        scored.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"),
                      (F.col("n_words") >= least_words).alias("eligible"), F.monotonically_increasing_id().alias("row")),
        "weights",
    )
    drawn = scored.where("eligible").count() * share // 100
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("row")]
    place = F.col("place") + 1
    return ranked(scored, order, "place").select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).cast("long").alias("rank"))


def oracle() -> str:
    """``resample`` with its default parameters against ``benchmark`` in DuckDB's SQL, for ids that are there and differ."""
    crc = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"""

    def words(table: str, key: str) -> str:
        # upper-case letters are no word characters after lower-casing, which translate does for A to Z alone
        low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"select {key} as id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table}"

    runs = " union all ".join(
        f"select kind, id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) as f from texts where len(w) >= {n}"
        for n in range(1, LONGEST + 1)
    )
    return f"""
with texts as materialized (
  select 0 as kind, * from ({words('documents', 'doc_id')}) union all select 1 as kind, * from ({words('benchmark', 'null')})),
runs as materialized ({runs}),
hashed as materialized (select f, ({crc}) % {BUCKETS} as bucket from (select distinct f from runs)),
placed as materialized (select kind, id, bucket, count(*) as n from runs join hashed using (f) group by all),
sums as (select b as bucket, coalesce(sum(n) filter (where kind = 0), 0) as s, coalesce(sum(n) filter (where kind = 1), 0) as t
  from range({BUCKETS}) r(b) left join placed on placed.bucket = b group by b),
totals as (select sum(s) as s_all, sum(t) as t_all from sums),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + {BUCKETS})::double / ((s + 1)::double * (t_all + {BUCKETS})::double)))::bigint as gain from sums, totals),
weights as (select id, sum(n) as n_features, sum(n * gain) as weight from placed join gains using (bucket) where kind = 0 group by id),
scored as (
  select t.id as doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, len(w) >= {LEAST_WORDS} as eligible,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || t.id), 1, 8))::bigint + 0.5::double) / 4294967296))))::bigint as score
  from texts t left join weights on weights.id = t.id where kind = 0),
placed_rows as (select *, row_number() over (order by eligible desc, score desc, doc_id) as place, count(*) filter (where eligible) over () as n from scored)
select doc_id, n_features, weight, score, case when place <= {SHARE} * n // 100 then place end::bigint as rank from placed_rows
"""
