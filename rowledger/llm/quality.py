"""Quality rules: compression bands.

A text that zstandard shrinks far too well repeats itself; one that it hardly shrinks is noise. Both
limits depend on the length, because short texts give a compressor little to work with. The ratio is
taken over the whole text and over fixed chunks, so that a long text with a bad stretch shows as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from rowledger.llm import tokens as T

LEVEL = 3
CHUNK = 4096
WINDOW = 8
# (bytes from, smallest ratio, largest ratio) of compressed to plain size. Running prose in any language
# lies well inside. A short text may even grow by zstandard's frame header, so it has no upper limit.
BANDS = ((0, 0.0, 9.9), (200, 0.20, 9.9), (500, 0.14, 0.86), (2000, 0.10, 0.78), (8000, 0.06, 0.70))
# a text fails by its chunks when more than this share of its whole chunks lies outside the chunk band
BAD_CHUNKS = 0.5
CHUNK_BAND = (0.12, 0.75)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, ratio double, n_chunks long, bad_chunks long"
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another equals it, and whether an earlier one does."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:]] = same
    later[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of every text of a chunk."""
    n = len(at) - 1
    w = T.words(data, at, lower=False)
    salt = T.mix(np.arange(1, n + 1, dtype=np.uint64))
    # 8-word windows that lie inside one text
    text = w.text_of()
    keys = T.windows(w.hash, WINDOW)
    inside = np.flatnonzero(text[: len(keys)] == text[WINDOW - 1 :]) if len(keys) else np.zeros(0, np.int64)
    again, _ = _repeated(T.mix(keys[inside] ^ salt[text[inside]]))
    steps = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(steps, inside[again], 1)
    np.add.at(steps, inside[again] + WINDOW, -1)
    covered = np.cumsum(steps[:-1]) > 0
    # lines: cut at \n and where a text begins or ends
    cuts = np.unique(np.concatenate([at, np.flatnonzero(data == 10) + 1]))
    start, end = cuts[:-1], cuts[1:].copy()
    broken = (end > start) & (data[end - 1] == 10) if len(start) else np.zeros(0, bool)
    end[broken] -= 1
    first = np.searchsorted(w.start, start, "left")
    full = np.searchsorted(w.start, end, "left") > first
    start, end = start[full], end[full]
    owner = np.searchsorted(at, start, "right") - 1
    _, later = _repeated(T.mix(T.span_hashes(data, start, end) ^ salt[owner]))
    plain = ~T.WHITE[data]
    return {
        "n_words": np.diff(w.of),
        "word_chars": T.counts_within(plain & T.code_points(data), at),
        "n_symbols": T.counts_within(_SYMBOLS[data], at),
        "n_dup_lines": np.bincount(owner[later], minlength=n),
        "n_repeat_words": T.counts_within(covered, w.of),
    }


def band(size: int) -> tuple[float, float]:
    """Smallest and largest accepted ratio for a text of this many bytes."""
    return next((low, high) for least, low, high in reversed(BANDS) if size >= least)


def bands_accept(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[bool, float, int, int]:
    """Verdict, ratio of the whole text, number of whole chunks, number of those outside the chunk band."""
    if not raw:
        return True, 1.0, 0, 0
    ratio = len(packer.compress(raw)) / len(raw)
    low, high = band(len(raw))
    bad = total = 0
    for i in range(0, len(raw) - CHUNK + 1, CHUNK):
        total += 1
        part = len(packer.compress(raw[i : i + CHUNK])) / CHUNK
        bad += not CHUNK_BAND[0] <= part <= CHUNK_BAND[1]
    return low <= ratio <= high and bad <= BAD_CHUNKS * total, ratio, total, bad


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for first, last, data, at in T.chunks(batch.column(1)):
            c = counts(data, at)
            failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
            verdicts = [bands_accept(data[a:b].tobytes(), packer) for a, b in zip(at[:-1], at[1:])]
            good, ratio, total, bad = (list(x) for x in zip(*verdicts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[first:last].cast(pa.int64()),
                    *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    pa.array(failed), pa.array(~failed & np.array(good, bool)),
                    pa.array(ratio, pa.float64()), pa.array(total, pa.int64()), pa.array(bad, pa.int64()),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept", "ratio", "n_chunks", "bad_chunks"],
            )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base counts, whether they fail, and whether the text is kept.

    Null and empty texts have no words: all counts 0, ``base_failed`` true, ratio 1. Repeated rows are
    judged each on their own; further columns of ``docs`` are not looked at. Lines and windows are
    compared by 64-bit hashes.
    """
    return docs.select("doc_id", "text").mapInArrow(_score, SCHEMA)
