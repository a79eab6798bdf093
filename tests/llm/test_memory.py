"""Memory of the Python workers, which an executor holds beside its heap."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rowledger.llm import neardup, toxicity


def _peak(work) -> float:
    tracemalloc.start()
    try:
        for _ in work:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _batch(n: int, words: int) -> pa.RecordBatch:
    texts = [" ".join(f"w{(i * 31 + j * j) % 5003}" for j in range(words)) for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], ["row_id", "text"])


def test_signing_many_short_texts_holds_few_at_a_time():
    assert _peak(neardup._sign(iter([_batch(8000, 45)]))) < 60


def test_scoring_holds_few_texts_at_a_time():
    model = toxicity.Model(np.ones(toxicity.SIZE, np.float32), -1.0, 1.0, 0.0, np.ones(toxicity.SIZE, np.float32), 0.0)
    batch = _batch(8000, 45)
    swapped = pa.RecordBatch.from_arrays(batch.columns[::-1], ["__text", "doc_id"])
    assert _peak(toxicity._scorer(model)(iter([swapped]))) < 60


def test_text_inside_a_row_is_scored_as_one_beside_it(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (3, ""), (4, "a fine day")], "doc_id long, text string")
    model = toxicity.Model(np.linspace(-1, 1, toxicity.SIZE).astype(np.float32), 0.1, 1.0, 0.0, np.ones(toxicity.SIZE, np.float32), 0.0)
    beside = {r.doc_id: r.score for r in toxicity.with_score(docs, model, "doc_id").collect()}
    marked = docs.select(F.struct("doc_id", "text").alias("row"))
    inside = {r.row.doc_id: (r.row.text, r.score) for r in toxicity.with_score(marked, model, "row", text_in="row").collect()}
    assert {i: s for i, (_, s) in inside.items()} == beside
    assert [inside[i][0] for i in (1, 2, 3, 4)] == ["you idiot", None, "", "a fine day"]
