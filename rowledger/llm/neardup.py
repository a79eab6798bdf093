"""MinHash near-duplicates: DartMinHash over weighted word shingles.

A text is a bag of five-word shingles; the weight of a shingle is how often it occurs, and two texts are alike
by their weighted Jaccard similarity, sum of minima over sum of maxima. Every unit of an element's weight is a
region at which darts are thrown, hashed from the element and the unit: their ranks form a Poisson process, and each
dart falls on one of ``COORDINATES`` coordinates. A text keeps the earliest dart of each coordinate, which two texts share with
their similarity as chance. Only darts up to a rank that gives each coordinate several on average are thrown at all,
so the effort follows the text's length plus the signature's, not their product.

Texts of the same words are merged first. Signatures are cut into bands; texts that share a band meet in a bucket.
A bucket is not multiplied out: one leader is compared with all others and links are joined to classes. Texts in
buckets whose members are then still in different classes go through an exact join with prefix, length and positional
filter, which finds every link left between them. Signatures and lengths rule out most pairs, an exact comparison of the texts decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rowledger.llm import tokens as T
from rowledger.llm.common import write_once

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5  # a pair at the threshold shares no band with a chance of 7e-6
COORDINATES = BANDS * ROWS
# pairs whose signatures agree less are not compared: 4.3 standard deviations below the threshold
AGREEMENT = SIMILARITY - 4.3 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
BROADCAST_IDS = 1_000_000
CHUNK = 1 << 19  # bytes of texts taken apart at a time; signatures of short texts are far longer than the texts

SIGNED = "row_id long, key_1 long, key_2 long, n long, bands array<long>, marks binary"


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, T.Words]:
    """Text and hash of each shingle; a text of fewer than five words is one shingle."""
    w = T.words(data, at)
    n_words, text = np.diff(w.of), w.text_of()
    found = T.windows(w.hash, SHINGLE)
    inside = np.flatnonzero(text[: len(found)] == text[SHINGLE - 1 :]) if len(found) else np.zeros(0, np.int64)
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    own = [T.windows(w.hash[w.of[i] : w.of[i + 1]], int(n_words[i]))[0] for i in few]
    return np.concatenate([text[inside], few]), np.concatenate([found[inside], np.array(own, np.uint64)]), w


def units(text: np.ndarray, element: np.ndarray) -> np.ndarray:
    """Hash of each unit of weight: the element, and how often it came before in its text."""
    key = T.mix(element ^ T.mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(key) else np.zeros(0, bool)
    place = np.arange(len(key))
    nth = np.empty(len(key), np.uint64)
    nth[order] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    return T.mix(element + nth * np.uint64(0xD1342543DE82EF95))


def signatures(text: np.ndarray, element: np.ndarray, n_texts: int, size: int = COORDINATES) -> np.ndarray:
    """Rank of the earliest dart on each coordinate (infinite for texts without shingles); equal ranks are one dart."""
    region = units(text, element)
    best = np.full(n_texts * size, np.inf)
    weight = np.bincount(text, minlength=n_texts)
    reach = size * (math.log(size) + 2) / np.maximum(weight, 1)  # ranks to throw up to
    todo = weight > 0
    while todo.any():
        mine = np.flatnonzero(todo[text])
        rank, dart = np.zeros(len(mine)), 0
        while len(mine):
            dart += 1
            throw = T.mix(region[mine] + np.uint64(dart * 0x9E3779B97F4A7C15 % (1 << 64)))
            rank = rank - np.log(((throw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            kept = np.flatnonzero(rank < reach[text[mine]])
            mine, rank = mine[kept], rank[kept]
            coordinate = T.mix(throw[kept] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(size)
            np.minimum.at(best, text[mine] * size + coordinate.astype(np.int64), rank)
        # throw farther for texts with an empty coordinate
        todo &= np.isinf(best.reshape(n_texts, size)).any(axis=1)
        reach[todo] *= 2
    return best.reshape(n_texts, size)


def word_keys(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's sequence of words."""
    keys = []
    for hashes in (w.hash, T.mix(w.hash ^ np.uint64(0x8EBC6AF09C88C6E3))):
        up, down = T._powers.to(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=sums[1:])
        keys.append(T.mix((sums[w.of[1:]] - sums[w.of[:-1]]) * down[w.of[:-1]] + np.diff(w.of).astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in T.chunks(batch.column(1), CHUNK):
            text, element, w = shingles(data, at)
            signature = signatures(text, element, last - first).view(np.uint64)
            key_1, key_2 = word_keys(w)
            bands = np.zeros((last - first, BANDS), np.uint64)
            for j in range(BANDS):
                for i in range(ROWS):
                    bands[:, j] = T.mix(bands[:, j] + signature[:, j * ROWS + i])
                bands[:, j] = T.mix(bands[:, j] + np.uint64(j))
            marks = (T.mix(signature) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[first:last], pa.array(key_1), pa.array(key_2),
                    pa.array(np.bincount(text, minlength=last - first).astype(np.int64)),
                    pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                    pa.array([m.tobytes() for m in marks], pa.binary()),
                ],
                ["row_id", "key_1", "key_2", "n", "bands", "marks"],
            )


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts, by their shingles."""
    (a, a_at), (b, b_at) = T.utf8(left), T.utf8(right)
    both = (a_at + b_at)[1:]
    result, first = np.zeros(len(left)), 0
    while first < len(left):
        done = both[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(both, done + CHUNK, "right")))
        keys, sizes = [], []
        for data, at in ((a, a_at), (b, b_at)):
            pair, element, _ = shingles(data[at[first] : at[last]], at[first : last + 1] - at[first])
            keys.append((T.mix(units(pair, element) ^ T.mix(pair.astype(np.uint64) + np.uint64(1))), pair))
            sizes.append(np.bincount(pair, minlength=last - first))
        # units are distinct within a text, so two of a kind are shared
        key, pair = (np.concatenate(x) for x in zip(*keys))
        order = np.argsort(key, kind="stable")
        twice = order[1:][key[order][1:] == key[order][:-1]]
        shared = np.bincount(pair[twice], minlength=last - first)
        result[first:last] = shared / np.maximum(1, sizes[0] + sizes[1] - shared)
        first = last
    return result


def similarity(a: str, b: str) -> float:
    return float(similarities(pa.array([a], pa.string()), pa.array([b], pa.string()))[0])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 3))
        # one in 256 different marks is equal by chance
        share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        kept = pa.array(np.flatnonzero(share >= AGREEMENT))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])


def _compare(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array(np.flatnonzero(similarities(batch.column(2), batch.column(3)) >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])

    return compare


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the smallest id that each id of (a, b) is connected with, by alternating stars.

    Every round only takes minima and joins, so that nothing grows with a class's size; rounds are written out.
    """
    edges = write_once(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _stars(edges):
        # every edge (a, b) has a > b; large star: higher neighbours go to the smallest neighbour
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its lower neighbours go to the smallest of them
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        edges = write_once(small.where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("class"))


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one lower neighbour or is the lowest of its class."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def row_id(doc_id: Column, text: Column) -> Column:
    """The document's id; without one, a negative number from its text."""
    return F.coalesce(doc_id.cast("long"), -1 - F.pmod(F.xxhash64(text), F.lit(1 << 62)))


def _linked(pairs: DataFrame, texts: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of texts that are similar."""
    pairs = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("marks").alias("left")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("marks").alias("right")), "b")
        .select("a", "b", "left", "right").mapInArrow(_agree, "a long, b long")
    )
    pairs = write_once(pairs, "pairs")
    wanted = _wanted(docs, texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    return (
        pairs.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
        .join(wanted.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
        .select("a", "b", "left", "right").mapInArrow(_compare(similarity), "a long, b long")
    )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in T.chunks(batch.column(1), CHUNK):
            key_1, key_2 = word_keys(T.words(data, at))
            yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(key_1), pa.array(key_2), batch.column(1)[first:last]], ["row_id", "key_1", "key_2", "text"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in T.chunks(batch.column(1), CHUNK):
            text, element, _ = shingles(data, at)
            yield pa.RecordBatch.from_arrays([batch.column(0)[first:last].take(pa.array(text)), pa.array(units(text, element).view(np.int64))], ["id", "unit"])


def _wanted(docs: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (id, text) for each text of ``ids``, written.

    A text is fetched from the rows of its smallest row id. Rows may share that id, so their words decide.
    """
    wanted = write_once(texts.join(ids.select("id").distinct(), "id", "left_semi").select("id", "row_id", "key_1", "key_2"), "needed")
    rows = wanted.select("row_id").distinct()
    # ids of 8 bytes go to all tasks while they are few, so that only their texts are shuffled
    if wanted.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    found = docs.select("row_id", "text").join(rows, "row_id", "left_semi").mapInArrow(_keyed, "row_id long, key_1 long, key_2 long, text string")
    return write_once(found.join(wanted, ["row_id", "key_1", "key_2"]).dropDuplicates(["id"]).select("id", "text"), "texts")


def _prefix_pairs(rest: DataFrame, texts: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes that can be similar, by prefix, length and positional filter.

    With the units of weight ordered by how many texts have them, similar texts share one of the first
    n - ceil(similarity * n) + 1 of either, so passages that many texts have make no pairs. After the first unit that they
    share, either has only so many units left, which must do for the overlap that is needed.
    """
    found = write_once(_wanted(docs, texts, rest).mapInArrow(_units, "id long, unit long"), "units")
    common = found.groupBy("unit").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    # units of one text alone come first in its order and join nothing
    own = Window.partitionBy("id")
    ranked = found.join(common, "unit").withColumn("place", F.row_number().over(own.orderBy("seen", "unit"))).withColumn("of", F.count(F.lit(1)).over(own))
    ranked = ranked.join(rest, "id")
    length = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    left = (F.col("of") - F.col("place")).cast("int").alias("left")
    prefix = write_once(ranked.where(F.col("place") <= length - (F.col("n") - F.col("of"))).select("unit", "id", "n", "class", left), "prefixes")
    other = prefix.select("unit", *(F.col(c).alias(f"other_{c}") for c in ("id", "n", "class", "left")))
    overlap = similarity / (1 + similarity) * (F.col("n") + F.col("other_n"))
    return prefix.join(other, "unit").where(
        (F.col("id") > F.col("other_id")) & (F.col("class") != F.col("other_class"))
        & (F.least("n", "other_n") >= similarity * F.greatest("n", "other_n"))
        & (1 + F.least("left", "other_left") >= overlap - 1e-6)
    ).select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``id``, and ``class_id``, the smallest id of its class.

    Also ``class``, a number that no other class has (null without words), and two keys of the words.

    Texts of the same words (after lower-casing A-Z) are copies; texts at or above ``similarity`` are linked, and linked
    texts form classes. A text without words is a class of its own. A text of one to four words is a single shingle.
    Rows without doc_id get a negative id from their text. Rows that share a doc_id are judged each by its own text, so
    they may stand in several classes; classes with the same smallest id differ in ``class``. Long texts are taken
    whole, one at a time if need be. Further columns of ``docs`` are not looked at.
    """
    own = docs.select("doc_id", row_id(F.col("doc_id"), F.col("text")).alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = write_once(own.select("row_id", "text").mapInArrow(_sign, SIGNED), "signed")
    full = signed.where("n > 0")
    # each different text is a node with a number of its own, given once and written
    texts = full.groupBy("key_1", "key_2").agg(F.min("row_id").alias("row_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    texts = write_once(texts.withColumn("id", F.monotonically_increasing_id()), "distinct-texts")
    rows = texts.select("id", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    members = write_once(rows.join(shared.select("bucket", "size"), "bucket"), "shared-buckets")
    # who meets many others is likely the text that these are copies of, and leads
    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    members = write_once(members.drop("size").join(met, "id"), "buckets")
    near = (F.col("id") != F.col("leader")) & (F.least("n", "leader_n") >= similarity * F.greatest("n", "leader_n"))
    leaders = members.groupBy("bucket").agg(F.max(F.struct("met", -F.col("id"), "n")).alias("top"))
    leaders = leaders.select("bucket", (-F.col("top.col2")).alias("leader"), F.col("top.n").alias("leader_n"))
    pairs = members.join(leaders, "bucket").where(near).select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b"))
    links = write_once(_linked(pairs.distinct(), texts, own, similarity), "links")
    classes = components(links)
    # buckets within one class are done; the texts of all others are joined exactly
    rest = members.select("bucket", "id", "n").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    open_ = rest.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("bucket")
    rest = write_once(rest.join(open_, "bucket", "left_semi").select("id", "n", "class").distinct(), "open")
    if not rest.isEmpty():
        pairs = _prefix_pairs(rest, texts, own, similarity)
        links = write_once(_linked(pairs, texts, own, similarity), "links")
        # earlier classes go on as their members' links to the smallest id
        classes = components(links.union(classes.select("id", "class")))
    # a class is named after the smallest row id of its texts
    of_text = write_once(
        texts.select("key_1", "key_2", "id", "row_id").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id")), "classes-of-texts"
    )
    names = of_text.groupBy("class").agg(F.min("row_id").alias("class_id"))
    with_key = signed.select("row_id", "n", "key_1", "key_2").join(of_text.join(names, "class").select("key_1", "key_2", "class", "class_id"), ["key_1", "key_2"], "left")
    class_id = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("row_id"))
    return with_key.select(
        F.when(F.col("row_id") >= 0, F.col("row_id")).alias("doc_id"), F.col("row_id").alias("id"), class_id.alias("class_id"), "class", "key_1", "key_2"
    )


def _keyed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in T.chunks(batch.column(1), CHUNK):
            key_1, key_2 = word_keys(T.words(data, at))
            yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(key_1), pa.array(key_2), batch.column(2)[first:last]], ["id", "key_1", "key_2", "row"])


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` per class: the one of its smallest id, and if that has several texts in the class, of one of them.

    Rows without words stay, once per id.
    """
    found = write_once(near_duplicates(docs, similarity), "classes-of-rows")
    kept = found.groupBy("class", F.when(F.col("class").isNull(), F.col("id")).alias("own")).agg(F.min(F.struct("id", "key_1", "key_2")).alias("k")).select("k.*")
    per_id = found.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    kept = write_once(kept.join(per_id, "id"), "kept")
    marked = docs.select(row_id(F.col("doc_id"), F.col("text")).alias("id"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    single = marked.join(kept.where("rows = 1").select("id"), "id", "left_semi").select("row.*")
    # only rows of repeated ids are told apart by their words
    schema = StructType([StructField(n, LongType()) for n in ("id", "key_1", "key_2")] + [marked.schema["row"]])
    keyed = marked.join(kept.where("rows > 1").select("id").distinct(), "id", "left_semi").mapInArrow(
        _keyed_rows, schema
    )
    names = ["id", "key_1", "key_2"]
    repeated = keyed.join(kept.select(*names), names, "left_semi").dropDuplicates(names).select("row.*")
    return single.unionByName(repeated)
