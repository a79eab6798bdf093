"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units after numbers, and names (capitalised words inside a sentence) are replaced by
typed placeholders, the rest is lower-cased words. Windows of eight template words are hashed and joined with those of
the benchmark, so a question is found again with other numbers and names in it. Where windows with placeholders match, the
slots must be filled consistently: one value of the item stands for one value in the document throughout.

What counts as a name depends on capitals and on the word before. So windows with slots are hashed in a second form,
of all words in lower case, by which exact copies are found wherever they stand and however they are capitalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import write_once

WINDOW = 8
COVERAGE = 0.5     # of an item's different windows that a document must hold
CONSISTENCY = 0.7  # of an item's slot values that must stand for a single value
# a template says something only if this many of its words are no placeholders; other windows count by their exact words
LEAST_WORDS = 3
# the benchmark's window hashes go to all tasks up to this number (8 bytes each), beyond it they are shuffled
BROADCAST_WINDOWS = 2_000_000

MARK = "\u0001"
# fixed values: units that may follow a number
UNITS = (
    "mm|cm|dm|km|m|mg|kg|g|lb|lbs|oz|ml|cl|l|s|sec|secs|min|mins|h|hr|hrs|hours?|minutes?|seconds?|days?|weeks?|months?|years?"
    "|meters?|metres?|kilometers?|kilometres?|miles?|inches|feet|foot|yards?|grams?|kilograms?|tons?|tonnes?|liters?|litres?"
    "|percent|dollars?|cents?|euros?|pounds?|usd|eur|gbp|mph|kmh|kwh|kw|w|v|hz|khz|mhz|ghz|kb|mb|gb|tb"
)
_NUMBER = r"(?<![\p{L}\p{N}\x01])[0-9]+(?:[.,][0-9]+)*"
_UNIT = rf"({MARK}n[0-9.,]+) ?[ -]?({UNITS})(?![\p{{L}}\p{{N}}])"
# title case only: text in capitals has no names
_NAME = r"(?<=[\p{Ll}\p{N},;:] )\p{Lu}\p{Ll}[\p{L}'’-]*"
_BREAK = r"(?:[^\p{L}\p{N}\x01.,]|[.,](?![0-9]))+"


def tokens(text: Column) -> Column:
    """The template's words; a slot is a mark, a letter for its type, and its value."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), MARK, " ")
    named = F.regexp_replace(plain, _NAME, MARK + "m$0")
    # digits are looked for only where there are any
    counted = F.regexp_replace(named, _NUMBER, MARK + "n$0")
    counted = F.when(named.rlike("[0-9]"), F.regexp_replace(counted, "(?i)" + _UNIT, "$1 " + MARK + "u$2")).otherwise(named)
    return F.array_remove(F.split(F.lower(counted), _BREAK), "")


def template(words: Column) -> Column:
    """Slots without their values."""
    return F.transform(words, lambda t: F.when(F.substring(t, 1, 1) == MARK, F.substring(t, 1, 2)).otherwise(t))


def slots(words: Column) -> Column:
    return F.filter(words, lambda t: F.substring(t, 1, 1) == MARK)


def exact(words: Column) -> Column:
    """All words without the marks of slots."""
    return F.transform(words, lambda t: F.when(F.substring(t, 1, 1) == MARK, t.substr(F.lit(3), F.length(t))).otherwise(t))


def _slotted(words: Column) -> Column:
    return F.exists(words, lambda t: F.substring(t, 1, 1) == MARK)


def hashed_windows(words: Column, template: Column, plain: Column, length: int) -> Column:
    """(at, hash) of each run of ``length`` words by its template and, if there are slots, by its exact words."""
    starts = F.sequence(F.lit(1), F.size(words) - length + 1)

    def hashes(of: Column, at: Column) -> Column:
        return F.transform(at, lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.slice(of, i, length)).alias("hash")))

    slotted = F.filter(starts, lambda i: _slotted(F.slice(words, i, length)))
    both = F.when(_slotted(words), F.concat(hashes(template, starts), hashes(plain, slotted))).otherwise(hashes(template, starts))
    return F.when(F.size(words) >= length, both)


def _exploded(frame: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, at, hash) of every window of ``frame.words``."""
    windows = hashed_windows(F.col("words"), F.col("template"), F.col("plain"), length)
    return frame.select(*keys, F.explode(windows).alias("window")).select(*keys, "window.at", "window.hash")


def _with_forms(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"template": template(F.col("words")), "plain": exact(F.col("words"))})


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, at, unit, hash, exact, length, values): the windows of every item; an item of fewer words is one window.

    A window with slots has two rows, by its template and by its exact words (``exact``), of the same ``unit``.
    Windows of few plain words are left out; if an item has no others, they count by their exact words.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.size("words"), F.lit(WINDOW))).dropDuplicates(["item_id", "words"])
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    said = F.transform(starts, lambda i: F.col("length") - F.size(slots(F.slice("words", i, F.col("length")))))
    least = F.least(F.lit(LEAST_WORDS), F.col("length"))
    items = items.withColumn("said", said).withColumn("enough", F.exists("said", lambda n: n >= least))
    cut = items.select("item_id", "length", "words", "enough", F.posexplode("said").alias("at", "n")).where(F.when(F.col("enough"), F.col("n") >= least).otherwise(F.col("n") > 0))
    cut = cut.withColumn("window", F.expr("slice(words, at + 1, length)"))
    cut = cut.withColumns({"template": F.xxhash64(template(F.col("window"))), "plain": F.xxhash64(exact(F.col("window"))), "values": slots(F.col("window"))})
    by_template = F.struct(F.col("template").alias("hash"), F.lit(False).alias("exact"))
    by_words = F.struct(F.col("plain").alias("hash"), F.lit(True).alias("exact"))
    forms = F.when(~F.col("enough"), F.array(by_words)).when(F.size("values") > 0, F.array(by_template, by_words)).otherwise(F.array(by_template))
    return cut.withColumn("form", F.explode(forms)).select(
        "item_id", (F.col("at") + 1).cast("long").alias("at"), F.when(F.col("enough"), F.col("template")).otherwise(F.col("plain")).alias("unit"),
        "form.hash", "form.exact", "length", "values",
    )


def _hits(docs: DataFrame, keys: list[str], wanted: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """Windows of ``docs.words`` that the benchmark has too."""
    found = None
    for length in lengths:
        own = wanted.where(F.col("length") == length).select("hash").distinct()
        one = _exploded(docs, keys, length).join(F.broadcast(own) if few else own, "hash").withColumn("length", F.lit(length))
        found = one if found is None else found.unionByName(one)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds: windows found, coverage, slot consistency.

    A document is its doc_id and text: repeated rows give one row, texts that share an id one each. Null and empty
    texts hold nothing; null and empty items, and items of placeholders alone, are in nothing. Items of few other words
    are found by their exact words only. Of an
    item without slots the consistency is 1. Further columns are not looked at.
    """
    wanted = write_once(benchmark_windows(benchmark), "benchmark-windows")
    n, slotted = wanted.agg(F.count(F.lit(1)), F.sum((F.size("values") > 0).cast("int"))).first()
    # at most WINDOW different lengths
    lengths = sorted(r["length"] for r in wanted.select("length").distinct().collect())
    keys = ["doc_id", "text_key"]
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    if not lengths:
        return own.where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("coverage"), F.lit(0.0).alias("consistency"))
    few = n <= BROADCAST_WINDOWS
    templates = _with_forms(own.select(*keys, tokens(F.col("text")).alias("words")))
    # a window counts once per document, however often it stands there
    hits = _hits(templates, keys, wanted, lengths, few).groupBy(*keys, "hash", "length").agg(F.lit(1).alias("one")).drop("one")
    size = wanted.groupBy("item_id").agg(F.countDistinct("unit").alias("n_all"))
    items = wanted.select("hash", "unit", "length", "item_id").distinct().join(size, "item_id")
    # a window counts once, whether it is found by its template, its words or both
    units = hits.join(items, ["hash", "length"]).groupBy(*keys, "item_id", "unit").agg(F.first("n_all").alias("n_all"))
    covered = units.groupBy(*keys, "item_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.first("n_all").alias("n_all")
    )
    covered = covered.withColumn("coverage", F.col("n_windows") / F.col("n_all")).where(F.col("coverage") >= COVERAGE)
    covered = write_once(covered.drop("n_all"), "covered")
    if slotted:
        covered = covered.join(_consistency(own, covered, wanted, lengths, few), [*keys, "item_id"], "left")
        covered = covered.withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= CONSISTENCY)
    else:
        covered = covered.withColumn("consistency", F.lit(1.0))
    return covered.select("doc_id", "item_id", "n_windows", "coverage", "consistency")


def _consistency(own: DataFrame, covered: DataFrame, wanted: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """Per document and item: share of the item's slot values that stand for one value, in the best place.

    A place is a shift between the document's and the item's words. Only documents that cover an item are read again.
    """
    keys = ["doc_id", "text_key"]
    needed = covered.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    again = own.join(needed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_semi")
    again = again.dropDuplicates(keys).select(*keys, tokens(F.col("text")).alias("words"))
    slotted = wanted.where(F.size("values") > 0)
    placed = _hits(_with_forms(again), keys, slotted, lengths, few).join(again.select(*[F.col(k).alias(f"r_{k}") for k in keys], "words"), (F.col("text_key") == F.col("r_text_key")) & F.col("doc_id").eqNullSafe(F.col("r_doc_id")))
    filled = placed.select(*keys, "hash", "length", F.col("at").cast("long").alias("doc_at"), slots(F.expr("slice(words, at + 1, length)")).alias("here"))
    pairs = filled.join(slotted, ["hash", "length"]).select(
        *keys, "item_id", (F.col("doc_at") - F.col("at")).alias("shift"), F.explode(F.arrays_zip("values", F.when(F.col("exact"), F.col("values")).otherwise(F.col("here")).alias("here"))).alias("pair")
    )
    values = pairs.groupBy(*keys, "item_id", "shift", F.col("pair.values").alias("value")).agg(
        F.min("pair.here").alias("low"), F.max("pair.here").alias("high"), F.count(F.lit(1)).alias("n")
    )
    places = values.groupBy(*keys, "item_id", "shift").agg(
        F.sum("n").alias("n"), F.avg((F.col("low") == F.col("high")).cast("double")).alias("consistency")
    )
    # the place with most slots, then the most consistent
    return places.groupBy(*keys, "item_id").agg(F.max(F.struct("n", "consistency"))["consistency"].alias("consistency"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows that share an id go together."""
    found = write_once(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    names = docs.columns
    return docs.join(found.withColumnRenamed("doc_id", "__found"), F.col("doc_id").eqNullSafe(F.col("__found")), "left_anti").select(*names)
