"""Personal data: candidate generators, gradient-boosted trees, calibrated threshold.

Strict patterns with checks (parts of an address, Luhn sums, digit counts) give the base spans, which always stay. Wider
generators propose overlapping spans that the strict ones miss: addresses spelled with "(at)" and "[dot]", addresses in any
alphabet, telephone numbers without a plus sign, card numbers with other separators, version 6 addresses. Boosted trees
judge them by format and context. They learn from the corpus itself: candidates of the strict patterns that pass or
fail the checks, and passing ones with a part of their format hidden (no plus, no at sign, other separators), so that
trees must rely on the rest. The threshold is the lowest that keeps precision on a held-out part of them. All candidates are
learned from: those with the same features are one row with their number as its weight.

All of it is DataFrame expressions; the trees are unfolded into one. A text's spans stay arrays inside its row, so
nothing is shuffled but the strict candidates' features. Patterns use possessive quantifiers: no backtracking, no deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import write_once

KINDS = ("email", "ip", "card", "phone")
ITERATIONS, DEPTH = 6, 3
PRECISION = 0.95
BLOCK, PIECE = 256, 2048  # items, and code points, that are gone through at a time
CONTEXT = 24           # characters looked at before a candidate

# fixed values: the strict patterns; where a match can only begin at the start of a run, that is said outright
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": [
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[] ?(?i:at) ?[)\]] ?[A-Za-z0-9-]++(?: ?[(\[] ?(?i:dot) ?[)\]] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    ],
    "ip": [r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"],
    "card": [r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])"],
    "phone": [r"(?<![0-9+./-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"],
}
# cheap tests of the whole text before a pattern is tried
GATES = {"email": "[@(\\[]", "ip": "[0-9][.:]", "card": "[0-9]", "phone": "[0-9]"}
CUES = {
    "email": "mail|contact|write|address|@",
    "ip": "ip|host|server|address|addr|network",
    "card": "card|visa|credit|debit|payment|iban|account",
    "phone": "phone|tel|call|fax|mobile|contact|dial",
}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside another lambda function it would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """All that the steps put out, as an array of the type ``out``, going through the items from left to right.

    ``step`` makes of the state and an item the next state and an array. Arrays are copied when they grow, so what is
    put out is kept in blocks of ``BLOCK`` items: the work is linear in any text.
    """
    empty, blocks = F.expr(f"cast(array() as array<{out}>)"), F.expr(f"cast(array() as array<array<{out}>>)")

    def one(acc: Column, item: Column) -> Column:
        new, more = step(acc["state"], item)
        return F.struct(new.alias("state"), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        return bound(
            F.aggregate(part, F.struct(acc["state"].alias("state"), empty.alias("out")), one),
            lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")),
        )

    def through(all_items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_items, i * BLOCK + 1, BLOCK))
        done = F.aggregate(parts, F.struct(state.alias("state"), blocks.alias("out")), block, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(all_items) > 0, done).otherwise(empty)

    return bound(items, through)


def cut(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, the last one shorter; reading far into a long string is slow."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from one place to another, start not before 0."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    head, tail = F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, last), F.lit(""))
    far = F.concat(
        F.substring(head, start % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(tail, F.lit(1), end % PIECE),
    )
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(head, start % PIECE + 1, end - start)).otherwise(far)


def spans(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, in code points: what lies between the matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
        pairs = F.zip_with(gaps, values, lambda gap, value: F.struct(F.length(gap).alias("gap"), F.length(value).alias("long"), value.alias("value")))

        def step(at: Column, m: Column) -> tuple[Column, Column]:
            begin = at + m["gap"]
            end = begin + m["long"]
            return end, F.array(F.struct(begin.alias("start"), end.alias("end"), m["value"].alias("value")))

        return scan(pairs, F.lit(0), "struct<start:int,end:int,value:string>", step)

    return bound(found, placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the checksum of a string of digits is right."""
    n = F.length(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a strict match."""
    number = digits(value)
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

        return F.forall(F.split(value, "\\."), small)
    if kind == "card":
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(8, 15)
    return F.lit(True)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<kind:int,start:int,end:int,value:string,strict:boolean,base:boolean>>)")


def candidates(text: Column) -> Column:
    """All candidates of a text; ``strict`` ones match a strict pattern, ``base`` ones pass its check too."""
    parts = []
    for k, kind in enumerate(KINDS):
        def of(found: Column, strict: bool, k: int = k, kind: str = kind) -> Column:
            return F.transform(found, lambda x: F.struct(
                F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"),
                F.lit(strict).alias("strict"), (passes(kind, x["value"]) if strict else F.lit(False)).alias("base"),
            ))

        mine = [of(spans(text, STRICT[kind]), True), *(of(spans(text, p), False) for p in WIDE[kind])]
        parts.append(F.when(text.rlike(GATES[kind]), F.concat(*mine)).otherwise(_none()))
    return F.when(text.rlike("[0-9@(\\[]"), F.concat(*parts)).otherwise(_none())


FEATURES = [
    "kind", "digits", "length", "plus", "at", "spelled", "paren", "separators", "dots", "longest_digits", "letters",
    "after_space", "before_space", "cue", "groups",
]


def features(pieces: Column, c: Column) -> list[Column]:
    """Format and context of a candidate, as numbers in the order of ``FEATURES``."""
    value = c["value"]
    before = F.lower(between(pieces, F.greatest(c["start"] - CONTEXT, F.lit(0)), c["start"]))
    left = F.when(c["start"] > 0, between(pieces, c["start"] - 1, c["start"])).otherwise(F.lit(" "))
    right = between(pieces, c["end"], c["end"] + 1)
    cue = reduce(lambda a, k: a | ((c["kind"] == k) & before.rlike(CUES[KINDS[k]])), range(len(KINDS)), F.lit(False))
    runs = F.split(value, "[^0-9]+")
    found = [
        c["kind"], F.length(digits(value)), F.length(value), value.startswith("+"), value.contains("@"), value.rlike("(?i)[(\\[] ?at"),
        value.contains("("), F.length(F.regexp_replace(value, "[^ ./_-]", "")), F.length(F.regexp_replace(value, "[^.]", "")),
        F.array_max(F.transform(runs, F.length)), F.length(F.regexp_replace(value, "[^\\p{L}]", "")),
        left.rlike("\\s"), (right == "") | right.rlike("[\\s.,;:!?)]"), cue, F.size(runs),
    ]
    return [x.cast("double") for x in found]


def hidden(values: Column) -> Column:
    """A passing candidate's features, and variants with parts of its format hidden; ``values`` is the array of features."""
    def with_(**change: Column) -> Column:
        return F.array(*(change.get(name, values[i]) for i, name in enumerate(FEATURES)))

    def at(name: str) -> Column:
        return values[FEATURES.index(name)]

    zero, one = F.lit(0.0), F.lit(1.0)
    return F.concat(
        F.array(values),
        F.when(at("kind") == 0, F.array(with_(at=zero, spelled=one, paren=one), with_(letters=at("letters") + 1)))
        .when(at("kind") == 2, F.array(with_(separators=F.lit(3.0), length=F.lit(19.0), longest_digits=F.lit(4.0), groups=F.lit(4.0), dots=F.lit(3.0))))
        .when(at("kind") == 3, F.array(
            with_(plus=zero, digits=F.lit(10.0), length=F.lit(14.0), separators=F.lit(2.0), groups=F.lit(4.0)),
            with_(plus=zero, digits=F.lit(10.0), length=F.lit(12.0), separators=F.lit(2.0), paren=zero, groups=F.lit(3.0)),
        )).otherwise(F.array(with_(dots=zero))),
    )


class Trees:
    """Boosted trees as one expression over the array of features, with the threshold."""

    def __init__(self, trees: list[tuple[float, object]], threshold: float) -> None:
        self.trees, self.threshold = trees, threshold

    def probability(self, values: Column) -> Column:
        def walk(node) -> Column:
            if node.getClass().getSimpleName() == "LeafNode":
                return F.lit(float(node.prediction()))
            split = node.split()
            return F.when(values[split.featureIndex()] <= float(split.threshold()), walk(node.leftChild())).otherwise(walk(node.rightChild()))

        margin = reduce(lambda a, b: a + b, [F.lit(float(w)) * walk(root) for w, root in self.trees])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def fit_trees(docs: DataFrame) -> Trees | None:
    """Fit on all strict candidates, counted by their features; None if all of them pass, or all fail."""
    text = F.col("text")
    strict = F.filter(candidates(text), lambda c: c["strict"])
    described = bound(F.when(F.size(strict) > 0, cut(text)), lambda pieces: F.transform(strict, lambda c: F.struct(c.alias("c"), F.array(*features(pieces, c)).alias("f"))))
    found = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("of"), F.explode(described).alias("x"))
    rows = found.select(F.col("x.c.base").cast("double").alias("label"), "x.f", F.xxhash64("x.c.value", "x.c.start", "of").alias("rank"))
    # equal candidates of copied texts count once
    distinct = rows.groupBy("rank").agg(F.first("label").alias("label"), F.first("f").alias("f"))
    # an expanded row keeps its fold; from here on a row stands for all that look alike to the trees
    varied = distinct.withColumn("f", F.explode(F.when(F.col("label") > 0, hidden(F.col("f"))).otherwise(F.array("f"))))
    held_out = (F.pmod("rank", F.lit(5)) == 0).alias("held_out")
    counted = write_once(varied.groupBy("label", "f", held_out).agg(F.count(F.lit(1)).cast("double").alias("weight")), "pii-candidates")
    train = counted.where("not held_out")
    n, passed = train.agg(F.sum("weight"), F.sum(F.col("label") * F.col("weight"))).first()
    if not n or passed in (0, n):
        return None
    data = train.select("label", "weight", array_to_vector("f").alias("features"))
    model = GBTClassifier(maxIter=ITERATIONS, maxDepth=DEPTH, seed=5, stepSize=0.3, maxBins=32, weightCol="weight").fit(data)
    trees = Trees([(w, t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees)], 0.5)
    scored = counted.where("held_out").select("label", "weight", trees.probability(F.col("f")).alias("p"))
    steps = [i / 20 for i in range(10, 20)]
    sums = scored.agg(*(
        (F.sum(F.when(F.col("p") >= t, F.col("label") * F.col("weight"))) / F.sum(F.when(F.col("p") >= t, F.col("weight")))).alias(f"t{i}")
        for i, t in enumerate(steps)
    )).first()
    good = [t for t, precision in zip(steps, sums) if precision is not None and precision >= PRECISION]
    trees.threshold = good[0] if good else steps[-1]
    return trees


SPAN = "struct<kind:int,start:int,end:int>"
FAR = (1 << 31) - 1  # beyond every text


def _bare(c: Column) -> Column:
    return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))


def _free(found: Column) -> Column:
    """Candidates, by start, that are neither strict nor overlap a base span; one sweep from either side."""
    kept = F.filter(found, lambda c: c["base"] | ~c["strict"])
    by_start = F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"), c["value"].alias("value"))))
    type_ = "struct<start:int,end:int,kind:int,base:boolean,value:string>"

    def until(before: Column, c: Column) -> tuple[Column, Column]:
        """Leave out those that a base span reaches into from the left."""
        kept = c["base"] | (c["start"] >= before)
        return F.when(c["base"], F.greatest(before, c["end"])).otherwise(before), F.filter(F.array(c), lambda _: kept)

    def from_(behind: Column, c: Column) -> tuple[Column, Column]:
        """Leave out base spans, and those that reach into one to the right."""
        kept = ~c["base"] & (c["end"] <= behind)
        return F.when(c["base"], F.least(behind, c["start"])).otherwise(behind), F.filter(F.array(c), lambda _: kept)

    # a base span that begins where a candidate does may stand on either side of it
    return F.reverse(scan(F.reverse(scan(by_start, F.lit(-1), type_, until)), F.lit(FAR), type_, from_))


def all_spans(text: Column, found: Column, trees: Trees | None) -> Column:
    """Base spans, and accepted others that don't overlap these; by kind, then start.

    Of accepted ones that overlap, going from left to right, the more likely stays, of equal ones the one that begins
    first, then the longer one.
    """
    base = F.transform(F.filter(found, lambda c: c["base"]), _bare)
    if trees is None:
        return F.sort_array(base)

    def judged(pieces: Column) -> Column:
        described = F.transform(_free(found), lambda c: F.struct(
            c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"), F.array(*features(pieces, c)).alias("f")))
        scored = F.transform(described, lambda c: F.struct(c["start"].alias("start"), c["back"].alias("back"), c["kind"].alias("kind"), trees.probability(c["f"]).alias("p")))
        return F.array_sort(F.filter(scored, lambda c: c["p"] >= trees.threshold))

    def better(kept: Column, c: Column) -> tuple[Column, Column]:
        apart = c["start"] >= -kept["back"]
        # what is kept is put out when the next one begins behind it; the first and the last are no candidates
        out = F.filter(F.array(F.struct(kept["kind"].alias("kind"), kept["start"].alias("start"), (-kept["back"]).alias("end"))), lambda x: apart & (x["start"] >= 0))
        return F.when(apart | (c["p"] > kept["p"]), c).otherwise(kept), out

    def edge(at: int) -> Column:
        return F.struct(F.lit(at).alias("start"), F.lit(-at).alias("back"), F.lit(0).alias("kind"), F.lit(2.0).alias("p"))

    with_end = F.concat(bound(cut(text), judged), F.array(edge(FAR)))
    both = F.sort_array(F.concat(base, scan(with_end, edge(-1), SPAN, better)))
    return F.when(F.exists(found, lambda c: ~c["strict"]), both).otherwise(F.sort_array(base))


def _text(found: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", name[c["kind"]], c["start"].cast("string"), c["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` and ``found``, arrays of (kind, start, end).

    Kinds are numbered as in ``KINDS``. Null and empty texts have no spans. Without candidates to learn from,
    ``found`` is ``base``. Repeated rows are searched each on their own; further columns are not looked at.
    """
    trees = fit_trees(docs.select("text"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("c", candidates(F.col("text")))
    base = F.sort_array(F.transform(F.filter("c", lambda c: c["base"]), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return own.select("doc_id", base.alias("base"), all_spans(F.col("text"), F.col("c"), trees).alias("found"))


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans as text."""
    found = find_personal_data(docs)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("found")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The columns and rows of ``docs``, with every span in ``text`` replaced by its kind in brackets.

    Spans that overlap become one, named after the first. Null texts stay null. A column ``n_chars`` is kept in step.
    """
    trees = fit_trees(docs.select("text"))
    # the row is kept as it is, so none of its names can clash
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("c", candidates(F.col("text")))
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform(all_spans(F.col("text"), F.col("c"), trees), lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))
    # the end of the text closes the last gap; its kind has no name
    ends = F.array(F.struct(F.length("text").alias("start"), (-F.length("text")).alias("back"), F.lit(len(KINDS)).alias("kind")))

    def whole(pieces: Column) -> Column:
        def step(at: Column, c: Column) -> tuple[Column, Column]:
            said = F.array(between(pieces, at, c["start"]), F.coalesce(F.get(name, c["kind"]), F.lit("")))
            return F.greatest(at, -c["back"]), F.filter(said, lambda _: c["start"] >= at)

        return F.array_join(scan(F.concat(by_start, ends), F.lit(0), "string", step), "")

    marked = own.withColumn("new", F.when(F.size("c") > 0, bound(cut(F.col("text")), whole)).otherwise(F.col("row.text")))
    columns = [
        F.col("new").alias("text") if c == "text"
        else F.when(F.col("new").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars"
        else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return marked.select(*columns)
