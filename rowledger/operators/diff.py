"""Cell-level comparison of two table sets.

The comparison goes in two steps so that unchanged rows are never shuffled whole:

1. Every row becomes three hashes (key, and two of its compared cells). Grouping by the key
   hash, with partial sums before the shuffle, tells which keys are not the same on both
   sides. A hash clash can only let a key through to step 2, except when all 96 bits of two
   different row contents under one key agree.
2. Rows of those keys are joined on their real key, and the changed cells are exploded. Where the list
   of keys is too long to be sent to all tasks, a bitmap of it is, so that only its rows are shuffled.

Keys are expected to identify a row but need not. A key that is unique on both sides is paired.
A key that repeats on a side stands for every old row meeting every new one; these pairs are
counted and never formed, however few they are, see ``_crowded_updates``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowledger.functions.cells import cells_at, cells_differ, key_text, literal, text, value_class
from rowledger.model import LOG_COLUMNS, POSITION, TABLE_KEY, Frame, TableSet
from rowledger.operators.pairs import AFTER_ONLY, before_only_warnings, pair_tables, structural_changes
from rowledger.storage import write_once

ROW_KEY = [*TABLE_KEY, "key_tuple"]
CELL_KEY = [*ROW_KEY, "column_name"]
SPELLED_TABLES = 100
# Sizes that choose a plan: keys that need no bitmap, bits per key, and the longest bitmap (32 MB).
LISTED_KEYS, BITS_PER_KEY, MOST_BITS = 20_000, 16, 1 << 28
# Size that chooses a plan: rows of a repeated key, both sides together, that are brought into one task.
GATHERED_ROWS = 1000

# Fixed texts.
FRESH_NOTE = "Value on newly added column"
TABLE_ADD_NOTE = "Part of table_add"
CROWDED_NOTE = "Repeated key: old and new values listed apart"

# Tables of the same columns at the same places are compared by their cells as they are: a difference that is none, such as in a
# key's spelling, only lets the key through to step 2.
SAME_LAYOUT = (
    "(common.a = common.b and a_key = b_key and size(common) + size(a_key) = size(a_columns) and size(a_columns) = size(b_columns))"
)
NO_POSITION = f"cast(null as {POSITION.simpleString()})"


@dataclass(frozen=True)
class Diff:
    """``log`` has the ten log columns, ``seq`` (order of equal log keys) and ``copies``."""

    pairs: DataFrame
    log: DataFrame
    warnings: DataFrame
    errors: DataFrame


def _sequence(old: str, new: str) -> str:
    return f"struct({old} as old, {new} as new)"


def _prepare(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of comparable tables with their matching key, key hash and content hashes."""
    layout = pairs.where("comparable").selectExpr(
        *TABLE_KEY, f"{side}_key as key_places", f"common.{side} as places", f"{SAME_LAYOUT} as same_layout"
    )
    return (
        rows.join(layout, TABLE_KEY)
        .selectExpr(
            *TABLE_KEY, "pos", "cells", f"if(same_layout, cells, {cells_at('cells', 'places')}) as content",
            f"{key_text('cells', 'key_places')} as key_tuple",
        )
        .selectExpr(
            *ROW_KEY, "pos", "cells", f"xxhash64({', '.join(ROW_KEY)}) as key_hash",
            "xxhash64(key_tuple, content) as content_a", "hash(key_tuple, content) as content_b",
        )
    )


@dataclass(frozen=True)
class Side:
    """Rows of comparable tables of one side.

    ``hashes`` has the key hash and content hashes of all, ``rows`` gives their key, position and cells, of all or
    of those that a filter on the key hash lets through.
    """

    hashes: DataFrame
    rows: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]

    def all_rows(self) -> DataFrame:
        return self.rows(lambda rows: rows)


# Types whose equal values have equal texts.
TYPED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _hashed_as_typed(before: Frame, after: Frame, common: list[Row]) -> bool:
    """Whether the common columns have the same types on both sides, so that no text is needed to compare them."""
    return all(
        before.types[c.b] == after.types[c.a] and (isinstance(before.types[c.b], TYPED) or before.types[c.b] == T.StringType())
        for c in common
    )


def _framed(before: TableSet, after: TableSet, pairs: DataFrame, side: str) -> Side | None:
    """The rows of a side that is made of ordinary frames, or null. Keys are looked at before cells are made."""
    own, other = ({(f.change_request_id, f.table_name): f for f in t.frames} for t in ((before, after) if side == "b" else (after, before)))
    if not own:
        return None
    hashes, keyed = [], []
    # a row per frame, which the driver has already
    for pair in pairs.where("comparable").selectExpr(*TABLE_KEY, f"{side}_key as key_places", "common", f"{SAME_LAYOUT} as same_layout").collect():
        name = (pair.change_request_id, pair.table_name)
        frame = own[name]
        rows = frame.keyed(pair.key_places, ROW_KEY)
        places = [c[side] for c in pair.common]
        twin = other.get(name)
        if twin is not None and _hashed_as_typed(*((frame, twin) if side == "b" else (twin, frame)), pair.common):
            # a null leaves a hash as it is, so it is hashed as such
            content = "".join(f", c{i}, isnull(c{i})" for i in places)
        else:
            cells = frame.cells if pair.same_layout else [frame.cells[i] for i in places]
            content = f", cast(array({', '.join(cells)}) as array<string>)"
        hashes.append(rows.selectExpr("key_hash", f"xxhash64(key_tuple{content}) as content_a", f"hash(key_tuple{content}) as content_b"))
        keyed.append((frame, rows))
    if not keyed:
        return None
    return Side(
        reduce(DataFrame.unionAll, hashes),
        lambda pick: reduce(DataFrame.unionAll, [f.as_rows(pick(rows)) for f, rows in keyed]).select(*ROW_KEY, "pos", "cells", "key_hash"),
    )


def _side(before: TableSet, after: TableSet, pairs: DataFrame, side: str) -> Side:
    framed = _framed(before, after, pairs, side)
    if framed is not None:
        return framed
    rows = _prepare((before if side == "b" else after).rows, pairs, side)
    return Side(rows.select("key_hash", "content_a", "content_b"), lambda pick: pick(rows).select(*ROW_KEY, "pos", "cells", "key_hash"))


def changed_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Key hashes whose rows differ between the sides, whether the key repeats on one, and whether its rows are too many for one task."""
    hashes = ["key_hash", "content_a", "content_b"]
    both = before.selectExpr(*hashes, "1 as b", "0 as a").unionAll(after.selectExpr(*hashes, "0 as b", "1 as a"))
    profile = both.groupBy("key_hash").agg(
        F.expr("sum(b) as b"), F.expr("sum(a) as a"),
        F.expr("min(content_a) = max(content_a) and min(content_b) = max(content_b) as alike"),
    )
    return profile.where("not (b > 0 and a > 0 and alike)").selectExpr(
        "key_hash", "b > 1 or a > 1 as crowded", f"b + a > {GATHERED_ROWS} as vast"
    )


def bitmap_bits(n_keys: int) -> int:
    return min(MOST_BITS, 1 << (BITS_PER_KEY * n_keys).bit_length())


def _slot(bits: int) -> str:
    return f"pmod(key_hash, {bits}L) + 1"


def key_bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """Key hashes as a bitmap of ``bits`` bits, in rows of 4 KB: 512 numbers, whose first byte has the lowest bits."""
    slots = keys.selectExpr(f"{_slot(bits)} as slot").selectExpr(
        "bitmap_bucket_number(slot) as bucket", "bitmap_bit_position(slot) as place"
    )
    word = "cast(conv(hex(substring(bitmap, 8 * i + 1, 8)), 16, -10) as bigint)"
    return slots.repartition("bucket").groupBy("bucket").agg(F.expr("bitmap_construct_agg(place) as bitmap")).selectExpr(
        "bucket", f"transform(sequence(0, 511), i -> {word}) as words"
    )


def maybe_listed(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """Rows whose key hash is in the bitmap: all rows of its keys, and few others."""
    place = f"bitmap_bit_position({_slot(bits)})"
    word = f"get(words, cast({place} div 64 as int))"
    found = f"bitmap_bucket_number({_slot(bits)}) = bucket and getbit({word}, cast({place} & 63 ^ 56 as int)) = 1"
    # no semi join, which Spark would push below the hashes, to make them again
    return rows.join(F.broadcast(bitmap), F.expr(found)).drop("bucket", "words")


def _changes(kind: str, columns: str, old: str, new: str, notes: str = "") -> str:
    """One struct per listed column ``c``."""
    return (
        f"transform({columns}, c -> struct('{kind}' as change_type, c.name as column_name,"
        f" {old} as old_value, {new} as new_value, {literal(notes)} as notes))"
    )


def _cell(cells: str, place: str) -> str:
    return text(f"get({cells}, {place})")


def _added_cells(cells: str, notes: str = "") -> str:
    columns = "transform(a_columns, (n, i) -> struct(n as name, i as a))"
    return _changes("row_add", columns, "''", _cell(cells, "c.a"), notes)


def _deleted_cells(cells: str) -> str:
    return _changes("row_delete", "kept", _cell(cells, "c.b"), "''")


def _emit(rows: DataFrame, entries: str, seq: str) -> DataFrame:
    """Explode change structs into log rows."""
    return (
        rows.selectExpr(
            *ROW_KEY, "nb as n_keys_before", "na as n_keys_after", f"{seq} as seq", f"explode({entries}) as change"
        )
        .select(*ROW_KEY, "n_keys_before", "n_keys_after", "change.*", "seq")
        .selectExpr(*LOG_COLUMNS, "seq", "1L as copies")
    )


def _row_changes(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """Added, deleted and updated rows from one full outer join on the key."""
    b = before.selectExpr(*ROW_KEY, "pos as b_pos", "cells as b_cells")
    a = after.selectExpr(*ROW_KEY, "pos as a_pos", "cells as a_cells")
    layout = pairs.where("comparable").select(*TABLE_KEY, "nb", "na", "a_columns", "kept", "common")
    differing = f"filter(common, c -> {cells_differ('get(b_cells, c.b)', 'get(a_cells, c.a)')})"
    updates = _changes("value_update", differing, _cell("b_cells", "c.b"), _cell("a_cells", "c.a"))
    entries = (
        f"case when b_cells is null then {_added_cells('a_cells')}"
        f" when a_cells is null then {_deleted_cells('b_cells')} else {updates} end"
    )
    joined = b.join(a, ROW_KEY, "full_outer").join(layout, TABLE_KEY)
    return _emit(joined, entries, _sequence("b_pos", "a_pos"))


def _fresh_fills(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """New columns of rows that existed before: once per new row, whatever the key repeats."""
    layout = pairs.where("comparable and size(fresh) > 0").select(*TABLE_KEY, "nb", "na", "fresh")
    known = before.join(layout.select(*TABLE_KEY), TABLE_KEY, "left_semi").select(*ROW_KEY).distinct()
    # only the new cells go through the join with the known keys
    fills = f"transform(fresh, c -> {_cell('cells', 'c.a')}) as fills"
    filled = after.join(layout.select(*TABLE_KEY, "fresh"), TABLE_KEY).selectExpr(*ROW_KEY, "pos", fills)
    rows = filled.join(known, ROW_KEY, "left_semi").join(layout, TABLE_KEY)
    columns = "transform(fresh, (f, i) -> struct(f.name as name, get(fills, i) as value))"
    entries = _changes("value_update", columns, "''", "c.value", FRESH_NOTE)
    return _emit(rows, entries, _sequence(NO_POSITION, "pos"))


def _new_tables(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """All cells of tables that only the new side has."""
    layout = pairs.where(f"kind = '{AFTER_ONLY}'").select(*TABLE_KEY, "nb", "na", "a_columns", "a_key")
    keyed = rows.join(layout, TABLE_KEY).selectExpr("*", f"{key_text('cells', 'a_key')} as key_tuple")
    return _emit(keyed, _added_cells("cells", TABLE_ADD_NOTE), _sequence(NO_POSITION, "pos"))


def _lone_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys with rows on one side only."""
    sides = before.selectExpr(*ROW_KEY, "1 as b", "0 as a").unionAll(after.selectExpr(*ROW_KEY, "0 as b", "1 as a"))
    return sides.groupBy(*ROW_KEY).agg(F.max("b").alias("b"), F.max("a").alias("a")).where("b = 0 or a = 0")


def _crowded_rows(before: DataFrame, after: DataFrame, pairs: DataFrame, lone: DataFrame) -> list[DataFrame]:
    """Added and deleted rows of repeated keys: a small written list of keys decides, nothing is paired."""
    layout = pairs.where("comparable").select(*TABLE_KEY, "nb", "na", "a_columns", "kept")
    any_added, any_deleted = lone.selectExpr("max(b = 0)", "max(a = 0)").first()
    parts = []
    if any_added:
        added = after.join(lone.where("b = 0").select(*ROW_KEY), ROW_KEY, "left_semi").join(layout, TABLE_KEY)
        parts.append(_emit(added, _added_cells("cells"), _sequence(NO_POSITION, "pos")))
    if any_deleted:
        deleted = before.join(lone.where("a = 0").select(*ROW_KEY), ROW_KEY, "left_semi").join(layout, TABLE_KEY)
        parts.append(_emit(deleted, _deleted_cells("cells"), _sequence("pos", NO_POSITION)))
    return parts


@dataclass(frozen=True)
class Places:
    """How the positions of a side's rows become numbers in the same order, whose maximum a hash aggregation can keep.

    ``splits`` are the numbered (part, block) of every table with their lowest line; each takes ``width`` numbers.
    """

    splits: DataFrame
    width: int
    dtype: str

    @property
    def _width(self) -> str:
        return f"{self.width}L" if self.dtype == "bigint" else f"{self.width}BD"

    def number(self) -> str:
        if self.dtype == "bigint":
            return f"split * {self._width} + (pos.line - low)"
        line = "cast(pos.line as decimal(20,0)) - cast(low as decimal(20,0))"
        return f"cast(cast(split as decimal(12,0)) * {self._width} + ({line}) as {self.dtype})"

    def with_positions(self, rows: DataFrame, place: str) -> DataFrame:
        """Rows with the positions, as ``<place>_pos``, of the numbers ``place``."""
        line = f"cast({place} % {self._width} + low as bigint)"
        pos = f"cast(if({place} is null, null, struct(part, block, {line} as line)) as {POSITION.simpleString()})"
        return rows.selectExpr("*", f"cast({place} div {self._width} as int) as split").join(
            self.splits, [*TABLE_KEY, "split"], "left"
        ).selectExpr(*rows.columns, f"{pos} as {place}_pos")


def _numbered(rows: DataFrame, whole: DataFrame | None = None) -> tuple[DataFrame, Places]:
    """Rows with their position as one number: a long integer, unless the lines of the splits are too far apart for that.

    ``whole`` may give the rows that ``rows`` come from, where their positions are cheaper to read.
    """
    same_split = [*TABLE_KEY, "part", "block"]
    found = (rows if whole is None else whole).selectExpr(*TABLE_KEY, "pos.part", "pos.block", "pos.line").groupBy(*same_split).agg(
        F.min("line").alias("low"), F.max("line").alias("high")
    )
    ranked = f"row_number() over (partition by {', '.join(TABLE_KEY)} order by part, block) - 1 as split"
    splits = write_once(found.selectExpr(*same_split, "low", "high", ranked), "splits-of-rows")
    most, widest = splits.selectExpr("max(split) + 1", "max(cast(high as decimal(20,0)) - low) + 1").first()
    width = int(widest or 1)
    places = Places(splits.drop("high"), width, "bigint" if (most or 0) * width < 1 << 63 else "decimal(38,0)")
    in_split = rows.withColumns({"part": F.col("pos.part"), "block": F.col("pos.block")}).join(places.splits, same_split)
    return in_split.selectExpr(*ROW_KEY, "cells", f"{places.number()} as place"), places


def _counts(side: str, b_places: Places, a_places: Places, times: str = "1L") -> list[str]:
    """A row counted for its side, with its place there."""
    types = {"b": b_places.dtype, "a": a_places.dtype}
    return [f"{times if side == s else '0L'} as n_{s}" for s in "ba"] + [
        f"{'place' if side == s else f'cast(null as {types[s]})'} as place_{s}" for s in "ba"
    ]


COUNTS = ["n_b", "n_a", "place_b", "place_a"]


def _counted(cells: DataFrame, cell: list[str]) -> DataFrame:
    """Every text of a cell once: how often each side has it, and where last."""
    return cells.groupBy(*cell, "value").agg(
        F.sum("n_b").alias("n_b"), F.sum("n_a").alias("n_a"), F.max("place_b").alias("place_b"), F.max("place_a").alias("place_a")
    ).selectExpr("*", f"{value_class('value')} as class")


def _listed_apart(values: DataFrame, cell: list[str], last_old: str, b_places: Places, a_places: Places) -> DataFrame:
    """Log values of each text that takes part in a differing pair: an old one, and a new one with its number of pairs."""
    fields = "old_value, new_value, old_place, new_place, copies, listed"
    old = f"value, cast(null as string), place_b, cast(null as {a_places.dtype}), 0L, n_b > 0 and total_a > alike_a"
    new = f"cast(null as string), value, {last_old}, place_a, n_a * (total_b - alike_b), n_a > 0 and total_b > alike_b and last is not null"
    return values.selectExpr(*cell, f"stack(2, {old}, {new}) as ({fields})").where("listed").drop("listed")


def _as_updates(lines: DataFrame, b_places: Places, a_places: Places) -> DataFrame:
    """Log rows of values listed apart."""
    placed = a_places.with_positions(b_places.with_positions(lines, "old_place"), "new_place")
    return placed.selectExpr(
        *TABLE_KEY, "'value_update' as change_type", "nb as n_keys_before", "na as n_keys_after", "key_tuple",
        "column_name", "old_value", "new_value", f"{literal(CROWDED_NOTE)} as notes",
        f"{_sequence('old_place_pos', 'new_place_pos')} as seq", "copies",
    )


def _crowded_updates(
    before: DataFrame, after: DataFrame, b_whole: DataFrame, a_whole: DataFrame, pairs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Updates of repeated keys without forming the pairs, and the list of keys with rows on one side only.

    A pair differs when the two cells fall into different value classes, so the pairs of one
    cell need only be counted. Each old and each new text that takes part in a differing pair
    becomes one log row with the other side null; the new ones carry the number of pairs as
    ``copies`` and, as ``seq``, the last pair they belong to. The work is linear in the rows.

    All rows may share one key: the cells of both sides are counted by their text first and met by value class, which
    spreads a key over all tasks. What is then joined by the key alone is one row per cell and written, so that it can be
    sent to all tasks. Tables and columns are numbers until the end, because every cell is a row of the first count. Keys
    of few rows take the shorter way of ``_gathered_updates``.
    """
    names = "transform(common, c -> c.name)"

    def numbers(side: str) -> list[str]:
        """Per cell of a row: number of its column, or null, and how many columns of that name count it. 0 stands for no column in common."""
        each = f"transform(sequence(0, greatest(size({side}_columns), 1) - 1), i -> "
        found = f"filter(common, c -> c.{side} = i)"
        number = f"cast(nullif(array_position({names.replace('c ', 'd ').replace('c.', 'd.')}, get({found}, 0).name), 0) as int)"
        return [
            f"{each}if(i = 0 and size(common) = 0, 0, {number})) as {side}_numbers", f"{each}greatest(size({found}), 1)) as {side}_times",
        ]

    layout = write_once(pairs.where("comparable").selectExpr(
        *TABLE_KEY, "monotonically_increasing_id() as nth_table", "nb", "na", f"{names} as names", *numbers("b"), *numbers("a"),
    ), "numbered-tables")
    cell = ["nth_table", "key_tuple", "nth_column"]
    b_rows, b_places = _numbered(before, b_whole)
    a_rows, a_places = _numbered(after, a_whole)

    def cells(rows: DataFrame, side: str) -> DataFrame:
        missing = f"size({side}_numbers) - size(cells)"
        return (
            rows.join(layout.select(*TABLE_KEY, "nth_table", f"{side}_numbers", f"{side}_times"), TABLE_KEY)
            .withColumn("cells", F.expr(f"if({missing} > 0, concat(cells, array_repeat('', {missing})), cells)"))
            .selectExpr("nth_table", "key_tuple", f"{side}_numbers", f"{side}_times", "place", "posexplode(cells) as (at, cell)")
            .selectExpr(
                "nth_table", "key_tuple", f"get({side}_numbers, at) as nth_column", f"{text('cell')} as value",
                *_counts(side, b_places, a_places, f"cast(get({side}_times, at) as bigint)"),
            )
            .where("nth_column is not null")
        )

    of_class = f"partition by {', '.join(cell)}, class"
    values = write_once(
        _counted(cells(b_rows, "b").unionAll(cells(a_rows, "a")), cell)
        .selectExpr("*", f"row_number() over ({of_class} order by value) as nth_text")
        .selectExpr(
            *cell, "value", *COUNTS, "nth_text", f"sum(n_b) over ({of_class}) as alike_b", f"sum(n_a) over ({of_class}) as alike_a",
            f"max(place_b) over ({of_class}) as class_place",
        ),
        "values-by-class",
    )
    classes = values.where("nth_text = 1")
    totals = write_once(classes.groupBy(*cell).agg(
        F.sum("alike_b").alias("total_b"), F.sum("alike_a").alias("total_a"), F.max("class_place").alias("last")
    ), "totals")
    # an old row outside a class: the last of all, but for the one class that has it alone
    ends = write_once(
        classes.join(totals, cell).groupBy(*cell, "total_b", "total_a", "last").agg(
            F.expr("max(if(class_place < last, class_place, null)) as second"), F.expr("sum(if(class_place = last, 1, 0)) as n_last")
        ),
        "ends",
    )
    last_old = "if(class_place = last and n_last = 1, second, last)"
    lines = _listed_apart(values.join(ends, cell), cell, last_old, b_places, a_places)
    named = lines.where("nth_column > 0").join(layout.select(*TABLE_KEY, "nth_table", "nb", "na", "names"), "nth_table").selectExpr(
        "*", "get(names, nth_column - 1) as column_name"
    )
    sides = ends.groupBy("nth_table", "key_tuple").agg(F.max("total_b").alias("b"), F.max("total_a").alias("a")).where("b = 0 or a = 0")
    lone = write_once(sides.join(layout.select(*TABLE_KEY, "nth_table"), "nth_table").select(*ROW_KEY, "b", "a"), "lone-keys")
    return _as_updates(named, b_places, a_places), lone


def _gathered_updates(before: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same rows as ``_crowded_updates``, for keys of so few rows that those of both sides meet in one task.

    The rows are shuffled once, by their key; all that follows stays in the task.
    """
    layout = pairs.where("comparable").select(*TABLE_KEY, "nb", "na", "common")
    b_rows, b_places = _numbered(before)
    a_rows, a_places = _numbered(after)

    def cells(rows: DataFrame, side: str) -> DataFrame:
        entry = f"transform(common, c -> struct(c.name as column_name, {_cell('cells', 'c.' + side)} as value)) as entries"
        return rows.join(layout, TABLE_KEY).selectExpr(*ROW_KEY, entry, *_counts(side, b_places, a_places))

    values = _counted(
        cells(b_rows, "b").unionAll(cells(a_rows, "a")).repartition(*ROW_KEY)
        .select(*ROW_KEY, F.explode("entries").alias("cell"), *COUNTS)
        .select(*ROW_KEY, "cell.*", *COUNTS),
        CELL_KEY,
    )
    of_class, of_cell = f"(partition by {', '.join(CELL_KEY)}, class)", f"(partition by {', '.join(CELL_KEY)})"
    met = (
        values.selectExpr(
            "*", f"sum(n_b) over {of_class} as alike_b", f"sum(n_a) over {of_class} as alike_a", f"max(place_b) over {of_class} as class_place",
            f"sum(n_b) over {of_cell} as total_b", f"sum(n_a) over {of_cell} as total_a", f"max(place_b) over {of_cell} as last",
        )
        .selectExpr("*", f"max(if(class_place = last, class, null)) over {of_cell} as last_class")
        .selectExpr("*", f"max(if(class <> last_class, class_place, null)) over {of_cell} as second")
    )
    lines = _listed_apart(met, CELL_KEY, "if(last_class = class, second, last)", b_places, a_places)
    return _as_updates(lines.join(layout, TABLE_KEY), b_places, a_places)


def _structural(pairs: DataFrame) -> DataFrame:
    line = f"cast(struct('' as part, 0 as block, nth as line) as {POSITION.simpleString()})"
    return structural_changes(pairs).selectExpr(
        *LOG_COLUMNS, f"{_sequence(NO_POSITION, line)} as seq", "1L as copies"
    )


def _named(pairs: DataFrame, condition: str) -> Column | None:
    """Filter for the tables that need a branch, or null if none does.

    A short list is spelled out, so that the scans of all other tables are pruned from the
    branch; a long one is left to the join with the layout.
    """
    found = pairs.where(condition).select(*TABLE_KEY).take(SPELLED_TABLES + 1)
    if not found:
        return None
    if len(found) > SPELLED_TABLES:
        return F.lit(True)
    return reduce(
        Column.__or__,
        ((F.col("change_request_id") == cr) & (F.col("table_name") == table) for cr, table in found),
    )


def diff_tables(before: TableSet, after: TableSet, renames: DataFrame) -> Diff:
    """Compare all tables of two sets, each change request with its own pair of snapshots.

    Two short lists of tables and one flag, read from written tables, decide which branches
    the plan needs.
    """
    pairs = write_once(pair_tables(before.meta, after.meta, renames), "pairs")
    b, a = _side(before, after, pairs, "b"), _side(before, after, pairs, "a")
    changed = write_once(changed_keys(b.hashes, a.hashes), "changed-keys")
    new_tables = _named(pairs, f"kind = '{AFTER_ONLY}'")
    fresh = _named(pairs, "comparable and size(fresh) > 0")
    kinds = (ALONE, FEW, MANY) = ("not crowded", "crowded and not vast", "crowded and vast")
    sizes = dict(zip(kinds, changed.select(*(F.count_if(F.expr(kind)) for kind in kinds)).first()))
    few, many = sizes[FEW], sizes[MANY]
    bitmaps = {}
    # a bitmap for each kind of keys, so that no branch shuffles the rows of another
    if sum(sizes.values()) > LISTED_KEYS:
        for kind, n_keys in sizes.items():
            bits = bitmap_bits(n_keys)
            bitmaps[kind] = write_once(key_bitmap(changed.where(kind), bits), "changed-bits"), bits

    def keep(side: Side, kind: str) -> DataFrame:
        rows = side.rows(lambda rows: maybe_listed(rows, *bitmaps[kind])) if bitmaps else side.all_rows()
        return rows.join(changed.where(kind).select("key_hash"), "key_hash").select(*ROW_KEY, "pos", "cells")

    parts = [_structural(pairs), _row_changes(keep(b, ALONE), keep(a, ALONE), pairs)]
    if new_tables is not None:
        parts.append(_new_tables(after.rows.where(new_tables), pairs))
    if fresh is not None:
        parts.append(_fresh_fills(b.all_rows().where(fresh), a.all_rows().where(fresh), pairs))
    if few:
        # several branches read these rows
        b_few, a_few = (write_once(keep(side, FEW), "crowded-rows") for side in (b, a))
        parts.extend(_crowded_rows(b_few, a_few, pairs, write_once(_lone_keys(b_few, a_few), "lone-keys")))
        parts.append(_gathered_updates(b_few, a_few, pairs))
    if many:
        # read once, and once more only where a key is added or deleted: not worth writing
        b_many, a_many = (keep(side, MANY) for side in (b, a))
        updates, lone = _crowded_updates(b_many, a_many, b.all_rows(), a.all_rows(), pairs)
        parts.extend([updates, *_crowded_rows(b_many, a_many, pairs, lone)])
    errors = pairs.where("comparable and size(lost_keys) > 0").selectExpr(
        *TABLE_KEY, "concat('Undeclared rename of key column: ', array_join(lost_keys, ', ')) as message"
    )
    return Diff(pairs, reduce(DataFrame.unionByName, parts), before_only_warnings(pairs), errors)
