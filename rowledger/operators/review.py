"""Review grids: the changed rows of every touched table, old and new values side by side.

Only changed keys are kept. A grid row carries its displayed cells as an array in the order
of the table's review columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.functions.cells import bind, key_text
from rowledger.model import TABLE_KEY, TableSet
from rowledger.operators.diff import LISTED_KEYS, bitmap_bits, key_bitmap, maybe_listed
from rowledger.operators.pairs import BEFORE_ONLY
from rowledger.storage import write_once

ROW = ["table_name", "key_tuple"]
CELL = [*ROW, "column_name"]
# Rows are sorted by a number first, because texts that begin alike are slow to compare.
HASHED_ROW = ["row_hash", *ROW]
ROW_HASH = f"hash({', '.join(ROW)}) as row_hash"
# Size that chooses a plan: requests whose snapshots get a column each while rows are brought together.
SPREAD_STEPS = 16
ROW_TYPES = ("row_add", "row_delete", "value_update")
STRUCTURAL_TYPES = ("column_add", "column_delete", "column_rename", "key_count_change", "table_add")


@dataclass(frozen=True)
class Review:
    columns: DataFrame
    notes: DataFrame
    grid: DataFrame


def changed_keys(log: DataFrame) -> DataFrame:
    """Distinct non-empty keys with row or value changes."""
    return log.where(F.col("change_type").isin(*ROW_TYPES) & (F.col("key_tuple") != "")).select(*ROW).distinct()


def review_columns(pairs: DataFrame, log: DataFrame, steps: DataFrame) -> DataFrame:
    """Columns of each touched table: first seen over the requests, then those only named in the log."""
    touched = pairs.where(f"kind <> '{BEFORE_ONLY}'").join(steps, ["change_request_id"])
    shown = touched.groupBy("table_name").agg(
        F.expr("array_distinct(flatten(array_sort(collect_list(struct(step, a_columns))).a_columns)) as seen"),
        F.expr("count(distinct change_request_id) > 1 as multi_cr"),
    )
    named = (
        log.where(F.col("change_type").isin(*ROW_TYPES, "column_add"))
        .where("column_name <> '' and column_name not like '%->%'")
        .join(steps, ["change_request_id"])
        .groupBy("table_name", "column_name").agg(F.expr("min(struct(step, change_type, key_tuple, seq)) as first"))
        .groupBy("table_name").agg(F.expr("array_sort(collect_list(struct(first, column_name))).column_name as named"))
    )
    none = "cast(array() as array<string>)"
    return shown.join(named, ["table_name"], "left").selectExpr(
        "table_name", f"array_union(seen, coalesce(named, {none})) as columns", "multi_cr"
    )


def review_notes(log: DataFrame, steps: DataFrame) -> DataFrame:
    """Distinct texts of the structural changes, with their first place."""
    note = (
        "concat('[', change_request_id, '] ', change_type, ' - ', case change_type"
        " when 'table_add' then if(notes = '', 'Table only present in after/', notes)"
        " when 'key_count_change' then concat(old_value, ' -> ', new_value, if(notes = '', '', concat(' (', notes, ')')))"
        " when 'column_rename' then concat(old_value, ' -> ', new_value)"
        " else column_name end)"
    )
    return (
        log.where(F.col("change_type").isin(*STRUCTURAL_TYPES)).join(steps, ["change_request_id"])
        .selectExpr("table_name", f"{note} as note", "struct(step, seq) as place")
        .groupBy("table_name", "note").agg(F.expr("min(place) as place"))
    )


def _seeds(before: TableSet, after: TableSet, pairs: DataFrame, steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per key, the rows that the snapshots have of it: (rank, step, cells), new snapshots with rank 1, old ones with 0.

    Of repeated keys the last row counts. Rows of other keys are left out before the shuffle, save a few.
    """
    n_wanted = wanted.count()
    wanted = wanted.selectExpr(f"xxhash64({', '.join(ROW)}) as key_hash")
    if n_wanted > LISTED_KEYS:
        bits = bitmap_bits(n_wanted)
        bitmap = write_once(key_bitmap(wanted, bits), "review-bits")

    def picked(rows: DataFrame) -> DataFrame:
        if n_wanted > LISTED_KEYS:
            return maybe_listed(rows, bitmap, bits)
        return rows.join(wanted, "key_hash", "left_semi")

    def side(tables: TableSet, rank: int) -> DataFrame:
        keys = tables.meta.join(
            pairs.where(f"kind <> '{BEFORE_ONLY}'").select(*TABLE_KEY), TABLE_KEY, "left_semi"
        ).join(steps.select("change_request_id", "step"), ["change_request_id"])
        if tables.frames:
            # keys are looked at before cells are made
            rows = reduce(DataFrame.unionAll, [f.as_rows(picked(f.keyed(f.key_places, ROW))) for f in tables.frames])
            rows = rows.join(keys.select(*TABLE_KEY, "step"), TABLE_KEY)
        else:
            places = "transform(slice(columns, 1, greatest(n_keys - 1, 0)), (_c, i) -> i) as places"
            rows = picked(tables.rows.join(keys.selectExpr(*TABLE_KEY, "step", places), TABLE_KEY).selectExpr(
                "table_name", f"{key_text('cells', 'places')} as key_tuple", "step", "pos", "cells"
            ).withColumn("key_hash", F.xxhash64(*ROW)))
        return rows.selectExpr(ROW_HASH, *ROW, f"{rank} as rank", "step", "pos", "cells")

    rows = side(after, 1).unionAll(side(before, 0))
    taken = [r.step for r in steps.select("step").distinct().sort("step").limit(SPREAD_STEPS + 1).collect()]
    if len(taken) <= SPREAD_STEPS:
        # a column per request brings the rows of a key together at once; of old rows only the first request's may be shown
        new = [f"max_by(cells, pos) filter (where rank = 1 and step = {n}) as new_{n}" for n in taken]
        old = "max_by(struct(step, cells), struct(-step, pos)) filter (where rank = 0) as old"
        seeds = ["struct(0 as rank, old.step as step, old.cells as cells)", *(f"struct(1 as rank, {n} as step, new_{n} as cells)" for n in taken)]
        return rows.groupBy(*HASHED_ROW).agg(F.expr(old), *map(F.expr, new)).selectExpr(
            *HASHED_ROW, f"filter(array({', '.join(seeds)}), s -> s.cells is not null) as seeds"
        )
    last = rows.groupBy(*HASHED_ROW, "rank", "step").agg(F.expr("max_by(cells, pos) as cells"))
    return last.groupBy(*HASHED_ROW).agg(F.expr("array_sort(collect_list(struct(rank, step, cells))) as seeds"))


def _layouts(before: TableSet, after: TableSet, steps: DataFrame, columns: DataFrame) -> DataFrame:
    """Per table, where each review column stands in each snapshot: (rank, step, places), -1 for none."""
    sides = [t.meta.selectExpr(*TABLE_KEY, f"{rank} as rank", "columns as own") for t, rank in ((after, 1), (before, 0))]
    return (
        sides[0].unionByName(sides[1]).join(steps.select("change_request_id", "step"), ["change_request_id"])
        .join(columns.select("table_name", "columns"), ["table_name"])
        .selectExpr("table_name", "rank", "step",
                    "transform(columns, c -> cast(array_position(own, c) - 1 as int)) as places")
        .groupBy("table_name").agg(F.expr("collect_list(struct(rank, step, places)) as layouts"))
    )


def _changes(log: DataFrame) -> DataFrame:
    """Per key its status and, by column and request, its update and its last added or deleted value.

    A unique key has one update per cell and request, and these are listed. A repeated key may
    have any number: it shows how many, and the change log lists them. Keys that repeat are
    counted apart by cell and request first; what is then brought together by key is short.
    """
    update = "filter (where change_type = 'value_update' and column_name <> '')"
    rows = "filter (where change_type in ('row_add', 'row_delete'))"
    change = "concat(coalesce(old_value, ''), ' -> ', coalesce(new_value, ''))"
    value = "if(change_type = 'row_delete', old_value, new_value)"
    kind = "if(change_type = 'row_delete', 1, 0)"
    hashed = log.where("key_tuple <> ''").selectExpr("*", ROW_HASH)
    per_request = hashed.groupBy("row_hash", *CELL, "step", "change_request_id").agg(
        F.expr(f"count(*) {update} as n"), F.expr(f"sum(copies) {update} as copies"),
        F.expr(f"min({change}) {update} as change"),
        F.expr(f"max_by(struct(step, {kind} as kind, seq, {value} as value), struct({kind} as kind, seq)) {rows} as last"),
        F.expr("bool_or(change_type = 'row_delete') as deleted"), F.expr("bool_or(change_type = 'row_add') as added"),
        F.expr(f"bool_or(change_type in {ROW_TYPES}) as touched"),
    )
    cell = "struct(column_name, step, change, change_request_id, n, copies, last) as cell"
    return per_request.selectExpr("row_hash", *ROW, cell, "deleted", "added", "touched").repartition(*HASHED_ROW).groupBy(*HASHED_ROW).agg(
        F.expr("case when bool_or(deleted) then 'DELETE' when bool_or(added) then 'ADD' else '' end as status"),
        F.expr("array_sort(collect_list(cell)) as changes"), F.expr("bool_or(touched) as touched"),
    ).where("touched")


def display_cell() -> str:
    """``old -> new`` per update, tagged with the request where several touch the table; else the last added or
    deleted value, else ``seed``. ``es`` are the cell's changes by request, in order."""
    one = "if(multi_cr, concat(u.change, ' [', u.change_request_id, ']'), u.change)"
    return (
        "case when size(es) = 0 then seed"
        " when exists(es, e -> e.n > 1) then concat(aggregate(es, 0L, (n, e) -> n + coalesce(e.copies, 0L)), ' updates, see change log')"
        f" when exists(es, e -> e.n > 0) then array_join(transform(filter(es, e -> e.n > 0), u -> {one}), ' | ')"
        " when exists(es, e -> e.last is not null) then"
        " coalesce(try_element_at(filter(es, e -> e.last is not null), -1).last.value, '') else seed end"
    )


def build_review(before: TableSet, after: TableSet, pairs: DataFrame, log: DataFrame, steps: DataFrame) -> Review:
    """Columns, structural notes and grid rows of every touched table.

    New snapshots win over old ones and later requests over earlier ones. Old snapshots count only for keys
    that no new one has, and only the first. Rows stay arrays: no cell is a row of its own but those of the log.
    """
    columns = write_once(review_columns(pairs, log, steps), "review-columns")
    wanted = write_once(changed_keys(log), "review-keys")
    changes = _changes(log.join(steps.select("change_request_id", "step"), ["change_request_id"]))
    layouts = write_once(_layouts(before, after, steps, columns), "review-layouts")
    used = "if(exists(seeds, s -> s.rank = 1), filter(seeds, s -> s.rank = 1), slice(seeds, 1, 1))"
    places = "get(filter(layouts, l -> l.rank = s.rank and l.step = s.step), 0).places"
    # an absent row of a known column is empty text; a column that a snapshot lacks is null, and an earlier one decides
    laid = f"reverse(transform({used}, s -> struct({places} as places, s.cells as cells)))"
    held = "transform(filter(laid, s -> get(s.places, i) >= 0), s -> coalesce(get(s.cells, get(s.places, i)), ''))"
    shown = bind("filter(changes, e -> e.column_name = c)", "es", display_cell().replace("seed", f"coalesce(get({held}, 0), '')"))
    grid = (
        changes.join(_seeds(before, after, pairs, steps, wanted), HASHED_ROW, "left")
        .join(columns, ["table_name"]).join(layouts, ["table_name"], "left")
        .selectExpr("*", f"{laid} as laid")
        .selectExpr(
            *ROW, "status", "case status when 'ADD' then 0 when 'DELETE' then 2 else 1 end as status_rank",
            f"transform(columns, (c, i) -> {shown}) as cells",
        )
    )
    return Review(columns, review_notes(log, steps), grid)
