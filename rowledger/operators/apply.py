"""Apply an approved change log to a production set.

All requests of an era (see ``evolve``) are applied in one pass over production: the log is
reduced to at most one record per key, the *edits*, and joined once. A row made at step *a*
(production rows: step 0) is dropped by a delete, and changed by an update, of a later step.
That is the order inside a step too: deletes, then updates, then added rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.functions.cells import cells_at, key_text, literal, text
from rowledger.model import POSITION, TableSet
from rowledger.operators.evolve import evolution
from rowledger.storage import write_once

ROW = ["table_name", "key_tuple"]
# Sorts behind every file name, so that added rows follow the existing ones.
AFTER_FILES = "\U0010ffff"


SLOT = "get(name_slots, cast(array_position(names, column_name) - 1 as int)) as slot"


def row_edits(log: DataFrame, steps: DataFrame) -> DataFrame:
    """Per era and key: last update of each cell, and the last step that deletes the key."""
    layout = steps.where("not adds_table and step > reset_step").select(
        "table_name", "step", "era", "names", "name_slots"
    )
    kept = log.where(F.col("change_type").isin("value_update", "row_delete")).join(layout, ["table_name", "step"])
    updates = (
        kept.where("change_type = 'value_update' and column_name <> '' and new_value is not null")
        .selectExpr("era", *ROW, "step", "seq", "new_value", SLOT)
        .groupBy("era", *ROW, "slot")
        .agg(F.expr("max_by(struct(step, new_value as value), struct(step, seq)) as edit"))
    )
    deletes = kept.where("change_type = 'row_delete'").groupBy("era", *ROW).agg(
        F.expr("-1 as slot"), F.expr("struct(max(step) as step, '' as value) as edit")
    )
    return updates.unionByName(deletes).groupBy("era", *ROW).agg(
        F.expr("map_from_entries(collect_list(struct(slot, edit)) filter (where slot >= 0)) as updates"),
        F.expr("max(edit.step) filter (where slot < 0) as delete_step"),
    )


def added_rows(log: DataFrame, steps: DataFrame) -> DataFrame:
    """Added rows as records: key parts fill the key columns, given cells override them."""
    layout = steps.where("step >= reset_step")
    records = (
        log.where("change_type = 'row_add' and column_name <> ''")
        .groupBy(*ROW, "step", "column_name").agg(F.expr("max_by(new_value, seq) as value"))
        .join(layout.select("table_name", "step", "names", "name_slots"), ["table_name", "step"])
        .selectExpr(*ROW, "step", SLOT, "value")
        .groupBy(*ROW, "step").agg(F.expr("map_from_entries(collect_list(struct(slot, value))) as given"))
    )
    parts = "if(key_tuple = '' or adds_table, cast(array() as array<string>), split(key_tuple, '[|]', -1))"
    filled = "if(size(parts) = size(final_key_slots), final_key_slots, match_slots)"
    part = "if(array_contains(filled, i), get(parts, cast(array_position(filled, i) - 1 as int)), null)"
    place = f"concat({literal(AFTER_FILES)}, lpad(step, 9, '0'), ':', key_tuple)"
    return (
        records.join(layout, ["table_name", "step"])
        .selectExpr("*", f"{parts} as parts")
        .selectExpr("*", f"{filled} as filled")
        .selectExpr(
            "era", "table_name", "step",
            f"cast(struct({place} as part, 0 as block, 0 as line) as {POSITION.simpleString()}) as pos",
            f"transform(sequence(0, n_slots - 1), i -> coalesce(try_element_at(given, i), {part}, '')) as cells",
        )
    )


def _apply_era(rows: DataFrame, edits: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (with ``step``) of tables in this era, joined once with the era's edits."""
    layout = steps.groupBy("table_name").agg(
        F.expr("first(match_slots) as match_slots"), F.expr("first(n_slots) as n_slots")
    )
    joined = (
        rows.join(layout, ["table_name"])
        .selectExpr("*", f"{key_text('cells', 'match_slots')} as key_tuple")
        .join(edits.drop("era"), ROW, "left")
        .where("delete_step is null or delete_step <= step")
    )
    edit = "try_element_at(updates, i)"
    cell = f"if({edit}.step > step, {edit}.value, {text('get(cells, i)')})"
    return joined.selectExpr(
        "table_name", "step", "pos",
        f"if(updates is null, cells, transform(sequence(0, n_slots - 1), i -> {cell})) as cells",
    )


def changed_tables(production: TableSet, log: DataFrame) -> TableSet:
    """The tables that the approved log names, after it; ``log`` carries ``step``.

    Order of rows: existing rows in place, then added rows by step and key.
    """
    final, steps = evolution(production.meta, log)
    edits = write_once(row_edits(log, steps), "edits")
    added = write_once(added_rows(log, steps), "added-rows")
    n_eras = (steps.agg(F.max("era")).first()[0] or 0) + 1

    touched = production.rows.join(final.select("table_name", "reset_step"), ["table_name"])
    rows = touched.where("reset_step = 0").selectExpr("table_name", "0 as step", "pos", "cells")
    for era in range(n_eras):
        steps_now = steps.where(F.col("era") == era)
        rows = rows.unionByName(added.where(F.col("era") == era).drop("era"))
        tables_now = steps_now.select("table_name").distinct()
        resting = rows.join(tables_now, ["table_name"], "left_anti") if era else None
        rows = _apply_era(rows, edits.where(F.col("era") == era), steps_now)
        if resting is not None:
            rows = rows.unionByName(resting)
        if era + 1 < n_eras:
            rows = write_once(rows, "era")

    changed = rows.join(final.select("table_name", "final_slots"), ["table_name"]).selectExpr(
        "'' as change_request_id", "table_name", "pos", f"{cells_at('cells', 'final_slots')} as cells"
    )
    of_old = production.meta.join(final.select("table_name"), ["table_name"], "left_semi")
    kept_around = final.where("reset_step = 0").select("table_name")
    return TableSet(_final_meta(of_old, final), changed, production.dummies.join(kept_around, ["table_name"], "left_semi"))


def with_untouched(production: TableSet, changed: TableSet) -> TableSet:
    """All tables: changed ones, and those of production that the log doesn't name, as they are."""
    names = changed.meta.select("table_name")

    def both(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(names, ["table_name"], "left_anti").select(*new.columns).unionByName(new)

    meta = production.meta.withColumn("change_request_id", F.lit(""))
    return TableSet(both(meta, changed.meta), both(production.rows, changed.rows), both(production.dummies, changed.dummies))


def apply_changes(production: TableSet, log: DataFrame) -> TableSet:
    """The production set after the approved log; tables that it does not name pass through untouched."""
    return with_untouched(production, changed_tables(production, log))


def _final_meta(meta: DataFrame, final: DataFrame) -> DataFrame:
    replaced = final.selectExpr("table_name", "reset_step", "n_keys as new_keys", "columns as new_columns")
    kept = "coalesce(reset_step, 0) = 0"
    return meta.join(replaced, ["table_name"], "full_outer").selectExpr(
        "'' as change_request_id", "table_name", "coalesce(new_keys, n_keys) as n_keys",
        "coalesce(new_columns, columns) as columns", f"if({kept}, coalesce(suffix, '.csv'), '.csv') as suffix",
        f"if({kept}, encoding, null) as encoding", f"if({kept}, source_path, null) as source_path",
    )
