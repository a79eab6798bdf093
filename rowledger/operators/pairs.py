"""Table pairing, rename alignment and the structural part of a comparison.

Works on ``meta`` frames alone: one row per table, columns as arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.functions.cells import literal
from rowledger.model import LOG_COLUMNS, TABLE_KEY

BOTH, AFTER_ONLY, BEFORE_ONLY = "both", "after_only", "before_only"
NO_NAMES = "cast(array() as array<string>)"


def rename_maps(renames: DataFrame) -> DataFrame:
    """Declared renames per table as a map; a repeated old name keeps its last target."""
    return (
        renames.groupBy(*TABLE_KEY, "old_column_name")
        .agg(F.expr("min(sheet_pos) as first"), F.expr("max_by(new_column_name, sheet_pos) as new_column_name"))
        .groupBy(*TABLE_KEY)
        .agg(F.expr("array_sort(collect_list(struct(first, old_column_name, new_column_name))) as declared"))
        .selectExpr(
            *TABLE_KEY, "declared", "map_from_arrays(declared.old_column_name, declared.new_column_name) as renames"
        )
    )


def aligned(columns: str, renames: str) -> str:
    """Column names as they read after the declared renames."""
    return f"transform({columns}, c -> coalesce(try_element_at({renames}, c), c))"


def _place(names: str, c: str) -> str:
    return f"cast(array_position({names}, {c}) - 1 as int)"


def pair_tables(before_meta: DataFrame, after_meta: DataFrame, renames: DataFrame) -> DataFrame:
    """One row per table of either side, with everything the row comparison needs to know.

    ``a_key``/``b_key`` are cell positions of the matching key; ``common``, ``kept``, ``fresh``
    list columns with their positions on either side.
    """
    before = before_meta.selectExpr(*TABLE_KEY, "n_keys as nb", "columns as b_columns")
    after = after_meta.selectExpr(*TABLE_KEY, "n_keys as na", "columns as a_columns")
    own_keys = "slice(a_columns, 1, greatest(na - 1, 0))"
    paired = (
        before.join(after, TABLE_KEY, "full_outer")
        .join(rename_maps(renames), TABLE_KEY, "left")
        .selectExpr(
            "*",
            f"case when na is null then '{BEFORE_ONLY}' when nb is null then '{AFTER_ONLY}' else '{BOTH}' end as kind",
            f"if(renames is null, b_columns, {aligned('b_columns', 'renames')}) as mapped",
        )
        .selectExpr(
            "*",
            f"if(kind = '{AFTER_ONLY}' or nb = na, {own_keys},"
            f" filter({own_keys}, c -> array_contains(mapped, c))) as key_names",
        )
    )
    return paired.selectExpr(
        *TABLE_KEY, "kind", "nb", "na", "b_columns", "a_columns", "mapped", "declared", "renames", "key_names",
        f"kind = '{BOTH}' and (nb = na or size(key_names) > 0) as comparable",
        f"filter(key_names, c -> kind = '{BOTH}' and not array_contains(mapped, c)) as lost_keys",
        f"transform(key_names, c -> {_place('mapped', 'c')}) as b_key",
        f"transform(key_names, c -> {_place('a_columns', 'c')}) as a_key",
        "transform(filter(a_columns, c -> array_contains(mapped, c) and not array_contains(key_names, c)),"
        f" c -> struct(c as name, {_place('mapped', 'c')} as b, {_place('a_columns', 'c')} as a)) as common",
        "transform(filter(mapped, c -> array_contains(a_columns, c)),"
        f" c -> struct(c as name, {_place('mapped', 'c')} as b)) as kept",
        "transform(filter(a_columns, c -> not array_contains(mapped, c)),"
        f" c -> struct(c as name, {_place('a_columns', 'c')} as a)) as fresh",
    )


def added_columns() -> str:
    """New columns by name; targets of declared renames are not additions."""
    targets = f"coalesce(map_values(renames), {NO_NAMES})"
    return f"array_sort(filter(array_except(a_columns, mapped), c -> not array_contains({targets}, c)))"


def deleted_columns() -> str:
    """Old columns that are neither renamed nor present afterwards, by name."""
    sources = f"coalesce(map_keys(renames), {NO_NAMES})"
    return f"array_sort(array_except(array_except(b_columns, {sources}), a_columns))"


def structural_changes(pairs: DataFrame) -> DataFrame:
    """Log rows that concern whole tables: added tables, key counts, columns."""

    def change(kind: str, column: str = "''", old: str = "''", new: str = "''", notes: str = "") -> str:
        return (
            f"struct('{kind}' as change_type, {column} as column_name, {old} as old_value,"
            f" {new} as new_value, {literal(notes)} as notes)"
        )

    key_count = change(
        "key_count_change", old="cast(nb as string)", new="cast(na as string)", notes="Structural key-count change"
    )
    rename = change(
        "column_rename", "concat(r.old_column_name, '->', r.new_column_name)", "r.old_column_name",
        "r.new_column_name", "Declared in ColumnRenames",
    )
    none = f"filter(array({change('table_add')}), c -> false)"
    of_pairs = (
        f"concat(if(nb <> na, array({key_count}), {none}),"
        f" if(declared is null, {none}, transform(declared, r -> {rename})),"
        f" transform({added_columns()}, c -> {change('column_add', 'c')}),"
        f" transform({deleted_columns()}, c -> {change('column_delete', 'c')}))"
    )
    table_add = f"array({change('table_add', notes='Table only present in after/')})"
    return (
        pairs.where(f"kind <> '{BEFORE_ONLY}'")
        .selectExpr(
            *TABLE_KEY, "nb as n_keys_before", "na as n_keys_after", "'' as key_tuple",
            f"posexplode(if(kind = '{AFTER_ONLY}', {table_add}, {of_pairs})) as (nth, change)",
        )
        .select(*TABLE_KEY, "n_keys_before", "n_keys_after", "key_tuple", "change.*", "nth")
        .select(*LOG_COLUMNS, "nth")
    )


def before_only_warnings(pairs: DataFrame) -> DataFrame:
    """Tables that vanished are reported and otherwise left alone."""
    text = "[%s] Table '%s' exists only in before/ — skipped (no automatic deletes)."
    return pairs.where(f"kind = '{BEFORE_ONLY}'").selectExpr(
        *TABLE_KEY, f"format_string({literal(text)}, change_request_id, table_name) as message"
    )
