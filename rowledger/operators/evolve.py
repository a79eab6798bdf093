"""How the columns and keys of each table evolve over the applied requests.

Only table-level facts are handled here. Each column gets a *slot*: production columns keep
their position, columns that appear later get the next free slots, and a renamed column keeps
its own. Row cells can then be addressed by slot through any number of requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.functions.cells import bind
from rowledger.storage import write_once

NO_IDS = "cast(array() as array<string>)"
STRUCTURAL = ("key_count_change", "column_rename", "column_add", "column_delete")
COLUMN = "struct<name:string,id:string>"
RECORD = (
    f"struct<step:int,adds_table:boolean,columns:array<{COLUMN}>,n_keys:int,"
    "match_ids:array<string>,final_ids:array<string>,updated_ids:array<string>>"
)


def step_facts(log: DataFrame) -> DataFrame:
    """Per table and step: structural changes and the columns its rows mention, in log order."""
    order = "struct(key_tuple, column_name, seq)"
    per_column = log.groupBy("table_name", "step", "change_type", "column_name").agg(
        F.expr(f"min({order}) as first"),
        F.expr(f"min(struct({order} as place, n_keys_after as n)) filter (where n_keys_after is not null) as keys"),
    )

    def columns_of(kind: str) -> str:
        chosen = f"filter (where change_type = '{kind}' and column_name <> '')"
        return f"array_sort(collect_list(struct(first, column_name)) {chosen}).column_name"

    facts = per_column.groupBy("table_name", "step").agg(
        F.expr("bool_or(change_type = 'table_add') as adds_table"),
        F.expr("min(struct(change_type, keys)) filter (where keys is not null) as first_keys"),
        F.expr(f"{columns_of('value_update')} as updated"),
        F.expr(f"{columns_of('row_add')} as inserted"),
    )
    change = f"struct({order} as place, change_type, column_name, old_value, new_value, n_keys_after)"
    structural = (
        log.where(F.col("change_type").isin(*STRUCTURAL)).groupBy("table_name", "step")
        .agg(F.expr(f"array_sort(collect_list({change})) as changes"))
    )
    return facts.join(structural, ["table_name", "step"], "left").selectExpr(
        "table_name", "step", "adds_table", "first_keys.keys.n as new_table_keys", "updated", "inserted",
        "coalesce(changes, array()) as changes",
    )


def _ids(columns: str) -> str:
    return f"transform({columns}, c -> c.id)"


def _names(columns: str) -> str:
    return f"transform({columns}, c -> c.name)"


def _new_column(name: str) -> str:
    return f"struct({name} as name, concat(s.step, ':', {name}) as id)"


def _head(columns: str, n_keys: str) -> str:
    return _ids(f"slice({columns}, 1, greatest({n_keys} - 1, 0))")


def _with_unknown(columns: str, names: str) -> str:
    return f"concat({columns}, transform(array_except({names}, {_names(columns)}), n -> {_new_column('n')}))"


def _apply_structure() -> str:
    """Record after step ``s`` from the ``last`` one.

    Key count, renames, additions, deletions, then unknown columns.
    """
    n_keys = (
        "coalesce(try_element_at(transform(filter(s.changes, c -> c.change_type = 'key_count_change'"
        " and c.n_keys_after is not null), c -> c.n_keys_after), -1), last.n_keys)"
    )
    renamed = (
        f"aggregate(filter(s.changes, c -> c.change_type = 'column_rename'), cast(last.columns as array<{COLUMN}>),"
        " (acc, r) -> transform(acc, c -> struct(if(c.name = r.old_value, r.new_value, c.name) as name, c.id as id)))"
    )
    # a wider key takes its new columns right behind the old key columns
    at = "least(greatest(last.n_keys - 1, 0), size(acc))"
    added = f"array({_new_column('r.column_name')})"
    widened = (
        f"aggregate(filter(s.changes, c -> c.change_type = 'column_add'), {renamed}, (acc, r) -> case"
        f" when r.column_name = '' or array_contains({_names('acc')}, r.column_name) then acc"
        f" when n_keys > last.n_keys then concat(slice(acc, 1, {at}), {added}, slice(acc, {at} + 1, size(acc)))"
        f" else concat(acc, {added}) end)"
    )
    structured = (
        f"filter({widened}, c -> not exists(s.changes,"
        " d -> d.change_type = 'column_delete' and d.column_name = c.name))"
    )
    record = (
        f"struct(s.step as step, false as adds_table, {_with_unknown('updated', 's.inserted')} as columns,"
        f" n_keys as n_keys, {_head('structured', 'last.n_keys')} as match_ids,"
        f" {_head('structured', 'n_keys')} as final_ids,"
        f" {_ids('filter(updated, c -> array_contains(s.updated, c.name))')} as updated_ids)"
    )
    record = bind(_with_unknown("structured", "s.updated"), "updated", record)
    record = bind(structured, "structured", record)
    return bind(n_keys, "n_keys", record)


def _new_table() -> str:
    """Record after step ``s`` that adds, or replaces, the table."""
    columns = f"transform(s.inserted, n -> {_new_column('n')})"
    n_keys = "coalesce(s.new_table_keys, 1)"
    return (
        f"struct(s.step as step, true as adds_table, {columns} as columns, {n_keys} as n_keys,"
        f" {_head(columns, n_keys)} as match_ids, {NO_IDS} as final_ids, {NO_IDS} as updated_ids)"
    )


def evolution(meta: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, steps): final layout of every table, and the layout at each of its steps.

    An *era* is a run of steps that match rows on the same key cells. It ends where the key
    columns change, or where a step updates a cell that the next step uses as key.
    """
    fact = "struct(step, adds_table, new_table_keys, updated, inserted, changes)"
    facts = step_facts(log).groupBy("table_name").agg(F.expr(f"array_sort(collect_list({fact})) as facts"))
    base = meta.selectExpr("table_name", "n_keys as base_keys", "columns as base_columns")
    start = (
        "struct(0 as step, false as adds_table,"
        f" transform(coalesce(base_columns, {NO_IDS}), n -> struct(n as name, concat('0:', n) as id)) as columns,"
        f" coalesce(base_keys, 1) as n_keys, {NO_IDS} as match_ids, {NO_IDS} as final_ids, {NO_IDS} as updated_ids)"
    )
    advance = bind(
        "element_at(acc, -1)", "last",
        f"cast(if(s.adds_table, {_new_table()}, {_apply_structure()}) as {RECORD})",
    )
    history = f"aggregate(facts, array(cast({start} as {RECORD})), (acc, s) -> concat(acc, array({advance})))"
    same_key = "get(history, i).match_ids = get(history, i - 1).match_ids"
    moved = "arrays_overlap(get(history, i - 1).updated_ids, get(history, i).match_ids)"
    eras = (
        "aggregate(sequence(1, size(history) - 1), array(0), (acc, i) -> concat(acc, array("
        f"element_at(acc, -1) + if(i = 1 or ({same_key} and not {moved}), 0, 1))))"
    )
    slots = f"array_distinct(flatten(transform(history, h -> {_ids('h.columns')})))"
    reset = "coalesce(array_max(transform(filter(history, h -> h.adds_table), h -> h.step)), 0)"
    tables = write_once(
        facts.join(base, ["table_name"], "left").selectExpr("table_name", f"{history} as history")
        .selectExpr("table_name", "history", f"{slots} as slots", f"{reset} as reset_step", f"{eras} as eras"),
        "evolution",
    )

    def places(ids: str) -> str:
        return f"transform({ids}, c -> cast(array_position(slots, c) - 1 as int))"

    final = tables.selectExpr(
        "table_name", "reset_step", "slots", "element_at(history, -1) as last"
    ).selectExpr(
        "table_name", "reset_step", "last.n_keys as n_keys", f"{_names('last.columns')} as columns",
        f"{places(_ids('last.columns'))} as final_slots",
    )
    steps = tables.selectExpr(
        "table_name", "slots", "reset_step", "eras", "posexplode(history) as (place, h)"
    ).where("place > 0").selectExpr(
        "table_name", "reset_step", "size(slots) as n_slots", "get(eras, place) as era", "h.step", "h.adds_table",
        f"{_names('h.columns')} as names", f"{places(_ids('h.columns'))} as name_slots",
        f"{places('h.match_ids')} as match_slots", f"{places('h.final_ids')} as final_key_slots",
    )
    return final, steps
