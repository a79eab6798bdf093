"""Registered queries: every operator, run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.functions.cells import bind, cells_differ, key_text, literal, normalize_key_part, value_class, yes
from rowledger.model import LOG_COLUMNS, TABLE_KEY, TableSet, from_dataframe
from rowledger.operators.apply import apply_changes
from rowledger.operators.conflicts import (
    cell_overlaps, detect_conflicts, flat_conflicts, missing_fills, overlap_values, structural_collisions,
)
from rowledger.operators.diff import FRESH_NOTE, diff_tables
from rowledger.operators.pairs import aligned, before_only_warnings, pair_tables, rename_maps, structural_changes
from rowledger.operators.review import build_review, changed_keys, review_columns, review_notes
from rowledger.operators.summary import summarize
from rowledger.operators.validate import (
    approved_log, conflict_messages, log_groups, missing_keys, missing_tables, undeclared_renames,
    unapproved_key_counts, unresolved_conflicts, validate,
)
from rowledger.plans import bindings as B
from rowledger.plans.run import _one_row, audit_record, facts_frame, integrate, report, report_totals
from rowledger.sources.changelog import (
    content_hash, export_log, latest_change_log, parse_conflicts, read_log_csv, write_conflicts, write_log,
)
from rowledger.sources.control import (
    change_requests, column_renames, included_requests, key_count_approvals, key_count_approved, make_control,
)
from rowledger.sources.marker import (
    fit_cells, header_keys, list_tables, render_lines, scan_tables, split_cells, write_tables,
)
from rowledger.storage import new_path, write_once

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def query_as(name: str) -> Callable[[Query], Query]:
    """Register under a name that the module also uses for an operator."""

    def register(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return B.read(spark, sf_dir, name)


def logged(df: DataFrame) -> DataFrame:
    return df.select(*LOG_COLUMNS)


# --- comparison -----------------------------------------------------------------------------


def _orders_diff(spark, sf_dir, kind, fills=False):
    log = B.diff(spark, sf_dir, "orders").log.where(F.col("change_type") == kind)
    if kind == "value_update":
        log = log.where("notes <> ''" if fills else "notes = ''")
    return logged(log)


@query
def diff_value_update(spark, sf_dir):
    """Flagship: which cells of orders changed, from what to what, per request."""
    return _orders_diff(spark, sf_dir, "value_update")


@query
def diff_row_add(spark, sf_dir):
    return _orders_diff(spark, sf_dir, "row_add")


@query
def diff_row_delete(spark, sf_dir):
    return _orders_diff(spark, sf_dir, "row_delete")


@query
def diff_new_column_fill(spark, sf_dir):
    return _orders_diff(spark, sf_dir, "value_update", fills=True)


@query
def diff_lineitem(spark, sf_dir):
    """All row-level changes of lineitem under its four-column key."""
    return logged(B.diff(spark, sf_dir, "lineitem").log)


@query
def diff_repeated_keys(spark, sf_dir):
    """Lineitem under a two-column key: unique keys are paired, pairs of repeated ones counted."""
    keys = ["l_orderkey", "l_linenumber"]
    before = from_dataframe(B.source(spark, sf_dir, B.LINEITEM), "lineitem", keys, change_request_id="CR_A")
    after = from_dataframe(B.source(spark, sf_dir, B.LINEITEM_A), "lineitem", keys, change_request_id="CR_A")
    log = diff_tables(before, after, B.control(spark).renames).log
    return log.groupBy("change_type", "key_tuple", "column_name", "old_value", "new_value").agg(
        F.sum("copies").alias("copies")
    )


@query
def diff_crowded_keys(spark, sf_dir):
    """Lineitem keyed by return flag: a few keys hold all rows, pairs are counted, not formed."""
    before = from_dataframe(B.source(spark, sf_dir, B.LINEITEM), "lineitem", ["l_returnflag"], change_request_id="CR_A")
    after = from_dataframe(B.source(spark, sf_dir, B.LINEITEM_A), "lineitem", ["l_returnflag"], change_request_id="CR_A")
    log = diff_tables(before, after, B.control(spark).renames).log
    # every text once per side, then counted: a row of the log goes into one aggregation, not three times into one of distinct values
    cell = ["change_type", "key_tuple", "column_name"]
    texts = log.selectExpr(*cell, "stack(2, 'old', old_value, 0L, 'new', new_value, copies) as (side, value, copies)")
    return (
        texts.where("value is not null or copies <> 0").groupBy(*cell, "side", "value").agg(F.sum("copies").alias("copies"))
        .groupBy(*cell).agg(
            F.sum("copies").alias("copies"), F.expr("count_if(side = 'old' and value is not null) as n_old"),
            F.expr("count_if(side = 'new' and value is not null) as n_new"),
        )
    )


@query
def diff_table_add(spark, sf_dir):
    return logged(B.diff(spark, sf_dir, "supplier").log)


@query
def diff_key_count(spark, sf_dir):
    """Orders get a second key column: rows match on the key columns both sides have."""
    before = from_dataframe(B.source(spark, sf_dir, B.ORDERS), "orders", ["o_orderkey"], change_request_id="CR_K")
    after = from_dataframe(
        B.source(spark, sf_dir, B.ORDERS_KEYED), "orders", ["o_orderkey", "o_custkey"], change_request_id="CR_K"
    )
    return logged(diff_tables(before, after, B.control(spark).renames).log)


@query
def full_changelog(spark, sf_dir):
    return logged(B.diff(spark, sf_dir).log)


def key_sets(before: TableSet, after: TableSet) -> DataFrame:
    """Every key of either side once, with the part it belongs to; both sides meet in one aggregation."""
    key = [*TABLE_KEY, "key_tuple"]
    sides = before.keyed_rows().selectExpr(*key, "1 as b", "0 as a").unionAll(after.keyed_rows().selectExpr(*key, "0 as b", "1 as a"))
    found = sides.groupBy(*key).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return found.selectExpr(*key, "case when b = 0 then 'added' when a = 0 then 'deleted' else 'common' end as part")


@query
def key_set_ops(spark, sf_dir):
    """Keys that each request adds to, deletes from and keeps in each table."""
    return key_sets(B.snapshots(spark, sf_dir, B.BEFORE), B.snapshots(spark, sf_dir, B.AFTER))


def _book_pairs(spark, sf_dir):
    before, after, renames = B.books(spark, sf_dir)
    return pair_tables(before, after, renames)


@query
def table_pairing(spark, sf_dir):
    return _book_pairs(spark, sf_dir).select(*TABLE_KEY, "kind", F.col("nb").alias("n_before"), F.col("na").alias("n_after"))


@query
def align_renames(spark, sf_dir):
    before, _, renames = B.books(spark, sf_dir)
    return before.join(rename_maps(renames), TABLE_KEY, "left").selectExpr(
        "table_name", f"array_join(if(renames is null, columns, {aligned('columns', 'renames')}), ',') as columns"
    )


@query
def diff_before_only(spark, sf_dir):
    return before_only_warnings(_book_pairs(spark, sf_dir))


def _structural(spark, sf_dir, kind):
    return logged(structural_changes(_book_pairs(spark, sf_dir)).where(F.col("change_type") == kind))


@query
def diff_column_rename(spark, sf_dir):
    return _structural(spark, sf_dir, "column_rename")


@query
def diff_column_add(spark, sf_dir):
    return _structural(spark, sf_dir, "column_add")


@query
def diff_column_delete(spark, sf_dir):
    return _structural(spark, sf_dir, "column_delete")


# --- cells and keys -------------------------------------------------------------------------


@query
def normalize_key(spark, sf_dir):
    """Key parts in many spellings, made from every order."""
    spellings = (
        "array(concat('00', o_orderkey), concat(o_orderkey, '.0'), concat(o_orderkey, 'e3'), concat('-', o_orderkey),"
        " concat(o_orderkey, '.250'), concat('0.0000', o_orderkey + 1), concat(o_orderkey + 1, 'e18'),"
        " concat(o_orderkey, '_000'), o_orderpriority, '', concat(o_custkey, 'd'))"
    )
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"posexplode({spellings}) as (nth, raw)").selectExpr(
        "o_orderkey", "nth", "raw", f"{normalize_key_part('raw')} as part"
    )


@query
def composite_key(spark, sf_dir):
    cells = "array(concat(l_orderkey, '.0'), concat('0', l_linenumber), cast(l_partkey as string), l_returnflag)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{bind(cells, '_c', key_text('_c', 'sequence(0, 3)'))} as key_tuple"
    )


@query_as("cells_differ")
def cells_differ_pairs(spark, sf_dir):
    """Old and new spellings of every order's customer key compared as cells."""
    spellings = [
        ("cast(o_custkey as string)", "concat(o_custkey, '.0')"),
        ("cast(o_custkey as string)", "cast(o_custkey + 1 as string)"), ("o_orderpriority", "o_orderstatus"),
        ("''", "cast(o_custkey as string)"), ("concat(o_custkey, '.10')", "concat(o_custkey, '.1')"),
        ("concat(o_custkey, 'e1')", "concat(o_custkey, '0')"), ("cast(null as string)", "''"),
    ]
    pairs = "array(" + ", ".join(f"struct({o} as o, {n} as n)" for o, n in spellings) + ")"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"posexplode({pairs}) as (nth, p)").selectExpr(
        "o_orderkey", "nth", f"{cells_differ('p.o', 'p.n')} as differs",
        f"{value_class('p.o')} <> {value_class('p.n')} as class_differs",
    )


@query
def yn_flag(spark, sf_dir):
    word = (
        "case o_orderstatus when 'F' then concat(' ', substr('yY', 1 + cast(o_totalprice > 250000 as int), 1), ' ')"
        " when 'O' then if(o_totalprice > 250000, 'True', 'no') else if(o_totalprice > 250000, '1', o_orderpriority) end"
    )
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{word} as word").selectExpr(
        "o_orderkey", "word", f"{yes('word')} as flag"
    )


# --- control --------------------------------------------------------------------------------


def _requests(spark, sf_dir):
    """A request sheet with one request per customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_name as ` Change_Request_ID `", "if(c_nationkey < 20, cast(c_nationkey as string), 'later') as `ORDER`",
        "if(c_acctbal > 1000, ' yes', 'N') as include", "if(c_mktsegment = 'BUILDING', '1', 'n') as Approved",
        "c_mktsegment as description", "cast(null as string) as notes", "cast(c_custkey as bigint) as sheet_pos",
    )


@query
def control_tables(spark, sf_dir):
    return change_requests(_requests(spark, sf_dir))


@query_as("included_requests")
def included_requests_in_order(spark, sf_dir):
    chosen = included_requests(change_requests(_requests(spark, sf_dir)), require_approved=True)
    return chosen.select("change_request_id", "order", "sheet_pos")


@query
def declared_renames(spark, sf_dir):
    """Rename sheet with a few rows per customer's book: unusable ones, and a repeated old name."""
    rows = (
        "array(struct('balance' as old, concat('b', c_nationkey) as new),"
        " struct(lower(c_mktsegment) as old, if(c_acctbal < 0, ' ', concat('s', c_nationkey)) as new),"
        " struct('balance' as old, if(c_acctbal > 5000, 'latest', '') as new))"
    )
    sheet = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_nationkey", "c_name", f"posexplode({rows}) as (nth, r)"
    ).selectExpr(
        "concat('CR_', c_nationkey) as change_request_id", "concat(' ', c_name) as table_name",
        "r.old as old_column_name", "r.new as new_column_name", "c_custkey * 3L + nth as sheet_pos",
    )
    return rename_maps(column_renames(sheet)).selectExpr(
        *TABLE_KEY, "size(renames) as n_renames", "declared[0].old_column_name as first_old",
        "declared[0].new_column_name as first_new",
    )


@query_as("key_count_approved")
def key_count_approval(spark, sf_dir):
    """Key-count approval of every customer's book: own entry first, else the request's flag."""
    customer = table(spark, sf_dir, "customer")
    approvals = customer.where("c_acctbal > 0").selectExpr(
        "concat('CR_', c_nationkey) as change_request_id", "c_name as table_name",
        "if(c_acctbal > 5000, 'Y', 'N') as approved", "cast(c_custkey as bigint) as sheet_pos",
    )
    requests = table(spark, sf_dir, "nation").where("n_nationkey <> 7").selectExpr(
        "concat('CR_', n_nationkey) as change_request_id", "'1' as `order`", "'Y' as include",
        "if(n_regionkey < 2, 'Y', 'N') as approved", "'' as description", "'' as notes",
        "cast(n_nationkey as bigint) as sheet_pos",
    )
    control = make_control(spark, requests, approvals=approvals)
    groups = customer.selectExpr("concat('CR_', c_nationkey) as change_request_id", "c_name as table_name")
    return key_count_approved(groups, control).select(*TABLE_KEY, "approved")


# --- conflicts and summary ------------------------------------------------------------------


def _conflicts(spark, sf_dir):
    return B.once(
        spark, sf_dir, "bound-conflicts",
        lambda: detect_conflicts(B.change_log(spark, sf_dir), B.steps(spark)).conflicts,
    )


@query
def conflict_cell_overlap(spark, sf_dir):
    return flat_conflicts(cell_overlaps(overlap_values(B.change_log(spark, sf_dir))))


@query
def conflict_missing_fill(spark, sf_dir):
    return flat_conflicts(missing_fills(B.change_log(spark, sf_dir), B.steps(spark)))


@query
def conflict_structural(spark, sf_dir):
    """Books changed by two requests at once."""
    first = structural_changes(_book_pairs(spark, sf_dir))
    before, after, renames = B.books(spark, sf_dir, "CR_2")
    second = structural_changes(pair_tables(before, after, renames))
    return flat_conflicts(structural_collisions(first.unionByName(second)))


@query
def conflicts_flat(spark, sf_dir):
    return flat_conflicts(_conflicts(spark, sf_dir))


@query
def conflict_roundtrip(spark, sf_dir):
    """Conflicts written for people as CSV and read back."""
    path = new_path(spark, "conflict-files")
    write_conflicts(_conflicts(spark, sf_dir), path)
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(f"{path}/conflicts_csv")
    return parse_conflicts(raw).withColumn("change_request_ids", F.array_join("change_request_ids", "+"))


def _summary(spark, sf_dir):
    tables = pair_tables(
        B.snapshots(spark, sf_dir, B.BEFORE).meta, B.snapshots(spark, sf_dir, B.AFTER).meta, B.control(spark).renames
    )
    return summarize(B.change_log(spark, sf_dir), tables, B.steps(spark), _conflicts(spark, sf_dir))


@query
def summary_by_cr(spark, sf_dir):
    return _summary(spark, sf_dir).drop("has_conflict", "status")


@query
def summary_conflict_flag(spark, sf_dir):
    return _summary(spark, sf_dir).select("change_request_id", "has_conflict", "status")


# --- log order and validation ---------------------------------------------------------------


@query
def ordered_log(spark, sf_dir):
    """Approved log with its application order inside request, table and type."""
    approved = approved_log(B.change_log(spark, sf_dir), B.steps(spark))
    return approved.selectExpr(
        "step", "table_name", "change_type", "key_tuple", "column_name",
        "concat_ws('/', lpad(step, 4, '0'), table_name, change_type, key_tuple, column_name) as place",
    )


@query_as("changed_keys")
def changed_key_set(spark, sf_dir):
    return changed_keys(B.change_log(spark, sf_dir))


def _approved(spark, sf_dir):
    return approved_log(B.change_log(spark, sf_dir), B.steps(spark))


@query_as("unresolved_conflicts")
def open_conflicts(spark, sf_dir):
    return conflict_messages(unresolved_conflicts(_conflicts(spark, sf_dir), B.steps(spark)))


@query
def validate_keys(spark, sf_dir):
    production = B.production(spark, sf_dir, whole=False)
    log = _approved(spark, sf_dir)
    return logged(missing_keys(log, log_groups(log, production), production))


def _book_log(spark, sf_dir):
    before, after, renames = B.books(spark, sf_dir)
    log = structural_changes(pair_tables(before, after, renames)).withColumn("step", F.lit(1))
    return log.withColumnRenamed("nth", "seq").withColumn("copies", F.lit(1).cast("long"))


def _book_control(spark, sf_dir):
    """Approvals for nations under 3, declared renames for positive nations only."""
    customer = table(spark, sf_dir, "customer")
    approvals = customer.selectExpr(
        "'CR_1' as change_request_id", "c_name as table_name", "if(c_nationkey < 3, 'Y', 'N') as approved",
        "cast(c_custkey as bigint) as sheet_pos",
    )
    _, _, renames = B.books(spark, sf_dir)
    kept = renames.join(
        customer.where("c_nationkey > 0").select(F.col("c_name").alias("table_name")), "table_name", "left_semi"
    )
    requests = B.control(spark).requests.where("change_request_id = 'CR_A'").selectExpr(
        "'CR_1' as change_request_id", "'1' as `order`", "'Y' as include", "'Y' as approved", "'' as description",
        "'' as notes", "sheet_pos",
    )
    return make_control(spark, requests, kept, approvals)


def _book_production(spark, sf_dir):
    """Books of customers that have a positive nation."""
    books = B.books_set(spark, sf_dir)
    known = table(spark, sf_dir, "customer").where("c_nationkey > 0").select(F.col("c_name").alias("table_name"))
    return books.with_tables(meta=books.meta.join(known, "table_name", "left_semi"))


@query
def validate_tables(spark, sf_dir):
    groups = log_groups(_book_log(spark, sf_dir), _book_production(spark, sf_dir))
    return missing_tables(groups).select(*TABLE_KEY)


@query
def validate_key_count(spark, sf_dir):
    log = _book_log(spark, sf_dir)
    groups = log_groups(log, _book_production(spark, sf_dir))
    return unapproved_key_counts(log, groups, _book_control(spark, sf_dir)).select(*TABLE_KEY, "n_keys_after")


@query
def validate_renames(spark, sf_dir):
    log = _book_log(spark, sf_dir)
    groups = log_groups(log, B.books_set(spark, sf_dir))
    return undeclared_renames(log, groups, _book_control(spark, sf_dir)).select(*TABLE_KEY, "old_value", "new_value")


def _book_rows_log(spark, sf_dir):
    """The structural book log with rows of every dear order: two fills under one key, and rows added anew and again."""
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 300000").join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")
    )
    again, anew = "cast(o_orderkey as string)", "cast(o_orderkey + 10000000 as string)"
    entries = [
        ("row_add", again, "id", again, ""), ("row_add", anew, "id", anew, ""),
        ("value_update", again, "extra", "'x'", FRESH_NOTE), ("value_update", again, "extra", "'y'", FRESH_NOTE),
    ]
    structs = (
        f"struct('{kind}' as change_type, {key} as key_tuple, '{column}' as column_name, {value} as new_value, {literal(note)} as notes)"
        for kind, key, column, value, note in entries
    )
    rows = dear.selectExpr("c_name", f"inline(array({', '.join(structs)}))").selectExpr(
        "'CR_1' as change_request_id", "c_name as table_name", "change_type", "2 as n_keys_before", "2 as n_keys_after", "key_tuple",
        "column_name", "'' as old_value", "new_value", "notes", "1 as step", "1L as copies",
    )
    return _book_log(spark, sf_dir).drop("seq").unionByName(rows)


@query
def validate_messages(spark, sf_dir):
    return validate(_book_rows_log(spark, sf_dir), _book_production(spark, sf_dir), _book_control(spark, sf_dir))


@query
def integration_report(spark, sf_dir):
    """Totals of a failing dry run against production without its dearest orders."""
    outcome = integrate(
        B.change_log(spark, sf_dir), _conflicts(spark, sf_dir), B.production(spark, sf_dir, whole=False),
        B.control(spark), "validate_only",
    )
    return report_totals(report(outcome.messages, outcome.status, "validate_only"), outcome.status, "validate_only")


# --- apply ----------------------------------------------------------------------------------


def _cells_of(applied: TableSet) -> DataFrame:
    """Applied rows as (table, cells) text."""
    return applied.rows.select("table_name", F.array_join("cells", ",").alias("cells"))


def _apply_orders(spark, sf_dir, *kinds):
    log = approved_log(B.orders_log(spark, sf_dir).where(F.col("change_type").isin(*kinds)), B.steps(spark))
    production = B.snapshots(spark, sf_dir, [("", "orders", B.ORDERS, ["o_orderkey"])])
    return apply_changes(production, log)


@query
def apply_update(spark, sf_dir):
    """Last update per cell over both requests."""
    return _cells_of(_apply_orders(spark, sf_dir, "value_update"))


@query
def apply_delete(spark, sf_dir):
    return _cells_of(_apply_orders(spark, sf_dir, "row_delete"))


@query
def apply_row_add(spark, sf_dir):
    return _cells_of(_apply_orders(spark, sf_dir, "row_add"))


@query
def apply_table_add(spark, sf_dir):
    log = approved_log(B.change_log(spark, sf_dir).where("table_name = 'supplier'"), B.steps(spark))
    return _cells_of(apply_changes(B.production(spark, sf_dir), log))


def _apply_books(spark, sf_dir, kind):
    log = _book_log(spark, sf_dir).where(F.col("change_type") == kind)
    known = B.books_set(spark, sf_dir)
    return apply_changes(known, log.join(known.meta.select("table_name"), "table_name", "left_semi"))


def _layouts(applied: TableSet) -> DataFrame:
    return applied.meta.select("table_name", "n_keys", F.array_join("columns", ",").alias("columns"))


@query
def apply_key_count(spark, sf_dir):
    return _layouts(_apply_books(spark, sf_dir, "key_count_change"))


@query
def apply_rename(spark, sf_dir):
    return _layouts(_apply_books(spark, sf_dir, "column_rename"))


@query
def apply_column_add(spark, sf_dir):
    """Rows of all books after their new columns are added."""
    return _cells_of(_apply_books(spark, sf_dir, "column_add"))


@query
def apply_column_delete(spark, sf_dir):
    return _cells_of(_apply_books(spark, sf_dir, "column_delete"))


@query
def apply_sequence(spark, sf_dir):
    """Orders after request CR_A and then CR_B."""
    log = approved_log(B.orders_log(spark, sf_dir), B.steps(spark))
    production = B.snapshots(spark, sf_dir, [("", "orders", B.ORDERS, ["o_orderkey"])])
    return _cells_of(apply_changes(production, log))


@query
def apply_all_tables(spark, sf_dir):
    """Every production table after the whole log, rendered as lines and counted."""
    applied = apply_changes(B.production(spark, sf_dir), _approved(spark, sf_dir))
    lines = render_lines(applied)
    return lines.groupBy("table_name", "section").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"), F.max("value").alias("greatest_line")
    )


# --- review ---------------------------------------------------------------------------------


def _review(spark, sf_dir):
    before, after = B.snapshots(spark, sf_dir, B.BEFORE), B.snapshots(spark, sf_dir, B.AFTER)
    pairs = B.once(spark, sf_dir, "bound-pairs", lambda: pair_tables(before.meta, after.meta, B.control(spark).renames))
    return build_review(before, after, pairs, B.change_log(spark, sf_dir), B.steps(spark))


@query
def review_grid(spark, sf_dir):
    grid = _review(spark, sf_dir).grid
    return grid.select("table_name", "key_tuple", "status", F.array_join("cells", ";").alias("cells"))


@query
def review_display(spark, sf_dir):
    """Cells that show updates."""
    review = _review(spark, sf_dir)
    cells = review.grid.join(review.columns.select("table_name", "columns"), "table_name")
    return cells.selectExpr("table_name", "key_tuple", "inline(arrays_zip(columns, cells))").selectExpr(
        "table_name", "key_tuple", "columns as column_name", "cells as shown"
    ).where("shown like '% -> %'")


@query
def review_order(spark, sf_dir):
    return _review(spark, sf_dir).grid.select("table_name", "status_rank", "key_tuple")


@query_as("review_columns")
def review_column_order(spark, sf_dir):
    """Columns of every book: first seen, then those only the log names."""
    before, after, renames = B.books(spark, sf_dir)
    steps = B.steps(spark).where("step = 1").withColumn("change_request_id", F.lit("CR_1"))
    found = review_columns(pair_tables(before, after, renames), _book_log(spark, sf_dir).drop("step"), steps)
    return found.select("table_name", F.array_join("columns", ",").alias("columns"), "multi_cr")


@query_as("review_notes")
def review_structural_notes(spark, sf_dir):
    steps = B.steps(spark).where("step = 1").withColumn("change_request_id", F.lit("CR_1"))
    return review_notes(_book_log(spark, sf_dir).drop("step"), steps).select("table_name", "note")


# --- files ----------------------------------------------------------------------------------


def _orders_set(spark, sf_dir) -> TableSet:
    return B.snapshots(spark, sf_dir, [("", "sub/orders", B.ORDERS, ["o_orderkey"]),
                                       ("", "customer", B.CUSTOMER, ["c_custkey"])])


@query_as("render_lines")
def render_order_lines(spark, sf_dir):
    return render_lines(_orders_set(spark, sf_dir)).select("table_name", "section", "value")


@query
def scan_marker_block(spark, sf_dir):
    """Orders and customers written as marker files and read back."""
    path = new_path(spark, "marker-files")
    write_tables(_orders_set(spark, sf_dir), path)
    return _cells_of(scan_tables(spark, path).tables)


def _raw_lines(spark, sf_dir):
    """Untidy data lines made from every order: blanks, missing and surplus cells."""
    line = (
        "concat('* , ', o_orderkey, '\t,', o_orderstatus, case o_orderstatus when 'F' then ''"
        " when 'O' then concat(', ', o_orderpriority, ' ') else concat(',', o_orderpriority, ',x,y') end)"
    )
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{line} as line")


@query_as("split_cells")
def split_line_cells(spark, sf_dir):
    return _raw_lines(spark, sf_dir).selectExpr("o_orderkey", f"posexplode({split_cells('line')}) as (nth, cell)")


@query
def pad_trim_cells(spark, sf_dir):
    return _raw_lines(spark, sf_dir).selectExpr("o_orderkey", f"{split_cells('line')} as cells").selectExpr(
        "o_orderkey", f"array_join({fit_cells('slice(cells, 2, size(cells))', '3')}, '|') as cells"
    )


@query
def parse_key_count(spark, sf_dir):
    """Header markers made from every customer."""
    marker = "if(c_acctbal < 0, '!x', concat('!', if(c_nationkey < 9, '0', ''), c_nationkey))"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{marker} as marker").selectExpr(
        "c_custkey", "marker", f"{header_keys('marker')} as n_keys"
    )


def _text_file(df: DataFrame, path: str, name: str) -> str:
    """Lines (``line`` in order ``nth``) as the table file ``name``, in ordered parts."""
    spark = df.sparkSession
    (
        write_once(df.select("nth", "line"), "file-lines").repartitionByRange("nth").sortWithinPartitions("nth")
        .select(F.lit(name).alias("table_file"), F.col("line").alias("value"))
        .write.partitionBy("table_file").mode("append").text(path)
    )
    return path


@query
def dummy_lines(spark, sf_dir):
    """Customers as a file with a block in the middle: lines around it are kept verbatim."""
    lines = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey + 1000000000L * if(c_mktsegment = 'BUILDING', 0, if(c_mktsegment = 'FURNITURE', 3, 2)) as nth",
        "case c_mktsegment when 'BUILDING' then concat('about ', c_name, ',,')"
        " when 'FURNITURE' then concat(if(c_nationkey > 12, '*,', ''), c_name, ' ,') else concat('*,', c_custkey, ',x') end as line",
    )
    end = spark.range(1)
    around = end.selectExpr("1000000000L as nth", "'!2,id,v' as line").unionByName(
        end.selectExpr("2999999999L as nth", "'end of block' as line"))
    path = _text_file(lines.unionByName(around), new_path(spark, "dummy-files"), "customer.fac")
    found = scan_tables(spark, path).tables
    return found.dummies.select("table_name", "section", "value").unionByName(
        found.rows.selectExpr("table_name", "2 as section", "array_join(cells, ',') as value"))


@query
def encoding_fallback(spark, sf_dir):
    """Whole documents as one Latin-1 file and one UTF-8 file, read back to the same text."""
    plain = r"regexp_replace(regexp_replace(text, '[^\\x01-\\x7f\\xa0-\\xff]', '?'), r'[,\n\r\t\x0b\x0c]', ' ')"
    # both files are written from one copy; only blanks are left to be dropped at the ends
    docs = write_once(table(spark, sf_dir, "documents").selectExpr("doc_id", f"trim({plain}) as body"), "clean-documents")
    head = spark.range(1).selectExpr("-1L as nth", "'!2,doc_id,body' as line")
    line = "concat('*,', doc_id, ',', body)"
    path = new_path(spark, "encoded-files")
    for name, raw in (("utf.csv", line), ("latin.csv", f"cast(encode({line}, 'ISO-8859-1') as string)")):
        _text_file(head.unionByName(docs.selectExpr("cast(doc_id as bigint) as nth", f"{raw} as line")), path, name)
    found = scan_tables(spark, path).tables
    return found.rows.join(found.meta.select("table_name", "encoding"), "table_name").selectExpr(
        "table_name", "encoding", "cells[0] as doc_id", "cells[1] as body"
    )


@query
def discover_prefer_fac(spark, sf_dir):
    """One file per supplier as .csv, as .FAC, or as both, of which .FAC wins."""
    path = new_path(spark, "listing")
    supplier = table(spark, sf_dir, "supplier")
    # the number is given, else so few bytes would become one task that writes all files
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for suffix, chosen in ((".csv", "s_nationkey > 5"), (".FAC", "s_nationkey < 15")):
        lines = supplier.where(chosen).selectExpr(
            f"concat('r', s_nationkey, '/', s_name, '{suffix}') as table_file", "'!2,id,name' as value"
        )
        lines.repartition(parts, "table_file").write.partitionBy("table_file").mode("append").text(path)
    return list_tables(spark, path).select("table_name", "suffix")


@query
def changelog_roundtrip(spark, sf_dir):
    """The log as quoted CSV, read back."""
    path = new_path(spark, "log") + ".csv"
    export_log(B.change_log(spark, sf_dir), path)
    return logged(read_log_csv(spark, path))


@query_as("content_hash")
def content_hash_of_log(spark, sf_dir):
    log = B.change_log(spark, sf_dir)
    return content_hash(logged(log))


@query_as("audit_record")
def audit_of_log(spark, sf_dir):
    """The record of a run that writes the log, without its time; what it says of the log is seen while writing."""
    facts = write_log(B.change_log(spark, sf_dir), new_path(spark, "audited"))
    record = audit_record("RUN", "generate_changelog", "SUCCESS", _one_row(spark, change_log=facts_frame(spark, facts)))
    kept = F.from_json(F.get_json_object("facts", "$.facts.change_log"), "array<struct<n_rows:bigint,n_change_rows:bigint,tables_affected:bigint,content_hash:string>>")
    return record.select("run_id", "mode", "final_status", F.inline(kept))


@query
def latest_changelog(spark, sf_dir):
    """Newest run in a listing with one change log per event."""
    runs = table(spark, sf_dir, "events").selectExpr("concat('Output/ChangeLog_', event_id) as path", "ts as modified")
    return latest_change_log(runs)
