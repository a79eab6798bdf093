"""Checks of a change log against production, as report messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.functions.cells import yes
from rowledger.model import TABLE_KEY, TableSet
from rowledger.operators.diff import FRESH_NOTE
from rowledger.sources.control import Control, key_count_approved
from rowledger.storage import write_once

REPORT_COLUMNS = [
    "section", "change_request_id", "table_name", "change_type", "key_tuple", "column_name", "message", "severity",
]
REPEATED_ROW = "Key exists in production; row_add appends a second row."
SHARED_FILL = "Several rows share this key under the wider key; the last value wins."
KEYED_TYPES = ("value_update", "row_delete")


def message(df: DataFrame, section: str, text: Column, severity: str, **fields: str) -> DataFrame:
    """Report rows; fields not named are empty."""
    values = {"section": F.lit(section), "message": text, "severity": F.lit(severity)}
    values.update({k: F.col(v) for k, v in fields.items()})
    return df.select(*(F.coalesce(values.get(c, F.lit("")), F.lit("")).alias(c) for c in REPORT_COLUMNS))


def quoted(c: Column) -> Column:
    """Text in quotes, the way messages show it."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\")
    with_double = c.contains("'") & ~c.contains('"')
    single = F.concat(F.lit("'"), F.regexp_replace(c, "'", r"\\'"), F.lit("'"))
    return F.when(with_double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(single)


def quoted_list(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(ids, quoted), ", "), F.lit("]"))


def approved_log(log: DataFrame, steps: DataFrame) -> DataFrame:
    """Log rows of approved requests with their step."""
    return log.join(steps.select("change_request_id", "step"), ["change_request_id"])


def log_order(df: DataFrame) -> Column:
    """Application order of log rows, as one comparable value."""
    return F.struct("step", "table_name", "change_type", "key_tuple", "column_name", "seq")


def unresolved_conflicts(conflicts: DataFrame, steps: DataFrame) -> DataFrame:
    """Conflicts not marked resolved that involve an approved request."""
    open_ones = conflicts.where(~F.expr(yes("resolved")))
    involved = (
        open_ones.select("conflict_type", "table_name", "key_tuple", "column_name", "change_request_ids",
                         F.explode("change_request_ids").alias("change_request_id"))
        .join(steps.select("change_request_id"), ["change_request_id"], "left_semi")
        .drop("change_request_id").distinct()
    )
    return involved


def conflict_messages(unresolved: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Unresolved conflict ("), "conflict_type", F.lit(") on table "), "table_name",
        F.lit(" key="), quoted(F.col("key_tuple")), F.lit(" col="), quoted(F.col("column_name")),
        F.lit(" CRs="), quoted_list(F.col("change_request_ids")),
    )
    return message(unresolved, "conflict", text, "FAIL", table_name="table_name")


def log_groups(log: DataFrame, production: TableSet) -> DataFrame:
    """One row per request and table of the log: whether it adds the table, whether it is known."""
    known = production.meta.select("table_name").distinct().withColumn("known", F.lit(True))
    adds = F.max((F.col("change_type") == "table_add").cast("int")) == 1
    return (
        log.groupBy(*TABLE_KEY, "step").agg(adds.alias("adds"))
        .join(known, ["table_name"], "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
    )


def missing_tables(groups: DataFrame) -> DataFrame:
    return groups.where("not adds and not known")


def unapproved_key_counts(log: DataFrame, groups: DataFrame, control: Control) -> DataFrame:
    rows = log.where("change_type = 'key_count_change'").join(groups.where("adds or known"), TABLE_KEY, "left_semi")
    return key_count_approved(rows, control).where("not approved")


def undeclared_renames(log: DataFrame, groups: DataFrame, control: Control) -> DataFrame:
    declared = control.renames.select(
        *TABLE_KEY, F.col("old_column_name").alias("old_value"), F.col("new_column_name").alias("new_value")
    ).distinct()
    return (
        log.where("change_type = 'column_rename'").join(groups.where("adds or known"), TABLE_KEY, "left_semi")
        .join(declared, [*TABLE_KEY, "old_value", "new_value"], "left_anti")
    )


def key_findings(log: DataFrame, groups: DataFrame, production: TableSet) -> tuple[DataFrame, DataFrame]:
    """Updates and deletes whose key production lacks; (request, table, key) of added rows whose key it has.

    The distinct log keys are written first: production is then filtered by them, so it is
    never shuffled whole when they are few. One pass over it serves both.
    """
    keyed = log.where(F.col("change_type").isin(*KEYED_TYPES, "row_add") & (F.col("copies") > 0)).join(
        groups.where("known and not adds"), TABLE_KEY, "left_semi"
    )
    key = ["table_name", "key_tuple"]
    wanted = write_once(keyed.select(*key).distinct(), "log-keys")
    found = write_once(production.keyed_rows().select(*key).join(wanted, key, "left_semi").distinct(), "known-keys")
    absent = wanted.join(found, key, "left_anti")
    missing = keyed.where(F.col("change_type").isin(*KEYED_TYPES)).join(absent, key, "left_semi")
    added = keyed.where("change_type = 'row_add' and key_tuple <> ''").select(*TABLE_KEY, "key_tuple").distinct()
    return missing, added.join(found, key, "left_semi")


def missing_keys(log: DataFrame, groups: DataFrame, production: TableSet) -> DataFrame:
    """Updates and deletes whose key production lacks."""
    return key_findings(log, groups, production)[0]


def shared_fills(log: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells that a request with a wider key fills more than once, because several new rows share the old key."""
    widened = log.where("change_type = 'key_count_change' and n_keys_after > n_keys_before").join(
        groups.where("known and not adds"), TABLE_KEY, "left_semi"
    )
    cell = [*TABLE_KEY, "key_tuple", "column_name"]
    fills = log.where((F.col("change_type") == "value_update") & (F.col("notes") == FRESH_NOTE))
    return (
        fills.join(widened.select(*TABLE_KEY).distinct(), TABLE_KEY, "left_semi")
        .groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1").select(*cell)
    )


def validate(log: DataFrame, production: TableSet, control: Control) -> DataFrame:
    """Messages for the approved log (with ``step``) against the original production set.

    A failure stops the run; a warning (WARN) says what will be applied in a way that may not be meant.
    """
    groups = write_once(log_groups(log, production), "log-groups")
    missing, repeated = key_findings(log, groups, production)
    by_table = {c: c for c in TABLE_KEY}
    fails = [
        message(
            missing_tables(groups), "validation",
            F.format_string("Table '%s' not found in production (and not a table_add).", "table_name"),
            "FAIL", **by_table,
        ),
        message(
            unapproved_key_counts(log, groups, control), "validation",
            F.lit("Key-count change blocked: not approved in Control."), "FAIL",
            change_type="change_type", **by_table,
        ),
        message(
            undeclared_renames(log, groups, control), "validation",
            F.concat(F.lit("Column rename "), quoted(F.col("old_value")), F.lit("->"), quoted(F.col("new_value")),
                     F.lit(" not declared in ColumnRenames.")),
            "FAIL", change_type="change_type", column_name="column_name", **by_table,
        ),
        message(
            missing, "validation",
            F.concat(F.lit("Key not found in production for "), "change_type", F.lit(".")), "FAIL",
            change_type="change_type", key_tuple="key_tuple", column_name="column_name", **by_table,
        ),
    ]
    failed = write_once(reduce(DataFrame.unionAll, fails), "failures")
    passed = groups.where("known and not adds").join(failed.select(*TABLE_KEY).distinct(), TABLE_KEY, "left_anti")
    warnings = [
        message(
            repeated.withColumn("change_type", F.lit("row_add")), "validation", F.lit(REPEATED_ROW), "WARN",
            change_type="change_type", key_tuple="key_tuple", **by_table,
        ),
        message(
            shared_fills(log, groups).withColumn("change_type", F.lit("value_update")), "validation", F.lit(SHARED_FILL), "WARN",
            change_type="change_type", key_tuple="key_tuple", column_name="column_name", **by_table,
        ),
    ]
    passing = message(passed, "validation", F.lit("Validation passed."), "INFO", **by_table)
    return reduce(DataFrame.unionAll, [failed, passing, *warnings])
