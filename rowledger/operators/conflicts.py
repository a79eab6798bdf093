"""Conflicts between change requests, found in the change log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["table_name", "key_tuple", "column_name"]
CELL_TYPES = ("value_update", "row_add", "row_delete")
STRUCTURAL_TYPES = ("key_count_change", "column_add", "column_delete", "column_rename", "table_add")
CONFLICT_COLUMNS = [
    "conflict_type", "table_name", "key_tuple", "column_name", "change_request_ids", "change_types",
    "old_values", "new_values", "notes", "resolved",
]

COUNTED_VALUES = " distinct values, see conflict_values"

# Fixed texts.
OVERLAP_NOTE = "Multiple change requests modify the same cell"
STRUCTURAL_NOTE = "Multiple change requests apply structural changes to the same table"
FILL_NOTE = (
    "Row add + column add leave this cell without a value; "
    "add a Detail value_update (or row_add cell) or set "
    "resolved=Y if blank is intentional"
)


def _sorted_set(c: str) -> Column:
    return F.array_sort(F.collect_set(c)).alias(c)


def _no_values() -> Column:
    return F.array().cast("array<string>")


def overlapping_cells(log: DataFrame) -> DataFrame:
    """Cells touched by two requests or more, equal values included.

    ``repeated`` tells whether a request names the cell more than once: its key repeats then.
    """
    touched = log.where(F.col("change_type").isin(*CELL_TYPES) & (F.col("column_name") != ""))
    return (
        touched.groupBy(*CELL, "change_request_id").agg(F.count("*").alias("n"))
        .groupBy(*CELL).agg(F.count("*").alias("requests"), (F.max("n") > 1).alias("repeated"))
        .where("requests > 1").select(*CELL, "repeated")
    )


def overlap_values(log: DataFrame) -> DataFrame:
    """Long form of every overlapping cell: one row per distinct request, type, old and new text."""
    touched = log.where(F.col("change_type").isin(*CELL_TYPES) & (F.col("column_name") != ""))
    facts = F.array(*(
        F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
        for kind, c in (("cr", "change_request_id"), ("type", "change_type"), ("old", "old_value"), ("new", "new_value"))
    ))
    return (
        touched.join(overlapping_cells(log), CELL)
        .select(*CELL, "repeated", F.explode(facts).alias("fact")).select(*CELL, "repeated", "fact.*")
        .where("value is not null").distinct()
    )


def cell_overlaps(values: DataFrame) -> DataFrame:
    """One conflict per overlapping cell, with its values as sorted lists.

    The lists of a unique key are as short as the list of requests. Those of a repeated key
    have no bound: its texts stay in the long form, and the conflict says how many there are.
    """

    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))

    def texts(kind: str) -> Column:
        number = F.count(F.when(F.col("kind") == kind, True))
        short = F.collect_list(F.when((F.col("kind") == kind) & ~F.col("repeated"), F.col("value")))
        return F.when(
            F.col("repeated"), F.array(F.concat(number.cast("string"), F.lit(COUNTED_VALUES)))
        ).otherwise(F.array_sort(short))

    return values.groupBy(*CELL, "repeated").agg(
        listed("cr").alias("change_request_ids"), listed("type").alias("change_types"),
        texts("old").alias("old_values"), texts("new").alias("new_values"),
    ).select(
        F.lit("cell_overlap").alias("conflict_type"), *CELL, "change_request_ids", "change_types",
        "old_values", "new_values", F.lit(OVERLAP_NOTE).alias("notes"), F.lit("N").alias("resolved"),
    )


def structural_collisions(log: DataFrame) -> DataFrame:
    """Tables whose structure two requests or more change."""
    return (
        log.where(F.col("change_type").isin(*STRUCTURAL_TYPES)).groupBy("table_name")
        .agg(_sorted_set("change_request_id"), _sorted_set("change_type"))
        .where(F.size("change_request_id") >= 2)
        .select(
            F.lit("structural_collision").alias("conflict_type"), "table_name",
            F.lit("").alias("key_tuple"), F.lit("").alias("column_name"),
            F.col("change_request_id").alias("change_request_ids"), F.col("change_type").alias("change_types"),
            _no_values().alias("old_values"), _no_values().alias("new_values"),
            F.lit(STRUCTURAL_NOTE).alias("notes"), F.lit("N").alias("resolved"),
        )
    )


def missing_fills(log: DataFrame, steps: DataFrame) -> DataFrame:
    """Added rows without a cell for an added column.

    Every added key subtracts the columns it covers from its table's list of added columns,
    so only the missing cells are formed, never all keys times all columns.
    """
    columns = (
        log.where("change_type = 'column_add' and column_name <> ''").join(steps, ["change_request_id"])
        .groupBy("table_name", "column_name").agg(F.max_by("change_request_id", "step").alias("column_cr"))
        .groupBy("table_name").agg(F.collect_list(F.struct("column_name", "column_cr")).alias("added"))
    )
    is_add = F.col("change_type") == "row_add"
    keys = (
        log.where(F.col("change_type").isin("row_add", "value_update") & (F.col("key_tuple") != ""))
        .join(columns.select("table_name"), ["table_name"], "left_semi")
        .groupBy("table_name", "key_tuple")
        .agg(
            F.collect_set("column_name").alias("covered"),
            F.collect_set(F.when(is_add, F.col("change_request_id"))).alias("row_crs"),
        )
        .where(F.size("row_crs") > 0)
    )
    missing = F.filter("added", lambda c: ~F.array_contains(F.col("covered"), c["column_name"]))
    return (
        keys.join(columns, ["table_name"])
        .select("table_name", "key_tuple", "row_crs", F.explode(missing).alias("c"))
        .select(
            F.lit("missing_row_column_fill").alias("conflict_type"), "table_name", "key_tuple",
            F.col("c.column_name").alias("column_name"),
            F.array_sort(F.array_union("row_crs", F.array("c.column_cr"))).alias("change_request_ids"),
            F.array(F.lit("column_add"), F.lit("row_add")).alias("change_types"),
            _no_values().alias("old_values"), _no_values().alias("new_values"),
            F.lit(FILL_NOTE).alias("notes"), F.lit("N").alias("resolved"),
        )
    )


@dataclass(frozen=True)
class Conflicts:
    conflicts: DataFrame
    values: DataFrame


def detect_conflicts(log: DataFrame, steps: DataFrame) -> Conflicts:
    """All conflicts of a change log; ``steps`` gives the order of the requests."""
    values = overlap_values(log)
    conflicts = cell_overlaps(values).unionByName(structural_collisions(log)).unionByName(missing_fills(log, steps))
    return Conflicts(conflicts.select(*CONFLICT_COLUMNS), values)


def flat_conflicts(conflicts: DataFrame) -> DataFrame:
    """Conflicts with their lists as comma-separated text."""
    lists = {"change_request_ids", "change_types", "old_values", "new_values"}
    return conflicts.select(
        *(F.array_join(c, ", ").alias(c) if c in lists else F.col(c) for c in CONFLICT_COLUMNS)
    )
